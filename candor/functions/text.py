"""Text expressions: cleaning, tokens, n-grams, sequences, synonym replacement.

All patterns name Unicode classes explicitly, because a plain ``\\w`` or ``\\s``
is ASCII-only in Java and would drop accented letters.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from candor.functions.arrays import let, run_lengths
from candor.functions.seeded import hash60
from candor.functions.stopwords import ENGLISH

# Kept characters, whitespace and token patterns.
DROPPED = r"[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x85.,!?-]+"
WHITESPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"
NOT_BLANK = r"[^\s\p{Z}\x1c-\x1f\x85]"
TOKEN = r"[\p{L}\p{N}_]{2,}"
EDGE_PUNCTUATION = ".,!?;:"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(value: Column | str) -> Column:
    """The value as a string; null becomes the empty string."""
    return F.coalesce(_col(value).cast("string"), F.lit(""))


def clean_text(text: Column | str) -> Column:
    """Lowercase; keep word characters, whitespace and ``. , ! ? -``; squeeze spaces."""
    kept = F.regexp_replace(F.lower(as_text(text)), DROPPED, "")
    return F.trim(F.regexp_replace(kept, WHITESPACE, " "))


def tokenize(text: Column | str) -> Column:
    """Lowercased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(as_text(text)), F.lit(TOKEN), F.lit(0))


def clean_tokens(text: Column | str) -> Column:
    """The tokens of the cleaned text.

    Equal to ``tokenize(clean_text(text))``, without the pass that squeezes
    whitespace, which no token can hold.
    """
    kept = F.regexp_replace(F.lower(as_text(text)), DROPPED, "")
    return F.regexp_extract_all(kept, F.lit(TOKEN), F.lit(0))


def split_words(text: Column | str) -> Column:
    """Whitespace-separated words, without empty ones."""
    return F.filter(F.split(as_text(text), WHITESPACE), lambda w: w != "")


def remove_stop_words(tokens: Column | str, stop_words: Sequence[str] = ENGLISH) -> Column:
    words = sorted(set(stop_words))
    return F.filter(_col(tokens), lambda t: ~t.isin(words))


def ngrams(tokens: Column | str, low: int = 1, high: int = 1) -> Column:
    """All n-grams with ``low <= n <= high``, shorter ones first, words joined by a space."""

    def of_size(t: Column, n: int) -> Column:
        grams = t
        for shift in range(1, n):
            grams = F.zip_with(
                F.slice(grams, F.lit(1), F.greatest(F.size(t) - shift, F.lit(0))),
                F.slice(t, F.lit(shift + 1), F.size(t)),
                # Much cheaper in a lambda than concat_ws; words are never null.
                lambda a, b: F.concat(a, F.lit(" "), b),
            )
        return grams

    tokens = _col(tokens)
    if (low, high) == (1, 1):
        return tokens
    return let(tokens, lambda t: F.concat(*[of_size(t, n) for n in range(low, high + 1)]))


def term_counts(tokens: Column | str) -> Column:
    """Array of (term, tf) per row, counted inside the row."""
    return run_lengths(_col(tokens), "term", "tf")


def preview(text: Column | str, width: int = 100) -> Column:
    return F.substring(as_text(text), 1, width)


def file_safe_name(name: Column | str) -> Column:
    """Lowercase with spaces as underscores, for result file names."""
    return F.replace(F.lower(_col(name)), F.lit(" "), F.lit("_"))


def holds_phrase(cleaned: Column | str, phrase: str) -> Column:
    """True where a cleaned text holds the phrase as whole words."""
    edge = r"[^\p{L}\p{N}_]"
    return _col(cleaned).rlike(f"(^|{edge}){re.escape(phrase.lower())}($|{edge})")


def pad_to(values: Column, length: int, filler: Column) -> Column:
    """First ``length`` entries, padded on the right."""
    kept = F.slice(values, F.lit(1), F.lit(length))
    return let(kept, lambda v: F.concat(v, F.array_repeat(filler, F.lit(length) - F.size(v))))


def synonym_replace(
    text: Column | str,
    key: Column | str,
    synonyms: Mapping[str, Sequence[str]],
    share: float = 0.2,
    seed: int = 42,
) -> Column:
    """Replace dictionary words at seeded random positions, drawn with replacement.

    ``max(1, int(n * share))`` draws are made over the ``n`` words of a text; a
    later draw at the same position sees the word an earlier one put there.
    Texts under three words are returned untouched.

    Draws that meet no dictionary word are dropped first.  The rest are merged
    with the positions by one sort, so the work is n log n in the text length.
    """
    text, key = _col(text), _col(key)
    if not synonyms:
        return text
    heads = sorted(synonyms)
    choices = F.from_json(
        F.lit(json.dumps({h: list(synonyms[h]) for h in heads})), "map<string,array<string>>"
    )
    # An event is one bigint: position, then 0 for the word itself or 1 + draw number.
    draw_bits = 31

    def event(position: Column, rank: Column | int) -> Column:
        return F.shiftleft(position.cast("bigint"), draw_bits) + rank

    def position_of(code: Column) -> Column:
        return F.shiftright(code, draw_bits).cast("int")

    def bare(word: Column) -> Column:
        return F.btrim(F.lower(word), F.lit(EDGE_PUNCTUATION))

    def replace(word: Column, code: Column) -> Column:
        draw = code.bitwiseAND(F.lit(2**draw_bits - 1)) - 1
        options = F.element_at(choices, bare(word))
        pick = F.pmod(hash60(seed, F.lit("choice"), key, draw), F.size(options)).cast("int")
        return F.when(bare(word).isin(heads), F.get(options, pick)).otherwise(word)

    def rewrite(words: Column) -> Column:
        n = F.size(words)
        n_draws = F.greatest(F.lit(1), F.floor(n * F.lit(float(share))).cast("int"))
        drawn = F.transform(
            F.sequence(F.lit(0), n_draws - 1),
            lambda d: event(F.pmod(hash60(seed, F.lit("position"), key, d), n), d + 1),
        )
        hits = F.filter(drawn, lambda c: bare(F.get(words, position_of(c))).isin(heads))
        return let(
            hits,
            lambda h: F.when(F.size(h) == 0, F.concat_ws(" ", words)).otherwise(
                let(
                    F.array_sort(F.concat(F.transform(words, lambda _, i: event(i, 0)), h)),
                    lambda events: fold(events, words),
                )
            ),
        )

    def fold(events: Column, words: Column) -> Column:
        # Every word's event starts a run that holds the draws made at its position.
        starts = F.filter(
            F.transform(
                events, lambda c, i: F.when(c.bitwiseAND(F.lit(2**draw_bits - 1)) == 0, i)
            ),
            lambda i: i.isNotNull(),
        )
        return let(
            starts,
            lambda s: F.concat_ws(
                " ",
                F.zip_with(
                    s,
                    F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.size(events))),
                    lambda here, after: F.aggregate(
                        F.slice(events, here + 2, after - here - 1),
                        F.get(words, position_of(F.get(events, here))),
                        replace,
                    ),
                ),
            ),
        )

    return let(split_words(text), lambda w: F.when(F.size(w) < 3, text).otherwise(rewrite(w)))
