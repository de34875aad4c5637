"""Quality rules whose cutoffs are certified on labelled documents.

Every document gets rule statistics from its whole text.  For each stratum and
rule, labelled good documents tell how many a cutoff would wrongly reject, and an
exact binomial test decides whether the true rate can be above the allowed risk.
Cutoffs are tried from the loosest to the strictest, and the first one that fails
ends the sequence, so that each stratum and rule spends its share of the error
probability once (fixed-sequence testing, Bonferroni over strata and rules).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.llm.shared import column, fresh, keep

SYMBOLS = b"#*$%&|<>"
WINDOW = 8

STATS = {
    "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint",
    "n_dup_lines": "bigint", "n_repeat_words": "bigint", "n_lines": "bigint",
    "n_exclaim": "bigint",
}
STATS_TYPE = "struct<" + ",".join(f"{k}:{v}" for k, v in STATS.items()) + ">"

# Rule name -> (numerator, denominator) over the statistics; a document fails a rule
# above its cutoff.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "exclaim": ("n_exclaim", "n_words"),
}


@dataclass(frozen=True)
class Risk:
    """At most ``rate`` of a stratum's good documents fail the rules, with error ``delta`` overall.

    The rate is shared evenly by the rules.  Cutoffs are j / steps for j = steps - 1 down
    to 0.  Among certified cutoffs the one that rejects the largest share of bad
    documents is taken, where a share of good ones costs ``cost`` times as much.
    """

    rate: float = 0.05
    delta: float = 0.05
    steps: int = 100
    cost: float = 5.0


def _repeat_words(words: list[bytes]) -> int:
    """Words in 8-word windows that occur twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    keys = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        keys = keys * np.uint64(0x100000001B3) + mixed[j : j + n]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[WINDOW : WINDOW + n] -= twice
    return int((np.cumsum(edges)[:-1] > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The statistics of one whole text, in the order of STATS; null is the empty text."""
    raw = (text or "").encode()
    words = raw.split()
    codes = np.frombuffer(raw, np.uint8)
    counts = np.bincount(codes, minlength=256)
    points = int(counts[:128].sum() + counts[192:].sum())
    spaces = int(counts[9:14].sum() + counts[32])
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    return (
        len(words),
        points - spaces,
        int(sum(counts[c] for c in SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeat_words(words),
        len(lines),
        int(counts[33]),
    )


def document_stats(text: Column) -> Column:
    """The statistics as a struct column."""
    fields = pa.schema([(k, pa.int64()) for k in STATS])

    @F.arrow_udf(STATS_TYPE)
    def stats(texts: pa.Array) -> pa.Array:
        found = [text_stats(t.as_py()) for t in texts]
        columns = list(zip(*found)) if found else [()] * len(STATS)
        return pa.StructArray.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], fields=list(fields)
        )

    # Marked so that a filter on the statistics does not make Spark take them twice.
    return stats.asNondeterministic()(text)


def base_failed(stats: Column) -> Column:
    """Too short, or too many of the words repeat."""
    return (stats["n_words"] < 20) | (100 * stats["n_repeat_words"] > 30 * stats["n_words"])


def rule_level(stats: Column, rule: str, steps: int) -> Column:
    """The rule's ratio in whole steps, rounded up: a cutoff of j / steps rejects levels over j."""
    top, bottom = RULES[rule]
    ratio = F.ceil(steps * stats[top] / F.greatest(stats[bottom], F.lit(1)))
    return F.least(ratio, F.lit(steps)).cast("int")


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p)."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i])
    return float(np.exp(logs + i * math.log(p) + (n - i) * math.log1p(-p)).sum())


def certified_cutoff(good: dict[int, int], bad: dict[int, int], risk: Risk, delta: float) -> int | None:
    """The best cutoff (in steps) that the sequence of tests reaches, or None.

    ``good`` and ``bad``: number of labelled documents at each level of the rule.
    Without any bad document rejected, or without gain, there is no cutoff; of equally
    good ones the loosest is taken.
    """
    rate = risk.rate / len(RULES)
    n_good, n_bad = sum(good.values()), sum(bad.values())
    wrong, right, best, most = 0, 0, None, 0.0
    for cutoff in range(risk.steps - 1, -1, -1):
        wrong += good.get(cutoff + 1, 0)
        right += bad.get(cutoff + 1, 0)
        # More than this many can't pass, and the sum over them would be long.
        if wrong > rate * n_good or binomial_cdf(wrong, n_good, rate) > delta:
            break
        gain = right / max(1, n_bad) - risk.cost * wrong / n_good
        if gain > most:
            best, most = cutoff, gain
    return best


def fit_cutoffs(labelled: DataFrame, stratum: str, stats: str, good: str, risk: Risk) -> DataFrame:
    """(stratum, rule, cutoff) from labelled documents; only certified cutoffs appear.

    Counts per (stratum, rule, level) are summed before the shuffle, so a stratum
    reaches its task as at most rules x steps rows.
    """
    level = F.explode(
        F.array(
            *[
                F.struct(F.lit(r).alias("rule"), rule_level(column(stats), r, risk.steps).alias("level"))
                for r in RULES
            ]
        )
    )
    cells = labelled.select(column(stratum).alias("stratum"), column(good).alias("good"), level.alias("x"))
    cells = cells.groupBy("stratum", "x.rule", "x.level", "good").agg(F.count("*").alias("n"))
    cells = keep(cells, "levels")
    strata = cells.select("stratum").distinct().count()
    delta = risk.delta / max(1, strata * len(RULES))

    def test(cell: pd.DataFrame) -> pd.DataFrame:
        good, bad = cell[cell.good], cell[~cell.good]
        cutoff = certified_cutoff(
            dict(zip(good.level, good.n)), dict(zip(bad.level, bad.n)), risk, delta
        )
        first = cell.iloc[:1]
        return pd.DataFrame(
            {"stratum": first.stratum, "rule": first.rule, "cutoff": [cutoff]}
        ).dropna(subset=["cutoff"])

    return cells.groupBy("stratum", "rule").applyInPandas(
        test, "stratum string, rule string, cutoff int"
    )


def apply_rules(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    good: str = "quality",
    risk: Risk = Risk(),
) -> DataFrame:
    """All rows and columns of ``docs`` plus ``stats``, ``base_failed``, ``failed_rules``, ``kept``.

    Null text counts as empty and fails the base rules; a null stratum is a stratum of
    its own; one without enough labels has no cutoffs, so only the base rules apply.
    Repeated rows each get a row.  Input columns named like the new ones are replaced.
    Without labels the base rules alone decide.  A key labelled twice counts once, as
    its lowest label; null labels and null keys are not used.
    """
    name, cuts = fresh(docs.columns, "stratum", "cuts")
    named = F.coalesce(F.concat(F.lit("="), column(stratum).cast("string")), F.lit(""))
    labelled = labels.select(column(key).alias("_id"), column(good).alias("_good")).dropna()
    labelled = labelled.groupBy("_id").agg((F.min("_good") == 1).alias("_good"))
    # Only statistics meet the labels, so that no text is shuffled.
    holdout = docs.select(
        column(key).alias("_id"), named.alias("_stratum"), document_stats(column(text)).alias("_stats")
    ).join(labelled, "_id")
    per_stratum = fit_cutoffs(holdout, "_stratum", "_stats", "_good", risk).groupBy(
        F.col("stratum").alias(name)
    ).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias(cuts))
    # Written first: its size is then known, and a small table joins without a shuffle.
    per_stratum = keep(per_stratum, "cutoffs")
    kept = docs.withColumns({"stats": document_stats(column(text)), name: named})
    stats = column("stats")
    failed = F.filter(
        F.array(
            *[
                F.when(rule_level(stats, r, risk.steps) > column(cuts)[r], F.lit(r))
                for r in RULES
            ]
        ),
        lambda r: r.isNotNull(),
    )
    judged = kept.join(per_stratum, name, "left").withColumns(
        {"base_failed": base_failed(stats), "failed_rules": failed}
    )
    return judged.withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    ).drop(name, cuts)

