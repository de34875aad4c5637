"""Runs of words: stretches that repeat with a period, found by recompression.

A group of texts is one sequence of word codes, with a separator of its own before each text.
Recompression rewrites it level by level, in turn every block of equal symbols by one symbol
and every pair out of two halves of the alphabet by one symbol, until texts are single symbols.
Equal stretches are rewritten alike but for their edges, so the levels are a run-length grammar
in which the longest common extension of two places is read off in few steps: at each step the
largest symbol that begins (or ends) at both places and is equal at both is passed whole.

A run of period q and at least 2 q words holds two neighbours of the grid q, 2 q, 3 q, ...
The grid has n log n pairs over all periods.  Those whose words agree are extended both ways,
exactly, and the extended stretch is a run if it is long enough.  The smallest period of a
stretch is the smallest that gives the stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_LENGTH = 12
# Words of one sequence (a longer text is a sequence of its own), and grid pairs looked at in one step.
GROUP_WORDS = 200_000
STEP_PAIRS = 1_000_000
# Halves of the alphabet that are tried per level, and levels that may pass without progress.
SPLITS = 4
PATIENCE = 8

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.struct([("runs", pa.list_(RUN)), ("collapsed", pa.string())])
FOUND_DDL = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


# --- the grammar ------------------------------------------------------------------------


def halves(symbols: np.ndarray, seed: int) -> np.ndarray:
    """A seeded bit of every symbol."""
    x = (symbols.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(61)).astype(np.int64) & 1


def named(left: np.ndarray, right: np.ndarray, first: int) -> np.ndarray:
    """Equal pairs get equal symbols, from ``first`` on."""
    pairs = left.astype(np.int64) << 32 | right
    return (np.unique(pairs, return_inverse=True)[1] + first).astype(np.int32)


def block_starts(symbols: np.ndarray) -> np.ndarray:
    return np.r_[True, symbols[1:] != symbols[:-1]]


def block_round(symbols: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the new symbols begin, and what they are: one for each block of equal ones."""
    starts = np.flatnonzero(block_starts(symbols))
    power = np.diff(np.r_[starts, len(symbols)])
    new = symbols[starts]
    many = power > 1
    new[many] = named(new[many], power[many], free)
    return starts, new


def pair_round(symbols: np.ndarray, free: int, separators: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for pairs of a symbol of one half and one of the other after it.

    Of a few seeded halves those that join most pairs are taken.  Separators join nothing.
    """
    plain = symbols >= separators
    best = np.zeros(0, np.intp)
    for split in range(SPLITS):
        half = halves(symbols, seed * SPLITS + split)
        for first in (0, 1):
            joins = (half[:-1] == first) & (half[1:] != first) & plain[:-1] & plain[1:]
            if (found := np.flatnonzero(joins)).size > best.size:
                best = found
    stays = np.ones(len(symbols), bool)
    stays[best + 1] = False
    starts = np.flatnonzero(stays)
    new = symbols.copy()
    if best.size:
        new[best] = named(symbols[best], symbols[best + 1], free)
    return starts, new[starts]


class Grammar:
    """All levels of the recompressed sequence, in a few flat arrays.

    ``top[p]`` is the highest level at which a symbol begins at place p, and
    ``at[first[p] + k]`` its index among the symbols of all levels, for k up to there.
    ``symbol``, ``length``, ``after`` and ``upto`` say of an index: which symbol, how many
    words, and how many equal ones begin and end there on its level.
    """

    def __init__(self, codes: np.ndarray, separators: int) -> None:
        """``codes`` begin and end with a separator; separators are the codes below ``separators``."""
        n = len(codes)
        symbols, places = codes.astype(np.int32), np.arange(n, dtype=np.int32)
        free = int(symbols.max()) + 1
        levels, idle, turn = [], 0, 0
        while True:
            levels.append((symbols, places))
            if idle > PATIENCE or np.count_nonzero(symbols >= separators) < separators:
                break
            starts, new = block_round(symbols, free)
            if len(new) == len(symbols):
                starts, new = pair_round(symbols, free, separators, turn)
                turn += 1
            idle = idle + 1 if len(new) == len(symbols) else 0
            free = max(free, int(new.max()) + 1)
            symbols, places = new, places[starts]
            if idle:
                levels.pop()
        self.top = np.full(n, -1, np.int32)
        for _, places in levels:
            self.top[places] += 1
        self.first = np.cumsum(np.r_[0, self.top[:-1] + 1], dtype=np.int64)
        self.at = np.zeros(int(self.first[-1] + self.top[-1] + 1), np.int32)
        parts = ([], [], [], [])
        base = 0
        for k, (symbols, places) in enumerate(levels):
            self.at[self.first[places] + k] = base + np.arange(len(places))
            base += len(places)
            cuts = np.flatnonzero(block_starts(symbols))
            power = np.diff(np.r_[cuts, len(symbols)])
            inside = np.arange(len(symbols)) - np.repeat(cuts, power)
            for part, values in zip(
                parts, (symbols, np.diff(np.r_[places, n]), np.repeat(power, power) - inside, inside + 1)
            ):
                part.append(values.astype(np.int32))
        self.symbol, self.length, self.after, self.upto = map(np.concatenate, parts)

    def extend(self, p: np.ndarray, q: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words are equal from the places p and q on, or before them.

        A separator ends every extension, as no other place holds it.
        """
        side, power = (1, self.upto) if back else (0, self.after)
        sign = -1 if back else 1
        total = np.zeros(len(p), np.int64)
        live, p, q = np.arange(len(p)), p.copy(), q.copy()
        while live.size:
            # The highest level at which both places carry the same symbol; equal symbols
            # are equal on all levels below.
            low, high = np.full(live.size, -1), np.minimum(self.top[p], self.top[q])
            while (open_ := low < high).any():
                mid = (low + high + 1) // 2
                i, j = self.at[self.first[p] + mid] - side, self.at[self.first[q] + mid] - side
                same = self.symbol[i] == self.symbol[j]
                low = np.where(open_ & same, mid, low)
                high = np.where(open_ & ~same, mid - 1, high)
            found = low >= 0
            live, p, q, low = live[found], p[found], q[found], low[found]
            i, j = self.at[self.first[p] + low] - side, self.at[self.first[q] + low] - side
            step = np.minimum(power[i], power[j]) * self.length[i]
            total[live] += step
            p, q = p + sign * step, q + sign * step
        return total


# --- runs -------------------------------------------------------------------------------


def grid(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period): all k q with k >= 0 and k q + q inside a text, for q up to half of it."""
    periods = sizes // 2
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    places = (sizes[text] - 1) // period
    upto = np.cumsum(places)
    begin = 0
    while begin < len(text):
        done = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, done + STEP_PAIRS, "right")))
        here, n = slice(begin, end), places[begin:end]
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        q = np.repeat(period[here], n)
        yield np.repeat(starts[text[here]], n) + nth * q, q
        begin = end


def runs_of(codes: list[np.ndarray], min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """Per text the rows (start, length, period) of its runs, by start and period.

    A run has at least ``min_length`` words and twice its period, and no neighbouring
    word continues it.
    """
    sizes = np.array([len(c) for c in codes], np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    separators = len(codes) + 1
    sequence = np.zeros(int(sizes.sum()) + separators, np.int64)
    sequence[np.r_[0, starts + sizes]] = np.arange(separators)
    inside = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    sequence[inside] = np.concatenate(codes) + separators if codes else 0
    grammar = None
    found = [np.zeros((0, 3), np.int64)]
    for p, q in grid(starts, sizes):
        # A run's words agree one period on in a stretch of at least two that holds a grid place.
        agree = sequence[p] == sequence[p + q]
        p, q = p[agree], q[agree]
        beside = (sequence[p + 1] == sequence[p + q + 1]) | (sequence[p - 1] == sequence[p + q - 1])
        p, q = p[beside], q[beside]
        if not p.size:
            continue
        grammar = grammar or Grammar(sequence, separators)
        back = grammar.extend(p, p + q, back=True)
        length = back + q + grammar.extend(p, p + q)
        long = length >= np.maximum(min_length, 2 * q)
        found.append(np.stack([p - back, length, q], axis=1)[long])
    rows = np.concatenate(found)
    # One row per stretch, that of the smallest period.
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)][: len(rows)]
    rows = rows[new]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.r_[starts, len(sequence)])
    return [rows[a:z] - [start, 0, 0] for a, z, start in zip(cuts[:-1], cuts[1:], starts)]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay if each run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def collapse(texts: list[bytes], min_length: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """Per text its runs, and its words without repeats, joined by one space."""
    known: dict[bytes, int] = {}
    words = [text.split() for text in texts]
    fresh_code = count()
    codes = [np.fromiter(map(known.setdefault, w, fresh_code), np.int64, len(w)) for w in words]
    for own, runs in zip(words, runs_of(codes, min_length)):
        if len(runs):
            own = [own[i] for i in np.flatnonzero(kept_words(len(own), runs))]
        yield runs, b" ".join(own)


def groups(texts: pa.Array) -> Iterator[list[bytes]]:
    """Texts in order, about GROUP_WORDS words together; null is empty."""
    held, size = [], 0
    for text in texts:
        raw = (text.as_py() or "").encode()
        # A word and the space after it take two bytes at least.
        if held and size + len(raw) > 2 * GROUP_WORDS:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield held


def periodic_runs(text: Column, min_length: int = MIN_LENGTH) -> Column:
    """(runs, collapsed) of whole texts: runs as (start, length, period) and the words left.

    Words are numbered from 0.  A run is a stretch of consecutive words whose smallest period is
    ``period``, with at least ``min_length`` and 2 ``period`` words, that no neighbouring word
    continues; runs come by start, then period.  A word goes if any run contains it after
    that run's first ``period`` words.  Null and blank texts have no runs and collapse to
    the empty text.  Texts are handled row by row: nothing is shuffled, and keys, repeated
    rows, ties and other columns do not matter.
    """
    if min_length < 3:
        raise ValueError("runs of fewer than 3 words are not searched for")

    @F.arrow_udf(FOUND_DDL)
    def find(texts: pa.Array) -> pa.Array:
        lists, collapsed, sizes = [np.zeros((0, 3), np.int64)], [], []
        for group in groups(texts):
            for runs, left in collapse(group, min_length):
                lists.append(runs)
                sizes.append(len(runs))
                collapsed.append(left.decode())
        rows = np.concatenate(lists)
        structs = pa.StructArray.from_arrays([pa.array(rows[:, j]) for j in range(3)], fields=list(RUN))
        offsets = pa.array(np.cumsum([0, *sizes]).astype(np.int32))
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(offsets, structs), pa.array(collapsed, pa.string())], fields=list(FOUND)
        )

    return find(text)


def run_lines(runs: Column) -> Column:
    """``start,length,period`` and a line feed for every run."""
    line = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return F.concat(F.array_join(line, "\n"), F.when(F.size(runs) > 0, F.lit("\n")).otherwise(F.lit("")))


def greatest_run(runs: Column) -> Column:
    """The longest run, the first of equals, then that of the smaller period; null without runs."""
    better = lambda a, b: (b["length"] > a["length"]) | (
        (b["length"] == a["length"]) & ((b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["period"] < a["period"])))
    )
    return F.when(
        F.size(runs) > 0, F.reduce(runs, runs[0], lambda a, b: F.when(better(a, b), b).otherwise(a))
    )
