"""Benchmark passages in documents: q-gram counts in diagonal bands, then banded alignment.

Texts are lower-cased and runs of white space become one space.  An item of n characters may
be off by k = n / 10 edits.  By the q-gram lemma an alignment within k edits shares at least
n + 1 - q - k q of the item's q-grams, all on k + 1 neighbouring diagonals.  Hits are counted
in bands of diagonals that overlap by k, so one band holds them all; only bands that reach
the bound are aligned.  Grams found in many items may go uncounted, in which case the bound
falls by one for each, so nothing is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.llm.shared import column, fresh, keep

Q = 8
EDIT_RATE = 0.1
MIN_CHARS = 20
# A gram in more places of the benchmark than this may go uncounted.
FREQUENT = 4
# Characters of benchmark text that one pass over the documents looks for.
ITEM_BLOCK = 2_000_000
# Characters of documents that are looked at in one step.
TEXT_BLOCK = 1_000_000
FILTER_BITS = 22

LEAK = "struct<item:string,edits:int,start:int,end:int>"
_BASE = 0x9E3779B97F4A7C15
_SPACES = np.array([32, 9, 10, 11, 12, 13, 0x85, 0xA0, 0x2028, 0x2029], np.uint32)


def _lower_table() -> np.ndarray:
    """Lower case of the basic plane, where that is a single character."""
    low = [c.lower() if not 0xD800 <= i < 0xE000 else c for i, c in enumerate(map(chr, range(65536)))]
    return np.array([ord(c) if len(c) == 1 else i for i, c in enumerate(low)], np.uint32)


_LOWER = _lower_table()


def normalised(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points, and the position each had."""
    basic = codes < 65536
    out = codes.copy()
    out[basic] = _LOWER[codes[basic]]
    space = np.isin(out, _SPACES)
    out[space] = 32
    kept = np.flatnonzero(~(space & np.r_[False, space[:-1]]))
    return out[kept], kept


def text_codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of Q characters; Q is a power of two."""
    h = codes.astype(np.uint64) + np.uint64(1)
    factor, width = _BASE, 1
    while width < Q:
        h = h[:-width] * np.uint64(factor) + h[width:] if len(h) > width else h[:0]
        factor, width = factor * factor % 2**64, 2 * width
    return h ^ (h >> np.uint64(31))


@dataclass
class Index:
    """The grams of some benchmark items, and each item's length, budget and bound."""

    names: list[str | None]
    codes: list[np.ndarray]
    budget: np.ndarray
    bound: np.ndarray
    stride: np.ndarray
    grams: np.ndarray
    starts: np.ndarray
    entry_item: np.ndarray
    entry_at: np.ndarray
    present: np.ndarray
    longest: int


def build_index(items: list[tuple[str | None, str]]) -> Index | None:
    """Index of the items with at least MIN_CHARS normalised characters; None if there is none."""
    names, codes = [], []
    for name, text in items:
        own = normalised(text_codes(text.strip()))[0]
        if len(own) >= MIN_CHARS:
            names.append(name)
            codes.append(own)
    if not names:
        return None
    sizes = np.array([len(c) for c in codes])
    # The largest budget that leaves a bound of one gram or more.
    budget = np.minimum((sizes * EDIT_RATE).astype(np.int64), (sizes - Q) // Q)
    bound = sizes + 1 - Q - budget * Q
    hashes = [gram_hashes(c) for c in codes]
    every = np.concatenate(hashes)
    distinct, code, times = np.unique(every, return_inverse=True, return_counts=True)
    item = np.repeat(np.arange(len(names)), [len(h) for h in hashes])
    at = np.concatenate([np.arange(len(h)) for h in hashes])
    counted = np.ones(len(every), bool)
    begin = 0
    for i, h in enumerate(hashes):
        own = times[code[begin : begin + len(h)]]
        # Half of the bound at most goes to grams that many items have.
        often = np.argsort(-own, kind="stable")[: bound[i] // 2]
        often = often[own[often] > FREQUENT]
        counted[begin + often] = False
        bound[i] -= len(often)
        begin += len(h)
    order = np.argsort(code[counted], kind="stable")
    used, starts = np.unique(code[counted][order], return_index=True)
    grams = distinct[used]
    present = np.zeros(1 << FILTER_BITS, bool)
    present[grams >> np.uint64(64 - FILTER_BITS)] = True
    stride = 1 << np.maximum(4, np.ceil(np.log2(budget + 1)).astype(np.int64))
    return Index(
        names, codes, budget, bound, stride, grams, np.r_[starts, len(order)],
        item[counted][order], at[counted][order], present, int(sizes.max()),
    )


def banded_edits(item: np.ndarray, region: np.ndarray, first: int, width: int) -> tuple[int, int, int]:
    """Least edits that turn the item into a part of the region, with that part's ends.

    Only cells on diagonals first to first + width - 1 (region position minus item
    position) are filled.  Ends in the region are free.
    """
    far = 1 << 20
    n, slots = len(item), np.arange(width)
    at = first + slots
    inside = (at >= 0) & (at <= len(region))
    cost = np.where(inside, 0, far)
    origin = np.where(inside, at, 0)
    padded = np.full(len(region) + 2 * (width + n) + abs(first) + 2, 0xFFFFFFFF, np.uint32)
    shift = width + n + abs(first) + 1
    padded[shift : shift + len(region)] = region
    for i in range(n):
        # Slot s of row i + 1 ends at region position first + s + i + 1.
        letters = padded[shift + first + i : shift + first + i + width]
        diagonal = cost + (letters != item[i])
        skipped = np.r_[cost[1:] + 1, far]
        take = skipped < diagonal
        new = np.where(take, skipped, diagonal)
        source = np.where(take, np.r_[origin[1:], 0], origin)
        # A letter of the region left over: from the slot before, one edit each.
        lead = new - slots
        low = np.minimum.accumulate(lead)
        where = np.maximum.accumulate(np.where(lead == low, slots, 0))
        cost = np.minimum(low + slots, far)
        origin = source[where]
        end = first + slots + i + 1
        cost = np.where((end >= 0) & (end <= len(region)), cost, far)
    best = int(np.argmin(cost))
    return int(cost[best]), int(origin[best]), first + best + n


def find_in_block(texts: list[str], index: Index) -> list[list[tuple[str | None, int, int, int]]]:
    """Per text: (item, edits, start, end) of the best alignment with each item in budget."""
    raw = [text_codes(t) for t in texts]
    parts = [normalised(c) for c in raw]
    lengths = np.array([len(p[0]) for p in parts])
    begins = np.cumsum(np.r_[0, lengths + 1])
    # A zero between texts; no item has one, as hashes start from code + 1.
    codes = np.zeros(int(begins[-1]), np.uint32)
    for (own, _), begin in zip(parts, begins):
        codes[begin : begin + len(own)] = own
    out: list[list[tuple[str | None, int, int, int]]] = [[] for _ in texts]
    hashes = gram_hashes(codes)
    at = np.flatnonzero(index.present[hashes >> np.uint64(64 - FILTER_BITS)])
    row = np.searchsorted(index.grams, hashes[at])
    row = np.minimum(row, len(index.grams) - 1)
    real = index.grams[row] == hashes[at]
    at, row = at[real], row[real]
    if not len(at):
        return out
    times = index.starts[row + 1] - index.starts[row]
    hit = np.repeat(np.arange(len(at)), times)
    entry = np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times) + index.starts[row][hit]
    item = index.entry_item[entry]
    doc = np.searchsorted(begins, at, "right") - 1
    doc = doc[hit]
    diagonal = at[hit] - begins[doc] - index.entry_at[entry] + index.longest
    stride = index.stride[item]
    band = diagonal // stride
    also = diagonal % stride < index.budget[item]
    key = np.r_[band, band[also] - 1] + 1
    key |= np.r_[item, item[also]] << 24
    key |= np.r_[doc, doc[also]] << 44
    keys, counts = np.unique(key, return_counts=True)
    reached = counts >= index.bound[(keys >> 24) & 0xFFFFF]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for k in keys[reached].tolist():
        d, i, b = k >> 44, (k >> 24) & 0xFFFFF, (k & 0xFFFFFF) - 1
        if best.get((d, i), (1,))[0] == 0:
            continue
        wanted, budget = index.codes[i], int(index.budget[i])
        first = b * int(index.stride[i]) - index.longest
        width = int(index.stride[i]) + budget + 1
        own, where = parts[d]
        low = max(0, first)
        region = own[low : max(0, first + width + len(wanted) + budget)]
        exact = region.tobytes().find(wanted.tobytes())
        if exact >= 0 and exact % 4 == 0:
            edits, s, e = 0, exact // 4, exact // 4 + len(wanted)
        else:
            edits, s, e = banded_edits(wanted, region, first - low, width)
        if edits <= budget and (edits, low + s) < best.get((d, i), (budget + 1, 0))[:2]:
            best[d, i] = (edits, low + s, low + e)
    for (d, i), (edits, s, e) in sorted(best.items()):
        where = parts[d][1]
        out[d].append((index.names[i], edits, int(where[s]), int(where[e - 1]) + 1))
    return out


def leaks(text: Column, index: Index) -> Column:
    """All leaks of the index's items in a text, as an array of LEAK."""
    fields = pa.struct([("item", pa.string()), ("edits", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    @F.arrow_udf(f"array<{LEAK}>")
    def find(texts: pa.Array) -> pa.Array:
        found, held, size = [], [], 0
        for t in texts:
            own = t.as_py() or ""
            held.append(own)
            size += len(own)
            if size > TEXT_BLOCK:
                found += find_in_block(held, index)
                held, size = [], 0
        if held:
            found += find_in_block(held, index)
        named = [[dict(zip(("item", "edits", "start", "end"), x)) for x in doc] for doc in found]
        return pa.array(named, pa.list_(fields))

    return find(text)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id",
    item_text: str = "text", item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """``docs`` with the column ``leaks``: (item, edits, start, end) by item, in code points.

    Every item is looked for in every whole text.  The benchmark comes in blocks of about
    ``item_block`` characters; with several, the documents are passed over once for each
    and written between, so a worker never holds more than one block.  Null texts and
    items are empty; items under MIN_CHARS characters are too short to tell a leak from
    chance and match nothing.  An item listed twice is reported twice.  An input
    column called ``leaks`` is replaced.
    """
    empty = F.array().cast(f"array<{LEAK}>")
    found = docs.withColumn("leaks", empty)
    items = benchmark.select(
        column(item_key).cast("string").alias("name"), column(item_text).cast("string").alias("text")
    ).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // item_block))
    block = F.pmod(F.xxhash64("name", "text"), F.lit(blocks))
    for b in range(blocks):
        own = sorted(
            ((r["name"], r["text"]) for r in items.where(block == b).collect()),
            key=lambda x: (x[0] is None, len(x[0] or ""), x),
        )
        index = build_index(own)
        if index is not None:
            found = found.withColumn("leaks", F.concat("leaks", leaks(column(text), index)))
            found = keep(found, "leaks") if blocks > 1 else found
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **names: str) -> DataFrame:
    """The rows without a leak, with the columns they came with."""
    [mark] = fresh(docs.columns, "leaks")
    clash = "leaks" in docs.columns
    source = docs.withColumnRenamed("leaks", mark) if clash else docs
    own = mark if text == "leaks" else text
    clean = find_leaks(source, benchmark, own, **names).where(F.size("leaks") == 0).drop("leaks")
    return clean.withColumnRenamed(mark, "leaks") if clash else clean
