"""Repeated runs of lines: windows grouped by hash, of which the first stays.

A run counts from ``MIN_LINES`` lines or ``MIN_WORDS`` words on; lines without a word are skipped.
From every line starts the shortest window that counts.  Repeats are found by grouping whole
windows by their hash, and windows whose text came earlier are deleted, unless they overlap its
first place; their union is every later repeat of a run, in full length.  The smallest line hash in a window (``seed``) only
filters before that: equal windows have equal minima, so a window whose minimum occurs once has
no repeat.  No positions are selected by it, and no match is extended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.shared import column, fresh

MIN_LINES = 3
MIN_WORDS = 50
_BASE = 0x9E3779B97F4A7C15


def line_windows(text: str | None, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS):
    """(fingerprint, hash, first line, last line) of each window, as arrays.

    Line numbers count all lines of the text from 0.
    """
    lines = (text or "").encode().split(b"\n")
    counts = np.array([len(x.split()) for x in lines])
    number = np.flatnonzero(counts)
    n = len(number)
    empty = np.zeros(0, np.int64)
    if not n:
        return empty, empty, empty, empty
    h = np.array([xxhash.xxh64_intdigest(lines[i]) for i in number], np.uint64)
    total = np.cumsum(counts[number])
    before = total - counts[number]
    last = np.minimum(np.arange(n) + min_lines - 1, np.searchsorted(total, before + min_words))
    start = np.flatnonzero(last < n)
    last = last[start]
    least = h[start].copy()
    mixed = h[start].copy()
    for j in range(1, min_lines):
        more = start + j <= last
        at = start[more] + j
        least[more] = np.minimum(least[more], h[at])
        mixed[more] = mixed[more] * np.uint64(_BASE) + h[at] + np.uint64(j)
    return least.view(np.int64), mixed.view(np.int64), number[start], number[last]


def fingerprints(docs: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """(doc, seed, window, first, last): all windows of the texts; ``doc`` says where they are."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_windows(t.as_py(), min_lines, min_words) for t in batch.column("text")]
            rows = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            columns = [np.concatenate([f[i] for f in found]) for i in range(4)] if found else []
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(pa.array(rows)), *map(pa.array, columns)],
                    ["doc", "seed", "window", "first", "last"],
                )

    kind = docs.select("doc").schema["doc"].dataType.simpleString()
    return docs.select("doc", "text").mapInArrow(
        find, f"doc {kind}, seed bigint, window bigint, first bigint, last bigint"
    )


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, first, last): windows that came earlier; ``docs`` has an ordered ``doc`` and ``text``.

    A window that shares a line with the first place of its text is no repeat of it.
    """
    windows = fingerprints(docs, min_lines, min_words)
    twice = windows.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    place = F.struct("doc", "first", "last")
    followed = windows.join(twice, "seed", "left_semi").withColumn("place", place)
    first = followed.groupBy("window").agg(F.min("place").alias("earliest"), F.count("*").alias("n"))
    later = followed.join(first.where("n > 1"), "window").where("place > earliest")
    overlaps = F.col("doc").eqNullSafe(F.col("earliest.doc")) & (F.col("first") <= F.col("earliest.last"))
    return later.where(~overlaps).select("doc", "first", "last")


def without_lines(text: str | None, runs: list[dict] | None) -> tuple[str | None, list[tuple[int, int]]]:
    """The text without the runs' lines that hold a word, and the runs united."""
    if text is None or not runs:
        return text, []
    united: list[list[int]] = []
    lines = text.split("\n")
    wordy = [bool(x.encode().split()) for x in lines]
    for first, last in sorted((r["first"], r["last"]) for r in runs):
        # Runs that touch, or have only lines without words between them, are one.
        if united and not any(wordy[united[-1][1] + 1 : first]):
            united[-1][1] = max(united[-1][1], last)
        else:
            united.append([first, last])
    gone = {i for a, z in united for i in range(a, z + 1) if wordy[i]}
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), [(a, z) for a, z in united]


def dedup_lines(
    df: DataFrame, key: str = "doc_id", text: str = "text",
    min_lines: int = MIN_LINES, min_words: int = MIN_WORDS,
) -> DataFrame:
    """All rows and columns plus ``clean_text`` and ``removed`` (runs of line numbers from 0).

    Documents are ordered by key, null keys last, and by content where keys are equal;
    rows equal in key and text count as one place, so neither is a repeat of the other.
    The first place of a run keeps it, and so do copies that overlap it: of six equal lines
    the last three go.  Null text stays null and empty text empty.  Lines
    without a word are never removed.  Input columns named like the new ones are replaced.
    """
    row, found, done = fresh([*df.columns, "clean_text", "removed"], "row", "runs", "cut")
    where = F.struct(
        column(key).isNull().alias("last"), column(key).alias("key"),
        F.xxhash64(column(text)).alias("content"),
    )
    docs = df.select(where.alias("doc"), column(text).alias("text"))
    runs = repeated_runs(docs, min_lines, min_words)
    per_doc = runs.groupBy(F.xxhash64("doc").alias(row)).agg(
        F.collect_set(F.struct("first", "last")).alias(found)
    )
    joined = df.drop("clean_text", "removed").withColumn(row, F.xxhash64(where)).join(per_doc, row, "left")
    kind = pa.struct(
        [
            ("text", pa.string()),
            ("removed", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
        ]
    )

    @F.arrow_udf("struct<text:string,removed:array<struct<first:int,last:int>>>")
    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        left = [without_lines(t.as_py(), r.as_py()) for t, r in zip(texts, runs)]
        return pa.array(
            [{"text": t, "removed": [{"first": a, "last": z} for a, z in u]} for t, u in left], kind
        )

    return joined.withColumn(done, cut(column(text), column(found))).withColumns(
        {"clean_text": column(done)["text"], "removed": column(done)["removed"]}
    ).drop(done, found, row)
