"""Small documents and brute-force pieces that the corpus tests share."""

from __future__ import annotations

import re

import pyarrow.parquet as pq

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def read(sf_dir, name):
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


def documents(spark, rows):
    """Rows of (doc_id, text, source) as a documents table."""
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def odd_rows():
    """Nulls in every column, empty and blank texts, a long text, ties and repeated rows."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    return [
        (1, "Alpha beta gamma delta. " * 3, "a"), (1, "Alpha beta gamma delta. " * 3, "a"),
        (2, None, "a"), (3, "", None), (None, " \t\n ", "b"), (None, None, None),
        (4, long, "b"), (5, "ünïcode wörds — and 東京 too", "b"), (1, "another text, same key", None),
    ]
