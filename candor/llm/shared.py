"""Pieces that several corpus operators use: tokens, seeded draws, staged tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.sources.staging import shared_folder

# A word is a run of characters other than space and the ASCII controls 9 to 13.
# In Python, bytes.split() cuts at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def keep(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Compute a table once, in the folder all executors share, and read it back.

    It cuts the lineage: a lost executor costs a re-read of its files.  The files
    go when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """Names for working columns that no given column has, in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        new = f"_{name}"
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        out.append(new)
    return out


def column(name: str) -> Column:
    """The top-level column of that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), GAP)
    # Only the first and the last part can be empty.
    edges = (F.element_at(parts, 1) == "").cast("bigint") + F.when(
        F.size(parts) > 1, (F.element_at(parts, -1) == "").cast("bigint")
    ).otherwise(F.lit(0))
    return F.size(parts).cast("bigint") - edges


def draw60(seed: int, *parts: Column) -> Column:
    """60 seeded bits of md5('seed:part:...') as a non-negative bigint; null reads as ''."""
    pieces = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    text = F.concat_ws(":", F.lit(str(seed)), *pieces)
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null reads as the empty text."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def key_fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; a null key counts as ''."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))
