"""Shards that each hold every source in its share: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.ranking import ROWS_PER_BUCKET, bucket_of, prefix_sums
from candor.llm.shared import column, draw60, fresh, keep


def interleaved_shards(
    df: DataFrame,
    shards: int,
    key: str = "doc_id",
    source: str = "source",
    seed: int = 17,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... in the shard) to every row.

    A seeded draw orders the rows of a source; a row's fractional rank is
    (rank - 1/2) / rows of the source.  Sorted by it, the rows of all sources
    interleave in proportion, and cutting that order into equal runs gives every
    shard each source's share up to rounding, and row counts at most one apart.

    Ties of the draw go by key, equal fractional ranks by source.  A null source is a
    source of its own and null keys come first.  Repeated rows are rows like any
    other; it does not matter which of two equal ones takes which slot.  Input columns
    called ``shard`` or ``slot`` are replaced.  An empty table gives an empty result,
    and fewer rows than shards leave some shards empty.
    """
    rows = df.count()
    group, whole, draw, rank, size, part, place, ties = fresh(
        df.columns, "group", "whole", "draw", "rank", "size", "part", "place", "ties"
    )
    named = F.coalesce(F.concat(F.lit("="), column(source).cast("string")), F.lit(""))
    # Rows that share a key are told apart by their content.
    content = F.xxhash64(*[column(c) for c, kind in df.dtypes if not kind.startswith("map")])
    drawn = df.withColumns({group: named, draw: draw60(seed, column(key)), ties: content})
    # Written first: its size is then known, and few sources join without a shuffle.
    per_source = keep(drawn.groupBy(group).agg(F.count("*").alias(size)), "source-rows")
    drawn = drawn.join(per_source, group)
    ranked = prefix_sums(
        drawn,
        group,
        bucket_of(column(draw) / F.lit(2.0**60), column(size), rows_per_bucket),
        [column(draw), column(key).asc_nulls_first(), column(ties)],
        {rank: F.lit(1)},
    )
    # (rank - 1/2) / size, with rank counted from 1.
    fraction = (2 * column(rank) + 1) / (2 * column(size))
    ranked = ranked.withColumns({part: fraction, whole: F.lit(0)})
    placed = prefix_sums(
        ranked,
        whole,
        bucket_of(column(part), F.lit(max(1, rows)), rows_per_bucket),
        [column(part), column(group), column(draw), column(key).asc_nulls_first(), column(ties)],
        {place: F.lit(1)},
    )
    # Whole-number arithmetic: the first place of shard s is ceil(s * rows / shards).
    shard = F.expr(f"({place} * {shards}) div {max(1, rows)}")
    first = F.expr(f"(shard * {rows} + {shards} - 1) div {shards}")
    return (
        placed.withColumn("shard", shard)
        .withColumn("slot", (column(place) - first).cast("bigint"))
        .withColumn("shard", F.col("shard").cast("int"))
        .drop(group, whole, draw, rank, size, part, place, ties)
    )
