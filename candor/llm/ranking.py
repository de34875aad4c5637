"""Ranks and prefix sums inside groups of any size, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.llm.shared import column, fresh

ROWS_PER_BUCKET = 1024


def bucket_of(share: Column, rows: Column, rows_per_bucket: int = ROWS_PER_BUCKET) -> Column:
    """Bucket of a number in [0, 1) in a group of so many rows: about as many buckets as it fills."""
    buckets = F.ceil(rows / rows_per_bucket)
    return F.least(F.floor(share * buckets), buckets - 1)


def prefix_sums(
    df: DataFrame,
    group: str,
    bucket: Column,
    order: list[Column],
    values: dict[str, Column],
) -> DataFrame:
    """Add each value's sum over the rows of the group that come before this one.

    ``bucket`` is a number that never falls along ``order`` and spreads each group
    over many buckets.  Bucket totals are summed first; every row then adds what
    precedes it inside its own bucket.  The rows are shuffled once, by (group,
    bucket), and the totals have one row for each of those.  ``group`` has no nulls.
    """
    cut, *parts = fresh(df.columns, "bucket", *[f"part{i}" for i in range(len(values))])
    starts = fresh([*df.columns, cut, *parts], *[f"start{i}" for i in range(len(values))])
    rows = df.withColumns({cut: bucket} | dict(zip(parts, values.values())))
    totals = rows.groupBy(group, cut).agg(*[F.sum(p).alias(s) for p, s in zip(parts, starts)])
    earlier = Window.partitionBy(group).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        group, cut, *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(s) for s in starts]
    )
    inside = Window.partitionBy(group, cut).orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(totals, [group, cut])
    sums = {
        name: column(s) + F.coalesce(F.sum(p).over(inside), F.lit(0))
        for name, p, s in zip(values, parts, starts)
    }
    return joined.withColumns(sums).drop(cut, *parts, *starts)
