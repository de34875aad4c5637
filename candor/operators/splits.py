"""Exact seeded partitions: stratified and nested splits, folds, subsets.

Rows of a class are put in a random but repeatable order by a seeded hash of
their key.  A partition gives each class a list of cumulative block sizes, and
a block is a run of ranks in that order.

No row is ranked globally.  A histogram over hash prefixes finds the prefix in
which each block ends, a window over only those prefixes finds the last
(hash, key) of the block, and the rows are then compared with that handful of
boundaries.  So two passes read just label and key, the data itself is never
shuffled, and one huge class costs no more than many small ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candor.functions.seeded import HASH_BITS, hash60
from candor.operators.lookup import small_table

# Rows that share a hash prefix, on average.
ROWS_PER_PREFIX = 4096
MAX_PREFIX_BITS = 30
# Prefixes of prefixes, of which the driver adds up the rows.
TOP_BITS = 10

CutRule = Callable[[DataFrame], DataFrame]


def _bucket(hashed: Column, bits: int) -> Column:
    return F.shiftright(hashed, HASH_BITS - bits).cast("int")


def prefix_bits_for(rows: int) -> int:
    """Enough bits for prefixes of about ROWS_PER_PREFIX rows, however many rows there are."""
    return min(MAX_PREFIX_BITS, max(1, (rows // ROWS_PER_PREFIX).bit_length()))


def train_quota(n: Column, total: Column, wanted: Column, label: str) -> Column:
    """Rows per class so that the quotas sum to ``wanted``, by largest remainder.

    For use on a one-row-per-class table; ties go to the first label.
    """
    share = n.cast("decimal(19,0)") * wanted.cast("decimal(19,0)")
    base = F.floor(share / total).cast("bigint")
    remainder = share - base * total
    left_over = wanted - F.sum(base).over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(remainder.desc(), F.col(label)))
    return base + (place <= left_over).cast("bigint")


def held_out_size(total: Column, fraction: float) -> Column:
    """ceil(total * fraction), the size of a held-out part."""
    return F.ceil(total * F.lit(float(fraction))).cast("bigint")


def nested_cuts(fractions: Sequence[float], label: str) -> CutRule:
    """Hold out one fraction after another, each of what the earlier ones left."""

    def rule(counts: DataFrame) -> DataFrame:
        table = counts.withColumn("rest", F.col("n")).withColumn("cuts", F.array().cast("array<bigint>"))
        for fraction in fractions:
            total = F.sum("rest").over(Window.partitionBy())
            table = table.withColumn("total", total)
            table = table.withColumn("kept_total", F.col("total") - held_out_size(F.col("total"), fraction))
            kept = train_quota(F.col("rest"), F.col("total"), F.col("kept_total"), label)
            table = table.withColumn("rest", kept).withColumn(
                "cuts", F.concat("cuts", F.array(F.col("n") - F.col("rest")))
            )
        return table.select(label, "cuts")

    return rule


def fold_cuts(k: int, label: str) -> CutRule:
    """k folds, balanced within every class and, to one row, over all rows.

    With the classes laid end to end in label order, position p goes to fold
    p mod k; a class gets in each fold as many rows as it has such positions.
    """

    def positions_up_to(x: Column, fold: Column) -> Column:
        whole = F.floor(x / k).cast("bigint")
        return whole * (fold + 1) + F.least(x - whole * k, (fold + 1).cast("bigint"))

    def rule(counts: DataFrame) -> DataFrame:
        before = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        return placed.select(
            label,
            F.transform(
                F.sequence(F.lit(0), F.lit(k - 2)),
                lambda f: positions_up_to(F.col("start") + F.col("n"), f)
                - positions_up_to(F.col("start"), f),
            ).alias("cuts"),
        )

    return rule


def subset_cuts(size: int, label: str) -> CutRule:
    """One block with ``size`` rows in all, class shares kept."""

    def rule(counts: DataFrame) -> DataFrame:
        table = counts.withColumn("total", F.sum("n").over(Window.partitionBy()))
        table = table.withColumn("wanted", F.least(F.lit(size).cast("bigint"), F.col("total")))
        quota = train_quota(F.col("n"), F.col("total"), F.col("wanted"), label)
        return table.select(label, F.array(quota).alias("cuts"))

    return rule


def assign_blocks(
    df: DataFrame,
    key: str,
    label: str,
    rule: CutRule,
    *,
    seed: int = 42,
    block_col: str = "block",
    prefix_bits: int | None = None,
) -> DataFrame:
    """Add the 0-based block of each row.  ``key`` must be unique, ``label`` not null.

    The width of the hash prefixes follows from the number of rows unless it is given.
    """
    prefix_bits = prefix_bits or prefix_bits_for(df.count())
    hashed = df.select(label, key, hash60(seed, key).alias("_h")).withColumn(
        "_bucket", _bucket(F.col("_h"), prefix_bits)
    )
    histogram = hashed.groupBy(label, "_bucket").agg(F.count("*").alias("_count"))
    earlier = (
        Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    spans = histogram.withColumn("_before", F.coalesce(F.sum("_count").over(earlier), F.lit(0)))

    cuts = rule(histogram.groupBy(label).agg(F.sum("_count").alias("n")))
    wanted = cuts.select(label, F.posexplode("cuts").alias("_block", "_cut"))
    # A cut at rank r lies in the span with before < r <= before + count; r = 0 lies in none.
    located = small_table(
        wanted.join(spans, label, "left")
        .groupBy(label, "_block", "_cut")
        .agg(
            F.max(
                F.when(
                    (F.col("_before") < F.col("_cut"))
                    & (F.col("_cut") <= F.col("_before") + F.col("_count")),
                    F.struct("_bucket", (F.col("_cut") - F.col("_before")).alias("_rank")),
                )
            ).alias("_at")
        )
        .select(label, "_block", "_at._bucket", "_at._rank")
    )
    ends = located.where(F.col("_rank").isNotNull())
    within = Window.partitionBy(label, "_bucket").orderBy("_h", key)
    boundary_rows = (
        hashed.join(ends.select(label, "_bucket").distinct(), [label, "_bucket"], "left_semi")
        .withColumn("_rank", F.row_number().over(within).cast("bigint"))
        .join(ends, [label, "_bucket", "_rank"])
        .select(label, "_block", "_h", key)
    )
    empty = located.where(F.col("_rank").isNull()).select(
        label, "_block", F.lit(-1).cast("bigint").alias("_h"),
        F.lit(None).cast(df.schema[key].dataType).alias(key),
    )
    boundaries = small_table(
        boundary_rows.unionByName(empty)
        .groupBy(label)
        .agg(F.collect_list(F.struct("_h", key)).alias("_ends"))
    )
    here = F.struct(hash60(seed, key).alias("_h"), F.col(key).alias(key))
    block = F.size(F.filter("_ends", lambda end: end < here)).cast("int")
    return df.join(boundaries, label, "left").withColumn(block_col, block).drop("_ends")


def _named(df: DataFrame, block_col: str, names: Sequence[str], out: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col(block_col) + 1)
    return df.withColumn(out, name).drop(block_col)


def stratified_split(
    df: DataFrame, key: str, label: str, test_size: float = 0.2, *, seed: int = 42
) -> DataFrame:
    """Add ``split``: test holds ceil(n * test_size) rows, class shares kept exactly."""
    blocks = assign_blocks(df, key, label, nested_cuts([test_size], label), seed=seed)
    return _named(blocks, "block", ["test", "train"], "split")


def nested_split(
    df: DataFrame,
    key: str,
    label: str,
    test_size: float = 0.2,
    val_size: float = 0.15,
    *,
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: test first, then validation from the rest, then train."""
    rule = nested_cuts([test_size, val_size], label)
    blocks = assign_blocks(df, key, label, rule, seed=seed)
    return _named(blocks, "block", ["test", "val", "train"], "split")


def assign_folds(
    df: DataFrame, key: str, label: str, k: int = 5, *, seed: int = 42
) -> DataFrame:
    """Add ``fold`` 0..k-1."""
    if k < 2:
        raise ValueError("at least two folds are needed")
    return assign_blocks(df, key, label, fold_cuts(k, label), seed=seed, block_col="fold")


def debug_subset(
    df: DataFrame, key: str, label: str, size: int = 50, *, seed: int = 42
) -> DataFrame:
    """A stratified sample of ``size`` rows."""
    blocks = assign_blocks(df, key, label, subset_cuts(size, label), seed=seed)
    return blocks.where("block = 0").drop("block")


def prefix_offsets(histogram: DataFrame, bits: int) -> DataFrame:
    """``histogram`` (_bucket, _count) plus ``_off``, the rows in the prefixes before.

    In two levels: at most 2 ** TOP_BITS prefixes of prefixes are added up on the driver, and every
    one of them adds up its own, so no task sees all prefixes.
    """
    shift = max(0, bits - TOP_BITS)
    tops = histogram.groupBy(F.shiftright("_bucket", shift).alias("_top")).agg(F.sum("_count").alias("n")).collect()
    before, starts = 0, []
    for row in sorted(tops):
        starts.append((row["_top"], before))
        before += row["n"]
    known = histogram.sparkSession.createDataFrame(starts, "_top int, _start bigint")
    earlier = Window.partitionBy("_top").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = histogram.withColumn("_top", F.shiftright("_bucket", shift)).join(F.broadcast(known), "_top")
    inside = F.coalesce(F.sum("_count").over(earlier), F.lit(0))
    return placed.withColumn("_off", F.col("_start") + inside).drop("_top", "_start")


def ranked_rows(df: DataFrame, key: str, ranks: DataFrame, *, seed: int = 42, n: int) -> DataFrame:
    """``ranks`` (with a column ``idx`` from 0 to n - 1) plus the key that has that rank.

    The order is that of a seeded hash.  A histogram over hash prefixes tells in which
    prefix a rank lies, and only prefixes that are asked for are ranked.  Prefixes and
    ranks meet in cells of equal width, so that this is a plain join.
    """
    bits = prefix_bits_for(n)
    hashed = df.select(key, hash60(seed, key).alias("_h")).withColumn(
        "_bucket", _bucket(F.col("_h"), bits)
    )
    histogram = hashed.groupBy("_bucket").agg(F.count("*").alias("_count"))
    spans = prefix_offsets(histogram, bits)
    width = -(-n // 2**bits)

    def cell(rank: Column) -> Column:
        return F.floor(rank / width).cast("bigint")

    cells = spans.withColumn(
        "_cell", F.explode(F.sequence(cell(F.col("_off")), cell(F.col("_off") + F.col("_count") - 1)))
    )
    inside = (F.col("_off") <= F.col("idx")) & (F.col("idx") < F.col("_off") + F.col("_count"))
    asked = ranks.withColumn("_cell", cell(F.col("idx"))).join(cells, "_cell").where(inside)
    asked = asked.withColumn("_rank", (F.col("idx") - F.col("_off") + 1).cast("bigint"))
    asked = small_table(asked.drop("_cell", "_off", "_count"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", key)).cast("bigint")
    hit = hashed.join(asked.select("_bucket").distinct(), "_bucket", "left_semi")
    ranked = hit.withColumn("_rank", within).select("_bucket", "_rank", key)
    return asked.join(ranked, ["_bucket", "_rank"]).drop("_bucket", "_rank")
