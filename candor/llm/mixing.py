"""Mixtures with target weights per source: epochs, then a weighted draw without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.llm.ranking import ROWS_PER_BUCKET, bucket_of, prefix_sums
from candor.llm.shared import column, draw60, fresh, keep, word_count

MAX_EPOCHS = 3
CYCLE = (1, 2, 3)

# Quality weights are whole sixteenths, from a quarter to one.
WEIGHT_STEPS = 16
LEAST_STEPS = 4


def quality_steps(text: Column) -> Column:
    """A document's quality weight in sixteenths: its share of letters, digits and spaces.

    At least a quarter, so that every document can be drawn; null or empty text
    gets the least.
    """
    text = F.coalesce(text, F.lit(""))
    plain = F.length(text) - F.length(F.translate(text, "#*$%&|<>!{}[]=~^_", ""))
    share = WEIGHT_STEPS - F.floor(WEIGHT_STEPS * 4 * plain / F.greatest(F.length(text), F.lit(1)))
    return F.when(F.length(text) == 0, F.lit(LEAST_STEPS)).otherwise(
        F.greatest(share, F.lit(LEAST_STEPS))
    ).cast("int")


def source_targets(sizes: DataFrame, source: str, group: str, size: str) -> DataFrame:
    """(group, source_size, target) from the size of each source.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ... and share the total
    by weight.  A target stops at MAX_EPOCHS times its source; what is above goes to
    the others by weight.  Sources ordered by cap per weight are capped in that
    order, so one pass of prefix sums finds the common level.  One row per source.
    """
    named = sizes.withColumn(
        "_rank", F.row_number().over(Window.orderBy(column(source).asc_nulls_last())) - 1
    )
    weight = F.array(*map(F.lit, CYCLE))[F.pmod(F.col("_rank"), F.lit(len(CYCLE)))]
    weighted = named.select(
        group, column(size).alias("source_size"), weight.alias("_weight"),
        (MAX_EPOCHS * column(size)).alias("_cap"), "_rank",
    )
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    weights = F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    stepped = weighted.withColumns({"_left": left, "_weights": weights})
    # The first source whose cap is not under its share: from it on, shares by weight.
    open_ = F.col("_left") * F.col("_weight") <= F.col("_cap") * F.col("_weights")
    at = F.min(F.when(open_, F.struct(F.col("_cap") / F.col("_weight"), "_rank", "_left", "_weights")))
    level = stepped.withColumn("_at", at.over(whole))
    free = F.struct(F.col("_cap") / F.col("_weight"), "_rank") >= F.struct(
        F.col("_at")["col1"], F.col("_at")["_rank"]
    )
    share = F.col("_at")["_left"].cast("double") * F.col("_weight") / F.col("_at")["_weights"]
    return level.select(
        group, "source_size",
        F.when(free, F.least(share, F.col("_cap").cast("double")))
        .otherwise(F.col("_cap").cast("double")).alias("target"),
    )


def mix_sources(
    df: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    size: Column | None = None,
    weight_steps: Column | None = None,
    text: str = "text",
    seed: int = 23,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``size``, ``source_size``, ``target`` and ``epochs`` (times a row is taken) to every row.

    A target of e whole epochs and a rest takes every document of the source e times;
    the rest goes to documents in the order of Efraimidis and Spirakis, by falling
    u ** (1 / w) for a seeded uniform u and the quality weight w, while their words
    fit.  The document at the edge is taken if that comes closer to the target.

    Null and empty texts have size 0; they take no words and go with the whole
    epochs.  A null source is a source of its own.  Equal keys are told apart by
    content; of equal rows any may be the one taken.  Input columns named like the
    new ones are replaced.  An empty table gives an empty result.
    """
    size = word_count(column(text)) if size is None else size
    steps = quality_steps(column(text)) if weight_steps is None else weight_steps
    taken = {"size", "source_size", "target", "epochs"}
    kept = [column(c) for c, _ in df.dtypes if c.lower() not in taken or c in (key, source, text)]
    group, rank, before, ties, count = fresh(
        [*df.columns, *taken], "group", "key", "before", "ties", "rows"
    )
    named = F.coalesce(F.concat(F.lit("="), column(source).cast("string")), F.lit(""))
    content = F.xxhash64(*[column(c) for c, kind in df.dtypes if not kind.startswith("map")])
    # u in (0, 1); the key lies in (0, 1) and rises where the document comes later.
    u = (draw60(seed, column(key)) + F.lit(0.5)) / F.lit(2.0**60)
    late = 1 - F.pow(u, F.lit(float(LEAST_STEPS)) / steps)
    rows = df.select(
        *kept, size.alias("size"), named.alias(group), late.alias(rank), content.alias(ties)
    )
    sizes = rows.groupBy(group).agg(
        F.min(column(source)).alias("_source"), F.sum("size").alias("_size"),
        F.count("*").alias("_rows"),
    )
    sizes = keep(sizes, "source-sizes")
    # Read back, so that Spark knows the size of this one row per source when it joins.
    targets = source_targets(sizes, "_source", group, "_size").join(
        sizes.select(group, F.col("_rows").alias(count)), group
    )
    targets = keep(targets, "source-targets")
    summed = prefix_sums(
        rows.join(targets, group),
        group,
        bucket_of(column(rank), column(count), rows_per_bucket),
        [column(rank), column(key).asc_nulls_first(), column(ties)],
        {before: F.col("size")},
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    whole = F.coalesce(whole, F.lit(0)).cast("int")
    rest = F.col("target") - whole * F.col("source_size")
    # Taken if at least half of it lies within the rest.
    extra = (F.col("size") > 0) & (column(before) + F.col("size") / 2 < rest)
    return summed.withColumn("epochs", whole + extra.cast("int")).drop(group, rank, before, ties, count)


def take_epochs(mixed: DataFrame) -> DataFrame:
    """Each row as often as the mix takes it, without the columns of the mix."""
    copies = F.explode(F.sequence(F.lit(1), F.col("epochs")))
    rows = mixed.where("epochs > 0").withColumn("epochs", copies)
    return rows.drop("size", "source_size", "target", "epochs")
