"""Label cleaning, encoding, class statistics and balancing weights."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from candor.functions.text import NOT_BLANK, as_text
from candor.operators.lookup import small_table


def valid_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows whose label is neither null nor blank."""
    return df.where(F.col(label).cast("string").rlike(NOT_BLANK))


def of_class(df: DataFrame, target, label: str = "label") -> DataFrame:
    """Rows of one class; every value is a valid target, also 0 and the empty string."""
    return df.where(F.col(label).eqNullSafe(F.lit(target)))


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n) of rows with a label; rows without one belong to no class."""
    return valid_labels(df, label).groupBy(label).agg(F.count("*").alias("n"))


def class_table(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, label_id) with ids 0..k-1 in sorted label order; a missing label has none."""
    # The window runs over one row per class, not over the data.
    ids = F.row_number().over(Window.orderBy(label)) - 1
    known = df.select(label).where(F.col(label).isNotNull()).distinct()
    return small_table(known.select(label, ids.cast("int").alias("label_id")))


def encode_labels(
    df: DataFrame, classes: DataFrame, label: str = "label", id_col: str = "label_id"
) -> DataFrame:
    """Add the class id; a label that the class table lacks is an error when read."""
    ids = classes.select(label, F.col("label_id").alias(id_col))
    joined = df.join(ids, label, "left")
    problem = F.concat(F.lit("unseen label: "), as_text(label))
    checked = F.when(F.col(id_col).isNull(), F.raise_error(problem).cast("int")).otherwise(
        F.col(id_col)
    )
    return joined.withColumn(id_col, checked)


def decode_labels(
    df: DataFrame, classes: DataFrame, id_col: str, name_col: str, label: str = "label"
) -> DataFrame:
    """Add the label text that belongs to a class id."""
    names = classes.select(F.col("label_id").alias(id_col), F.col(label).alias(name_col))
    return df.join(names, id_col, "left")


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, percent) over all rows with a label."""
    counts = class_counts(df, label)
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(label, "n", F.round(F.col("n") / total * 100, 4).alias("percent"))


def class_counts_dense(df: DataFrame, classes: DataFrame, label: str = "label") -> DataFrame:
    """Counts for every known class, zero where a class has no row."""
    counts = class_counts(df, label)
    return classes.join(counts, label, "left").select(
        label, "label_id", F.coalesce("n", F.lit(0)).alias("n")
    )


def imbalance_ratio(df: DataFrame, label: str = "label") -> DataFrame:
    """Largest class count over the smallest."""
    return class_counts(df, label).agg(
        F.max("n").alias("largest"),
        F.min("n").alias("smallest"),
        F.round(F.max("n") / F.min("n"), 4).alias("ratio"),
    )


def balanced(counts: DataFrame, label: str = "label") -> DataFrame:
    """Class counts with balanced weights total / (k * n), not rounded."""
    everything = Window.partitionBy()
    share = F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))
    return small_table(counts.select(label, "n", share.alias("weight")))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights, one row per class of the rows with a label."""
    return balanced(class_counts(df, label), label)


def minority_class(df: DataFrame, label: str = "label") -> DataFrame:
    """The class with the fewest rows; on a tie the first in label order."""
    counts = class_counts(df, label)
    return counts.agg(
        F.min_by(F.col(label), F.struct("n", label)).alias(label), F.min("n").alias("n")
    )


def roll_up_labels(
    df: DataFrame,
    parents: Mapping[str, str],
    child: str = "label",
    parent: str = "parent_label",
) -> DataFrame:
    """Add the coarse label of each fine label from a child -> parent map.

    The map holds each child once, so a child has exactly one parent by
    construction; children without an entry get a null parent.
    """
    schema = T.StructType(
        [T.StructField(child, T.StringType()), T.StructField(parent, T.StringType())]
    )
    table = df.sparkSession.createDataFrame(sorted(parents.items()), schema)
    return df.join(table, child, "left")


def inconsistent_children(df: DataFrame, child: str, parent: str) -> DataFrame:
    """Fine labels that the data puts under more than one coarse label."""
    pairs = df.groupBy(child, parent).agg(F.count("*").alias("n"))
    return (
        pairs.groupBy(child)
        .agg(F.count_distinct(parent).alias("n_parents"), F.sum("n").alias("n"))
        .where("n_parents > 1")
    )


def label_rollup_counts(df: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, parent, n, n_parents): row counts per pair and parents seen per child."""
    pairs = df.groupBy(child, parent).agg(F.count("*").alias("n"))
    seen = F.count(F.col(parent)).over(Window.partitionBy(child))
    return pairs.select(child, parent, "n", seen.alias("n_parents"))


def weight_column(df: DataFrame, weights: DataFrame, label: str = "label") -> DataFrame:
    """Attach the class weight to every row."""
    return df.join(weights.select(label, "weight"), label)


def label_name(*parts: tuple[str, Column]) -> Column:
    """A compound label such as ``q1_t0`` from prefixed parts."""
    return F.concat_ws("_", *[F.concat(F.lit(p), c.cast("string")) for p, c in parts])
