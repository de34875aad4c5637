"""Table profiles and exploratory statistics of labelled text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candor.functions.text import (
    as_text,
    clean_text,
    holds_phrase,
    preview,
    split_words,
)
from candor.operators.roles import quoted

DISCOURSE_MARKERS = ("well", "let me")


def table_profile(df: DataFrame, key: str) -> DataFrame:
    """(column, position, type, n_rows, n_nulls, avg_length, sample), from one aggregation.

    The sample is the start of the value in the row with the smallest key.
    """
    fields = df.schema.fields
    measures = [F.count("*").alias("n_rows")]
    for i, f in enumerate(fields):
        text = as_text(quoted(f.name))
        measures += [
            F.count_if(quoted(f.name).isNull()).alias(f"nulls{i}"),
            F.avg(F.length(text)).alias(f"length{i}"),
            F.min_by(preview(text), quoted(key)).alias(f"sample{i}"),
        ]
    one_row = df.agg(*measures)
    rows = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(i).alias("position"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.col("n_rows"),
                F.col(f"nulls{i}").alias("n_nulls"),
                F.round(F.col(f"length{i}"), 4).alias("avg_length"),
                F.col(f"sample{i}").alias("sample"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return one_row.select(F.inline(rows))


def text_previews(df: DataFrame, key: str, text: str, width: int = 100) -> DataFrame:
    """(key, n_chars, preview) of every row."""
    return df.select(
        key, F.length(as_text(text)).cast("bigint").alias("n_chars"),
        preview(text, width).alias("preview"),
    )


def text_length_stats(df: DataFrame, text: str) -> DataFrame:
    length = F.length(F.col(text)).cast("bigint")
    return df.agg(
        F.min(length).alias("min_chars"),
        F.max(length).alias("max_chars"),
        F.round(F.avg(length), 4).alias("mean_chars"),
    )


def n_words(text: str) -> Column:
    return F.size(split_words(text)).cast("bigint")


def token_length_histogram(df: DataFrame, tokens: str, width: int = 50) -> DataFrame:
    """(bucket, n): documents by number of tokens, in steps of ``width``."""
    length = F.size(tokens)
    bucket = (F.floor(length / width) * width).cast("bigint").alias("bucket")
    return df.groupBy(bucket).agg(F.count("*").alias("n"))


def sequence_length_quantiles(
    df: DataFrame, tokens: str, quantiles: Sequence[float] = (0.5, 0.9, 0.95, 0.99)
) -> DataFrame:
    """Exact token-length quantiles: the least length that the share q of rows does not exceed.

    From the histogram of lengths, which has one row per distinct length.
    """
    sizes = df.groupBy(F.size(tokens).alias("length")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("length"))
    total = F.sum("n").over(Window.partitionBy())
    ranked = sizes.select("length", upto.alias("upto"), total.alias("total"))
    return ranked.agg(
        *[
            F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * F.lit(q)), F.col("length")))
            .alias(f"p{round(q * 100)}")
            for q in quantiles
        ]
    )


def top_unigrams(df: DataFrame, tokens: str, label: str, k: int = 20) -> DataFrame:
    """(label, place, term, n): the k commonest tokens per class and, as ``*``, overall."""
    terms = df.select(
        F.col(label).alias("label"), F.explode_outer(tokens).alias("term")
    ).where("term is not null")
    per_class = terms.groupBy("label", "term").agg(F.count("*").alias("n"))
    # Overall counts come from the class counts, so the text is read once.
    both = per_class.select(F.explode(F.array("label", F.lit("*"))).alias("label"), "term", "n")
    order = Window.partitionBy("label").orderBy(F.desc("n"), "term")
    return (
        both.groupBy("label", "term")
        .agg(F.sum("n").alias("n"))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= k)
        .select("label", "place", "term", "n")
    )


def length_by_class(df: DataFrame, text: str, label: str) -> DataFrame:
    """(label, n, mean_words, sd_words) with the sample standard deviation."""
    words = n_words(text)
    return df.groupBy(F.col(label).alias("label")).agg(
        F.count("*").alias("n"),
        F.round(F.avg(words), 4).alias("mean_words"),
        F.round(F.stddev_samp(words), 4).alias("sd_words"),
    )


def annotator_disagreement(df: DataFrame, annotators: Sequence[str]) -> DataFrame:
    """Rows with at least two annotations, those that differ, and their share."""
    given = F.filter(F.array(*[quoted(a) for a in annotators]), lambda a: a.isNotNull())
    several = df.select(given.alias("_given")).where(F.size("_given") >= 2)
    differs = F.size(F.array_distinct("_given")) > 1
    return several.agg(
        F.count("*").alias("n"),
        F.count_if(differs).alias("n_disagree"),
        F.round(F.avg(differs.cast("double")), 4).alias("rate"),
    )


def flag_rates(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """(flag, n_set, rate) over the rows where the flag is known."""
    measures = []
    for f in flags:
        measures += [
            F.count_if(quoted(f)).alias(f"n_{f}"),
            F.avg(quoted(f).cast("double")).alias(f"r_{f}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("flag"), F.col(f"n_{f}").alias("n_set"),
                F.round(F.col(f"r_{f}"), 4).alias("rate"),
            )
            for f in flags
        ]
    )
    return df.agg(*measures).select(F.inline(rows))


def discourse_markers(
    df: DataFrame, text: str, label: str, markers: Sequence[str] = DISCOURSE_MARKERS
) -> DataFrame:
    """(label, marker, n, n_with, rate): texts that hold each marker as whole words."""
    held = F.array(
        *[
            F.struct(F.lit(m).alias("marker"), holds_phrase("_cleaned", m).alias("held"))
            for m in markers
        ]
    )
    cleaned = df.select(F.col(label).alias("label"), clean_text(text).alias("_cleaned"))
    rows = cleaned.select("label", F.inline(held))
    return rows.groupBy("label", "marker").agg(
        F.count("*").alias("n"),
        F.count_if("held").alias("n_with"),
        F.round(F.avg(F.col("held").cast("double")), 4).alias("rate"),
    )


def dataset_summary(df: DataFrame, label: str, split: str) -> DataFrame:
    """One row: sizes in all and per split, classes, and imbalance of the test classes."""
    counts = df.groupBy(F.col(label).alias("label"), F.col(split).alias("split")).agg(
        F.count("*").alias("n")
    )
    per_class = counts.groupBy("label").agg(
        F.sum("n").alias("n"),
        *[
            F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(s)
            for s in ("train", "val", "test")
        ],
    )
    tested = F.when(F.col("test") > 0, F.col("test"))
    return per_class.agg(
        F.sum("n").alias("total_samples"),
        F.sum("train").alias("train_samples"),
        F.sum("val").alias("val_samples"),
        F.sum("test").alias("test_samples"),
        F.count("*").alias("n_classes"),
        F.array_join(F.sort_array(F.collect_list("label")), ",").alias("classes"),
        F.round(F.max(tested) / F.min(tested), 4).alias("class_imbalance_ratio"),
    )


def training_history(log: DataFrame) -> DataFrame:
    """(run, epoch, phase, loss, accuracy) from a batch log.

    The log has one row per batch (run, epoch, phase, loss, correct, total):
    loss is the mean over batches, accuracy the share of correct rows.
    """
    return log.groupBy("run", "epoch", "phase").agg(
        F.avg("loss").alias("loss"),
        (F.sum("correct") / F.sum("total")).alias("accuracy"),
    )
