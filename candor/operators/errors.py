"""Error analysis over predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candor.operators.lookup import small_table
from candor.operators.metrics import MODEL


def is_wrong() -> Column:
    """Whether the prediction is not the label; a row without a prediction is an error."""
    return ~F.col("label").eqNullSafe(F.col("prediction"))


def misclassified(predictions: DataFrame) -> DataFrame:
    return predictions.where(is_wrong())


def error_rates(cells: DataFrame) -> DataFrame:
    """(model, scope, label, n, errors, error_rate): overall and per true class.

    Models without a single error are left out.
    """
    wrong = F.sum(F.when(is_wrong(), F.col("n")).otherwise(0))
    per_class = cells.groupBy(*MODEL, "label").agg(
        F.sum("n").alias("n"), wrong.alias("errors")
    )
    of_model = Window.partitionBy(*MODEL)
    per_class = per_class.withColumn("_all", F.sum("errors").over(of_model)).where("_all > 0")
    overall = per_class.groupBy(*MODEL).agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"))
    rows = per_class.select(
        *MODEL, F.lit("class").alias("scope"), F.col("label").cast("string").alias("label"),
        "n", "errors",
    ).unionByName(
        overall.select(
            *MODEL, F.lit("model").alias("scope"), F.lit("").alias("label"), "n", "errors"
        )
    )
    return rows.withColumn("error_rate", F.round(F.col("errors") / F.col("n"), 4))


def error_samples(
    predictions: DataFrame, texts: DataFrame, key: str, text: str = "text", k: int = 10
) -> DataFrame:
    """The first k wrong rows of each model in key order, with their text.

    The ranking sees keys only; texts are fetched for the k rows per model.
    """
    order = Window.partitionBy(*MODEL).orderBy(key)
    first = (
        misclassified(predictions)
        .select(*MODEL, key, "label", "prediction")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= k)
    )
    return texts.select(key, text).join(small_table(first), key).select(
        *MODEL, "place", key, text, "label", "prediction"
    )


def prediction_table(
    predictions: DataFrame, texts: DataFrame, classes: DataFrame, key: str, text: str = "text"
) -> DataFrame:
    """Text, true and predicted class as id and name, and 1 or 0 for correct."""
    # One row per key before the join, so that a text moves once and not once per model.
    per_key = predictions.groupBy(key).agg(
        F.collect_list(F.struct(*MODEL, "label", "prediction")).alias("_rows")
    )
    joined = per_key.join(texts.select(key, text), key).select(key, text, F.inline("_rows"))
    ids = classes.select("label", "label_id")
    true_side = ids.toDF("label", "true_label")
    predicted_side = ids.toDF("prediction", "predicted_label")
    return (
        joined.join(true_side, "label", "left")
        .join(predicted_side, "prediction", "left")
        .select(
            *MODEL,
            key,
            text,
            "true_label",
            F.col("label").alias("true_label_name"),
            "predicted_label",
            F.col("prediction").alias("predicted_label_name"),
            (~is_wrong()).cast("int").alias("correct"),
        )
    )


def error_by_length(
    predictions: DataFrame, lengths: DataFrame, key: str, length: str, width: int
) -> DataFrame:
    """(model, bucket, n, errors, error_rate) over buckets of text length."""
    bucket = (F.floor(F.col(length) / width) * width).cast("bigint")
    joined = predictions.join(lengths.select(key, bucket.alias("bucket")), key)
    return (
        joined.groupBy(*MODEL, "bucket")
        .agg(F.count("*").alias("n"), F.count_if(is_wrong()).alias("errors"))
        .withColumn("error_rate", F.round(F.col("errors") / F.col("n"), 4))
    )
