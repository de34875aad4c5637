"""Batch scoring with class probabilities."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candor.functions.arrays import let
from candor.operators.tfidf import json_literal


def linear_logits(
    vector: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]
) -> Column:
    """One score per class: weights . vector + bias."""
    heads = json_literal(
        [{"w": list(map(float, w)), "b": float(b)} for w, b in zip(weights, bias, strict=True)],
        "array<struct<w:array<double>,b:double>>",
    )
    return let(
        vector.cast("array<double>"),
        lambda x: F.transform(
            heads,
            lambda h: F.aggregate(
                F.zip_with(h["w"], x, lambda a, b: a * b), h["b"], lambda acc, p: acc + p
            ),
        ),
    )


def softmax(logits: Column) -> Column:
    """Probabilities, shifted by the largest logit so that exp cannot overflow."""

    def normalized(exps: Column) -> Column:
        total = F.aggregate(exps, F.lit(0.0), lambda acc, e: acc + e)
        return let(total, lambda t: F.transform(exps, lambda e: e / t))

    def shifted(values: Column) -> Column:
        return let(
            F.array_max(values), lambda top: F.transform(values, lambda v: F.exp(v - top))
        )

    return let(logits, lambda values: let(shifted(values), normalized))


def argmax(values: Column) -> Column:
    """0-based position of the largest entry, the first one on a tie."""
    return let(values, lambda v: F.array_position(v, F.array_max(v)) - 1).cast("int")


def predict_linear(
    df: DataFrame, vector: str, weights: Sequence[Sequence[float]], bias: Sequence[float]
) -> DataFrame:
    """Add ``probabilities`` and ``prediction`` of a linear classification head."""
    scored = df.withColumn("probabilities", softmax(linear_logits(F.col(vector), weights, bias)))
    return scored.withColumn("prediction", argmax(F.col("probabilities")))


def probability_rows(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, prediction, class_id, probability), one row per class."""
    # The outer form keeps Spark from adding a filter that would score every row twice.
    return scored.select(
        *keys, "prediction", F.posexplode_outer("probabilities").alias("class_id", "probability")
    ).where(F.col("class_id").isNotNull())


def predict_batches(
    df: DataFrame, vector: str, width: int, make_predict_fn: Callable, batch_size: int = 16
) -> DataFrame:
    """Score with any batch model: ``make_predict_fn`` loads it once per Python worker.

    Its function maps a numpy batch of vectors of ``width`` entries to a numpy
    batch of logits.
    """
    logits = predict_batch_udf(
        make_predict_fn,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[[width]],
    )
    scored = df.withColumn("probabilities", softmax(logits(F.col(vector))))
    return scored.withColumn("prediction", argmax(F.col("probabilities")))
