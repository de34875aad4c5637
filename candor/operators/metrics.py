"""Classification metrics.

Predictions are a long table (model_rank, model, key, label, prediction).  They
are aggregated once, to confusion cells (model_rank, model, label, prediction,
n); every metric is derived from the cells, whose number depends on models and
classes only.  A score with denominator zero is zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MODEL = ["model_rank", "model"]
ENSEMBLE = "Ensemble"


def confusion_cells(predictions: DataFrame) -> DataFrame:
    """The non-zero cells of every model's confusion matrix, in one aggregation."""
    return predictions.groupBy(*MODEL, "label", "prediction").agg(F.count("*").alias("n"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def class_scores(cells: DataFrame) -> DataFrame:
    """(model, class, support, predicted, hits, precision, recall, f1), not rounded.

    Classes are those seen as a label or as a prediction of the model.
    """
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(
            F.col("label").alias("class"), F.col("n").alias("support"),
            zero.alias("predicted"), hit.alias("hits"),
        ),
        F.struct(
            F.col("prediction").alias("class"), zero.alias("support"),
            F.col("n").alias("predicted"), zero.alias("hits"),
        ),
    )
    totals = (
        cells.select(*MODEL, F.inline(sides))
        # A missing prediction is an error of its label, but no class.
        .where(F.col("class").isNotNull())
        .groupBy(*MODEL, "class")
        .agg(
            F.sum("support").alias("support"),
            F.sum("predicted").alias("predicted"),
            F.sum("hits").alias("hits"),
        )
    )
    return totals.select(
        "*",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def model_scores(cells: DataFrame) -> DataFrame:
    """Accuracy and macro and weighted averages per model, not rounded."""

    def weighted(score: str) -> Column:
        return _ratio(F.sum(F.col(score) * F.col("support")), F.sum("support"))

    return (
        class_scores(cells)
        .groupBy(*MODEL)
        .agg(
            _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
            *[F.avg(s).alias(f"{s}_macro") for s in ("precision", "recall", "f1")],
            *[weighted(s).alias(f"{s}_weighted") for s in ("precision", "recall", "f1")],
            F.sum("support").alias("support"),
        )
    )


def _rounded(df: DataFrame, keys: Sequence[str], names: dict[str, str]) -> DataFrame:
    return df.select(*keys, *[F.round(F.col(c), 4).alias(name) for c, name in names.items()])


def model_comparison(cells: DataFrame) -> DataFrame:
    """(model, accuracy, f1_score) with support-weighted F1, to 4 digits."""
    return _rounded(
        model_scores(cells), MODEL, {"accuracy": "accuracy", "f1_weighted": "f1_score"}
    )


def metrics_macro(cells: DataFrame) -> DataFrame:
    return _rounded(
        model_scores(cells),
        MODEL,
        {
            "accuracy": "accuracy",
            "f1_macro": "f1_macro",
            "f1_weighted": "f1_weighted",
            "precision_macro": "precision",
            "recall_macro": "recall",
        },
    )


def metrics_weighted(cells: DataFrame) -> DataFrame:
    return _rounded(
        model_scores(cells),
        MODEL,
        {
            "accuracy": "accuracy",
            "f1_weighted": "f1_score",
            "precision_weighted": "precision",
            "recall_weighted": "recall",
        },
    )


def classification_report(cells: DataFrame) -> DataFrame:
    """(model, row, precision, recall, f1_score, support): classes, then summary rows.

    The accuracy row carries the accuracy in all four columns.
    """
    columns = ["precision", "recall", "f1_score", "support"]
    per_class = class_scores(cells).select(
        *MODEL,
        F.col("class").cast("string").alias("row"),
        "precision",
        "recall",
        F.col("f1").alias("f1_score"),
        F.col("support").cast("double").alias("support"),
    )
    overall = F.col("accuracy")
    support = F.col("support").cast("double")

    def summary(row: str, p: Column, r: Column, f: Column, s: Column) -> Column:
        return F.struct(
            F.lit(row).alias("row"), p.alias("precision"), r.alias("recall"),
            f.alias("f1_score"), s.alias("support"),
        )

    summaries = model_scores(cells).select(
        *MODEL,
        F.inline(
            F.array(
                summary("accuracy", overall, overall, overall, overall),
                *[
                    summary(
                        f"{kind} avg",
                        F.col(f"precision_{kind}"),
                        F.col(f"recall_{kind}"),
                        F.col(f"f1_{kind}"),
                        support,
                    )
                    for kind in ("macro", "weighted")
                ],
            )
        ),
    )
    return per_class.unionByName(summaries).select(
        *MODEL, "row", *[F.round(c, 4).alias(c) for c in columns]
    )


def nested_report(cells: DataFrame) -> DataFrame:
    """One row per model with its report as a map from row name to scores."""
    entry = F.struct(
        F.col("row"), F.struct("precision", "recall", "f1_score", "support").alias("scores")
    )
    rows = F.sort_array(F.collect_list(entry))
    return (
        classification_report(cells).groupBy(*MODEL)
        .agg(F.map_from_entries(rows).alias("report"))
    )


def confusion_matrix(cells: DataFrame) -> DataFrame:
    """Every (label, prediction) pair of each model's classes, with zeros."""
    classes = (
        cells.select(*MODEL, F.explode(F.array("label", "prediction")).alias("class"))
        .groupBy(*MODEL)
        .agg(F.collect_set("class").alias("classes"))
    )
    grid = classes.select(*MODEL, "classes", F.explode("classes").alias("label")).select(
        *MODEL, "label", F.explode("classes").alias("prediction"),
        F.lit(0).cast("bigint").alias("n"),
    )
    return (
        grid.unionByName(cells.select(*MODEL, "label", "prediction", "n"))
        .groupBy(*MODEL, "label", "prediction")
        .agg(F.sum("n").alias("n"))
    )


def confusion_normalized(cells: DataFrame) -> DataFrame:
    """The dense matrix with each cell as a share of its label's rows."""
    row_total = F.sum("n").over(Window.partitionBy(*MODEL, "label"))
    return confusion_matrix(cells).select(
        *MODEL, "label", "prediction", F.round(_ratio(F.col("n"), row_total), 4).alias("share")
    )


def confusion_wide(cells: DataFrame, classes: Sequence) -> DataFrame:
    """One row per model and label, one count column per predicted class."""
    wide = (
        confusion_matrix(cells).groupBy(*MODEL, "label").pivot("prediction", list(classes))
        .agg(F.sum("n"))
    )
    return wide.select(
        *MODEL, "label",
        *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"pred_{c}") for c in classes],
    )


def top_classes_by_f1(cells: DataFrame, k: int = 3) -> DataFrame:
    """The k best classes of each model; equal scores in class order."""
    order = Window.partitionBy(*MODEL).orderBy(F.desc("f1"), "class")
    scored = class_scores(cells)
    return (
        scored.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= k)
        .select(*MODEL, "place", "class", F.round("f1", 4).alias("f1_score"))
    )


def best_model(comparison: DataFrame, metrics: Sequence[str] = ("accuracy", "f1_score")) -> DataFrame:
    """The best model by each metric; on a tie the earliest one."""
    row = F.struct("model", *metrics)
    winners = comparison.agg(
        *[F.max_by(row, F.struct(F.col(m), -F.col("model_rank"))).alias(f"by_{m}") for m in metrics]
    )
    listed = F.array(
        *[
            F.struct(F.lit(f"by_{m}").alias("criterion"), F.col(f"by_{m}").alias("best"))
            for m in metrics
        ]
    )
    return winners.select(F.inline(listed)).select("criterion", "best.*")


def key_insights(comparison: DataFrame, imbalance: DataFrame) -> DataFrame:
    """One row: imbalance ratio, best accuracy, F1 range, whether the ensemble helped."""
    is_ensemble = F.col("model") == ENSEMBLE
    ensemble = F.max(F.when(is_ensemble, F.col("accuracy")))
    others = F.max(F.when(~is_ensemble, F.col("accuracy")))
    rows = comparison.select("model", "accuracy", "f1_score").unionByName(
        imbalance.select("ratio"), allowMissingColumns=True
    )
    return rows.agg(
        F.max("accuracy").alias("best_accuracy"),
        F.min("f1_score").alias("f1_min"),
        F.max("f1_score").alias("f1_max"),
        F.coalesce(ensemble > others, F.lit(False)).alias("ensemble_improved"),
        F.max("ratio").alias("imbalance_ratio"),
    )


def metrics_long(
    comparison: DataFrame, metrics: Sequence[str], models: Sequence[str] | None = None
) -> DataFrame:
    """(model, metric, value), for the chosen models."""
    chosen = comparison if models is None else comparison.where(F.col("model").isin(list(models)))
    return chosen.unpivot(["model"], list(metrics), "metric", "value")
