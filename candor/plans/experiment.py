"""A whole experiment: prepare, train, vote, evaluate, and write every result."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.functions.text import file_safe_name
from candor.operators import errors, metrics
from candor.operators.labels import imbalance_ratio, valid_labels
from candor.operators.lookup import small_table
from candor.operators.profile import dataset_summary
from candor.operators.voting import with_ensemble
from candor.plans.models import (
    Corpus,
    ModelSpec,
    TextModel,
    four_models,
    predict_split,
    prepare_corpus,
    train_all,
)
from candor.sources.staging import stage
from candor.sources.tables import one_json_document, read_csv, write_csv, write_json


@dataclass(frozen=True)
class Experiment:
    corpus: Corpus
    models: list[TextModel]
    validation: DataFrame
    predictions: DataFrame
    cells: DataFrame
    comparison: DataFrame


def run_experiment(
    df: DataFrame,
    key: str,
    text: str,
    label: str = "label",
    specs: Sequence[ModelSpec] | None = None,
    test: DataFrame | None = None,
    seed: int = 42,
    copies: int = 0,
) -> Experiment:
    """Train the models, add their majority vote, and compare them on the test split.

    ``copies`` varied copies of the smallest class are added to the train rows.
    """
    specs = list(specs or four_models())
    corpus = prepare_corpus(df, key, text, label, test=test, seed=seed, copies=copies)
    models, staged = train_all(corpus, specs)
    validation = metrics.model_comparison(
        metrics.confusion_cells(predict_split(models, staged, key, "val"))
    )
    single = predict_split(models, staged, key, "test")
    predictions = stage(with_ensemble(single, key, len(specs)), "voted")
    cells = small_table(metrics.confusion_cells(predictions))
    return Experiment(
        corpus, models, validation, predictions, cells, metrics.model_comparison(cells)
    )


def summary_document(run: Experiment, text: str, label: str) -> DataFrame:
    """One row with the JSON summary: data, models, results, best models, insights."""
    spark = run.comparison.sparkSession
    settings = spark.range(1).select(
        F.lit(text).alias("text_column"),
        F.lit(label).alias("label_column"),
        F.current_timestamp().alias("finished_at"),
    )
    tested = run.corpus.split("test").select("label")
    models = spark.createDataFrame(
        [
            (i, m.name, m.features.max_features, list(m.features.ngram_range), len(m.vocabulary.terms))
            for i, m in enumerate(run.models)
        ],
        "model_rank int, model string, max_features int, ngram_range array<int>, n_terms int",
    )
    return one_json_document(
        {
            "experiment": settings,
            "dataset": dataset_summary(run.corpus.rows.where("copy is null"), "label", "split"),
            "models": models.orderBy("model_rank"),
            "results": run.comparison.orderBy("model_rank"),
            "best_models": metrics.best_model(run.comparison),
            "key_insights": metrics.key_insights(run.comparison, imbalance_ratio(tested)),
        }
    )


# Result tables with their schemas, by kind of file.
CSV_RESULTS = {
    "model_comparison": "model_rank int, model string, accuracy double, f1_score double",
    "validation": "model_rank int, model string, accuracy double, f1_score double",
    "reports": "model_rank int, model string, row string, precision double, recall double, "
    "f1_score double, support double, file string",
    "confusion_matrices": "model_rank int, model string, label string, prediction string, "
    "n bigint, file string",
}
JSON_RESULTS = {
    "error_rates": "model_rank int, model string, scope string, label string, n bigint, "
    "errors bigint, error_rate double",
    "error_samples": "model_rank int, model string, place int, {key} bigint, text string, "
    "label string, prediction string",
}


def read_results(
    spark: SparkSession,
    folder: str,
    key: str,
    key_type: str = "bigint",
    models: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """The result tables that ``write_results`` wrote, for the chosen models.

    The table of predictions, with a row per document, is Parquet; its CSV is for export.
    """

    def schema(text: str) -> str:
        return text.replace("{key} bigint", f"`{key}` {key_type}")

    found = {
        name: read_csv(spark, f"{folder}/{name}", schema(s), line_breaks=True)
        for name, s in CSV_RESULTS.items()
    }
    found["predictions"] = spark.read.parquet(f"{folder}/predictions")
    for name, s in JSON_RESULTS.items():
        found[name] = spark.read.schema(schema(s)).json(f"{folder}/{name}")
    if models is None:
        return found
    return {name: df.where(F.col("model").isin(list(models))) for name, df in found.items()}


def write_results(
    run: Experiment, source: DataFrame, key: str, text: str, label: str, folder: str
) -> None:
    """Models, comparison, reports, matrices, predictions, errors and summary.

    ``source`` is the table that holds the test rows' text.
    """
    spark = source.sparkSession
    for model in run.models:
        model.save(spark, f"{folder}/models/{model.name}")
    file_name = file_safe_name("model")
    texts = valid_labels(source, label).select(key, F.col(text).alias("text"))

    write_csv(run.comparison.orderBy("model_rank").coalesce(1), f"{folder}/model_comparison")
    write_csv(run.validation.orderBy("model_rank").coalesce(1), f"{folder}/validation")
    reports = metrics.classification_report(run.cells).withColumn("file", file_name)
    write_csv(reports.coalesce(1), f"{folder}/reports", partition_by=("file",))
    documents = metrics.nested_report(run.cells).withColumn("file", file_name)
    write_json(documents.coalesce(1), f"{folder}/reports_json", partition_by=("file",))
    matrices = metrics.confusion_matrix(run.cells).withColumn("file", file_name)
    write_csv(matrices.coalesce(1), f"{folder}/confusion_matrices", partition_by=("file",))
    table = errors.prediction_table(run.predictions, texts, run.corpus.class_table(), key, "text")
    table.withColumn("file", file_name).write.mode("overwrite").partitionBy("file").parquet(
        f"{folder}/predictions"
    )
    rows = spark.read.parquet(f"{folder}/predictions")
    write_csv(rows, f"{folder}/predictions_csv", partition_by=("file",))
    write_json(errors.error_rates(run.cells).coalesce(1), f"{folder}/error_rates")
    samples = errors.error_samples(run.predictions, texts, key, "text")
    write_json(samples.coalesce(1), f"{folder}/error_samples")
    summary = summary_document(run, text, label)
    summary.coalesce(1).write.mode("overwrite").text(f"{folder}/summary")
