"""Stand-in inputs, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.functions.seeded import hash60
from candor.functions.text import clean_tokens
from candor.operators.labels import class_table, label_name
from candor.sources.tables import read_table

# Rule models: each keeps the true label for a share of the rows, in tenths.
RULE_MODELS = (("m1", 6), ("m2", 5), ("m3", 7))
ANNOTATORS = ("annotator1", "annotator2", "annotator3")


# Tables whose rows take long to work on.
WIDE = {"documents", "conversations", "embeddings"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", spread=name in WIDE)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label)."""
    return table(spark, sf_dir, "labels").select(
        "doc_id", label_name(("q", F.col("quality")), ("t", F.col("toxic"))).alias("label")
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, label) for the labelled documents."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.join(labels(spark, sf_dir), "doc_id")


def maybe_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the label is null where there is none."""
    return table(spark, sf_dir, "documents").join(labels(spark, sf_dir), "doc_id", "left")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tokens) of all documents."""
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", clean_tokens("text").alias("tokens"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long predictions of the rule models on all labelled rows."""
    rows = labels(spark, sf_dir)
    classes = class_table(rows)
    k = classes.count()
    models = F.array(
        *[
            F.struct(
                F.lit(rank).alias("model_rank"), F.lit(name).alias("model"),
                F.lit(tenths).alias("_tenths"),
            )
            for rank, (name, tenths) in enumerate(RULE_MODELS)
        ]
    )
    scored = rows.select("doc_id", "label", F.inline(models))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "model", F.col("doc_id").cast("string"))), 1, 15), 16, 10)
    scored = scored.withColumn("_h", h.cast("bigint"))
    other = classes.select(F.col("label_id"), F.col("label").alias("_other"))
    joined = scored.join(other, F.pmod("_h", F.lit(k)) == F.col("label_id"))
    kept = F.pmod("_h", F.lit(10)) < F.col("_tenths")
    return joined.select(
        "model_rank", "model", "doc_id", "label",
        F.when(kept, F.col("label")).otherwise(F.col("_other")).alias("prediction"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three annotators who mostly repeat the label, at times differ, at times are silent."""
    rows = labels(spark, sf_dir)
    columns = []
    for name in ANNOTATORS:
        h = hash60(name, "doc_id")
        columns.append(
            F.when(F.pmod(h, F.lit(7)) == 0, F.lit(None).cast("string"))
            .when(F.pmod(h, F.lit(10)) == 1, F.lit("other"))
            .otherwise(F.col("label"))
            .alias(name)
        )
    return rows.select("doc_id", *columns)


def question_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn right after it, and three flags.

    Turns meet on (conv_id, turn), a unique key, so a long conversation is no hot key.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answered = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("interview_answer")
    )
    pairs = asked.join(answered, ["conv_id", "turn"])
    marks = F.length("question") - F.length(F.replace(F.col("question"), F.lit("?"), F.lit("")))
    return pairs.select(
        "*",
        (F.length("interview_answer") < 100).alias("inaudible"),
        (marks > 1).alias("multiple_questions"),
        F.col("question").rlike(r"\?\s*$").alias("affirmative_questions"),
    )


def batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a training log: a run per user group, an epoch per day."""
    events = table(spark, sf_dir, "events")
    phase = F.when(F.col("event_type").isin("view", "click", "purchase"), "train").otherwise("val")
    return events.select(
        F.pmod("user_id", F.lit(3)).cast("int").alias("run"),
        F.dayofmonth("ts").alias("epoch"),
        phase.alias("phase"),
        F.col("value").alias("loss"),
        F.pmod(hash60(42, "event_id"), F.lit(17)).alias("correct"),
        F.lit(16).cast("bigint").alias("total"),
    )
