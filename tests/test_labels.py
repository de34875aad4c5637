import math

import pytest
from comparing import rows
from pyspark.sql import functions as F

from candor.operators import augment, labels
from candor.operators.lookup import small_table


@pytest.fixture(scope="module")
def df(spark):
    data = [(i, "abc"[i % 7 % 3]) for i in range(70)] + [(97, "\n\u00a0\t"), (98, None), (99, "  ")]
    return spark.createDataFrame(data, "doc_id bigint, label string")


def test_blank_labels_are_dropped(df):
    assert labels.valid_labels(df).count() == 70


def test_encode_and_decode(spark, df):
    known = labels.valid_labels(df)
    classes = labels.class_table(known)
    encoded = labels.encode_labels(known, classes)
    ids = {r["label"]: r["label_id"] for r in encoded.collect()}
    assert ids == {"a": 0, "b": 1, "c": 2}
    back = labels.decode_labels(encoded.select("doc_id", "label_id"), classes, "label_id", "name")
    assert rows(back.select("doc_id", "name")) == rows(known.select("doc_id", "label"))


def test_unseen_label_is_an_error(spark, df):
    classes = labels.class_table(labels.valid_labels(df))
    other = spark.createDataFrame([(1, "zzz")], "doc_id bigint, label string")
    with pytest.raises(Exception, match="unseen label: zzz"):
        labels.encode_labels(other, classes).collect()


def test_weights_sum_to_the_number_of_rows(df):
    known = labels.valid_labels(df)
    weighted = labels.weight_column(known, labels.class_weights(known))
    assert math.isclose(weighted.agg(F.sum("weight")).first()[0], 70)


def test_class_statistics(df):
    known = labels.valid_labels(df)
    assert rows(labels.class_distribution(known)) == [
        ("a", 30, 42.8571), ("b", 20, 28.5714), ("c", 20, 28.5714),
    ]
    assert tuple(labels.minority_class(known).first()) == ("b", 20)
    assert tuple(labels.imbalance_ratio(known).first()) == (30, 20, 1.5)
    classes = labels.class_table(known)
    dense = labels.class_counts_dense(known.where("label <> 'b'"), classes)
    assert rows(dense) == [("a", 0, 30), ("b", 1, 0), ("c", 2, 20)]


def test_published_imbalance_ratio(spark):
    df = spark.range(227).select(F.when(F.col("id") < 211, "x").otherwise("y").alias("label"))
    assert labels.imbalance_ratio(df).first()["ratio"] == 13.1875


def test_rollup(spark):
    df = spark.createDataFrame([("a1",), ("a2",), ("b1",), ("?",)], "label string")
    rolled = labels.roll_up_labels(df, {"a1": "a", "a2": "a", "b1": "b"})
    assert rows(rolled) == rows(
        spark.createDataFrame([("a1", "a"), ("a2", "a"), ("b1", "b"), ("?", None)], "x string, y string")
    )
    pairs = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p")], "c string, p string")
    assert rows(labels.inconsistent_children(pairs, "c", "p")) == [("x", 2, 2)]


def test_class_zero_and_empty_string_are_valid_targets(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id bigint, label int")
    assert labels.of_class(df, 0).count() == 2
    text = df.withColumn("text", F.lit("good bad answer"))
    grown = augment.oversample(text, "doc_id", "text", target=0, n_samples=5)
    assert grown.where("sample_id is not null").select("label").distinct().first()[0] == 0


def test_rows_without_a_label_are_no_class(spark):
    data = [(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "b"), (6, None), (7, " ")]
    df = spark.createDataFrame(data, "doc_id bigint, label string").withColumn("text", F.lit("good bad x"))
    assert tuple(labels.minority_class(df).first()) == ("a", 2)
    assert {r["label"]: r["weight"] for r in labels.class_weights(df).collect()} == {"a": 1.25, "b": 5 / 6}
    assert rows(labels.class_table(df.where("label <> ' '"))) == [("a", 0), ("b", 1)]
    grown = augment.oversample(df, "doc_id", "text", n_samples=6)
    assert {r["label"] for r in grown.where("sample_id is not null").collect()} == {"a"}
    assert grown.where("sample_id is null").count() == 7
    # A missing label can still be asked for.
    assert labels.of_class(df, None).count() == 1


def test_oversample(spark):
    data = [(i, "big", "good answer to a question") for i in range(50)]
    data += [(100 + i, "tiny", f"a good answer number {i}") for i in range(3)]
    df = spark.createDataFrame(data, "doc_id bigint, label string, text string")
    grown = augment.oversample(df, "doc_id", "text", n_samples=40)
    copies = grown.where("sample_id is not null")
    assert grown.count() == 93 and copies.count() == 40
    assert copies.select("sample_id").distinct().count() == 40
    assert {r["label"] for r in copies.collect()} == {"tiny"}
    assert {r["doc_id"] for r in copies.collect()} == {100, 101, 102}
    again = augment.oversample(df.repartition(7), "doc_id", "text", n_samples=40)
    assert rows(grown) == rows(again)
    with pytest.raises(ValueError):
        augment.oversample(df, "doc_id", "text", target="absent")


def test_side_tables_are_computed_once_and_broadcast_by_size(spark):
    side = small_table(spark.range(100).withColumn("x", F.rand()))
    assert rows(side) == rows(side)
    joined = spark.range(5).join(side, "id")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().toString()
