import pytest
from comparing import rows
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candor.functions.seeded import hash60
from candor.operators import splits


def corpus(spark, sizes, partitions=4):
    """doc_id 0.. with classes of the given sizes."""
    pairs = [(name, n) for name, n in sizes.items()]
    df = spark.createDataFrame(pairs, "label string, n bigint")
    out = df.select("label", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    return out.select(
        F.concat("label", F.lit("-"), F.col("i")).alias("doc_id"), "label"
    ).repartition(partitions)


def plain_rank(df):
    order = Window.partitionBy("label").orderBy(hash60(42, "doc_id"), "doc_id")
    return df.withColumn("r", F.row_number().over(order))


def test_quotas_match_the_published_split_sizes(spark):
    counts = spark.createDataFrame(
        [("Ambivalent", 2040), ("Clear Reply", 1052), ("Clear Non-Reply", 356)],
        "label string, n bigint",
    )
    cut = splits.nested_cuts([0.15], "label")(counts).collect()
    kept = {r["label"]: r["cuts"][0] for r in cut}
    assert (2040 - kept["Ambivalent"], 1052 - kept["Clear Reply"]) == (1734, 894)
    assert 356 - kept["Clear Non-Reply"] == 302
    nested = splits.nested_cuts([0.2, 0.15], "label")(counts)
    test, both = nested.agg(F.sum(F.col("cuts")[0]), F.sum(F.col("cuts")[1])).first()
    assert (test, both - test, 3448 - both) == (690, 414, 2344)


SIZES = {"hot": 9000, "mid": 700, "small": 11, "single": 1}


@pytest.mark.parametrize("prefix_bits", [2, 12])
def test_split_equals_a_plain_window(spark, prefix_bits):
    df = corpus(spark, SIZES)
    rule = splits.nested_cuts([0.2, 0.15], "label")
    blocks = splits.assign_blocks(df, "doc_id", "label", rule, prefix_bits=prefix_bits)
    counts = df.groupBy("label").agg(F.count("*").alias("n"))
    cuts = {r["label"]: r["cuts"] for r in rule(counts).collect()}
    ranked = {r["doc_id"]: r["r"] for r in plain_rank(df).collect()}
    for r in blocks.collect():
        want = sum(ranked[r["doc_id"]] > c for c in cuts[r["label"]])
        assert r["block"] == want


def test_split_is_a_partition_with_exact_sizes(spark):
    df = corpus(spark, SIZES)
    split = splits.nested_split(df, "doc_id", "label")
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    total = sum(SIZES.values())
    test = -(-total * 2 // 10)
    val = -(-(total - test) * 15 // 100)
    assert sizes == {"test": test, "val": val, "train": total - test - val}
    assert split.select("doc_id").distinct().count() == total


def test_split_does_not_depend_on_partitioning(spark):
    one = splits.stratified_split(corpus(spark, SIZES, 1), "doc_id", "label")
    many = splits.stratified_split(corpus(spark, SIZES, 200), "doc_id", "label")
    assert rows(one) == rows(many)


def test_another_seed_gives_another_split(spark):
    df = corpus(spark, SIZES)
    a = splits.stratified_split(df, "doc_id", "label", seed=1)
    b = splits.stratified_split(df, "doc_id", "label", seed=2)
    assert rows(a) != rows(b)
    assert rows(a.groupBy("label", "split").count()) == rows(b.groupBy("label", "split").count())


def test_folds_are_balanced(spark):
    folds = splits.assign_folds(corpus(spark, SIZES), "doc_id", "label", 5)
    per_fold = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert len(per_fold) == 5 and max(per_fold) - min(per_fold) <= 1
    per_class = folds.groupBy("label", "fold").count().groupBy("label")
    for r in per_class.agg(F.max("count").alias("hi"), F.min("count").alias("lo")).collect():
        assert r["hi"] - r["lo"] <= 1
    with pytest.raises(ValueError):
        splits.assign_folds(folds, "doc_id", "label", 1)


def test_debug_subset(spark):
    df = corpus(spark, SIZES)
    assert splits.debug_subset(df, "doc_id", "label", 50).count() == 50
    assert splits.debug_subset(df, "doc_id", "label", 10**6).count() == df.count()


def test_ranked_rows_equal_a_plain_row_number(spark, monkeypatch):
    df = corpus(spark, {"a": 500})
    order = Window.orderBy(hash60(42, "doc_id"), "doc_id")
    want = df.select((F.row_number().over(order) - 1).cast("bigint").alias("idx"), "doc_id")
    asked = spark.range(500).select(F.col("id").alias("idx"))
    for per_prefix in (1, 30, 4096):
        monkeypatch.setattr(splits, "ROWS_PER_PREFIX", per_prefix)
        assert rows(splits.ranked_rows(df, "doc_id", asked, n=500)) == rows(want)
    some = want.where("idx % 90 = 7")
    assert rows(splits.ranked_rows(df, "doc_id", some.select("idx"), n=500)) == rows(some)


def test_the_data_is_not_shuffled_to_split_it(spark, tmp_path):
    corpus(spark, SIZES).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = splits.stratified_split(df, "doc_id", "label")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert "BroadcastHashJoin" in physical
    assert "hashpartitioning" not in physical and "SinglePartition" not in physical


@pytest.mark.parametrize("bits, top", [(1, 10), (9, 3), (12, 10)])
def test_prefix_offsets_in_two_levels(spark, monkeypatch, bits, top):
    monkeypatch.setattr(splits, "TOP_BITS", top)
    counts = {b: 1 + b * 7 % 5 for b in range(0, 2**bits, 3)}
    df = spark.createDataFrame(list(counts.items()), "_bucket int, _count bigint")
    found = splits.prefix_offsets(df, bits)
    got = {r["_bucket"]: (r["_count"], r["_off"]) for r in found.collect()}
    assert got == {b: (n, sum(m for c, m in counts.items() if c < b)) for b, n in counts.items()}
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
    assert splits.prefix_offsets(df.limit(0), bits).count() == 0
