"""Column roles, schema union, profiles, sources and sinks."""

import json

import pytest
from comparing import rows
from pyspark.sql import functions as F

from candor.functions.text import clean_tokens
from candor.operators import metrics, profile, roles
from candor.sources import staging, tables


def frame(spark, ddl, *data):
    return spark.createDataFrame(list(data), ddl)


def test_text_column_is_a_string_and_exact_names_win(spark):
    df = frame(
        spark,
        "question_order bigint, question_title string, question string, evasion_label string",
        (1, "title", "text", "x"),
    )
    assert roles.detect_text_column(df) == "question"
    assert roles.detect_label_column(df, "question") == "evasion_label"
    fallback = frame(spark, "n int, aa string, bb string", (1, "x", "y"), (2, "x", "z"))
    assert roles.detect_text_column(fallback) == "aa"
    assert roles.detect_label_column(fallback, "bb") == "aa"
    with pytest.raises(ValueError):
        roles.detect_text_column(frame(spark, "n int", (1,)))
    with pytest.raises(ValueError):
        roles.detect_label_column(frame(spark, "t string", ("x",)), "t")


def test_roles_in_the_canonical_schema(spark):
    empty = spark.createDataFrame([], roles.CANONICAL)
    assert roles.detect_columns(empty, ["index"]) == ("interview_question", "clarity_label")


def test_standardize_turns_null_text_into_the_empty_string(spark):
    df = frame(spark, "id int, `my.Text` string, Label string", (1, None, "a"), (2, "t", None))
    got = roles.standardize(df, keys=["id"])
    assert got.columns == ["id", "text", "label"]
    assert rows(got) == [(1, "", "a"), (2, "t", None)]


def test_choice_of_the_text_column(spark):
    long = "a text of more than twenty characters"
    df = frame(
        spark, "question string, interview_answer string, `gpt3.5_summary` string",
        ("short", long, long), (None, long, long),
    )
    assert roles.select_text_column(df) == "interview_answer"
    none_fits = frame(spark, "x string, question string", ("a", "b"))
    assert roles.select_text_column(none_fits) == "question"
    neither = frame(spark, "x string, y string", ("a", "b"))
    assert roles.select_text_column(neither) == "x"


def test_fewest_distinct_by_sketches_equals_the_whole_count(spark, monkeypatch):
    df = spark.range(20_000).select(
        "id", (F.col("id") % 5000).alias("a"), (F.col("id") % 4990).cast("string").alias("b.c"),
        F.when(F.col("id") % 2 == 0, F.col("id") % 5000).alias("half"), F.sha2(F.col("id").cast("string"), 512).alias("t"),
    )
    counted = []
    whole = roles.distinct_counts
    monkeypatch.setattr(roles, "distinct_counts", lambda d, c: counted.append(c) or whole(d, c))
    for columns, best in ((None, ("half", 2500)), (["id", "a", "b.c"], ("b.c", 4990)), (["a", "id"], ("a", 5000))):
        assert tuple(roles.fewest_distinct_column(df, columns).first()) == best
        assert best == tuple(roles.fewest_distinct(whole(df, columns)).first())
    # Columns of nearly as few values are counted too, others are not.
    assert counted == [["half"], ["a", "b.c"], ["a"]]
    bounds = roles.distinct_bounds(df)
    assert all(low <= n <= high for (low, high), n in zip(bounds.values(), (20_000, 5000, 4990, 2500, 20_000)))


def test_fewest_distinct_of_nulls_ties_and_nothing(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "x", None), (2, None, None)], "a int, b string, n string")
    assert tuple(roles.fewest_distinct_column(df).first()) == ("n", 0)
    assert tuple(roles.fewest_distinct_column(df, ["a", "b"]).first()) == ("b", 1)
    assert tuple(roles.fewest_distinct_column(df.withColumn("c", F.col("b")), ["c", "b"]).first()) == ("c", 1)
    assert roles.detect_label_column(df, "n") == "b"


def test_distinct_counts_with_nulls_and_long_values(spark):
    df = frame(spark, "a string, b int", ("x" * 500, 1), ("x" * 500, None), ("x" * 499, 1))
    assert rows(roles.distinct_counts(df).select("column", "n_distinct")) == [("a", 2), ("b", 1)]
    assert tuple(roles.fewest_distinct(roles.distinct_counts(df)).first()) == ("b", 1)


def test_schema_variants_unite(spark):
    a = frame(spark, "question string, label string, inaudible boolean", ("q", "l", True))
    b = frame(spark, "`Unnamed: 0` bigint, Label string, Annotator1 string", (5, "m", "n"))
    c = frame(spark, "annotator_id bigint, `gpt3.5_summary` string, junk int", (7, "s", 1))
    got = roles.harmonize_union([a, b, c])
    assert got.columns == [
        "question", "evasion_label", "inaudible", "annotator1", "annotator_id", "gpt3.5_summary",
    ]
    assert rows(got) == rows(
        frame(
            spark,
            "a string, b string, c boolean, d string, e string, f string",
            ("q", "l", True, None, None, None),
            (None, "m", None, "n", None, None),
            (None, None, None, None, "7", "s"),
        )
    )


def test_two_columns_of_one_canonical_name(spark):
    df = frame(spark, "label string, evasion_label string, other int", ("a", "b", 1), (None, "c", 2))
    assert rows(roles.harmonize(df, extra=["other"])) == [("a", 1), ("c", 2)]


def test_profile(spark):
    df = frame(spark, "id int, `t.x` string", (2, "second"), (1, "first one"), (3, None))
    got = {r["column"]: tuple(r)[3:] for r in profile.table_profile(df, "id").collect()}
    assert got == {"id": (3, 0, 1.0, "1"), "t.x": (3, 1, 5.0, "first one")}


def test_exploration(spark):
    df = frame(
        spark, "label string, t string",
        ("a", "well well now"), ("a", "now then"), ("b", "let me see now, farewell"),
    )
    tokens = df.withColumn("t", clean_tokens("t"))
    assert rows(profile.top_unigrams(tokens, "t", "label", 1)) == [
        ("*", 1, "now", 3), ("a", 1, "now", 2), ("b", 1, "farewell", 1),
    ]
    assert rows(profile.discourse_markers(df, "t", "label")) == [
        ("a", "let me", 2, 0, 0.0), ("a", "well", 2, 1, 0.5),
        ("b", "let me", 1, 1, 1.0), ("b", "well", 1, 0, 0.0),
    ]
    assert rows(profile.length_by_class(df, "t", "label")) == [("a", 2, 2.5, 0.7071), ("b", 1, 5.0, None)]
    assert rows(profile.token_length_histogram(tokens, "t", 3)) == [(0, 1), (3, 2)]
    marks = frame(
        spark, "x string, y string, z string", ("a", "a", None), ("a", "b", "a"), ("a", None, None)
    )
    assert tuple(profile.annotator_disagreement(marks, ["x", "y", "z"]).first()) == (2, 1, 0.5)
    flags = frame(spark, "f boolean, g boolean", (True, None), (False, True))
    assert rows(profile.flag_rates(flags, ["f", "g"])) == [("f", 1, 0.5), ("g", 1, 1.0)]


def test_history(spark):
    log = frame(
        spark, "run string, epoch int, phase string, loss double, correct int, total int",
        ("r", 1, "train", 1.0, 8, 16), ("r", 1, "train", 0.5, 4, 4), ("r", 1, "val", 2.0, 1, 4),
    )
    assert rows(profile.training_history(log)) == [
        ("r", 1, "train", 0.75, 0.6), ("r", 1, "val", 2.0, 0.25),
    ]


def test_csv_keeps_any_text(spark, tmp_path):
    texts = ['say "hi", now', "two\nlines", "comma, and \\ slash", "plain"]
    df = frame(spark, "id int, text string", *enumerate(texts))
    tables.write_csv(df, str(tmp_path / "c"))
    back = tables.read_csv(spark, str(tmp_path / "c"), "id int, text string", line_breaks=True)
    assert rows(back) == rows(df)
    tables.write_csv(df.withColumn("m", F.lit("x")), str(tmp_path / "p"), partition_by=("m",))
    assert (tmp_path / "p" / "m=x").is_dir()


def test_json_sinks(spark, tmp_path):
    df = frame(spark, "m string, n int", ("a", 1), ("b", 2))
    tables.write_json(df, str(tmp_path / "j"))
    assert rows(spark.read.json(str(tmp_path / "j"))) == rows(df)
    [row] = tables.one_json_document({"one": df, "two": df.limit(1)}).collect()
    assert json.loads(row["document"]) == {
        "one": [{"m": "a", "n": 1}, {"m": "b", "n": 2}], "two": [{"m": "a", "n": 1}],
    }


def test_json_documents_keep_the_order_of_rows_and_sections(spark):
    df = spark.createDataFrame([(i, f"m{i}") for i in range(12)], "model_rank int, model string")
    [row] = tables.one_json_document({"z": df.orderBy("model_rank"), "a": df.orderBy(F.desc("model_rank"))}).collect()
    found = json.loads(row["document"])
    assert list(found) == ["z", "a"]
    assert [r["model_rank"] for r in found["z"]] == list(range(12))
    assert [r["model_rank"] for r in found["a"]] == list(range(11, -1, -1))


def test_split_files_are_found_by_file_name(spark, tmp_path):
    base = tmp_path / "train-data"
    for folder in ("", "data"):
        for split in ("train", "test"):
            spark.range(1).write.parquet(str(base / folder / f"{split}-00000-of-00001.parquet"))
    found = tables.find_split_files(spark, str(base))
    assert found["train"].endswith("data/train-00000-of-00001.parquet")
    assert found["test"].endswith("data/test-00000-of-00001.parquet")
    with pytest.raises(FileNotFoundError):
        tables.find_split_files(spark, str(tmp_path / "nothing"))


def test_small_tables_use_all_cores(spark, sf_dir):
    df = tables.read_table(spark, f"{sf_dir}/documents.parquet", spread=True)
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_staged_tables_live_in_the_shared_folder(spark):
    df = spark.range(10).withColumn("p", F.col("id") % 2)
    staged = staging.stage(df, "x", "p")
    folder = spark.conf.get("spark.checkpoint.dir")
    assert all(folder in f for f in staged.inputFiles())
    assert rows(staged.select("id", "p")) == rows(df)


def test_metric_table_round_trip(spark, tmp_path):
    df = frame(spark, "model string, accuracy double, f1_score double", ("a", 0.5, 0.25))
    tables.write_csv(df, str(tmp_path / "m"))
    schema = "model string, accuracy double, f1_score double"
    back = tables.read_csv(spark, str(tmp_path / "m"), schema)
    assert rows(metrics.metrics_long(back, ["accuracy", "f1_score"])) == [
        ("a", "accuracy", 0.5), ("a", "f1_score", 0.25),
    ]
