"""Plans of the registered queries, and the loading of files."""

import subprocess
import sys

import pytest
from __spark_entry__ import entry, oracle_sql, queries
from comparing import compare, connect
from comparing import rows

from candor.plans.loading import load_dataset
from catalog import tables as t
from catalog.oracle import ORACLE

FORBIDDEN = (
    "PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
    "CartesianProduct", "BroadcastNestedLoopJoin",
)
# Windows over all rows: allowed only where those are one row per class, column or length.
WITHOUT_PARTITION = {
    "class_distribution", "json_document", "select_text_column", "sequence_length_quantiles",
}


def physical(df):
    text = df._jdf.queryExecution().toString()
    return text[text.index("== Physical Plan ==") :]


# A pluggable Python model is scored in Arrow batches.
IN_PYTHON = {"batch_scoring"}
# These fit several models; the plans that score and stage are those of the other model queries.
SEVERAL_FITS = {"evaluate_all", "train_all", "cross_validate", "baseline_c", "proposed", "random_forest"}


@pytest.mark.parametrize("name", sorted(set(ORACLE) - IN_PYTHON - SEVERAL_FITS))
def test_plan_stays_in_the_jvm_and_never_pairs_all_rows(spark, small_dir, name):
    plan = physical(queries()[name](spark, small_dir))
    for node in FORBIDDEN:
        assert node not in plan
    if "Window [" in plan and "SinglePartition" in plan:
        assert name in WITHOUT_PARTITION


@pytest.mark.parametrize(
    "name",
    [
        "label_encode", "class_weights", "nested_split", "kfold_assign", "debug_subset",
        "augment_minority", "classification_report", "prediction_table", "error_samples",
    ],
)
def test_side_tables_over_the_bound_join_by_shuffle(spark, small_dir, name):
    want = connect(small_dir).sql(oracle_sql()[name]).to_arrow_table()
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        df = queries()[name](spark, small_dir)
        assert "BroadcastHashJoin" not in physical(df)
        assert compare(df.toArrow(), want) is None
    finally:
        spark.conf.set(threshold, before)


def test_scans_read_only_the_columns_they_need(spark, small_dir):
    plan = queries()["token_length_histogram"](spark, small_dir)._jdf.queryExecution()
    assert "ReadSchema: struct<text:string>" in plan.toString()
    plan = queries()["majority_vote"](spark, small_dir)._jdf.queryExecution().toString()
    assert "text" not in plan[plan.index("== Physical Plan ==") :]


def test_applying_a_vocabulary_does_not_shuffle(spark, small_dir):
    plan = physical(queries()["tfidf_l2"](spark, small_dir))
    assert "hashpartitioning" not in plan


def test_top_k_windows_are_cut_before_the_shuffle(spark, small_dir):
    plan = physical(queries()["top_unigrams"](spark, small_dir))
    assert "WindowGroupLimit" in plan and ", Partial" in plan


def test_votes_are_hashed_and_not_sorted(spark, small_dir):
    plan = physical(queries()["majority_vote"](spark, small_dir))
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


@pytest.mark.parametrize("name", ["tfidf_sublinear", "tfidf_apply", "tfidf_l2"])
def test_long_weights_take_no_detour_through_json(spark, small_dir, name):
    assert "json" not in physical(queries()[name](spark, small_dir)).lower()


def test_the_corpus_package_can_be_taken_out(tmp_path):
    """Without the llm folder and the pipeline, the entry point has all other queries."""
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for part in ("candor", "catalog"):
        shutil.copytree(root / part, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') for k in e.queries()))"
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=False
    )
    assert done.returncode == 0, done.stderr[-2000:]
    total, dealt = map(int, done.stdout.split())
    assert total > 60 and dealt == 0


def test_entry(spark):
    [row] = entry(spark).collect()
    assert row["model"] == "Baseline_A" and 0 < row["accuracy"] <= 1


def test_load_dataset(spark, small_dir, tmp_path):
    labelled = t.labelled(spark, small_dir).withColumnRenamed("label", "evasion_label")
    labelled = labelled.withColumnRenamed("text", "interview_question")
    for split in ("train", "test"):
        labelled.write.parquet(str(tmp_path / f"{split}-00000-of-00001.parquet"))
    data = load_dataset(spark, "doc_id", str(tmp_path))
    assert data.train.columns == ["label", "doc_id", "text", "label_id"]
    assert rows(data.train) == rows(data.test)
    assert data.classes.count() == 4
    blank = str(tmp_path / "blank")
    labelled.selectExpr("doc_id", "interview_question", "' ' AS evasion_label").write.parquet(blank)
    with pytest.raises(ValueError):
        load_dataset(spark, "doc_id", str(tmp_path), test_path=blank)


def test_command_line_takes_a_folder(spark, small_dir, tmp_path):
    rows = t.labelled(spark, small_dir).withColumnsRenamed(
        {"label": "evasion_label", "text": "interview_question"}
    )
    for split in ("train", "test"):
        rows.write.parquet(str(tmp_path / f"{split}-00000-of-00001.parquet"))
    command = [
        sys.executable, "-m", "candor", "--base", str(tmp_path), "--key", "doc_id",
        "--models", "three", "--copies", "5", "--out", str(tmp_path / "out"),
    ]
    done = subprocess.run(command, capture_output=True, text=True, timeout=600, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "Ensemble" in done.stdout


def test_command_line(spark, small_dir, tmp_path):
    t.labelled(spark, small_dir).write.parquet(str(tmp_path / "train"))
    command = [
        sys.executable, "-m", "candor", "--train", str(tmp_path / "train"), "--key", "doc_id",
        "--text", "text", "--models", "three", "--out", str(tmp_path / "out"),
    ]
    done = subprocess.run(command, capture_output=True, text=True, timeout=600, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "Ensemble" in done.stdout
    assert (tmp_path / "out" / "summary").is_dir()
