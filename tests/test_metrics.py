"""Metrics against published confusion matrices and brute force."""

from collections import Counter
from itertools import product

import pytest
from comparing import rows
from pyspark.sql import functions as F

from candor.operators import errors, metrics, voting

CLASSES = ["Ambivalent", "Clear Non-Reply", "Clear Reply"]
# Cells by true class (rows) and predicted class (columns), then the expected
# accuracy, weighted F1, macro F1, macro precision, macro recall, weighted precision.
GOLDEN = {
    "A": ([[193, 0, 13], [20, 0, 3], [70, 0, 9]], 0.6558, 0.5723, 0.3208, 0.3473, 0.3503, 0.5485),
    "C": ([[157, 4, 45], [14, 0, 9], [57, 3, 19]], 0.5714, 0.5480, 0.3245, 0.3163, 0.3342, 0.5273),
    "P": ([[111, 29, 66], [8, 3, 12], [44, 10, 25]], 0.4513, 0.4797, 0.3229, 0.3317, 0.3286, 0.5231),
    "Q": ([[118, 25, 63], [9, 1, 13], [41, 12, 26]], 0.4708, 0.4982, 0.3170, 0.3279, 0.3151, 0.5371),
}
ERROR_RATES = {
    "A": [0.0631, 1.0, 0.8861], "C": [0.2379, 1.0, 0.7595], "P": [0.4612, 0.8696, 0.6835],
}


@pytest.fixture(scope="module")
def predictions(spark):
    data = []
    for rank, (model, (cells, *_)) in enumerate(GOLDEN.items()):
        key = 0
        for i, j in product(range(3), range(3)):
            for _ in range(cells[i][j]):
                data.append((rank, model, key, CLASSES[i], CLASSES[j]))
                key += 1
    return spark.createDataFrame(
        data, "model_rank int, model string, doc_id bigint, label string, prediction string"
    )


@pytest.fixture(scope="module")
def cells(predictions):
    return metrics.confusion_cells(predictions).cache()


def by_model(df):
    return {r["model"]: r for r in df.collect()}


def test_published_scores(cells):
    macro, weighted = by_model(metrics.metrics_macro(cells)), by_model(metrics.metrics_weighted(cells))
    comparison = by_model(metrics.model_comparison(cells))
    for model, (_, acc, wf1, mf1, mp, mr, wp) in GOLDEN.items():
        assert (comparison[model]["accuracy"], comparison[model]["f1_score"]) == (acc, wf1)
        m = macro[model]
        assert (m["f1_macro"], m["precision"], m["recall"]) == (mf1, mp, mr)
        w = weighted[model]
        assert (w["f1_score"], w["precision"], w["recall"]) == (wf1, wp, acc)


def test_matrix_is_dense_and_row_shares_sum_to_one(cells):
    matrix = {(r["model"], r["label"], r["prediction"]): r["n"]
              for r in metrics.confusion_matrix(cells).collect()}
    for model, (want, *_) in GOLDEN.items():
        for i, j in product(range(3), range(3)):
            assert matrix[model, CLASSES[i], CLASSES[j]] == want[i][j]
    shares = metrics.confusion_normalized(cells).groupBy("model", "label")
    for r in shares.agg(F.sum("share").alias("s")).collect():
        assert r["s"] == pytest.approx(1, abs=3e-4)
    wide = metrics.confusion_wide(cells, CLASSES).where("model = 'C'").orderBy("label").collect()
    assert [[r[f"pred_{c}"] for c in CLASSES] for r in wide] == GOLDEN["C"][0]


def test_disjoint_classes_score_zero(spark):
    df = spark.range(308).select(
        F.lit(0).alias("model_rank"), F.lit("A").alias("model"), F.col("id").alias("doc_id"),
        F.lit("0").alias("label"), F.lit("6").alias("prediction"),
    )
    cells = metrics.confusion_cells(df)
    report = {r["row"]: tuple(r)[3:] for r in metrics.classification_report(cells).collect()}
    assert report == {
        "0": (0.0, 0.0, 0.0, 308.0),
        "6": (0.0, 0.0, 0.0, 0.0),
        "accuracy": (0.0, 0.0, 0.0, 0.0),
        "macro avg": (0.0, 0.0, 0.0, 308.0),
        "weighted avg": (0.0, 0.0, 0.0, 308.0),
    }
    shares = {(r["label"], r["prediction"]): r["share"] for r in metrics.confusion_normalized(cells).collect()}
    assert shares == {("0", "0"): 0.0, ("0", "6"): 1.0, ("6", "0"): 0.0, ("6", "6"): 0.0}


def test_report_has_classes_and_three_summary_rows(cells):
    report = metrics.classification_report(cells).where("model = 'A'")
    got = {r["row"]: r for r in report.collect()}
    assert set(got) == {*CLASSES, "accuracy", "macro avg", "weighted avg"}
    assert got["Ambivalent"]["recall"] == round(193 / 206, 4)
    assert got["accuracy"]["support"] == got["accuracy"]["precision"] == 0.6558
    assert got["macro avg"]["support"] == 308


def test_nested_report_holds_the_same_numbers(cells):
    nested = {r["model"]: r["report"] for r in metrics.nested_report(cells).collect()}
    for r in metrics.classification_report(cells).collect():
        assert tuple(nested[r["model"]][r["row"]]) == tuple(r)[3:]


def test_error_rates(cells):
    rates = {(r["model"], r["scope"], r["label"]): r["error_rate"]
             for r in errors.error_rates(cells).collect()}
    for model, want in ERROR_RATES.items():
        assert [rates[model, "class", c] for c in CLASSES] == want
        assert rates[model, "model", ""] == round(1 - GOLDEN[model][1], 4)
    perfect = cells.where("model = 'A' and label = prediction")
    assert errors.error_rates(perfect).count() == 0


def test_top_classes_and_ties(cells):
    top = metrics.top_classes_by_f1(cells, 2).where("model = 'A'").orderBy("place").collect()
    assert [r["class"] for r in top] == ["Ambivalent", "Clear Reply"]


def comparison(spark, data):
    rows_ = [(i, *r) for i, r in enumerate(data)]
    return spark.createDataFrame(
        rows_, "model_rank int, model string, accuracy double, f1_score double"
    )


PUBLISHED = [
    ("Baseline_A", 0.1942, 0.2053), ("Baseline_C", 0.2217, 0.2278), ("Proposed", 0.158, 0.1657),
    ("RandomForest", 0.2406, 0.2305), ("Ensemble", 0.1986, 0.2098),
]


def test_published_best_model_and_insights(spark):
    df = comparison(spark, PUBLISHED)
    assert rows(metrics.best_model(df)) == [
        ("by_accuracy", "RandomForest", 0.2406, 0.2305),
        ("by_f1_score", "RandomForest", 0.2406, 0.2305),
    ]
    ratio = spark.createDataFrame([(13.1875,)], "ratio double")
    row = metrics.key_insights(df, ratio).first().asDict()
    assert row == {
        "best_accuracy": 0.2406, "f1_min": 0.1657, "f1_max": 0.2305,
        "ensemble_improved": False, "imbalance_ratio": 13.1875,
    }


def test_insights_without_and_with_a_better_ensemble(spark):
    ratio = spark.createDataFrame([(2.0,)], "ratio double")
    alone = comparison(spark, PUBLISHED[:2])
    assert metrics.key_insights(alone, ratio).first()["ensemble_improved"] is False
    better = comparison(spark, [*PUBLISHED[:2], ("Ensemble", 0.9, 0.9)])
    assert metrics.key_insights(better, ratio).first()["ensemble_improved"] is True


def test_best_model_takes_the_first_on_a_tie(spark):
    df = comparison(spark, [("x", 0.5, 0.1), ("y", 0.5, 0.2), ("z", 0.4, 0.2)])
    assert rows(metrics.best_model(df)) == [
        ("by_accuracy", "x", 0.5, 0.1), ("by_f1_score", "y", 0.5, 0.2),
    ]


def test_metrics_long(spark):
    long = metrics.metrics_long(comparison(spark, PUBLISHED), ["accuracy", "f1_score"], ["Proposed"])
    assert rows(long) == [("Proposed", "accuracy", 0.158), ("Proposed", "f1_score", 0.1657)]


def votes(spark, patterns):
    data = [
        (rank, f"m{rank}", key, "t", vote)
        for key, pattern in enumerate(patterns)
        for rank, vote in enumerate(pattern)
    ]
    return spark.createDataFrame(
        data, "model_rank int, model string, doc_id bigint, label string, prediction string"
    )


@pytest.mark.parametrize("n_models", [1, 2, 3, 4])
def test_vote_on_all_patterns(spark, n_models):
    patterns = list(product("abc", repeat=n_models))
    got = voting.majority_vote(votes(spark, patterns), "doc_id").orderBy("doc_id").collect()
    assert [r["prediction"] for r in got] == [Counter(p).most_common(1)[0][0] for p in patterns]


def test_ensemble_needs_two_models(spark):
    single = votes(spark, [("a",), ("b",)])
    assert voting.with_ensemble(single, "doc_id", 1) is single
    both = voting.with_ensemble(votes(spark, [("a", "b")]), "doc_id", 2)
    assert rows(both.where("model = 'Ensemble'")) == [(2, "Ensemble", 0, "t", "a")]


def test_error_samples_and_prediction_table(spark, predictions):
    texts = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    samples = errors.error_samples(predictions, texts, "doc_id", k=4)
    wrong = sorted(r["doc_id"] for r in predictions.where("model = 'C' and label <> prediction").collect())
    got = samples.where("model = 'C'").orderBy("place").collect()
    assert [r["doc_id"] for r in got] == wrong[:4]
    assert [r["text"] for r in got] == [f"text {i}" for i in wrong[:4]]
    classes = spark.createDataFrame([(c, i) for i, c in enumerate(CLASSES)], "label string, label_id int")
    table = errors.prediction_table(predictions, texts, classes, "doc_id")
    assert table.count() == predictions.count()
    assert table.where("model = 'A'").agg(F.round(F.avg("correct"), 4)).first()[0] == 0.6558
    assert table.where("true_label <> array_position(array('Ambivalent', 'Clear Non-Reply', 'Clear Reply'), true_label_name) - 1").count() == 0


def test_error_by_length(spark):
    data = [(0, "m", i, "a", "a" if i % 2 else "b") for i in range(10)]
    df = spark.createDataFrame(
        data, "model_rank int, model string, doc_id bigint, label string, prediction string"
    )
    lengths = spark.range(10).select(F.col("id").alias("doc_id"), (F.col("id") * 10).alias("n"))
    assert rows(errors.error_by_length(df, lengths, "doc_id", "n", 50)) == [
        (0, "m", 0, 5, 3, 0.6), (0, "m", 50, 5, 2, 0.4),
    ]


def test_models_of_one_name_are_kept_apart(spark):
    data = [(0, "P", i, "a", "a") for i in range(4)] + [(1, "P", i, "a", "b" if i else "a") for i in range(4)]
    df = spark.createDataFrame(data, "model_rank int, model string, doc_id int, label string, prediction string")
    cells = metrics.confusion_cells(df)
    shares = {(r["model_rank"], r["prediction"]): r["share"] for r in metrics.confusion_normalized(cells).where("label = 'a'").collect()}
    assert shares == {(0, "a"): 1.0, (1, "a"): 0.25, (1, "b"): 0.75}
    places = [(r["model_rank"], r["place"]) for r in metrics.top_classes_by_f1(cells).collect()]
    assert sorted(places) == [(0, 1), (1, 1), (1, 2)]
    rates = errors.error_rates(cells).where("scope = 'model'").collect()
    assert [(r["model_rank"], r["errors"]) for r in rates] == [(1, 3)]
    texts = df.select("doc_id", F.lit("t").alias("text")).distinct()
    assert errors.error_samples(df, texts, "doc_id", k=2).count() == 2


def test_a_missing_prediction_is_an_error(spark):
    data = [(0, "m", 1, "a", "a"), (0, "m", 2, "a", None), (0, "m", 3, "b", None), (0, "m", 4, "b", "a"), (0, "m", 5, "b", "b")]
    df = spark.createDataFrame(data, "model_rank int, model string, doc_id int, label string, prediction string")
    cells = metrics.confusion_cells(df)
    [overall] = errors.error_rates(cells).where("scope = 'model'").collect()
    assert (overall["n"], overall["errors"], overall["error_rate"]) == (5, 3, 0.6)
    assert metrics.model_comparison(cells).first()["accuracy"] == 0.4
    assert {r["class"] for r in metrics.class_scores(cells).collect()} == {"a", "b"}
    assert errors.misclassified(df).count() == 3
    classes = spark.createDataFrame([("a", 0), ("b", 1)], "label string, label_id int")
    texts = df.select("doc_id", F.lit("t").alias("text"))
    table = errors.prediction_table(df, texts, classes, "doc_id")
    assert sorted((r["doc_id"], r["correct"]) for r in table.collect()) == [(1, 1), (2, 0), (3, 0), (4, 0), (5, 1)]
    more = df.unionByName(df.withColumns({"model_rank": F.lit(1), "prediction": F.lit(None).cast("string")}))
    vote = {r["doc_id"]: r["prediction"] for r in voting.majority_vote(more, "doc_id").collect()}
    assert vote == {1: "a", 2: None, 3: None, 4: "a", 5: "b"}
