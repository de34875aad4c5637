import json
import math

import numpy as np
import pytest
from comparing import rows
from pyspark.sql import functions as F

from candor.operators import linear, metrics, scoring
from candor.operators.tfidf import TextFeatures
from candor.plans import experiment
from candor.plans import models as plan
from catalog import tables as t


@pytest.fixture(scope="module")
def labelled(spark, sf_dir):
    return t.labelled(spark, sf_dir)


@pytest.fixture(scope="module")
def corpus(labelled):
    return plan.prepare_corpus(labelled, "doc_id", "text")


def test_corpus(corpus, labelled):
    sizes = {r["split"]: r["count"] for r in corpus.rows.groupBy("split").count().collect()}
    assert sizes == {"test": 80, "val": 48, "train": 271}
    assert rows(corpus.rows.select("doc_id")) == rows(labelled.select("doc_id"))


def test_corpus_with_a_given_test_table(labelled):
    with_test = plan.prepare_corpus(labelled, "doc_id", "text", test=labelled, val_size=0.15)
    sizes = {r["split"]: r["count"] for r in with_test.rows.groupBy("split").count().collect()}
    assert sizes == {"test": 399, "val": 60, "train": 339}


SPECS = {
    "lr": plan.baseline_a(500),
    "svm": plan.ModelSpec("SVM", TextFeatures(500, (1, 2)), plan.linear_svm(max_iter=50)),
    "ovr": plan.proposed(500),
    "multinomial": plan.proposed_multinomial(500),
    "forest": plan.ModelSpec("RF", TextFeatures(300), plan.random_forest(20, 5)),
}


REGISTERED = {s.name: s for s in [*plan.three_models(), *plan.four_models()[2:]]}


@pytest.mark.parametrize("name", [*SPECS, *REGISTERED])
def test_model_learns_and_predicts_known_classes(corpus, name):
    models, staged = plan.train_all(corpus, [SPECS.get(name) or REGISTERED[name]])
    scored = {s: plan.predict_split(models, staged, "doc_id", s) for s in ("train", "test")}
    known = set(corpus.classes)
    for split, df in scored.items():
        assert rows(df.select("doc_id")) == rows(corpus.split(split).select("doc_id"))
        assert {r["prediction"] for r in df.collect()} <= known
    counts = corpus.split("train").groupBy("label").count()
    majority = counts.agg(F.max("count") / F.sum("count")).first()[0]
    correct = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    assert scored["train"].agg(correct).first()[0] > majority


def test_save_and_load_give_equal_predictions(spark, corpus, tmp_path):
    specs = [SPECS["multinomial"], SPECS["svm"]]
    models, staged = plan.train_all(corpus, specs)
    for model in models:
        model.save(spark, str(tmp_path / model.name))
        loaded = plan.TextModel.load(spark, str(tmp_path / model.name))
        test = corpus.split("test")
        got = rows(loaded.predict_tokens(test, "doc_id", "label"))
        assert got == rows(model.predict_tokens(test, "doc_id", "label"))
        assert loaded.features == model.features and loaded.vocabulary == model.vocabulary
        vectors = staged[model.features].split("test")
        assert rows(model.predict_vectors(vectors, "doc_id")) == [r[:3] for r in got]


@pytest.mark.parametrize("name", ["lr", "svm", "ovr", "forest"])
def test_raw_texts_without_labels_are_scored(spark, corpus, tmp_path, name):
    [model], _ = plan.train_all(corpus, [SPECS[name]])
    model.save(spark, str(tmp_path / "m"))
    texts = spark.createDataFrame([(1, "Some new text of the of"), (2, None), (3, "")], "i int, t string")
    scored = plan.score_saved(spark, str(tmp_path / "m"), texts, "i", "t").orderBy("i").collect()
    assert [r["i"] for r in scored] == [1, 2, 3]
    for r in scored:
        assert r["prediction"] in corpus.classes
        assert len(r["probabilities"]) == len(corpus.classes)
        assert sum(r["probabilities"]) == pytest.approx(1) and min(r["probabilities"]) >= 0
        assert corpus.classes[int(np.argmax(r["probabilities"]))] == r["prediction"]
    assert scored[1]["probabilities"] == scored[2]["probabilities"]


def test_two_models_of_one_name_are_refused(corpus):
    with pytest.raises(ValueError):
        plan.train_all(corpus, [plan.baseline_a(50), plan.baseline_a(60)])


def test_linear_models_are_fitted_by_several_tasks(spark, corpus):
    vectors = plan.stage_features(corpus, TextFeatures(50))
    assert plan.train_rows(vectors).rdd.getNumPartitions() >= plan.LEAST_TASKS > 1
    counted = plan.train_rows(vectors).count()
    assert counted == corpus.n_train


def test_copies_are_train_rows_only(labelled):
    grown = plan.prepare_corpus(labelled, "doc_id", "text", copies=30)
    plain = plan.prepare_corpus(labelled, "doc_id", "text")
    copies = grown.rows.where("copy is not null")
    assert copies.count() == 30 and {r["split"] for r in copies.collect()} == {"train"}
    trained = {r["doc_id"] for r in plain.split("train").collect()}
    assert {r["doc_id"] for r in copies.collect()} <= trained
    originals = grown.rows.where("copy is null").select("doc_id", "split", "label")
    assert rows(originals) == rows(plain.rows.select("doc_id", "split", "label"))
    assert grown.n_train == plain.n_train + 30


def test_features_are_staged_once_per_specification(corpus):
    two = [plan.baseline_a(100), plan.ModelSpec("B", TextFeatures(100), plan.logistic(0.5))]
    _, staged = plan.train_all(corpus, two)
    assert len(staged) == 1


def test_cross_validation_scores_every_row_once(labelled):
    got = plan.cross_validate(
        labelled, "doc_id", "text", TextFeatures(200),
        {"weak": plan.logistic(0.01, 20), "strong": plan.logistic(1.0, 20)}, k=3,
    )
    scores = got.collect()
    assert {r["model"] for r in scores} == {"weak", "strong"}
    assert all(0 < r["accuracy"] <= 1 for r in scores)


GRID = {
    f"{n} {c}": (TextFeatures(n), plan.logistic_one_vs_rest(c)) for n in (30, 300) for c in (1e-4, 1.0)
}


def test_halving_finds_the_winner_of_the_full_grid(labelled):
    scored, scores = plan.halving_search(labelled, "doc_id", "text", GRID, k=3)
    _, full = plan.halving_search(labelled, "doc_id", "text", GRID, k=3, keep=1.0)
    assert full.count() == len(GRID)
    assert plan.best_name(scores, "f1_score") == plan.best_name(full, "f1_score")
    per_rung = scored.groupBy("rung").agg(F.count_distinct("model").alias("m"), F.count_distinct("fold").alias("f"))
    assert sorted(map(tuple, per_rung.collect())) == [(0, 4, 1), (1, 2, 1), (2, 1, 1)]
    assert plan.halving_rungs(5) == [[0], [1], [2, 3], [4]] and plan.halving_rungs(1) == [[0]]
    with pytest.raises(ValueError):
        plan.halving_search(labelled, "doc_id", "text", {})


def test_a_path_of_penalties_ends_where_each_fit_alone_ends(corpus):
    staged = plan.stage_features(corpus, TextFeatures(200))
    rows = linear.PackedRows.of(plan.train_rows(staged))
    alone = linear.NewtonClassifier(linear.MULTINOMIAL, 1.0).fit_rows(rows)
    before = linear.NewtonClassifier(linear.MULTINOMIAL, 0.1).fit_rows(rows)
    after = linear.NewtonClassifier(linear.MULTINOMIAL, 1.0, start=before).fit_rows(rows)
    rows.release()
    assert np.abs(alone.coefficients - after.coefficients).max() < 2e-3


def test_the_best_candidate_is_fitted_on_all_rows(labelled):
    candidates = {"weak": plan.logistic(1e-6, 20), "strong": plan.logistic(1.0, 20)}
    scores, model = plan.tune(labelled, "doc_id", "text", TextFeatures(200), candidates, k=3)
    best = max(scores.collect(), key=lambda r: (r["f1_score"], -r["model_rank"]))
    assert model.name == best["model"]
    scored = model.predict(labelled, "doc_id")
    assert scored.count() == labelled.count()


def test_fold_vocabularies_equal_those_of_the_other_folds(spark, labelled):
    from candor.functions.text import clean_tokens
    from candor.operators import tfidf

    docs = labelled.select("doc_id", (F.col("doc_id") % 3).alias("fold"), clean_tokens("text").alias("tokens"))
    counts = tfidf.corpus_term_counts(docs, "tokens", ["fold"])
    others = counts.where("fold <> 1").groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    rest = docs.where("fold <> 1")
    spec = TextFeatures(150, min_df=2)
    want = tfidf.fit_terms(rest, "tokens", spec)
    assert tfidf.chosen_terms(others, rest.count(), spec).to_pydict() == want.to_pydict()


def test_experiment_writes_every_result(spark, labelled, tmp_path):
    specs = [SPECS["lr"], SPECS["forest"]]
    run = experiment.run_experiment(labelled, "doc_id", "text", specs=specs)
    assert [r["model"] for r in run.comparison.orderBy("model_rank").collect()] == [
        "Baseline_A", "RF", "Ensemble",
    ]
    folder = str(tmp_path / "out")
    experiment.write_results(run, labelled, "doc_id", "text", "label", folder)
    results = experiment.read_results(spark, folder, "doc_id")
    table = results["predictions"]
    assert rows(results["model_comparison"]) == rows(run.comparison)
    assert rows(results["confusion_matrices"].drop("file")) == rows(metrics.confusion_matrix(run.cells))
    written = table.where("model = 'RF'").select("doc_id", "text")
    tested = run.corpus.split("test").select("doc_id")
    assert rows(written) == rows(labelled.join(tested, "doc_id").select("doc_id", "text"))
    wrong = table.where("correct = 0").groupBy("model").count().orderBy("model")
    rates = results["error_rates"].where("scope = 'model'").orderBy("model")
    assert [r["count"] for r in wrong.collect()] == [r["errors"] for r in rates.collect()]
    chosen = experiment.read_results(spark, folder, "doc_id", models=["RF"])
    assert {r["model"] for r in chosen["reports"].collect()} == {"RF"}
    assert chosen["error_samples"].where("label = prediction").count() == 0
    assert table.count() == 3 * 80
    by_model = table.groupBy("model").agg(F.round(F.avg("correct"), 4).alias("accuracy"))
    assert rows(by_model) == rows(run.comparison.select("model", "accuracy"))
    summary = json.loads(spark.read.text(f"{folder}/summary").first()[0])
    assert [m["model"] for m in summary["models"]] == ["Baseline_A", "RF"]
    assert [r["model"] for r in summary["results"]] == ["Baseline_A", "RF", "Ensemble"]
    assert summary["dataset"][0]["total_samples"] == 399
    assert {r["criterion"] for r in summary["best_models"]} == {"by_accuracy", "by_f1_score"}
    for part in ("reports", "reports_json", "confusion_matrices", "predictions", "predictions_csv"):
        assert (tmp_path / "out" / part / "file=baseline_a").is_dir()
    for part in ("model_comparison", "validation", "error_rates", "error_samples", "models"):
        assert (tmp_path / "out" / part).is_dir()


def test_reported_metrics_follow_from_the_predictions(corpus):
    models, staged = plan.train_all(corpus, [SPECS["lr"]])
    scored = plan.predict_split(models, staged, "doc_id", "test")
    [row] = metrics.model_comparison(metrics.confusion_cells(scored)).collect()
    pairs = [(r["label"], r["prediction"]) for r in scored.collect()]
    assert row["accuracy"] == round(sum(a == b for a, b in pairs) / len(pairs), 4)


def test_linear_head(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1000.0])], "i int, v array<float>")
    got = scoring.predict_linear(df, "v", [[1, 0], [0, 1], [1, 0]], [0, 0, 0]).orderBy("i").collect()
    assert [r["prediction"] for r in got] == [0, 1]
    e = math.e
    assert got[0]["probabilities"] == pytest.approx([e / (2 * e + 1), 1 / (2 * e + 1), e / (2 * e + 1)])
    assert got[1]["probabilities"] == pytest.approx([0, 1, 0])


def test_batch_model(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "i int, v array<double>")

    def make():
        head = np.array([[1.0, 0.0], [0.0, 5.0]])
        return lambda batch: batch @ head.T

    got = scoring.predict_batches(df, "v", 2, make).orderBy("i").collect()
    assert [r["prediction"] for r in got] == [int(i <= 5) if i != 5 else 0 for i in range(40)]


def test_a_forest_has_no_more_tasks_than_cores(spark, monkeypatch):
    """Each task sends on the histograms of all nodes, so its number must not follow the rows."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(plan, "SOLVER_BLOCK", 1)
    many = spark.range(4000).select(F.col("id").alias("label_id")).repartition(64)
    cores = spark.sparkContext.defaultParallelism
    forest, other = plan.random_forest(2, 2)(10), plan.linear_svm()(10)
    assert plan.fit_rows(many, forest).rdd.getNumPartitions() <= max(cores, plan.LEAST_TASKS)
    assert plan.fit_rows(many, other).rdd.getNumPartitions() == 64
    assert plan.fit_rows(many, forest).count() == 4000
