"""The registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.functions import text as txt
from candor.functions.stopwords import ENGLISH
from candor.operators import (
    augment,
    errors,
    metrics,
    profile,
    roles,
    scoring,
    sequences,
    splits,
    tfidf,
    voting,
)
from candor.operators import labels as lab
from candor.operators.lookup import small_table
from candor.operators.term_state import TermState
from candor.plans import models as plan
from candor.sources.staging import fresh_path, stage
from candor.sources.tables import one_json_document, read_csv, write_csv, write_json
from catalog import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters that the SQL texts repeat.
ENHANCED = tfidf.TextFeatures(3000, (1, 2), 2, 0.95, ENGLISH, True)
UNIGRAMS = tfidf.TextFeatures(3000)
SYNONYMS = {
    "the": ["this", "that"],
    "der": ["dieser", "jener"],
    "el": ["este", "aquel", "ese"],
    "la": ["cette", "esta"],
}
PARENTS = {"q0_t0": "q0", "q0_t1": "q0", "q1_t0": "q1", "q1_t1": "q1"}
MARKERS = ("well", "let me", "the", "la")
MAX_LENGTH = 256
N_CLASSES = 10
N_DIMENSIONS = 64
HEAD = [
    [((c * 31 + j * 17) % 23 - 11) / 10 for j in range(N_DIMENSIONS)] for c in range(N_CLASSES)
]
BIAS = [c / 10 for c in range(N_CLASSES)]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_table(metrics.confusion_cells(t.predictions(spark, sf_dir)))


# --- columns and schemas ---------------------------------------------------------------


@query
def standardize_columns(spark, sf_dir):
    raw = t.maybe_labelled(spark, sf_dir).select(
        "doc_id",
        F.col("n_chars").alias("question_order"),
        F.col("lang").alias("president"),
        F.col("text").alias("Interview_Question"),
        F.col("label").alias("evasion_label"),
    )
    return roles.standardize(raw, keys=["doc_id"])


@query
def fewest_distinct_column(spark, sf_dir):
    return roles.fewest_distinct_column(t.table(spark, sf_dir, "documents"))


@query
def select_text_column(spark, sf_dir):
    raw = t.table(spark, sf_dir, "documents").select(
        F.col("lang").alias("question"),
        F.col("source").alias("interview_question"),
        F.col("text").alias("interview_answer"),
        F.col("text").alias("gpt3.5_summary"),
    )
    return roles.text_column_lengths(raw)


@query
def label_encode(spark, sf_dir):
    rows = t.labels(spark, sf_dir)
    return lab.encode_labels(rows, lab.class_table(rows)).select("doc_id", "label", "label_id")


@query
def harmonize_union(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    first = docs.join(t.labels(spark, sf_dir), "doc_id").select(
        F.col("source").alias("question"),
        F.col("text").alias("interview_answer"),
        "label",
        (F.col("lang") == "fr").alias("inaudible"),
    )
    second = t.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("Unnamed: 0"),
        F.col("text").alias("question"),
        F.col("role").alias("Label"),
        F.col("role").alias("Annotator1"),
    )
    third = docs.select(
        F.col("doc_id").alias("annotator_id"),
        F.col("source").alias("gpt3.5_summary"),
        F.col("text").alias("interview_answer"),
        F.col("lang").alias("clarity_label"),
        F.col("n_chars").alias("index"),
    )
    union = roles.harmonize_union([first, second, third])
    return union.withColumnRenamed("gpt3.5_summary", "gpt_summary")


@query
def label_rollup(spark, sf_dir):
    rows = lab.roll_up_labels(t.labels(spark, sf_dir), PARENTS)
    return lab.label_rollup_counts(rows, "label", "parent_label")


@query
def valid_labels(spark, sf_dir):
    return lab.valid_labels(t.maybe_labelled(spark, sf_dir)).select("doc_id", "label")


# --- text ------------------------------------------------------------------------------


@query
def clean_text(spark, sf_dir):
    return t.table(spark, sf_dir, "documents").select(
        "doc_id", txt.clean_text("text").alias("text_clean")
    )


@query
def text_preview(spark, sf_dir):
    return profile.text_previews(t.table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def text_length_stats(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    return profile.text_length_stats(docs.select(txt.clean_text("text").alias("c")), "c")


@query
def tokenize(spark, sf_dir):
    return t.tokens(spark, sf_dir).select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
        F.array_join("tokens", " ").alias("tokens"),
    )


@query
def stopword_filter(spark, sf_dir):
    kept = txt.remove_stop_words("tokens")
    return t.tokens(spark, sf_dir).select("doc_id", F.array_join(kept, " ").alias("tokens"))


@query
def ngrams(spark, sf_dir):
    grams = t.tokens(spark, sf_dir).select("doc_id", txt.ngrams("tokens", 1, 2).alias("g"))
    return grams.select(
        "doc_id", F.size("g").cast("bigint").alias("n_grams"), F.array_join("g", "|").alias("grams")
    )


@query
def synonym_replace(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", txt.synonym_replace("text", "doc_id", SYNONYMS).alias("text_varied")
    )


@query
def encode_sequences(spark, sf_dir):
    docs = t.tokens(spark, sf_dir)
    ids = sequences.fit_token_ids(docs, "tokens", 3000)
    encoded = sequences.encode_sequences(docs, ids, "tokens", "doc_id", MAX_LENGTH)
    return encoded.select(
        "doc_id",
        F.array_join("input_ids", " ").alias("input_ids"),
        F.array_join("attention_mask", "").alias("attention_mask"),
    )


# --- features --------------------------------------------------------------------------


@query
def vocab_fit(spark, sf_dir):
    # Read by two passes or three.
    docs = stage(t.tokens(spark, sf_dir).select("tokens"), "tokens")
    return tfidf.fit_vocabulary(docs, "tokens", ENHANCED).select(
        "term", "term_id", "tf", "df"
    )


@query
def vocab_incremental(spark, sf_dir):
    """The vocabulary of all documents, from the state of half of them and the other half."""
    docs = t.tokens(spark, sf_dir)
    first, second = (docs.where(F.pmod("doc_id", F.lit(2)) == i) for i in (0, 1))
    half = TermState.create(first, "tokens", ENHANCED, fresh_path(spark, "terms"), buckets=8)
    state = half.add(second, "tokens", fresh_path(spark, "terms"))
    chosen = spark.createDataFrame(state.vocabulary()).select("term", "term_id", "tf", "df")
    for one in (half, state):
        one.drop()
    return chosen


@query
def term_counts(spark, sf_dir):
    counted = t.tokens(spark, sf_dir).select("doc_id", txt.term_counts("tokens").alias("c"))
    return counted.select("doc_id", F.inline_outer("c")).where("term is not null")


@query
def idf_table(spark, sf_dir):
    table = tfidf.fit_vocabulary(t.tokens(spark, sf_dir), "tokens", UNIGRAMS)
    return table.select("term", "df", F.round("idf", 6).alias("idf"))


def _long(spark, sf_dir, spec, normalize):
    docs = stage(t.tokens(spark, sf_dir), "tokens")
    vocabulary = tfidf.Vocabulary.fit(docs, "tokens", spec)
    weights = tfidf.tfidf_long(docs, vocabulary, "tokens", spec, "doc_id", normalize)
    return weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query
def tfidf_sublinear(spark, sf_dir):
    return _long(spark, sf_dir, ENHANCED, normalize=False)


@query
def tfidf_l2(spark, sf_dir):
    return _long(spark, sf_dir, UNIGRAMS, normalize=True)


@query
def tfidf_apply(spark, sf_dir):
    split = splits.stratified_split(t.labels(spark, sf_dir), "doc_id", "label")
    docs = t.tokens(spark, sf_dir).join(split.select("doc_id", "split"), "doc_id")
    train, test = (docs.where(F.col("split") == s) for s in ("train", "test"))
    vocabulary = tfidf.Vocabulary.fit(train, "tokens", ENHANCED)
    weights = tfidf.tfidf_long(test, vocabulary, "tokens", ENHANCED, "doc_id")
    return weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))


# --- splits, weights, augmentation -----------------------------------------------------


@query
def stratified_split(spark, sf_dir):
    return splits.stratified_split(t.labels(spark, sf_dir), "doc_id", "label")


@query
def nested_split(spark, sf_dir):
    return splits.nested_split(t.labels(spark, sf_dir), "doc_id", "label")


@query
def kfold_assign(spark, sf_dir):
    return splits.assign_folds(t.labels(spark, sf_dir), "doc_id", "label", 5)


@query
def debug_subset(spark, sf_dir):
    return splits.debug_subset(t.labels(spark, sf_dir), "doc_id", "label", 50)


@query
def class_weights(spark, sf_dir):
    return lab.class_weights(t.maybe_labelled(spark, sf_dir)).select(
        "label", "n", F.round("weight", 6).alias("weight")
    )


@query
def minority_class(spark, sf_dir):
    return lab.minority_class(t.maybe_labelled(spark, sf_dir))


@query
def augment_minority(spark, sf_dir):
    rows = t.maybe_labelled(spark, sf_dir).select("doc_id", "text", "label")
    rows = rows.withColumn("text", txt.clean_text("text"))
    return augment.oversample(rows, "doc_id", "text", n_samples=200, synonyms=SYNONYMS)


# --- class statistics ------------------------------------------------------------------


@query
def class_distribution(spark, sf_dir):
    return lab.class_distribution(t.labels(spark, sf_dir))


@query
def class_counts_dense(spark, sf_dir):
    rows = t.labels(spark, sf_dir)
    split = splits.stratified_split(rows, "doc_id", "label")
    return lab.class_counts_dense(split.where("split = 'test'"), lab.class_table(rows))


@query
def imbalance_ratio(spark, sf_dir):
    return lab.imbalance_ratio(t.labels(spark, sf_dir))


@query
def dataset_summary(spark, sf_dir):
    split = splits.nested_split(t.labels(spark, sf_dir), "doc_id", "label")
    return profile.dataset_summary(split, "label", "split")


@query
def table_profile(spark, sf_dir):
    return profile.table_profile(t.maybe_labelled(spark, sf_dir), "doc_id")


# --- metrics ---------------------------------------------------------------------------


@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_cells(spark, sf_dir))


@query
def confusion_normalized(spark, sf_dir):
    return metrics.confusion_normalized(_cells(spark, sf_dir))


@query
def confusion_wide(spark, sf_dir):
    return metrics.confusion_wide(_cells(spark, sf_dir), sorted(PARENTS))


@query
def model_comparison(spark, sf_dir):
    return metrics.model_comparison(_cells(spark, sf_dir))


@query
def metrics_macro(spark, sf_dir):
    return metrics.metrics_macro(_cells(spark, sf_dir))


@query
def metrics_weighted(spark, sf_dir):
    return metrics.metrics_weighted(_cells(spark, sf_dir))


@query
def classification_report(spark, sf_dir):
    return metrics.classification_report(_cells(spark, sf_dir))


@query
def model_metric_long(spark, sf_dir):
    scores = metrics.metrics_macro(_cells(spark, sf_dir))
    chosen = ["accuracy", "f1_macro", "precision", "recall"]
    return metrics.metrics_long(scores, chosen, models=["m1", "m3"])


@query
def top_classes_by_f1(spark, sf_dir):
    return metrics.top_classes_by_f1(_cells(spark, sf_dir))


@query
def best_model(spark, sf_dir):
    return metrics.best_model(metrics.model_comparison(_cells(spark, sf_dir)))


def _with_vote(spark, sf_dir):
    rows = t.predictions(spark, sf_dir)
    return voting.with_ensemble(rows, "doc_id", len(t.RULE_MODELS))


@query
def key_insights(spark, sf_dir):
    cells = small_table(metrics.confusion_cells(_with_vote(spark, sf_dir)))
    comparison = metrics.model_comparison(cells)
    split = splits.nested_split(t.labels(spark, sf_dir), "doc_id", "label")
    tested = split.where("split = 'test'")
    return metrics.key_insights(comparison, lab.imbalance_ratio(tested))


@query
def majority_vote(spark, sf_dir):
    return voting.majority_vote(t.predictions(spark, sf_dir), "doc_id")


@query
def ensemble_comparison(spark, sf_dir):
    return metrics.model_comparison(metrics.confusion_cells(_with_vote(spark, sf_dir)))


@query
def training_history(spark, sf_dir):
    history = profile.training_history(t.batch_log(spark, sf_dir))
    return history.select(
        "run", "epoch", "phase", F.round("loss", 9).alias("loss"),
        F.round("accuracy", 9).alias("accuracy"),
    )


# --- errors ----------------------------------------------------------------------------


@query
def error_rates(spark, sf_dir):
    return errors.error_rates(_cells(spark, sf_dir))


@query
def error_samples(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    return errors.error_samples(t.predictions(spark, sf_dir), docs, "doc_id")


@query
def prediction_table(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    classes = lab.class_table(t.labels(spark, sf_dir))
    return errors.prediction_table(t.predictions(spark, sf_dir), docs, classes, "doc_id")


@query
def error_by_length(spark, sf_dir):
    lengths = t.table(spark, sf_dir, "documents").select("doc_id", profile.n_words("text").alias("w"))
    return errors.error_by_length(t.predictions(spark, sf_dir), lengths, "doc_id", "w", 100)


# --- exploration -----------------------------------------------------------------------


@query
def token_length_histogram(spark, sf_dir):
    return profile.token_length_histogram(t.tokens(spark, sf_dir), "tokens")


@query
def sequence_length_quantiles(spark, sf_dir):
    return profile.sequence_length_quantiles(t.tokens(spark, sf_dir), "tokens")


@query
def top_unigrams(spark, sf_dir):
    rows = t.labelled(spark, sf_dir).select("label", txt.clean_tokens("text").alias("tokens"))
    return profile.top_unigrams(rows, "tokens", "label")


@query
def length_by_class(spark, sf_dir):
    return profile.length_by_class(t.labelled(spark, sf_dir), "text", "label")


@query
def annotator_disagreement(spark, sf_dir):
    return profile.annotator_disagreement(t.annotations(spark, sf_dir), t.ANNOTATORS)


@query
def flag_rates(spark, sf_dir):
    flags = ["inaudible", "multiple_questions", "affirmative_questions"]
    return profile.flag_rates(t.question_pairs(spark, sf_dir), flags)


@query
def discourse_markers(spark, sf_dir):
    return profile.discourse_markers(t.labelled(spark, sf_dir), "text", "label", MARKERS)


# --- scoring and models ----------------------------------------------------------------


@query
def softmax_argmax(spark, sf_dir):
    vectors = t.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    scored = scoring.predict_linear(vectors, "embedding", HEAD, BIAS)
    rows = scoring.probability_rows(scored, ["vec_id"])
    return rows.withColumn("probability", F.round("probability", 6))


@query
def batch_scoring(spark, sf_dir):
    """The same head as a pluggable batch model."""
    weights, bias = np.array(HEAD), np.array(BIAS)

    # Nested, so that it reaches the workers by value and they need not import this module.
    def make():
        return lambda batch: batch.astype(float) @ weights.T + bias

    vectors = t.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    scored = scoring.predict_batches(vectors, "embedding", N_DIMENSIONS, make, 256)
    return scored.select(
        "vec_id", "prediction", F.round(F.array_max("probabilities"), 6).alias("probability")
    )


def _corpus(spark, sf_dir):
    return plan.prepare_corpus(t.labelled(spark, sf_dir), "doc_id", "text")


def _scored(spark, sf_dir, specs, split="test"):
    corpus = _corpus(spark, sf_dir)
    fitted, staged = plan.train_all(corpus, specs)
    return corpus, plan.predict_split(fitted, staged, "doc_id", split)


def compared(spark, sf_dir, specs, split="test"):
    """The models' comparison rows."""
    _, scored = _scored(spark, sf_dir, specs, split)
    return metrics.model_comparison(metrics.confusion_cells(scored))


def _accounted(corpus, scored):
    """(model_rank, model, label, n, n_known, agrees): what holds for any solver.

    Rows scored, rows with a class of the corpus, and whether the reported accuracy is
    the one recomputed from the rows.
    """
    right = (F.col("label") == F.col("prediction")).cast("double")
    direct = scored.groupBy(*metrics.MODEL).agg(F.round(F.avg(right), 4).alias("direct"))
    reported = metrics.model_comparison(metrics.confusion_cells(scored))
    agrees = reported.join(direct, metrics.MODEL).select(
        *metrics.MODEL, (F.col("accuracy") == F.col("direct")).alias("agrees")
    )
    known = F.count_if(F.col("prediction").isin(*corpus.classes))
    per_label = scored.groupBy(*metrics.MODEL, "label").agg(
        F.count("*").alias("n"), known.alias("n_known")
    )
    return per_label.join(agrees, metrics.MODEL)


@query
def baseline_a(spark, sf_dir):
    return _accounted(*_scored(spark, sf_dir, [plan.baseline_a()]))


@query
def baseline_c(spark, sf_dir):
    return _accounted(*_scored(spark, sf_dir, [plan.baseline_c()]))


@query
def proposed(spark, sf_dir):
    return _accounted(*_scored(spark, sf_dir, [plan.proposed()]))


@query
def random_forest(spark, sf_dir):
    return _accounted(*_scored(spark, sf_dir, [plan.forest()]))


@query
def train_all(spark, sf_dir):
    return _accounted(*_scored(spark, sf_dir, plan.three_models(), split="val"))


@query
def evaluate_all(spark, sf_dir):
    specs = plan.four_models()
    corpus, scored = _scored(spark, sf_dir, specs)
    return _accounted(corpus, stage(voting.with_ensemble(scored, "doc_id", len(specs)), "voted"))


@query
def cross_validate(spark, sf_dir):
    """Rows and distinct documents scored, by candidate and fold."""
    candidates = {f"C={c}": plan.softmax_newton(c) for c in (0.5, 1.0)}
    scored = plan.cross_validated_predictions(
        t.labelled(spark, sf_dir), "doc_id", "text", tfidf.TextFeatures(3000), candidates
    )
    return scored.groupBy(*metrics.MODEL, "fold").agg(
        F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_documents")
    )


GRID = {
    f"{kind} C={c}": (features, rule(c))
    for kind, features, rule in (
        ("svm", tfidf.TextFeatures(1000), plan.linear_svm),
        ("ovr", tfidf.TextFeatures(1000, sublinear_tf=True), plan.logistic_one_vs_rest),
    )
    for c in (0.1, 1.0)
}


@query
def halving_search(spark, sf_dir):
    """Candidates and documents scored in each rung of folds."""
    scored, _ = plan.halving_search(t.labelled(spark, sf_dir), "doc_id", "text", GRID)
    return scored.groupBy("rung").agg(
        F.count_distinct("model").alias("n_candidates"), F.count_distinct("doc_id").alias("n_documents"),
        F.count("*").alias("n"),
    )


def _saved(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    [model], _ = plan.train_all(corpus, [plan.baseline_a(3000)])
    path = fresh_path(spark, "model")
    model.save(spark, path)
    return corpus, model, path


@query
def model_roundtrip(spark, sf_dir):
    """Whether a model that was saved and loaded again predicts the same known class."""
    corpus, model, path = _saved(spark, sf_dir)
    test = corpus.split("test")
    loaded = plan.TextModel.load(spark, path).predict_tokens(test, "doc_id")
    first = model.predict_tokens(test, "doc_id", "label")
    again = loaded.select("doc_id", F.col("prediction").alias("again"))
    return first.join(again, "doc_id").select(
        "doc_id", "label", (F.col("prediction") == F.col("again")).alias("same"),
        F.col("again").isin(*corpus.classes).alias("known"),
    )


@query
def score_documents(spark, sf_dir):
    """All documents, labelled or not, scored from raw text by a saved model."""
    corpus, _, path = _saved(spark, sf_dir)
    scored = plan.score_saved(spark, path, t.table(spark, sf_dir, "documents"), "doc_id")
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p)
    return scored.select(
        "doc_id", F.col("prediction").isin(*corpus.classes).alias("known"),
        F.size("probabilities").alias("n_classes"), F.round(total, 6).alias("total"),
    )


# --- files -----------------------------------------------------------------------------


@query
def csv_roundtrip(spark, sf_dir):
    df = t.maybe_labelled(spark, sf_dir).select("doc_id", "lang", "source", "label")
    path = fresh_path(spark, "csv")
    write_csv(df, path, partition_by=("lang",))
    back = read_csv(spark, path, "doc_id bigint, source string, label string, lang string")
    return back.select("doc_id", "lang", "source", "label")


@query
def json_roundtrip(spark, sf_dir):
    df = t.table(spark, sf_dir, "documents").select("doc_id", "text")
    path = fresh_path(spark, "json")
    write_json(df, path)
    return spark.read.schema("doc_id bigint, text string").json(path)


@query
def json_document(spark, sf_dir):
    """Classes in falling order, through one JSON document and back."""
    rows = t.labels(spark, sf_dir)
    document = one_json_document(
        {
            "sizes": lab.imbalance_ratio(rows),
            "classes": lab.class_distribution(rows).orderBy(F.desc("label")),
        }
    )
    kind = "classes array<struct<label:string,n:bigint,percent:double>>"
    classes = F.from_json("document", kind)["classes"]
    return document.select(F.posexplode(classes).alias("place", "c")).select("place", "c.*")


@query
def file_safe_names(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    title = F.initcap(F.concat_ws(" ", F.lit("model of"), "lang", "source"))
    return docs.select(title.alias("name")).distinct().select(
        "name", txt.file_safe_name("name").alias("file")
    )
