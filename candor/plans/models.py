"""Text classifiers: specifications, distributed training, scoring, tuning.

Text is cleaned and tokenized once and staged.  Each distinct feature
specification is fitted and staged once, and training, validation and test all
read the staged vectors.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.functions.arrays import let
from candor.functions.stopwords import ENGLISH
from candor.functions.text import clean_tokens
from candor.operators.augment import SYNONYMS, oversample
from candor.operators.labels import (
    balanced,
    class_table,
    class_weights,
    encode_labels,
    valid_labels,
)
from candor.operators.linear import (
    LOGISTIC,
    MULTINOMIAL,
    SQUARED_HINGE,
    LinearModel,
    NewtonClassifier,
    PackedRows,
)
from candor.operators.metrics import confusion_cells, model_comparison
from candor.operators.splits import assign_folds, nested_split, stratified_split
from candor.operators.tfidf import (
    TextFeatures,
    Vocabulary,
    chosen_terms,
    corpus_term_counts,
    tfidf_vectors,
)
from candor.sources.staging import stage

# Stop when the loss or the gradient changes by less than this share.
TOLERANCE = 1e-4

# Given the number of training rows, build an unfitted classifier.  Balanced
# weights sum to that number, so the penalty 1 / (c * rows) of MLlib equals inverse
# strength c on the unscaled loss.
ClassifierRule = Callable[[int], Estimator | NewtonClassifier]
COLUMNS = {"featuresCol": "features", "labelCol": "label_id", "weightCol": "weight"}


def logistic(c: float = 1.0, max_iter: int = 1000, tol: float = TOLERANCE) -> ClassifierRule:
    def make(rows: int) -> Estimator:
        return LogisticRegression(
            family="multinomial", regParam=1.0 / (c * rows), maxIter=max_iter, tol=tol,
            standardization=False, **COLUMNS,
        )

    return make


def logistic_one_vs_rest(
    c: float = 1.0, max_iter: int = 100, tol: float = TOLERANCE
) -> ClassifierRule:
    """A logistic regression per class against the rest, the intercept penalised like a feature."""
    return lambda rows: NewtonClassifier(LOGISTIC, c, tol, max_iter)


def linear_svm(c: float = 1.0, max_iter: int = 100, tol: float = TOLERANCE) -> ClassifierRule:
    """A squared-hinge SVM per class against the rest, the intercept penalised like a feature."""
    return lambda rows: NewtonClassifier(SQUARED_HINGE, c, tol, max_iter)


def softmax_newton(c: float = 1.0, max_iter: int = 100, tol: float = TOLERANCE) -> ClassifierRule:
    """The objective of ``logistic``, by Newton's method, which can start from a weaker penalty's model."""
    return lambda rows: NewtonClassifier(MULTINOMIAL, c, tol, max_iter)


# Every task of a forest's fit holds so many MB of histograms at a time; it takes more rounds with fewer.
FOREST_MB = 256


def random_forest(trees: int = 100, depth: int = 15, seed: int = 42) -> ClassifierRule:
    def make(rows: int) -> Estimator:
        return RandomForestClassifier(
            numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=FOREST_MB, **COLUMNS
        )

    return make


@dataclass(frozen=True)
class ModelSpec:
    name: str
    features: TextFeatures
    classifier: ClassifierRule


def baseline_a(max_features: int = 5000) -> ModelSpec:
    """Unigram TF-IDF with balanced logistic regression."""
    return ModelSpec("Baseline_A", TextFeatures(max_features), logistic())


def baseline_c(max_features: int = 5000) -> ModelSpec:
    """Unigram and bigram TF-IDF with a balanced linear SVM."""
    return ModelSpec("Baseline_C", TextFeatures(max_features, (1, 2)), linear_svm())


ENHANCED = {
    "ngram_range": (1, 2), "min_df": 2, "max_df": 0.95, "stop_words": ENGLISH, "sublinear_tf": True,
}


def proposed(max_features: int = 5000) -> ModelSpec:
    """Stop words, pruned sublinear TF-IDF, one logistic regression per class."""
    features = TextFeatures(max_features, **ENHANCED)
    return ModelSpec("Proposed", features, logistic_one_vs_rest(1.0, 2000))


def proposed_multinomial(max_features: int = 4000) -> ModelSpec:
    """The same features with a stronger penalty and one multinomial regression."""
    features = TextFeatures(max_features, **ENHANCED)
    return ModelSpec("Proposed_Multinomial", features, logistic(0.5, 2000))


def forest(max_features: int = 2000) -> ModelSpec:
    features = TextFeatures(max_features, (1, 2))
    return ModelSpec("RandomForest", features, random_forest())


def three_models() -> list[ModelSpec]:
    return [baseline_a(), baseline_c(), proposed()]


def four_models() -> list[ModelSpec]:
    return [baseline_a(3000), baseline_c(3000), proposed_multinomial(), forest()]


@dataclass(frozen=True)
class Corpus:
    """Staged (key, label, label_id, split, tokens, copy), and what all models share.

    ``classes`` are the labels by id, ``weights`` the class weights of the train rows and
    ``n_train`` their number.  ``copy`` is null but for varied copies of train rows.
    """

    rows: DataFrame
    classes: tuple[str, ...]
    weights: DataFrame
    n_train: int
    key: str

    def split(self, name: str) -> DataFrame:
        return self.rows.where(F.col("split") == name)

    def class_table(self) -> DataFrame:
        pairs = [(c, i) for i, c in enumerate(self.classes)]
        return self.rows.sparkSession.createDataFrame(pairs, "label string, label_id int")


def corpus_of(rows: DataFrame, classes: DataFrame, key: str) -> Corpus:
    """Count the train rows once, for the weights and the penalties of all models."""
    counts = class_weights(rows.where("split = 'train'").select("label"))
    n_train = counts.agg(F.sum("n")).first()[0] or 0
    names = tuple(r["label"] for r in sorted(classes.collect(), key=lambda r: r["label_id"]))
    return Corpus(rows, names, counts.select("label", "weight"), n_train, key)


def prepare_corpus(
    df: DataFrame,
    key: str,
    text: str,
    label: str = "label",
    test: DataFrame | None = None,
    test_size: float = 0.2,
    val_size: float = 0.15,
    seed: int = 42,
    copies: int = 0,
    synonyms: Mapping[str, Sequence[str]] = SYNONYMS,
) -> Corpus:
    """Drop blank labels, split, vary, clean and tokenize, encode labels, and stage.

    Without a test table, test and validation rows are both held out of ``df``;
    with one, only validation rows are.  ``copies`` varied copies of the smallest class
    are added to the train rows, after the split, so none of them is ever tested on.
    """

    def shaped(frame: DataFrame) -> DataFrame:
        return valid_labels(frame, label).select(
            key, F.col(label).alias("label"), F.col(text).alias("text")
        )

    known = shaped(df)
    if test is None:
        rows = nested_split(known, key, "label", test_size, val_size, seed=seed)
    else:
        held_out = stratified_split(known, key, "label", val_size, seed=seed).replace(
            "test", "val", subset="split"
        )
        rows = held_out.unionByName(shaped(test).withColumn("split", F.lit("test")))
    rows = rows.withColumn("copy", F.lit(None).cast("bigint"))
    if copies:
        train = rows.where("split = 'train'").drop("copy")
        varied = oversample(train, key, "text", n_samples=copies, synonyms=synonyms, seed=seed)
        varied = varied.withColumnRenamed("sample_id", "copy").where("copy is not null")
        rows = rows.unionByName(varied)
    classes = class_table(known)
    encoded = encode_labels(rows, classes)
    tokens = encoded.withColumn("tokens", clean_tokens("text")).drop("text")
    return corpus_of(stage(tokens, "corpus", "split", spread=True), classes, key)


@dataclass(frozen=True)
class TextModel:
    """A fitted classifier together with all it needs to score new text."""

    name: str
    features: TextFeatures
    vocabulary: Vocabulary
    classes: tuple[str, ...]
    classifier: Transformer | LinearModel

    def score_vectors(self, df: DataFrame, *keep: str) -> DataFrame:
        """(keep, prediction, probabilities): the class name, and one number per class in order.

        Models without probabilities of their own (one against the rest) get theirs from
        the logistic function of each class's margin, made to add up to one.  For the SVM
        these are scores and no calibrated probabilities.
        """
        names = F.array(*[F.lit(c) for c in self.classes])
        scored = self.classifier.transform(df)
        if isinstance(self.classifier, LinearModel):
            if self.classifier.kind == MULTINOMIAL:
                # From the largest margin down, so that none overflows.
                raised = F.transform("margins", lambda m: F.exp(m - F.array_max("margins")))
            else:
                raised = F.transform("margins", lambda m: 1 / (1 + F.exp(-m)))
            shares = let(
                raised,
                lambda p: let(
                    F.aggregate(p, F.lit(0.0), lambda a, x: a + x),
                    lambda total: F.transform(p, lambda x: x / total),
                ),
            )
        else:
            shares = vector_to_array("probability")
        chosen = F.element_at(names, F.col("prediction").cast("int") + 1)
        return scored.select(*keep, chosen.alias("prediction"), shares.alias("probabilities"))

    def predict_vectors(self, df: DataFrame, key: str) -> DataFrame:
        """(key, label, prediction) as class names, from staged vectors."""
        return self.score_vectors(df, key, "label").drop("probabilities")

    def predict_tokens(self, df: DataFrame, *keep: str, tokens: str = "tokens") -> DataFrame:
        """(keep, prediction, probabilities) for token arrays."""
        vectors = tfidf_vectors(df, self.vocabulary, tokens, self.features)
        return self.score_vectors(vectors, *keep)

    def predict(self, df: DataFrame, key: str, text: str = "text") -> DataFrame:
        """(key, prediction, probabilities) for raw texts, labelled or not; null is empty."""
        tokens = df.select(key, clean_tokens(text).alias("tokens"))
        return self.predict_tokens(tokens, key)

    def save(self, spark: SparkSession, path: str) -> None:
        description = {
            "name": self.name, "features": asdict(self.features), "classes": list(self.classes),
            "linear": isinstance(self.classifier, LinearModel),
        }
        meta = spark.createDataFrame([(json.dumps(description),)], "description string")
        meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/description")
        vocabulary = self.vocabulary.table(spark)
        vocabulary.coalesce(1).write.mode("overwrite").parquet(f"{path}/vocabulary")
        if description["linear"]:
            self.classifier.save(spark, f"{path}/classifier")
        else:
            PipelineModel([self.classifier]).write().overwrite().save(f"{path}/classifier")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextModel:
        meta = spark.read.parquet(f"{path}/description").first()["description"]
        description = json.loads(meta)
        spec = description["features"]
        spec["ngram_range"] = tuple(spec["ngram_range"])
        spec["stop_words"] = tuple(spec["stop_words"])
        if description["linear"]:
            classifier = LinearModel.load(spark, f"{path}/classifier")
        else:
            classifier = PipelineModel.load(f"{path}/classifier").stages[0]
        return cls(
            description["name"],
            TextFeatures(**spec),
            Vocabulary.from_table(spark.read.parquet(f"{path}/vocabulary")),
            tuple(description["classes"]),
            classifier,
        )


@dataclass(frozen=True)
class Features:
    """Staged vectors of all splits for one feature specification."""

    rows: DataFrame
    vocabulary: Vocabulary

    def split(self, name: str) -> DataFrame:
        return self.rows.where(F.col("split") == name)


def stage_features(corpus: Corpus, spec: TextFeatures) -> Features:
    """Fit the vocabulary on the train split and stage the vectors of all splits."""
    vocabulary = Vocabulary.fit(corpus.split("train"), "tokens", spec, corpus.n_train)
    vectors = tfidf_vectors(corpus.rows, vocabulary, "tokens", spec).drop("tokens")
    weighted = vectors.join(corpus.weights, "label", "left")
    return Features(stage(weighted, "features", "split"), vocabulary)


def in_parallel(spark: SparkSession, work: Callable, items: Sequence, threads: int) -> list:
    """Run independent jobs side by side, so that the cluster need not idle between them."""
    with ThreadPool(max(1, min(threads, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), items)


# The solvers work on blocks of this size, and sum up over four tasks in one stage.
SOLVER_BLOCK = 1024 * 1024
LEAST_TASKS = 4


def fit_partitions(train: DataFrame) -> DataFrame:
    """A staged table in at least LEAST_TASKS partitions.

    There are as many as the files have, but no more than a block of the solver fills:
    an iteration is a job over all of them, and tasks with less are mere scheduling.
    """
    size = train._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    wanted = max(LEAST_TASKS, -(-size // SOLVER_BLOCK))
    have = train.rdd.getNumPartitions()
    if have > wanted:
        return train.coalesce(wanted)
    return train.repartition(LEAST_TASKS) if have < LEAST_TASKS else train


def train_rows(features: Features) -> DataFrame:
    """The train vectors as the solvers read them."""
    return fit_partitions(features.split("train"))


def fit_rows(train: DataFrame, estimator: Estimator | NewtonClassifier) -> DataFrame:
    """The train vectors as the estimator reads them.

    Each task of a forest's fit sends on the histograms of all open nodes, however few its rows are,
    so tasks must not grow in number with the rows: there is one a core.
    """
    rows = fit_partitions(train)
    if isinstance(estimator, RandomForestClassifier):
        return rows.coalesce(max(LEAST_TASKS, rows.sparkSession.sparkContext.defaultParallelism))
    return rows


def fit_model(corpus: Corpus, features: Features, spec: ModelSpec) -> TextModel:
    estimator = spec.classifier(corpus.n_train)
    classifier = estimator.fit(fit_rows(features.split("train"), estimator))
    return TextModel(spec.name, spec.features, features.vocabulary, corpus.classes, classifier)


def train_all(
    corpus: Corpus, specs: Sequence[ModelSpec], parallelism: int = 4
) -> tuple[list[TextModel], dict[TextFeatures, Features]]:
    """Fit every model; features are staged once per distinct specification."""
    names = [spec.name for spec in specs]
    if len(set(names)) < len(names):
        raise ValueError(f"two models have one name: {sorted(names)}")
    spark = corpus.rows.sparkSession
    distinct = list(dict.fromkeys(spec.features for spec in specs))
    vectors = in_parallel(spark, lambda f: stage_features(corpus, f), distinct, parallelism)
    staged = dict(zip(distinct, vectors))
    models = in_parallel(
        spark, lambda spec: fit_model(corpus, staged[spec.features], spec), specs, parallelism
    )
    return models, staged


def predict_split(
    models: Sequence[TextModel], staged: dict[TextFeatures, Features], key: str, split: str
) -> DataFrame:
    """Staged long predictions (model_rank, model, key, label, prediction) of one split."""
    frames = [
        model.predict_vectors(staged[model.features].split(split), key).select(
            F.lit(rank).alias("model_rank"), F.lit(model.name).alias("model"),
            key, "label", "prediction",
        )
        for rank, model in enumerate(models)
    ]
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame)
    return stage(union, "predictions")


# A candidate of a cross-validation: how texts become vectors, and how vectors are learned.
Candidate = tuple[TextFeatures, ClassifierRule]


@dataclass(frozen=True)
class Folds:
    """Labelled rows in folds: staged tokens, and what each fold needs to know of the others.

    ``rows`` has (key, label, label_id, fold, tokens); terms are counted once per fold and kind of features.
    """

    rows: DataFrame
    per_class: DataFrame
    counts: dict[TextFeatures, DataFrame]
    classes: tuple[str, ...]
    key: str

    @classmethod
    def of(
        cls, df: DataFrame, key: str, text: str, label: str, features: Sequence[TextFeatures], k: int, seed: int
    ) -> Folds:
        rows = valid_labels(df, label).select(key, F.col(label).alias("label"), F.col(text).alias("text"))
        classes = class_table(rows)
        folds = assign_folds(encode_labels(rows, classes), key, "label", k, seed=seed)
        tokens = folds.withColumn("tokens", clean_tokens("text")).drop("text")
        staged = stage(tokens, "folds", "fold", spread=True)
        counts = {
            spec: stage(corpus_term_counts(staged, spec.terms("tokens"), ["fold"]), "fold-terms")
            for spec in dict.fromkeys(features)
        }
        per_class = stage(staged.groupBy("fold", "label").agg(F.count("*").alias("n")), "fold-classes")
        names = tuple(r["label"] for r in sorted(classes.collect(), key=lambda r: r["label_id"]))
        return cls(staged, per_class, counts, names, key)

    def others(self, fold: int, spec: TextFeatures) -> tuple[DataFrame, Vocabulary, int]:
        """Staged vectors of all rows by the vocabulary of the other folds, with their class weights."""
        terms = self.counts[spec].where(F.col("fold") != fold).groupBy("term").agg(
            F.sum("tf").alias("tf"), F.sum("df").alias("df")
        )
        sizes = self.per_class.where(F.col("fold") != fold).groupBy("label").agg(F.sum("n").alias("n"))
        n_train = sizes.agg(F.sum("n")).first()[0]
        vocabulary = Vocabulary.from_arrow(chosen_terms(terms, n_train, spec))
        weighted = self.rows.join(balanced(sizes).select("label", "weight"), "label", "left")
        vectors = tfidf_vectors(weighted, vocabulary, "tokens", spec).drop("tokens")
        held = vectors.withColumn("held_out", F.col("fold") == fold)
        return stage(held, "fold-vectors", "held_out"), vocabulary, n_train

    def scored(self, fold: int, spec: TextFeatures, rules: Mapping[str, ClassifierRule]) -> DataFrame:
        """(model, fold, key, label, prediction) of the fold's rows, by models of one kind of features.

        Vectors are made once.  Newton classifiers share one packed table, and those of one objective
        are fitted from the strongest penalty on, each from the one before.
        """
        vectors, vocabulary, n_train = self.others(fold, spec)
        train, held_out = vectors.where("not held_out"), vectors.where("held_out")
        unfitted = {name: rule(n_train) for name, rule in rules.items()}
        fitted: dict[str, Transformer | LinearModel] = {}
        paths = [(name, u) for name, u in unfitted.items() if isinstance(u, NewtonClassifier)]
        if paths:
            packed = PackedRows.of(train)
            try:
                last: dict[str, LinearModel] = {}
                for name, u in sorted(paths, key=lambda p: p[1].c):
                    fitted[name] = last[u.kind] = replace(u, start=last.get(u.kind)).fit_rows(packed)
            finally:
                packed.release()
        for name, u in unfitted.items():
            if name not in fitted:
                fitted[name] = u.fit(fit_rows(train, u))
        frames = [
            TextModel(name, spec, vocabulary, self.classes, classifier)
            .score_vectors(held_out, "fold", self.key, "label")
            .select(F.lit(name).alias("model"), "fold", self.key, "label", "prediction")
            for name, classifier in fitted.items()
        ]
        return reduce(DataFrame.unionByName, frames)

    def run(
        self, candidates: Mapping[str, Candidate], names: Sequence[str], folds: Sequence[int], parallelism: int
    ) -> DataFrame:
        """Staged (model_rank, model, fold, key, label, prediction) of some candidates on some folds."""
        work = [
            (fold, spec, {n: candidates[n][1] for n in names if candidates[n][0] == spec})
            for spec in dict.fromkeys(candidates[n][0] for n in names)
            for fold in folds
        ]
        frames = in_parallel(self.rows.sparkSession, lambda w: self.scored(*w), work, parallelism)
        rank = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(candidates) for x in (n, i)]), F.col("model"))
        union = reduce(DataFrame.unionByName, frames)
        return stage(union.select(rank.alias("model_rank"), "*"), "cross-validated")


def cross_validated_predictions(
    df: DataFrame,
    key: str,
    text: str,
    features: TextFeatures,
    candidates: Mapping[str, ClassifierRule],
    label: str = "label",
    k: int = 5,
    parallelism: int = 4,
    seed: int = 42,
) -> DataFrame:
    """Staged (model_rank, model, fold, key, label, prediction): each row scored once per candidate.

    The vocabulary and the class weights of a fold come from the other folds only.  Terms
    are counted once per fold, and a fold's vocabulary is what the others add up to;
    a fold's vectors are written once for all candidates.
    """
    folds = Folds.of(df, key, text, label, [features], k, seed)
    pairs = {name: (features, rule) for name, rule in candidates.items()}
    return folds.run(pairs, list(pairs), range(k), parallelism)


def cross_validate(
    df: DataFrame,
    key: str,
    text: str,
    features: TextFeatures,
    candidates: Mapping[str, ClassifierRule],
    **options,
) -> DataFrame:
    """(candidate, accuracy, f1_score) over k stratified folds."""
    scored = cross_validated_predictions(df, key, text, features, candidates, **options)
    return model_comparison(confusion_cells(scored))


def best_name(scores: DataFrame, metric: str) -> str:
    """The candidate with the best score, on a tie the first."""
    return max(scores.collect(), key=lambda r: (r[metric], -r["model_rank"]))["model"]


def halving_rungs(k: int) -> list[list[int]]:
    """Folds in rungs: one, one, two, four, ... until all k are used."""
    rungs, at, size = [], 0, 1
    while at < k:
        rungs.append(list(range(at, min(k, at + size))))
        at += size
        size = max(1, at)
    return rungs


def halving_search(
    df: DataFrame,
    key: str,
    text: str,
    candidates: Mapping[str, Candidate],
    metric: str = "f1_score",
    label: str = "label",
    k: int = 5,
    keep: float = 0.5,
    parallelism: int = 4,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Successive halving over folds, for a grid of features and classifiers.

    All candidates are scored on the first fold; after every rung of folds the share ``keep`` that is best on all
    rows scored so far goes on, at least one.  Returns the staged predictions with the rung that made
    them, and the comparison of the candidates that were scored on all folds.
    """
    if not 0 < keep <= 1 or not candidates:
        raise ValueError("keep a share of at least one candidate")
    folds = Folds.of(df, key, text, label, [spec for spec, _ in candidates.values()], k, seed)
    alive, done = list(candidates), []
    rungs = halving_rungs(k)
    for rung, own in enumerate(rungs):
        done.append(folds.run(candidates, alive, own, parallelism).withColumn("rung", F.lit(rung)))
        so_far = reduce(DataFrame.unionByName, done).where(F.col("model").isin(alive))
        scores = model_comparison(confusion_cells(so_far.drop("rung")))
        if rung + 1 < len(rungs):
            best = sorted(scores.collect(), key=lambda r: (-r[metric], r["model_rank"]))
            alive = [r["model"] for r in best[: max(1, round(keep * len(alive)))]]
    return reduce(DataFrame.unionByName, done), scores


def fit_best(
    df: DataFrame, key: str, text: str, name: str, candidate: Candidate, label: str = "label"
) -> TextModel:
    """One candidate fitted on all rows."""
    spec, rule = candidate
    known = valid_labels(df, label).select(key, F.col(label).alias("label"), F.col(text).alias("text"))
    classes = class_table(known)
    tokens = encode_labels(known, classes).withColumn("tokens", clean_tokens("text")).drop("text")
    rows = stage(tokens.withColumn("split", F.lit("train")), "tuned", spread=True)
    corpus = corpus_of(rows, classes, key)
    return fit_model(corpus, stage_features(corpus, spec), ModelSpec(name, spec, rule))


def tune(
    df: DataFrame,
    key: str,
    text: str,
    features: TextFeatures,
    candidates: Mapping[str, ClassifierRule],
    metric: str = "f1_score",
    label: str = "label",
    **options,
) -> tuple[DataFrame, TextModel]:
    """The candidates' scores, and the best one fitted on all rows; on a tie the first."""
    scores = cross_validate(df, key, text, features, candidates, label=label, **options)
    best = best_name(scores, metric)
    return scores, fit_best(df, key, text, best, (features, candidates[best]), label)


def tune_grid(
    df: DataFrame,
    key: str,
    text: str,
    candidates: Mapping[str, Candidate],
    metric: str = "f1_score",
    label: str = "label",
    **options,
) -> tuple[DataFrame, TextModel]:
    """The same over features as well, by successive halving."""
    _, scores = halving_search(df, key, text, candidates, metric, label, **options)
    best = best_name(scores, metric)
    return scores, fit_best(df, key, text, best, candidates[best], label)


def score_saved(
    spark: SparkSession, path: str, df: DataFrame, key: str, text: str = "text"
) -> DataFrame:
    """Load a saved model and score raw texts with it."""
    return TextModel.load(spark, path).predict(df, key, text)
