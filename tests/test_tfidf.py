import math
from collections import Counter

import pytest
from comparing import rows
from pyspark.sql import functions as F

from candor.functions.text import clean_text, tokenize
from candor.operators import sequences, tfidf

TEXTS = {
    1: "the cat sat on the mat the cat",
    2: "the dog sat on the log",
    3: "dogs and cats and dogs",
    4: "",
    5: "zebra",
}
SPEC = tfidf.TextFeatures(10, (1, 2), min_df=2, max_df=0.6, stop_words=("on",), sublinear_tf=True)


def token_table(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    return df.select("doc_id", tokenize(clean_text("text")).alias("tokens"))


def python_terms(text, spec):
    words = [w for w in text.split() if len(w) > 1 and w not in spec.stop_words]
    grams = list(words)
    if spec.ngram_range[1] == 2:
        grams += [f"{a} {b}" for a, b in zip(words, words[1:])]
    return grams


def python_fit(texts, spec):
    tf, df = Counter(), Counter()
    for text in texts.values():
        terms = python_terms(text, spec)
        tf.update(terms)
        df.update(set(terms))
    fits = [t for t in tf if spec.min_df <= df[t] <= spec.max_df * len(texts)]
    kept = sorted(fits, key=lambda t: (-tf[t], t))[: spec.max_features]
    return {t: (tf[t], df[t], math.log((1 + len(texts)) / (1 + df[t])) + 1) for t in kept}


def python_weights(text, fitted, spec):
    counts = Counter(t for t in python_terms(text, spec) if t in fitted)
    raw = {
        t: (1 + math.log(n) if spec.sublinear_tf else n) * fitted[t][2] for t, n in counts.items()
    }
    norm = math.sqrt(sum(w * w for w in raw.values()))
    return {t: w / norm for t, w in raw.items()}


@pytest.mark.parametrize(
    "spec",
    [
        SPEC,
        tfidf.TextFeatures(4),
        tfidf.TextFeatures(100, (1, 2)),
        tfidf.TextFeatures(100, sublinear_tf=True),
    ],
)
def test_fit_and_weights_equal_a_plain_computation(spark, spec):
    docs = token_table(spark, TEXTS)
    table = tfidf.fit_vocabulary(docs, "tokens", spec)
    fitted = python_fit(TEXTS, spec)
    got = {r["term"]: (r["tf"], r["df"], r["idf"]) for r in table.collect()}
    assert set(got) == set(fitted)
    for term, values in fitted.items():
        assert got[term] == pytest.approx(values)
    ids = {r["term"]: r["term_id"] for r in table.collect()}
    assert [ids[t] for t in sorted(ids)] == list(range(len(ids)))

    vocabulary = tfidf.Vocabulary.from_table(table)
    weights: dict = {}
    for r in tfidf.tfidf_long(docs, vocabulary, "tokens", spec, "doc_id").collect():
        weights.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    for key, text in TEXTS.items():
        assert weights.get(key, {}) == pytest.approx(python_weights(text, fitted, spec))


def test_vectors_have_norm_one_or_zero_and_keep_all_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens = docs.select("doc_id", tokenize(clean_text("text")).alias("tokens"))
    spec = tfidf.TextFeatures(500, sublinear_tf=True)
    vocabulary = tfidf.Vocabulary.from_table(tfidf.fit_vocabulary(tokens, "tokens", spec))
    vectors = tfidf.tfidf_vectors(tokens, vocabulary, "tokens", spec)
    parts = F.unwrap_udt("features")["values"]
    norm = F.aggregate(parts, F.lit(0.0), lambda a, v: a + v * v)
    sizes = vectors.select(F.round(norm, 9).alias("n")).groupBy("n").count().collect()
    assert {r["n"] for r in sizes} <= {0.0, 1.0}
    assert sum(r["count"] for r in sizes) == docs.count()


def test_unknown_terms_drop_out_and_empty_rows_stay(spark):
    spec = tfidf.TextFeatures(100)
    train = token_table(spark, TEXTS)
    vocabulary = tfidf.Vocabulary.from_table(tfidf.fit_vocabulary(train, "tokens", spec))
    unseen = token_table(spark, {7: "unknown words only", 8: "cat unknown"})
    vectors = tfidf.tfidf_vectors(unseen, vocabulary, "tokens", spec)
    got = {r["doc_id"]: r["features"] for r in vectors.collect()}
    assert got[7].numNonzeros() == 0
    assert got[8].values.tolist() == [1.0]


def test_ties_at_the_cut_are_broken_by_term(spark):
    docs = token_table(spark, {1: "dd cc bb aa", 2: "dd cc bb aa ee ee ee"})
    table = tfidf.fit_vocabulary(docs, "tokens", tfidf.TextFeatures(3))
    assert [r["term"] for r in table.orderBy("term_id").collect()] == ["aa", "bb", "ee"]


def test_empty_vocabulary_is_an_error(spark):
    docs = token_table(spark, TEXTS)
    with pytest.raises(ValueError):
        tfidf.tfidf_vectors(docs, tfidf.Vocabulary((), ()), "tokens", SPEC)


def test_sequences(spark):
    texts = spark.createDataFrame([(1, "bb aa bb cc"), (2, ""), (3, "new bb")], "i int, t string")
    df = texts.select("i", tokenize("t").alias("t"))
    ids = sequences.fit_token_ids(df.where("i = 1"), "t", 2)
    assert rows(ids) == [("aa", 3), ("bb", 2)]
    got = sequences.encode_sequences(df, ids, "t", "i", 3)
    assert [(r["i"], r["input_ids"], r["attention_mask"]) for r in got.orderBy("i").collect()] == [
        (1, [2, 3, 2], [1, 1, 1]),
        (2, [0, 0, 0], [0, 0, 0]),
        (3, [1, 2, 0], [1, 1, 0]),
    ]


def test_the_plan_of_sequences_does_not_grow_with_the_vocabulary(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tokenize("text").alias("t"))
    sizes = []
    for n in (10, 5000):
        ids = sequences.fit_token_ids(docs, "t", n)
        encoded = sequences.encode_sequences(docs, ids, "t", "doc_id", 16)
        sizes.append(len(encoded._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(sizes[0] - sizes[1]) < 200


def test_sequences_with_and_without_a_broadcast(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tokenize("text").alias("t"))
    ids = sequences.fit_token_ids(docs, "t", 500)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before, found = spark.conf.get(name), []
    try:
        for limit in (before, "-1"):
            spark.conf.set(name, limit)
            encoded = sequences.encode_sequences(docs, ids, "t", "doc_id", 64)
            assert ("BroadcastHashJoin" in encoded._jdf.queryExecution().toString()) == (limit == before)
            found.append(rows(encoded))
    finally:
        spark.conf.set(name, before)
    assert found[0] == found[1]


def test_counting_runs_in_compiled_code(spark):
    """Lambdas are interpreted term by term; the count needs none beyond those that make n-grams."""
    docs = token_table(spark, {**TEXTS, 6: "cat cat dog"})
    counted = tfidf.corpus_term_counts(docs, "tokens")
    assert "lambda" not in counted._jdf.queryExecution().optimizedPlan().toString()
    got = {r["term"]: (r["tf"], r["df"]) for r in counted.collect()}
    assert got["cat"] == (4, 2) and got["dogs"] == (2, 1) and got["the"] == (5, 2)
