import hashlib
import re
from functools import reduce

import pytest
from comparing import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from candor.functions import text as txt
from candor.functions.stopwords import ENGLISH

CHAIN = {"evade": ["avoid", "dodge"], "avoid": ["evade", "elude"], "good": ["fine", "great"]}


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(column).collect()]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Hello,  WORLD! (yes) it's\t50% - ok?", "hello, world! yes its 50 - ok?"),
        ("Élan über naïve", "élan über naïve"),
        ("", ""),
        (None, ""),
        (" \n ", ""),
        ("a_b [c] {d} #e", "a_b c d e"),
    ],
)
def test_clean_text(spark, raw, want):
    assert one(spark, txt.clean_text("t"), raw) == [want]


def python_clean(text):
    kept = "".join(
        c for c in text.lower() if re.match(r"\w", c) or c.isspace() or c in ".,!?-"
    )
    return " ".join(kept.split())


def test_clean_text_agrees_with_python_on_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for r in docs.select("text", txt.clean_text("text").alias("c")).collect():
        assert r["c"] == python_clean(r["text"])


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=60), min_size=1, max_size=20))
def test_clean_text_is_idempotent(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    once = df.select(txt.clean_text("t").alias("t"))
    assert rows(once) == rows(once.select(txt.clean_text("t")))


def test_clean_tokens_are_the_tokens_of_the_cleaned_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([("it's\u00a0a-b\u2003c\x1cd e%f\u0301g",), (None,)], "text string")
    for df in (docs, odd):
        differ = ~txt.clean_tokens("text").eqNullSafe(txt.tokenize(txt.clean_text("text")))
        assert df.where(differ).count() == 0


def test_tokens_and_stop_words(spark):
    tokens = txt.tokenize("t")
    assert one(spark, tokens, "I can't eat 2 über-cakes, a_b!", "", None) == [
        ["can", "eat", "über", "cakes", "a_b"], [], [],
    ]
    kept = txt.remove_stop_words(tokens)
    assert one(spark, kept, "the cat and THE hat") == [["cat", "hat"]]


def test_stop_words_are_the_default_list_without_contractions(spark):
    default = StopWordsRemover.loadDefaultStopWords("english")
    assert sorted(ENGLISH) == sorted(w for w in default if "'" not in w)


def test_ngrams(spark):
    grams = txt.ngrams(F.split("t", " "), 1, 2)
    assert one(spark, grams, "a b c", "a") == [["a", "b", "c", "a b", "b c"], ["a"]]
    three = txt.ngrams(F.split("t", " "), 2, 3)
    assert one(spark, three, "a b c d", "a") == [["a b", "b c", "c d", "a b c", "b c d"], []]


def test_term_counts(spark):
    counts = txt.term_counts(txt.tokenize("t"))
    got = one(spark, counts, "bb aa bb cc bb aa", "", "zz")
    assert [[tuple(x) for x in g] for g in got] == [
        [("aa", 2), ("bb", 3), ("cc", 1)], [], [("zz", 1)],
    ]


def test_split_words_and_names(spark):
    assert one(spark, txt.split_words("t"), " a b \n c ", "") == [["a", "b", "c"], []]
    assert one(spark, txt.file_safe_name("t"), "Random Forest X") == ["random_forest_x"]
    assert one(spark, txt.preview("t", 3), "abcdef", None) == ["abc", ""]


@pytest.mark.parametrize(
    ("text", "held"),
    [("well, let me see", True), ("farewell", False), ("wells", False), ("oh well", True)],
)
def test_holds_phrase(spark, text, held):
    assert one(spark, txt.holds_phrase("t", "well"), text) == [held]


def drawn(seed, kind, key, d):
    return int(hashlib.md5(f"{seed}:{kind}:{key}:{d}".encode()).hexdigest()[:15], 16)


def replaced(text, key, synonyms, share, seed):
    """Each word by itself: the draws that fall on its place, in order, folded over it."""
    words = text.split()
    n = len(words)
    if n < 3:
        return text
    falls = {}
    for d in range(max(1, int(n * share))):
        falls.setdefault(drawn(seed, "position", key, d) % n, []).append(d)

    def step(word, d):
        options = synonyms.get(word.lower().strip(".,!?;:"), [word])
        return options[drawn(seed, "choice", key, d) % len(options)]

    return " ".join(reduce(step, falls.get(i, []), word) for i, word in enumerate(words))


def test_synonyms_in_literal_cases(spark):
    """One word to choose from, and so many draws that every place is hit."""
    swap = {"good": ["fine"], "bad": ["poor"]}
    change = txt.synonym_replace("t", F.lit(1), swap, 40.0)
    texts = ["Good, bad not goodness", "two words", "", "good good bad!"]
    assert one(spark, change, *texts) == ["fine poor not goodness", "two words", "", "fine fine poor"]
    chain = {"a": ["b"], "b": ["c"], "c": ["c"]}
    assert one(spark, txt.synonym_replace("t", F.lit(1), chain, 40.0), "a b x") == ["c c x"]


@pytest.mark.parametrize("share", [0.2, 1.0, 3.0])
def test_synonym_replace_is_a_sequence_of_draws(spark, share):
    texts = [
        "Evade, avoid evade good! bad avoid",
        "good good  good good\ngood evade? avoid. Evade avoid",
        "too short",
        "",
        "nothing to replace in here at all",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = df.select(
        "id", txt.synonym_replace("t", "id", CHAIN, share, seed=7).alias("v")
    ).orderBy("id")
    want = [replaced(t, i, CHAIN, share, 7) for i, t in enumerate(texts)]
    assert [r["v"] for r in got.collect()] == want
    assert want != texts


def test_synonym_replace_on_a_long_text_is_not_quadratic(spark):
    text = "evade good " * 50_000
    df = spark.createDataFrame([(1, text)], "id int, t string")
    [row] = df.select(txt.synonym_replace("t", "id", CHAIN).alias("v")).collect()
    assert row["v"] == replaced(text, 1, CHAIN, 0.2, 42)


def test_row_wise_text_operators_run_on_streams(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.write.parquet(str(tmp_path / "in"))

    def shape(df):
        tokens = txt.tokenize(txt.clean_text("text"))
        return df.select("doc_id", F.size(txt.ngrams(tokens, 1, 2)).alias("n"))

    stream = shape(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")))
    running = (
        stream.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    assert running.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(shape(docs))
