"""N-grams counted as numbers, against plain Python."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from candor.operators import grams, tfidf

DOCS = [["aa", "bb", "aa", "bb", "the", "cc"], None, [], ["bb"], ["cc", "the", "aa", "bb", "é"], ["aa"] * 4, ["bb", "cc"]]


def plain(docs, low, high, stop):
    tf, df = Counter(), Counter()
    for doc in docs:
        words = [w for w in doc or [] if w not in stop]
        found = [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]
        tf.update(found)
        df.update(set(found))
    return {t: (tf[t], df[t]) for t in tf}


def batch():
    return pa.RecordBatch.from_arrays([pa.array(DOCS, pa.list_(pa.string()))], ["tokens"])


@pytest.mark.parametrize("stop", [(), ("the", "unknown")])
@pytest.mark.parametrize("n", [1, 2, 3, 4, 9])
@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_grams_of_chunks_add_up(monkeypatch, stop, n, chunk):
    monkeypatch.setattr(grams, "CHUNK_WORDS", chunk)
    tf, df = Counter(), Counter()
    for words in grams.chunks(iter([batch().slice(1), batch().slice(0, 1)]), stop):
        for r in words.counted(n, words.starts(n)).to_pylist():
            tf[r["term"]] += r["tf"]
            df[r["term"]] += r["df"]
    assert {t: (tf[t], df[t]) for t in tf} == plain(DOCS, n, n, stop)


def test_a_term_has_the_same_bucket_in_every_batch():
    def placed(tokens):
        words = grams.Words.of(tokens)
        return {
            words.counted(2, words.starts(2)[[i]])["term"][0].as_py(): b
            for i, b in enumerate(words.buckets(2, words.starts(2), 1 << 18))
        }

    whole, part = placed(batch().column(0)), placed(batch().column(0).slice(4))
    assert set(part) < set(whole) and all(whole[t] == b for t, b in part.items())


def test_no_lambda_makes_the_grams_of_a_fit(spark, monkeypatch):
    """Interpreted lambdas took most of a fit with bigrams; it needs none, and no array of n-grams."""
    docs = spark.createDataFrame([(d,) for d in DOCS], "tokens array<string>")
    spec, plans = tfidf.TextFeatures(4, (1, 3), 2, 0.9, ("the",)), []
    choose = tfidf.chosen_terms
    monkeypatch.setattr(
        tfidf, "chosen_terms",
        lambda counts, *rest: plans.append(counts._jdf.queryExecution().optimizedPlan().toString()) or choose(counts, *rest),
    )
    fitted = tfidf.fit_terms(docs, "tokens", spec)
    assert plans and not any("lambda" in p for p in plans)
    want = {t: v for t, v in plain(DOCS, 1, 3, ("the",)).items() if 2 <= v[1] <= 0.9 * len(DOCS)}
    best = sorted(want, key=lambda t: (-want[t][0], t))[:4]
    assert {r["term"]: (r["tf"], r["df"]) for r in fitted.to_pylist()} == {t: want[t] for t in best}
    full = choose(tfidf.corpus_term_counts(docs, spec.terms(F.col("tokens"))), len(DOCS), spec)
    assert fitted.equals(full)
