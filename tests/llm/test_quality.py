"""Quality rules and the quality classifier."""

import zlib
from collections import Counter
from math import comb

import numpy as np
import pytest
from helpers import WORD, documents, odd_rows, read

from candor.llm import quality_classifier as qc
from candor.llm import quality_rules as qr
from candor.llm.queries import QUERIES


def brute_stats(text):
    words = WORD.findall(text)
    seen = Counter(tuple(words[j : j + 8]) for j in range(len(words) - 7))
    covered = set()
    for j in range(len(words) - 7):
        if seen[tuple(words[j : j + 8])] > 1:
            covered.update(range(j, j + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(covered),
    )


def test_op10_equals_brute_force_on_whole_tables(spark, sf_dir):
    texts = {d["doc_id"]: d["text"] for d in read(sf_dir, "documents")}
    found = QUERIES["op10_quality_rules"](spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        want = brute_stats(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])
        assert r["kept"] == (not r["base_failed"] and r["failed_rules"] == "")


def test_op10_rules_reject_bad_documents_and_spare_good_ones(spark):
    sf = "/root/testdata/sf0.1"
    quality = {r["doc_id"]: r["quality"] for r in read(sf, "labels")}
    langs = {r["doc_id"]: r["lang"] for r in read(sf, "documents")}
    rows = [r for r in QUERIES["op10_quality_rules"](spark, sf).collect() if r["doc_id"] in quality]
    good = [r for r in rows if quality[r["doc_id"]] and not r["base_failed"]]
    assert np.mean([r["kept"] for r in good]) > 0.95
    bad = [r for r in rows if not quality[r["doc_id"]] and langs[r["doc_id"]] == "en"]
    assert np.mean([not r["kept"] for r in bad]) > 0.9


@pytest.mark.parametrize("k, n, p", [(0, 50, 0.02), (3, 200, 0.05), (10, 40, 0.5), (5, 5, 0.1)])
def test_binomial_cdf(k, n, p):
    want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert qr.binomial_cdf(k, n, p) == pytest.approx(want)


def test_cutoffs_are_certified():
    risk = qr.Risk(rate=0.2, delta=0.05)
    # 1 % of the good documents lie above level 30, all bad ones above 60.
    best = qr.certified_cutoff({0: 990, 40: 10}, {70: 50}, risk, 0.01)
    assert best == 69
    # Too few good documents to certify anything, and no bad ones to reject.
    assert qr.certified_cutoff({0: 5}, {70: 50}, risk, 0.01) is None
    assert qr.certified_cutoff({0: 990, 40: 10}, {}, risk, 0.01) is None
    # Good and bad alike: no cutoff gains.
    assert qr.certified_cutoff({0: 500, 50: 500}, {0: 50, 50: 50}, risk, 0.01) is None


def test_certified_risk_holds_in_simulation():
    """Draws with a true rate just above the bound are certified at most delta of the time."""
    rng = np.random.default_rng(5)
    risk = qr.Risk(rate=0.08, delta=0.05)
    wrong = 0
    for _ in range(400):
        above = rng.binomial(1000, 0.021)
        cutoff = qr.certified_cutoff({0: 1000 - above, 50: above}, {60: 100}, risk, 0.05)
        wrong += cutoff is not None and cutoff < 50
    assert wrong <= 0.08 * 400


def test_rules_on_odd_rows(spark):
    docs = documents(spark, odd_rows()).withColumnRenamed("n_chars", "stats")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None)], "doc_id bigint, quality int")
    rows = qr.apply_rules(docs, labels).collect()
    assert len(rows) == len(odd_rows())
    blank = [r for r in rows if r["text"] is None or not r["text"].strip()]
    assert len(blank) == 4 and not any(r["kept"] for r in blank)
    assert [r["kept"] for r in rows if r["doc_id"] == 4] == [True]
    assert qr.apply_rules(docs.limit(0), labels).count() == 0
    assert qr.apply_rules(docs, labels.limit(0)).where("kept").count() == 1
    empty_lang = docs.selectExpr("doc_id", "text", "cast(null as string) AS lang")
    assert qr.apply_rules(empty_lang, labels).count() == len(odd_rows())


def test_op1_separates_labels_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.1"
    quality = {r["doc_id"]: r["quality"] for r in read(sf, "labels")}
    rows = QUERIES["op1_quality"](spark, sf).collect()
    assert len(rows) == len(read(sf, "documents"))
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in quality]
    good = np.array([r["score"] for r in held if quality[r["doc_id"]]])
    bad = np.array([r["score"] for r in held if not quality[r["doc_id"]]])
    assert (good[:, None] > bad[None, :]).mean() > 0.98
    assert np.mean([r["predicted"] == quality[r["doc_id"]] for r in held]) > 0.97


def test_moments_and_model_equal_numpy(spark):
    rng = np.random.default_rng(3)
    p = len(qc.FEATURES)
    x = rng.normal(size=(300, p)) * (1 + np.arange(p))
    y = (rng.random(300) < 0.4).astype(int)
    x[y == 1] += 1.5
    rows = spark.createDataFrame(
        [(int(i % 4), int(l), [float(v) for v in r]) for i, (r, l) in enumerate(zip(x, y))],
        "fold bigint, label bigint, features array<double>",
    )
    moments = qc.fold_moments(rows)
    for label in (0, 1):
        total = sum((m for (_, l), m in moments.items() if l == label), qc.nothing())
        assert total.n == (y == label).sum()
        assert np.allclose(total.scatter() / (total.n - 1), np.cov(x[y == label].T))
    model = qc.fit_moments(*[sum((m for (_, l), m in moments.items() if l == c), qc.nothing()) for c in (0, 1)], 0.0, 1e-9, 1.0)
    pooled = sum((np.cov(x[y == c].T) * ((y == c).sum() - 1) for c in (0, 1))) / 298
    scale = np.sqrt(np.diag(pooled))
    odds = []
    for c in (0, 1):
        own = x[y == c] / scale
        n = len(own)
        cov = (n * np.cov(own.T) + pooled / np.outer(scale, scale)) / (n + 1)
        z = x / scale - own.mean(axis=0)
        maha = np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z)
        odds.append(np.log((n + 1) / 302) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * maha)
    assert np.allclose(model.log_odds(x), odds[1] - odds[0], rtol=1e-4, atol=1e-4)


def test_classifier_on_odd_rows(spark):
    docs = documents(spark, odd_rows())
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (4, None)], "doc_id bigint, quality int")
    from pyspark.sql import functions as F

    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        rows = qc.score_quality(docs, known, F.lit(1), 0).collect()
        assert len(rows) == len(odd_rows())
        assert all(0 <= r["score"] <= 1 for r in rows)
    assert qc.score_quality(docs.limit(0), labels, F.lit(1), 0).count() == 0
