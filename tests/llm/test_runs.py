"""Periodic runs against a search over all periods and places."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import WORD, documents, odd_rows, read
from pyspark.sql import functions as F

from candor.llm import periodic_runs as pr
from candor.llm.queries import QUERIES


def brute_runs(words, min_length=12):
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, 2 * q):
                best.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, l, q) for (s, l), q in best.items()), key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_op12_equals_brute_force_on_whole_tables(spark, small_dir):
    got = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, small_dir).collect()}
    docs, total = read(small_dir, "documents"), 0
    assert len(got) == len(docs)
    for d in docs:
        words, h = WORD.findall(d["text"] or ""), zlib.crc32(str(d["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        total += len(runs)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        r = got[d["doc_id"]]
        assert r["n_runs"] == len(runs) and (r["start"], r["length"], r["period"]) == top
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if runs else None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(brute_collapse(words, runs).encode()).hexdigest()
    assert total > 10


def some_words(rng):
    letters = rng.choice([1, 2, 3, 6])
    words = [rng.randrange(letters) for _ in range(rng.choice([0, 1, 5, 13, 40, 120]))]
    if words and rng.random() < 0.6:
        a = rng.randrange(len(words))
        p = rng.randint(1, max(1, (len(words) - a) // 2))
        words = [words[i if i < a else a + (i - a) % p] for i in range(len(words))]
    return words


@pytest.mark.parametrize("min_length", [3, 6, 12])
def test_runs_of_groups_of_texts(min_length, monkeypatch):
    rng = random.Random(min_length)
    for _ in range(120):
        monkeypatch.setattr(pr, "STEP_PAIRS", rng.choice([1, 50, 1_000_000]))
        texts = [some_words(rng) for _ in range(rng.randint(1, 12))]
        found = pr.runs_of([np.array(t, np.int64) for t in texts], min_length)
        assert [list(map(tuple, f.tolist())) for f in found] == [brute_runs(t, min_length) for t in texts]


def test_extensions_equal_a_scan():
    rng = random.Random(8)
    for _ in range(40):
        words = [0, *[x + 2 for x in some_words(rng)], 1]
        grammar, n = pr.Grammar(np.array(words), 2), len(words)
        pairs = [(i, j) for i in range(1, n) for j in range(i + 1, n)]
        if not pairs:
            continue
        p, q = map(np.array, zip(*pairs))

        def ahead(i, j):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            return k

        def behind(i, j):
            k = 0
            while i - k > 0 and words[i - k - 1] == words[j - k - 1]:
                k += 1
            return k

        assert grammar.extend(p, q).tolist() == [ahead(i, j) for i, j in pairs]
        assert grammar.extend(p, q, back=True).tolist() == [behind(i, j) for i, j in pairs]


def test_levels_shrink_and_extensions_take_few_steps():
    """A long word sequence twice: whole symbols are passed, not words."""
    rng = np.random.default_rng(2)
    half = rng.integers(0, 50, 20_000)
    codes = np.r_[0, half + 2, half + 2, 1]
    grammar = pr.Grammar(codes, 2)
    assert len(grammar.symbol) < 8 * len(codes)
    assert grammar.extend(np.array([1, 500]), np.array([20_001, 20_500])).tolist() == [20_000, 19_501]
    assert grammar.top.max() < 100


def test_long_texts_that_repeat():
    texts = [b"a " * 100_000, b" ".join(b"%d" % (i % 7) for i in range(100_000)), b"x", b""]
    got = list(pr.collapse(texts, 12))
    assert [runs.tolist() for runs, _ in got] == [[[0, 100_000, 1]], [[0, 100_000, 7]], [], []]
    assert [left for _, left in got] == [b"a", b"0 1 2 3 4 5 6", b"x", b""]


def test_runs_of_odd_rows(spark):
    docs = documents(spark, odd_rows()).withColumnRenamed("n_chars", "runs")
    found = docs.select("text", "runs", pr.periodic_runs(F.col("text")).alias("found"))
    rows = found.collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        words = WORD.findall(r["text"] or "")
        runs = brute_runs(words) if len(words) < 1000 else []
        assert [tuple(x) for x in r["found"]["runs"]] == runs
        assert r["found"]["collapsed"] == brute_collapse(words, runs)
    assert docs.limit(0).select(pr.periodic_runs(F.col("text"))).count() == 0


def test_lines_and_greatest_of_equal_runs(spark):
    rows = [([(5, 14, 7), (5, 14, 2), (1, 13, 3), (9, 14, 1)],), ([],)]
    df = spark.createDataFrame(rows, "runs array<struct<start:bigint,length:bigint,period:bigint>>")
    got = df.select(pr.run_lines(F.col("runs")).alias("s"), pr.greatest_run(F.col("runs")).alias("top")).collect()
    assert got[0]["s"] == "5,14,7\n5,14,2\n1,13,3\n9,14,1\n" and tuple(got[0]["top"]) == (5, 14, 2)
    assert got[1]["s"] == "" and got[1]["top"] is None
