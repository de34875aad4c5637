"""Sharding and mixing."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import WORD, documents, odd_rows, read
from pyspark.sql import functions as F

from candor.llm import mixing, sharding
from candor.llm.queries import QUERIES
from candor.llm.shared import word_count


def test_op3_on_whole_tables(spark, sf_dir):
    texts = {d["doc_id"]: d for d in read(sf_dir, "documents")}
    rows = QUERIES["op3_shards"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    slots = defaultdict(list)
    for r in rows:
        raw = texts[r["doc_id"]]["text"].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(24))
    counts = [len(s) for s in slots.values()]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def brute_order(rows, seed=17):
    """The interleaved order by sorting everything at once."""
    import hashlib

    def draw(key):
        text = f"{seed}:{'' if key is None else key}"
        return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)

    by_source = defaultdict(list)
    for key, source in rows:
        by_source[source].append((draw(key), key))
    placed = []
    for source, own in by_source.items():
        for rank, (d, key) in enumerate(sorted(own)):
            placed.append(((2 * rank + 1) / (2 * len(own)), f"={source}", d, key))
    return [x[3] for x in sorted(placed)]


@pytest.mark.parametrize("per_bucket", [3, 100_000])
def test_shards_equal_one_sort_for_any_bucket_size(spark, per_bucket):
    rows = [(i, f"s{0 if i % 3 else i % 7}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string")
    got = sharding.interleaved_shards(df, 7, rows_per_bucket=per_bucket).collect()
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order == brute_order(rows)
    share = Counter((r["shard"], r["source"]) for r in got)
    sizes = Counter(s for _, s in rows)
    for (_, source), n in share.items():
        assert abs(n - sizes[source] / 7) <= 3


def test_shards_of_odd_rows(spark):
    docs = documents(spark, odd_rows()).withColumnRenamed("n_chars", "shard")
    rows = sharding.interleaved_shards(docs, 4).collect()
    assert len(rows) == len(odd_rows())
    assert sorted(Counter(r["shard"] for r in rows).values()) == [2, 2, 2, 3]
    assert sharding.interleaved_shards(docs.limit(0), 4).count() == 0
    assert len(sharding.interleaved_shards(docs.limit(2), 24).collect()) == 2


def test_word_count(spark):
    texts = [None, "", " ", "a", " a ", "a b", "\x0ba\x1cb\u00a0c\nd\r", "\n\n x", "x\t"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(word_count(F.col("t"))).collect()]
    assert got == [len(WORD.findall(t or "")) for t in texts]


def brute_targets(sizes):
    """Share by weight, cap, and share the excess again until none is above."""
    total = sum(sizes.values())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    capped = {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        weights = sum(weight[s] for s in free)
        target = {s: left * weight[s] / weights for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return {**target, **capped}
        capped |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 2, "c": 1000, None: 50}, {"a": 0, "b": 5},
        {"a": 500, "b": 1, "c": 1, "d": 1, "e": 1}, {"a": 7}, {"z": 3, "ä": 900, "B": 20, "~": 4},
    ],
)
def test_targets_equal_repeated_sharing(spark, sizes):
    rows = [(s, n, f"g{i}") for i, (s, n) in enumerate(sizes.items())]
    df = spark.createDataFrame(rows, "source string, n bigint, g string")
    got = {r["g"]: r["target"] for r in mixing.source_targets(df, "source", "g", "n").collect()}
    want = brute_targets(sizes)
    for source, _, g in rows:
        assert got[g] == pytest.approx(want[source])


def test_op4_meets_targets(spark, sf_dir):
    docs = {d["doc_id"]: d for d in read(sf_dir, "documents")}
    rows = QUERIES["op4_mix"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    sizes, taken, target, longest = Counter(), Counter(), {}, Counter()
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == len(WORD.findall(d["text"])) and r["taken"] <= 3 * r["size"]
        sizes[d["source"]] += r["size"]
        taken[d["source"]] += r["taken"]
        target[d["source"]] = r["target"]
        longest[d["source"]] = max(longest[d["source"]], r["size"])
    assert target == pytest.approx(brute_targets(sizes))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1


def test_draw_prefers_heavier_documents(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'s' || (id % 3) AS source", "'a b c' AS text")
    steps = F.when(F.col("doc_id") % 2 == 0, F.lit(16)).otherwise(F.lit(4))
    rows = mixing.mix_sources(df, weight_steps=steps).where("source = 's0'").collect()
    rate = [np.mean([r["epochs"] for r in rows if r["doc_id"] % 2 == k]) for k in (0, 1)]
    assert rate[0] > 2 * rate[1]


@pytest.mark.parametrize("per_bucket", [2, 100_000])
def test_mix_of_odd_rows(spark, per_bucket):
    docs = documents(spark, odd_rows()).withColumnRenamed("n_chars", "Target")
    mixed = mixing.mix_sources(docs, rows_per_bucket=per_bucket)
    rows = mixed.collect()
    assert len(rows) == len(odd_rows())
    assert all(0 <= r["epochs"] <= 3 for r in rows)
    again = sorted(map(str, mixing.mix_sources(docs).collect()))
    assert sorted(map(str, rows)) == again
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    plain = documents(spark, odd_rows())
    copies = mixing.take_epochs(mixing.mix_sources(plain))
    assert set(copies.columns) == set(plain.columns)
    assert copies.count() == sum(r["epochs"] for r in mixing.mix_sources(plain).collect())
