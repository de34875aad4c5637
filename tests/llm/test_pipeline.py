"""The corpus pipeline, stage by stage."""

from collections import Counter

import corpus_pipeline as cp
import numpy as np
import pytest
from helpers import documents, odd_rows, read
from test_copies import brute_components, brute_fingerprint
from test_placing import brute_targets
from test_scans import norm

from candor.llm import simhash
from candor.llm.quality_rules import apply_rules
from candor.llm.shared import keep


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(keep(stage(spark, out[-1], sf_dir), "test-stage"))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_all_but_the_last_keep_the_columns(stages):
    for df in stages[:-1]:
        assert df.dtypes == stages[0].dtypes
    assert set(stages[-1].columns) == {*stages[0].columns, "shard", "slot"}


def test_quality_stage(spark, sf_dir, stages):
    judged = apply_rules(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids(stages[1]) == ids(judged.where("kept"))
    quality = {r["doc_id"]: r["quality"] for r in read(sf_dir, "labels")}
    kept = set(ids(stages[1]))
    good = [i for i, q in quality.items() if q]
    assert np.mean([i in kept for i in good]) > 0.9


def test_near_duplicate_stage(stages):
    docs = sorted((r["doc_id"], r["text"]) for r in stages[1].collect())
    groups = brute_components([brute_fingerprint(t) for _, t in docs])
    assert ids(stages[2]) == [docs[i][0] for i in sorted(set(groups))]


def test_decontamination_stage(sf_dir, stages):
    items = [norm(b["text"]).strip() for b in read(sf_dir, "benchmark")]
    before = {r["doc_id"]: norm(r["text"]) for r in stages[2].collect()}
    kept = set(ids(stages[3]))
    assert {i for i, t in before.items() if any(x in t for x in items)} == set(before) - kept


def test_mixing_stage(stages):
    size, source = Counter(), {}
    for r in stages[3].collect():
        source[r["doc_id"]] = r["source"]
        size[r["doc_id"]] = len(r["text"].encode().split())
    total, taken, longest = Counter(), Counter(), Counter()
    for i, s in source.items():
        total[s] += size[i]
        longest[s] = max(longest[s], size[i])
    times = Counter(ids(stages[4]))
    for i, n in times.items():
        taken[source[i]] += n * size[i]
    assert max(times.values()) <= 3
    for s, target in brute_targets(total).items():
        assert abs(taken[s] - target) <= longest[s] / 2 + 1


def test_sharding_stage(stages):
    rows = stages[5].collect()
    assert sorted(r["doc_id"] for r in rows) == ids(stages[4])
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    assert sorted(map(str, cp.run(spark, sf_dir).select("doc_id", "shard", "slot").collect())) == sorted(
        map(str, stages[-1].select("doc_id", "shard", "slot").collect())
    )


def test_stages_on_odd_rows(spark, sf_dir):
    docs = documents(spark, odd_rows())
    for _, stage in cp.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, sf_dir)
            assert out.columns[: len(docs.columns)] == docs.columns
            assert out.count() <= 3 * len(odd_rows())


def test_copies_of_one_text_leave_one(spark):
    rows = [(i, "the same text of quite a few words in a row", "s") for i in range(50, 0, -1)]
    kept = simhash.drop_near_duplicates(documents(spark, rows)).collect()
    assert [r["doc_id"] for r in kept] == [1]
