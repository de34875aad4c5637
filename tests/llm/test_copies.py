"""Repeated lines and near-duplicates."""

import random

import numpy as np
import pytest
import xxhash
from helpers import LOWER, WORD, documents, odd_rows, read
from pyspark.sql import functions as F

from candor.llm import line_dedup as ld
from candor.llm import simhash as sh
from candor.llm.components import components
from candor.llm.queries import QUERIES


def brute_clean(rows, min_lines=3, min_words=50):
    """Delete every shortest window that came before and does not overlap its first place."""
    seen, out = {}, {}
    for key, text in rows:
        lines = text.split("\n")
        at = [j for j, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for s in range(len(at)):
            words = 0
            for e in range(s, len(at)):
                words += len(WORD.findall(lines[at[e]]))
                if e - s + 1 >= min_lines or words >= min_words:
                    window = tuple(lines[j] for j in at[s : e + 1])
                    first, end = seen.setdefault(window, (key, at[e]))
                    if first != key or at[s] > end:
                        gone.update(at[s : e + 1])
                    break
        out[key] = "\n".join(x for j, x in enumerate(lines) if j not in gone)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(6)
    pool = [" ".join(rng.choices("a b c d e f".split(), k=rng.choice([1, 2, 30]))) for _ in range(12)] + ["", " "]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 14))), "s") for i in range(150)]
    got = {r["doc_id"]: r["clean_text"] for r in ld.dedup_lines(documents(spark, rows)).collect()}
    assert got == brute_clean([(i, t) for i, t, _ in rows])


def test_first_copy_stays_and_long_lines_count_alone(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    block = "one line\ntwo line\nthree line\nfour line"
    rows = [(3, f"x\n{passage}\ny", "s"), (1, f"{block}\nend", "s"), (2, f"start\n{block}", "s"), (4, f"{passage}\n\nz", "s")]
    got = {r["doc_id"]: (r["clean_text"], [tuple(x) for x in r["removed"]]) for r in ld.dedup_lines(documents(spark, rows)).collect()}
    assert got[1] == (f"{block}\nend", []) and got[3] == (f"x\n{passage}\ny", [])
    assert got[2] == ("start", [(1, 4)]) and got[4] == ("\nz", [(0, 0)])


def test_runs_that_overlap_themselves_keep_their_first_copy(spark):
    rows = [(n, "\n".join([f"line of {n}"] * n), "s") for n in range(3, 10)]
    got = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in ld.dedup_lines(documents(spark, rows)).collect()}
    assert got == {n: [(3, n - 1)] if n > 5 else [] for n in range(3, 10)}


def test_line_dedup_beside_columns_with_clashing_names(spark):
    block = "one line\ntwo line\nthree line"
    docs = documents(spark, [(1, block, "s"), (2, f"{block}\nend", "t")])
    for name in ("_runs", "_cut", "_row", "_RUNS", "doc", "seed"):
        rows = ld.dedup_lines(docs.withColumnRenamed("source", name)).orderBy("doc_id").collect()
        assert [r[name] for r in rows] == ["s", "t"] and [r["clean_text"] for r in rows] == [block, "end"]


def test_line_dedup_of_odd_rows(spark):
    docs = documents(spark, odd_rows()).withColumnRenamed("n_chars", "removed")
    rows = ld.dedup_lines(docs).collect()
    assert len(rows) == len(odd_rows())
    assert all(r["clean_text"] == r["text"] for r in rows)
    assert ld.dedup_lines(docs.limit(0)).count() == 0


# --- near-duplicates --------------------------------------------------------------------


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    k = min(3, len(words))
    hashes = [
        xxhash.xxh64_intdigest(" ".join(words[j : j + k]).encode(), 42) for j in range(len(words) - k + 1)
    ] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=3):
    values = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_of_tricky_texts(spark):
    texts = [None, "", " \n", "One", "one TWO", "a b c", "a b c a b c a b c", "É é ẞ K\u00a0x y z\x1cw"]
    texts.append(" ".join(map(str, range(9000))))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(sh.fingerprint_hex(sh.fingerprint(F.col("t")))).collect()]
    assert got == [f"{brute_fingerprint(t):016x}" for t in texts]
    # The hash is the one Spark has.
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] == np.uint64(xxhash.xxh64_intdigest("a b c", 42)).view(np.int64)


def test_op9_equals_brute_force_on_whole_tables(spark, sf_dir):
    docs = sorted((d["doc_id"], d["text"]) for d in read(sf_dir, "documents"))
    rows = {r["doc_id"]: r for r in QUERIES["op9_simhash"](spark, sf_dir).collect()}
    fps = [brute_fingerprint(t) for _, t in docs]
    assert [rows[i]["fingerprint"] for i, _ in docs] == [f"{f:016x}" for f in fps]
    assert [rows[i]["component_id"] for i, _ in docs] == [docs[c][0] for c in brute_components(fps)]


@pytest.mark.parametrize("block", [4, 1024])
def test_links_close_over_all_pairs_for_any_block(spark, block):
    """Clouds of close fingerprints around few centres, a chain, and scattered ones."""
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = {rng.getrandbits(64) for _ in range(300)}
    for c in centres:
        for _ in range(120):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    x = rng.getrandbits(64)
    for _ in range(40):
        for b in rng.sample(range(64), 3):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(sh.signed(f),) for f in fps], "fp bigint")
    links = sh.fingerprint_links(df, block=block).collect()
    assert all((r["a"] ^ r["b"]).bit_count() <= 3 or ((r["a"] ^ r["b"]) % 2**64).bit_count() <= 3 for r in links)
    at = {sh.signed(f): i for i, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        a, b = find(at[r["a"]]), find(at[r["b"]])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == brute_components(fps)


def test_thresholds_meet_the_radius_at_least_cost():
    costs = [[5.0, 9.0], [50.0, 90.0], [1.0, 30.0], [4.0, 6.0]]
    price, chosen = sh.share_thresholds(costs, 3)
    assert sum(t + 1 for t in chosen) == 4
    from itertools import product

    best = min(
        sum(c[t] for c, t in zip(costs, ts) if t >= 0)
        for ts in product((-1, 0, 1), repeat=4) if sum(t + 1 for t in ts) == 4
    )
    assert price == best


def test_parts_group_correlated_bits():
    n, both = 1000, np.full((64, 64), 250.0)
    np.fill_diagonal(both, 500)
    both[3, 40] = both[40, 3] = 500
    parts = sh.correlated_parts(n, both, 4)
    assert sorted(b for p in parts for b in p) == list(range(64))
    assert any({3, 40} <= set(p) for p in parts)


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)]
    edges += [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300), (-5, 139)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(df, "a", "b").collect()}
    want = {i: 0 for i in range(61)} | {i: -5 for i in [*range(100, 140), -5]} | {200 + i: 200 for i in range(9)}
    assert got == want
    assert components(df.limit(0), "a", "b").count() == 0


def test_near_duplicates_of_odd_rows(spark):
    docs = documents(spark, odd_rows()).withColumnRenamed("n_chars", "fp")
    rows = sh.near_duplicates(docs).collect()
    assert len(rows) == len(odd_rows())
    blank = [r for r in rows if r["fp"] == 0]
    assert len(blank) == 4 and {r["component_id"] for r in blank} == {2}
    kept = sh.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    # The repeated row, and all blank texts but that with the smallest key, go.
    assert len(texts) == 5 and texts.count("Alpha beta gamma delta. " * 3) == 1 and None in texts
    assert sh.drop_near_duplicates(docs.limit(0)).count() == 0
    assert sh.near_duplicates(docs.limit(0)).count() == 0
