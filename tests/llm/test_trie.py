"""The conversation trie against one made turn by turn in memory."""

import hashlib
import random
import zlib

import pytest
from helpers import WORD, read
from pyspark.sql import functions as F

from candor.llm import prefix_trie as pt
from candor.llm.queries import QUERIES, with_shared_heads

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def in_order(rows):
    """Turns (role, text) per conversation."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    return {c: [x[3:] for x in sorted(turns)] for c, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute_trie(convs):
    members = {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members.setdefault(tuple(convs[c][:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for path in sorted(members, key=len, reverse=True):
        words = len(WORD.findall(path[-1][1])) if path else 0
        kids.setdefault(path, 0)
        leaves[path] = leaves.get(path, 0) or 1
        saved[path] = saved.get(path, 0) + (len(members[path]) - 1) * words
        if path:
            up = path[:-1]
            kids[up] = kids.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[path]
            saved[up] = saved.get(up, 0) + saved[path]
    return sorted(
        (
            m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p],
            hashlib.sha256(",".join(str(c) for c in m if len(convs[c]) == len(p)).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def some_conversations(rng, n=60):
    rows = []
    for c in rng.sample(range(200), n):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["u", "a", None]), rng.choice(["x y", "x", "", None])))
    # One conversation with a third of all turns, and copies of one.
    rows += [(500, i, "u", "x" if i % 3 else "y z") for i in range(150)]
    rows += [(c, i, "u", "x" if i % 3 else "y z") for c in range(600, 615) for i in range(7)]
    return rows


def trie_rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("size, mass", [(1024, None), (4, 5), (1, 40)])
def test_trie_equals_brute_force(spark, size, mass):
    rows = some_conversations(random.Random(size))
    blocks = pt.turn_blocks(spark.createDataFrame(rows, SCHEMA).repartition(5), size=size)
    assert trie_rows(pt.prefix_trie(blocks, mass)) == brute_trie(in_order(rows))


def test_op13_equals_brute_force_on_whole_tables(spark, sf_dir):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in read(sf_dir, "conversations")]
    got = trie_rows(QUERIES["op13_prefix_trie"](spark, sf_dir))
    assert got == brute_trie(rebuilt(in_order(rows)))


def test_blocks_hold_the_turns_in_order(spark):
    rows = some_conversations(random.Random(3))
    convs = in_order(rows)
    found = pt.turn_blocks(spark.createDataFrame(rows, SCHEMA).repartition(7), size=4).collect()
    for c, turns in convs.items():
        own = sorted((r for r in found if r["conv"] == c), key=lambda r: r["start"])
        assert [bytes(d) for r in own for d in r["digests"]] == [digest(*t) for t in turns]
        assert [n for r in own for n in r["words"]] == [len(WORD.findall(t)) for _, t in turns]
        assert {r["total"] for r in own} == {len(turns)} and own[0]["start"] == 0
        assert [r["start"] for r in own[1:]] == [r["start"] + len(r["digests"]) for r in own[:-1]]


def test_shared_heads(spark):
    rows = some_conversations(random.Random(4))
    # The head's own conversation is shorter than the heads taken of it.
    rows = [r for r in rows if r[0] != 40] + [(40, 0, "u", "only")] + [(c, t, "a", f"own {t}") for c in (41, 42, 43, 44) for t in (1, 2)]
    convs = rebuilt(in_order(rows))
    # Blocks of one turn, as the edges of tasks make them too.
    for size in (1, 2, 1024):
        blocks = with_shared_heads(pt.turn_blocks(spark.createDataFrame(rows, SCHEMA), size=size))
        found = blocks.collect()
        for c, turns in convs.items():
            own = sorted((r for r in found if r["conv"] == c), key=lambda r: (r["start"], len(r["digests"])))
            assert [bytes(d) for r in own for d in r["digests"]] == [digest(*t) for t in turns]
            assert {r["total"] for r in own} == {len(turns)} and [r["first"] for r in own].count(True) == 1
            assert [r["start"] for r in own[1:]] == [r["start"] + len(r["digests"]) for r in own[:-1]]
        if size == 1:
            assert trie_rows(pt.prefix_trie(blocks, 6)) == brute_trie(convs)


def test_trie_of_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, None, None, None), (2, None, "", ""), (None, 1, "u", "lost"), (None, None, None, None),
        (3, 1, "u", "a"), (3, 1, "u", "a"), (3, 1, "a", "b"), (-7, 2**62, "u", "a"), (4, 0, "u", "word " * 50_000),
        (2**62, 0, "1:", "x"), (2**62 + 1, 0, "1", ":x"),
    ]
    # Columns with the names of working columns.
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"conv": F.lit(9), "digest": F.lit(9), "part": F.lit(9)})
    assert trie_rows(pt.prefix_trie(pt.turn_blocks(df))) == brute_trie(in_order(rows))
    assert pt.prefix_trie(pt.turn_blocks(df.limit(0))).count() == 0
    assert pt.prefix_trie(pt.turn_blocks(df.where("conv_id is null"))).count() == 0


def test_queue_gives_everything_in_order_whatever_it_holds():
    rng = random.Random(1)
    for held in (1, 2, 7, 1000):
        queue, waiting = pt.SpillingQueue(held), []
        for _ in range(600):
            if waiting and rng.random() < 0.45:
                least = min(waiting)
                waiting.remove(least)
                assert queue.least() == least and queue.pop() == least
            else:
                item = (rng.randrange(20), rng.randrange(3))
                waiting.append(item)
                queue.push(item)
        assert [queue.pop() for _ in sorted(waiting)] == sorted(waiting) and queue.least() is None


def test_totals_do_not_depend_on_what_the_queue_holds(spark):
    """A binary tree of 9 levels as one shard."""
    rows = [(i, 0, i // 2, 0, i.bit_length(), 1, 0, 2, i % 5, 0, 0, 0) for i in range(1, 512)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in pt.SHARD))
    want = {}
    for i in range(511, 0, -1):
        n, s = want.get(i, (0, 0))
        want[i] = (n or 1, s + i % 5)
        if i > 1:
            up = want.get(i // 2, (0, 0))
            want[i // 2] = (up[0] + want[i][0], up[1] + want[i][1])
    for held in (3, 100_000):
        got = {r["a"]: (r["n_leaves"], r["saved_tokens"]) for r in pt.shard_totals(df, held).collect()}
        assert got == want


def test_hash_of_many_ends_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE_BYTES", 40)
    rows = [(1, 1, c) for c in range(-30, 400)] + [(1, 2, 5), (-9, 1, 7), (-9, 1, 3)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "a bigint, b bigint, conv bigint")
    got = {(r["a"], r["b"]): r["ends_sha256"] for r in pt.end_hashes(df.repartition(6)).collect()}
    want = {(1, 1): range(-30, 400), (1, 2): [5], (-9, 1): [3, 7]}
    assert got == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in want.items()}
