"""Language-model scores against formulas and a step-by-step coder."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import LOWER, WORD, documents, odd_rows, read
from pyspark.sql import functions as F

from candor.llm import lm_scoring as lm
from candor.llm.queries import QUERIES


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def symbols(text):
    return [0] * lm.ORDER + [b + 1 for b in " ".join(tokens(text)).encode()] + [lm.END]


def contexts(texts):
    seen = [defaultdict(Counter) for _ in range(lm.ORDER + 1)]
    for t in texts:
        s = symbols(t)
        for p in range(lm.ORDER, len(s)):
            for k in range(lm.ORDER + 1):
                seen[k][tuple(s[p - k : p])][s[p]] += 1
    return seen


def code(seen, text):
    """log10 probability, symbol by symbol: escapes by method D, with exclusion."""
    s, total = symbols(text), 0.0
    for p in range(lm.ORDER, len(s)):
        out = set()
        for k in range(lm.ORDER, -1, -1):
            own = {x: n for x, n in seen[k].get(tuple(s[p - k : p]), {}).items() if x not in out}
            if s[p] in own:
                total += math.log10((2 * own[s[p]] - 1) / (2 * sum(own.values())))
                break
            if own:
                total += math.log10(len(own) / (2 * sum(own.values())))
            out |= set(own)
        else:
            total -= math.log10(lm.ALPHABET - len(out))
    return total


def test_op5_on_whole_tables(spark, sf_dir):
    texts = {d["doc_id"]: d["text"] for d in read(sf_dir, "documents")}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in [*tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    rows = QUERIES["op5_lm_scores"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = [*tokens(texts[r["doc_id"]]), None]
        assert (r["held_out"], r["train_tokens"], r["n_tokens"]) == (held[r["doc_id"]], n, len(own))
        assert r["n_known"] == sum(counts[w] > 0 for w in own)
        want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        assert r["base_score"] == pytest.approx(want, rel=1e-9)
    seen = contexts(t for i, t in texts.items() if not held[i])
    some = [r for r in rows if r["held_out"]][:15] + [r for r in rows if not r["held_out"]][:15]
    for r in some:
        assert r["score"] == pytest.approx(code(seen, texts[r["doc_id"]]), rel=1e-9)


def test_probabilities_of_all_next_symbols_add_up_to_one():
    rng = random.Random(1)
    seen = contexts("".join(rng.choices("ab c", k=30)) for _ in range(20))
    for context in ([0] * 5, [98, 99, 33, 98, 98], [5, 6, 7, 8, 9], [33, 98, 99, 99, 100]):
        total = 0.0
        for symbol in range(1, lm.ALPHABET + 1):
            out, p = set(), 1.0
            for k in range(lm.ORDER, -1, -1):
                own = {x: n for x, n in seen[k].get(tuple(context[len(context) - k :]), {}).items() if x not in out}
                if symbol in own:
                    p *= (2 * own[symbol] - 1) / (2 * sum(own.values()))
                    break
                if own:
                    p *= len(own) / (2 * sum(own.values()))
                out |= set(own)
            else:
                p /= lm.ALPHABET - len(out)
            total += p
        assert total == pytest.approx(1.0)


def test_windows_of_a_long_text_in_pieces(monkeypatch):
    rng = random.Random(5)
    docs = [rng.choices([b"a", b"bcd", b"efghi"], k=n) for n in (0, 3, 400, 1, 90, 0)]
    want = [sorted(lm.windows([b" ".join(d)])[0].tolist()) for d in docs]
    for size in (7, 50, 10_000):
        monkeypatch.setattr(lm, "BLOCK_SYMBOLS", size)
        got = [[] for _ in docs]
        for first, packed, starts in lm.blocks(docs):
            for i, part in enumerate(lm.np.split(packed, starts[1:])):
                got[first + i] += part.tolist()
        assert [sorted(g) for g in got] == want


def test_packed_numbers_and_words_come_back():
    rng = lm.np.random.default_rng(3)
    for values in (lm.np.zeros(0, lm.np.int64), lm.np.sort(rng.integers(0, 2**54, 999)), lm.np.array([-5, 2**62])):
        assert lm.unpack(lm.pack(values)).tolist() == values.tolist()
    logs = lm.np.log10(rng.random(500))
    assert lm.unpack_scores(lm.pack_scores(logs)).tolist() == logs.tolist()
    for words in ([], [b""], [b"", b"a"], [b"x\xff", b"y"]):
        assert lm.unpack_words(lm.pack_words(words)) == words


def test_scores_do_not_depend_on_chunks_or_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id < 120")
    train = F.col("doc_id") % 7 != 2
    want = None
    for parts, size in ((1, 1 << 22), (5, 20_000), (3, 3000)):
        rows = lm.score_documents(docs.repartition(parts), train, chunk_bytes=size).collect()
        got = {r["doc_id"]: (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows}
        want = want or got
        assert got.keys() == want.keys()
        assert all(got[i] == pytest.approx(want[i], rel=1e-12) for i in want)


def test_odd_rows_and_small_blocks(spark, monkeypatch):
    rows = odd_rows()
    docs = documents(spark, rows).withColumnRenamed("n_chars", "score")
    train = F.col("doc_id") != 5
    got = sorted(lm.score_documents(docs, train).collect(), key=str)
    assert len(got) == len(rows)
    seen = contexts(t for i, t, _ in rows if i is not None and i != 5)
    want = sorted((len(tokens(t)) + 1, code(seen, t)) for _, t, _ in rows)
    for (n, s), (m, t) in zip(want, sorted((r["n_tokens"], r["score"]) for r in got)):
        assert n == m and t == pytest.approx(s, rel=1e-9)
    monkeypatch.setattr(lm, "BLOCK_SYMBOLS", 50)
    again = sorted(lm.score_documents(docs, train, chunk_bytes=20).collect(), key=str)
    assert [r["n_tokens"] for r in again] == [r["n_tokens"] for r in got]
    assert [r["score"] for r in again] == pytest.approx([r["score"] for r in got])
    assert lm.score_documents(docs.limit(0), train).count() == 0
    nothing = lm.score_documents(docs, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in nothing)
    assert [r["base_score"] for r in nothing] == [0.0] * len(rows)
