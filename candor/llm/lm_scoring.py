"""Code lengths of documents under prediction by partial matching, beside a word model.

Texts are read as tokens: the words with A-Z lower-cased, a space between, an end symbol
last.  A trie of byte contexts up to ORDER symbols is counted over all training documents.
A symbol's probability comes from the longest context seen with it; every context that has
not seen it costs an escape (method D: the number of its distinct symbols against twice its
total), and symbols that a longer context could have coded are excluded from the shorter.
The model is trained before it scores, so the probability of a symbol depends on its window
alone, and each distinct window is worked out once.

Documents are handled in chunks of about CHUNK_BYTES.  A document's chunk is written next to it
before anything is counted, so that it is the same whatever tasks read it later.  A chunk asks
for its distinct words and windows in buckets, every bucket answers all chunks, and the answers
meet the chunk's texts.  No table of the model is broadcast or held whole in a task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.llm.shared import ASCII_LOWER, column, keep

ORDER = 5
# Symbols: 0 before the text, 1 to 256 the bytes, 257 the end.
SYMBOL_BITS = 9
END = 257
ALPHABET = 257
# More text in a chunk shares more words and windows, and takes more memory: some 30 bytes a byte.
CHUNK_BYTES = 8 * 1024 * 1024
# Symbols that are looked at in one step.
BLOCK_SYMBOLS = 1_000_000
PRIME = 1_000_003

# Windows with equal first symbols share a bucket, so that sorted ones differ little.
PREFIX_BITS = 3 * SYMBOL_BITS

TALLY = "chunk bigint, bucket int, words binary, word_n binary, grams binary, gram_n binary"


# --- symbols ----------------------------------------------------------------------------


def token_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ASCII_LOWER).split()


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed windows of ORDER + 1 symbols of all texts, and where each text's begin."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(np.r_[0, lengths + ORDER + 1])
    symbols = np.zeros(int(starts[-1]), np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    shift = starts[:-1] + ORDER - (np.cumsum(lengths) - lengths)
    symbols[np.repeat(shift, lengths) + np.arange(len(raw))] = raw
    symbols[symbols.nonzero()] += 1
    symbols[starts[:-1] + ORDER + lengths] = END
    return packed_windows(symbols)[symbols[ORDER:] != 0], np.cumsum(np.r_[0, lengths[:-1] + 1])


def packed_windows(symbols: np.ndarray) -> np.ndarray:
    n = max(0, len(symbols) - ORDER)
    packed = symbols[:n].copy()
    for j in range(1, ORDER + 1):
        packed <<= SYMBOL_BITS
        packed |= symbols[j : j + n]
    return packed


def blocks(docs: list[list[bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, windows, starts) of runs of documents with about BLOCK_SYMBOLS symbols.

    A longer text comes in several pieces, each as a run of one document.
    """
    texts: list[bytes] = []
    first = held = 0
    for i, words in enumerate(docs):
        text = b" ".join(words)
        if texts and held + len(text) > BLOCK_SYMBOLS:
            yield first, *windows(texts)
            texts, held = [], 0
        if len(text) > BLOCK_SYMBOLS:
            for a in range(0, len(text) + 1, BLOCK_SYMBOLS):
                before = np.frombuffer(text[max(0, a - ORDER) : a + BLOCK_SYMBOLS], np.uint8).astype(np.int64) + 1
                edge = [np.zeros(max(0, ORDER - a), np.int64), before]
                if a + BLOCK_SYMBOLS > len(text):
                    edge.append(np.array([END], np.int64))
                yield i, packed_windows(np.concatenate(edge)), np.zeros(1, np.int64)
            continue
        if not texts:
            first = i
        texts.append(text)
        held += len(text) + ORDER + 1
    if texts:
        yield first, *windows(texts)


def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their values."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    distinct, codes = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(codes, np.concatenate(values), len(distinct)).astype(np.int64)


def gram_buckets(grams: np.ndarray, buckets: int) -> np.ndarray:
    return (grams >> PREFIX_BITS) % PRIME % buckets


def pack(values: np.ndarray) -> bytes:
    """64-bit numbers as compressed differences, byte by byte of equal weight; few bytes if sorted."""
    steps = np.diff(values, prepend=np.int64(0))
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


def pack_scores(values: np.ndarray) -> bytes:
    """Doubles as they are; windows of one context are neighbours and often score the same."""
    return zstandard.compress(values.tobytes(), 1)


def unpack_scores(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.float64)


def pack_words(words: list[bytes]) -> bytes:
    """Words hold no space.  The empty word can be among them, so no word at all is the empty string."""
    return zstandard.compress(b" ".join(words), 1) if words else b""


def unpack_words(data: bytes) -> list[bytes]:
    return zstandard.decompress(data).split(b" ") if data else []


def word_bucket(word: bytes, buckets: int) -> int:
    return zlib.crc32(word) % buckets


# --- what the corpus says ---------------------------------------------------------------


def tally_rows(chunk: int, docs: list[list[bytes]], train: list[bool], buckets: int) -> list[dict]:
    """A chunk's distinct words and windows by bucket, with their counts in training documents.

    The end of a document is the word b"".
    """
    words: Counter[bytes] = Counter()
    for own, learns in zip(docs, train):
        words.update([*own, b""] if learns else dict.fromkeys([*own, b""], 0))
    learns = np.array(train, np.float64)
    keys, values = [], []
    for first, packed, starts in blocks(docs):
        codes, distinct = pd.factorize(packed)
        weights = np.repeat(learns[first : first + len(starts)], np.diff(np.r_[starts, len(packed)]))
        keys.append(distinct)
        values.append(np.bincount(codes, weights, len(distinct)).astype(np.int64))
    grams, counts = summed(keys, values)
    of = gram_buckets(grams, buckets)
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(buckets + 1))
    per_bucket: dict[int, list[bytes]] = {}
    for word in words:
        per_bucket.setdefault(word_bucket(word, buckets), []).append(word)
    rows = []
    for b in np.union1d(np.unique(of), np.array(list(per_bucket), np.int64)).tolist():
        own, named = order[cuts[b] : cuts[b + 1]], sorted(per_bucket.get(b, []))
        rows.append(
            {
                "chunk": chunk, "bucket": b, "words": pack_words(named),
                "word_n": pack(np.array([words[w] for w in named], np.int64)),
                "grams": pack(grams[own]), "gram_n": pack(counts[own]),
            }
        )
    return rows


ROWS = pa.schema(
    [
        ("chunk", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()),
        ("word_n", pa.binary()), ("grams", pa.binary()), ("gram_n", pa.binary()),
    ]
)


def in_chunks(narrow: DataFrame, chunk_bytes: int) -> DataFrame:
    """The rows with the number of their chunk, written; a task's rows fill one chunk after the other."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            chunks = []
            for size in pc.binary_length(batch.column("text")).to_pylist():
                if held and held + size > chunk_bytes:
                    chunk, held = chunk + 1, 0
                held += size + 1
                chunks.append(chunk)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(chunks, pa.int64())], [*batch.schema.names, "chunk"]
            )

    kind = narrow.schema["key"].dataType.simpleString()
    numbered = narrow.mapInArrow(number, f"key {kind}, text binary, train boolean, chunk bigint")
    return keep(numbered, "lm-documents", "zstd")


def tally_chunks(marked: DataFrame, buckets: int) -> DataFrame:
    """One row per chunk and bucket; more where a chunk's rows are read by several tasks."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, docs, train = None, [], []
        for batch in batches:
            chunks, learn = batch.column("chunk").to_pylist(), batch.column("train").to_pylist()
            for chunk, text, learns in zip(chunks, batch.column("text"), learn):
                if chunk != current:
                    if docs:
                        yield pa.RecordBatch.from_pylist(tally_rows(current, docs, train, buckets), ROWS)
                    current, docs, train = chunk, [], []
                docs.append(token_words(text.as_py()))
                train.append(learns)
        if docs:
            yield pa.RecordBatch.from_pylist(tally_rows(current, docs, train, buckets), ROWS)

    return marked.select("chunk", "text", "train").mapInArrow(tally, TALLY)


def _unpacked(table: pa.Table, name: str) -> list[np.ndarray]:
    return [unpack(x.as_py()) for x in table.column(name)]


def word_totals(tallies: DataFrame) -> tuple[int, int]:
    """Training tokens and distinct training tokens."""

    def count(table: pa.Table) -> pa.Table:
        total: Counter[bytes] = Counter()
        for words, counts in zip(table.column("words"), table.column("word_n")):
            for w, n in zip(unpack_words(words.as_py()), unpack(counts.as_py()).tolist()):
                if n:
                    total[w] += n
        return pa.table({"tokens": [sum(total.values())], "types": [len(total)]})

    per_bucket = tallies.select("bucket", "words", "word_n").groupBy("bucket").applyInArrow(
        count, "tokens bigint, types bigint"
    )
    tokens, types = per_bucket.agg(F.sum("tokens"), F.sum("types")).first()
    return tokens or 0, types or 0


def window_counts(tallies: DataFrame) -> DataFrame:
    """(gram, n): every window of the corpus with its count in training documents."""

    def count(table: pa.Table) -> pa.Table:
        grams, n = summed(_unpacked(table, "grams"), _unpacked(table, "gram_n"))
        return pa.table({"gram": grams, "n": n})

    return tallies.select("bucket", "grams", "gram_n").groupBy("bucket").applyInArrow(
        count, "gram bigint, n bigint"
    )


# --- the trie ---------------------------------------------------------------------------


def last_symbols(gram: str, count: str) -> Column:
    """The last ``count`` symbols of a packed window."""
    return F.expr(f"{gram} & (shiftleft(1L, {SYMBOL_BITS} * ({count})) - 1)")


def trie_edges(counts: DataFrame) -> DataFrame:
    """(k, gram, n): contexts of k symbols with a symbol after, and how often it was seen."""
    orders = F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k")
    seen = counts.where("n > 0").select("gram", "n", orders)
    return seen.select("k", last_symbols("gram", "k + 1").alias("gram"), "n").groupBy("k", "gram").agg(
        F.sum("n").alias("n")
    )


def trie_nodes(edges: DataFrame) -> DataFrame:
    """(k, ctx, total, types, lower): ``lower`` is the count of its symbols one order down."""
    lower = edges.select((F.col("k") + 1).alias("k"), F.col("gram").alias("low"), F.col("n").alias("n_low"))
    children = edges.withColumn("low", last_symbols("gram", "k")).join(lower, ["k", "low"], "left")
    return children.groupBy("k", F.shiftright("gram", SYMBOL_BITS).alias("ctx")).agg(
        F.sum("n").alias("total"), F.count("*").alias("types"),
        F.coalesce(F.sum("n_low"), F.lit(0)).alias("lower"),
    )


def window_scores(counts: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(gram, score): log10 probability of each window's last symbol after the others."""
    ctx = F.shiftright("gram", SYMBOL_BITS)
    top = nodes.where(f"k = {ORDER}").select("ctx", "total")
    seen = counts.where("n > 0").withColumn("ctx", ctx).join(top, "ctx").select(
        "gram", F.log10((2 * F.col("n") - 1) / (2 * F.col("total"))).alias("score")
    )
    orders = F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k")
    asked = counts.where("n = 0").select(F.col("gram").alias("window"), orders)
    asked = asked.withColumn("gram", last_symbols("window", "k + 1")).withColumn("ctx", ctx)

    def looked_up(rows: DataFrame, e: DataFrame, x: DataFrame) -> DataFrame:
        return rows.join(e, ["k", "gram"], "left").join(x, ["k", "ctx"], "left")

    # Orders 0 and 1 have at most 258 contexts and 258 * 257 edges: every row asks them.
    low = looked_up(asked.where("k < 2"), F.broadcast(edges.where("k < 2")), F.broadcast(nodes.where("k < 2")))
    high = looked_up(asked.where("k >= 2"), edges.where("k >= 2"), nodes.where("k >= 2"))
    found = low.unionByName(high).groupBy("window").agg(
        F.collect_list(
            F.struct(
                "k", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n", "total", "types", "lower")]
            )
        ).alias("levels")
    )
    state = "struct<score:double,done:boolean,types:bigint,lower:bigint>"
    start = F.struct(
        F.lit(0.0).alias("score"), F.lit(False).alias("done"), F.lit(0).alias("types"), F.lit(0).alias("lower")
    ).cast(state)

    def step(acc: Column, x: Column) -> Column:
        total, types = x["total"] - acc["lower"], x["types"] - acc["types"]
        hit = x["n"] > 0
        cost = F.when(hit, F.log10((2 * x["n"] - 1) / (2 * total))).when(
            total > 0, F.log10(types / (2 * total))
        )
        after = F.struct(
            (acc["score"] + F.coalesce(cost, F.lit(0.0))).alias("score"), hit.alias("done"),
            x["types"].alias("types"), x["lower"].alias("lower"),
        ).cast(state)
        return F.when(acc["done"], acc).otherwise(after)

    def finish(acc: Column) -> Column:
        # Order -1: the symbols never seen at all share what is left.
        rest = F.log10(F.greatest(ALPHABET - acc["types"], F.lit(1)).cast("double"))
        return F.when(acc["done"], acc["score"]).otherwise(acc["score"] - rest)

    down = F.reverse(F.array_sort("levels"))
    unseen = found.select(F.col("window").alias("gram"), F.aggregate(down, start, step, finish).alias("score"))
    return seen.unionByName(unseen)


# --- scoring ----------------------------------------------------------------------------


def answers(tallies: DataFrame, scores: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, counts, scores): for a chunk's distinct words and windows in order."""

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        total: Counter[bytes] = Counter()
        per_chunk: dict[int, tuple[set[bytes], list[np.ndarray]]] = {}
        bucket = 0
        for row in range(asked.num_rows):
            chunk, bucket = asked["chunk"][row].as_py(), asked["bucket"][row].as_py()
            words = unpack_words(asked["words"][row].as_py())
            for w, n in zip(words, unpack(asked["word_n"][row].as_py()).tolist()):
                total[w] += n
            own = per_chunk.setdefault(chunk, (set(), []))
            own[0].update(words)
            own[1].append(unpack(asked["grams"][row].as_py()))
        keys = known["gram"].to_numpy()
        order = np.argsort(keys)
        keys, values = keys[order], known["score"].to_numpy()[order]
        out = [
            {
                "chunk": chunk, "bucket": bucket,
                "counts": pack(np.array([total[w] for w in sorted(words)], np.int64)),
                "scores": pack_scores(values[np.searchsorted(keys, np.unique(np.concatenate(grams)))]),
            }
            for chunk, (words, grams) in per_chunk.items()
        ]
        return pa.Table.from_pylist(out, ANSWERS)

    prefix = F.pmod(F.shiftright("gram", PREFIX_BITS), F.lit(PRIME))
    keyed = scores.withColumn("bucket", F.pmod(prefix, F.lit(buckets)).cast("int"))
    asked = tallies.select("chunk", "bucket", "words", "word_n", "grams")
    return asked.groupBy("bucket").cogroup(keyed.groupBy("bucket")).applyInArrow(
        answer, "chunk bigint, bucket int, counts binary, scores binary"
    )


ANSWERS = pa.schema(
    [
        ("chunk", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("scores", pa.binary()),
    ]
)


def score_chunk(texts: list[bytes | None], told: dict[int, tuple[np.ndarray, np.ndarray]], buckets: int):
    """Per text: tokens, known tokens, sum of log10(c + 1), log10 probability."""
    docs = [token_words(t) for t in texts]
    per_bucket: list[set[bytes]] = [set() for _ in range(buckets)]
    for word in set().union(*docs, [b""]):
        per_bucket[word_bucket(word, buckets)].add(word)
    count: dict[bytes, int] = {}
    for b, words in enumerate(per_bucket):
        if words:
            count.update(zip(sorted(words), told[b][0].tolist(), strict=True))
    tokens = np.array([len(d) + 1 for d in docs], np.int64)
    known, word_logs = np.zeros(len(docs), np.int64), np.zeros(len(docs))
    for i, words in enumerate(docs):
        c = np.array([count[w] for w in words] + [count[b""]], np.int64)
        known[i], word_logs[i] = (c > 0).sum(), np.log10(c + 1).sum()
    # The windows once, as numbers into the distinct ones of their block; the answers follow
    # the chunk's distinct windows in order.
    coded = []
    for first, packed, starts in blocks(docs):
        codes, distinct = pd.factorize(packed)
        coded.append((first, starts, codes.astype(np.int32), distinct))
    keys = np.unique(np.concatenate([distinct for *_, distinct in coded]))
    of = gram_buckets(keys, buckets)
    order = np.argsort(of, kind="stable")
    value = np.empty(len(keys))
    value[order] = np.concatenate([told[b][1] for b in np.unique(of).tolist()])
    score = np.zeros(len(docs))
    for first, starts, codes, distinct in coded:
        logs = value[np.searchsorted(keys, distinct)][codes]
        score[first : first + len(starts)] += np.add.reduceat(logs, starts)
    return tokens, known, word_logs, score


def score_documents(
    df: DataFrame, train: Column, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """One row per row: key, train, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` says from which rows to learn.  ``base_score`` is the log10 probability under
    word counts with one added: sum of log10((c + 1) / (N + V + 1)) over words and the end.
    ``score`` is the trie's log10 probability of the same tokens.

    Null text is the empty text: one token, the end.  Repeated rows are learned from and
    scored as often as they come; null keys stay null.  Without training rows every
    window falls through to the flat order -1.  Other columns are not read.
    """
    narrow = df.select(
        column(key).alias("key"), F.coalesce(column(text), F.lit("")).cast("binary").alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
    )
    marked = in_chunks(narrow, chunk_bytes)
    buckets = max(1, marked.select("chunk").distinct().count())
    tallies = keep(tally_chunks(marked, buckets), "lm-tallies")
    train_tokens, train_types = word_totals(tallies)
    counts = keep(window_counts(tallies), "lm-windows")
    edges = keep(trie_edges(counts), "lm-edges")
    nodes = keep(trie_nodes(edges), "lm-nodes")
    scores = keep(window_scores(counts, edges, nodes), "lm-scores")
    told = answers(tallies, scores, buckets)

    def score(docs: pa.Table, answered: pa.Table) -> pa.Table:
        replies = {
            b: (unpack(c.as_py()), unpack_scores(s.as_py()))
            for b, c, s in zip(answered["bucket"].to_pylist(), answered["counts"], answered["scores"])
        }
        tokens, known, logs, total = score_chunk(docs["text"].to_pylist(), replies, buckets)
        return pa.table(
            {
                "key": docs["key"], "train": docs["train"], "n_tokens": tokens, "n_known": known,
                "word_logs": logs, "score": total,
            }
        )

    kind = dict(marked.dtypes)["key"]
    scored = marked.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(
        score, f"key {kind}, train boolean, n_tokens bigint, n_known bigint, word_logs double, score double"
    )
    flat = F.log10(F.lit(float(train_tokens + train_types + 1)))
    return scored.select(
        F.col("key").alias(key), "train", "n_tokens", "n_known",
        F.lit(train_tokens).cast("bigint").alias("train_tokens"),
        (F.col("word_logs") - F.col("n_tokens") * flat).alias("base_score"), "score",
    )
