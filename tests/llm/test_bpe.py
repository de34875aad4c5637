"""Byte-level BPE against a public library on the same vocabulary file."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from helpers import documents, odd_rows, read
from pyspark.sql import functions as F

from candor.llm import byte_bpe as bb
from candor.llm.queries import QUERIES

PIECES = ["a", "b", " ", "é", "東", "'s", "\n", "\t", "1", "<|endoftext|>", "  ", "ab", "!!", "\x1c", "\U0001f600"]


@pytest.fixture(scope="module")
def vocabulary():
    return bb.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding(
        "test", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={}
    )


def test_op11_equals_the_library_on_whole_tables(spark, sf_dir, library):
    got = {r["doc_id"]: r for r in QUERIES["op11_byte_bpe"](spark, sf_dir).collect()}
    docs = read(sf_dir, "documents")
    assert len(got) == len(docs)
    for d in docs:
        ids, r = library.encode_ordinary(d["text"] or ""), got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_merges_of_random_and_long_texts(vocabulary, library):
    encoder, rng = bb.Encoder(vocabulary.ranks, vocabulary.pattern), random.Random(1)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 80))) for _ in range(1500)]
    texts += ["a" * 50_000, "ab" * 20_000, "東" * 20_000, "".join(rng.choices("abcdefghij", k=60_000)), " " * 30_000]
    for text in texts:
        assert bb.split_ids(encoder.encode(text)) == library.encode_ordinary(text)


def test_every_code_point_is_cut_as_the_library_cuts_it(vocabulary, library):
    encoder = bb.Encoder(vocabulary.ranks, vocabulary.pattern)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for begin in range(0, len(points), 500):
        text = "".join(f"a{chr(c)}1{chr(c)}{chr(c)}! {chr(c)}  b" for c in points[begin : begin + 500])
        assert bb.split_ids(encoder.encode(text)) == library.encode_ordinary(text)


def test_pieces_are_right_after_they_are_forgotten(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bb, "KNOWN_PIECES", 3)
    encoder = bb.Encoder(vocabulary.ranks, vocabulary.pattern)
    for text in ["uncached unseenish wordlets repeatedlyish " * 5, "quizzically otherwordlet", "", "unseenish" * 20]:
        assert bb.split_ids(encoder.encode(text)) == library.encode_ordinary(text)
        # What is left is of the last texts only, and nothing long.
        assert len(encoder) <= 8 and all(len(p.encode()) <= bb.KNOWN_BYTES for p in encoder)


def test_trees_side_by_side_equal_single_trees(vocabulary):
    pairs, rng = bb.PairRanks(vocabulary.ranks), random.Random(5)
    longest = max(map(len, vocabulary.ranks))
    for size in (1, 2, 8, 64):
        pieces = ["".join(rng.choices("abcdeée東 ", k=size)).encode()[: rng.randint(1, size)] for _ in range(300)]
        ids, counts = bb.merged_together(pieces, pairs, size)
        want = [[vocabulary.ranks[t] for t in bb.merged(p, vocabulary.ranks, longest)] for p in pieces]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_another_vocabulary_merges_by_its_own_ranks():
    """All pairs tie in nothing but place: the leftmost of the least rank goes first."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"aba": 258, b"abab": 300, b"cc": 259}
    assert bb.merged(b"abcc", ranks, 4) == [b"ab", b"cc"]
    assert bb.merged(b"ababa", ranks, 4) == [b"ab", b"aba"]
    assert bb.merged(b"ababab", ranks, 4) == [b"abab", b"ab"]
    assert bb.merged(b"z", ranks, 4) == [b"z"]


def test_encoding_of_odd_rows(spark, vocabulary, library):
    docs = documents(spark, odd_rows()).withColumnRenamed("n_chars", "ids")
    bpe = bb.ByteBpe(spark, vocabulary)
    coded = docs.select("*", bpe.encode(F.col("text")).alias("packed"))
    both = bpe.round_trip(F.col("text")).alias("both")
    rows = coded.select("text", "packed", bpe.decode(F.col("packed")).alias("back"), both).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        assert bb.split_ids(r["packed"]) == library.encode_ordinary(r["text"] or "")
        assert bytes(r["back"]).decode() == (r["text"] or "")
        assert r["both"]["ids"] == r["packed"] and r["both"]["decoded"] == r["back"]
    assert coded.limit(0).count() == 0


def test_bad_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bb.Vocabulary({b"a": 0}, ".")
    with pytest.raises(ValueError):
        bb.Vocabulary({bytes([b]): b for b in range(256)} | {b"ab": 7}, ".")
    with pytest.raises(ValueError):
        bb.split_ids(b"\x00\x01")
