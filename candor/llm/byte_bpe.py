"""Byte-level BPE: texts to token ids by a file of ranks, and ids back to bytes.

A text is cut by a pattern, and every piece is merged by itself.  Over the byte positions of
a piece lies a segment tree: a leaf holds the rank of the pair that begins with the token
there and the next one, the inner nodes the least rank below them, the leftmost among equals.
The root names the next merge.  A merge changes three leaves, that of the merged pair, of
the token swallowed and of the token before, so it costs O(log n) however long the piece.
Short pieces are merged many at a time, their trees side by side.

Token ids travel as packed little-endian unsigned 32-bit integers, as token files hold them.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

ID_BYTES = 4
# A vocabulary is sent to all executors, so its size is bounded.
MAX_TOKENS = 4_000_000
MAX_VOCABULARY_BYTES = 64 * 1024 * 1024
# Pieces that a worker remembers, and the longest of them in bytes.
KNOWN_PIECES = 250_000
KNOWN_BYTES = 64
# Characters of the texts that are encoded together, and pieces whose trees are merged in step.
GROUP_CHARS = 1_000_000
TOGETHER = 8_192


@dataclass(frozen=True)
class Vocabulary:
    """Token bytes and their ranks, which are the ids, and the pattern that cuts texts."""

    ranks: dict[bytes, int]
    pattern: str

    def __post_init__(self) -> None:
        if len(self.ranks) > MAX_TOKENS or sum(map(len, self.ranks)) > MAX_VOCABULARY_BYTES:
            raise ValueError("the vocabulary is too large to be sent to all executors")
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("every single byte needs a rank")
        if len(set(self.ranks.values())) < len(self.ranks) or not all(
            0 <= r < 2 ** (8 * ID_BYTES) for r in self.ranks.values()
        ):
            raise ValueError("ranks must be distinct unsigned 32-bit integers")

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """Lines of a token in base64 and its rank."""
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)


def merged(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[bytes]:
    """The tokens of one piece: the leftmost pair of least rank is joined until none has a rank.

    A node of the tree holds rank * length + position, so that the smaller number is the pair
    to join; ``none`` is larger than all.  The root is node 1, the leaf of position i is size + i.
    """
    n = len(piece)
    none = n << 8 * ID_BYTES
    size = 1 << (n - 1).bit_length()
    # Where the token that starts here ends, and where the one before it starts.
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = ranks.get
    nodes = [none] * (2 * size)
    for i in range(n - 1):
        if (r := rank(piece[i : i + 2])) is not None:
            nodes[size + i] = r * n + i
    for at in range(size - 1, 0, -1):
        left, right = nodes[2 * at], nodes[2 * at + 1]
        nodes[at] = left if left < right else right
    while (least := nodes[1]) != none:
        i = least % n
        swallowed = end[i]
        after = end[i] = end[swallowed]
        if after < n:
            before[after] = i
        # The live neighbours' pairs anew; the swallowed token begins none any more.
        for start in (swallowed, i, before[i]):
            if start < 0:
                continue
            key, middle = none, end[start]
            if start != swallowed and middle < n and end[middle] - start <= longest:
                if (r := rank(piece[start : end[middle]])) is not None:
                    key = r * n + start
            at = size + start
            nodes[at] = key
            while at > 1:
                left, right = nodes[at & -2], nodes[at | 1]
                at >>= 1
                if right < left:
                    left = right
                if nodes[at] == left:
                    break
                nodes[at] = left
    out, at = [], 0
    while at < n:
        out.append(piece[at : end[at]])
        at = end[at]
    return out


class PairRanks:
    """Ranks of pairs of token ids, for many pairs at once.

    Joining two tokens gives the token whose bytes are theirs, so its rank depends on the ids alone.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = [
            (left, right, rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        ]
        table = np.array(pairs, np.int64).reshape(-1, 3)
        keys = table[:, 0] << 32 | table[:, 1]
        order = np.argsort(keys)
        # One more entry than keys, so that a place found is always one of the table.
        self.keys, self.ranks = np.r_[keys[order], -1], np.r_[table[order, 2], 0]
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def find(self, left: np.ndarray, right: np.ndarray, none: int, size: int, place: np.ndarray) -> np.ndarray:
        """rank * size + place of each pair, or ``none``."""
        wanted = left << 32 | right
        at = np.searchsorted(self.keys[:-1], wanted)
        return np.where(self.keys[at] == wanted, self.ranks[at] * size + place, none)


def merged_together(pieces: list[bytes], pairs: PairRanks, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces in a row, and how many each has; pieces have up to ``size`` bytes.

    The trees of all pieces stand side by side, each with ``size`` leaves, and are merged in step.
    """
    m, none = len(pieces), size << 8 * ID_BYTES
    n = np.fromiter(map(len, pieces), np.int64, m)
    raw = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(m, size)
    token = pairs.of_byte[raw]
    place = np.arange(size)
    alive = place < n[:, None]
    after = np.tile(place + 1, (m, 1))
    before = np.tile(np.arange(-1, size), (m, 1))
    nodes = np.full((m, 2 * size), none, np.int64)
    keys = pairs.find(token[:, :-1], token[:, 1:], none, size, place[:-1])
    nodes[:, size:-1] = np.where(alive[:, 1:], keys, none)
    level = size
    while level > 1:
        nodes[:, level // 2 : level] = np.minimum(nodes[:, level : 2 * level : 2], nodes[:, level + 1 : 2 * level : 2])
        level //= 2
    live = np.flatnonzero(nodes[:, 1] < none)
    while live.size:
        least = nodes[live, 1]
        i = least % size
        swallowed = after[live, i]
        beyond = after[live, swallowed]
        token[live, i] = least // size
        alive[live, swallowed] = False
        after[live, i] = beyond
        before[live, beyond] = i
        previous = before[live, i]
        nodes[live, size + swallowed] = none
        right = np.minimum(beyond, size - 1)
        key = pairs.find(token[live, i], token[live, right], none, size, i)
        nodes[live, size + i] = np.where(beyond < n[live], key, none)
        left = np.maximum(previous, 0)
        key = pairs.find(token[live, left], token[live, i], none, size, left)
        has_left = previous >= 0
        nodes[live[has_left], size + left[has_left]] = key[has_left]
        rows = np.concatenate([live, live, live])
        at = size + np.concatenate([swallowed, i, np.where(has_left, left, i)])
        for _ in range(size.bit_length() - 1):
            at >>= 1
            nodes[rows, at] = np.minimum(nodes[rows, 2 * at], nodes[rows, 2 * at + 1])
        live = live[nodes[live, 1] < none]
    return token[alive], alive.sum(axis=1)


class Encoder(dict):
    """Pieces to packed ids; pieces seen lately are looked up, and forgotten all at once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.longest, self.pairs = max(map(len, ranks)), PairRanks(ranks)
        self.packed = {token: rank.to_bytes(ID_BYTES, "little") for token, rank in ranks.items()}

    def learn(self, pieces: set[str]) -> list[str]:
        """Work out pieces not seen yet; those too long to be remembered come back."""
        classes: dict[int, list[tuple[str, bytes]]] = {}
        long = []
        for piece in pieces:
            raw = piece.encode()
            ids = self.packed.get(raw)
            if ids is not None:
                self[piece] = ids
            elif len(raw) <= KNOWN_BYTES:
                classes.setdefault(1 << (len(raw) - 1).bit_length(), []).append((piece, raw))
            else:
                long.append(piece)
                self[piece] = b"".join(map(self.packed.__getitem__, merged(raw, self.ranks, self.longest)))
        for size, own in classes.items():
            for begin in range(0, len(own), TOGETHER):
                some = own[begin : begin + TOGETHER]
                ids, counts = merged_together([raw for _, raw in some], self.pairs, size)
                packed, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * ID_BYTES).tolist()
                for (piece, _), start, end in zip(some, [0, *ends], ends):
                    self[piece] = packed[start:end]
        return long

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        pieces = [self.find(text or "") for text in texts]
        distinct = set().union(*pieces)
        new = distinct.difference(self)
        if len(self) + len(new) > KNOWN_PIECES:
            self.clear()
            new = distinct
        long = self.learn(new)
        out = [b"".join(map(self.__getitem__, own)) for own in pieces]
        for piece in long:
            del self[piece]
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


def text_groups(texts: pa.Array) -> Iterator[list[str | None]]:
    """Texts in order, about GROUP_CHARS characters together."""
    held, size = [], 0
    for value in texts:
        text = value.as_py()
        if held and size + len(text or "") > GROUP_CHARS:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield held


_encoders: dict[str, Encoder] = {}
_tokens: dict[str, dict[int, bytes]] = {}


def worker_encoder(name: str, vocabulary: Vocabulary) -> Encoder:
    """One per Python worker and vocabulary, so that tasks share what it remembers."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(vocabulary.ranks, vocabulary.pattern)
    return _encoders[name]


def worker_tokens(name: str, vocabulary: Vocabulary) -> dict[int, bytes]:
    """Token bytes by id."""
    if name not in _tokens:
        _tokens.clear()
        _tokens[name] = {rank: token for token, rank in vocabulary.ranks.items()}
    return _tokens[name]


def split_ids(ids: bytes | None) -> list[int]:
    """Packed ids as a list."""
    if ids and len(ids) % ID_BYTES:
        raise ValueError("packed ids must be whole 32-bit integers")
    return np.frombuffer(ids or b"", "<u4").tolist()


class ByteBpe:
    """Column functions of one vocabulary, which is sent to the executors once.

    They work on whole texts of any length row by row: nothing is shuffled, repeated rows
    and null keys do not matter, an empty table stays empty, and other columns are not read.
    """

    def __init__(self, spark: SparkSession, vocabulary: Vocabulary) -> None:
        sent = spark.sparkContext.broadcast(vocabulary)
        name = uuid.uuid4().hex

        def unpacked(ids: bytes | None) -> bytes:
            tokens = worker_tokens(name, sent.value)
            return b"".join(map(tokens.__getitem__, split_ids(ids)))

        def packed(texts: pa.Array) -> Iterator[list[bytes]]:
            encoder = worker_encoder(name, sent.value)
            return (encoder.encode_all(group) for group in text_groups(texts))

        @F.arrow_udf("binary")
        def encode(texts: pa.Array) -> pa.Array:
            return pa.array([ids for group in packed(texts) for ids in group], pa.binary())

        @F.arrow_udf("binary")
        def decode(ids: pa.Array) -> pa.Array:
            return pa.array([unpacked(one.as_py()) for one in ids], pa.binary())

        @F.arrow_udf("struct<ids:binary,decoded:binary>")
        def both(texts: pa.Array) -> pa.Array:
            ids = [one for group in packed(texts) for one in group]
            back = pa.array([unpacked(one) for one in ids], pa.binary())
            return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), back], ["ids", "decoded"])

        self._encode, self._decode, self._both = encode, decode, both

    def encode(self, text: Column) -> Column:
        """Packed ids of a text; null reads as the empty text, which has none.

        Special tokens are not known: their strings are ordinary text.
        """
        return self._encode(text)

    def round_trip(self, text: Column) -> Column:
        """(ids, decoded) of a text: what ``encode`` gives, and what ``decode`` makes of that, in one pass."""
        return self._both(text)

    def decode(self, ids: Column) -> Column:
        """The bytes of packed ids; null reads as no ids.  An id without a token is an error."""
        return self._decode(ids)


def token_count(ids: Column) -> Column:
    return (F.octet_length(ids) / ID_BYTES).cast("bigint")

