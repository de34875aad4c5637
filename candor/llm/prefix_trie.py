"""The trie of conversations by their turns, with totals of every subtree.

A node is a distinct sequence of first turns.  It is named by 128 bits: the sum of a hash of
(place, turn) over its turns, so that prefixes add up block by block and no task has to see
a whole conversation.  Its row is an aggregate over the conversations that begin with it.

Subtree totals go up by time-forward processing.  The trie is cut into shards: subtrees of
at most ``mass`` turns (light), and what is above them (heavy), cut again every ``mass`` levels.
Within a shard the nodes are sorted externally in reverse level order, and each sends its totals to
its parent through a priority queue that spills.  The roots of light shards send theirs to the
heavy nodes, summed by receiver; the heavy shards' sums go up the tree of shard roots in the
same way, and then every heavy shard knows what comes from below and is worked through once.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.llm.shared import column, keep, word_count

BLOCK_TURNS = 1024
# A light subtree has at most this many turns, or this share of all turns if that is more.
LEAST_MASS = 256
MASS_SHARE = 1024
# Messages that a queue holds in memory, and how many are written and read at once.
HELD_MESSAGES = 500_000
SPILL_BATCH = 10_000
PIECE_BYTES = 65_536
BATCH_ROWS = 20_000
ROOT = 0


# --- conversations as blocks of turns ---------------------------------------------------


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for role and text; null reads as the empty text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)


def turn_blocks(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    size: int = BLOCK_TURNS,
) -> DataFrame:
    """(conv, start, first, total, digests, words): conversations as blocks of up to ``size`` turns.

    Turns are ordered by ``turn``, null first, and equal ones by their digest.  ``start`` is the number
    of turns before the block and ``total`` that of the conversation.  Every conversation
    has one block that is ``first``.  Rows without a conversation are in none.

    Turns are sorted by ranges, so a conversation of any length is spread over tasks; only the
    first and the last conversation of a task can go on in another, and their offsets
    are two rows a task.
    """
    turns = df.where(column(conv).isNotNull()).select(
        column(conv).cast("bigint").alias("conv"), column(turn).alias("turn"),
        turn_digest(column(role), column(text)).alias("digest"), word_count(column(text)).alias("words"),
    )
    # The draw only parts rows that are equal in all columns.
    order = ["conv", "turn", "digest", "draw"]
    dealt = turns.withColumn("draw", F.rand(13)).repartitionByRange(*order).sortWithinPartitions(*order)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("part", pa.int32()), ("conv", pa.int64()), ("nth", pa.int64()), ("edge", pa.bool_()),
             ("here", pa.int64()), ("digests", pa.list_(pa.binary())), ("words", pa.list_(pa.int64()))]
        )
        rows: list[dict] = []
        first = last = None
        nth = done = 0
        part, digests, words = 0, [], []

        def block(edge: bool, here: int) -> dict:
            return {"part": part, "conv": last, "nth": nth, "edge": edge, "here": here,
                    "digests": digests, "words": words}

        for batch in batches:
            for part_, c, digest, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                part = part_
                if c != last and last is not None:
                    # ``here`` is told by the last block: the turns of the conversation in this task.
                    rows.append(block(last == first, done))
                    nth, done, digests, words = 0, 0, [], []
                elif len(digests) == size:
                    rows.append(block(last == first, 0))
                    nth, digests, words = nth + 1, [], []
                first, last = c if first is None else first, c
                digests.append(digest)
                words.append(n)
                done += 1
            if len(rows) >= BATCH_ROWS // 10:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if last is not None:
            rows.append(block(True, done))
        yield pa.RecordBatch.from_pylist(rows, schema)

    numbered = dealt.select(F.spark_partition_id().alias("part"), "conv", "digest", "words").mapInArrow(
        blocks,
        "part int, conv bigint, nth bigint, edge boolean, here bigint, digests array<binary>, words array<bigint>",
    )
    numbered = keep(numbered, "turn-blocks")
    # Only the first and the last conversation of a task can have turns in others.
    shares = numbered.where("here > 0")
    own = Window.partitionBy("conv")
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    across = shares.where("edge").select(
        "conv", "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("offset"),
        F.sum("here").over(own).alias("total"),
    )
    inside = shares.where("not edge and nth > 0").select(
        "conv", "part", F.lit(0).cast("bigint").alias("offset"), F.col("here").alias("total")
    )
    whole = "not edge and nth = 0 and here > 0"
    alone = numbered.where(whole).select(
        "conv", F.lit(0).cast("bigint").alias("start"), F.col("here").alias("total"), "digests", "words"
    )
    parted = numbered.where(f"not ({whole})").join(across.unionByName(inside), ["conv", "part"]).select(
        "conv", (F.col("offset") + F.col("nth") * size).alias("start"), "total", "digests", "words"
    )
    return alone.unionByName(parted).withColumn("first", F.col("start") == 0)


# --- nodes ------------------------------------------------------------------------------

LIMB = (1 << 32) - 1
LIMBS = [f"limb{i}" for i in range(4)]


def place_hash(place: int, digest: bytes) -> int:
    """128 bits of a turn at a place, counted from 1."""
    return int.from_bytes(hashlib.blake2b(place.to_bytes(8, "big") + digest, digest_size=16).digest(), "big")


def block_hash(start: int, digests: list[bytes]) -> int:
    return sum(place_hash(start + i, digest) for i, digest in enumerate(digests, 1)) % (1 << 128)


def signed(bits: int) -> int:
    """64 bits as a bigint."""
    return bits - (1 << 64) if bits >> 63 else bits


def carried(blocks: DataFrame) -> DataFrame:
    """Blocks with the sum of the hashes of all turns before them, in limbs of 32 bits.

    A conversation of one block carries nothing.  Of the others one row a block is summed.
    """
    alone = "first and size(digests) = total"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, digests = batch.column("start").to_pylist(), batch.column("digests").to_pylist()
            hashes = [block_hash(s, d) for s, d in zip(starts, digests)]
            limbs = [pa.array([h >> 32 * i & LIMB for h in hashes], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *limbs], ["conv", "start", "first", *LIMBS])

    parted = blocks.where(f"not ({alone})")
    of_block = parted.select("conv", "start", "first", "digests").mapInArrow(
        sums, "conv bigint, start bigint, first boolean, " + ", ".join(f"{x} bigint" for x in LIMBS)
    )
    # A first block without turns has the start of the second, and adds nothing.
    before = Window.partitionBy("conv").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    carry = of_block.select("conv", "start", "first", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(x) for x in LIMBS])
    zero = {x: F.lit(0).cast("bigint") for x in LIMBS}
    return blocks.where(alone).withColumns(zero).unionByName(parted.join(carry, ["conv", "start", "first"]))


ROWS = pa.schema([(x, pa.int64()) for x in ("a", "b", "pa", "pb", "depth", "conv", "words", "below")])
ROWS_DDL = ", ".join(f"{x} bigint" for x in ROWS.names)


def prefixes(blocks: DataFrame) -> DataFrame:
    """One row per conversation and prefix: node (a, b), its parent, and the turns from it on, itself included.

    The root counts as a turn here.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for conv, start, first, total, digests, words, *limbs in zip(*(c.to_pylist() for c in batch.columns)):
                at = sum(limb << 32 * i for i, limb in enumerate(limbs)) % (1 << 128)
                here = signed(at >> 64), signed(at & (1 << 64) - 1)
                if first:
                    out.append((ROOT, ROOT, ROOT, ROOT, 0, conv, 0, total + 1))
                for depth, (digest, n) in enumerate(zip(digests, words), start + 1):
                    at = (at + place_hash(depth, digest)) % (1 << 128)
                    parent, here = here, (signed(at >> 64), signed(at & (1 << 64) - 1))
                    out.append((*here, *parent, depth, conv, n, total - depth + 1))
                if len(out) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=ROWS)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=ROWS)

    return carried(blocks).select("conv", "start", "first", "total", "digests", "words", *LIMBS).mapInArrow(expand, ROWS_DDL)


def trie_nodes(rows: DataFrame) -> DataFrame:
    """One row per node: its smallest conversation, how many begin with it, and the turns in all of them from it on."""
    return rows.groupBy("a", "b").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.sum("below").alias("mass"),
        *[F.min(x).alias(x) for x in ("pa", "pb", "depth", "words")],
    )


# --- totals of subtrees -----------------------------------------------------------------


class SpillingQueue:
    """A priority queue of tuples, least first; beyond ``held`` of them the greater half goes to disk.

    A spilled half is a sorted run in a file without a name, scratch of the one task that has
    it open, as Spark's own sorts make; runs are merged as they are read.
    """

    def __init__(self, held: int = HELD_MESSAGES) -> None:
        self.held, self.heap, self.runs, self.spills = held, [], [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.held:
            self.heap.sort()
            half = len(self.heap) // 2
            run = self._read(self._written(self.heap[half:]))
            # A sorted list is a heap.
            del self.heap[half:]
            heapq.heappush(self.runs, (next(run), self.spills, run))
            self.spills += 1

    @staticmethod
    def _written(items: list[tuple]):
        file = tempfile.TemporaryFile()
        for begin in range(0, len(items), SPILL_BATCH):
            pickle.dump(items[begin : begin + SPILL_BATCH], file)
        file.seek(0)
        return file

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def least(self) -> tuple | None:
        """The least item, which stays."""
        if self.runs and not (self.heap and self.heap[0] <= self.runs[0][0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        item = self.least()
        if self.heap and self.heap[0] is item:
            return heapq.heappop(self.heap)
        _, nth, run = self.runs[0]
        following = next(run, None)
        if following is None:
            heapq.heappop(self.runs)
        else:
            heapq.heapreplace(self.runs, (following, nth, run))
        return item


SHARD = ["a", "b", "pa", "pb", "depth", "ca", "cb", "n_convs", "words", "kids", "leaves", "saved"]
TOTALS = pa.schema([(x, pa.int64()) for x in ("a", "b", "n_children", "n_leaves", "saved_tokens")])
TOTALS_DDL = ", ".join(f"{x} bigint" for x in TOTALS.names)


def shard_totals(nodes: DataFrame, held: int = HELD_MESSAGES) -> DataFrame:
    """(a, b, n_children, n_leaves, saved_tokens) of nodes whose parents, up to (ca, cb), are in the same shard.

    ``kids``, ``leaves`` and ``saved`` are what a node gets from outside its shard.
    """

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, out = SpillingQueue(held), []
        for batch in batches:
            for a, b, up_a, up_b, depth, ca, cb, n, words, kids, leaves, saved in zip(
                *(c.to_pylist() for c in batch.columns)
            ):
                while (message := queue.least()) and message[:3] == (-depth, a, b):
                    queue.pop()
                    kids, leaves, saved = kids + 1, leaves + message[3], saved + message[4]
                leaves = leaves if kids else 1
                saved += (n - 1) * words
                out.append((a, b, kids, leaves, saved))
                if (a, b) != (ca, cb):
                    queue.push((1 - depth, up_a, up_b, leaves, saved))
            if len(out) >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=TOTALS)
                out = []
        if queue.least() is not None:
            raise RuntimeError("a node's parent is not in its shard")
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=TOTALS)

    dealt = nodes.select(*SHARD).repartition("ca", "cb")
    return dealt.sortWithinPartitions(F.desc("depth"), "a", "b").mapInArrow(forward, TOTALS_DDL)


def received(messages: DataFrame) -> DataFrame:
    """(a, b, kids, leaves, saved) that nodes get, from rows (pa, pb, n_leaves, saved_tokens) of children."""
    return messages.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )


def with_received(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    got = nodes.join(received(messages), ["a", "b"], "left")
    return got.withColumns({x: F.coalesce(x, F.lit(0)) for x in ("kids", "leaves", "saved")})


def light_shards(nodes: DataFrame, rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """Light nodes with the root (ca, cb) of their shard: the first light node on their way from the root."""
    light_rows = rows.join(heavy.select("a", "b"), ["a", "b"], "left_anti")
    roots = light_rows.groupBy("conv").agg(F.min_by("a", "depth").alias("ca"), F.min_by("b", "depth").alias("cb"))
    return nodes.where("not heavy").join(roots, "conv")


def heavy_shards(heavy: DataFrame, rows: DataFrame, levels: int) -> DataFrame:
    """Heavy nodes with the root (ca, cb) of their shard: their ancestor at the next multiple of ``levels``."""
    tops = rows.where(F.col("depth") % levels == 0).select(
        "conv", F.col("depth").alias("top"), F.col("a").alias("ca"), F.col("b").alias("cb")
    )
    top = F.col("depth") - F.col("depth") % levels
    low = heavy.withColumn("top", top)
    first = low.where("top = 0").withColumns({x: F.lit(ROOT).cast("bigint") for x in ("ca", "cb")})
    return first.unionByName(low.where("top > 0").join(tops, ["conv", "top"]).select(first.columns))


def subtree_totals(nodes: DataFrame, rows: DataFrame, mass: int) -> DataFrame:
    """(a, b, n_children, n_leaves, saved_tokens) of all nodes."""
    heavy = keep(nodes.where("heavy"), "heavy-nodes")
    none = {x: F.lit(0).cast("bigint") for x in ("kids", "leaves", "saved")}
    light = keep(light_shards(nodes, rows, heavy), "light-shards")
    below = keep(shard_totals(light.withColumns(none)), "light-totals")
    light_roots = light.where("a = ca and b = cb").select("a", "b", "pa", "pb")
    upward = keep(light_roots.join(below, ["a", "b"]).select("pa", "pb", "n_leaves", "saved_tokens"), "to-heavy")

    above = keep(heavy_shards(heavy, rows, mass), "heavy-shards")
    # What a heavy shard's own nodes and the light shards under them add up to.
    leaf = above.join(above.select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> 0 or b <> 0"), ["a", "b"], "left_anti")
    leaf = leaf.join(upward.select(F.col("pa").alias("a"), F.col("pb").alias("b")), ["a", "b"], "left_anti")
    leaf = leaf.select("ca", "cb", F.lit(1).cast("bigint").alias("leaves"), F.lit(0).cast("bigint").alias("saved"))
    got = with_received(above, upward).select(
        "ca", "cb", "leaves", (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved")
    )
    sums = got.unionByName(leaf).groupBy("ca", "cb").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    # The tree of shard roots: the parent of a root lies in another shard, whose root is its parent here.
    tops = above.where("a = ca and b = cb").select("a", "b", "pa", "pb", F.col("top").alias("depth"))
    inner = above.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("ca").alias("ra"), F.col("cb").alias("rb"))
    tree = tops.join(inner, ["pa", "pb"]).join(sums.withColumnsRenamed({"ca": "a", "cb": "b"}), ["a", "b"])
    tree = keep(tree, "shard-roots")
    root = F.lit(ROOT).cast("bigint")
    one = F.lit(1).cast("bigint")
    # Depth in bands of levels, so that a parent is one above its children.
    across = shard_totals(
        tree.select(
            "a", "b", F.col("ra").alias("pa"), F.col("rb").alias("pb"), (F.col("depth") / mass).cast("bigint").alias("depth"),
            root.alias("ca"), root.alias("cb"), one.alias("n_convs"), F.lit(0).cast("bigint").alias("words"),
            one.alias("kids"), "leaves", "saved",
        )
    )
    from_shards = tree.where("depth > 0").select("a", "b", "pa", "pb").join(across, ["a", "b"])
    messages = upward.unionByName(from_shards.select("pa", "pb", "n_leaves", "saved_tokens"))
    return below.unionByName(shard_totals(with_received(above, messages)))


# --- the trie ---------------------------------------------------------------------------

NO_ENDS = hashlib.sha256(b"").hexdigest()


def end_hashes(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) from (a, b, conv): SHA-256 of the conversations in ascending order, comma-joined.

    Sorted by ranges first, so that one node's many conversations reach the task that hashes
    them as few long pieces, which it reads one after the other.
    """
    order = ["a", "b", "conv"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, 0, [], 0
        out: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            columns = zip(*out)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(columns, types)], ["a", "b", "first", "piece"]
            )
            out.clear()

        for batch in batches:
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != key or size > PIECE_BYTES:
                    if held:
                        out.append((*key, first, ",".join(held).encode()))
                        if len(out) >= 1000:
                            yield from flush()
                    key, first, held, size = (a, b), conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            out.append((*key, first, ",".join(held).encode()))
        if out:
            yield from flush()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for a, b, _, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) == key:
                    state.update(b",")
                else:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                state.update(piece)
            yield rows_of(done)
        if key:
            yield rows_of([(*key, state.hexdigest())])

    def rows_of(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) or [(), (), ()]
        types = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], ["a", "b", "ends_sha256"])

    dealt = ends.select(order).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = dealt.mapInArrow(pieces, "a bigint, b bigint, first bigint, piece binary")
    sorted_parts = parts.repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return sorted_parts.mapInArrow(hashes, "a bigint, b bigint, ends_sha256 string")


def prefix_trie(blocks: DataFrame, mass: int | None = None) -> DataFrame:
    """The trie of conversations given as blocks of turns (``turn_blocks``), a row per node.

    conv_id and depth name a node: the first ``depth`` turns of its smallest conversation.  The root
    has depth 0.  parent_conv_id is its parent's conv_id, null for the root; n_convs
    counts the conversations that begin with it, n_children its children, n_leaves the nodes without
    children in its subtree, and saved_tokens adds up (n_convs - 1) times the words of the
    last turn over its subtree, the node included.  ends_sha256 is the SHA-256 of
    the conversations that are the node, ascending and comma-joined.

    No conversations give no rows, not even a root; conversations without turns are the root.
    ``mass`` is the number of turns a light shard may have, by default a share of all.
    """
    blocks = keep(blocks, "trie-blocks")
    if mass is None:
        turns = blocks.agg(F.sum(F.size("digests"))).first()[0] or 0
        mass = max(LEAST_MASS, turns // MASS_SHARE)
    rows = keep(prefixes(blocks), "trie-rows")
    heavy = (F.col("mass") > mass) | (F.col("depth") == 0)
    nodes = keep(trie_nodes(rows).withColumn("heavy", heavy), "trie-nodes")
    totals = keep(subtree_totals(nodes, rows, mass), "trie-totals")
    ends = end_hashes(rows.where("below = 1"))

    # Children of heavy nodes can be many, and heavy nodes are few; light ones have few children.
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent_conv_id"), "heavy")
    few = parents.where("heavy").drop("heavy")
    narrow = nodes.drop("heavy", "mass")
    under_heavy = narrow.join(few, ["pa", "pb"])
    under_light = narrow.join(parents.where("not heavy").drop("heavy"), ["pa", "pb"])
    named = under_heavy.unionByName(under_light)
    return named.join(totals, ["a", "b"]).join(ends, ["a", "b"], "left").select(
        F.col("conv").alias("conv_id"), "depth",
        F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
