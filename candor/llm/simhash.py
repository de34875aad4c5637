"""SimHash near-duplicates by a generalised pigeonhole search, and their groups.

Two fingerprints at most ``radius`` bits apart, cut into m parts, agree to within t_i bits on
some part i whenever the t_i + 1 add up to radius + 1.  Bits that vary together are put into
one part, and a dynamic programme shares the thresholds out by the number of candidates that
each part and threshold would bring, estimated over all fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.llm.components import components
from candor.llm.shared import ASCII_LOWER, column, fresh, keep

BITS = 64
SHINGLE = 3
SEED = 42
RADIUS = 3
# Fingerprints of one bucket that are compared in one step; larger buckets are cut into blocks.
BLOCK = 1024


def text_fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash over word shingles, repeats included, A-Z lower-cased.

    A bit is set if more than half of the shingles' hashes have it.  With fewer words
    than a shingle the whole sequence is the one shingle; without words it is zero.
    """
    words = (text or "").encode().translate(ASCII_LOWER).split()
    if not words:
        return 0
    width = min(shingle, len(words))
    n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    columns = [words[j : j + n] for j in range(width)]
    hashes = np.fromiter((digest(b" ".join(s), seed) for s in zip(*columns)), np.uint64, n)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, 4096):
        part = hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprint(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint as a bigint with the same 64 bits."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        found = [text_fingerprint(t.as_py(), shingle, seed) for t in texts]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return of(text)


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- parts and thresholds ---------------------------------------------------------------


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set (64 x 64)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            values = batch.column(0).to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(values, axis=1).astype(np.float64)
            both += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[i, -1]), pa.array(np.r_[j, -1]), pa.array(np.r_[both[i, j], n])],
            ["i", "j", "n"],
        )

    cells = fps.select("fp").mapInArrow(count, "i bigint, j bigint, n bigint")
    # 2,081 numbers, whatever the input.
    rows = cells.groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r["i"] < 0:
            n = r["n"]
        else:
            both[r["i"], r["j"]] = both[r["j"], r["i"]] = r["n"]
    return n, both


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m parts of even size; each takes the bit that correlates most with those it has.

    Bits count from 0, the highest.
    """
    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread))
    left = set(range(BITS))
    parts = []
    for i in range(m):
        size = BITS // m + (i < BITS % m)
        # The bit with the most correlation left starts the part.
        own = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.discard(own[0])
        while len(own) < size:
            best = max(sorted(left), key=lambda b: corr[b, own].sum())
            own.append(best)
            left.discard(best)
        parts.append(sorted(own))
    return parts


def part_masks(parts: list[list[int]]) -> list[int]:
    return [sum(1 << (BITS - 1 - b) for b in part) for part in parts]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def share_thresholds(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = radius + 1 at least cost.

    ``costs[i][t]`` is the cost of threshold t on part i; -1 skips the part for nothing.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        found: dict[int, tuple[float, list[int]]] = {}
        for used, (spent, chosen) in best.items():
            for t in range(-1, len(cost)):
                total = used + t + 1
                price = spent + (cost[t] if t >= 0 else 0.0)
                if total <= radius + 1 and (total not in found or price < found[total][0]):
                    found[total] = (price, [*chosen, t])
        best = found
    return best[radius + 1]


def plan_search(fps: DataFrame, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(mask, threshold) of the parts to probe, the cheapest over 2, 3 or 4 parts.

    The number of equal pairs in a part is counted over all fingerprints; pairs one bit
    apart follow from it and from how often each bit differs.
    """
    n, both = bit_moments(fps)
    p = np.diag(both) / max(1, n)
    agree = p**2 + (1 - p) ** 2
    layouts = {m: correlated_parts(n, both, m) for m in range(2, radius + 2)}
    flat = [(m, i, mask) for m, parts in layouts.items() for i, mask in enumerate(part_masks(parts))]
    keys = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("v"))
                for k, (_, _, mask) in enumerate(flat)
            ]
        )
    )
    sizes = fps.select(keys.alias("x")).groupBy("x.k", "x.v").agg(F.count("*").alias("n"))
    pairs = sizes.groupBy("k").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs"))
    equal = {r["k"]: r["pairs"] for r in pairs.collect()}
    plans = []
    for m, parts in layouts.items():
        costs = []
        for i, part in enumerate(parts):
            k = next(k for k, f in enumerate(flat) if f[:2] == (m, i))
            same = equal.get(k, 0.0)
            near = same * (1 + sum((1 - agree[b]) / agree[b] for b in part))
            # A probe row costs about as much as a candidate.
            costs.append([same + n, near + n * (len(part) + 1)])
        price, chosen = share_thresholds(costs, radius)
        plans.append((price, list(zip(part_masks(parts), chosen))))
    return [(mask, t) for mask, t in min(plans, key=lambda x: x[0])[1] if t >= 0]


# --- probing and verifying --------------------------------------------------------------


def probe_keys(fps: DataFrame, search: list[tuple[int, int]]) -> DataFrame:
    """(part, drop, key, fp): fingerprints that share a row of the first three are candidates.

    Threshold 0 has one key per part; threshold 1 one for each bit left out.
    """
    keys = []
    for part, (mask, t) in enumerate(search):
        drops = [0] if t == 0 else [1 << b for b in range(BITS) if mask >> b & 1]
        keys += [
            F.struct(
                F.lit(part).alias("part"),
                F.lit(d).alias("drop"),
                F.col("fp").bitwiseAND(F.lit(signed(mask & ~drop))).alias("key"),
            )
            for d, drop in enumerate(drops)
        ]
    return fps.select("fp", F.explode(F.array(*keys)).alias("x")).select("x.*", "fp")


def spanning_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what pairs within the radius join; at most len(values) - 1 of them."""
    left, a, b = values, [], []
    while len(left):
        front, left = list(left[:1]), left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                hit = left[near]
                a += [at] * len(hit)
                b += list(hit)
                front += list(hit)
                left = left[~near]
    return np.array(a, np.uint64), np.array(b, np.uint64)


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints whose closure is that of all close pairs.

    ``fps`` has one column ``fp`` of distinct values.  A bucket's fingerprints meet as one
    array of at most 2 * ``block`` values: a larger bucket is cut into blocks by hash, and
    every two of its blocks meet in a row of their own, so no task gets a whole hot
    bucket and no pair is left out.
    """
    keys = probe_keys(fps, plan_search(fps, radius))
    where = ["part", "drop", "key"]
    sizes = keys.groupBy(*where).agg(F.count("*").alias("n")).where("n > 1")
    cut = F.ceil(F.col("n") / block).cast("int")
    small = keys.join(sizes, where).select(
        *where, "fp", cut.alias("blocks"), F.pmod(F.xxhash64("fp"), cut).cast("int").alias("own")
    )
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = small.withColumn("other", others).select(
        *where, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp"
    )
    rows = met.groupBy(*where, "x", "y").agg(F.collect_list("fp").alias("fps"))
    rows = rows.where(F.size("fps") > 1).select("fps")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values = lists.flatten().to_numpy().view(np.uint64)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            lengths = np.diff(ends)
            starts = ends[:-1]
            # Most buckets have two members: all of those at once.
            two = starts[lengths == 2]
            near = np.bitwise_count(values[two] ^ values[two + 1]) <= radius
            a, b = [values[two][near]], [values[two + 1][near]]
            for s, n in zip(starts[lengths > 2], lengths[lengths > 2]):
                x, y = spanning_links(values[s : s + n], radius)
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], ["a", "b"]
            )

    return rows.mapInArrow(verify, "a bigint, b bigint")


def fingerprint_roots(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(fp, root) for distinct fingerprints: the smallest one reachable over links."""
    links = keep(fingerprint_links(fps, radius, block), "fingerprint-links")
    roots = components(links, "a", "b")
    joined = fps.join(roots, fps["fp"] == roots["node"], "left")
    return joined.select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, block: int = BLOCK,
    shingle: int = SHINGLE,
) -> DataFrame:
    """One row (key, fp, component_id) per row: the smallest key reachable over links.

    Rows with equal fingerprints are linked, and so are those at most ``radius`` bits
    apart.  Null, empty and blank texts have fingerprint zero like any text without words.
    Repeated rows each get their row.  A null key is never the smallest; a component
    of null keys only has a null id.  Other columns are not read, whatever their names.
    """
    marked = df.select(column(key).alias("key"), fingerprint(column(text), shingle).alias("fp"))
    marked = keep(marked, "fingerprints")
    groups = keep(marked.groupBy("fp").agg(F.min("key").alias("least")), "fingerprint-groups")
    linked = groups.join(fingerprint_roots(groups.select("fp"), radius, block), "fp")
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = linked.join(ids, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(F.col("key").alias(key), "fp", "component_id")


def drop_near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE
) -> DataFrame:
    """The rows of ``df`` without near-duplicates: each group keeps its smallest key.

    Fingerprints of ``shingle`` words link at ``radius`` bits.  Of rows that share the kept key the one
    with the smallest content hash stays, and one of rows that are equal in all columns.
    Rows are told apart by 128 bits of content hash, so that repeated and null keys stay
    distinct.  Column names and types do not change.
    """
    row = fresh(df.columns, "row_a", "row_b")
    plain = [column(c) for c, kind in df.dtypes if not kind.startswith("map")]
    hashed = df.withColumns(dict(zip(row, (F.xxhash64(*plain), F.xxhash64(F.lit("b"), *plain)))))
    marked = keep(
        hashed.select(
            column(key).alias("key"), fingerprint(column(text), shingle).alias("fp"),
            *[column(r).alias(f"row{i}") for i, r in enumerate(row)],
        ),
        "fingerprints",
    )
    fps = keep(marked.select("fp").distinct(), "fingerprint-groups")
    best = marked.join(fingerprint_roots(fps, radius), "fp").groupBy("root").agg(
        F.min(F.struct(F.col("key").isNull(), "key", "row0", "row1")).alias("best")
    )
    kept = keep(best.select(*[F.col(f"best.row{i}").alias(r) for i, r in enumerate(row)]), "kept-rows")
    return hashed.join(kept, row, "left_semi").dropDuplicates(row).drop(*row)
