"""URL verdicts: a few rules by host and path, else a cascade of Bloom filters.

A filter of the first level holds the listed keys.  Keys of the corpus that pass
it by mistake go into the second level, listed keys that pass that one by mistake
into the third, and so on until no key passes wrongly.  As the corpus's keys are
all known, the cascade answers exactly for each of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.llm.shared import ascii_lower, column, keep

MAX_LEVELS = 64
# A cascade serves at most this many listed keys; more are split over several by hash.
KEYS_PER_CASCADE = 4_000_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest rule (``host/path``) whose host is this one or above it and whose path starts it."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _slot(key: Column, seed: Column | int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed) if isinstance(seed, int) else seed, key), F.lit(bits))


def _slots(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    return [_slot(key, 1000 * level + i, bits) for i in range(hashes)]


class Level:
    """One Bloom filter: a one-row table with its bits as an array of longs."""

    def __init__(self, keys: DataFrame, level: int, n: int, rate: float):
        self.level = level
        self.hashes = max(1, round(-math.log2(rate)))
        words = max(1, math.ceil(n * self.hashes / math.log(2) / 64))
        self.bits = 64 * words
        slots = F.explode(F.array(*_slots(F.col("key"), level, self.hashes, self.bits)))
        set_bits = keys.select(slots.alias("s")).select(
            F.shiftright("s", 6).alias("w"),
            F.expr("shiftleft(1L, cast(s & 63 AS int))").alias("b"),
        )
        per_word = set_bits.groupBy("w").agg(F.bit_or("b").alias("b"))
        # At most bits / 64 entries, whatever the number of rows: a bound set by n.
        packed = per_word.agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m"))
        filled = F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.lit(words - 1).cast("bigint")),
            lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint")),
        )
        self.table = keep(packed.select(filled.alias("bits")), "bloom-level")

    def holds(self, key: Column) -> Column:
        """Whether the key passes; the bits come from a scalar subquery."""
        bits = self.table.scalar()
        passed = F.lit(True)
        for slot in _slots(key, self.level, self.hashes, self.bits):
            word = F.element_at(bits, (F.shiftright(slot, 6) + 1).cast("int"))
            passed &= F.expr("1L") == (
                F.call_function("shiftrightunsigned", word, slot.bitwiseAND(F.lit(63)).cast("int"))
            ).bitwiseAND(F.lit(1).cast("bigint"))
        return passed


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels that tell listed keys from all other keys of the universe.

    Both tables have one column ``key`` of distinct, non-null values, and listed keys
    need not be in the universe.  Every level but the first halves what passes.
    """
    inside, n_inside = listed, listed.count()
    others = universe.join(listed, "key", "left_anti")
    outside = keep(others, "cascade-others")
    n_outside = outside.count()
    levels: list[Level] = []
    if not n_inside:
        return levels
    rate = min(0.5, max(2.0**-20, n_inside / (math.sqrt(2) * max(1, n_outside))))
    while n_inside:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade does not shrink")
        level = Level(inside, len(levels) + 1, n_inside, rate if not levels else 0.5)
        levels.append(level)
        passed = keep(outside.where(level.holds(F.col("key"))), "cascade-passed")
        # What passed by mistake is what the next level holds.
        inside, outside = passed, inside
        n_inside, n_outside = passed.count(), n_inside
    return levels


def in_cascade(levels: Sequence[Level], key: Column) -> Column:
    """Membership: the number of levels passed from the first on is odd."""
    answer = F.lit(False)
    for i, level in reversed(list(enumerate(levels))):
        # Failing level i: not listed if the level holds listed keys, listed if it holds others.
        failed = F.lit(i % 2 == 1)
        after = answer if i + 1 < len(levels) else F.lit(i % 2 == 0)
        answer = F.when(level.holds(key), after).otherwise(failed)
    return answer


def filter_by_list(
    df: DataFrame, key: Column, listed: DataFrame, name: str = "listed",
    keys_per_cascade: int = KEYS_PER_CASCADE,
) -> DataFrame:
    """Add the boolean ``name``: whether the row's key is in ``listed`` (one column, any name).

    Exact for every row, since the universe is all keys of ``df``; the rows meet no
    join.  A null key is not listed, and null or repeated listed keys count for
    nothing more.  Without listed keys the answer is false everywhere.  An input
    column called ``name`` is replaced.  Lists longer than ``keys_per_cascade`` are
    split by hash into groups with a cascade each, of which every row asks one.
    """
    wanted = keep(listed.select(F.col(f"`{listed.columns[0]}`").cast("string").alias("key"))
                  .dropna().distinct(), "listed")
    universe = keep(df.select(key.cast("string").alias("key")).dropna().distinct(), "universe")
    groups = max(1, -(-wanted.count() // keys_per_cascade))
    of = F.pmod(F.xxhash64(F.lit(7), key.cast("string")), F.lit(groups))
    kinds = [F.pmod(F.xxhash64(F.lit(7), F.col("key")), F.lit(groups)) == g for g in range(groups)]
    answer = F.lit(False)
    for g, kind in enumerate(kinds):
        levels = build_cascade(wanted.where(kind), universe.where(kind))
        found = in_cascade(levels, key.cast("string"))
        answer = found if groups == 1 else F.when(of == g, found).otherwise(answer)
    return df.withColumn(name, F.coalesce(answer & key.isNotNull(), F.lit(False)))
