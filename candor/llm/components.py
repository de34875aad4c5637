"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.shared import keep

MAX_ROUNDS = 100


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node reachable.

    Large-star and small-star steps in turn: the first hangs every larger neighbour of a
    node on its smallest one, the second every smaller neighbour and the node itself.
    Edges never grow in number, a hub's neighbours are summed before the shuffle, and
    the number of rounds grows with the logarithm of the table.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: all edges point from the larger to the smaller node.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(down, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))
                )
            ).alias("e")
        ).select("e.u", "e.v").where("u <> v").distinct()
        edges = keep(moved, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v"), F.col("v")).distinct()
            )
        state = now
    raise RuntimeError("components did not settle")
