"""Side tables: one row per class, model or the like."""

from __future__ import annotations

from pyspark.sql import DataFrame

from candor.sources.staging import stage


def small_table(df: DataFrame) -> DataFrame:
    """Compute a side table once, for any number of uses.

    It is read back from the shared folder with its size known: Spark broadcasts it up to
    ``spark.sql.autoBroadcastJoinThreshold`` and joins by shuffle beyond, and nothing of
    it passes through the driver's Python.
    """
    return stage(df, "side")
