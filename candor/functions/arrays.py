"""Array helpers that stay linear in the array length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``.

    Catalyst may inline a projected expression into a lambda, where it would be
    evaluated again for every element; a lambda variable is bound only once.
    """
    return F.transform(F.array(value), body)[0]


def run_lengths(values: Column, value_name: str, count_name: str) -> Column:
    """Distinct values of an array with their counts, ordered by value.

    Sorts inside the row and measures runs, so counting needs no shuffle.
    """

    def runs(s: Column) -> Column:
        following = F.slice(s, F.lit(2), F.size(s))
        marked = F.zip_with(
            s, following, lambda a, b: F.struct(a.alias("v"), a.eqNullSafe(b).alias("same"))
        )
        numbered = F.transform(
            marked,
            lambda x, i: F.struct(x["v"].alias("v"), (i + 1).alias("end"), x["same"].alias("same")),
        )
        return let(F.filter(numbered, lambda x: ~x["same"]), measure)

    def measure(ends: Column) -> Column:
        starts = F.concat(
            F.array(F.lit(0)),
            F.transform(
                F.slice(ends, F.lit(1), F.greatest(F.size(ends) - 1, F.lit(0))), lambda x: x["end"]
            ),
        )
        # An empty array still has one start; cut it off so that zip_with adds no null row.
        starts = F.slice(starts, F.lit(1), F.size(ends))
        return F.zip_with(
            ends,
            starts,
            lambda e, s: F.struct(
                e["v"].alias(value_name), (e["end"] - s).cast("bigint").alias(count_name)
            ),
        )

    # sort_array compares in the JVM's own order; array_sort would run a comparator lambda.
    return let(F.sort_array(values), runs)
