"""Which column is the text and which the label; union of drifting schemas.

Roles come from the schema alone where names decide, and from one aggregation
over all candidate columns where contents must decide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from candor.functions.text import as_text

# Name parts that mark a role, and text columns in order of preference.
TEXT_NAMES = ("question", "text", "utterance", "content", "interview_question")
LABEL_NAMES = ("label", "labels", "evasion_label", "is_evasive", "target")
TEXT_PREFERENCE = ("question", "interview_question", "interview_answer", "gpt3.5_summary")
MIN_AVERAGE_LENGTH = 20

# The canonical columns.
CANONICAL = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("title", "date", "president", "url")
    ]
    + [T.StructField("question_order", T.LongType())]
    + [
        T.StructField(name, T.StringType())
        for name in (
            "interview_question",
            "interview_answer",
            "gpt3.5_summary",
            "gpt3.5_prediction",
            "question",
            "annotator_id",
            "annotator1",
            "annotator2",
            "annotator3",
        )
    ]
    + [
        T.StructField(name, T.BooleanType())
        for name in ("inaudible", "multiple_questions", "affirmative_questions")
    ]
    + [T.StructField("index", T.LongType())]
    + [T.StructField(name, T.StringType()) for name in ("clarity_label", "evasion_label")]
)


def quoted(name: str) -> Column:
    """A column by its exact name; names may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def _string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _named(columns: Sequence[str], parts: Sequence[str]) -> list[str]:
    """Columns whose lowercase name contains one of the parts, in table order."""
    return [c for c in columns if any(p in c.lower() for p in parts)]


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, position, n_distinct) from one pass over the table.

    Values are grouped per column and value first, so no task holds a column's
    whole value set.  Values longer than a digest are compared by their SHA-256,
    so long texts are not shuffled.
    """
    columns = list(columns or df.columns)

    def short(value: Column) -> Column:
        text = value.cast("string")
        return F.when(F.length(text) > 64, F.sha2(text, 256)).otherwise(text)

    values = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.lit(i).alias("position"),
                short(quoted(c)).alias("value"),
            )
            for i, c in enumerate(columns)
        ]
    )
    rows = df.select(F.inline(values)).distinct()
    return rows.groupBy("column", "position").agg(F.count("value").alias("n_distinct"))


# Sketches of 2 ** SKETCH_BITS registers; their relative standard error is 1.04 / 2 ** (SKETCH_BITS / 2).
SKETCH_BITS = 12
SKETCH_DEVIATIONS = 6


def distinct_bounds(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, tuple[float, float]]:
    """Lower and upper bounds on each column's distinct values, nulls aside, from one pass.

    Sketches are added up by tasks, so no value is shuffled.  A bound is off with the probability of six standard
    deviations of the sketch, about one in 500 million.
    """
    columns = list(columns or df.columns)
    sketches = [
        F.hll_sketch_estimate(F.hll_sketch_agg(quoted(c).cast("string"), SKETCH_BITS)).alias(f"c{i}")
        for i, c in enumerate(columns)
    ]
    told = df.agg(*sketches).first()
    error = SKETCH_DEVIATIONS * 1.04 / 2 ** (SKETCH_BITS / 2)
    return {c: ((told[i] or 0) / (1 + error) - 1, (told[i] or 0) / (1 - error) + 1) for i, c in enumerate(columns)}


def fewest_distinct_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_distinct): the column with the fewest distinct values, counted exactly.

    Only columns that can have the fewest by their bounds are counted, so a column of keys or
    texts is sketched and never shuffled unless it comes that close.
    """
    columns = list(columns or df.columns)
    bounds = distinct_bounds(df, columns)
    least = min(high for _, high in bounds.values())
    near = [c for c in columns if bounds[c][0] <= least]
    return fewest_distinct(distinct_counts(df, near))


def fewest_distinct(counts: DataFrame) -> DataFrame:
    """The column with the fewest distinct values, the first one on a tie."""
    return counts.agg(
        F.min_by("column", F.struct("n_distinct", "position")).alias("column"),
        F.min("n_distinct").alias("n_distinct"),
    )


def detect_text_column(df: DataFrame) -> str:
    """By name among the string columns, an exact name first; else the first string column."""
    strings = _string_columns(df)
    if not strings:
        raise ValueError("the table has no string column")
    exact = [c for c in strings if c.lower() in TEXT_NAMES]
    return (exact + _named(strings, TEXT_NAMES) + strings)[0]


def detect_label_column(df: DataFrame, text: str) -> str:
    """The first column with a label name, else the one with the fewest distinct values."""
    others = [c for c in df.columns if c != text]
    if not others:
        raise ValueError("the table has no second column")
    named = _named(others, LABEL_NAMES)
    if named:
        return named[0]
    return fewest_distinct_column(df, others).first()["column"]


def detect_columns(df: DataFrame, keys: Sequence[str] = ()) -> tuple[str, str]:
    """(text column, label column), neither of them a key."""
    others = df.select(*[quoted(c) for c in df.columns if c not in keys])
    text = detect_text_column(others)
    return text, detect_label_column(others, text)


def standardize(
    df: DataFrame, keys: Sequence[str] = (), columns: tuple[str, str] | None = None
) -> DataFrame:
    """Text (null becomes empty) and label under these names, plus keys.

    ``columns`` names the two columns; without it they are detected.
    """
    text, label = columns or detect_columns(df, keys)
    return df.select(
        *[quoted(k) for k in keys], as_text(quoted(text)).alias("text"), quoted(label).alias("label")
    )


def text_column_lengths(
    df: DataFrame, candidates: Sequence[str] = TEXT_PREFERENCE
) -> DataFrame:
    """(column, position, avg_length, selected) for the candidates the table has.

    Selected is the first candidate with a mean length over 20 characters; with
    none, ``question`` or else the table's first column stands in.
    """
    present = [c for c in candidates if c in df.columns]
    fallback = "question" if "question" in df.columns else df.columns[0]
    measured = present if fallback in present else [*present, fallback]
    averages = df.agg(
        *[F.avg(F.length(as_text(quoted(c)))).alias(f"c{i}") for i, c in enumerate(measured)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.lit(i).alias("position"),
                F.col(f"c{i}").alias("avg_length"), F.lit(c in present).alias("_candidate"),
            )
            for i, c in enumerate(measured)
        ]
    )
    listed = averages.select(F.inline(rows))
    fits = F.col("_candidate") & (F.col("avg_length") > MIN_AVERAGE_LENGTH)
    # One row per candidate column.
    winner = F.min(F.when(fits, F.col("position"))).over(Window.partitionBy())
    stand_in = F.lit(measured.index(fallback))
    return listed.select(
        "column",
        "position",
        F.round("avg_length", 4).alias("avg_length"),
        (F.col("position") == F.coalesce(winner, stand_in)).alias("selected"),
    )


def select_text_column(df: DataFrame, candidates: Sequence[str] = TEXT_PREFERENCE) -> str:
    return text_column_lengths(df, candidates).where("selected").first()["column"]


def harmonize(
    df: DataFrame, label_column: str = "evasion_label", extra: Sequence[str] = ()
) -> DataFrame:
    """One schema variant in canonical names and types.

    Names match without regard to case, ``label`` goes to ``label_column``,
    and columns that are absent stay absent.  Index columns and others without
    a canonical name are dropped, but for those that ``extra`` names.  Where
    several columns have one canonical name, the first value that is not null
    counts.
    """
    types = {f.name: f.dataType for f in CANONICAL.fields}
    sources: dict[str, list[Column]] = {}
    for name in df.columns:
        target = label_column if name.lower() == "label" else name.lower()
        if name in extra:
            sources.setdefault(name, []).append(quoted(name))
        elif target in types:
            sources.setdefault(target, []).append(quoted(name).cast(types[target]))
    return df.select(*[F.coalesce(*found).alias(target) for target, found in sources.items()])


def harmonize_union(
    variants: Sequence[DataFrame],
    label_column: str = "evasion_label",
    extra: Sequence[str] = (),
) -> DataFrame:
    """All variants under each other; a column that one lacks is null there."""
    frames = [harmonize(v, label_column, extra) for v in variants]
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame, allowMissingColumns=True)
    return union
