"""From files to standard train and test tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from candor.operators.labels import class_table, encode_labels, valid_labels
from candor.operators.roles import detect_columns, standardize
from candor.sources.tables import find_split_files, read_table


@dataclass(frozen=True)
class Dataset:
    """(key, text, label, label_id) tables, and the class table of the train labels."""

    train: DataFrame
    test: DataFrame
    classes: DataFrame


def load_dataset(
    spark: SparkSession,
    key: str,
    base_path: str = ".",
    train_path: str | None = None,
    test_path: str | None = None,
) -> Dataset:
    """Read both splits and detect the text and label columns on the train split.

    Paths that are not given are looked for under ``base_path``.  Rows with a
    blank label are dropped; a test label that train lacks is an error.
    """
    if train_path is None or test_path is None:
        found = find_split_files(spark, base_path)
        train_path, test_path = train_path or found["train"], test_path or found["test"]
    train, test = (read_table(spark, p, spread=True) for p in (train_path, test_path))
    columns = detect_columns(train, [key])
    shaped = [valid_labels(standardize(df, [key], columns)) for df in (train, test)]
    if any(df.isEmpty() for df in shaped):
        raise ValueError("a split has no row with a label")
    classes = class_table(shaped[0])
    return Dataset(*[encode_labels(df, classes) for df in shaped], classes)
