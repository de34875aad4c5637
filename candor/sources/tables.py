"""Scans, result-table sinks and the discovery of split files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Where split files are looked for, relative to a base path, and their names.
SPLIT_FOLDERS = (".", "data")
SPLIT_FILE = "{split}-00000-of-00001.parquet"


def read_table(spark: SparkSession, path: str, spread: bool = False) -> DataFrame:
    """Parquet scan; with ``spread``, a very small table is spread over all cores.

    A Parquet file splits only between row groups, so a small table written as
    one row group would run its whole text work in one task.
    """
    df = spark.read.parquet(path)
    return spread_over_cores(df) if spread else df


def spread_over_cores(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one partition per core, if that moves little.

    Little is what Spark charges for opening one file, for each core
    (``spark.sql.files.openCostInBytes``): Spark would not split such a table further.
    Larger tables split by themselves and are never shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    little = cores * spark._jsparkSession.sessionState().conf().filesOpenCostInBytes()
    if size > little or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def find_split_files(
    spark: SparkSession, base_path: str, folders: Sequence[str] = SPLIT_FOLDERS
) -> dict[str, str]:
    """Paths of the train and test files; the last folder that has one wins.

    The role comes from the file name only, so a folder called ``train`` or
    ``latest`` cannot change it.
    """
    found: dict[str, str] = {}
    for folder in folders:
        parent = base_path if folder == "." else f"{base_path}/{folder}"
        for split in ("train", "test"):
            path = f"{parent}/{SPLIT_FILE.format(split=split)}"
            if _path_exists(spark, path):
                found[split] = path
    missing = {"train", "test"} - set(found)
    if missing:
        raise FileNotFoundError(f"no {' and '.join(sorted(missing))} file under {base_path}")
    return found


def write_csv(df: DataFrame, path: str, *, partition_by: tuple[str, ...] = ()) -> None:
    """CSV with a header line; quotes are doubled, so any text survives a round trip."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, *, line_breaks: bool = False
) -> DataFrame:
    """CSV with a header line.

    With ``line_breaks``, values may hold line breaks; a file is then read by one task, so
    this is for tables of bounded size.  Tables with a row per document belong in Parquet.
    """
    reader = spark.read.schema(schema).option("header", True).option("escape", '"')
    return reader.option("multiLine", line_breaks).csv(path)


def write_json(df: DataFrame, path: str, *, partition_by: tuple[str, ...] = ()) -> None:
    """One JSON object per line."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.json(path)


def one_json_document(sections: Mapping[str, DataFrame]) -> DataFrame:
    """One row with a JSON object that holds each section's rows as an array.

    Sections come in the order given, rows in the order of their table.  For result
    tables of bounded size: every section must already be aggregated.
    """
    parts = [
        df.select(
            F.lit(place).alias("place"), F.lit(name).alias("section"),
            F.struct(
                F.monotonically_increasing_id().alias("at"),
                F.to_json(F.struct(*df.columns)).alias("row"),
            ).alias("row"),
        )
        for place, (name, df) in enumerate(sections.items())
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    ordered = F.transform(F.sort_array(F.collect_list("row")), lambda r: r["row"])
    per_section = rows.groupBy("place", "section").agg(
        F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")).alias("rows")
    )
    text = F.concat(F.lit('"'), F.col("section"), F.lit('":'), F.col("rows")).alias("text")
    fields = F.sort_array(F.collect_list(F.struct("place", text)))
    joined = F.array_join(F.transform(fields, lambda f: f["text"]), ",")
    return per_section.agg(F.concat(F.lit("{"), joined, F.lit("}")).alias("document"))
