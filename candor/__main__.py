"""Run an experiment from the command line or with spark-submit.

    python -m candor --train train.parquet --key index --out results
    python -m candor --base folder --key index --out results

With --base, the split files are found in the folder and the columns by their names.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from candor.operators.roles import detect_label_column, select_text_column
from candor.plans.experiment import run_experiment, write_results
from candor.plans.loading import load_dataset
from candor.plans.models import four_models, three_models
from candor.sources.tables import read_table


def main() -> None:
    parser = argparse.ArgumentParser(prog="candor", description=__doc__)
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--train", help="Parquet table of labelled texts")
    source.add_argument("--base", help="folder with train and test split files")
    parser.add_argument("--test", help="Parquet test table; without it test rows are held out")
    parser.add_argument("--key", required=True, help="column that identifies a row")
    parser.add_argument("--text", help="text column; chosen by length if absent")
    parser.add_argument("--label", help="label column; found by name if absent")
    parser.add_argument("--models", choices=("three", "four"), default="four")
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--copies", type=int, default=0, help="varied copies of the smallest class")
    parser.add_argument("--out", required=True, help="folder for all results")
    args = parser.parse_args()

    spark = SparkSession.builder.appName("candor").getOrCreate()
    if args.base:
        data = load_dataset(spark, args.key, args.base)
        train, test, text, label = data.train, data.test, "text", "label"
    else:
        train = read_table(spark, args.train, spread=True)
        test = read_table(spark, args.test, spread=True) if args.test else None
        text = args.text or select_text_column(train)
        label = args.label or detect_label_column(train.drop(args.key), text)
    specs = four_models() if args.models == "four" else three_models()
    run = run_experiment(train, args.key, text, label, specs, test, args.seed, args.copies)
    source = test if test is not None else train
    write_results(run, source, args.key, text, label, args.out)
    run.comparison.orderBy("model_rank").drop("model_rank").show(truncate=False)


if __name__ == "__main__":
    main()
