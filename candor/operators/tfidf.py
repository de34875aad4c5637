"""TF-IDF: vocabulary fit, weighting, and application to any split.

Only the vocabulary fit shuffles, and it shuffles partial sums per term.
Applying a vocabulary works row by row on sparse vectors: no join on terms and
no regrouping by document.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import (
    Binarizer,
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
)
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candor.functions.arrays import let
from candor.functions.text import ngrams, remove_stop_words
from candor.operators.grams import chunks
from candor.sources.staging import stage

@dataclass(frozen=True)
class TextFeatures:
    """How cleaned text becomes weighted terms.

    ``max_features`` bounds the vocabulary, which is kept on the driver and sent to
    every executor.
    """

    max_features: int
    ngram_range: tuple[int, int] = (1, 1)
    min_df: int = 1
    max_df: float = 1.0
    stop_words: tuple[str, ...] = field(default=())
    sublinear_tf: bool = False

    def __post_init__(self) -> None:
        if self.max_features < 1:
            raise ValueError("max_features must be at least 1")

    def terms(self, tokens: Column | str) -> Column:
        """The terms of a token array: stop words go first, then n-grams are formed."""
        kept = remove_stop_words(tokens, self.stop_words) if self.stop_words else tokens
        return ngrams(kept, *self.ngram_range)


def corpus_term_counts(
    df: DataFrame, tokens: Column | str, by: Sequence[str] = ()
) -> DataFrame:
    """(term, tf, df): occurrences and documents per term, and per value of ``by``.

    Terms are sorted inside each document, where the first of equal neighbours stands for the
    document.  Rows go from the sorted arrays into the aggregation in compiled code; counting
    inside the arrays would be interpreted, term by term.
    """
    terms = F.col(tokens) if isinstance(tokens, str) else tokens
    ordered = df.select(*by, F.sort_array(terms).alias("_terms"))
    # The outer form keeps Spark from adding a filter that would sort every row twice.
    each = ordered.select(*by, "_terms", F.posexplode_outer("_terms").alias("_at", "term"))
    before = F.get("_terms", F.col("_at") - 1)
    first = (F.col("_at") == 0) | ~before.eqNullSafe(F.col("term"))
    counted = each.where(F.col("term").isNotNull()).select(*by, "term", first.cast("bigint").alias("_first"))
    return counted.groupBy(*by, "term").agg(F.count("*").alias("tf"), F.sum("_first").alias("df"))


def smooth_idf(n_docs: int, df: Column) -> Column:
    return F.log((F.lit(1.0) + F.lit(n_docs)) / (F.lit(1.0) + df)) + F.lit(1.0)


def chosen_terms(counts: DataFrame, n_docs: int, spec: TextFeatures) -> pa.Table:
    """(term, term_id, tf, df, idf): at most ``max_features`` rows, by total count.

    Equal counts are cut in term order; ids follow term order.
    """
    if spec.min_df > 1:
        counts = counts.where(F.col("df") >= spec.min_df)
    if spec.max_df < 1.0:
        counts = counts.where(F.col("df") <= F.lit(spec.max_df * n_docs))
    top = counts.orderBy(F.desc("tf"), "term").limit(spec.max_features)
    kept = top.withColumn("idf", smooth_idf(n_docs, F.col("df"))).toArrow().sort_by("term")
    ids = pa.array(range(kept.num_rows), pa.int32())
    return kept.append_column("term_id", ids).select(["term", "term_id", "tf", "df", "idf"])


# Totals of so many buckets of terms are kept on the driver; and how many buckets per wanted
# term are looked into first.
TERM_BUCKETS = 1 << 18
BUCKETS_PER_TERM = 4


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def bucket_totals(df: DataFrame, terms: Column) -> np.ndarray:
    """Occurrences of all terms of each bucket: a bound on the count of each of its terms.

    A summary of fixed size that tasks and tables can add up; no term is shuffled.
    """
    # Hashed after the explosion, where Spark compiles it.
    each = df.select(F.explode_outer(terms).alias("term")).where("term is not null")
    return bucket_array(each.groupBy(term_bucket(F.col("term")).alias("b")).agg(F.count("*").alias("n")))


def bucket_array(counted: DataFrame) -> np.ndarray:
    """(b, n) as an array of all buckets."""
    told = counted.toArrow()
    totals = np.zeros(TERM_BUCKETS, np.int64)
    totals[told["b"].to_numpy()] = told["n"].to_numpy()
    return totals


def in_buckets(terms: Column, chosen: np.ndarray) -> Column:
    """The terms whose bucket is chosen (a truth value per bucket)."""
    words = F.lit(np.packbits(chosen, bitorder="little").view(np.int64).tolist()).cast("array<bigint>")

    def test(term: Column) -> Column:
        # Two hashes cost less than a lambda that binds one.
        b = term_bucket(term)
        return F.bit_get(F.get(words, F.shiftright(b, 6)), b.bitwiseAND(F.lit(63))) == 1

    return F.filter(terms, test)


def proven_terms(
    count: Callable[[np.ndarray], DataFrame], n_docs: int, spec: TextFeatures, totals: np.ndarray
) -> pa.Table:
    """``chosen_terms`` of the whole count, from ``count``: an exact count of the terms in chosen buckets.

    A term outside has fewer occurrences than ``least``.  If the last term chosen has ``least`` or more,
    no other can precede it.  If not, its count is a bound that all of the true choice
    meet, and a second count with it is final.
    """
    wanted = min(TERM_BUCKETS, BUCKETS_PER_TERM * spec.max_features)
    least = int(np.partition(totals, TERM_BUCKETS - wanted)[TERM_BUCKETS - wanted])
    while True:
        kept = chosen_terms(count(totals >= least), n_docs, spec)
        last = pc.min(kept["tf"]).as_py() if kept.num_rows == spec.max_features else 0
        if least <= 1 or last >= least:
            return kept
        least = last


def top_terms(
    df: DataFrame, terms: Column, n_docs: int, spec: TextFeatures, totals: np.ndarray
) -> pa.Table:
    """``proven_terms`` of term arrays, counted in compiled code."""

    def count(chosen: np.ndarray) -> DataFrame:
        # All buckets that hold a term may be chosen.
        return corpus_term_counts(df, in_buckets(terms, chosen) if (totals[~chosen] > 0).any() else terms)

    return proven_terms(count, n_docs, spec, totals)


def gram_totals(df: DataFrame, tokens: str, spec: TextFeatures) -> np.ndarray:
    """``bucket_totals`` of n-grams, by the buckets of ``grams``."""
    (low, high), stop_words, n_buckets = spec.ngram_range, spec.stop_words, TERM_BUCKETS

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(n_buckets, np.int64)
        for words in chunks(batches, stop_words):
            for n in range(low, high + 1):
                totals += np.bincount(words.buckets(n, words.starts(n), n_buckets), minlength=n_buckets)
        filled = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(totals[filled])], ["b", "n"])

    each = df.select(tokens).mapInArrow(added, "b int, n bigint")
    return bucket_array(each.groupBy("b").agg(F.sum("n").alias("n")))


def gram_counts(df: DataFrame, tokens: str, spec: TextFeatures, chosen: np.ndarray) -> DataFrame:
    """(term, tf, df) of the n-grams in chosen buckets, added up by chunk of documents first."""
    (low, high), stop_words = spec.ngram_range, spec.stop_words

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in chunks(batches, stop_words):
            for n in range(low, high + 1):
                starts = words.starts(n)
                yield words.counted(n, starts[chosen[words.buckets(n, starts, len(chosen))]])

    each = df.select(tokens).mapInArrow(counted, "term string, tf bigint, df bigint")
    # Never null, as a count is.
    tf = F.coalesce(F.sum("tf"), F.lit(0).cast("bigint"))
    return each.groupBy("term").agg(tf.alias("tf"), F.sum("df").alias("df"))


def fit_terms(df: DataFrame, tokens: str, spec: TextFeatures, n_docs: int | None = None) -> pa.Table:
    """The vocabulary of the documents: what ``chosen_terms`` makes of all counts.

    Single words are counted in compiled code; longer n-grams would be made there by lambdas, and so are
    counted as numbers.
    """
    n_docs = df.count() if n_docs is None else n_docs
    if spec.ngram_range[1] > 1:
        totals = gram_totals(df, tokens, spec)
        return proven_terms(lambda chosen: gram_counts(df, tokens, spec, chosen), n_docs, spec, totals)
    terms = spec.terms(tokens)
    return top_terms(df, terms, n_docs, spec, bucket_totals(df, terms))


def fit_vocabulary(df: DataFrame, tokens: str, spec: TextFeatures) -> DataFrame:
    """The fitted terms as a table."""
    return df.sparkSession.createDataFrame(fit_terms(df, tokens, spec))


@dataclass(frozen=True)
class Vocabulary:
    """A fitted vocabulary on the driver; its size is bounded by ``max_features``."""

    terms: tuple[str, ...]
    idf: tuple[float, ...]

    @classmethod
    def from_arrow(cls, table: pa.Table) -> Vocabulary:
        ordered = table.sort_by("term_id")
        return cls(tuple(ordered["term"].to_pylist()), tuple(ordered["idf"].to_pylist()))

    @classmethod
    def from_table(cls, table: DataFrame) -> Vocabulary:
        return cls.from_arrow(table.select("term_id", "term", "idf").toArrow())

    @classmethod
    def fit(
        cls, df: DataFrame, tokens: str, spec: TextFeatures, n_docs: int | None = None
    ) -> Vocabulary:
        """Fitted on the documents; the terms come to the driver once."""
        return cls.from_arrow(fit_terms(df, tokens, spec, n_docs))

    def table(self, spark: SparkSession) -> DataFrame:
        columns = {
            "term_id": pa.array(range(len(self.terms)), pa.int32()),
            "term": pa.array(self.terms, pa.string()),
            "idf": pa.array(self.idf, pa.float64()),
        }
        return spark.createDataFrame(pa.table(columns))


def sparse_vector(size: int, indices: Column, values: Column) -> Column:
    """A sparse ML vector from index and value arrays.

    Spark SQL has no cast to the vector type; its JSON reader produces it.
    """
    parts = F.struct(
        F.lit(0).cast("byte").alias("type"),
        F.lit(size).alias("size"),
        indices.alias("indices"),
        values.alias("values"),
    )
    schema = T.StructType([T.StructField("vector", VectorUDT())])
    return F.from_json(F.to_json(F.struct(parts.alias("vector"))), schema)["vector"]


def count_vectors(
    df: DataFrame, vocabulary: Vocabulary, terms: str, out: str = "tf"
) -> DataFrame:
    """Add the sparse term-count vector; unknown terms drop out."""
    model = CountVectorizerModel.from_vocabulary(
        list(vocabulary.terms), inputCol=terms, outputCol=out
    )
    return model.transform(df)


def tfidf_vectors(
    df: DataFrame,
    vocabulary: Vocabulary,
    tokens: str,
    spec: TextFeatures,
    out: str = "features",
    normalize: bool = True,
) -> DataFrame:
    """Add the TF-IDF vector of a token array; rows without known terms get zeros."""
    size = len(vocabulary.terms)
    if size == 0:
        raise ValueError("the vocabulary is empty")
    counted = count_vectors(
        df.withColumn("_terms", spec.terms(tokens)), vocabulary, "_terms", "_tf"
    ).drop("_terms")
    if spec.sublinear_tf:
        parts = F.unwrap_udt("_tf")
        scaled = F.transform(parts["values"], lambda v: F.lit(1.0) + F.log(v))
        counted = counted.withColumn("_tf", sparse_vector(size, parts["indices"], scaled))
    weigh = ElementwiseProduct(
        scalingVec=Vectors.dense(vocabulary.idf),
        inputCol="_tf",
        outputCol="_weights" if normalize else out,
    )
    weighted = weigh.transform(counted).drop("_tf")
    if not normalize:
        return weighted
    unit = Normalizer(p=2.0, inputCol="_weights", outputCol=out)
    return unit.transform(weighted).drop("_weights")


def tfidf_long(
    df: DataFrame,
    vocabulary: Vocabulary,
    tokens: str,
    spec: TextFeatures,
    key: str,
    normalize: bool = True,
) -> DataFrame:
    """(key, term, weight) for the terms of each document that the vocabulary knows.

    Weights are worked out on arrays: the counts, and the idf of the same terms, which
    is the product of the idf vector with the counts' pattern of ones.
    """
    if not vocabulary.terms:
        raise ValueError("the vocabulary is empty")
    counted = count_vectors(
        df.select(key, spec.terms(tokens).alias("_terms")), vocabulary, "_terms", "_tf"
    ).drop("_terms")
    ones = Binarizer(inputCol="_tf", outputCol="_ones", threshold=0.0).transform(counted)
    idf = ElementwiseProduct(
        scalingVec=Vectors.dense(vocabulary.idf), inputCol="_ones", outputCol="_idf"
    ).transform(ones)
    parts = idf.select(key, F.unwrap_udt("_tf").alias("_tf"), F.unwrap_udt("_idf").alias("_idf"))

    def weight(count: Column, idf: Column) -> Column:
        return (F.lit(1.0) + F.log(count) if spec.sublinear_tf else count) * idf

    def unit(weights: Column) -> Column:
        squares = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w * w)
        return let(F.sqrt(squares), lambda norm: F.transform(weights, lambda w: w / norm))

    # The pattern of ones is stored densely where a document has most of the terms.
    found = F.col("_idf")["values"]
    picked = F.transform(F.col("_tf")["indices"], lambda i: F.get(found, i))
    idfs = F.when(F.col("_idf")["indices"].isNull(), picked).otherwise(found)
    weights = F.zip_with(F.col("_tf")["values"], idfs, weight)
    weights = let(weights, unit) if normalize else weights
    entries = F.arrays_zip(F.col("_tf")["indices"].alias("term_id"), weights.alias("weight"))
    # The outer form keeps Spark from adding a filter that would count every row twice.
    rows = parts.select(key, F.inline_outer(entries)).where(F.col("term_id").isNotNull())
    names = stage(vocabulary.table(df.sparkSession).select("term_id", "term"), "terms")
    return rows.join(names, "term_id").select(key, "term", "weight")


def json_literal(value: object, ddl: str) -> Column:
    """A nested constant; Spark folds it to a literal while planning."""
    return F.from_json(F.lit(json.dumps(value)), ddl)
