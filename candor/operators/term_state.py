"""Term counts that grow with their documents, so that a vocabulary is refitted from what is new.

The counts of all documents so far are a table bucketed by term.  New documents are counted by
themselves, and only their counts are shuffled, to the buckets of the table; the table is
read bucket by bucket.  Each addition writes a new version, so a job that dies leaves the last
one as it was.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.operators.tfidf import TextFeatures, chosen_terms, corpus_term_counts
from candor.sources.staging import stage

BUCKETS = 64
# A task sorts a bucket, so buckets are doubled in number until they hold no more than this on average.
TERMS_PER_BUCKET = 1 << 19
COLUMNS = "term string, tf bigint, df bigint"


def quoted_path(path: str) -> str:
    return "'" + path.replace("\\", "\\\\").replace("'", "\\'") + "'"


def enough_buckets(buckets: int, n_terms: int) -> int:
    """``buckets``, or the first double of it again and again that keeps the mean bucket small."""
    while n_terms > buckets * TERMS_PER_BUCKET:
        buckets *= 2
    return buckets


@dataclass(frozen=True)
class TermState:
    """The counts (term, tf, df) of ``n_docs`` documents, for one way to make terms.

    ``path`` is the folder of this version: the counts in ``counts``, and one row that
    describes them in ``about``.  ``features`` rules how terms are made; what is cut and weighed when a
    vocabulary is chosen can differ from one choice to the next.
    """

    spark: SparkSession
    path: str
    table: str
    features: TextFeatures
    n_docs: int
    buckets: int

    @classmethod
    def _write(
        cls, counts: DataFrame, path: str, features: TextFeatures, n_docs: int, buckets: int
    ) -> TermState:
        spark = counts.sparkSession
        name = f"term_state_{uuid.uuid4().hex}"
        bucketed = counts.select("term", "tf", "df").write.bucketBy(buckets, "term").sortBy("term")
        bucketed.option("path", f"{path}/counts").saveAsTable(name)
        about = spark.createDataFrame([(n_docs, buckets)], "n_docs bigint, buckets int")
        about.coalesce(1).write.parquet(f"{path}/about")
        return cls(spark, path, name, features, n_docs, buckets)

    @classmethod
    def create(
        cls, df: DataFrame, tokens: str, features: TextFeatures, path: str, buckets: int = BUCKETS
    ) -> TermState:
        """The state of the first documents, in a new folder, in at least so many buckets."""
        counts = stage(corpus_term_counts(df, features.terms(tokens)), "term-counts")
        buckets = enough_buckets(buckets, counts.count())
        return cls._write(counts.repartition(buckets, "term"), path, features, df.count(), buckets)

    @classmethod
    def open(cls, spark: SparkSession, path: str, features: TextFeatures) -> TermState:
        """A state that was written before, perhaps by another session."""
        about = spark.read.parquet(f"{path}/about").first()
        name = f"term_state_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {name} ({COLUMNS}) USING parquet CLUSTERED BY (term) SORTED BY (term) "
            f"INTO {about['buckets']} BUCKETS LOCATION {quoted_path(path + '/counts')}"
        )
        return cls(spark, path, name, features, about["n_docs"], about["buckets"])

    def counts(self) -> DataFrame:
        return self.spark.table(self.table)

    def merged(self, df: DataFrame, tokens: str) -> DataFrame:
        """(term, tf, df) of the documents so far and those of ``df``."""
        return self._merged(df, tokens)[0]

    def _merged(self, df: DataFrame, tokens: str) -> tuple[DataFrame, int]:
        """The merged counts, and the number of buckets they are dealt to."""
        counted = stage(corpus_term_counts(df, self.features.terms(tokens)), "term-counts")
        new = counted.withColumnsRenamed({"tf": "new_tf", "df": "new_df"})
        old = self.counts()
        buckets = enough_buckets(self.buckets, old.count() + counted.count())
        if buckets > self.buckets:
            # Once per doubling, the old counts move too.
            old = old.repartition(buckets, "term")
        # A merge join on the buckets: a broadcast could not keep terms of both sides.
        both = old.hint("merge").join(new.repartition(buckets, "term"), "term", "full")
        merged = both.select(
            "term",
            *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"new_{c}", F.lit(0))).cast("bigint").alias(c) for c in ("tf", "df")],
        )
        return merged, buckets

    def add(self, df: DataFrame, tokens: str, path: str) -> TermState:
        """The state with more documents, as a new version in a new folder.  None may have been added before."""
        counts, buckets = self._merged(df, tokens)
        return TermState._write(counts, path, self.features, self.n_docs + df.count(), buckets)

    def vocabulary(self, features: TextFeatures | None = None) -> pa.Table:
        """(term, term_id, tf, df, idf) as a fit on all documents would choose them.

        ``features`` may choose differently from the same terms: another size or other bounds on df.
        """
        spec = features or self.features
        if (spec.ngram_range, spec.stop_words) != (self.features.ngram_range, self.features.stop_words):
            raise ValueError("the state counts other terms")
        return chosen_terms(self.counts(), self.n_docs, spec)

    def drop(self) -> None:
        """Forget the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
