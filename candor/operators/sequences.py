"""Fixed-length token id sequences over a fitted vocabulary."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.functions.text import pad_to
from candor.operators.tfidf import corpus_term_counts
from candor.sources.staging import stage

PADDING_ID = 0
UNKNOWN_ID = 1
FIRST_TERM_ID = 2


def fit_token_ids(df: DataFrame, tokens: str, vocab_size: int) -> DataFrame:
    """(term, token_id) of the most frequent terms, ids from 2 by falling count.

    ``vocab_size`` terms come to the driver and are staged from there.
    """
    counts = corpus_term_counts(df, tokens)
    top = counts.orderBy(F.desc("tf"), "term").limit(vocab_size).select("term").toArrow()
    ids = pa.array(range(FIRST_TERM_ID, FIRST_TERM_ID + top.num_rows), pa.int32())
    return stage(df.sparkSession.createDataFrame(top.append_column("token_id", ids)), "token-ids")


def encode_sequences(
    df: DataFrame, token_ids: DataFrame, tokens: str, key: str, max_length: int = 256
) -> DataFrame:
    """(key, input_ids, attention_mask), both arrays of ``max_length`` entries.

    Longer token arrays are cut at ``max_length`` first, as a model input must be, so at
    most that many rows per document meet the vocabulary and come back together.
    """
    kept = df.select(key, F.slice(tokens, F.lit(1), F.lit(max_length)).alias("_tokens"))
    placed = kept.select(key, F.posexplode_outer("_tokens").alias("_at", "term"))
    known = placed.join(token_ids, "term", "left")
    found = F.when(
        F.col("_at").isNotNull(),
        F.struct("_at", F.coalesce("token_id", F.lit(UNKNOWN_ID)).alias("id")),
    )
    in_order = F.array_sort(F.collect_list(found))
    sequences = known.groupBy(key).agg(in_order.alias("_ids"))
    ids = F.transform("_ids", lambda x: x["id"])
    mask = F.transform("_ids", lambda _: F.lit(1))
    return sequences.select(
        key,
        pad_to(ids, max_length, F.lit(PADDING_ID)).alias("input_ids"),
        pad_to(mask, max_length, F.lit(0)).alias("attention_mask"),
    )
