"""The corpus operators as queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.llm import (
    byte_bpe,
    decontamination,
    line_dedup,
    lm_scoring,
    mixing,
    periodic_runs,
    prefix_trie,
    quality_classifier,
    quality_rules,
    secret_scan,
    sharding,
    simhash,
    url_filter,
)
from candor.llm.shared import GAP, key_fold, text_crc32

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SHARDS = 24

URL_RULES = {
    "com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow",
    "net/es/": "block", "net/fr/": "block",
}
# Hosts with one of these labels make up the list of blocked pages.
LISTED_LABELS = ("spam-farm", "adult-x", "free-bets")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_shards(spark, sf_dir):
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8).alias("size"),
        text_crc32(text).alias("text_crc32"),
    )
    placed = sharding.interleaved_shards(docs, SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


@query
def op4_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source",
        mixing.word_count(F.col("text")).alias("words"),
        mixing.quality_steps(F.col("text")).alias("steps"),
    )
    mixed = mixing.mix_sources(docs, size=F.col("words"), weight_steps=F.col("steps"), text="words")
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken")
    )


@query
def op7_url_verdicts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        url_filter.url_host(F.col("url")).alias("host"),
        url_filter.url_path(F.col("url")).alias("path"),
    )
    marked = r"(^|\.)(" + "|".join(LISTED_LABELS) + r")\."
    key = F.concat("host", "path")
    listed = pages.where(F.col("host").rlike(marked)).select(key.alias("key"))
    rule = url_filter.matching_rule(F.col("host"), F.col("path"), list(URL_RULES))
    judged = url_filter.filter_by_list(pages.withColumn("rule", rule), key, listed)
    by_rule = F.element_at(F.create_map(*[F.lit(x) for kv in URL_RULES.items() for x in kv]), F.col("rule"))
    by_list = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id", "host", "path", "rule",
        F.when(F.col("rule").isNull(), by_list).otherwise(by_rule).alias("verdict"), "listed",
    )


@query
def op8_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("spans")
    base = tuple(kind for kind, *_ in secret_scan.PATTERNS)
    counts = [secret_scan.kind_count(spans, kind).alias(f"n_{kind}") for kind in base]
    return secret_scan.scan_secrets(docs).select(
        "doc_id", *counts,
        F.sha2(secret_scan.span_list(spans, base), 256).alias("base_sha256"),
        secret_scan.span_list(spans).alias("spans"),
    )


@query
def op10_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality_rules.apply_rules(docs, table(spark, sf_dir, "labels"))
    stats = F.col("stats")
    return judged.select(
        "doc_id",
        *[stats[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"),
    )


@query
def op9_simhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op5_lm_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = key_fold(F.col("doc_id"), 7) == 2
    scored = lm_scoring.score_documents(docs, ~held_out)
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score",
    )


@query
def op1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = key_fold(F.col("doc_id"), 5)
    return quality_classifier.score_quality(docs, table(spark, sf_dir, "labels"), fold, held_out=0)


@query
def op2_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.dedup_lines(docs)
    run = F.transform("removed", lambda r: F.concat_ws("-", r["first"], r["last"]))
    return done.select("doc_id", F.array_join(run, ",").alias("removed"), "clean_text")


@query
def op6_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    leak = F.transform(
        "leaks", lambda x: F.concat_ws(":", x["item"], x["edits"], x["start"], x["end"])
    )
    return found.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"),
        F.size("leaks").cast("bigint").alias("n_leaks"), F.array_join(leak, ",").alias("leaks"),
    )


@query
def op11_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    bpe = byte_bpe.ByteBpe(spark, byte_bpe.Vocabulary.read(path, public_tokenizers.PATTERN))
    coded = table(spark, sf_dir, "documents").select("doc_id", bpe.round_trip(F.col("text")).alias("x"))
    return coded.select(
        "doc_id", byte_bpe.token_count(F.col("x.ids")).alias("n_tokens"),
        F.sha2("x.ids", 256).alias("ids_sha256"), F.sha2("x.decoded", 256).alias("decoded_sha256"),
    )


def made_periodic(key: Column, text: Column) -> Column:
    """The texts of one key in ten made to repeat from some word on; the others as they are."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")
    n, h = F.size(words), F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
    period = F.slice(words, a + 1, p)
    repeated = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a), repeated), " ")
    return F.when((h % 10 == 0) & (n > 0), changed).otherwise(text)


@query
def op12_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", made_periodic(F.col("doc_id"), F.col("text")).alias("text")
    )
    found = docs.select("doc_id", periodic_runs.periodic_runs(F.col("text")).alias("found"))
    top = periodic_runs.greatest_run(F.col("found.runs"))
    rows = found.select("doc_id", "found", top.alias("top"))
    return rows.select(
        "doc_id", F.size("found.runs").cast("bigint").alias("n_runs"),
        "top.start", "top.length", "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(periodic_runs.run_lines(F.col("found.runs")), 256).alias("runs_sha256"),
        F.sha2("found.collapsed", 256).alias("collapsed_sha256"),
    )


def with_shared_heads(blocks: DataFrame, family: int = 20, most: int = 3) -> DataFrame:
    """Blocks of conversations whose first h turns, h <= ``most``, are those of the first of their family.

    That is conversation c - c % family; h is crc32 of c as text modulo ``most`` + 1.  All
    of its turns are taken if it has fewer, and none if it is not there.
    """
    conv, start = F.col("conv"), F.col("start")
    # The first turns can lie in several blocks; at most ``most`` of a conversation's begin that early.
    near = blocks.where((conv % family == 0) & (start < most) & (F.size("digests") > 0))
    pairs = F.arrays_zip(F.slice("digests", 1, most).alias("digest"), F.slice("words", 1, most).alias("n"))
    heads = near.groupBy(conv.alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("start", pairs.alias("p")))).alias("b")
    )
    head = F.slice(F.flatten(F.col("b.p")), 1, most)
    heads = heads.select("base", head["digest"].alias("head"), head["n"].alias("head_words"))
    h = F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(most + 1)).cast("int")
    taken = F.when(F.col("head").isNull(), 0).otherwise(F.least(F.col("h"), F.size("head")))
    joined = blocks.withColumns({"base": conv - conv % family, "h": h}).join(heads, "base", "left")
    joined = joined.withColumn("taken", taken)
    # Of the block's own turns those up to the h-th of the conversation go.
    gone = F.greatest(F.col("h") - start, F.lit(0)).cast("int")
    left = F.greatest(F.size("digests") - gone, F.lit(0))

    def headed(own: str, head: str) -> Column:
        none = F.array().cast(dict(blocks.dtypes)[own])
        before = F.when(F.col("first") & (F.col("taken") > 0), F.slice(F.col(head), F.lit(1), F.col("taken")))
        rest = F.when(left > 0, F.slice(F.col(own), gone + 1, left))
        return F.concat(F.coalesce(before, none), F.coalesce(rest, none)).alias(own)

    moved = F.greatest(start - F.col("h"), F.lit(0)) + F.col("taken")
    return joined.where(F.col("first") | (left > 0)).select(
        "conv", F.when(F.col("first"), F.lit(0)).otherwise(moved).cast("bigint").alias("start"), "first",
        (F.col("taken") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).cast("bigint").alias("total"),
        headed("digests", "head"), headed("words", "head_words"),
    )


@query
def op13_prefix_trie(spark, sf_dir):
    blocks = prefix_trie.turn_blocks(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(with_shared_heads(blocks))
