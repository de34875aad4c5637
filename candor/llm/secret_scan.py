"""Secrets in texts: three fixed patterns, and strings that a battery of tests calls random.

A candidate is a run of letters, digits and ``+/_=-``.  Its encoding is inferred from
its characters, and three statistics are taken: chi-squared against a flat alphabet,
runs of character classes, and the serial correlation of the codes.  What ordinary
candidates look like (repeat rates, changes of class, correlation) is measured over all
candidates of the corpus.  A candidate is a secret if it is compatible
with a flat alphabet and its statistics are so unlike ordinary candidates of its length
that Benjamini and Hochberg's procedure, run in each class of lengths, keeps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.functions.arrays import let
from candor.llm.shared import column, keep

# The patterns, the group whose length counts, and the least length.
PATTERNS = (
    (
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs are maximal, so the least length can stand in the pattern.
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
RANDOM = "random"
CANDIDATE = r"[A-Za-z0-9+/_=-]{12,}"
LEAST_TESTED = 12

# Encoding -> (its characters, its size), the first that fits.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", 10),
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 16),
    ("base32", r"^[A-Z2-7]+=*$", 32),
    ("base36", r"^[a-z0-9]+$", 36),
    ("base62", r"^[A-Za-z0-9]+$", 62),
    ("base64", r"", 64),
)
# Length classes by their least length.
LENGTHS = (12, 16, 20, 24, 32, 48)
FALSE_DISCOVERY = 0.001
# One-sided 0.1 % bound for the tests against a flat alphabet.
COMPATIBLE = 3.09
LEVELS_PER_TEN = 100
TOP_LEVEL = 30 * LEVELS_PER_TEN

# Matches whose positions are summed together.
SUM_BLOCK = 64

SPAN = "struct<start:int,rank:int,end:int,kind:string,text:string>"
FOUND = "struct<start:int,end:int,text:string>"


def pattern_spans(text: Column, pattern: str, group: int) -> Column:
    """Leftmost matches in order as (start, end, text, part); code points, end exclusive.

    The text between matches and the matches take turns, so positions are running
    sums of their lengths.  They are summed in blocks, and then over the blocks, so
    that texts with very many matches take no quadratic time.
    """
    kind = "struct<start:int,end:int,text:string,part:string>"
    state = f"struct<at:int,out:array<{kind}>>"
    parts = F.transform(F.split(text, pattern, -1), F.length)
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    counted = F.regexp_extract_all(text, F.lit(pattern), group)
    pairs = F.arrays_zip(parts.alias("gap"), matches.alias("m"), counted.alias("c"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        here = F.struct(
            begin.alias("start"), end.alias("end"), x["m"].alias("text"), x["c"].alias("part")
        )
        out = F.when(x["m"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], here))
        return F.struct(end.alias("at"), out.alias("out")).cast(state)

    def summed(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(state)
        return F.aggregate(block, start, step)

    def blocks(p: Column) -> Column:
        last = F.floor((F.size(p) - 1) / SUM_BLOCK).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last), lambda i: summed(F.slice(p, i * SUM_BLOCK + 1, F.lit(SUM_BLOCK)))
        )

    def joined(done: Column) -> Column:
        offsets = F.aggregate(
            done,
            F.struct(F.lit(0).alias("at"), F.array().alias("starts")).cast("struct<at:int,starts:array<int>>"),
            lambda acc, x: F.struct(
                (acc["at"] + x["at"]).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts")
            ),
            lambda acc: acc["starts"],
        )
        return F.flatten(F.zip_with(done, offsets, moved))

    def moved(block: Column, by: Column) -> Column:
        return F.transform(
            block["out"],
            lambda s: F.struct(
                (s["start"] + by).alias("start"), (s["end"] + by).alias("end"),
                s["text"].alias("text"), s["part"].alias("part"),
            ),
        )

    some = let(pairs, lambda p: let(blocks(p), joined))
    return F.when(text.rlike(pattern), some).otherwise(F.array().cast(f"array<{kind}>"))


def _of_kind(spans: Column, rank: int, kind: str, least: int) -> Column:
    long = F.filter(spans, lambda s: F.length(s["part"]) >= least)
    return F.transform(
        long,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"),
            F.lit(kind).alias("kind"), s["text"].alias("text"),
        ),
    )


def base_spans(text: Column) -> Column:
    """All matches of the fixed patterns that are long enough, by start, then kind."""
    found = [
        _of_kind(pattern_spans(text, pattern, group), rank, kind, least)
        for rank, (kind, pattern, group, least) in enumerate(PATTERNS)
    ]
    return F.array_sort(F.concat(*found)).cast(f"array<{SPAN}>")


def candidates(text: Column, base: Column) -> Column:
    """Candidate runs that touch no span of the patterns."""
    runs = pattern_spans(text, CANDIDATE, 0)
    free = F.filter(
        runs,
        lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    return F.transform(
        free, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["text"].alias("text"))
    )


def _encoding(s: Column) -> Column:
    out = F.lit(ENCODINGS[-1][0])
    for name, pattern, _ in reversed(ENCODINGS[:-1]):
        out = F.when(s.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _number(enc: Column, values: dict[str, float]) -> Column:
    """The value of the row's encoding; few enough to stand in the expression."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), enc)


def measured(tokens: DataFrame) -> DataFrame:
    """Add enc, n, counts, pairs (sum of o(o-1)), runs and r to rows with a ``text``."""
    s = F.col("text")
    one = tokens.withColumns({"enc": _encoding(s), "n": F.length(s)})
    chars = F.array_distinct(F.split(s, ""))
    counts = F.transform(
        F.filter(chars, lambda c: c != ""),
        lambda c: F.struct(c.alias("c"), (F.length(s) - F.length(F.replace(s, c, F.lit("")))).alias("o")),
    )
    classes = s
    for pattern, mark in (("[0-9]+", "0"), ("[a-z]+", "a"), ("[A-Z]+", "A"), ("[^0aA]+", "-")):
        classes = F.regexp_replace(classes, pattern, mark)
    one = one.withColumns({"counts": counts, "runs": F.length(classes)})

    def add(acc, x):
        return acc + x

    total = F.aggregate("counts", F.lit(0.0), lambda a, x: a + x["o"] * (x["o"] - 1))
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("double"))
    mean = F.aggregate(codes, F.lit(0.0), add) / F.greatest(F.length(s), F.lit(1))

    def correlation(x: Column) -> Column:
        following = F.slice(x, F.lit(2), F.size(x))
        top = F.aggregate(F.zip_with(x, following, lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), add)
        return top / F.aggregate(F.transform(x, lambda a: a * a), F.lit(0.0), add)

    centred = let(codes, lambda c: let(mean, lambda m: F.transform(c, lambda a: a - m)))
    r = F.coalesce(F.try_divide(let(centred, correlation), F.lit(1.0)), F.lit(0.0))
    r = F.when(F.size(F.col("counts")) < 2, F.lit(0.0)).otherwise(r)
    return one.withColumns({"pairs": total, "r": r})


def upper_tail(z: Column) -> Column:
    """P(N(0,1) > z), by a bound that is exact at 0 and tight in the tail."""
    a = F.abs(z)
    tail = F.exp(-a * a / 2) / 2.5066282746310002 * 2 / (a + F.sqrt(a * a + 2.546479089470325))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def ordinary(tokens: DataFrame) -> tuple[float, float, float, float]:
    """Sum of p^2 and of p^3 over characters, rate of class changes, mean correlation.

    Taken over all candidates, of which secrets are few; one row comes back.
    """
    chars = tokens.select(F.inline("counts")).groupBy("c").agg(F.sum("o").alias("o"))
    p = F.col("o") / F.sum("o").over(Window.partitionBy())
    shares = chars.select(p.alias("p")).agg(
        F.sum(F.pow("p", F.lit(2))).alias("q"), F.sum(F.pow("p", F.lit(3))).alias("c3")
    )
    rest = tokens.agg(
        ((F.sum(F.col("runs") - 1) + 1) / (F.sum(F.col("n") - 1) + 2)).alias("tau"),
        F.avg("r").alias("rho"),
    )
    q, c3 = shares.first()
    tau, rho = rest.first()
    return (q or 0.05, c3 or 0.005, tau or 0.5, rho or 0.0)


def tested(tokens: DataFrame, model: tuple[float, float, float, float]) -> DataFrame:
    """Add ``flat`` (compatible with a flat alphabet) and ``level`` (-100 log10 p, floored)."""
    sizes = {name: float(size) for name, _, size in ENCODINGS}
    enc, n, r = F.col("enc"), F.col("n").cast("double"), F.col("r")
    size = _number(enc, sizes)
    q, c3, tau, rho = map(F.lit, model)
    pairs, runs = F.col("pairs"), F.col("runs")
    chi2 = size / n * (pairs + n) - n
    # Wilson and Hilferty's cube root turns chi-squared into a normal deviate.
    k = size - 1
    flat_z = (F.pow(chi2 / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))
    flat = (flat_z <= COMPATIBLE) & (F.abs(r) * F.sqrt(n) <= COMPATIBLE + 0.2)

    # Against ordinary candidates: fewer repeats, more changes of class, less correlation.
    spread = 2 * n * (n - 1) * F.greatest(q + 2 * (n - 2) * c3 - (2 * n - 3) * q * q, F.lit(1e-9))
    p_chars = upper_tail((n * (n - 1) * q - pairs) / F.sqrt(spread))
    moves = (n - 1) * tau
    p_runs = upper_tail((runs - 1 - 0.5 - moves) / F.sqrt(F.greatest(moves * (1 - tau), F.lit(0.25))))
    side = F.when(rho <= 0, r - rho).otherwise(rho - r)
    p_serial = upper_tail(side * F.sqrt(n))
    # Fisher: -2 sum ln p is chi-squared with six degrees of freedom.
    x = -(F.log(p_chars) + F.log(p_runs) + F.log(p_serial))
    combined = F.exp(-x) * (1 + x + x * x / 2)
    level = F.floor(-F.log10(F.greatest(combined, F.lit(1e-300))) * LEVELS_PER_TEN)
    length_class = F.lit(LENGTHS[0])
    for least in LENGTHS[1:]:
        length_class = F.when(n >= least, F.lit(least)).otherwise(length_class)
    return tokens.withColumns(
        {
            "flat": F.coalesce(flat, F.lit(False)),
            "level": F.least(F.greatest(F.coalesce(level, F.lit(0)), F.lit(0)), F.lit(TOP_LEVEL)).cast("int"),
            "length_class": length_class,
        }
    )


def discovery_levels(tokens: DataFrame, rate: float = FALSE_DISCOVERY) -> dict[int, int]:
    """Benjamini and Hochberg's cut per length class, from the histogram of levels."""
    cells = tokens.groupBy("length_class", "level").agg(F.count("*").alias("n"))
    per_class = Window.partitionBy("length_class")
    down = per_class.orderBy(F.col("level").desc())
    ranked = cells.withColumns({"above": F.sum("n").over(down), "m": F.sum("n").over(per_class)})
    passes = F.pow(F.lit(10.0), -F.col("level") / LEVELS_PER_TEN) * F.col("m") <= rate * F.col("above")
    cuts = ranked.where(passes).groupBy("length_class").agg(F.min("level").alias("cut"))
    return {x["length_class"]: x["cut"] for x in cuts.collect()}


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", rate: float = FALSE_DISCOVERY) -> DataFrame:
    """One row (key, spans) per row: spans of (start, end, kind, text) by start, then kind.

    Kinds are those of PATTERNS and ``random``; a random span touches no other.  Null
    and empty texts have no spans, a null key stays null, and repeated rows each get
    their row.  Other columns of the input, whatever their names, are not read.
    """
    whole = F.coalesce(column(text), F.lit(""))
    found = df.select(column(key).alias("key"), whole.alias("t"))
    found = found.withColumn("base", base_spans(F.col("t")))
    found = found.select("key", "base", candidates(F.col("t"), F.col("base")).alias("runs"))
    found = keep(found, "secret-candidates")
    tokens = measured(found.select(F.inline("runs")))
    model = ordinary(tokens)
    long = f"length(text) >= {LEAST_TESTED}"
    cuts = discovery_levels(tested(measured(found.select(F.inline("runs")).where(long)), model), rate)
    numbered = found.withColumn("row", F.monotonically_increasing_id())
    if not cuts:
        spans = F.transform("base", _public)
        return found.select(F.col("key").alias(key), spans.alias("spans"))
    # Few candidates are long enough; only documents with a secret among them come back.
    rows = numbered.select("row", F.inline("runs")).where(long)
    rows = tested(measured(rows), model)
    cut = F.element_at(F.create_map(*[F.lit(x) for kv in cuts.items() for x in kv]), F.col("length_class"))
    secrets = rows.where(F.col("flat") & (F.col("level") >= cut))
    span = F.struct(
        F.col("start"), F.lit(len(PATTERNS)).alias("rank"), F.col("end"),
        F.lit(RANDOM).alias("kind"), F.col("text"),
    ).cast(SPAN)
    more = secrets.groupBy("row").agg(F.collect_list(span).alias("more"))
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(f"array<{SPAN}>"))))
    return numbered.join(more, "row", "left").select(
        F.col("key").alias(key), F.transform(spans, _public).alias("spans")
    )


def _public(s: Column) -> Column:
    return F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text")
    )


def kind_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def span_list(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the spans in order, joined by commas."""
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(
        F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )
