"""Operator 8, quality rules with host-level verdicts. Native: column expressions and SQL functions only.

Each document's statistics come from one pass of array functions. Failures of each soft rule are aggregated by host, and a
beta prior is estimated from the spread of hosts' rates (method of moments), so that a host's rate is shrunk towards the
corpus. A host is bad by a rule if its posterior says with CONFIDENCE that its rate is above FACTOR times the corpus's; the
tail of the posterior is taken as normal (mean and variance of the beta), since SQL has no incomplete beta function. A
document is dropped if it fails a base rule, or fails a soft rule that its host is bad by; a document without any failure
is never dropped for its host. Where hosts differ no more than by chance the prior is strong and no host is bad.

Cases: null text counts as empty (no words, base_failed); very long texts are read whole; ties can't be; rows without doc_id
are judged like others and dealt over the salts; null hosts are one host named ''; repeated rows give equal
rows; an empty table gives an empty result; only the named columns are read, so others may be named anything. Windows
are compared by a 64-bit hash within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import written

SPAN = 8
MIN_WORDS, MOST_REPEATED = 20, 30
FACTOR, CONFIDENCE, TAIL = 1.5, 0.9, 1.2815515655446004  # the tail is the normal quantile of the confidence
SOFT = ("symbols", "lines", "length")
SALTS = 64
SYMBOLS = "#*$%&|<>"
WHITE_CHARS = " \t\n\x0b\f\r"
WHITE = r"[\x20\x09-\x0D]+"


def repeated_words(rows: DataFrame) -> DataFrame:
    """Add n_repeat_words from `words`: words in windows of SPAN words that are found twice or more in the text."""
    rows = rows.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    last = F.size("_h") - SPAN
    window = lambda i: F.struct(F.xxhash64(*[F.col("_h")[i + k] for k in range(SPAN)]).alias("h"), i.alias("i"))
    rows = rows.withColumn("_s", F.when(last >= 1, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window)))).drop("_h")
    n = F.size("_s")
    twin = lambda x, k: ((k > 0) & (x["h"] == F.get("_s", k - 1)["h"])) | ((k < n - 1) & (x["h"] == F.get("_s", k + 1)["h"]))
    rows = rows.withColumn("_p", F.sort_array(F.transform(F.filter("_s", twin), lambda x: x["i"]))).drop("_s")
    total = F.aggregate("_p", F.struct(F.lit(-SPAN).alias("at"), F.lit(0).cast("long").alias("n")), lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(F.lit(SPAN), p - acc["at"])).alias("n")), lambda acc: acc["n"])
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("_p")


def describe(docs: DataFrame, host: Column) -> DataFrame:
    """Statistics, base rule and soft rules of each document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(host.cast("string"), F.lit("")).alias("host"), text.alias("text"))
    solid = F.translate("text", WHITE_CHARS, "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, WHITE_CHARS, "")) > 0)
    rows = rows.select(
        "doc_id", "host", F.filter(F.split("text", WHITE), lambda w: w != "").alias("words"), F.length(solid).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.alias("lines"),
    )
    rows = rows.withColumn("n_words", F.size("words").cast("long")).withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("lines"))).drop("lines")
    rows = repeated_words(rows).drop("words")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    soft = {"symbols": 10 * F.col("n_symbols") > F.col("word_chars"), "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"), "length": F.col("word_chars") > 20 * F.col("n_words")}
    return rows.withColumn("base_failed", base).select("*", *[fails.alias(f"failed_{name}") for name, fails in soft.items()])


def host_rates(rows: DataFrame, factor: float = FACTOR, tail: float = TAIL) -> DataFrame:
    """host, documents, and of each soft rule: shrunk rate, excess (standard deviations of the posterior between the rate
    and `factor` times the corpus's) and whether the host is bad by it. The priors are one row."""
    hosts = rows.groupBy("host").agg(F.count("*").alias("documents"), *[F.sum(F.col(f"failed_{r}").cast("long")).alias(f"failures_{r}") for r in SOFT])
    n = F.col("documents")
    of = lambda r: [F.sum(f"failures_{r}").alias(f"f_{r}"), F.var_pop(F.col(f"failures_{r}") / n).alias(f"v_{r}")]
    p = hosts.agg(F.sum(n).alias("n"), F.avg(1 / n).alias("i"), *[x for r in SOFT for x in of(r)]).first()
    for r in SOFT:
        mean = (p[f"f_{r}"] or 0) / p["n"] if p["n"] else 0.0
        within = mean * (1 - mean) * (p["i"] or 0)  # variance that counting alone would show
        between = max((p[f"v_{r}"] or 0) - within, 1e-6)
        strength = min(max(mean * (1 - mean) / between - 1, 2.0), 10_000.0)
        a, whole = F.col(f"failures_{r}") + mean * strength, n + strength
        rate = a / whole
        spread = F.sqrt(rate * (1 - rate) / (whole + 1))
        excess = F.coalesce((rate - factor * mean) / F.nullif(spread, F.lit(0.0)), F.lit(-9.0))
        hosts = hosts.withColumn(f"rate_{r}", rate).withColumn(f"excess_{r}", excess).withColumn(f"bad_{r}", excess > tail)
    return hosts


def judge(docs: DataFrame, host: Column | None = None, factor: float = FACTOR, tail: float = TAIL) -> DataFrame:
    rows = written(describe(docs, F.col("source") if host is None else host), "rules")
    most = F.greatest(*[F.col(f"excess_{r}") for r in SOFT])
    hosts = host_rates(rows, factor, tail).select("host", *[f"bad_{r}" for r in SOFT], F.floor(most * 1000 + 0.5).cast("long").alias("host_excess_milli"))
    dropped = F.col("base_failed")
    for r in SOFT:
        dropped = dropped | (F.col(f"bad_{r}") & F.col(f"failed_{r}"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))  # a host may hold a third of all rows
    return rows.join(hosts.select("*", salts), ["host", "salt"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~dropped).alias("kept"), "host_excess_milli")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_host_rules": op8}
SQL: dict[str, str] = {}
