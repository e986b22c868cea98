"""Operator 2, secret scan with corpus-wide ownership frequency. Native: column expressions and SQL functions only.

Base kinds (assign, access, hex) are found by regular expressions; besides them, any long token of mixed letters and
digits is a candidate. All candidates' hashes are counted over the corpus by distinct owners and repositories: a hash
with at most MOST_OWNERS owners in at most MOST_REPOSITORIES repositories is owner-specific and looks live, others are
widely copied examples. Owner-specific
tokens outside the base spans are added as kind `owned`; base spans stay whatever their verdict, which is counted.

Owners are the `source` column and repositories `source/lang`, both parameters. Counting pre-aggregates by (hash, owner,
repository), so a secret in a third of all rows is one row a partition; the join back is an equi-join that AQE can split.

Cases: null text counts as empty; very long texts are scanned whole; rows without doc_id are scanned; empty texts have no spans and the hash of the empty string; overlapping spans of
different kinds all stay, ordered by start and kind; repeated rows give equal rows; null owners count as one owner; an
empty table gives an empty result; only the named columns are read, so others may be named anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import written

KINDS = ("assign", "access", "hex", "owned")
VALUE = r"[A-Za-z0-9+/_.=-]+"
HEAD = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
MIN_VALUE = 12
MOST_OWNERS, MOST_REPOSITORIES = 2, 4
TOKEN = r"[A-Za-z0-9+/_=-]{24,}"
SPAN = "array<struct<start:int,kind:int,end:int,hash:bigint,own:boolean>>"


def located(text: Column, pattern: str, kind: int, guard: Column, value: Column | None = None) -> Column:
    """Spans of the leftmost non-overlapping matches: a lazy gap and a match alternate, so lengths give the places."""
    pairs = rf"(?s)(.*?)(?:({pattern})|\z)"
    gaps = F.regexp_extract_all(text, F.lit(pairs), F.lit(1))
    found = F.regexp_extract_all(text, F.lit(pairs), F.lit(2))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        secret = F.when(F.lit(kind) == 0, F.regexp_extract(x["found"], rf"\A{HEAD}({VALUE})\z", 1)).otherwise(x["found"])
        mixed = x["found"].rlike("[0-9]") & x["found"].rlike("[A-Z]") & x["found"].rlike("[a-z]")
        good = {0: F.length(secret) >= MIN_VALUE, 3: mixed}.get(kind, F.length(x["found"]) > 0)
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.xxhash64(secret).alias("hash"), F.lit(kind == 3).alias("own"))
        return F.struct(end.alias("at"), F.when(good & (F.length(x["found"]) > 0), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    pieces = F.arrays_zip(gaps.alias("gap"), found.alias("found"))
    return F.when(guard, F.aggregate(pieces, zero, step, lambda acc: acc["spans"])).otherwise(F.array().cast(SPAN))


def candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """doc_id, key of the text, owner, repository, base spans and other tokens."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"))
    text, low = F.col("text"), F.lower("text")
    said = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    # runs are maximal, so a least length in the pattern equals dropping short runs afterwards
    base = F.concat(
        located(text, HEAD + VALUE, 0, said),
        located(text, "AKIA[A-Z0-9]{14,}", 1, text.contains("AKIA")),
        located(text, "[0-9a-f]{16,}", 2, text.rlike("[0-9a-f]{16}")),
    )
    return rows.select("doc_id", F.xxhash64("text").alias("key"), "owner", "repository", base.alias("base"), located(text, TOKEN, 3, text.rlike(TOKEN)).alias("tokens"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, owners, repositories over all candidates."""
    each = found.select("owner", "repository", F.explode(F.concat("base", "tokens")).alias("x")).select("owner", "repository", F.col("x.hash").alias("hash"))
    owners = each.distinct().groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def shown(spans: Column) -> Column:
    """kind:start:end, by start and kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """Per document the base counts and digest, all spans, and how many candidates are live or widely copied."""
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    found = written(candidates(docs, owner, repository), "secrets")
    counts = ownership(found)
    each = found.select("doc_id", "key", F.explode(F.concat("base", "tokens")).alias("x")).select("doc_id", "key", "x", F.col("x.hash").alias("hash"))
    judged = each.join(counts, "hash").select("doc_id", "key", "x", ((F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)).alias("live"))
    one = judged.groupBy("doc_id", "key").agg(
        F.collect_set(F.when(F.col("live") & F.col("x.own"), F.col("x"))).alias("own"),
        F.collect_set(F.when(F.col("live"), F.col("x"))).alias("live"),
        F.collect_set(F.when(~F.col("live"), F.col("x"))).alias("copied"),
    )
    none = F.array().cast(SPAN)
    rows = found.join(one, ["doc_id", "key"], "left").withColumn("base", F.array_sort("base"))
    inside = lambda s, b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])
    more = F.filter(F.coalesce("own", none), lambda s: ~F.exists("base", lambda b: inside(s, b)))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    rows = rows.withColumn("all", F.array_sort(F.concat("base", more)))
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("all")).alias("spans"),
        F.size(F.coalesce("live", none)).cast("long").alias("n_live"), F.size(F.coalesce("copied", none)).cast("long").alias("n_copied"),
        F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("places"), "key",
    )


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The same documents with every span of their text replaced by mask; overlapping spans by one."""
    found = scan(docs).where("spans <> ''").select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "places").dropDuplicates(["_doc", "_key"]).hint("merge")  # grows with the documents, so it is never broadcast
    text = F.coalesce("text", F.lit(""))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def masked(text: Column) -> Column:
        return F.aggregate("places", zero, lambda acc, s: step(text, acc, s), lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))

    def step(text: Column, acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    row = docs.select(F.struct("*").alias("_row"), F.xxhash64(text).alias("_key0"))  # within _row no name clashes
    text, places = F.coalesce("_row.text", F.lit("")), F.col("places")
    joined = row.join(found, F.col("_row.doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key0") == F.col("_key")), "left")
    new = F.when(places.isNull(), F.col("_row.text")).otherwise(masked(text))
    return joined.select(*[new.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("places", "key")


QUERIES = {"op2_secret_ownership": op2}
SQL: dict[str, str] = {}
