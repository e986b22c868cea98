"""Operator 5, URL filter with a weighted vocabulary.

Host, path and the rule list are plain column expressions. URLs under no rule are judged by an Aho-Corasick automaton
over strict and soft terms: a hit counts only between boundaries (no ASCII letter or digit on either side), one strict
hit or MIN_SOFT distinct soft hits reject.

Cases: null URLs or URLs without `://` have an empty host and path, no rule, and are judged on their whole string (null:
allowed); ties of rule length can't be (two rules of one length that both fit are one rule); very long URLs are
read whole; repeated rows give equal rows; an empty table gives an empty result; only page_id and url are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
STRICT = ("porn", "xxx", "casino", "casinos", "viagra", "escorts", "phishing", "malware", "warez", "spam", "bets")
SOFT = ("adult", "sex", "sexy", "bet", "betting", "poker", "slots", "win", "free", "bonus", "pills", "cheap", "loan", "loans", "dating", "cam", "cams", "nude", "farm", "x", "crack", "torrent")
MIN_SOFT = 2


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)


@lru_cache(maxsize=8)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for weight, terms in ((2, strict), (1, soft)):
        for term in terms:
            found.add_word(term, (weight, term))
    found.make_automaton()
    return found


def alnum(c: str) -> bool:
    return c.isascii() and c.isalnum()


def hits(url: str, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> tuple[int, list[str]]:
    """Strict hits, and the distinct soft terms, of a lower-cased URL."""
    n_strict, seen = 0, set()
    for end, (weight, term) in automaton(strict, soft).iter(url):
        start = end - len(term) + 1
        if (start and alnum(url[start - 1])) or (end + 1 < len(url) and alnum(url[end + 1])):
            continue
        if weight == 2:
            n_strict += 1
        else:
            seen.add(term)
    return n_strict, sorted(seen)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, min_soft: int = MIN_SOFT) -> DataFrame:
    """page_id, host, path, the longest rule that fits, the vocabulary's counts, and the verdict."""

    @F.pandas_udf("strict_hits int, soft_terms array<string>")
    def judged(urls: pd.Series) -> pd.DataFrame:
        found = [hits(u.lower(), strict, soft) for u in urls]
        return pd.DataFrame({"strict_hits": [x[0] for x in found], "soft_terms": [x[1] for x in found]})

    url = F.coalesce(F.col("url"), F.lit(""))
    base = pages.select("page_id", url.alias("url")).select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    base = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"), judged("url").alias("v"))
    method = F.when((F.col("v.strict_hits") > 0) | (F.size("v.soft_terms") >= min_soft), "block").otherwise("allow")
    return base.select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), F.col("v.strict_hits").alias("strict_hits"), F.array_join("v.soft_terms", ",").alias("soft_terms"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    case = lambda what: "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{t if what == 'rule' else s}'"
        for t, s in sorted(RULES, key=lambda r: -len(r[0]))
        for h, p in [t.split("/", 1)]
    ) + " END"
    hit = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    strict = " + ".join(f"len(regexp_extract_all(regexp_replace(low, '([^a-z0-9])', '\\1\\1', 'g'), '(^|[^a-z0-9]){t}([^a-z0-9]|$)'))" for t in STRICT)
    soft = "concat_ws(',', " + ", ".join(f"CASE WHEN {hit(t)} THEN '{t}' END" for t in sorted(SOFT)) + ")"
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
b AS (SELECT page_id, lower(url) AS low, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM a),
c AS (SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM b),
d AS (SELECT page_id, host, path, {case('rule')} AS rule, {case('says')} AS said, {strict} AS strict_hits, {soft} AS soft_terms FROM c)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN strict_hits > 0 OR soft_terms LIKE '%,%' THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(strict_hits AS INTEGER) AS strict_hits, soft_terms FROM d"""


QUERIES = {"op5_url_vocabulary": op5}
SQL = {"op5_url_vocabulary": _sql()}
