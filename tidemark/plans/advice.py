"""Queries over spoken texts, names in texts, alert checks and stricter retrieval, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import alerts as A
from tidemark.functions import speech
from tidemark.operators import retrieve
from tidemark.plans.catalogue import _GATE, _TOKENS, _gate, query
from tidemark.sources.views import cte, view

_READ = "WITH t AS (SELECT event_id, event_id % 7 AS a, event_id % 10 AS b, event_id % 7 + 1 AS c, event_id % 4 AS d, 20 + event_id % 10 AS e FROM events)"


def _bulletins(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    text = F.format_string("Swell %d.%d-%dm, wind %d km/h; sea %d°C.", n % 7, n % 10, n % 7 + 1, n % 4, n % 10 + 20)
    return view(spark, d, "events").select("event_id", text.alias("text"))


@query("spoken_bulletins", _READ + """ SELECT event_id, 'Swell ' || a || '.' || b || ' to ' || c || CASE c WHEN 1 THEN ' metre' ELSE ' metres' END || ', wind ' || d || CASE d WHEN 1 THEN ' kilometre' ELSE ' kilometres' END || ' per hour; sea ' || e || ' degrees Celsius.' AS text,
 a || '.' || b || ',' || c || ',' || d || ',' || e AS numbers, 'm,km/h,degC' AS units, false AS drifted FROM t""")  # fmt: skip
def spoken_bulletins(spark: SparkSession, d: str) -> DataFrame:
    rows = _bulletins(spark, d).select("event_id", speech.spoken(F.col("text")).alias("s"))
    return rows.select("event_id", "s.text", F.array_join("s.numbers", ",").alias("numbers"), F.array_join("s.units", ",").alias("units"), "s.drifted")


ALIASES = [("ofthe", 1), ("of", 2), ("is", 3), ("is", 4), ("andthe", 5), ("the", 5), ("in", 6), ("inthe", 6), ("undder", 7), ("und", 8), ("que", 9), ("dela", 10)]
_KEY = "lower(regexp_replace({0}, '[^\\p{{L}}\\p{{Nd}}]', '', 'g'))"


@query("places_in_texts", "WITH RECURSIVE al(alias, place_id) AS (VALUES " + ", ".join(f"('{a}', {p})" for a, p in ALIASES) + f"""), ag AS (SELECT alias, CASE WHEN count(DISTINCT place_id) = 1 THEN min(place_id) END AS place FROM al GROUP BY alias),
 w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '[,.]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS ws FROM documents), u AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS s FROM w),
 g AS (SELECT doc_id, s, k, array_to_string(ws[s:s + k - 1], ' ') AS phrase FROM u, (VALUES (1), (2), (3)) n(k) WHERE s + k - 1 <= len(ws)),
 m AS (SELECT doc_id, s, max(k) AS k, arg_max(phrase, k) AS phrase, arg_max(struct_pack(p := place), k).p AS place FROM g JOIN ag ON alias = {_KEY.format('phrase')} GROUP BY doc_id, s),
 walk AS (SELECT doc_id, min(s) AS s, arg_min(k, s) AS k FROM m GROUP BY doc_id UNION ALL SELECT walk.doc_id, min(m.s), arg_min(m.k, m.s) FROM walk JOIN m ON m.doc_id = walk.doc_id AND m.s >= walk.s + walk.k GROUP BY walk.doc_id),
 h AS (SELECT m.* FROM m JOIN walk USING (doc_id, s)), o AS (SELECT doc_id, min(s) AS s, arg_min(phrase, s) AS phrase, place FROM h GROUP BY doc_id, place, CASE WHEN place IS NULL THEN phrase END)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS ordinal, phrase, CASE WHEN place IS NULL THEN 'ambiguous' ELSE 'exact' END AS kind, CAST(place AS BIGINT) AS place_id FROM o""")  # fmt: skip
def places_in_texts(spark: SparkSession, d: str) -> DataFrame:
    aliases = spark.createDataFrame(ALIASES, "alias string, place_id bigint")
    normal = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{Nd}]", ""))
    return retrieve.places_in(view(spark, d, "documents"), "doc_id", "text", aliases, normal)


@query("lexical_all_topk", f"{cte('docs')}, {_GATE}, t AS (SELECT doc_id, {_TOKENS} AS t FROM g), l AS (SELECT doc_id, len(list_filter(t, lambda w: w IN ('the', 'of', 'and'))) AS total FROM t WHERE list_has_all(t, ['the', 'of', 'and']) AND NOT list_contains(t, 'nature') AND contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')) SELECT doc_id, CAST(3 AS INTEGER) AS matched, CAST(total AS INTEGER) AS total, row_number() OVER (ORDER BY total DESC, doc_id) AS rank FROM l QUALIFY rank <= 50")
def lexical_all_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.lexical(view(spark, d, "docs").where(_gate().predicate()), "doc_id", ("the", "of", "and"), every=True, phrases=["of the"], without=["nature"])


@query("cap_lint", """SELECT c_custkey AS vessel_id, concat_ws(',', CASE WHEN c_custkey % 5 = 0 THEN 'identifier' END, CASE WHEN c_custkey % 7 = 0 THEN 'sender' END,
 CASE WHEN c_custkey % 11 = 0 THEN 'info/headline' WHEN c_custkey % 11 = 1 THEN 'info/headline' END, CASE WHEN c_custkey % 3 = 0 THEN 'info/instruction' END, CASE WHEN c_custkey % 4 <> 1 THEN 'info/expires' END, CASE WHEN c_custkey % 6 = 0 THEN 'info/area' END, CASE WHEN c_custkey % 2 = 0 THEN 'info/language' END) AS issues FROM customer""")  # fmt: skip
def cap_lint(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_custkey")
    at = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    later = F.when(n % 4 == 0, at).when(n % 4 == 1, at + F.expr("INTERVAL 1 HOUR")).otherwise(at - F.expr("INTERVAL 1 HOUR"))
    info = lambda language, headline, instruction, expires, areas: F.struct(language.alias("language"), headline.alias("headline"), instruction.alias("instruction"), at.alias("effective"), expires.alias("expires"), areas.alias("areas"))
    first = info(F.lit("en"), F.when(n % 11 == 0, "").when(n % 11 == 1, F.repeat(F.lit("x"), 161)).otherwise("Gale"), F.when(n % 3 != 0, "Stay ashore"), later, (n % 6).cast("int"))
    second = info(F.when(n % 2 == 0, "en").otherwise("hi"), F.lit("Gale"), F.lit("Stay ashore"), F.lit(None).cast("timestamp_ntz"), F.lit(1))
    issues = A.cap_issues(F.when(n % 10 == 0, "").when(n % 5 == 0, "a b").otherwise("tm-1"), F.when(n % 7 == 0, F.lit(None)).otherwise("tidemark"), F.array(first, second))
    return view(spark, d, "customer").select(n.alias("vessel_id"), F.array_join(issues, ",").alias("issues"))
