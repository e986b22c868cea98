"""Queries over alert texts, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import messages
from tidemark.plans.catalogue import query
from tidemark.sources.views import cte, view

_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_N = "vessel_id"


def fired(spark: SparkSession, d: str) -> DataFrame:
    """Every rule of every vessel, with what was observed and the context that is known."""
    n = F.col("vessel_id")
    rules = F.explode(F.array(*map(F.lit, sorted(messages.TEMPLATE_OF)))).alias("rule")
    seen = F.map_from_arrays(F.array(*map(F.lit, ("wave_height_m", "wind_speed_ms", "distance_km", "minutes"))), F.array(F.col("wave_height_m") + 0.03, F.col("wind_speed_ms"), F.when(n % 4 != 0, (n % 90) / 7.0), F.when(n % 6 != 0, (n % 45).cast("double"))))
    told = {"location": F.when(n % 13 != 0, F.concat(F.lit("cell "), n.cast("string"))), "harbour": F.when(n % 17 != 0, F.lit("Rameswaram")), "distance": F.when(n % 19 != 0, F.concat((n % 40).cast("string"), F.lit(" km"))), "valid_until": F.lit("18:00"), "issued": F.lit("06:00"), "system": F.lit("Alpha")}
    context = F.map_from_arrays(F.array(*map(F.lit, told)), F.array(*told.values()))
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a vessel makes 32 texts, and a small file would be one task
    return view(spark, d, "vessels").repartition(wide, "vessel_id").select("vessel_id", rules, seen.alias("observed"), context.alias("context"))


def told(spark: SparkSession, d: str) -> DataFrame:
    """The texts of every rule of every vessel in every language; slots are the same in all languages and made once."""
    tongues = F.explode(F.array(*[F.lit(x) for x in ("en", "hi", "ta", "bn")])).alias("language")
    rows = messages.with_slots(fired(spark, d)).select("vessel_id", "rule", "template", "slots", tongues)
    return messages.rendered(rows, messages.templates(spark))


def _sql() -> str:
    forms = ", ".join(f"('{t}', '{lang}', '{form}')" for t, by in messages.FORMS.items() for lang, form in by.items())
    rules = ", ".join(f"('{r}', '{t}')" for r, t in messages.TEMPLATE_OF.items())
    shown = lambda x, digits, unit: f"printf('%.{digits}f {unit}', {x})"
    slots = {
        "system": "'Alpha'", "location": "loc", "authority": f"'{messages.AUTHORITY}'", "issued": "'06:00'", "valid_until": "'18:00'", "harbour": "harbour", "bearing": "'unknown'", "speed": "'unknown'",
        "boundary": f"'{messages.BOUNDARY}'", "wave_height": f"coalesce({shown('wave_height_m', 1, 'm')}, CASE WHEN t = 'return_to_shore' THEN 'not reported' END)", "wind_speed": f"coalesce({shown('wind_speed_ms', 1, 'm/s')}, 'not reported')",
        "distance": f"CASE WHEN t = 'near_boundary' THEN coalesce({shown('km', 1, 'km')}, dist, 'unknown distance') ELSE dist END", "time": f"coalesce({shown('minutes', 0, 'min')}, 'an unknown time')",
    }
    text = "form"
    for name, value in slots.items():
        text = f"replace({text}, '{{{name}}}', coalesce({value}, '#'))"
    lacking = lambda t: "concat_ws(',', " + ", ".join(f"CASE WHEN ({slots[s]}) IS NULL THEN '{s}' END" for s in sorted(messages.slots_of(messages.FORMS[t]["en"]))) + ")"
    missing = "CASE t " + " ".join(f"WHEN '{t}' THEN {lacking(t)}" for t in messages.FORMS) + " END"
    return f"""{cte('vessels')}, f(t, lang, form) AS (VALUES {forms}), r(rule, t) AS (VALUES {rules}), l(language, used) AS (VALUES ('en', 'en'), ('hi', 'hi'), ('ta', 'ta'), ('bn', 'en')),
 v AS (SELECT vessel_id, wave_height_m + 0.03 AS wave_height_m, wind_speed_ms, CASE WHEN {_N} % 4 <> 0 THEN ({_N} % 90) / 7.0::DOUBLE END AS km, CASE WHEN {_N} % 6 <> 0 THEN CAST({_N} % 45 AS DOUBLE) END AS minutes, CASE WHEN {_N} % 13 <> 0 THEN concat('cell ', {_N}) END AS loc, CASE WHEN {_N} % 17 <> 0 THEN 'Rameswaram' END AS harbour, CASE WHEN {_N} % 19 <> 0 THEN concat({_N} % 40, ' km') END AS dist FROM vessels),
 x AS (SELECT vessel_id, rule, language, used, {missing} AS missing, {text} AS text FROM v, r JOIN f USING (t), l WHERE lang = used)
 SELECT vessel_id, rule, language, used AS said_in, missing, CASE WHEN missing = '' THEN text END AS text FROM x"""


@query("alert_messages", _sql())
def alert_messages(spark: SparkSession, d: str) -> DataFrame:
    """The text of every rule for every vessel in every language; without a slot's value there is none."""
    rows = told(spark, d)
    return rows.select("vessel_id", "rule", "language", "said_in", F.array_join("missing", ",").alias("missing"), "text")


@query("spoken_messages", f"WITH a AS ({_sql()}) SELECT language, count(text) AS read_out, count(*) FILTER (text IS NULL) AS withheld FROM a GROUP BY language")
def spoken_messages(spark: SparkSession, d: str) -> DataFrame:
    """How many of them can be read out: none may say other numbers than its text."""
    rows = messages.for_speech(told(spark, d))
    return rows.groupBy("language").agg(F.count(F.when(~F.col("drifted"), F.col("spoken"))).alias("read_out"), F.count_if(F.col("spoken").isNull()).alias("withheld"))
