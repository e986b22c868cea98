"""Alert texts by template: no text is generated, every word is a template's or a slot's.

Templates are compiled once to arrays of segments and slot names. Slots are typed: a measurement is formatted from the very
value that a rule has held against its threshold, a name is taken from the context, and a slot without a value withholds
the text instead of leaving a gap in it. Rows meet templates by (template, language); a language without a form falls back.
A text whose numbers aren't those of its template and slots, in order, is withheld too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import speech
from tidemark.functions.alerts import looked_up
from tidemark.functions.text import numbers
from tidemark.operators.records import measurement

FALLBACK = "en"
AUTHORITY, BOUNDARY = "INCOIS", "India-Sri Lanka maritime boundary"
# fixed values: the template that each rule speaks by
TEMPLATE_OF = {
    "cyclone_cone": "cyclone", "cyclone_wind": "cyclone", "geofence_drift": "near_boundary", "geofence_proximity": "near_boundary",
    "lightning": "return_to_shore", "squall": "return_to_shore", "wave_height": "high_wave", "wind_speed": "return_to_shore",
}
FORMS = {
    "cyclone": {
        "en": "Cyclone {system} is {distance} from {location}, moving {bearing} at {speed}. Source {authority}, issued at {issued}. Keep away from the sea.",
        "hi": "चक्रवात {system}, {location} से {distance} पर, दिशा {bearing}, गति {speed}। स्रोत {authority}, समय {issued}। समुद्र से दूर रहें।",
        "ta": "புயல் {system}, {location} இலிருந்து {distance}, திசை {bearing}, வேகம் {speed}. ஆதாரம் {authority}, நேரம் {issued}. கடலுக்குச் செல்லாதீர்கள்.",
    },
    "high_wave": {
        "en": "High waves of {wave_height} near {location} until {valid_until}. Source {authority}.",
        "hi": "{location} के पास {valid_until} तक {wave_height} ऊंची लहरें। स्रोत {authority}।",
        "ta": "{location} அருகே {valid_until} வரை {wave_height} உயர அலைகள். ஆதாரம் {authority}.",
    },
    "return_to_shore": {
        "en": "Return to shore now. Near {location} waves are {wave_height} and wind is {wind_speed}. Nearest harbour {harbour}, {distance} away.",
        "hi": "अभी तट पर लौटें। {location} के पास लहरें {wave_height}, हवा {wind_speed}। निकटतम बंदरगाह {harbour}, {distance} दूर।",
        "ta": "உடனே கரைக்குத் திரும்புங்கள். {location} அருகே அலை {wave_height}, காற்று {wind_speed}. அருகிலுள்ள துறைமுகம் {harbour}, {distance} தொலைவில்.",
    },
    "near_boundary": {
        "en": "You are {distance} from the {boundary}, {time} at this course. Turn back.",
        "hi": "आप {boundary} से {distance} दूर हैं, इस दिशा में {time}। वापस मुड़ें।",
        "ta": "நீங்கள் {boundary} இலிருந்து {distance} தொலைவில், இந்தத் திசையில் {time}. திரும்புங்கள்.",
    },
}
NAME = r"\{([a-z_]+)\}"


def slots_of(form: str) -> list[str]:
    return re.findall(NAME, form)


def templates(spark: SparkSession, forms: dict[str, dict[str, str]] = FORMS) -> DataFrame:
    """template, language, segments, names: a form's text around its slots, and the slots in order."""
    rows = spark.createDataFrame([(t, lang, form) for t, by in forms.items() for lang, form in by.items()], "template string, language string, form string")
    return rows.select("template", "language", F.split("form", r"\{[a-z_]+\}").alias("segments"), F.regexp_extract_all("form", F.lit(NAME), F.lit(1)).alias("names"))


def slot_values(rule: Column, observed: Column, context: Column) -> Column:
    """map of slot to text for a rule's template; null where a slot that it needs has no value.

    observed: map<string,double> of what the rule has seen; context: map<string,string> of names and times.
    """
    seen = lambda name: F.try_element_at(observed, F.lit(name))
    told = lambda name: F.try_element_at(context, F.lit(name))
    template = looked_up(TEMPLATE_OF, rule)
    wave = F.coalesce(measurement(seen("wave_height_m"), F.lit("m")), told("wave_height"))
    wind = F.coalesce(measurement(seen("wind_speed_ms"), F.lit("m/s")), told("wind_speed"), F.lit("not reported"))
    away = F.coalesce(measurement(seen("distance_km"), F.lit("km")), told("distance"), F.lit("unknown distance"))
    time = F.coalesce(measurement(seen("minutes"), F.lit("min"), 0), F.lit("an unknown time"))
    authority = F.coalesce(told("authority"), F.lit(AUTHORITY))
    made = {
        "cyclone": {"system": told("system"), "distance": told("distance"), "location": told("location"), "bearing": F.coalesce(told("bearing"), F.lit("unknown")), "speed": F.coalesce(told("speed"), F.lit("unknown")), "authority": authority, "issued": told("issued")},
        "high_wave": {"wave_height": wave, "location": told("location"), "valid_until": told("valid_until"), "authority": authority},
        "return_to_shore": {"location": told("location"), "wave_height": F.coalesce(wave, F.lit("not reported")), "wind_speed": wind, "harbour": told("harbour"), "distance": told("distance")},
        "near_boundary": {"distance": away, "boundary": F.lit(BOUNDARY), "time": time},
    }
    out = F.lit(None).cast("map<string,string>")
    for name, slots in made.items():
        out = F.when(template == name, F.map_from_arrays(F.array(*map(F.lit, slots)), F.array(*slots.values()))).otherwise(out)
    return out


def with_slots(results: DataFrame) -> DataFrame:
    """results(rule, observed, context, ...) with template and slots."""
    return results.withColumn("template", looked_up(TEMPLATE_OF, F.col("rule"))).withColumn("slots", slot_values(F.col("rule"), F.col("observed"), F.col("context")))


def rendered(rows: DataFrame, forms: DataFrame, fallback: str = FALLBACK) -> DataFrame:
    """rows(template, language, slots, ...) with said_in, missing (slots without a value), note and text; null text is not
    to be sent. forms is a small fixed table."""
    own = forms.select(F.col("template").alias("_t"), F.col("language").alias("_l"), F.struct("segments", "names").alias("_own"))
    spare = forms.where(F.col("language") == fallback).select(F.col("template").alias("_u"), F.struct("segments", "names").alias("_spare"))
    met = rows.join(F.broadcast(own), (F.col("template") == F.col("_t")) & (F.col("language") == F.col("_l")), "left").join(F.broadcast(spare), F.col("template") == F.col("_u"), "left")
    form = F.coalesce("_own", "_spare")
    value = lambda name: F.try_element_at("slots", name)
    met = met.withColumn("_f", form).withColumn("said_in", F.when(F.col("_own").isNotNull(), F.col("language")).when(F.col("_spare").isNotNull(), fallback))
    met = met.withColumn("missing", F.array_sort(F.array_distinct(F.filter("_f.names", lambda n: value(n).isNull()))))
    names, segments = F.col("_f.names"), F.col("_f.segments")
    parts = F.flatten(F.transform(segments, lambda s, i: F.array(s, F.coalesce(value(F.get(names, i)), F.lit("")))))
    # parts and their text are used twice each: columns of their own, they are made once
    met = met.withColumn("_parts", parts).withColumn("_text", F.array_join("_parts", ""))
    drifted = ~numbers(F.col("_text")).eqNullSafe(numbers(F.array_join("_parts", " ")))
    note = F.when(F.col("_f").isNull(), "no such template").when(F.size("missing") > 0, F.concat(F.lit("no value for "), F.array_join("missing", ", "))).when(drifted, "the text's numbers are not its slots'")
    return met.withColumn("note", note).withColumn("text", F.when(F.col("note").isNull(), F.col("_text"))).drop("_t", "_l", "_u", "_own", "_spare", "_f", "_parts", "_text")


def for_speech(messages: DataFrame) -> DataFrame:
    """Add spoken (null where there is no text) and drifted: rows that drift must not be read out."""
    rows = messages.withColumn("_s", speech.read_out(F.col("text"), F.col("said_in")))
    return rows.withColumn("spoken", F.col("_s.text")).withColumn("drifted", F.coalesce("_s.drifted", F.lit(False))).drop("_s")


def headline(text: Column, most: int = 160) -> Column:
    """The first sentence, or its beginning and an ellipsis if it is longer than `most`; null text gives null."""
    first = F.trim(F.substring_index(text, ".", 1))
    first = F.when(first == "", F.trim(text)).otherwise(first)
    return F.when(F.length(first) <= most, first).otherwise(F.concat(F.rtrim(F.substring(first, 1, most - 3)), F.lit("…")))
