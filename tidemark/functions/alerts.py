"""Alert rules, severities and CAP pieces as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANKS = {"unevaluated": -1, "clear": 0, "watch": 1, "warning": 2, "emergency": 3}
SEVERITY = {"emergency": "Extreme", "warning": "Severe", "watch": "Moderate", "clear": "Minor", "unevaluated": "Unknown"}
CONDITION_AGE_S, POSITION_AGE_S, CYCLONE_AGE_S = 3 * 3600, 30 * 60, 6 * 3600


def looked_up(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def threshold_rule(value: Column, caution: Column, avoid: Column, age_seconds: Column) -> Column:
    """Wave height and wind speed: null or old is unevaluated, not clear."""
    return F.when(value.isNull() | (age_seconds > CONDITION_AGE_S), "unevaluated").when(value >= avoid, "warning").when(value >= caution, "watch").otherwise("clear")


def lightning_rule(strikes: Column, freeboard: Column) -> Column:
    """No staleness gate; low boats are in an emergency."""
    return F.when(strikes.isNull(), "unevaluated").when(strikes >= 10, F.when(freeboard < 1.2, "emergency").otherwise("warning")).when(strikes >= 3, "watch").otherwise("clear")


def squall_rule(probability: Column) -> Column:
    return F.when(probability.isNull(), "unevaluated").when(probability >= 0.5, "warning").when(probability >= 0.3, "watch").otherwise("clear")


def cyclone_rule(knots: Column) -> Column:
    return F.when(knots.isNull(), "clear").when(knots >= 50, "emergency").when(knots >= 34, "warning").otherwise("watch")


def cone_rule(has_cone: Column, inside: Column) -> Column:
    return F.when(~has_cone, "unevaluated").when(inside, "watch").otherwise("clear")


def band_rule(band: Column) -> Column:
    return looked_up({"crossed": "emergency", "red": "warning", "amber": "watch", "clear": "clear"}, band)


def drift_rule(minutes: Column) -> Column:
    return F.when(minutes.isNull(), "clear").when(minutes <= 10, "emergency").when(minutes <= 20, "warning").otherwise("watch")


def rank(outcome: Column) -> Column:
    return looked_up(RANKS, outcome)


def severity(outcome: Column) -> Column:
    return looked_up(SEVERITY, outcome)


def urgency(rule: Column, outcome: Column, minutes: Column) -> Column:
    return F.when((outcome == "emergency") | ((rule == "geofence_drift") & (minutes <= 10)), "Immediate").when(outcome == "warning", "Expected").otherwise("Future")


def worst(results: Column) -> Column:
    """The highest fired element of array<struct<rule, outcome>>; the first of equals."""
    ranked = F.transform(results, lambda r, i: F.struct(rank(r["outcome"]).alias("rank"), (-i).alias("i"), r.alias("r")))
    top = F.array_max(F.filter(ranked, lambda x: x["rank"] >= 1))
    return top["r"]


def identifier(user: Column, rule: Column, sent: Column, salt: str = "") -> Column:
    return F.concat(F.lit("tm-"), F.substring(F.sha2(F.concat_ws("|", user, rule, sent.cast("string"), F.lit(salt)), 256), 1, 16))


def coverage_zone(km: Column) -> Column:
    return F.when(km <= 10, "nearshore").when(km <= 20, "marginal").otherwise("offshore")


def skip_reason(has_position: Column, at_sea: Column, age_seconds: Column, endpoints: Column) -> Column:
    """Why a subscriber isn't evaluated, the first that holds; null if evaluable."""
    return F.when(~has_position, "no_position").when(~at_sea, "ashore").when(age_seconds > POSITION_AGE_S, "stale").when(endpoints == 0, "unreachable")


def broadcast_reaches(in_fleet: Column, has_fleet: bool, has_position: Column, in_area: Column, has_area: bool) -> Column:
    """Fleet over area over everyone; an unknown position is included in an area."""
    return in_fleet if has_fleet else (~has_position | in_area) if has_area else F.lit(True)


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def cap_xml(identifier_: Column, sender: str, sent: Column, kind: Column, event: Column, urgency_: Column, severity_: Column, certainty: Column, headline: Column) -> Column:
    """A CAP 1.2 alert with one info block, its children in the order the standard asks."""
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), escaped(value), F.lit(f"</{name}>"))
    head = [tag("identifier", identifier_), tag("sender", F.lit(sender)), tag("sent", F.date_format(sent, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")), tag("status", F.lit("Actual")), tag("msgType", kind), tag("scope", F.lit("Public"))]
    info = [tag("category", F.lit("Met")), tag("event", event), tag("urgency", urgency_), tag("severity", severity_), tag("certainty", certainty), tag("headline", headline)]
    return F.concat(F.lit('<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2">'), *head, F.lit("<info>"), *info, F.lit("</info></alert>"))


def cap_issues(identifier_: Column, sender: Column, infos: Column) -> Column:
    """Names of the elements of an alert that are amiss, all of them, in document order.

    infos: array<struct<language, headline, instruction, effective, expires, areas>>, areas being their count.
    """
    word = lambda x: F.coalesce(x == "", F.lit(True)) | x.contains(" ")
    blank = lambda x: F.coalesce(x == "", F.lit(True))
    said = lambda pairs: F.filter(F.array(*[F.when(wrong, name) for name, wrong in pairs]), lambda x: x.isNotNull())

    def of(x: Column, i: Column) -> Column:
        earlier = F.transform(F.slice(infos, F.lit(1), i), lambda y: y["language"])
        return said([("info/language", F.array_contains(earlier, x["language"])), ("info/headline", blank(x["headline"])), ("info/headline", F.length(x["headline"]) > 160), ("info/instruction", blank(x["instruction"])), ("info/expires", x["expires"] <= x["effective"]), ("info/area", F.coalesce(x["areas"], F.lit(0)) == 0)])

    return F.concat(said([("identifier", word(identifier_)), ("sender", word(sender))]), F.flatten(F.transform(infos, of)))


def circle(lat: Column, lon: Column, km: Column) -> Column:
    """CAP circle text; null if a part is."""
    return F.when(lat.isNotNull() & lon.isNotNull() & km.isNotNull(), F.format_string("%.4f,%.4f %.1f", lat, lon, km))
