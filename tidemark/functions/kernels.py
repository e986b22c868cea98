"""Scores and flags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHTS = {"wave": 0.45, "wind": 0.30, "swell": 0.15, "squall": 0.10}
MIN_RELIABILITY, SAFE, CAUTION = 0.25, 70.0, 40.0


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def hazard(value: Column, caution: Column, avoid: Column) -> Column:
    """0 up to caution, 1 from avoid, linear between."""
    return clamp((value - caution) / (avoid - caution), 0.0, 1.0)


def swell_hazard(period: Column, comfortable: Column) -> Column:
    """0 from the comfortable period, 1 at half of it."""
    return clamp((comfortable - period) / (comfortable - comfortable / 2.0), 0.0, 1.0)


def margin_factor(freeboard: Column, length: Column, power: Column) -> Column:
    """Freeboard against 8 % of the length, within .9 and 1.1; without an engine at most 1."""
    found = clamp(freeboard / (length * 0.08), 0.9, 1.1)
    return F.when(power > 0, found).otherwise(F.least(found, F.lit(1.0)))


def safety_value(wave: Column, wind: Column, swell: Column, squall: Column, margin: Column, c) -> tuple[Column, Column]:
    """Unrounded score and the weight of the drivers present; c names the class thresholds."""
    use_swell, use_squall = swell.isNotNull(), squall.isNotNull()
    w = WEIGHTS
    total = w["wave"] * hazard(wave, c("caution_wave"), c("avoid_wave")) + w["wind"] * hazard(wind, c("caution_wind"), c("avoid_wind"))
    total = total + F.when(use_swell, w["swell"] * swell_hazard(swell, c("min_period"))).otherwise(0.0)
    total = total + F.when(use_squall, w["squall"] * clamp(squall, 0.0, 1.0)).otherwise(0.0)
    weight = F.lit(w["wave"] + w["wind"]) + F.when(use_swell, w["swell"]).otherwise(0.0) + F.when(use_squall, w["squall"]).otherwise(0.0)
    return (1.0 - clamp(total / weight / margin, 0.0, 1.0)) * 100.0, weight


def tenths(x: Column) -> Column:
    """Rounded to one decimal place, as an integer of tenths: the same in any engine."""
    return F.floor(x * 10.0 + 0.5).cast("long")


def safety_band(score: Column) -> Column:
    return F.when(score >= SAFE, "safe").when(score >= CAUTION, "caution").otherwise("avoid")


def confidence_spread(reliability: Column, weight: Column, can_call: Column) -> Column:
    return 3.0 + (1.0 - reliability) * 25.0 + (1.0 - weight) * 20.0 + F.when(can_call, 0.0).otherwise(5.0)


def pfz_weight(age_hours: Column) -> Column:
    """1 up to 56 h, linear to 0 at 112 h; null counts as 0."""
    return F.coalesce(clamp((112.0 - age_hours) / 56.0, 0.0, 1.0), F.lit(0.0))


def catch_signal(km: Column, age_hours: Column, front: Column, chlorophyll: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - km / 50.0), F.lit(0.0)) * pfz_weight(age_hours) + front + chlorophyll


def bloom_flag(value: Column, baseline: Column) -> Column:
    """high, medium or null."""
    ratio = value / F.when(baseline > 0, baseline)
    return F.when((ratio >= 3.0) & (value >= 1.0), F.when(ratio >= 5.0, "high").otherwise("medium"))


def slick_flag(value: Column, baseline: Column) -> Column:
    return F.when((value <= 0.05) & (value < 0.2 * baseline), "low")


def step_cost(wave: Column, wind: Column, current: Column) -> Column:
    """Cost of entering a cell, before the length of the step."""
    return F.greatest(F.lit(0.1), 1.0 + 2.0 * wave + 0.6 * (wind / 10.0) - current)


def coherence(value: Column, reason: Column, detail: Column) -> Column:
    """Why a kernel's result contradicts itself, or null: it abstains with a value or without an explanation, or has no
    value and no reason."""
    issue = F.when(reason.isNotNull() & value.isNotNull(), "an abstention returns a value")
    issue = issue.when(reason.isNotNull() & (F.coalesce(detail, F.lit("")) == ""), "an abstention does not explain itself")
    return issue.when(reason.isNull() & value.isNull(), "no value and no reason")
