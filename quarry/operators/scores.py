"""Scores of interpretation answers (JSON text) against what is known, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A summary must be longer; a predicted top may be off by so many metres; a fault by so many traces.
SUMMARY, NEAR_TOP, NEAR_CDP = 20, 50.0, 20.0
#: How many of an answer's zones are looked at.
ZONES, FLUIDS = 12, 5
#: Words for sand and for shale.
SAND, SHALE = ("sand", "砂岩", "sandstone"), ("shale", "泥岩", "mudstone", "clay")
QUALITIES, DECISIONS = ("excellent", "good", "acceptable", "poor"), ("drill_ready", "data_gap", "inventory", "drop")
RISKS = ("trap_risk", "reservoir_risk", "seal_risk", "charge_risk")


def _list(raw: Column, path: str) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(raw, f"$.{path}"), "array<string>"), F.array().cast("array<string>"))


def _told(raw: Column, field: str) -> Column:
    return F.coalesce(F.length(F.get_json_object(raw, f"$.{field}")) > SUMMARY, F.lit(False))


def _one(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)).cast("double")


def _number(text: Column, path: str) -> Column:
    return F.get_json_object(text, path).try_cast("double")


def seismic_score(raw: Column, cdp: float, kind: str) -> Column:
    """struct(fault_detected, cdp_error, cdp_ok, type_match, anomaly_detected, overall).

    The fault is the first whose first position is not at trace 0, else the first.
    """
    faults = _list(raw, "faults")
    at = lambda f: F.coalesce(_number(f, "$.positions[0][0]"), _number(f, "$.positions[0]"), F.lit(0.0))
    best = F.coalesce(F.get(F.filter(faults, lambda f: at(f) != 0), F.lit(0)), F.get(faults, F.lit(0)))
    error = F.when(F.size(faults) > 0, F.abs(at(best) - F.lit(cdp)))
    odd = F.size(_list(raw, "anomalies")) > 0
    overall = (_one(F.size(faults) > 0) + 0.5 * _one(odd) + 0.5 * _one(_told(raw, "summary"))) / 2.0
    return F.struct((F.size(faults) > 0).alias("fault_detected"), error.alias("cdp_error"), (error < NEAR_CDP).alias("cdp_ok"), F.lower(F.get_json_object(best, "$.type")).contains(kind).alias("type_match"), odd.alias("anomaly_detected"), overall.alias("overall"))


def log_score(raw: Column, sands: list[float], shales: list[float], fluids: list[tuple[float, str]]) -> Column:
    """struct(matched, sand_recall, depth_error, fluid_recall, reservoirs, overall).

    Known sands and shales are given by their tops; each predicted zone meets the
    first known one of a kind within reach and counts if it has a word for it.
    """
    zones = F.slice(_list(raw, "lithology_zones"), 1, ZONES)

    def hits(zone: Column, tops: list[float], words: tuple[str, ...]) -> Column:
        top, name = F.coalesce(_number(zone, "$.depth_top"), F.lit(0.0)), F.lower(F.coalesce(F.get_json_object(zone, "$.lithology"), F.lit("")))
        named = F.lit(False)
        for w in words:
            named = named | name.contains(w)
        off = F.filter(F.array(*[F.abs(top - F.lit(float(t))) for t in tops]) if tops else F.array().cast("array<double>"), lambda d: d < NEAR_TOP)
        return F.when(named & (F.size(off) > 0), F.slice(off, 1, 1)).otherwise(F.array().cast("array<double>"))

    errors = F.flatten(F.transform(zones, lambda z: F.concat(hits(z, sands, SAND), hits(z, shales, SHALE))))
    matched = F.size(errors)
    recall = matched / float(len(sands)) if sands else F.lit(0.0)

    def fluid_hit(zone: Column) -> Column:
        top, name = F.coalesce(_number(zone, "$.depth_top"), F.lit(0.0)), F.lower(F.coalesce(F.get_json_object(zone, "$.fluid_type"), F.lit("")))
        out = F.lit(0)
        for t, kind in reversed(fluids):
            out = F.when(F.abs(top - F.lit(float(t))) < NEAR_TOP, F.when(name.contains(kind), 1).otherwise(0)).otherwise(out)
        return out

    found = F.aggregate(F.transform(F.slice(_list(raw, "fluid_zones"), 1, FLUIDS), fluid_hit), F.lit(0), lambda a, x: a + x)
    fluid = found / float(len(fluids)) if fluids else F.lit(0.0)
    reservoirs = F.size(_list(raw, "reservoir_zones"))
    overall = (recall + fluid + 0.5 * F.least(reservoirs / 2.0, F.lit(1.0)) + 0.5 * _one(_told(raw, "summary"))) / 3.0
    error = F.when(matched > 0, F.aggregate(errors, F.lit(0.0), lambda a, x: a + x) / matched).otherwise(F.lit(999.0))
    return F.struct(matched.alias("matched"), recall.alias("sand_recall"), error.alias("depth_error"), fluid.alias("fluid_recall"), reservoirs.alias("reservoirs"), overall.alias("overall"))


def fusion_score(raw: Column) -> Column:
    """struct(has_calibration, correlation_in_range, quality_valid, interfaces, overall)."""
    calib = F.get_json_object(raw, "$.well_seismic_calibration")
    has = F.coalesce((calib != "{}") & (calib != "null"), F.lit(False))
    fits = F.coalesce(_number(calib, "$.correlation_coefficient").between(0, 1), F.lit(False))
    interfaces = F.size(_list(raw, "key_geological_interfaces"))
    overall = 0.5 * (_one(has) + _one(fits) + _one(interfaces > 0) + _one(_told(raw, "fusion_summary"))) / 2.0
    return F.struct(has.alias("has_calibration"), fits.alias("correlation_in_range"), F.coalesce(F.get_json_object(calib, "$.calibration_quality").isin(*QUALITIES), F.lit(False)).alias("quality_valid"), interfaces.alias("interfaces"), overall.alias("overall"))


def prospect_score(raw: Column) -> Column:
    """struct(targets, has_risk, risk_in_range, has_decision, has_pg, overall), by the first target."""
    targets = _list(raw, "targets")
    first = F.get(targets, F.lit(0))
    risk = lambda k: _number(first, f"$.risk_assessment.{k}")
    there = inside = F.lit(True)
    for k in RISKS:
        there = there & F.get_json_object(first, f"$.risk_assessment.{k}").isNotNull()
        inside = inside & F.coalesce(risk(k).between(1, 5), F.lit(False))
    decided = F.coalesce(F.get_json_object(first, "$.decision.category"), F.get_json_object(first, "$.decision")).isin(*DECISIONS)
    chance = risk("geological_success_probability_pct")
    flags = {"has_risk": there & first.isNotNull(), "risk_in_range": inside & first.isNotNull(), "has_decision": decided, "has_pg": (chance > 0) & (chance <= 100)}
    flags = {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}
    overall = (sum((_one(v) for v in flags.values()), F.lit(0.0)) + _one(_told(raw, "overall_summary"))) / 5.0
    return F.struct(F.size(targets).alias("targets"), *[v.alias(k) for k, v in flags.items()], overall.alias("overall"))
