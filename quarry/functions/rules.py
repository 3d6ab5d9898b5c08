"""Threshold rules and the rule tables of lithology and fluids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (GR below, DEN below, class, confidence), first match; None is no bound.
LITHOLOGY = [
    (45, 2.35, "clean_sandstone", 0.85),
    (45, 2.55, "silty_sandstone", 0.80),
    (45, None, "calcareous_sandstone", 0.70),
    (75, 2.40, "silty_sandstone", 0.75),
    (75, 2.60, "shaly_sandstone", 0.75),
    (75, None, "sandy_shale", 0.70),
    (120, 2.50, "sandy_shale", 0.70),
    (120, 2.70, "shale", 0.85),
    (120, None, "calcareous_shale", 0.75),
]
#: Bounds of the fluids of each lithology, in order.
ML_FLUIDS = [
    ("clean_sandstone", "gas", "rt >= 50 AND den <= 2.35 AND cnl <= 0.20"),
    ("clean_sandstone", "oil", "rt >= 20 AND den <= 2.42"),
    ("clean_sandstone", "water", "rt <= 8"),
    ("silty_sandstone", "oil", "rt >= 15 AND den <= 2.45"),
    ("silty_sandstone", "water", "rt <= 10"),
    ("carbonate", "gas", "rt >= 80 AND den <= 2.55"),
    ("carbonate", "oil", "rt >= 30 AND den <= 2.60"),
]
_RULE = r"^\s*(\w+)\s*(<=|>=|<|>)\s*([0-9.]+)"
_BETWEEN = r"^\s*([0-9.]+)\s*<\s*(\w+)\s*<\s*([0-9.]+)"


def parse_rule(rule: Column) -> Column:
    """struct(variable, op, threshold) of ``var op number``; null if it is no such rule.

    What follows the first bound is ignored, as are rules with signs or a
    number in front.
    """
    var = F.regexp_extract(rule, _RULE, 1)
    number = F.regexp_extract(rule, _RULE, 3).try_cast("double")
    return F.when(rule.rlike(_RULE) & number.isNotNull(), F.struct(var.alias("variable"), F.regexp_extract(rule, _RULE, 2).alias("op"), number.alias("threshold")))


def holds(rule: Column, value: Column) -> Column:
    """Whether a value satisfies a rule, ``a < var < b`` included; false for no rule."""
    lo, hi = F.regexp_extract(rule, _BETWEEN, 1).try_cast("double"), F.regexp_extract(rule, _BETWEEN, 3).try_cast("double")
    p = parse_rule(rule)
    one = F.when(p["op"] == "<", value < p["threshold"]).when(p["op"] == ">", value > p["threshold"]).when(p["op"] == "<=", value <= p["threshold"]).when(p["op"] == ">=", value >= p["threshold"])
    return F.coalesce(F.when(rule.rlike(_BETWEEN), (lo < value) & (value < hi)).otherwise(one), F.lit(False))


def compare(value: Column, op: str, threshold: float) -> Column:
    """``value op threshold`` for the four operators of rules."""
    return {"<": value < threshold, "<=": value <= threshold, ">": value > threshold, ">=": value >= threshold}[op]


def lithology(gr: Column, den: Column, rt: Column) -> Column:
    """struct(lithology, confidence) by the table above and the branch of GR 120 and more."""
    pair = lambda name, conf: F.struct(F.lit(name).alias("lithology"), F.lit(float(conf)).alias("confidence"))
    out = None
    for g, d, name, conf in LITHOLOGY:
        cond = (gr < g) & (den < d) if d else gr < g
        out = F.when(cond, pair(name, conf)) if out is None else out.when(cond, pair(name, conf))
    return out.when((den < 2.5) & (rt > 20), pair("organic_rich_shale", 0.70)).otherwise(pair("shale", 0.85))


def fluid(rt: Column, den: Column) -> Column:
    """struct(fluid, confidence) by resistivity and density."""
    pair = lambda name, conf: F.struct(F.lit(name).alias("fluid"), F.lit(float(conf)).alias("confidence"))
    return F.when((rt > 50) & (den < 2.35), pair("gas", 0.85)).when((rt > 20) & (den < 2.40), pair("oil", 0.80)).when((rt > 15) & (den < 2.40), pair("oil_water", 0.65)).when(rt < 5, pair("water", 0.85)).otherwise(pair("water", 0.60))


def ml_fluid(lith: Column, rt: Column, den: Column, cnl: Column) -> Column:
    """The first fluid of a lithology whose bounds hold, else null."""
    bounds = {"rt": rt, "den": den, "cnl": cnl}
    out = F.lit(None).cast("string")
    for name, what, rule in reversed(ML_FLUIDS):
        cond = lith == name
        for part in rule.split(" AND "):
            var, op, number = part.split()
            cond = cond & compare(bounds[var], op, float(number))
        out = F.when(cond, what).otherwise(out)
    return out


def two_stage_fluid(rt: Column, den: Column) -> Column:
    """Gas, oil, water or unknown by two thresholds of resistivity."""
    return F.when((rt > 20) & (den < 2.35), "gas").when(rt > 20, "oil").when(rt < 5, "water").otherwise("unknown")
