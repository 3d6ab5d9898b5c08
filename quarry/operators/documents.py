"""JSON and text operators: extraction, validation, slimming, reports."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names under which a depth range may stand.
RANGE_KEYS = ("expected_depth_ranges", "expected_range", "target_range", "depth_range", "depth_ranges")
#: Instruction fields that each model of a plan must have.
REQUIRED = {"traditional_code": "rules", "horizon_tracker": "seed_points", "attribute_extractor": "attributes", "sam": "prompt_value"}


_DECODER = json.JSONDecoder()
#: Braces in each other that the parser is given at most.
DEEPEST = 2_000
_MARK = re.compile(r'\\.|["{}]', re.S)


def _starts(text: str) -> list[tuple[int, int, int | None]]:
    """Every opening brace: its place, how many quotes are before it (odd or even), and where it closes.

    One with more than ``DEEPEST`` braces in each other counts as one that never closes.

    From a start on, quotes are read as seen from it: starts that see the same quotes
    share a stack, of which there are two, for a start inside a string of the other sees
    them the other way. A brace after a backslash is skipped by the starts before it,
    but is a start too: it closes where its stack falls below the height it began at.
    """
    stacks: tuple[list[list[int]], list[list[int]]] = ([], [])
    skipped: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
    seen: list[tuple[int, int]] = []
    closes: dict[int, int] = {}
    odd = 0
    for m in _MARK.finditer(text):
        c = m[0]
        if c == '"':
            odd ^= 1
        elif c == "{":
            seen.append((m.start(), odd))
            stacks[odd].append([m.start(), 0])
        elif c == "\\{":
            seen.append((m.end() - 1, odd))
            skipped[odd].setdefault(len(stacks[odd]), []).append(m.end() - 1)
        elif c == "}":
            for at in skipped[odd].pop(len(stacks[odd]), ()):
                closes[at] = m.end()
            if stacks[odd]:
                start, depth = stacks[odd].pop()
                if depth < DEEPEST:
                    closes[start] = m.end()
                if stacks[odd]:
                    stacks[odd][-1][1] = max(stacks[odd][-1][1], depth + 1)
    return [(at, side, closes.get(at)) for at, side in seen]


def first_json(text: str | None) -> str | None:
    """The first balanced, parseable, non-empty object in a text.

    Braces in strings do not count; a backslash skips the next character
    anywhere. A start that never closes ends the search for that start only, and one
    nested too deeply for the parser counts as unparseable.

    Where parsing fails, all starts that are open there and see the same quotes fail
    there as well, so they are passed over and the work is linear in the text.
    """
    text = text or ""
    failed = [-1, -1]
    for at, side, close in _starts(text):
        if close is None or at < failed[side] < close:
            continue
        try:
            got, _ = _DECODER.raw_decode(text, at)
        except json.JSONDecodeError as e:
            failed[side] = e.pos
        except RecursionError:
            continue
        else:
            if isinstance(got, dict) and got:
                return json.dumps(got)
    return None


@F.pandas_udf(T.StringType())
def extract_json(texts: pd.Series) -> pd.Series:
    """Arrow form of ``first_json``."""
    return texts.map(first_json)


def depth_ranges(raw: Column) -> Column:
    """Array of struct(top, bottom) from the spellings of a depth range in JSON.

    Objects with top_m/bottom_m or top/bottom, pairs, one flat pair; numbers may
    be strings. What cannot be read is left out; null gives an empty array.
    """
    pair = lambda t, b: F.struct(t.try_cast("double").alias("top"), b.try_cast("double").alias("bottom"))
    items = F.from_json(raw, "array<string>")
    obj = lambda s, *ks: F.coalesce(*[F.get_json_object(s, f"$.{k}") for k in ks])

    def one(s: Column) -> Column:
        nested = F.from_json(s, "array<string>")
        return F.when(s.startswith("{"), pair(obj(s, "top_m", "top"), obj(s, "bottom_m", "bottom"))).when(s.startswith("[") & (F.size(nested) >= 2), pair(F.get(nested, F.lit(0)), F.get(nested, F.lit(1))))

    flat = ~F.exists(items, lambda s: s.startswith("{") | s.startswith("["))
    found = F.when(flat & (F.size(items) >= 2), F.array(pair(F.get(items, F.lit(0)), F.get(items, F.lit(1))))).when(~flat, F.transform(items, one))
    return F.coalesce(F.filter(found, lambda r: r["top"].isNotNull() & r["bottom"].isNotNull()), F.array().cast("array<struct<top:double,bottom:double>>"))


def range_of(rule: Column) -> Column:
    """The first non-empty depth range of a rule object, as JSON."""
    empty = ("[]", "{}", "", "null")
    return F.coalesce(*[F.when(~F.get_json_object(rule, f"$.{k}").isin(*empty), F.get_json_object(rule, f"$.{k}")) for k in RANGE_KEYS])


def parse_scales(raw: Column) -> Column:
    """Numbers of a comma-separated list; what is none is left out."""
    return F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())


def section_after(text: Column, marker: str) -> Column:
    """What follows a heading line up to the next one of its level; the text itself without it."""
    return F.when(text.contains(marker), F.regexp_replace(F.substring_index(F.substring_index(text, marker, -1), "\n## ", 1), r"^\s+|\s+$", "")).otherwise(text)


def validate(df: DataFrame, raw: str, checks: list[tuple[str, Column, str]]) -> DataFrame:
    """Adds ``error``: the first failed check as ``path: message``, or null."""
    first = F.when(F.try_parse_json(raw).isNull() | F.col(raw).isNull(), F.lit("$: not JSON"))
    for path, ok, message in checks:
        first = first.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{path}: {message}"))
    return df.withColumn("error", first)


def validate_plan(plan: DataFrame) -> DataFrame:
    """Adds ``missing``: the instruction field that a step's model must have and lacks."""
    out = None
    for model, field in REQUIRED.items():
        lacks = (F.col("model") == model) & F.get_json_object("instruction", f"$.{field}").isNull()
        out = F.when(lacks, field) if out is None else out.when(lacks, field)
    return plan.withColumn("missing", out)


def slim_manifest(raw: Column) -> Column:
    """The part of a manifest that is passed on: ids, shape, views, names of available curves."""
    curves = F.from_json(F.get_json_object(raw, "$.well_logs.curves"), "array<struct<canonical_name:string,available:boolean>>")
    named = F.from_json(F.get_json_object(raw, "$.well_logs.curves"), "map<string,struct<canonical_name:string,available:boolean>>")
    none = F.array().cast("array<struct<canonical_name:string,available:boolean>>")
    present = F.coalesce(F.when(F.get_json_object(raw, "$.well_logs.curves").startswith("["), curves), F.map_values(named), none)
    return F.struct(F.get_json_object(raw, "$.sample_id").alias("sample_id"), F.get_json_object(raw, "$.task").alias("task"), F.get_json_object(raw, "$.seismic.shape").alias("shape"), F.transform(F.filter(present, lambda c: c["available"]), lambda c: c["canonical_name"]).alias("curves_present"))


def merge_maps(old: Column, new: Column) -> Column:
    """Both maps; entries of the second win."""
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, new)


def truncated(text: Column, limit: int, marker: str) -> Column:
    """At most ``limit`` characters, with a marker where something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(marker))).otherwise(text)
