"""JSON values: leaves, comparable forms, shapes of arguments, checks, views without nulls."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions.python import flat_map

# Fixed values.
MAX_DEPTH, MAX_FIELDS, MAX_ITEMS, MIN_VALUE = 6, 200, 20, 3
# Ends of fixed values.


def leaves(value, path: str = "", depth: int = 0) -> list[tuple[str, object]]:
    """(path, value) of the strings and numbers of a nested value, within bounds of depth, items and fields."""
    if depth > MAX_DEPTH or value is None or isinstance(value, bool):
        return []
    if isinstance(value, dict):
        inner = [(f"{path}.{k}" if path else str(k), v) for k, v in value.items()]
    elif isinstance(value, list):
        inner = [(f"{path}[{i}]", v) for i, v in enumerate(value[:MAX_ITEMS])]
    else:
        return [(path, value)]
    out: list[tuple[str, object]] = []
    for p, v in inner:
        if len(out) >= MAX_FIELDS:
            break
        out += leaves(v, p, depth + 1)
    return out


def comparable(value) -> str | None:
    """Trimmed and folded text, or a number without trailing zeros; None for values too short to tell anything."""
    form = f"{value:.10g}" if isinstance(value, int | float) else value.strip().casefold() if isinstance(value, str) else ""
    return form if len(form) >= MIN_VALUE else None


def flattened(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id_col, field, value, form for each leaf of a JSON column; text that isn't JSON has none."""

    def make(i, raw):
        try:
            found = leaves(json.loads(raw or "null"))
        except ValueError:
            return []
        return [(i, p, v if isinstance(v, str) else json.dumps(v), comparable(v)) for p, v in found]

    return flat_map(rows.select(F.col(id_col).cast("string"), F.col(json_col).cast("string")), make, f"{id_col} string, field string, value string, form string")


def arg_shape(raw: str | None) -> str:
    """Names of a call's arguments with the kinds of their values, in order of the alphabet; no value shows."""
    kinds = {bool: "bool", int: "num", float: "num", str: "str", list: "list", type(None): "null"}
    try:
        args = json.loads(raw or "{}")
    except ValueError:
        return ""
    return ",".join(f"{k}:{kinds.get(type(args[k]), 'obj')}" for k in sorted(args)) if isinstance(args, dict) else ""


def when_shape(shape: Column) -> Column:
    """The clause that holds for calls of this shape only."""
    return F.concat(F.lit("shape == "), F.to_json(F.array(shape)).substr(F.lit(2), F.length(F.to_json(F.array(shape))) - 2))


def view(*columns: str) -> Column:
    """A JSON object of the columns that have a value."""
    return F.to_json(F.struct(*columns))


def conflict_pairs(rows: DataFrame, id_col: str, others: str) -> DataFrame:
    """a, b: undirected distinct pairs of each row and those that it contradicts."""
    flat = rows.select(F.col(id_col).alias("x"), F.explode(others).alias("y"))
    return flat.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()
