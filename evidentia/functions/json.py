"""Structured texts: closed schemas, schema rewriting, sentinels, error texts."""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unknown_keys(payload: Column, known: list[str]) -> Column:
    """Top-level keys of a JSON object that aren't known; null if it is no object."""
    return F.array_sort(F.array_except(F.json_object_keys(payload), F.array(*map(F.lit, known))))


def closed(payload: Column, schema: str, known: list[str]) -> Column:
    """The payload parsed, null if it is malformed or has unknown keys."""
    fine = F.size(unknown_keys(payload, known)) == 0
    return F.when(F.coalesce(fine, F.lit(False)), F.from_json(payload, schema))


def int_keys(values: Column) -> Column:
    """A map with its text keys as ints."""
    return F.transform_keys(values, lambda k, v: k.cast("int"))


def replace_sentinel(payload: Column, path: str, sentinel: str, value: Column) -> Column:
    """A JSON text with the one sentinel at `path` replaced; unchanged if it isn't there or stands more than once."""
    quoted = json.dumps(sentinel, ensure_ascii=False)
    once = (F.length(payload) - F.length(F.replace(payload, F.lit(quoted), F.lit("")))) == len(quoted)
    here = F.get_json_object(payload, path) == sentinel
    return F.when(F.coalesce(here & once, F.lit(False)), F.replace(payload, F.lit(quoted), F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2))).otherwise(payload)


def error_text(errors: Column) -> Column:
    """`path: message` of errors struct(path array<string>, message), joined by semicolons."""
    return F.array_join(F.transform(errors, lambda e: F.concat(F.array_join(e["path"], "."), F.lit(": "), e["message"])), "; ")


def _strict(node):
    """Every property required, none beside them, no defaults or titles, a constant as a choice of one."""
    if isinstance(node, list):
        return [_strict(x) for x in node]
    if not isinstance(node, dict):
        return node
    found = {}
    for key, value in node.items():
        if key in ("default", "title") and not (key in node.get("properties", {}) and isinstance(value, dict)):
            continue
        if key == "const":
            found["enum"] = [value]
        elif key in ("properties", "$defs"):
            found[key] = {k: _strict(v) for k, v in value.items()}
        else:
            found[key] = _strict(value)
    if "properties" in found:
        found |= {"required": sorted(found["properties"]), "additionalProperties": False}
    return found


@lru_cache(maxsize=1024)
def _strict_text(schema: str) -> str:
    return json.dumps(_strict(json.loads(schema)), ensure_ascii=False, sort_keys=True)


@F.arrow_udf(T.StringType())
def strict_schema(schemas: pa.Array) -> pa.Array:
    """A JSON schema in strict form, keys sorted."""
    return pa.array([None if s is None else _strict_text(s) for s in schemas.to_pylist()], pa.string())


@lru_cache(maxsize=1024)
def _bound_text(schema: str, values: str) -> str:
    tree = json.loads(schema)
    for name, value in json.loads(values).items():
        if name in tree.get("properties", {}):
            tree["properties"][name]["enum"] = [value]
    return json.dumps(tree, ensure_ascii=False, sort_keys=True)


@F.arrow_udf(T.StringType())
def bind_constants(schemas: pa.Array, constants: pa.Array) -> pa.Array:
    """A JSON schema whose root properties named in the constants (a JSON object) allow those values only."""
    rows = zip(schemas.to_pylist(), constants.to_pylist(), strict=True)
    return pa.array([s if s is None or v is None else _bound_text(s, v) for s, v in rows], pa.string())


def first_text(payload: Column) -> Column:
    """The first input_text part of a request's first input item."""
    parts = F.from_json(F.get_json_object(payload, "$.input[0].content"), "array<struct<type:string,text:string>>")
    return F.get(F.filter(parts, lambda p: p["type"] == "input_text"), F.lit(0))["text"]


def response_fields(payload: Column) -> Column:
    """struct(status, refusal, incomplete_reason, text) of a model response."""
    parts = F.from_json(F.get_json_object(payload, "$.output[0].content"), "array<struct<type:string,text:string,refusal:string>>")
    pick = lambda kind, name: F.get(F.filter(parts, lambda p: p["type"] == kind), F.lit(0))[name]
    return F.struct(
        F.get_json_object(payload, "$.status").alias("status"),
        pick("refusal", "refusal").alias("refusal"),
        F.get_json_object(payload, "$.incomplete_details.reason").alias("incomplete_reason"),
        pick("output_text", "text").alias("text"),
    )
