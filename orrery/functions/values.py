"""Metadata values: what is stored for a Python value, and the column form that filters read.

A field is stored as struct(kind, text, num, items): kind is one of null, bool, number, string, array, object; text is the raw
string, or else the value's canonical JSON (numbers by exact magnitude: 10 and 10.0 are both 10; object keys sorted), so
that equality of values is equality of (kind, text); num is a number's double; items are an array's elements as canonical JSON.
"""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH = 128
FIELD = "struct<kind:string,text:string,num:double,items:array<string>>"


def stored(value: Any, depth: int = 0) -> Any:
    """The JSON value that is stored for a Python value: numbers beyond 64 bits become floats, what JSON lacks becomes its string."""
    if depth > MAX_DEPTH:
        raise ValueError(f"Metadata is nested more than {MAX_DEPTH} levels deep")
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, int):
        return value if -(2**63) <= value < 2**63 else stored(float(value))
    if isinstance(value, float):
        return value if math.isfinite(value) else "NaN" if math.isnan(value) else "inf" if value > 0 else "-inf"
    if isinstance(value, list):
        return [stored(v, depth + 1) for v in value]
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise TypeError("Metadata keys must be strings")
        return {k: stored(v, depth + 1) for k, v in value.items()}
    if hasattr(value, "item") and not hasattr(value, "__len__"):  # a NumPy scalar
        return stored(value.item(), depth)
    return str(value)


def canonical(value: Any) -> str:
    """JSON text that is equal exactly where stored values are."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (int, float)):
        return str(int(value)) if value == int(value) else repr(value)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value)) + "}"


def kind_of(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def field(value: Any) -> dict[str, Any]:
    """The column form of one stored value."""
    kind = kind_of(value)
    return {
        "kind": kind,
        "text": value if kind == "string" else canonical(value),
        "num": float(value) if kind == "number" else None,
        "items": [canonical(v) for v in value] if kind == "array" else None,
    }


def fields(metadata: dict[str, Any]) -> dict[str, dict[str, Any]]:
    return {k: field(v) for k, v in metadata.items()}


def json_field(document: Column, name: str) -> Column:
    """The column form of one top-level key of a JSON text column, by VARIANT functions; null where the key or the document is missing.

    A name is one key and never a path. Numbers inside arrays and objects keep the spelling of the document.
    """
    if "'" in name and '"' in name:
        raise ValueError("A path cannot name a key that has both kinds of quotes")
    path = f'$["{name}"]' if "'" in name else f"$['{name}']"
    return F.transform(F.array(F.variant_get(F.try_parse_json(document), path, "variant")), _variant_field)[0]


def _variant_field(value: Column) -> Column:
    schema = F.schema_of_variant(value)
    number = schema.isin("BIGINT", "DOUBLE") | schema.startswith("DECIMAL")
    kind = (
        F.when(value.isNull(), None)
        .when(F.is_variant_null(value), "null")
        .when(schema == "BOOLEAN", "bool")
        .when(number, "number")
        .when(schema == "STRING", "string")
        .when(schema.startswith("ARRAY"), "array")
        .otherwise("object")
    )
    text = F.try_variant_get(value, "$", "string")
    plain = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    exact = F.when(schema == "DOUBLE", F.coalesce(F.try_variant_get(value, "$", "decimal(38,0)").cast("string"), text)).otherwise(plain)
    exact = F.when((schema == "DOUBLE") & (F.try_variant_get(value, "$", "double") != F.floor(F.try_variant_get(value, "$", "double"))), text).otherwise(exact)
    spelled = F.when(kind == "string", text).when(kind == "number", exact).otherwise(F.to_json(value))
    items = F.when(kind == "array", F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.to_json(v)))
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), spelled.alias("text"), F.when(kind == "number", F.try_variant_get(value, "$", "double")).alias("num"), items.alias("items")))
