"""Structure of free-form JSON texts.

Depth and flattening recurse, which column expressions cannot, so one vectorised function walks each
parsed value; everything that follows from the walk is plain column arithmetic.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys that mark a kind of document.
API_KEYS = ["status", "data", "error", "message", "results", "response"]
SCHEMA_PAIR_KEYS = ["properties", "type", "required", "definitions", "$schema"]
SCHEMA_KEYS = ["$schema", "type", "properties", "required", "definitions", "allOf", "anyOf", "oneOf"]
TIME_PARTS = ["time", "date", "created", "updated"]
ID_KEYS = ["id", "_id", "uuid", "guid"]
META_KEYS = ["meta", "metadata", "_meta"]

_TEXTS, _INTS = T.ArrayType(T.StringType()), T.ArrayType(T.IntegerType())
_SHAPE = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in [
            ("kind", T.StringType()), ("depth", T.IntegerType()), ("keys", _TEXTS), ("key_count", T.IntegerType()), ("n_items", T.IntegerType()),
            ("value_types", T.MapType(T.StringType(), T.IntegerType())), ("nested", T.BooleanType()), ("arrays", T.BooleanType()), ("array_lengths", _INTS),
            ("flat_values", T.BooleanType()), ("all_objects", T.BooleanType()), ("same_keys", T.BooleanType()), ("schema", T.StringType()), ("content", T.StringType()),
        ]
    ]
)


def _depth(v, at=0):
    if isinstance(v, dict):
        return max((_depth(x, at + 1) for x in v.values()), default=at)
    if isinstance(v, list):
        return max((_depth(x, at + 1) for x in v[:10]), default=at)
    return at


def _schema(v):
    if isinstance(v, dict):
        return {k: _schema(x) if isinstance(x, (dict, list)) else type(x).__name__ for k, x in v.items()}
    if isinstance(v, list) and v:
        return {"type": "array", "items": _schema(v[0]), "length": len(v)}
    return type(v).__name__


def _words(v, at, out):
    if at > 10:
        return
    if isinstance(v, dict):
        for k, x in v.items():
            out.append(f"{k}:")
            _words(x, at + 1, out)
    elif isinstance(v, list):
        for x in v:
            _words(x, at + 1, out)
    elif v is not None:
        out.append(str(v))


def _describe(text: str):
    """Shape of one text; None if it is no JSON or nested deeper than Python can follow."""
    try:
        return _shape(json.loads(text))
    except (TypeError, ValueError, RecursionError):
        return None


def _shape(v):
    is_map, is_list = isinstance(v, dict), isinstance(v, list)
    looked = list(v.values()) if is_map else v[:10] if is_list else []
    types: dict[str, int] = {}
    for x in looked:
        types[type(x).__name__] = types.get(type(x).__name__, 0) + 1
    flat = is_map and all(not isinstance(x, (dict, list)) or (isinstance(x, dict) and _depth(x) <= 2) for x in looked)
    objects = is_list and all(isinstance(x, dict) for x in looked)
    words: list[str] = []
    _words(v, 0, words)
    return {
        "kind": type(v).__name__, "depth": _depth(v), "keys": list(v) if is_map else [], "key_count": len(v) if is_map else 0, "n_items": len(v) if is_list else 0,
        "value_types": types, "nested": any(isinstance(x, dict) for x in looked), "arrays": is_list or any(isinstance(x, list) for x in looked),
        "array_lengths": [len(x) for x in looked if isinstance(x, list)], "flat_values": flat, "all_objects": objects,
        "same_keys": bool(objects and looked) and all(set(x) == set(looked[0]) for x in looked), "schema": json.dumps(_schema(v)), "content": " ".join(words),
    }


@F.pandas_udf(_SHAPE)
def describe(texts: pd.Series) -> pd.DataFrame:
    """Shape of each JSON text; all null for text that is no JSON."""
    fields = _SHAPE.fieldNames()
    rows = [_describe(t) or dict.fromkeys(fields) for t in texts]
    return pd.DataFrame(rows, columns=fields)


def _count(keys: Column, known: list[str]) -> Column:
    return F.size(F.array_intersect(keys, F.array(*[F.lit(k) for k in known])))


def complexity(s: str) -> Column:
    c = lambda k: F.col(f"{s}.{k}")
    v = (
        c("depth") * 0.2
        + F.size(c("value_types")) * 0.1
        + F.when(c("nested"), 0.3).otherwise(0.0)
        + F.when(c("arrays"), 0.2).otherwise(0.0)
        + F.when(c("key_count") > 50, 0.3).when(c("key_count") > 20, 0.2).otherwise(0.0)
    )
    return F.least(v, F.lit(1.0))


def data_type(s: str) -> Column:
    c = lambda k: F.col(f"{s}.{k}")
    is_map, is_list = c("kind") == "dict", c("kind") == "list"
    return (
        F.when(is_map & (_count(c("keys"), API_KEYS) >= 2), "api_response")
        .when(is_map & c("flat_values"), "configuration")
        .when(is_list & (c("n_items") > 10) & c("all_objects"), "dataset")
        .when(is_map & (_count(c("keys"), SCHEMA_PAIR_KEYS) >= 2), "schema")
        .when(c("depth") > 3, "nested_data")
        .otherwise("general")
    )


def has_schema(s: str) -> Column:
    return _count(F.col(f"{s}.keys"), SCHEMA_KEYS) > 0


def patterns(s: str) -> Column:
    keys = F.col(f"{s}.keys")
    timed = F.exists(keys, lambda k: F.lower(k).rlike("|".join(TIME_PARTS)))
    return F.array_compact(
        F.array(
            F.when(timed, F.lit("timestamps")),
            F.when(_count(keys, ID_KEYS) > 0, F.lit("identifiers")),
            F.when(_count(keys, META_KEYS) > 0, F.lit("metadata")),
            F.when(F.col(f"{s}.same_keys"), F.lit("homogeneous_list")),
        )
    )
