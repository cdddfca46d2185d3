"""Schemas from dicts, DDL strings, Arrow, pandas, models and StructTypes."""

from __future__ import annotations

import typing
import warnings
from typing import Any

from pyspark.sql import types as T

ALIASES = {"str": "string", "utf8": "string", "int32": "int", "integer": "int", "int64": "bigint", "long": "bigint", "float32": "float", "float64": "double", "bool": "boolean", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "bytes": "binary", "int8": "int", "int16": "int"}
SURROGATES = {"uuid": (T.StringType(), "uuid"), "time": (T.LongType(), "time_micros")}


def parse_type(name: Any) -> tuple[T.DataType, dict]:
    """Spark type and field metadata of a type name; types that Parquet can't hold get a surrogate and say so in metadata."""
    if isinstance(name, T.DataType):
        return name, {}
    if isinstance(name, dict):
        return struct(name), {}
    low = name.strip().lower()
    if low in SURROGATES:
        kind, logical = SURROGATES[low]
        return kind, {"logical": logical}
    if low == "decimal":
        warnings.warn("decimal without precision: decimal(38,9)", stacklevel=3)
        return T.DecimalType(38, 9), {}
    if low.startswith("list<"):
        low = "array<" + low[5:]
    try:
        return T.DataType.fromDDL(ALIASES.get(low, low)), {}
    except Exception:
        inner = low
        for a, b in ALIASES.items():
            for left in "<,: ":
                for right in ">,":
                    inner = inner.replace(f"{left}{a}{right}", f"{left}{b}{right}")
        try:
            return T.DataType.fromDDL(inner), {}
        except Exception:
            warnings.warn(f"unknown type {name!r}: string", stacklevel=3)
            return T.StringType(), {}


def struct(spec: dict) -> T.StructType:
    fields = []
    for name, kind in spec.items():
        required = False
        if isinstance(kind, dict) and "type" in kind and isinstance(kind["type"], (str, dict, T.DataType)):
            required, kind = bool(kind.get("required")), kind["type"]
        data_type, meta = parse_type(kind)
        fields.append(T.StructField(name, data_type, not required, meta))
    return T.StructType(fields)


def from_model(model: type) -> T.StructType:
    """Schema of a model class with annotated fields (pydantic or plain): Optional fields are nullable."""
    hints = typing.get_type_hints(model)
    return T.StructType([T.StructField(n, *_hint(h)) for n, h in hints.items() if not n.startswith("_") and typing.get_origin(h) is not typing.ClassVar and n not in ("model_config", "model_fields")])


def _hint(h: Any) -> tuple[T.DataType, bool]:
    import datetime
    import decimal

    simple = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), datetime.datetime: T.TimestampNTZType(), datetime.date: T.DateType(), bytes: T.BinaryType(), decimal.Decimal: T.DecimalType(38, 9)}
    args = typing.get_args(h)
    if type(None) in args:
        rest = [a for a in args if a is not type(None)]
        return (_hint(rest[0])[0] if len(rest) == 1 else T.StringType()), True
    origin = typing.get_origin(h)
    if origin is list:
        return T.ArrayType(_hint(args[0])[0]), False
    if origin is dict:
        return T.MapType(_hint(args[0])[0], _hint(args[1])[0]), False
    if h in simple:
        return simple[h], False
    return (from_model(h), False) if hasattr(h, "__annotations__") else (T.StringType(), False)


def schema_of(x: Any) -> T.StructType:
    import pandas as pd
    import pyarrow as pa
    from pyspark.sql import DataFrame
    from pyspark.sql.pandas.types import from_arrow_schema

    if isinstance(x, T.StructType):
        return x
    if isinstance(x, DataFrame):
        return x.schema
    if isinstance(x, dict):
        return struct(x)
    if isinstance(x, str):
        return T.StructType.fromDDL(x)
    if isinstance(x, pd.DataFrame):
        x = pa.Schema.from_pandas(x, preserve_index=False)
    if isinstance(x, pa.Table):
        x = x.schema
    if isinstance(x, pa.Schema):
        return from_arrow_schema(x)
    return from_model(x)
