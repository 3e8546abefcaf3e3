"""Columns as JSON text with a blank behind each comma and colon, and only the escapes that JSON asks for."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The short escapes; other control characters are written as four hexadecimal digits.
SHORT = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
_ESCAPES = SHORT | {chr(c): f"\\u{c:04x}" for c in range(32) if chr(c) not in SHORT}


def quoted(text: Column) -> Column:
    """A string literal; text that needs no escape is only put in quotes."""
    escaped = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), _ESCAPES.items(), text)
    return F.concat(F.lit('"'), F.when(text.rlike('[\\x00-\\x1f"\\\\]'), escaped).otherwise(text), F.lit('"'))


def json_text(value: Column, kind: T.DataType) -> Column:
    """The JSON text of a column of strings, booleans, whole numbers, arrays, maps and structs of these; null is ``null``.

    Map entries keep their order. Other types are a TypeError, since their text would depend on the engine.
    """
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        out = quoted(value)
    elif isinstance(kind, T.BooleanType) or isinstance(kind, T.IntegralType):
        out = value.cast("string")
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json_text(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, (T.StringType, T.BooleanType, T.IntegralType)):
        key = lambda k: quoted(k if isinstance(kind.keyType, T.StringType) else k.cast("string"))
        pairs = F.transform(F.map_entries(value), lambda e: F.concat(key(e["key"]), F.lit(": "), json_text(e["value"], kind.valueType)))
        out = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    elif isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(f"{json.dumps(f.name, ensure_ascii=False)}: "), json_text(value.getField(f.name), f.dataType)) for f in kind.fields]
        out = F.concat(F.lit("{"), F.array_join(F.array(*fields), ", ") if fields else F.lit(""), F.lit("}"))
    else:
        raise TypeError(f"no JSON text for {kind.simpleString()}")
    return F.when(value.isNull(), F.lit("null")).otherwise(out)


def with_json(frame: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """The frame with a column that holds the JSON object of these fields, in this order."""
    kind = frame.select(*fields).schema
    return frame.withColumn(column, json_text(F.struct(*fields), kind))
