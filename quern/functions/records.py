"""Rows as JSON records and back, and the physical view of typed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a record shows for bytes that aren't UTF-8.
NOT_UTF8 = "<non-utf8-string>"


def has_binary(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(has_binary(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return has_binary(kind.elementType)
    if isinstance(kind, T.MapType):
        return has_binary(kind.keyType) or has_binary(kind.valueType)
    return isinstance(kind, T.BinaryType)


def _text(value: Column) -> Column:
    as_text = value.cast("string")
    return F.when(value.isNotNull(), F.when(F.is_valid_utf8(as_text), as_text).otherwise(NOT_UTF8))


def readable(value: Column, kind: T.DataType) -> Column:
    """``value`` with every binary leaf as text; columns without one are left alone."""
    if not has_binary(kind):
        return value
    if isinstance(kind, T.StructType):
        inner = F.struct(*(readable(value.getField(f.name), f.dataType).alias(f.name) for f in kind))
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: readable(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(readable(e["key"], kind.keyType).alias("key"), readable(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(entries)
    return _text(value)


def record_json(df: DataFrame, keep_nulls: bool = False, null_rows: bool = False) -> Column:
    """Each row as one JSON object.

    Null fields are left out, at the top and inside structs, unless
    ``keep_nulls``; null elements of arrays stay. Bytes are shown as text, or
    as NOT_UTF8. A row of nulls is ``{}``, or ``null`` if ``null_rows``.
    """
    fields = [readable(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]
    out = F.to_json(F.struct(*fields), {"ignoreNullFields": str(not keep_nulls).lower()}) if fields else F.lit("{}")
    if null_rows and fields:
        bare = [F.col(f"`{f.name}`").isNull() for f in df.schema]
        every = bare[0]
        for b in bare[1:]:
            every = every & b
        out = F.when(every, "null").otherwise(out)
    return out


def to_records(df: DataFrame, **options) -> DataFrame:
    """One column ``record`` of JSON objects; see ``record_json`` for options."""
    return df.select(record_json(df, **options).alias("record"))


def from_records(df: DataFrame, schema: T.StructType | str, column: str = "record", strict: bool = True, options: dict | None = None) -> DataFrame:
    """The inverse of ``to_records`` for a known schema; what doesn't parse raises an error, or gives nulls if not ``strict``."""
    parsed = F.from_json(F.col(column), schema, {"mode": "FAILFAST" if strict else "PERMISSIVE", **(options or {})})
    return df.select(parsed.alias("r")).select("r.*")


def to_variant(df: DataFrame, column: str = "record") -> DataFrame:
    """Records of unknown shape as one variant column ``value``; text that isn't JSON raises an error."""
    return df.select(F.parse_json(F.col(column)).alias("value"))


def mapped(kind: T.DataType, leaf: Callable[[T.DataType], T.DataType]) -> T.DataType:
    """``kind`` with ``leaf`` applied to everything that isn't a struct, an array or a map."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, mapped(f.dataType, leaf), f.nullable) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(mapped(kind.elementType, leaf), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(mapped(kind.keyType, leaf), mapped(kind.valueType, leaf), kind.valueContainsNull)
    return leaf(kind)


def physical(kind: T.DataType) -> T.DataType:
    """The type in which Spark's writer holds ``kind`` in a file: what annotates integers and bytes is taken off."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) or type(kind).__name__ == "TimeType":
        return T.LongType()
    if isinstance(kind, T.DateType):
        return T.IntegerType()
    if isinstance(kind, T.DecimalType):
        return T.IntegerType() if kind.precision <= 9 else T.LongType() if kind.precision <= 18 else kind
    return T.BinaryType() if isinstance(kind, T.StringType) else kind


def physical_schema(schema: T.StructType) -> T.StructType:
    """A schema that reads the same file without annotations: raw integers and bytes."""
    return mapped(schema, physical)


def is_wrapper(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and kind.names == ["element"]


def collapsed_type(kind: T.DataType) -> T.DataType:
    if is_wrapper(kind):
        return collapsed_type(kind[0].dataType)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, collapsed_type(f.dataType), f.nullable) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(collapsed_type(kind.elementType))
    return kind


def _collapse(value: Column, kind: T.DataType) -> Column:
    if is_wrapper(kind):
        return _collapse(value.getField("element"), kind[0].dataType)
    if collapsed_type(kind) == kind:
        return value
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_collapse(value.getField(f.name), f.dataType).alias(f.name) for f in kind)))
    return F.transform(value, lambda x: _collapse(x, kind.elementType))


def collapse_element(df: DataFrame) -> DataFrame:
    """Every struct whose only field is ``element`` replaced by that field, at any depth below the record."""
    return df.select(*(_collapse(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


def _wrap(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: F.struct(_wrap(x, kind.elementType).alias("element")))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_wrap(value.getField(f.name), f.dataType).alias(f.name) for f in kind)))
    return value


def wrap_lists(df: DataFrame) -> DataFrame:
    """Every array element inside a struct with the one field ``element``, as the file's three levels have it."""
    return df.select(*(_wrap(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))
