"""Merging, joining, folding and comparing values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merge_structs(left: Column, right: Column, left_type: T.StructType, right_type: T.StructType) -> Column:
    """All fields of both; where both have one, the left's, unless it is null. A null side counts as empty."""
    names = list(dict.fromkeys([*left_type.names, *right_type.names]))
    pick = {n: [s.getField(n) for s, kind in ((left, left_type), (right, right_type)) if n in kind.names] for n in names}
    return F.when(left.isNotNull() | right.isNotNull(), F.struct(*(F.coalesce(*pick[n]).alias(n) for n in names)))


def merge_maps(left: Column, right: Column) -> Column:
    """All entries of both; where both have a key, the left's. A null side counts as empty."""
    extra = F.map_filter(right, lambda k, _: ~F.map_contains_key(left, k))
    return F.coalesce(F.map_concat(left, extra), left, right)


def concat_lists(left: Column, right: Column) -> Column:
    """The elements of both in order. A null side counts as empty."""
    return F.coalesce(F.concat(left, right), left, right)


def fold_defined(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """A left fold that keeps what it has wherever ``step`` gives null."""
    return F.aggregate(values, start, lambda acc, x: F.coalesce(step(acc, x), acc))


def first_or_null(values: Column) -> Column:
    """The first element, null for an empty array."""
    return F.try_element_at(values, F.lit(1))


def path_of(parts: Column) -> Column:
    """The names of a path, joined by dots."""
    return F.array_join(parts, ".")


def comparable(value: Column, kind: T.DataType) -> Column:
    """``value`` with maps as sorted entries, so that ``<=>`` compares it regardless of their order."""
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), comparable(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: comparable(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(comparable(value.getField(n), kind[n].dataType).alias(n) for n in sorted(kind.names))))
    return value


def same(left: Column, right: Column, kind: T.DataType) -> Column:
    """Equality of nested values; nulls equal nulls, and neither fields' nor entries' order counts."""
    return comparable(left, kind).eqNullSafe(comparable(right, kind))
