"""Dictionary codes for values, and runs of equal values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges into which numbering splits its rows.
RANGES = 64


def row_numbers(df: DataFrame, order: str, name: str, ranges: int = RANGES, ties: Sequence[str] = ()) -> DataFrame:
    """``df`` with the place, from 0, of each row by the numeric column ``order``, nulls last.

    Rows are numbered within ranges of ``order`` that hold about as many each,
    so no task sees all of them; only the ranges' bounds and counts reach the
    driver. Ties go by the columns ``ties`` and then take any order.
    """
    found = df.select(F.percentile_approx(order, [k / ranges for k in range(1, ranges)], 100 * ranges)).head()[0] or []
    bounds = F.array(*(F.lit(b) for b in sorted(set(found))))
    part = F.when(F.col(order).isNull(), len(found)).otherwise(F.size(F.filter(bounds, lambda b: b < F.col(order)))) if found else F.lit(0)
    placed = df.withColumn("__part", part)
    counts = sorted((r["__part"], r["count"]) for r in placed.groupBy("__part").count().collect())
    offsets, total = [], 0
    for k, n in counts:
        offsets += [F.lit(k), F.lit(total)]
        total += n
    if not offsets:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(F.col(order).asc_nulls_last(), *ties))
    return placed.withColumn(name, (within - 1 + F.create_map(*offsets)[F.col("__part")]).cast("bigint")).drop("__part")


def dictionary(df: DataFrame, column: str, position: str) -> DataFrame:
    """code, value: the different values of a column, numbered from 0 as they first occur by ``position``; null has none."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(position).alias("__first"))
    return row_numbers(first, "__first", "code").select("code", "value")


def dictionary_encode(df: DataFrame, column: str, entries: DataFrame) -> DataFrame:
    """``df`` with ``code`` in place of ``column``; null where the dictionary lacks the value."""
    return df.join(entries.withColumnRenamed("value", column), column, "left").drop(column)


def dictionary_decode(df: DataFrame, column: str, entries: DataFrame) -> DataFrame:
    """The inverse: ``column`` in place of ``code``. A code that the dictionary lacks raises an error."""
    joined = df.join(entries.select("code", F.col("value").alias("__value")), "code", "left")
    beyond = F.raise_error(F.lit("a code is beyond the dictionary"))
    value = F.when(F.col("__value").isNotNull() | F.col("code").isNull(), F.col("__value")).otherwise(beyond)
    return joined.withColumn(column, value).drop("__value", "code")


def runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, run (from 0), value, n: the runs of equal values, nulls too, of each key's rows by ``order``."""
    span = Window.partitionBy(*keys).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(span)) | (F.row_number().over(span) == 1)).cast("bigint")
    marked = df.select(*keys, *order, F.col(value).alias("__value"), new.alias("__new"))
    numbered = marked.withColumn("run", F.sum("__new").over(span.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy(*keys, "run").agg(F.first("__value").alias(value), F.count("*").alias("n"))
