"""Records as files and as bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import cbor, records


#: Times to the microsecond; Spark writes milliseconds by default.
MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_json(df: DataFrame, path: str, mode: str = "errorifexists", **options) -> None:
    """One JSON object a line; options of ``record_json``."""
    records.to_records(df, **options).write.mode(mode).text(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Records of JSON lines. With a schema nothing is inferred, and what doesn't fit raises an error; numbers with a fraction are doubles."""
    source = spark.read
    if schema is not None:
        source = source.schema(schema).option("mode", "FAILFAST")
    return source.json(path)


def to_bytes(df: DataFrame) -> DataFrame:
    """One binary column ``record``: the UTF-8 bytes of each row's JSON, where binary values are base64, so that they come back as they were."""
    fields = [F.col(f"`{f.name}`") for f in df.schema]
    return df.select(F.encode(F.to_json(F.struct(*fields), MICROS) if fields else F.lit("{}"), "UTF-8").alias("record"))


def from_bytes(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """The inverse of ``to_bytes``; bytes that aren't UTF-8 raise an error."""
    return records.from_records(df.select(F.validate_utf8(F.col("record").cast("string")).alias("record")), schema, options=MICROS)


def to_cbor(df: DataFrame) -> DataFrame:
    """One binary column ``record``: each row as a CBOR map."""
    return cbor.encoded(df)


def from_cbor(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The inverse of ``to_cbor``."""
    return cbor.decoded(df, schema)
