"""CBOR (RFC 8949) for rows, by Arrow batches: Spark has no function for it."""

from __future__ import annotations

import datetime
import decimal
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << (8 * size):
            return bytes([major << 5 | code]) + n.to_bytes(size, "big")
    raise OverflowError(n)


_EPOCH = datetime.date(1970, 1, 1)
#: Tags and what they make of their item.
_TAGS = {
    0: datetime.datetime.fromisoformat,
    2: lambda data: int.from_bytes(data, "big"),
    3: lambda data: -1 - int.from_bytes(data, "big"),
    4: lambda pair: decimal.Decimal((int(pair[1] < 0), tuple(map(int, str(abs(pair[1])))), pair[0])),
    100: lambda days: _EPOCH + datetime.timedelta(days),
}


def dumps(value) -> bytes:
    """Null, booleans, integers of any size, floats, bytes, text, lists and maps; decimals (tag 4), dates (tag 100) and times (tag 0, in UTC)."""
    match value:
        case None:
            return b"\xf6"
        case bool():
            return b"\xf5" if value else b"\xf4"
        case int():
            major, n = (0, value) if value >= 0 else (1, -1 - value)
            return _head(major, n) if n < 1 << 64 else _head(6, 2 + major) + dumps(n.to_bytes((n.bit_length() + 7) // 8, "big"))
        case decimal.Decimal():
            sign, digits, exponent = value.as_tuple()
            return _head(6, 4) + dumps([exponent, int("".join(map(str, digits))) * (-1 if sign else 1)])
        case datetime.datetime():
            utc = value.astimezone(datetime.UTC) if value.tzinfo else value
            return _head(6, 0) + dumps(utc.replace(tzinfo=None).isoformat(timespec="microseconds") + "Z")
        case datetime.date():
            return _head(6, 100) + dumps((value - _EPOCH).days)
        case float():
            return b"\xfb" + struct.pack(">d", value)
        case bytes() | bytearray():
            return _head(2, len(value)) + bytes(value)
        case str():
            data = value.encode()
            return _head(3, len(data)) + data
        case list() | tuple():
            return _head(4, len(value)) + b"".join(map(dumps, value))
        case dict():
            return _head(5, len(value)) + b"".join(dumps(k) + dumps(v) for k, v in value.items())
    raise TypeError(f"no CBOR for {type(value).__name__}")


def loads(data: bytes):
    """The one item in ``data``; more or fewer bytes raise an error. Items of indefinite length and tags that ``dumps`` doesn't write aren't taken."""
    value, at = _item(data, 0)
    if at != len(data):
        raise ValueError(f"{len(data) - at} bytes behind the item")
    return value


def _item(data: bytes, at: int):
    if at >= len(data):
        raise ValueError("the item is cut off")
    major, code = data[at] >> 5, data[at] & 31
    at += 1
    size = {24: 1, 25: 2, 26: 4, 27: 8}.get(code, 0)
    if code > 27 or at + size > len(data):
        raise ValueError("the item is cut off or of an unknown kind")
    n = int.from_bytes(data[at : at + size], "big") if size else code
    if major == 7:
        if code in (25, 26, 27):
            return struct.unpack({25: ">e", 26: ">f", 27: ">d"}[code], data[at : at + size])[0], at + size
        return {20: False, 21: True, 22: None, 23: None}[n], at + size
    at += size
    if major < 2:
        return (n if not major else -1 - n), at
    if major < 4:
        if at + n > len(data):
            raise ValueError("the item is cut off")
        return (bytes(data[at : at + n]) if major == 2 else data[at : at + n].decode()), at + n
    if major == 6:
        if n not in _TAGS:
            raise ValueError(f"tag {n} isn't taken")
        value, at = _item(data, at)
        return _TAGS[n](value), at
    out = []
    for _ in range(n * (major - 3)):
        value, at = _item(data, at)
        out.append(value)
    return (out if major == 4 else dict(zip(out[::2], out[1::2]))), at


def encoded(df: DataFrame) -> DataFrame:
    """``record``: a map of each row's fields that aren't null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [dumps({k: v for k, v in row.items() if v is not None}) for row in batch.to_pylist(maps_as_pydicts="strict")]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])

    return df.mapInArrow(run, "record binary")


def decoded(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of ``schema`` from ``record``; fields that a map lacks are null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for batch in batches:
            rows = [loads(r) for r in batch.column("record").to_pylist()]
            pick = lambda f, row: list(v.items()) if isinstance(v := row.get(f.name), dict) and pa.types.is_map(f.type) else v
            yield pa.RecordBatch.from_arrays([pa.array([pick(f, r) for r in rows], f.type) for f in kinds], schema=kinds)

    return df.select("record").mapInArrow(run, schema)
