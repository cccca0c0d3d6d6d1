"""Column chunks as data sources: what their pages hold, with the levels that stand in the file.

``parquet_entries`` has one row for each entry of a leaf: its repetition and
definition level as stored, and the value's bytes. ``parquet_dictionary`` has
one row for each entry of a chunk's dictionary. Values are the bytes of the
plain encoding without a length in front: numbers with the least byte first
(``codecs.uint_le`` reads whole ones), a boolean as one byte, text as its bytes;
null where the definition level is below the largest.

Rows are numbered in their file. What identifies them in a table of several
files is the value of a leaf of whole numbers, the key, which ``parquet_entries``
gives with each entry on request.

The driver only lists files. A task takes the row groups that begin in a range
of bytes and holds one page at a time, and the keys of a row group. Files without rows give no rows. Values
in delta encodings or with their bytes split raise an error, as do encrypted
columns; so do bytes that end too early.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from quern.functions.codecs import hybrid_values
from quern.sources import files
from quern.sources.metadata import schema_rows, text
from quern.sources.reader import Part, parts

#: Bytes of a value of each physical type of fixed size.
SIZES = {"INT32": 4, "INT64": 8, "INT96": 12, "FLOAT": 4, "DOUBLE": 8}
#: pyarrow's names of the compressions that it knows.
COMPRESSIONS = {"SNAPPY": "snappy", "GZIP": "gzip", "BROTLI": "brotli", "ZSTD": "zstd", "LZ4_RAW": "lz4_raw"}
DICTIONARY_CODES = ("PLAIN_DICTIONARY", "RLE_DICTIONARY")

ENTRIES = pa.schema([("path", pa.string()), ("row_group", pa.int32()), ("path_in_schema", pa.string()), ("entry", pa.int64()), ("row_id", pa.int64()), ("rep", pa.int32()), ("def", pa.int32()), ("max_def", pa.int32()), ("value", pa.binary())])
DICTIONARY = pa.schema([("path", pa.string()), ("row_group", pa.int32()), ("path_in_schema", pa.string()), ("code", pa.int64()), ("value", pa.binary())])


def expanded(data: bytes, codec: str, size: int) -> bytes:
    if codec == "UNCOMPRESSED" or not size:
        return data
    if codec not in COMPRESSIONS:
        raise ValueError(f"pages compressed by {codec}")
    return pa.decompress(data, size, COMPRESSIONS[codec], asbytes=True)


def binary_array(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    if len(data) >= 1 << 31:
        raise ValueError("values of one page beyond 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def plain(data: bytes, kind: str, size: int | None, n: int) -> pa.Array:
    """``n`` values of the plain encoding."""
    if kind == "BOOLEAN":
        bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
        if len(bits) < n:
            raise ValueError(f"{n} values asked for, {len(bits)} there")
        return binary_array(np.arange(n + 1), bits[:n])
    if kind == "BYTE_ARRAY":
        starts, at = np.empty(n, np.int64), 0
        ends = np.empty(n, np.int64)
        for k in range(n):
            starts[k] = at + 4
            at += 4 + int.from_bytes(data[at : at + 4], "little")
            ends[k] = at
        if at > len(data):
            raise ValueError(f"values of {at} bytes in {len(data)}")
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        held = np.zeros(at + 1, np.int64)  # each value's bytes are those between a start and an end
        np.add.at(held, starts, 1)
        np.add.at(held, ends, -1)
        return binary_array(offsets, np.frombuffer(data, np.uint8, at)[np.cumsum(held[:at]) > 0])
    size = SIZES.get(kind, size)
    if len(data) < n * size:
        raise ValueError(f"{n} values of {size} bytes in {len(data)}")
    return binary_array(np.arange(n + 1) * size, np.frombuffer(data, np.uint8, n * size))


def level_block(data: bytes, most: int, n: int, encoding: str | None) -> tuple[np.ndarray, int]:
    """``n`` levels at the start of a page, and the bytes they take. A hybrid has its length in front; levels that can only be 0 take none."""
    width = most.bit_length()
    if not width:
        return np.zeros(n, np.int32), 0
    if encoding == "BIT_PACKED":
        size = -(-n * width // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size))[: n * width].reshape(n, width)
        return (bits.astype(np.int32) @ (1 << np.arange(width - 1, -1, -1))).astype(np.int32), size
    size = int.from_bytes(data[:4], "little")
    return hybrid_values(data[4 : 4 + size], width, n).astype(np.int32), 4 + size


def page_entries(header: dict, body: bytes, leaf: dict, dictionary: pa.Array | None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(repetition levels, definition levels, defined values) of a data page of either version."""
    if header["type"] == "DATA_PAGE_V2":
        page = header["data_page_v2"]
        n, a = page["num_values"], page["repetition_levels_byte_length"]
        b = a + page["definition_levels_byte_length"]
        rep, most = (hybrid_values(part, leaf[m].bit_length(), n).astype(np.int32) if leaf[m] else np.zeros(n, np.int32) for part, m in ((body[:a], "max_rep"), (body[a:b], "max_def")))
        data = body[b:]
        if page.get("is_compressed", True):
            data = expanded(data, leaf["codec"], header["uncompressed_page_size"] - b)
    else:
        page = header["data_page"]
        n = page["num_values"]
        data = expanded(body, leaf["codec"], header["uncompressed_page_size"])
        rep, a = level_block(data, leaf["max_rep"], n, page["repetition_level_encoding"])
        most, b = level_block(data[a:], leaf["max_def"], n, page["definition_level_encoding"])
        data = data[a + b :]
    defined, encoding = int((most == leaf["max_def"]).sum()), page["encoding"]
    if encoding == "PLAIN":
        return rep, most, plain(data, leaf["type"], leaf["type_length"], defined)
    if encoding in DICTIONARY_CODES:
        if dictionary is None:
            raise ValueError("codes without a dictionary")
        codes = hybrid_values(data[1:], data[0], defined) if defined else np.zeros(0, np.int64)
        return rep, most, dictionary.take(pa.array(codes))
    if encoding == "RLE" and leaf["type"] == "BOOLEAN":
        return rep, most, binary_array(np.arange(defined + 1), hybrid_values(data[4:], 1, defined).astype(np.uint8))
    raise ValueError(f"values encoded by {encoding}")


def chunk_pages(source, chunk: dict) -> Iterator[tuple[dict, bytes]]:
    for offset, length, header in files.pages(source, chunk):
        yield header, source.read(offset + length, header["compressed_page_size"])


def entries_of(source, chunk: dict, leaf: dict, first_row: int) -> Iterator[dict]:
    dictionary, entry, row = None, 0, first_row - 1
    for header, body in chunk_pages(source, chunk):
        if header["type"] == "DICTIONARY_PAGE":
            dictionary = plain(expanded(body, leaf["codec"], header["uncompressed_page_size"]), leaf["type"], leaf["type_length"], header["dictionary_page"]["num_values"])
        elif header["type"] in ("DATA_PAGE", "DATA_PAGE_V2"):
            rep, most, found = page_entries(header, body, leaf, dictionary)
            full = most == leaf["max_def"]
            rank = np.cumsum(full) - 1
            rows = row + np.cumsum(rep == 0)
            yield {"entry": entry + np.arange(len(rep)), "row_id": rows, "rep": rep, "def": most, "max_def": np.full(len(rep), leaf["max_def"], np.int32), "value": found.take(pa.array(rank, mask=~full))}
            entry, row = entry + len(rep), int(rows[-1]) if len(rows) else row


def dictionary_of(source, chunk: dict, leaf: dict, first_row: int) -> Iterator[dict]:
    header, body = next(chunk_pages(source, chunk), ({"type": None}, b""))
    if header["type"] == "DICTIONARY_PAGE":
        found = plain(expanded(body, leaf["codec"], header["uncompressed_page_size"]), leaf["type"], leaf["type_length"], header["dictionary_page"]["num_values"])
        yield {"code": np.arange(len(found)), "value": found}


def keys_of(source, chunk: dict, leaf: dict, first_row: int) -> pa.Array:
    """The whole number that each row of a chunk has; the leaf isn't in a list."""
    if leaf["max_rep"] or leaf["type"] not in ("INT32", "INT64"):
        raise ValueError("a key is a leaf of INT32 or INT64 that isn't in a list")
    out = [pa.array([], pa.int64())]
    for found in entries_of(source, chunk, leaf, first_row):
        full = found["def"] == leaf["max_def"]
        values = found["value"].drop_null().cast(pa.binary(SIZES[leaf["type"]])).view(leaf["type"].lower()).cast(pa.int64())
        out.append(values.take(pa.array(np.cumsum(full) - 1, mask=~full)))
    return pa.concat_arrays(out)


class ChunkReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str] | None, make, schema: pa.Schema, key: str | None = None):
        self.path, self.columns, self.make, self.arrow, self.key = path, columns, make, schema, key

    def partitions(self) -> list[Part]:
        return parts(self.path)

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        source = files.opened(partition.path)
        try:
            meta = files.footer(source)
            leaves = {r[3]: {"type": r[4], "type_length": r[5], "max_rep": r[-2], "max_def": r[-1]} for r in schema_rows(meta["schema"]) if r[4]}
            for wanted in [*(self.columns or ()), *([self.key] if self.key else ())]:
                if wanted not in leaves:
                    raise KeyError(f"no leaf {wanted}; there are {', '.join(leaves)}")
            begin = 0
            for k, group in enumerate(meta["row_groups"]):
                chunks = [c.get("meta_data") for c in group["columns"]]
                first, begin = begin, begin + group["num_rows"]
                shown = [c for c in chunks if c]
                if not shown or not partition.start <= files.first_page(shown[0]) < partition.stop:
                    continue
                if not all(chunks):
                    raise ValueError("a column is encrypted")
                named = [(".".join(map(text, c["path_in_schema"])), c) for c in chunks]
                if self.key:
                    chunk = dict(named)[self.key]
                    keys = keys_of(source, chunk, leaves[self.key] | {"codec": chunk["codec"]}, first)
                for name, chunk in named:
                    if self.columns and name not in self.columns:
                        continue
                    for found in self.make(source, chunk, leaves[name] | {"codec": chunk["codec"]}, first):
                        n = len(found["value"])
                        if self.key:
                            found["key"] = keys.take(pa.array(found["row_id"] - first))
                        found |= {"path": pa.repeat(pa.scalar(partition.path), n), "row_group": np.full(n, k, np.int32), "path_in_schema": pa.repeat(pa.scalar(name), n)}
                        yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) if isinstance(found[f.name], np.ndarray) else found[f.name] for f in self.arrow], schema=self.arrow)
        finally:
            source.close()


class _Chunks(DataSource):
    """Options: ``path`` (a file, a folder, a pattern or a URL), ``columns`` (paths in the schema, comma-joined; all by default) and, of entries, ``key`` (a path in the schema)."""

    arrow = None
    make = None

    @classmethod
    def name(cls) -> str:
        return cls.format

    def _arrow(self) -> pa.Schema:
        return self.arrow.append(pa.field("key", pa.int64())) if self.options.get("key") else self.arrow

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(self._arrow())

    def reader(self, schema) -> ChunkReader:
        wanted = self.options.get("columns")
        return ChunkReader(self.options["path"], [c.strip() for c in wanted.split(",")] if wanted else None, type(self).make, self._arrow(), self.options.get("key"))


class Entries(_Chunks):
    format = "parquet_entries"
    arrow = ENTRIES
    make = staticmethod(entries_of)


class Dictionaries(_Chunks):
    format = "parquet_dictionary"
    arrow = DICTIONARY
    make = staticmethod(dictionary_of)


def _load(spark: SparkSession, source: type[_Chunks], path: str, columns: list[str] | None, key: str | None = None) -> DataFrame:
    spark.dataSource.register(source)
    reader = spark.read.format(source.format)
    reader = reader.option("key", key) if key else reader
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)


def entries(spark: SparkSession, path: str, columns: list[str] | None = None, key: str | None = None) -> DataFrame:
    """path, row_group, path_in_schema, entry, row_id, rep, def, max_def, value, and with ``key`` the number that this leaf has in the row: see the module."""
    return _load(spark, Entries, path, columns, key)


def dictionary(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """path, row_group, path_in_schema, code, value: see the module."""
    return _load(spark, Dictionaries, path, columns)
