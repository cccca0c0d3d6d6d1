"""Footers, schemas, row groups, column chunks and pages as data sources.

``register`` makes the formats parquet_file_meta, parquet_schema,
parquet_row_groups, parquet_column_chunks and parquet_pages known to a session:
``spark.read.format("parquet_pages").load(path)``. The driver only lists files;
tasks read footers, some files each, by byte range.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.sources import files

#: Files whose footers one task reads.
FILES_PER_TASK = 64

ENCRYPTION = "struct<algorithm: string, aad_prefix: binary, aad_file_unique: binary, supply_aad_prefix: boolean>"
LOGICAL = "struct<name: string, scale: int, precision: int, is_adjusted_to_utc: boolean, unit: string, bit_width: int, is_signed: boolean>"
STATISTICS = "struct<min: binary, max: binary, min_value: binary, max_value: binary, null_count: bigint, distinct_count: bigint, is_min_value_exact: boolean, is_max_value_exact: boolean>"


def text(value: bytes | None) -> str | None:
    return None if value is None else value.decode("utf-8", "replace")


def key_values(entries: list[dict] | None) -> dict[str, str | None]:
    return {text(e["key"]): text(e.get("value")) for e in entries or ()}


def union(value: dict | None) -> tuple[str | None, dict]:
    """The one variant of a union and its fields."""
    return next(iter(value.items())) if value else (None, {})


def logical(element: dict) -> tuple | None:
    name, given = union(element.get("logical_type"))
    if name is None:
        return None
    return name, given.get("scale"), given.get("precision"), given.get("is_adjusted_to_utc"), union(given.get("unit"))[0], given.get("bit_width"), given.get("is_signed")


def statistics(found: dict | None) -> tuple | None:
    names = ("min", "max", "min_value", "max_value", "null_count", "distinct_count", "is_min_value_exact", "is_max_value_exact")
    return tuple(found.get(n) for n in names) if found else None


def schema_rows(elements: list[dict]) -> Iterator[tuple]:
    """The elements in file order with their place in the tree and their largest levels (the root's are 0)."""
    left: list[int] = []  # children still to come, of each node above
    path: list[str] = []
    levels: list[tuple[int, int]] = []
    for place, element in enumerate(elements):
        while left and not left[-1]:
            left.pop()
            path.pop()
            levels.pop()
        name, kind = text(element["name"]), element.get("repetition_type")
        rep, most = levels[-1] if levels else (0, 0)
        if place:
            left[-1] -= 1
            rep, most = rep + (kind == "REPEATED"), most + (kind != "REQUIRED")
        path.append(name)
        levels.append((rep, most))
        left.append(element.get("num_children") or 0)
        yield (
            (place, len(path) - 1, name, ".".join(path[1:]), element.get("type"), element.get("type_length"), kind, element.get("num_children"))
            + (element.get("converted_type"), element.get("scale"), element.get("precision"), element.get("field_id"), logical(element), rep, most)
        )


def file_rows(path: str) -> Iterator[tuple]:
    meta = files.footer_of(path)
    algorithm, given = union(meta.get("encryption_algorithm"))
    encryption = (algorithm, given.get("aad_prefix"), given.get("aad_file_unique"), given.get("supply_aad_prefix")) if algorithm else None
    orders = [union(o)[0] for o in meta["column_orders"]] if "column_orders" in meta else None
    yield path, meta["version"], meta["num_rows"], len(meta["row_groups"]), len(meta["schema"]), key_values(meta.get("key_value_metadata")), text(meta.get("created_by")), orders, encryption, meta.get("footer_signing_key_metadata")


def element_rows(path: str) -> Iterator[tuple]:
    for row in schema_rows(files.footer_of(path)["schema"]):
        yield path, *row


def group_rows(path: str) -> Iterator[tuple]:
    begin = 0
    for k, group in enumerate(files.footer_of(path)["row_groups"]):
        order = [(s["column_idx"], s["descending"], s["nulls_first"]) for s in group["sorting_columns"]] if "sorting_columns" in group else None
        yield path, k, begin, group["num_rows"], len(group["columns"]), group["total_byte_size"], group.get("total_compressed_size"), group.get("file_offset"), group.get("ordinal"), order
        begin += group["num_rows"]


def chunk_rows(path: str) -> Iterator[tuple]:
    for k, group in enumerate(files.footer_of(path)["row_groups"]):
        for n, chunk in enumerate(group["columns"]):
            meta = chunk.get("meta_data") or {}
            counts = [(s["page_type"], s["encoding"], s["count"]) for s in meta["encoding_stats"]] if "encoding_stats" in meta else None
            crypto = union(chunk.get("crypto_metadata"))[0]
            yield (
                (path, k, n, ".".join(map(text, meta.get("path_in_schema", []))), meta.get("type"), meta.get("encodings"), meta.get("codec"), meta.get("num_values"))
                + (meta.get("total_uncompressed_size"), meta.get("total_compressed_size"), meta.get("data_page_offset"), meta.get("index_page_offset"), meta.get("dictionary_page_offset"))
                + (statistics(meta.get("statistics")), counts, meta.get("bloom_filter_offset"), meta.get("bloom_filter_length"), key_values(meta.get("key_value_metadata")))
                + (text(chunk.get("file_path")), chunk["file_offset"], chunk.get("offset_index_offset"), chunk.get("offset_index_length"), chunk.get("column_index_offset"), chunk.get("column_index_length"))
                + (crypto, chunk.get("encrypted_column_metadata"))
            )


def page_rows(path: str) -> Iterator[tuple]:
    source = files.opened(path)
    try:
        for k, group in enumerate(files.footer_of(path)["row_groups"]):
            for chunk in group["columns"]:
                meta = chunk.get("meta_data")
                if not meta:
                    continue  # its column is encrypted
                column = ".".join(map(text, meta["path_in_schema"]))
                for n, (offset, length, header) in enumerate(files.pages(source, meta)):
                    body = header.get("data_page") or header.get("data_page_v2") or header.get("dictionary_page") or {}
                    yield (
                        (path, k, column, n, header["type"], offset, length, header["compressed_page_size"], header["uncompressed_page_size"], header.get("crc"))
                        + (body.get("num_values"), body.get("num_nulls"), body.get("num_rows"), body.get("encoding"), body.get("definition_level_encoding"), body.get("repetition_level_encoding"))
                        + (body.get("definition_levels_byte_length"), body.get("repetition_levels_byte_length"), body.get("is_compressed"), body.get("is_sorted"), statistics(body.get("statistics")))
                    )
    finally:
        source.close()


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class FilesReader(DataSourceReader):
    def __init__(self, path: str, make):
        self.path, self.make = path, make

    def partitions(self) -> list[Files]:
        found = files.listed(self.path)
        return [Files(found[k : k + FILES_PER_TASK]) for k in range(0, len(found), FILES_PER_TASK)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths if partition else ():
            yield from self.make(path)


class _Metadata(DataSource):
    """Option ``path``: a file, a folder, a pattern or a URL."""

    columns = ""
    make = None

    @classmethod
    def name(cls) -> str:
        return cls.format

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options["path"], type(self).make)


class FileMeta(_Metadata):
    format = "parquet_file_meta"
    columns = f"path string, version int, num_rows bigint, num_row_groups int, num_schema_elements int, key_value_metadata map<string, string>, created_by string, column_orders array<string>, encryption_algorithm {ENCRYPTION}, footer_signing_key_metadata binary"
    make = staticmethod(file_rows)


class Schema(_Metadata):
    format = "parquet_schema"
    columns = f"path string, ordinal int, depth int, name string, path_in_schema string, type string, type_length int, repetition_type string, num_children int, converted_type string, scale int, precision int, field_id int, logical_type {LOGICAL}, max_rep int, max_def int"
    make = staticmethod(element_rows)


class RowGroups(_Metadata):
    format = "parquet_row_groups"
    columns = "path string, row_group int, first_row bigint, num_rows bigint, num_columns int, total_byte_size bigint, total_compressed_size bigint, file_offset bigint, ordinal int, sorting_columns array<struct<column_idx: int, descending: boolean, nulls_first: boolean>>"
    make = staticmethod(group_rows)


class ColumnChunks(_Metadata):
    format = "parquet_column_chunks"
    columns = (
        "path string, row_group int, column int, path_in_schema string, type string, encodings array<string>, codec string, num_values bigint, total_uncompressed_size bigint, total_compressed_size bigint, "
        f"data_page_offset bigint, index_page_offset bigint, dictionary_page_offset bigint, statistics {STATISTICS}, encoding_stats array<struct<page_type: string, encoding: string, count: int>>, "
        "bloom_filter_offset bigint, bloom_filter_length int, key_value_metadata map<string, string>, file_path string, file_offset bigint, offset_index_offset bigint, offset_index_length int, "
        "column_index_offset bigint, column_index_length int, crypto string, encrypted_column_metadata binary"
    )
    make = staticmethod(chunk_rows)


class Pages(_Metadata):
    format = "parquet_pages"
    columns = (
        "path string, row_group int, path_in_schema string, page int, type string, offset bigint, header_size int, compressed_page_size int, uncompressed_page_size int, crc int, num_values bigint, num_nulls bigint, "
        "num_rows bigint, encoding string, definition_level_encoding string, repetition_level_encoding string, definition_levels_byte_length int, repetition_levels_byte_length int, is_compressed boolean, "
        f"is_sorted boolean, statistics {STATISTICS}"
    )
    make = staticmethod(page_rows)


SOURCES = (FileMeta, Schema, RowGroups, ColumnChunks, Pages)


def register(spark: SparkSession) -> None:
    for source in SOURCES:
        spark.dataSource.register(source)


def metadata(spark: SparkSession, kind: str, path: str):
    """One of the formats' frames; ``kind`` without the prefix (file_meta, schema, row_groups, column_chunks or pages)."""
    register(spark)
    return spark.read.format(f"parquet_{kind}").load(path)


def lookup(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """The schema elements at a path of names, one for each file; no names give the root. A path that a file lacks gives no row for it."""
    at = ".".join(names)
    return metadata(spark, "schema", path).where((F.col("path_in_schema") == at) & (F.col("depth") == len(names)))
