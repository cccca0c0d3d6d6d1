"""Reading nested columnar files into rows.

``read`` is Spark's own scan with a few views on it. ``ranged`` is for what that
scan can't do: files behind HTTP and single row groups; it reads by byte range,
one task for each part of a file (or for each of the
row groups asked for), which reads the footer and the row groups that begin in it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.functions import records
from quern.sources import files

#: Rows of a batch that a task hands on.
BATCH_ROWS = 1 << 14
#: Bytes of a file whose row groups one task reads.
PART_BYTES = 128 << 20


def read(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, physical: bool = False, ordered: bool = False, raw_lists: bool = False, collapse_element: bool = False) -> DataFrame:
    """The rows of all row groups of one or several files or folders.

    ``columns`` prunes the scan. ``physical`` reads raw integers and bytes
    without their annotations. ``ordered`` sorts by file and row (a shuffle; the
    order is otherwise unspecified). ``raw_lists`` shows list elements inside
    structs named ``element``, ``collapse_element`` takes such structs away,
    those of users too. Nulls, empty lists and nested nulls stay what they are.
    """
    paths = [path] if isinstance(path, str) else path
    allow_times(spark)
    df = spark.read.parquet(*paths)
    if physical:
        df = spark.read.schema(physical_schema(df)).parquet(*paths)
    if ordered:
        df = df.orderBy("_metadata.file_path", "_metadata.row_index")
    if columns is not None:
        df = df.select(*columns)
    if raw_lists:
        df = records.wrap_lists(df)
    return records.collapse_element(df) if collapse_element else df


def _tree(elements: list[dict], at: int = 0) -> tuple[dict, int]:
    """The schema node at a place of a footer's list, with its ``children`` by name, and the place behind it."""
    node, children, behind = elements[at], {}, at + 1
    for _ in range(node.get("num_children") or 0):
        child, behind = _tree(elements, behind)
        children[child["name"].decode()] = child
    return node | {"children": children}, behind


def _stated(kind: T.DataType, node: dict, leaf) -> T.DataType:
    """``kind`` with the nullability that a file's schema node states; ``leaf`` makes the leaves' types."""
    children = node["children"]
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _stated(f.dataType, children[f.name], leaf), children[f.name]["repetition_type"] != "REQUIRED", f.metadata) for f in kind])
    if isinstance(kind, T.ArrayType):
        repeated = next(iter(children.values()), node)
        inner = next(iter(repeated["children"].values())) if len(repeated["children"]) == 1 else repeated
        return T.ArrayType(_stated(kind.elementType, inner, leaf), inner["repetition_type"] == "OPTIONAL")
    if isinstance(kind, T.MapType):
        key, value = next(iter(children.values()))["children"].values()
        return T.MapType(_stated(kind.keyType, key, leaf), _stated(kind.valueType, value, leaf), value["repetition_type"] == "OPTIONAL")
    return leaf(kind, node)


def _of_first_file(df: DataFrame, leaf) -> T.StructType:
    files_of = df.inputFiles()
    if not files_of:
        return df.schema
    root, _ = _tree(files.footer_of(files_of[0])["schema"])
    return T.StructType([T.StructField(f.name, _stated(f.dataType, root["children"][f.name], leaf), root["children"][f.name]["repetition_type"] != "REQUIRED", f.metadata) if f.name in root["children"] else f for f in df.schema])


def stated_schema(df: DataFrame) -> T.StructType:
    """The schema of a frame read from files with the nullability that the first file's footer states, which is what levels count."""
    return _of_first_file(df, lambda kind, node: kind)


#: Spark's types for the physical types of a file.
_PHYSICAL = {"BOOLEAN": T.BooleanType, "INT32": T.IntegerType, "INT64": T.LongType, "FLOAT": T.FloatType, "DOUBLE": T.DoubleType, "BYTE_ARRAY": T.BinaryType, "FIXED_LEN_BYTE_ARRAY": T.BinaryType}


def physical_schema(df: DataFrame) -> T.StructType:
    """A schema that reads the frame's files without annotations. Decimals may be held in several ways, so where there are any the first file's footer tells."""
    if "decimal(" not in df.schema.simpleString():
        return records.physical_schema(df.schema)
    return _of_first_file(df, lambda kind, node: _PHYSICAL[node["type"]]() if node["type"] in _PHYSICAL else kind)


def allow_times(spark: SparkSession) -> None:
    """Lets the session read times of day, and nanosecond timestamps as integers, which it refuses by default."""
    spark.conf.set("spark.sql.timeType.enabled", "true")
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """The rows with file and row_id, their place in it from 0: a key for shredding."""
    df = spark.read.parquet(path)
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_id"), "*")


def stream_records(df: DataFrame) -> Iterator[dict]:
    """The rows as dictionaries, one partition in memory at a time while the next is on its way."""
    for row in df.toLocalIterator(prefetchPartitions=True):
        yield row.asDict(recursive=True)


class Part(InputPartition):
    """A row group by its number, or the row groups that begin in a range of bytes."""

    def __init__(self, path: str, number: int | None, start: int, stop: int):
        self.path, self.number, self.start, self.stop = path, number, start, stop


def parts(path: str) -> list[Part]:
    """All files of a path in ranges of PART_BYTES; only their sizes are asked for."""
    out = []
    for name in files.listed(path):
        source = files.opened(name)
        size = source.size
        source.close()
        out += [Part(name, None, a, min(a + PART_BYTES, size)) for a in range(0, size, PART_BYTES)]
    return out


class RangedReader(DataSourceReader):
    def __init__(self, path: str, groups: list[int] | None, columns: list[str]):
        self.path, self.groups, self.columns = path, groups, columns

    def partitions(self) -> list[Part]:
        if self.groups is None:
            return parts(self.path)
        return [Part(path, g, 0, 0) for path in files.listed(self.path) for g in self.groups]

    def read(self, partition: Part):
        import pyarrow.parquet as pq

        if partition is None:
            return
        source = files.opened(partition.path)
        try:
            groups = files.footer(source)["row_groups"]
            if partition.number is None:
                starts = [files.first_page(g["columns"][0]["meta_data"]) for g in groups]
                wanted = [k for k, start in enumerate(starts) if partition.start <= start < partition.stop]
            elif not 0 <= partition.number < len(groups):
                raise IndexError(f"{partition.path} has row groups 0 to {len(groups) - 1}")
            else:
                wanted = [partition.number]
            if wanted:
                file = pq.ParquetFile(files.Seekable(source), pre_buffer=False)
                yield from file.iter_batches(BATCH_ROWS, wanted, self.columns)
        finally:
            source.close()


class Ranged(DataSource):
    """Options: ``path`` (a file, a folder or a URL), ``row_groups`` (numbers, comma-joined; all by default), ``columns`` (top-level names, comma-joined)."""

    @classmethod
    def name(cls) -> str:
        return "parquet_ranged"

    def _columns(self) -> list[str]:
        wanted = self.options.get("columns")
        return [c.strip() for c in wanted.split(",")] if wanted else self._arrow().names

    def _arrow(self):
        import pyarrow.parquet as pq

        source = files.opened(files.listed(self.options["path"])[0])
        try:
            return pq.ParquetFile(files.Seekable(source)).schema_arrow
        finally:
            source.close()

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema
        from pyspark.sql.types import StructType

        whole = from_arrow_schema(self._arrow(), prefer_timestamp_ntz=True)
        return StructType([whole[c] for c in self._columns()])

    def reader(self, schema) -> RangedReader:
        groups = self.options.get("row_groups")
        return RangedReader(self.options["path"], [int(g) for g in groups.split(",")] if groups else None, schema.names)


def ranged(spark: SparkSession, path: str, row_groups: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
    """The rows of a local or remote file, or of some of its row groups, read by byte range."""
    spark.dataSource.register(Ranged)
    source = spark.read.format("parquet_ranged")
    if row_groups is not None:
        source = source.option("row_groups", ",".join(map(str, row_groups)))
    if columns is not None:
        source = source.option("columns", ",".join(columns))
    return source.load(path)
