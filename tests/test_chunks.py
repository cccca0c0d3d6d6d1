"""Column chunks read page by page against what was written, and the codecs of levels."""

import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.functions import codecs
from quern.operators import shred
from quern.plans import catalog
from quern.sources import chunks, metadata, reader

ROWS = 700
TABLE = pa.table(
    {
        "i": pa.array([None if k % 7 == 3 else k * 1_000_003 for k in range(ROWS)], pa.int64()),
        "s": pa.array([None if k % 5 == 1 else "" if k % 5 == 2 else "wörd" * (k % 4) for k in range(ROWS)]),
        "b": pa.array([None if k % 3 == 1 else k % 2 == 0 for k in range(ROWS)]),
        "x": pa.array([k / 8 for k in range(ROWS)], pa.float64()),
        "f": pa.array([struct.pack("<I", k) for k in range(ROWS)], pa.binary(4)),
        "l": pa.array([None if k % 4 == 0 else [] if k % 4 == 1 else [[k, None], None, []] if k % 4 == 2 else [[k]] for k in range(ROWS)], pa.list_(pa.list_(pa.int32()))),
    },
    schema=pa.schema([("i", pa.int64()), ("s", pa.string()), ("b", pa.bool_()), pa.field("x", pa.float64(), nullable=False), ("f", pa.binary(4)), ("l", pa.list_(pa.list_(pa.int32())))]),
)
FORMS = [
    {"data_page_version": version, "use_dictionary": coded, "compression": codec, "data_page_size": 512, "row_group_size": 300, "write_batch_size": 64}
    for version, coded, codec in [("1.0", True, "snappy"), ("1.0", False, "none"), ("2.0", True, "zstd"), ("2.0", False, "gzip"), ("1.0", True, "lz4"), ("2.0", True, "brotli")]
]


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return bytes([value])
    if isinstance(value, int):
        return struct.pack("<q", value)
    if isinstance(value, float):
        return struct.pack("<d", value)
    return value.encode() if isinstance(value, str) else value


@pytest.mark.parametrize("form", FORMS, ids=lambda f: f"{f['data_page_version']}-{f['use_dictionary']}-{f['compression']}")
def test_entries_are_what_was_written(spark, tmp_path, form):
    path = str(tmp_path / "t.parquet")
    pq.write_table(TABLE, path, **form)
    found = chunks.entries(spark, path).collect()
    for name in "isbxf":
        rows = sorted((r for r in found if r["path_in_schema"] == name), key=lambda r: r["row_id"])
        most = 0 if name == "x" else 1
        assert [r["row_id"] for r in rows] == list(range(ROWS))
        assert [None if r["value"] is None else bytes(r["value"]) for r in rows] == [plain(v) for v in TABLE[name].to_pylist()]
        assert {(r["rep"], r["max_def"]) for r in rows} == {(0, most)} and all((r["def"] == most) == (r["value"] is not None) for r in rows)


@pytest.mark.parametrize("form", FORMS[:3], ids=lambda f: f"{f['data_page_version']}-{f['compression']}")
def test_levels_of_nested_lists(spark, tmp_path, form):
    """The stored levels are those that shredding works out from the rows."""
    path = str(tmp_path / "t.parquet")
    pq.write_table(TABLE, path, **form)
    leaf = "l.list.element.list.element"
    stored = chunks.entries(spark, path, [leaf]).select("row_id", "entry", "rep", "def", "max_def", codecs.uint_le(F.col("value"), 4)["value"].cast("int").alias("value"))
    stored = [(r[0], *r[2:]) for r in sorted(stored.collect(), key=lambda r: (r["row_id"], r["entry"]))]
    worked = shred.shred(reader.numbered(spark, path), ["row_id"], leaf).select("row_id", "at", "rep", "def", "max_def", "value")
    assert stored == [(r[0], *r[2:]) for r in sorted(worked.collect(), key=lambda r: (r["row_id"], r["at"]))]


def of_several_files(folder, name, table, form):
    """A table's rows dealt over three files, the last ones in the first file and each file in two row groups."""
    (folder / f"{name}.parquet").mkdir(parents=True)
    size = -(-len(table) // 3)
    for k in range(3):
        pq.write_table(table.slice(k * size, size), folder / f"{name}.parquet" / f"part-{2 - k}.parquet", **form | {"row_group_size": size // 2 + 1})


@pytest.mark.parametrize("form", FORMS[:3], ids=lambda f: f"{f['data_page_version']}-{f['compression']}")
def test_keys(spark, tmp_path, form):
    ids = [None if k % 50 == 7 else k * 3 - 100 for k in range(ROWS)]
    table = TABLE.append_column("k", pa.array(ids, pa.int64())).append_column("m", pa.array(ids, pa.int32()))
    of_several_files(tmp_path, "t", table, form)
    for key in "km":
        found = chunks.entries(spark, str(tmp_path / "t.parquet"), ["x", "l.list.element.list.element"], key).collect()
        assert sorted((repr(r["key"]), bytes(r["value"])) for r in found if r["path_in_schema"] == "x") == sorted((repr(i), plain(x)) for i, x in zip(ids, TABLE["x"].to_pylist()))
        nested = sorted((r["key"], int.from_bytes(r["value"], "little")) for r in found if r["path_in_schema"] != "x" and r["value"] is not None and r["key"] is not None)
        want = [(i, v) for i, l in zip(ids, TABLE["l"].to_pylist()) for inner in l or () for v in inner or () if v is not None and i is not None]
        assert nested == sorted(want)
    with pytest.raises(Exception, match="a key is a leaf"):
        chunks.entries(spark, str(tmp_path / "t.parquet"), ["x"], "s").count()


def test_nested_query_over_several_files(spark, tmp_path):
    """places in files start anew in each."""
    vectors = pa.table({"vec_id": pa.array(range(30), pa.int64()), "embedding": pa.array([[k / 4, -k / 8] for k in range(30)], pa.list_(pa.float32())), "label": pa.array(range(30), pa.int32())})
    of_several_files(tmp_path, "embeddings", vectors, FORMS[0])
    found = catalog.queries()["chunk_entries_nested"](spark, str(tmp_path)).collect()
    assert sorted((r["row_id"], r["rep"], r["def"], r["value"]) for r in found) == [(k, rep, 3, value) for k in range(30) for rep, value in ((0, k / 4), (1, -k / 8))]


def test_text_query_over_several_files(spark, tmp_path):
    """numbers run over all files, by id, null ids last and equal ids by file and place."""
    ids = [None if k == 4 else 3 if k in (10, 11) else 100 - k for k in range(40)]
    of_several_files(tmp_path, "documents", pa.table({"doc_id": pa.array(ids, pa.int64()), "text": [None if k == 20 else f"té {k}" for k in range(40)]}), FORMS[0])
    found = catalog.queries()["chunk_entries_text"](spark, str(tmp_path)).collect()
    order = sorted(range(40), key=lambda k: (ids[k] is None, ids[k] or 0, k))
    assert sorted(map(tuple, found)) == [(n, None if k == 20 else f"té {k}") for n, k in enumerate(order)]


def test_dictionaries(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    pq.write_table(pa.table({"s": ["b", "a", None, "b", "c"], "n": [1, 1, 2, 2, 3]}), path)
    found = chunks.dictionary(spark, path, ["s"]).orderBy("code").collect()
    assert [(r["code"], bytes(r["value"])) for r in found] == [(0, b"b"), (1, b"a"), (2, b"c")]
    pq.write_table(pa.table({"s": ["b", "a"]}), path, use_dictionary=False)
    assert chunks.dictionary(spark, path).count() == 0


def test_empty_file_and_unknown_leaf(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    pq.write_table(TABLE.slice(0, 0), path)
    assert chunks.entries(spark, path).count() == 0
    with pytest.raises(Exception, match="no leaf nowhere"):
        chunks.entries(spark, path, ["nowhere"]).count()


def test_other_encodings_raise(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    pq.write_table(TABLE.select(["i"]), path, use_dictionary=False, column_encoding={"i": "DELTA_BINARY_PACKED"})
    with pytest.raises(Exception, match="values encoded by DELTA_BINARY_PACKED"):
        chunks.entries(spark, path).count()


def test_bit_packed_levels():
    """The old form of level blocks: the most significant bit first, without a length."""
    assert [x.tolist() if hasattr(x, "tolist") else x for x in chunks.level_block(bytes([0b00011011, 0b10000000]), 2, 5, "BIT_PACKED")] == [[0, 1, 2, 3, 2], 2]
    assert chunks.level_block(b"", 0, 3, "BIT_PACKED")[0].tolist() == [0, 0, 0]


def test_cut_off_values():
    with pytest.raises(ValueError):
        chunks.plain(b"\x05\x00\x00\x00ab", "BYTE_ARRAY", None, 1)
    with pytest.raises(ValueError):
        chunks.plain(b"\x05\x00", "INT32", None, 1)
    assert chunks.plain(b"\x00\x00\x00\x00\x01\x00\x00\x00z\x00\x00\x00\x00", "BYTE_ARRAY", None, 3).to_pylist() == [b"", b"z", b""]


def test_level_block_expressions(spark):
    levels = [0, 1, 1, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 0]
    df = spark.createDataFrame([(levels,), ([],), (None,)], "l array<bigint>")
    coded = df.select("l", F.size("l").alias("n"), codecs.level_block_of(F.col("l"), 2).alias("b"))
    found = coded.where("l is not null").select("l", codecs.level_block(F.concat("b", F.lit(b"xy")), 2, F.col("n")).alias("d")).collect()
    assert all(r["l"] == r["d"]["values"] and bytes(r["d"]["rest"]) == b"xy" for r in found)
    assert coded.where("l is null").select("b").collect()[0]["b"] is None
    none = spark.range(1).select(codecs.level_block(F.lit(b"q"), 0, F.lit(2)).alias("d")).collect()[0]["d"]
    assert none["values"] == [0, 0] and bytes(none["rest"]) == b"q"


def test_bytes_both_ways(spark):
    every = bytes(range(256))
    df = spark.createDataFrame([(every,), (b"",), (b"\n",), (None,)], "b binary")
    found = df.select("b", codecs.byte_values(F.col("b")).alias("v"), codecs.binary_of(codecs.byte_values(F.col("b"))).alias("again")).collect()
    assert [r["v"] for r in found] == [list(every), [], [10], None]
    assert [r["again"] if r["again"] is None else bytes(r["again"]) for r in found] == [every, b"", b"\n", None]


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8, 9, 13, 31, 32])
def test_packing_every_width(spark, width):
    values = np.random.default_rng(width).integers(0, 1 << width, 37)
    bits = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8)
    df = spark.createDataFrame([(values.tolist(),)], "v array<bigint>")
    assert bytes(df.select(codecs.bit_pack(F.col("v"), width).alias("b")).collect()[0]["b"]) == np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def test_spread_long_and_odd(spark):
    levels = [k % 3 for k in range(5000)]
    present = [f"v{k}" for k in range(levels.count(2))]
    df = spark.createDataFrame([(levels, present), ([], []), (None, []), ([1], ["left over"])], "l array<int>, p array<string>")
    got = [r["s"] for r in df.select(codecs.spread(F.col("l"), 2, F.col("p")).alias("s")).collect()]
    rest = iter(present)
    assert got == [[next(rest) if d == 2 else None for d in levels], [], None, [None]]


def test_lookup(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    pq.write_table(TABLE, path)
    assert metadata.lookup(spark, path).collect()[0]["num_children"] == 6
    assert metadata.lookup(spark, path, "l", "list", "element").collect()[0]["max_rep"] == 1
    assert metadata.lookup(spark, path, "l", "nothing").count() == 0
