import datetime
import decimal
import http.server
import os
import threading

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quern.sources import files, reader, thrift
from quern.sources.metadata import metadata


@pytest.fixture(scope="module")
def paged(tmp_path_factory):
    """50,000 rows in five row groups with small pages, a list and a struct."""
    path = str(tmp_path_factory.mktemp("paged") / "f.parquet")
    n = 50_000
    table = pa.table(
        {
            "i": pa.array(range(n), pa.int64()),
            "s": pa.array([f"v{k % 50}" for k in range(n)]),
            "l": pa.array([[k, None] if k % 3 else [] for k in range(n)], pa.list_(pa.int64())),
            "t": pa.array([{"a": k, "b": None} for k in range(n)], pa.struct([("a", pa.int32()), ("b", pa.string())])),
        },
        schema=pa.schema([pa.field("i", pa.int64(), False), ("s", pa.string()), ("l", pa.list_(pa.int64())), ("t", pa.struct([("a", pa.int32()), ("b", pa.string())]))], metadata={"made": "here"}),
    )
    pq.write_table(table, path, row_group_size=10_000, data_page_size=1024, compression="zstd", use_dictionary=["s"])
    return path


def test_all_pages_and_row_groups_are_read(spark, paged):
    assert reader.read(spark, paged).selectExpr("count(*)", "sum(i)", "count(distinct s)", "sum(size(l))").head()[:] == (50_000, 1_249_975_000, 50, 66_666)
    assert [r["i"] for r in reader.read(spark, paged, ["i"], ordered=True).collect()] == list(range(50_000))
    assert reader.numbered(spark, paged).where("row_id <> i").count() == 0


def test_pull(spark, paged):
    rows = reader.stream_records(reader.read(spark, paged, ordered=True))
    assert next(rows) == {"i": 0, "s": "v0", "l": [], "t": {"a": 0, "b": None}}
    assert sum(1 for _ in rows) == 49_999


def test_file_and_schema_frames(spark, paged):
    found = metadata(spark, "file_meta", paged).head()
    want = duckdb.sql(f"select num_rows, num_row_groups, created_by, format_version from parquet_file_metadata('{paged}')").limit(1).fetchall()[0]
    assert (found["num_rows"], found["num_row_groups"], found["created_by"], found["version"]) == want
    assert found["key_value_metadata"]["made"] == "here" and found["encryption_algorithm"] is None
    rows = metadata(spark, "schema", paged).orderBy("ordinal").collect()
    want = duckdb.sql(f"select name, type, repetition_type, num_children, converted_type from parquet_schema('{paged}')").fetchall()
    assert [(r["name"], r["type"], r["repetition_type"], r["num_children"], r["converted_type"]) for r in rows][1:] == want[1:]
    levels = {r["path_in_schema"]: (r["max_rep"], r["max_def"]) for r in rows}
    assert levels["i"] == (0, 0) and levels["l.list.element"] == (1, 3) and levels["t.a"] == (0, 2)
    assert {r["path_in_schema"]: r["logical_type"]["name"] for r in rows if r["logical_type"]} == {"s": "STRING", "l": "LIST", "t.b": "STRING"}


def test_row_groups_and_chunks(spark, paged):
    groups = metadata(spark, "row_groups", paged).orderBy("row_group").collect()
    assert [(g["first_row"], g["num_rows"]) for g in groups] == [(k * 10_000, 10_000) for k in range(5)]
    found = metadata(spark, "column_chunks", paged).orderBy("row_group", "column").collect()
    columns = "row_group_id, column_id, type, num_values, data_page_offset, dictionary_page_offset, total_compressed_size, total_uncompressed_size, compression, path_in_schema"
    want = duckdb.sql(f"select {columns} from parquet_metadata('{paged}') order by 1, 2").fetchall()
    names = "row_group column type num_values data_page_offset dictionary_page_offset total_compressed_size total_uncompressed_size codec".split()
    assert [tuple(r[n] for n in names) for r in found] == [w[:9] for w in want]
    assert {r["path_in_schema"] for r in found} == {"i", "s", "l.list.element", "t.a", "t.b"}
    first = found[0]["statistics"]
    assert int.from_bytes(first["min_value"], "little") == 0 and int.from_bytes(first["max_value"], "little") == 9999 and first["null_count"] == 0


def test_pages(spark, paged):
    rows = metadata(spark, "pages", paged).collect()
    data = [r for r in rows if r["type"] == "DATA_PAGE"]
    assert len([r for r in data if r["path_in_schema"] == "i"]) >= 50
    assert sum(r["num_values"] for r in data if r["path_in_schema"] == "i") == 50_000
    chunks = {(r["row_group"], r["path_in_schema"]): r for r in metadata(spark, "column_chunks", paged).collect()}
    for key, chunk in chunks.items():
        own = sorted((r for r in rows if (r["row_group"], r["path_in_schema"]) == key), key=lambda r: r["page"])
        assert sum(r["header_size"] + r["compressed_page_size"] for r in own) == chunk["total_compressed_size"]
        assert sum(r["num_values"] for r in own if r["type"] == "DATA_PAGE") == chunk["num_values"]
    assert {r["path_in_schema"] for r in rows if r["type"] == "DICTIONARY_PAGE"} == {"s"}


def test_pages_of_version_two(spark, tmp_path):
    path = str(tmp_path / "v2.parquet")
    pq.write_table(pa.table({"i": pa.array([1, None, 3], pa.int64()), "s": ["a", "ab", "abc"]}), path, data_page_version="2.0", use_dictionary=False, column_encoding={"i": "DELTA_BINARY_PACKED", "s": "DELTA_BYTE_ARRAY"}, compression="zstd")
    found = {r["path_in_schema"]: r for r in metadata(spark, "pages", path).collect()}
    assert (found["i"]["type"], found["i"]["num_nulls"], found["i"]["num_rows"], found["i"]["encoding"]) == ("DATA_PAGE_V2", 1, 3, "DELTA_BINARY_PACKED")
    assert found["s"]["encoding"] == "DELTA_BYTE_ARRAY"
    assert sorted(map(tuple, reader.read(spark, path).collect()), key=str) == sorted([(1, "a"), (None, "ab"), (3, "abc")], key=str)


def test_folders_patterns_and_odd_files(spark, paged, tmp_path):
    folder = tmp_path / "many"
    spark.range(100).repartition(3).write.parquet(str(folder))
    assert metadata(spark, "file_meta", str(folder)).selectExpr("sum(num_rows)", "count(*)").head()[:] == (100, 3)
    assert metadata(spark, "file_meta", f"{folder}/*.parquet").count() == 3
    assert metadata(spark, "file_meta", f"file:{folder}").count() == 3
    bad = tmp_path / "bad.parquet"
    bad.write_bytes(b"PAR1 but nothing more than that PAR2")
    with pytest.raises(Exception, match="no footer"):
        metadata(spark, "file_meta", str(bad)).collect()
    with pytest.raises(Exception, match="No such file|FileNotFound|none.parquet"):
        metadata(spark, "file_meta", str(tmp_path / "none.parquet")).collect()


def test_thrift_truncation():
    with pytest.raises(thrift.Truncated):
        thrift.Reader(b"\x15").structure(thrift.PAGE_HEADER)
    assert thrift.Reader(b"\x15\x04\x00").structure(thrift.PAGE_HEADER) == {"type": "DICTIONARY_PAGE"}


def test_physical_types(spark, tmp_path):
    path = str(tmp_path / "types.parquet")
    day, time = datetime.date(2020, 1, 2), datetime.time(1, 2, 3, 4)
    stamp = datetime.datetime(2020, 1, 2, 3, 4, 5, 6)
    table = pa.table(
        {
            "b": [True, None],
            "i": pa.array([1, 2], pa.int32()),
            "f": pa.array([1.5, 2.5], pa.float32()),
            "d": [1.5, 2.5],
            "x": pa.array([b"ab", b"cd"], pa.binary(2)),
            "m": pa.array([decimal.Decimal("1.25"), None], pa.decimal128(15, 2)),
            "u": pa.array([2**63, 1], pa.uint64()),
            "day": [day, None],
            "time": pa.array([time, None], pa.time64("us")),
            "us": pa.array([stamp, None], pa.timestamp("us")),
            "ns": pa.array([stamp, None], pa.timestamp("ns")),
        }
    )
    pq.write_table(table, path)
    row = reader.read(spark, path).where("i = 1").head()
    assert (row["b"], row["i"], row["f"], row["d"], row["x"], row["m"], row["u"], row["day"], row["us"]) == (True, 1, 1.5, 1.5, b"ab", decimal.Decimal("1.25"), 2**63, day, stamp)
    assert row["ns"] == 1577934245000006000
    raw = reader.read(spark, path, ["us", "day", "time"], physical=True).where("us is not null").head()
    assert (raw["us"], raw["day"], raw["time"]) == (1577934245000006, 18263, 3723000004)


class Ranges(http.server.SimpleHTTPRequestHandler):
    def do_GET(self):
        path = self.translate_path(self.path)
        if not os.path.exists(path):
            return self.send_error(404)
        data = open(path, "rb").read()
        span = self.headers["Range"].removeprefix("bytes=")
        a, _, b = span.partition("-")
        start, stop = (len(data) - int(b), len(data)) if not a else (int(a), int(b) + 1 if b else len(data))
        self.send_response(206)
        self.send_header("Content-Range", f"bytes {start}-{min(stop, len(data)) - 1}/{len(data)}")
        self.end_headers()
        self.wfile.write(data[start:stop])

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def served(paged):
    folder = os.path.dirname(paged)
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), lambda *a: Ranges(*a, directory=folder))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}/f.parquet"
    server.shutdown()


def test_http(spark, paged, served):
    assert files.opened(served).read(0, 4) == b"PAR1"
    assert metadata(spark, "file_meta", served).head()["num_rows"] == 50_000
    want = reader.read(spark, paged).selectExpr("sum(i)", "count(distinct s)", "sum(size(l))").head()
    assert reader.ranged(spark, served).selectExpr("sum(i)", "count(distinct s)", "sum(size(l))").head() == want
    with pytest.raises(Exception, match="404"):
        metadata(spark, "file_meta", served.replace("f.parquet", "g.parquet")).collect()


def test_row_group_by_range(spark, paged):
    assert reader.ranged(spark, paged, [1, 4], ["i"]).selectExpr("min(i)", "max(i)", "count(*)").head()[:] == (10_000, 49_999, 20_000)
    with pytest.raises(Exception, match="row groups 0 to 4"):
        reader.ranged(spark, paged, [5]).collect()


def test_a_footer_is_read_anew_after_an_overwrite(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = str(tmp_path / "o.parquet")
    for rows in (5, 50):
        pq.write_table(pa.table({"a": list(range(rows))}), path)
        assert metadata(spark, "file_meta", path).head()["num_rows"] == rows
