import json

import pytest
from pyspark.sql import functions as F

from quern.functions import cbor, records, values
from quern.sources import reader, sinks
from quern.streaming import records as streams

#: Six rows; each has one of six columns.
GOLDEN = [{"f1": [[1, 2], [3, 4], [5]]}] + [{f"f{k}": [1, 2, 3]} for k in range(2, 7)]


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("golden"))
    schema = "f1 array<array<bigint>>, " + ", ".join(f"f{k} array<bigint>" for k in range(2, 7))
    rows = [tuple(r.get(f"f{k}") for k in range(1, 7)) for r in GOLDEN]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").option("compression", "none").parquet(folder)
    return folder


def test_golden_round_trip(spark, golden):
    df = reader.read(spark, golden, ordered=True)
    assert [json.loads(r["record"]) for r in records.to_records(df).collect()] == GOLDEN
    again = records.from_records(records.to_records(df), df.schema)
    assert again.collect() == df.collect()


def test_raw_lists_and_collapse(spark, golden):
    raw = reader.read(spark, golden, raw_lists=True, ordered=True)
    first = json.loads(records.to_records(raw).head()["record"])
    assert first["f1"][0] == {"element": [{"element": 1}, {"element": 2}]}
    assert records.collapse_element(raw).collect() == reader.read(spark, golden, ordered=True).collect()


def test_users_struct_named_element_is_kept_unless_asked(spark, tmp_path):
    path = str(tmp_path / "e")
    spark.sql("select array(named_struct('element', 1L)) as f, named_struct('element', named_struct('element', 2L)) as g").write.parquet(path)
    assert json.loads(records.to_records(reader.read(spark, path)).head()["record"]) == {"f": [{"element": 1}], "g": {"element": {"element": 2}}}
    assert json.loads(records.to_records(reader.read(spark, path, collapse_element=True)).head()["record"]) == {"f": [1], "g": 2}


def test_nulls(spark):
    df = spark.createDataFrame([(None, None), (1, None), (None, (None, 1))], "x bigint, a struct<b: bigint, c: bigint>")
    assert [r["record"] for r in records.to_records(df).collect()] == ["{}", '{"x":1}', '{"a":{"c":1}}']
    assert [r["record"] for r in records.to_records(df, null_rows=True).collect()][0] == "null"
    assert [r["record"] for r in records.to_records(df, keep_nulls=True).collect()][1] == '{"x":1,"a":null}'
    lists = spark.createDataFrame([([1, None],), ([],), (None,)], "f array<bigint>")
    assert [r["record"] for r in records.to_records(lists).collect()] == ['{"f":[1,null]}', '{"f":[]}', "{}"]


def test_bytes_at_any_depth(spark):
    df = spark.createDataFrame([(b"\xff", [b"ab", b"\xfe"], {"k": b"\xc3\xa9"}, (b"x",))], "b binary, l array<binary>, m map<string, binary>, s struct<b: binary>")
    found = json.loads(records.to_records(df).head()["record"])
    assert found == {"b": records.NOT_UTF8, "l": ["ab", records.NOT_UTF8], "m": {"k": "é"}, "s": {"b": "x"}}


def test_json_files(spark, golden, tmp_path):
    df = reader.read(spark, golden)
    sinks.write_json(df, str(tmp_path / "j"))
    assert sorted(map(str, sinks.read_json(spark, str(tmp_path / "j"), df.schema).collect())) == sorted(map(str, df.collect()))
    fraction = spark.createDataFrame([('{"a": 1.5}',)], "record string")
    assert records.from_records(fraction, "a double").head()["a"] == 1.5
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        records.from_records(spark.createDataFrame([("{",)], "record string"), "a bigint").collect()
    assert records.from_records(spark.createDataFrame([("{",)], "record string"), "a bigint", strict=False).head()["a"] is None
    assert records.to_variant(fraction).select(F.variant_get("value", "$.a", "double")).head()[0] == 1.5


def test_bytes_and_cbor(spark, golden):
    df = reader.read(spark, golden)
    for there, back in ((sinks.to_bytes, sinks.from_bytes), (sinks.to_cbor, sinks.from_cbor)):
        assert sorted(map(str, back(there(df), df.schema).collect())) == sorted(map(str, df.collect()))
    maps = spark.createDataFrame([({"a": 1}, b"\xff", 1.5, True, -3)], "m map<string, bigint>, b binary, d double, t boolean, i int")
    assert sinks.from_cbor(sinks.to_cbor(maps), maps.schema).collect() == maps.collect()


def test_every_type_through_bytes_and_cbor(spark):
    df = spark.sql("""select * from values
        (date'2024-02-29', timestamp'2024-02-29 12:34:56.789012', timestamp_ntz'1969-12-31 23:59:59.5', cast(-1.50 as decimal(5,2)), cast('12345678901234567890123456789.125' as decimal(38,3)), X'FF00', 'abcd', array(X'61', null), named_struct('d', date'1900-01-01')),
        (null, null, null, null, null, X'', null, null, null) as t(d, ts, ntz, small, large, bin, txt, list, st)""")
    df = df.union(df.select("d", "ts", "ntz", "small", "large", F.lit(b"abcd"), "txt", "list", "st"))
    for there, back in ((sinks.to_bytes, sinks.from_bytes), (sinks.to_cbor, sinks.from_cbor)):
        assert sorted(map(str, back(there(df), df.schema).collect())) == sorted(map(str, df.collect()))


def test_physical_decimals(spark, tmp_path):
    """A decimal of 15 digits in fixed bytes, as the file's footer says."""
    import decimal

    import pyarrow as pa
    import pyarrow.parquet as pq

    path = str(tmp_path / "d.parquet")
    pq.write_table(pa.table({"a": pa.array([decimal.Decimal("1.25"), None], pa.decimal128(15, 2)), "t": ["x", "y"]}), path)
    rows = reader.read(spark, path, physical=True).collect()
    assert int.from_bytes(rows[0]["a"], "big", signed=True) == 125 and rows[1]["a"] is None and bytes(rows[0]["t"]) == b"x"


@pytest.mark.parametrize("value,coded", [(0, "00"), (23, "17"), (24, "1818"), (1000000, "1a000f4240"), (-1, "20"), (-500, "3901f3"), (1.1, "fb3ff199999999999a"), ("ü", "62c3bc"), (b"\1\2", "420102"), ([1, [2]], "82018102"), ({"a": 1}, "a1616101"), (None, "f6"), (True, "f5")])
def test_cbor_vectors(value, coded):
    assert cbor.dumps(value).hex() == coded
    assert cbor.loads(bytes.fromhex(coded)) == value


@pytest.mark.parametrize("coded", ["", "18", "62c3", "8201", "0000", "c100", "9fff"])
def test_cbor_that_is_not_one_item(coded):
    with pytest.raises(ValueError):
        cbor.loads(bytes.fromhex(coded))


def test_merging(spark):
    df = spark.createDataFrame([((1, None), (2, 3, 4)), (None, (2, 3, 4)), (None, None)], "a struct<x: bigint, y: bigint>, b struct<x: bigint, y: bigint, z: bigint>")
    merged = df.select(values.merge_structs(df.a, df.b, df.schema["a"].dataType, df.schema["b"].dataType).alias("m")).collect()
    assert [r["m"] and tuple(r["m"]) for r in merged] == [(1, 3, 4), (2, 3, 4), None]
    maps = spark.createDataFrame([({"k": 1}, {"k": 2, "l": 3}), (None, {"k": 2}), ({"k": 1}, None)], "a map<string, int>, b map<string, int>")
    assert [r[0] for r in maps.select(values.merge_maps(maps.a, maps.b)).collect()] == [{"k": 1, "l": 3}, {"k": 2}, {"k": 1}]
    lists = spark.createDataFrame([([1], [2]), (None, [2]), ([1], None), ([], [])], "a array<int>, b array<int>")
    assert [r[0] for r in lists.select(values.concat_lists(lists.a, lists.b)).collect()] == [[1, 2], [2], [1], []]


def test_same_ignores_order_of_keys(spark):
    df = spark.sql("select map('a', 1, 'b', 2) as x, map('b', 2, 'a', 1) as y, map('a', 1) as z, cast(null as map<string, int>) as n")
    kind = df.schema["x"].dataType
    assert tuple(df.select(values.same(df.x, df.y, kind), values.same(df.x, df.z, kind), values.same(df.n, df.n, kind), values.same(df.x, df.n, kind)).head()) == (True, False, True, False)


def test_stream_of_a_folder(spark, golden, tmp_path):
    schema = reader.read(spark, golden).schema
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):  # a second run from the same checkpoint adds nothing
        streams.write_records(streams.follow(spark, golden, schema), out, state, available_now=True).awaitTermination()
    assert sorted(r[0] for r in spark.read.text(out).collect()) == sorted(json.dumps(r, separators=(",", ":")) for r in GOLDEN)
