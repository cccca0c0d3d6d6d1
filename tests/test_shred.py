import pytest
from pyspark.sql import functions as F

from quern.operators import dictionary as dictionaries
from quern.operators import shred as shredding


def entries(df, path):
    rows = shredding.shred(df, ["k"], path).collect()
    return [(r["rep"], r["def"], r["value"]) for r in sorted(rows, key=lambda r: (r["k"], r["at"]))]


def test_levels_of_lists(spark):
    df = spark.createDataFrame([(0, [1, None]), (1, []), (2, None)], "k int, a array<bigint>")
    assert entries(df, "a.list.element") == [(0, 3, 1), (1, 2, None), (0, 1, None), (0, 0, None)]


def test_worked_example_of_nested_lists(spark):
    df = spark.createDataFrame([(0, [[1, 2], [3, 4], [5]]), (1, None)], "k int, f array<array<bigint>>")
    assert entries(df, "f.list.element.list.element") == [(0, 5, 1), (2, 5, 2), (1, 5, 3), (2, 5, 4), (1, 5, 5), (0, 0, None)]


def test_leaves_and_required_ones(spark):
    from pyspark.sql import types as T

    schema = T.StructType(
        [
            T.StructField("r", T.LongType(), False),
            T.StructField("m", T.MapType(T.StringType(), T.ArrayType(T.LongType(), False))),
        ]
    )
    assert [(x.path, x.max_rep, x.max_def) for x in shredding.leaves(schema)] == [("r", 0, 0), ("m.key_value.key", 1, 2), ("m.key_value.value.list.element", 2, 4)]
    with pytest.raises(KeyError, match="no leaf m"):
        shredding.leaf(schema, "m")


CASES = {
    "flat": ("x bigint", [(None,), (1,)]),
    "lists": ("f array<bigint>", [([1],), ([],), ([2],), (None,), ([None, 3],)]),
    "null inside": ("f array<array<bigint>>", [([None, [1]],), ([[]],), ([[1, 2], [3, 4], [5]],), (None,)]),
    "deep": ("f array<array<array<bigint>>>", [([[[1, 2], [3]], [[4]]],), ([[], [[]], None],)]),
    "structs": ("a struct<b: bigint, c: bigint>", [((None, 1),), ((1, None),), (None,)]),
    "list of structs": ("l array<struct<a: bigint, b: array<string>>>", [([(1, ["x"]), (2, None), None, (None, [])],), ([],), (None,)]),
    "maps": ("m map<string, bigint>", [({"x": 1},), ({},), (None,), ({"a": 1, "b": None},)]),
    "map of structs": ("m map<string, struct<a: bigint, b: array<bigint>>>", [({"x": (1, [1, 2])},), ({"y": None},), (None,)]),
    "several": ("a bigint, s struct<t: array<bigint>, u: string>, z array<string>", [(1, ([1], "u"), ["z"]), (None, None, None), (2, (None, None), [])]),
}


@pytest.mark.parametrize("name", CASES)
def test_assembly_is_the_inverse(spark, name):
    kind, rows = CASES[name]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"k int, {kind}")
    schema = df.drop("k").schema
    parts = {x.path: shredding.shred(df, ["k"], x.path) for x in shredding.leaves(schema)}
    again = shredding.assemble(parts, ["k"], schema)
    assert again.drop("k").schema.simpleString() == schema.simpleString()
    assert sorted(again.collect(), key=lambda r: r["k"]) == sorted(df.collect(), key=lambda r: r["k"])


def test_assembly_wants_every_leaf(spark):
    df = spark.createDataFrame([(0, (1, 2))], "k int, a struct<b: bigint, c: bigint>")
    with pytest.raises(KeyError, match="a.c"):
        shredding.assemble({"a.b": shredding.shred(df, ["k"], "a.b")}, ["k"], df.drop("k").schema)


def test_assembly_keeps_one_partitioning(spark):
    """All groupings and the joins of two leaves go by the key: one exchange for each leaf."""
    df = spark.createDataFrame([(0, [[1]], [2])], "k int, f array<array<bigint>>, g array<bigint>")
    schema = df.drop("k").schema
    parts = {x.path: shredding.shred(df, ["k"], x.path) for x in shredding.leaves(schema)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = shredding.assemble(parts, ["k"], schema)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_record_numbers(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 0), (4, 2)], "pos int, rep int")
    assert [r["row_id"] for r in shredding.record_numbers(df, "pos").orderBy("pos").collect()] == [1, 1, 2, 3, 3]


def test_dictionary(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, None), (3, "b"), (4, "c")], "i bigint, v string")
    entries = dictionaries.dictionary(df, "v", "i")
    assert sorted(map(tuple, entries.collect())) == [(0, "b"), (1, "a"), (2, "c")]
    coded = dictionaries.dictionary_encode(df, "v", entries)
    assert {r["i"]: r["code"] for r in coded.collect()} == {0: 0, 1: 1, 2: None, 3: 0, 4: 2}
    assert sorted(map(tuple, dictionaries.dictionary_decode(coded, "v", entries).select("i", "v").collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="beyond the dictionary"):
        dictionaries.dictionary_decode(coded, "v", entries.where("code < 2")).collect()
    assert dictionaries.dictionary(df.limit(0), "v", "i").collect() == []


def test_row_numbers_in_ranges(spark):
    df = spark.range(0, 1000).select((F.col("id") * 37 % 1009).alias("x"))
    found = dictionaries.row_numbers(df, "x", "n", 8).orderBy("x").collect()
    assert [r["n"] for r in found] == list(range(1000))


def test_runs(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, None), (1, 3, None), (1, 4, "a"), (2, 0, None)], "k int, i int, v string")
    found = dictionaries.runs(df, ["k"], ["i"], "v").collect()
    assert sorted((r["k"], r["run"], str(r["v"]), r["n"]) for r in found) == [(1, 0, "a", 2), (1, 1, "None", 2), (1, 2, "a", 1), (2, 0, "None", 1)]


def test_levels_of_required_nodes_come_from_the_file(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from quern.sources import reader

    path = str(tmp_path / "r.parquet")
    kind = pa.schema([pa.field("k", pa.int64(), False), pa.field("x", pa.list_(pa.field("element", pa.int64(), False)), False)])
    pq.write_table(pa.table({"k": [1, 2], "x": [[7, 8], []]}, schema=kind), path)
    df = spark.read.parquet(path)
    entries = shredding.shred(df, ["k"], "x.list.element", reader.stated_schema(df)).orderBy("k", "at").collect()
    assert [(r["k"], r["rep"], r["def"], r["max_def"], r["value"]) for r in entries] == [(1, 0, 1, 1, 7), (1, 1, 1, 1, 8), (2, 0, 0, 1, None)]


def test_columns_of_different_rows_raise(spark):
    a, b = spark.createDataFrame([(1, 1), (2, 2)], "k int, a int"), spark.createDataFrame([(1, 3)], "k int, b int")
    assert shredding.zip_columns([a.where("k = 1"), b], ["k"]).collect() == [(1, 1, 3)]
    with pytest.raises(Exception, match="different rows"):
        shredding.zip_columns([a, b], ["k"]).collect()
