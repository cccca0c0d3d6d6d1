import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import codecs


def one(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} {kind(v)}" for k, v in inputs.items()))
    return row.select(column.alias("x")).head()["x"]


def kind(value):
    return {bytes: "binary", bytearray: "binary", int: "bigint", list: "array<bigint>", type(None): "binary"}[type(value)]


@pytest.fixture(autouse=True)
def b(spark):
    return F.col("b")


def test_bit_unpack_from_the_least_bit(spark, b):
    found = one(spark, codecs.bit_unpack(b, 3, 1), b=bytes([136, 198, 250]))
    assert (found["values"], found["consumed"], found["rest"]) == (list(range(8)), 3, b"")
    found = one(spark, codecs.bit_unpack(b, 3, 1), b=bytes([0x88, 0x46, 0, 0]))
    assert (found["values"], found["consumed"], found["rest"]) == ([0, 1, 2, 3, 4, 0, 0, 0], 3, b"\0")


def test_bit_unpack_from_the_most_bit_behind_a_count(spark, b):
    found = one(spark, codecs.bit_unpack_counted(b, 3), b=bytes([3, 5, 57, 119]))
    assert (found["values"], found["consumed"], found["rest"]) == (list(range(8)), 4, b"")


def test_rle(spark, b):
    found = one(spark, codecs.rle_decode(b, 3, 4), b=bytes([1, 2, 3, 4, 5]))
    assert (found["values"], found["consumed"], found["rest"]) == ([1] * 4, 1, bytes([2, 3, 4, 5]))


@pytest.mark.parametrize("rest", [b"", b"\1\2"])
def test_uint(spark, b, rest):
    data = bytes([136, 198, 250])
    found = one(spark, codecs.uint_le(b, 3), b=data + rest)
    assert (found["value"], found["consumed"], found["rest"]) == (16434824, 3, rest)
    assert one(spark, codecs.uint_be(b, 3), b=data + rest)["value"] == int.from_bytes(data, "big")


@pytest.mark.parametrize("rest", [b"", b"\1\2"])
def test_varint(spark, b, rest):
    found = one(spark, codecs.varint_decode(b), b=bytes.fromhex("E58E26") + rest)
    assert (found["value"], found["consumed"], found["rest"]) == (624485, 3, rest)


@pytest.mark.parametrize("value,coded", [(624485, "E58E26"), (0, "00"), (127, "7F"), (128, "8001"), (2**63 - 1, "FFFFFFFFFFFFFFFF7F"), (-1, "FFFFFFFFFFFFFFFFFF01")])
def test_varint_both_ways(spark, b, value, coded):
    assert one(spark, codecs.varint_encode(F.col("v")), v=value) == bytes.fromhex(coded)
    assert one(spark, codecs.varint_decode(b), b=bytes.fromhex(coded))["value"] == value


def test_cut_off_bytes_raise(spark, b):
    for column, data in [(codecs.varint_decode(b), b"\x80\x80"), (codecs.varint_decode(b), b""), (codecs.uint_le(b, 3), b"\1"), (codecs.bit_unpack(b, 3, 1), b"\1"), (codecs.rle_decode(b, 9, 2), b"\1")]:
        with pytest.raises(Exception, match="needs|no end|has"):
            one(spark, column, b=data)


def test_nulls_stay_null(spark, b):
    for column in (codecs.varint_decode(b), codecs.uint_le(b, 3), codecs.bit_unpack(b, 3, 1), codecs.bit_unpack_counted(b, 3), codecs.rle_decode(b, 3, 2), codecs.hybrid_decode(b, 3, F.lit(1))):
        assert one(spark, column, b=None) is None


@pytest.mark.parametrize("width", [0, 1, 3, 7, 8, 13, 17, 31, 32])
def test_pack_and_unpack(spark, b, width):
    values = [int(x) for x in np.random.default_rng(width).integers(0, 1 << width, 24)]
    packed = one(spark, codecs.bit_pack(F.col("v"), width), v=values)
    assert len(packed) == 3 * width
    assert one(spark, codecs.bit_unpack(b, width, 3), b=bytes(packed))["values"] == values


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 20).flatmap(lambda w: st.tuples(st.just(w), st.lists(st.tuples(st.integers(0, (1 << w) - 1), st.integers(1, 30)), max_size=12))))
def test_hybrid_of_many_runs(case):
    width, runs = case
    values = np.array([v for v, n in runs for _ in range(n)], np.int64)
    assert codecs.hybrid_values(codecs._hybrid_bytes(values, width), width, len(values)).tolist() == values.tolist()


def test_hybrid_of_two_kinds_of_runs(spark, b):
    data = bytes([8, 5]) + bytes([3, 136, 198, 250])  # four fives, then one packed group
    assert one(spark, codecs.hybrid_decode(b, 3, F.lit(12)), b=data) == [5] * 4 + list(range(8))
    with pytest.raises(Exception, match="values asked for"):
        one(spark, codecs.hybrid_decode(b, 3, F.lit(13)), b=data)


def test_level_bit_width(spark, b):
    found = spark.range(9).select(codecs.level_bit_width(F.col("id")).alias("w")).toPandas()["w"].tolist()
    assert found == [0, 1, 2, 2, 3, 3, 3, 3, 4]


def test_dictionary_and_levels(spark, b):
    v, d = F.col("v"), F.col("d")
    assert one(spark, codecs.dictionary_values(v, d), v=[1, 0, 1], d=[7, 9]) == [9, 7, 9]
    with pytest.raises(Exception, match="beyond the dictionary"):
        one(spark, codecs.dictionary_values(v, d), v=[2], d=[7, 9])
    assert one(spark, codecs.spread(v, 1, d), v=[1, 0, 1, 0], d=[7, 9]) == [7, None, 9, None]
    with pytest.raises(Exception, match="fewer values"):
        one(spark, codecs.spread(v, 1, d), v=[1, 1], d=[7])
    assert [tuple(x) for x in one(spark, codecs.zip_exact(v, d), v=[1, 2], d=[3, 4])] == [(1, 3), (2, 4)]
    with pytest.raises(Exception, match="unequal sizes"):
        one(spark, codecs.zip_exact(v, d), v=[1], d=[3, 4])
    assert one(spark, codecs.levels_or_zeros(v, 3), v=[]) == [0, 0, 0]
