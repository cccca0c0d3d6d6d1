"""Bit-packing, run-length and variable-length integer codecs as column expressions.

Everything but the multi-run hybrid is built from Spark's own functions, so it
runs in the JVM (lambdas over arrays there are interpreted, not generated). A decoder gives a struct: what it read (``value`` or
``values``), how many bytes that took (``consumed``) and the bytes behind them
(``rest``). A null argument gives null; bytes that end too early raise an error.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A varint of more bytes than this has bits beyond 64.
VARINT_BYTES = 10
#: Widest value of a bit-packed run.
WIDTHS = range(33)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def _count(n: int | Column) -> Column:
    return n.cast("int") if isinstance(n, Column) else F.lit(n)


def _upto(n: Column) -> Column:
    """0, 1, ... n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def _cut(data: Column, taken: Column, name: str, value: Column) -> Column:
    """The decoder's struct, or an error if fewer than ``taken`` bytes are there."""
    size = F.octet_length(data)
    rest = F.substring(data, taken + 1, F.greatest(size - taken, F.lit(0)))
    short = F.raise_error(F.concat(F.lit("needs "), taken.cast("string"), F.lit(" bytes, has "), size.cast("string")))
    whole = F.struct(value.alias(name), taken.alias("consumed"), rest.alias("rest"))
    return F.when(size < taken, short).when(data.isNotNull(), whole)


def byte_values(data: Column) -> Column:
    """The bytes of a binary column as an array of 0 to 255."""
    letters = F.split(F.decode(data, "ISO-8859-1"), "")  # where a byte is a character of the same number
    values = F.transform(letters, lambda c: F.ascii(c).cast("bigint"))
    return F.when(F.octet_length(data) > 0, values).when(data.isNotNull(), F.expr("cast(array() as array<bigint>)"))


def binary_of(values: Column) -> Column:
    """The inverse of ``byte_values``."""
    return F.encode(F.array_join(F.transform(values, F.char), ""), "ISO-8859-1")


def _folded(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, v: F.shiftleft(acc, 8).bitwiseOR(v))


def uint_le(data: Column, n: int | Column) -> Column:
    """The first ``n`` (8 at most) bytes as an integer, the least byte first; with 8 bytes the top bit is the sign."""
    n = _count(n)
    return _cut(data, n, "value", _folded(F.reverse(byte_values(F.substring(data, F.lit(1), n)))))


def uint_be(data: Column, n: int | Column) -> Column:
    """As ``uint_le``, the greatest byte first."""
    n = _count(n)
    return _cut(data, n, "value", _folded(byte_values(F.substring(data, F.lit(1), n))))


def level_bit_width(most: Column) -> Column:
    """Bits that levels up to ``most`` take: none for 0."""
    return F.when(most == 0, 0).otherwise(F.length(F.bin(most.cast("bigint"))))


def bit_unpack(data: Column, width: int, groups: int | Column, first: str = "least") -> Column:
    """``groups`` times 8 values of ``width`` bits, packed from the ``least`` or the ``most`` significant bit of each byte.

    Each value is read from the five bytes it can touch.
    """
    if width not in WIDTHS:
        raise ValueError(f"width {width} is not within 0 to 32")
    groups = _count(groups)
    taken = groups * width
    mask = (1 << width) - 1

    def read(raw: Column) -> Column:
        def value(k: Column) -> Column:
            bit = k.cast("bigint") * width
            at, inner = (bit - bit % 8) / 8, (bit % 8).cast("int")
            seen = [F.coalesce(F.get(raw, at.cast("int") + i), F.lit(0).cast("bigint")) for i in range(5)]
            if first == "least":
                window = sum((F.shiftleft(b, 8 * i) for i, b in enumerate(seen[1:], 1)), seen[0])
                return F.call_function("shiftright", window, inner).bitwiseAND(F.lit(mask))
            window = sum((F.shiftleft(b, 32 - 8 * i) for i, b in enumerate(seen[:4])), seen[4])
            return F.call_function("shiftright", window, F.lit(40 - width) - inner).bitwiseAND(F.lit(mask))

        return F.transform(_upto(groups * 8), value)

    zeros = F.array_repeat(F.lit(0).cast("bigint"), groups * 8)
    values = zeros if not width else _let(byte_values(F.substring(data, F.lit(1), taken)), read)
    return _cut(data, taken, "values", values)


def bit_unpack_counted(data: Column, width: int) -> Column:
    """Values packed from the most significant bit, behind a varint that gives the number of groups times two plus one."""

    def read(head: Column) -> Column:
        groups = F.call_function("shiftright", head.getField("value"), F.lit(1)).cast("int")
        body = bit_unpack(head.getField("rest"), width, groups, "most")
        whole = lambda b: F.struct(b.getField("values").alias("values"), (b.getField("consumed") + head.getField("consumed")).alias("consumed"), b.getField("rest").alias("rest"))
        return _let(body, lambda b: F.when(b.isNotNull(), whole(b)))

    return _let(varint_decode(data), read)


def bit_pack(values: Column, width: int) -> Column:
    """Values packed from the least significant bit; the last byte is filled up with zeros."""
    if width not in WIDTHS:
        raise ValueError(f"width {width} is not within 0 to 32")
    if not width:
        return F.when(values.isNotNull(), F.lit(b""))

    touched = -(-(width + 7) // width)  # values that a byte can have bits of

    def byte(vs: Column) -> Callable[[Column], Column]:
        def of(j: Column) -> Column:
            bit = j.cast("bigint") * 8
            inner = (bit % width).cast("int")
            first = ((bit - inner) / width).cast("int")
            seen = [F.coalesce(F.get(vs, first + t), F.lit(0)).cast("bigint").bitwiseAND(F.lit((1 << width) - 1)) for t in range(touched)]
            out = F.call_function("shiftright", seen[0], inner)
            for t, v in enumerate(seen[1:], 1):
                out = out.bitwiseOR(F.call_function("shiftleft", v, F.lit(t * width) - inner))
            return out.bitwiseAND(F.lit(255))

        return of

    count = F.ceil(F.size(values) * width / 8).cast("int")
    return F.when(values.isNotNull(), _let(values, lambda vs: binary_of(F.transform(_upto(count), byte(vs)))))


def rle_decode(data: Column, width: int, n: int | Column) -> Column:
    """One run: a value of as many whole bytes as ``width`` bits take, ``n`` times."""
    return _let(uint_le(data, -(-width // 8)), lambda v: F.when(v.isNotNull(), F.struct(F.array_repeat(v.getField("value"), _count(n)).alias("values"), v.getField("consumed").alias("consumed"), v.getField("rest").alias("rest"))))


def varint_decode(data: Column) -> Column:
    """The variable-length integer at the start: seven bits a byte, the least first, the top bit set on all but the last."""

    def read(raw: Column) -> Column:
        size = F.array_position(F.transform(raw, lambda b: b < 128), True).cast("int")
        value = F.aggregate(F.reverse(F.slice(raw, F.lit(1), size)), F.lit(0).cast("bigint"), lambda acc, b: F.shiftleft(acc, 7).bitwiseOR(b.bitwiseAND(F.lit(127))))
        return F.when(size == 0, F.raise_error(F.lit("a variable-length integer has no end"))).when(size > VARINT_BYTES, F.raise_error(F.lit("a variable-length integer is too long"))).otherwise(_cut(data, size, "value", value))

    return F.when(data.isNotNull(), _let(byte_values(F.substring(data, 1, 32)), read))


def varint_encode(value: Column) -> Column:
    """The bytes of a variable-length integer; 0 takes one byte, a negative number its 64 bits."""
    value = value.cast("bigint")
    groups = F.ceil(F.length(F.bin(value)) / 7).cast("int")
    of = lambda i: F.call_function("shiftrightunsigned", value, i * 7).bitwiseAND(F.lit(127))
    return F.when(value.isNotNull(), binary_of(F.transform(_upto(groups), lambda i: of(i) + F.when(i < groups - 1, 128).otherwise(0))))


def dictionary_values(codes: Column, dictionary: Column) -> Column:
    """The dictionary's entries at the codes (from 0); a code beyond it raises an error."""
    beyond = F.raise_error(F.lit("a code is beyond the dictionary"))
    return F.transform(codes, lambda c: F.when((c >= F.size(dictionary)) | (c < 0), beyond).otherwise(F.get(dictionary, c.cast("int"))))


def spread(levels: Column, most: int | Column, present: Column) -> Column:
    """One slot for each definition level: the next of the ``present`` values where it equals ``most``, else null.

    The places of defined slots, then those of the others, stand beside the
    values, which end with the former; sorting by place puts them in order. So
    nothing is counted again for each slot. Values must be of a type that sorts.
    """
    most = _count(most)
    places = lambda full: F.filter(F.transform(levels, lambda d, i: F.when((d == most) == full, i)), lambda i: i.isNotNull())
    short = F.raise_error(F.lit("fewer values than defined levels"))

    def slots(at: Column) -> Column:
        beside = F.zip_with(F.concat(at, places(False)), F.slice(present, F.lit(1), F.size(at)), lambda i, v: F.struct(i.alias("i"), v.alias("v")))
        return F.when(F.size(present) < F.size(at), short).otherwise(F.transform(F.array_sort(beside), lambda x: x["v"]))

    return F.when(levels.isNotNull() & present.isNotNull(), _let(places(True), slots))


def zip_exact(left: Column, right: Column, names: tuple[str, str] = ("left", "right")) -> Column:
    """Both arrays side by side as structs; unequal sizes raise an error."""
    pairs = F.zip_with(left, right, lambda a, b: F.struct(a.alias(names[0]), b.alias(names[1])))
    return F.when(F.size(left) != F.size(right), F.raise_error(F.lit("arrays of unequal sizes"))).otherwise(pairs)


def levels_or_zeros(levels: Column, n: int | Column) -> Column:
    """``levels``, or ``n`` zeros where there are none."""
    return F.when(F.size(levels) == 0, F.array_repeat(F.lit(0), _count(n))).otherwise(levels)


def hybrid_values(data: bytes, width: int, n: int) -> np.ndarray:
    """``n`` values from runs: a varint header whose lowest bit tells packed groups (1) from a repeated value (0)."""
    out, have, at = [], 0, 0
    size = -(-width // 8)
    while have < n:
        header = shift = 0
        while True:
            if at >= len(data):
                raise ValueError(f"{n} values asked for, {have} there")
            byte = data[at]
            at += 1
            header |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                break
        if header & 1:
            count = (header >> 1) * 8
            packed = np.frombuffer(data, np.uint8, min((header >> 1) * width, len(data) - at), at)
            at += len(packed)
            bits = np.unpackbits(packed, bitorder="little")
            if width:
                whole = len(bits) // width
                part = bits[: whole * width].reshape(whole, width).astype(np.int64) @ (np.int64(1) << np.arange(width, dtype=np.int64))
            else:
                part = np.zeros(count, np.int64)
        else:
            if at + size > len(data):
                raise ValueError("a repeated value is cut off")
            part = np.full(min(header >> 1, n - have), int.from_bytes(data[at : at + size], "little"), np.int64)
            at += size
            if not header >> 1:
                raise ValueError("a run of no values")
        if not len(part):
            raise ValueError(f"{n} values asked for, {have} there")
        out.append(part[: n - have])
        have += len(out[-1])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _hybrid_bytes(values: np.ndarray, width: int) -> bytes:
    """Runs of 8 and more equal values as repeated ones, all else in packed groups."""
    out = bytearray()

    def head(x: int) -> None:
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        out.append(x)

    def packed(part: np.ndarray) -> None:
        if len(part):
            groups = -(-len(part) // 8)
            head(groups << 1 | 1)
            bits = np.zeros((groups * 8, width), np.uint8)
            bits[: len(part)] = (part[:, None] >> np.arange(width)) & 1
            out.extend(np.packbits(bits.reshape(-1), bitorder="little").tobytes())

    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(values))
    done = 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        lead = -(a - done) % 8  # what the packed group before the run still takes
        if b - a - lead >= 8:
            packed(values[done : a + lead])
            head((b - a - lead) << 1)
            out.extend(int(values[a]).to_bytes(-(-width // 8), "little"))
            done = b
    packed(values[done:])
    return bytes(out)


def level_block(data: Column, most: int, n: Column) -> Column:
    """The block of ``n`` levels up to ``most`` at the start of a page: the four bytes of its length, then a hybrid of runs. Levels that can only be 0 have no block."""
    width = most.bit_length()
    if not width:
        return _cut(data, F.lit(0), "values", F.array_repeat(F.lit(0).cast("bigint"), n.cast("int")))

    def read(size: Column) -> Column:
        taken = (size + 4).cast("int")
        return _cut(data, taken, "values", hybrid_decode(F.substring(data, F.lit(5), size.cast("int")), width, n))

    return read(uint_le(data, 4)["value"])


def level_block_of(levels: Column, most: int) -> Column:
    """The inverse of ``level_block``."""
    width = most.bit_length()
    if not width:
        return F.when(levels.isNotNull(), F.lit(b""))
    runs = hybrid_encode(levels, width)
    size = F.unhex(F.lpad(F.hex(F.octet_length(runs)), 8, "0"))
    head = F.concat(*(F.substring(size, k, 1) for k in (4, 3, 2, 1)))
    return F.concat(head, runs)


def hybrid_decode(data: Column, width: int, n: Column) -> Column:
    """``n`` values of a run-length and bit-packed hybrid of any number of runs. Runs end where their bytes say, so this is an Arrow UDF."""

    @F.pandas_udf("array<bigint>")
    def decode(data: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if d is None or pd.isna(k) else hybrid_values(bytes(d), width, int(k)) for d, k in zip(data, n)], dtype=object)

    return decode(data, n)


def hybrid_encode(values: Column, width: int) -> Column:
    """The inverse of ``hybrid_decode``."""

    @F.pandas_udf("binary")
    def encode(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else _hybrid_bytes(np.asarray(v, np.int64), width) for v in values], dtype=object)

    return encode(values)
