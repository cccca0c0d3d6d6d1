"""Shared helpers: tables, Arrow text blocks, checkpoints and hashing in numpy."""

from __future__ import annotations

import contextlib
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes worked on at once; numpy needs some tens of bytes for each.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors see: the session's spark.checkpoint.dir.

    Where that is unset, one in the temporary folder of this machine is set,
    which only a session in one process (as in tests) can share; others raise.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quern-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What queries made and run in here have shuffled is deleted as each ends; else it stays until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that neither lineage nor lost executors bring it back."""
    shared_folder(df.sparkSession)
    with swept(df.sparkSession):
        return df.select("*").checkpoint(True)


def afresh(df: DataFrame) -> DataFrame:
    """``cut`` for frames that loops join again and again: a Parquet table in the shared folder.

    A checkpoint hands on the size that the optimiser has estimated for it. That
    of a join is the product of its sides', so in a loop it soon has millions of
    digits, and planning takes longer than the work. A table's size is that of
    its files, of which there are at most four for each core of the cluster.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    with swept(spark):
        df.coalesce(4 * spark.sparkContext.defaultParallelism).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes in ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        array = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.binary_length(array).fill_null(0)).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < len(sizes):
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def chosen(docs: DataFrame, judge: Callable[[pa.Array], np.ndarray], limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, columns as they are, for whose texts ``judge`` gives true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", limit):
            yield batch.filter(pa.array(judge(batch.column("text"))))

    return docs.mapInArrow(run, docs.schema)


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array (nulls as empty) and its offsets, len(array) + 1 of them, from 0."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if array.null_count:
        array = array.fill_null(b"" if "binary" in str(array.type) else "")
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


#: Numbers hashed at once: temporary arrays of more are given back to the system each time, which costs more than the work.
PART = 1 << 14


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise on uint64."""
    if x.size > PART:
        flat, out = x.reshape(-1), np.empty(x.size, np.uint64)
        for lo in range(0, len(flat), PART):
            out[lo : lo + PART] = mix(flat[lo : lo + PART])
        return out.reshape(x.shape)
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Keys of the hashes; two hashes with different keys are independent.
KEYS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Longer byte strings are hashed one by one.
LONG = 512
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on (and one behind the end) as numbers; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def strings(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, key: int = KEYS[0]) -> np.ndarray:
    """Keyed 64-bit hashes of the byte strings [start, stop), eight bytes at a time through ``mix``."""
    size = stops - starts
    out = mix(size.astype(np.uint64) ^ np.uint64(key))
    long = np.flatnonzero(size > LONG)
    aligned = np.zeros((len(data) >> 3) + 2, "<u8")
    aligned.view(np.uint8)[: len(data)] = data
    for lo in range(0, len(size), PART):
        rows = np.flatnonzero((size[lo : lo + PART] > 0) & (size[lo : lo + PART] <= LONG)) + lo
        at, left = starts[rows], size[rows]
        while len(rows):
            place, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
            # Shifted by 64 in two steps, as one of 64 isn't defined.
            lane = aligned[place] >> shift | aligned[place + 1] << np.uint64(1) << (np.uint64(63) - shift)
            short = np.flatnonzero(left < 8)
            lane[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
            out[rows] = mix(out[rows] * _STEP ^ lane)
            more = left > 8
            rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for k in long:
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : stops[k]].tobytes(), digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
    return out


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, in this order."""
    if a.size > PART and a.ndim == 1 and b.shape == a.shape:
        out = np.empty(len(a), np.uint64)
        for lo in range(0, len(a), PART):
            out[lo : lo + PART] = mix(a[lo : lo + PART] * _STEP + b[lo : lo + PART])
        return out
    return mix(a * _STEP + b)


def grams(hashes: np.ndarray, width: int, key: int = KEYS[1], have: int = 1) -> np.ndarray:
    """Hashes of every ``width`` consecutive symbols, from their own or those of ``have`` each, by doubling; the last two may overlap."""
    count = max(len(hashes) + have - width, 0)
    out, span = mix(hashes ^ np.uint64(key)), have
    while span * 2 <= width and count:
        out = paired(out[: len(out) - span], out[span:])
        span *= 2
    if span < width and count:
        out = paired(out[:count], out[width - span : width - span + count])
    return out[:count]


def chains(hashes: np.ndarray, starts: np.ndarray, size: int, key: int = KEYS[1]) -> np.ndarray:
    """Hashes of the ``size`` symbols from each start on, one after the other; for few of them."""
    out = np.full(len(starts), mix(np.array([size ^ key], np.uint64))[0])
    for k in range(size):
        out = paired(out, hashes[starts + k])
    return out


def sums(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, key: int) -> np.ndarray:
    """A hash of the set of values in each [start, stop), whatever their order."""
    total = np.append(np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(key)), dtype=np.uint64))
    return mix(total[stops] - total[starts] + (stops - starts).astype(np.uint64) * np.uint64(key))


#: White space of the word contracts: space and \t \n \v \f \r.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: The ASCII bytes that are no letter or digit.
_MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, hashes) of the words ``[^\\x20\\x09-\\x0D]+`` in concatenated texts, and each text's first word (len + 1 of them).

    ``lower``: A-Z count as a-z. ``marks``: words are runs of ASCII letters and digits and of all that isn't ASCII.
    """
    if lower:
        data = _LOWER[data]
    inside = ~(_MARKS if marks else _SPACE)[data]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    first = offsets[:-1][(offsets[:-1] < len(data))]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = offsets[1:-1]
    last = last[(last > 0) & (last <= len(data))] - 1
    after[last] = False
    stops = np.flatnonzero(inside & ~after) + 1
    return starts, stops, strings(data, starts, stops), np.searchsorted(starts, offsets)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    count = len(values) - width + 1
    return np.minimum(out[:count], out[width - span : width - span + count])


def ranked(code: np.ndarray, length: int) -> np.ndarray:
    """The rank, in the order of their first ``length`` symbols, of all suffixes of ``code``; equal for equal ones.

    By prefix doubling; suffixes are compared as if zeros followed.
    """
    rank = np.unique(code, return_inverse=True)[1].astype(np.int64) + 1
    size = 1
    while size < length:
        step = min(size, length - size)
        after = np.zeros_like(rank)
        after[: len(rank) - step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        size += step
    return rank
