"""Document fingerprints by improbable-feature digests.

Every window of WINDOW bytes has an entropy; how rare each entropy level is over
all documents gives its rank, the rarest first. A window that is the first of
least rank among the NEIGHBOURS windows around it often enough is a feature.
Features go in order into a chain of Bloom filters of FILTER_BITS bits, at most
FEATURES each. Two digests compare by the overlap of their filters' bits beyond
what chance gives, normalised by the most possible: every filter of the shorter
chain with its best partner.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import KEYS, blocks, mix, raw, sliding_min, strings, table

WINDOW = 64
LEVELS = 1000
#: Windows among which the least rank is sought, and how often a feature must be it.
NEIGHBOURS, POPULAR = 64, 16
FILTER_BITS, HASHES, FEATURES = 2048, 5, 160
#: Levels of almost uniform windows, which say nothing.
WEAK = 100
#: Text bytes worked on at once.
LIMIT = 1 << 18
#: Longer texts are taken in stretches that overlap, so that memory stays bounded.
STRETCH = 1 << 20

#: c * log2(c) in fixed point, so that equal windows have exactly equal entropies.
_CLOGC = np.round(np.array([c * np.log2(c) if c else 0.0 for c in range(WINDOW + 1)]) * (1 << 20)).astype(np.int64)
_MOST = int(_CLOGC[WINDOW])


def levels(data: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The entropy level, 0 to LEVELS, of the window at every place; -1 where it crosses a text's end."""
    size = len(data) - WINDOW + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    ahead = np.ones(len(data), np.uint8)  # how often a byte is among itself and the 63 behind it
    back = np.zeros(len(data), np.uint8)  # how often it is among the 63 before it
    for k in range(1, WINDOW):
        same = (data[k:] == data[:-k]).view(np.uint8)
        ahead[:-k] += same
        back[k:] += same
    first = int(_CLOGC[np.bincount(data[:WINDOW], minlength=256)].sum())
    step = np.empty(size, np.int64)
    step[0] = first
    leaves = ahead[: size - 1].astype(np.int64)  # its count in the window that it leaves
    enters = back[WINDOW : WINDOW + size - 1].astype(np.int64)
    step[1:] = _CLOGC[leaves - 1] - _CLOGC[leaves] + _CLOGC[enters + 1] - _CLOGC[enters]
    level = (_MOST - np.cumsum(step)) * LEVELS // _MOST
    level[owner[:size] != owner[WINDOW - 1 :]] = -1
    return level


def features(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the features of concatenated texts, in order; a text without any but with bytes is itself its one feature."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    level = levels(data, owner)
    chosen = np.zeros(0, np.int64)
    if len(level):
        valid = level >= 0
        place = np.arange(len(level))
        packed = (np.where(valid, rank[np.maximum(level, 0)], LEVELS + 2) << 32) | place
        width = min(NEIGHBOURS, len(level))
        least = sliding_min(packed, width) & 0xFFFFFFFF
        count = len(least)
        inside = valid[:count] & valid[width - 1 : width - 1 + count] & (owner[:count] == owner[width - 1 : width - 1 + count])
        popular = np.bincount(least[inside], minlength=len(level))
        chosen = np.flatnonzero((popular >= POPULAR) & valid & (level >= WEAK))
    hashes = strings(data, chosen, chosen + WINDOW)
    text = owner[chosen]
    bare = np.flatnonzero((np.bincount(text, minlength=len(offsets) - 1) == 0) & (np.diff(offsets) > 0))
    text = np.concatenate([text, bare])
    hashes = np.concatenate([hashes, strings(data, offsets[bare], offsets[bare + 1])])
    order = np.argsort(text, kind="stable")
    return text[order], hashes[order]


def digests(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Each text's chain of filters, as (filters x FILTER_BITS / 8) bytes; none for an empty text."""
    out: list = [None] * len(texts)
    group: list[int] = []
    total = 0
    for k in range(len(texts) + 1):
        if k == len(texts) or total + len(texts[k]) > LIMIT and group:
            joined = b"".join(texts[g] for g in group)
            offsets = np.cumsum([0, *(len(texts[g]) for g in group)])
            if len(group) == 1 and len(joined) > STRETCH:
                text, hashes = _long(np.frombuffer(joined, np.uint8), rank)
            else:
                text, hashes = features(np.frombuffer(joined, np.uint8), offsets, rank)
            bounds = np.searchsorted(text, np.arange(len(group) + 1))
            for g, a, b in zip(group, bounds, bounds[1:]):
                out[g] = chained(hashes[a:b])
            group, total = [], 0
        if k < len(texts):
            group.append(k)
            total += len(texts[k])
    return out


def _long(data: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``features`` of one long text by stretches; those near a seam are found by the stretch that has them whole."""
    pad, hashes = 4 * (WINDOW + NEIGHBOURS), []
    for lo in range(0, len(data), STRETCH):
        a, b = max(0, lo - pad), min(len(data), lo + STRETCH + pad)
        part = data[a:b]
        at, found = _placed(part, rank)
        own = (at + a >= lo) & (at + a < lo + STRETCH)
        hashes.append(found[own])
    out = np.concatenate(hashes)
    if not len(out):
        out = strings(data, np.array([0]), np.array([len(data)]))
    return np.zeros(len(out), np.int64), out


def _placed(part: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    level = levels(part, np.zeros(len(part), np.int64))
    if len(level) < NEIGHBOURS:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = sliding_min((rank[level] << 32) | np.arange(len(level)), NEIGHBOURS) & 0xFFFFFFFF
    chosen = np.flatnonzero((np.bincount(least, minlength=len(level)) >= POPULAR) & (level >= WEAK))
    return chosen, strings(part, chosen, chosen + WINDOW)


def chained(hashes: np.ndarray) -> np.ndarray:
    """The features in a chain of Bloom filters."""
    count = -(-len(hashes) // FEATURES)
    bits = np.zeros((count, FILTER_BITS), np.uint8)
    link = np.arange(len(hashes)) // FEATURES
    for k in range(HASHES):
        at = mix(hashes + np.uint64((k + 1) * KEYS[1] & 0xFFFFFFFFFFFFFFFF)) % np.uint64(FILTER_BITS)
        bits[link, at.astype(np.int64)] = 1
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; two empty digests are alike, an empty and another not at all."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    if a.shape == b.shape and (a == b).all():
        return 1.0
    ones_b = np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    total = 0.0
    for row in a:  # one filter of the shorter chain at a time
        ones = int(np.bitwise_count(row).sum())
        both = np.bitwise_count(row & b).sum(axis=1, dtype=np.int64)
        most = np.minimum(ones, ones_b)
        chance = ones * ones_b / FILTER_BITS
        share = (both - chance) / np.maximum(most - chance, 1e-9)
        total += float(np.clip(share, 0, 1).max())
    return total / len(a)


def written(digest: np.ndarray) -> str:
    return base64.b64encode(digest.tobytes()).decode()


def ranks(docs: DataFrame) -> np.ndarray:
    """The rank of every entropy level: the fewer windows of all ``docs`` (text) have it, the lower; ties by level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for batch in blocks(batches, "text", LIMIT):
            data, offsets = raw(batch.column(0))
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            for lo in range(0, max(1, len(data)), STRETCH):
                found = levels(data[lo : lo + STRETCH + WINDOW - 1], owner[lo : lo + STRETCH + WINDOW - 1])
                total += np.bincount(found[found >= 0], minlength=LEVELS + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["level", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "level bigint, n bigint").groupBy("level").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(LEVELS + 1, np.int64)
    counts[np.asarray(found.column("level"))] = np.asarray(found.column("n"))
    out = np.empty(LEVELS + 1, np.int64)
    out[np.lexsort((np.arange(LEVELS + 1), counts))] = np.arange(LEVELS + 1)
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last half, rounded down, replaced by as many first characters of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """part, turn, doc_id, text: docs by descending id within ranges of ids, each range followed by the row that comes next.

    A range's next row is the head of the range below it; the last range's is
    the first head. Only the ranges' heads (one row of ids each) reach the
    driver. Ties of doc_id go by the text's hash and the text; null ids come
    last.
    """
    spark = docs.sparkSession
    parts = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))) * 4
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("place", F.struct(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("th")))
    bounds = keyed.select(F.percentile_approx("place.id", [k / parts for k in range(1, parts)], 10 * parts).alias("b")).head()["b"] or []
    bounds = sorted(set(bounds))
    part = F.lit(0)
    if bounds:
        part = F.expr(f"aggregate(array({','.join(f'{b}L' if b > -(1 << 63) else '-9223372036854775808' for b in bounds)}), 0, (n, b) -> n + if(place.id > b, 1, 0))") if len(bounds) < 8 else _part(bounds)
    placed = keyed.withColumn("part", part)
    heads = {r["part"]: (r["h"]["id"], r["h"]["th"]) for r in placed.groupBy("part").agg(F.max("place").alias("h")).collect()}
    order = sorted(heads)
    # A head goes to its own range and, as the last row, to the range above.
    above = {low: order[(k + 1) % len(order)] for k, low in enumerate(order)}
    frame = spark.createDataFrame([(p, *heads[p], above[p]) for p in order], "part int, id bigint, th bigint, above int")
    extra = F.broadcast(frame.select("part", F.struct("id", "th").alias("head"), "above"))
    tagged = placed.join(extra, "part").withColumn("to", F.when(F.col("place") == F.col("head"), F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("turn")), F.struct(F.col("above").alias("part"), F.lit(1).alias("turn")))).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("turn")))))
    return tagged.select(F.explode("to").alias("to"), "doc_id", "place", "text").select("to.part", "to.turn", "doc_id", "place", "text")


def _part(bounds: list[int]):
    """How many of the sorted bounds are below the id, by a binary tree of comparisons."""
    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("place.id") > bounds[mid], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))


def compare_edited(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Every row's fingerprint, that of its edited text, and their likeness.

    Needs doc_id (an integer) and text; others are ignored. The next row is the
    one that follows by descending doc_id, after the last the first; see
    ``with_next`` for ties and nulls. A null text counts as empty; an empty
    text's fingerprint is the empty string; a text too short for a feature is
    one feature; a lone row is its own next; no rows give no rows. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(ranks(docs))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        """All but the last of consecutive rows (part, turn, doc_id, text), ends of ranges apart."""
        rank = shared.value
        texts = [r[3] for r in rows]
        own = digests([t.encode() for t in texts], rank)
        at = [k for k in range(len(rows) - 1) if not rows[k][1]]
        changed = [edited(texts[k], texts[k + 1]).encode() for k in at]
        other = digests(changed, rank)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[k][2] for k in at], doc_type[0]),
                pa.array([len(texts[k]) for k in at], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
                pa.array([written(own[k]) for k in at], pa.string()),
                pa.array([written(o) for o in other], pa.string()),
                pa.array([likeness(own[k], o) for k, o in zip(at, other)], pa.float64()),
                pa.array([likeness(own[k], own[k + 1]) for k in at], pa.float64()),
            ],
            names,
        )

    doc_type: list = [None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row, until the next is known
        for batch in blocks(batches, "text", LIMIT):
            doc_type[0] = batch.column(2).type
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist()))
            # Of several equal heads that close a range, the first is enough.
            rows = [r for p, r in zip([held, *rows], rows) if not (r[1] and p and p[1] and p[0] == r[0])]
            rows = [held, *rows] if held else rows
            if rows:
                yield judged(rows)
                held = rows[-1]

    placed = with_next(docs, parts)
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartition(max(8, count), "part").sortWithinPartitions("part", "turn", F.desc("place"), "text")
    return ordered.mapInArrow(run, schema)


def op7(spark, sf_dir: str) -> DataFrame:
    """Contract query: fingerprints of every document and of its edited text."""
    return compare_edited(table(spark, sf_dir, "documents"))
