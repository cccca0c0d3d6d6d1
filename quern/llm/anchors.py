"""Finding repeated windows without shuffling every suffix.

A window is LENGTH consecutive symbols (words or bytes). Its anchor is the
gram of GRAM symbols inside it with the least hash (the leftmost such). Equal
windows have equal anchors at equal offsets, and consecutive windows mostly
share theirs, so a text needs one row for about (LENGTH - GRAM) / 2 symbols:
the anchor's hash (``key``), the hash of the whole stretch that its windows
cover (``span``), where the stretch starts, how many windows it has and where
in it the anchor lies (``lead``).

Only anchors that recur go on. Each distinct stretch (key, span) has one leaf
with the least and the largest id that it stands under and how often it occurs.
The leaves of one anchor are a group, whose windows are compared on their texts;
a group of one leaf needs no comparison. A group of more than GROUP leaves is
split by a longer common part: the windows whose anchor is at an offset from lo
to hi have LENGTH - (hi - lo) symbols in common around it, so each half of the
offsets makes a group for each such part. Halves are split again while they are
too large; a common part of LENGTH symbols is one window, and so one leaf. What
is found for a leaf holds for all places of its stretch.

Hashes are keyed and not linear in the text, and stretches are told apart by 128
bits of them (key and span).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import KEYS, afresh, blocks, cut, mix, paired, raw, sliding_min

#: Window starts worked on at once; a longer text is taken in stretches of so many.
STRETCH = 1 << 15
#: Leaves of a group that are compared in memory; larger groups are split.
GROUP = 500
#: Bytes of stretches compared at once (and whole groups); so few stay in a core's cache.
COMPARED = 1 << 17
#: Stands for a null id, which takes no part in comparisons of ids.
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Windows:
    """What windows are made of: their length, their anchors' length, and the symbols of texts."""

    length: int
    gram: int
    #: (bytes, offsets) -> (a number for the ``have`` symbols from each on, each text's first symbol and the end)
    symbols: Callable
    have: int
    #: one text's bytes -> (first, end) -> the bytes of these symbols
    view: Callable
    #: Only windows of a smaller id count; else any other place of the same window.
    smaller_id: bool


def doubled(hashes: np.ndarray, have: int, width: int) -> tuple[np.ndarray, int]:
    """Hashes of as many symbols as a power of two gives within ``width``, from those of ``have`` each, and their number."""
    while have * 2 <= width:
        hashes = paired(hashes[:-have], hashes[have:])
        have *= 2
    return hashes, have


def rows(symbols: np.ndarray, first: np.ndarray, w: Windows) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, key, span, start, windows, lead) of every anchor, in arrays; start is in symbols of the text."""
    length, gram = w.length, w.gram
    owner = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    total, width = int(first[-1]) - length + 1, length - gram + 1
    for lo in range(0, max(total, 0), STRETCH):
        hi = min(lo + STRETCH, total)
        at = np.flatnonzero(owner[lo:hi] == owner[lo + length - 1 : hi + length - 1])
        if not len(at):
            continue
        short, few = doubled(mix(symbols[lo : hi + length - w.have] ^ np.uint64(KEYS[1])), w.have, gram)
        grams = paired(short[: hi - lo + width - 1], short[gram - few :][: hi - lo + width - 1])
        best = sliding_min(grams & np.uint64(0xFFFFFFFF00000000) | np.arange(len(grams), dtype=np.uint64), width)
        anchor = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)[at]
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        run = np.flatnonzero(new)
        starts, count = at[run], np.diff(np.append(run, len(at)))
        lead = anchor[run] - starts
        # The first and the last window cover the stretch.
        long, many = doubled(short, few, length)
        windows = (paired(long[x], long[x + length - many]) for x in (starts, starts + count - 1))
        span = paired(paired(*windows), (count << 20 | lead).astype(np.uint64))
        text = owner[lo + starts]
        yield text, grams[anchor[run]].view(np.int64), span.view(np.int64), lo + starts - first[text], count, lead


def named(docs: DataFrame) -> DataFrame:
    """doc_id as it was, its comparable form ``doc``, the text as bytes and its hash: (doc, th) names a row's content."""
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select("doc_id", doc.alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))


def packed(docs: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> DataFrame:
    """``named`` docs with compressed texts, which are shuffled at a third of their size; only the rows for which ``keep`` gives true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in blocks(batches, "text"):
            if keep is not None:
                batch = batch.filter(pa.array(keep(batch)))
            z = pa.array([press.compress(t) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), z], ["doc_id", "doc", "th", "z"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, doc bigint, th bigint, z binary")


def unpack(column: pa.Array) -> list[bytes]:
    press = zstandard.ZstdDecompressor()
    return [press.decompress(z) for z in column.to_pylist()]


def anchored(docs: DataFrame, w: Windows) -> DataFrame:
    """key, span, doc, th, at, n, lead of every anchor of ``named`` docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            doc, th = (np.asarray(batch.column(k)) for k in (1, 2))
            for text, key, span, start, count, lead in rows(*w.symbols(*raw(batch.column(3))), w):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(span), pa.array(doc[text]), pa.array(th[text]), pa.array(start.astype(np.int64)), pa.array(count.astype(np.int32)), pa.array(lead.astype(np.int32))],
                    ["key", "span", "doc", "th", "at", "n", "lead"],
                )

    return docs.mapInArrow(run, "key bigint, span bigint, doc bigint, th bigint, at bigint, n int, lead int")


def repeated(docs: DataFrame, w: Windows, compare: Callable) -> DataFrame:
    """doc, th, runs: for each row content of ``named`` docs, the [start, stop) of symbols that repeated windows cover.

    ``compare`` takes arrays of the least id, the largest id and the number of
    places of leaves, and their stretches as bytes. It gives (leaf, offset,
    least) of their windows that recur: those of rows with an id above that
    least are repeats. Rows that repeat as a whole are one content here.
    """
    source = docs.where(F.col("doc") != NO_ID) if w.smaller_id else docs
    anchors = afresh(anchored(source.drop("doc_id").select(F.lit(0).alias("unused"), "doc", "th", "text"), w))
    recurs = (F.min("doc") < F.max("doc")) if w.smaller_id else (F.count("*") > 1)
    keys = cut(anchors.groupBy("key").agg(recurs.alias("more")).where("more").select("key"))
    shared = cut(anchors.join(keys, "key", "left_semi"))
    stretches = shared.groupBy("key", "span").agg(F.min(F.struct("doc", "th", "at", "n", "lead")).alias("r"), F.max("doc").alias("most"), F.count("*").alias("copies"))
    stretches = cut(stretches.select("key", "span", "r.*", F.col("r.doc").alias("least"), "most", "copies"))
    members = cut(stretches.groupBy("key").agg(F.count("*").alias("members")))
    alive = stretches.join(members.where("members > 1"), "key")
    leaf = F.struct("key", "span", "at", "n", "lead", "least", "most", "copies", "members")
    alive = alive.select("doc", "th", leaf.alias("s")).groupBy("doc", "th").agg(F.collect_list("s").alias("s"))
    # Rows with the same id and text have the same leaves, once.
    joined = packed(docs).drop("doc_id").join(alive, ["doc", "th"]).dropDuplicates(["doc", "th"])
    leaves = cut(_leaves(joined, w))
    alone = stretches.join(members.where("members = 1"), "key").where(_recurs(w)).select("key", "span", F.lit(0).cast("bigint").alias("start"), (F.col("n") + (w.length - 1)).cast("bigint").alias("stop"), "least")
    hits = [alone, _compared(leaves.where(F.col("members") <= GROUP), w, compare)]
    large = leaves.where(F.col("members") > GROUP)
    if not large.isEmpty():
        hits.append(_split(large, w, compare))
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    found = shared.select("key", "span", "doc", "th", "at").join(cut(found), ["key", "span"])
    if w.smaller_id:
        found = found.where("doc > least")
    run = F.struct((F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("stop")).alias("stop"))
    # A set, as rows with the same id and text have the same runs.
    return found.select("doc", "th", run.alias("run")).groupBy("doc", "th").agg(F.collect_set("run").alias("runs"))


def _recurs(w: Windows):
    """Whether a leaf's whole stretch is a repeat for some of its places."""
    return F.col("least") < F.col("most") if w.smaller_id else F.col("copies") > 1


_LEAF = "key bigint, span bigint, n int, lead int, low int, high int, least bigint, most bigint, copies bigint, members bigint, stretch binary"


def _leaves(joined: DataFrame, w: Windows) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "span", "n", "lead", "low", "high", "least", "most", "copies", "members"]
        for batch in blocks(batches, "z", 1 << 19):
            out: list[list] = [[] for _ in range(len(names) + 1)]
            for text, some in zip(unpack(batch.column("z")), batch.column("s").to_pylist()):
                view = w.view(text)
                for s in some:
                    # Anchors are at every offset of a window to begin with.
                    for column, name in zip(out, names):
                        column.append({"low": 0, "high": w.length - w.gram}.get(name, s.get(name)))
                    out[-1].append(view(s["at"], s["at"] + s["n"] + w.length - 1))
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, *[pa.int64()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [*names, "stretch"])

    return joined.mapInArrow(run, _LEAF)


def _split(large: DataFrame, w: Windows, compare: Callable) -> DataFrame:
    """What ``_compared`` gives for the leaves of groups that are too large.

    Each half of a leaf's offsets is dealt to a group for the longer part that
    its windows have in common, as long as groups are too large. Equal parts of
    different leaves are one leaf there. Offsets halve each time, so this goes
    no deeper than their logarithm.
    """
    pieces = afresh(large.mapInArrow(_pieces(w), "shift int, whole bigint, of bigint, key bigint, span bigint, n int, lead int, low int, high int, least bigint, most bigint, copies bigint, stretch binary"))
    same = [F.first(c).alias(c) for c in ("n", "lead", "low", "high", "stretch")]
    leaves = cut(pieces.groupBy("key", "span").agg(*same, F.min("least").alias("least"), F.max("most").alias("most"), F.sum("copies").alias("copies")))
    members = cut(leaves.groupBy("key").agg(F.count("*").alias("members")))
    leaves = leaves.join(members, "key")
    found = leaves.where("members = 1").where(_recurs(w)).select("key", "span", F.lit(0).cast("bigint").alias("start"), (F.col("n") + (w.length - 1)).cast("bigint").alias("stop"), "least")
    several = cut(leaves.where("members > 1").select(*(c.split()[0] for c in _LEAF.split(", "))))
    found = found.unionByName(_compared(several.where(F.col("members") <= GROUP), w, compare))
    rest = several.where(F.col("members") > GROUP)
    if not rest.isEmpty():
        found = found.unionByName(_split(rest, w, compare))
    found = pieces.select("key", "span", "whole", "of", "shift").join(cut(found), ["key", "span"])
    return found.select(F.col("whole").alias("key"), F.col("of").alias("span"), (F.col("start") + F.col("shift")).alias("start"), (F.col("stop") + F.col("shift")).alias("stop"), "least")


def _pieces(w: Windows) -> Callable:
    """Leaves to their parts for each half of their offsets: key and span of the part, those of the leaf, and where the part starts in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "stretch", 1 << 19):
            out: list[list] = [[] for _ in range(13)]
            for s in batch.to_pylist():
                view, middle = w.view(s["stretch"]), (s["low"] + s["high"]) // 2
                for low, high in ((s["low"], middle), (middle + 1, s["high"])):
                    # The window at w has its anchor at lead - w.
                    a, b = max(0, s["lead"] - high), min(s["n"], s["lead"] - low + 1)
                    if a >= b:
                        continue
                    core = view(s["lead"] - low, s["lead"] - high + w.length)
                    part = view(a, b + w.length - 1)
                    lead = s["lead"] - a
                    key, span = (int.from_bytes(hashlib.blake2b(x, digest_size=8, salt=f"{low},{high}".encode()).digest(), "little", signed=True) for x in (core, part + f" {lead}".encode()))
                    for column, value in zip(out, (a, s["key"], s["span"], key, span, b - a, lead, low, high, s["least"], s["most"], s["copies"], part)):
                        column.append(value)
            kinds = [pa.int32(), *[pa.int64()] * 4, *[pa.int32()] * 4, *[pa.int64()] * 3, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["shift", "whole", "of", "key", "span", "n", "lead", "low", "high", "least", "most", "copies", "stretch"])

    return run


def _compared(leaves: DataFrame, w: Windows, compare: Callable) -> DataFrame:
    """key, span, start, stop, least: the runs of recurring windows of ``leaves``, counted from their stretch's start; groups are whole in a task."""

    def judged(table: pa.Table) -> pa.RecordBatch:
        least, most, copies = (np.asarray(table.column(c)) for c in ("least", "most", "copies"))
        owner, offset, least = compare(least, most, copies, table.column("stretch").to_pylist())
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1) | (least[1:] != least[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(owner)) - 1 if len(owner) else first
        of = [pa.array(np.asarray(table.column(c))[owner[first]]) for c in ("key", "span")]
        return pa.RecordBatch.from_arrays([*of, pa.array(offset[first]), pa.array(offset[last] + w.length), pa.array(least[first])], ["key", "span", "start", "stop", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in blocks(batches, "stretch", COMPARED):
            part = pa.Table.from_batches([batch])
            part = pa.concat_tables([kept, part]) if kept is not None else part
            key = np.asarray(part.column("key"))
            whole = int(np.searchsorted(key, key[-1]))  # the last key may go on
            kept = part.slice(whole)
            if whole:
                yield judged(part.slice(0, whole))
        if kept is not None and kept.num_rows:
            yield judged(kept)

    sorted_groups = leaves.repartition("key").sortWithinPartitions("key")
    return sorted_groups.mapInArrow(run, "key bigint, span bigint, start bigint, stop bigint, least bigint")
