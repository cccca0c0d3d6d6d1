"""Substring dedup on bytes with threshold-bounded interval expansion.

For a group of stretches that share an anchor (see anchors), the suffixes are
sorted, the Burrows-Wheeler transform is read off, and the lengths of common
prefixes are derived breadth first: backward extension of the intervals found at
one length gives all boundaries of the next, so values appear in increasing
order, and the search stops at the minimum length. Neighbours whose boundary has
not been reached by then share at least that many bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.anchors import Windows, named, packed, repeated, unpack
from quern.llm.common import blocks, lanes, table

LENGTH, ANCHOR = 400, 100
#: Steps to the end of an interval before it is looked up among all ends.
NEAR = 16


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight bytes from each on, and each text's first byte."""
    return lanes(data), offsets


def view(text: bytes):
    return lambda a, b: text[a:b]


def sorted_suffixes(code: np.ndarray) -> np.ndarray:
    """The suffix array of ``code``, whose last symbol is nowhere else, by prefix doubling on the suffixes that aren't told apart yet."""
    n = len(code)
    bits = int(code.max()).bit_length() + 1
    size = 62 // bits
    padded = np.append(code, np.zeros(size, np.int64))
    first = np.zeros(n, np.int64)
    for k in range(size):
        first = first << bits | padded[k : k + n]
    order = np.argsort(first)
    head = np.ones(n + 1, bool)  # where suffixes begin that differ from those before
    head[1:n] = np.diff(first[order]) != 0
    # rank: the place of the first suffix that is equal so far
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    starts = np.flatnonzero(head[:n])
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    while True:
        places = np.flatnonzero(~(head[:-1] & head[1:]))
        if not len(places):
            return order
        at = order[places]
        pair = rank[at] * (n + 1) + rank[np.minimum(at + size, n)] + 1
        turn = np.argsort(pair)
        at, pair = at[turn], pair[turn]
        order[places] = at
        new = np.flatnonzero(np.append(True, np.diff(pair) != 0))
        start = places[new]
        rank[at] = np.repeat(start, np.diff(np.append(new, len(at))))
        head[start] = True
        size *= 2


def _ends(found: np.ndarray, front: np.ndarray) -> np.ndarray:
    """The next place behind each of ``front`` that is found: most are near, so a few steps are tried first."""
    ends = front + 1
    rest = np.flatnonzero(~found[ends])
    for _ in range(NEAR):
        if not len(rest):
            return ends
        ends[rest] += 1
        rest = rest[~found[ends[rest]]]
    bounds = np.flatnonzero(found)
    ends[rest] = bounds[np.searchsorted(bounds, front[rest], side="right")]
    return ends


def bounded_boundaries(code: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in the suffix array, whether its suffix shares fewer than ``length`` symbols with the one before.

    ``found`` is set for the boundaries of common-prefix values 0, 1, 2, ... in
    turn. The boundary that opens an interval is extended backward by every
    symbol of the interval's transform: the first such symbol at or behind the
    boundary leads to a boundary of a value one larger, unless that has been
    found. Intervals of one value are disjoint, so no boundary is reached twice.
    """
    n = len(code)
    bwt = code[order - 1]  # the last symbol stands before the first
    by_symbol = np.argsort(bwt.astype(np.uint16) if code.max() < 1 << 16 else bwt, kind="stable")
    step = np.empty(n, np.int64)
    step[by_symbol] = np.arange(n)  # where the suffix one symbol longer stands
    before = np.full(n, -1, np.int64)  # the last place with the same symbol
    same = bwt[by_symbol][1:] == bwt[by_symbol][:-1]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    found = np.zeros(n + 1, bool)
    found[n] = True
    heads = code[order]
    front = np.flatnonzero(np.append(True, heads[1:] != heads[:-1]))
    found[front] = True
    for _ in range(1, length):
        if not len(front):
            break
        sizes = _ends(found, front) - front
        start = np.repeat(front, sizes)
        place = start + np.arange(len(start)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        reached = step[place[before[place] < start]]
        front = reached[~found[reached]]
        found[front] = True
    return found[:n]


def compare(least: np.ndarray, most: np.ndarray, copies: np.ndarray, texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, offset, 0) of the windows whose bytes also start elsewhere: in these stretches, or where their stretch has more places."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    code = np.zeros(int(sizes.sum()) + len(texts), np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    code[:] = len(texts)
    inside = np.ones(len(code), bool)
    inside[begin + sizes] = False
    code[inside] += np.frombuffer(b"".join(texts), np.uint8)
    code[begin + sizes] = np.arange(len(texts))  # an end of its own, before every byte
    order = sorted_suffixes(code)
    alone = bounded_boundaries(code, order, length)
    linked = ~alone
    hit = np.zeros(len(code), bool)
    hit[order] = linked | np.append(linked[1:], False)
    # Every window of a stretch with more places is a leaf of that many.
    hit |= (copies[owner] > 1) & (np.arange(len(code)) - begin[owner] <= sizes[owner] - length)
    at = np.flatnonzero(hit)
    return owner[at], at - begin[owner[at]], np.zeros(len(at), np.int64)


WINDOWS = Windows(LENGTH, ANCHOR, symbols, 8, view, smaller_id=False)


def dedup(docs: DataFrame) -> DataFrame:
    """Every row's bytes without those that repeated strings of LENGTH bytes cover.

    Needs columns doc_id (an integer) and text; others are ignored. Returns
    doc_id, n_bytes, n_removed, n_spans, spans (array of [start, stop) in bytes
    of the maximal removed runs), kept (binary; a cut may fall inside a
    character) and kept_sha256. A null text counts as empty. Rows with a null or
    a repeated doc_id are judged like any other; all copies of a string go, the
    first too; no rows give no rows.
    """
    docs = named(docs)
    runs = repeated(docs, WINDOWS, compare)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "z"):
            out: list[list] = [[] for _ in range(5)]
            for text, runs in zip(unpack(batch.column("z")), batch.column("runs").to_pylist()):
                spans: list[list[int]] = []
                for a, b in sorted((r["start"], r["stop"]) for r in runs or ()):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                cuts = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                for column, value in zip(out, (len(text), len(text) - len(kept), spans, kept, hashlib.sha256(kept).hexdigest())):
                    column.append(value)
            n, removed, spans, kept, digest = out
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary()), pa.array(digest, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<array<bigint>>, kept binary, kept_sha256 string"
    return packed(docs).join(runs, ["doc", "th"], "left").mapInArrow(finish, schema)


def op2(spark, sf_dir: str) -> DataFrame:
    """Contract query: counts and digests of every document's remaining bytes."""
    return dedup(table(spark, sf_dir, "documents")).drop("spans", "kept")
