"""Substring dedup on words with prefix-partitioned suffix trees.

Suffixes are split by prefixes of variable length into groups that fit in
memory: first by the 20 words of their windows' anchor, then, where a group is
still too large, by 35, 43 and more words around it up to the whole window of 50
(see anchors). The suffix tree of a group is built as its sorted leaves and the
depths at which neighbours part; an internal node is a run of leaves between
shallower depths. The nodes at least LENGTH deep that have no such node above
them are the maximal repeats' highest places. A node carries the least doc_id of
its leaves, and every leaf's windows below it are repeats for larger ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.anchors import Windows, named, packed, repeated, unpack
from quern.llm.common import blocks, table, words

LENGTH, ANCHOR = 50, 20
#: Bytes of text hashed into words at once, cut at white space.
SLICE = 1 << 22


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts, and each text's first word."""
    if len(data) <= SLICE:
        return words(data, offsets)[2:]
    if len(offsets) > 2:
        parts = [symbols(data[a:b], np.array([0, b - a])) for a, b in zip(offsets, offsets[1:])]
        return np.concatenate([p[0] for p in parts]), np.cumsum([0, *(len(p[0]) for p in parts)])
    out, lo = [], 0
    while lo < len(data):
        hi = lo + SLICE
        while hi < len(data) and data[hi] not in (32, 9, 10, 11, 12, 13):
            hi += 1
        out.append(words(data[lo:hi], np.array([0, len(data[lo:hi])]))[2])
        lo = hi
    hashes = np.concatenate(out)
    return hashes, np.array([0, len(hashes)])


def view(text: bytes):
    """A view that gives the words from one to another, joined by one space."""
    found = text.split()
    return lambda a, b: b" ".join(found[a:b])


def tree(code: np.ndarray, leaves: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix tree, down to ``depth``, of the suffixes of ``code`` at ``leaves``: the leaves in order, and the depth at which each parts from the one before.

    Suffixes are ranked by prefixes of 1, 2, 4, ... symbols; two neighbours part
    behind the prefixes of these sizes, the largest first, that they share.
    Depths beyond ``depth`` are given as that or more.
    """
    rank = np.unique(code, return_inverse=True)[1].astype(np.int64) + 1
    size, ranks = 1, [rank]
    while size < depth:
        after = np.zeros_like(rank)
        after[: len(rank) - size] = rank[size:]
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        ranks.append(rank)
        size *= 2
    order = np.argsort(rank[leaves], kind="stable")
    a, b = leaves[order][1:], leaves[order][:-1]
    parts = np.zeros(len(leaves), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + parts[1:], b + parts[1:]
        inside = (x < len(code)) & (y < len(code))
        same = ranks[k][np.where(inside, x, 0)] == ranks[k][np.where(inside, y, 0)]
        parts[1:] += np.where(inside & same, 1 << k, 0)
    return order, parts


def deep_nodes(parts: np.ndarray, length: int) -> np.ndarray:
    """Where, among sorted leaves, the highest nodes at least ``length`` deep begin; a leaf alone is one."""
    return np.flatnonzero(parts < length)


def compare(least: np.ndarray, most: np.ndarray, copies: np.ndarray, texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, offset, least id of the node) of the windows below a deep node that has a smaller id than some place of their stretch."""
    ids: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    code = [ids.setdefault(x, len(ids)) for s in split for x in [*s, None]]
    code = np.array(code, np.int64)
    sizes = np.array([len(s) for s in split], np.int64)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    code[begin + sizes] = len(ids) + np.arange(len(texts))  # an end of its own
    count = sizes - length + 1
    owner = np.repeat(np.arange(len(texts)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    if not len(owner):
        return owner, offset, offset
    order, parts = tree(code, begin[owner] + offset, length)
    nodes = deep_nodes(parts, length)
    lowest = np.minimum.reduceat(least[owner[order]], nodes)
    carried = np.empty(len(owner), np.int64)
    carried[order] = np.repeat(lowest, np.diff(np.append(nodes, len(order))))
    hit = carried < most[owner]
    return owner[hit], offset[hit], carried[hit]


WINDOWS = Windows(LENGTH, ANCHOR, symbols, 1, view, smaller_id=True)


def dedup(docs: DataFrame) -> DataFrame:
    """Every row's text without the words that windows of a smaller doc_id's document cover.

    Needs columns doc_id (an integer) and text; others are ignored. Returns
    doc_id, n_words, n_removed, kept (the kept words joined by one space) and
    kept_sha256. A null text has no words. A row with a null doc_id is kept whole
    and repeats nothing, as no id is smaller or larger. Rows of the same doc_id
    don't remove from each other, as neither id is smaller; no rows give no rows.
    """
    docs = named(docs)
    runs = repeated(docs, WINDOWS, compare)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "z"):
            total, removed, kept = [], [], []
            for text, runs in zip(unpack(batch.column("z")), batch.column("runs").to_pylist()):
                found = text.split()
                keep = np.ones(len(found), bool)
                for r in runs or ():
                    keep[r["start"] : r["stop"]] = False
                total.append(len(found))
                removed.append(len(found) - int(keep.sum()))
                kept.append(b" ".join(compress(found, keep.tolist()) if removed[-1] else found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return packed(docs).join(runs, ["doc", "th"], "left").mapInArrow(finish, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string, kept_sha256 string")


def op1(spark, sf_dir: str) -> DataFrame:
    """Contract query: counts and digests of every document's kept words."""
    return dedup(table(spark, sf_dir, "documents")).drop("kept")


SQL = r"""
with split as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), windows as (
  select doc_id, i, array_to_string(w[i : i + 49], ' ') as s
  from (select doc_id, w, unnest(generate_series(1, len(w) - 49)) as i from split where len(w) >= 50)
), found as (
  select a.doc_id, list(a.i) as starts
  from windows a join (select s, min(doc_id) as least from windows group by s) b on a.s = b.s and a.doc_id > b.least
  group by a.doc_id
), gone as (
  select distinct doc_id, p from (
    select doc_id, unnest(generate_series(i, i + 49)) as p from (select doc_id, unnest(starts) as i from found))
), kept as (
  select t.doc_id, count(*) filter (where g.p is not null) as n_removed,
         coalesce(string_agg(t.x, ' ' order by t.p) filter (where g.p is null), '') as k
  from (select doc_id, unnest(w) as x, unnest(generate_series(1, len(w))) as p from split) t
  left join gone g on g.doc_id = t.doc_id and g.p = t.p
  group by t.doc_id
)
select s.doc_id, cast(len(s.w) as bigint) as n_words, cast(coalesce(k.n_removed, 0) as bigint) as n_removed,
       sha256(coalesce(k.k, '')) as kept_sha256
from split s left join kept k on k.doc_id = s.doc_id
"""
