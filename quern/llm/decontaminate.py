"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle set, in powers of two.
An item of n shingles is probed by its k least MinHash values, with
k = n - ceil(share * n) + 1: a document that holds the asked share of the
item's shingles must hold one of any k of them, so no hit is missed, however long
the document (a MinHash signature of the whole long document could not see so
small an overlap). A document is searched only for the partitions that it is
large enough to contain. Candidates are verified by exact shingle containment.

Items are broadcast in blocks of at most BLOCK bytes of text; a larger benchmark
takes more blocks, one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import blocks, chains, chosen, mix, raw, table, words

SIZE, PERCENT = 5, 80
#: Bytes of benchmark text broadcast at once.
BLOCK = 8 << 20
#: Text bytes worked on at once.
LIMIT = 1 << 20


def _grams(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed ``size``-grams of each text in order, and each text's first and the end."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    owner = np.repeat(np.arange(len(count)), count)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][owner]
    return chains(hashes, start, size), np.append(0, np.cumsum(count))


class Items:
    """A block of test items with the probes of each size partition."""

    def __init__(self, ids: list, texts: pa.Array, size: int, percent: int):
        _, _, hashes, first = words(*raw(texts), lower=True, marks=True)
        self.ids, self.sets, self.percent = ids, [], percent
        probes: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i in range(len(ids)):
            gram = min(size, int(first[i + 1] - first[i]))  # a shorter item is one shingle of its own size
            own = np.unique(_grams(hashes[first[i] : first[i + 1]], np.array([0, first[i + 1] - first[i]]), gram)[0]) if gram else np.zeros(0, np.uint64)
            self.sets.append(own)
            if gram:
                least = np.sort(mix(own))[: len(own) - self.needed(len(own)) + 1]
                probes.setdefault((gram, len(own).bit_length()), []).extend((int(p), i) for p in least)
        #: (gram, least set size a document needs, sorted probes, their items)
        self.partitions = []
        for (gram, power), some in sorted(probes.items()):
            some.sort()
            # Without the type, numbers on both sides of 2**63 would become floats and lose bits.
            value, item = np.array([p for p, _ in some], np.uint64), np.array([i for _, i in some], np.int64)
            self.partitions.append((gram, self.needed(1 << (power - 1)), value, item))

    def needed(self, n: int) -> int:
        return -(-self.percent * n // 100)

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, shared, size) of every item that a text contains."""
        out, made = [], {}
        for gram, least, probes, item in self.partitions:
            if gram not in made:
                value, start = _grams(hashes, first, gram)
                made[gram] = value, start, np.repeat(np.arange(len(start) - 1), np.diff(start)), mix(value)
            value, start, owner, order = made[gram]
            fit = np.flatnonzero(np.isin(order, probes))
            fit = fit[np.diff(start)[owner[fit]] >= least]
            lo, hi = np.searchsorted(probes, order[fit], "left"), np.searchsorted(probes, order[fit], "right")
            found = {(int(owner[f]), int(i)) for f, a, b in zip(fit, lo, hi) for i in item[a:b]}
            for text, i in sorted(found):
                own = self.sets[i]
                shared = int(np.isin(own, value[start[text] : start[text + 1]]).sum())
                if shared >= self.needed(len(own)):
                    out.append((text, i, shared, len(own)))
        return out


def search(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with doc_id, text and hits: an array of (item_id, shared, size) of the test items each row's text contains.

    Needs doc_id and text; item_id (an integer) and text of ``benchmark``; other
    columns are ignored. Words are runs of letters and digits, A-Z as a-z. An
    item of fewer than ``size`` words is one shingle of its own words; items and
    texts that are null or without words match nothing. Rows and items that
    repeat are judged one by one; empty tables give no rows or no hits.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, text string, hits array<struct<item_id: bigint, shared: bigint, size: bigint>>"
    out = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.expr("cast(array() as array<struct<item_id: bigint, shared: bigint, size: bigint>>)").alias("hits"))
    for shared in item_blocks(benchmark, size, percent):
        out = out.mapInArrow(_searched(shared), schema)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, columns as they are, that contain no test item; see ``search``."""
    for shared in item_blocks(benchmark, size, percent):
        docs = chosen(docs, _free(shared), LIMIT)
    return docs


def item_blocks(benchmark: DataFrame, size: int, percent: int) -> Iterator:
    """Broadcast Items, each of about BLOCK bytes of text."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    amount = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    count = -(-int(amount) // BLOCK)
    for k in range(count):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(count)) == k).toArrow()
        yield benchmark.sparkSession.sparkContext.broadcast(Items(block.column("item_id").to_pylist(), block.column("text").combine_chunks(), size, percent))


def _free(shared):
    def judge(texts: pa.Array) -> np.ndarray:
        _, _, hashes, first = words(*raw(texts), lower=True, marks=True)
        free = np.ones(len(texts), bool)
        free[[hit[0] for hit in shared.value.hits(hashes, first)]] = False
        return free

    return judge


def _searched(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in blocks(batches, "text", LIMIT):
            _, _, hashes, first = words(*raw(batch.column(1)), lower=True, marks=True)
            found: dict[int, list] = {}
            for text, i, overlap, size in items.hits(hashes, first):
                found.setdefault(text, []).append({"item_id": items.ids[i], "shared": overlap, "size": size})
            hits = batch.column(2)
            if found:
                hits = pa.array([[*h, *found.get(k, ())] for k, h in enumerate(hits.to_pylist())], hits.type)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hits], ["doc_id", "text", "hits"])

    return run


def op6(spark, sf_dir: str) -> DataFrame:
    """The (doc_id, item_id) of every test item that a document contains, with the shingles shared and asked for."""
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", F.col("h.shared").alias("n_shared"), F.col("h.size").alias("n_item"))


SQL = r"""
with tests as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from benchmark
), docs as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents
), items as (
  select item_id, least(5, len(w)) as m,
         list_distinct(list_transform(generate_series(1, len(w) - least(5, len(w)) + 1), lambda i: array_to_string(w[i : i + least(5, len(w)) - 1], ' '))) as s
  from tests where len(w) > 0
), asked as (
  select item_id, m, len(s) as n, unnest(s) as g from items
), sets as (
  select doc_id, m, unnest(list_distinct(list_transform(generate_series(1, len(w) - m + 1), lambda i: array_to_string(w[i : i + m - 1], ' ')))) as g
  from docs, (select distinct m from items) where len(w) >= m
)
select doc_id, item_id, count(*) as n_shared, cast(n as bigint) as n_item
from asked join sets using (m, g)
group by doc_id, item_id, n
having 100 * count(*) >= 80 * n
"""
