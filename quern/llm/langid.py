"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams are gathered over all labelled training rows: each
task counts into dense arrays, Spark adds up their non-zero cells. The
log-probability matrix has a fixed number of buckets, so its broadcast is
bounded by BUCKETS x languages. Scoring gathers matrix rows for the n-grams of a
block of texts and adds them up per text in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import blocks, table

ORDERS = (1, 2, 3)
#: Zeros before each text: one less than the longest n-gram.
PADS = max(ORDERS) - 1
BITS = 15
BUCKETS = 1 << BITS
#: Added to every count.
SMOOTHING = 0.5
#: Text bytes worked on at once; each character needs a few dozen bytes.
LIMIT = 1 << 19
#: Category L; numerals such as Ⅷ and ½ are none.
LETTER = regex.compile(r"\p{L}")
#: Languages that may be learned: the matrix that is broadcast has 2**15 numbers for each.
LANGUAGES = 200


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def ngrams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order, the buckets of the n-grams at every position of the lower-cased texts; each text's start and size.

    Every text stands behind PADS zeros, so an n-gram that crosses its start or
    end sees zeros only.
    """
    gap = bytes(4 * PADS)
    coded = gap.join([b"", *(t.lower().encode("utf-32-le", "replace") for t in texts), b""])
    sizes = np.array([len(t.lower()) for t in texts], np.int64) + PADS
    chars = np.frombuffer(coded, np.uint32)
    size = len(chars) - PADS
    out, code = [], np.zeros(size, np.uint32)
    for n in ORDERS:
        code = code * np.uint32(0x01000193) + chars[n - 1 : n - 1 + size]
        out.append(((code + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    return out, np.cumsum(sizes) - sizes, sizes


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability matrix with the prior as its last row) from rows with text and a non-null lang."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        totals: list[np.ndarray] = []
        for batch in blocks(batches, "text", LIMIT):
            langs = batch.column("lang").to_pylist()
            for lang in langs:
                if lang not in names:
                    names[lang] = len(names)
                    totals.append(np.zeros(BUCKETS + 1, np.int64))
            of = np.array([names[lang] for lang in langs], np.int64)
            grams, _, sizes = ngrams([t or "" for t in batch.column("text").to_pylist()])
            row = np.repeat(of * BUCKETS, sizes)
            found = sum(np.bincount(row + g, minlength=len(names) * BUCKETS) for g in grams).reshape(-1, BUCKETS)
            for k in range(len(names)):
                totals[k][:BUCKETS] += found[k]
            for k in of:
                totals[k][BUCKETS] += 1
        for lang, total in zip(names, totals):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["lang", "bucket", "n"])

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, bucket int, n bigint")
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(found.column("lang").unique().to_pylist())
    if len(langs) > LANGUAGES:
        raise ValueError(f"{len(langs)} languages are more than {LANGUAGES}")
    at = pc.index_in(found.column("lang"), pa.array(langs, pa.string()))
    counts = np.zeros((BUCKETS + 1, max(1, len(langs))))
    counts[np.asarray(found.column("bucket")), np.asarray(at)] = np.asarray(found.column("n"))
    grams = counts[:BUCKETS] + SMOOTHING
    logs = np.log(grams / grams.sum(axis=0))
    prior = np.log((counts[BUCKETS] + 1) / (counts[BUCKETS] + 1).sum())
    return langs, np.vstack([logs, prior])


def identify(docs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """The language of every row's text.

    ``docs`` needs columns doc_id and text; ``train`` (text, lang) teaches the
    languages; rows with a null lang are left out. Other columns are ignored.
    Returns doc_id, lang_pred and score, the posterior probability of lang_pred.
    A null text, or one without a letter, gets ``und`` and 0.0, as does every
    row when nothing was learned. Ties go to the language first by name; more than LANGUAGES languages raise an error; very long texts are read whole;
    repeated rows are judged alike; no rows give no rows.
    """
    train = (docs if train is None else train).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    langs, matrix = fit(train.where(F.col("lang").isNotNull()))
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        columns = [np.ascontiguousarray(logs[:BUCKETS, k]) for k in range(logs.shape[1])]
        for batch in blocks(batches, "text", LIMIT):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            grams, starts, _ = ngrams(texts)
            total = np.stack([np.add.reduceat(sum(column[g] for g in grams), starts) for column in columns], axis=1) + logs[BUCKETS]
            best = total.argmax(axis=1)
            share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            known = [bool(langs) and LETTER.search(t) is not None for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([langs[b] if k else "und" for b, k in zip(best, known)], pa.string()),
                    pa.array([float(s) if k else 0.0 for s, k in zip(share, known)], pa.float64()),
                ],
                ["doc_id", "lang_pred", "score"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op4(spark, sf_dir: str) -> DataFrame:
    """Contract query: learned from rows whose remainder is not 2 (a null id's row teaches too)."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    found = identify(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
