"""BPE encoding and decoding by forced-boundary splitting.

A pair of adjacent bytes that occurs inside no vocabulary token can never be
joined by a merge, so a cut between them is certain. Each pre-token is cut at
such pairs, its fragments are merged independently of each other, and the ids
are concatenated. Fragments and pre-tokens recur, so both are kept in bounded
caches.

The vocabulary is a byte-level BPE file of the tokenizers library; the results
equal that library's ``encode(text, add_special_tokens=False).ids`` and
``decode(ids, skip_special_tokens=False)`` with truncation and padding unused.
Strings of added tokens in a text become their ids, as they do there.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import blocks, table

#: The pre-tokens of byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Texts of nothing beyond this code point go through a faster equivalent of PIECES.
SIMPLE = 0x24F
#: Entries a cache may hold before it starts afresh.
CACHE_ENTRIES = 200_000
#: Longer pieces and fragments aren't kept, so that unbroken strings don't fill the memory.
CACHE_LENGTH = 64
#: Longer texts are split into pieces bit by bit.
LONG_TEXT = 1 << 20


def simple_pieces() -> re.Pattern:
    """PIECES for texts within SIMPLE, with explicit classes for the standard library's faster engine."""
    letter, number, space = ("".join(re.escape(chr(i)) for i in range(SIMPLE + 1) if regex.match(p, chr(i))) for p in (r"\p{L}", r"\p{N}", r"\p{White_Space}"))
    return re.compile(rf" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class _Cache(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(key) > CACHE_LENGTH:
            return self.make(key)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[key] = value = self.make(key)
        return value


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE vocabulary")
        alphabet = byte_alphabet()
        self.bytes_of = {i: bytes(alphabet[c] for c in token) for token, i in model["vocab"].items() if all(c in alphabet for c in token)}
        ids = {token: i for token, i in model["vocab"].items()}
        self.single = [ids[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.merges = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        joined = np.zeros((256, 256), np.uint8)
        for token in self.bytes_of.values():
            for a, b in zip(token, token[1:]):
                joined[a, b] = 1
        self.joined = [row.tobytes() for row in joined]
        self.core = self._core(model["merges"])
        self.added = {}
        for token in spec["added_tokens"]:
            if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
                raise ValueError("added tokens that look around them are not offered")
            self.added[token["content"]] = np.uint32(token["id"]).astype("<u4").tobytes()
            self.bytes_of[token["id"]] = token["content"].encode()
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.stops = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.pieces, self.simple, self.beyond = regex.compile(PIECES), simple_pieces(), re.compile(f"[^\0-{chr(SIMPLE)}]")
        self.fragments = _Cache(self.merge)
        self.encoded = _Cache(self.encode_piece)

    def cuts(self, data: bytes) -> list[int]:
        """Where a cut is certain: before the second byte of a pair that no token holds."""
        joined = self.joined
        return [i for i, (a, b) in enumerate(zip(data, data[1:]), 1) if not joined[a][b]]

    def _core(self, merges: list):
        """tiktoken's merger, if ids follow the merges' ranks, so that it merges as they say; else None."""
        if len(self.merges) != len(merges) or any(new - 256 != rank for rank, new in self.merges.values()):
            return None
        import tiktoken

        ranks = {token: i for i, token in self.bytes_of.items() if i < 256 + len(merges)}
        return tiktoken.Encoding("own", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def merge(self, fragment: bytes) -> bytes:
        """The ids of one fragment, merged by rank and then from the left; little-endian uint32."""
        if self.core:
            return pack("<%dI" % len(ids := self.core.encode_single_piece(fragment)), *ids)
        return self.merge_plain(fragment)

    def merge_plain(self, fragment: bytes) -> bytes:
        """``merge`` for any list of merges, in n log n."""
        import heapq

        n = len(fragment)
        ids = [self.single[b] for b in fragment]
        right, left, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = new, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (m := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, m[1], ids[x], ids[y]))
        return np.array([t for t, ok in zip(ids, alive) if ok], "<u4").tobytes()

    def encode_piece(self, piece: str) -> bytes:
        data = piece.encode()
        cuts = self.cuts(data)
        if not cuts:
            return self.merge(data)
        cuts = [0, *cuts, len(data)]
        return b"".join(self.fragments[data[a:b]] for a, b in zip(cuts, cuts[1:]))

    def _plain(self, text: str) -> bytes:
        pieces = self.pieces if self.beyond.search(text) else self.simple
        if len(text) <= LONG_TEXT:
            return b"".join(map(self.encoded.__getitem__, pieces.findall(text)))
        return b"".join(self.encoded[m.group()] for m in pieces.finditer(text))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not self.stops or not any(a in text for a in self.added):
            return self._plain(text)
        out, at = [], 0
        for m in self.stops.finditer(text):
            out += [self._plain(text[at : m.start()]), self.added[m.group()]]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Every row's text as token ids, and the text decoded from them.

    Needs columns doc_id and text; others are ignored. Returns doc_id, n_tokens,
    ids (array<int>; null unless ``keep_ids``), decoded, ids_sha256 and
    decoded_sha256. A null or empty text has no ids and decodes to the empty
    text; rows that repeat or tie are encoded one by one; a null doc_id stays
    null; no rows give no rows. ``path`` must be readable on every executor.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path)
        for batch in blocks(batches, "text"):
            ids = [code.encode(t or "") for t in batch.column("text").to_pylist()]
            decoded = [code.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([np.frombuffer(x, "<i4") if keep_ids else None for x in ids], pa.list_(pa.int32())),
                    pa.array(decoded, pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens bigint, ids array<int>, decoded string, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    """Contract query: counts and digests of every document's ids and decoded text."""
    return encode(table(spark, sf_dir, "documents"), keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
