"""Secret scan by assignment-aware lexing.

Base spans come from three fixed patterns. Beside them, source and configuration
syntax is lexed into (name, literal) pairs around every assignment sign (also
typed names, blocks of lines, and names and values of markup), names
that stand for other names' literals are resolved (constant propagation, through
chains; the last definition before the use, else the first behind it), and each literal is scored by the sensitivity of
the name it reaches and by its own make-up.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import blocks, table


def _either(word: str) -> str:
    """ASCII letters in either case, and nothing that Unicode folds to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
ASSIGN = re.compile(rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "named")

#: A name and the sign behind it; what stands between may be a quote that ends the name, and a type. Possessive, so linear in the text.
SIGN = re.compile(r"(?<![A-Za-z0-9_.$-])([A-Za-z_$][A-Za-z0-9_.$-]*+)[\"'\]]{0,2}+[ \t]*+(?:(?::=|=>|=(?![=>])|:(?![=:/])))")
TYPE = re.compile(r"[ \t]*+[A-Za-z_][A-Za-z0-9_.\[\]|]*+[ \t]*+=(?![=>])")
LITERAL = re.compile(r"[ \t]*(?:\"\"\"(.*?)\"\"\"|'''(.*?)'''|\"((?:[^\"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`|([A-Za-z0-9+/_.$~!@%^&*-]++(?:={1,2}(?![A-Za-z0-9+/_.=$~!@%^&*-]))?))", re.DOTALL)
BARE = 6
JOIN = re.compile(r"[ \t]*\+[ \t]*")
REFERENCE = re.compile(r"\$?\{?([A-Za-z_][A-Za-z0-9_.-]*)\}?\Z")
#: A block of indented lines behind a key.
BLOCK = re.compile(r"[ \t]*[|>][+-]?[ \t]*\n((?:[ \t]+[^\n]*(?:\n|\Z))+)")
#: A name and a value in two attributes, and an element's name and text.
ATTRIBUTES = re.compile(r"\b(?:name|key|id)[ \t]*=[ \t]*([\"'])([A-Za-z_][A-Za-z0-9_.-]*+)\1[ \t\n]+value[ \t]*=[ \t]*([\"'])((?:(?!\3)[^\n])*+)\3")
ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.-]*+)>([^<>\n]++)</\1>")
#: How strongly a part of a name says that its value is secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0, "secretkey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.7, "bearer": 0.8, "signature": 0.5, "key": 0.5}
#: Names and values that only look like secrets.
HARMLESS = re.compile(r"(?i)\b(?:example|changeme|placeholder|dummy|sample|redacted|none|null|true|false|todo)\b|x{4,}|\*{3,}|^<.*>$|^\$\{")
#: Least score of a reported literal.
THRESHOLD = 0.5


def sensitivity(name: str) -> float:
    """0 to 1: how sensitive a target name is, by its parts and neighbouring parts."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *map("".join, zip(parts, parts[1:]))]), default=0.0)


def strength(value: str) -> float:
    """0 to 1: how much a literal looks made by chance: entropy, length and mixture."""
    if len(value) < 6 or HARMLESS.search(value):
        return 0.0
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    mixed = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, entropy / 4) * min(1.0, len(value) / 12) * (1.0 if mixed > 1 else 0.6)


def base_spans(text: str) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, value start, value end) of the three patterns, failing matches dropped."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end(), m.start(), m.end()) for m in HEX.finditer(text)]


#: (value, start, end, whether it is quoted, whether it goes on from the string before)
Term = tuple[str, int, int, bool, bool]


def _terms(text: str, at: int) -> list[Term]:
    """What is assigned from ``at`` on: a literal or a name, or several joined by +; neighbouring strings are one."""
    out: list[Term] = []
    while m := LITERAL.match(text, at):
        kind = m.lastindex
        value, start, end = m.group(kind), m.start(kind), m.end(kind)
        if kind == BARE and value.endswith("+") and text[end : end + 1] in ("'", '"', "`"):
            value, end = value[:-1], end - 1
        out.append((value, start, end, kind != BARE, bool(out) and out[-1][3] and kind != BARE))
        plus = JOIN.match(text, end if kind == BARE else m.end())
        if not plus:
            break
        at = plus.end()
    return out


def pairs(text: str) -> list[tuple[int, str, list[Term]]]:
    """(position, name, terms) of every assignment, in order: code, configuration, typed names, blocks, attributes and elements."""
    out, behind = [], 0
    if ":" in text or "=" in text:
        for sign in SIGN.finditer(text):
            at = sign.end()
            if text[at - 1] == ":":
                if at >= behind and (block := BLOCK.match(text, at)):
                    behind = block.end()
                    start = block.start(1) + len(block[1]) - len(block[1].lstrip())
                    out.append((sign.start(), sign[1], [("".join(line.strip() for line in block[1].splitlines()), start, start + len(block[1].strip()), True, False)]))
                    continue
                if kind := TYPE.match(text, at):
                    at = kind.end()
            if terms := _terms(text, at):
                out.append((sign.start(), sign[1], terms))
    if "<" in text:
        out += [(m.start(), m[2], [(m[4], m.start(4), m.end(4), True, False)]) for m in ATTRIBUTES.finditer(text)]
        out += [(m.start(), m[1], [(m[2], m.start(2), m.end(2), True, False)]) for m in ELEMENT.finditer(text)]
    return sorted(out, key=lambda p: p[0])


def named_spans(text: str) -> list[tuple[str, int, int, int, int]]:
    """Literals that reach a sensitive name, by themselves or through other names, and score enough.

    A name stands for its last definition before the place that uses it, or for
    its first one where all are behind.
    """
    found, known = {}, pairs(text)
    defined: dict[str, tuple[list[int], list[list[Term]]]] = {}
    for at, name, terms in known:
        places, values = defined.setdefault(name.rpartition(".")[2] or name, ([], []))
        places.append(at)
        values.append(terms)
    for at, name, terms in known:
        s = sensitivity(name)
        if not s:
            continue
        parts, seen, todo = [], {name.rpartition(".")[2] or name}, [(at, t) for t in reversed(terms)]
        while todo:
            use, (value, start, end, quoted, goes_on) = todo.pop()
            ref = None if quoted else REFERENCE.match(value)
            if ref and ref[1] in defined and ref[1] not in seen:
                seen.add(ref[1])
                places, values = defined[ref[1]]
                k = max(bisect_left(places, use) - 1, 0)
                todo += [(places[k], t) for t in reversed(values[k])]
            else:
                parts.append((value, start, end, goes_on))
        if s * strength("".join(p[0] for p in parts)) >= THRESHOLD:
            joined: list[list[int]] = []
            for value, start, end, goes_on in parts:
                if goes_on and joined:
                    joined[-1][1] = end
                elif value:
                    joined.append([start, end])
            for start, end in joined:
                found[start, end] = ("named", start, end, start, end)
    return list(found.values())


def spans(text: str) -> list[tuple[str, int, int, int, int]]:
    """Base spans and those named ones whose literal no base span holds, by start and then kind."""
    base = sorted(base_spans(text), key=lambda b: b[1])
    starts, reach = [b[1] for b in base], list(accumulate((b[2] for b in base), max))
    more = [n for n in named_spans(text) if not (i := bisect_right(starts, n[1])) or reach[i - 1] < n[2]]
    return sorted([*base, *more], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, found: list[tuple[str, int, int, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with the secret part of every span, overlaps joined, replaced by ``mark``."""
    out, at = [], 0
    joined: list[list[int]] = []
    for a, b in sorted((s[3], s[4]) for s in found):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    for a, b in joined:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def _written(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _, _ in found)


def scan(docs: DataFrame) -> DataFrame:
    """Every row's secrets and its text without them.

    Needs columns doc_id and text; others are ignored. Returns doc_id, n_assign,
    n_access, n_hex, base_sha256, spans (code points, end exclusive) and redacted.
    A null text counts as empty and has no span (its redacted text stays null);
    repeated rows are scanned one by one; a null doc_id stays null; a very long
    text is scanned whole; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            texts = batch.column("text").to_pylist()
            found = [spans(t or "") for t in texts]
            base = [[s for s in f if s[0] != "named"] for f in found]
            counts = [Counter(s[0] for s in b) for b in base]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array([c[k] for c in counts], pa.int64()) for k in KINDS[:3]),
                    pa.array([hashlib.sha256(_written(b).encode()).hexdigest() for b in base], pa.string()),
                    pa.array([_written(f) for f in found], pa.string()),
                    pa.array([t if t is None or not f else redact(t, f) for t, f in zip(texts, found)], pa.string()),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, redacted string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def clean(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` with the secrets of their texts replaced; n_chars, if it is there, follows. See ``scan`` for odd rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            at = batch.schema.get_field_index("text")
            texts = [t if not t or not (found := spans(t)) else redact(t, found) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(dict(docs.dtypes)["n_chars"]), "n_chars")) if "n_chars" in docs.columns else out


def op5(spark, sf_dir: str) -> DataFrame:
    """Contract query: counts, the digest of base spans, and all spans of every document."""
    return scan(table(spark, sf_dir, "documents")).drop("redacted")
