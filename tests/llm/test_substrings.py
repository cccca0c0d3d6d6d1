"""op1 and op2 against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from quern.llm import anchors, suffix_array, suffix_tree


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_words(rows, length=50):
    least = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            if doc is not None:
                least[key] = min(least.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        keep = [True] * len(w)
        for i in range(len(w) - length + 1):
            if doc is not None and least[tuple(w[i : i + length])] < doc:
                keep[i : i + length] = [False] * length
        kept = " ".join(x for x, k in zip(w, keep) if k)
        out.append((doc, len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, length=400):
    seen = defaultdict(int)
    data = [(doc, (text or "").encode()) for doc, text in rows]
    for _, t in data:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] += 1
    out = []
    for doc, t in data:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("which", ["odd_docs", "unruly_docs", "no_docs"])
def test_words(request, which):
    docs = request.getfixturevalue(which)
    found = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in suffix_tree.dedup(docs).collect()]
    assert sorted(found, key=str) == brute_words(pairs(docs))
    assert which == "no_docs" or any(f[2] for f in found)


@pytest.mark.parametrize("which", ["odd_docs", "unruly_docs", "no_docs"])
def test_bytes(request, which):
    docs = request.getfixturevalue(which)
    found = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_array.dedup(docs).collect()]
    assert sorted(found, key=str) == brute_bytes(pairs(docs))
    assert which == "no_docs" or any(f[2] for f in found)


def test_large_groups_are_split(spark, monkeypatch):
    """A passage with more different surroundings than GROUP, which some share in part."""
    monkeypatch.setattr(anchors, "GROUP", 3)
    passage = " ".join(f"p{k}" for k in range(70))
    docs = spark.createDataFrame([(k, f"before{k} b{k % 3} {passage} after{k % 4} a{k}") for k in range(12)] + [(k, f"x{k} " + passage[: 170 + 9 * k]) for k in range(12)], "doc_id bigint, text string")
    rows = pairs(docs)
    found = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in suffix_tree.dedup(docs).collect()]
    assert sorted(found, key=str) == brute_words(rows)
    long = spark.createDataFrame([(k, f"{k} " * 40 + passage * 3 + f" {k * k}" * 30) for k in range(12)], "doc_id bigint, text string")
    found = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_array.dedup(long).collect()]
    assert sorted(found, key=str) == brute_bytes(pairs(long))


@pytest.mark.parametrize("group", [anchors.GROUP, 2])
def test_all_places_of_a_stretch_under_the_least_id(spark, monkeypatch, group):
    """X P Y X P Y, and X P Y in two texts of one id, against A P B: the border stretches are the same in both places."""
    monkeypatch.setattr(anchors, "GROUP", group)
    p, x, y, a, b = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("p", 90), ("x", 60), ("y", 60), ("a", 60), ("b", 60)))
    docs = [(5, f"{a} {p} {b}"), (10, f"{x} {p} {y} {x} {p} {y}"), (12, f"{b} {p} {a} one"), (12, f"{b} {p} {a} two"), (20, f"{x} {p} {a}")]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in suffix_tree.dedup(docs).collect()]
    assert sorted(found, key=str) == brute_words(pairs(docs))


def numbered(letter, n):
    return " ".join(f"{letter}{k}" for k in range(n))


@pytest.mark.parametrize("before", ["", numbered("z", 70) + " "])
def test_a_passage_twice_in_one_document(spark, before):
    first = numbered("a", 90) + " " + numbered("q", 60)
    half = numbered("a", 90) + " " + numbered("x", 90)
    docs = spark.createDataFrame([(1, before.replace("z", "y") + first), (2, before + f"{half} {numbered('j', 120)} {half}")], "doc_id bigint, text string")
    found = {r["doc_id"]: r["n_removed"] for r in suffix_tree.dedup(docs).collect()}
    assert found == {1: 0, 2: 180}


def test_equal_rows_have_their_runs_once(spark):
    text = numbered("p", 200)
    rows = [(1, text)] + [(2, text)] * 40 + [(None, text)] * 20
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for module, brute in ((suffix_tree, brute_words), (suffix_array, brute_bytes)):
        runs = anchors.repeated(anchors.named(docs), module.WINDOWS, module.compare).collect()
        assert max(len(r["runs"]) for r in runs) < 30
        found = [tuple(r)[:3] + ((r["n_spans"],) if module is suffix_array else ()) + (r["kept_sha256"],) for r in module.dedup(docs).collect()]
        assert sorted(found, key=str) == brute(rows)


@pytest.mark.parametrize("module", [suffix_tree, suffix_array])
def test_very_long_texts_in_stretches(spark, monkeypatch, module):
    """STRETCH and SLICE so small that windows and texts cross them."""
    monkeypatch.setattr(anchors, "STRETCH", 64)
    monkeypatch.setattr(suffix_tree, "SLICE", 100)
    passage = numbered("p", 120)
    rows = [(k, f"{numbered(f'u{k}', 40 + k)} {passage} {numbered(f'v{k}', 100)} {passage[: 300 + 40 * k]}") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [tuple(r)[:3] + ((r["n_spans"],) if module is suffix_array else ()) + (r["kept_sha256"],) for r in module.dedup(docs).collect()]
    assert sorted(found, key=str) == (brute_words if module is suffix_tree else brute_bytes)(rows)


def test_patterned_words_are_told_apart(spark):
    """Words and windows of two symbols in the Thue-Morse order, whose polynomial hashes modulo 2**64 are equal."""
    bits = [bin(k).count("1") % 2 for k in range(2048)]
    one, two = ("".join("ab"[b ^ f] for b in bits) for f in (0, 1))
    rows = [(1, f"{numbered('p', 30)} {one} {numbered('q', 30)}"), (2, f"{numbered('p', 30)} {two} {numbered('q', 30)}"), (3, " ".join(one)), (4, " ".join(two))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in suffix_tree.dedup(docs).collect()]
    assert sorted(found, key=str) == brute_words(rows)


def test_suffix_array_and_bounded_boundaries():
    rng = np.random.default_rng(1)
    for alphabet in (2, 3, 20):
        for _ in range(10):
            code = rng.integers(1, alphabet + 1, rng.integers(2, 80)).astype(np.int64)
            code[-1] = 0
            order = suffix_array.sorted_suffixes(code)
            text = code.tolist()
            assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
            for length in (1, 2, 5):
                alone = suffix_array.bounded_boundaries(code, order, length)
                want = [True] + [text[a : a + length] != text[b : b + length] for a, b in zip(order, order[1:])]
                assert alone.tolist() == want


def test_tree_depths_and_deep_nodes():
    rng = np.random.default_rng(3)
    for depth in (1, 2, 3, 5, 50):
        code = rng.integers(0, 3, 60)
        code[-1] = 9
        leaves = np.arange(0, 60, 2)
        order, parts = suffix_tree.tree(code, leaves, depth)
        text = code.tolist()
        for k in range(1, len(order)):
            a, b = text[leaves[order[k - 1]] :], text[leaves[order[k]] :]
            common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert min(parts[k], depth) == min(common, depth) and a[:depth] <= b[:depth]
        groups = np.split(leaves[order], suffix_tree.deep_nodes(parts, depth)[1:])
        assert len(groups) == len({tuple(text[i : i + depth]) for i in leaves})
