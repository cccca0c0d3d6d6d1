"""op3 and the pipeline against brute force."""

import re

import pytest
from conftest import SF, need_tables
from pyspark.sql import functions as F

from quern.llm import bpe, secrets, url_filter


def parsed(url):
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def ruled(host, path):
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def brute_verdicts(pages):
    """The whole method in dictionaries."""
    info = [(p, *parsed(u), h or "") for p, u, h in pages]
    trust, distrust, edges = {}, {}, {}
    for _, host, path, html in info:
        if not host:
            continue
        rule = ruled(host, path)
        trust.setdefault(host, 0.0)
        distrust.setdefault(host, 0.0)
        if rule:
            (trust if rule.verdict == "allow" else distrust)[host] += 1
        for other in {parsed(x)[0] for x in re.findall(url_filter.LINK, html)}:
            if other and other != host:
                edges[host, other] = edges.get((host, other), 0) + 1
    for host in list(trust):
        if "." in host and (up := host.partition(".")[2]):
            for e in ((host, up), (up, host)):
                edges[e] = edges.get(e, 0) + 1
    out, back = {}, {}
    for (a, b), w in edges.items():
        out[a], back[b] = out.get(a, 0) + w, back.get(b, 0) + w
    d = url_filter.DAMPING
    seeds = {h: (trust[h], distrust[h]) for h in trust}
    ranks = dict(seeds)
    for _ in range(url_filter.ROUNDS):
        new = {h: [(1 - d) * t, (1 - d) * u] for h, (t, u) in seeds.items()}
        for (a, b), w in edges.items():
            new.setdefault(b, [0.0, 0.0])[0] += d * ranks.get(a, (0, 0))[0] * w / out[a]
            new.setdefault(a, [0.0, 0.0])[1] += d * ranks.get(b, (0, 0))[1] * w / back[b]
        ranks = new
    rows = []
    for p, host, path, _ in info:
        rule = ruled(host, path)
        t, u = ranks.get(host, (0, 0))
        bad = t + u > 0 and u / (t + u) > url_filter.THRESHOLD
        rows.append((p, host, path, rule and rule.name, rule.verdict if rule else "block" if bad else "allow"))
    return sorted(rows, key=str)


ODD_URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?y#z", "x://example.org/en/1", "x://example.org/en/12/", "x://notexample.org/es/", "http://b.com?/fr/", "http://b.com/fr/a#b", "http://c.com#x", "http://c.com/de", "http://c.com/de/", "a://b://c/d", "http://x.net/p"]


def test_odd_pages(spark):
    linked = '<a href="http://c.com/de/x">1</a> <a HREF = \'HTTP://x.net/\'>2</a> <a href=http://c.com/>3</a> <a href="/local">4</a>'
    pages = [(k, u, linked if k % 3 == 0 else None if k % 3 == 1 else "<p>") for k, u in enumerate(ODD_URLS)] + [(3, ODD_URLS[3], linked), (None, "http://c.com/de/", None)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("host", F.lit("clash")).withColumn("trust", F.lit(1))
    found = url_filter.judge(df).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, found), key=str) == brute_verdicts(pages)
    assert url_filter.judge(df.limit(0)).collect() == []


@need_tables()
def test_all_pages(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    found = url_filter.op3(spark, SF).collect()
    assert sorted(map(tuple, found), key=str) == brute_verdicts(pages)


def test_distrust_reaches_what_links_to_blocked_hosts(spark):
    pages = [(1, "http://bad.com/de/", ""), (2, "http://fan.net/", '<a href="http://bad.com/de/">x</a>'), (3, "http://good.com/fr/", '<a href="http://friend.net/">x</a>'), (4, "http://friend.net/", ""), (5, "http://alone.net/", "")]
    found = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert found == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


@need_tables()
def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from test_documents import brute_components, contained

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "secrets", "bpe"]
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    for name in list(stages)[:-1]:
        kept = stages[name](spark, docs, SF)
        assert kept.schema.simpleString() == docs.schema.simpleString()
        before, after = rows(docs), rows(kept)
        if name == "toxicity":
            assert set(after) <= set(before) and len(after) > 0.9 * len(before)
        elif name == "near_dedup":
            least = {d for d, _, c, _ in brute_components(before, 5, 80) if c == d}
            assert sorted(after) == sorted(r for r in before if r[0] in least)
        elif name == "decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert sorted(after) == sorted(r for r in before if all(contained(r[1], t) is None for t in items))
        else:
            assert sorted(after) == sorted((d, secrets.redact(t, secrets.spans(t))) for d, t in before)
        docs = spark.createDataFrame(kept.toPandas(), docs.schema)
    last = stages["bpe"](spark, docs, SF).orderBy("doc_id").collect()
    whole = corpus_pipeline.run(spark, SF).orderBy("doc_id").collect()
    assert last == whole and whole
    code = bpe.codec(bpe.default_path())
    texts = dict(rows(docs))
    assert all(r["decoded"] == texts[r["doc_id"]] and r["n_tokens"] == len(code.encode(texts[r["doc_id"]])) // 4 for r in whole)


def test_pipeline_on_odd_and_empty_rows(spark, unruly_docs, no_docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    extra = unruly_docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    for name, docs in (("odd", extra), ("none", no_docs)):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert len(out) > 20 if name == "odd" else out == []
