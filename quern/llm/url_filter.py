"""URL filter by link-graph propagation.

Hosts are the nodes of a graph whose edges are the links of pages to other hosts
and, both ways, each host's tie to its parent domain among the hosts seen or
ruled on. Trust spreads forward from allowed seeds as personalised PageRank;
distrust spreads along reversed edges from blocked seeds. A host is blocked
where its share of distrust outweighs its trust by the threshold. Rules, where
one fits a url, decide by themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, table

#: Share of rank that is passed on; the rest returns to the seeds.
DAMPING = 0.85
ROUNDS = 8
#: A host is blocked when distrust / (trust + distrust) is above this.
THRESHOLD = 0.6
LINK = r"""(?i)\bhref\s*=\s*["']?\s*([a-z][a-z0-9+.-]*://[^\s"'<>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def _behind(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z as a-z; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_behind(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_behind(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct (name, verdict) of the longest rule that fits, or null; of equally long ones the first by name."""
    out = F.lit(None).cast("struct<name: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), tuple(-ord(c) for c in r.name))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def edges_of(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """src, dst, weight: links between hosts, counted once for each page, and ties to parent domains."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), host_of))).alias("dst"))
    links = links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    up = hosts.select(F.col("host").alias("src"), F.expr("substring(host, instr(host, '.') + 1)").alias("dst")).where("instr(src, '.') > 0 and dst <> ''")
    ties = up.select("src", "dst", F.lit(1.0).alias("weight"))
    return links.unionByName(ties).unionByName(ties.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust after ``rounds`` of personalised PageRank.

    ``seeds`` has host, trust and distrust, in any unit that both share. Trust
    goes from src to dst, distrust from dst to src, in proportion to weight; a
    host without edges to pass on by keeps nothing for others.
    """
    out = edges.groupBy(F.col("src").alias("host")).agg(F.sum("weight").alias("total"))
    back = edges.groupBy(F.col("dst").alias("host")).agg(F.sum("weight").alias("total"))
    forward = edges.join(out.withColumnRenamed("host", "src"), "src").select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("weight") / F.col("total")).alias("trusted"), F.lit(0.0).alias("distrusted"))
    reverse = edges.join(back.withColumnRenamed("host", "dst"), "dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0.0).alias("trusted"), (F.col("weight") / F.col("total")).alias("distrusted"))
    steps = cut(forward.unionByName(reverse).groupBy("a", "b").agg(F.sum("trusted").alias("trusted"), F.sum("distrusted").alias("distrusted")))
    returned = seeds.select("host", ((1 - damping) * F.col("trust")).alias("trust"), ((1 - damping) * F.col("distrust")).alias("distrust"))
    ranks = seeds.select("host", "trust", "distrust")
    for _ in range(rounds):
        passed = steps.join(ranks, steps.a == ranks.host).select(F.col("b").alias("host"), (damping * F.col("trust") * F.col("trusted")).alias("trust"), (damping * F.col("distrust") * F.col("distrusted")).alias("distrust"))
        # Written each round: a join of two written sides can be split where a host has very many edges.
        ranks = cut(passed.unionByName(returned).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
    return ranks


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page.

    Needs page_id, url and html; others are ignored. Seeds: the hosts of pages
    that a rule allows or blocks, weighted by how many of their pages it does.
    Without a rule, a page's verdict is its host's: ``block`` where its share of
    distrust is above ``threshold``, else ``allow``, as for hosts that neither
    reaches. A null url, or one without ``://``, has an empty host and path; an
    empty host takes no part in the graph. Repeated rows are judged alike; no
    rows give no rows.
    """
    url = F.col("url").cast("string")
    placed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    ruled = placed.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    counts = (F.sum((F.col("fit.verdict") == v).cast("double")) for v in ("allow", "block"))
    seeds = cut(ruled.where("host <> ''").groupBy("host").agg(*(F.coalesce(n, F.lit(0.0)).alias(c) for n, c in zip(counts, ("trust", "distrust")))))
    ranks = propagate(cut(edges_of(placed, seeds)), seeds, rounds)
    found = ruled.drop("html").join(ranks, "host", "left")
    bad = F.coalesce(F.col("distrust") / F.nullif(F.col("trust") + F.col("distrust"), F.lit(0.0)) > threshold, F.lit(False))
    verdict = F.coalesce("fit.verdict", F.when(bad, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("fit.name").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op3(spark, sf_dir: str) -> DataFrame:
    """Contract query: every page's host, path, rule and verdict."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
