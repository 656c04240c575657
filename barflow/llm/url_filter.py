"""URL filter: host and path rules, and for all other pages trust and distrust that spread over links between hosts.

Trust is a personalised PageRank from hosts with allowed pages along the links. Distrust starts at hosts with blocked pages
and runs against the links: who links to bad hosts is suspect. A host is judged by what others lend it, not by its own seed,
since rules decide about their own pages already.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.session import cut_lineage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = r"(?is)<a\s[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


@dataclass(frozen=True)
class Walk:
    """``damping`` of the walks, passes over the edges, and the share of distrust from which a host is blocked."""

    damping: float = 0.85
    passes: int = 10
    threshold: float = 0.5
    cut_every: int = 5


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_of(host: Column, path: Column, rules: Sequence[Rule], what: str) -> Column:
    """Name or verdict of the longest rule that fits, null if none does. Of equally long rules the first in byte order counts."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), [-b for b in r.name.encode()])):
        out = F.when(((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path), getattr(r, what)).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, w: links from pages of a host to another host. Links without a host stay on their own host and are no edge."""
    refs = F.regexp_extract_all(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(_HREF), F.lit(1))
    away = F.filter(refs, lambda x: x.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"))
    to = host_of(F.regexp_replace("ref", r"^//", "any://"))
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(away).alias("ref")).select("src", to.alias("dst"))
    return links.filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))


def host_scores(judged: DataFrame, edges: DataFrame, p: Walk) -> DataFrame:
    """host, trust, distrust: what each host receives from others. ``judged`` has host and the verdict of a rule or null."""
    counts = judged.filter("host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    seeds = cut_lineage(counts.filter("good + bad > 0"))
    total = seeds.agg(F.sum("good"), F.sum("bad")).first()
    share = lambda c, n: (F.col(c) / n if n else F.lit(0.0)).cast("double")
    seeds = seeds.select("host", share("good", total[0]).alias("trust0"), share("bad", total[1]).alias("distrust0"))
    edges = cut_lineage(edges)
    # trust goes from src to dst by the share of src's links, distrust from dst to src by the share of links to dst
    ahead = edges.join(edges.groupBy("src").agg(F.sum("w").alias("all")), "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("w") / F.col("all")).alias("t"), F.lit(0.0).alias("d"))
    back = edges.join(edges.groupBy("dst").agg(F.sum("w").alias("all")), "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("w") / F.col("all")).alias("d"))
    steps = cut_lineage(ahead.unionByName(back))
    ranks = seeds.select("host", ((1 - p.damping) * F.col("trust0")).alias("trust"), ((1 - p.damping) * F.col("distrust0")).alias("distrust"))
    got = None
    for i in range(p.passes):
        got = steps.join(ranks, "host").groupBy(F.col("to").alias("host")).agg(
            (p.damping * F.sum(F.col("t") * F.col("trust"))).alias("trust"), (p.damping * F.sum(F.col("d") * F.col("distrust"))).alias("distrust")
        )
        if (i + 1) % p.cut_every == 0:
            got = cut_lineage(got)
        own = seeds.select("host", ((1 - p.damping) * F.col("trust0")).alias("trust"), ((1 - p.damping) * F.col("distrust0")).alias("distrust"))
        ranks = got.unionByName(own).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    return got if got is not None else ranks.limit(0)


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, p: Walk = Walk()) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule (or null), verdict.

    Null urls and urls without :// have empty host and path and fit no rule; they are allowed, like hosts of which nothing is
    known. Null html has no links. Rows that repeat a page_id are judged by their own urls. Rules are a list of the caller.
    Other columns are not looked at.
    """
    host, path = host_of(F.col("url").cast("string")), path_of(F.col("url").cast("string"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("url").cast("string").alias("url"), F.col("html"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules, "name")).withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules, "verdict"))
    scores = host_scores(judged.select("host", "ruled"), host_edges(judged.select("url", "html")), p)
    share = F.col("distrust") / (F.col("trust") + F.col("distrust"))
    bad = scores.filter("distrust > 0").filter(share > p.threshold).select("host", F.lit("block").alias("found"))
    out = judged.select("page_id", "host", "path", "rule", "ruled").join(bad, "host", "left")
    return out.select(F.col("page_id").cast("long").alias("page_id"), "host", "path", "rule", F.coalesce("ruled", "found", F.lit("allow")).alias("verdict"))
