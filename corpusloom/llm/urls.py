"""URL filter: allow and block rules, then trust and distrust propagated over the host graph.

A url a rule fits takes the longest rule's verdict.  Every other url takes its host's verdict from
two personalised PageRanks over the directed, weighted graph of links between hosts: trust starts at
hosts of which the rules allow some pages and block no more, and follows links; distrust starts at
hosts of which the rules block over half of all pages, and follows links backwards (a page that links
to a blocked host is suspect).  Pages no rule fits count among all pages, and a host's seed is in
proportion to its share of allowed or blocked pages among them.
A host is blocked if its share of all distrust exceeds ``ratio`` times its share of all trust.

Both ranks run in one loop: an iteration is one join of the ranks with the transition rows and one
sum.  Mass that reaches a host without links would restart at the seeds, which only scales the
ranks, so it is left out and the ranks are normalised at the end.  The lineage is cut every few
iterations in the shared folder; the loop ends when the ranks move less than ``tolerance``, or
after ``rounds`` if given.  A host with more than ``hub`` transitions is dealt to several keys by the
other end, and its rank is repeated for each; joins of links and pages with one row per host read
stored tables on both sides, so that Spark may split a hot host.

Defined results: a null url or one without ``://`` has empty host and path, no rule and the verdict
allow; a host that no mass reaches is allowed; links inside a host, null html and html without
absolute links add no edges; no rows give no rows; repeated rows stay; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import stored, table

#: (verdict, host, path) of the production rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_LINK = r"(?i)\bhref\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s>]+)"


def lowered(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = lowered(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(verdict, rule) of the longest fitting rule, or null.  Rules are a short literal list."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return F.lit(None).cast("struct<verdict:string,rule:string>") if out is None else out


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts."""
    host, _ = host_and_path(F.col("url"))
    links = pages.select(
        host.alias("src"),
        F.explode(F.transform(F.regexp_extract_all("html", F.lit(_LINK), 1), lowered)).alias("dst"),
    )
    links = links.where((F.col("src") != "") & (F.col("src") != F.col("dst")))
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(
    edges: DataFrame,
    seeds: DataFrame,
    *,
    damping: float = 0.85,
    rounds: int | None = None,
    cut: int = 5,
    tolerance: float = 1e-6,
    hub: int = 100_000,
) -> DataFrame:
    """host, kind, x: ranks of each kind ('trust' forwards, 'distrust' backwards), summing to 1.

    seeds: host, kind, s with s summing to 1 in each kind.
    """
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n")
    )
    both = stored(both)
    start = stored(seeds.select("host", "kind", F.col("s").alias("x")))
    ranks = start
    if both.isEmpty():
        return ranks
    out = both.groupBy("host", "kind").agg(F.sum("n").alias("total"), F.ceil(F.count(F.lit(1)) / hub).cast("long").alias("salts"))
    out = stored(out)
    steps = both.join(out, ["host", "kind"]).select(
        "host", "kind", F.pmod(F.xxhash64("to"), "salts").alias("salt"), "to", (F.col("n") / F.col("total")).alias("p")
    )
    steps = stored(steps)
    hubs = stored(out.where("salts > 1").select("host", "kind", "salts"))  # one row in ``hub`` transitions at most
    restart = start.select("host", "kind", (F.col("x") * (1 - damping)).alias("x"))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))
    for done in itertools.count(cut, cut):
        before = ranks
        for _ in range(cut):
            spread = ranks.join(hubs, ["host", "kind"], "left").select("host", "kind", "x", salts.alias("salt"))
            moved = steps.join(spread, ["host", "kind", "salt"]).select(
                F.col("to").alias("host"), "kind", (F.col("x") * F.col("p") * damping).alias("x")
            )
            ranks = moved.unionByName(restart).groupBy("host", "kind").agg(F.sum("x").alias("x"))
        ranks = stored(ranks)
        if rounds is not None and done >= rounds:
            break
        change = ranks.unionByName(before.select("host", "kind", (-F.col("x")).alias("x")))
        change = change.groupBy("host", "kind").agg(F.abs(F.sum("x")).alias("x")).agg(F.sum("x")).first()[0]
        if change is None or change < tolerance:
            break
    sums = ranks.groupBy("kind").agg(F.sum("x").alias("all"))
    return ranks.join(F.broadcast(sums), "kind").select("host", "kind", (F.col("x") / F.col("all")).alias("x"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, *, ratio: float = 1.0, **ppr) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust."""
    host, path = host_and_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = seen.withColumn("hit", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.col("hit.verdict")
    votes = (
        seen.where(F.col("host") != "")
        .groupBy("host")
        .agg(F.count_if(verdict == "allow").alias("a"), F.count_if(verdict == "block").alias("b"), F.count(F.lit(1)).alias("n"))
        .withColumn("kind", F.when((F.col("a") > 0) & (F.col("a") >= F.col("b")), "trust").when(2 * F.col("b") > F.col("n"), "distrust"))
        .where("kind is not null")
        .select("host", "kind", (F.when(F.col("kind") == "trust", F.col("a")).otherwise(F.col("b")) / F.col("n")).alias("share"))
    )
    votes = stored(votes)
    sizes = votes.groupBy("kind").agg(F.sum("share").alias("m"))
    seeds = votes.join(F.broadcast(sizes), "kind").select("host", "kind", (F.col("share") / F.col("m")).alias("s"))
    ranks = propagate(host_edges(pages.select("url", "html")), seeds, **ppr)
    ranks = ranks.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("x")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("x")).otherwise(0.0)).alias("distrust"),
    )
    out = seen.join(stored(ranks), "host", "left")
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust"))
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce(verdict, F.when(distrust > trust * ratio, "block").otherwise("allow")).alias("verdict"),
        trust.alias("trust"),
        distrust.alias("distrust"),
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
