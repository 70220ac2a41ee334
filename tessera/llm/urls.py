"""URL filters: rules by host and path, and link-graph propagation for the rest.

Personalised PageRank spreads trust from hosts with allowed pages along host edges,
and distrust from hosts with blocked pages against them. A host is blocked where
distrust outweighs trust. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, keep, lookup

#: Rounds in which ranks must settle; a host n links from all seeds takes n at least.
ROUNDS = 1000
#: Links of a host that one task takes in a round.
HUB = 50_000

#: Absolute and scheme-relative link targets in attributes; relative ones stay on their host.
LINK = r"""(?i)\shref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^\s"'<>]+)"""


@dataclass(frozen=True)
class Rule:
    """Allows or blocks a host with its subdomains, where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: F.Column) -> F.Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: F.Column) -> F.Column:
    """What follows the host, up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """`pages` with host, path, rule and rule_verdict, of the longest rule that fits
    (null where none does; of equally long ones, the first by name)."""
    u = F.col(url)
    out = pages.withColumns({"host": host_of(u), "path": path_of(u)})
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(ordered):
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return out.withColumns({"rule": name, "rule_verdict": verdict})


def host_edges(pages: DataFrame, html: str = "html", host: str = "host") -> DataFrame:
    """(src, dst, weight): links between different hosts, by number of pages with them."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1)), lambda x: host_of(F.concat(F.lit("x:"), F.regexp_replace(x, r"^[^/]*:", "")))))
    links = pages.where(F.col(host) != "").select(F.col(host).alias("src"), F.explode(targets).alias("dst"))
    return links.where((F.col("dst") != "") & (F.col("dst") != F.col("src"))).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def page_rank(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = ROUNDS, settled: float = 1e-6) -> DataFrame:
    """(host, rank): personalised PageRank from `seeds` (host, share) along `edges`
    (src, dst, weight); the ranks of all hosts add to 1.

    A host without links returns its rank to the seeds. That scales all ranks alike,
    so each round lets it go and the last one divides by what is left. Settled is when
    a round reaches no new host and moves no host's rank by more than `settled` of it;
    raises if `rounds` run out before. No seeds or no edges are defined: no rank, and
    the seeds' own.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"), F.count("*").alias("links"))
    edges = keep(edges, "edges")
    shared = lookup(edges, out, "src", "inner").select("src", "dst", (F.col("weight") / F.col("out")).alias("share"), F.ceil(F.col("links") / HUB).alias("salts"))
    # A hub's links are dealt out over salts; the salts of all hubs are under links / HUB.
    flow = keep(shared.withColumn("salt", F.pmod(F.xxhash64("dst"), F.col("salts"))).select("src", "dst", "share", "salt"), "flow")
    hubs = keep(out.where(F.col("links") > HUB).select(F.col("src").alias("host"), F.ceil(F.col("links") / HUB).alias("salts")), "hubs")
    rank = keep(seeds.select("host", F.col("share").alias("rank")), "rank")
    for _ in range(rounds):
        salted = rank.join(hubs, "host", "left").select("host", "rank", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1)).alias("salt"))
        # Sums come by partial aggregation, so a host that many link to is no hot group.
        moves = salted.join(flow, (salted.host == flow.src) & (salted.salt == flow.salt)).select(F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        start = seeds.select("host", (F.col("share") * (1 - damping)).alias("rank"))
        after = keep(start.unionByName(moves).groupBy("host").agg(F.sum("rank").alias("rank")), "rank")
        moved = F.abs(F.col("rank") - F.coalesce("old", F.lit(0.0))) / F.col("rank")
        row = after.join(rank.withColumnRenamed("rank", "old"), "host", "left").agg(F.max(moved).alias("d"), F.sum("rank").alias("total")).first()
        drop(rank)
        rank = after
        if row["d"] is None or row["d"] < settled:
            break
    else:
        raise RuntimeError(f"ranks did not settle in {rounds} rounds")
    for kept in (edges, flow, hubs):
        drop(kept)
    return rank.select("host", (F.col("rank") / F.lit(row["total"] or 1.0)).alias("rank"))


def host_verdicts(pages: DataFrame, html: str = "html", threshold: float = 1.0) -> DataFrame:
    """(host, trust, distrust, host_verdict) of `judged` pages' hosts. Seeds share by
    their pages under allowing and under blocking rules. A host is blocked where its
    distrust is over `threshold` times its trust."""
    seen = keep(pages.groupBy("host").agg(F.count_if(F.col("rule_verdict") == "allow").cast("double").alias("good"), F.count_if(F.col("rule_verdict") == "block").cast("double").alias("bad")), "hosts")
    edges = keep(host_edges(pages, html), "links")
    ranks = {}
    for side, name, along in (("good", "trust", edges), ("bad", "distrust", edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))):
        total = seen.agg(F.sum(side).alias("n")).first()["n"] or 0.0
        seeds = seen.where(F.col(side) > 0).select("host", (F.col(side) / F.lit(total or 1.0)).alias("share"))
        ranks[name] = page_rank(seeds, along).withColumnRenamed("rank", name)
    out = seen.select("host").join(ranks["trust"], "host", "left").join(ranks["distrust"], "host", "left").fillna(0.0, ["trust", "distrust"])
    return out.withColumn("host_verdict", F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow"))


def filter_urls(pages: DataFrame, rules: list[Rule], url: str = "url", html: str = "html", threshold: float = 1.0) -> DataFrame:
    """`pages` with host, path, rule, verdict, trust and distrust.

    The longest rule that fits decides; where none does, the host's verdict. Null
    urls and those without `://` have an empty host and path; the empty host has
    neither links nor, unless a rule names it, seeds, and is allowed. Null html has
    no links. Repeated rows each count. Columns of `pages` with the names added
    here are replaced.
    """
    own = ["host", "path", "rule", "rule_verdict", "trust", "distrust", "host_verdict", "verdict"]
    marked = judged(pages.drop(*[c for c in own if c != url and c != html]), rules, url)
    hosts = keep(host_verdicts(marked, html, threshold), "verdicts")
    return lookup(marked, hosts, "host").withColumn("verdict", F.coalesce("rule_verdict", "host_verdict"))
