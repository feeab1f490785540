"""URL verdicts: explicit rules, else trust and distrust spread over the graph of host links; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import UPPER
from ridgeline.operators.tables import join_hot, materialize


class Rule(NamedTuple):
    """``verdict`` for the urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path (up to ``?``, ``#`` or the end); both empty without ``://``."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(u, r"://([^/?#]*)", 1), UPPER, UPPER.lower())
    return host, F.regexp_extract(u, r"://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text (host and path) and verdict of the longest rule that fits, nulls if none does; of equal lengths the first listed."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.host + r.path)):  # later ones are asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.host + r.path).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts, counted: (src, dst, links). Relative links stay on their host and give no edge.

    Counts combine before the shuffle, so a host with a third of all pages or links costs one row per target and task.
    """
    href = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""), F.lit(1))
    absolute = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    links = pages.select(F.col("host").alias("src"), F.explode(href).alias("link")).select("src", split_url(absolute)[0].alias("dst"))
    return links.filter("src != dst and src != '' and dst != ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-6, settle: bool = False) -> DataFrame:
    """Personalised PageRank of every (kind, host) over ``edges`` (kind, src, dst, links), teleporting to ``seeds`` (kind, host, seed).

    Seeds of a kind sum to 1. Each round is a join on the source, a combine by target and one small aggregate; it is
    written to shared storage, which cuts lineage. Mass on hosts without links returns to the seeds. Ends after
    ``rounds`` or when no kind moved by ``tolerance``; with ``settle`` the former is an error. Returns (kind, host, score).
    """
    degree = edges.groupBy("kind", F.col("src").alias("host")).agg(F.sum("links").alias("out"))
    hosts = seeds.select("kind", "host").unionByName(edges.select("kind", F.col("src").alias("host"))).unionByName(edges.select("kind", F.col("dst").alias("host"))).distinct()
    nodes = hosts.join(seeds, ["kind", "host"], "left").join(degree, ["kind", "host"], "left").fillna({"seed": 0.0})
    ranks = nodes = materialize(nodes.withColumn("score", F.col("seed")), "hosts")
    for _ in range(rounds):
        sent = edges.withColumnRenamed("src", "host").join(ranks.filter("out is not null"), ["kind", "host"])
        got = sent.groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("links") / F.col("out")).alias("got"))
        lost = F.broadcast(ranks.groupBy("kind").agg(F.sum(F.when(F.col("out").isNull(), F.col("score")).otherwise(0.0)).alias("lost")))
        new = (1 - damping) * F.col("seed") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("seed"))
        step = ranks.withColumnRenamed("score", "old").join(got, ["kind", "host"], "left").join(lost, "kind")
        ranks = materialize(step.select("kind", "host", "seed", "out", new.alias("score"), F.abs(new - F.col("old")).alias("moved")), "ranks")
        if max((r[0] for r in ranks.groupBy("kind").agg(F.sum("moved")).select("sum(moved)").collect()), default=0) < tolerance:
            break
        ranks = ranks.drop("moved")
    else:
        if settle:
            raise RuntimeError(f"trust did not settle in {rounds} rounds")
    return ranks.select("kind", "host", "score")


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, ratio: float = 1.0, damping: float = 0.85, rounds: int = 20, settle: bool = False) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    The longest fitting rule decides. Where none fits, the host does: trust is personalised PageRank along the links from
    hosts with allowed pages, distrust the same against the links from hosts with blocked pages, both seeded by the share
    of such pages; a host is blocked when its distrust exceeds ``ratio`` times its trust, so hosts that nothing reaches
    are allowed.

    Null urls and urls without ``://`` have empty host and path, fit no rule and are allowed; null html has no links.
    Repeated rows are judged alike and count once more as seeds. Empty tables give no rows. Host scores are broadcast
    only if few; else hosts with very many pages are, and the rest shuffle. With ``settle`` scores that still move after
    ``rounds`` are an error.
    """
    host, path = split_url(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    judged = materialize(parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled")), "pages")
    edges = host_edges(parsed)
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "links").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "links"))
    edges = materialize(both, "host-edges")
    kind = F.when(F.col("ruled") == "allow", "trust").otherwise("distrust")
    counts = judged.filter("ruled is not null and host != ''").groupBy(kind.alias("kind"), "host").count()
    totals = F.broadcast(counts.groupBy("kind").agg(F.sum("count").alias("all")))
    seeds = materialize(counts.join(totals, "kind").select("kind", "host", (F.col("count") / F.col("all")).alias("seed")), "host-seeds")
    scores = propagate(edges, seeds, damping, rounds, settle=settle)
    by_host = scores.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])
    out = join_hot(judged, by_host, "host", judged.count()).fillna({"trust": 0.0, "distrust": 0.0})
    by_method = F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"), "trust", "distrust")
