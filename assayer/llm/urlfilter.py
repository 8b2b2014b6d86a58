"""URL filters: rules by host and path, and trust propagated over the host link graph.

A url that a rule fits has the rule's verdict. For every other host, personalised PageRank
runs twice over the links between hosts: trust flows along the links from hosts most of
whose urls are allowed, distrust flows against them from hosts most of whose urls are
blocked, for who links to a blocked host shares its blame. Blocked seeds take no trust
and trusted ones no distrust, so neither passes any on. A host whose distrust outweighs its trust is blocked. The walk
goes on until what a round still moves is below a tolerance, however far that leads.

Links are counted per pair of hosts before anything is joined, so a page full of links
or a host that everyone links to is one edge a pair; rank is summed before it is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, partitions, stored

#: (host, path, verdict). A rule fits its host and all subdomains under its path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING = 0.85
#: Share of all rank that a round may still move at the end, rounds after which it can't be
#: more whatever the links are, and rounds between two looks at it.
TOLERANCE = 1e-9
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
LOOK = 8
#: A host is blocked if its distrust is over this and over its trust times DISTRUST_RATIO.
LEAST_DISTRUST, DISTRUST_RATIO = 1e-12, 1.0

HOST = r"^.*?://([^/?#]*)"
PATH = r"^.*?://[^/?#]*([^?#]*)"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


def _found(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(text, f"(?s){pattern}", 1), F.lit(""))


def _ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; "" without ://."""
    return _ascii_lower(_found(url, HOST))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; "" without ://."""
    return _found(url, PATH)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    longest_first = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in reversed(longest_first):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst and n: links from pages of one host to another host. Columns url, html."""
    found = pages.select(host_of(F.col("url")).alias("src"), F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), lambda u: host_of(F.concat(F.lit("http://"), F.regexp_replace(u, "^(?i:https?:)?//", ""))))).alias("dsts"))
    return found.select("src", F.explode("dsts").alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """kind, host and rank of personalised PageRank, for each kind of seeds by itself.

    edges: kind, src, dst, n; seeds: kind, host, weight. A walk starts at a seed by weight,
    follows links by n with probability ``damping`` and else starts anew; a walk that has
    no link to follow ends. Rounds go on until they move no more than ``tolerance`` of a
    kind's rank. Hosts that no walk reaches are missing.
    """
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))
    start = stored(seeds.join(F.broadcast(total), "kind").select("kind", "host", ((1 - damping) * F.col("weight") / F.col("total")).alias("rank")), "url-start")
    if edges.isEmpty() or start.isEmpty():
        return start
    # The links of a host with very many of them are dealt to several tasks.
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("degree"))
    quarter = max(1, edges.count() // (4 * partitions(edges.sparkSession)))
    out = stored(out.withColumn("tasks", F.ceil(F.col("degree") / quarter).cast("int")), "url-out")
    share = edges.join(out, ["kind", "src"]).select("kind", "src", F.pmod(F.xxhash64("dst"), F.col("tasks")).cast("int").alias("salt"), "dst", (damping * F.col("n") / F.col("all")).alias("share"))
    share = stored(share, "url-edges")
    spread = out.select("kind", F.col("src").alias("host"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("salt"))

    def moved(rank: DataFrame) -> DataFrame:
        dealt = rank.join(spread, ["kind", "host"]).withColumnRenamed("host", "src")
        step = dealt.join(share, ["kind", "src", "salt"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share")).alias("rank"))
        return start.union(step).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))

    rank, rounds = start, 0
    while rounds < math.ceil(math.log(tolerance) / math.log(damping)):
        before = rank
        for _ in range(LOOK):
            rank = moved(rank)
        rank, rounds = stored(rank, "url-rank"), rounds + LOOK
        change = rank.join(before.withColumnRenamed("rank", "before"), ["kind", "host"], "left").groupBy("kind").agg(F.sum(F.abs(F.col("rank") - F.coalesce("before", F.lit(0.0)))).alias("change"))
        if (change.agg(F.max("change")).first()[0] or 0.0) <= tolerance:
            break
    return rank


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, url, host, path, rule, verdict, trust and distrust of every row of ``pages``.

    pages: page_id, url, html. Where no rule fits, the verdict is ``block`` for hosts
    whose distrust outweighs their trust and ``allow`` for all others, those without
    links and without a host included. Null urls have an empty host and path; null html
    has no links; repeated rows stay, and their links count again; other columns are
    ignored; no rows give no rows.
    """
    host, path = F.coalesce(host_of(F.col("url")), F.lit("")), F.coalesce(path_of(F.col("url")), F.lit(""))
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path")).withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    edges = stored(host_links(pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))), "url-links")
    votes = parsed.groupBy("host").agg(*[F.sum(F.when(F.col("fit.verdict") == v, 1.0).otherwise(0.0)).alias(v) for v in ("allow", "block")], F.count(F.lit(1)).alias("urls"))
    votes = stored(votes, "url-votes")
    verdict = F.when(F.col("allow") > F.col("urls") / 2, "allow").when(F.col("block") > F.col("urls") / 2, "block")
    seeds = votes.where("host <> ''").select(verdict.alias("kind"), "host", F.greatest("allow", "block").alias("weight")).where("kind is not null")
    # Trust flows along the links and into no blocked seed, distrust against them and into no trusted one.
    both = edges.select(F.lit("allow").alias("kind"), "src", "dst", "n").union(edges.select(F.lit("block"), "dst", "src", "n"))
    other = seeds.select(F.when(F.col("kind") == "allow", "block").otherwise("allow").alias("kind"), F.col("host").alias("dst"))
    ranks = personalised_rank(stored(both.join(other, ["kind", "dst"], "left_anti").select("kind", "src", "dst", "n"), "url-directed"), seeds, damping, tolerance)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    scores = votes.select("host", "urls").join(ranks.groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust")), "host", "left")
    scores = stored(scores.select("host", "urls", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "url-scores")
    judged = join_hot(parsed, scores, "host", F.col("urls"), votes.agg(F.sum("urls")).first()[0] or 0)
    blocked = (F.col("distrust") > LEAST_DISTRUST) & (F.col("distrust") > DISTRUST_RATIO * F.col("trust"))
    return judged.select("page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
