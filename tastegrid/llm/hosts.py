"""URL verdicts from rules, and from trust and distrust spread over the link graph of hosts.

A rule fits a host and its subdomains if the url's path starts with the rule's; the longest fitting rule decides (of two
equally long ones the blocking one). Urls that no rule fits take their host's verdict: trust starts at hosts in
proportion to the share of their pages that are allowed by rule and follows links; distrust starts likewise at
blocked pages and follows links backwards. Both are personalised PageRanks,
``x = (1 - damping) * seed + damping * sum(x of neighbours * link share)``. How large ``x`` can get depends on the links of a
host, so each score is divided by the one it would have if all pages of all hosts had the seed, which gives a mean of the
shares around the host, and counts at least as much as the host's own share. A host is blocked when its distrust exceeds its trust by more than
``margin`` on that scale. The columns hold the scores themselves; a ``threshold`` compares these instead.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed; a null page
has no links; relative links stay on their host; repeated pages count as often as they occur; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.llm.common import ascii_lower, broadcast_if
from tastegrid.operators.staging import stage

HREF = r"""(?i)\shref\s*=\s*["']?\s*([^"'\s>]+)"""
STEPS = 4  # rounds between two written tables
SENT_HOSTS = 200_000  # so many scored hosts are sent to every task, so pages of a large host stay spread


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.lit(2**31 - 1))
    return F.when(F.coalesce(at, F.lit(0)) > 0, ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.lit(2**31 - 1))
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest of ``rules (verdict, host, path)`` that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame, html: str) -> DataFrame:
    """``(src, dst, n)``: links between hosts; ``pages`` has the column ``host``."""
    found = pages.where("host != ''").select("host", F.explode(F.regexp_extract_all(html, F.lit(HREF), F.lit(1))).alias("to"))
    near = F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to")).otherwise(F.col("to"))
    far = F.when(near.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), host_of(near)).otherwise(F.col("host"))
    ends = found.select(F.col("host").alias("src"), far.alias("dst")).where("dst != ''")
    return ends.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(seeds: DataFrame, links: DataFrame, damping: float, tolerance: float, rounds: int) -> DataFrame:
    """``(host, trust, distrust, trust_share, distrust_share)`` from ``seeds (host, trust, distrust)``; the shares are the
    scores over those of a seed of 1 at every host of ``seeds``. Stops when no value moves by ``tolerance``."""

    def arcs_of(kind: str, begin: str, end: str) -> DataFrame:
        """Arcs along which ``kind`` moves, each with its share of all links at its beginning."""
        total = links.groupBy(begin).agg(F.sum("n").alias("all"))
        share = (F.col("n") / F.col("all")).alias("share")
        return links.join(total, begin).select(F.lit(kind).alias("kind"), F.col(begin).alias("host"), F.col(end).alias("to"), share)

    arcs = stage(arcs_of("trust", "src", "dst").union(arcs_of("distrust", "dst", "src")), "host-arcs")
    start = seeds.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) as (kind, seed)"))
    start = stage(start, "host-seeds")
    now = start.select("kind", "host", F.col("seed").alias("x"), F.lit(1.0).alias("full"))
    kept = start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("x"), F.lit(1 - damping).alias("full"))
    none = F.lit(0.0)
    for _ in range(0, rounds, STEPS):
        for _ in range(STEPS):
            step = arcs.join(now, ["kind", "host"])
            passed = [(F.col(c) * F.col("share") * damping).alias(c) for c in ("x", "full")]
            moved = step.select("kind", F.col("to").alias("host"), *passed)
            was, now = now, moved.union(kept).groupBy("kind", "host").agg(F.sum("x").alias("x"), F.sum("full").alias("full"))
        both = now.join(was.select("kind", "host", F.col("x").alias("old"), F.col("full").alias("old_full")), ["kind", "host"], "full")
        x, full = F.coalesce("x", none), F.coalesce("full", none)
        change = F.greatest(F.abs(x - F.coalesce("old", none)), F.abs(full - F.coalesce("old_full", none)))
        now = stage(both.select("kind", "host", x.alias("x"), full.alias("full"), change.alias("moved")), "host-scores")
        change = now.agg(F.max("moved")).first()[0] or 0.0
        now = now.select("kind", "host", "x", "full")
        if change < tolerance:
            break
    of = lambda k, value: F.coalesce(F.sum(F.when(F.col("kind") == k, value)), none)
    share = F.col("x") / F.nullif(F.col("full"), none)
    return now.groupBy("host").agg(
        *[of(k, F.col("x")).alias(k) for k in ("trust", "distrust")],
        *[of(k, share).alias(f"{k}_share") for k in ("trust", "distrust")],
    )


def verdicts(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], key: str = "page_id", url: str = "url", html: str = "html",
    damping: float = 0.85, margin: float = 0.5, threshold: float | None = None, tolerance: float = 1e-6, rounds: int = 100,
) -> DataFrame:
    """``(key, host, path, rule, verdict, trust, distrust)``, one row per page."""
    named = pages.select(key, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = named.withColumns({"rule": rule, "by_rule": verdict})
    share = lambda v: (F.count_if(F.col("by_rule") == v) / F.count(F.lit(1)))
    seeds = judged.where("host != ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    links = stage(host_links(pages.select(host_of(F.col(url)).alias("host"), html), html), "host-links")
    scores = spread(seeds, links, damping, tolerance, rounds)
    own = seeds.select("host", F.col("trust").alias("own_trust"), F.col("distrust").alias("own_distrust"))
    known = stage(scores.join(own, "host"), "host-shares")
    out = judged.join(broadcast_if(known, known.count(), SENT_HOSTS), "host", "left")
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    more = F.greatest("own_distrust", "distrust_share") - F.greatest("own_trust", "trust_share") - margin
    if threshold is not None:
        more = distrust - trust - threshold
    by_host = F.when(F.round(more, 9) > 0, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(
        key, "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), trust.alias("trust"), distrust.alias("distrust")
    )
