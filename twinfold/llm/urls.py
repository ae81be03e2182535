"""URL verdicts: rules for hosts and paths first, the reputation of the host in the link graph for the rest.

Trust walks along the links from hosts with allowed pages, distrust walks against them from hosts with blocked pages: who
links to a blocked host is suspect, who is linked from a trusted one is not. Both are personalised PageRanks whose seeds
are the numbers of pages that the rules allow or block. A host is blocked when distrust holds most of the two. The walks
go on until they reach no new host and add less than a tolerance to what each host has, so a host's verdict does not
depend on how far it is from the seeds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import pick, stored

LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/"'?#\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIGITS = 3


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


@dataclass(frozen=True)
class RankConfig:
    """``damping`` of the walks; they end when no host gains more than ``tolerance`` of its trust or its distrust. A host is
    blocked at ``block_share`` of distrust or more, rounded to ``DIGITS``."""

    damping: float = 0.85
    tolerance: float = 1e-5
    block_share: float = 0.75


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def with_rule(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``rule`` and ``by_rule`` of the longest rule that fits ``host`` and ``path``; null without one. Of rules of equal
    length the first listed wins."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule = F.when(fits, F.lit(r.text)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return pages.withColumns({"rule": rule, "by_rule": verdict})


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, share_out, share_in``: links between different hosts, weighted by the pages that hold them, with the
    share of the links out of ``src`` and into ``dst``. ``pages`` has ``host, html``."""
    targets = F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1))
    each = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
    each = each.withColumn("dst", F.translate("dst", UPPER, LOWER)).filter("src <> dst")
    edges = each.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    out_of = edges.groupBy("src").agg(F.sum("w").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("w").alias("into"))
    joined = edges.join(out_of, "src").join(into, "dst")
    return joined.select("src", "dst", (F.col("w") / F.col("out")).alias("share_out"), (F.col("w") / F.col("into")).alias("share_in"))


def reputations(seeds: DataFrame, links: DataFrame, config: RankConfig = RankConfig()) -> DataFrame:
    """``host, trust, distrust`` from ``host, allowed, blocked`` and :func:`host_links`."""
    start = (1 - config.damping) * F.col("allowed"), (1 - config.damping) * F.col("blocked")
    base = stored(seeds.select("host", start[0].alias("trust"), start[1].alias("distrust")), "seeds")
    links = stored(links, "hostlinks")
    if links.isEmpty():  # nothing to walk on
        return base
    # what arrives in a round starts the next one; the ranks are the sums of all rounds
    ranks, moving, none = base, base, F.lit(0.0)
    while True:
        along = links.join(moving.filter("trust > 0"), links["src"] == moving["host"])
        along = along.select(F.col("dst").alias("host"), (config.damping * F.col("trust") * F.col("share_out")).alias("trust"), none.alias("distrust"))
        against = links.join(moving.filter("distrust > 0"), links["dst"] == moving["host"])
        against = against.select(F.col("src").alias("host"), none.alias("trust"), (config.damping * F.col("distrust") * F.col("share_in")).alias("distrust"))
        sums = [F.sum(c).alias(c) for c in ("trust", "distrust")]
        moving = stored(along.unionByName(against).groupBy("host").agg(*sums), "moving")
        ranks = stored(ranks.unionByName(moving).groupBy("host").agg(*sums), "ranks")
        gained = moving.select("host", F.col("trust").alias("more"), F.col("distrust").alias("less")).join(ranks, "host")
        if gained.filter((F.col("more") > config.tolerance * F.col("trust")) | (F.col("less") > config.tolerance * F.col("distrust"))).isEmpty():
            return ranks


def judged_urls(
    df: DataFrame, rules: tuple[Rule, ...] = RULES, config: RankConfig = RankConfig(), id_col: str = "page_id", url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row.

    Rows without a url, or whose url has no ``://``, have an empty host and path. Where no rule fits, the host's
    reputation decides; a host without any, the empty one too, is allowed. Repeated rows and null ids are kept; null html
    has no links; other columns are not read.
    """
    pages = pick(df, page_id=id_col, url=url_col, html=html_col)
    pages = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ruled = with_rule(pages, rules)
    kinds = [F.count_if(F.col("by_rule") == v).cast("double") for v in ("allow", "block")]
    seeds = ruled.filter("host <> '' and rule is not null").groupBy("host").agg(kinds[0].alias("allowed"), kinds[1].alias("blocked"))
    ranks = reputations(seeds, host_links(pages), config)
    share = F.round(F.try_divide(F.col("distrust"), F.col("trust") + F.col("distrust")), DIGITS)
    bad = ranks.filter(share >= config.block_share).select("host", F.lit(True).alias("bad"))
    out = ruled.select("page_id", "host", "path", "rule", "by_rule").join(bad, "host", "left")
    verdict = F.coalesce("by_rule", F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
