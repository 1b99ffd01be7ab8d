"""URL filter with redirect equivalence.

A url has the verdict of its longest fitting rule. A url without one takes the
verdict of its aliases: redirects and canonical links are edges between urls, and the
connected components of that graph share a decision, an explicit allow of any member
before an explicit block. Nothing known: allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii
from .components import connected

ALLOW, BLOCK = "allow", "block"

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"

CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?\s*[0-9.]*\s*;\s*url\s*=\s*["']?([^"'\s>]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path). The host is what stands after the first ``://`` up to ``/``,
    ``?``, ``#`` or the end, A-Z in lower case; the path follows up to ``?``, ``#`` or
    the end. Both are empty without ``://``."""
    host = lower_ascii(F.regexp_extract(url, URL, 1))
    path = F.regexp_extract(url, URL, 2)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Rules are
    (verdict, host, path); they are a parameter, so they are part of the plan."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0]))  # allow before block
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): the page's url and all it redirects or canonically links to. Only
    absolute targets name a url; others and links to itself are no edges."""
    targets = F.concat(*[F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1)) for pattern in (CANONICAL, REFRESH)])
    marked = F.col(html).rlike("(?i)canonical|http-equiv")  # most pages stop here
    found = pages.where(F.col(url).isNotNull() & marked).select(F.col(url).alias("src"), F.explode(targets).alias("dst"))
    return found.where((F.instr("dst", "://") > 0) & (F.col("src") != F.col("dst"))).distinct()


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    edges: DataFrame | None = None,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A null or malformed url has empty host and path, no rule and the verdict allow.
    Rows may repeat; each gets its own row. ``edges`` (src, dst) may add redirects
    from elsewhere, such as a crawl log. Only urls that are part of an edge enter the
    component search; all others are judged where they lie."""
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("__url"), F.col(html).alias("__html"))
    links = alias_edges(own, "__url", "__html")
    if edges is not None:
        given = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst")
        links = links.unionByName(given).distinct()
    member = connected(links)  # (node, component)

    def ruled(df: DataFrame) -> DataFrame:
        host, path = split_url(F.col("__url"))
        df = df.withColumns({"host": host, "path": path})
        rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
        return df.withColumns({"rule": rule, "__own": verdict})

    judged = ruled(member.withColumnRenamed("node", "__url"))
    shared = judged.groupBy("component").agg(
        F.when(F.max(F.col("__own") == ALLOW), ALLOW).when(F.max(F.col("__own") == BLOCK), BLOCK).alias("__shared")
    )
    decided = judged.join(shared, "component").select("__url", "__shared").where("__shared is not null")
    out = ruled(own.drop("__html")).join(decided, "__url", "left")
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("__own", "__shared", F.lit(ALLOW)).alias("verdict")
    )
