"""URL verdicts from rules, and from trust and distrust spread over links between hosts."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from geolattice.session import written

#: (verdict, rule); a rule is a host and the start of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty where the url is null or has no `://`."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _fits(host: Column, path: Column, rule: str) -> Column:
    name, _, start = rule.partition("/")
    return ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))


def ranked(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-9) -> DataFrame:
    """Personalised PageRank: `edges` (src, dst, n), `seeds` (host, weight above 0); returns host, rank of the hosts reached.

    Ranks start from the seeds, scaled to sum 1. In each round a host passes `damping` of its rank along its links, by their
    numbers; the rest, and what hosts without links hold, goes back to the seeds. Rounds end when the ranks move by less than `tolerance`
    in sum, which the damping brings about on any graph. No seeds give no rows.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    total = seeds.agg(F.sum("weight").alias("total"))
    start = written(seeds.crossJoin(F.broadcast(total)).select("host", (F.col("weight") / F.col("total")).alias("s")), "seeds")   # one row
    shares = written(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")), "shares")
    rank = start.select("host", F.col("s").alias("rank"))
    while True:
        passed = (shares.join(rank, F.col("src") == F.col("host")).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share") * damping).alias("got")))
        passed = written(passed, "passed")
        back = 1.0 - (passed.agg(F.sum("got")).first()[0] or 0.0)
        new = written(passed.join(start, "host", "full").select("host", (F.coalesce("got", F.lit(0.0)) + F.coalesce("s", F.lit(0.0)) * back).alias("rank")), "rank")
        moved = new.join(rank.select("host", F.col("rank").alias("was")), "host", "full").agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0]
        rank = new
        if (moved or 0.0) < tolerance:
            return rank


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 1.0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Allow or block every url.

    The longest rule that fits decides (`rule`, `verdict`). Every other page gets the verdict of its host: pages under an
    allow rule make their host trusted, pages under a block rule make it distrusted. Trust runs along the links between hosts, from
    a page's host to those it names; distrust runs against them, to hosts that link to distrusted ones. A host is
    blocked if its distrust is above `threshold` times its trust, so a host that neither reaches is allowed.

    Returns page_id, host, path, rule, verdict, trust, distrust, one row per input row. Defined cases: a null url, or one
    without `://`, has an empty host and path, no rule and verdict allow; links within a host and null html give no edges; repeated rows count each time.

    Scale: pages become counts per host and per pair of hosts before any shuffle; only those are ranked. Page rows meet their host's
    verdict in one join, whose hot host Spark can split as both sides are dealt out for it.
    """
    host, path = url_parts(F.col(url_col))
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    seen = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    fits = [(_fits(F.col("host"), F.col("path"), rule), verdict, rule) for verdict, rule in ordered]
    pick = lambda i: F.coalesce(*[F.when(f[0], F.lit(f[i])) for f in fits], F.lit(None).cast("string"))
    seen = seen.select("page_id", "host", "path", pick(2).alias("rule"), pick(1).alias("ruled"), "html")
    links = F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))
    linked = seen.where("host <> ''").select("host", F.explode(links).alias("dst")).select(F.col("host").alias("src"), F.translate(F.regexp_replace("dst", r"^.*@|:\d*$", ""), _UPPER, _LOWER).alias("dst"))
    edges = written(linked.where("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")), "edges")
    seeds = written(seen.where("host <> '' and ruled is not null").groupBy("host", "ruled").agg(F.count(F.lit(1)).alias("weight")), "seeds")
    trust = ranked(edges, seeds.where("ruled = 'allow'").select("host", "weight"))
    distrust = ranked(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), seeds.where("ruled = 'block'").select("host", "weight"))
    scores = trust.select("host", F.col("rank").alias("trust")).join(distrust.select("host", F.col("rank").alias("distrust")), "host", "full")
    scores = written(scores.select(F.col("host").alias("h"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "hosts")
    judged = seen.drop("html").join(scores, F.col("host") == F.col("h"), "left")
    by_host = F.when(F.coalesce(F.col("distrust") > threshold * F.col("trust"), F.lit(False)), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
