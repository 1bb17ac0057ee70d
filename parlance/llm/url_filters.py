"""URL filters: host and path rules, and a tree of path templates per host judged by labelled purity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (verdict, rule): a rule is a host and a path that begins with "/".
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
WILD = "*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; '' for null or no "://"."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(1 << 30)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; '' for null or no "://"."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(1 << 30)))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (struct of length, rule, verdict) that fits, else null.

    A rule fits its host and all subdomains of it if the path starts with the rule's path. Of equal
    rules the last by code point, then by verdict, wins.
    """
    given = F.array(
        *[
            F.struct(F.lit(len(r)).alias("length"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r.split("/", 1)[0]).alias("host"), F.lit("/" + r.split("/", 1)[1]).alias("path"))
            for v, r in rules
        ]
    )
    fits = lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"])
    return F.array_max(F.filter(given, fits))


def shape(segment: Column) -> Column:
    """A segment with its variable parts named: numbers, hex strings and dates become wildcards of their kind."""
    hexed = F.regexp_replace(segment, r"\b(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{8,}\b", "{hex}")
    return F.regexp_replace(hexed, r"[0-9]+", "{n}")


def templates(urls: DataFrame, depth: int = 6, many: int = 24, unlike: float = 0.25) -> DataFrame:
    """The template of each (host, path): segments that vary become wildcards.

    Level by level from the root, each host's branches are counted by the template so far and the next
    segment. A segment becomes "*" where its parent has more than ``many`` different branches and the
    segment has no more than its even share, or where its branch merges: the branches of a parent that
    have similar statistics - the kinds of what follows them and their labelled share differ from the
    parent's pooled ones by at most ``unlike`` in total variation - are one. A branch is held against
    the pool, never against each other branch, so the work is linear in the branches. Where a branch
    or the pool has no labels the kinds alone tell, so labels reach branches without any. What lies below
    ``depth`` segments is told apart by its kinds and never merged. ``urls``: host, path, label (1 to reject, 0 to keep, null unknown).

    Counts are taken over distinct (host, path, label) with their numbers, and summed before they are
    shuffled; a host with a third of all rows is as many groups as it has branches.
    """
    paths = urls.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("label").alias("known"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
    parts = F.split(F.col("path"), "/")
    kinds = F.transform(F.slice(parts, 2, depth), shape)
    # What lies deeper is one last part, so paths that differ there only stay apart.
    kinds = F.when(F.size(parts) - 1 > depth, F.array_append(kinds, F.array_join(F.transform(F.slice(parts, depth + 2, F.size(parts)), shape), "/"))).otherwise(kinds)
    at = written(paths.withColumn("kinds", kinds).withColumn("template", F.lit("")), "url-paths")
    for level in range(depth):
        here = at.withColumn("segment", F.get("kinds", F.lit(level))).withColumn("next", F.coalesce(F.get("kinds", F.lit(level + 1)), F.lit("$")))
        follow = here.filter(F.col("segment").isNotNull()).groupBy("host", "template", "segment", "next").agg(*[F.sum(c).alias(c) for c in ("n", "known", "bad")])
        branch = follow.groupBy("host", "template", "segment").agg(*[F.sum(c).alias(c) for c in ("n", "known", "bad")])
        pool = branch.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.sum("known").alias("all_known"), F.sum("bad").alias("all_bad"), F.count("*").alias("branches"))
        pooled = follow.groupBy("host", "template", "next").agg(F.sum("n").alias("pool_n"))
        key = ["host", "template"]
        # Total variation between a branch's kinds and the pool's: 1 - the sum of the smaller shares.
        common = follow.join(pooled, [*key, "next"]).join(branch.select(*key, "segment", F.col("n").alias("branch_n")), [*key, "segment"]).join(pool.select(*key, "all_n"), key)
        common = common.groupBy(*key, "segment").agg(F.sum(F.least(F.col("n") / F.col("branch_n"), F.col("pool_n") / F.col("all_n"))).alias("common"))
        judged = branch.join(pool, key).join(common, [*key, "segment"])
        rate = F.abs(F.col("bad") / F.nullif(F.col("known"), F.lit(0)) - F.col("all_bad") / F.nullif(F.col("all_known"), F.lit(0)))
        alike = (F.col("branches") > 1) & (1 - F.col("common") <= unlike) & F.coalesce(rate <= unlike, F.lit(True))
        fan = (F.col("branches") > many) & (F.col("n") * F.col("branches") <= F.col("all_n"))
        # Only the branches that merge are carried to their paths; a hot host is as many rows here as it has such branches.
        wild = written(judged.filter(F.coalesce(alike | fan, F.lit(False))).select(*key, "segment", F.lit(WILD).alias("as")), f"url-wild{level}")
        grown = F.when(F.col("segment").isNotNull(), F.concat(F.col("template"), F.lit("/"), F.coalesce("as", "segment"))).otherwise(F.col("template"))
        at = written(here.join(wild, [*key, "segment"], "left").select("host", "path", "n", "known", "bad", "kinds", grown.alias("template")), f"url-level{level}")
        if at.filter(F.size("kinds") > level + 1).isEmpty():
            break
    deeper = F.get("kinds", F.lit(depth))
    whole = F.when(deeper.isNotNull(), F.concat(F.col("template"), F.lit("/"), deeper)).otherwise(F.col("template"))
    return at.select("host", "path", whole.alias("template"), "n", "known", "bad")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labels: DataFrame | None = None, reject: float = 0.6, weight: float = 2.0, prior: float = 0.1, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """A verdict for each row of ``pages``: page_id, host, path, rule, template, purity, verdict.

    A rule that fits decides. Other pages are judged by their template's labelled purity, the share of
    rejected ones among its labelled pages, smoothed by ``weight`` pages at ``prior``; templates at or
    above ``reject`` are rejected. Labels are ``labels`` (page_id, label: 1 reject, 0 keep; a page
    with several takes the largest), and for pages without one the verdict of the rule that fits.
    Templates without labels have the purity of the prior and are kept. Null urls and those without
    "://" have empty host and path, fit no rule and share one template. Rows of one page_id are judged
    one by one. Other columns are not used or returned.
    """
    fit = matched_rule(F.col("host"), F.col("path"), rules)
    seen = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn("fit", fit)
    by_rule = F.when(F.col("fit").isNotNull(), (F.col("fit.verdict") == "block").cast("int"))
    if labels is None:
        known = seen.withColumn("label", by_rule)
    else:
        given = labels.groupBy(F.col("page_id").alias("_id")).agg(F.max("label").cast("int").alias("_label"))
        known = seen.join(given, seen["page_id"] == given["_id"], "left").withColumn("label", F.coalesce(F.col("_label"), by_rule)).drop("_id", "_label")
    found = templates(known.select("host", "path", "label"))
    rate = (F.col("bad") + F.lit(weight * prior)) / (F.col("known") + F.lit(weight))
    purity = found.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("known").alias("known")).select("host", "template", rate.alias("purity"))
    # One row for each different (host, path).
    judged = found.select("host", "path", "template").join(purity, ["host", "template"])
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return seen.join(judged, ["host", "path"]).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
