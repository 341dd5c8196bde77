"""URL filter: rules by host and path, and for all other urls a tree of path templates judged by labelled purity."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.llm.common import col
from sondage.session import cut_lineage

# (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
Rule = tuple[str, str, str]
# A segment stays as it is with this many urls and this share of its parent's; others are variable.
MIN_URLS, MIN_SHARE = 10, 0.01
# Branches merge while their share of blocked urls is less than this many standard errors from that of their siblings together.
DIFFERENT = 1.96
# Strength of the prior share, its upper end, and the purity from which a template is rejected.
PRIOR, PRIOR_MOST, REJECT = 5.0, 0.5, 0.8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` with A-Z lower-cased, path up to ``?``, ``#`` or the end; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The rule that fits with the longest host and path, as text, and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def templates(rows: DataFrame) -> DataFrame:
    """(host, shape, template) for the rows (host, shape, n, allow, block): one level of the tree after the other.

    ``shape`` is a path with its digits already made wildcards. Per host and template so far, a rare segment becomes ``*``;
    frequent ones that have labels and whose blocked share does not differ from their siblings' merge into ``+``.

    Below a branch of fewer than ``MIN_URLS`` urls every segment is rare, so its rows leave the loop with the wildcards they
    lack; the loop ends where no crowded branch goes deeper. There is no limit of depth.
    """
    t = cut_lineage(rows.withColumn("parts", F.filter(F.split("shape", "/"), lambda s: s != "")).withColumns({"template": F.lit(""), "crowd": F.lit(MIN_URLS).cast("long")}))
    ended, d = None, 0
    while True:
        left = F.size("parts") - F.lit(d)
        going = (left > 0) & (F.col("crowd") >= MIN_URLS)
        done = t.where(~going).select("host", "shape", "n", "allow", "block", F.concat("template", F.repeat(F.lit("/*"), F.greatest(left, F.lit(0)))).alias("template"))
        ended = done if ended is None else ended.unionByName(done)
        t = t.where(going)
        if t.isEmpty():
            return ended
        t = cut_lineage(_level(t, d))
        d += 1


def _level(t: DataFrame, d: int) -> DataFrame:
    """The rows with the template of their segment ``d`` added and the urls that share it as ``crowd``."""
    t = t.withColumn("seg", F.get("parts", F.lit(d)))
    kids = t.groupBy("host", "template", "seg").agg(*[F.sum(c).alias(c) for c in ("n", "allow", "block")])
    sums = kids.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.sum("allow").alias("all_allow"), F.sum("block").alias("all_block"))
    known = F.col("allow") + F.col("block")
    share = F.col("all_block") / (F.col("all_allow") + F.col("all_block"))
    error = F.sqrt(known * F.greatest(share * (1 - share), F.lit(1e-9)))
    frequent = (F.col("n") >= MIN_URLS) & (F.col("n") >= MIN_SHARE * F.col("all_n"))
    alike = (known > 0) & (F.abs(F.col("block") - known * share) <= DIFFERENT * error)
    made = F.when(~frequent, F.lit("*")).when(alike, F.lit("+")).otherwise(F.col("seg"))
    k = kids.join(sums, ["host", "template"]).select("host", "template", "seg", "n", made.alias("made"))
    crowds = k.groupBy("host", "template", "made").agg(F.sum("n").alias("crowd"))
    k = k.drop("n").join(crowds, ["host", "template", "made"])
    t = t.drop("crowd").join(k, ["host", "template", "seg"])
    return t.select("host", "shape", "n", "allow", "block", "parts", F.concat("template", F.lit("/"), "made").alias("template"), "crowd")


def judge(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) per page.

    Where a rule fits, the longest one decides; its urls are the labelled ones of the tree. Elsewhere a template with a
    smoothed share of blocked urls of ``REJECT`` or more is blocked; templates without labels keep the prior, which
    never blocks. Null urls and urls without ``://`` have an empty host and path and form a template of their own.
    Repeated rows count and are judged each; extra columns are ignored. All of it is counts per host and template,
    partially aggregated, so a host with most of the pages is no task of its own.
    """
    host, path = host_and_path(col(url))
    p = pages.select(col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, kind = longest_rule(F.col("host"), F.col("path"), rules)
    p = p.select("page_id", "host", "path", rule.alias("rule"), kind.alias("kind"), F.regexp_replace("path", "[0-9]+", "{n}").alias("shape"))
    marks = [F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(k) for k in ("allow", "block")]
    tree = templates(p.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), *marks))
    by = tree.groupBy("host", "template").agg(F.sum("allow").alias("a"), F.sum("block").alias("b"))
    total = tree.agg(F.sum("allow"), F.sum("block")).first()
    prior = min(PRIOR_MOST, total[1] / (total[0] + total[1])) if total[0] and total[0] + total[1] else PRIOR_MOST
    by = by.select("host", "template", ((F.col("b") + PRIOR * prior) / (F.col("a") + F.col("b") + PRIOR)).alias("purity"))
    shapes = tree.select("host", "shape", "template").join(by, ["host", "template"])
    found = p.join(shapes, ["host", "shape"])
    return found.select("page_id", "host", "path", "rule", F.coalesce("kind", F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"), "template", "purity")
