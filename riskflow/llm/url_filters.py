"""URL filters by a tree of path templates (operator 1, DataFrame functions only).

Rules decide first.  The rest is judged by templates: per host the path
segments form a tree; a node with many distinct children, or children that are
numbers, generalises them into a wildcard; sibling branches whose labelled
rates do not differ statistically are merged on every level, with the others of
their parent or among themselves; a template is rejected when its smoothed rate
of bad labels is above a threshold.

Defined cases: a null url or one without ``://`` has empty host and path and is
judged by the empty template; pages without labels count for the shape of the
tree only; several labels of one page all count; repeated rows are judged each;
an empty table gives an empty result.
"""
from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import settle

#: levels of the SQL twin; the operator goes on to the deepest path
DEPTH = 6
#: a node with at least this many distinct children, for at least this share of the distinct paths below them,
#: generalises them; hot children (more rows than PRIOR, and the share of them more than the child at that share
#: of all children has) do not count and stay beside the wildcard
MIN_CHILDREN = 8
CHILD_SHARE = 0.3
#: siblings within this many standard errors of their pooled rate are merged
SIMILAR_Z = 2.0
PRIOR = 20.0
BAD_RATE = 0.5
NUMBER = r"^[0-9]+(\.[A-Za-z][A-Za-z0-9]{0,5})?$"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule (verdict, host, path prefix) that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def _wildcard(seg: Column) -> Column:
    """The wildcard of a segment keeps its extension, so pages and files stay apart."""
    ext = F.regexp_extract(seg, r"(\.[A-Za-z][A-Za-z0-9]{0,5})$", 1)
    return F.concat(F.lit("*"), ext)


def templates(pages: DataFrame) -> DataFrame:
    """pages (with host, path) plus template: the path with generalised segments.

    One level of the tree of distinct paths per round; counts are combined
    before the shuffle, and only the nodes that generalise and their hot
    children are joined back, by (host, prefix).
    """
    paths = settle(pages.groupBy("host", "path").agg(F.count(F.lit(1)).alias("_rows")), "url-paths")
    segs = F.split(F.regexp_replace("path", r"^/", ""), "/")
    d = paths.withColumn("_segs", segs).withColumn("template", F.lit(""))
    deepest = paths.agg(F.max(F.size(segs))).first()[0] or 0
    for depth in range(1, deepest + 1):
        seg = F.get("_segs", F.lit(depth - 1))
        d = d.withColumn("_seg", seg)
        number = F.col("_seg").rlike(NUMBER)
        child = d.filter(F.col("_seg").isNotNull() & (F.col("_seg") != "") & ~number) \
            .groupBy(F.col("host").alias("_wh"), F.col("template").alias("_wt"), F.col("_seg").alias("_ws")) \
            .agg(F.sum("_rows").alias("n"), F.count(F.lit(1)).alias("below"))
        usual = child.groupBy("_wh", "_wt").agg(F.count(F.lit(1)).alias("kinds"), F.percentile("n", F.lit(CHILD_SHARE)).alias("usual")) \
            .filter(F.col("kinds") >= MIN_CHILDREN).drop("kinds")
        child = settle(child.join(usual, ["_wh", "_wt"]).withColumn(
            "_hot", (F.col("n") > PRIOR) & (CHILD_SHARE * F.col("n") > F.col("usual"))), "url-children")
        wide = child.filter("not _hot").groupBy("_wh", "_wt").agg(F.count(F.lit(1)).alias("kinds"), F.sum("below").alias("below")) \
            .filter((F.col("kinds") >= MIN_CHILDREN) & (F.col("kinds") >= CHILD_SHARE * F.col("below"))) \
            .select("_wh", "_wt", F.lit(True).alias("_wide"))
        node = (F.col("host") == F.col("_wh")) & (F.col("template") == F.col("_wt"))
        d = d.join(wide, node, "left").drop("_wh", "_wt")
        d = d.join(child.filter("_hot").select("_wh", "_wt", "_ws", "_hot"), node & (F.col("_seg") == F.col("_ws")), "left") \
            .withColumn("_wide", F.col("_wide") & F.col("_hot").isNull()).drop("_wh", "_wt", "_ws", "_hot")
        token = F.when(F.col("_seg") == "", F.lit("")) \
            .when(number | F.col("_wide"), _wildcard(F.col("_seg"))).otherwise(F.col("_seg"))
        d = d.withColumn("template", F.when(F.col("_seg").isNull(), F.col("template"))
                         .otherwise(F.concat(F.col("template"), F.lit("/"), token))).drop("_wide")
        if depth % 2 == 0 and depth < deepest:
            d = settle(d, "url-level")
            further = d.filter(F.size("_segs") > depth).groupBy("host", "template").agg(F.count(F.lit(1)).alias("n"))
            if further.filter(F.col("n") >= MIN_CHILDREN).isEmpty():  # only numbers can still generalise
                rest = F.transform(F.filter("_segs", lambda x, i: i >= depth),
                                   lambda x: F.concat(F.lit("/"), F.when(x.rlike(NUMBER), _wildcard(x)).otherwise(x)))
                d = d.withColumn("template", F.concat("template", F.array_join(rest, "")))
                break
    return pages.join(d.drop("_segs", "_seg", "_rows"), ["host", "path"])


def _merge_level(d: DataFrame, depth: int) -> DataFrame:
    """d (host, template, branch, labelled, bad) with the sibling branches of one level merged where their rates are alike.

    Siblings differ in one literal segment.  Those near their pooled rate are
    one branch; those above and those below it are pooled anew among
    themselves, until every branch is near the rate of its group.
    """
    at = F.split("branch", "/")
    seg = F.get(at, F.lit(depth))
    literal = F.coalesce((seg != "") & ~seg.startswith("*"), F.lit(False))
    shape = F.array_join(F.transform(at, lambda x, i: F.when(i == depth, F.lit("{}")).otherwise(x)), "/")
    units = d.filter(literal).groupBy("host", "branch").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")) \
        .withColumn("shape", shape).withColumn("mark", F.lit("")).withColumn("open", F.lit(True))
    while True:
        going = units.filter("open")
        pool = going.groupBy("host", "shape", "mark").agg(F.sum("labelled").alias("_lab"), F.sum("bad").alias("_bad"))
        pooled = F.when(F.col("_lab") > 0, F.col("_bad") / F.col("_lab"))
        off = F.coalesce(F.col("bad") / F.greatest(F.col("labelled"), F.lit(1)) - pooled, F.lit(0.0))
        spread = F.coalesce(F.sqrt(pooled * (1 - pooled) / F.greatest(F.col("labelled"), F.lit(1))), F.lit(0.0))
        near = (F.col("labelled") == 0) | (F.abs(off) <= SIMILAR_Z * spread)
        side = F.when(near, F.lit("")).when(off > 0, F.lit("+")).otherwise(F.lit("-"))
        judged = going.join(pool, ["host", "shape", "mark"]).withColumn("_side", side) \
            .select("host", "branch", "labelled", "bad", "shape", F.concat("mark", "_side").alias("mark"), (F.col("_side") != "").alias("open"))
        units = settle(units.filter("not open").unionByName(judged), "url-siblings")
        if units.filter("open").isEmpty():
            break
    # the mark stands in the merged segment, so groups of one parent stay apart on the levels above
    to = F.array_join(F.transform(F.split("shape", "/"), lambda x, i: F.when(i == depth, F.concat(x, F.col("mark"))).otherwise(x)), "/")
    return d.join(units.select("host", "branch", to.alias("_to")), ["host", "branch"], "left") \
        .withColumn("branch", F.coalesce("_to", "branch")).drop("_to")


def template_verdicts(counts: DataFrame, overall: float) -> DataFrame:
    """counts: host, template, n, labelled, bad -> plus branch (merged template), purity, rejected.

    Siblings are merged level by level from the deepest, so merged branches
    are compared as wholes on the levels above.
    """
    d = counts.withColumn("branch", F.col("template"))
    levels = counts.select(F.posexplode(F.split("template", "/")).alias("level", "seg")) \
        .filter((F.col("level") > 0) & (F.col("seg") != "") & ~F.col("seg").startswith("*")).select("level").distinct()
    for depth in sorted((r["level"] for r in levels.collect()), reverse=True):
        d = settle(_merge_level(d, depth), "url-branches")
    merged = d.groupBy("host", "branch").agg(F.sum("labelled").alias("branch_labelled"), F.sum("bad").alias("branch_bad"))
    rate = (F.col("branch_bad") + F.lit(PRIOR * overall)) / (F.col("branch_labelled") + F.lit(PRIOR))
    return d.select("host", "template", "n", "branch").join(merged, ["host", "branch"]) \
        .withColumn("bad_rate", rate).withColumn("rejected", F.col("bad_rate") > BAD_RATE)


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id",
                url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, bad_rate for every page.

    labels: (key, bad) with key equal to page_id.
    """
    host, path = host_path(F.col(url))
    d = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    d = settle(templates(d), "url-templates")
    lab = labels.groupBy(F.col("key").alias("_key")).agg(
        F.count(F.lit(1)).alias("labelled"), F.sum(F.col("bad").cast("long")).alias("bad"))
    counts = d.join(lab, d["page_id"] == lab["_key"], "left").groupBy("host", "template").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    counts = settle(counts, "url-counts")
    total = counts.agg(F.sum("labelled").alias("n"), F.sum("bad").alias("bad")).first()
    overall = (total["bad"] or 0) / total["n"] if total["n"] else 0.0
    seen = settle(template_verdicts(counts, overall), "url-verdicts").select("host", "template", "bad_rate", "rejected")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return d.join(seen, ["host", "template"], "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template", "bad_rate")
