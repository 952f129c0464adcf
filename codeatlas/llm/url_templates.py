"""URL filters: rules of (host, path prefix), and for all other URLs a tree of path templates per host, judged by labelled purity.

Only DataFrame functions. Rows are counted per (host, path) first; everything after works on these counts.

* A rule fits its host and all subdomains if the path starts with the rule's; the longest rule (host and path together) wins. Of rules with the same host and path a
  blocking one wins. Lookups are equi-joins: host suffixes of as many labels as rules have, and path prefixes of the lengths that a rule host has.
* The tree is grown level by level. Below a node a segment stays as it is if it has at least MIN_ROWS rows and a SHARE-th of the node's; rarer ones, numbers and '*' become the
  wildcard '*'. So a node has at most SHARE children besides it. Level DEPTH holds the rest of the path as one segment: nothing is left out.
* Siblings are templates that differ in their last fixed segment only. Those whose share of bad labels doesn't differ from the siblings' pooled share (a chi-square test at 95%)
  are merged into one class. A sibling without labels isn't merged with labelled ones: missing labels are no evidence.
* A class is rejected if (good + 2) / (good + bad + 3), its share of good labels smoothed by a prior of three labels, is below 0.4.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, materialize, maybe_broadcast

DEPTH, MIN_ROWS, SHARE = 4, 5, 20
#: The prior's good labels and all its labels; purity below LEAST tenths is rejected; the test's bound in hundredths.
PRIOR_GOOD, PRIOR_ALL, LEAST, CHI_SQUARE = 2, 3, 4, 384


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first '://' and '/', '?', '#' or the end, A-Z lower-cased, and what follows up to '?', '#' or the end. Both are empty without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (distinct host, path, ...) with `rule` (host and path of the longest rule that fits, or null) and `ruled` (its verdict). rules (host, path, verdict)."""
    given = materialize(
        rules.select(F.lower("host").alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict").where("rule_host is not null and verdict is not null")
        .groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("ruled")), "rules",
    )
    n, labels = given.agg(F.count(F.lit(1)), F.max(F.size(F.split("rule_host", "[.]")))).first()
    if not n:
        return urls.withColumn("rule", F.lit(None).cast("string")).withColumn("ruled", F.lit(None).cast("string"))
    lengths = maybe_broadcast(given.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths")), n)
    parts = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    asked = urls.select("host", "path", F.explode(suffixes).alias("rule_host")).join(lengths, "rule_host")
    asked = asked.select("host", "path", "rule_host", F.explode("lengths").alias("k")).where("k <= length(path)").withColumn("rule_path", F.expr("substring(path, 1, k)"))
    found = asked.join(maybe_broadcast(given, n), ["rule_host", "rule_path"])
    size = F.length("rule_host") + F.length("rule_path")
    best = found.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "ruled"), F.struct(size, F.length("rule_host"))).alias("b"))
    return urls.join(best, ["host", "path"], "left").withColumn("rule", F.col("b.rule")).withColumn("ruled", F.col("b.ruled")).drop("b")


def grow(urls: DataFrame) -> DataFrame:
    """urls (host, path, n, good, bad, ...) with `template`. Each level is written to the shared folder."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    last = F.when(F.size(parts) >= DEPTH, F.array_join(F.slice(parts, DEPTH, F.greatest(F.size(parts), F.lit(1))), "/"))
    u = urls.withColumn("template", F.lit(""))
    for level in range(1, DEPTH + 1):
        segment = last if level == DEPTH else F.get(parts, F.lit(level - 1))
        u = u.withColumn("_s", segment)
        rows = u.where("_s is not null").groupBy("host", "template", "_s").agg(F.sum("n").alias("c"))
        total = u.where("_s is not null").groupBy("host", "template").agg(F.sum("n").alias("total"))
        fixed = rows.where((F.col("c") >= MIN_ROWS) & ~F.col("_s").rlike(r"^([0-9]+|\*)\z")).join(total, ["host", "template"]).where(F.col("c") * SHARE >= F.col("total"))
        fixed = materialize(fixed.select("host", "template", "_s", F.lit(True).alias("_fixed")), "fixed")
        grown = u.join(maybe_broadcast(fixed, fixed.count()), ["host", "template", "_s"], "left")
        step = F.when(F.col("_s").isNull(), F.lit("")).when(F.col("_fixed"), F.concat(F.lit("/"), "_s")).otherwise(F.lit("/*"))
        before, u = u, materialize(grown.withColumn("template", F.concat("template", step)).drop("_s", "_fixed"), "grown")
        discard(before, fixed)
    return u


def classes(grown: DataFrame) -> DataFrame:
    """(host, template, n_good, n_bad, rejected): of the class that a template belongs to after merging siblings. A node has at most SHARE + 1 siblings of one form."""
    t = grown.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    tail = F.regexp_extract("template", r"((?:/[*])*)\z", 1)
    t = t.withColumn("_tail", tail).withColumn("_head", F.expr("substring(template, 1, length(template) - length(_tail))"))
    t = t.withColumn("_parent", F.regexp_extract("_head", r"^(.*/)?[^/]*\z", 1))
    kin = ["host", "_parent", "_tail"]
    w = Window.partitionBy(*kin)
    labelled, double = F.col("good") + F.col("bad"), lambda c: c.cast("double")
    b, m, all_b, all_m = double(F.col("bad")), double(labelled), double(F.sum("bad").over(w)), double(F.sum(labelled).over(w))
    gap = b * all_m - m * all_b
    t = t.withColumn("_like", (labelled > 0) & (F.lit(100.0) * gap * gap <= F.lit(float(CHI_SQUARE)) * m * all_b * (all_m - all_b)))
    pool = Window.partitionBy(*kin, "_like")
    pooled = lambda c: F.when(F.col("_like"), F.sum(c).over(pool)).otherwise(F.col(c))
    t = t.select("host", "template", pooled("good").alias("n_good"), pooled("bad").alias("n_bad"))
    return t.withColumn("rejected", (F.col("n_good") + PRIOR_GOOD) * 10 < (F.col("n_good") + F.col("n_bad") + PRIOR_ALL) * LEAST)


def judge(pages: DataFrame, rules: DataFrame, labels: DataFrame | None = None, ident: str = "page_id", url: str = "url") -> DataFrame:
    """(ident, host, path, rule, verdict, template, n_good, n_bad), a row per row of pages.

    verdict: the rule's, else 'block' where the class of the URL's template is rejected, else 'allow'. rules (host, path, verdict). labels (url, bad), where given, are further
    labelled URLs; each URL of pages that a rule fits is one, too, once for each of its rows.

    A null url, or one without '://', has an empty host and path. Missing ids, repeated rows and very long URLs (host, path and query of any length) are rows like others; columns
    of pages other than the two named are not returned, so none can clash. An empty table gives an empty one.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(ident).alias("_id"), host.alias("host"), path.alias("path"))
    seen = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    u = match_rules(seen, rules)
    count = lambda v: F.when(F.col("ruled") == v, F.col("n")).otherwise(F.lit(0))
    u = u.withColumn("good", count("allow")).withColumn("bad", count("block"))
    if labels is not None:
        lh, lp = host_and_path(F.col("url"))
        told = labels.where("bad is not null").groupBy(lh.alias("host"), lp.alias("path")).agg(F.count_if(F.col("bad") == 0).alias("_g"), F.count_if(F.col("bad") != 0).alias("_b"))
        u = u.join(told, ["host", "path"], "left").withColumn("good", F.col("good") + F.coalesce("_g", F.lit(0))).withColumn("bad", F.col("bad") + F.coalesce("_b", F.lit(0))).drop("_g", "_b")
    u = grow(materialize(u, "urls"))
    judged = u.join(classes(u), ["host", "template"])
    verdict = F.coalesce("ruled", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    judged = judged.select("host", "path", "rule", verdict.alias("verdict"), "template", "n_good", "n_bad")
    return rows.join(judged, ["host", "path"]).select(F.col("_id").alias(ident), "host", "path", "rule", "verdict", "template", "n_good", "n_bad")
