"""Where the links of a set of pages lead: to a page, to an area (a directory with pages below it), out of the set, or nowhere known.

Pages are the files of a site and links their references. Every link is kept with its place as evidence, and one that can't be resolved is a gap with a reason, not a missing row.

    output/links  resolution=...: page_id, pos, href, kind, target (host and path), hit (the page's or area's path), area (the linking page's directory), reason
    output/areas  level=...: area, n_pages, n_links, n_resolved, n_gaps, n_in (links of other areas that lead to it or its pages)

Both tables are written whole, so a run over the same pages gives the same rows, and one after a failure replaces what was left.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from codeatlas.functions import paths
from codeatlas.operators import resolve

log = logging.getLogger(__name__)

LINKS = "page_id long, pos long, href string, kind string, target string, hit string, area string, reason string, resolution string"
AREAS = "area string, n_pages long, n_links long, n_resolved long, n_gaps long, n_in long, level int"
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"


def _place(url: Column) -> Column:
    """Host and path of a URL as one path: no query, no fragment, no slash at the end."""
    return F.regexp_replace(F.concat(F.lower(F.regexp_extract(url, _URL, 1)), F.regexp_extract(url, _URL, 2)), "/+$", "")


def _kind(href: Column) -> Column:
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.lit("url"))
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit("other"))
        .when(href.startswith("#") | href.startswith("?") | (href == ""), F.lit("self"))
        .when(href.startswith("/"), F.lit("absolute"))
        .when(paths.looks_like_alias(href), F.lit("alias"))
        .otherwise(F.lit("relative"))
    )


def _target(kind: Column, href: Column, page: Column) -> Column:
    """The host and path that a link names, null where it names none."""
    bare = F.regexp_replace(href, "[?#].*$", "")
    host = F.split_part(page, F.lit("/"), F.lit(1))
    return (
        F.when(kind == "url", _place(href))
        .when(kind == "self", page)
        .when(kind == "absolute", F.concat_ws("/", host, F.nullif(paths.normalize(bare), F.lit(""))))
        .when(kind == "relative", F.concat_ws("/", host, F.nullif(paths.normalize(F.concat_ws("/", F.substr(paths.dirname(page), F.length(host) + 2), bare)), F.lit(""))))
    )


def links(pages: DataFrame) -> DataFrame:
    """Links of pages (page_id, url, html) with where they lead. page_id is the table's key; a page without a URL or text has no links."""
    p = pages.select("page_id", _place(F.col("url")).alias("page"), "html")
    href = F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("pos", "href")
    found = p.where("page <> ''").select("page_id", "page", href).withColumn("pos", F.col("pos").cast("long")).withColumn("kind", _kind(F.col("href")))
    found = found.withColumn("target", _target(F.col("kind"), F.col("href"), F.col("page"))).withColumn("area", paths.dirname(F.col("page")))
    page = p.where("page <> ''").select("page")
    known = page.select(F.concat(F.lit("page:"), "page").alias("name")).unionByName(page.select(F.explode(resolve.path_prefixes(F.col("page"))).alias("d")).select(F.concat(F.lit("area:"), "d").alias("name")))
    t = F.col("target")
    tries = F.when(t.isNotNull(), F.array(*[F.concat(F.lit(kind), t, F.lit(end)) for kind, end in (("page:", ""), ("page:", ".html"), ("page:", "/index"), ("area:", ""))]))
    j = resolve.candidate_join(found, tries, known, "name", ["page_id", "pos"])
    host = F.split_part(t, F.lit("/"), F.lit(1))
    hosts = page.select(F.split_part("page", F.lit("/"), F.lit(1)).alias("_host")).distinct().withColumn("_known", F.lit(True))
    j = j.join(hosts, host == F.col("_host"), "left")
    resolution = F.when(F.col("hit").isNotNull(), F.split_part("hit", F.lit(":"), F.lit(1))).when(t.isNotNull() & F.col("_known").isNull(), F.lit("external")).otherwise(F.lit("gap"))
    j = j.withColumn("resolution", resolution)
    reason = F.when(F.col("resolution") != "gap", F.lit(None).cast("string")).when(t.isNotNull(), F.lit("no page or area has this path")).otherwise(F.concat(F.lit("not a path: "), "kind"))
    return j.select("page_id", "pos", "href", "kind", "target", F.substring("hit", 6, 2**30).alias("hit"), "area", reason.alias("reason"), "resolution")


def areas(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Per directory that holds pages: their number, their links by outcome, and the links that lead to it from elsewhere."""
    own = pages.select(_place(F.col("url")).alias("page")).where("page <> ''").groupBy(paths.dirname(F.col("page")).alias("area")).agg(F.count(F.lit(1)).alias("n_pages"))
    out = found.groupBy("area").agg(F.count(F.lit(1)).alias("n_links"), F.count("hit").alias("n_resolved"), F.count_if(F.col("resolution") == "gap").alias("n_gaps"))
    to = F.when(F.col("resolution") == "area", F.col("hit")).otherwise(paths.dirname(F.col("hit")))
    came = found.where("hit is not null").withColumn("to", to).where("to <> area").groupBy(F.col("to").alias("area")).agg(F.count(F.lit(1)).alias("n_in"))
    a = own.join(out, "area", "left").join(came, "area", "left").fillna(0, ["n_links", "n_resolved", "n_gaps", "n_in"])
    return a.withColumn("level", F.size(F.filter(F.split("area", "/"), lambda s: s != "")))


def _write(df: DataFrame, path: str, by: str) -> int:
    seen = Observation()
    df.hint("rebalance", by).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy(by).parquet(path)
    return seen.get["n"]


def run(spark: SparkSession, input: str, output: str) -> dict:
    """Reads pages, writes both tables, and returns how many rows were read and written."""
    output = output.rstrip("/")
    pages = spark.read.parquet(input)
    n = pages.count()
    log.info("read %d pages from %s", n, input)
    n_links = _write(links(pages), f"{output}/links", "resolution")
    n_areas = _write(areas(pages, spark.read.schema(LINKS).parquet(f"{output}/links")), f"{output}/areas", "level")
    log.info("wrote %d links and %d areas to %s", n_links, n_areas, output)
    return {"pages": n, "links": n_links, "areas": n_areas}


def read_links(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(LINKS).parquet(f"{output.rstrip('/')}/links")


def read_areas(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(AREAS).parquet(f"{output.rstrip('/')}/areas")


if __name__ == "__main__":
    from jobs import _cli

    _cli.main("site_links", __doc__.split("\n")[0], run, {"input": str, "output": str})
