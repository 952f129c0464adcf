"""Quantiles by selection, and pages from an index of blocks."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from codeatlas.operators import ranking


@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_exact_quantile(spark, bins):
    rng = random.Random(bins)
    rows = [("hot", rng.choice([rng.uniform(-5, 5), 1.0, rng.gauss(0, 1e6), 1e-300 * rng.random()])) for _ in range(401)]
    rows += [("one", 3.5), ("two", 1.0), ("two", 2.0), ("same", 7.0), ("same", 7.0), (None, 1.0), (None, -1.0), ("none", None), ("nan", float("nan")), ("wide", 1.7e308), ("wide", -1.7e308), ("wide", 0.0)]
    got = {r.k: r.v for r in ranking.exact_quantile(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", 0.5, bins).collect()}
    groups = {}
    for k, v in rows:
        if v is not None and v == v:
            groups.setdefault(k, []).append(v)
    assert got == {k: statistics.median(v) for k, v in groups.items()}


def test_other_quantiles_are_interpolated(spark):
    df = spark.range(11).select(F.lit("k").alias("k"), (F.col("id") * F.col("id")).alias("v"))
    for q in (0.0, 0.25, 0.9, 1.0):
        want = df.agg(F.percentile("v", q)).first()[0]
        assert abs(ranking.exact_quantile(df, ["k"], "v", q).first().v - want) < 1e-9
    assert ranking.exact_quantile(df.where("false"), ["k"], "v", 0.5).count() == 0


def test_pages_read_their_blocks_only(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("a"), (F.col("id") % 3).alias("b"))
    p = ranking.Pages(df, [F.col("b"), F.col("a").desc()], 30, block_rows=100)
    want = [(r.a, r.b) for r in df.orderBy("b", F.desc("a")).collect()]
    for asked, number in ((1, 1), (4, 4), (34, 34), (99, 34), (-3, 1)):
        page = p.page(asked)
        got = page.orderBy("ord").collect()
        assert [(r.a, r.b) for r in got] == want[(number - 1) * 30 : number * 30] and got[0].ord == (number - 1) * 30 + 1
        assert len({f.split("_part=")[1].split("/")[0] for f in page.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}) <= 2
    scan = p.page(34)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "_part" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert ranking.Pages(df.where("false"), [F.col("a")], 30).page(1).count() == 0
