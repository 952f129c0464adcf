"""Passes over ordered rows that are cut anywhere, against the windows that aren't, and against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from codeatlas.operators import windows

KIND = "g string, i long, k string, v long"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = [("hot", i, rng.choice(["a", "a", "b", None]), rng.choice([1, 2, None])) for i in range(500)]
    out += [(rng.choice(["x", "y", None]), i, rng.choice("ab"), 1) for i in range(500, 560)] + [("hot", 900 + i, "c", 1) for i in range(300)]
    rng.shuffle(out)
    return spark.createDataFrame(out, KIND)


def both(a, b):
    assert a.columns == b.columns
    return sorted(map(repr, a.collect())), sorted(map(repr, b.collect()))


@pytest.mark.parametrize("partition", [[], ["g"]])
def test_islands(rows, partition):
    order = [F.col("i").desc()]
    plain = windows.islands(rows, partition, order, F.col("k"))
    got, want = both(windows.islands_split(rows, partition, order, F.col("k")), plain)
    assert got == want


def test_numbers(rows):
    got, want = both(windows.numbered_split(rows, ["g"], [F.col("i")], start=0), windows.numbered(rows, ["g"], [F.col("i")], start=0))
    assert got == want
    got = [r.ord for r in windows.numbered_global(rows, [F.col("k").desc(), F.col("i")]).orderBy(F.col("k").desc(), "i").collect()]
    assert got == list(range(1, rows.count() + 1))
    assert "Window" not in windows.numbered_global(rows, [F.col("i")])._jdf.queryExecution().toString()


def test_running(rows):
    b = windows.blocks(rows, ["g"], [F.col("i")])
    assert b.select("_block").distinct().count() > 1 and b.where("g = 'hot'").select("_block").distinct().count() > 1
    w = windows.running(["g"], [F.col("i")])
    for how, f in (("sum", F.sum), ("max", F.max)):
        got, want = both(windows.running_split(b, ["g"], "r", F.col("v"), how).drop("_block", "_pos"), rows.withColumn("r", f("v").over(w)))
        assert got == want


def test_empty(rows):
    none = rows.where("false")
    assert windows.numbered_split(none, ["g"], [F.col("i")]).count() == windows.islands_split(none, [], [F.col("i")], F.col("k")).count() == 0
    assert windows.cooldown(none.withColumn("t", F.current_timestamp()), "g", "t", "i", 60).count() == 0


def fold(requests, seconds):
    last, out = {}, {}
    for key, at, ident in sorted(requests):
        ok = key not in last or last[key] <= at - timedelta(seconds=seconds)
        if ok:
            last[key] = at
        left = last[key] + timedelta(seconds=seconds) - at
        out[key, ident] = (ok, 0 if ok else max(0, -(-left // timedelta(seconds=1))))
    return out


@pytest.mark.parametrize("seconds", [0, 1, 90, 10**6])
def test_cooldown_of_a_hot_key(spark, seconds):
    rng = random.Random(seconds)
    start = datetime(2024, 1, 1)
    requests = [("hot" if rng.random() < 0.8 else rng.choice("abc"), start + timedelta(microseconds=rng.randint(0, 3_000) * 500_000), i) for i in range(700)]
    df = spark.createDataFrame([*requests, ("hot", None, -1), (None, start, -2)], "k string, t timestamp, i long")
    got = {(r.k, r.i): (r.granted, r.remaining) for r in windows.cooldown(df, "k", "t", "i", seconds).collect()}
    assert got == fold(requests, seconds)


@pytest.mark.parametrize("partition", [[], ["g"], ["g", "k"]])
def test_next_reads_rows_once(spark, rows, partition):
    """Rows aren't joined with one another; tasks of no rows, of one row, and ends of partitions at ends of tasks."""
    w = Window.partitionBy(*partition).orderBy("i")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for some in (rows, rows.where("i < 3"), rows.where("i = 1"), rows.where("false")):
            out = windows.next_split(some, partition, [F.col("i")], "v", "after")
            assert "SortMergeJoin" not in out._jdf.queryExecution().toString()
            got, want = both(out, some.withColumn("after", F.lead("v").over(w)))
            assert got == want
            got, want = both(windows.next_split(some, partition, [F.col("i")], "i", "after", ["v"]), some.withColumn("after", F.lead("i").over(w)).select("v", "after"))
            assert got == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_next_by_order_alone(rows):
    some = rows.withColumn("day", F.floor(F.col("i") / 50))
    w = Window.partitionBy("day").orderBy("i")
    got, want = both(windows.next_split(some, ["day"], [F.col("i")], "v", "after", ordered=True), some.withColumn("after", F.lead("v").over(w)))
    assert got == want
