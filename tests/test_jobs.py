"""The jobs on copies of the given tables: growing input, late and repeated events, failures between steps, command lines."""

import glob
import json
import os
import subprocess
import sys
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from jobs import history, site_links

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@data
def test_history_of_growing_input(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    to, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    late = F.col("event_id") % 3 == 0  # of the same days and users
    events.where(~late).repartition(2).write.parquet(to)
    first = history.run(spark, to, out, mark, files_per_batch=1)
    assert first["batches"] == 2 and first["read"] == events.where(~late).count()
    assert rows(history.read_entries(spark, out)) == rows(history.entries(events.where(~late).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))).select(*history.read_entries(spark, out).columns))
    odd = spark.createDataFrame([(None, datetime(2024, 1, 1), 1), (10**9, None, 1), (10**9, datetime(2024, 1, 1), None)], "event_id long, ts timestamp, user_id long")
    odd = odd.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    events.where(late).unionByName(odd).coalesce(1).write.mode("append").parquet(to)
    events.where("event_id < 20").coalesce(1).write.mode("append").parquet(to)  # again
    second = history.run(spark, to, out, mark)
    assert second["read"] == events.where(late).count() + 3 + events.where("event_id < 20").count() and second["rejected"] == 3
    whole = rows(history.read_entries(spark, out))
    assert whole == rows(history.entries(events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))).select(*history.read_entries(spark, out).columns))
    assert history.run(spark, to, out, mark) == {"batches": 0, "read": 0, "rejected": 0, "entries": 0}
    # a run that fails after its writes and before its commit is run again
    last = max(glob.glob(f"{mark}/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
    os.remove(last)
    os.remove(f"{mark}/commits/.{os.path.basename(last)}.crc")
    again = history.run(spark, to, out, mark)
    assert again["batches"] == 1 and rows(history.read_entries(spark, out)) == whole
    assert spark.read.parquet(f"{out}/rejected").count() == 3


@data
def test_history_after_a_failure(spark, tmp_path, monkeypatch):
    to, out, mark = f"{SF}/event[s].parquet", f"{tmp_path}/out", f"{tmp_path}/mark"
    plain = history.entries

    def fails(events):
        raise OSError("lost")

    monkeypatch.setattr(history, "entries", fails)
    with pytest.raises(Exception, match="lost"):
        history.run(spark, to, out, mark)
    monkeypatch.setattr(history, "entries", plain)
    assert history.run(spark, to, out, mark)["read"] == 1000 and spark.read.parquet(f"{out}/events").count() == 1000
    assert history.read_entries(spark, out).agg(F.sum("n_events")).first()[0] == 1000


@data
def test_history_reads_only_the_days_touched(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    to, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    events.coalesce(1).write.parquet(to)
    history.run(spark, to, out, mark)
    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{out}/entries/day=*/*.parquet")}
    before = files()
    day = events.agg(F.min(F.date_format("ts", "yyyy-MM-dd"))).first()[0]
    events.where(F.date_format("ts", "yyyy-MM-dd") == day).limit(3).withColumn("event_id", F.col("event_id") + 10**6).coalesce(1).write.mode("append").parquet(to)
    history.run(spark, to, out, mark)
    changed = {f for f, t in files().items() if before.get(f) != t} | (set(before) - set(files()))
    assert changed and all(f"day={day}" in f for f in changed)


def test_links_of_every_kind(spark, tmp_path):
    html = "".join(f'<a href="{h}">x</a>' for h in ("/en/2", "./2?q", "../en/2.html#t", "/en", "b", "http://OTHER.test/en/9/", "http://else.test/", "mailto:a@b", "#top", "@/x", "/no/where", ""))
    pages = [(1, "https://Site.test/en/1", html), (2, "https://site.test/en/2.html", None), (3, "http://other.test/en/9", 'href="/en/9"'), (4, None, html), (5, "no url", html), (6, "https://site.test/fr/b/index", 'href="/en/2" href="/fr/b"')]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        done = site_links.run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    got = {(r.page_id, r.pos): (r.kind, r.resolution, r.hit, r.reason) for r in site_links.read_links(spark, f"{tmp_path}/out").collect()}
    nowhere = "no page or area has this path"
    assert done == {"pages": 6, "links": len(got), "areas": 3}
    assert [got[1, i] for i in range(12)] == [
        ("absolute", "page", "site.test/en/2.html", None), ("relative", "page", "site.test/en/2.html", None), ("relative", "page", "site.test/en/2.html", None), ("absolute", "area", "site.test/en", None),
        ("relative", "gap", None, nowhere), ("url", "page", "other.test/en/9", None), ("url", "external", None, None), ("other", "gap", None, "not a path: other"), ("self", "page", "site.test/en/1", None),
        ("alias", "gap", None, "not a path: alias"), ("absolute", "gap", None, nowhere), ("self", "page", "site.test/en/1", None),
    ]
    assert got[6, 1] == ("absolute", "page", "site.test/fr/b/index", None) and {k[0] for k in got} == {1, 3, 6}
    areas = {r.area: (r.n_pages, r.n_links, r.n_resolved, r.n_gaps, r.n_in) for r in site_links.read_areas(spark, f"{tmp_path}/out").collect()}
    assert areas == {"site.test/en": (2, 12, 7, 4, 1), "other.test/en": (1, 1, 1, 0, 1), "site.test/fr/b": (1, 2, 2, 0, 0)}


@data
def test_empty_pages(spark, tmp_path):
    spark.read.parquet(f"{SF}/pages.parquet").where("false").write.parquet(f"{tmp_path}/in")
    assert site_links.run(spark, f"{tmp_path}/in", f"{tmp_path}/out") == {"pages": 0, "links": 0, "areas": 0}


@data
def test_command_line(tmp_path):
    config = tmp_path / "job.json"
    config.write_text(json.dumps({"input": f"{SF}/event[s].parquet", "output": f"{tmp_path}/other"}))
    command = [sys.executable, "-m", "jobs.history", "--config", str(config), "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark"]
    done = subprocess.run(command, cwd=ROOT, capture_output=True, text=True, timeout=240, check=True)
    assert "read 1000 events in 1 batches, rejected 0" in done.stderr and glob.glob(f"{tmp_path}/out/entries/day=*") and not os.path.exists(f"{tmp_path}/other")


def test_sample_configs_fit_the_jobs():
    import inspect

    for job in (history, site_links):
        with open(f"{ROOT}/jobs/{job.__name__.split('.')[1]}.json") as f:
            assert set(json.load(f)) <= set(inspect.signature(job.run).parameters)


def test_jobs_use_nothing_of_the_other_part():
    for path in [*glob.glob(f"{ROOT}/jobs/*.py"), __file__]:
        with open(path) as f:
            imports = [line for line in f if line.lstrip().startswith(("import ", "from "))]
        assert not [line for line in imports if "llm" in line or "corpus_pipeline" in line]
