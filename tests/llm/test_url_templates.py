"""URL rules and path templates against plain Python, and on odd rows."""

import random
import re
from collections import Counter, defaultdict

import pytest

from codeatlas.llm import url_templates
from codeatlas.llm.queries import URL_RULES

FOLD = {c: c + 32 for c in range(65, 91)}


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(FOLD), re.match(r"[^?#]*", rest[len(host) :], re.S).group()


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute(urls):
    """Verdict and template of every URL."""
    parsed = [parse(u) for u in urls]
    ruled = [rule_of(*x)[1] for x in parsed]
    segments = []
    for _, path in parsed:
        s = [x for x in path.split("/") if x]
        segments.append(s[:3] + (["/".join(s[3:])] if len(s) > 3 else []))
    template = [""] * len(urls)
    for level in range(4):
        count, total = Counter(), Counter()
        for (host, _), s, t in zip(parsed, segments, template):
            if len(s) > level:
                count[host, t, s[level]] += 1
                total[host, t] += 1
        for i, ((host, _), s) in enumerate(zip(parsed, segments)):
            if len(s) > level:
                t, x = template[i], s[level]
                fixed = count[host, t, x] >= 5 and count[host, t, x] * 20 >= total[host, t] and not re.fullmatch(r"[0-9]+|\*", x)
                template[i] = t + "/" + (x if fixed else "*")
    good, bad = Counter(), Counter()
    for (host, _), t, v in zip(parsed, template, ruled):
        good[host, t] += v == "allow"
        bad[host, t] += v == "block"
    kin = defaultdict(list)
    for host, t in set(good):
        tail = re.search(r"((?:/[*])*)\Z", t).group(1)
        kin[host, (re.match(r"(.*/)?[^/]*\Z", t[: len(t) - len(tail)], re.S).group(1) or ""), tail].append((host, t))
    sums = {}
    for family in kin.values():
        b_all = sum(bad[x] for x in family)
        m_all = b_all + sum(good[x] for x in family)
        alike = [x for x in family if good[x] + bad[x] and 100 * (bad[x] * m_all - (good[x] + bad[x]) * b_all) ** 2 <= 384 * (good[x] + bad[x]) * b_all * (m_all - b_all)]
        for x in family:
            sums[x] = (sum(good[y] for y in alike), sum(bad[y] for y in alike)) if x in alike else (good[x], bad[x])
    out = []
    for (host, path), t, v in zip(parsed, template, ruled):
        g, b = sums[host, t]
        out.append((host, path, rule_of(host, path)[0], v or ("block" if (g + 2) * 10 < (g + b + 3) * 4 else "allow"), t, g, b))
    return out


def some_urls(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(900):
        host = rng.choice(["a.example.com", "a.example.com", "B.Example.NET", "example.net", "c.org", "net", "xnet", "d.example.org"])
        depth = rng.randint(0, 6)
        path = "".join("/" + rng.choice(["en", "de", "fr", "de", str(rng.randint(0, 50)), "blog", f"p{rng.randint(0, 9)}.html", "*", ""]) for _ in range(depth))
        out.append(rng.choice(["http://", "https://"]) + host + path + rng.choice(["", "/", "?q=/de/", "#/de/", "/?x"]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_judge_is_the_plain_form(spark, seed):
    urls = some_urls(seed)
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = url_templates.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.template, r.n_good, r.n_bad) for r in got.collect()}
    want = brute(urls)
    assert got == dict(enumerate(want))
    assert {w[3] for w in want if w[2] is None} == {"allow", "block"}  # the method has its own verdicts of both kinds


def test_labels_reject_a_template_and_merge_its_like(spark):
    urls = [f"http://h.test/{s}/{i}" for s in ("spam", "junk", "good", "new") for i in range(30)]
    labels = [(f"http://h.test/{s}/{i}", int(s != "good")) for s in ("spam", "junk", "good") for i in range(10)] + [(None, 1), ("http://h.test/new/1", None)]
    none = spark.createDataFrame([], "host string, path string, verdict string")
    got = url_templates.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), none, spark.createDataFrame(labels, "url string, bad int")).collect()
    verdicts = {(r.template, r.verdict) for r in got}
    assert verdicts == {("/spam/*", "block"), ("/junk/*", "block"), ("/good/*", "allow"), ("/new/*", "allow")}
    assert {r.n_bad for r in got if r.template == "/new/*"} == {0}


def test_odd_rows(spark):
    long = "http://" + "a." * 3000 + "net/" + "x/" * 20_000 + "\n"
    rows = [(1, None, "h", "r"), (1, None, "h", "r"), (None, "http://net/", "h", "r"), (2, "", "h", "r"), (3, "no scheme", None, None), (4, "http://", "h", "r"), (5, long, "h", "r"), (6, "http://NET?x/", "h", "r"), (7, "://net/a/*/*/*/*/b\n", "h", "r")]
    kind = "page_id long, url string, host string, rule string"
    rules = spark.createDataFrame(URL_RULES + [("net", "/", "allow"), (None, "/", "block"), ("x", None, None)], "host string, path string, verdict string")
    got = url_templates.judge(spark.createDataFrame(rows, kind), rules).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("", "", None, "allow")
    assert (by[None].rule, by[None].verdict) == ("net/", "block") and by[5].rule == "net/" and by[5].path.endswith("x/\n")
    assert (by[6].host, by[6].path, by[6].rule) == ("net", "", None) and by[7].template == "/*/*/*/*"
    assert url_templates.judge(spark.createDataFrame([], kind), rules).collect() == []
    assert url_templates.judge(spark.createDataFrame(rows, kind), rules.where("false")).where("rule is not null").count() == 0
