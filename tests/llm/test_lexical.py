"""Ranked search against plain Python: treaps, pruned search, and the whole operator."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from codeatlas.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    N = sum(1 for _, b in bags if b)
    L = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    for i, ts in asked.items():
        found = []
        for d, b in bags:
            m = 10 + (90 * sum(b.values()) * N) // L if L else 0
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t in ts if b[t])
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def collection(seed, n=700):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 14))) for _ in range(150)]
    pick = lambda m: " ".join(words[min(int(rng.expovariate(0.04)), 149)].upper() if rng.random() < 0.1 else words[min(int(rng.expovariate(0.04)), 149)] for _ in range(m))
    docs = [(i * 3, pick(rng.choice([3, 20, 60, 200]))) for i in range(n)]
    docs += [(5, docs[4][1]), (5, docs[4][1]), (7, docs[4][1]), (None, docs[4][1]), (11, None), (12, ""), (13, "...")]
    items = [(i, pick(rng.randint(1, 40))) for i in range(25)] + [(25, docs[4][1]), (25, "zzz"), (26, None), (27, "never-seen"), (None, words[0])]
    return docs, items


@pytest.mark.parametrize("block", [30_000, 10**9])
def test_rank_is_the_plain_form(spark, monkeypatch, block):
    docs, items = collection(block)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = lexical.rank(d, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items)


def test_queries_in_several_passes(spark, monkeypatch):
    docs, items = collection(3, 60)
    monkeypatch.setattr(lexical, "QUERY_BYTES", 500)
    got = lexical.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items)


def test_treaps_are_search_trees_and_heaps():
    rng = np.random.default_rng(1)
    lists = [np.sort(rng.choice(5000, n, replace=False)) for n in (1, 0, 400, 3, 900, 0)]
    first = np.cumsum([0, *map(len, lists)])
    doc = np.concatenate(lists)
    impact = np.concatenate([rng.integers(0, 5, first[3]), np.arange(first[-1] - first[3])])
    left, right, root = lexical.treaps(doc, impact, first)
    for t in range(len(lists)):
        walked, stack = [], [(root[t], 0, 5000, None)]
        while stack:
            v, lo, hi, top = stack.pop()
            if v == len(doc):
                continue
            assert first[t] <= v < first[t + 1] and lo <= doc[v] < hi and (top is None or impact[v] <= top)
            walked.append(v)
            stack += [(left[v], lo, doc[v], impact[v]), (right[v], doc[v] + 1, hi, impact[v])]
        assert sorted(walked) == list(range(first[t], first[t + 1]))


def test_search_skips_most_documents(monkeypatch):
    rng = np.random.default_rng(2)
    n = 20_000
    doc, term, tf = [], [], []
    for t in range(8):
        d = np.sort(rng.choice(n, 40 * 2**t, replace=False))
        doc.append(d), term.append(np.full(len(d), t)), tf.append(rng.geometric(0.3, len(d)))
    block = lexical.Block(*map(np.concatenate, (doc, term, tf)), np.full(n, 100), 8)
    weight = (np.arange(8)[::-1] + 1) * 500
    scored = []
    plain = lexical.Block.scores
    monkeypatch.setattr(lexical.Block, "scores", lambda self, d, w: (scored.append(len(d)), plain(self, d, w))[1])
    docs, score = block.search(np.arange(8), weight, 10, 1)
    everything = plain(block, np.arange(n), weight)
    by = np.lexsort((np.arange(n), -everything))[:10]
    assert docs.tolist() == by.tolist() and score.tolist() == everything[by].tolist()
    assert sum(scored) < n // 4


def test_terms_and_vocabulary():
    texts = ["Ab12 ÉÇ_x\x7f日本.z", None, "", "AB12", "abcdefgh1 abcdefgh2 abcdefgh", "-", "x"]
    row, start, size, data = lexical.occurrences(pa.array(texts).slice(0))
    got = [(int(r), data[s : s + n].tobytes().decode()) for r, s, n in zip(row, start, size)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in terms(t)]
    v = lexical.Vocabulary([b"abcdefgh1", b"abcdefgh3", b"x", b"ab12", "é".encode()])
    found = v.find(start, size, data)
    assert [(w, int(f)) for (_, w), f in zip(got, found) if f >= 0] == [("ab12", 3), ("x", 2), ("ab12", 3), ("abcdefgh1", 0), ("x", 2)]


def test_odd_tables(spark):
    d, q = "doc_id int, text string, score long, rank int", "item_id string, text string, rank int"
    docs = spark.createDataFrame([(1, "a " * 400_000, 1, 1), (2, "a b", 1, 1), (None, None, 1, 1)], d)
    items = spark.createDataFrame([("x", "b", 1), (None, "B", 1), ("y", "...", 1)], q)
    assert [(r.item_id, r.rank, r.doc_id) for r in lexical.rank(docs, items).orderBy("item_id").collect()] == [(None, 1, 2), ("x", 1, 2)]
    assert lexical.rank(spark.createDataFrame([], d), items).collect() == []
    assert lexical.rank(docs, spark.createDataFrame([], q)).collect() == []
    assert lexical.rank(docs, items.where("item_id = 'y'")).collect() == []
