"""Substring dedup over the whole documents, against plain Python: what is removed, where, and whom it meets; nothing more and nothing less."""

import os
import re
from collections import defaultdict

import pytest

from codeatlas.llm import paragraphs, queries

SF = "/root/testdata/sf0.01"


def words_of(text):
    return [(m[0].translate({c: c + 32 for c in range(65, 91)}), *m.span()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]


class Components:
    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


def similar_lines(lines):
    """The components of the word sequences: those linked by sets of five-word shingles with a Jaccard similarity of 0.8. Every pair that shares a shingle is compared."""
    sets = {k: {k[i : i + 5] for i in range(len(k) - 4)} for k in lines}
    holders = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            holders[g].append(k)
    comps = Components()
    for k, s in sets.items():
        shared = defaultdict(int)
        for g in s:
            for other in holders[g]:
                shared[other] += 1
        for other, n in shared.items():
            if other != k and 100 * n >= 80 * (len(s) + len(sets[other]) - n):
                comps.join(k, other)
    return comps


def plain_repeats(rows):
    """Per doc_id: merged spans, class_id."""
    spans, links = defaultdict(set), Components()

    def repeat(i, start, end, owner):
        spans[i].add((start, end))
        links.join(i, owner)

    first_text, lines, first_window = {}, defaultdict(list), {}
    for i, text in sorted(rows):
        words, at = words_of(text), 0
        if len(words) >= 5:
            owner = first_text.setdefault(text, i)
            if owner != i:
                repeat(i, words[0][1], words[-1][2], owner)
        for line in text.split("\n"):
            key = tuple(w for w, _, _ in words_of(line))
            if len(key) >= 5:
                lines[key].append((i, at, at + len(line)))
            at += len(line) + 1
        keys = [tuple(w for w, _, _ in words[k : k + 50]) for k in range(len(words) - 49)]
        for k, key in enumerate(keys):
            if first_window.get(key, i) != i:
                repeat(i, words[k][1], words[k + 49][2], first_window[key])
        for key in keys:
            first_window.setdefault(key, i)
    comps, keeper = similar_lines(lines), {}
    for key, held in lines.items():
        root = comps.root(key)
        keeper[root] = min(keeper.get(root, held[0]), held[0])
    for key, held in lines.items():
        of = keeper[comps.root(key)]
        for i, start, end in held:
            if (i, start, end) != of:
                repeat(i, start, end, of[0])
    out = {}
    for i, _ in rows:
        merged = []
        for start, end in sorted(spans[i]):
            if merged and merged[-1][1] >= start:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((start, end))
        out[i] = (merged, links.root(i))
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_the_query_removes_what_is_repeated_and_nothing_else(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert len({i for i, _ in rows}) == len(rows)
    want = plain_repeats([(i, t) for i, t in rows if t is not None])
    found = paragraphs.find_repeats(docs).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: ([tuple(x) for x in r.removed], r.class_id) for r in found}
    assert sum(len(s) for s, _ in want.values()) > 50
    assert {i: x for i, x in got.items() if x != want.get(i, ([], i))} == {}
    digest = {r.doc_id: (r.n_repeats, r.removed_chars, r.class_id) for r in queries.op3_substring_dedup(spark, SF).collect()}
    assert digest == {i: (len(s), sum(b - a for a, b in s), c) for i, (s, c) in ((i, want.get(i, ([], i))) for i, _ in rows)}
