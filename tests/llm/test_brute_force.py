"""Operators against plain Python on small tables."""

import json
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeatlas.llm import _common, _words, chat, decontam, mixing, ngram_join, paragraphs, quality, queries, sharding, tokens, wrappers

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def near_copies(seed=1, families=6, copies=12):
    rng = random.Random(seed)
    words, out = vocabulary(rng), []
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.randint(6, 160))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 20))):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
    rng.shuffle(out)
    return list(enumerate(out))


def test_ngram_join_is_exact(spark):
    rows = near_copies()
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or {tuple(w)}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, _ in rows:
        for j, _ in rows:
            if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i, _ in rows}


def test_words_of_columns():
    """Places and hashes of words against a regular expression, over slices, nulls, wide offsets, texts next to each other and long words."""
    rng = random.Random(3)
    for _ in range(60):
        texts = ["".join(rng.choice("aB é\n\t\x0b\U0001f600zzzzzzzz") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 6))] + [None, "x" * 700, ""]
        for column in (pa.array(texts, pa.string()), pa.array(["skip me", *texts], pa.string())[1:], pa.array(texts, pa.large_string())):
            w = _words.Words(column)
            for r, t in enumerate(texts):
                want = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
                assert [w.data[w.start[k] : w.end[k]].tobytes() for k in range(w.first[r], w.first[r + 1])] == want
                assert w.sequence(r).tolist() == _words.Words.of(t).hash.tolist()
            lines = w.lines(2)
            points = w.points()
            got = [(r, points[a] - points[w.rows[r]], points[b] - points[w.rows[r]]) for r, a, b in zip(lines.row, lines.begin, lines.end, strict=True)]
            want = []
            for r, t in enumerate(texts):
                at = 0
                for line in (t or "").split("\n"):
                    if len(re.findall(r"[^\x20\x09-\x0D]+", line)) >= 2:
                        want.append((r, at, at + len(line)))
                    at += len(line) + 1
            assert got == want
    assert _words.Words(pa.array([], pa.string())).lines(1).key.tolist() == []


def test_partenum_signatures_are_complete():
    rng = np.random.default_rng(5)
    limits = ngram_join.bands(85, 4000)
    for _ in range(300):
        n = int(rng.integers(6, 600))
        both = int(np.ceil(n * 0.92))
        s = rng.integers(0, 2**64 - 1, n, dtype="u8")
        a, b = np.unique(s), np.unique(np.concatenate([s[:both], rng.integers(0, 2**64 - 1, int(rng.integers(0, n - both + 1)), dtype="u8")]))
        k = len(np.intersect1d(a, b))
        if 100 * k >= 85 * (len(a) + len(b) - k) and k < max(len(a), len(b)):
            assert len(np.intersect1d(ngram_join.signatures(a, 85, limits), ngram_join.signatures(b, 85, limits)))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in _common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_passages_inside_of_paragraphs_are_found(spark):
    rng = random.Random(11)
    words = vocabulary(rng, 3000)
    fresh = lambda n: [rng.choice(words) + str(rng.randrange(10**6)) for _ in range(n)]
    rows, planted = [], {}
    for p in range(20):
        passage = fresh(rng.randint(52, 90))
        for c in range(3):
            i = len(rows)
            planted[i] = p
            rows.append((i, " ".join(fresh(rng.randint(0, 200)) + passage + fresh(rng.randint(0, 200)))))
    clean = [(1000 + k, " ".join(fresh(150))) for k in range(40)]
    got = {r.doc_id: r for r in paragraphs.find_repeats(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    assert all(got[i].class_id == 3 * p for i, p in planted.items())
    assert all((got[i].n_repeats == 1) == (i % 3 > 0) for i in planted)
    assert all(got[i].n_repeats == 0 and got[i].class_id == i for i, _ in clean)


def windows_held_before(rows, n=50):
    """Per document, the character spans of n-word windows that a document with a smaller id holds, joined where they overlap; and the smallest holders."""
    first, out = {}, {}
    for i, t in sorted(rows):
        w = [(m[0].lower(), *m.span()) for m in re.finditer(r"\S+", t)]
        keys = [tuple(x[0] for x in w[k : k + n]) for k in range(len(w) - n + 1)]
        spans, owners = [], set()
        for k, key in enumerate(keys):
            if key in first:
                owners.add(first[key])
                if spans and spans[-1][1] >= w[k][1]:
                    spans[-1][1] = w[k + n - 1][2]
                else:
                    spans.append([w[k][1], w[k + n - 1][2]])
        for key in keys:
            first.setdefault(key, i)
        out[i] = ([tuple(x) for x in spans], owners)
    return out


@data
def test_every_passage_of_the_documents_is_removed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text is not None]
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in paragraphs.find_repeats(docs).collect()}
    want = windows_held_before(rows)
    assert sum(len(spans) for spans, _ in want.values()) > 10
    for i, (spans, _) in want.items():
        assert all(any(a <= x and y <= b for a, b in got[i]) for x, y in spans), i


def test_texts_that_share_a_doc_id_are_told_apart(spark):
    rng = random.Random(51)
    a, c = (" ".join(f"v{rng.randrange(10**9)}" for _ in range(60)) for _ in range(2))
    rows = spark.createDataFrame([(1, a), (5, a), (5, c)], "doc_id long, text string")
    assert sorted(r.text for r in paragraphs.without_repeats(rows).collect()) == sorted([a, "", c])


def test_passages_meet_their_first_verbatim_holder(spark):
    """An earlier document with an edited or truncated copy of a passage doesn't hide that two later ones hold all of it."""
    rng = random.Random(21)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for p in range(12):
        passage = fresh(rng.randint(52, 70))
        edited = list(passage)
        edited[rng.randint(21, 30)] = "edited"
        for body in (edited if p % 2 else passage[:45], passage, passage):
            rows.append((len(rows), " ".join(fresh(rng.randint(5, 60)) + body + fresh(rng.randint(5, 60)))))
    want = windows_held_before(rows)
    assert all(want[3 * p + 2][1] == {3 * p + 1} for p in range(12))
    got = {r.doc_id: r for r in paragraphs.find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: [tuple(x) for x in r.removed] for i, r in got.items()} == {i: spans for i, (spans, _) in want.items()}
    assert all(got[3 * p + 2].class_id == 3 * p + 1 for p in range(12))


def test_passages_of_few_words_over_and_over_are_found(spark):
    rng = random.Random(41)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for period in (1, 2, 3, 4, 7):
        passage = (fresh(period) * 60)[:60]
        rows += [(len(rows) + c, " ".join(fresh(20) + passage + fresh(20))) for c in range(2)]
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in paragraphs.find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: spans for i, (spans, _) in windows_held_before(rows).items()} and all(got[2 * k + 1] for k in range(5))


def test_near_duplicate_paragraphs_are_found(spark):
    rng = random.Random(12)
    words = vocabulary(rng, 2000)
    rows = []
    for p in range(30):
        line = [rng.choice(words) for _ in range(120)]
        for c in range(2):
            w = list(line)
            for _ in range(2 * c):
                w[rng.randrange(120)] = rng.choice(words)
            rows.append((2 * p + c, "start " + str(len(rows)) + "\n" + " ".join(w)))
    got = {r.doc_id: r for r in paragraphs.find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * p + 1].class_id == 2 * p for p in range(30)) >= 29


def test_near_duplicates_of_short_paragraphs_are_found(spark):
    rng = random.Random(31)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for p in range(10):
        lines = [fresh(n) for n in (20, 35, 5, 49, 28)]
        copy = [list(w) for w in lines]
        for k in (0, 1, 3, 4):  # no 50 words in a row stay
            copy[k][-1 if k < 2 else 0] = "edited"
        rows += [(2 * p + c, "\n".join(" ".join(w) for w in x)) for c, x in enumerate((lines, copy))]
    got = {r.doc_id: r for r in paragraphs.find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * p].n_repeats == 0 for p in range(10))
    assert all(got[2 * p + 1].class_id == 2 * p and got[2 * p + 1].n_repeats == 5 for p in range(10))


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(2)
    s = np.concatenate([rng.integers(0, 4, 3000), np.tile([1, 2, 3, 1], 40), [0]]).astype("i4")
    index = decontam.FMIndex(s)
    table = np.full((60, 5), -1, "i4")
    for k in range(60):
        at, n = int(rng.integers(0, 3000)), int(rng.integers(1, 6))
        table[k, 5 - n :] = s[at : at + n]
    table = table[(table != 0).all(axis=1)]
    hit, lo, hi = index.search(table)
    found = {int(k): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(hit, lo, hi, strict=True)}
    for k, row in enumerate(table):
        p = row[row >= 0]
        want = [i for i in range(len(s) - len(p) + 1) if (s[i : i + len(p)] == p).all()]
        assert found.get(k, []) == want


def test_decontamination_blocks_agree(spark, monkeypatch):
    docs = spark.createDataFrame(near_copies(4, 5, 4), "doc_id long, text string")
    bench = docs.select(F.col("doc_id").alias("item_id"), F.substring("text", 30, 120).alias("text"))
    rows = lambda df: sorted((r.doc_id, r.n_words, r.n_hit, str(r.spans), str(r["items"])) for r in df.collect())
    one = rows(decontam.contamination(docs, bench))
    monkeypatch.setattr(decontam, "BLOCK_ROWS", 3)
    assert rows(decontam.contamination(docs, bench)) == one and any(r[2] for r in one)


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    path = tokens.tokenizer_file()
    mine, theirs = tokens.Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(7)
    alphabet = ["a", "B", "é", "ß", " ", "  ", "\n", "1", "²", "'s", "'", "!", "\t", " ", "ǅ", "漢", "<|endoftext|>", "\x07", "#", "don't"]
    for _ in range(400):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert mine(t) == np.array(theirs.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_reader_decompresses_only_what_is_asked(tmp_path):
    w = tokens.TokenFileWriter(f"file://{tmp_path}/x.zst", frame_ids=16)
    docs = [(i, np.arange(i % 40, dtype="<u4").tobytes()) for i in range(50)]
    for d in docs:
        w.add(*d)
    w.close()
    r = tokens.TokenFileReader(f"file://{tmp_path}/x.zst")
    assert r.ids(49) == docs[49][1] and r.frames_read == 1
    assert [(d, r.ids(k)) for k, d in enumerate(r.doc_ids)] == docs
    raw = bytearray((tmp_path / "x.zst").read_bytes())
    raw[30] ^= 255
    (tmp_path / "y.zst").write_bytes(raw)
    with pytest.raises(Exception):
        bad = tokens.TokenFileReader(f"file://{tmp_path}/y.zst")
        [bad.ids(k) for k in range(50)]


def test_mixing_targets_and_totals(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 30, 200, 900])), rng.choice("aaaab") + str(rng.randrange(3))) for i in range(3000)] + [(5000 + i, "x y", None) for i in range(5)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    sizes = out.groupby("source", dropna=False)["size"].sum()
    order = sorted(sizes.index, key=lambda s: (not isinstance(s, str), s if isinstance(s, str) else ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, free, want = float(sizes.sum()), set(order), {}
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            want |= {s: left * weight[s] / total for s in free}
            break
        want |= {s: 3.0 * sizes[s] for s in over}
        left, free = left - sum(3 * sizes[s] for s in over), free - over
    for s in order:
        mine = out[out.source.isna()] if not isinstance(s, str) else out[out.source == s]
        assert abs(mine.target.iloc[0] - want[s]) < 1e-6 and (mine.source_size == sizes[s]).all()
        assert abs((mine["size"] * mine.copies).sum() - want[s]) <= max(2, 0.002 * want[s])


def test_mixing_tilts_rates(spark):
    rows = [(i, "w " * 100, "a" if i < 500 else "b", 1.0 + i % 2) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    out = mixing.mix(df, weights=(3.0, 1.0), tilt=F.col("q")).toPandas()
    a = out[out.source == "a"]
    assert a[a.q == 2].copies.mean() > a[a.q == 1].copies.mean() > 1
    assert abs((a["size"] * a.copies).sum() / a.target.iloc[0] - 1) < 0.01


def test_sharding_keeps_groups_and_splits_the_hot_one(spark):
    rows = [(i, "hot") for i in range(1500)] + [(2000 + i, f"g{i // 4}") for i in range(1500)] + [(9000 + i, f"s{i}") for i in range(1500)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), 4).join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").toPandas()
    counts = got.groupby("shard").size()
    assert counts.max() - counts.min() <= 1
    small = got[got.text.str.startswith("g")].groupby("text").shard.nunique()
    assert (small > 1).mean() < 0.05
    assert got[got.text == "hot"].groupby("shard").size().max() >= 750  # half of it: small groups have the right of way
    groups = got[~got.text.str.startswith("s")]
    c = sharding.cut(spark.createDataFrame(groups[["doc_id", "text", "shard"]]), ["text"]).first()
    pairs = lambda g: (g * (g - 1) // 2).sum()
    assert c.links == pairs(groups.groupby("text").size()) and c.cut == c.links - pairs(groups.groupby(["text", "shard"]).size())
    assert c.cut < 0.9 * c.cut_by_hash  # the hot group has to be split


@data
@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_sharding_of_the_documents(spark, law):
    """All laws of the contract on a whole table, and fewer links cut than by hash."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = sharding.shard_rows(docs, 8, law=law)
    got = out.toPandas()
    size = {r.doc_id: (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()}
    assert len(got) == len(size) and all(size[i] == (s, c) for i, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True))
    for _, rows in got.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))
    if law == "rows":
        counts = got.groupby("shard").size().reindex(range(8), fill_value=0)
        assert counts.max() - counts.min() <= 1
    else:
        sums = got.groupby("shard")["size"].sum().reindex(range(8), fill_value=0)
        assert sums.max() - sums.min() <= 2 * got["size"].max()
    c = sharding.cut(out.select("doc_id", "text_crc32", "shard"), ["text_crc32"]).first()
    assert 0 < c.links and c.cut < c.cut_by_hash / 2


def test_repeat_words_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        w = [rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(0, 40))]
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {p for i, x in enumerate(windows) if windows.count(x) > 1 for p in range(i, i + 3)}
        assert quality.measure(" ".join(w))[5] == len(hit)


def test_ablation(spark):
    led = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, 2), (5, 32)], "doc_id long, failed long")
    got = {r.rule: (r.n_fail, r.n_only, r.n_rejected, r.n_rows) for r in quality.ablation(led, quality.POLICIES["base"]).collect()}
    assert got == {"few_words": (2, 1, 3, 5), "repeated_word_windows": (2, 1, 3, 5)}


def test_event_log(spark):
    log = [
        ("start", 0, "user", None), ("delta", 0, None, "Hel"), ("delta", 0, None, "lo"), ("start", 1, "assistant", None), ("delta", 1, None, "bad"), ("start", 2, "user", "more"),
        ("regenerate", 1, None, None), ("delta", 1, None, "good"), ("start", 2, "user", "again"), ("edit", 0, None, "Hi"), ("delta", 9, None, "lost"), ("noise", 0, None, "x"),
    ]
    df = spark.createDataFrame([(1, s, k, t, r, x) for s, (k, t, r, x) in enumerate(log)], "conv_id long, seq long, kind string, turn long, role string, text string")
    got = chat.fold_events(df).first().messages
    assert [(m.turn, m.role, m.text) for m in got] == [(0, "user", "Hi"), (1, "assistant", "good"), (2, "user", "again")]
    gone = chat.fold_events(df.where("seq < 8")).first().messages
    assert [m.turn for m in gone] == [0, 1]


def test_wrapper_accepts_every_page_it_saw():
    rng = random.Random(8)
    pages, wrapper = [], None
    for _ in range(60):
        items = "".join(f"<li><a href='/{i}'>x{i}</a></li>" for i in range(rng.randint(1, 4)))
        body = "".join(f"<p>{'<b>' if rng.random() < 0.3 else ''}t{i} &lt;</p>" for i in range(rng.randint(1, 5)))
        ad = "<div class='ad-box'>buy</div>" if rng.random() < 0.5 else ""
        pages.append(f"<html><body><nav><ul>{items}</ul></nav>{ad}<article><h1>T</h1>{body}</article>{ad}<footer>f</footer></body></html>")
        wrapper = wrappers.align(wrapper, wrappers.wrapper_of(wrappers.tokens(pages[-1])[0]))
    m = wrappers.Matcher(json.loads(json.dumps(wrapper)))
    for p in pages:
        assert min(m.place(wrappers.tokens(p)[0])) >= 0


WORDS = [f"word{i}" for i in range(400)]


def host_pages(seed, n, plain, odd=0):
    """(html, main text) of n pages of a host. plain: all elements are divisions without names; odd: kinds of blocks that a page may have besides."""
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    out = []
    for i in range(n):
        blocks = [("h1", say(6)), *[("p", say(rng.randint(8, 40))) for _ in range(rng.randint(2, 6))]]
        blocks += [(rng.choice(("h2", "blockquote", "pre", "p")), say(10)) for _ in range(rng.randint(0, odd))]
        main = "".join(f"<{t}>{x}</{t}>" for t, x in blocks)
        menu = "".join(f'<li><a href="/{k}">{say(1)}</a></li>' for k in range(rng.randint(2, 5)))
        extra = "".join(f"<div><span class='k{rng.choice('abcdefgh')}'>{say(1)}</span></div>" for _ in range(rng.randint(0, odd)))
        page = f"<html><body><nav><ul>{menu}</ul></nav>{extra}<div class='ad'>Buy now and save</div><article>{main}</article><aside>All about us here</aside><footer>Made by us</footer></body></html>"
        if plain:
            page = re.sub(r"<(/?)(?:nav|article|aside|footer|div)\b[^>]*>", r"<\1div>", page)
        out.append((page, "\n".join(x for _, x in blocks)))
    return out


def extracted(spark, pages):
    rows = [(i, f"https://a.example/{i}", html) for i, (html, _) in enumerate(pages)]
    return {r.page_id: r for r in wrappers.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_wrapper_finds_main_text_without_names(spark):
    """The result comes from the wrapper: without it no page is right."""
    pages = host_pages(1, 25, plain=True)
    got = extracted(spark, pages)
    assert all(got[i].text == want and got[i].by_wrapper for i, (_, want) in enumerate(pages))
    assert not any(wrappers.extract(html, None)[0] == want for html, want in pages)


@pytest.mark.parametrize("plain, odd", [(False, 6), (True, 1)])
def test_wrapper_of_varied_pages(spark, plain, odd):
    """Hosts of any variety go through their wrapper."""
    pages = host_pages(2, 80, plain=plain, odd=odd)
    got = extracted(spark, pages)
    right = [got[i].text == want for i, (_, want) in enumerate(pages)]
    assert all(r.by_wrapper for r in got.values()) and sum(right) == len(pages)


def test_words_of_classes_drop_containers_only():
    for html, want in [
        ('<article><p class="search-results">About search</p><p class="share">Share prices fell</p><div class="header-image"><p>cap</p></div></article>', "About search\nShare prices fell\ncap"),
        ("<article><header><h1>Head</h1></header><p>Body</p></article>", "Head\nBody"),
        ("<article><p hidden>x</p><p style='color:red; display: none'>z</p><p>y</p></article>", "y"),
        ('<article><p>Body</p><div class="share-bar">Tell all</div><div id="comments"><p>First!</p></div><footer>f</footer></article><article class="comment">no</article>', "Body"),
    ]:
        assert wrappers.extract(html, None)[0] == want


@data
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, SF), con.sql(queries.SQL[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    rows = lambda cols, data: sorted(repr([r[cols.index(c)] for c in order]) for r in data)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@data
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    led = {r.doc_id for r in quality.ledger(docs).where(~quality.rejected(quality.POLICIES["v1"])).collect()}
    kept = p.quality_rules(spark, docs, SF)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == led
    comps = {r.doc_id: r.component_id for r in ngram_join.join_components(kept, 80, 5).collect()}
    one = p.near_duplicates(spark, kept, SF)
    assert one.columns == columns and {r.doc_id for r in one.collect()} == set(comps.values())
    clean = p.benchmark_decontamination(spark, one, SF)
    hit = {r.doc_id for r in decontam.contamination(one, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit > 0").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - hit
    mixed = p.mix_sources(spark, clean, SF)
    assert mixed.columns == columns
    out = p.token_output(spark, mixed, SF)
    assert out.count() == mixed.count() == p.run(spark, SF).count()
