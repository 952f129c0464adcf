"""Substring dedup by paragraph MinHash banding, over lines and over windows of words.

Paragraphs are lines of at least SHINGLE words. Their sets of five-word shingles get BANDS bands of ROWS MinHash values: two paragraphs of
similarity 0.8 share a band with probability 1 - (1 - 0.8^3)^10 > 0.999. Paragraphs that collide are verified on their sets
by exact Jaccard similarity, links form components, and each component keeps its first paragraph.

A passage may also be embedded in otherwise different paragraphs. So all windows of MIN_WORDS words are paragraphs, too, overlapping ones: their
one band is the MinHash of the runs of half their length (and one word more where that is odd), which equal windows share with certainty and
neighbours mostly have in common, so a document has few. Windows whose band no other text has are nobody else's; colliding ones are verified by the
hash of all their words, and each meets the first document that holds it. No window is left out, whatever stands around it or in earlier documents.

Texts equal to an earlier one are repeats as a whole, and give no windows; nor do windows within a line that equals an earlier one: whatever they could
show, the first holder of the text or line shows. Rows are per occurrence, never pairs within a group, and first holders are found by
minima that are combined before the shuffle. Words, windows and equal paragraphs are told apart by 64-bit hashes, equal texts by three hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, connected_components, discard, materialize, maybe_broadcast, n_parts
from ._links import link_components
from ._words import Words, mix
from .ngram_join import many_shingles

MIN_WORDS, SHINGLE, PERCENT, BANDS, ROWS = 50, 5, 80, 10, 3

_RNG = np.random.default_rng(20240101)  # fixed, so that all tasks and reruns agree
_A = _RNG.integers(1, 2**63, BANDS * ROWS, dtype="u8") * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS * ROWS, dtype="u8")
_LOW = np.uint64(2**32 - 1)


def minhash_bands(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row of BANDS signatures for each list of word hashes; lists of n words, SHINGLE at least, are laid end to end. Minima are taken over 32-bit hashes, which
    numpy multiplies several at once."""
    starts = np.cumsum(n) - n
    grams = h.copy()
    for j in range(1, SHINGLE):
        grams[:-j] = mix(grams[:-j] + h[j:])
    beyond = np.arange(len(h)) > np.repeat(starts + n, n) - SHINGLE  # shingles that reach into the next list don't count
    half = (grams >> np.uint64(32)).astype("u4")
    out = np.empty((len(n), BANDS * ROWS), "u8")
    for k in range(BANDS * ROWS):
        v = half * np.uint32(_A[k] & _LOW) + np.uint32(_B[k] & _LOW)
        v ^= v >> np.uint32(15)
        v *= np.uint32(_A[-1 - k] & _LOW)
        v[beyond] = np.uint32(_LOW)
        out[:, k] = np.minimum.reduceat(v, starts)
    bands = np.zeros((len(n), BANDS), "u8") + np.arange(BANDS, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        bands = mix(bands + out[:, r::ROWS])
    return bands.view("i8")


TEXT, LINE, MARK = 0, 1, 2


def _fact_rows(least: int, min_words: int):
    """(kind, item, doc_id, version, start, end), start and end in code points: the texts of enough words, item being a hash of their bytes; their lines of enough words; and the marks of
    their windows, which have no places. One pass gives all three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch["text"])
            points = words.points()

            def rows(kind: int, row: np.ndarray, item: np.ndarray, places: tuple | None) -> pa.RecordBatch:
                ids = [batch[c].take(pa.array(row)) for c in ("doc_id", "version")]
                spans = [pa.array(points[x] - points[words.rows[row]]) for x in places] if places else [pa.nulls(len(row), pa.int64())] * 2
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(row), kind, "i1")), pa.array(item.view("i8")), *ids, *spans], ["kind", "item", "doc_id", "version", "start", "end"])

            n = np.diff(words.first)
            row = np.flatnonzero(n >= least)
            whole = np.array([xxhash.xxh3_64_intdigest(batch["text"][r].as_buffer()) for r in row.tolist()], "u8")
            yield rows(TEXT, row, whole, (words.start[words.first[row]], words.end[words.first[row + 1] - 1]))
            lines = words.lines(least)
            yield rows(LINE, lines.row, lines.key, (lines.begin, lines.end))
            mark, _, nth, _ = windows(words.hash, n, min_words)
            new = np.ones(len(mark), bool)
            new[1:] = (mark[1:] != mark[:-1]) | (nth[1:] != nth[:-1])
            yield rows(MARK, nth[new], mark[new], None)

    return run


def _band_rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a partition give their signatures once
        for batch in batches:
            lines = Words(batch["text"]).lines(least)
            new = np.zeros(len(lines.key), bool)
            for k, key in enumerate(lines.key.tolist()):
                if key not in seen:
                    seen.add(key)
                    new[k] = True
            if new.any():
                bands = minhash_bands(lines.flat[np.repeat(new, lines.n)], lines.n[new])
                yield pa.RecordBatch.from_arrays([pa.array(bands.ravel()), pa.array(np.repeat(lines.key[new], BANDS))], ["sig", "id"])

    return run


def _runs(h: np.ndarray, n: int, join) -> np.ndarray:
    """join() over all runs of n neighbours, from runs of powers of two; empty if there are fewer."""
    size = len(h) - n + 1
    out, done, power, width = None, 0, h, 1
    while size > 0:
        if n & width:
            out = power[:size] if out is None else join(out, power[done : done + size])
            done += width
        if done == n:
            return out
        power = join(power[:-width], power[width:])
        width *= 2
    return h[:0]


def windows(h: np.ndarray, sizes: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mark, hash, nth sequence, first word in it) of all windows of min_words words, for word hashes of sequences laid end to end."""
    half = (min_words + 1) // 2
    chain = lambda a, b: mix(a * _A[0] + b)
    part = _runs(h, half, chain)
    mark = _runs(part, min_words - half + 1, np.minimum)
    whole = chain(part[: len(mark)], part[min_words - half :][: len(mark)])  # its first and its last half
    many = np.maximum(sizes - min_words + 1, 0)
    nth = np.repeat(np.arange(len(sizes)), many)
    first = np.arange(len(nth)) - np.repeat(np.cumsum(many) - many, many)
    at = (np.cumsum(sizes) - sizes)[nth] + first
    return mark[at], whole[at], nth, first


def _window_rows(min_words: int):
    """(item, doc_id, version, at) of the windows that have one of the row's marks and don't lie within one of its `known` spans; equal windows that
    overlap or touch are one row; `at` holds the start in its upper, the end in its lower half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch["text"])
            mark, whole, nth, first = windows(words.hash, np.diff(words.first), min_words)
            of, marks = _laid_out(batch["marks"])
            wanted = _among(_in_row(mark, nth), _in_row(marks.to_numpy().view("u8"), of))
            whole, nth, word = whole[wanted], nth[wanted], words.first[nth[wanted]] + first[wanted]
            points = words.points()
            base = points[words.rows[nth]]
            start, end = points[words.start[word]] - base, points[words.end[word + min_words - 1]] - base
            of, known = _laid_out(batch["known"])
            if len(of):
                lo, hi = (known.field(c).to_numpy() for c in ("start", "end"))  # by row, in order
                at = np.searchsorted((of << 32) | lo, (nth << 32) | start, "right") - 1
                out = (at < 0) | (of[at] != nth) | (end > hi[at])
                whole, nth, word, start, end = (x[out] for x in (whole, nth, word, start, end))
            if not len(nth):
                continue
            order = np.lexsort((word, whole, nth))
            whole, nth, word, start, end = (x[order] for x in (whole, nth, word, start, end))
            new = np.ones(len(nth), bool)
            new[1:] = (nth[1:] != nth[:-1]) | (whole[1:] != whole[:-1]) | (word[1:] - word[:-1] > min_words)
            lo = np.flatnonzero(new)
            at = (start[lo] << 32) | end[np.append(lo[1:], len(nth)) - 1]
            same = [batch[c].take(pa.array(nth[lo])) for c in ("doc_id", "version")]
            yield pa.RecordBatch.from_arrays([pa.array(whole[lo].view("i8")), *same, pa.array(at)], ["item", "doc_id", "version", "at"])

    return run


def _laid_out(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """(row of each element, elements) of a column of lists; null is empty."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(n)), n), lists.flatten()


def _in_row(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes told apart by their rows, too. Should two fall together, a window more is looked at, and none is lost."""
    return h + row.astype("u8") * _A[0]


def _among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of x are among some."""
    if not len(some):
        return np.zeros(len(x), bool)
    some = np.sort(some)
    at = np.searchsorted(some, x)
    at[at == len(some)] = 0
    return some[at] == x


def _joined_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, version, start, end, owner) of the runs of windows that overlap or touch and have one owner; rows come in order of doc_id, version and at."""
    held = None
    for batch in batches:
        d, v, o, at = (batch[c].to_numpy() for c in ("doc_id", "version", "owner", "at"))
        if not len(d):
            continue
        rows = np.stack([d, v, o, at >> 32, at & (2**32 - 1)])
        if held is not None:
            rows = np.concatenate([held[:, None], rows], axis=1)
        new = np.ones(rows.shape[1], bool)
        new[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0) | (rows[3, 1:] > rows[4, :-1])
        lo = np.flatnonzero(new)
        rows = np.concatenate([rows[:4, lo], np.maximum.reduceat(rows[4], lo)[None]])
        held = rows[:, -1]
        yield _spans(rows[:, :-1])
    if held is not None:
        yield _spans(held[:, None])


def _spans(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[i])) for i in (0, 1, 3, 4, 2)], ["doc_id", "version", "start", "end", "owner"])


def _lines_of(least: int):
    """(id, text) of a row's wanted lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch["text"])
            lines = words.lines(least)
            wanted = [set(x) for x in batch["items"].to_pylist()]
            out = []
            for r, k, lo, hi in zip(lines.row.tolist(), lines.key.tolist(), lines.begin.tolist(), lines.end.tolist(), strict=True):
                if k in wanted[r]:
                    wanted[r].discard(k)
                    out.append((k, words.data[lo:hi].tobytes().decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([t for _, t in out])], ["id", "text"])

    return run


def versions(docs: DataFrame) -> DataFrame:
    """(doc_id, version, text) of the rows that have both; version is a hash of the text and tells rows of one doc_id apart."""
    return docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("version"), "text")


def facts_of(d: DataFrame, least: int = SHINGLE, min_words: int = MIN_WORDS) -> DataFrame:
    """What _fact_rows gives of versions of documents, written once and read by kind."""
    return materialize(d.mapInArrow(_fact_rows(least, min_words), "kind byte, item long, doc_id long, version long, start long, end long"), "facts")


def repeated_texts(facts: DataFrame) -> DataFrame:
    """(doc_id, version, start, end, owner) of the texts that an earlier document has as they are."""
    rows = facts.where(f"kind = {TEXT}").drop("kind")
    same = ["version", "item", "start", "end"]
    owners = rows.groupBy(*same).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("most")).where("owner < most").drop("most")
    owners = materialize(owners, "owners")
    return rows.join(maybe_broadcast(owners, owners.count()), same).where("doc_id <> owner").select("doc_id", "version", "start", "end", "owner").distinct()


def repeated_paragraphs(d: DataFrame, facts: DataFrame, least: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """For versions of documents: the (doc_id, version, start, end, owner) of the paragraphs that aren't the first of their component, owner being the
    first one's doc_id; and the (doc_id, version, start, end) of those that equal an earlier one."""
    para = facts.where(f"kind = {LINE}").drop("kind")
    first = materialize(para.groupBy("item").agg(F.min(F.struct("doc_id", "version", "start")).alias("first"), F.count(F.lit(1)).alias("n")), "firsts")

    def texts(ids: DataFrame, count: int) -> DataFrame:
        of = first.join(maybe_broadcast(ids.withColumnRenamed("id", "item"), count), "item").groupBy("first.doc_id").agg(F.collect_list("item").alias("items"))
        found = d.join(maybe_broadcast(materialize(of, "owners"), count), "doc_id").select("items", "text")
        return found.mapInArrow(_lines_of(least), "id long, text string")

    comps = link_components(d.select("text").mapInArrow(_band_rows(least), "sig long, id long"), texts, lambda column: many_shingles(column, SHINGLE), PERCENT)
    # an item's component, and the component's first paragraph
    of = first.join(comps, first.item == comps.id, "left").select("item", "first", "n", "root")
    linked = of.where("root is not null")
    keeper = linked.groupBy("root").agg(F.min("first").alias("keeper"))
    of = linked.join(keeper, "root").select("item", "first", "keeper").unionByName(of.where("root is null and n > 1").select("item", "first", F.col("first").alias("keeper")))
    of = materialize(of.select("item", "first", F.col("keeper.doc_id").alias("owner"), F.col("keeper.version").alias("of"), F.col("keeper.start").alias("at")), "keepers")
    here = F.struct("doc_id", "version", "start")
    repeats = F.expr("doc_id <> owner or version <> of or start <> at").alias("repeats")
    rows = para.join(of, "item").select("doc_id", "version", "start", "end", "owner", repeats, (here != F.col("first")).alias("known"))
    rows = materialize(rows.where("repeats or known"), "repeated")
    discard(first)
    return rows.where("repeats").select("doc_id", "version", "start", "end", "owner"), rows.where("known").select("doc_id", "version", "start", "end")


def repeated_passages(d: DataFrame, facts: DataFrame, copies: DataFrame, known: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """For versions of documents: the (doc_id, version, start, end, owner) of runs of windows of min_words words of which the owner is the first document that
    holds them. Texts in copies, and windows within spans in known, repeat earlier ones and are left out. The table of facts goes once its marks are read."""
    key = ["doc_id", "version"]
    marks = facts.where(f"kind = {MARK}").select("item", *key)
    again = marks.groupBy("item").agg(F.min("version").alias("a"), F.max("version").alias("b")).where("a < b").select("item")
    per = marks.join(again, "item").groupBy(*key).agg(F.collect_set("item").alias("marks")).join(copies.select(*key).distinct(), key, "left_anti")
    spans = known.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("known"))
    per = materialize(per.join(spans, key, "left"), "wanted")
    discard(facts)
    found = d.join(per, key).select("doc_id", "version", "text", "marks", "known")
    rows = materialize(found.mapInArrow(_window_rows(min_words), "item long, doc_id long, version long, at long"), "windows")
    first = rows.groupBy("item").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("most")).where("owner < most").select("item", "owner")
    later = rows.join(first, "item").where("doc_id <> owner").select("doc_id", "version", "owner", "at")
    later = later.repartition(n_parts(d), *key).sortWithinPartitions("doc_id", "version", "at")
    return later.mapInArrow(_joined_windows, "doc_id long, version long, start long, end long, owner long")


def find_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for every row of docs: doc_id, version, n_repeats, removed array<struct<start, end>> (code points, merged and in order),
    removed_chars, class_id.

    docs has doc_id (a long) and text; other columns are ignored. `removed` covers what an earlier document holds: whole texts and paragraphs of at least
    SHINGLE words (paragraphs that aren't their component's first), and passages of at least min_words words. class_id is the smallest doc_id reached by such
    repeats, the document's own where it has none. Null and empty texts and shorter ones have no repeats and, if null, a null version. A null doc_id has no
    repeats and a null class_id. Rows that share a doc_id are told apart by their texts, but a passage counts as repeated only if a smaller doc_id holds it; equal
    rows answer alike. Very long texts are searched whole, in batches of a megabyte or one text. Ties have no effect: owners are minima. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession, "1m")
    d = versions(docs)
    key = ["doc_id", "version"]
    facts = facts_of(d, SHINGLE, min_words)
    copies = materialize(repeated_texts(facts), "copies")
    repeats, known = repeated_paragraphs(d, facts)
    every = repeats.unionByName(copies).unionByName(repeated_passages(d, facts, copies, known, min_words))
    spans = materialize(every, "spans")
    links = spans.where("doc_id <> owner").select(F.col("doc_id").alias("u"), F.col("owner").alias("v"))
    classes = connected_components(links)
    one = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    per = spans.groupBy(*key).agg(F.array_sort(F.collect_set(one)).alias("all"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    joined = F.aggregate(
        "all",
        none,
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(
            F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))
        )).otherwise(F.concat(acc, F.array(x))),
    )
    per = materialize(per.select(*key, joined.alias("removed")), "repeats")
    out = docs.select("doc_id", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("version"))
    out = out.join(per, key, "left").join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("removed", F.coalesce("removed", none))
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]))
    return out.select("doc_id", "version", F.size("removed").cast("long").alias("n_repeats"), "removed", chars.alias("removed_chars"), F.coalesce("root", "doc_id").alias("class_id"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeats cut out of the texts; documents that had nothing else are left with an empty text. Rows are as find_repeats tells them apart."""
    found = find_repeats(docs, min_words).where("n_repeats > 0").select("doc_id", F.col("version").alias("_version"), "removed").dropDuplicates(["doc_id", "_version"])
    found = found.withColumnRenamed("removed", "_removed")
    step = lambda acc, x: F.struct(F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])).alias("out"), x["end"].alias("at"))
    kept = F.aggregate("_removed", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(F.concat(kept["out"], F.substring(F.col("text"), kept["at"] + 1, F.length("text"))))
    return docs.withColumn("_version", F.xxhash64("text")).join(found, ["doc_id", "_version"], "left").withColumn("text", text).select(*docs.columns)
