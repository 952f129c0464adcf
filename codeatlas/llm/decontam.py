"""Benchmark decontamination with an FM-index per training shard.

A shard is a batch of documents as a task streams them. Its words become symbols (the benchmark's vocabulary; every other word
and every document end is the stop symbol), and an FM-index is built over them: suffix array by prefix doubling, the
Burrows-Wheeler transform in a wavelet matrix, and suffix positions sampled at every SAMPLE-th place. All windows of
the benchmark are searched backwards at once through wavelet ranks; the rows of a match are walked to a sampled position, and the
places found merge into spans. Stop symbols are ordered by place, so no match crosses one, and a walk never does because
each place after one is sampled. Runs between stops that are shorter than every window hold no match and are left out of the index.

No shuffle moves documents. The benchmark lies in the shared folder in blocks of BLOCK_ROWS items, which tasks read one after
another, so neither its size nor a document's frequency of hits gathers anything on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, new_path
from ._files import file_system

#: Words in a window; words and documents in a shard; distance of sampled suffix positions; items in a block.
WINDOW, SHARD_WORDS, SHARD_DOCS, SAMPLE, BLOCK_ROWS = 10, 1_000_000, 4096, 16, 20_000

#: Lower-cases A-Z and turns what isn't a word character into spaces: words are runs of 0-9, a-z and non-ASCII.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Windows:
    """The distinct windows of a block of benchmark items, as rows of symbols padded in front with -1."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words(text)]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                found.setdefault(tuple(w[i : i + window]), set()).add(item)
        self.items = [sorted(x, key=str) for x in found.values()]
        self.length = np.array([len(x) for x in found], "i8")
        self.least = int(self.length.min()) if found else 0
        self.table = np.full((len(found), window), -1, "i4")
        for k, x in enumerate(found):
            self.table[k, window - len(x) :] = x


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Places of s (which ends with 0) in order of their suffixes, where every 0 is a symbol of its own, ordered by place,
    below all others. Prefix doubling; only places that still tie are sorted again."""
    n, zeros = len(s), np.flatnonzero(s == 0)
    counts = np.bincount(s, minlength=2)
    counts[0] = len(zeros)
    below = np.concatenate([[0], np.cumsum(counts)])
    rank = below[s].astype("i8")  # suffixes known to be smaller
    rank[zeros] = np.arange(len(zeros))
    tied = np.flatnonzero((s > 0) & (counts[s] > 1))
    step = 1
    while len(tied):
        order = np.lexsort((rank[tied + step], rank[tied]))
        tied = tied[order]
        first, second = rank[tied], rank[tied + step]
        new_group = np.concatenate([[True], first[1:] != first[:-1]])
        new_rank = new_group | np.concatenate([[True], second[1:] != second[:-1]])
        at = np.arange(len(tied))
        rank[tied] = first + np.maximum.accumulate(np.where(new_rank, at, 0)) - np.maximum.accumulate(np.where(new_group, at, 0))
        sizes = np.diff(np.concatenate([np.flatnonzero(new_rank), [len(tied)]]))
        tied = tied[np.repeat(sizes > 1, sizes)]
        step *= 2
    sa = np.empty(n, "i8")
    sa[rank] = np.arange(n)
    return sa


class WaveletMatrix:
    """Ranks of symbols in a sequence, for many (symbol, place) at once."""

    def __init__(self, a: np.ndarray):
        self.bits = max(1, int(a.max(initial=0)).bit_length())
        self.zeros_before, self.zeros = [], []
        for level in reversed(range(self.bits)):
            bit = (a >> level) & 1
            before = np.zeros(len(a) + 1, "i4")
            np.cumsum(1 - bit, out=before[1:])
            self.zeros_before.append(before)
            self.zeros.append(int(before[-1]))
            a = np.concatenate([a[bit == 0], a[bit == 1]])

    def rank(self, c: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often c occurs before each place."""
        at = [np.zeros(len(c), "i8"), *(p.astype("i8") for p in places)]
        for k, level in enumerate(reversed(range(self.bits))):
            one, before, zeros = ((c >> level) & 1).astype(bool), self.zeros_before[k], self.zeros[k]
            at = [np.where(one, zeros + i - before[i], before[i]) for i in at]
        return [i - at[0] for i in at[1:]]


class FMIndex:
    def __init__(self, s: np.ndarray, sample: int = SAMPLE):
        sa = suffix_array(s)
        previous = s[sa - 1]  # row of place 0 wraps to the closing 0
        self.c = np.concatenate([[0], np.cumsum(np.bincount(s))])
        self.bwt, self.wavelet = previous, WaveletMatrix(previous)
        kept = (previous == 0) | (sa % sample == 0)
        self.kept, self.nth = kept, np.cumsum(kept) - 1
        self.samples = sa[kept]

    def search(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(windows, lo, hi) of the windows that occur, whose rows are lo to hi - 1."""
        size = len(self.c) - 1
        alive = np.flatnonzero((table < size).all(axis=1)) if len(table) else np.zeros(0, "i8")
        lo, hi = np.zeros(len(alive), "i8"), np.full(len(alive), len(self.bwt), "i8")
        for k in reversed(range(table.shape[1])):
            c = table[alive, k]
            pad = c < 0
            safe = np.where(pad, 0, c)
            a, b = self.wavelet.rank(safe, lo, hi)
            lo, hi = np.where(pad, lo, self.c[safe] + a), np.where(pad, hi, self.c[safe] + b)
            going = lo < hi
            alive, lo, hi = alive[going], lo[going], hi[going]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, steps, open_ = rows.copy(), np.zeros(len(rows), "i8"), np.flatnonzero(~self.kept[rows])
        while len(open_):
            r = at[open_]
            c = self.bwt[r]
            at[open_] = self.c[c] + self.wavelet.rank(c, r)[0]
            steps[open_] += 1
            open_ = open_[~self.kept[at[open_]]]
        return self.samples[self.nth[at]] + steps


def find(docs: list[list[bytes]], windows: Windows) -> dict[int, tuple[list[tuple[int, int]], set]]:
    """For each document that holds a window: its merged spans of words, and the items."""
    if not len(windows.length):
        return {}
    get, parts = windows.vocabulary.get, []
    for w in docs:
        parts.append(np.fromiter((get(x, 0) for x in w), "i4", len(w)))
        parts.append(np.zeros(1, "i4"))
    s = np.concatenate(parts)
    # leave out runs between stops that no window fits in
    stops = np.flatnonzero(s == 0)
    lengths = np.diff(np.concatenate([[-1], stops])) - 1
    fits = np.repeat(lengths >= windows.least, lengths + 1)
    if not fits.any():
        return {}
    where, s = np.flatnonzero(fits), s[fits]
    index = FMIndex(s)
    hit, lo, hi = index.search(windows.table)
    if not len(hit):
        return {}
    counts = hi - lo
    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    window = np.repeat(hit, counts)
    place = where[index.locate(rows)]
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in docs])])
    doc = np.searchsorted(starts, place, "right") - 1
    out: dict[int, tuple[list[tuple[int, int]], set]] = {}
    order = np.lexsort((place, doc))
    for d, p, k in zip(doc[order].tolist(), (place - starts[doc])[order].tolist(), window[order].tolist(), strict=True):
        spans, items = out.setdefault(d, ([], set()))
        end = p + int(windows.length[k])
        if spans and p <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((p, end))
        items.update(windows.items[k])
    return out


_BLOCKS: dict[str, list] = {}


def _blocks(path: str, window: int) -> Iterator[Windows]:
    """The benchmark's blocks. A lone block is kept by the worker for its next tasks."""
    if path in _BLOCKS:
        yield from _BLOCKS[path]
        return
    fs, at = file_system(path)
    import pyarrow.fs as pafs

    files = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(at)) if x.path.endswith(".parquet"))
    for f in files:
        t = pq.read_table(f, filesystem=fs)
        w = Windows(list(zip(t["item_id"].to_pylist(), t["text"].to_pylist(), strict=True)), window)
        if len(files) == 1:
            _BLOCKS.clear()
            _BLOCKS[path] = [w]
        yield w


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted(a + b):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for every row of docs: doc_id, n_words, n_hit, spans array<struct<start, end>> (words, end excluded, merged and
    in order), items array<string> (ids of the items found, sorted as strings), then the columns named in `keep`.

    docs has doc_id and text, benchmark has item_id and text. Null and empty texts have no words; an item without words is never
    found, one with fewer words than a window is found as a whole. Items that share an id count as one; an item with a null
    id is named 'null'. Documents that repeat, rows or texts, are each reported. Touching spans merge.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    path = new_path(spark, "benchmark")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    # a short table; its number of rows sets the number of blocks
    items.repartition(max(1, -(-items.count() // BLOCK_ROWS))).write.parquet(path)
    columns = ["doc_id", *(c for c in dict.fromkeys([*keep, "text"]) if c != "doc_id")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            found: dict[int, tuple[list[tuple[int, int]], set]] = {}
            for block in _blocks(path, window):
                for d, (spans, ids) in find(split, block).items():
                    old = found.get(d)
                    found[d] = (spans, ids) if old is None else (_merge(old[0], spans), old[1] | ids)
            none: tuple[list, set] = ([], set())
            hits = [found.get(k, none) for k in range(len(split))]
            whole = pa.Table.from_batches(held).select(["doc_id", *keep]).combine_chunks()
            arrays = [
                pa.array([len(w) for w in split], pa.int64()),
                pa.array([sum(y - x for x, y in h[0]) for h in hits], pa.int64()),
                pa.array([[{"start": x, "end": y} for x, y in h[0]] for h in hits], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array([sorted(h[1]) for h in hits], pa.list_(pa.string())),
            ]
            names = ["doc_id", "n_words", "n_hit", "spans", "items", *keep]
            return pa.Table.from_arrays([whole["doc_id"], *arrays, *(whole[c] for c in keep)], names)

        held: list[pa.RecordBatch] = []
        split: list[list[bytes]] = []
        total = 0
        for batch in batches:
            at = 0
            for k, text in enumerate(batch["text"]):
                split.append(words(text.as_py()))
                total += len(split[-1])
                if total >= SHARD_WORDS or len(split) >= SHARD_DOCS:
                    held.append(batch.slice(at, k + 1 - at))
                    yield from flush().to_batches()
                    held, split, total, at = [], [], 0, k + 1
            if at < batch.num_rows:
                held.append(batch.slice(at))
        if split:
            yield from flush().to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = f"doc_id {kinds['doc_id']}, n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>"
    return docs.select(*columns).mapInArrow(scan, ", ".join([schema, *(f"`{c}` {kinds[c]}" for c in keep)]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the documents that hold a window of the benchmark; the columns stay, also those named like contamination()'s own. Null and empty texts hold none and stay, rows that repeat
    stay or go together, texts are searched whole, and an empty table or benchmark takes nothing away."""
    clash = {c: f"_kept_{c}" for c in docs.columns if c in ("n_words", "n_hit", "spans", "items")}
    named = docs.withColumnsRenamed(clash)
    found = contamination(named, benchmark, window, tuple(c for c in named.columns if c != "doc_id")).where("n_hit = 0")
    return found.select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns])
