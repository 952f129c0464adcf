"""Ranked lexical search over inverted treaps.

Documents stay where they are read. A task takes its documents in blocks of bounded size and turns each block into an inverted treap per query term: nodes are the term's
documents, in search order of doc_id and in heap order of impact (what an occurrence is worth before the term's weight), so a node holds the largest impact of its
range of documents. All queries run over a block while it is in memory. A query walks its terms' treaps at once: a state is a range of documents and one node for each term, and
the weighted sum of the nodes' impacts bounds every score in the range. Ranges whose bound is below the k-th best score so far are dropped with all below them; others are
split at the document of the node that contributes most; small ranges are scored exactly. The k best of each task are merged by an aggregate.

Counts (documents, terms, document frequencies of query terms) come from a first pass over all documents. Documents are never shuffled, and nothing of their size is collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bound_batches
from ._words import mix

#: A block ends once it has so many bytes of text.
BLOCK_BYTES = 24_000_000
#: Texts of queries that are sent to tasks at once; more are searched in several passes.
QUERY_BYTES = 4_000_000
#: Ranges of so few documents are scored, not split; so many ranges are looked at in one step.
LEAF, STEP = 16, 256
#: Tasks' results are merged in so many groups, and these in one.
MERGE_GROUPS = 128

_FOLD = np.arange(256, dtype="u1")
_FOLD[65:91] += 32
_TERM = np.ones(256, bool)
_TERM[:128] = [chr(c).isalnum() for c in range(128)]
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def occurrences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, size, data) of every term of a column of strings; data holds the column's bytes, A-Z lower-cased, and eight more. A term is a run of letters and digits of
    ASCII and of characters beyond it; null has none."""
    column = column.fill_null("") if column.null_count else column
    kind = "i8" if pa.types.is_large_string(column.type) else "i4"
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype("i8") if len(column) else np.zeros(1, "i8")
    size = int(offsets[-1] - offsets[0])
    data = np.zeros(size + 8, "u1")
    if size:
        data[:size] = _FOLD[np.frombuffer(column.buffers()[2], "u1", size, int(offsets[0]))]
    rows = offsets - offsets[0]
    inside = np.zeros(size + 2, bool)
    inside[1:-1] = _TERM[data[:size]]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = rows[(rows > 0) & (rows < size)]
    first[edges], last[edges - 1] = inside[1:-1][edges], inside[1:-1][edges - 1]
    start = np.flatnonzero(first)
    return np.searchsorted(rows, start, "right") - 1, start, np.flatnonzero(last) + 1 - start, data


def _eight(data: np.ndarray) -> np.ndarray:
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))


def _masked(eight: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place, the rest as zeros."""
    keep = np.clip(left, 0, 8).astype("u8")
    mask = np.where(keep == 8, ~np.uint64(0), (np.uint64(1) << (keep * np.uint64(8))) - np.uint64(1))
    return eight[np.minimum(at, len(eight) - 1)] & mask


class Vocabulary:
    """The distinct terms of queries: number of a term, looked up for many occurrences at once. Hashes only find candidates; bytes decide."""

    def __init__(self, terms: list[bytes]):
        self.size = len(terms)
        data = np.frombuffer(b"".join(terms) + bytes(8), "u1")
        self.length = np.array([len(t) for t in terms], "i8")
        self.start = np.cumsum(self.length) - self.length
        self.eight = _eight(data)
        head = _masked(self.eight, self.start, self.length)
        self.key = mix(head ^ (self.length.astype("u8") * _PRIME))
        self.order = np.argsort(self.key, kind="stable")
        self.sorted = self.key[self.order]
        self.most = int(np.max(np.unique(self.key, return_counts=True)[1], initial=0))

    def find(self, start: np.ndarray, size: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The number of the term at each place, -1 where it is none. Terms that share length and first eight bytes share a key and are tried in turn."""
        out = np.full(len(start), -1, "i8")
        if not self.size or not len(start):
            return out
        eight = _eight(data)
        key = mix(_masked(eight, start, size) ^ (size.astype("u8") * _PRIME))
        low = np.searchsorted(self.sorted, key)
        for k in range(self.most):
            at = np.minimum(low + k, self.size - 1)
            open_ = np.flatnonzero((out < 0) & (self.sorted[at] == key))
            term = self.order[at[open_]]
            same = self.length[term] == size[open_]
            open_, term = open_[same], term[same]
            good, step = np.ones(len(open_), bool), 0
            while True:
                more = np.flatnonzero(good & (size[open_] > step))
                if not len(more):
                    break
                o, t = open_[more], term[more]
                good[more] = _masked(eight, start[o] + step, size[o] - step) == _masked(self.eight, self.start[t] + step, self.length[t] - step)
                step += 8
            out[open_[good]] = term[good]
        return out


def treaps(doc: np.ndarray, impact: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, root) of the treaps of many lists that lie end to end: list t has nodes first[t] to first[t + 1], sorted by doc. Nodes of equal impact are put in an order that
    looks random, which keeps treaps flat. len(doc) stands for no node.

    A node's parent is the lesser of the nearest larger nodes on both sides. These are found for all nodes at once: a candidate that isn't larger is replaced by its own
    candidate, for nothing between the two can be larger either.
    """
    n = len(doc)
    lists = len(first) - 1
    noise = mix(np.arange(n, dtype="u8") * _PRIME) >> np.uint64(33)
    order = np.lexsort((noise, impact))
    rank = np.empty(n, "i8")
    rank[order] = np.arange(n)
    owner = np.repeat(np.arange(lists), np.diff(first))
    value = np.append(rank, n)  # the sentinel is larger than all
    before, after = np.arange(n) - 1, np.arange(n) + 1
    before[first[:-1][np.diff(first) > 0]] = n
    after[first[1:][np.diff(first) > 0] - 1] = n
    for near in (before, after):
        wide = np.append(near, n)
        todo = np.flatnonzero(value[near] < rank)
        while len(todo):
            wide[todo] = wide[wide[todo]]
            todo = todo[value[wide[todo]] < rank[todo]]
        near[:] = wide[:-1]
    left, right, root = np.full(n + 1, n), np.full(n + 1, n), np.full(lists, n)
    node = np.arange(n)
    alone = (before == n) & (after == n)
    root[owner[alone]] = node[alone]
    low = ~alone & (value[before] < value[after])
    right[before[low]] = node[low]
    high = ~alone & ~low
    left[after[high]] = node[high]
    return left, right, root


class Block:
    """Documents in order of id, a treap per term over them, and each document's terms."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, terms: int):
        """doc, term, tf: one posting each; m: by document."""
        self.n = len(m)
        by = np.lexsort((doc, term))
        self.doc, term, tf = doc[by], term[by], tf[by]
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc]) if len(tf) else tf
        self.first = np.searchsorted(term, np.arange(terms + 1))
        self.left, self.right, self.root = treaps(self.doc, self.impact, self.first)
        by = np.argsort(self.doc, kind="stable")
        self.own_term, self.own_impact = term[by], self.impact[by]
        self.own_first = np.searchsorted(self.doc[by], np.arange(self.n + 1))
        self.doc, self.impact = np.append(self.doc, -1), np.append(self.impact, 0)

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores of documents; weight is by term, 0 for those not asked."""
        lo, n = self.own_first[docs], self.own_first[docs + 1] - self.own_first[docs]
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        sums = np.concatenate([[0], np.cumsum(weight[self.own_term[at]] * self.own_impact[at])])
        ends = np.cumsum(n)
        return sums[ends] - sums[ends - n]

    def search(self, terms: np.ndarray, weight: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) among which are the k best, lower ids first among equals, of those that score `floor` at least. floor: above 0."""
        none = len(self.doc) - 1
        terms = terms[(self.root[terms] != none) & (weight[terms] > 0)]
        w = weight[terms]
        lo, hi, node = np.zeros(1, "i8"), np.full(1, self.n), self.root[terms][None, :]
        bound = self.impact[node] @ w
        best, score = np.zeros(0, "i8"), np.zeros(0, "i8")
        while True:
            keep = (bound >= floor) & (lo < hi)
            lo, hi, node, bound = lo[keep], hi[keep], node[keep], bound[keep]
            if not len(lo):
                return best, score
            if len(lo) > STEP:  # the most promising ranges first
                now = np.zeros(len(lo), bool)
                now[np.argpartition(bound, len(lo) - STEP)[-STEP:]] = True
            else:
                now = np.ones(len(lo), bool)
            a, b, v = lo[now], hi[now], node[now]
            small = b - a <= LEAF
            size = np.where(small, b - a, 0)
            ranged = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
            a, b, v = a[~small], b[~small], v[~small]
            split = self.doc[v[np.arange(len(a)), np.argmax(self.impact[v] * w, axis=1)]] if len(a) else a
            docs = np.concatenate([ranged, split])
            best, score = self._best(np.concatenate([best, docs]), np.concatenate([score, self.scores(docs, weight)]), k, floor)
            if len(best) == k:
                floor = max(floor, int(score[-1]))
            new_lo, new_hi = np.concatenate([a, split + 1]), np.concatenate([split, b])
            new = self._below(np.concatenate([v, v]), new_lo, new_hi, none)
            lo, hi, node = np.concatenate([lo[~now], new_lo]), np.concatenate([hi[~now], new_hi]), np.concatenate([node[~now], new])
            bound = np.concatenate([bound[~now], self.impact[new] @ w])

    @staticmethod
    def _best(docs: np.ndarray, score: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        keep = score >= floor
        docs, score = docs[keep], score[keep]
        by = np.lexsort((docs, -score))[:k]
        return docs[by], score[by]

    def _below(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray, none: int) -> np.ndarray:
        """The root of each treap's part within a range: down from a node until its document lies inside."""
        flat, terms = node.ravel().copy(), node.shape[1]
        lo, hi = np.repeat(lo, terms), np.repeat(hi, terms)
        at = np.arange(len(flat))
        while len(at):
            d = self.doc[flat[at]]
            low, high = d < lo[at], d >= hi[at]
            out = (low | high) & (flat[at] != none)
            at, low = at[out], low[out]
            flat[at] = np.where(low, self.right[flat[at]], self.left[flat[at]])
        return flat.reshape(node.shape)


def _postings(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, tf) of query terms, and the number of all terms by document."""
    row, start, size, data = occurrences(texts)
    n = np.bincount(row, minlength=len(texts)).astype("i8")
    term = vocabulary.find(start, size, data)
    key, tf = np.unique(row[term >= 0] * np.int64(max(1, vocabulary.size)) + term[term >= 0], return_counts=True)
    return key // max(1, vocabulary.size), key % max(1, vocabulary.size), tf.astype("i8"), n


def _counts(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, terms = np.zeros(vocabulary.size, "i8"), 0, 0
        for batch in batches:
            for part in _slices(batch):
                _, term, _, n = _postings(part["text"], vocabulary)
                df += np.bincount(term, minlength=vocabulary.size)
                docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array([-2, -1, *some.tolist()], pa.int64()), "c": pa.array([docs, terms, *df[some].tolist()], pa.int64())})

    return run


def _slices(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have so many bytes at most, or one row."""
    sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype("i8"))
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def _searcher(vocabulary: Vocabulary, items: list[np.ndarray], weight: np.ndarray, N: int, L: int, k: int):
    """Search of every item over the documents of a task: rows (item, score, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [pd.DataFrame({"score": pd.Series(dtype="i8"), "none": pd.Series(dtype=bool), "doc_id": pd.Series(dtype="i8")}) for _ in items]
        held: list[tuple] = []

        def flush() -> None:
            ids, none = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            n = np.concatenate([h[5] for h in held])
            base = np.cumsum([0, *[len(h[0]) for h in held]])
            doc = np.concatenate([h[2] + b for h, b in zip(held, base)])
            by = np.lexsort((ids, none))
            place = np.empty(len(by), "i8")
            place[by] = np.arange(len(by))
            ids, none, n = ids[by], none[by], n[by]
            block = Block(place[doc], np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held]), 10 + (90 * n * N) // max(1, L), vocabulary.size)
            held.clear()
            asked = np.zeros(vocabulary.size, "i8")
            for i, terms in enumerate(items):
                floor = int(best[i]["score"].iloc[-1]) if len(best[i]) == k else 1
                asked[terms] = weight[terms]
                docs, score = block.search(terms, asked, k, floor)
                asked[terms] = 0
                if len(docs):
                    new = pd.DataFrame({"score": score, "none": none[docs], "doc_id": ids[docs]})
                    best[i] = pd.concat([best[i], new]).sort_values(["score", "none", "doc_id"], ascending=[False, True, True], kind="stable")[:k]

        size = 0
        for batch in batches:
            for part in _slices(batch):
                doc, term, tf, n = _postings(part["text"], vocabulary)
                ids = part["doc_id"]
                held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), doc, term, tf, n))
                size += part["text"].nbytes
                if size >= BLOCK_BYTES:
                    flush()
                    size = 0
        if held:
            flush()
        found = pd.concat([b.assign(item=i) for i, b in enumerate(best)])
        doc_id = pa.array(found["doc_id"].to_numpy("i8"), pa.int64(), mask=found["none"].to_numpy(bool))
        yield pa.RecordBatch.from_arrays([pa.array(found["item"].to_numpy("i8")), pa.array(found["score"].to_numpy("i8")), doc_id], ["item", "score", "doc_id"])

    return run


def rank(documents: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id integer, text) of each query (item_id, text) that score above 0, equal scores by ascending doc_id.

    Weights, impacts and scores are those of the formula in `_weight` and `Block`, in whole numbers. Rows of one item_id are one query with all their terms; those without an id are
    one, too. Rows of documents are ranked each by itself, even if they share a doc_id; those without one come last among equals. Null and empty texts have no terms, and
    queries without terms give no rows. Texts may have any length: a long one is a block of its own. Other columns are left alone. Without documents or queries the result is empty.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = queries.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = None
    for ids, texts in _query_blocks(asked):
        found = _rank_block(docs, ids, texts, k, asked.schema["item_id"].dataType)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    return out


def _query_blocks(asked: DataFrame) -> Iterator[tuple[list, list[list[str]]]]:
    """Queries one after another in blocks of bounded size, each as its id and texts."""
    whole = asked.groupBy("item_id").agg(F.sort_array(F.collect_list("text")).alias("texts")).orderBy("item_id")
    ids, texts, size = [], [], 0
    for r in whole.toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += sum(map(len, r[1]))
        if size >= QUERY_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _weight(N: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * N + 2) / (2 * df + 1)))


def _rank_block(docs: DataFrame, ids: list, texts: list[list[str]], k: int, kind) -> DataFrame:
    spark = docs.sparkSession
    numbers: dict[bytes, int] = {}
    items = []
    for group in texts:
        _, start, size, data = occurrences(pa.array(group, pa.large_string()))
        words = {data[s : s + n].tobytes() for s, n in zip(start.tolist(), size.tolist())}
        items.append(np.array(sorted(numbers.setdefault(w, len(numbers)) for w in sorted(words)), "i8"))
    vocabulary = Vocabulary(list(numbers))
    sums = dict(docs.select("text").mapInArrow(_counts(vocabulary), "term long, c long").groupBy("term").agg(F.sum("c")).collect())
    N, L = sums.get(-2, 0), sums.get(-1, 0)
    weight = np.array([_weight(N, sums.get(t, 0)) for t in range(vocabulary.size)], "i8")
    found = docs.mapInArrow(_searcher(vocabulary, items, weight, N, L, k), "item long, score long, doc_id long")
    order = F.col("score").desc(), F.col("doc_id").asc_nulls_last()
    found = found.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
    for keys in (["item", "_group"], ["item"]):  # the best of groups of tasks, then of all
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {kind.simpleString()}")  # one block of queries
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
