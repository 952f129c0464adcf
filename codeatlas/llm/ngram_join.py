"""N-gram Jaccard join with PartEnum signatures.

Sets are put into bands of similar size. Within a band with largest size r, sets of a Jaccard similarity of at least
t differ in at most k = floor((1 - t) / (1 + t) * 2r) features. The domain of features is hashed into n1 first-level
partitions with n1 > k / 2, so of any such two sets some partition differs in at most one feature; it is split into three, and
each subset of two of the three gives a signature, one of which must agree. A set whose size reaches into the next band is entered there,
too. Subsets without features give no signature unless the set has so few full partitions that it needs them (then each partner
needs them as well), so the join is exact: every similar pair shares a signature, and candidates are verified on their sets. Some
spare partitions make such sets rare.

Features that very many sets hold would make signatures of nothing but boilerplate. Leaving any fixed features out of all sets can only lower
the number of differences, so signatures are taken from the other features alone; sets that are left with too few full partitions add
signatures of all their features, as does each partner that has too few. What is left out is a matter of speed, never of results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._common import bound_batches, materialize, maybe_broadcast, new_path
from ._files import file_system
from ._links import link_components
from ._words import _M1, _M2, _S32, Words, mix

#: Growth of band limits, and words in a shingle.
GROWTH, SHINGLE = 1.5, 4

#: A feature is common if COMMON_LOCAL sets of a run of COMMON_CHUNK features hold it; the COMMON_MOST most frequent ones are left out of signatures.
COMMON_LOCAL, COMMON_CHUNK, COMMON_MOST = 8, 1_000_000, 200_000

def _spread(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows of word hashes."""
    size = max(0, len(h) - n + 1)
    out = np.zeros(size, "u8")
    for j in range(n):
        out = mix(out + h[j : j + size])
    return out


def shingles(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """The sorted set of hashed n-word shingles of word hashes; with fewer words, of the whole sequence; none without words."""
    return np.unique(_spread(h, min(n, len(h)))) if len(h) else np.zeros(0, "u8")


def many_shingles(texts: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """shingles() of many texts, hashed in one go; a batch of a few megabytes at most."""
    words = Words(texts)
    grams = _spread(words.hash, n)
    ends = words.first.tolist()
    return [np.unique(grams[a : b - n + 1]) if b - a >= n else shingles(words.hash[a:b], n) for a, b in zip(ends, ends[1:], strict=False)]


def text_set(n: int = SHINGLE):
    """A text's set: its words are A-Z lower-cased and split at ASCII white space."""
    return lambda text: shingles(Words.of(text).hash, n)


def set_key(s: np.ndarray) -> int:
    """A number that stands for a set; equal sets have equal numbers."""
    return xxhash.xxh64_intdigest(s.tobytes(), seed=len(s)) - 2**63


def bands(percent: int, most: int) -> list[tuple[int, int, int]]:
    """(largest size, k, n1) of the bands, from the smallest size that can have an unequal partner up to beyond `most`."""
    out, r = [], 0
    while not out or out[-1][0] < most:
        r = max(r + 1, int(r * GROWTH)) if r else -(-percent // (100 - percent)) + 1
        k = (100 - percent) * 2 * r // (100 + percent)
        out.append((r, k, k // 2 + 1 + max(2, k // 32)))  # spare ones make sets rare that need signatures without features
    return out


def signatures(s: np.ndarray, percent: int, limits: list[tuple[int, int, int]], common: np.ndarray | None = None) -> np.ndarray:
    """The signatures of one set, as signed 64-bit numbers; `common` is the sorted array of features to leave out."""
    n, out = len(s), []
    some = s
    if common is not None and len(common) and n:
        at = np.searchsorted(common, s)
        at[at == len(common)] = 0
        some = s[common[at] != s]
    reach = n * 100 // percent  # the largest partner
    if reach <= n:  # only equal sets are similar
        return np.zeros(0, "i8")
    low = 0
    for band, (r, _, n1) in enumerate(limits):
        # the set itself, or as the smaller partner of sets in this band
        if n <= r and reach > low:
            most = (100 - percent) * (n + min(r, reach)) // (100 + percent)  # differences from any partner in this band, k at most
            sig, enough = _band_signatures(some, band, most, n1)
            out.append(sig)
            if not enough:
                sig, enough = _band_signatures(s, band + 1000, most, n1)
                out.append(sig if enough else _band_signatures(s, band + 1000, most, n1, empty=True)[0])
        if reach <= r:
            break
        low = r
    return np.concatenate(out).view("i8") if out else np.zeros(0, "i8")


def _band_signatures(s: np.ndarray, band: int, k: int, n1: int, empty: bool = False) -> tuple[np.ndarray, bool]:
    """(signatures of the subsets that hold features, or of all, whether they suffice by themselves)."""
    cell = (((s >> _S32) * np.uint64(3 * n1)) >> _S32).astype("i8")  # the upper half of the hash picks one of 3 * n1 cells
    sums = np.zeros(3 * n1, "u8")
    np.add.at(sums, cell, mix(s))
    full = np.bincount(cell, minlength=3 * n1).reshape(n1, 3) > 0
    sums = sums.reshape(n1, 3)
    place = np.arange(3 * n1, dtype="u8").reshape(n1, 3) * _M1 + np.array([band], "u8") * _M2
    a, b = np.array([0, 0, 1]), np.array([1, 2, 2])
    sig = mix(mix(sums[:, a] + place) + sums[:, b])
    # to leave no common subset that holds features, two differences are needed in a partition with two full cells, one with one
    cells = full.sum(axis=1)
    enough = bool(2 * (cells >= 2).sum() + (cells == 1).sum() > k)
    return (sig.ravel() if empty else sig[full[:, a] | full[:, b]]), enough


def _set_rows(n: int):
    """(doc_id, n_shingles, item) of every document; and with n_shingles = -count, (null, -count, feature) of locally common features."""

    def row_batch(ids, sizes, items) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(items, pa.int64())], ["doc_id", "n_shingles", "item"])

    def common(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if held:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= COMMON_LOCAL
            yield row_batch(pa.nulls(int(often.sum()), pa.int64()), -counts[often], values[often].view("i8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0
        for batch in batches:
            sets = many_shingles(batch["text"], n)
            yield row_batch(batch["doc_id"], [len(s) for s in sets], [set_key(s) if len(s) else None for s in sets])
            held += sets
            total += sum(map(len, sets))
            if total > COMMON_CHUNK:
                yield from common(held)
                held, total = [], 0
        yield from common(held)

    return run


_COMMON: dict[str, np.ndarray] = {}


def _common_features(path: str) -> np.ndarray:
    if path not in _COMMON:
        import pyarrow.dataset as ds

        fs, at = file_system(path)
        _COMMON.clear()
        _COMMON[path] = np.sort(ds.dataset(at, filesystem=fs, format="parquet").to_table(columns=["item"])["item"].to_numpy().astype("i8").view("u8"))
    return _COMMON[path]


def _signature_rows(n: int, percent: int, common_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a partition give their signatures once
        limits, common = bands(percent, 1 << 10), _common_features(common_path)
        for batch in batches:
            sigs, items, held = [], [], 0
            for s in many_shingles(batch["text"], n):
                key = set_key(s) if len(s) else None
                if key is None or key in seen:
                    continue
                seen.add(key)
                if 2 * len(s) > limits[-1][0]:
                    limits = bands(percent, 4 * len(s))
                x = signatures(s, percent, limits, common)
                sigs.append(x)
                items.append(np.full(len(x), key, "i8"))
                held += len(x)
                if held > 200_000:
                    yield _pairs(sigs, items)
                    sigs, items, held = [], [], 0
            if sigs:
                yield _pairs(sigs, items)

    return run


def _pairs(sigs: list[np.ndarray], items: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(items))], ["sig", "id"])


def join_components(docs: DataFrame, percent: int = 85, n: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    docs has doc_id (a long) and text; other columns are ignored. Documents are linked whose sets of n-word shingles have a Jaccard
    similarity of percent / 100 or more, compared in whole numbers; component_id is the smallest doc_id that links reach. A row with a
    null doc_id is linked with nothing and has a null component_id. Null texts and texts without words have no shingles and are linked with nothing. Rows that share a doc_id are separate documents that answer alike if
    their sets do. Equal sets collapse into one item before anything is compared, so copies cost one row each.
    """
    sets, lowest = _linked(docs, percent, n)
    roots = lowest.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    item_roots = lowest.join(roots, "root").select("item", "component_id")
    out = sets.join(materialize(item_roots, "item_roots"), "item", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _linked(docs: DataFrame, percent: int, n: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n_shingles, item) of every row, (item, root, doc_id) of every set: its component and the smallest doc_id that has it)."""
    bound_batches(docs.sparkSession)
    d = docs.select("doc_id", "text")
    rows = materialize(d.mapInArrow(_set_rows(n), "doc_id long, n_shingles long, item long"), "sets")
    sets = rows.where("n_shingles >= 0")
    often = rows.where("n_shingles < 0").groupBy("item").agg(F.sum("n_shingles").alias("n")).orderBy("n", "item").limit(COMMON_MOST).select("item")
    common_path = new_path(docs.sparkSession, "common")
    often.write.parquet(common_path)
    sigs = d.where("doc_id is not null").select("text").mapInArrow(_signature_rows(n, percent, common_path), "sig long, id long")
    owners = sets.where("item is not null and doc_id is not null").groupBy("item").agg(F.min("doc_id").alias("doc_id"))

    def texts(ids: DataFrame, count: int) -> DataFrame:
        of = materialize(owners.join(maybe_broadcast(ids.withColumnRenamed("id", "item"), count), "item"), "owners")
        # a few ids go to every task; many meet the documents in a shuffle join. Rows of a doc_id that have another set are left out.
        found = d.join(maybe_broadcast(of, count), "doc_id")
        return found.mapInArrow(_checked(n), "id long, text string")

    get = text_set(n)
    comps = link_components(sigs, texts, lambda column: (get(t.as_py()) for t in column), percent)  # documents are long: one at a time
    lowest = owners.join(comps, owners.item == comps.id, "left").select("item", F.coalesce("root", "item").alias("root"), "doc_id")
    return sets, materialize(lowest, "lowest")


def _with_item(n: int):
    get = text_set(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [set_key(s) if len(s := get(t.as_py())) else None for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(items, pa.int64())], [*batch.schema.names, "_item"])

    return run


def _checked(n: int):
    get = text_set(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t.as_py()) for i, t in zip(batch["item"].to_pylist(), batch["text"], strict=True)]
            rows = [(i, t) for i, t in rows if len(s := get(t)) and set_key(s) == i]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["id", "text"])

    return run


def one_of_each(docs: DataFrame, percent: int = 80, n: int = 5) -> DataFrame:
    """The rows of docs, with their columns, of which each component keeps one: of its smallest doc_id, and of the smallest set key among
    rows that share that. Rows without a doc_id are compared, too, and come last. Rows without words all stay: null and empty texts are like nothing. Ties
    are settled by doc_id, set key and text, texts are compared whole, other columns pass through, and an empty table stays empty."""
    last = F.lit(1 << 62) + F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1))  # a stand-in, so that they don't meet each other in joins by id
    d = docs.withColumn("_id", F.coalesce("doc_id", last))
    sets, lowest = _linked(d.select(F.col("_id").alias("doc_id"), "text"), percent, n)
    keepers = lowest.groupBy("root").agg(F.min(F.struct("doc_id", "item")).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.item").alias("_item"))
    keepers = materialize(keepers, "keepers")
    per = materialize(sets.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("rows"), F.min("item").alias("_item")), "ids")
    many = per.where("rows > 1").select("_id")
    gone = per.where("rows = 1 and _item is not null").join(keepers, ["_id", "_item"], "left_anti").select("_id")
    gone = materialize(gone.unionByName(many), "gone")
    out = d.join(maybe_broadcast(gone, gone.count()), "_id", "left_anti").select(*docs.columns)
    if not many.take(1):
        return out
    # rows that share an id are told apart by their sets
    schema = StructType([*d.schema.fields, StructField("_item", LongType())])
    rest = d.join(many, "_id", "left_semi").select(*d.columns).mapInArrow(_with_item(n), schema)
    one = rest.join(keepers, ["_id", "_item"], "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_item").orderBy("text"))).where("_n = 1")
    return out.unionByName(rest.where("_item is null").select(*docs.columns)).unionByName(one.select(*docs.columns))
