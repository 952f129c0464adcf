"""Mixing sources to target weights by entropy balancing, with DataFrame expressions only.

Per source the rates r_i of its documents minimise sum(size_i / tilt_i * (r_i log r_i - r_i + 1)), a divergence
from "take each document once", under 0 <= r_i <= cap and the token constraint sum(size_i * r_i) = target. The convex dual has one
variable per source, and its optimum gives exponentially tilted rates r_i = min(cap, exp(lambda * tilt_i)). By default a document's tilt grows
with the logarithm of its size: long documents carry more of a source's change than short ones. Newton's method,
guarded by a bracket, solves the dual on a table of tokens by (source, tilt): every iteration joins the sources' lambdas with it and sums
gradient and curvature in a distributed aggregate. The constraints of different sources share no variable, so the Hessian is diagonal and
all sources iterate at once, until each meets its target.

Rates become whole copies by error diffusion: documents are dealt into cells of about CELL rows of one source,
each cell walks its documents from the largest to the smallest and takes the whole number of copies that keeps
the words taken nearest to the words due. A cell ends within about half its smallest document of its due.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, materialize

#: Documents in one cell of the rounding; bounds what one row of the plan gathers.
CELL = 2048

#: Most steps of the guarded Newton iteration, each of which halves the bracket or gains by the quadratic rate; what may be missing from a target, as a part of it.
NEWTON_STEPS, CLOSE = 80, 1e-9

#: Tilts are rounded to multiples of 1 / TILT_GRID and bounded by MOST_TILT, which bounds a source's histogram; lambdas lie between LOWEST and log(cap) * TILT_GRID.
TILT_GRID, MOST_TILT, LOWEST = 64, 64, -60.0 * 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0) -> DataFrame:
    """(source, n_docs, source_size, target) for rows of (source, size).

    Sources by code point, null last, weigh as `weights` says, over and over, and share the total size by weight.
    Where a share exceeds cap times the source's size, the target stops there and the excess is shared by weight
    among the others until none is above: with sources in order of cap / weight the stopped ones are a prefix, so
    running sums find them. The windows order the sources, never documents.
    """
    s = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, len(weights)) + 1).cast("int")))
    s = s.withColumn("most", cap * F.col("source_size").cast("double"))
    rising = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    free = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(rising), F.lit(0.0))
    level = free / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(rising), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("stopped", F.col("most") < F.col("level") * F.col("weight"))
    # the level is right at the first source that isn't stopped, and stays so for all after it
    final = F.min(F.when(~F.col("stopped"), F.struct(F.col("most") / F.col("weight"), F.col("level").alias("level")))).over(whole)["level"]
    return s.select("source", "n_docs", "source_size", F.least(F.col("most"), F.coalesce(final * F.col("weight"), F.col("most"))).alias("target"))


def length_tilt(size: Column) -> Column:
    """A document's tilt by its size: 1 for a word, and 1 more for each doubling."""
    return F.log2(size + 1)


def rates(sizes: DataFrame, targets: DataFrame, cap: float = 3.0) -> DataFrame:
    """(source, n_docs, source_size, target, lam) for rows (source, size, tilt): sum(size * min(cap, exp(lam * tilt))) is the target.

    A step reads the histogram, of a row per source and tilt, and writes a row per source; only the number of sources that aren't done comes to the driver.
    """
    hist = sizes.where("size > 0").groupBy("source", "tilt").agg(F.sum("size").cast("double").alias("tokens"))
    hist = materialize(hist, "histogram")
    rate = F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.col("tilt")))
    most = math.log(cap) * TILT_GRID
    # targets of nothing, and of cap times the size, are met at the ends of the bracket
    full = F.col("target") >= cap * F.col("source_size") * (1 - CLOSE)
    state = targets.select(
        "source", "n_docs", "source_size", "target", F.when(F.col("target") <= 0, LOWEST).when(full, most).otherwise(0.0).alias("lam"),
        F.lit(LOWEST).alias("lo"), F.lit(most).alias("hi"), ((F.col("target") <= 0) | full).alias("done"),
    )
    state = materialize(state, "lambdas")
    for _ in range(NEWTON_STEPS):
        if not state.where("not done").take(1):
            break
        at = state.where("not done").select(F.col("source").alias("_s"), "lam")
        sums = hist.join(at, hist.source.eqNullSafe(F.col("_s"))).groupBy("_s").agg(
            F.sum(F.col("tokens") * rate).alias("taken"), F.sum(F.when(rate < cap, F.col("tokens") * F.col("tilt") * rate).otherwise(0.0)).alias("slope")
        )
        s = state.join(sums, state.source.eqNullSafe(F.col("_s")), "left")
        excess = F.col("taken") - F.col("target")
        lo, hi = F.when(excess < 0, F.col("lam")).otherwise(F.col("lo")), F.when(excess >= 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - excess / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > lo) & (newton < hi)
        met = F.abs(excess) <= CLOSE * F.col("target")
        s = s.select(
            "source", "n_docs", "source_size", "target",
            F.when(F.col("done") | met, F.col("lam")).when(inside, newton).otherwise((lo + hi) / 2).alias("lam"),
            F.when(F.col("done"), F.col("lo")).otherwise(lo).alias("lo"), F.when(F.col("done"), F.col("hi")).otherwise(hi).alias("hi"), (F.col("done") | met).alias("done"),
        )
        state = materialize(s, "lambdas")
    return state.select("source", "n_docs", "source_size", "target", "lam")


def _diffuse(cell: Column, cap: int) -> Column:
    """Copies for a cell's entries (size, doc_id, n, rate), largest first: array<struct<doc_id, size, copies>>."""
    none = F.array().cast("array<struct<doc_id:bigint,size:bigint,tilt:double,copies:bigint>>")

    def step(a: Column, x: Column) -> Column:
        due = a["due"] + x["rate"] * x["size"] * x["n"]
        copies = F.greatest(F.lit(0), F.least(F.lit(cap), F.round(due / F.greatest(x["size"] * x["n"], F.lit(1)), 0))).cast("long")
        copies = F.when(x["size"] > 0, copies).otherwise(F.round(x["rate"], 0).cast("long"))
        return F.struct(
            (due - copies * x["size"] * x["n"]).cast("double").alias("due"),
            F.concat(a["out"], F.array(F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["tilt"].alias("tilt"), copies.alias("copies")))).alias("out"),
        )

    return F.aggregate(cell, F.struct(F.lit(0.0).cast("double").alias("due"), none.alias("out")), step)["out"]


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: int = 3, tilt: Column | None = None) -> DataFrame:
    """docs with size, source_size, target and copies (0 to cap): take each row that many times.

    docs has doc_id, text and source; other columns pass through, but columns named size, source_size, target or
    copies are replaced. Null text has size 0; a null source is a source of its own, last in order; null doc_ids
    are alike. Rows that repeat a doc_id with an equal source, size and tilt get equal copies. A source of size 0 has
    target 0 and its rows no copies. Texts are only counted, whatever their length; ties are ordered by hashes of doc_id. An empty table stays empty.
    Copies depend on doc_id, source, size and tilt alone, so reruns agree. `tilt` is a positive column that says how strongly a row's rate reacts (null: 1;
    default: length_tilt of its size; F.lit(1) gives all documents of a source one rate).
    """
    docs = docs.drop("size", "source_size", "target", "copies", "_tilt")
    sized = docs.withColumn("size", word_count(F.col("text")))
    strength = length_tilt(F.col("size")) if tilt is None else F.coalesce(tilt.cast("double"), F.lit(1.0))
    sized = sized.withColumn("_tilt", F.least(F.lit(float(MOST_TILT)), F.greatest(F.lit(1), F.round(strength * TILT_GRID)) / TILT_GRID))
    # narrow, and read several times: the texts are counted here and once more where copies meet the rows
    entries = materialize(sized.select("doc_id", "source", "size", F.col("_tilt").alias("tilt")), "sizes")
    solved = rates(entries, source_targets(entries, weights, cap), cap)
    # source tables hold a row per source; the join is left to the planner, which splits a hot source if it shuffles
    e = entries.groupBy("doc_id", "source", "size", "tilt").agg(F.count(F.lit(1)).alias("n"))
    e = e.join(solved, e.source.eqNullSafe(solved.source)).drop(solved.source)
    e = e.withColumn("rate", F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.col("tilt"))))
    cell = F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("n_docs") / CELL))
    cells = e.withColumn("cell", cell).groupBy("source", "source_size", "target", "cell").agg(
        F.sort_array(F.collect_list(F.struct("size", F.xxhash64("doc_id", F.lit(3)).alias("h"), "doc_id", "n", "rate", "tilt")), asc=False).alias("entries")
    )
    out = cells.select("source", "source_size", "target", F.explode(_diffuse(F.col("entries"), cap)).alias("c")).select("source", "source_size", "target", "c.*")
    same = sized.doc_id.eqNullSafe(out.doc_id) & sized.source.eqNullSafe(out.source) & (sized["size"] == out["size"]) & (sized["_tilt"] == out["tilt"])
    return sized.join(out, same).drop(out.doc_id).drop(out.source).drop(out["size"]).drop(out.tilt).drop("_tilt")


def copies(mixed: DataFrame) -> DataFrame:
    """Every row as often as its copies say, without the mixing's own columns; null copies give no rows, an empty table none. Texts are passed on as they are."""
    repeated = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed.where("copies > 0").withColumn("_copy", repeated).drop("_copy", "copies", "size", "source_size", "target")


def repeated(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: int = 3) -> DataFrame:
    """The rows of docs as often as mix() takes them, with exactly their columns, those named like mix()'s own too. Empty texts, nulls, repeated rows and empty tables as in mix()."""
    clash = {c: f"_kept_{c}" for c in docs.columns if c in ("size", "source_size", "target", "copies")}
    return copies(mix(docs.withColumnsRenamed(clash), weights, cap)).select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns])
