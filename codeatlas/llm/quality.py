"""Quality rules as a ledger of bits.

One pass measures every text. Every rule is evaluated once on the measurements and leaves its failure as a bit of
``failed``, next to the measurements themselves. A policy is a version and a mask of rules that reject; applying one,
comparing two, or asking what a rule alone removes are bitwise operations on the ledger and never read a text again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclaims")


@dataclass(frozen=True)
class Rule:
    """A rule fails where its SQL condition over the measurements is true. Its bit never changes once given."""

    bit: int
    name: str
    fails: str


#: Bits are only ever added. The first two are the base rules.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_word_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "many_symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "duplicate_lines", "n_lines >= 4 AND 10 * n_dup_lines > 6 * n_lines"),
    Rule(4, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)"),
    Rule(5, "many_exclamation_marks", "10 * n_exclaims > 5 * n_words"),
)

BASE = 0b00011


@dataclass(frozen=True)
class Policy:
    version: str
    mask: int


#: v1 is what the queries and the pipeline apply; base is the base rules alone.
POLICIES = {"base": Policy("base", BASE), "v1": Policy("v1", 0b111111)}


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of a text: words are runs without ASCII white space; n_lines counts lines with a word; a duplicate line
    equals an earlier one; n_repeat_words counts words in windows of three that occur more than once; n_exclaims counts exclamation marks."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode().split()  # of bytes: at ASCII white space alone
    n = len(words)
    word_chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    seen, lines, dup = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return (n, word_chars, symbols, lines, dup, _repeat_words(words), text.count("!"))


def _repeat_words(words: list[bytes]) -> int:
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    a = np.fromiter((number.setdefault(w, len(number)) for w in words), "i8", n)
    v = len(number)
    pair = a[:-1] * v + a[1:]
    if v**3 >= 2**63:  # number the pairs, so that the windows' keys stay exact
        pair = np.unique(pair, return_inverse=True)[1].astype("i8")
    key = pair[:-1] * v + a[2:]
    order = key.argsort()
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    cover[:-2] = again
    cover[1:-1] |= again
    cover[2:] |= again
    return int(cover.sum())


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch["text"]
        rows = [measure(text[k].as_py()) for k in range(len(text))]
        arrays = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(MEASURES)
        rest = [n for n in batch.schema.names if n != "_drop"]
        yield pa.RecordBatch.from_arrays([*(batch[n] for n in rest), *arrays], [*rest, *MEASURES])


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns named in `keep`, the MEASURES, and failed long: the bits of the rules that fail. One row per row of docs.

    docs has text and the kept columns; columns of docs that are named like a measure or `failed` are dropped. Null and empty
    texts measure 0 throughout. Rows that repeat are measured alike. Texts are measured whole, however long; an empty table gives an empty one.
    """
    bound_batches(docs.sparkSession)
    keep = tuple(c for c in dict.fromkeys(keep) if c not in (*MEASURES, "failed"))
    columns = [*keep, *(["text"] if "text" not in keep else [])]
    fields = [docs.schema[c] for c in columns]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{m} long" for m in MEASURES)])
    measured = docs.select(*columns).mapInArrow(_measured, schema)
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits + F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long"))
    return measured.withColumn("failed", bits).select(*keep, *MEASURES, "failed")


def rejected(policy: Policy, failed: Column | str = "failed") -> Column:
    failed = F.col(failed) if isinstance(failed, str) else failed
    return failed.bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def ablation(led: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row per rule of the policy: n_fail (rows that fail it), n_only (rows that only it rejects, so the rows that come back without it),
    n_rejected and n_rows of the whole. Rows are first counted by their bits: at most 2^rules groups, whatever the size."""
    masks = led.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    within = F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long"))
    per_rule = [F.struct(F.lit(policy.version).alias("policy"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if policy.mask >> r.bit & 1]
    x = masks.withColumn("within", within).withColumn("r", F.explode(F.array(*per_rule)))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return x.groupBy("r.policy", "r.rule", "r.bit").agg(
        total(F.col("within").bitwiseAND(F.col("r.bit")) != 0).alias("n_fail"),
        total(F.col("within") == F.col("r.bit")).alias("n_only"),
        total(F.col("within") != 0).alias("n_rejected"),
        F.sum("n").alias("n_rows"),
    )


def passing(docs: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    """The rows of docs that the policy keeps, with their columns, also those named like a measure. Null and empty texts measure 0, so policies with a least number of words
    reject them; rows that repeat are kept or go together; an empty table stays empty."""
    clash = {c: f"_kept_{c}" for c in docs.columns if c in (*MEASURES, "failed")}
    named = docs.withColumnsRenamed(clash)
    led = ledger(named, tuple(named.columns)).where(~rejected(policy))
    return led.select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns])
