"""Long conversations, logs with cuts in random order, and masks over long strings, against plain Python."""

import random

from pyspark.sql import functions as F

from codeatlas.llm import chat


def fold(events):
    """(turn, role, text) of one conversation's events."""
    by = {}
    for seq, kind, turn, role, text in events:
        by.setdefault(turn, []).append((seq, kind in ("delta",), kind, role or "", role, text or ""))
    out = []
    for turn, log in sorted(by.items()):
        log.sort(key=lambda x: x[:4] + (x[5],))
        opened = [x[0] for x in log if x[2] in ("start", "edit")]
        if not opened:
            continue
        cuts = [x[0] for t, other in by.items() if t < turn for x in other if x[2] == "regenerate" and any(y[2] in ("start", "edit") for y in other)]
        if any(c > max(opened) for c in cuts):
            continue
        resets = [k for k, x in enumerate(log) if not x[1]]
        last = log[resets[-1]]
        text = last[5] + "".join(x[5] for x in log if x[1] and x[0] >= last[0])
        roles = [x[4] for x in log if x[4] is not None]
        out.append((turn, roles[-1] if roles else "", text))
    return out


def test_folding_random_logs(spark):
    rng = random.Random(11)
    logs = {}
    for conv in range(12):
        seq, log = 0, []
        for _ in range(rng.randint(1, 60)):
            seq += 1
            log.append((seq, rng.choice(["start", "delta", "delta", "edit", "regenerate"]), rng.randrange(12), rng.choice(["user", "assistant"]), rng.choice(["a", "b<", "", None])))
        logs[conv] = log
    df = spark.createDataFrame([(c, *e) for c, log in logs.items() for e in log], "conv_id long, seq long, kind string, turn long, role string, text string")
    got = {}
    for r in chat.fold_rows(df).collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert {c: sorted(m) for c, m in got.items()} == {c: fold(log) for c, log in logs.items() if fold(log)}
    arrays = {r.conv_id: [tuple(m) for m in r.messages] for r in chat.fold_events(df).collect()}
    assert arrays == {c: sorted(m) for c, m in got.items()}
    by_row = {r.conv_id: (r.formatted, r.loss_mask) for r in chat.render_rows(chat.fold_rows(df)).collect()}
    by_array = {r.conv_id: (r.formatted, r.loss_mask) for r in chat.render(chat.fold_events(df)).collect()}
    assert by_row == by_array


def test_a_conversation_of_twenty_thousand_turns(spark):
    n = 20_000
    said = lambda c: F.concat(F.lit("é<turn \U0001f600 "), c.cast("string"))
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), said(F.col("id")).alias("text"))
    got = chat.digest(chat.render_rows(chat.fold_rows(chat.events_of_rows(rows)))).first()
    want = "".join(f"é<turn \U0001f600 {k}" for k in range(1, n, 2))
    import hashlib

    assert got.n_turns == n and got.loss_chars == len(want) and got.loss_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_spans_at_the_edges_of_parts(spark):
    text = "".join(chr(0x1F600 + k % 50) if k % 3 else "ab"[k % 2] for k in range(3 * chat.PART))
    spans = [(0, 1), (5, 5), (chat.PART - 1, chat.PART), (chat.PART, chat.PART), (chat.PART - 3, 2 * chat.PART + 4), (2 * chat.PART, 3 * chat.PART), (3 * chat.PART, 3 * chat.PART)]
    df = spark.createDataFrame([(text, spans), ("", []), (None, None)], "formatted string, loss_mask array<struct<start:int,end:int>>")
    got = [r[0] for r in df.select(chat.masked_text(F.col("formatted"), F.col("loss_mask"))).collect()]
    assert got == ["".join(text[a:b] for a, b in spans), "", None]
