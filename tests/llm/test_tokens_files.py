"""Every tokenizer file of the library, and the whole query, against the library itself."""

import json
import os
import random
import struct
import sys
import zlib

import pytest

sys.path.insert(0, "/opt/tokenizers")

from tokenizers import Tokenizer

from codeatlas.llm import queries, tokens

SF = "/root/testdata/sf0.001"
FILES = [f"/opt/tokenizers/{n}.json" for n in ("byte_bpe_50k", "word_bpe_49k")]
TEXTS = ["", "Hello World, it's 1 2 THREE", "é Ça va?\n\n  tabs\tand\r\n", "<|endoftext|> x", "<|startoftext|>", "日本語 text \U0001f600", " lead", "trail  ", "a" * 3000, "don't DON'T", "½ cup ª º²"]


def some(rng):
    return "".join(rng.choice(["a", "B", " ", "  ", "\n", "'s", "é", "1", "½", ".", "#", "\t", "ñ", "xyz", " "]) for _ in range(rng.randint(0, 60)))


@pytest.mark.parametrize("path", [p for p in FILES if os.path.exists(p)])
def test_ids_are_the_library_s(path):
    own, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(3)
    for text in TEXTS + [some(rng) for _ in range(400)]:
        ids = plain.encode(text, add_special_tokens=False).ids
        assert own(text) == struct.pack(f"<{len(ids)}I", *ids), text
    assert own.short == path.endswith("byte_bpe_50k.json")


def test_changed_settings_take_the_long_way(tmp_path):
    if not os.path.exists(FILES[0]):
        pytest.skip("no tokenizer")
    with open(FILES[0]) as f:
        base = json.load(f)
    changes = {
        "normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True},
        "truncation": {"direction": "Right", "max_length": 4, "strategy": "LongestFirst", "stride": 0},
    }
    for key, value in changes.items():
        path = tmp_path / f"{key}.json"
        path.write_text(json.dumps(base | {key: value}))
        own, plain = tokens.Encoder(str(path)), Tokenizer.from_file(str(path))
        plain.no_truncation()
        assert own.short == (key == "truncation")
        for text in TEXTS:
            ids = plain.encode(text, add_special_tokens=False).ids
            assert own(text) == struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_the_query_over_documents(spark):
    plain = Tokenizer.from_file(FILES[0])
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    want, at = [], 0
    for doc_id, text in docs:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    got = queries.op2_tokens(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want
