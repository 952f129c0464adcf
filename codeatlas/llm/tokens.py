"""Token-ID output in a seekable binary format.

A token file is a sequence of independent zstandard frames, each holding token ids as little-endian unsigned 32-bit
integers, then a skippable frame with the index of documents, then a skippable frame with the seek table (the public
seekable format of zstandard: for every frame its compressed size, its decompressed size and the low 32 bits of the
XXH64 of its content). Frames end where a document ends once FRAME_IDS are reached; a document longer than that spans frames
of FRAME_IDS. A reader fetches the tail, finds a document in the index and decompresses only the frames that hold it.
Files are in ascending order of doc_id, and so are the documents within.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import bound_batches, materialize, n_parts
from ._files import AtomicFile, open_input

#: Fixed values of the zstandard skippable and seekable formats.
SKIPPABLE, SEEK_MAGIC, SEEK_FOOTER, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

#: Ids in a frame, about: 256 KiB.
FRAME_IDS = 65_536

#: Pieces kept in the memo, which only saves time.
MEMO_PIECES = 350_000

#: Texts of these characters alone are cut by _PIECE, which for them is the tokenizer's own pattern; classes are spelled by code point.
_LETTERS = "A-Za-z" + "".join(map(chr, (0xAA, 0xB5, 0xBA))) + f"{chr(0xC0)}-{chr(0xD6)}{chr(0xD8)}-{chr(0xF6)}{chr(0xF8)}-{chr(0x24F)}"
_NUMBERS = "0-9" + "".join(map(chr, (0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE)))
_FOREIGN = re.compile(f"[^ -~{chr(10)}{chr(0xA1)}-{chr(0x24F)}]")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^ \n{_LETTERS}{_NUMBERS}]+|[ \n]+(?![^ \n])|[ \n]+")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def plain_byte_level(settings: dict) -> bool:
    """Whether a tokenizer, by its own JSON, does nothing but what Encoder's short way does: no normalizer, the byte-level pre-tokenizer with its pattern and without a space in front, and
    byte-pair merges without dropout, affixes, byte fallback or whole-word look-ups."""
    pre, model = settings.get("pre_tokenizer") or {}, settings.get("model") or {}
    return (
        settings.get("normalizer") is None
        and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True)
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "fuse_unk"))
    )


class Encoder:
    """Encodes whole texts as the library does, with any tokenizer file. Where the file's own settings say that it is a plain byte-level one, texts of Latin characters are cut into
    the tokenizer's own pieces here, and each distinct piece goes to the library's model once; a memo answers repeats. Other texts, texts that spell a special token, and
    all texts of other tokenizers go through the library whole. Truncation and padding that a file may ask for are off."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.short = plain_byte_level(json.loads(self.tokenizer.to_str()))
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.memo: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.short or _FOREIGN.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        memo, pieces = self.memo, _PIECE.findall(text)
        try:
            return b"".join(map(memo.__getitem__, pieces))
        except KeyError:
            if len(memo) > MEMO_PIECES:
                memo.clear()
            for p in pieces:
                if p not in memo:
                    memo[p] = self._piece(p)
            return b"".join(map(memo.__getitem__, pieces))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class TokenFileWriter:
    def __init__(self, uri: str, frame_ids: int = FRAME_IDS, level: int = 3):
        self.file = AtomicFile(uri)
        self.frame_bytes, self.zstd = 4 * frame_ids, zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True)
        self.pending: list[bytes] = []
        self.pending_bytes, self.frames = 0, []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []

    def _frame(self, data: bytes) -> None:
        packed = self.zstd.compress(data)
        self.file.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self.pending:
            self._frame(b"".join(self.pending))
            self.pending, self.pending_bytes = [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        if len(ids) > self.frame_bytes:
            self._flush()
            for at in range(0, len(ids), self.frame_bytes):
                self._frame(ids[at : at + self.frame_bytes])
            return
        self.pending.append(ids)
        self.pending_bytes += len(ids)
        if self.pending_bytes >= self.frame_bytes:
            self._flush()

    def close(self) -> None:
        self._flush()
        known = np.array([x is not None for x in self.doc_ids], "u1")
        ids = np.array([x or 0 for x in self.doc_ids], "<i8")
        index = self.zstd.compress(known.tobytes() + ids.tobytes() + np.array(self.lengths, "<u8").tobytes())
        index = struct.pack("<Q", len(self.doc_ids)) + index
        self.file.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        self.frames.append((len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEK_FOOTER)
        self.file.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
        self.file.close()


class TokenFileReader:
    """Random access to one token file."""

    def __init__(self, uri: str):
        self.file = open_input(uri)
        size = self.file.size()
        n, flag, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_FOOTER or not flag & CHECKSUM_FLAG:
            raise ValueError(f"{uri} has no seek table")
        table = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3)
        self.sizes, self.checks = table[:, 0].astype("i8"), table[:, 2]
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.begins = np.concatenate([[0], np.cumsum(table[:, 1].astype("i8"))])  # in decompressed bytes
        index = self.file.read_at(int(self.sizes[-1]), int(self.at[-2]))[8:]
        count = struct.unpack("<Q", index[:8])[0]
        raw = zstandard.ZstdDecompressor().decompress(index[8:]) if count else b""
        known = np.frombuffer(raw, "u1", count)
        self.doc_ids = [int(i) if k else None for i, k in zip(np.frombuffer(raw, "<i8", count, count), known, strict=True)]
        self.lengths = np.frombuffer(raw, "<u8", count, 9 * count).astype("i8")
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.zstd, self.last = zstandard.ZstdDecompressor(), (-1, b"")
        self.frames_read = 0

    def _frame(self, k: int) -> bytes:
        if self.last[0] != k:
            data = self.zstd.decompress(self.file.read_at(int(self.sizes[k]), int(self.at[k])))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != int(self.checks[k]):
                raise ValueError(f"frame {k} fails its checksum")
            self.last, self.frames_read = (k, data), self.frames_read + 1
        return self.last[1]

    def ids(self, nth: int) -> bytes:
        """The ids of the file's nth document, as little-endian bytes."""
        lo, hi = 4 * int(self.starts[nth]), 4 * int(self.starts[nth + 1])
        k, out = bisect.bisect_right(self.begins, lo) - 1, []
        while lo < hi:
            data, begin = self._frame(k), int(self.begins[k])
            out.append(data[lo - begin : hi - begin])
            lo, k = begin + len(data), k + 1
        return b"".join(out)

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = 2, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Encodes docs (doc_id, text) into token files below out_dir and returns the manifest (part, path, n_docs, n_ids).

    Null and empty texts give the end id alone. Null doc_ids come first; rows of equal doc_id follow by text. Other
    columns are ignored. An empty table gives no files. One range-partitioned shuffle of the texts, then each
    task streams its range into one file; a task that is lost writes the same file again.
    """
    bound_batches(docs.sparkSession, "4m")
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, docs_n, ids_n = TaskContext.get().partitionId(), None, 0, 0
        path, encode = f"{out_dir}/tokens-{part:06d}.zst", encoder(tokenizer_path)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                out = out or TokenFileWriter(path, frame_ids)
                ids = encode(text.as_py() or "") + end
                out.add(doc_id, ids)
                docs_n, ids_n = docs_n + 1, ids_n + len(ids) // 4
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": [docs_n], "n_ids": [ids_n]})

    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n_parts(docs), order[0]).sortWithinPartitions(*order)
    return materialize(rows.mapInArrow(write, "part int, path string, n_docs long, n_ids long"), "manifest")


def _with_base(manifest: DataFrame) -> DataFrame:
    """The manifest has a row per file, some hundred megabytes of text each; the window orders files."""
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(w), F.lit(0)).cast("long"))


def read_token_files(manifest: DataFrame, doc_ids: Iterable[int] | None = None, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary), or with digest (doc_id, start, n_tokens, ids_crc32), of all documents in
    the manifest's files, or of the stated doc_ids alone, of which only their frames are decompressed."""
    wanted = None if doc_ids is None else frozenset(doc_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist(), strict=True):
                reader, rows = TokenFileReader(path), []
                for nth, doc_id in enumerate(reader.doc_ids):
                    if wanted is None or doc_id in wanted:
                        ids = reader.ids(nth)
                        rows.append((doc_id, base + int(reader.starts[nth]), int(reader.lengths[nth]), zlib.crc32(ids) if digest else ids))
                    if len(rows) >= 1000:
                        yield _rows(rows, digest)
                        rows = []
                reader.close()
                if rows:
                    yield _rows(rows, digest)

    files = _with_base(manifest).select("path", "base").repartition(n_parts(manifest), "path")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))


def _rows(rows: list[tuple], digest: bool) -> pa.RecordBatch:
    a, b, c, d = zip(*rows, strict=True)
    last = pa.array(d, pa.int64() if digest else pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenize(spark: SparkSession, docs: DataFrame, out_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Writes docs as token files and returns the digest read back from them, a row per row of docs. Null and empty texts give the end id alone, rows without a doc_id come first, rows that
    share one stand next to each other, long texts span frames, other columns are ignored. An empty table gives no rows."""
    manifest = write_token_files(docs, out_dir, tokenizer_path or tokenizer_file())
    return read_token_files(manifest, digest=True)
