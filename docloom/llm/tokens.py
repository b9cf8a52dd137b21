"""Operator 5: token ids in a binary file format of patched frame-of-reference blocks.

A file holds the ids of consecutive documents, cut into blocks of BLOCK values. Of each block the minimum is subtracted; the rest
is packed at the bit width that the PERCENTILE smallest values need; the high bits of larger ones are in an exception list
(place, value). The footer indexes the byte where each block starts, so that any block can be read alone, and holds the
documents' ids and counts.

    magic "DLPF", u32 version
    per block: u32 minimum, u8 width, u8 0, u16 values, u16 exceptions, packed values, exceptions' places (u16), high bits (u32)
    footer: block starts (u64 each), per document doc_id (i64), id-is-null (u8), values (u64)
    tail: u64 footer start, u64 blocks, u64 documents, u64 values, magic "FPLD"

Documents are range-partitioned and sorted by (doc_id, hash of the text), null ids first; each task writes its own files under
attempt-specific names, and only files in the manifest, a table written when all tasks are done, are ever read. So a lost or
repeated task leaves at most an unread file. Files go to the shared folder through pyarrow's file systems.

Defined results: a null or empty text is the end id alone; repeated ids are neighbours in the order of their texts' hashes; an
empty table gives no files and no rows; further columns are not stored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import cache, new_path, slices, trimmed, word_slices, written

BLOCK = 512
PERCENTILE = 90
END = 2
FILE_VALUES = 1 << 21
_WHOLE = 1 << 18
_READ = 1 << 18
#: Blocks that are packed or unpacked side by side.
_ROWS = 256
PARTITION_BYTES = 32 << 20
_MAGIC, _TAIL = b"DLPF", b"FPLD"
_HEAD = struct.Struct("<IBBHH")
_FOOT = struct.Struct("<QQQQ4s")


# ---- blocks -------------------------------------------------------------------------------------------------------------------


def pack_blocks(values: np.ndarray) -> list[bytes]:
    """Blocks of up to BLOCK values each, in order."""
    full = len(values) // BLOCK
    out: list[bytes] = []
    for lo in range(0, full, _ROWS):
        out += _pack_equal(values[lo * BLOCK : min(full, lo + _ROWS) * BLOCK].reshape(-1, BLOCK))
    if full * BLOCK < len(values):
        out += _pack_equal(values[full * BLOCK :].reshape(1, -1))
    return out


def _pack_equal(v: np.ndarray) -> list[bytes]:
    v = v.astype(np.uint32)
    n = v.shape[1]
    low = v.min(axis=1)
    d = v - low[:, None]
    edge = np.partition(d, n * PERCENTILE // 100 if n > 1 else 0, axis=1)[:, n * PERCENTILE // 100 if n > 1 else 0]
    width = np.where(edge > 0, np.floor(np.log2(np.maximum(edge, 1).astype(np.float64))).astype(np.int64) + 1, 0)
    out: list[bytes] = [b""] * len(v)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        mine = d[rows]
        bits = ((mine[:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8).reshape(len(rows), -1)
        packed = np.packbits(bits, axis=1, bitorder="little")
        high = mine >> np.uint32(w)
        for i, r in enumerate(rows):
            at = np.flatnonzero(high[i])
            out[r] = _HEAD.pack(int(low[r]), int(w), 0, n, len(at)) + packed[i].tobytes() + at.astype("<u2").tobytes() + high[i][at].astype("<u4").tobytes()
    return out


def unpack_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The values of the blocks that start at `starts`, in order."""
    heads = [_HEAD.unpack_from(data, int(s)) for s in starts]
    sizes = np.array([h[3] for h in heads], dtype=np.int64)
    at = np.zeros(len(heads) + 1, dtype=np.int64)
    np.cumsum(sizes, out=at[1:])
    out = np.zeros(int(at[-1]), dtype=np.uint32)
    alike: dict[tuple[int, int], list[int]] = {}
    for i, h in enumerate(heads):
        alike.setdefault((h[1], h[3]), []).append(i)
    raw = np.frombuffer(data, dtype=np.uint8)
    for (w, n), every in alike.items():
        for lo in range(0, len(every), _ROWS):
            rows = np.array(every[lo : lo + _ROWS])
            body = starts[rows].astype(np.int64) + _HEAD.size
            packed = raw[body[:, None] + np.arange(-(-w * n // 8))]
            bits = np.unpackbits(packed, axis=1, count=w * n, bitorder="little").reshape(len(rows), n, w)
            got = np.zeros((len(rows), n), dtype=np.uint32)
            for b in range(w):
                got |= bits[:, :, b].astype(np.uint32) << np.uint32(b)
            out[at[rows][:, None] + np.arange(n)] = got
    for i, (low, w, _, n, exceptions) in enumerate(heads):
        if exceptions:
            p = int(starts[i]) + _HEAD.size + -(-w * n // 8)
            place = np.frombuffer(data, "<u2", exceptions, p).astype(np.int64)
            out[at[i] + place] |= np.frombuffer(data, "<u4", exceptions, p + 2 * exceptions) << np.uint32(w)
        out[at[i] : at[i + 1]] += np.uint32(low)
    return out


def file_bytes(ids: np.ndarray, doc_ids: list[int | None], counts: list[int]) -> bytes:
    blocks = pack_blocks(ids)
    starts = np.zeros(len(blocks), dtype="<u8")
    if blocks:
        starts[:] = 8 + np.concatenate([[0], np.cumsum([len(b) for b in blocks[:-1]])])
    body = _MAGIC + struct.pack("<I", 1) + b"".join(blocks)
    null = np.array([d is None for d in doc_ids], dtype="u1")
    foot = starts.tobytes() + np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + null.tobytes() + np.array(counts, dtype="<u8").tobytes()
    return body + foot + _FOOT.pack(len(body), len(blocks), len(doc_ids), len(ids), _TAIL)


def read_file(data: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """ids, documents' ids, documents' counts."""
    foot, blocks, docs, values, tail = _FOOT.unpack_from(data, len(data) - _FOOT.size)
    if data[:4] != _MAGIC or tail != _TAIL:
        raise ValueError("not a file of packed ids")
    starts = np.frombuffer(data, "<u8", blocks, foot)
    ids = np.frombuffer(data, "<i8", docs, foot + 8 * blocks)
    null = np.frombuffer(data, "u1", docs, foot + 8 * (blocks + docs))
    counts = np.frombuffer(data, "<u8", docs, foot + 8 * blocks + 9 * docs).astype(np.int64)
    got = unpack_blocks(data, starts)
    if len(got) != values or counts.sum() != values:
        raise ValueError("damaged file of packed ids")
    return got, [None if x else int(i) for i, x in zip(ids, null)], counts


# ---- encoding -----------------------------------------------------------------------------------------------------------------


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The pre-tokenizer's pattern of the vocabulary file (fixed value), for texts of PLAIN characters, where a word character that
#: is neither digit nor underscore is a letter.
PIECES = r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\w\s]|_)+"
#: Texts of these characters only are unchanged by NFC and lower-cased alike by Python and the library.
PLAIN = r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ňŊ-ſ–—‘-”…]*"


class _Known(dict):
    """A cache of at most `most` keys of at most 40 characters each, in two halves: when the newer is full, it becomes the older one, and
    what is used again moves to the newer. So frequent keys stay."""

    def __init__(self, make, most: int):
        self.make, self.half, self.older = make, most // 2, {}

    def __missing__(self, key: str) -> bytes:
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= 40:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[key] = out
        return out


#: The normalizer and pre-tokenizer (fixed values) for which plain texts may be cut into pieces here.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_SAFE_CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


class Encoder:
    """Texts to ids through the tokenizers library.

    If the file normalizes and splits as _NORMALIZER, _SPLIT and _BYTES say, each distinct piece of plain texts is encoded once
    (a bounded cache of about 160 MB), and other texts (combining marks, other scripts, special tokens' names) are encoded whole, or
    if long in parts cut at a blank between two ASCII letters or digits, across which nothing composes or merges. With any other
    file every text goes through the library whole."""

    def __init__(self, path: str, kept: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        made = json.loads(self.whole.to_str())
        names = [t["content"] for t in made["added_tokens"]]
        known = (made["normalizer"], made["pre_tokenizer"]) == (_NORMALIZER, {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]})
        self.splits = known and made["truncation"] is None and all(n.startswith("<|") and " " not in n for n in names)
        self.plain = re.compile(PLAIN).fullmatch
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.known, self.split = _Known(self.chunk, kept), re.compile(PIECES).findall

    def chunk(self, chunk: str) -> bytes:
        """Ids of a plain text without blanks; its pieces are kept in the same cache."""
        low = chunk.lower()
        if not low.isalpha():  # else one piece
            pieces = self.split(low)
            if pieces != [low]:
                return b"".join(map(self.known.__getitem__, pieces))
        return self.known[low] if low != chunk else self.piece(chunk)

    def piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join(map(self.byte.__getitem__, piece.encode()))
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.splits:
            return self._whole(text)
        if "<|" not in text and self.plain(text):
            return b"".join(b"".join(map(self.known.__getitem__, part.split())) for part in word_slices(text))
        out, lo = [], 0
        while lo < len(text):
            cut = _SAFE_CUT.search(text, lo + _WHOLE) if len(text) - lo > _WHOLE else None
            hi = cut.start() if cut else len(text)
            out.append(self._whole(text[lo:hi]))
            lo = hi
        return b"".join(out)


def encoder(path: str) -> Encoder:
    encoders = cache(__name__)
    if path not in encoders:
        encoders[path] = Encoder(path)
    return encoders[path]


# ---- tables to files and back -------------------------------------------------------------------------------------------------

MANIFEST = "part int, seq int, path string, docs long, ids long, bytes long"


def write_ids(docs: DataFrame, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Writes the files of docs (doc_id, text) under folder; returns the manifest: part and seq order the files."""
    spark = docs.sparkSession
    path, end = tokenizer or tokenizer_path(), np.array([END], dtype="<u4").tobytes()
    total = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    parts = int(max(spark.sparkContext.defaultParallelism, -(-total // PARTITION_BYTES)))

    @trimmed
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        target, root = fs.FileSystem.from_uri(folder)
        target.create_dir(root, recursive=True)
        task = TaskContext.get()
        encode, seq = encoder(path), 0
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        counts: list[int] = []
        held = 0

        def flush() -> pd.DataFrame:
            nonlocal ids, doc_ids, counts, held, seq
            name = f"{root.rstrip('/')}/part-{task.partitionId():06d}-{seq:05d}-{task.taskAttemptId()}.pfor"
            data = file_bytes(np.frombuffer(b"".join(ids), dtype="<u4"), doc_ids, counts)
            with target.open_output_stream(name) as out:
                out.write(data)
            row = pd.DataFrame([(task.partitionId(), seq, name, len(doc_ids), held, len(data))], columns=["part", "seq", "path", "docs", "ids", "bytes"])
            ids, doc_ids, counts, held, seq = [], [], [], 0, seq + 1
            return row

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                got = encode(text) + end
                ids.append(got)
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                counts.append(len(got) // 4)
                held += len(got) // 4
                if held >= FILE_VALUES:
                    yield flush()
        if doc_ids:
            yield flush()

    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    # doc_id travels as decimal text: pandas would turn a column of integers with nulls into floats
    ordered = ordered.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return written(ordered.mapInPandas(write, MANIFEST), "ids-manifest")


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """Documents in the files of the manifest: doc_id, start (ids before it), n_tokens, ids (little-endian u32)."""
    order = Window.orderBy("part", "seq")  # one row for each file
    files = manifest.withColumn("base", F.sum("ids").over(order) - F.col("ids")).select("path", "base")
    files = files.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4), "path")

    @trimmed
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        source, _ = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            for path, base in zip(pdf["path"], pdf["base"]):
                with source.open_input_stream(path) as f:
                    ids, doc_ids, counts = read_file(f.read())
                cut = np.concatenate([[0], np.cumsum(counts)])
                for a, b in slices(counts.tolist(), _READ):  # documents, about _READ ids at a time
                    raw = ids[cut[a] : cut[b]].astype("<u4", copy=False).tobytes()
                    at = 4 * (cut[a : b + 1] - cut[a])
                    yield pd.DataFrame({"doc_id": pd.array(doc_ids[a:b], dtype="Int64"), "start": base + cut[a:b], "n_tokens": counts[a:b], "ids": [raw[x:y] for x, y in zip(at[:-1], at[1:])]})

    return files.mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def digest(read_back: DataFrame) -> DataFrame:
    return read_back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def tokenize_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the ids of docs, reads the files back."""
    folder = new_path(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, folder, tokenizer), folder)
