"""Operator 6: removal of repeated byte strings with a distributed suffix array, sorted by bucket-pointer refinement.

A byte goes if it is in a string of LENGTH bytes that also starts at another place, in the same document or another.

Texts that several rows have go whole, and one row stands for all of them in what follows.

One suffix array of the whole corpus fits no task, so the suffixes are first dealt out by content. Every window of LENGTH bytes
is filed under its minimiser, the q-gram of least hash in it (the leftmost of equals). Equal windows have the same minimiser at the same offset, so
they meet; consecutive windows with one minimiser are one segment, and the mean segment files 85 windows with one copy of
their bytes. Segments are compared by minimiser and a hash of their bytes (128 bits together):

* a segment that is all of another one is repeated as a whole;
* one with no other under its minimiser holds no repeat;
* one representative of each other segment has its bytes fetched. The segments under a minimiser are sorted as suffixes by bucket-
  pointer refinement: initial buckets of 8-grams, each refined by the bucket identifiers of later offsets, the refined ones used in
  turn, up to depth LENGTH. Windows whose bucket at that depth has company are repeated.

Neighbours of one text that are equal segments (blanks, periodic text) are filed as one row, a run. Minimisers of few rows are compared in
a window. Those of more than `hot_rows` (at least the 2^17th part of all rows, so at most 2^17 of them, which are broadcast) are aggregated by
minimiser and bytes instead, so that one common line is spread over tasks by what surrounds it and its copies are counted before the shuffle.

A minimiser with more than HOT_SEGMENTS different segments is not sorted in one task: its windows' 128-bit hashes are counted by Spark.

Documents are addressed by a 64-bit hash of (doc_id, text). Defined results: null and empty texts, and texts shorter than LENGTH,
lose nothing; repeated rows lose all that they share, at least LENGTH bytes; an empty table gives no rows. Columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import release, row_key, utf8, written

LENGTH = 200
GRAM = 32
HOT_SEGMENTS = 1 << 14
HOT_ROWS = 1000
#: So many keys of copied rows are broadcast (8 bytes each, 16 MB in a hash table).
KNOWN_COPIES = 1 << 20
_MOST_HOT = 1 << 17
_PIECE = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
_SORT_BYTES = 1 << 20
_MULT = 0x9E3779B97F4A7C15


# ---- segments -----------------------------------------------------------------------------------------------------------------


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of every GRAM bytes, by doubling."""
    h, step, mult = raw.astype(np.uint64) + np.uint64(1), 1, _MULT
    while step < GRAM:
        h = h[:-step] * np.uint64(mult) + h[step:]
        mult, step = mult * mult % (1 << 64), 2 * step
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, from running minima of blocks of w."""
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, np.uint64(2**64 - 1))
    full[: len(x)] = x
    grid = full.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Segments of all texts: text number, first byte, length, minimiser's hash, bytes' hash."""
    import xxhash

    found: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def done() -> None:
        nonlocal held, size
        if not held:
            return
        data = b"".join(p for _, _, p in held)
        grams = gram_hashes(np.frombuffer(data, np.uint8))
        key = grams & ~_PLACE | np.arange(len(grams), dtype=np.uint64)
        least = sliding_minimum(key, LENGTH - GRAM + 1)
        cut = np.cumsum([0] + [len(p) for _, _, p in held])
        ok = np.ones(len(least), bool)
        for c in cut[1:-1]:
            ok[max(0, c - LENGTH + 1) : c] = False
        at = np.flatnonzero(ok)
        place = (least[at] & _PLACE).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        start, length = at[first], at[last] - at[first] + LENGTH
        piece = np.searchsorted(cut, start, side="right") - 1
        digest = xxhash.xxh3_64_intdigest
        body = np.array([digest(data[a:b]) for a, b in zip(start.tolist(), (start + length).tolist())], dtype=np.uint64)
        owner, offset = np.array([i for i, _, _ in held]), np.array([o for _, o, _ in held])
        found.append((owner[piece], start - cut[piece] + offset[piece], length, grams[place[first]], body))
        held, size = [], 0

    for i, text in enumerate(texts):
        for at in range(0, len(text) - LENGTH + 1, _PIECE):
            part = text[at : at + _PIECE + LENGTH - 1]
            if size + len(part) > 2 * _PIECE - LENGTH:
                done()
            held.append((i, at, part))
            size += len(part)
    done()
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    return tuple(np.concatenate(x) for x in zip(*found))


# ---- bucket-pointer refinement ------------------------------------------------------------------------------------------------


def buckets(text: np.ndarray, depth: int) -> np.ndarray:
    """For every suffix a bucket identifier; suffixes with the same first `depth` bytes share it, in the order of these bytes.

    Valid where depth bytes are left."""
    n, have = len(text), min(8, depth)
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    gram = np.zeros(n, np.uint64)
    for i in range(have):
        gram = gram << np.uint64(8) | padded[i : i + n].astype(np.uint64)
    order = np.argsort(gram, kind="stable")
    pointer = np.zeros(n + depth, np.int64)
    live, pointer[:n] = _numbered(gram, order, np.zeros(n, np.int64))
    while have < depth and len(live):
        ahead = min(have, depth - have)
        key = pointer[live] * np.int64(n + 1) + pointer[live + ahead]  # own bucket, then the bucket of the later offset
        order = np.argsort(key, kind="stable")
        again, fresh = _numbered(key, order, pointer[live])
        pointer[live] = fresh
        live = live[again]
        have += ahead
    return pointer[:n]


def _numbered(key: np.ndarray, order: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of equal keys: members of buckets of more than one, and everyone's identifier.

    A bucket is named by the rank where it starts, inside the bucket (`base`) that it is cut from, so names stay in order and unique."""
    ranked = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(key)))
    old = base[order]
    opened = np.ones(len(key), bool)
    opened[1:] = old[1:] != old[:-1]
    outer = np.maximum.accumulate(np.where(opened, np.arange(len(key)), 0))
    name = np.zeros(len(key), np.int64)
    name[order] = old + np.repeat(start, size) - outer
    many = np.zeros(len(key), bool)
    many[order] = np.repeat(size > 1, size)
    return np.flatnonzero(many), name


def repeated_windows(parts: list[bytes]) -> list[np.ndarray]:
    """For each part, whether each of its windows of LENGTH bytes occurs at another place of the parts."""
    text = np.frombuffer(b"".join(parts), np.uint8)
    pointer = buckets(text, LENGTH)
    size = np.array([len(p) for p in parts])
    start = np.cumsum(size) - size
    at = np.concatenate([np.arange(s, s + n - LENGTH + 1) for s, n in zip(start, size)])
    _, number, count = np.unique(pointer[at], return_inverse=True, return_counts=True)
    return np.split(count[number] > 1, np.cumsum(size - LENGTH + 1)[:-1])


def runs(mark: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of marked windows, from their first window's byte `start` on."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    return start + edge[::2], start + edge[1::2] + LENGTH - 1


# ---- over tables --------------------------------------------------------------------------------------------------------------

_RANGE = "k long, lo int, hi int"


def _file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        k, texts, lo = pdf["k"].to_numpy(), pdf["text"].tolist(), 0
        while lo < len(texts):
            hi, held = lo, 0
            while hi < len(texts) and (hi == lo or held < 1 << 23):
                held += len(texts[hi])
                hi += 1
            owner, start, length, h, body = segments([utf8(t) for t in texts[lo:hi]])
            new = np.ones(len(h), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1]) | (body[1:] != body[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(h))[: len(first)] - 1
            start, stop = start.astype(np.int32), (start + length).astype(np.int32)
            yield pd.DataFrame(
                {"h": h.view(np.int64)[first], "body": body.view(np.int64)[first], "k": k[lo:hi][owner[first]], "lo": start[first], "hi": stop[first], "end": stop[last], "run": last > first}
            )
            lo = hi


def _fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for k, text, wanted in zip(pdf["k"], pdf["text"], pdf["wanted"]):
            raw = utf8(text)
            out += [(w["h"], k, w["lo"], w["whole"], w["crowded"], raw[w["lo"] : w["hi"]]) for w in wanted]
        yield pd.DataFrame(out, columns=["h", "k", "lo", "whole", "crowded", "bytes"])


def _refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by minimiser; whole minimisers are sorted together, about _SORT_BYTES at a time."""

    def done(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        lo, h, size = 0, pdf["h"].to_numpy(), pdf["bytes"].map(len).to_numpy()
        while lo < len(pdf):
            total = np.cumsum(size[lo:])
            hi = lo + max(1, int(np.searchsorted(total, _SORT_BYTES)))
            while hi < len(pdf) and h[hi] == h[hi - 1]:
                hi += 1
            rows = pdf[lo:hi]
            for k, at, whole, mark in zip(rows["k"], rows["lo"], rows["whole"], repeated_windows(rows["bytes"].tolist())):
                if not whole and mark.any():
                    a, b = runs(mark, at)
                    out.append(pd.DataFrame({"k": k, "lo": a, "hi": b}))
            lo = hi
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"k": [], "lo": [], "hi": []}, dtype="int64")

    held: list[pd.DataFrame] = []
    size = 0
    for pdf in batches:
        held.append(pdf)
        size += int(pdf["bytes"].map(len).sum())
        if size < 8 * _SORT_BYTES:
            continue
        pdf = pd.concat(held, ignore_index=True)
        cut = int(np.searchsorted(pdf["h"].to_numpy(), pdf["h"].iloc[-1]))  # the last minimiser may go on
        if cut:
            yield done(pdf[:cut].reset_index(drop=True))
        held = [pdf[cut:]]
        size = int(held[0]["bytes"].map(len).sum())
    if held:
        yield done(pd.concat(held, ignore_index=True))


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    for pdf in batches:
        for k, lo, whole, raw in zip(pdf["k"], pdf["lo"], pdf["whole"], pdf["bytes"]):
            digests = [xxhash.xxh3_128_digest(raw[i : i + LENGTH]) for i in range(len(raw) - LENGTH + 1)]
            yield pd.DataFrame({"w": digests, "k": k, "lo": np.arange(lo, lo + len(digests)), "whole": whole})


_FOUND = ("h", "k", "lo", "hi", "end", "whole", "open", "crowded")


def _compared_in_windows(filed: DataFrame, hot_segments: int) -> DataFrame:
    """Which segments are repeated as a whole, and one representative ("open") of each that shares its minimiser with others."""
    w = Window.partitionBy("h").orderBy("body", "k", "lo")
    near = filed.withColumns({"before": F.lag("body").over(w), "after": F.lead("body").over(w), "first": F.first("body").over(w)})
    repeated = F.coalesce(F.col("before") == F.col("body"), F.lit(False)) | F.coalesce(F.col("after") == F.col("body"), F.lit(False))
    last = F.col("after").isNull() | (F.col("after") != F.col("body"))
    company = (F.col("first") != F.col("body")) | F.col("after").isNotNull()
    near = near.withColumns({"whole": F.col("run") | repeated, "open": last & company})
    different = F.sum(F.col("open").cast("int")).over(Window.partitionBy("h"))
    return near.withColumn("crowded", different > hot_segments).where("whole or open").select(*_FOUND)


def _compared_by_bytes(filed: DataFrame, hot_rows: int, hot_segments: int) -> DataFrame:
    """The same for hot minimisers: copies are counted before the shuffle, and no task gets all rows of one."""
    one = [F.first(c).alias(c) for c in ("k", "lo", "hi")]  # all of one row: any copy represents them
    kinds = written(filed.groupBy("h", "body").agg(F.count("*").alias("rows"), F.max("run").alias("run"), *one), "segment-kinds")
    kinds = kinds.withColumn("whole", F.col("run") | (F.col("rows") > 1))
    company = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select("h", (F.col("kinds") > hot_segments).alias("crowded"))
    out = kinds.join(F.broadcast(company), "h").withColumns({"end": F.col("hi"), "open": F.lit(True)}).select(*_FOUND)
    copied = kinds.where("whole")
    common = F.broadcast(copied.where(F.col("rows") > hot_rows).select("h", "body"))  # at most _MOST_HOT, as hot minimisers
    rare = copied.where(F.col("rows") <= hot_rows).select("h", "body")
    for rows in (filed.join(common, ["h", "body"], "left_semi"), filed.join(common, ["h", "body"], "left_anti").join(rare, ["h", "body"], "left_semi")):
        out = out.unionByName(rows.withColumns({"whole": F.lit(True), "open": F.lit(False), "crowded": F.lit(False)}).select(*_FOUND))
    return out


def _copies(long: DataFrame) -> DataFrame | None:
    """(k, first, hi): the rows of whole texts that several rows have, one of them to stand for all, and their bytes; None if there are none."""
    keyed = long.select("k", row_key("text").alias("key"), F.octet_length("text").alias("hi"))
    twice = written(keyed.groupBy("key").agg(F.min("k").alias("first"), F.count("*").alias("rows")).where("rows > 1").select("key", "first"), "copied-texts")
    return None if twice.isEmpty() else written(keyed.join(twice, "key").select("k", "first", "hi"), "copies")


def _without_copies(long: DataFrame, copies: DataFrame, most: int) -> DataFrame:
    """long without the rows that another one stands for. Up to `most` of their keys are broadcast, so that texts stay where they are; above, both sides meet by key."""
    others = copies.where("k <> first").select("k").distinct()
    return long.join(F.broadcast(others) if others.count() <= most else others, "k", "left_anti")


def repeated_ranges(docs: DataFrame, hot_segments: int = HOT_SEGMENTS, hot_rows: int = HOT_ROWS, known_copies: int = KNOWN_COPIES) -> DataFrame:
    """(k, text) -> (k, lo, hi): byte ranges that cover all repeated windows; they may overlap."""
    long = docs.where(F.octet_length("text") >= LENGTH)
    copies = _copies(long)
    if copies is not None:
        long = _without_copies(long, copies, known_copies)
    filed = written(long.select("k", "text").mapInPandas(_file, "h long, body long, k long, lo int, hi int, end int, run boolean"), "filed")
    hot_rows = max(hot_rows, filed.count() // _MOST_HOT)
    hot = written(filed.groupBy("h").count().where(F.col("count") > hot_rows).select("h"), "hot-minimisers")
    if hot.isEmpty():
        found = _compared_in_windows(filed, hot_segments)
    else:
        some = F.broadcast(hot)
        found = _compared_in_windows(filed.join(some, "h", "left_anti"), hot_segments)
        found = found.unionByName(_compared_by_bytes(filed.join(some, "h", "left_semi"), hot_rows, hot_segments))
    found = written(found, "segments")
    release(filed)
    ranges = found.where("whole").select("k", "lo", F.col("end").alias("hi"))
    if copies is not None:
        ranges = ranges.unionByName(copies.select("k", F.lit(0).alias("lo"), "hi"))
    wanted = found.where("open").groupBy("k").agg(F.collect_list(F.struct("h", "lo", "hi", "whole", "crowded")).alias("wanted"))
    parts = long.select("k", "text").join(wanted, "k").mapInPandas(_fetch, "h long, k long, lo int, whole boolean, crowded boolean, bytes binary")
    if not found.where("crowded").isEmpty():
        parts = written(parts, "parts")
        windows = parts.where("crowded").drop("crowded").mapInPandas(_windows, "w binary, k long, lo int, whole boolean")
        twice = windows.groupBy("w").count().where("count > 1").select("w")
        counted = windows.where("not whole").join(twice, "w").select("k", "lo", (F.col("lo") + LENGTH).cast("int").alias("hi"))
        ranges = ranges.unionByName(counted)
        parts = parts.where("not crowded")
    sorted_parts = parts.drop("crowded").repartition("h").sortWithinPartitions("h")
    return ranges.unionByName(sorted_parts.mapInPandas(_refine, _RANGE))


def merged(ranges: list) -> list[tuple[int, int]]:
    """Maximal runs of byte ranges."""
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def dedupe(docs: DataFrame, hot_segments: int = HOT_SEGMENTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """docs with n_bytes, n_removed, spans (removed byte ranges) and kept (the bytes left)."""
    docs = docs.drop("n_bytes", "n_removed", "spans", "kept")
    keyed = docs.withColumn("_docloom_k", F.xxhash64("doc_id", "text"))
    ranges = repeated_ranges(keyed.select(F.col("_docloom_k").alias("k"), "text"), hot_segments, hot_rows).groupBy("k").agg(F.collect_list(F.struct("lo", "hi")).alias("_docloom_ranges"))

    def cut(texts: pd.Series, every: pd.Series) -> pd.DataFrame:
        rows = []
        for text, found in zip(texts, every):
            raw, spans = utf8(text), merged(found) if found is not None else []
            edge = [0, *[x for s in spans for x in s], len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2]))
            rows.append((len(raw), len(raw) - len(kept), [{"lo": a, "hi": b} for a, b in spans], kept))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "spans", "kept"])

    cut.__annotations__ = {"texts": pd.Series, "every": pd.Series, "return": pd.DataFrame}
    shape = F.pandas_udf(cut, "n_bytes long, n_removed long, spans array<struct<lo:int,hi:int>>, kept binary")
    return keyed.join(ranges.withColumnRenamed("k", "_docloom_k"), "_docloom_k", "left").withColumn("_docloom_cut", shape("text", "_docloom_ranges")).select(*docs.columns, "_docloom_cut.*")


def dedupe_digest(docs: DataFrame) -> DataFrame:
    d = dedupe(docs.select("doc_id", "text"))
    return d.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
