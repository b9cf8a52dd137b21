"""Operator 2: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

Words are white-space separated, lower-cased, with everything but letters and digits taken out. One pass counts the test
items' words in the whole corpus. An n-gram of an item is a seed if it is rare by its words: the product of their shares of the
corpus is at most RARE; the rarest third of an item's n-grams are seeds in any case. (Rarity by words, not by how often the
n-gram occurs, so that a passage leaked into a third of the corpus keeps its seeds.) A second pass joins passages to items on seeds;
around each group of seeds the item is aligned with the passage by Smith-Waterman on words (match 2, mismatch and gap -1), and the score
is the share of the item's highest possible one. So edited and paraphrased copies keep a high score, chance seeds do not.

Test items are sent to the executors in blocks of at most BLOCK_BYTES of text, one search of the corpus for each block, and each
block's matches are written before the next one is sent.

Defined results: items of SEED to MIN_WORDS - 1 words match only where they stand word for word; shorter items (null and empty ones
too) hold no seed and match nothing; null and empty texts match nothing; repeated rows give repeated results; repeated items each
count; with no items or no documents there are no rows. `clean` takes only items of MIN_WORDS words and more as evidence of a leak.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import release, row_key, slices, trimmed, word_slices, written

SEED = 3
RARE = 1e-8
MIN_SCORE = 0.5
MIN_WORDS = 5
BLOCK_BYTES = 16 << 20
_CHUNK = 1 << 18
_CACHED = 40
_DROPPED, _OTHER = -1, 0
_MARKS = ".,;:!?\"'()[]"
_REST = re.compile(r"[\W_]+")


def normal(chunk: str) -> str:
    """The chunk in lower case with letters and digits alone; those that have nothing else, but for marks at their ends, need no pattern."""
    word = chunk.lower().strip(_MARKS)
    return word if word.isalnum() else _REST.sub("", word)


class Vocabulary(dict):
    """White-space separated chunk -> number of its word: from 1 for the items' words, else _OTHER, _DROPPED if nothing is left.

    A cache of a task's own in two generations of at most `most` chunks of at most _CACHED characters: what a full one was not asked for again goes."""

    def __init__(self, words: dict[str, int], most: int = 200_000):
        self.words, self.most, self.old = words, most, {}

    def __missing__(self, chunk: str) -> int:
        out = self.old.get(chunk)
        if out is None:
            word = normal(chunk)
            out = self.words.get(word, _OTHER) if word else _DROPPED
        if len(chunk) <= _CACHED:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[chunk] = out
        return out

    def numbers(self, text: str | None) -> np.ndarray:
        parts = [np.zeros(0, np.int64)]
        for piece in word_slices(text or ""):
            chunks = piece.split()
            parts.append(np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks)))
        out = np.concatenate(parts) if len(parts) > 2 else parts[-1]
        return out[out != _DROPPED]


class Items:
    """A block of test items as word numbers, and their seeds."""

    def __init__(self, rows: list[tuple[int, str]]):
        words: dict[str, int] = {}
        self.ids, self.words = [], []
        for item_id, text in rows:
            w = [n for n in map(normal, (text or "").split()) if n]
            if len(w) >= SEED:
                self.ids.append(item_id)
                self.words.append(np.array([words.setdefault(x, len(words) + 1) for x in w], dtype=np.int64))
        self.vocabulary = words
        self.size = len(words) + 1

    def keys(self, words: np.ndarray) -> np.ndarray:
        """A number for each n-gram, modulo 2^64; equal n-grams have equal ones."""
        out, n = np.zeros(max(0, len(words) - SEED + 1), dtype=np.uint64), max(0, len(words) - SEED + 1)
        for i in range(SEED):
            out = out * np.uint64(self.size) + words[i : i + n].astype(np.uint64)
        return out

    def index(self, counts: np.ndarray) -> None:
        """counts: how often each word number occurs in the corpus (0: other words)."""
        with np.errstate(divide="ignore"):
            log = np.log(np.maximum(counts, 1) / max(1, counts.sum()))
        posts = []
        for item, w in enumerate(self.words):
            p = sum(log[w[i : len(w) - SEED + 1 + i]] for i in range(SEED))
            limit = max(np.log(RARE), np.partition(p, len(p) // 3)[len(p) // 3])
            at = np.flatnonzero(p <= limit)
            posts.append(np.stack([self.keys(w)[at], np.full(len(at), item, np.uint64), at.astype(np.uint64)]))
        every = np.concatenate(posts, axis=1) if posts else np.zeros((3, 0), np.uint64)
        every = every[:, np.argsort(every[0], kind="stable")]
        self.seeds, start = np.unique(every[0], return_index=True)
        self.start = np.append(start, every.shape[1])
        self.item, self.place = every[1].astype(np.int64), every[2].astype(np.int64)
        self.marks = np.zeros(1 << 18, bool)
        self.marks[self._mark(self.seeds)] = True

    @staticmethod
    def _mark(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in `words`, items, and places in the items of all common seeds."""
        keys = self.keys(words)
        at = np.flatnonzero(self.marks[self._mark(keys)])
        n = np.searchsorted(self.seeds, keys[at])
        same = self.seeds[np.minimum(n, len(self.seeds) - 1)] == keys[at] if len(self.seeds) else np.zeros(len(at), bool)
        ok = same & (words[at] > 0) & (words[at + 1] > 0) & (words[at + 2] > 0)
        at, n = at[ok], n[ok]
        many = self.start[n + 1] - self.start[n]
        post = np.repeat(self.start[n] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.repeat(at, many), self.item[post], self.place[post]


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local score of a against b and where it ends in each; words 0 match nothing."""
    place = np.arange(len(b))
    above, best, end = np.zeros(len(b) + 1, np.int64), 0, (0, 0)
    for i, w in enumerate(a):
        row = np.maximum(np.maximum(above[:-1] + np.where((b == w) & (w > 0), 2, -1), above[1:] - 1), 0)
        row = np.maximum.accumulate(row + place) - place
        above[1:] = row
        j = int(row.argmax())
        if row[j] > best:
            best, end = int(row[j]), (i + 1, j + 1)
    return best, *end


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int, int, int]:
    """Score (0 to 1), and the aligned ranges in item and passage."""
    best, i, j = smith_waterman(item, passage)
    if not best:
        return 0.0, 0, 0, 0, 0
    _, back_i, back_j = smith_waterman(item[:i][::-1], passage[:j][::-1])
    return best / (2 * len(item)), i - back_i, i, j - back_j, j


def matches(items: Items, words: np.ndarray, bounds: np.ndarray, min_score: float) -> list[tuple]:
    """(document number, item number, score, range in item, range in document, seeds) for the documents in words; bounds cut them."""
    at, item, place = items.hits(words)
    doc = np.searchsorted(bounds, at, side="right") - 1
    inside = at + SEED <= bounds[doc + 1] if len(at) else np.zeros(0, bool)
    at, item, place, doc = at[inside], item[inside], place[inside], doc[inside]
    order = np.lexsort((at, item, doc))
    at, item, place, doc = at[order], item[order], place[order], doc[order]
    best: dict[tuple[int, int], tuple] = {}
    lo = 0
    while lo < len(at):
        d, t, hi = int(doc[lo]), int(item[lo]), lo + 1
        length = len(items.words[t])
        while hi < len(at) and doc[hi] == d and item[hi] == t and at[hi] - at[hi - 1] <= length and at[hi] - at[lo] <= 4 * length:
            hi += 1
        slack = length // 3 + 3 if length >= MIN_WORDS else 0
        first = max(int(bounds[d]), int((at[lo:hi] - place[lo:hi]).min()) - slack)
        last = min(int(bounds[d + 1]), int((at[lo:hi] - place[lo:hi]).max()) + length + slack)
        passage = words[first:last]
        least = min_score if length >= MIN_WORDS else 1.0
        if np.isin(items.words[t], passage).sum() >= least * length:
            score, i, j, x, y = align(items.words[t], passage)
            if score >= least and score > best.get((d, t), (0,))[0]:
                x, y = first + x - int(bounds[d]), first + y - int(bounds[d])
                best[d, t] = (score, i, j, x, y, hi - lo)
        lo = hi
    return [(*k, *v) for k, v in best.items()]


# ---- over tables --------------------------------------------------------------------------------------------------------------


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    size = benchmark.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = -(-size // (BLOCK_BYTES // 2)) if size > BLOCK_BYTES else 1
    for b in range(n):
        part = benchmark.select("item_id", "text").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield Items([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()])


def word_counts(docs: DataFrame, items: Items) -> np.ndarray:
    """How often each of the items' words occurs in all texts (0: all other words)."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    @trimmed
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, total = shared.value, None
        cache = Vocabulary(own.vocabulary)
        for pdf in batches:
            for text in pdf["text"]:
                got = np.bincount(cache.numbers(text), minlength=own.size)
                total = got if total is None else total + got
        if total is not None:
            at = np.flatnonzero(total)
            yield pd.DataFrame({"word": at, "n": total[at]})

    # at most one row for each word of a block of items
    table = written(docs.select("text").mapInPandas(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    found = table.collect()
    shared.destroy()
    out = np.zeros(items.size, dtype=np.int64)
    for r in found:
        out[r["word"]] = r["n"]
    if out.sum() != (table.agg(F.sum("n")).head()[0] or 0):
        raise RuntimeError("the counts of the items' words are not whole")
    release(table)
    return out


_MATCH = "item_id string, score double, item_words int, item_start int, item_end int, doc_start int, doc_end int, seeds int"


def _matches(docs: DataFrame, benchmark: DataFrame, min_score: float) -> DataFrame | None:
    """(key string, text) x (item_id, text) -> one row for each key and item, written; None without items."""
    spark, found = docs.sparkSession, []
    for items in _blocks(benchmark):
        if not items.ids:
            continue
        items.index(word_counts(docs, items))
        shared = spark.sparkContext.broadcast(items)

        @trimmed
        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own = shared.value
            cache = Vocabulary(own.vocabulary)
            for pdf in batches:
                keys, texts, rows = pdf["key"].tolist(), pdf["text"].tolist(), []
                for lo, hi in slices([len(t or "") for t in texts], _CHUNK):
                    words = [cache.numbers(t) for t in texts[lo:hi]]
                    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
                    for d, t, score, *rest in matches(own, np.concatenate([*words, np.zeros(SEED, np.int64)]), bounds, min_score):
                        rows.append((keys[lo + d], None if own.ids[t] is None else str(own.ids[t]), round(score, 6), len(own.words[t]), *rest))
                yield pd.DataFrame(rows, columns=["key", "item_id", "score", "item_words", "item_start", "item_end", "doc_start", "doc_end", "seeds"])

        found.append(written(docs.mapInPandas(search, f"key string, {_MATCH}"), "matches"))
        shared.destroy()
    return reduce(DataFrame.unionByName, found) if found else None


RESULT = "doc_id long, item_id long, score double, item_start int, item_end int, doc_start int, doc_end int, seeds int"


def contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, text) x (item_id, text) -> one row for each document and item that it holds a copy of, with the best copy's place.

    Ranges are in words, from the first to after the last aligned one."""
    got = _matches(docs.select(F.col("doc_id").cast("string").alias("key"), "text"), benchmark, min_score)
    if got is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    return got.select(F.col("key").cast("long").alias("doc_id"), F.col("item_id").cast("long").alias("item_id"), *[c.split()[0] for c in RESULT.split(", ")[2:]])


def clean(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs without the documents that hold a copy of a test item of MIN_WORDS words or more; documents without id are judged by their text."""
    got = _matches(docs.select(F.hex(row_key("doc_id", "text")).alias("key"), "text"), benchmark, min_score)
    if got is None:
        return docs
    bad = got.where(F.col("item_words") >= MIN_WORDS).select(F.unhex("key").alias("_docloom_k")).distinct()
    return docs.withColumn("_docloom_k", row_key("doc_id", "text")).join(bad, "_docloom_k", "left_anti").drop("_docloom_k")
