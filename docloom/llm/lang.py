"""Operator 3: language identification with bit-sliced Bloom filters of letter n-grams.

One table of slots serves all languages: slot i holds a bitmask with one bit for each language, so a look-up of an n-gram
(the AND of its slots' masks) returns at once all languages whose training texts are marked by it. A document's n-grams give one popcount
for each language; the share that false positives alone would give is taken off (each language's rate is known from its filter's
fill), and the largest corrected count decides.

The filters are fitted on a bounded sample: at most `per_language` labelled documents of each language, chosen by a hash of
doc_id, of the MAX_LANGUAGES lang values with most of them. An n-gram belongs to a language if at least MIN_SHARE of its sampled documents hold it and its rate is at least LIKE
times that of the language where it is most frequent. So a language holds at most (distinct n-grams of a mean document /
MIN_SHARE) entries, which bounds what the driver collects and sends out, whatever the size of the corpus.

Defined results: a text that is null, empty or without a letter is `und` with score 0; letters that no filter knows get the
learned value with the most training documents, score 0; with no labelled document every text is `und`. Repeated rows get
equal results. Columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import trimmed, word_slices

ORDERS = (2, 3, 4)
MIN_SHARE = 0.02
LIKE = 0.25
PER_LANGUAGE = 2_000
MAX_LANGUAGES = 1000
PROBES = 2
UNKNOWN = "und"
LETTER = r"\p{L}"
HELD_OUT = 5
LOW_QUANTILE = 0.01
SLACK = 0.75
_CHUNK = 1 << 18
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Code point -> itself if it is a letter, else 0."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((i if chr(i).isalpha() else 0 for i in range(0x110000)), dtype=np.uint32, count=0x110000)
    return _letters


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all lower-cased texts in a row (0 for anything else), and each text's range: it starts at the 0 before the text."""
    codes = np.frombuffer(("\n" + "\n".join(texts) + "\n\n\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return letter_table()[codes], bounds


def parts_of(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers and lower-cased texts, about _CHUNK characters at a time; a longer text in slices that are cut before a blank, which no
    n-gram goes across."""
    pieces = ((i, p) for i, t in enumerate(texts) for p in ([(t or "").lower()] if len(t or "") <= _CHUNK else map(str.lower, word_slices(t, _CHUNK))))
    numbers, held, size = [], [], 0
    for i, p in pieces:
        if held and size + len(p) > _CHUNK:
            yield numbers, held
            numbers, held, size = [], [], 0
        numbers.append(i)
        held.append(p)
        size += len(p)
    if held:
        yield numbers, held


def grams(letters: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows of n whose inner characters are letters; an end may be a word's edge."""
    size = len(letters) - n + 1
    on = letters != 0
    if n == 2:
        ok = on[:-1] | on[1:]
    else:
        ok = on[1 : 1 + size].copy()
        for i in range(2, n - 1):
            ok &= on[i : i + size]
    at = np.flatnonzero(ok)
    h = np.full(len(at), n * 0x2545F4914F6CDD1D & (2**64 - 1), dtype=np.uint64)
    for i in range(n):
        h += letters[at + i].astype(np.uint64) * _M[i]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return at, h


class Filters:
    """The bit-sliced filters of all languages; masks has one row of slots for each 64 languages."""

    def __init__(self, languages: list[str], entries: list[tuple[int, int]]):
        """entries: (n-gram hash, language number); languages: most training documents first."""
        self.languages = languages
        bits = max(10, int(np.ceil(np.log2(max(1, len(entries)) * 12))))
        self.mask = np.uint64((1 << bits) - 1)
        words = max(1, -(-len(languages) // 64))
        kind = np.uint8 if len(languages) <= 8 else np.uint16 if len(languages) <= 16 else np.uint64
        self.masks = np.zeros((words, 1 << bits), dtype=kind)
        if entries:
            h = np.array([e[0] for e in entries], dtype=np.int64).view(np.uint64)
            lang = np.array([e[1] for e in entries], dtype=np.int64)
            for slots in self.slots(h):
                for w in range(words):
                    own = lang // 64 == w
                    np.bitwise_or.at(self.masks[w], slots[own], np.left_shift(np.uint64(1), (lang[own] % 64).astype(np.uint64)).astype(kind))
        self.false = np.array([np.mean((self.masks[i // 64] >> kind(i % 64)) & kind(1)) ** PROBES for i in range(len(languages))])

    def slots(self, h: np.ndarray) -> list[np.ndarray]:
        return [((h >> np.uint64(32 * p)) & self.mask).astype(np.int64) for p in range(PROBES)]

    def look_up(self, h: np.ndarray, word: int = 0) -> np.ndarray:
        """For each n-gram the bitmask of all languages that hold it."""
        a, b = self.slots(h)
        return self.masks[word][a] & self.masks[word][b]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (0 to 1) and coverage (the winner's share of all n-grams) of each text."""
        n_langs, n = len(self.languages), len(texts)
        hits, total, seen = np.zeros((n_langs, n)), np.zeros(n), np.zeros(n, bool)
        for numbers, parts in parts_of(texts):
            letters, bounds = letters_of(parts)
            for order in ORDERS:
                at, h = grams(letters, order)
                cut = np.searchsorted(at, bounds)
                np.add.at(total, numbers, np.diff(cut))
                for w in range(len(self.masks)):
                    found = self.look_up(h, w)
                    for i in range(64 * w, min(n_langs, 64 * w + 64)):
                        run = np.zeros(len(found) + 1, dtype=np.int32)
                        np.cumsum((found >> found.dtype.type(i % 64)) & found.dtype.type(1), out=run[1:], dtype=np.int32)
                        np.add.at(hits[i], numbers, run[cut[1:]] - run[cut[:-1]])
            np.logical_or.at(seen, numbers, np.logical_or.reduceat(letters != 0, bounds[:-1]))
        if not n_langs:
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n)
        right = np.maximum(0, (hits - total * self.false[:, None]) / (1 - self.false[:, None]))
        best = np.argmax(right, axis=0)
        top = right[best, np.arange(n)]
        right[best, np.arange(n)] = -1
        second = np.maximum(0, right.max(axis=0))
        score = np.where(top > 0, 1 / (1 + (second / np.maximum(top, 1e-9)) ** 4), 0.0)
        cover = np.minimum(1.0, top / np.maximum(total, 1))
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best, seen)], np.where(seen, score, 0.0), np.where(seen, cover, 0.0)


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def _document_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams and how many of the texts hold each; counts are folded after each part, so only distinct n-grams are kept."""
    gram, docs, last, open_ = np.zeros(0, np.uint64), np.zeros(0, np.int64), -1, np.zeros(0, np.uint64)

    def fold(new: list[np.ndarray]) -> None:
        nonlocal gram, docs
        every, counts = np.concatenate([gram, *new]), np.concatenate([docs, *(np.ones(len(x), np.int64) for x in new)])
        gram, at = np.unique(every, return_inverse=True)
        docs = np.bincount(at, counts, len(gram)).astype(np.int64)

    for numbers, parts in parts_of(texts):
        letters, bounds = letters_of(parts)
        found: dict[int, list[np.ndarray]] = {}
        for order in ORDERS:
            at, h = grams(letters, order)
            cut = np.searchsorted(at, bounds)
            for i, a, b in zip(numbers, cut[:-1], cut[1:]):
                found.setdefault(i, []).append(h[a:b])
        own = {i: np.unique(np.concatenate([*x, open_] if i == last else x)) for i, x in found.items()}
        if last >= 0 and last not in own:
            fold([open_])
        last = numbers[-1]
        open_ = own.pop(last)  # its next slice may be in the next part
        fold(list(own.values()))
    fold([open_])
    return gram, docs


@trimmed
def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, text) -> (lang, gram, docs): how many of the batch's documents hold the n-gram."""
    for pdf in batches:
        for lang, group in pdf.groupby("lang"):
            gram, docs = _document_counts(group["text"].tolist())
            yield pd.DataFrame({"lang": lang, "gram": gram.view(np.int64), "docs": docs.astype(np.int64)})


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Filters:
    """labelled: (doc_id, text, lang) that may be learned from; rows without lang or doc_id teach nothing."""
    labelled = labelled.where("lang is not null and text is not null and doc_id is not null")
    most = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES)
    counts = {r["lang"]: r["count"] for r in most.collect()}
    if not counts:
        return Filters([], [])
    limit = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, per_language / n) * (1 << 30)))])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.element_at(limit, F.col("lang")))
    chosen = chosen.select("lang", "text")
    sampled = {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()}
    languages = sorted(sampled, key=lambda k: (-counts[k], k))
    rate = F.col("docs") / F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, float(sampled[k]))]), F.col("lang"))
    grams_of = chosen.mapInPandas(_count, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs")).withColumn("rate", rate)
    grams_of = grams_of.where(F.col("rate") >= MIN_SHARE)
    most = grams_of.groupBy("gram").agg(F.max("rate").alias("most"))
    kept = grams_of.join(most, "gram").where(F.col("rate") >= LIKE * F.col("most")).select("gram", "lang").collect()
    number = {k: i for i, k in enumerate(languages)}
    return Filters(languages, [(r["gram"], number[r["lang"]]) for r in kept])


def coverage_bounds(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> dict[str, float]:
    """Language -> a low quantile of coverage over documents of that language that the filters have not seen, times SLACK.

    Filters of their own are fitted outside one fold, and at most per_language / 4 documents of each language inside it are read."""
    labelled = labelled.where("lang is not null and doc_id is not null")
    out, held = labelled.where(remainder(HELD_OUT) != 0), labelled.where(remainder(HELD_OUT) == 0).where(F.col("text").rlike(LETTER))
    model = fit(out, per_language)
    counts = {r["lang"]: r["count"] for r in held.where(F.col("lang").isin(model.languages)).groupBy("lang").count().collect()}
    if not counts:
        return {}
    limit = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, per_language / 4 / n) * (1 << 30)))])
    chosen = held.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.element_at(limit, F.col("lang")))
    low = identify(chosen, model).groupBy("lang").agg(F.percentile_approx("coverage", LOW_QUANTILE).alias("low")).collect()
    return {r["lang"]: SLACK * r["low"] for r in low}


RESULT = "lang_pred string, score double, coverage double"


def identify(df: DataFrame, model: Filters, text: str = "text") -> DataFrame:
    """df with lang_pred, score and coverage of column `text`."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    @trimmed
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for series in batches:
            lang, score, cover = own.predict(series.tolist())
            yield pd.DataFrame({"lang_pred": lang, "score": score, "coverage": cover})

    # else a filter on the result predicts once more, in a Python worker of its own for each task
    predict = predict.asNondeterministic()
    return df.drop("lang_pred", "score", "coverage").withColumn("_docloom_lang", predict(F.col(text))).select("*", "_docloom_lang.*").drop("_docloom_lang")


def predict_documents(docs: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """Learns from the documents outside the held-out fold, predicts all."""
    mine = docs.select("doc_id", "text", "lang")
    model = fit(mine.where(remainder(modulus) != held))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(remainder(modulus) == held, F.lit(False)).alias("held_out"), "lang_pred", "score", "coverage")
