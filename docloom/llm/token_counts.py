"""Operator 13: exact token counts of every prefix of a text, for a byte-pair tokenizer of pieces with scores.

A byte-pair encoding of a text is the one sequence of pieces in which every two neighbours encode to themselves: merges inside a piece go
on as if its neighbours were not there, until one would cross the border, which in a valid pair never comes. So of the pieces that end at a
place exactly one can follow the encoding of what lies before it, and a prefix's encoding is that of a shorter prefix plus one piece:

    count[i] = count[i - |piece|] + 1, for the one piece that ends at i and is valid after last[i - |piece|]

One pass from left to right therefore gives the token count of *every* prefix, and questions about prefixes (how many tokens has the first
half, where does a budget of 4,096 tokens end) are looked up and not encoded again. Validity of pairs is worked out once for each pair by
merging the two pieces' characters, and kept. A character that no piece holds is its UTF-8 bytes' tokens and never merges.

A text is cut where no piece of the model can cross: before a blank that follows another character, and between a letter and what is no
letter (the few letters that some piece holds before anything else do not count as such here; they are found when the model is loaded).
Segments' counts are kept in a cache of each worker, as texts repeat their words.

The table of `prefix_counts` has one row for each text: doc_id, n_bytes, n_chars, n_tokens, width and prefix, the zlib-packed differences of
the counts from one prefix to the next (width bytes each, as they can fall too). `tokens_at` and `truncate` read it.

Defined results: null and empty texts have no tokens and an empty prefix; a text of blanks is counted as the model's blanks; repeated rows and
ties give equal rows; an empty table gives no rows; texts of any length are counted whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import trimmed, utf8

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
BLANK = "▁"
_HEAD, _CACHED, _SEGMENTS, _PAIRS = 5, 48, 300_000, 1_000_000
_SLICE = 1 << 20


class Pieces:
    """The pieces of a sentencepiece byte-pair model with their scores, and which pairs of them are encodings."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in ids}
        if sp.normalize("a  Béﬁ ") != f"{BLANK}a{BLANK}{BLANK}Béﬁ{BLANK}":
            raise ValueError("prefixes are defined for models that keep every character and put one blank in front")
        neighbours = {(a, b) for p in self.score for a, b in zip(p, p[1:])}
        if any(b == BLANK and a != BLANK for a, b in neighbours):
            raise ValueError("a piece of this model crosses from a word to a blank")
        self.touching = {a + b for a, b in neighbours}
        letter = re.compile(r"[^\W\d_]").match
        odd = {a for a, b in neighbours if letter(a) and not letter(b)}  # letters that a piece holds before what is none count as none
        while more := {a for a, b in neighbours if letter(a) and a not in odd and b in odd}:
            odd |= more
        rest = re.escape("".join(sorted(odd)))
        other = rf"(?:[\d_{rest}]|[^\w{BLANK}])"
        #: a segment is blanks, then what is no letter, then letters: no piece goes on behind it
        self.cut = re.compile(rf"{BLANK}*{other}*[^\W\d_{rest}]+|{BLANK}*{other}+|{BLANK}+")
        self.ids: dict[str, int] = {}
        for p in self.score:  # a piece that does not encode to itself is in no encoding
            if self.merged(list(p)) == [p]:
                self.ids[p] = len(self.ids)
        self.names = list(self.ids)
        #: how long pieces are that end in three characters
        self.ends: dict[str, int] = {}
        for p in self.names:
            self.ends[p[-3:]] = max(len(p), self.ends.get(p[-3:], 0))
        self.pairs: dict[int, bool] = {}
        self.recent: dict[str, tuple[str, list, list]] = {}
        self.segments = Segments(self)

    def merged(self, characters: list[str]) -> list[str]:
        """The encoding by merging, best score first and leftmost of equals; only used for pieces and pairs of pieces."""
        parts = list(characters)
        while True:
            best, at = None, -1
            for i, (a, b) in enumerate(zip(parts, parts[1:])):
                s = self.score.get(a + b)
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, last: int, piece: int) -> bool:
        """Whether the two are the encoding of their text."""
        a, b = self.names[last], self.names[piece]
        if a[-1] + b[0] not in self.touching:  # no piece holds the two characters side by side
            return True
        return self.merged(list(a + b)) == [a, b]

    def differences(self, segment: str) -> bytes:
        """Of each prefix's token count from the one before, by dynamic programming over the prefixes."""
        ids, ends, pairs, n = self.ids.get, self.ends.get, self.pairs, len(segment)
        head, start = segment[:_HEAD], 0
        known, last, count = self.recent.get(head, ("", [None], [0]))  # a segment that began alike: its prefixes are this one's
        if known:
            start = _HEAD
            while start < n and start < len(known) and known[start] == segment[start]:
                start += 1
        last, count = last[: start + 1] + [None] * (n - start), count[: start + 1] + [0] * (n - start)
        for i in range(start + 1, n + 1):
            if segment[i - 1] not in self.score:  # its bytes are tokens, and nothing merges with them
                count[i] = count[i - 1] + len(segment[i - 1].encode("utf-8", "surrogatepass"))
                continue
            most = ends(segment[i - 3 : i], 2) if i > 2 else i
            for j in range(i - most if i > most else 0, i):
                if (piece := ids(segment[j:i])) is None:
                    continue
                if (before := last[j]) is not None:
                    key = before << 20 | piece
                    if (ok := pairs.get(key)) is None:
                        if len(pairs) >= _PAIRS:
                            pairs.clear()
                        ok = pairs[key] = self.follows(before, piece)
                    if not ok:
                        continue
                last[i], count[i] = piece, count[j] + 1
                break
            else:
                raise AssertionError(f"no encoding ends at {i} of {segment!r}")
        if _HEAD <= n <= _CACHED:
            if len(self.recent) >= _SEGMENTS // 3:
                self.recent.clear()
            self.recent[head] = (segment, last, count)
        return array("i", map(int.__sub__, count[1:], count)).tobytes()

    def prefix(self, text: str | None) -> np.ndarray:
        """Differences of the token counts of the prefixes of 0, 1, ... characters."""
        if not text:
            return np.zeros(0, "<i4")
        line = BLANK + text.replace(" ", BLANK)
        found = np.frombuffer(b"".join(map(self.segments.__getitem__, self.cut.findall(line))), "<i4")
        out = found[1:].copy()  # the blank in front belongs to the first character
        out[0] += found[0]
        return out


class Segments(dict):
    """Segment -> the differences of its prefixes' counts. Two generations: where the newer one is full, what it did not ask for again goes."""

    def __init__(self, own: Pieces):
        self.own, self.old = own, {}

    def __missing__(self, segment: str) -> bytes:
        found = self.old.get(segment) or self.own.differences(segment)
        if len(segment) <= _CACHED:
            if len(self) >= _SEGMENTS:
                self.old = dict(self)
                self.clear()
            self[segment] = found
        return found


@lru_cache(maxsize=2)
def pieces(model_file: str) -> Pieces:
    """A worker's own, with its caches."""
    return Pieces(model_file)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(differences: np.ndarray) -> tuple[int, bytes]:
    """Bytes a difference, and their zlib form."""
    for width in (1, 2):
        small = differences.astype(f"<i{width}")
        if (small == differences).all():
            return width, zlib.compress(small.tobytes(), 1)
    return 4, zlib.compress(differences.astype("<i4").tobytes(), 1)


def counts(width: int, prefix: bytes) -> np.ndarray:
    """The token counts of the prefixes of 0, 1, ... n characters."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(zlib.decompress(prefix), f"<i{width}"), dtype=np.int64)])


def prefix_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_chars, n_tokens, width, prefix (the module's docstring says how to read it).

    model is a file of public_tokenizers, found anew on each executor, or a path. No shuffle: each text is counted where it is read."""
    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", "n_bytes", "n_chars", "n_tokens", "width", "prefix"]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model if "/" in model else model_path(model))
        for batch in batches:
            ids, texts, lo = batch.column(0), batch.column(1), 0
            rows: list[tuple] = []
            held = 0
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                found = own.prefix(text)
                width, prefix = packed(found)
                rows.append((len(utf8(text)), len(found), int(found.sum()), width, prefix))
                held += len(prefix) + 40
                if held >= _SLICE or i + 1 == batch.num_rows:
                    n_bytes, n_chars, n_tokens, widths, prefixes = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(lo, len(rows)), pa.array(n_bytes, pa.int64()), pa.array(n_chars, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(widths, pa.int32()), pa.array(prefixes, pa.binary())], names
                    )
                    lo, rows, held = i + 1, [], 0

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, n_bytes long, n_chars long, n_tokens long, width int, prefix binary")


def tokens_at(characters: Column, width: str = "width", prefix: str = "prefix") -> Column:
    """Tokens of the first so many characters (of the whole text if it is shorter; none of fewer than 1)."""

    @F.pandas_udf("long")
    def look_up(n: pd.Series, w: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([None if k is None or k != k else int((c := counts(b, x))[min(max(int(k), 0), len(c) - 1)]) for k, b, x in zip(n, w, p)], dtype=object)

    return look_up(characters, width, prefix)


def truncate(limit: Column, width: str = "width", prefix: str = "prefix") -> Column:
    """Characters of the longest prefix of at most so many tokens. Counts can fall where a merge ends, so it may lie behind a prefix over the limit."""

    @F.pandas_udf("long")
    def look_up(most: pd.Series, w: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([int(np.flatnonzero(counts(b, x) <= max(int(m), 0))[-1]) for m, b, x in zip(most, w, p)])

    return look_up(limit, width, prefix)


def budgets(docs: DataFrame, table: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs whose text is cut to its longest prefix of at most `limit` tokens, by the table of `prefix_counts`; n_tokens of what is left is added.

    Rows meet by doc_id, which must tell them apart; texts over the limit alone go through Python."""
    over = table.where(F.col("n_tokens") > limit).select("doc_id", truncate(F.lit(limit)).alias("_docloom_keep"), "width", "prefix")
    over = over.select("doc_id", "_docloom_keep", tokens_at(F.col("_docloom_keep")).alias("_docloom_n"))
    short = table.select("doc_id", "n_tokens").join(over, "doc_id", "left")
    out = docs.drop("n_tokens").join(short, "doc_id")
    text = F.when(F.col("_docloom_keep").isNull(), F.col("text")).otherwise(F.substring("text", F.lit(1), F.col("_docloom_keep").cast("int")))
    return out.withColumns({"text": text, "n_tokens": F.coalesce("_docloom_n", "n_tokens")}).drop("_docloom_keep", "_docloom_n")


def count_documents(docs: DataFrame, limit: int = LIMIT, model: str = MODEL) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the text is over the limit: the last prefix of each row of `prefix_counts`."""
    return prefix_counts(docs, model).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
