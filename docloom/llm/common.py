"""Helpers the operators of this package share: the shared folder, written tables, words."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = "\t\n\x0b\x0c\r"
_BLANK = re.compile(r"[\x20\x09-\x0D]")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master gets one of its own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/docloom-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark drops the shuffle files of a query that ends inside. Only for writes: each plans its query anew and has read all of it at its end."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and lost executors lose nothing of it. Its shuffle files go at once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _shuffles_dropped(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(table: DataFrame) -> None:
    """Deletes a table of `written` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if "/docloom-" in folder:
            _delete(table.sparkSession, folder)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has written to the shared folder; results that still read it end."""
    _delete(spark, _own_dir(spark))


def session_settings(spark: SparkSession, rows: int = 1000, megabytes: int = 4) -> None:
    """For an application over whole texts: lowers the session's Arrow batches to so many rows and bytes (a longer text alone).

    The operators do not call this themselves, as it holds for all queries of the session; their Python code cuts what it gets
    into slices by bytes in any case."""
    for key, most, shown in (("maxRecordsPerBatch", rows, rows), ("maxBytesPerBatch", megabytes << 20, f"{megabytes}m")):
        key = f"spark.sql.execution.arrow.{key}"
        now = re.fullmatch(r"(-?\d+)([kmg]?)b?", spark.conf.get(key).lower())
        size = int(now[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[now[2]] if now else 0
        if size <= 0 or size > most:
            spark.conf.set(key, str(shown))


def row_key(*columns: str) -> Column:
    """16 bytes that tell rows apart by the columns: two hashes of 64 bits, as one would meet by chance among billions of rows."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(salt), *columns)), 16, "0") for salt in ("a", "b"))))


_caches: dict[str, dict] = {}


def cache(module: str) -> dict:
    """What this Python worker keeps from one task of a module to the next."""
    return _caches.setdefault(module, {})


def _drop_caches(module: str) -> None:
    """Drops what tasks of other modules have kept."""
    for other in [m for m in _caches if m != module]:
        del _caches[other]


def trimmed(run):
    """A generator over a task's batches that drops other modules' caches and gives freed memory back to the system at its end, as Spark keeps
    idle Python workers and gives them tasks of any operator."""

    @functools.wraps(run)
    def wrapped(batches, *more, **named):
        _drop_caches(run.__module__)
        yield from run(batches, *more, **named)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def slices(sizes: list[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to at most `most` (a larger one alone)."""
    lo = 0
    while lo < len(sizes):
        hi, held = lo, 0
        while hi < len(sizes) and (hi == lo or held + sizes[hi] <= most):
            held += sizes[hi]
            hi += 1
        yield lo, hi
        lo = hi


def word_slices(text: str, most: int = 1 << 18) -> Iterator[str]:
    """The text in parts of about `most` characters, cut before a blank only (a longer word stays whole)."""
    lo = 0
    while lo < len(text):
        cut = _BLANK.search(text, lo + most) if len(text) - lo > most else None
        hi = cut.start() if cut else len(text)
        yield text[lo:hi]
        lo = hi


def n_words(text: Column) -> Column:
    """Number of words; null and empty texts have 0."""
    flat = F.trim(F.translate(F.coalesce(text, F.lit("")), _BLANKS, " " * len(_BLANKS)))
    return F.when(F.length(flat) == 0, F.lit(0)).otherwise(F.size(F.split(flat, " +"))).cast("long")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def word_shingles(text: str | None, shingle: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of every run of `shingle` words in order, repeats included, in slices of a long text; a shorter text is one run, a blank one none."""
    import xxhash

    digest, before, seen = xxhash.xxh64_intdigest, [], 0
    for part in word_slices(text or ""):
        words = before + utf8(part).lower().split()
        seen += len(words) - len(before)
        before = words[max(0, len(words) - shingle + 1) :]
        if len(words) < shingle:
            before = words
            continue
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-shingle] + 1]).tolist()
        yield np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
    if 0 < seen < shingle:
        yield np.array([digest(b" ".join(before), seed)], np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """The unsigned 64-bit SimHash of hashes that come in parts: a bit is 1 if it is set in over half of them."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones, n = ones + bits.sum(axis=0, dtype=np.int64), n + len(bits)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big") if n else 0


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *word_shingles(text, shingle, seed)])
