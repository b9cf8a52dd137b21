"""Similarity of many queries against an index in blocks (V9, J7), and an approximate index of inverted lists with quantised residuals.

Queries come in blocks of at most QUERY_BYTES of vectors, so that one can be sent to all tasks; each block is one scan of the index. A task multiplies the
rows of a batch with the block's queries as matrices and keeps, for each query and group, the k best so far. It sends at most k rows for each of them, which one
small shuffle and a window merge. So rows that travel are tasks x queries x groups x k at most, and never index rows x queries.

Products of matrices round differently by place, so they only choose: what is within MARGIN of the k-th best gets its score again as the sum of
products in order of dimension, as `search.dot` and SQL have it. Ties go by key.

`ListIndex` is the approximate form: k-means centroids of a bounded sample, every row in the list of its nearest centroid, and the residual in PARTS
bytes, each the nearest of 256 centroids of its part. Lists are partitions of the written table, split over files where they are large, so a query reads only the lists that
it probes. Codes choose `rerank` rows for each query and batch, and these are scored exactly. Probing all lists without codes is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

QUERY_BYTES = 4 << 20
ROWS = 1024
MARGIN = 1e-6
SAMPLE = 20_000
PARTS = 16
RECALL = 0.95
_SLICE = 1 << 15


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrays of equal length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of the rows of x with those of y, summed by dimension in order."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


class Best:
    """The k best rows so far for each query and group: exact scores, ties by key."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.held: dict[object, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, group: object, keys: np.ndarray, rows: np.ndarray, chosen: np.ndarray | None = None) -> None:
        """Offers rows of a group to the queries `chosen` (all if None)."""
        own = np.arange(len(self.queries)) if chosen is None else chosen
        for lo in range(0, len(rows), ROWS):
            part = rows[lo : lo + ROWS]
            s = part @ self.queries[own].T
            floor = np.partition(s, len(part) - self.k, axis=0)[len(part) - self.k] if len(part) > self.k else np.full(len(own), -np.inf)
            if group in self.held:
                floor = np.maximum(floor, self.floors(group)[own])
            self.exact(group, keys[lo : lo + ROWS], part, own, *np.nonzero(s >= floor - MARGIN))

    def exact(self, group: object, keys: np.ndarray, rows: np.ndarray, own: np.ndarray, at: np.ndarray, q: np.ndarray) -> None:
        """Scores the pairs (row at, query q of own) and keeps the best; in slices, as equal vectors make many pairs near the k-th best."""
        for lo in range(0, len(at), _SLICE):
            i, j = at[lo : lo + _SLICE], own[q[lo : lo + _SLICE]]
            self.keep(group, j, in_order(rows[i], self.queries[j]), keys[i])

    def keep(self, group: object, q: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        if group in self.held:
            q, score, key = (np.concatenate(x) for x in zip(self.held[group], (q, score, key)))
        order = np.lexsort((key, -score, q))
        q, score, key = q[order], score[order], key[order]
        first = np.searchsorted(q, q)  # where a query's rows begin
        best = np.arange(len(q)) - first < self.k
        self.held[group] = q[best], score[best], key[best]

    def floors(self, group: object) -> np.ndarray:
        """The k-th best score of each query, or less than any."""
        q, score, _ = self.held[group]
        out, n = np.full(len(self.queries), -np.inf), np.bincount(q, minlength=len(self.queries))
        full = n >= self.k
        out[full] = score[np.cumsum(n)[full] - 1]
        return out


def query_blocks(queries: DataFrame, most: int = QUERY_BYTES) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Queries (query_id, query) in blocks of about `most` bytes of vectors, by the hash of their id: ids and matrix."""
    size = queries.agg(F.sum(F.size("query")) * 8).head()[0] or 0
    n = max(1, -(-size // most))
    for b in range(n):
        table = queries.select("query_id", F.col("query").cast("array<double>").alias("query")).where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).toArrow()
        if table.num_rows:
            yield table.column("query_id").combine_chunks(), matrix(table.column("query"))


def _kind(df: DataFrame, column: str):
    return df.schema[column].dataType


def _shape(index: DataFrame, queries: DataFrame, by: list[str], key: str) -> StructType:
    fields = [StructField("query_id", _kind(queries, "query_id")), *[StructField(c, _kind(index, c)) for c in by], StructField(key, _kind(index, key)), StructField("score", DoubleType())]
    return StructType(fields)


def _emit(best: Best, ids: pa.Array, by: list[str], kinds: list[pa.DataType], key: str, key_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for group, (q, score, keys) in best.held.items():
        own = [pa.array([v] * len(q), t) for v, t in zip(group, kinds)]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), *own, pa.array(keys.tolist(), key_kind), pa.array(score)], ["query_id", *by, key, "score"])


def _ranked(found: DataFrame, by: list[str], key: str, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", *by).orderBy(F.col("score").desc(), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k_each(index: DataFrame, queries: DataFrame, k: int, by: list[str], folder: str, key: str = "vec_id", vector: str = "embedding", block: int = QUERY_BYTES) -> DataFrame:
    """V9 for many queries: query_id, by..., key, score and rank of the k best rows for each query and group, exact. Each block's rows are written below folder.

    Rows and queries without a vector have no score and are left out."""
    rows = index.select(key, *by, F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    queries = queries.where("query is not null")
    out = _shape(index, queries, by, key)
    for ids, q in query_blocks(queries, block):

        def search(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            best, kinds, key_kind = Best(q, k), [], None
            for batch in batches:
                key_kind, kinds = batch.schema.field(0).type, [batch.schema.field(1 + i).type for i in range(len(by))]
                keys, x = np.array(batch.column(0).to_pylist()), matrix(batch.column(len(by) + 1))
                groups: dict[tuple, list[int]] = {}
                for i, g in enumerate(zip(*(batch.column(1 + c).to_pylist() for c in range(len(by)))) if by else [()] * len(keys)):
                    groups.setdefault(g, []).append(i)
                for g, at in groups.items():
                    best.add(g, keys[at], x[at])
            if key_kind is not None:
                yield from _emit(best, ids, by, kinds, key, key_kind)

        rows.mapInArrow(search, out).write.mode("append").parquet(folder)
    spark = index.sparkSession
    return _ranked(spark.read.schema(out).parquet(folder) if not queries.isEmpty() else spark.createDataFrame([], out), by, key, k)


# ---- inverted lists -----------------------------------------------------------------------------------------------------------------


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centroids of a sample by Lloyd's rounds; an empty one moves to the row farthest from its own."""
    rnd = np.random.default_rng(seed)
    centers = x[rnd.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centers)
        far = np.argsort(-((x - centers[near]) ** 2).sum(1), kind="stable")
        n = np.bincount(near, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        for spare, c in enumerate(np.flatnonzero(n == 0)):
            centers[c] = x[far[spare]]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers**2).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *[np.argmax(x[lo : lo + 4096] @ centers.T - half, axis=1) for lo in range(0, len(x), 4096)]])


@dataclass
class Quantiser:
    """Centroids of the lists, and for each part of a residual 256 centroids."""

    lists: np.ndarray
    parts: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, parts: int = PARTS) -> Quantiser:
        centers = k_means(x, min(lists, len(x)))
        residual = x - centers[nearest(x, centers)]
        return cls(centers, [k_means(r, min(256, len(r)), 8) for r in np.array_split(residual, min(parts, x.shape[1]), axis=1)])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = nearest(x, self.lists)
        return own, np.stack([nearest(r, c) for r, c in zip(np.array_split(x - self.lists[own], len(self.parts), axis=1), self.parts)], axis=1).astype(np.uint8)

    def probes_for(self, x: np.ndarray, wanted: float, k: int = 10, queries: int = 256) -> int:
        """The least number of lists whose rows hold so great a share of the k nearest rows of x to its first rows (a row is no neighbour of its own)."""
        q = x[:queries]
        s = q @ x.T
        s[np.arange(len(q)), np.arange(len(q))] = -np.inf
        k = min(k, len(x) - 1)
        if k < 1:
            return 1
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        order = np.argsort(np.argsort(-(q @ self.lists.T), axis=1), axis=1)
        places = np.sort(order[np.arange(len(q))[:, None], nearest(x, self.lists)[top]].ravel())
        return int(places[min(len(places) - 1, int(np.ceil(wanted * len(places))) - 1)]) + 1

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of each query with each part's centroids: query x part x 256."""
        out = np.zeros((len(q), len(self.parts), 256))
        for m, (part, c) in enumerate(zip(np.array_split(q, len(self.parts), axis=1), self.parts)):
            out[:, m, : len(c)] = part @ c.T
        return out


def offer(best: Best, model: Quantiser, group: tuple, keys: np.ndarray, x: np.ndarray, codes: np.ndarray, chosen: np.ndarray, own: int, rerank: int | None) -> None:
    """Rows of list `own` to the queries that probe it: all of them, or for each query the `rerank` rows of best score by their codes. The products of queries with parts
    are made for a slice of queries at a time: those of a whole block would be 32 KB for each query in every task."""
    if rerank is None or len(keys) <= rerank:
        best.add(group, keys, x, chosen)
        return
    for lo in range(0, len(chosen), 256):
        some = chosen[lo : lo + 256]
        tables = model.tables(best.queries[some])
        rough = (best.queries[some] @ model.lists[own])[:, None] + sum(tables[:, m][:, codes[:, m]] for m in range(codes.shape[1]))
        top = np.argpartition(-rough, rerank - 1, axis=1)[:, :rerank]
        best.exact(group, keys, x, some, top.ravel(), np.repeat(np.arange(len(some)), rerank))


class ListIndex:
    """Inverted lists over (key, vector, ...): a written table below path, partitioned by list."""

    def __init__(self, spark: SparkSession, path: str, quantiser: Quantiser, key: str, probe: int):
        self.spark, self.path, self.quantiser, self.key, self.probe = spark, path, quantiser, key, probe

    @classmethod
    def build(cls, index: DataFrame, path: str, lists: int | None = None, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, parts: int = PARTS, wanted: float = RECALL) -> ListIndex:
        """`probe` is set to what a recall at ten of `wanted` takes inside the sample: more than in the whole index, whose neighbours are nearer.

        Fits on at most `sample` rows, those of least hash of their key, and writes every row with a vector. lists: about the root of the number of rows if not given.

        The model (lists x dimension numbers, and 256 x dimension) is sent to every task; it does not grow with the rows but by the choice of lists (at most 65,536)."""
        spark, rows = index.sparkSession, index.where(F.col(vector).isNotNull())
        n = rows.count()
        lists = lists or max(1, min(65_536, round(n**0.5)))
        taken = rows.select(key, F.col(vector).cast("array<double>").alias("v")).orderBy(F.xxhash64(key), key).limit(sample).toArrow()
        if not taken.num_rows:
            raise ValueError("there is nothing to fit an index on")
        known = matrix(taken.column("v"))
        model = Quantiser.fit(known, lists, parts)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, codes = model.encode(matrix(batch.column(batch.schema.get_field_index("v"))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(own, pa.int32())], [*batch.schema.names, "codes", "list"])

        full = rows.withColumn("v", F.col(vector).cast("array<double>")).drop(vector)
        shape = StructType([*full.schema.fields, *StructType.fromDDL("codes binary, list int").fields])
        # by range of list and hash: neighbours in a file, and a list that holds a third of all rows is still split
        full.mapInArrow(assign, shape).repartitionByRange("list", F.xxhash64(key)).write.mode("overwrite").partitionBy("list").parquet(path)
        return cls(spark, path, model, key, model.probes_for(known, wanted))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def probes(self, q: np.ndarray, n: int | None) -> np.ndarray:
        """The lists nearest to each query, by inner product."""
        s = q @ self.quantiser.lists.T
        n = min(n or s.shape[1], s.shape[1])
        return np.argpartition(-s, n - 1, axis=1)[:, :n]

    def scan(self, lists: list[int]) -> DataFrame:
        """The rows of some lists; other lists' files are not read."""
        return self.read().where(F.col("list").isin(lists))

    def search(self, queries: DataFrame, k: int, folder: str, probe: int | None = None, rerank: int | None = None, by: tuple[str, ...] = (), block: int = QUERY_BYTES) -> DataFrame:
        """query_id, by..., key, score and rank of the k best rows in the `probe` nearest lists (all if None), with exact scores. rerank: how many rows of each list's batch their codes
        choose for each query before that (all if None). Without both the result is exact."""
        by, key, model = list(by), self.key, self.quantiser
        rows = self.read()
        out = _shape(rows, queries, by, key)
        queries = queries.where("query is not null")
        for ids, q in query_blocks(queries, block):
            near = self.probes(q, probe)
            wanted: dict[int, np.ndarray] = {}
            flat = near.ravel()
            order = np.argsort(flat, kind="stable")
            cuts = np.flatnonzero(np.diff(flat[order])) + 1
            for at in np.split(order, cuts):
                wanted[int(flat[at[0]])] = at // near.shape[1]

            def look(batches: Iterator[pa.RecordBatch], ids=ids, q=q, wanted=wanted) -> Iterator[pa.RecordBatch]:
                best, kinds, key_kind = Best(q, k), [], None
                for batch in batches:
                    key_kind, kinds = batch.schema.field(0).type, [batch.schema.field(1 + i).type for i in range(len(by))]
                    keys, x = np.array(batch.column(0).to_pylist()), matrix(batch.column(len(by) + 1))
                    codes = np.frombuffer(b"".join(batch.column(len(by) + 2).to_pylist()), np.uint8).reshape(len(keys), -1)
                    groups: dict[tuple, list[int]] = {}
                    labels = [batch.column(1 + c).to_pylist() for c in range(len(by))]
                    for i, g in enumerate(zip(batch.column(len(by) + 3).to_pylist(), *labels)):
                        groups.setdefault(g, []).append(i)
                    for (own, *g), at in groups.items():
                        if (chosen := wanted.get(own)) is not None:
                            offer(best, model, tuple(g), keys[at], x[at], codes[at], chosen, own, rerank)
                if key_kind is not None:
                    yield from _emit(best, ids, by, kinds, key, key_kind)

            self.scan(sorted(wanted)).select(key, *by, "v", "codes", "list").mapInArrow(look, out).write.mode("append").parquet(folder)
        found = self.spark.read.schema(out).parquet(folder) if not queries.isEmpty() else self.spark.createDataFrame([], out)
        return _ranked(found, by, key, k)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> float:
    """The share of the exact results that were found."""
    return exact.join(found.select("query_id", key, F.lit(1).alias("_hit")), ["query_id", key], "left").agg(F.avg(F.coalesce("_hit", F.lit(0)))).head()[0]
