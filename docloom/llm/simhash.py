"""Operator 4: near-duplicates by SimHash with a Gray-order hierarchical index.

Fingerprints that differ in at most DISTANCE = 4 bits agree in `agree` of 4 + agree blocks of bits, whichever these are. So each
distinct fingerprint goes to one cell for each choice of agreeing blocks (five for agree = 1), and every link is found inside a
cell. `agree` grows with the number of fingerprints, so that a cell of evenly spread ones stays small; every choice is exact. In a cell the fingerprints are sorted by Gray rank, which
brings those with common bits together; above them stands a tree: each node keeps the bits that all fingerprints below it share,
and only those that its parent does not have already. Two nodes are compared from the root down, the differences in shared bits
add up, and as soon as they exceed the distance, all pairs below are pruned at once. Nodes below which all belong to one known component
are not compared with each other, so a dense group costs no pairs; a cell gives a spanning forest, not all its links.

A cell of more than `cell_rows` fingerprints is cut into ranges of Gray rank; each pair of ranges whose shared bits differ in at most
the distance is a task of its own. Exact copies share one fingerprint and never meet as pairs.

Defined results: null, empty and blank texts have fingerprint zero, which links like any other; repeated rows get equal results;
a null doc_id takes part but is never the smallest (a component of null ids only has component_id null); an empty table gives no rows.

keep_one takes the links of this index as candidates that whole shingle sets confirm, and finds the links that fingerprints
cannot tell (a similarity of 0.8 leaves about ten bits that differ) by an exact join of the rest (see overlap).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import overlap
from docloom.llm.common import majority, row_key, trimmed, word_shingles, written
from docloom.llm.components import components

SHINGLE = 4
DISTANCE = 4
FANOUT = 8
MEAN_CELL = 4096
CELL_ROWS = 1 << 16
_AT_ONCE = 1 << 15
_SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of XXH64 hashes of word shingles, repeats included; a long text is folded in slices."""
    return majority(word_shingles(text, shingle, _SEED))


def with_fingerprint(df: DataFrame, text: str = "text", into: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """df with the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return df.withColumn(into, fp(F.col(text)))


# ---- the index ----------------------------------------------------------------------------------------------------------------


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each bit pattern in the reflected Gray sequence."""
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Fingerprints in the order of (cell, Gray rank) under nodes of shared bits."""

    def __init__(self, cell: np.ndarray, fp: np.ndarray):
        order = np.lexsort((gray_rank(fp), cell))
        self.cell, self.fp = cell[order], fp[order]
        every = np.uint64(2**64 - 1)
        #: for each level from the leaves up: bits shared by all below, their values, first and last cell
        self.levels = [(np.full(len(fp), every), self.fp, self.cell, self.cell)]
        ones, zeros = self.fp, ~self.fp
        while len(ones) > FANOUT:
            at = np.arange(0, len(ones), FANOUT)
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
            self.levels.append((ones | zeros, ones, self.cell[at * FANOUT ** (len(self.levels) - 1)], np.maximum.reduceat(self.levels[-1][3], at)))
        self.label = np.arange(len(fp))

    def _find(self) -> None:
        while True:
            up = self.label[self.label]
            if (up == self.label).all():
                return
            self.label = up

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            la, lb = self.label[a], self.label[b]
            differ = la != lb
            if not differ.any():
                return
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            np.minimum.at(self.label, np.maximum(la, lb), np.minimum(la, lb))
            self._find()

    def _uniform(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Smallest and largest label below each node."""
        out = [(self.label, self.label)]
        for _ in self.levels[1:]:
            at = np.arange(0, len(out[-1][0]), FANOUT)
            out.append((np.minimum.reduceat(out[-1][0], at), np.maximum.reduceat(out[-1][1], at)))
        return out

    def link(self, distance: int) -> None:
        """Joins the labels of all fingerprints of one cell at most `distance` apart."""
        n = len(self.fp)
        for lag in range(1, min(n, 5)):  # neighbours in Gray order first: dense groups become uniform nodes
            a = np.flatnonzero((self.cell[lag:] == self.cell[:-lag]) & (np.bitwise_count(self.fp[lag:] ^ self.fp[:-lag]) <= distance))
            self.unite(a, a + lag)
        top = len(self.levels) - 1
        m = len(self.levels[top][0])
        a, b = np.triu_indices(m)
        stack = [(top, a, b, np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint8))]
        below, stale = self._uniform(), False
        while stack:
            level, a, b, known, acc = stack.pop()
            if len(a) > _AT_ONCE:
                half = len(a) // 2
                stack += [(level, a[half:], b[half:], known[half:], acc[half:]), (level, a[:half], b[:half], known[:half], acc[:half])]
                continue
            shared, value, first, last = self.levels[level]
            both = shared[a] & shared[b] & ~known  # the bits that the nodes above did not settle
            acc = acc + np.bitwise_count((value[a] ^ value[b]) & both)
            if stale:
                below, stale = self._uniform(), False
            lo, hi = below[level]
            keep = (acc <= distance) & (last[a] >= first[b]) & ~((lo[a] == hi[a]) & (lo[b] == hi[b]) & (lo[a] == lo[b]))
            a, b, known, acc = a[keep], b[keep], (known | both)[keep], acc[keep]
            if not len(a):
                continue
            if level == 0:
                self.unite(a, b)
                stale = True
                continue
            size = len(self.levels[level - 1][0])
            i, j = (x.ravel() for x in np.broadcast_arrays(FANOUT * a[:, None, None] + np.arange(FANOUT)[:, None], FANOUT * b[:, None, None] + np.arange(FANOUT)))
            of = np.repeat(np.arange(len(a)), FANOUT * FANOUT)
            ok = (i < size) & (j < size) & ((i < j) if level == 1 else (i <= j))
            stack.append((level - 1, i[ok], j[ok], known[of[ok]], acc[of[ok]]))

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Links from each fingerprint to its component's first one."""
        at = np.flatnonzero(self.label != np.arange(len(self.fp)))
        return self.fp[at], self.fp[self.label[at]]


def _links(distance: int):
    @trimmed
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by cell; whole cells are indexed together, as many as fit in _AT_ONCE rows."""
        held: list[pd.DataFrame] = []
        size = 0

        def done(pdf: pd.DataFrame) -> pd.DataFrame:
            _, number = np.unique(pdf["cell"].to_numpy(), return_inverse=True)
            index = GrayIndex(number, pdf["fp"].to_numpy().view(np.uint64))
            index.link(distance)
            a, b = index.forest()
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size < _AT_ONCE:
                continue
            pdf = pd.concat(held, ignore_index=True)
            cut = int(np.searchsorted(pdf["cell"].to_numpy(), pdf["cell"].iloc[-1]))  # the last cell may go on
            if cut:
                yield done(pdf[:cut])
            held, size = [pdf[cut:]], len(pdf) - cut
        if size:
            yield done(pd.concat(held, ignore_index=True))

    return run


def links(fps: DataFrame, distance: int = DISTANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Distinct fps (fp long) -> (a, b): links that connect exactly what links of at most `distance` bits connect."""
    spark, agree, n = fps.sparkSession, 1, fps.count()
    while n > MEAN_CELL << (64 * agree // (distance + agree)) and agree < 3:
        agree += 1
    parts, cells = distance + agree, []
    edges = [64 * i // parts for i in range(parts + 1)]
    block = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges[:-1], edges[1:])]
    for t, chosen in enumerate(combinations(range(parts), agree)):
        key, width = F.lit(t).cast("long"), 64 // parts + 1
        for c in chosen:
            key = F.shiftleft(key, width) + block[c]
        cells.append(key)
    rows = fps.select(F.explode(F.array(*cells)).alias("cell"), "fp")
    big = rows.groupBy("cell").count().where(F.col("count") > cell_rows)
    hot = [(r["cell"], -(-r["count"] // cell_rows)) for r in big.collect()]  # at most copies x fingerprints / cell_rows
    if hot:
        rows = _with_tiles(rows, spark.createDataFrame(hot, "cell long, ranges long"), distance)
    else:
        rows = rows.select(F.col("cell").cast("string").alias("cell"), "fp")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInPandas(_links(distance), "a long, b long")


def _gray(fp):
    r = fp
    for s in (1, 2, 4, 8, 16, 32):
        r = r.bitwiseXOR(F.shiftrightunsigned(r, s))
    return r


def _with_tiles(rows: DataFrame, hot: DataFrame, distance: int) -> DataFrame:
    """Rows of cells in hot get one copy for each pair of ranges of Gray rank that may hold links."""
    rows = rows.join(hot, "cell", "left")
    cold = rows.where("ranges is null").select(F.col("cell").cast("string").alias("cell"), "fp")
    # order of unsigned ranks: the sign bit is flipped
    mine = rows.where("ranges is not null").withColumn("rank", _gray(F.col("fp")).bitwiseXOR(F.lit(-(1 << 63)).cast("long")))
    m = max(2, hot.agg(F.max("ranges")).head()[0])
    cuts = mine.groupBy("cell").agg(F.percentile_approx("rank", [i / m for i in range(1, m)], max(1000, 4 * m)).alias("cuts"), F.first("ranges").alias("n"))
    cuts = cuts.withColumn("cuts", F.expr(f"transform(sequence(1L, n - 1), i -> element_at(cuts, cast(i * {m}L div n as int)))"))
    mine = written(mine.join(cuts, "cell").withColumn("range", F.expr("size(filter(cuts, c -> c < rank))")).select("cell", "range", "fp"), "ranges")
    nodes = mine.groupBy("cell", "range").agg(F.bit_and("fp").alias("ones"), F.bit_and(F.bitwise_not("fp")).alias("zeros"))
    left, right = nodes.toDF("cell", "i", "ones_i", "zeros_i"), nodes.toDF("cell", "j", "ones_j", "zeros_j")
    apart = F.expr("bit_count((ones_i & zeros_j) | (zeros_i & ones_j))")
    pairs = left.join(right, "cell").where((F.col("i") <= F.col("j")) & (apart <= distance)).select("cell", "i", "j")
    sides = pairs.select("cell", F.col("i").alias("range"), "i", "j").union(pairs.where("i <> j").select("cell", F.col("j").alias("range"), "i", "j"))
    tiles = mine.join(sides, ["cell", "range"]).select(F.concat_ws("/", "cell", "i", "j").alias("cell"), "fp")
    return cold.unionByName(tiles)


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text) -> (doc_id, row_key, fp, root, component_id): row_key tells rows apart, root names the component."""
    d = with_fingerprint(docs.select("doc_id", "text"), shingle=shingle)
    d = written(d.select("doc_id", row_key("doc_id", "text").alias("row_key"), "fp"), "fingerprints")
    fps = d.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(fps.select("fp"), distance))
    grouped = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # written, so that both sides of the join are exchanged for it and Spark can split the rows of a large component
    least = written(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    return d.join(grouped.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicate_documents(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, similarity: float = overlap.SIMILARITY, shingle: int = overlap.SHINGLE) -> DataFrame:
    """docs with one row of each group of near-copies (texts of Jaccard similarity of at least `similarity` are linked): that of the
    smallest doc_id (null last), then of the smallest row_key. Fingerprints of the same shingles bring close copies together without their pairs."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    rows, roots = overlap.near_copies(docs, similarity, shingle, links)
    least = rows.groupBy("node").agg(F.min(order).alias("o")).join(roots, "node", "left")
    first = least.groupBy(F.coalesce("root", "node")).agg(F.min("o").alias("o")).select(F.col("o.row_key").alias("_docloom_key"))
    kept = docs.withColumn("_docloom_key", row_key("doc_id", "text")).join(first, "_docloom_key", "left_semi")
    w = Window.partitionBy("_docloom_key").orderBy(F.xxhash64(*docs.columns))
    return kept.withColumn("_docloom_n", F.row_number().over(w)).where("_docloom_n = 1").drop("_docloom_n", "_docloom_key")
