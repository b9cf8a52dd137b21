"""Operator 9: a uniform shuffle into shards of exact size through a hypergeometric communication matrix.

Rows are dealt to blocks by a hash; how many rows of each block go to each shard is drawn exactly, on the driver, from the
multivariate hypergeometric law (only the blocks' counts go there, at most MAX_BLOCKS numbers). Each block is permuted and cut at
its drawn counts, the rows are exchanged, and each shard is permuted again. The result is that of one uniform permutation cut
into shards whose counts differ by at most one.

Blocks come from hashes of the rows' content and not from the files' splits, so a lost executor's tasks give the same rows again.

Defined results: a null text has size 1 and crc 0; null ids are hashed like any value; repeated rows are placed one by one, and
as they are equal, any order of theirs is the same result; an empty table gives no rows. Fewer rows than shards leave shards empty.
Further columns are carried along; columns named like one of the results are replaced by it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import written

BLOCK_ROWS = 2048
MAX_BLOCKS = 20_000
#: numpy draws from populations below this only; larger ones are first split into groups of blocks.
_DRAWABLE = 5 * 10**8


def split_counts(left: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of n rows drawn without replacement belong to each shard, if left[s] rows of shard s remain."""
    if left.sum() < 10**9:
        return rng.multivariate_hypergeometric(left, n, method="marginals")
    out, rest = np.zeros_like(left), int(left.sum())
    for s, good in enumerate(left):
        rest -= int(good)
        out[s] = _hypergeometric(int(good), rest, n, rng)
        n -= int(out[s])
    return out


def _hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """A draw for populations that numpy declines: inversion from the mode outwards by the ratio of neighbouring terms."""
    from math import exp, lgamma

    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    log_choose = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
    k = min(hi, max(lo, (n + 1) * (good + 1) // (good + bad + 2)))
    p = exp(log_choose(good, k) + log_choose(bad, n - k) - log_choose(good + bad, n))
    up, down, p_up, p_down, u = k, k, p, p, rng.random() - p
    while u > 0 and (up < hi or down > lo):
        if up < hi:
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > lo:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return k


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """counts of blocks x shards: exact row sums are the blocks' counts, exact column sums the shards' sizes (at most one apart)."""
    rng, total = np.random.default_rng(seed), int(sum(counts))
    sizes = np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)
    out = np.zeros((len(counts), shards), dtype=np.int64)
    groups, start = [], 0
    for i in range(len(counts) + 1):
        if i == len(counts) or (i > start and sum(counts[start : i + 1]) > _DRAWABLE):
            groups.append((start, i))
            start = i
    for lo, hi in groups if counts else []:
        mine = split_counts(sizes, int(sum(counts[lo:hi])), rng)
        sizes = sizes - mine
        for b in range(lo, hi):
            out[b] = split_counts(mine, int(counts[b]), rng)
            mine = mine - out[b]
    return out


def uniform_shards(df: DataFrame, by: list[Column], shards: int = 16, seed: int = 9) -> DataFrame:
    """df with shard int and slot long (gapless from 0 in each shard). by: what tells rows apart; equal rows are interchangeable."""
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    n_blocks = int(min(MAX_BLOCKS, max(1, -(-df.count() // BLOCK_ROWS))))
    keyed = df.withColumns({"_docloom_k1": F.xxhash64(F.lit(f"deal{seed}"), *by), "_docloom_k2": F.xxhash64(F.lit(f"local{seed}"), *by), "_docloom_k3": F.xxhash64(F.lit(f"again{seed}"), *by)}).withColumn("_docloom_block", F.pmod("_docloom_k1", F.lit(n_blocks)).cast("int"))
    counts = [0] * n_blocks
    for r in keyed.groupBy("_docloom_block").count().collect():
        counts[r["_docloom_block"]] = r["count"]
    cuts = np.cumsum(communication_matrix(counts, shards, seed), axis=1)
    table = spark.createDataFrame([(b, [int(x) for x in c]) for b, c in enumerate(cuts)], "_docloom_block int, _docloom_cuts array<bigint>")
    rank = F.row_number().over(Window.partitionBy("_docloom_block").orderBy("_docloom_k2", "_docloom_k1", "_docloom_k3"))
    dealt = keyed.withColumn("_docloom_rank", rank).join(table, "_docloom_block").withColumn("shard", F.expr("cast(size(filter(_docloom_cuts, c -> c < _docloom_rank)) as int)"))
    dealt = written(dealt.withColumn("_docloom_part", F.pmod(F.shiftrightunsigned("_docloom_k3", 40), F.lit(n_blocks)).cast("int")).drop("_docloom_cuts", "_docloom_rank", "_docloom_block"), "dealt")
    sums = dealt.groupBy("shard", "_docloom_part").agg(F.count("*").alias("_docloom_n"))
    before = sums.withColumn("_docloom_before", F.sum("_docloom_n").over(Window.partitionBy("shard").orderBy("_docloom_part")) - F.col("_docloom_n")).drop("_docloom_n")
    place = F.row_number().over(Window.partitionBy("shard", "_docloom_part").orderBy("_docloom_k3", "_docloom_k2", "_docloom_k1"))
    return dealt.withColumn("_docloom_place", place).join(before, ["shard", "_docloom_part"]).withColumn("slot", F.col("_docloom_before") + F.col("_docloom_place") - 1).drop("_docloom_k1", "_docloom_k2", "_docloom_k3", "_docloom_part", "_docloom_place", "_docloom_before")


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 9) -> DataFrame:
    """Documents with size, text_crc32, law, shard, slot and grown_shard; all columns of docs are kept."""
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumns({"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text)})
    out = uniform_shards(out, [F.col("doc_id"), F.col("size"), F.col("text_crc32")], shards, seed)
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def shard_plan(docs: DataFrame, shards: int = 16, seed: int = 9) -> DataFrame:
    """The same places without the texts: only ids, sizes and checksums are exchanged."""
    text = F.coalesce("text", F.lit(""))
    thin = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    placed = uniform_shards(thin, [F.col("doc_id"), F.col("size"), F.col("text_crc32")], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
