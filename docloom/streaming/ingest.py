"""Incremental ingest (S3, S5, V2, K8): a stream of files or rows to semantic chunks, vectors and the index, one micro-batch after another.

A batch's vectors, its number, and the running totals are published together, by the manifest of one version of the index. So a stream that dies
before that leaves nothing of the batch, and one that dies after it finds the batch done when Spark hands it out again: every batch
counts once. The result is that of one run over all input, as ids depend on the content and the product alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, StructType

from docloom.operators.buckets import ConcurrentWrite
from docloom.operators.chunk import semantic_chunks
from docloom.operators.encode import Encoder
from docloom.operators.index import VectorIndex
from docloom.operators.tables import written
from docloom.plans.pipeline import vectors_of_chunks
from docloom.sources.files import HIERARCHICAL

TOTALS = ("batches", "products", "chunks", "vectors")


def hierarchical_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """S3 as a stream: JSON arrays of hierarchical chunks, one file for each product, as they come to be below path."""
    reader = spark.readStream.schema("value string").option("wholetext", True).option("recursiveFileLookup", True)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    rows = reader.format("text").load(path)
    return rows.select(F.posexplode(F.from_json("value", ArrayType(StructType.fromDDL(HIERARCHICAL)))).alias("chunk_no", "c")).select("chunk_no", "c.*")


def totals(index: VectorIndex, stream: str = "ingest") -> dict[str, int]:
    """K8: what the stream has put into the index so far."""
    told = index.manifest().get("told", {}) if index.exists() else {}
    return told.get(stream, dict.fromkeys(TOTALS, 0))


def take_in(batch: DataFrame, batch_id: int, index: VectorIndex, encoder: Encoder, to_chunks: Callable[[DataFrame], DataFrame], stream: str = "ingest", tries: int = 5) -> bool:
    """One batch into the index, at most once; False if it was there already. Another writer's version in between means that the merge is made again."""
    for attempt in range(tries):
        told = index.manifest().get("told", {}) if index.exists() else {}
        before = told.get(stream, dict.fromkeys(TOTALS, 0))
        if before.get("last", -1) >= batch_id:
            return False
        if attempt == 0:
            vectors = written(vectors_of_chunks(to_chunks(batch), encoder), "batch")
            n = vectors.agg(F.count("*").alias("chunks"), F.count_distinct("id").alias("vectors"), F.count_distinct("metadata.product_id").alias("products")).head()
        now = {"last": batch_id, "batches": before["batches"] + 1, **{k: before[k] + n[k] for k in TOTALS[1:]}}
        try:
            index.upsert(vectors, told=told | {stream: now})
            return True
        except ConcurrentWrite:
            continue
    raise ConcurrentWrite(f"other writers were faster {tries} times")


def ingest_stream(source: DataFrame, index: VectorIndex, encoder: Encoder, checkpoint: str, to_chunks: Callable[[DataFrame], DataFrame] = semantic_chunks, stream: str = "ingest", **trigger) -> StreamingQuery:
    """Starts the stream; `to_chunks` makes semantic chunks of a batch of the source. trigger as for `trigger`, all that is there and then the end if not given.

    A product's rows must come in one batch, as ordinals count them (a file of `hierarchical_files` is one). The name of the stream tells
    its batches apart from those of others that write to the index: a new checkpoint needs a new name."""
    write = source.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return write.foreachBatch(lambda batch, batch_id: take_in(batch, batch_id, index, encoder, to_chunks, stream) and None).start()
