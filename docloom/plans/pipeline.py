"""Documents to answers in one lazy plan: lines, segments, semantic chunks, vectors, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.chunk import semantic_chunks
from docloom.operators.encode import HashingEncoder, encode
from docloom.operators.index import VectorIndex, vector_records
from docloom.operators.lines import font_lines, typed_lines
from docloom.operators.segment import page_segments


def chunks_of_glyphs(glyphs: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """Decoded pages to semantic chunks: one shuffle by (product, page), one by product."""
    return semantic_chunks(page_segments(typed_lines(font_lines(glyphs))), urls)


def vectors_of_chunks(chunks: DataFrame, encoder: HashingEncoder) -> DataFrame:
    return vector_records(encode(chunks, encoder))


def embed_chunks(chunks: DataFrame, encoder: HashingEncoder, index: VectorIndex, by: list[str] | None = None) -> int:
    """V2: semantic chunks encoded, projected and merged into the index by id; returns the vectors it holds then.

    Batches are Spark's Arrow batches, and no pause lies between them: the index is a table, not a service that limits its callers."""
    index.upsert(vectors_of_chunks(chunks, encoder), by)
    return index.stats().head()["total_vectors"]


def lines_of_documents(docs: DataFrame, lines_per_page: int = 30) -> DataFrame:
    """Plain documents as font lines: each line of text gets a font by its place, so that all line types occur."""
    d = docs.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("product_id"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    text = F.when(F.col("pos") % 13 == 4, "Hint").when(F.col("pos") % 17 == 6, "Related Topic").when(F.col("pos") % 19 == 8, "TP12").otherwise(F.col("raw"))
    bold = (F.col("pos") % 11 == 0) | (F.col("pos") % 5 == 0) | (F.col("pos") % 3 == 0)
    size = F.when(F.col("pos") % 11 == 0, 12.7).when(F.col("pos") % 5 == 0, 10.2).when(F.col("pos") % 3 == 0, 9.2).when(F.col("pos") % 7 == 0, 8.0).otherwise(9.7)
    return d.select("product_id", F.floor(F.col("pos") / lines_per_page).cast("int").alias("page"), F.col("pos").alias("line_no"), text.alias("text"), F.when(bold, "Face-Bold").otherwise("Face-Regular").alias("font"), size.alias("size"), (F.col("pos") * 10.0).alias("y0"))
