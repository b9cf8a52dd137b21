"""The parser's quality gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.fixed import FILE_MAXIMUM, MODE_DIAL
from docloom.functions.text import blank_to_null, strip

SAMPLE = 10


def _flagged(chunks: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    kinds = ("subheader", "section", "topic")
    titled = blank_to_null(F.concat(*[text(f"{k}_title") for k in kinds])).isNotNull()
    bodied = F.lit(False)
    for k in kinds:
        bodied = bodied | (strip(text(f"{k}_body")) != "")
    first = strip(F.coalesce(*[blank_to_null(text(f"{k}_body")) for k in kinds], F.lit("")))
    return chunks.withColumns({"incomplete": titled & ~bodied, "empty": ~titled & ~bodied, "body_length": F.when(first != "", F.length(first))})


def quality_metrics(chunks: DataFrame, incomplete_below: float = 5.0, empty_below: float = 1.0) -> DataFrame:
    """A4: one row. Pages count once each, over starts and whole ranges; chunks without a start count as one page."""
    f = _flagged(chunks)
    has = lambda phrases: F.expr(" or ".join(f"contains(coalesce(subheader_title, ''), '{p}')" for p in phrases)).cast("long")
    m = f.agg(
        F.count("*").alias("total_chunks"), F.coalesce(F.sum(F.col("incomplete").cast("long")), F.lit(0)).alias("incomplete_chunks"),
        F.coalesce(F.sum(F.col("empty").cast("long")), F.lit(0)).alias("empty_chunks"), F.coalesce(F.avg("body_length"), F.lit(0.0)).alias("avg_body_length"),
        F.coalesce(F.sum(has(FILE_MAXIMUM)), F.lit(0)).alias("file_maximum_artifacts"), F.coalesce(F.sum(has(MODE_DIAL)), F.lit(0)).alias("mode_dial_artifacts"),
    )
    every = F.when(F.col("page_start").isNull() | F.col("page_end").isNull() | (F.col("page_end") < F.col("page_start")), F.array("page_start")).otherwise(F.sequence("page_start", "page_end"))
    pages = f.select(F.explode(every).alias("page")).agg((F.count_distinct("page") + F.max(F.when(F.col("page").isNull(), 1).otherwise(0))).alias("page_coverage"))
    share = lambda n: F.when(F.col("total_chunks") > 0, F.col(n) / F.col("total_chunks") * 100).otherwise(0.0)
    m = m.crossJoin(pages).withColumns({"incomplete_percentage": share("incomplete_chunks"), "empty_percentage": share("empty_chunks"), "page_coverage": F.coalesce("page_coverage", F.lit(0)).cast("long")})
    return m.withColumn("quality_pass", (F.col("incomplete_percentage") < incomplete_below) & (F.col("empty_percentage") < empty_below))


def first_samples(chunks: DataFrame, kind: str, index: str = "chunk_no", n: int = SAMPLE) -> DataFrame:
    """The first n incomplete or empty chunks by product and page, where there are such columns, and index; a top-k, so no global sort."""
    order = [c for c in ("product_id", "page_start") if c in chunks.columns]
    return _flagged(chunks).where(F.col(kind)).orderBy(*order, index).limit(n)


def random_sample(chunks: DataFrame, n: int = 20, seed: int = 0, index: str = "chunk_no") -> DataFrame:
    """N rows at random (all if there are fewer), in the order of index."""
    return chunks.orderBy(F.xxhash64(F.lit(seed), *chunks.columns), index).limit(n).orderBy(index)


def report(chunks: DataFrame, n: int = 20, seed: int = 0) -> DataFrame:
    """K9: metrics and samples in one row, ready for write.json."""
    sample = random_sample(chunks, n, seed).select("chunk_no", F.substring("subheader_body", 1, 200).alias("preview"))
    rows = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    out = quality_metrics(chunks).crossJoin(rows(sample, "sample_chunks"))
    for kind in ("incomplete", "empty"):
        out = out.crossJoin(rows(first_samples(chunks, kind).select("chunk_no", F.col("page_start").alias("page"), "topic_title"), f"sample_{kind}"))
    return out


def passes(chunks: DataFrame) -> bool:
    """K10"""
    return bool(quality_metrics(chunks).head()["quality_pass"])


