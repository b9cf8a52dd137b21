"""Listings and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import blank_to_null, strip


def entity_counts(known: DataFrame, rows: DataFrame, key: str, cap: int | None = None) -> DataFrame:
    """A1: every known entity with its number of rows, 0 without any; cap mimics a capped scan."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0)).cast("long")
    return known.join(counts, key, "left").withColumn("chunk_count", n if cap is None else F.least(n, F.lit(cap).cast("long"))).drop("_n")


def topics(meta: DataFrame, product: str | None = None, cap: int | None = None) -> DataFrame:
    """A2: distinct topic titles in order; an empty one gives way to the section's, a blank one does not, and vanishes."""
    rows = meta if product is None else meta.where(F.col("product_id") == product)
    rows = rows if cap is None else rows.limit(cap)
    title = strip(F.coalesce(blank_to_null(F.col("topic_title")), F.col("section_title")))
    return rows.select(title.alias("topic")).where("topic <> ''").distinct().orderBy("topic")


def stats(index: DataFrame, per_entity: DataFrame) -> DataFrame:
    """A3: one row with totals, dimension and a map of entity to count. per_entity has a row for each known entity."""
    pairs = per_entity.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("product_id", "chunk_count")))).alias("chunks_per_product"), F.count("*").alias("total_products"))
    return index.agg(F.count("*").alias("total_chunks"), F.max(F.size("embedding")).alias("dimension")).crossJoin(pairs)


def listing_with_flag(known: DataFrame, urls: DataFrame) -> DataFrame:
    """Known entities in order, and whether their URL is known."""
    return known.join(urls.select("model", "url").dropDuplicates(["model"]), "model", "left").select("model", F.col("url").isNotNull().alias("has_url")).orderBy("model")


def known_only(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the known ones, each once however often it is known; a null key is not."""
    return rows.join(known.select(key), key, "left_semi")
