"""The vector index as a Parquet table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from docloom.functions.text import blank_to_null, strip
from docloom.operators.buckets import BucketedTable, parts


def admitted(items: Column) -> Column:
    """K4: a list without nulls and empty strings; null if nothing is left."""
    kept = F.filter(items, lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) > 0, kept)


def vector_records(chunks: DataFrame) -> DataFrame:
    """Semantic chunks with embedding -> (id, embedding, metadata), content inside the metadata."""
    lists = ("hints", "related_topics", "footnotes")
    names = chunks.schema["metadata"].dataType.names
    meta = [admitted(F.col(f"metadata.{n}")).alias(n) if n in lists else F.col(f"metadata.{n}").alias(n) for n in names]
    return chunks.select("id", "embedding", F.struct(*meta, F.col("content").alias("content")).alias("metadata"))


def latest(new: DataFrame, by: list[str], *key: str) -> DataFrame:
    """Of rows with one key the last by `by`."""
    w = Window.partitionBy(*(key or ("id",))).orderBy(*[F.col(c).desc() for c in by])
    return new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _settled(new: DataFrame, key: str, by: list[str] | None) -> DataFrame:
    if by:
        return latest(new, by, key)
    return latest(new.withColumn("_hash", F.xxhash64(*new.columns)), ["_hash"], key).drop("_hash")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", by: list[str] | None = None) -> DataFrame:
    """K3: rows of new replace those of old with the same key; others are added. by orders repeats in new, the last one counts; without it the one of
    greatest hash of the row counts, so reruns agree."""
    new = _settled(new, key, by).select(old.columns)
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(new)


class VectorIndex(BucketedTable):
    """The vectors by id; an upsert rewrites the hash buckets that its ids fall into, and readers keep the version that they opened (docloom.operators.buckets)."""

    def upsert(self, new: DataFrame, by: list[str] | None = None, told: dict | None = None) -> dict:
        """K3: settles repeats in new as `upsert` does and merges it in; returns the manifest of the new version."""
        settled = _settled(new, self.key, by)
        return self.merge(settled, told=told) if self.exists() else self.replace(settled, told=told)

    def delete(self, ids: DataFrame) -> dict:
        """Rows with an id of ids (id) go; only their buckets are rewritten."""
        return self.merge(gone=ids.select(self.key).distinct())

    def clear(self, confirm: bool = False, namespace: str | None = None) -> int:
        """K5: empties the index, or one namespace; returns the vectors left. Nothing happens on an empty index."""
        rows = self.read()
        if rows.isEmpty():
            return 0
        if not confirm:
            raise ValueError("clearing an index needs confirm=True")
        left = rows.where(~F.col("namespace").eqNullSafe(namespace)) if namespace is not None else rows.limit(0)
        self.replace(left)
        return self.read().count()

    def stats(self) -> DataFrame:
        return index_stats(self.read())


class CataloguedIndex(VectorIndex):
    """An index that knows its catalogue (A1-A4): each bucket has the counts of its rows by product, topic and page beside it, written with it.

    A write makes these anew for the buckets that it touches, so rows that it replaces or deletes are taken out without a record of them, and a
    listing adds up small rows and reads no vector. Counts add up, and distinct topics and pages are the keys; metadata has product_id, topic_title, section_title, page_start and page_end."""

    def _write(self, rows: DataFrame, n: int) -> tuple[str, set[str], int]:
        name, made, size = super()._write(rows, n)
        if not made:
            return name, made, size
        own = self.spark.read.schema(StructType([*rows.schema.fields, StructField("_bucket", IntegerType())])).parquet(f"{self.path}/data/{name}")
        title = strip(F.coalesce(blank_to_null(F.col("metadata.topic_title")), F.col("metadata.section_title")))
        first, last = F.col("metadata.page_start"), F.col("metadata.page_end")
        pages = F.when(first.isNull() | last.isNull() | (last < first), F.array(first)).otherwise(F.sequence(first, last))
        by = own.select("_bucket", F.col("metadata.product_id").alias("product_id"), title.alias("topic"), pages.alias("pages"))
        counts = by.groupBy("_bucket", "product_id", "topic").agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("pages")))).alias("pages"))
        counts.write.partitionBy("_bucket").parquet(f"{self.path}/catalogue/{name}")
        return name, made, size + self.files.size(f"{self.path}/catalogue/{name}")

    def partials(self, version: int | None = None) -> DataFrame:
        """product_id, topic, n, pages: a row for each folder of a bucket, product and topic."""
        m = self.manifest(version)
        paths = [f"{self.path}/catalogue/{f}/_bucket={b}" for b, f in parts(m["folders"])]
        schema = "product_id string, topic string, n bigint, pages array<int>"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def entity_counts(self, known: DataFrame) -> DataFrame:
        """A1: known (product_id, ...) with the number of its rows, 0 without any."""
        counts = self.partials().groupBy("product_id").agg(F.sum("n").alias("chunk_count"))
        return known.join(counts, "product_id", "left").fillna(0, ["chunk_count"])

    def topics(self, product: str | None = None) -> DataFrame:
        """A2: distinct topics in order."""
        rows = self.partials()
        return (rows if product is None else rows.where(F.col("product_id") == product)).select("topic").where("topic <> ''").distinct().orderBy("topic")

    def coverage(self) -> DataFrame:
        """A3, A4: rows, products and distinct pages (a missing start counts as one page) of the whole index, one row."""
        rows = self.partials()
        pages = rows.select(F.explode("pages").alias("page")).agg((F.count_distinct("page") + F.coalesce(F.max(F.col("page").isNull().cast("int")), F.lit(0))).alias("page_coverage"))
        return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_chunks"), F.count_distinct("product_id").alias("total_products")).crossJoin(pages)

    def vacuum(self, keep: int = 1) -> int:
        gone = super().vacuum(keep)
        named = set(self.files.names(f"{self.path}/data"))
        for f in self.files.names(f"{self.path}/catalogue"):
            if f not in named:
                self.files.delete(f"{self.path}/catalogue/{f}")
        return gone


def index_stats(index: DataFrame) -> DataFrame:
    """Number of vectors and their dimension."""
    return index.agg(F.count("*").alias("total_vectors"), F.max(F.size("embedding")).alias("dimension"))
