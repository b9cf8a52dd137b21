"""Filtered exact cosine search (V4-V9, C12) and the engine with the seven tools."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.fixed import ALIASES, KNOWN_PRODUCTS
from docloom.operators import catalog
from docloom.operators.encode import HashingEncoder


def compile_filter(spec: dict | None, column=F.col) -> Column | None:
    """V5: equality dicts, {"$or": [...]}, {"$and": [...]} and None to a condition, so that equalities reach the scan."""
    if not spec:
        return None
    parts = []
    for key, value in spec.items():
        if key in ("$or", "$and"):
            inner = [c for c in (compile_filter(s, column) for s in value) if c is not None]
            if inner:
                parts.append(reduce((lambda a, b: a | b) if key == "$or" else (lambda a, b: a & b), inner))
        elif isinstance(value, dict):
            operand = value["$eq"] if "$eq" in value else value.get("$in")
            parts.append(column(key).isin(operand) if "$in" in value else column(key) == F.lit(operand))
        else:
            parts.append(column(key) == F.lit(value))
    return reduce(lambda a, b: a & b, parts) if parts else None


def dot(a: Column, b: Column) -> Column:
    """Sum of products as doubles, folded in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(index: DataFrame, query: Sequence[float], k: int = 10, where: Column | None = None, key: str = "id", vector: str = "embedding") -> DataFrame:
    """V4: the k most similar rows, ties by key: rank and score are added. Vectors are unit, so cosine is the dot product."""
    rows = index if where is None else index.where(where)
    literal = F.array(*[F.lit(float(x)) for x in query])
    best = rows.withColumn("score", dot(F.col(vector), literal)).orderBy(F.col("score").desc_nulls_last(), key).limit(k)
    # at most k rows
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc_nulls_last(), key)))


def resolve_alias(name: str, aliases: dict = ALIASES) -> str:
    """V6: by upper case, else as written, else unchanged."""
    return aliases.get(name.upper(), aliases.get(name, name))


def resolve_aliases(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """V6, J2 as a join: aliases (alias, target) on the upper-cased name."""
    a = aliases.select(F.col("alias").alias("_alias"), "target")
    return df.join(a, F.upper(column) == F.col("_alias"), "left").withColumn("resolved", F.coalesce("target", column)).drop("_alias", "target")


META = {"product_id": "", "help_guide_url": "", "page_start": 0, "page_end": 0, "topic_title": "", "section_title": "", "subheader_title": "", "hints": [], "related_topics": [], "footnotes": []}


def shaped(found: DataFrame) -> DataFrame:
    """Rank, id, score, content and ten metadata fields with defaults."""
    def given(name: str, default) -> Column:
        c = F.col(f"metadata.{name}")
        return F.coalesce(c, F.array().cast("array<string>") if default == [] else F.lit(default)).alias(name)

    return found.select("rank", "id", "score", F.coalesce("metadata.content", F.lit("")).alias("content"), F.struct(*[given(n, d) for n, d in META.items()]).alias("metadata"))


class SearchEngine:
    """The tools over an index of (id, embedding, metadata); every method returns a DataFrame, to_json makes an answer's envelope."""

    def __init__(self, index: DataFrame, encoder: HashingEncoder | None = None, aliases: dict = ALIASES, products: Sequence[str] = KNOWN_PRODUCTS):
        self.index, self.encoder, self.aliases, self.products = index, encoder or HashingEncoder(), aliases, products

    def search(self, query: str, top_k_: int = 10, where: dict | None = None) -> DataFrame:
        condition = compile_filter(where, lambda c: F.col(f"metadata.{c}"))
        return shaped(top_k(self.index, self.encoder.query(query), top_k_, condition))

    def search_product(self, product: str, query: str, top_k_: int = 10) -> DataFrame:
        return self.search(query, top_k_, {"product_id": resolve_alias(product, self.aliases)})

    def search_topic(self, title: str, query: str = "", product: str | None = None, top_k_: int = 10) -> DataFrame:
        """V8: by topic or section title; an empty query is the title."""
        either = {"$or": [{"topic_title": title}, {"section_title": title}]}
        where = {"$and": [{"product_id": resolve_alias(product, self.aliases)}, either]} if product else either
        return self.search(query or title, top_k_, where)

    def compare(self, first: str, second: str, query: str, top_k_: int = 5) -> DataFrame:
        """V9: two searches side by side."""
        one, two = (self.search_product(p, query, top_k_).withColumn("compared", F.lit(p)) for p in (first, second))
        return one.unionByName(two)

    def list_products(self, cap: int | None = None) -> DataFrame:
        spark = self.index.sparkSession
        known = spark.createDataFrame([(i, p) for i, p in enumerate(self.products)], "place int, product_id string")
        return catalog.entity_counts(known, self.index.select("metadata.product_id"), "product_id", cap).orderBy("place").drop("place")

    def list_topics(self, product: str | None = None, cap: int | None = None) -> DataFrame:
        return catalog.topics(self.index.select("metadata.*"), product, cap)

    def stats(self) -> DataFrame:
        return catalog.stats(self.index, self.list_products())

    @staticmethod
    def to_json(df: DataFrame, **envelope: str | int) -> DataFrame:
        """One row, column json: results in rank order inside an envelope with a time stamp. Results of a search are at most top_k rows."""
        order = "rank" if "rank" in df.columns else df.columns[0]
        rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), *[F.col(c) for c in df.columns])))
        kept = F.transform(rows, lambda x: F.struct(*[x[c].alias(c) for c in df.columns]))
        extra = [F.lit(v).alias(k) for k, v in envelope.items()]
        return df.agg(kept.alias("results")).select(F.to_json(F.struct("results", F.size("results").alias("total_results"), *extra, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))).alias("json"))
