"""Hierarchical chunks to semantic chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import blank_to_null, chunk_id, is_quality, strip

CHUNK_TOKENS = 500
OVERLAP_TOKENS = 100


def context() -> Column:
    """C4: breadcrumb, bodies, hints, related topics and notes, the non-empty ones with a blank line between."""
    def lines(prefix: str, items: str) -> Column:
        return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit(prefix), x)), "\n"))

    crumb = F.concat_ws(" > ", *[blank_to_null(F.col(c)) for c in ("topic_title", "section_title", "subheader_title")])
    bodies = F.concat_ws("\n\n", *[blank_to_null(strip(F.col(c))) for c in ("topic_body", "section_body", "subheader_body")])
    related = F.when(F.size("related_topics") > 0, F.concat(F.lit("Related Topics: "), F.array_join("related_topics", ", ")))
    return F.concat_ws("\n\n", blank_to_null(crumb), blank_to_null(bodies), lines("Hint: ", "hints"), related, lines("Note: ", "footnotes"))


def pack(paragraphs: str, limit: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> Column:
    """Paragraphs (SQL expression of an array) packed in order into pieces of at most limit tokens, as array<array<string>>.

    A piece that the next paragraph would take over the limit is closed; its last paragraph starts the next piece too if it has fewer than
    overlap tokens. A paragraph over the limit is never split. Folded inside the row, so no shuffle."""
    zero = "named_struct('out', cast(array() as array<array<string>>), 'cur', cast(array() as array<string>), 'tok', 0)"
    tok = "cast(length(p) div 4 as int)"
    carry = f"(cast(length(element_at(s.cur, -1)) div 4 as int) < {overlap})"
    step = f"""case when s.tok + {tok} > {limit} and size(s.cur) > 0 then named_struct(
        'out', concat(s.out, array(s.cur)),
        'cur', case when {carry} then array(element_at(s.cur, -1), p) else array(p) end,
        'tok', cast(case when {carry} then cast(length(element_at(s.cur, -1)) div 4 as int) + {tok} else {tok} end as int))
      else named_struct('out', s.out, 'cur', concat(s.cur, array(p)), 'tok', cast(s.tok + {tok} as int)) end"""
    return F.expr(f"aggregate({paragraphs}, {zero}, (s, p) -> {step}, s -> case when size(s.cur) > 0 then concat(s.out, array(s.cur)) else s.out end)")


def split_text(text: str, separator: str = "\n\n", limit: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> Column:
    """Texts (column name) that fit stay whole; others are packed by paragraphs. array<string>."""
    quoted = separator.replace("\n", "\\n")
    parts = F.transform(pack(f"split({text}, '{quoted}')", limit, overlap), lambda x: F.array_join(x, separator))
    return F.when(F.floor(F.length(text) / 4) <= limit, F.array(F.col(text))).otherwise(parts)


def numbered(rows: DataFrame, into: str, product: str, page: str, *order: str) -> DataFrame:
    """rows with their place in the product from 0, by page and order. A page's rows are numbered on their own, and pages begin where the counts of those before end: what is
    windowed by product alone is a number for each page, so a product that holds a third of all rows is dealt out by page."""
    count = rows.groupBy(product, page).agg(F.count("*").alias("_rows"))
    start = F.sum("_rows").over(Window.partitionBy(product).orderBy(page).rowsBetween(Window.unboundedPreceding, -1))
    count = count.select(F.col(product).alias("_product"), F.col(page).alias("_page"), F.coalesce(start, F.lit(0)).alias("_start"))
    inside = rows.withColumn("_inside", F.row_number().over(Window.partitionBy(product, page).orderBy(*order)))
    placed = inside.join(count, F.expr(f"{product} <=> _product and {page} <=> _page"))
    return placed.withColumn(into, (F.col("_start") + F.col("_inside") - 1).cast("int")).drop("_product", "_page", "_start", "_inside")


def with_ordinal(hier: DataFrame) -> DataFrame:
    """Place of each hierarchical chunk in its product's file, rejected ones counted."""
    return numbered(hier, "ordinal", "product_id", "page_start", "chunk_no")


def semantic_chunks(hier: DataFrame, urls: DataFrame | None = None, product: str | None = None, limit: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """(id, content, metadata) of the good chunks. urls (model, url) fills empty URLs; product restricts to one."""
    d = hier if product is None else hier.where(F.col("product_id") == product)
    d = with_ordinal(d).withColumn("content", context()).where(is_quality(F.col("content")))
    own = blank_to_null(F.col("web_help_guide_url")) if "web_help_guide_url" in hier.columns else F.lit(None)
    if urls is None:
        d = d.withColumn("help_guide_url", F.coalesce(own, F.lit("")))
    else:
        d = d.join(urls.select(F.col("model").alias("product_id"), "url"), "product_id", "left").withColumn("help_guide_url", F.coalesce(own, "url", F.lit("")))
    d = d.select("*", F.posexplode(split_text("content", limit=limit, overlap=overlap)).alias("part", "piece"))
    names = ("product_id", "help_guide_url", "page_start", "page_end", "topic_title", "topic_body", "section_title", "section_body", "subheader_title", "subheader_body", "hints", "related_topics", "footnotes")
    meta = F.struct(*names, F.lit("help_guide").alias("type"), F.lit("camera_help_guide_pdf").alias("source"))
    return d.select(chunk_id(F.col("product_id"), F.col("page_start"), F.col("ordinal") + F.col("part"), F.col("piece")).alias("id"), F.col("piece").alias("content"), meta.alias("metadata"))


def counters(hier: DataFrame) -> DataFrame:
    """Products, chunks made and chunks skipped of a run."""
    good = is_quality(context())
    return hier.agg(F.count_distinct("product_id").alias("products"), F.sum(good.cast("long")).alias("kept"), F.sum((~good).cast("long")).alias("skipped"))
