"""Glyphs to typed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.fixed import IGNORED_CONTAINS, IGNORED_EQUAL, IGNORED_START
from docloom.functions.text import strip, threshold

PAGE = ("product_id", "page")


def font_lines(glyphs: DataFrame) -> DataFrame:
    """Glyphs (product_id, page, glyph_no, top, fontname, size, text) to lines.

    A line is the glyphs of a page with equal top, rounded to a tenth; its text is theirs in stream order, its font the most
    frequent one (the first seen of equals). Blank lines go. tops and sizes that a decoder rounded already stay as they are."""
    g = glyphs.select(
        *PAGE, "glyph_no", F.round(F.coalesce("top", F.lit(0.0)), 1).alias("y0"), F.coalesce("fontname", F.lit("")).alias("font"),
        F.round(F.coalesce("size", F.lit(0.0)), 1).alias("size"), F.coalesce("text", F.lit("")).alias("text"),
    )
    # pages are dealt out once: fonts of a line, lines and their numbers all stay within a page
    fonts = g.repartition(*PAGE).groupBy(*PAGE, "y0", "font", "size").agg(F.count("*").alias("n"), F.min("glyph_no").alias("first"), F.collect_list(F.struct("glyph_no", "text")).alias("g"))
    most = F.max_by(F.struct("font", "size"), F.struct("n", -F.col("first")))
    line = fonts.groupBy(*PAGE, "y0").agg(most.alias("f"), F.array_sort(F.flatten(F.collect_list("g"))).alias("g"))
    line = line.select(*PAGE, "y0", "f", F.array_join(F.transform("g", lambda x: x.text), "").alias("text"))
    line = line.withColumn("text", strip(F.col("text"))).where(F.col("text") != "")
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0")) - 1
    return line.select(*PAGE, number.cast("int").alias("line_no"), "text", F.col("f.font").alias("font"), F.col("f.size").alias("size"), "y0")


def line_type(text: Column, font: Column, size: Column, model: Column) -> Column:
    """The first rule that holds decides."""
    base = F.trim(F.split(F.split(model, "/")[0], ",")[0])
    at_least = lambda kind: size >= threshold(model, kind)
    bold = font.rlike("(?i)bold|black")
    ignored = text.rlike(r"^(?U)\d+$") | (text == model) | (text.contains(base) & (F.length(text) < 30)) | text.rlike(r"^TP\d+$")
    for phrase in IGNORED_EQUAL:
        ignored = ignored | (text == phrase)
    for phrase in IGNORED_START:
        ignored = ignored | text.startswith(phrase)
    for phrase in IGNORED_CONTAINS:
        ignored = ignored | text.contains(phrase)
    return (
        F.when(ignored, "ignore")
        .when(text == "Hint", "hint")
        .when(text == "Related Topic", "related")
        .when((size < threshold(model, "footnote")) | text.startswith("*"), "footnote")
        .when(bold & at_least("topic"), "topic")
        .when(bold & at_least("section"), "section")
        .when(bold & at_least("subheader"), "subheader")
        .otherwise("body")
    )


def typed_lines(lines: DataFrame, model: str = "product_id") -> DataFrame:
    return lines.withColumn("line_type", line_type(F.col("text"), F.col("font"), F.col("size"), F.col(model)))
