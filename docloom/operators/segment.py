"""Typed lines to hierarchical chunks (P5-P10): the page's segmentation as windows over runs of lines.

A run is a header with the lines up to the next one; run 0 comes before the first header. Pages are independent, so one shuffle
by page serves all windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import collapse, strip
from docloom.operators.chunk import numbered

PAGE = ("product_id", "page")
HEADERS = ("topic", "section", "subheader")
ORPHAN = 20
TITLE = 50


def _texts(condition):
    """Texts of the lines where condition holds, in order."""
    return F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("line_no", "text")))), lambda x: x.text)


def page_segments(typed: DataFrame) -> DataFrame:
    """(product_id, page, line_no, text, line_type) -> hierarchical chunks; chunk_no is the place in the product, orphan marks text before any header."""
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    is_header = F.col("line_type").isin(*HEADERS)
    lines = typed.select(*PAGE, "line_no", "text", "line_type").withColumns({
        "run": F.sum(F.when(is_header, 1).otherwise(0)).over(w),
        "prev": F.last(F.when(F.col("line_type") != "body", F.col("line_type")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "hint_no": F.sum(F.when(F.col("line_type") == "hint", 1).otherwise(0)).over(w),
    })
    body = F.col("line_type") == "body"
    in_hint, in_related = body & F.coalesce(F.col("prev") == "hint", F.lit(False)), body & F.coalesce(F.col("prev") == "related", F.lit(False))
    plain = body & ~in_hint & ~in_related
    related = in_related & ~F.col("text").startswith("TP") & ~F.col("text").contains("Copyright")
    runs = lines.groupBy(*PAGE, "run").agg(
        F.max(F.when(is_header, F.col("line_type"))).alias("type"),
        F.max(F.when(is_header, F.col("text"))).alias("title"),
        _texts(plain).alias("body"),
        _texts(F.col("line_type") == "footnote").alias("footnotes"),
        F.array_sort(F.collect_list(F.when(in_hint, F.struct("hint_no", "line_no", "text")))).alias("hint_lines"),
        _texts(related).alias("related"),
    )
    hints = F.expr("transform(array_sort(array_distinct(transform(hint_lines, x -> x.hint_no))), h -> array_join(transform(filter(hint_lines, x -> x.hint_no = h), x -> x.text), ' '))")
    r = Window.partitionBy(*PAGE).orderBy("run")
    runs = runs.withColumn("hints", hints).withColumns({"next": F.lead("type").over(r), "seg": F.sum(F.when(F.col("type") == "topic", 1).otherwise(0)).over(r)})
    # run 0: the first body line long enough starts the orphan, later lines follow it
    orphan = F.expr(f"get(filter(transform(body, (t, i) -> struct(i, t)), x -> length(x.t) >= {ORPHAN}), 0)")
    runs = runs.withColumn("_o", F.when(F.col("run") == 0, orphan)).withColumn("_t", F.col("_o.t"))
    sentence = F.element_at(F.split("_t", r"\."), 1)
    title = F.when(F.length(sentence) > TITLE, F.concat(strip(F.substring(sentence, 1, TITLE)), F.lit("..."))).otherwise(strip(sentence))
    rest = F.when(F.col("_t").contains("."), F.substring("_t", F.length(sentence) + 1, F.length("_t"))).otherwise(F.lit(""))
    # an empty title (text that starts with a period) leaves the rule on short lines in force
    later = F.when(title == "", F.expr(f"filter(slice(body, _o.i + 2, size(body)), t -> length(t) >= {ORPHAN})")).otherwise(F.expr("slice(body, _o.i + 2, size(body))"))
    orphan_body = F.concat_ws(" ", F.when(rest != "", rest), later)
    runs = runs.withColumns({"_title": F.when(F.col("run") == 0, title).otherwise(F.col("title")), "_body": F.when(F.col("run") == 0, orphan_body).otherwise(F.array_join("body", " "))})
    topic, section = F.col("type") == "topic", F.col("type") == "section"
    seg = Window.partitionBy(*PAGE, "seg").orderBy("run")
    so_far = seg.rowsBetween(Window.unboundedPreceding, 0)
    whole = seg.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mine = F.struct(F.col("_title").alias("t"), F.col("_body").alias("b"))
    runs = runs.withColumns({
        "topic": F.last(F.when(topic, mine), ignorenulls=True).over(so_far),
        "section": F.last(F.when(section, mine), ignorenulls=True).over(so_far),
        "related_topics": F.flatten(F.collect_list("related").over(whole)),
    })
    nxt = F.col("next")
    emitted = (
        F.when(F.col("run") == 0, F.col("_o").isNotNull() & ((F.col("_title") != "") | nxt.isNull() | (nxt == "section")))
        .when(topic, nxt.isNull() | (nxt == "topic"))
        .when(section, nxt.isNull() | (nxt == "section") | ((nxt == "topic") & (F.col("seg") > 0)))
        .otherwise(F.lit(True))
    )
    lower = F.col("type").isNull() | (F.col("type") == "subheader")
    given = lambda c: F.coalesce(c, F.lit(""))
    return numbered(runs.where(emitted), "chunk_no", "product_id", "page", "run").select(
        "product_id", "chunk_no", F.col("page").alias("page_start"), F.col("page").alias("page_end"),
        given(F.col("topic.t")).alias("topic_title"), collapse(given(F.col("topic.b"))).alias("topic_body"),
        F.when(section | lower, given(F.col("section.t"))).otherwise("").alias("section_title"),
        F.when(section | lower, collapse(given(F.col("section.b")))).otherwise("").alias("section_body"),
        F.when(lower, F.col("_title")).otherwise("").alias("subheader_title"), F.when(lower, collapse(F.col("_body"))).otherwise("").alias("subheader_body"),
        "footnotes", "hints", "related_topics", (F.col("run") == 0).alias("orphan"),
    )
