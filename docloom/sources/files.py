"""Readers and writers of the pipeline's files (S1-S8, S12-S14, K1, K2, A11, D7) with declared schemas."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

GLYPHS = "product_id string, page int, glyph_no int, top double, fontname string, size double, text string"
HIERARCHICAL = """product_id string, web_help_guide_url string, page_start int, page_end int, topic_title string, topic_body string,
section_title string, section_body string, subheader_title string, subheader_body string, footnotes array<string>, hints array<string>, related_topics array<string>"""
SEMANTIC = """id string, content string, metadata struct<product_id:string,help_guide_url:string,page_start:int,page_end:int,topic_title:string,topic_body:string,
section_title:string,section_body:string,subheader_title:string,subheader_body:string,hints:array<string>,related_topics:array<string>,footnotes:array<string>,type:string,source:string>"""


def read_hierarchical(spark: SparkSession, paths: str) -> DataFrame:
    """JSON arrays of hierarchical chunks, one file for each product; chunk_no is the place in the file."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), F.posexplode(F.from_json("value", ArrayType(StructType.fromDDL(HIERARCHICAL)))).alias("chunk_no", "c"))
    return raw.select("chunk_no", "c.*")


def _write_lines(rows: DataFrame, folder: str) -> int:
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(folder)
    return seen.get["n"]


def write_hierarchical(chunks: DataFrame, folder: str) -> int:
    """K1: hierarchical chunks as lines of JSON in UTF-8, product and chunk_no in each, as an array for each product would put a
    product into one task; returns their number. Columns that chunks lacks are null when read."""
    known = {"chunk_no", *StructType.fromDDL(HIERARCHICAL).names}
    return _write_lines(chunks.select(*[c for c in chunks.columns if c in known]), folder)


def read_hierarchical_lines(spark: SparkSession, folder: str) -> DataFrame:
    """What write_hierarchical wrote; rows without chunk_no have null there."""
    return spark.read.schema(f"chunk_no int, {HIERARCHICAL}").json(folder)


def write_semantic(chunks: DataFrame, folder: str) -> int:
    """K2: the semantic chunks of all products as lines of JSON in UTF-8; returns their number."""
    return _write_lines(chunks.select("id", "content", "metadata"), folder)


def parsed_files(spark: SparkSession, paths: str) -> int:
    """Number of files under paths, found by the listing alone."""
    return len(spark.read.format("binaryFile").load(paths).inputFiles())


def settings(spark: SparkSession, required: tuple[str, ...] = (), **defaults: str) -> dict[str, str]:
    """Values by name: the session's spark.docloom.<name>, else the environment's DOCLOOM_<NAME>, else the default. A required
    name without a value is an error that lists all that lack one."""
    found = {n: spark.conf.get(f"spark.docloom.{n}", None) or os.environ.get(f"DOCLOOM_{n.upper()}") or defaults.get(n) for n in (*required, *defaults)}
    if lost := [n for n in required if not found[n]]:
        raise ValueError(f"no value for {', '.join(lost)}")
    return found


def read_semantic(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Semantic chunks of a JSON array, or of lines as write_semantic makes them; no chunk at all is an error."""
    out = spark.read.schema(SEMANTIC).option("multiLine", not lines).json(path)
    if out.isEmpty():
        raise ValueError(f"no chunks in {path}")
    return out


def read_url_map(lines: DataFrame, split_commas: bool = True) -> DataFrame:
    """(file, pos, value) lines to (model, url).

    Blank lines and those that start with instructions: or example go. A URL belongs to the line before it, if that is a model; its
    name loses what is in parentheses and all but the first of names split by / (and by comma if asked). Of repeats the last counts."""
    t = F.trim("value")
    low = F.lower(t)
    kept = lines.select("file", "pos", t.alias("line")).where((t != "") & ~low.startswith("instructions:") & ~low.startswith("example"))
    kept = kept.withColumn("before", F.lag("line").over(Window.partitionBy("file").orderBy("pos")))
    pairs = kept.where(F.col("line").startswith("http") & ~F.col("before").startswith("http"))
    name = F.trim(F.regexp_replace("before", r"\(.*?\)", ""))
    first = F.trim(F.split(name, "/")[0])
    if split_commas:
        first = F.when(name.contains("/"), first).otherwise(F.trim(F.split(name, ",")[0]))
    return pairs.select(first.alias("model"), "line", "file", "pos").groupBy("model").agg(F.max_by("line", F.struct("file", "pos")).alias("url"))


def url_map_file(spark: SparkSession, path: str, split_commas: bool = True) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "value"))
    return read_url_map(raw, split_commas)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """A YAML pipeline config to a row for each variant and version. Small by nature: one file, read whole."""
    import yaml

    text = spark.read.text(path, wholetext=True).head()[0]
    rows = []
    for variant, versions in (yaml.safe_load(text).get("variants") or yaml.safe_load(text)).items():
        for version, v in versions.items() if isinstance(versions, dict) else []:
            if isinstance(v, dict) and "parsers" in v:
                get = lambda part, *keys, v=v: tuple((v.get(part) or {}).get(k) for k in keys)
                parsers = [(p.get("name"), p.get("script"), p.get("description"), [str(a) for a in p.get("args") or []]) for p in v["parsers"]]
                rows.append((variant, str(version), parsers, get("chunker", "script", "output", "description"), get("embedder", "script", "index", "chunks_file", "description", "notes")))
    return spark.createDataFrame(rows, "variant string, version string, parsers array<struct<name:string,script:string,description:string,args:array<string>>>, chunker struct<script:string,output:string,description:string>, embedder struct<script:string,index:string,chunks_file:string,description:string,notes:string>")


def read_pdfs(spark: SparkSession, paths: str, decoder: Callable[[bytes], Iterator[tuple[int, int, float, str, float, str]]] | None = None) -> DataFrame:
    """All PDFs of a glob to glyphs; product_id is the file's name. decoder: bytes -> (page from 1, glyph_no, top, font, size, text);
    by default the optional package pdfplumber."""
    import pandas as pd

    def default(data: bytes):
        import io

        import pdfplumber

        with pdfplumber.open(io.BytesIO(data)) as pdf:
            for n, page in enumerate(pdf.pages, 1):
                for i, c in enumerate(page.chars):
                    yield n, i, round(c.get("top", 0), 1), c.get("fontname", ""), round(c.get("size", 0), 1), c.get("text", "")

    def run(batches):
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                rows = [(path.rsplit("/", 1)[-1].removesuffix(".pdf"), *g) for g in (decoder or default)(bytes(data))]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in GLYPHS.split(", ")])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, GLYPHS)
