"""Crawling as rounds over a frontier table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import base_url, url_filename
from docloom.operators.html import parse_pages
from docloom.operators.index import latest


def join_urls(df: DataFrame, base: str, link: str, into: str = "url") -> DataFrame:
    """U6"""

    def run(bases: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([urljoin(b, u) if b is not None and u is not None else None for b, u in zip(bases, urls)])

    return df.withColumn(into, F.pandas_udf(run, "string")(F.col(base), F.col(link)))


def discover(models: DataFrame, known: DataFrame) -> DataFrame:
    """U8: the known URL of each model, null if there is none."""
    return models.join(known.select("model", "url"), "model", "left")


def next_frontier(pages: DataFrame, visited: DataFrame) -> DataFrame:
    """Links of pages (base, internal_links) under their base that were not visited."""
    links = join_urls(pages.select("base", F.explode("internal_links").alias("link")), "base", "link").where(F.col("url").startswith(F.col("base")))
    return links.select("base", "url").dropDuplicates(["url"]).join(visited.select("url"), "url", "left_anti").select("base", "url")


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], folder: str, most_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth first from seeds (url) until no link is new. fetch: (url) -> (url, html), html null on failure.

    Each round is written below folder, so rounds already done survive a lost executor. Links are resolved against the
    base of their seed and stay below it; a URL is fetched once in a run, whichever seed it belongs to. Returns (pages, visited).
    With most_rounds given, links left after so many rounds raise an error; the rounds done stay below folder."""
    spark = seeds.sparkSession
    frontier = seeds.select(base_url(F.col("url")).alias("base"), "url").dropDuplicates(["url"])
    none = spark.createDataFrame([], "base string, url string, ok boolean")
    visited, n = none, 0
    while not frontier.isEmpty():
        if n == most_rounds:
            raise RuntimeError(f"links left after {n} rounds, see {folder}/frontier")
        got = fetch(frontier.select("url"))
        parsed = parse_pages(got.where("html is not null"))
        parsed.join(frontier, "url").write.mode("overwrite").parquet(f"{folder}/pages/round={n}")
        pages = spark.read.parquet(f"{folder}/pages/round={n}")
        frontier.join(pages.select("url", F.lit(True).alias("ok")), "url", "left").select("base", "url", F.coalesce("ok", F.lit(False)).alias("ok")).write.mode("overwrite").parquet(f"{folder}/visited/round={n}")
        visited = spark.read.parquet(f"{folder}/visited").select("base", "url", "ok")
        next_frontier(pages, visited).write.mode("overwrite").parquet(f"{folder}/frontier/round={n}")
        frontier = spark.read.parquet(f"{folder}/frontier/round={n}")
        n += 1
    if n == 0:
        return parse_pages(spark.createDataFrame([], "url string, html string")), visited
    return spark.read.parquet(f"{folder}/pages").drop("round"), visited


def scrape_summary(pages: DataFrame, visited: DataFrame) -> DataFrame:
    """Per base pages scraped and failed, and bytes of the pages as JSON."""
    size = pages.withColumn("_json", F.to_json(F.struct(*[c for c in pages.columns if c != "base"]))).groupBy("base").agg(F.sum(F.length("_json")).alias("total_size_bytes"))
    n = visited.groupBy("base").agg(F.sum(F.col("ok").cast("int")).alias("pages_scraped"), F.sum((~F.col("ok")).cast("int")).alias("pages_failed"))
    return n.join(size, "base", "left").withColumn("total_size_bytes", F.coalesce("total_size_bytes", F.lit(0)))


def write_pages(pages: DataFrame, folder: str) -> None:
    """K6: JSON by base and file name; of the pages of one name that of the greatest URL stays."""
    named = pages.withColumn("file", url_filename(F.col("url"))).withColumn("_place", F.xxhash64(*pages.columns))
    latest(named, ["url", "_place"], "base", "file").drop("_place").write.mode("overwrite").partitionBy("base").json(folder)


def reachable(edges: DataFrame, seeds: DataFrame, folder: str) -> DataFrame:
    """The closure of (src, dst) from seeds (node): node and depth, one written round after another."""
    spark = edges.sparkSession
    seeds.select("node", F.lit(0).alias("depth")).distinct().write.mode("overwrite").parquet(f"{folder}/depth=0")
    depth = 0
    while True:
        every = spark.read.parquet(*[f"{folder}/depth={i}" for i in range(depth + 1)])
        last = spark.read.parquet(f"{folder}/depth={depth}")
        new = edges.join(last, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct().join(every, "node", "left_anti")
        depth += 1
        new.select("node", F.lit(depth).alias("depth")).write.mode("overwrite").parquet(f"{folder}/depth={depth}")
        if spark.read.parquet(f"{folder}/depth={depth}").isEmpty():
            return every


def by_host(rows: DataFrame, url: str) -> DataFrame:
    """Rows dealt by the host of their URL, so that one task keeps the pauses between requests to a host."""
    return rows.repartition(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def fetch_http(urls: DataFrame, timeout: float = 10.0, pause: float = 0.0, opener: Callable[..., object] | None = None) -> DataFrame:
    """(url) -> (url, html), null where the request fails. R9: with a pause, in seconds, a host's pages come from one task that rests
    so long after each request. opener: (url, timeout=) -> a response; urlopen if not given."""
    urls = by_host(urls.select("url"), "url") if pause else urls

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time
        from urllib.request import urlopen

        for pdf in batches:
            out = []
            for url in pdf["url"]:
                try:
                    with (opener or urlopen)(url, timeout=timeout) as r:
                        out.append(r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"))
                except (OSError, ValueError):
                    out.append(None)
                time.sleep(pause)
            yield pd.DataFrame({"url": pdf["url"], "html": out})

    return urls.select("url").mapInPandas(run, "url string, html string")
