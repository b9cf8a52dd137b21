"""Finding and downloading PDFs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.crawl import by_host, join_urls

_A = r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>"


def _first(html: Column, pattern: str) -> Column:
    found = F.regexp_extract(html, pattern, 1)
    return F.when(found != "", found)


def pdf_link(pages: DataFrame) -> DataFrame:
    """(url, html) with pdf_url. Each rule's first link counts only if it holds .pdf: an href that ends in .pdf; a text with download
    and pdf; a text with print or download; the first link of the first div whose class has download or pdf."""
    h, text = F.col("html"), r"[^<]*"
    rules = [
        r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']*\.pdf)[\"']",
        _A + rf"(?={text}(?:download[^<]*pdf|pdf[^<]*download){text}</a>)",
        _A + rf"(?={text}(?:print|download){text}</a>)",
        r"(?is)<div\b[^>]*?class\s*=\s*[\"'][^\"']*(?-i:download|pdf)[^\"']*[\"'][^>]*>(?:(?!</div>).)*?<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"']",
    ]
    out = pages
    for i, rule in enumerate(rules):
        out = join_urls(out.withColumn(f"_l{i}", _first(h, rule)), "url", f"_l{i}", f"_u{i}")
    tried = [F.when(F.lower(f"_u{i}").contains(".pdf"), F.col(f"_u{i}")) for i in range(len(rules))]
    return out.withColumn("pdf_url", F.coalesce(*tried)).drop(*[f"_{k}{i}" for i in range(len(rules)) for k in "lu"])


def probe_candidates(pages: DataFrame) -> DataFrame:
    """U7's fallback: for pages without a link the two usual places, in order; (url, place, candidate)."""
    parts = F.split(F.regexp_extract("url", r"^[a-z]+://[^/]+([^?#]*)", 1), "/")
    root = F.concat(F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1), F.array_join(F.slice(parts, 1, 4), "/"))
    two = F.array(F.concat(root, F.lit("/helpguide.pdf")), F.concat(root, F.lit("/print.html")))
    return pages.where(F.size(parts) >= 4).select("url", F.posexplode(two).alias("place", "candidate"))


def accept_probe(probes: DataFrame) -> DataFrame:
    """(url, place, candidate, status, content_type) -> (url, pdf_url): the first that answers 200 and is a PDF by type or name."""
    good = probes.where((F.col("status") == 200) & (F.lower(F.coalesce("content_type", F.lit(""))).contains("pdf") | F.col("candidate").endswith(".pdf")))
    return good.groupBy("url").agg(F.min_by("candidate", "place").alias("pdf_url"))


RECORD = "model string, help_guide_url string, success boolean, pdf_url string, file_size_bytes long, error string, output_path string"


def download(targets: DataFrame, folder: str, opener: Callable[[str], object] | None = None, pause: float = 0.0) -> DataFrame:
    """(model, help_guide_url, pdf_url) -> records. Files go to folder/model.pdf through pyarrow's file systems; an empty or broken
    one is deleted. A retried task writes the same file again.
    R9: with a pause, in seconds, a host's files come from one task that rests so long after each."""
    targets = by_host(targets, "pdf_url") if pause else targets

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time
        from urllib.request import urlopen

        from pyarrow import fs

        target, root = fs.FileSystem.from_uri(folder)
        get = opener or (lambda url: urlopen(url, timeout=30))
        for pdf in batches:
            rows = []
            for model, guide, url in zip(pdf["model"], pdf["help_guide_url"], pdf["pdf_url"]):
                path, size, error = f"{root.rstrip('/')}/{model}.pdf", 0, None
                if url is None:
                    rows.append((model, guide, False, None, 0, "no PDF link", None))
                    continue
                try:
                    target.create_dir(root, recursive=True)
                    with get(url) as source, target.open_output_stream(path) as out:
                        while block := source.read(8192):
                            out.write(block)
                            size += len(block)
                    error = None if size else "empty file"
                except (OSError, ValueError) as e:
                    error = str(e) or type(e).__name__
                if error and target.get_file_info(path).type != fs.FileType.NotFound:
                    target.delete_file(path)
                time.sleep(pause)
                rows.append((model, guide, error is None, url, 0 if error else size, error, None if error else path))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])

    return targets.select("model", "help_guide_url", "pdf_url").mapInPandas(run, RECORD)


def verify_files(files: DataFrame) -> DataFrame:
    """binaryFile rows with is_pdf: not empty and with a PDF's first bytes."""
    return files.withColumn("is_pdf", (F.col("length") > 0) & (F.substring("content", 1, 4) == F.lit(b"%PDF")))


def download_summary(records: DataFrame) -> DataFrame:
    """A5, K8: totals and all records in one row."""
    return records.agg(
        F.count("*").alias("total_cameras"), F.coalesce(F.sum(F.col("success").cast("int")), F.lit(0)).alias("successful_downloads"),
        F.coalesce(F.sum((~F.col("success")).cast("int")), F.lit(0)).alias("failed_downloads"),
        F.coalesce(F.sum("file_size_bytes") / (1024 * 1024), F.lit(0.0)).alias("total_size_mb"),
        F.array_sort(F.collect_list(F.struct(*[c.split()[0] for c in RECORD.split(", ")]))).alias("downloads"),
    )
