"""python -m docloom parse | count: pages to hierarchical chunks (P11), and the number of files made."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docloom.operators.lines import font_lines, typed_lines
from docloom.operators.segment import page_segments
from docloom.sources import files


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="docloom")
    tasks = out.add_subparsers(dest="task", required=True)
    parse = tasks.add_parser("parse", help="PDFs of one product to hierarchical chunks")
    for name, what in (("pdf", "file or glob"), ("model", "product id"), ("url", "address of its web guide"), ("output", "folder")):
        parse.add_argument(f"--{name}", required=True, help=what)
    tasks.add_parser("count", help="files of an output folder").add_argument("--output", required=True)
    return out


def main(argv: list[str] | None = None, decoder=None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("docloom").getOrCreate()
    if args.task == "count":
        print(files.parsed_files(spark, f"{args.output}/*.json"))
        return 0
    glyphs = files.read_pdfs(spark, args.pdf, decoder).withColumn("product_id", F.lit(args.model))
    chunks = page_segments(typed_lines(font_lines(glyphs))).withColumn("web_help_guide_url", F.lit(args.url))
    print(f"{files.write_hierarchical(chunks, args.output)} chunks in {args.output}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
