"""Crawled pages to records (H1-H10). The tree is html.parser's; blocks inside blocks repeat their text, as documented."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRUNED = {"script", "style", "nav", "header", "footer"}
BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "div", "td", "th"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Pages whose records leave a task together.
AT_ONCE = 256
PAGE = """url string, title string, manual_number string, content string, internal_links array<string>,
images array<struct<src:string,alt:string>>, metadata struct<scraped_at:string,content_length:int,num_images:int,keywords:string>"""


class _Tree(HTMLParser):
    """Elements in document order as [tag, attributes, parent, texts]; an unclosed element stays open, as in the parser's own tree."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple[str, dict, int]] = [("#", {}, -1)]
        self.texts: list[tuple[int, str]] = []
        self._open = [0]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.nodes.append((tag, {k: v or "" for k, v in attrs}, self._open[-1]))
        if tag not in VOID:
            self._open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.nodes.append((tag, {k: v or "" for k, v in attrs}, self._open[-1]))

    def handle_endtag(self, tag):
        for i in range(len(self._open) - 1, 0, -1):
            if self.nodes[self._open[i]][0] == tag:
                del self._open[i:]
                return

    def handle_data(self, data):
        self.texts.append((self._open[-1], data))

    def inside(self, root: int) -> list[bool]:
        """Whether each element is root or below it, and below no pruned element."""
        out = [False] * len(self.nodes)
        for i, (tag, _, parent) in enumerate(self.nodes):
            out[i] = (i == root or (parent >= 0 and out[parent])) and tag not in PRUNED
        return out


def only_references(html: str, names: Collection[str]) -> str:
    """html whose parsed text has the references of these names decoded where a semicolon closes them, and all others as they are written."""
    return re.sub(rf"&(?!(?:{'|'.join(map(re.escape, names))});)", "&amp;", html) if names else html.replace("&", "&amp;")


def parse_page(html: str | None, references: Collection[str] | None = None) -> dict | None:
    """H2-H9 of one page; None without main content. Character references are decoded as browsers do, closed by a semicolon or not, or only those
    named in `references`, where closed."""
    t = _Tree((html or "") if references is None else only_references(html or "", references))
    clean = t.inside(0)
    first = lambda want: next((i for i, n in enumerate(t.nodes) if want(*n[:2])), None)
    title = first(lambda tag, a: tag == "title")
    words = "".join(x for n, x in t.texts if n == title).strip() if title is not None else ""
    meta = first(lambda tag, a: tag == "meta" and a.get("name") == "keywords")
    main = next((i for i, n in enumerate(t.nodes) if n[1].get("role") == "main" and clean[i]), None)
    main = main if main is not None else next((i for i, n in enumerate(t.nodes) if n[0] == "body" and clean[i]), None)
    if main is None:
        return None
    within = t.inside(main)
    pieces: dict[int, list[str]] = {}
    for node, raw in t.texts:
        piece = raw.strip()
        if not piece or not within[node]:
            continue
        while node > 0:
            if within[node] and t.nodes[node][0] in BLOCKS and node != main:
                pieces.setdefault(node, []).append(piece)
            node = t.nodes[node][2]
    lines = ["".join(pieces[i]) for i in sorted(pieces)]
    links = {a["href"].replace("\\", "/") for i, (tag, a, _) in enumerate(t.nodes) if within[i] and tag == "a" and a.get("href", "").endswith(".html") and not a["href"].startswith("http")}
    images = [{"src": a["src"], "alt": a.get("alt", "")} for i, (tag, a, _) in enumerate(t.nodes) if within[i] and tag == "img" and a.get("src")]
    return {"title": words or "Untitled", "content": "\n".join(x for x in lines if len(x) > 1), "internal_links": sorted(links), "images": images, "keywords": t.nodes[meta][1].get("content", "") if meta is not None else ""}


def parse_pages(pages: DataFrame, scraped_at: str = "", references: Collection[str] | None = None) -> DataFrame:
    """H1: (url, html) -> page records; pages without main content give no row. `references` as for parse_page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (whole.iloc[lo : lo + AT_ONCE] for whole in batches for lo in range(0, len(whole), AT_ONCE)):
            rows = []
            for url, html in zip(pdf["url"], pdf["html"]):
                p = parse_page(html, references)
                if p is not None:
                    about = {"scraped_at": scraped_at, "content_length": len(p["content"]), "num_images": len(p["images"]), "keywords": p["keywords"]}
                    rows.append((url, p["title"], "", p["content"], p["internal_links"], p["images"], about))
            yield pd.DataFrame(rows, columns=["url", "title", "manual_number", "content", "internal_links", "images", "metadata"])

    return pages.select("url", "html").mapInPandas(run, PAGE)


def titles(pages: DataFrame) -> DataFrame:
    """H2 without a parser: raw title text, Untitled without one."""
    raw = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return pages.withColumn("title", F.when(raw == "", "Untitled").otherwise(raw))


def links(pages: DataFrame) -> DataFrame:
    """H8's raw material without a parser: distinct href values in order."""
    return pages.withColumn("links", F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1)))))
