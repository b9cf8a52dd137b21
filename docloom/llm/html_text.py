"""Operator 10: main text of HTML pages by consensus host paths.

Every page's containers are scored: characters of text in them, less those in links and less those in parts that are never article
text (scripts, navigation, forms, adverts, comments and the like). The page votes for the generalised tag-class path of its best
container (numbers in class names are levelled, positions left out). Votes are counted for each host in Spark; paths with
at least WINNING of the host's votes win. Every page is then read again, and its text is that in the elements on the best winning path it has;
a page that has none, or no host, is read by its own best path. So odd pages are read as their host's other pages are.

As each page has one vote, a host has at most 1 / WINNING winning paths. Votes and winners are small rows; pages stay where they
are if the winners' table is small enough for Spark to send out, else they are joined on the host, where AQE splits hot hosts.

Parts that are never article text are told by their element or by words in class, id and role. Names are weighed, not just looked up:
inside an article, main or an element named as one, a compound name says what its last telling word says (`advert-box` is an advert,
`advert-industry-history` and `menu-description` are not). A form, or a name that layouts share with noise (`widget-area`, `promo-page`), does not hide a
page: what it holds is read if the page's only article or main stands in it, if it has prose and next to nothing stands outside of noise, or if
its host's votes say so (a winning path that leads into it). Comments, hidden parts and elements like nav or aside are never read.
A header stays in an article or main, and in an element named as one if it has a heading. A noise element inside a line leaves the line whole.

Blocks are what block elements and line breaks bound; white space in a block (no-break spaces too) becomes one space. Defined
results: null, empty and text-free html gives an empty text; unclosed and misnested tags are closed as browsers do where it matters
here; a null url is no host; repeated rows give repeated results. Columns named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from docloom.llm.common import written

WINNING = 0.05
#: Characters of a block that is prose and no label of a form.
PROSE = 100
#: How many times the text outside of noise must be outweighed before a wrapper is read.
OUTSIDE = 20

#: Element names of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
NEVER = frozenset("head script style noscript nav footer aside button select textarea iframe svg math canvas template object audio video dialog menu title xmp noembed noframes datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements that are never article text but stand inside a line: they end no block.
IN_LINE_NEVER = frozenset("script style noscript template svg math canvas object audio video iframe button select textarea datalist".split())
CONTAINERS = frozenset("body main article section div td center".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: Words in class, id and role that mark parts that are never article text, and those that do so only alone.
STRONG = frozenset("nav navbar navigation menu sidebar footer ad ads advert adverts advertisement advertising sponsor sponsored promo comment comments disqus respond replies cookie cookies consent gdpr newsletter subscribe signup breadcrumb breadcrumbs pagination pager popup modal overlay widget widgets skip".split())
WEAK = frozenset("header banner masthead toolbar notice notices alert share sharing social related recommended tags byline search login complementary contentinfo".split())
KEEP = frozenset("article content main entry post story text body".split())
#: Words that name a place or a shape and say nothing on what stands there.
SHAPES = frozenset("area bar block body bottom box button buttons card col column container content copy cta desktop footer form frame group header headline holder icon image inline inner item items label large left link links list message mobile outer panel primary right row secondary section side slot small text title top unit view wrap wrapper zone".split())
#: Words that layouts also give to what wraps a whole page.
LAYOUT = WEAK | frozenset("widget widgets promo menu skip popup modal overlay".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
COMMENTS = frozenset("comment comments disqus respond replies".split())
BEFORE = frozenset("with has no without".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|--!>|$)"
    r"|<!\[CDATA\[.*?(?:\]\]>|$)"
    r"|<[!?][^>]*(?:>|$)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|$)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def is_hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")) is not None


def names(attrs: dict[str, str], of: tuple[str, ...] = ("class", "id")) -> Iterator[list[str]]:
    """The words of every name; those that say what an element has or lacks are not its names."""
    for name in of:
        for one in attrs.get(name, "").split():
            words = [w.lower() for w in _WORDS.findall(one)]
            if words and words[0] not in BEFORE:
                yield words


def says_noise(words: list[str], in_article: bool, named: bool) -> bool:
    """Whether a name says that an element is never article text. named: it stands in an element named as an article."""
    if not STRONG.isdisjoint(words):
        telling = [w for w in words if len(w) > 1 and w.isalpha() and (w not in SHAPES or w in STRONG)]
        return not (in_article or named) or not COMMENTS.isdisjoint(words) or telling[-1] in STRONG
    return not WEAK.isdisjoint(words) and KEEP.isdisjoint(words) and (not in_article or WEAK.issuperset(words))


def is_noise(tag: str, attrs: dict[str, str], in_article: bool, named: bool = False) -> bool:
    """Whether an element is never article text."""
    if tag in NEVER or tag == "form" or (tag == "header" and not in_article and not named):
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    return is_hidden(attrs) or any(says_noise(words, in_article, named) for words in names(attrs, ("class", "id", "role")))


def hard_noise(tag: str, attrs: dict[str, str]) -> bool:
    """Whether nothing below an element is ever article text, whatever it is; comments too."""
    words = {w.lower() for name in ("class", "id") for w in _WORDS.findall(attrs.get(name, ""))}
    return tag in NEVER or is_hidden(attrs) or not COMMENTS.isdisjoint(words)


def may_wrap(tag: str, attrs: dict[str, str]) -> bool:
    """Whether a noise element may be what a whole page stands in: a form, or compound names whose noise words are those of layouts."""
    said = [words for words in names(attrs, ("class", "id", "role")) if not (STRONG | WEAK).isdisjoint(words)]
    return tag != "header" and (tag == "form" or bool(said)) and all((STRONG - LAYOUT).isdisjoint(words) and not LAYOUT.issuperset(words) for words in said)


class Page:
    """Elements and text blocks of one page."""

    def __init__(self, html: str | None, spared: frozenset[int] = frozenset()):
        """spared: elements that are text though their name or that of a wrapper says noise."""
        # of each element: parent, label, path key, tag, noise, noise that no element below ends
        self.parent, self.label, self.key, self.tag, self.noise, self.hard = [-1], [""], [0], ["#"], [False], [False]
        self.html, self.spared = html, spared
        self.wraps: list[int] = []  # noise elements that a whole page may stand in
        self._own, self._names_article = [False], [False]  # noise by itself; named as an article
        self._named = [False]  # whether an element or one around it is named as an article
        self._headers: list[int] = []  # those that only a heading keeps
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._parts: list[str] = []
        self._links = 0
        self._stack = [0]
        self._anchors = 0
        self._read(html or "")

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.blocks.append((self._at, text, min(self._links, len(text))))
            self._parts, self._links = [], 0

    def _text(self, raw: str) -> None:
        if raw:
            node = self._stack[-1]
            if self.noise[node]:  # stands beside the block that it may be inside of
                if text := " ".join(raw.split()):
                    self.blocks.append((node, text, 0))
                return
            while self.tag[node] in INLINE:
                node = self.parent[node]
            if self._parts and node != self._at:
                self._flush()
            self._at = node
            raw = unescape(raw) if "&" in raw else raw
            self._parts.append(raw)
            if self._anchors:
                self._links += len(raw.strip())

    def _close(self, depth: int) -> None:
        """Closes all elements from this place of the stack on."""
        for node in self._stack[depth:]:
            if self.tag[node] not in INLINE and self.tag[node] not in IN_LINE_NEVER:
                self._flush()
            self._anchors -= self.tag[node] == "a"
        del self._stack[depth:]

    def _close_among(self, tags: set, until: set) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[i]]
            if tag in tags:
                return self._close(i)
            if tag in until:
                return None
        return None

    def _open(self, tag: str, raw: str) -> None:
        if tag in CLOSES_P:
            self._close_among({"p"}, {"table", "td", "th", "button", "object", "body"} | (CLOSES_P - {"p"}))
        if tag in CLOSED_BY:
            self._close_among(*CLOSED_BY[tag])
        if tag == "body":
            self._close_among({"head"}, set())
        if tag in VOID:
            if tag in ("br", "hr"):
                self._flush()
            return
        if tag in ("html", "body") and tag in (self.tag[i] for i in self._stack):
            return
        attrs = attributes(raw) if raw else {}
        up = self._stack[-1]
        inside = any(self.tag[i] in ("article", "main") for i in self._stack)
        own, number = is_noise(tag, attrs, inside, self._named[up]), len(self.tag)
        noise = (self.noise[up] or own) and number not in self.spared
        if own and may_wrap(tag, attrs):
            self.wraps.append(number)
        if tag == "header" and not inside and not own:
            self._headers.append(number)
        article = tag not in ("html", "body") and not own and any(not KEEP.isdisjoint(words) for words in names(attrs))
        self._own.append(own and number not in self.spared)
        self._names_article.append(article)
        self._named.append(not noise and (self._named[up] or article))
        if tag not in INLINE and tag not in IN_LINE_NEVER:
            self._flush()
        classes = sorted({re.sub(r"\d+", "#", c) for c in attrs.get("class", "").split()})
        label = ".".join([tag, *classes])
        self.parent.append(up)
        self.label.append(label)
        self.key.append(xxhash.xxh64_intdigest(f"{self.key[up]}>{label}"))
        self.tag.append(tag)
        self.noise.append(noise)
        self.hard.append(self.hard[up] or (own and hard_noise(tag, attrs)) or (tag == "article" and hard_noise(tag, attrs)))
        self._stack.append(len(self.tag) - 1)
        self._anchors += tag == "a"

    def _read(self, html: str) -> None:
        at = 0
        while True:
            m = _TOKEN.search(html, at)
            if m is None:
                break
            self._text(html[at : m.start()])
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if not tag:
                continue
            tag = tag.lower()
            if m["end"] or m["end2"]:
                for i in range(len(self._stack) - 1, 0, -1):
                    if self.tag[self._stack[i]] == tag:
                        self._close(i)
                        break
                    if tag in INLINE and self.tag[self._stack[i]] not in INLINE:
                        break
                else:
                    if tag == "p":
                        self._flush()
                continue
            attrs = m["attrs"] or m["attrs2"] or ""
            self._open(tag, attrs)
            if tag in RAW and not attrs.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                if close is None:
                    at = len(html)
                    break
                at = close.start()
        self._text(html[at:])
        self._close(1)
        self._flush()
        if self._headers:
            kept = set()
            for i in range(1, len(self.tag)):
                if self.tag[i] in HEADINGS:
                    while i > 0:
                        kept.add(i)
                        i = self.parent[i]
            for i in self._headers:
                self.noise[i] = self.noise[i] or i not in kept
            for i in range(self._headers[0], len(self.tag)):
                self.noise[i] = self.noise[i] or (self.noise[self.parent[i]] and i not in self.spared)

    def lone_article(self) -> int:
        """The only article or main of a page, if it stands below a wrapper that only its name makes noise; else -1."""
        found = [i for i, tag in enumerate(self.tag) if tag in ("article", "main")]
        outer = [i for i in found if self.parent[i] not in found]
        return outer[0] if len(outer) == 1 and self.noise[outer[0]] and not self.hard[outer[0]] else -1

    def wrapper(self) -> int:
        """The noise element that most of the page's prose stands in, though next to nothing stands outside of noise; else -1.

        Prose is text less links, in no other noise below. Some of it must stand in an element named as an article or be a block of at least PROSE characters."""
        prose, telling, clean = dict.fromkeys(self.wraps, 0), set(), 0
        if not prose:
            return -1
        for node, block, links in self.blocks:
            if not self.noise[node]:
                clean += len(block)
                continue
            while node > 0 and node not in prose and self.noise[self.parent[node]] and not self._own[node]:
                node = self.parent[node]
            if node in prose and not self.hard[node]:
                prose[node] += len(block) - links
                if len(block) - links >= PROSE:
                    telling.add(node)
        for node in range(len(self.tag)):
            if self._names_article[node]:
                up = self.parent[node]
                while up > 0 and up not in prose and not self._own[up]:
                    up = self.parent[up]
                telling.add(up)
        top = max(self.wraps, key=lambda i: prose[i])
        return top if top in telling and prose[top] > OUTSIDE * clean else -1

    def best(self) -> int:
        """The element with most text less links and noise; the deeper one of equals; -1 without text."""
        n = len(self.tag)
        gain, text = [0] * n, [0] * n
        for node, block, links in self.blocks:
            gain[node] += -len(block) if self.noise[node] else len(block) - 2 * links
            text[node] += 0 if self.noise[node] else len(block)
        depth, top = [0] * n, -1
        for i in range(1, n):
            depth[i] = depth[self.parent[i]] + 1
        for i in range(n - 1, 0, -1):
            gain[self.parent[i]] += gain[i]
            text[self.parent[i]] += text[i]
        for i in range(n):
            if text[i] and not self.noise[i] and (self.tag[i] in CONTAINERS or i == 0) and (top < 0 or (gain[i], depth[i]) > (gain[top], depth[top])):
                top = i
        return top

    def path(self, node: int) -> str:
        out = []
        while node > 0:
            out.append(self.label[node])
            node = self.parent[node]
        return ">".join(reversed(out))

    def text_in(self, key: int) -> list[str]:
        """Blocks in the elements of a path, in page order."""
        inside = [False] * len(self.tag)
        for i in range(len(self.tag)):
            inside[i] = self.key[i] == key or (i > 0 and inside[self.parent[i]])
        return [text for node, text, _ in self.blocks if inside[node] and not self.noise[node]]


def read_page(html: str | None) -> Page:
    page = Page(html)
    while True:  # ends, as every round spares one element more
        more = page.lone_article()
        if more < 0:
            more = page.wrapper()
        if more < 0 or more in page.spared:
            return page
        page = Page(html, page.spared | {more})


def text_by_path(page: Page, key: int) -> list[str]:
    """Blocks in the elements of a host's winning path; the votes outweigh a wrapper's name, as most pages of the host are read so."""
    blocks = page.text_in(key)
    if not blocks and (found := [i for i, k in enumerate(page.key) if k == key and page.noise[i] and not page.hard[i]]):
        blocks = Page(page.html, page.spared.union(found)).text_in(key)
    return blocks


def signed(key: int) -> int:
    return key - (1 << 64) if key >= 1 << 63 else key


# ---- over tables --------------------------------------------------------------------------------------------------------------

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)"


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) -> (host, path_key, path) of each page's best container."""
    for batch in batches:
        keys, paths = [], []
        for html in batch.column("html").to_pylist():
            page = read_page(html)
            best = page.best()
            keys.append(None if best < 0 else signed(page.key[best]))
            paths.append(None if best < 0 else page.path(best))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(keys, pa.int64()), pa.array(paths, pa.string())], ["host", "path_key", "path"])


def winning_paths(pages: DataFrame, winning: float = WINNING) -> DataFrame:
    """(url, html) -> (host, paths): the host's winning paths, most votes first."""
    at = pages.select(host_of(F.col("url")).alias("host"), "html").where("host <> ''")
    ballots = at.mapInArrow(_votes, "host string, path_key long, path string").where("path_key is not null")
    votes = ballots.groupBy("host", "path_key").agg(F.count("*").alias("votes"), F.min("path").alias("path"))
    votes = written(votes, "votes")
    cast = votes.groupBy("host").agg(F.sum("votes").alias("cast"))
    won = votes.join(cast, "host").where(F.col("votes") >= F.col("cast") * winning)
    order = F.expr("array_sort(collect_list(struct(-votes as less, path, path_key)))")
    return written(won.groupBy("host").agg(order.alias("p")).select("host", F.col("p.path_key").alias("paths"), F.col("p.path").alias("path_names")), "winning-paths")


def _reads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with _docloom_paths -> the same columns without it, and text and by_host. (Arrow in and out: other columns pass untouched.)"""
    for batch in batches:
        texts, used = [], []
        for html, keys in zip(batch.column("html").to_pylist(), batch.column("_docloom_paths").to_pylist()):
            page, blocks = read_page(html), []
            for key in keys or []:
                blocks = text_by_path(page, key % (1 << 64))
                if blocks:
                    break
            used.append(bool(blocks))
            if not blocks and (best := page.best()) >= 0:
                blocks = page.text_in(page.key[best])
            texts.append("\n".join(blocks))
        kept = [n for n in batch.schema.names if n != "_docloom_paths"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(texts, pa.string()), pa.array(used, pa.bool_())], [*kept, "text", "by_host"])


def extract(pages: DataFrame, winning: float = WINNING) -> DataFrame:
    """pages with text, n_chars and by_host (whether a winning path of the host was used)."""
    pages = pages.drop("text", "n_chars", "by_host")
    won = winning_paths(pages, winning).select(F.col("host").alias("_docloom_host"), "paths")
    at = pages.withColumn("_docloom_h", host_of(F.col("url"))).join(won.withColumnRenamed("paths", "_docloom_paths"), F.col("_docloom_h") == F.col("_docloom_host"), "left").select(*pages.columns, "_docloom_paths")
    schema = StructType([*pages.schema.fields, StructField("text", StringType()), StructField("by_host", BooleanType())])
    return at.mapInArrow(_reads, schema).withColumn("n_chars", F.length("text").cast("long"))


def extract_pages(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
