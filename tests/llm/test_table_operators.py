"""JPEG media, mixing, sharding, HTML extraction and the pipeline against brute force on small tables."""

import hashlib
import os
import random
import struct
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import decontam, html_text, media, mixing, queries, sharding
from tests.duck import connection, same

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TEXTS = [None, "", "a", "x" * 63, "x" * 64, "x" * 65, "é ß 漢字 \U0001f600", "".join(map(chr, range(1, 256))), "\xff" * 300, "long " * 70_000, "a"]


# ---- media --------------------------------------------------------------------------------------------------------------------


def test_texts_come_back_from_jpeg(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumns({"media": F.lit("clash"), "image": F.lit("clash")})
    got = {r.doc_id: r for r in media.media_digest(df).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        pay = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:])), i
    same_text = ("media_bytes", "media_sha256", "feature")
    assert [got[2][c] for c in same_text] == [got[10][c] for c in same_text] and [got[0][c] for c in same_text] == [got[1][c] for c in same_text]
    assert media.media_digest(df.limit(0)).count() == 0


def test_stored_bytes_are_what_was_hashed(spark):
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    stored = bytes(media.store_texts(df).head().media)
    r = media.media_digest(df).head()
    assert (len(stored), hashlib.sha256(stored).hexdigest()) == (r.media_bytes, r.media_sha256)
    assert stored[:2] == b"\xff\xd8" and stored[-2:] == b"\xff\xd9"


def jpeg(width, height, sampling, dc, restart=0):
    """A baseline JPEG of flat blocks: dc has for each component its blocks' DC values by row; written with the operator's tables only."""
    codes = media._codes(media.DC_LENGTHS, media.DC_SYMBOLS)
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    wide, high = -(-width // (8 * hm)), -(-height // (8 * vm))
    scan, bits, pred = b"", "", [0] * len(sampling)

    def done():
        nonlocal bits, scan
        bits += "1" * (-len(bits) % 8)
        scan += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        bits = ""

    for n in range(wide * high):
        if restart and n and n % restart == 0:
            done()
            scan += bytes([0xFF, 0xD0 + (n // restart - 1) % 8])
            pred = [0] * len(sampling)
        for c, (h, v) in enumerate(sampling):
            for y in range(v):
                for x in range(h):
                    value = int(dc[c][n // wide * v + y][n % wide * h + x])
                    d, pred[c] = value - pred[c], value
                    code, size = codes[abs(d).bit_length()]
                    s = abs(d).bit_length()
                    bits += f"{code:0{size}b}" + (f"{d if d > 0 else d + (1 << s) - 1:0{s}b}" if s else "") + "0"
    done()
    seg = media._segment
    frame = bytes([8, height >> 8, height & 255, width >> 8, width & 255, len(sampling), *[x for i, (h, v) in enumerate(sampling) for x in (i + 1, h << 4 | v, 0)]])
    huff = bytes([0x00, *media.DC_LENGTHS, *media.DC_SYMBOLS]) + bytes([0x10, *media.AC_LENGTHS, *media.AC_SYMBOLS])
    start = bytes([len(sampling), *[x for i in range(len(sampling)) for x in (i + 1, 0)], 0, 63, 0])
    return b"\xff\xd8" + seg(0xFE, b"a comment") + seg(0xDB, bytes([0, *[4] * 64])) + seg(0xC0, frame) + seg(0xC4, huff) + (seg(0xDD, restart.to_bytes(2, "big")) if restart else b"") + seg(0xDA, start) + scan + b"\xff\xd9"


@pytest.mark.parametrize("sampling", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("restart", [0, 2])
def test_thumbnails_of_colour_images(sampling, restart):
    rng = np.random.default_rng(1)
    width, height = 61, 43
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    wide, high = -(-width // (8 * hm)), -(-height // (8 * vm))
    dc = [rng.integers(-250, 250, (high * v, wide * h)) for h, v in sampling]
    ((w, t, pixels),) = media.thumbnails([jpeg(width, height, sampling, dc, restart)])[0]
    want = np.clip((dc[0][: -(-height // 8), : -(-width // 8)] * 4 + 4 >> 3) + 128, 0, 255)
    assert (w, t) == (width, height) and (pixels == want).all()


def test_damaged_media_has_a_reason(spark):
    good = media.encode_payloads([b"a" * 128])[0]
    rows = [(0, None), (1, b""), (2, b"no image"), (3, good[:-40]), (4, good.replace(b"\xff\xc0", b"\xff\xc2")), (5, good)]
    got = {r.i: r.image for r in media.decode(spark.createDataFrame(rows, "i int, media binary")).collect()}
    assert all(got[i].error and got[i].width is None for i in range(5))
    assert got[5].error is None and (got[5].width, got[5].height, bytes(got[5].thumbnail)) == (512, 16, b"a" * 128)


# ---- mixing -------------------------------------------------------------------------------------------------------------------


@tables
def test_mix_equals_its_sql(spark):
    same(queries.op7_mixing(spark, SF), mixing.MIX_SQL, SF)


def filled(sizes, weights=(3, 1, 2), share=1.5, passes=2):
    """Targets by filling up: cap every source above its limit, reshare, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        theta = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * theta > passes * sizes[s]}
        if not over:
            return target | {s: weight[s] * theta for s in open_}
        for s in over:
            target[s] = passes * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_targets_and_takes(spark):
    rng = random.Random(11)
    for trial in range(3):
        rows = [(i, " ".join("w" * 3 for _ in range(rng.randrange(1 if trial else 0, 40))), rng.choice(["b", "a", None, "É", "z"])) for i in range(300)]
        rows += [(400, None, "a"), (401, "", None), (402, "p q", "only"), (402, "p q", "only")]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("clash"))
        got = mixing.mix_plan(df).collect()
        sizes = Counter()
        for _, t, s in rows:
            sizes[s] += len((t or "").split())
        want = filled(dict(sizes))
        by_id = {i: s for i, _, s in rows}
        taken = Counter()
        for r in got:
            s = by_id[r.doc_id]
            assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r["size"]
            taken[s] += r.taken
        assert len(got) == len(rows) and sum(taken.values()) == sum(sizes.values()) * 3 // 2
        assert all(abs(taken[s] - want[s]) <= mixing.PACKET for s in want)


def served(rows, packet, weights=(3, 1, 2), share=1.5, passes=2, seed=7):
    """Doc id -> words, by serving one packet after another from the queue with the least virtual finish time."""
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    queue = {s: [] for s in order}
    for i, t, s in sorted(rows, key=lambda r: (md5(f"{seed}:{r[0]}:{md5(r[1] or '')}"), len((r[1] or "").split()))):
        queue[s].append((md5(f"{seed}:{i}:{md5(t or '')}"), i, len((t or "").split())))
    heads = []
    for s, q in queue.items():
        done = 0
        for _ in range(passes):
            for key, i, size in q:
                for lo in range(0, size, packet):
                    n = min(packet, size - lo)
                    done += n
                    heads.append((done * 6 // weight[s], key, s is not None, s or "", i, n))
    left, taken = int(sum(len((t or "").split()) for _, t, _ in rows) * share), Counter()
    for *_, i, n in sorted(heads):
        taken[i] += min(n, left)
        left -= min(n, left)
    return taken


@pytest.mark.parametrize("packet", [5, 256, None])
def test_mix_equals_a_queue_that_is_served_in_order(spark, packet):
    rng = random.Random(13)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 3, 12, 40]))), rng.choice(["b", "a", None, "z"])) for i in range(250)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.taken for r in mixing.mix_plan(df, packet=packet).collect()}
    assert {k: n for k, n in got.items() if n} == {k: n for k, n in served(rows, packet or 10**9).items() if n}


def test_mix_serves_copies_in_order(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{j}" for j in range(rng.randrange(1, 30))), rng.choice("ab")) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r.doc_id: r.taken for r in mixing.mix_plan(df, packet=None).collect()}
    got = mixing.mix(df).collect()
    assert [r.finish for r in got] == sorted(r.finish for r in got)
    words = Counter()
    for r in got:
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({k: n for k, n in plan.items() if n})
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix_plan(df.limit(0)).count() == 0


# ---- sharding -----------------------------------------------------------------------------------------------------------------


def test_matrix_has_exact_sums():
    for counts, shards in (([5, 0, 7, 1], 3), ([100] * 50, 16), ([1], 4), ([], 4), ([3 * 10**8] * 9, 5)):
        m = sharding.communication_matrix(counts, shards, 1)
        total = sum(counts)
        assert m.sum(axis=1).tolist() == counts and (m >= 0).all()
        assert m.sum(axis=0).tolist() == [total // shards + (s < total % shards) for s in range(shards)]


def test_large_draws_follow_the_law():
    rng = np.random.default_rng(0)
    x = np.array([sharding._hypergeometric(30, 50, 20, rng) for _ in range(4000)])
    assert abs(x.mean() - 7.5) < 0.15 and abs(x.var() - 20 * 30 / 80 * 50 / 80 * 60 / 79) < 0.3 and x.min() >= 0 and x.max() <= 20


@pytest.mark.parametrize("n", [0, 5, 5000])
def test_shards(spark, n):
    rows = [(i if i % 9 else None, "same" if i % 3 else f"t{i}") for i in range(n)] + ([(None, None), (1, "same"), (1, "same")] if n else [])
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("clash"))
    got = sharding.shard_plan(df).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == len(rows) and all(0 <= s < 16 for s in counts)
    assert max(counts.values(), default=0) - min(counts[s] for s in range(16)) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert Counter((r["size"], r.text_crc32) for r in got) == Counter((len(t or "") + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    again = sharding.shard_plan(df.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert {(r.law, r.grown_shard) for r in got} <= {("rows", None)}


def _hashed(word, *longs):
    """What Spark's xxhash64 gives for a string and integers: each value's hash is the next one's seed, nulls are skipped."""
    h = xxhash.xxh64_intdigest(word.encode(), 42)
    for x in longs:
        h = h if x is None else xxhash.xxh64_intdigest(struct.pack("<q", x), h)
    return h - (h >> 63 << 64)


@pytest.mark.parametrize("n, shards", [(0, 16), (7, 16), (6000, 16), (6000, 5)])
def test_shards_equal_rows_placed_one_by_one(spark, n, shards):
    """The same matrix, but blocks, cuts, exchange and second permutation done on lists of rows."""
    texts = ["copy", "", None, "é" * 40, "long " * 50_000]
    rows = [(i if i % 7 else None, texts[0] if i % 3 else texts[i % 5]) for i in range(n)] + [(5, "twice"), (5, "twice")] * (n > 0)
    blocks = max(1, -(-len(rows) // sharding.BLOCK_ROWS))
    dealt = [[] for _ in range(blocks)]
    for doc_id, text in rows:
        data = (text or "").encode()
        row = (doc_id, len(data) + 1, zlib.crc32(data))
        k1, k2, k3 = (_hashed(f"{word}9", *row) for word in ("deal", "local", "again"))
        dealt[k1 % blocks].append((k2, k1, k3, row))
    matrix = sharding.communication_matrix([len(b) for b in dealt], shards, 9)
    exchanged = [[] for _ in range(shards)]
    for block, counts in zip(dealt, matrix.tolist()):
        block.sort(key=lambda r: r[:3])
        for s, count in enumerate(counts):
            exchanged[s] += block[:count]
            block = block[count:]
    want = Counter()
    for s, mine in enumerate(exchanged):
        mine.sort(key=lambda r: ((r[2] % 2**64 >> 40) % blocks, r[2], r[0], r[1]))
        want.update((*row, "rows", s, slot, None) for slot, (*_, row) in enumerate(mine))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, sharding.shard_plan(df, shards).collect())) == want
    whole = sharding.shard_documents(df.withColumn("size", F.lit("clash")), shards)
    assert Counter(map(tuple, whole.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect())) == want


def test_shards_are_shuffled(spark):
    got = sharding.shard_plan(spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))).toPandas()
    low = got[got.doc_id < 10_000].groupby("shard").size()
    assert (abs(low - 625) < 100).all()  # over five standard deviations
    assert abs(np.corrcoef(got.doc_id, got.slot)[0, 1]) < 0.04


# ---- pages --------------------------------------------------------------------------------------------------------------------

SHELL = """<html><head><title>T</title><style>p{}</style></head><body><div class="navbar"><a href="/">Home</a></div><header>Top</header>
<div class="layout"><div class="content-%d"><h1>Head &amp; more</h1><p>%s</p><ul><li>one<li>two</ul><script>var x = "<p>no</p>";</script></div>
<div class="sidebar"><p>Popular things</p></div></div><div id="comments"><p>A reader says so</p></div><footer>Foot</footer></body></html>"""


def test_pages(spark):
    long = "The   story goes\non <b>and</b> on &mdash; for many words, so it is the main one."
    said = "The story goes on and on — for many words, so it is the main one."
    rows = [(i, f"https://h.example/{i}", SHELL % (i, long)) for i in range(8)]
    rows += [(20, None, SHELL % (1, long)), (21, "https://h.example/x", None), (22, "https://h.example/y", ""), (23, "nonsense", "<p>only &lt;this&gt;<p>and that"), (24, "https://k.example", "<div><nav>menu</nav></div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "_host": F.lit("h"), "paths": F.lit("p"), "host": F.lit("h2")})
    out = html_text.extract(df)
    got = {r.page_id: r for r in out.collect()}
    for i in (*range(8), 20):
        assert got[i].text == f"Head & more\n{said}\none\ntwo" and got[i].n_chars == len(got[i].text)
    assert all(got[i].by_host for i in range(8)) and not got[20].by_host
    assert [got[i].text for i in (21, 22, 23, 24)] == ["", "", "only <this>\nand that", ""]
    assert html_text.extract_pages(df.limit(0)).count() == 0 and len(got) == len(rows)


@pytest.mark.parametrize("html, want", [
    ("<p>One <span class='ad'>ad</span> two</p>", "One two"),
    ("<p>One <script>x()</script>two <button>press</button>three</p>", "One two three"),
    ("<div class='search-results-page'><article><p>Found <b>text</b> here</p></article></div>", "Found text here"),
    ("<article><div class='login-help'>How to log in</div><p class='tags-intro'>On tags</p><div class='related'>no</div></article>", "How to log in\nOn tags"),
    ("<article><p>Mine</p></article><div class='comments'><article class='comment'><p>Theirs</p></article></div>", "Mine"),
    ("<p>Only</p><section id='comments'><article><p>Theirs</p></article></section>", "Only"),
    ("<main><p>a</p><aside>no</aside><div class='ad-box'>no</div>b</main>", "a\nb"),
])
def test_article_text_stays_and_noise_goes(html, want):
    page = html_text.read_page("<html><body>" + html + "</body></html>")
    assert "\n".join(page.text_in(page.key[page.best()])) == want


STORY = "<h1>Head</h1><p>" + "A story is told here. " * 8 + "</p>"
TOLD = "Head\n" + ("A story is told here. " * 8).strip()


@pytest.mark.parametrize("html, want", [
    (f"<form><nav>x</nav><div class='content'>{STORY}</div><footer>f</footer></form>", TOLD),
    (f"<form action='/'>{STORY}<button>Go</button></form>", TOLD),
    ("<form><label>Name</label><input><label>Your message</label></form>", ""),
    (f"<div class='widget-area'><div class='content'>{STORY}</div></div>", TOLD),
    (f"<form><div class='widget-area'><div class='sidebar'>no</div><div class='text'>{STORY}</div></div></form>", TOLD),
    (f"<div class='promo-page'><div class='text'>{STORY}</div></div>", TOLD),
    (f"<div class='share-price-report'>{STORY}</div>", TOLD),
    (f"<article>{STORY}<p class='menu-description'>Of dishes</p><section class='advert-industry-history'>Of adverts</section><div class='advert-box'>no</div></article>", TOLD + "\nOf dishes\nOf adverts"),
    (f"<div class='post'><header><h1>Title</h1></header>{STORY}<header>no</header></div>", "Title\n" + TOLD),
    (f"<header><h1>Site</h1></header><div class='post'>{STORY}</div>", TOLD),
    ("<div class='cookie-notice'><p>" + "We use cookies here. " * 20 + "</p></div>", ""),
    ("<p>Short one.</p><div class='widget-area'><div class='text'>" + "Another text. " * 4 + "</div></div>", "Short one."),
    (f"<p>Mine</p><form><div class='comments'><div class='content'>{STORY}</div></div></form>", "Mine"),
])
def test_wrappers_do_not_hide_a_page(html, want):
    page = html_text.read_page("<html><body>" + html + "</body></html>")
    assert "\n".join(page.text_in(page.key[page.best()]) if page.best() >= 0 else []) == want


def test_votes_outweigh_a_name(spark):
    """Nine pages vote for the content in a wrapper named as noise; in the tenth a longer note stands outside of it, so its own text does not tell."""
    body = "<body><div class='note'>%s</div><div class='widget-area'><div class='content'><p>%s</p></div></div></body>"
    rows = [(i, "http://h/a", body % ("", "main text " * 20)) for i in range(9)] + [(9, "http://h/b", body % ("note " * 20, "brief")), (10, "http://k/b", body % ("note " * 20, "brief"))]
    got = {r.page_id: r.text for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == ("main text " * 20).strip() and got[9] == "brief" and got[10] == ("note " * 20).strip()


class Plain(HTMLParser):
    """The article of a page of the tables by the library's parser: no scores, no paths."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.depth, self.skip, self.parts, self.blocks = 0, 0, [], []
        self.feed(html)
        self.close()
        self.end()

    def end(self):
        if text := " ".join("".join(self.parts).split()):
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skip += tag in html_text.NEVER
        if tag not in html_text.INLINE:
            self.end()

    def handle_endtag(self, tag):
        if tag not in html_text.INLINE:
            self.end()
        self.depth -= tag == "article"
        self.skip -= tag in html_text.NEVER

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.parts.append(data)


@tables
def test_pages_equal_a_plain_reader(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r.page_id: "\n".join(Plain(r.html or "").blocks) for r in pages.collect()}
    assert {r.page_id: r.text for r in html_text.extract_pages(pages).collect()} == want and all(want.values())


def test_long_page(spark):
    """A page of over a megabyte with thousands of blocks and deep nesting comes out whole."""
    blocks = [f"Block {i} of a long page" for i in range(40_000)]
    html = "<body><nav>no</nav>" + "<div>" * 500 + "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>" + "</div>" * 500
    got = html_text.extract_pages(spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string")).collect()
    assert got[0].text == "\n".join(blocks)


def test_odd_pages_are_read_as_their_hosts_others(spark):
    """The first nine pages vote for div.post, as link lists make the body a bad container; the tenth, read alone, would be its whole body."""
    body = "<body><div class='list'>%s</div><div class='post'><p>%s</p></div><div class='box'><p>%s</p></div></body>"
    links = "<a href='x'>another page to read</a> " * 9
    rows = [(i, "http://h/a", body % (links, "main text " * 20, "box")) for i in range(9)] + [(9, "http://h/b", body % ("", "brief", "quoted text " * 30))]
    rows += [(10, "http://k/b", rows[9][2])]
    got = {r.page_id: r.text for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "brief" and got[0] == ("main text " * 20).strip() and got[10].startswith("brief\nquoted")


# ---- all queries and the pipeline ---------------------------------------------------------------------------------------------


@tables
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_whole_tables(spark, name):
    """One row for each document, page or conversation; of the divergence, all pairs of the sources of each language."""
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name == "op11_dialogue":
        assert sorted(got.conv_id) == [r[0] for r in connection(SF).sql("select distinct conv_id from conversations order by 1").fetchall()]
        return
    if name == "op12_divergence":
        pairs = connection(SF).sql("select distinct a.lang, a.source, b.source from documents a join documents b on a.lang = b.lang and a.source <> b.source").fetchall()
        assert sorted(got[got.part == "pair"][["lang", "source", "item"]].itertuples(index=False, name=None)) == sorted(pairs)
        return
    if name == "op2_decontamination":
        assert len(got) and (got.score >= 0.5).all()
        return
    of, key = ("pages", "page_id") if name == "op10_html" else ("documents", "doc_id")
    want = [r[0] for r in connection(SF).sql(f"select {key} from {of} order by 1").fetchall()]
    assert sorted(got[key]) == want


@tables
def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns
        if name != "mixture":
            assert 0 < out.count() <= docs.count()
            assert out.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).isEmpty()
        docs = out
    rows = p.STAGES[-1][1](spark, docs, SF).collect()
    assert len(rows) == docs.count()
    assert sorted(r.start for r in rows) == np.concatenate([[0], np.cumsum([r.n_tokens for r in sorted(rows, key=lambda r: r.start)])[:-1]]).tolist()
    assert sorted(map(tuple, p.run(spark, SF).collect())) == sorted(map(tuple, rows))


FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
]


@tables
def test_language_stage_rejects_texts_in_no_learned_language(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    foreign = spark.createDataFrame([(10**9 + i, t, None, "s", len(t)) for i, t in enumerate(FOREIGN)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in p.language(spark, docs.unionByName(foreign.select([F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])), SF).collect())
    assert got == sorted(r.doc_id for r in docs.where(F.col("text").rlike(r"\p{L}")).collect())


def test_language_stage_predicts_each_text_once(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([(i, "the cat sat on the mat and the dog", "en", "s", None) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    plan = p.language(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [predict") == 1


def test_language_stage_without_labels_keeps_texts_with_a_letter(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate([*FOREIGN, "x", "1 2 3", "", None, "漢字"])], "doc_id long, text string, lang string")
    assert sorted((r.doc_id, r.lang) for r in p.language(spark, docs, "").collect()) == [(i, None) for i in (0, 1, 2, 3, 4, 8)]


def test_no_query_leaves_the_shuffle_clean_up_on(spark):
    """Written tables drop their shuffle files themselves; counts and cuts are whole each time, and the session's setting stays."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    docs = spark.createDataFrame([(i, f"alpha beta w{i % 7} w{i % 11} gamma", f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    items = spark.createDataFrame([(1, "alpha beta w1 w2 gamma"), (2, "w3 w4 gamma alpha beta")], "item_id long, text string")
    block = next(decontam._blocks(items))
    first = decontam.word_counts(docs, block)
    assert first.sum() > 0 and first[1] == 300  # "alpha" is the first word of the first item
    for _ in range(5):
        assert (decontam.word_counts(docs, block) == first).all()
        assert mixing.mix_plan(docs).groupBy().agg({"taken": "sum"}).head()[0] == 300 * 5 * 3 // 2
    assert spark.conf.get(key, None) == before
