import random

from pyspark.sql import functions as F

from docloom.operators import lines, segment

KINDS = {"T": "topic", "S": "section", "B": "subheader", "b": "body", "f": "footnote", "H": "hint", "R": "related", "i": "ignore"}


def table(spark, pages):
    rows = []
    for n, page in enumerate(pages):
        for i, (kind, text) in enumerate(page):
            rows.append(("p", n, i, text, KINDS[kind]))
    return spark.createDataFrame(rows, "product_id string, page int, line_no int, text string, line_type string")


def by_hand(page):
    """One page line by line, written from the documented rules."""
    fresh = lambda: dict(tt="", tb=[], st="", sb=[], bt="", bb=[], f=[], h=[], rel=[], orphan=False)
    cur, out, mode = fresh(), [], None

    def emit():
        out.append({**cur, "tb": list(cur["tb"]), "sb": list(cur["sb"]), "bb": list(cur["bb"]), "f": list(cur["f"]), "h": list(cur["h"])})

    for kind, text in page:
        if kind != "b":
            mode = {"H": "hint", "R": "rel"}.get(kind)
        if kind == "T":
            if cur["bt"] or cur["tt"]:
                emit()
            cur = fresh() | {"tt": text}
        elif kind == "S":
            if cur["bt"] or cur["st"] or cur["orphan"]:
                emit()
            cur |= dict(st=text, sb=[], bt="", bb=[], f=[], h=[], orphan=False)
        elif kind == "B":
            if cur["bt"]:
                emit()
            cur |= dict(bt=text, bb=[], f=[], h=[])
        elif kind == "f":
            cur["f"].append(text)
        elif kind == "H":
            cur["h"].append([])
        elif kind == "b" and mode == "hint":
            cur["h"][-1].append(text)
        elif kind == "b" and mode == "rel":
            if not text.startswith("TP") and "Copyright" not in text:
                cur["rel"].append(text)
        elif kind == "b":
            if cur["bt"]:
                cur["bb"].append(text)
            elif cur["st"]:
                cur["sb"].append(text)
            elif cur["tt"]:
                cur["tb"].append(text)
            elif len(text) >= 20:
                if not cur["orphan"]:
                    first = text.split(".")[0]
                    cur |= dict(bt=first[:50].strip() + ("..." if len(first) > 50 else ""), bb=[text[len(first) :]] if "." in text and text[len(first) :] else [], orphan=True)
                else:
                    cur["bb"].append(text)
    if cur["bt"] or cur["st"] or cur["tt"] or cur["orphan"]:
        emit()
    join = lambda x: " ".join(" ".join(x).split())
    return [(c["tt"], join(c["tb"]), c["st"], join(c["sb"]), c["bt"], join(c["bb"]), c["f"], [" ".join(h) for h in c["h"] if h], c["rel"]) for c in out]


def segments(spark, pages):
    rows = segment.page_segments(table(spark, pages)).orderBy("chunk_no").collect()
    out = {i: [] for i in range(len(pages))}
    for r in rows:
        out[r.page_start].append((r.topic_title, r.topic_body, r.section_title, r.section_body, r.subheader_title, r.subheader_body, r.footnotes, r.hints, r.related_topics))
    return [out[i] for i in range(len(pages))]


def script(words):
    return [(w, f"{KINDS[w]} line number {i} of this page") for i, w in enumerate(words)]


def test_documented_pages(spark):
    want = {"TbSbBb": 1, "TbTb": 2, "SbTb": 1, "TSS": 2, "bT": 2, "SfB": 1, "TBRbB": 2, "BHbib": 1, "T": 1, "S": 1, "f": 0}
    got = segments(spark, [script(w) for w in want])
    assert {w: len(g) for w, g in zip(want, got)} == want | {"bT": len(by_hand(script("bT")))}
    for w, g in zip(want, got):
        assert g == by_hand(script(w)), w


def test_random_pages(spark):
    rng = random.Random(5)
    texts = ["short", "a body line that is long enough", "First part. And the rest of it is here", "x" * 70, "TP123", ". starts with a period and goes on", "Copyright of all of this text"]
    pages = []
    for _ in range(400):
        kinds = [rng.choice("TSBbbbfHRi") for _ in range(rng.randint(0, 14))]
        pages.append([(k, rng.choice(texts) if k == "b" else f"{KINDS[k]} {i}") for i, k in enumerate(kinds)])
    for page, got in zip(pages, segments(spark, pages)):
        assert got == by_hand(page), page


def test_line_types(spark):
    cases = [("42", "Bold", 20.0, "ignore"), ("Help Guide", "x", 9.7, "ignore"), ("about ILME-FX3", "x", 9.7, "ignore"), ("this line is about the ILME-FX3 model", "x", 9.7, "body"),
             ("TP1001920799", "x", 9.7, "ignore"), ("Copyright 2024", "x", 9.7, "ignore"), ("Hint", "x", 9.7, "hint"), ("Related Topic", "x", 9.7, "related"), ("*1 note", "Bold", 12.0, "footnote"),
             ("small", "Bold", 8.4, "footnote"), ("large", "Regular", 20.0, "body"), ("topic", "xBOLDx", 11.5, "topic"), ("section", "Black", 10.0, "section"), ("sub", "Bold", 9.0, "subheader"), ("none", "Bold", 8.9, "body")]
    df = spark.createDataFrame([(i, t, f, s, "ILME-FX3") for i, (t, f, s, _) in enumerate(cases)], "i int, text string, font string, size double, product_id string")
    got = {r.i: r.line_type for r in lines.typed_lines(df).collect()}
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]


def test_thresholds_by_prefix(spark):
    df = spark.createDataFrame([("ILME-FR7",), ("ILCE-1",), ("ILME-FX3",), ("other",)], "m string")
    from docloom.functions.text import threshold

    assert [r[0] for r in df.select(threshold(F.col("m"), "topic")).collect()] == [11.0, 12.0, 11.5, 11.5]


def test_font_lines(spark):
    g = [("p", 1, 0, 10.0, "A", 9.0, "b"), ("p", 1, 1, 10.0, "B", 9.0, "a"), ("p", 1, 2, 5.0, "A", 9.0, " "), ("p", 1, 3, 20.0, "B", 8.0, "x"), ("p", 1, 4, 20.0, "B", 8.0, "y"), ("p", 1, 5, 20.0, "A", 8.0, "z")]
    df = spark.createDataFrame(g, "product_id string, page int, glyph_no int, top double, fontname string, size double, text string")
    got = [(r.line_no, r.text, r.font) for r in lines.font_lines(df).orderBy("line_no").collect()]
    assert got == [(0, "ba", "A"), (1, "xyz", "B")]
