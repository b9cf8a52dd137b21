import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import buckets, catalog, chunk, crawl, download, html, index, layout, quality, ratelimit, search
from docloom.operators.encode import HashingEncoder, encode, self_test
from docloom.sources import files


def packed(text, limit, overlap):
    if len(text) // 4 <= limit:
        return [text]
    out, cur, tok = [], [], 0
    for p in text.split("\n\n"):
        t = len(p) // 4
        if cur and tok + t > limit:
            out.append("\n\n".join(cur))
            last = cur[-1]
            cur, tok = ([last], len(last) // 4) if len(last) // 4 < overlap else ([], 0)
        cur.append(p)
        tok += t
    return out + ["\n\n".join(cur)] if cur else out


def test_packing(spark):
    import random

    rng = random.Random(1)
    texts = ["\n\n".join("w" * rng.choice([1, 30, 396, 400, 900, 2500]) for _ in range(rng.randint(1, 12))) for _ in range(200)] + ["a" * 2000, "a" * 2004, "", "x" * 9000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", chunk.split_text("t").alias("p")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == packed(t, 500, 100), i


def test_quality_edges(spark):
    cases = {"x" * 19: False, "x" * 20: True, "  " + "x" * 19 + " ": False, "a" * 6 + "-" * 14: True, "a" * 5 + "-" * 15: False, "Copyright " + "x" * 89: False, "Copyright " + "x" * 90: True}
    df = spark.createDataFrame(list(cases.items()), "t string, ok boolean")
    assert df.where(T.is_quality(F.col("t")) != F.col("ok")).isEmpty()
    assert spark.createDataFrame([(None,)], "t string").where(T.is_quality(F.col("t"))).isEmpty()


def test_upsert_and_index(spark, tmp_path):
    rows = lambda r: spark.createDataFrame(r, "id string, v int, seq int")
    old = rows([("a", 1, 0), ("b", 1, 0)])
    got = {r.id: r.v for r in index.upsert(old, rows([("b", 2, 0), ("b", 3, 1), ("c", 4, 0)]), by=["seq"]).collect()}
    assert got == {"a": 1, "b": 3, "c": 4}
    ix = index.VectorIndex(spark, f"file://{tmp_path}/ix")
    assert not ix.exists()
    with pytest.raises(FileNotFoundError):
        ix.read()
    ix.upsert(old)
    ix.upsert(rows([("a", 9, 1)]))
    assert {r.id: r.v for r in ix.read().collect()} == {"a": 9, "b": 1}
    with pytest.raises(ValueError):
        ix.clear()
    assert ix.clear(confirm=True) == 0 and ix.clear() == 0


def test_an_upsert_writes_what_it_touches(spark, tmp_path):
    """Bytes written grow with the new rows and not with the table; keys are looked up in their own buckets."""
    vectors = lambda lo, hi, v: spark.range(lo, hi).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: (F.hash("id", x) % 1000 + v).cast("float")).alias("embedding"), F.lit(v).alias("v"))
    ix = index.VectorIndex(spark, f"file://{tmp_path}/ix", buckets=32)
    whole = ix.replace(vectors(0, 4000, 0))
    one, few = ix.upsert(vectors(5, 6, 1)), ix.upsert(vectors(10, 14, 2))
    assert whole["buckets_written"] == 32 and one["buckets_written"] == 1 and 1 < few["buckets_written"] <= 4
    assert one["bytes_written"] < whole["bytes_written"] / 16 and one["bytes_written"] < few["bytes_written"] < whole["bytes_written"] / 4
    assert {r.v: r.n for r in ix.read().groupBy("v").agg(F.count("*").alias("n")).collect()} == {0: 3995, 1: 1, 2: 4}
    assert [(r.id, r.v) for r in ix.get([5, 12, 9999]).orderBy("id").collect()] == [(5, 1), (12, 2)]
    assert 1 < len({f.rsplit("/", 1)[0] for f in ix.read().inputFiles()}) and len({f.rsplit("/", 1)[0] for f in ix.get([5]).inputFiles()}) == 1
    again = ix.rebucket(4)
    assert again["buckets"] == 4 and ix.read().count() == 4000


def test_readers_and_writers_of_an_index(spark, tmp_path):
    """A reader keeps its version, of two writers from one version one must run again, a dead writer leaves nothing visible, deletions and empty buckets."""
    rows = lambda *ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string")
    ids = lambda df: sorted(r.id for r in df.collect())
    ix = index.VectorIndex(spark, f"file://{tmp_path}/ix", buckets=8)
    ix.replace(rows(1, 2, 3))
    opened = ix.read()
    other = index.VectorIndex(spark, f"file://{tmp_path}/ix")
    publish = ix._publish

    def late(*a, **b):
        other.upsert(rows(50))  # another writer is faster
        assert ids(other.read()) == [1, 2, 3, 50]
        return publish(*a, **b)

    ix._publish = late
    with pytest.raises(buckets.ConcurrentWrite):
        ix.upsert(rows(60))
    ix._publish = publish
    assert ids(ix.read()) == [1, 2, 3, 50] and ids(opened) == [1, 2, 3]
    ix.upsert(rows(60))
    ix.delete(rows(1, 2, 3, 50, 77))
    assert ids(ix.read()) == [60] and ids(ix.read(0)) == [1, 2, 3] and ids(opened) == [1, 2, 3]
    ix._publish = lambda *a, **b: 1 / 0
    with pytest.raises(ZeroDivisionError):
        ix.upsert(rows(80))
    ix._publish = publish
    assert ids(index.VectorIndex(spark, f"file://{tmp_path}/ix").read()) == [60]
    assert ix.vacuum() > 0 and ids(ix.read()) == [60] and len(ix.versions()) == 1
    ix.delete(rows(60))
    assert ids(ix.read()) == [] and ids(ix.get([60])) == []
    ix.upsert(rows(4, 4))
    assert ids(ix.read()) == [4]


def test_ingest_counts_every_batch_once(spark, tmp_path):
    """Killed before a batch is published, killed after it and before the stream knows, and with another writer between: index and totals are those of one run over all files."""
    import os

    from docloom.streaming import ingest

    encoder, ix = HashingEncoder(16), index.VectorIndex(spark, f"file://{tmp_path}/ix", buckets=4)
    page = lambda p, n: {"product_id": p, "page_start": n, "page_end": n, "topic_title": f"Title {n}", "topic_body": f"What the {p} does on page {n}, in a few words.", "section_title": "", "section_body": "", "subheader_title": "", "subheader_body": "", "footnotes": [], "hints": [f"hint {n}"], "related_topics": []}
    os.makedirs(f"{tmp_path}/in")
    for i, p in enumerate(("X1", "X2", "X3", "X4")):
        with open(f"{tmp_path}/in/{p}.json", "w") as f:
            json.dump([page(p, n) for n in range(3 + i)], f)

    def run():
        q = ingest.ingest_stream(ingest.hierarchical_files(spark, f"{tmp_path}/in", 1), ix, encoder, f"{tmp_path}/cp")
        q.awaitTermination()

    publish, calls = ix._publish, []

    def fragile(*a, **b):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("killed before")
        out = publish(*a, **b)
        if len(calls) == 4:
            raise OSError("killed after")
        return out

    ix._publish = fragile
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            run()
    index.VectorIndex(spark, f"file://{tmp_path}/ix").upsert(ix.read().limit(1))  # another writer; what the stream told stays known
    ix._publish = publish
    run()
    run()
    whole = chunk.semantic_chunks(files.read_hierarchical(spark, f"{tmp_path}/in/*.json"))
    assert sorted(r.id for r in ix.read().collect()) == sorted(r.id for r in whole.collect()) and ix.read().count() == 18
    assert ingest.totals(ix) == {"last": 3, "batches": 4, "products": 4, "chunks": 18, "vectors": 18}


def test_a_topic_search_reads_few_row_groups(spark, tmp_path):
    """40,000 rows, a third of one product, in eight files: a topic's rows come from a few of the row groups, and a section's by its Bloom filter; the answers are those of the whole table."""
    product = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("P"), (F.col("id") % 40).cast("string")))
    topic, section = F.concat(F.lit("topic "), F.lpad((F.col("id") % 997).cast("string"), 3, "0")), F.concat(F.lit("section "), F.md5(F.floor(F.col("id") / 40).cast("string")))
    rows = spark.range(40_000).select("id", F.struct(product.alias("product_id"), topic.alias("topic_title"), section.alias("section_title"), F.md5(F.col("id").cast("string")).alias("content")).alias("metadata"))
    layout.write_clustered(rows, f"{tmp_path}/t", row_group=1 << 17, partitions=8)
    written, meta = spark.read.parquet(f"{tmp_path}/t"), lambda c: F.col(f"metadata.{c}")
    either = lambda t: {"$or": [{"topic_title": t}, {"section_title": t}]}
    name = rows.where("id = 12345").head().metadata
    for spec in ({"$and": [{"product_id": name.product_id}, either(name.topic_title)]}, {"$and": [{"product_id": "hot"}, either(name.section_title)]}, {"product_id": "P7"}):
        found = written.where(search.compile_filter(spec, meta)).select("id")
        assert sorted(r.id for r in found.collect()) == sorted(r.id for r in rows.where(search.compile_filter(spec, meta)).collect()) != []
        assert layout.rows_scanned(written.where(search.compile_filter(spec, meta)).select("id")) <= 40_000 // 4, spec
    assert layout.rows_scanned(written.select("id", "metadata.topic_title")) == 40_000


def test_catalogue_follows_random_writes(spark, tmp_path):
    """After each of several random upserts and deletions the partial counts say what a pass over all rows says."""
    import random

    rnd = random.Random(8)
    shape = "id long, metadata struct<product_id:string,topic_title:string,section_title:string,page_start:int,page_end:int>"
    row = lambda i: (i, (rnd.choice(["A", "B", None]), rnd.choice(["T1", " ", "", None, "T2 "]), rnd.choice(["S", ""]), rnd.choice([None, 1, 2, 5]), rnd.choice([None, 3, 5])))
    ix = index.CataloguedIndex(spark, f"file://{tmp_path}/ix", buckets=4)
    ix.replace(spark.createDataFrame([row(i) for i in range(60)], shape))
    known = spark.createDataFrame([("A",), ("B",), ("C",)], "product_id string")
    for step in range(3):
        if step:
            ix.upsert(spark.createDataFrame([row(rnd.randrange(90)) for _ in range(3)], shape))
            ix.delete(spark.createDataFrame([(rnd.randrange(90),) for _ in range(5)], "id long"))
        rows = ix.read().select("id", "metadata.*").withColumn("chunk_no", F.col("id"))
        for kind in ("topic_body", "section_body", "subheader_title", "subheader_body"):
            rows = rows.withColumn(kind, F.lit(""))
        assert sorted(ix.entity_counts(known).collect()) == sorted(catalog.entity_counts(known, rows.select("product_id"), "product_id").collect())
        assert ix.topics().collect() == catalog.topics(rows).collect() and ix.topics("A").collect() == catalog.topics(rows, "A").collect()
        got, want = ix.coverage().head(), quality.quality_metrics(rows).head()
        assert (got.total_chunks, got.page_coverage) == (want.total_chunks, want.page_coverage)
    kept = ix.topics().collect()
    ix.vacuum()
    assert ix.topics().collect() == kept


def test_filter_language(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2) for i in range(12)], "i int, a int, b int")
    ids = lambda spec: sorted(r.i for r in df.where(search.compile_filter(spec)).collect())
    assert search.compile_filter(None) is None and search.compile_filter({}) is None
    assert ids({"a": 1, "b": 0}) == [4, 10]
    assert ids({"$or": [{"a": 0}, {"$and": [{"a": 1}, {"b": {"$eq": 1}}]}]}) == [0, 1, 3, 6, 7, 9]
    assert ids({"i": {"$in": [2, 5]}}) == [2, 5]


@pytest.fixture(scope="module")
def engine(spark):
    enc = HashingEncoder(64)
    rows = [("1", "zoom lens setting", "X", "Zoom", ""), ("2", "battery charge", "X", "", "Zoom"), ("3", "zoom ring", "PXW-Z200, HXR-NX800", " ", "S"), ("4", "menu", "Y", "Menu", "")]
    d = spark.createDataFrame(rows, "id string, content string, product_id string, topic_title string, section_title string")
    d = d.select("id", F.struct("product_id", F.lit("u").alias("help_guide_url"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), "topic_title", "section_title", F.lit("").alias("subheader_title"),
                 F.array(F.lit("h"), F.lit("")).alias("hints"), F.array().cast("array<string>").alias("related_topics"), F.lit(None).cast("array<string>").alias("footnotes")).alias("metadata"), "content")
    return search.SearchEngine(index.vector_records(encode(d, enc)), enc, products=("X", "Y", "Z"))


def test_search_tools(engine):
    found = engine.search("zoom lens setting", 2).collect()
    assert found[0].id == "1" and abs(found[0].score - 1) < 1e-6 and found[0].metadata.hints == ["h"] and found[0].metadata.footnotes == []
    assert [r.id for r in engine.search_product("hxr-nx800", "zoom").collect()] == ["3"]
    assert sorted(r.id for r in engine.search_topic("Zoom").collect()) == ["1", "2"]
    assert [r.id for r in engine.search_topic("Menu", product="X").collect()] == []
    assert {(r.compared, r.id) for r in engine.compare("X", "Y", "zoom", 1).collect()} == {("X", "1"), ("Y", "4")}
    assert [(r.product_id, r.chunk_count) for r in engine.list_products().collect()] == [("X", 2), ("Y", 1), ("Z", 0)]
    assert [r.topic for r in engine.list_topics().collect()] == ["Menu", "Zoom"]  # the blank topic vanishes
    s = engine.stats().head()
    assert s.total_chunks == 4 and s.chunks_per_product == {"X": 2, "Y": 1, "Z": 0}
    answer = json.loads(engine.to_json(engine.search("zoom", 3), query="zoom").head().json)
    assert answer["query"] == "zoom" and [r["rank"] for r in answer["results"]] == [1, 2, 3]
    assert self_test(engine.encoder)


def test_catalog_cap(spark):
    known = spark.createDataFrame([("a",), ("b",)], "k string")
    rows = spark.createDataFrame([("a",)] * 5, "k string")
    assert {r.k: r.chunk_count for r in catalog.entity_counts(known, rows, "k", 3).collect()} == {"a": 3, "b": 0}


CHUNK = "chunk_no int, page_start int, page_end int, topic_title string, topic_body string, section_title string, section_body string, subheader_title string, subheader_body string"


def test_quality_gate(spark):
    none = quality.quality_metrics(spark.createDataFrame([], CHUNK)).head()
    assert (none.total_chunks, none.incomplete_percentage, none.quality_pass, none.page_coverage) == (0, 0.0, True, 0)
    row = lambda i, **k: tuple({"chunk_no": i, "page_start": i, "page_end": i + 1, "topic_title": "t", "topic_body": "", "section_title": "", "section_body": "", "subheader_title": "", "subheader_body": "", **k}.values())
    rows = [row(i, topic_body="body") for i in range(19)] + [row(19)]
    m = quality.quality_metrics(spark.createDataFrame(rows, CHUNK)).head()
    assert m.incomplete_chunks == 1 and m.incomplete_percentage == 5.0 and not m.quality_pass and m.page_coverage == 21
    blank = quality.quality_metrics(spark.createDataFrame([row(0, subheader_body="  ", section_body="full")], CHUNK)).head()
    assert blank.incomplete_chunks == 0 and blank.avg_body_length == 0.0
    df = spark.createDataFrame(rows, CHUNK)
    assert [r.chunk_no for r in quality.first_samples(df, "incomplete").collect()] == [19]
    one, two = (quality.random_sample(df, 5, 3).collect() for _ in range(2))
    assert one == two and len(one) == 5 and quality.random_sample(df, 50).count() == 20
    assert quality.report(df).count() == 1 and not quality.passes(df)


def test_admission(spark):
    import random

    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.randint(0, 400) * 250_000) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, k string, us long").withColumn("ts", F.timestamp_micros("us"))
    burst, minute = (2, 1_000_000), (20, 60_000_000)
    got = {r.id: (r.allowed, r.retry_after) for r in ratelimit.admit(df, "k", "ts", "id", burst, minute).collect()}
    second, long = {}, {}
    for i, k, us in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        s = second[k] = [us, 1] if k not in second or us >= second[k][0] + 1_000_000 else [second[k][0], second[k][1] + 1]
        if s[1] > 2:
            assert got[i] == (False, 1)
            continue
        m = long[k] = [us, 1] if k not in long or us >= long[k][0] + 60_000_000 else [long[k][0], long[k][1] + 1]
        assert got[i][0] == (m[1] <= 20), i
    assert {r.limit_type for r in ratelimit.denial(ratelimit.admit(df, "k", "ts", "id", burst, minute)).collect()} <= {"per-second burst", "per-minute"}


def test_streaming_admission_equals_batch(spark, tmp_path):
    from docloom.streaming.ratelimit import admit_stream

    df = spark.createDataFrame([(i, "ab"[i % 2], i * 100_000) for i in range(300)], "id long, k string, us long").withColumn("ts", F.when(F.col("id") % 50 != 7, F.timestamp_micros("us")))  # some without a time
    for part in range(3):
        df.where((F.col("id") >= part * 100) & (F.col("id") < part * 100 + 100)).coalesce(1).write.parquet(f"{tmp_path}/in/part{part}")
    limits = dict(burst=(3, 1_000_000), minute=(25, 10_000_000))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else processing-time timeouts ask for batches without end
    stream = admit_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"), "k", "ts", "id", **limits)
    q = stream.writeStream.format("memory").queryName("admitted").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = sorted(tuple(r) for r in ratelimit.admit(df, "k", "ts", "id", **limits).collect())
    assert sorted(tuple(r) for r in spark.table("admitted").collect()) == want


def test_stale_connections_are_evicted(spark, tmp_path):
    """Late, repeated and unordered beats, a beat that joins two sessions, and a restart from the checkpoint between all batches; as the rule says for all beats at once."""
    from docloom.streaming.ratelimit import stale_connections

    batches = [
        [("a", 0), ("a", 4), ("b", 1), ("c", 2), (None, 3), ("d", 0)],
        [("a", 14), ("a", 4), ("b", 12), ("d", 16)],  # a: exactly ten seconds on, and a repeat; b: eleven, so another session
        [("d", 9), ("c", 26), ("e", None)],  # d: a late beat joins 0 and 16
        [("z", 300)],  # all others are behind the watermark
        [("a", 20), ("z", 301)],  # too late: left out
        [("z", 900)],
    ]
    schema = "connection string, ts timestamp"
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")  # a watermark that has moved may end sessions in a batch without rows
    seen = []
    for n, batch in enumerate(batches):
        rows = spark.createDataFrame([(c, t) for c, t in batch], "connection string, s long").select("connection", F.timestamp_micros((F.col("s") + 1000) * 1_000_000).alias("ts"))
        rows.coalesce(1).write.parquet(f"{tmp_path}/in/part{n}")
        stream = stale_connections(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"), 10, "30 seconds")
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination()
        found = spark.read.parquet(f"{tmp_path}/out")
        seen.append(found.count())
    got = sorted((r.connection or "", r.o, r.e, r.beats) for r in found.select("connection", F.unix_micros("opened").alias("o"), F.unix_micros("evicted").alias("e"), "beats").collect())
    second = 1_000_000
    want = [("", 3, 13, 1), ("a", 0, 24, 4), ("b", 1, 11, 1), ("b", 12, 22, 1), ("c", 2, 12, 1), ("c", 26, 36, 1), ("d", 0, 26, 3), ("z", 300, 311, 2)]
    assert got == [(c, (1000 + o) * second, (1000 + e) * second, n) for c, o, e, n in want]
    assert seen[0] == 0 and seen[3] == 7  # nothing goes before the watermark has passed it


def test_admission_of_a_hot_key(spark):
    """Bursts, quiet spells and ties, one key with most requests and a null key: each decision is that of counters that see the requests one by one."""
    import random

    rnd, rows, now = random.Random(6), [], 0
    for i in range(4000):
        now += rnd.choice([0, 0, 1, 30, 1000, 30_000]) if rnd.random() < 0.995 else rnd.choice([400_000, 5_000_000, 900_000_000])
        rows.append(("hot", now, i))
    rows += [(k, rnd.randrange(4_000_000), 10_000 + i) for i, k in enumerate(["cold", "cool", None] * 200)]
    burst, minute = (5, 50_000), (40, 1_000_000)
    df = spark.createDataFrame(rows, "k string, us long, id long").select("k", F.timestamp_micros("us").alias("ts"), "id").repartition(6)
    got = {r["id"]: (r["rate_key"], r["allowed"], r["retry_after"], r["remaining"]) for r in ratelimit.admit(df, "k", "ts", "id", burst, minute).collect()}
    counters, want = {}, {}
    for k, us, i in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = (k, *counters.setdefault(k, ratelimit.Counters(burst, minute)).hit(us))
    assert got == want and {v[1] for v in want.values()} == {True, False} and {v[2] for v in want.values()} >= {0, 1}
    plan = ratelimit.admit(df, "k", "ts", "id", burst, minute)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    none = spark.createDataFrame([], "k string, ts timestamp, id long")
    assert ratelimit.admit(none, "k", "ts", "id").collect() == []


@pytest.mark.parametrize("gap", [0, 3, 2_000])
def test_window_starts_by_halving_blocks(spark, monkeypatch, gap):
    """A key with thousands of windows, some of them with nothing in the bucket after, and short keys: the tables of exits halve from one to the next, so all that is written stays near twice the times."""
    import random

    rnd, rows, now, length = random.Random(7), [], -20_000, 50
    for i in range(30_000):
        now += rnd.randrange(11) + (rnd.randrange(gap * length) if gap and i % 97 == 0 else 0)
        rows.append(("hot", now))
    rows += [(k, rnd.choice([0, 49, 50, 51, 100, 149, 10_000_000])) for k in ["x", "y", None] for _ in range(4)]
    many, write = [], ratelimit.written
    monkeypatch.setattr(ratelimit, "written", lambda df, name: many.append((name, (out := write(df, name)).count())) or out)
    got = sorted((r.k or "", r.start) for r in ratelimit.window_starts(spark.createDataFrame(rows, "k string, us long"), length).collect())
    want, last = [], {}
    for k, us in sorted((k or "", us) for k, us in rows):
        if k not in last or us >= last[k] + length:
            last[k] = us
            want.append((k, us))
    assert got == want and len(got) > 2_500
    times = dict(many)["times"]
    assert sum(n for name, n in many if name != "times") < 2.6 * times


def test_routes_and_keys(spark):
    rows = [("/health", "GET", False), ("/sse", "POST", False), ("/mcp", "GET", False), ("/mcp/x", "POST", True), ("/", "GET", True), ("/other", "POST", False)]
    df = spark.createDataFrame(rows, "p string, m string, want boolean")
    assert df.where(ratelimit.limited(F.col("p"), F.col("m")) != F.col("want")).isEmpty()
    ips = spark.createDataFrame([(" 1.1.1.1 , 2", "3", "4", "1.1.1.1"), ("", "3", "4", "3"), (None, None, "4", "4"), (None, "", None, "unknown")], "f string, r string, c string, want string")
    assert ips.where(T.client_ip(F.col("f"), F.col("r"), F.col("c")) != F.col("want")).isEmpty()


PAGE = r"""<html><head><title> T </title><meta name="keywords" content="k1,k2"></head><body><nav><a href="n.html">no</a></nav><div role="main"><h1>Head</h1><div><p>Para <b>one</b></p></div>
<p>x</p><a href="a\b.html">l</a><a href="http://h/x.html">l</a><a href="y.html#f">l</a><a href="a\b.html">l</a><img src="i.png"><img src="j.png" alt="J"></div><p>outside</p></body></html>"""


def test_html_records(spark):
    df = spark.createDataFrame([("u", PAGE), ("v", "<p>no body</p>"), ("w", None), ("z", "<body><p>ok</p></body>")], "url string, html string")
    got = {r.url: r for r in html.parse_pages(df).collect()}
    assert set(got) == {"u", "z"}
    u = got["u"]
    assert (u.title, u.metadata.keywords, u.manual_number) == ("T", "k1,k2", "") and u.content == "Head\nParaone\nParaone"
    assert u.internal_links == ["a/b.html"] and [tuple(i) for i in u.images] == [("i.png", ""), ("j.png", "J")]
    assert got["z"].title == "Untitled"


def test_new_keys_do_not_write_a_table_again(spark, tmp_path, monkeypatch):
    """Writes of new keys cost what they bring, replaced and deleted keys count as before, and buckets of many folders are made one again."""
    t = index.VectorIndex(spark, f"file://{tmp_path}/t", buckets=2)
    rows = lambda ids, v: spark.createDataFrame([(f"k{i}", v) for i in ids], "id string, v int")
    t.replace(rows(range(20_000), 0))
    first = t.manifest()["bytes_written"]
    costs = [t.upsert(rows(range(20_000 + 100 * i, 20_100 + 100 * i), i))["bytes_written"] for i in range(3)]
    assert max(costs) < first / 5 and t.read().count() == 20_300
    t.upsert(rows([5, 20_050, 30_000], 9))
    t.delete(rows([20_150], 0))
    want = {f"k{i}": 0 for i in range(20_000)} | {f"k{20_000 + i}": i // 100 for i in range(300)} | {"k5": 9, "k20050": 9, "k30000": 9}
    want.pop("k20150")
    assert {r.id: r.v for r in t.read().collect()} == want and t.read().count() == len(want)
    monkeypatch.setattr(buckets, "PARTS", 2)
    for i in range(3):
        t.upsert(rows(range(40_000 + 50 * i, 40_050 + 50 * i), 1))
    assert all(isinstance(f, str) or len(f) <= 2 for f in t.manifest()["folders"].values()) and t.read().count() == len(want) + 150
    t.vacuum()
    assert t.read().count() == len(want) + 150


def test_records_and_vectors_leave_tasks_in_slices(spark, monkeypatch):
    """A batch of 1,000 rows in, never 1,000 records or vectors at once out."""
    taken, texts = {}, pd.DataFrame({"url": [f"u{i}" for i in range(1000)], "html": ["<body><p>ok</p></body>"] * 1000})
    df = spark.createDataFrame([("u", "a b")], "url string, html string")
    real_map, real_udf = type(df).mapInPandas, F.pandas_udf
    monkeypatch.setattr(type(df), "mapInPandas", lambda rows, run, shape: taken.update(pages=run) or real_map(rows, run, shape))
    monkeypatch.setattr(F, "pandas_udf", lambda run, kind: taken.update(vectors=run) or real_udf(run, kind))
    html.parse_pages(df)
    encode(df, HashingEncoder(8), text="html")
    for out in ([len(x) for x in taken["pages"](iter([texts]))], [len(x) for x in taken["vectors"](iter([texts["html"]]))]):
        assert sum(out) == 1000 and max(out) <= 256


def test_crawl(spark, tmp_path):
    site = {"http://h/a/index.html": ["p.html", "q.html"], "http://h/a/p.html": ["q.html", "index.html", "gone.html"], "http://h/a/q.html": []}
    pages = spark.createDataFrame([(u, "<body>" + "".join(f'<a href="{x}">l</a>' for x in links) + "<p>text</p></body>") for u, links in site.items()], "url string, html string")
    seeds = spark.createDataFrame([("http://h/a/index.html",)], "url string")
    got, visited = crawl.crawl(seeds, lambda urls: urls.join(pages, "url", "left"), f"file://{tmp_path}")
    assert sorted(r.url for r in got.select("url").collect()) == sorted(site)
    s = crawl.scrape_summary(got, visited).head()
    assert (s.pages_scraped, s.pages_failed) == (3, 1) and s.total_size_bytes > 0


def test_downloads(spark, tmp_path):
    rows = [("a", '<a href="x.html">Print</a><a href="g/b.PDF">b</a>', "http://h/d/g/b.PDF"), ("b", '<a href="c.pdf?x">Download the PDF</a>', "http://h/d/c.pdf?x"), ("c", '<div class="pdf"><a href="d.pdf#1">z</a></div>', "http://h/d/d.pdf#1"), ("d", "<p>none</p>", None)]
    df = spark.createDataFrame([(f"http://h/d/{k}", h, w) for k, h, w in rows], "url string, html string, want string")
    assert download.pdf_link(df).where(~F.col("pdf_url").eqNullSafe(F.col("want"))).isEmpty()
    probes = download.probe_candidates(spark.createDataFrame([("http://h/ilc/1/v1/en/x.html",)], "url string")).orderBy("place")
    assert [r.candidate for r in probes.collect()] == ["http://h/ilc/1/v1/helpguide.pdf", "http://h/ilc/1/v1/print.html"]

    def opener(url):
        import io

        if url == "bad":
            raise OSError("refused")
        return io.BytesIO(b"%PDF-1" if url == "good" else b"")

    targets = spark.createDataFrame([("m1", "g", "good"), ("m2", "g", "empty"), ("m3", "g", "bad"), ("m4", "g", None)], "model string, help_guide_url string, pdf_url string")
    rec = {r.model: r for r in download.download(targets, f"file://{tmp_path}/pdf", opener).collect()}
    assert rec["m1"].success and rec["m1"].file_size_bytes == 6 and [rec[m].error for m in ("m2", "m3", "m4")] == ["empty file", "refused", "no PDF link"]
    seen = download.verify_files(spark.read.format("binaryFile").load(f"file://{tmp_path}/pdf")).collect()
    assert len(seen) == 1 and seen[0].is_pdf


def test_sources(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("Instructions: x\nExample y\n\nA1 (Ver. 2)\nhttp://1\nhttp://lost\nB1/B2\nhttp://2\nC1, C2\nhttp://3\nD1\nE1\nhttp://4\nA1\nhttp://5\n")
    got = {r.model: r.url for r in files.url_map_file(spark, f"file://{tmp_path}/urls.txt").collect()}
    assert got == {"A1": "http://5", "B1": "http://2", "C1": "http://3", "E1": "http://4"}
    assert "C1, C2" in {r.model for r in files.url_map_file(spark, f"file://{tmp_path}/urls.txt", split_commas=False).collect()}
    (tmp_path / "h.json").write_text(json.dumps([{"product_id": "X", "page_start": 1, "page_end": 1, "hints": ["h"], "extra": 1}, {"product_id": "X", "page_start": 2, "page_end": 2}]))
    rows = files.read_hierarchical(spark, f"file://{tmp_path}/h.json").orderBy("chunk_no").collect()
    assert [(r.chunk_no, r.page_start, r.hints) for r in rows] == [(0, 1, ["h"]), (1, 2, None)]
    (tmp_path / "c.yaml").write_text("v:\n  '1':\n    parsers:\n      - {name: p, script: s, args: ['--x', 1]}\n    chunker: {script: c, output: o}\n    embedder: {script: e, index: i}\nsettings: {a: 1}\n")
    c = files.read_config(spark, f"file://{tmp_path}/c.yaml").head()
    assert (c.variant, c.version, c.parsers[0].args, c.embedder["index"]) == ("v", "1", ["--x", "1"], "i")
    (tmp_path / "m.pdf").write_bytes(b"ab")
    g = files.read_pdfs(spark, f"file://{tmp_path}/m.pdf", lambda data: [(1, i, 1.0, "F", 9.0, chr(c)) for i, c in enumerate(data)]).orderBy("glyph_no").collect()
    assert [(r.product_id, r.text) for r in g] == [("m", "a"), ("m", "b")]


def hierarchical(spark):
    row = lambda p, n, title, body: (p, "", 1, 1, title, body, "", "", "", "", [], ["Näh"], [], n)
    rows = [row("a", 0, "Title", "A body that is long enough to be kept as a chunk"), row("a", 1, "Titel ü", "Another body that is long enough to be kept"), row(None, None, None, None), row("12", 0, "", "")]
    return spark.createDataFrame(rows, f"{files.HIERARCHICAL}, chunk_no int")


def test_json_sinks_come_back(spark, tmp_path):
    """K1, K2: every row, nulls and names that look like numbers included; an empty table has no rows."""
    df = hierarchical(spark)
    assert files.write_hierarchical(df.withColumn("orphan", F.lit(True)), f"{tmp_path}/h") == 4
    back = files.read_hierarchical_lines(spark, f"{tmp_path}/h")
    key = lambda r: str(r)
    assert sorted(back.select(df.columns).collect(), key=key) == sorted(df.collect(), key=key)
    assert files.write_hierarchical(df.limit(0), f"{tmp_path}/none") == 0
    assert files.read_hierarchical_lines(spark, f"{tmp_path}/none").isEmpty()
    chunks = chunk.semantic_chunks(df)
    n = chunks.count()
    assert n >= 2 and files.write_semantic(chunks, f"{tmp_path}/s") == n
    back = files.read_semantic(spark, f"{tmp_path}/s", lines=True)
    assert {(r.id, r.content, r.metadata.topic_title) for r in back.collect()} == {(r.id, r.content, r.metadata.topic_title) for r in chunks.collect()}
    with pytest.raises(ValueError):
        files.read_semantic(spark, f"{tmp_path}/none", lines=True)


def test_embed_chunks(spark, tmp_path):
    """V2: encode, project and merge in one call; a second call with the same chunks adds nothing."""
    from docloom.plans.pipeline import embed_chunks

    chunks, table = chunk.semantic_chunks(hierarchical(spark)), index.VectorIndex(spark, f"{tmp_path}/v")
    n = chunks.select("id").distinct().count()
    assert embed_chunks(chunks, HashingEncoder(16), table) == n
    assert embed_chunks(chunks, HashingEncoder(16), table) == n
    rows = table.read().collect()
    assert len(rows) == n and all(len(r.embedding) == 16 and r.metadata.hints == ["Näh"] and r.metadata.related_topics is None and r.metadata.content for r in rows)


def test_admission_fails_open(spark):
    """Requests without a time pass and are not counted."""
    rows = [("k", None, i) for i in range(5)] + [("k", "2024-01-01 00:00:00", 5 + i) for i in range(3)] + [(None, None, 9)]
    df = spark.createDataFrame(rows, "k string, ts string, id long").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.id: (r.allowed, r.retry_after, r.remaining) for r in ratelimit.admit(df, "k", "ts", "id", burst=(2, 1_000_000), minute=(9, 60_000_000)).collect()}
    assert got == {**{i: (True, 0, 9) for i in (0, 1, 2, 3, 4, 9)}, 5: (True, 0, 8), 6: (True, 0, 7), 7: (False, 1, 7)}


def test_requests_to_a_host_keep_their_pauses(spark):
    """A host's pages come from one task, a failure is null."""
    def opener(url, timeout):
        import io
        import time
        from email.message import Message

        if url.endswith("bad"):
            raise OSError("gone")
        out = io.BytesIO(str(time.time()).encode())
        out.headers = Message()
        return out

    urls = [f"http://{h}/{i}" for h in "ab" for i in range(4)] + ["http://a/bad"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").repartition(4)
    got = {r.url: r.html for r in crawl.fetch_http(df, pause=0.05, opener=opener).collect()}
    assert set(got) == set(urls) and got["http://a/bad"] is None
    for h in "ab":
        times = sorted(float(got[f"http://{h}/{i}"]) for i in range(4))
        assert all(y - x >= 0.045 for x, y in zip(times, times[1:]))


def test_settings(spark, monkeypatch):
    """Session, then environment, then default; what is missing is named."""
    monkeypatch.setenv("DOCLOOM_INDEX", "from-env")
    spark.conf.set("spark.docloom.space", "from-session")
    assert files.settings(spark, ("index", "space"), stage="prod") == {"index": "from-env", "space": "from-session", "stage": "prod"}
    with pytest.raises(ValueError, match="key"):
        files.settings(spark, ("key",))
    spark.conf.unset("spark.docloom.space")


def test_command_line(spark, tmp_path, capsys):
    """A file to chunks, and the number of files; every option is required."""
    from docloom.__main__ import main

    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    text = ["A title of a page", "A body line that is long enough to be kept"]

    def decoder(data):
        for i, t in enumerate(text):
            yield 1, i, 10.0 * i, "Face-Bold" if i == 0 else "Face", 12.7 if i == 0 else 9.7, t

    out = f"{tmp_path}/out"
    assert main(["parse", "--pdf", f"{tmp_path}/*.pdf", "--model", "M1", "--url", "http://x/", "--output", out], decoder) == 0
    back = files.read_hierarchical_lines(spark, out).collect()
    assert back and {(r.product_id, r.web_help_guide_url) for r in back} == {("M1", "http://x/")} and back[0].topic_title == text[0]
    assert f"{len(back)} chunks" in capsys.readouterr().out
    assert main(["count", "--output", out]) == 0
    import glob

    assert int(capsys.readouterr().out) == len(glob.glob(f"{out}/*.json"))
    with pytest.raises(SystemExit):
        main(["parse", "--pdf", "x", "--model", "M1", "--url", "u"])


def test_pages_of_one_name_are_settled(spark, tmp_path):
    """K6: of the pages of one file name that of the greatest URL stays."""
    df = spark.createDataFrame([("b", f"http://x/{d}/p.html", d) for d in ("m", "z", "a")], "base string, url string, title string")
    name = df.select(T.url_filename(F.col("url")).alias("n")).distinct().count()
    crawl.write_pages(df, f"{tmp_path}/p")
    left = [r.title for r in spark.read.json(f"{tmp_path}/p").collect()]
    assert len(left) == name and "z" in left
