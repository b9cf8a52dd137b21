"""Operator 12: how far a language's sources diverge from each other, by systolic rotation of their term vectors.

Terms are runs of letters (all that is not ASCII, and A-Z lower-cased). A language keeps the terms that at least MIN_DOCUMENTS of its documents hold.
A group is a source within a language; a kept term's share of it is p = 1 + floor(SCALE * (count + 1) / (N + V)), and the divergence of
a group from another is the sum of floor((p - q)^2 / q) over all kept terms, the ones that neither holds included.

Kept terms are dealt into shards of about SHARD terms by hash, so a group's vector is a block for each shard: the numbers of the terms that
it holds, as differences, and their counts, zlib-packed. Blocks of a group stay where they are (hash-partitioned by group and shard, kept on disk, and
made anew from their written table where an executor is lost). In each round of a round-robin tournament every group meets one other: half of the blocks travel
to the partition of the group they meet, and both directions are worked out at once, each from the counts of the two and four numbers (N and V).
So every pair meets exactly once, what moves in a round is at most half of the packed vectors, and a task holds two blocks at a time. ROUNDS rounds are one
job, written to the shared folder. Sums over shards are small rows.

The terms that a group holds more than its language does are ranked by a heap for each block, at most `top` terms; the blocks' heaps of a group are merged by a window.

All arithmetic is in integers. Results of the tournament are as many as there are ordered pairs of sources of a language, which is what is asked for.

Defined results: null text, lang and source are read as ''; a group without kept terms meets all others with count 0; a language without kept
terms has divergence 0 between all its sources; a language with one source has no pairs; repeated rows count again; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import new_path, release, trimmed, utf8, written

SCALE = 1_000_000_000
MIN_DOCUMENTS = 3
TOP = 200
SHARD = 1 << 16
ROUNDS = 8
_HELD = 400_000
_WIDE = (1 << 63) // SCALE - 1
#: Every byte of a term as it is, A-Z as a-z, all else a space; a text's terms are the parts between spaces.
_TERMS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_PIECE = 1 << 20
_GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def term_slices(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in slices of a long one cut between terms."""
    data, lo = utf8(text), 0
    while lo < len(data):
        cut = _GAP.search(data, lo + _PIECE) if len(data) - lo > _PIECE else None
        hi = cut.start() if cut else len(data)
        yield data[lo:hi].translate(_TERMS).split()
        lo = hi


def shares(counts: np.ndarray, whole: int, kept: int) -> np.ndarray:
    """p of each count, in integers; Python's where 64 bits do not hold the product."""
    if max(whole + kept, int(counts.max(initial=0)) + 1) > _WIDE:
        return np.array([1 + SCALE * (int(c) + 1) // (whole + kept) for c in counts], np.int64)
    return 1 + SCALE * (counts.astype(np.int64) + 1) // (whole + kept)


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def pack(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending term numbers as differences, and their counts."""
    return zlib.compress(np.diff(places, prepend=0).astype("<u4").tobytes() + counts.astype("<u8").tobytes(), 1)


def unpack(block: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if block is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = zlib.decompress(block)
    n = len(data) // 12
    return np.cumsum(np.frombuffer(data, "<u4", n).astype(np.int64)), np.frombuffer(data, "<u8", n, 4 * n).astype(np.int64)


def meet(one: tuple[bytes | None, int], two: tuple[bytes | None, int], kept: int, here: int) -> tuple[int, int]:
    """The two groups' divergences from each other over the `here` terms of a shard; a group is its block and N, kept is V."""
    (i, c), (j, d) = unpack(one[0]), unpack(two[0])
    either = np.union1d(i, j)
    a, b = np.zeros(len(either) + 1, np.int64), np.zeros(len(either) + 1, np.int64)
    a[np.searchsorted(either, i)], b[np.searchsorted(either, j)] = c, d
    p, q = shares(a, one[1], kept), shares(b, two[1], kept)  # the last one stands for all terms that neither holds
    times = np.ones(len(p), np.int64)
    times[-1] = here - len(either)
    return int((excess(p, q) * times).sum()), int((excess(q, p) * times).sum())


# ---- counts and blocks ----------------------------------------------------------------------------------------------------------


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it). A task adds up what it reads and sends at most a row for each group and term of _HELD."""

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, list[int]]] = defaultdict(dict)
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in held.items():
                names, values = list(terms), list(terms.values())
                for lo in range(0, len(names), 50_000):
                    part = values[lo : lo + 50_000]
                    k = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * k), pa.array([source] * k), pa.array([t.decode("utf-8", "replace") for t in names[lo : lo + k]]), pa.array([v[0] for v in part], pa.int64()), pa.array([v[1] for v in part], pa.int64())],
                        ["lang", "source", "term", "n", "docs"],
                    )
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(k) for k in range(3))):
                own = held[lang.as_py(), source.as_py()]
                before, seen, once = len(own), {}, set()
                for terms in term_slices(text.as_py()):
                    for t in terms:
                        seen[t] = seen.get(t, 0) + 1
                    if len(seen) > _HELD:  # a text of very many terms goes on in parts; which it has had is kept
                        for t, n in seen.items():
                            v = own.setdefault(t, [0, 0])
                            v[0] += n
                            v[1] += t not in once
                        once.update(seen)
                        seen = {}
                for t, n in seen.items():
                    v = own.get(t)
                    if v is None:
                        own[t] = [n, int(t not in once)]
                    else:
                        v[0] += n
                        v[1] += t not in once
                size += len(own) - before
                if size >= _HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    rows = _texts(docs).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    # dealt by language and term, both sums come without another shuffle
    return rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class Audit:
    """The written tables: counts of kept terms, groups, and blocks."""

    def __init__(self, docs: DataFrame, least: int = MIN_DOCUMENTS, shard: int = SHARD):
        raw = written(term_counts(docs), "counts")
        words = raw.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole")).where(F.col("docs") >= least).drop("docs")
        words = written(words, "terms")
        langs = words.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("whole").alias("lang_total"))
        self.langs = written(langs.withColumn("shards", F.ceil(F.col("kept") / shard).cast("int")), "langs")
        # terms are numbered inside a shard, of about `shard` terms each
        numbered = words.join(self.langs.select("lang", "shards"), "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"))
        numbered = numbered.withColumn("place", F.row_number().over(Window.partitionBy("lang", "shard").orderBy("term")) - 1)
        self.sizes = written(numbered.groupBy("lang", "shard").agg(F.count("*").alias("here")), "shards")
        self.terms = written(raw.drop("docs").join(numbered.drop("shards"), ["lang", "term"]), "kept")
        release(raw)
        totals = self.terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        every = _texts(docs).groupBy("lang", "source").agg(F.lit(0).cast("bigint").alias("total")).unionByName(totals)
        g = every.groupBy("lang", "source").agg(F.max("total").alias("total")).join(self.langs, "lang", "left")
        g = g.fillna(0, ["kept", "lang_total"]).fillna(1, ["shards"])
        here = Window.partitionBy("lang")
        g = g.withColumns({"number": F.row_number().over(here.orderBy("source")) - 1, "groups": F.count("*").over(here)})
        self.groups = written(g, "groups")

    def blocks(self, top: int = TOP) -> DataFrame:
        """One row for each group and shard: block (null if it holds none of the terms) and best, its terms of most excess over the language. Written.

        A task holds the terms of one block at a time."""
        rows = self.terms.join(self.groups.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"])

        def build(key: tuple, table: pa.Table) -> pa.Table:
            place = table.column("place").to_numpy()
            order = np.argsort(place)
            n, whole = table.column("n").to_numpy()[order], table.column("whole").to_numpy()[order]
            total, kept, lang_total = (table.column(c)[0].as_py() for c in ("total", "kept", "lang_total"))
            p, q = shares(n, total, kept), shares(whole, lang_total, kept)
            value, over = excess(p, q), np.flatnonzero(p > q)
            terms = table.column("term")
            if len(over) > top:
                least = np.partition(value[over], len(over) - top)[len(over) - top]
                over = over[value[over] >= least]  # ties at the end are settled by the heap
            named = ((-int(value[i]), terms[int(order[i])].as_py()) for i in over)
            best = [{"item": t, "value": -v} for v, t in heapq.nsmallest(top, named, key=lambda x: (x[0], utf8(x[1])))]
            kind = pa.list_(pa.struct([("item", pa.string()), ("value", pa.int64())]))
            return pa.table({"lang": [key[0].as_py()], "source": [key[1].as_py()], "shard": pa.array([key[2].as_py()], pa.int32()), "block": pa.array([pack(place[order], n)], pa.binary()), "best": pa.array([best], kind)})

        out = "lang string, source string, shard int, block binary, best array<struct<item:string,value:bigint>>"
        return written(rows.groupBy("lang", "source", "shard").applyInArrow(build, out), "blocks")


def seats(number, other_round, groups):
    """The opponent of a group in a round of a round-robin tournament by the circle method, as Columns: null where it rests.

    With an even number n of places the last stays and the others turn: in round r, x < n - 1 meets the y with x + y = r modulo n - 1, and the one that would meet itself
    meets the last."""
    n = groups + groups % 2
    turn = F.pmod(other_round - number, n - 1)
    fixed = F.expr("null").cast("int")
    # the last place's opponent: 2x = r modulo n - 1, and n - 1 is odd
    last = F.pmod(other_round * (n / 2).cast("bigint"), n - 1)
    y = F.when(number == n - 1, last).when(turn == number, n - 1).otherwise(turn)
    return F.when(y < groups, y).otherwise(fixed)


def tournament(groups: DataFrame, blocks: DataFrame, sizes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """lang, source, item, value: each group's divergence from every other group of its language."""
    spark = groups.sparkSession
    most = groups.agg(F.max("groups")).head()[0] or 0
    where = new_path(spark, "meetings")
    wide = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).join(blocks.select("lang", "source", "shard", "block"), ["lang", "source", "shard"], "left")
    wide = wide.join(sizes, ["lang", "shard"], "left").select("lang", "shard", "number", "groups", "source", "total", "kept", F.coalesce("here", F.lit(0)).alias("here"), "block")
    resident = written(wide, "resident").repartition("lang", "shard", "number").persist(StorageLevel.DISK_ONLY)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [meet((r["block"], r["total"]), (r["guest_block"], r["guest_total"]), r["kept"], r["here"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], ["lang", "source", "item", "there", "back"])

    for first in range(0, most - 1 + most % 2, rounds):
        turns = F.explode(F.sequence(F.lit(first), F.least(F.lit(first + rounds - 1), F.col("groups") + F.col("groups") % 2 - 2)))
        guests = resident.where(F.col("groups") + F.col("groups") % 2 - 2 >= first).withColumn("_round", turns).withColumn("host", seats(F.col("number"), F.col("_round"), F.col("groups")))
        # of each pair one travels: who does changes with the round, so that no group is always on its way
        lower = F.col("number") < F.col("host")
        guests = guests.where(F.when(F.col("_round") % 2 == 0, lower).otherwise(F.col("number") > F.col("host")))
        guests = guests.select("lang", "shard", F.col("host").cast("int").alias("number"), F.col("source").alias("item"), F.col("total").alias("guest_total"), F.col("block").alias("guest_block"))
        met = resident.join(guests, ["lang", "shard", "number"]).select("lang", "source", "item", "total", "kept", "here", "block", "guest_total", "guest_block")
        met.mapInArrow(both, "lang string, source string, item string, there long, back long").write.mode("append").parquet(where)
    resident.unpersist()
    if most < 2:
        return spark.createDataFrame([], "lang string, source string, item string, value long")
    met = spark.read.schema("lang string, source string, item string, there long, back long").parquet(where)
    flat = met.select("lang", F.explode(F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))).alias("m"))
    return flat.select("lang", "m.*").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))


def divergence(docs: DataFrame, least: int = MIN_DOCUMENTS, top: int = TOP, shard: int = SHARD, rounds: int = ROUNDS) -> DataFrame:
    """(lang, source, text) -> lang, source, part (`pair` or `term`), item, value and rank."""
    audit = Audit(docs, least, shard)
    blocks = audit.blocks(top)
    release(audit.terms)
    pairs = tournament(audit.groups, blocks, audit.sizes, rounds)
    best = blocks.select("lang", "source", F.explode("best").alias("b")).select("lang", "source", "b.item", "b.value")
    return _ranked(pairs, "pair").unionByName(_ranked(best, "term").where(F.col("rank") <= top))


DIVERGENCE_SQL = r"""
with d as (select row_number() over () as n, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
t as (select n, lang, source, unnest(terms) as term from d),
c as (select lang, source, term, count(*) as k, count(distinct n) as docs from t group by all),
v as (select lang, term, cast(sum(k) as bigint) as k from c group by lang, term having sum(docs) >= 3),
l as (select lang, count(*) as kept, cast(sum(k) as bigint) as total from v group by lang),
g as (select lang, source, cast(coalesce(sum(k), 0) as bigint) as total from (select distinct lang, source from d) left join (select c.* from c join v using (lang, term)) using (lang, source) group by lang, source),
p as (select g.lang, g.source, v.term, coalesce(c.k, 0) as k, 1 + (1000000000::hugeint * (coalesce(c.k, 0) + 1)) // (g.total + l.kept) as p
  from g join l using (lang) join v using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = v.term),
q as (select v.lang, v.term, 1 + (1000000000::hugeint * (v.k + 1)) // (l.total + l.kept) as q from v join l using (lang)),
pairs as (select a.lang, a.source, b.source as item, cast(coalesce(x.value, 0) as bigint) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) x
  on x.lang = a.lang and x.source = a.source and x.item = b.source),
best as (select p.lang, p.source, p.term as item, cast((p.p - q.q) * (p.p - q.q) // q.q as bigint) as value from p join q using (lang, term) where p.k > 0 and p.p > q.q),
r as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from best)
select lang, source, part, item, value, cast(rank as int) as rank from r where part = 'pair' or rank <= 200
"""
