"""Operator 7: mixing sources to target weights by weighted fair queueing.

Every document of a source waits in a shuffled queue; a second pass of the queue follows the first. Its virtual finish time is the number of
its source's words up to and including it, divided by the source's weight. All copies are range-sorted by virtual finish time, and
the queue is cut where the running total of words reaches the budget: copies that finish before the cut are taken whole, the one
at the cut up to the budget, later ones not at all. So sources with queues left get words in proportion to their weights, and
the share of a source whose passes are used up goes to the others.

With `packet` words given, a document waits as packets of at most so many words, each with a virtual finish time of its own
(the document's is that of its last one). Then every source comes within one packet of its target, and not within one document.

The running total is taken in two levels, over the totals of whole partitions of the range sort and inside the one partition
where the budget ends, so only one number for each partition and the cut itself pass through the driver. Virtual times are exact integers,
in units of 1 / (least common multiple of the weights). A hot source is no single task either: queue positions are summed over 4,096 hash
ranges of the source and then inside a range. Sources are ranked and filled up by the same two-level sums, however many there are.

Defined results: null or empty texts have size 0 and take 0; null is a source of its own, last; repeated rows are queued one by
one and being equal, any order of theirs is the same result; an empty table gives no rows; with no words at all every target is
0. Columns named like a result are replaced.
"""

from __future__ import annotations

import re
from fractions import Fraction
from itertools import islice
from math import lcm

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from docloom.llm.common import WORD, n_words, release, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
PASSES = 2
PACKET = 256
_WHOLE = 1 << 62


def _steps(weights: tuple) -> list[int]:
    """Virtual time of one word at each weight, in whole units."""
    parts = [Fraction(str(w)) for w in weights]
    unit = lcm(*(p.numerator for p in parts))
    return [unit * p.denominator // p.numerator for p in parts]


def sums_before(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with the sums of columns over all rows before in `order`: partitions of a range sort first, then inside a partition."""
    w = Window.partitionBy("_docloom_part").orderBy(*order)
    dealt = written(df.repartitionByRange(*order).withColumn("_docloom_part", F.spark_partition_id()), "ranges")
    whole = dealt.groupBy("_docloom_part").agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    base = whole.select("_docloom_part", *((F.sum(k).over(Window.orderBy("_docloom_part")) - F.col(k)).alias(f"_docloom_{k}") for k in sums))  # a row for each partition
    inside = dealt.withColumns({k: F.sum(c).over(w) - c for k, c in sums.items()})
    return inside.join(F.broadcast(base), "_docloom_part").withColumns({k: F.col(k) + F.col(f"_docloom_{k}") for k in sums}).drop("_docloom_part", *(f"_docloom_{k}" for k in sums))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(source, source_size) -> also weight, step and target: min(passes * size, weight * theta), summing to share of all sizes."""
    every = F.array(*[F.struct(F.lit(float(w)).alias("weight"), F.lit(s).cast("long").alias("step")) for w, s in zip(weights, _steps(weights))])
    name = F.col("source").asc_nulls_last()
    t = sums_before(sizes, [name], {"rank": F.lit(1)}).withColumn("_w", F.element_at(every, (F.col("rank") % len(weights) + 1).cast("int")))
    t = t.select("source", "source_size", "_w.*", (F.col("source_size") * float(passes)).alias("_cap"))
    t = written(sums_before(t, [F.col("_cap") / F.col("weight"), name], {"_capped": F.col("_cap"), "_below": F.col("weight")}), "sources")
    whole = t.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).head()
    # capping the fullest sources first raises theta as long as they are over it, and lowers it after that
    theta = t.agg(F.max((F.lit(float(share) * (whole["size"] or 0)) - F.col("_capped")) / (F.lit(whole["weight"]) - F.col("_below")))).head()[0]
    return t.select("source", "source_size", "weight", "step", F.least("_cap", F.col("weight") * F.lit(theta)).alias("target"))


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """docs with size and the key that shuffles the queues."""
    docs = docs.drop("size", "source_size", "target", "weight", "takes")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))
    return docs.withColumns({"size": n_words(F.col("text")), "_docloom_key": key})


def _placed(d: DataFrame, sources: DataFrame, starts: DataFrame) -> DataFrame:
    """d with its source's columns and _docloom_before: words of its source queued before it."""
    at = Window.partitionBy("source", "_docloom_range").orderBy("_docloom_key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_docloom_range", F.substring("_docloom_key", 1, 3)).withColumn("_docloom_inside", F.sum("size").over(at))
    t = starts.join(sources.withColumnRenamed("source", "_docloom_s"), F.expr("source <=> _docloom_s")).drop("source", "_docloom_sum").withColumnRenamed("_docloom_range", "_docloom_r")
    d = d.join(t, F.expr("source <=> _docloom_s and _docloom_range = _docloom_r")).withColumn("_docloom_before", F.col("_docloom_offset") + F.col("_docloom_inside") - F.col("size"))
    return d.drop("_docloom_range", "_docloom_inside", "_docloom_s", "_docloom_r", "_docloom_offset")


_ORDER = ["finish", "_docloom_key", "source"]


def _cut(placed: DataFrame, budget: int, passes: int, packet: int) -> Row | None:
    """Range-sorts all packets by virtual finish time; the one where the running total of words reaches the budget, with `rest`, the words
    of it that are still taken. None: the budget is not reached."""
    copies = placed.where("size > 0").withColumn("_docloom_p", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    copies = copies.withColumn("_docloom_end", F.explode(F.expr(f"transform(sequence(1L, (size - 1) div {packet}L + 1), n -> if(n > (size - 1) div {packet}L, size, n * {packet}L))")))
    words = F.expr(f"_docloom_end - ((_docloom_end - 1) div {packet}L) * {packet}L")
    finish = F.expr("(_docloom_p * source_size + _docloom_before + _docloom_end) * step")
    stream = copies.select(finish.alias("finish"), "_docloom_key", "source", words.alias("words"))
    dealt = written(stream.repartitionByRange(*_ORDER).withColumn("_docloom_part", F.spark_partition_id()), "stream")
    left, at = budget, None
    parts = dealt.groupBy("_docloom_part").agg(F.sum("words").alias("n")).orderBy("_docloom_part").collect()  # a row for each partition
    if sum(r["n"] for r in parts) != passes * (placed.agg(F.sum("size")).head()[0] or 0):
        raise RuntimeError("the queue does not hold every word of every pass")
    for r in parts:
        if left <= r["n"]:
            at = r["_docloom_part"]
            break
        left -= r["n"]
    if at is None:
        release(dealt)
        return None
    total = F.sum("words").over(Window.orderBy(*_ORDER))  # over one partition of the range sort
    inside = dealt.where(F.col("_docloom_part") == at).withColumn("total", total).where(F.col("total") >= left).orderBy(*_ORDER)
    row = inside.withColumn("rest", F.lit(left) - F.col("total") + F.col("words")).head()
    release(dealt)
    return row


def _words(cut: Row | None, packet: int, start: str) -> str:
    """SQL for the words taken of a copy whose source has served `start` words before it: its packets that finish before the cut, and
    the rest of the one at the cut (whose key and source are in the columns _docloom_ck and _docloom_cs)."""
    if cut is None:
        return "size"
    sooner = "(_docloom_key < _docloom_ck or _docloom_key = _docloom_ck and _docloom_cs is not null and (source is null or source < _docloom_cs))"
    done = f"(if({sooner}, {cut['finish']}L, {cut['finish'] - 1}L) div step - {start})"
    end = f"({cut['finish']}L div step - {start})"
    whole = f"case when {done} >= size then size when {done} <= 0 then 0L else {done} - {done} % {packet}L end"
    hit = f"_docloom_key = _docloom_ck and source <=> _docloom_cs and {cut['finish']}L % step = 0 and {end} between 1 and size and ({end} = size or {end} % {packet}L = 0)"
    return f"{whole} + if({hit}, {cut['rest']}L, 0L)"


def _with_takes(placed: DataFrame, cut: Row | None, passes: int, packet: int) -> DataFrame:
    edge = {} if cut is None else {"_docloom_ck": F.lit(cut["_docloom_key"]), "_docloom_cs": F.lit(cut["source"])}
    starts = {f"_docloom_start{p}": F.expr(f"{p} * source_size + _docloom_before") for p in range(passes)}
    takes = [F.expr(f"named_struct('pass', {p}, 'words', cast({_words(cut, packet, s)} as bigint), 'finish', ({s} + size) / weight)") for p, s in enumerate(starts)]
    return placed.withColumns(starts | edge).withColumn("takes", F.array(*takes)).drop("weight", "step", "_docloom_key", "_docloom_before", *starts, *edge)


def _plan(docs: DataFrame, weights: tuple, share: float, passes: int, seed: int, packet: int | None) -> tuple[DataFrame, DataFrame, DataFrame, Row | None]:
    """The queued rows without texts, the sources, the first word of each hash range, and the cut. Texts are read once."""
    thin = written(_keyed(docs, seed).select("doc_id", "source", "size", "_docloom_key"), "queue")
    sums = written(thin.groupBy("source", F.substring("_docloom_key", 1, 3).alias("_docloom_range")).agg(F.sum("size").alias("_docloom_sum")), "sums")
    starts = sums.withColumn("_docloom_offset", F.sum("_docloom_sum").over(Window.partitionBy("source").orderBy("_docloom_range")) - F.col("_docloom_sum"))
    sources = written(targets(sums.groupBy("source").agg(F.sum("_docloom_sum").alias("source_size")), weights, share, passes), "targets")
    placed = written(_placed(thin, sources, starts), "placed")
    release(thin)
    total = sources.agg(F.sum("source_size")).head()[0] or 0
    cut = _cut(placed, int(Fraction(str(share)) * total), passes, packet or _WHOLE)
    return placed, sources, starts, cut


def schedule(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: int = 7, packet: int | None = None) -> DataFrame:
    """docs with size, source_size, target and takes: for each pass its words taken and its virtual finish time."""
    placed, sources, starts, cut = _plan(docs, weights, share, passes, seed, packet)
    release(placed)
    return _with_takes(_placed(_keyed(docs, seed), sources, starts), cut, passes, packet or _WHOLE)


def _first_words(texts: pd.Series, words: pd.Series) -> pd.Series:
    """The first words of each text, with the white space between them; null stays null."""
    def cut(text: str | None, n: int) -> str | None:
        if text is None:
            return None
        return next((text[: m.end()] for m in islice(re.finditer(WORD, text), int(n) - 1, None)), text)

    return pd.Series([cut(t, n) for t, n in zip(texts, words)], dtype=object)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix: one row for each served copy in the order of virtual finish time, range-sorted over all partitions.

    pass, words and finish are added; a copy that is cut keeps its first `words` words, others are whole. Without `packet` only the one
    copy where the budget ends is cut."""
    s = schedule(docs, **how).withColumn("_docloom_t", F.explode("takes")).where("_docloom_t.words > 0")
    begun = F.pandas_udf(_first_words, "string")(F.when(F.col("_docloom_t.words") < F.col("size"), F.col("text")), F.col("_docloom_t.words"))
    out = s.withColumns({"text": F.coalesce(begun, "text"), "pass": F.col("_docloom_t.pass"), "words": F.col("_docloom_t.words"), "finish": F.col("_docloom_t.finish")})
    return out.drop("takes", "_docloom_t").repartitionByRange("finish", "doc_id").sortWithinPartitions("finish", "doc_id")


def mix_plan(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: int = 7, packet: int | None = PACKET) -> DataFrame:
    """Per document what the mix takes of it, without moving texts."""
    placed, _, _, cut = _plan(docs, weights, share, passes, seed, packet)
    s = _with_takes(placed, cut, passes, packet or _WHOLE)
    return s.select("doc_id", "size", "source_size", "target", F.expr("aggregate(takes, 0L, (a, x) -> a + x.words)").alias("taken"))


MIX_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         md5('7:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as key
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, (row_number() over (order by source asc nulls last) - 1) % 3 as kind from s),
v as (select *, cast(case kind when 0 then 3 when 1 then 1 else 2 end as double) as weight, case kind when 0 then 2 when 1 then 6 else 3 end as step,
      source_size * 2.0::double as cap from w),
f as (select *, sum(cap) over o - cap as capped, sum(weight) over () - (sum(weight) over o - weight) as weights,
      sum(source_size) over () * 1.5::double as budget from v
      window o as (order by cap / weight, source asc nulls last)),
g as (select *, (budget - capped) / weights as theta_here from f),
h as (select *, max(theta_here) over () as theta from g),
t as (select source, source_size, step, least(cap, weight * theta) as target from h),
q as (select d.doc_id, d.source, d.key, d.size, t.source_size, t.step, t.target,
      cast(sum(d.size) over (partition by d.source order by d.key, d.size, d.doc_id rows unbounded preceding) as bigint) - d.size as bef
      from d join t on d.source is not distinct from t.source),
c as (select q.*, unnest([0, 1]) as pass from q where size > 0),
p as (select c.*, unnest(range(1, (size - 1) // 256 + 2)) as n from c),
k as (select *, (pass * source_size + bef + least(n * 256, size)) * step as finish, least(n * 256, size) - (n - 1) * 256 as words from p),
r as (select *, sum(words) over (order by finish, key, source asc nulls first rows unbounded preceding) - words as served from k),
x as (select source, bef, cast(sum(greatest(0, least(words, (select cast(sum(size) as bigint) * 3 // 2 from d) - served))) as bigint) as taken from r group by source, bef)
select q.doc_id, cast(q.size as bigint) as size, q.source_size, cast(q.target as double) as target, coalesce(x.taken, 0) as taken
from q left join x on q.size > 0 and q.bef = x.bef and q.source is not distinct from x.source
"""
