"""Keyed admission with two anchored windows, in batch (R1-R6, A10). The streaming form is docloom.streaming.ratelimit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.tables import written

BURST, MINUTE = (60, 1_000_000), (300, 60_000_000)


def limited(path: Column, method: Column) -> Column:
    """R2: whether a request counts: health and event streams are exempt, so is reading /mcp; only /mcp and / are limited."""
    return F.when(path.isin("/health", "/sse"), False).when(path.startswith("/mcp") & (method == "GET"), False).otherwise(path.startswith("/mcp") | (path == "/"))


class Counters:
    """The two counters of one key: (window start or -1, hits) each. The streaming form's state; the batch form is held against it."""

    def __init__(self, burst=BURST, minute=MINUTE, state: tuple[int, int, int, int] = (-1, 0, -1, 0)):
        self.burst, self.minute, self.state = burst, minute, state

    def hit(self, us: int) -> tuple[bool, int, int]:
        """One request at `us`: allowed, retry_after in seconds (0 if allowed), remaining in the minute's window."""
        bs, bc, ms, mc = self.state
        bs, bc = (us, 1) if bs < 0 or us >= bs + self.burst[1] else (bs, bc + 1)
        fresh = ms < 0 or us >= ms + self.minute[1]
        if bc > self.burst[0]:
            self.state = (bs, bc, ms, mc)
            return False, 1, max(self.minute[0] - (0 if fresh else mc), 0)
        ms, mc = (us, 1) if fresh else (ms, mc + 1)
        self.state = (bs, bc, ms, mc)
        if mc > self.minute[0]:
            return False, max(1, -(-(ms + self.minute[1] - us) // 1_000_000)), 0
        return True, 0, self.minute[0] - mc


#: Stands for a time that no request has.
_NEVER = (1 << 63) - 1


def _bucket(us: str, length: int) -> Column:
    """The time divided by the length, rounded down, in integers."""
    return F.expr(f"({us} - pmod({us}, {length}L)) div {length}L")


def _buckets(nodes: DataFrame) -> DataFrame:
    """nodes (k, b, us) -> (k, b, r, first, past): each key's buckets that have times, numbered from 0; the first time in each, and the first time after bucket b + 1.

    What is windowed by key alone is a row for every 1,024 buckets."""
    w, by_key = Window.partitionBy("k", "many").orderBy("b"), Window.partitionBy("k").orderBy("many")
    b = nodes.groupBy("k", "b").agg(F.min("us").alias("first")).withColumn("many", F.floor(F.col("b") / 1024))
    b = b.withColumns({"n": F.row_number().over(w), "b1": F.lead("b").over(w), "f1": F.lead("first").over(w), "f2": F.lead("first", 2).over(w)})
    g = b.groupBy("k", "many").agg(F.count("*").alias("rows"), F.min("b").alias("gb"), F.min("first").alias("g1"), F.min(F.when(F.col("n") == 2, F.col("first"))).alias("g2"))
    g = g.select(F.col("k").alias("k2"), F.col("many").alias("m2"), (F.sum("rows").over(by_key) - F.col("rows")).alias("before"), F.lead("gb").over(by_key).alias("gb"),
                 F.lead("g1").over(by_key).alias("g1"), F.coalesce(F.lead("g2").over(by_key), F.lead("g1", 2).over(by_key)).alias("g2"))
    after, second = F.coalesce("f1", "g1"), F.when(F.col("f1").isNull(), F.col("g2")).otherwise(F.coalesce("f2", "g1"))
    past = F.when(F.coalesce("b1", "gb") == F.col("b") + 1, second).otherwise(after)
    return b.join(g, F.expr("k <=> k2 and many = m2")).select("k", "b", (F.col("before") + F.col("n") - 1).alias("r"), "first", past.alias("past"))


def _next(nodes: DataFrame, buckets: DataFrame, length: int) -> DataFrame:
    """nodes (k, b, us), distinct -> (k, r, us, nxt, head): the first of the key's times at or past us + length or null, us's bucket, and whether us is its first time.

    us + length is in bucket b + 1, and so is its successor, or it is the first time after that bucket, which stands there as a guard."""
    none = F.lit(None).cast("long")
    times = nodes.select("k", "b", F.col("us").alias("t"), none.alias("us"), none.alias("r"), none.alias("first"))
    guards = buckets.select("k", F.col("b") + 1, F.coalesce("past", F.lit(_NEVER)), none, "r", "first")
    asked = nodes.select("k", F.col("b") + 1, F.col("us") + F.lit(length), "us", none, none)
    # seen from the latest: the guard is the first row, and the last time before a question is the nearest one at or past it
    seen = Window.partitionBy("k", "b").orderBy(F.col("t").desc(), F.col("us").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    near = times.union(guards).union(asked).withColumns({"near": F.last(F.when(F.col("us").isNull(), F.col("t")), ignorenulls=True).over(seen), "r": F.first("r").over(seen), "first": F.first("first").over(seen)})
    return near.where("us is not null").select("k", "r", "us", F.when(F.col("near") < _NEVER, F.col("near")).alias("nxt"), (F.col("us") == F.col("first")).alias("head"))


def window_starts(times: DataFrame, length: int) -> DataFrame:
    """times (k, us) -> (k, start): the starts of each key's windows, the first time and then always the first one at or past the last window's end.

    Blocks of 2^j of a key's buckets, j = 0, 1, ...: a chain enters a block at a time of its first bucket, or at the first time of its second one, and each such
    entry knows the first time that its chain has past the block. An even block's entries with the exits of the odd block after it are those of
    the block twice as long, so a table has half the rows of the one before, and all of them together about twice the times. From the longest block
    down, each start that is known gives the one in the odd block after its own. Every join is by key and time."""
    nodes = written(times.distinct().withColumn("b", _bucket("us", length)), "times")
    buckets = written(_buckets(nodes), "buckets")
    last = buckets.agg(F.max("r")).head()[0]
    exits: list[DataFrame] = []
    for j in range((last or 0).bit_length()):
        if j == 0:
            exits.append(written(_next(nodes, buckets, length), "exits"))
            continue
        even, odd = exits[-1].where("r % 2 = 0"), exits[-1].where("r % 2 = 1")
        to = odd.select(F.col("k").alias("k2"), F.col("us").alias("us2"), F.col("nxt").alias("nxt2"))
        longer = even.join(to, F.expr("k <=> k2 and nxt = us2"), "left").withColumn("nxt", F.when(F.col("us2").isNull(), F.col("nxt")).otherwise(F.col("nxt2"))).select("k", "r", "us", "nxt", "head")
        if j == 1:  # blocks of one bucket: an entry by the second bucket of two is not one of the first
            longer = longer.unionByName(odd.where("head"))
        exits.append(written(longer.withColumn("r", F.floor(F.col("r") / 2)), "exits"))
    starts = buckets.where("r = 0").select("k", F.col("first").alias("start"))
    for e in reversed(exits):
        to = e.where("r % 2 = 0 and nxt is not null").select(F.col("k").alias("k2"), "us", "nxt")
        starts = starts.join(to, F.expr("k <=> k2 and start = us"), "left").select("k", F.explode(F.array_compact(F.array("start", "nxt"))).alias("start"))
    return starts.distinct()  # a chain that skips a whole bucket has its next start from the longer blocks too


def counted(rows: DataFrame, length: int, start: str, count: str) -> DataFrame:
    """rows (k, us, id, ...) with the start of their window and their number in it. Starts are at least a window apart, so a bucket of that length holds one at
    most, and a row's is in its own bucket or the one before."""
    starts = written(window_starts(rows.select("k", "us"), length).withColumn("b", _bucket("start", length)), "starts")
    r = rows.withColumn("b", _bucket("us", length))
    own, before = starts.toDF("k2", "s2", "b2"), starts.toDF("k3", "s3", "b3")
    r = r.join(own, F.expr("k <=> k2 and b = b2"), "left").join(before, F.expr("k <=> k3 and b - 1 = b3"), "left")
    r = r.withColumn(start, F.when(F.col("s2") <= F.col("us"), F.col("s2")).otherwise(F.col("s3"))).drop("b", "k2", "s2", "b2", "k3", "s3", "b3")
    return r.withColumn(count, F.row_number().over(Window.partitionBy("k", start).orderBy("us", "id")))


def admit(requests: DataFrame, key: str, ts: str, order: str, burst: tuple[int, int] = BURST, minute: tuple[int, int] = MINUTE) -> DataFrame:
    """(rate_key, id, allowed, retry_after, remaining). Windows start at a key's first request, and end after their length
    in microseconds; both are (limit, length).

    R5: what cannot be counted is let in: a request without a time passes and leaves the counters as they are.
    Over the burst limit a request is denied for 1 s and the minute's counter stays; over the minute's limit it is denied until that
    window ends. Event time decides, ties by `order`. The burst's windows do not depend on the minute's, so two passes of `counted` give all
    decisions: one over all requests, one over those that the burst lets through. A key's windows are dealt out over tasks; none holds a key."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = written(requests.select(F.col(key).cast("string").alias("k"), us.alias("us"), F.col(order).cast("long").alias("id")), "requests")
    first = written(counted(rows.where("us is not null"), burst[1], "bs", "bc"), "burst")
    through = written(counted(first.where(F.col("bc") <= burst[0]), minute[1], "ms", "mc"), "minute")
    wait = F.greatest(F.lit(1), F.ceil((F.col("ms") + F.lit(minute[1]) - F.col("us")) / 1_000_000))
    over, left = F.col("mc") > minute[0], lambda n: F.greatest(F.lit(minute[0]) - n, F.lit(0))
    passed = through.select("k", "id", (~over).alias("allowed"), F.when(over, wait).otherwise(0).alias("retry_after"), left(F.col("mc")).alias("remaining"))
    # a burst's denied requests see the minute's counter as its last counted request left it
    last = through.where(F.col("bc") == burst[0]).select(F.col("k").alias("k2"), F.col("bs").alias("bs2"), "ms", "mc")
    denied = first.where(F.col("bc") > burst[0]).join(last, F.expr("k <=> k2 and bs = bs2"), "left")
    fresh = F.col("ms").isNull() | (F.col("us") >= F.col("ms") + F.lit(minute[1]))
    denied = denied.select("k", "id", F.lit(False).alias("allowed"), F.lit(1).alias("retry_after"), left(F.when(fresh, 0).otherwise(F.col("mc"))).alias("remaining"))
    lost = rows.where("us is null").select("k", "id", F.lit(True).alias("allowed"), F.lit(0).alias("retry_after"), F.lit(minute[0]).alias("remaining"))
    every = passed.unionByName(denied).unionByName(lost)
    return every.select(F.col("k").alias("rate_key"), "id", "allowed", F.col("retry_after").cast("int").alias("retry_after"), F.col("remaining").cast("int").alias("remaining"))


def denial(decisions: DataFrame, minute_limit: int = MINUTE[0], burst_limit: int = BURST[0]) -> DataFrame:
    """Answers to denied requests; a wait of one second is called a burst, whatever denied it."""
    burst = F.col("retry_after") == 1
    return decisions.where("not allowed").select("rate_key", "id", "retry_after", F.lit(429).alias("status"), F.when(burst, "per-second burst").otherwise("per-minute").alias("limit_type"), F.when(burst, burst_limit).otherwise(minute_limit).alias("limit"), F.lit(0).alias("remaining"))


def key_statistics(keys: DataFrame) -> DataFrame:
    """Live counter keys; session suffixes make counted_ips too many, distinct_ips is right."""
    ip = F.regexp_extract("rate_key", r"^(\[[^\]]*\]|[^:]*)", 1)
    return keys.agg(F.count_distinct("rate_key").alias("active_keys"), F.count_distinct("rate_key").alias("counted_ips"), F.count_distinct(ip).alias("distinct_ips"))
