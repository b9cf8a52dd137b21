"""Operator 11: conversation structure repair by a fold over sorted turns, in Spark SQL alone.

A repaired conversation's roles read (s?(ua)+)?: nothing, or a system turn that may be missing and pairs of user and assistant. Each turn is kept (0),
gets the role user or assistant (3), or is deleted (4; blank and repeated turns must go); empty turns of either role may be put in anywhere (3), and
a truncated turn that stays costs 3 more. The cheapest edits win; of equally cheap ones the ASCII-least string of their initials (the audit).

Four states say what a repaired prefix ends in: nothing, s, u, or a. aggregate() folds a conversation's sorted turns and carries for each state the
least struct (cost, audit); `least` compares the structs, so cost decides and then the audit. Keeping only the least is exact: audits of equal cost
over the same turns have as many letters K, R and D, and with one a proper prefix of the other the longer one would hold more inserts and cost more.

No conversation has to be folded in one piece. Turns are range-sorted by conversation, turn, role and text hash and numbered; every SEGMENT turns of the numbering
that belong to one conversation are a segment, folded on its own from each of the four states (from the first one only where the conversation
begins there). A second fold goes over the segments' four by four results. So texts are never gathered by conversation, only letters are; the chosen
states at the segments' borders then give each segment its part of the audit, and its turns their edits. The row of a conversation that
this operator returns (one audit) and the digest's hash of a whole repaired text are single values, however long the conversation.

Faults come from windows over a segment (role changes, new turn numbers) and from first occurrences. Each turn's first fault counts: blank, duplicate, truncated.

Defined results: null roles and texts are one space; null turns come first; turns of equal number are ordered by role and then by the md5 of
their text; rows with a null conversation are one conversation; a conversation without turns has zeros and an empty audit; an empty table gives no rows; any
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import written

SEGMENT_BITS = 8
KEEP, REROLE, DELETE, INSERT = (0, "K"), (3, "R"), (4, "D"), (3, "I")
TRUNCATED = 3
BLANKS, SPACES = "\t\n\x0b\x0c\r", " " * 5
_ENTRY = "struct<cost:bigint,audit:string>"
_STATES = range(4)  # nothing yet, s, u, a; the first and the last are complete
_NAMES = ("none", "s", "u", "a")


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults by crc32 of "conv_id:turn" modulo 20: 0 drops a row, 1 empties its text, 2 takes its . ! and ?
    out, 3 repeats it, 4 makes its role user. Nulls are one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    t = turns.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    t = t.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_kind") == 3, 2).otherwise(1).alias("_n"))
    return t.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "_n")).alias("_n")).drop("_n")


def _rows(turns: DataFrame) -> DataFrame:
    """Turns with the hash that stands for the text and the one that stands for the whole row."""
    t = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"))
    t = t.withColumn("key", F.md5("text"))
    return t.withColumn("row", F.unhex(F.md5(F.to_json(F.struct("conv_id", "turn", "role", "key")))))  # to_json leaves nulls out, so it is unambiguous


def placed(turns: DataFrame) -> DataFrame:
    """Every turn without its text: id (in the order of conversation, turn, role and key), segment, initial and the faults that its own text shows. Written."""
    t = _rows(turns)
    seen = F.rtrim(F.translate("text", BLANKS, SPACES))
    t = t.select("conv_id", "turn", "role", "key", "row", F.substring("role", 1, 1).alias("initial"), (seen == "").alias("blank"), (~F.substring(seen, -1, 1).isin(".", "!", "?")).alias("truncated"))
    order = ("conv_id", "turn", "role", "key")
    t = t.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    return written(t.withColumn("segment", F.shiftright("id", SEGMENT_BITS)), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """`placed` turns with fault (blank, duplicate, truncated or null), illegal and new_turn against the turn before in the segment, and starts (first of its conversation).

    What was said earlier is found by the least id of each conversation, role and text: aggregated before it is shuffled, and met by
    id, so that a text that a conversation says a million times is no task of its own."""
    first = turns.groupBy("conv_id", "role", "key").agg(F.min("id").alias("id"))
    start = first.groupBy("conv_id").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("starts"))
    t = turns.join(first.select("id", F.lit(True).alias("_first")), "id", "left").join(start, "id", "left")
    w = Window.partitionBy("conv_id", "segment").orderBy("id")
    fault = F.when(F.col("blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(F.col("truncated"), "truncated")
    return t.select(
        "conv_id", "segment", "id", "turn", "row", "initial", fault.alias("fault"), F.coalesce("starts", F.lit(False)).alias("starts"),
        illegal(F.lag("initial").over(w), F.col("initial")).alias("illegal"), (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(w))).alias("new_turn"),
    )


def illegal(before: Column, initial: Column) -> Column:
    """Whether two neighbours' initials cannot follow each other."""
    return before.isNotNull() & ~F.concat(before, initial).isin("su", "ua", "au")


# ---- the fold -----------------------------------------------------------------------------------------------------------------


def _after(entry: Column, edit: tuple[int, str], extra: Column | None = None) -> Column:
    """The entry with an edit's cost and initial; null stays null."""
    cost = entry["cost"] + F.lit(edit[0])
    return F.when(entry.isNotNull(), F.struct((cost if extra is None else cost + extra).cast("bigint").alias("cost"), F.concat(entry["audit"], F.lit(edit[1])).alias("audit")))


def _four(entries: list[Column]) -> Column:
    return F.struct(*[e.cast(_ENTRY).alias(n) for e, n in zip(entries, _NAMES)])


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _with_inserts(v: Column) -> Column:
    """Every state also by empty turns put in behind."""
    one, two = INSERT, (2 * INSERT[0], 2 * INSERT[1])
    user = F.least(v["u"], *[_after(v[n], one) for n in ("none", "s", "a")])
    assistant = F.least(v["a"], _after(v["u"], one), _after(v["none"], two), _after(v["s"], two))
    return _four([v["none"], v["s"], user, assistant])


def _begin(start: int) -> Column:
    entry = F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("audit"))
    return _with_inserts(_four([entry if s == start else F.lit(None) for s in _STATES]))


def _step(v: Column, t: Column) -> Column:
    """The states after one more turn t (initial, fault)."""
    extra = F.when(t["fault"] == "truncated", TRUNCATED).otherwise(0)
    deleted = [_after(v[n], DELETE) for n in _NAMES]
    kept = lambda n, initial: F.when(t["initial"] == initial, _after(v[n], KEEP, extra))
    other = lambda n: _after(v[n], REROLE, extra)
    before_user = ("none", "s", "a")
    stays = _four([
        deleted[0],
        F.least(deleted[1], kept("none", "s")),
        F.least(deleted[2], *[kept(n, "u") for n in before_user], *[other(n) for n in before_user]),
        F.least(deleted[3], kept("u", "a"), other("u")),
    ])
    goes = t["fault"].isin("blank", "duplicate")
    return _let(F.when(F.coalesce(goes, F.lit(False)), _four(deleted)).otherwise(stays), _with_inserts)


def _fold(turns: Column, start: int) -> Column:
    return F.aggregate(turns, _begin(start), _step)


def segments(marked: DataFrame) -> DataFrame:
    """One row for each segment: its turns, counts, borders, and `best`: for each state it may be entered in, the four least (cost, audit)."""
    count = lambda c: F.sum(c.cast("bigint"))
    s = marked.groupBy("conv_id", "segment").agg(
        F.array_sort(F.collect_list(F.struct("id", "initial", "fault", "row"))).alias("turns"), F.max("starts").alias("starts"),
        *[count(F.coalesce(F.col("fault") == k, F.lit(False))).alias(k) for k in ("blank", "duplicate", "truncated")],
        count(F.col("illegal")).alias("illegal"), count(F.col("new_turn")).alias("distinct"), F.min("turn").alias("low"), F.max("turn").alias("high"),
    )
    best = F.array(_fold(F.col("turns"), 0), *[F.when(~F.col("starts"), _fold(F.col("turns"), s)) for s in _STATES[1:]])
    return s.withColumns({"best": best, "first": F.get("turns", F.lit(0))["initial"], "last": F.element_at("turns", -1)["initial"]})


def conversations(segs: DataFrame) -> DataFrame:
    """Per conversation the sums of its segments and the cheapest path through them: cost, audit, the state it ends in, and for each segment its entry state."""
    part = F.struct("segment", "best", "blank", "duplicate", "truncated", "illegal", "distinct", "low", "high", "first", "last")
    c = segs.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    kind = "struct<cost:bigint,audit:string,path:array<int>>"
    entry = lambda cost, audit, path: F.struct(cost.alias("cost"), audit.alias("audit"), path.alias("path")).cast(kind)
    four = lambda e: F.struct(*[x.cast(kind).alias(n) for x, n in zip(e, _NAMES)])

    def over(v: Column, p: Column) -> Column:
        def reach(to: str) -> Column:
            ways = []
            for s, name in enumerate(_NAMES):
                part = p["best"][s][to]
                ways.append(F.when(v[name].isNotNull() & part.isNotNull(), entry(v[name]["cost"] + part["cost"], F.concat(v[name]["audit"], part["audit"]), F.concat(v[name]["path"], F.array(F.lit(s))))))
            return F.least(*ways)

        return four([reach(n) for n in _NAMES])

    begin = four([entry(F.lit(0).cast("bigint"), F.lit(""), F.array().cast("array<int>")), *[F.lit(None)] * 3])
    c = c.withColumn("_v", F.aggregate("parts", begin, over)).withColumn("_best", F.least("_v.none", "_v.a"))
    added = lambda name: F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p[name])
    pairs = F.zip_with(F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))), F.slice("parts", 2, F.size("parts")), lambda a, b: F.struct(illegal(a["last"], b["first"]).alias("illegal"), F.coalesce(a["high"] == b["low"], F.lit(False)).alias("same")))
    borders = lambda name: F.size(F.filter(pairs, lambda x: x[name])).cast("bigint")
    low, high = F.array_min(F.transform("parts", lambda p: p["low"])), F.array_max(F.transform("parts", lambda p: p["high"]))
    gaps = F.coalesce(high - low + 1 - (added("distinct") - borders("same")), F.lit(0))
    return c.select(
        "conv_id", gaps.cast("bigint").alias("gaps"), *[added(k).alias(k) for k in ("blank", "duplicate", "truncated")], (added("illegal") + borders("illegal")).alias("illegal"),
        F.col("_best.cost").alias("cost"), F.col("_best.audit").alias("audit"), F.when(F.col("_v.none").eqNullSafe(F.col("_best")), 0).otherwise(3).alias("ends"),
        F.transform("parts", lambda p: p["segment"]).alias("segment"), F.col("_best.path").alias("path"),
    )


def audits(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, turn, role, text) -> the written segments, and per conversation gaps, faults, cost and audit with the path through the segments."""
    segs = written(segments(faults(placed(turns))), "segments")
    return segs, written(conversations(segs), "audits")


def _edits(segs: DataFrame, plan: DataFrame) -> DataFrame:
    """One row for each letter of the audits: conv_id, place, edit, row (null for an insert) and the role that it gets (null: its own)."""
    ways = plan.select("conv_id", F.explode(F.transform(F.arrays_zip("segment", "path"), lambda x, i: F.struct(x["segment"].alias("segment"), x["path"].alias("enter"), F.coalesce(F.get(F.col("path"), i + 1), F.col("ends")).alias("leave")))).alias("w"))
    ways = ways.select(F.col("conv_id").alias("_c"), "w.*")
    chosen = F.element_at("best", F.col("enter") + 1)
    audit = reduce(lambda otherwise, s: F.when(F.col("leave") == s, chosen[_NAMES[s]]["audit"]).otherwise(otherwise), _STATES, F.lit(None))
    s = segs.join(ways.withColumnRenamed("segment", "_s"), F.expr("segment = _s and conv_id <=> _c")).select("conv_id", "segment", "turns", "enter", audit.alias("audit"))

    kind = "array<struct<edit:string,row:binary,role:string>>"
    zero = F.struct(F.col("enter").alias("state"), F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def apply(a: Column, letter: Column) -> Column:
        t = F.get(F.col("turns"), a["at"])
        gets = F.when(a["state"] == 2, "assistant").otherwise("user")
        kept = F.when(t["initial"] == "s", 1).when(t["initial"] == "u", 2).otherwise(3)
        state = F.when(letter == "D", a["state"]).when(letter == "K", kept).when(a["state"] == 2, 3).otherwise(2)
        item = F.struct(letter.alias("edit"), F.when(letter != "I", t["row"]).alias("row"), F.when(letter.isin("I", "R"), gets).alias("role"))
        return F.struct(state.alias("state"), (a["at"] + F.when(letter == "I", 0).otherwise(1)).alias("at"), F.concat(a["out"], F.array(item).cast(kind)).alias("out"))

    letters = F.filter(F.split("audit", ""), lambda x: x != "")
    out = F.aggregate(letters, zero, apply, lambda a: a["out"])
    e = s.select("conv_id", "segment", F.posexplode(out).alias("_i", "e"))
    place = F.col("segment") * (1 << SEGMENT_BITS + 2) + F.col("_i")  # a segment has at most so many letters: two inserts can come with each turn and two at its end
    return e.select("conv_id", place.alias("place"), "e.edit", "e.row", "e.role")


def repaired(turns: DataFrame, segs: DataFrame, plan: DataFrame) -> DataFrame:
    """The turns that stay or are put in: conv_id, place (their order, with gaps), edit, role, text."""
    e = _edits(segs, plan).where("edit <> 'D'")
    own = _rows(turns).groupBy("row").agg(F.max("role").alias("_role"), F.max("text").alias("text"))  # equal rows have one text
    stay = e.where("edit <> 'I'").join(own, "row").select("conv_id", "place", "edit", F.coalesce("role", "_role").alias("role"), "text")
    return stay.unionByName(e.where("edit = 'I'").select("conv_id", "place", "edit", "role", F.lit("").alias("text")))


def repair(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) -> the repaired conversations, one row for each turn."""
    segs, plan = audits(turns)
    return repaired(turns, segs, plan)


def repair_digest(original: DataFrame) -> DataFrame:
    """Damages the conversations, repairs them, and returns for each original one its faults, cost, audit and the hash of its repaired lines."""
    turns = damage(original)
    segs, plan = audits(turns)
    line = F.struct("place", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = repaired(turns, segs, plan).groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    hashed = lines.select("conv_id", F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), "\n").cast("binary"), 256).alias("hash"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = original.select("conv_id").unionByName(plan.select("conv_id", *counts, "audit"), allowMissingColumns=True).unionByName(hashed, allowMissingColumns=True)
    got = every.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in (*counts, "audit", "hash")])
    return got.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("hash", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


REPAIR_SQL = r"""
with recursive
crc_table as (select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) as t from range(256) r(i)),
named as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda ch: ord(ch)::bigint) as bytes from conversations),
kinds as (select n.*, xor(list_reduce(n.bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) % 20 as kind from named n, crc_table),
damaged as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
  case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(case when kind = 3 then [1, 2] else [1] end) as copy from kinds where kind <> 0),
trimmed as (select *, md5(text) as key, regexp_replace(text, '[\x20\x09-\x0D]+$', '') as seen, substr(role, 1, 1) as initial from damaged),
numbered as (select *, row_number() over o as place, lag(initial) over o as before,
  row_number() over (partition by conv_id, role, key order by turn nulls first, copy) as nth from trimmed window o as (partition by conv_id order by turn nulls first, role, key, copy)),
faulty as (select *, case when seen = '' then 'blank' when nth > 1 then 'duplicate' when seen[-1] not in ('.', '!', '?') then 'truncated' else '' end as fault from numbered),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
  count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where before is not null and before || initial not in ('su', 'ua', 'au')) as illegal, count(*) as n from faulty group by conv_id),
fold as (
  select conv_id, 0::bigint as place, {'c': 0::bigint, 'a': ''} as v0, null::struct(c bigint, a varchar) as v1, null::struct(c bigint, a varchar) as v2, null::struct(c bigint, a varchar) as v3 from counts
  union all
  select conv_id, place,
    case when v0 is not null then {'c': v0.c + 4, 'a': v0.a || 'D'} end,
    least(case when v1 is not null then {'c': v1.c + 4, 'a': v1.a || 'D'} end, case when stays and initial = 's' and v0 is not null then {'c': v0.c + extra, 'a': v0.a || 'K'} end),
    least(case when w2 is not null then {'c': w2.c + 4, 'a': w2.a || 'D'} end,
      case when stays and initial = 'u' and v0 is not null then {'c': v0.c + extra, 'a': v0.a || 'K'} end, case when stays and initial = 'u' and v1 is not null then {'c': v1.c + extra, 'a': v1.a || 'K'} end,
      case when stays and initial = 'u' and w3 is not null then {'c': w3.c + extra, 'a': w3.a || 'K'} end, case when stays and v0 is not null then {'c': v0.c + 3 + extra, 'a': v0.a || 'R'} end,
      case when stays and v1 is not null then {'c': v1.c + 3 + extra, 'a': v1.a || 'R'} end, case when stays and w3 is not null then {'c': w3.c + 3 + extra, 'a': w3.a || 'R'} end),
    least(case when w3 is not null then {'c': w3.c + 4, 'a': w3.a || 'D'} end, case when stays and initial = 'a' and w2 is not null then {'c': w2.c + extra, 'a': w2.a || 'K'} end,
      case when stays and w2 is not null then {'c': w2.c + 3 + extra, 'a': w2.a || 'R'} end)
  from (select t.conv_id, t.place, t.initial, t.fault not in ('blank', 'duplicate') as stays, case when t.fault = 'truncated' then 3 else 0 end as extra, f.v0, f.v1,
      least(f.v2, case when f.v0 is not null then {'c': f.v0.c + 3, 'a': f.v0.a || 'I'} end, case when f.v1 is not null then {'c': f.v1.c + 3, 'a': f.v1.a || 'I'} end, case when f.v3 is not null then {'c': f.v3.c + 3, 'a': f.v3.a || 'I'} end) as w2,
      least(f.v3, case when f.v2 is not null then {'c': f.v2.c + 3, 'a': f.v2.a || 'I'} end, case when f.v0 is not null then {'c': f.v0.c + 6, 'a': f.v0.a || 'II'} end, case when f.v1 is not null then {'c': f.v1.c + 6, 'a': f.v1.a || 'II'} end) as w3
    from fold f join faulty t on t.conv_id is not distinct from f.conv_id and t.place = f.place + 1)),
ended as (select f.conv_id, least(f.v0, f.v3, case when f.v2 is not null then {'c': f.v2.c + 3, 'a': f.v2.a || 'I'} end, case when f.v1 is not null then {'c': f.v1.c + 6, 'a': f.v1.a || 'II'} end) as best
  from fold f join counts c on c.conv_id is not distinct from f.conv_id and f.place = c.n),
letters as (select conv_id, unnest(string_split(best.a, '')) as letter, generate_subscripts(string_split(best.a, ''), 1) as pos from ended where best.a <> ''),
ranked as (select *, count(*) filter (where letter <> 'I') over (partition by conv_id order by pos) as place from letters),
emitted as (select r.conv_id, r.letter, r.pos, t.role, t.initial, coalesce(t.text, '') as text, row_number() over (partition by r.conv_id order by r.pos) - 1 as e
  from ranked r left join faulty t on r.letter <> 'I' and t.conv_id is not distinct from r.conv_id and t.place = r.place where r.letter <> 'D'),
roles as (select *, max(case when e = 0 and letter = 'K' and initial = 's' then 1 else 0 end) over (partition by conv_id) as begins from emitted),
lines as (select conv_id, string_agg((case when letter = 'K' then role when (e - begins) % 2 = 0 then 'user' else 'assistant' end) || ':' || text, chr(10) order by pos) as body from roles group by conv_id)
select d.conv_id, coalesce(c.gaps, 0)::bigint as gaps, coalesce(c.blank, 0) as blank, coalesce(c.duplicate, 0) as duplicate, coalesce(c.truncated, 0) as truncated, coalesce(c.illegal, 0) as illegal,
  coalesce(x.best.c, 0) as cost, coalesce(x.best.a, '') as audit, sha256(coalesce(l.body, '')) as repaired_sha256
from (select distinct conv_id from conversations) d left join counts c on c.conv_id is not distinct from d.conv_id left join ended x on x.conv_id is not distinct from d.conv_id left join lines l on l.conv_id is not distinct from d.conv_id
"""
