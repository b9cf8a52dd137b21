"""Operators 11 to 13: conversations, divergence of sources, token counts."""

import hashlib
import heapq
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import dialogue, divergence, queries, token_counts
from tests.duck import same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", ["op11_dialogue", "op12_divergence"])
def test_query_equals_its_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)


# ---- conversations --------------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, id string, state int"


def cheapest(turns):
    """(cost, audit, lines) of one conversation by searching edits in the order of (cost, audit) until one is complete: no states are merged."""
    faults, seen = [], set()
    for role, text in turns:
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    queue = [(0, "", 0, ())]
    while True:
        cost, audit, at, lines = heapq.heappop(queue)
        roles = "".join(r[:1] for r, _ in lines)
        body = roles[1:] if roles[:1] == "s" else roles
        if at == len(turns) and (roles == "" or body and body == "ua" * (len(body) // 2)):
            return cost, audit, [f"{r}:{t}" for r, t in lines], faults
        add = lambda c, letter, step, new: heapq.heappush(queue, (cost + c, audit + letter, at + step, lines + new))
        following = "user" if len(body) % 2 == 0 else "assistant"
        if len(lines) < len(turns) + 4:
            add(3, "I", 0, ((following, ""),))
        if at < len(turns):
            role, text = turns[at]
            add(4, "D", 1, ())
            if faults[at] not in ("blank", "duplicate"):
                extra = 3 * (faults[at] == "truncated")
                if role[:1] == following[0] or role[:1] == "s" and not lines:
                    add(extra, "K", 1, ((role, text),))
                add(3 + extra, "R", 1, ((following, text),))


def test_repair_equals_a_search_over_all_edits(spark, monkeypatch):
    """Random conversations, with segments of 256 turns and of 2; every row of the result, and the repaired turns."""
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), rnd.choice(["Yes.", "So", "Why?", " ", "", "One. ", f"Text {t}!"]), None, 0) for c in range(40) for t in range(rnd.randint(1, 7))]
    df = spark.createDataFrame(rows, TURNS)
    for bits in (8, 1):
        monkeypatch.setattr(dialogue, "SEGMENT_BITS", bits)
        segs, plan = dialogue.audits(df)
        found = {r["conv_id"]: r for r in plan.collect()}
        lines = {}
        for r in dialogue.repaired(df, segs, plan).orderBy("conv_id", "place").collect():
            lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        for c in range(40):
            cost, audit, want, faults = cheapest([(r[2], r[3]) for r in rows if r[0] == c])
            r = found[c]
            assert (r["cost"], r["audit"], lines.get(c, [])) == (cost, audit, want), c
            assert [r[k] for k in ("blank", "duplicate", "truncated")] == [faults.count(k) for k in ("blank", "duplicate", "truncated")]


def test_one_conversation_may_hold_most_turns(spark):
    """A conversation of 3,000 turns is folded in pieces, and its audit is the one that a fold in one piece gives."""
    rnd = random.Random(5)
    rows = [(7, t, rnd.choice(["user", "assistant", "system"]), f"Turn {t}{rnd.choice('. ')}", None, 0) for t in range(3000)]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    segs, plan = dialogue.audits(df)
    assert segs.count() >= 3000 >> dialogue.SEGMENT_BITS
    state = [(0, ""), None, None, None]
    after = lambda v, c, a: None if v is None else (v[0] + c, v[1] + a)
    least = lambda *v: min((x for x in v if x is not None), default=None)
    inserted = lambda v: [v[0], v[1], least(v[2], *[after(v[k], 3, "I") for k in (0, 1, 3)]), least(v[3], after(v[2], 3, "I"), after(v[0], 6, "II"), after(v[1], 6, "II"))]
    for _, _, role, text, _, _ in rows:
        v, e, i = inserted(state), 0 if text.strip()[-1] == "." else 3, role[0]
        state = [
            after(v[0], 4, "D"),
            least(after(v[1], 4, "D"), after(v[0], e, "K") if i == "s" else None),
            least(after(v[2], 4, "D"), *[x for k in (0, 1, 3) for x in (after(v[k], e, "K") if i == "u" else None, after(v[k], 3 + e, "R"))]),
            least(after(v[3], 4, "D"), after(v[2], e, "K") if i == "a" else None, after(v[2], 3 + e, "R")),
        ]
    v = inserted(state)
    r = plan.head()
    assert (r["cost"], r["audit"]) == least(v[0], v[3])
    assert dialogue.repaired(df, segs, plan).count() == len([x for x in r["audit"] if x != "D"])


def test_digest_of_odd_conversations(spark):
    """Nulls, repeated rows, ties, a null conversation, very long texts and an empty table; extra columns named like the operator's own."""
    long = "word " * 200_000 + "end."
    rows = [(None, None, None, None, "x", 1), (None, 1, "user", "Hi.", "x", 1), (1, None, "user", "A.", "", 0), (1, None, "user", "A.", "", 0), (1, 5, "assistant", long, "", 0), (2, 0, "user", "", "", 0), (3, 2, "user", "B.", "", 0), (3, 2, "assistant", "C.", "", 0)]
    df = spark.createDataFrame(rows, TURNS)
    df.createOrReplaceTempView("odd")
    found = {r["conv_id"]: r for r in dialogue.repair_digest(df).collect()}
    assert set(found) == {None, 1, 2, 3}
    assert dialogue.repair_digest(df.limit(0)).collect() == []
    plain = {}
    for r in dialogue.damage(df).collect():
        plain.setdefault(r["conv_id"], []).append(r)
    for c, r in found.items():
        turns = sorted(plain.get(c, []), key=lambda x: (x["turn"] is not None, x["turn"] or 0, x["role"], hashlib.md5(x["text"].encode()).hexdigest()))
        cost, audit, lines, _ = cheapest([(x["role"], x["text"]) for x in turns])
        assert (r["cost"], r["audit"], r["repaired_sha256"]) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
        numbers = [x["turn"] for x in turns if x["turn"] is not None]
        assert r["gaps"] == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)


# ---- divergence -----------------------------------------------------------------------------------------------------------------


def plain_divergence(rows, least=3, top=200):
    import re

    lang_of = lambda x: x or ""
    docs = [(lang_of(g), lang_of(s), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))) for g, s, t in rows]
    out = []
    for g in {d[0] for d in docs}:
        held, groups = Counter(), {}
        for x, s, terms in docs:
            if x == g:
                held.update(set(terms))
                groups.setdefault(s, Counter()).update(terms)
        kept = {t for t, n in held.items() if n >= least}
        groups = {s: Counter({t: n for t, n in c.items() if t in kept}) for s, c in groups.items()}
        whole = sum(groups.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        q, p = share(whole), {s: share(c) for s, c in groups.items()}
        for s, c in groups.items():
            pairs = sorted(((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s), key=lambda x: (x[0], x[1].encode()))
            out += [(g, s, "pair", o, -v, i + 1) for i, (v, o) in enumerate(pairs)]
            terms = sorted(((-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if c[t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))
            out += [(g, s, "term", t, -v, i + 1) for i, (v, t) in enumerate(terms[:top])]
    return sorted(out)


@pytest.mark.parametrize("shard,rounds", [(1 << 16, 8), (3, 1)])
def test_divergence_equals_plain_python(spark, shard, rounds):
    """Nulls, a language without kept terms, a source without terms, one source alone, repeated rows, a very long text, odd and even numbers of sources."""
    rnd = random.Random(9)
    words = ["Alpha", "beta", "gämma", "Ünder", "δέλτα", "x", "y", "zeta-eta", "don't", "99", "É"]
    rows = [(g, f"s{rnd.randint(0, n)}", " ".join(rnd.choices(words, k=rnd.randint(0, 12)))) for g, n in (("en", 4), ("de", 3), ("fr", 0)) for _ in range(25)]
    rows += [(None, None, None), (None, "a", "only once"), ("xx", "a", "alone"), ("xx", "b", "also"), ("en", "empty", " 12 "), ("en", "s1", "beta " * 300_000), ("de", None, "beta"), ("de", None, "beta")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, item string, value int")
    found = divergence.divergence(df, shard=shard, rounds=rounds, top=4)
    assert sorted(tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect()) == plain_divergence(rows, top=4)
    assert divergence.divergence(df.limit(0)).collect() == []


def test_every_pair_meets_once(spark):
    for n in range(2, 10):
        rounds = n - 1 + n % 2
        met = Counter()
        for r in spark.range(n).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("r")).withColumn("b", divergence.seats(F.col("a"), F.col("r"), F.lit(n).cast("bigint"))).where("b is not null").collect():
            met[frozenset((r["a"], r["b"]))] += 1
            assert r["a"] != r["b"]
        assert met == {frozenset((a, b)): 2 for a in range(n) for b in range(a)}


def test_shares_of_very_large_counts():
    counts, whole = np.array([0, 5, 10**13]), 10**13 + 5
    assert divergence.shares(counts, whole, 3).tolist() == [1 + 10**9 * (int(c) + 1) // (whole + 3) for c in counts]
    places = np.array([0, 4, 70_000])
    i, c = divergence.unpack(divergence.pack(places, counts))
    assert i.tolist() == places.tolist() and c.tolist() == counts.tolist()


# ---- token counts ---------------------------------------------------------------------------------------------------------------

ODD = ["", None, " ", "   a  b ", "a", "<s> x </s>", "▁▁x▁", "\x00\n\t", "é€😀中ﬁ", "the end, isn't it? 3.14² km²,", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "Wort" * 500, "one two " * 60_000]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())


def test_every_prefix_has_the_librarys_count(library):
    own, rnd = token_counts.pieces(token_counts.model_path()), random.Random(4)
    letters = "ab cdethe  ▁ing\n.,'01²éßü😀中<s>AZ_-"
    texts = [t for t in ODD[:11] if t] + ["".join(rnd.choices(letters, k=rnd.randint(1, 50))) for _ in range(400)]
    for text in texts:
        counts = token_counts.counts(*token_counts.packed(own.prefix(text)))
        assert counts.tolist() == [len(library.encode(text[:i])) for i in range(len(text) + 1)], text


def test_token_counts(spark, library):
    rows = [(i, t, 0, "x") for i, t in enumerate(ODD)] + [(3, ODD[3], 0, "x"), (None, "null id", 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, prefix string")
    found = token_counts.count_documents(df, 100).collect()
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 100) for i, t, _, _ in rows)
    assert Counter(tuple(r) for r in found) == want
    assert token_counts.count_documents(df.limit(0)).collect() == []


def test_token_counts_of_the_documents(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.QUERIES["op13_token_counts"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found} == {i: (len((t or "").encode()), n, n > 4096) for i, t in texts.items() for n in [len(library.encode(t or ""))]}


def test_budgets_are_looked_up(spark, library):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    table = token_counts.prefix_counts(df)
    at = {r["doc_id"]: r["n"] for r in table.select("doc_id", token_counts.tokens_at(F.lit(5)).alias("n")).collect()}
    assert at == {i: len(library.encode((t or "")[:5])) for i, t in enumerate(ODD)}
    for r in token_counts.budgets(df, table, 7).collect():
        text = ODD[r["doc_id"]]
        if text is None:
            assert (r["text"], r["n_tokens"]) == (None, 0)
            continue
        counts = [len(library.encode(text[:i])) for i in range(min(len(text), 400) + 1)]
        keep = max(i for i, n in enumerate(counts) if n <= 7)
        assert (r["text"], r["n_tokens"]) == (text[:keep], counts[keep])
