"""Language ID, SimHash, token ids, substrings, decontamination and toxicity against brute force on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import decontam, lang, overlap, simhash, substrings, tokens, toxicity

EDGES = [None, "", " \t\n", "x", "one two three", "é ß 漢字 \U0001f600", "a" * 70_000, "word " * 30_000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# ---- SimHash ------------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        w = w.replace(blank, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, distance):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [*EDGES[:6], "A b C d E f", "one two three four", "Éa b c d e f g h i"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_simhash_components(spark):
    rng = random.Random(1)
    base = [words(rng, 120) for _ in range(6)]
    texts = [*EDGES[:6], *base, *base[:2]]
    for b in base:
        for _ in range(5):
            w = b.split()
            w[rng.randrange(len(w))] = "edited"
            texts.append(" ".join(w))
    got = {r.doc_id: r for r in simhash.near_duplicate_documents(table(spark, texts, 10)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert {i: (f"{f:016x}", 10 + g) for i, (f, g) in enumerate(zip(fps, groups(fps, 4)), 10)} == {k: (r.fingerprint, r.component_id) for k, r in got.items()}


def near_fingerprints(rng, n):
    out = []
    while len(out) < n:
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 6])):
            out.append(f)
            for b in rng.sample(range(64), rng.choice([1, 2, 4, 5])):
                f ^= 1 << b
    return sorted(set(out[:n]))


@pytest.mark.parametrize("cell_rows", [1 << 16, 40, 3])
def test_gray_index_finds_every_link(spark, cell_rows):
    """Also when cells are cut into ranges of Gray rank."""
    from docloom.llm.components import components

    rng = random.Random(cell_rows)
    fps = near_fingerprints(rng, 300)
    hot = rng.getrandbits(64)
    fps = sorted({*fps, *(hot ^ (rng.getrandbits(40) << 24) for _ in range(300))})  # one block of bits in common
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(df, 4, cell_rows)).collect()}
    want: dict = {}
    for f, g in zip(fps, groups(fps, 4)):
        want.setdefault(g, set()).add(signed(f))
    got: dict = {}
    for f in fps:
        got.setdefault(roots.get(signed(f), signed(f)), set()).add(signed(f))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_keep_one_keeps_the_first_of_each_group(spark):
    rng = random.Random(3)
    a, b = words(rng, 80), words(rng, 80)
    docs = table(spark, [a, a, b, None, "", a]).withColumn("root", F.lit("mine")).withColumn("_key2", F.lit(1))
    docs = docs.unionByName(docs.where("doc_id = 0"))
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [0, 2, 3]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("leaders, frequent", [(4, 3), (1, 10**9)])
def test_keep_one_links_all_texts_of_similarity_08(spark, monkeypatch, leaders, frequent):
    """Edited copies on both sides of the bound, chains of them, and a passage that unlike texts share."""
    monkeypatch.setattr(overlap, "LEADERS", leaders)
    monkeypatch.setattr(overlap, "FREQUENT", frequent)
    rng = random.Random(5)
    texts, passage = list(EDGES), words(rng, 60, 10**6)
    for size in (7, 30, 120, 400):
        for _ in range(4):
            base = words(rng, size, 10**6)
            texts += [base, base + " more", " ".join(base.split()[1:]), *[edited(rng, base, max(1, size * k // 200)) for k in (1, 2, 3, 4, 5, 6)]]
            for _ in range(4):  # each an edit of the one before
                texts.append(edited(rng, texts[-1], max(1, size // 60)))
    texts += [words(rng, 10, 10**6) + " " + passage + " " + words(rng, rng.randrange(3, 40), 10**6) for _ in range(20)]
    rng.shuffle(texts)

    def grams(text):
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, label, linked = [grams(t) for t in texts], list(range(len(texts))), 0
    for i, s in enumerate(sets):
        for j in range(i):
            if s == sets[j] or (s | sets[j] and 5 * len(s & sets[j]) >= 4 * len(s | sets[j])):
                linked += s != sets[j]
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert linked > 50
    assert sorted(r.doc_id for r in simhash.keep_one(table(spark, texts)).collect()) == sorted(set(label))


def test_keep_one_begins_with_fingerprints_and_lists_no_pairs_of_a_group_of_edits(spark, monkeypatch):
    """300 edits of one text, many less alike than 0.8: pairs that the whole sets are read for stay few."""
    rng, made, asked = random.Random(8), {}, []
    base = words(rng, 150, 10**6)
    df = table(spark, [base, *[edited(rng, base, 1 + i % 12) for i in range(300)]])
    write, links = overlap.written, simhash.links

    def counted(rows, name):
        out = write(rows, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(overlap, "written", counted)
    monkeypatch.setattr(simhash, "links", lambda fps: asked.append(fps.count()) or links(fps))
    kept = simhash.keep_one(df).count()
    assert 1 < kept < 301 and asked == [made["fingerprints"]] and made["apart"] + made["stars"] < 3000


def test_copies_of_a_text_are_filed_once(spark, monkeypatch):
    rng, made = random.Random(4), {}
    a, b = words(rng, 300), words(rng, 300)
    write = substrings.written

    def counted(rows, name):
        out = write(rows, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(substrings, "written", counted)
    left = {}
    for n in (1, 40):
        df = table(spark, [*[a] * n, b, a[:900] + b[:900], None, "short"])
        left[n] = [(r.n_bytes, r.n_removed) for r in substrings.dedupe_digest(df).orderBy("doc_id").collect()]
        made[n] = made["filed"]
    assert made[40] == made[1] and all(x == y for x, y in left[40][:40]) and left[40][40:] == left[1][1:] and left[1][1][1] > 0


def test_texts_stay_where_they_are_if_few_are_copies(spark, monkeypatch):
    """Tables above the threshold of a broadcast, as on large inputs: texts are filed without a shuffle of theirs; above the bound on copies the ranges are the same."""
    rng, plans, write = random.Random(5), {}, substrings.written
    a, b = words(rng, 200), words(rng, 200)
    df = table(spark, [*[a] * 5, b, b, a[:700] + b[:700], words(rng, 90)]).select(F.xxhash64("doc_id", "text").alias("k"), "text")
    monkeypatch.setattr(substrings, "written", lambda rows, name: plans.setdefault(name, []).append(rows._jdf.queryExecution().executedPlan().toString()) or write(rows, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [sorted(tuple(r) for r in substrings.repeated_ranges(df, **most).collect()) for most in ({}, {"known_copies": 4})]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got[0] == got[1] and len({k for k, _, _ in got[0]}) == 8
    assert "BroadcastHashJoin" in plans["filed"][0] and "SortMergeJoin" not in plans["filed"][0] and "SortMergeJoin" in plans["filed"][1]


def test_parities_bound_the_difference_of_two_sets():
    rng = np.random.default_rng(3)
    for n in (0, 1, 40, 3000):
        both, one, two = (np.unique(rng.integers(0, 1 << 48, k, dtype=np.uint64)) for k in (200, n, 30))
        a, b = np.union1d(both, one), np.union1d(both, two)
        apart = int(np.bitwise_count(overlap.parities(a) ^ overlap.parities(b)).sum())
        assert apart <= len(np.setxor1d(a, b)) and (n == 3000 or apart >= 0.8 * len(np.setxor1d(a, b)))


def test_simhash_of_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, "else where now then"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicate_documents(df).collect()), key=repr)
    assert got == sorted([(None, 4), (4, 4), (None, None), (None, None)], key=repr)
    assert simhash.near_duplicate_documents(df.limit(0)).count() == 0


# ---- language -----------------------------------------------------------------------------------------------------------------

VOICES = {"en": "the house of this and that with other things they were thinking", "de": "das haus und nicht der große schöne weg durch die stadt ist", "fr": "la maison est dans les rues avec beaucoup de choses très belles", "es": "la casa está en las calles con muchas cosas muy bonitas que son"}


def spoken(rng, language, n):
    return " ".join(rng.choice(VOICES[language].split()) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(5)
    rows = [(i, spoken(rng, k := rng.choice(list(VOICES)), rng.choice([6, 30, 200])), k) for i in range(600)]
    truth = {i: k for i, _, k in rows}
    rows += [(1000, None, "en"), (1001, "123 !?", "de"), (1002, "", "fr"), (1003, rows[0][1], None), (None, rows[1][1], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in lang.predict_documents(df).collect()}
    assert len(got) == len(rows)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) for i in truth)
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == got[0].lang_pred


def plain_grams(text):
    """Every window whose inner characters are letters (of two characters: one of them), by character; the edges of a text count as no letter."""
    shown = "\0" + "".join(c if c.isalpha() else "\0" for c in text.lower()) + "\0" * 4
    for n in lang.ORDERS:
        for at in range(len(text.lower()) + 1):
            gram = shown[at : at + n]
            if (gram != "\0\0") if n == 2 else "\0" not in gram[1:-1]:
                yield gram


def test_predictions_equal_exact_sets(spark):
    """Sets of strings instead of filters of hashes: the same language wherever the two best are apart, nearly the same score and coverage."""
    rng = random.Random(15)
    rows = [(i, spoken(rng, k := rng.choice(list(VOICES)), rng.choice([1, 3, 30, 120])), k) for i in range(240)]
    rows += [(300 + i, spoken(rng, "en", 5) + " " + spoken(rng, "de", 5), None) for i in range(20)]  # near-ties
    rows += [(400 + i, t, "en" if i % 2 else "twin") for i, t in enumerate(spoken(rng, "en", 40) for _ in range(40))]  # a language that is another's twin
    rows += [(500, None, "en"), (501, "", "de"), (502, "12 -", "fr"), (503, "漢字 слово", None), (504, spoken(rng, "fr", 20_000), None), (None, rows[0][1], "fr"), (505, "a", None)]
    learned = [(t, k) for i, t, k in rows if i is not None and t is not None and k is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    size = {k: sum(x == k for _, x in learned) for _, k in learned}
    docs = {k: {} for k in size}
    for t, k in learned:
        for gram in set(plain_grams(t)):
            docs[k][gram] = docs[k].get(gram, 0) + 1
    rate = {k: {g: n / size[k] for g, n in found.items() if n / size[k] >= lang.MIN_SHARE} for k, found in docs.items()}
    most = {}
    for found in rate.values():
        for gram, x in found.items():
            most[gram] = max(x, most.get(gram, 0))
    kept = {k: {g for g, x in found.items() if x >= lang.LIKE * most[g]} for k, found in rate.items()}
    got = {r.doc_id: r for r in lang.predict_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    apart = 0
    for i, t, _ in rows:
        grams = list(plain_grams(t or ""))
        hits = sorted(((sum(g in kept[k] for g in grams), k) for k in kept), reverse=True)
        (top, best), (second, _) = hits[:2]
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score, got[i].coverage) == ("und", 0.0, 0.0)
            continue
        near = 0.01 * len(grams) + 1.5  # one false positive counts a little over 1
        if top - second > 2 * near:
            apart += 1
            assert got[i].lang_pred == best, (i, t)
        assert abs(got[i].coverage - top / len(grams)) <= near / len(grams) + 0.01, (i, t)
        if top > 4 * near:
            assert abs(got[i].score - 1 / (1 + (second / top) ** 4)) <= 0.05, (i, t)
    assert apart > 150  # of about 180 texts that are not in the language with a twin


def test_long_texts_are_read_in_slices(monkeypatch):
    """Language, fingerprints, shingles, words and token ids are the same whatever the slices are."""
    from docloom.llm import common

    rng = random.Random(12)
    texts = [spoken(rng, "en", 400) + " " + spoken(rng, "de", 90), "x" * 900, "", None, spoken(rng, "fr", 700) + "\n\n" + "é" * 300]
    model = lang.Filters(["en", "de"], [(int(x.view(np.int64)), i % 2) for i, x in enumerate(lang.grams(*lang.letters_of([texts[0]])[:1], 3)[1])])
    encode = tokens.Encoder(tokens.tokenizer_path())
    odd = "日本 " + texts[0]
    whole = [model.predict(texts), lang._document_counts(texts), [common.shingle_hashes(t, 4).tolist() for t in texts], [simhash.fingerprint(t) for t in texts], encode(odd)]
    monkeypatch.setattr(lang, "_CHUNK", 100)
    monkeypatch.setattr(tokens, "_WHOLE", 100)
    small = lambda text, most=0: slices(text, 64)
    slices = common.word_slices
    for module in (common, lang, tokens):
        monkeypatch.setattr(module, "word_slices", small)
    cut = [model.predict(texts), lang._document_counts(texts), [common.shingle_hashes(t, 4).tolist() for t in texts], [simhash.fingerprint(t) for t in texts], encode(odd)]
    for a, b in zip(whole, cut):
        for x, y in zip(a, b):
            assert np.array_equal(x, y)


def test_language_model_never_sees_the_held_out_fold(spark):
    rng = random.Random(6)
    rows = [(i, spoken(rng, "en", 20), "en") for i in range(50)]
    held = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else k) for i, t, k in rows]
    shape = "doc_id long, text string, lang string"
    assert {r.lang_pred for r in lang.predict_documents(spark.createDataFrame(held, shape)).collect()} == {"en"}
    assert {r.lang_pred for r in lang.predict_documents(spark.createDataFrame([(0, "text", None)], shape)).collect()} == {"und"}
    assert lang.predict_documents(spark.createDataFrame([], shape)).count() == 0


def test_look_up_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 4000).astype(np.uint64)
    f = lang.Filters([f"l{i}" for i in range(70)], [(int(x.view(np.int64)), i % 70) for i, x in enumerate(h)])
    for word in (0, 1):
        got = f.look_up(h, word)
        own = [i for i in range(len(h)) if i % 70 // 64 == word]
        assert all(int(got[i]) >> (i % 70 % 64) & 1 for i in own)
    other = f.look_up(rng.integers(0, 2**63, 4000).astype(np.uint64))
    assert np.mean(other & np.uint64(1)) < 0.01


# ---- token ids ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("values", [[], [0], [7] * 1000, list(range(512)), [3] * 511 + [2**32 - 1], [2**32 - 1, 0], [5] * 513])
def test_blocks_come_back(values):
    v = np.array(values, dtype=np.uint32)
    got, ids, counts = tokens.read_file(tokens.file_bytes(v, [None, 5], [0, len(v)]))
    assert got.tolist() == values and ids == [None, 5] and counts.tolist() == [0, len(v)]


def test_random_blocks_come_back():
    rng = np.random.default_rng(2)
    for n in (1, 511, 512, 513, 5000):
        v = np.where(rng.random(n) < 0.05, rng.integers(0, 2**32, n), rng.integers(0, 50_000, n)).astype(np.uint32)
        assert (tokens.read_file(tokens.file_bytes(v, [1], [n]))[0] == v).all()


ODD = ["It's the Café's ñ test", "can't WON'T I'LL x'd", "123 4_5 __a__ a1b2", " nbsp", "ÀÉÎ ŒÆ ÿŸ", "don’t — “q” …", "<|endoftext|> a", "İstanbul ſ K", "漢字かな 😀", "tab\tnew\n\nline \r\n", "a" * 5000, "!!!???...", "É́ é", "ab\x0bcd\x1cef"]


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    own, tiny, whole = tokens.Encoder(tokens.tokenizer_path()), tokens.Encoder(tokens.tokenizer_path(), 4), Tokenizer.from_file(tokens.tokenizer_path())
    rng = random.Random(0)
    kinds = "aAbZ09'_ \t\n.,!-éÉßñÑœ–’“ ́漢"
    for text in [*ODD, *["".join(rng.choice(kinds) for _ in range(40)) for _ in range(400)]]:
        ids = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own(text), "<u4").tolist() == ids and np.frombuffer(tiny(text), "<u4").tolist() == ids, repr(text)
    assert len(tiny.known) <= 2 and len(tiny.known.older) <= 2


def test_token_ids(spark):
    from tokenizers import Tokenizer

    texts = [*EDGES, *ODD]
    docs = table(spark, texts, 3).orderBy(F.rand(1))
    got = {r.doc_id: r for r in tokens.digest(tokens.tokenize_documents(docs)).collect()}
    whole, start = Tokenizer.from_file(tokens.tokenizer_path()), 0
    for i, t in enumerate(texts, 3):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    assert len(got) == len(texts)


def test_token_ids_of_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (2, "c"), (2, "c"), (1, None)], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = [(r.doc_id, r.start) for r in tokens.digest(tokens.tokenize_documents(df)).orderBy("start").collect()]
    assert [g[0] for g in got] == [None, 1, 2, 2] and got[0][1] == 0
    assert tokens.digest(tokens.tokenize_documents(df.limit(0))).count() == 0


# ---- substrings ---------------------------------------------------------------------------------------------------------------


def plain_cut(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen: dict = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot, rows", [(substrings.HOT_SEGMENTS, substrings.HOT_ROWS), (2, substrings.HOT_ROWS), (substrings.HOT_SEGMENTS, 1), (2, 1), (3, 4)])
def test_repeated_substrings(spark, hot, rows):
    rng = random.Random(7)
    long = words(rng, 150)
    shared = [words(rng, n) for n in (38, 45, 60, 200)]
    texts = [None, "", "short", long, long, "ab" * 400, "é" * 350, "z" * 200, "z" * 199]
    for _ in range(40):
        texts.append(words(rng, rng.randrange(5, 60)) + rng.choice(shared)[rng.randrange(30) :] + words(rng, rng.randrange(60)))
    texts.append(shared[3] + " " + shared[3])
    edge = words(rng, 60)
    texts += ["1" + edge[:200] + "2", "3" + edge[:200] + "4", "5" + edge[200:399] + "6", "7" + edge[200:399] + "8"]
    df = table(spark, texts).withColumn("kept", F.lit("clash")).withColumn("k", F.lit(3))
    got = {r.doc_id: r for r in substrings.dedupe(df, hot, rows).collect()}
    for i, want in enumerate(plain_cut(texts)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) == want, (i, texts[i])


@pytest.mark.parametrize("rows", [substrings.HOT_ROWS, 20])
def test_periodic_texts_and_many_copies(spark, rows):
    rng = random.Random(9)
    line = words(rng, 60)
    texts = [" " * 100_000, "x" + " " * 300 + "y", "abc" * 7_000, "z" + "abc" * 90, *[words(rng, 80)] * 5_000]
    texts += [words(rng, 20) + line + words(rng, 20) for _ in range(300)]
    cut = substrings.dedupe(table(spark, texts).repartition(3), hot_rows=rows)
    got = {r.doc_id: r for r in cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n_spans"), F.sha2("kept", 256).alias("sha")).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(plain_cut(texts)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].sha) == want, i


def test_repeated_rows_lose_all_they_share(spark):
    text = words(random.Random(8), 100)
    df = spark.createDataFrame([(1, text), (1, text), (None, text[:150])], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in substrings.dedupe_digest(df).collect())
    assert got == [(150, 0), (len(text), len(text)), (len(text), len(text))]
    assert substrings.dedupe_digest(df.limit(0)).count() == 0


def test_bucket_pointer_refinement_equals_sorting():
    rng = np.random.default_rng(3)
    for text in (rng.integers(97, 99, 600), np.tile([97, 98, 97], 200), np.full(300, 97)):
        text = text.astype(np.uint8)
        for depth in (3, 8, 20, 200):
            pointer = substrings.buckets(text, depth)
            at = range(len(text) - depth + 1)
            whole = [text[i : i + depth].tobytes() for i in at]
            order = sorted(at, key=lambda i: whole[i])
            for a, b in zip(order, order[1:]):
                assert (pointer[a] == pointer[b]) == (whole[a] == whole[b]) and pointer[a] <= pointer[b]


# ---- decontamination ----------------------------------------------------------------------------------------------------------


def plain_score(item, passage):
    """Smith-Waterman in full, over the whole document."""
    a, b = ([w for w in map(decontam.normal, t.split()) if w] for t in (item, passage))
    if len(a) < decontam.SEED:
        return 0.0
    above, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[j] - 1))
        above, best = row, max(best, *row)
    return best / (2 * len(a)) if len(a) >= decontam.MIN_WORDS or best == 2 * len(a) else 0.0


def test_decontamination(spark):
    rng = random.Random(9)
    items = [words(rng, n, 5000) for n in (8, 20, 40, 80, 3)]
    docs = [None, "", *[words(rng, 300, 5000) for _ in range(30)]]
    for t in items:
        w = t.split()
        filler = words(rng, 50, 5000)
        docs.append(f"{filler} {t.upper()}, {filler}")
        edited = [x for i, x in enumerate(w) if i % 7 != 6]
        docs.append(f"{filler} {' '.join(edited)} {filler}")
        docs.append(" ".join(w[len(w) // 2 :]) + " " + filler)
        docs.append(" ".join([*w[: len(w) // 4], filler]))
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    df = table(spark, docs).withColumn("item_id", F.lit(2))
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(df, bench).collect()}
    want = {(d, i): s for d, t in enumerate(docs) for i, x in enumerate(items) if (s := plain_score(x, t or "")) >= decontam.MIN_SCORE}
    assert got == pytest.approx(want, abs=1e-5)
    clean = decontam.clean(df, bench)
    assert clean.columns == df.columns
    assert any(i == 4 for _, i in want)  # three words, found word for word
    assert {r.doc_id for r in clean.collect()} == {*range(len(docs))} - {d for d, i in want if i != 4}


def test_decontamination_of_empty_tables(spark):
    df, bench = table(spark, ["some text here for all of it"]), spark.createDataFrame([(1, "some text here for all of it")], "item_id long, text string")
    assert decontam.contaminated(df, bench.limit(0)).count() == 0 and decontam.contaminated(df.limit(0), bench).count() == 0
    assert decontam.contaminated(df, bench).count() == 1 and decontam.clean(df, bench.limit(0)).count() == 1


# ---- toxicity -----------------------------------------------------------------------------------------------------------------


def test_grammar():
    T = toxicity
    score = lambda *kinds: T.clause_score(list(kinds), [1.0 if k in (T.INSULT, T.THREAT) else 0.0 for k in kinds])
    assert score(T.OTHER, T.INSULT) == 1.0
    assert score(T.TARGET, T.INSULT) > 1.0 > score(T.NEGATION, T.INSULT) and score(T.REPORT, T.OTHER, T.INSULT) < 1.0
    assert score(T.THREAT) < score(T.TARGET, T.THREAT)
    assert score(T.NEGATION, *[T.OTHER] * 3, T.INSULT) == 1.0 and score(T.OTHER) == 0.0


def plain_clause(classes, weights):
    """The four rules in words."""
    total = 0.0
    for i, (c, w) in enumerate(zip(classes, weights)):
        if c in (toxicity.INSULT, toxicity.THREAT):
            target, report = toxicity.TARGET in classes[:i], toxicity.REPORT in classes[:i]
            w *= (1.25 if target else 1) * (0.6 if report else 1) * (0.5 if toxicity.NEGATION in classes[max(0, i - 3) : i] else 1)
            w *= 0.3 if c == toxicity.THREAT and not target else 1
        else:
            w = 0
        total += w
    return total


def test_composed_transducer_equals_its_rules():
    rng = random.Random(4)
    for _ in range(500):
        classes = [rng.randrange(6) for _ in range(rng.randrange(1, 12))]
        weights = [rng.random() if c in (toxicity.INSULT, toxicity.THREAT) else 0.0 for c in classes]
        assert toxicity.clause_score(classes, weights) == pytest.approx(plain_clause(classes, weights))


def test_toxicity(spark):
    rng = random.Random(10)
    rude, rows, labels = ["grobbel", "snarkwit", "oafling"], [], []
    for i in range(900):
        text, toxic = words(rng, 30), i % 3 == 0
        if toxic:
            text += f" you {rng.choice(rude)} and {rng.choice(rude)}. " + words(rng, 10)
        rows.append((i, text))
        labels.append((i, int(toxic)))
    rows += [(2000, None), (2001, ""), (None, "you grobbel"), (2002, "x" * 100_000)]
    labels += [(None, 1), (5, None), (2001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = {r.doc_id: r for r in toxicity.score_documents(docs, marks).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in held) for i in range(900))
    assert sum(got[i].predicted == (i % 3 == 0) for i in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert got[2000].score == got[2001].score == got[2002].score < 0.7
    none = toxicity.score_documents(docs, marks.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.0]
    assert toxicity.score_documents(docs.limit(0), marks).count() == 0


def test_a_worker_drops_the_tokenizer_in_other_operators_tasks():
    from pyspark import cloudpickle

    from docloom.llm import common

    sent = {}
    for module in (tokens.__name__, simhash.__name__):

        def run(batches):
            yield from batches

        run.__module__ = module
        sent[module] = cloudpickle.loads(cloudpickle.dumps(common.trimmed(run)))  # as a worker gets it
    first = tokens.encoder(tokens.tokenizer_path())
    assert list(sent[tokens.__name__](iter([1]))) == [1] and tokens.encoder(tokens.tokenizer_path()) is first
    assert list(sent[simhash.__name__](iter([1]))) == [1] and tokens.encoder(tokens.tokenizer_path()) is not first
