"""Source divergence, MinHash near duplicates and conversation repair against plain computations, and on odd tables."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import divergence, jaccard_join, minhash, repair, shingles

LONG = "word " * 30_000 + "x" * 3000
SCHEMA = "doc_id bigint, text string, lang string, source string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- 11: divergence -------------------------------------------------------------------------------


def plain_divergences(rows, top=200):
    counts, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in docs[lang].items() if n >= 3)
        own = {s: counts[lang, s] for g, s in groups if g == lang}
        whole = sum(own.values(), collections.Counter())

        def share(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept))

        def ranked(part, values, lang=lang, source=source):
            return [(lang, source, part, item, v, r) for r, (item, v) in enumerate(sorted(values.items(), key=lambda x: (-x[1], x[0].encode())), 1)]

        p = {t: share(own[source], t) for t in kept}
        out += ranked("pair", {o: sum((p[t] - q) ** 2 // q for t in kept for q in [share(own[o], t)]) for o in own if o != source})
        terms = {t: (p[t] - q) ** 2 // q for t in kept for q in [share(whole, t)] if own[source][t] and p[t] > q}
        out += ranked("term", terms)[:top]
    return sorted(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{'abcdefghij'[i % 10]}{'klmnop'[i // 10 % 6]}" for i in range(60)] + ["É", "é", "İx", "K", "it's", "a1b", "ÀB"]
    texts = [" ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=rng.randint(0, 30))) for _ in range(n // 2)]
    return [(i, rng.choice(texts), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "É", None, "ab"])) for i in range(n)]


def test_divergence_equals_plain_arithmetic(spark):
    rows = [*corpus(1), (500, LONG, "en", "a"), (500, LONG, "en", "b"), (None, LONG, "en", "b"), (501, None, "fr", "only"), (502, "", "fr", "two"), (503, "gone", None, "c")]
    got = divergence.divergences(spark.createDataFrame(rows, SCHEMA).withColumn("term", F.lit("clash")).withColumn("n", F.lit(1)))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain_divergences(rows)


def test_divergence_of_one_source_and_of_nothing(spark):
    assert divergence.divergences(spark.createDataFrame([], SCHEMA)).count() == 0
    assert divergence.divergences(spark.createDataFrame([(1, "a b", "en", "s")], SCHEMA)).count() == 0  # no other source, no kept term
    some = spark.createDataFrame(corpus(3), SCHEMA)
    assert divergence.divergences(some, top=2).where("part = 'term'").agg(F.max("rank")).first()[0] == 2


def test_divergence_flushes_lose_nothing(spark, monkeypatch):
    rows = corpus(2)
    monkeypatch.setattr(divergence, "HELD_TEXT", 300)
    monkeypatch.setattr(divergence, "HELD_COUNTS", 3)
    assert sorted(tuple(r) for r in divergence.divergences(spark.createDataFrame(rows, SCHEMA)).collect()) == plain_divergences(rows)


def test_divergence_shares_are_exact_for_huge_counts(spark):
    n, total, terms = 10**13 + 7, 10**15 + 1, 12345
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms)).alias("p"), divergence.excess(F.lit(10**9 + 1).cast("bigint"), F.lit(1).cast("bigint")).alias("f")).first()
    assert row.p == 1 + 10**9 * (n + 1) // (total + terms) and row.f == 10**18


# -- 12: near duplicates --------------------------------------------------------------------------


def brute_components(rows, k=4, percent=80):
    sets = {}
    for i, text in rows:
        w = lower(text).encode().split()
        sets[i] = {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def varied(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(40):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([1, 3, 4, 6, 12, 40, 120]))]
        for _ in range(rng.randint(1, 12)):
            own = base[:]
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"n{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(own)))
    return rows + [(9000, None), (9001, ""), (9002, " \n"), (9003, LONG), (9004, LONG + " end")]


def test_minhash_equals_brute_force(spark):
    rows = varied(4)
    docs = spark.createDataFrame([*rows, (None, rows[5][1]), (None, "other words without an id")], "doc_id bigint, text string").withColumn("set_id", F.lit("clash")).withColumn("kept", F.lit(1))
    got = minhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2


def test_minhash_repeated_ids_and_empty(spark):
    text = " ".join(f"a{i}" for i in range(30))
    docs = spark.createDataFrame([(7, text), (7, text), (7, "x y z"), (3, text)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()) == [(3, 3), (7, 3), (7, 3), (7, 7)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def near_copies(n, seed=5):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    rows = []
    for i in range(n):
        own = base[:]
        for at in rng.sample(range(120), rng.randint(1, 4)):
            own[at] = f"n{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(own)))
    return rows


def test_minhash_group_of_near_copies(spark, monkeypatch):
    verify, pairs = minhash.verify, []
    monkeypatch.setattr(minhash, "verify", lambda found, *rest: (pairs.append(found.count()), verify(found, *rest))[1])
    monkeypatch.setattr(jaccard_join, "SQUARE", 50)  # lists of several squares
    rows = near_copies(400)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    assert sum(pairs) <= 10 * 400  # pairs whose texts were read


def test_lists_are_split_and_only_sets_outside_the_largest_component_meet_all(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SQUARE", 4)
    rows = [(1, i, 10, 0, 0 if i < 20 else i) for i in range(26)] + [(2, i, 10, 0, i) for i in range(5)] + [(3, i, 10, 0, 3) for i in range(9)]
    lists = spark.createDataFrame(rows, "shingle bigint, set_id bigint, n int, place int, component bigint")
    sketches = spark.createDataFrame([(i, [0] * 16) for i in range(26)], "set_id bigint, sketch array<bigint>")
    got = {(r.a, r.b) for r in jaccard_join.across_lists(lists, sketches, F.lit(True)).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(range(26), 2) if b >= 20} | set(itertools.combinations(range(5), 2))


def test_signatures_estimate_similarity(monkeypatch):
    rng = random.Random(8)
    base = [f"a{i}" for i in range(900)]
    texts = [" ".join(w if rng.random() < keep else f"b{rng.randint(0, 10**6)}" for w in base).encode() for keep in (1, 0.99, 0.95)]
    sets = shingles.shingle_sets(texts, 4)
    whole = minhash.signatures(sets.values, sets.bounds)
    monkeypatch.setattr(minhash, "CHUNK", 100)
    assert (minhash.signatures(sets.values, sets.bounds) == whole).all()
    for (i, a), (j, b) in itertools.combinations(enumerate(map(set, sets)), 2):
        assert abs((whole[i] == whole[j]).mean() - len(a & b) / len(a | b)) < 0.2


def test_odds_of_missing_a_link():
    from math import comb

    n, t = minhash.COORDINATES, minhash.MATCHES
    missed = lambda j: sum(comb(n, k) * j**k * (1 - j) ** (n - k) for k in range(t))
    assert missed(0.8) < 1e-5 and missed(0.85) < 1e-8


# -- 13: conversations ----------------------------------------------------------------------------


def every_edit(codes):
    """(cost, audit) of the cheapest edits by trying all."""
    best = 4 * len(codes), "D" * len(codes)

    def go(i, state, cost, audit):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(codes) and state in (repair.NONE, repair.ASSISTANT):
            best = min(best, (cost, audit))
        if not audit.endswith("III"):
            go(i, repair.INSERTED[state], cost + 3, audit + "I")
        if i < len(codes):
            initial, fault = codes[i] % 4, codes[i] // 4
            go(i + 1, state, cost + 4, audit + "D")
            if fault < 2:
                go(i + 1, repair.INSERTED[state], cost + 3 + 3 * fault, audit + "R")
                if (state, initial) in repair.KEPT:
                    go(i + 1, repair.KEPT[state, initial], cost + 3 * fault, audit + "K")

    go(0, repair.NONE, 0, "")
    return best


def divided(codes):
    costs, order = repair.forward(codes, repair.NONE)
    total = [c + 3 * n for c, n in zip(costs, repair.END_INSERTS, strict=True)]
    end = min(range(4), key=lambda s: (total[s], order[s]))
    return total[end], "".join(repair.edits_between(codes, repair.NONE, end)) + "I" * repair.END_INSERTS[end]


def test_edits_are_the_cheapest_and_first_of_all():
    rng = random.Random(1)
    for _ in range(600):
        codes = bytes(rng.choices(range(16), weights=[6, 6, 6, 1, 3, 3, 3, 1] + [1] * 8, k=rng.randint(0, 6)))
        assert divided(codes) == every_edit(codes)


def plain_repair(rows):
    """The query's columns by one table over all rows and states."""
    import zlib

    chats = {}
    for conv, turn, role, text in rows:
        chats.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        chats[conv] += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {}
    for conv, turns in chats.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, codes, count = set(), [], collections.Counter()
        for _, role, text in turns:
            body = text.strip(repair.SPACES)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            codes.append((role[:1], fault))
        best = {0: (0, "", [])}
        for (initial, fault), (_, role, text) in zip(codes, turns, strict=True):
            new = {}
            for state, (cost, audit, said) in best.items():
                for inserts in range(3):
                    s, own = state, list(said)
                    for _ in range(inserts):
                        s = repair.INSERTED[s]
                        own.append("user:" if s == 2 else "assistant:")
                    ways = [(s, 4, "D", [])]
                    if fault not in ("blank", "duplicate"):
                        extra, to = 3 * (fault == "truncated"), repair.INSERTED[s]
                        ways.append((to, 3 + extra, "R", [("user:" if to == 2 else "assistant:") + text]))
                        if initial and (s, "sua".find(initial)) in repair.KEPT:
                            ways.append((repair.KEPT[s, "sua".find(initial)], extra, "K", [f"{role}:{text}"]))
                    for to, c, edit, line in ways:
                        way = cost + 3 * inserts + c, audit + "I" * inserts + edit, own + line
                        new[to] = min(new.get(to, way), way)
            best = new
        ends = [(c + 3 * n, a + "I" * n, said + ["user:", "assistant:"][2 - n :]) for s, (c, a, said) in best.items() for n in [repair.END_INSERTS[s]]]
        cost, audit, said = min(ends)
        numbers = [t for t, _, _ in turns if t is not None]
        pairs = [a[0] + b[0] for a, b in itertools.pairwise(codes)]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


CHATS = "conv_id bigint, turn bigint, role string, text string"


def odd_chats(seed, n=60):
    rng = random.Random(seed)
    texts = ["Yes.", "no", " \t", "", None, "what?\n", "a.b c", "é!", " "]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "User", "sys"]
    return [(rng.choice([None, *range(n // 8)]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)] + [(77, 1, "user", "the only row.")]


@pytest.mark.parametrize("seed,block", [(1, 4096), (2, 1), (3, 3)])
def test_repair_equals_one_table(spark, monkeypatch, seed, block):
    monkeypatch.setattr(repair, "BLOCK", block)  # small blocks: conversations of many
    rows = odd_chats(seed, 240)
    turns = spark.createDataFrame(rows, CHATS).withColumn("code", F.lit("clash")).withColumn("edits", F.lit(1))
    got = {r[0]: tuple(r[1:]) for r in repair.repair_digests(turns, repair.damage(turns)).collect()}
    assert got == plain_repair(rows)


def test_repair_of_a_long_conversation_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 64)
    rng = random.Random(6)
    rows = [(5, i, rng.choice(["user", "assistant"]), f"{i}{rng.choice(['.', '!', ''])}") for i in range(3000)] + [(5, 3000, "user", "x" * 400_000 + ".")]
    turns = spark.createDataFrame(rows, CHATS).repartition(7)
    got = repair.repair_digests(turns, repair.damage(turns)).first()
    assert tuple(got[1:]) == plain_repair(rows)[5]


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Are you there?"), (1, 2, "tool", "Yes."), (2, 0, "assistant", ""), (3, 0, "system", "Be kind."), (3, 1, "user", "Ok?")]
    got = repair.repair_turns(spark.createDataFrame(rows, CHATS)).orderBy("conv_id", "place").collect()
    said = [(r.conv_id, r.edit, r.role, r.text) for r in got]
    assert said == [
        (1, "D", None, None), (1, "K", "user", "Are you there?"), (1, "R", "assistant", "Yes."), (2, "D", None, None),
        (3, "K", "system", "Be kind."), (3, "K", "user", "Ok?"), (3, "I", "assistant", ""),
    ] or said[0][1] == "K"
    kept = "".join((r.role or "")[:1] for r in got if r.conv_id == 1)
    assert re.fullmatch("(s?(ua)+)?", kept) and repair.repair_turns(spark.createDataFrame([], CHATS)).count() == 0


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], CHATS)
    assert repair.repair_digests(none, repair.damage(none)).count() == 0
    dropped = spark.createDataFrame([(conv, 0, "user", "x.") for conv in range(200)], CHATS)
    gone = [r for r in repair.repair_digests(dropped, repair.damage(dropped)).collect() if not r.audit]
    assert gone and all(tuple(r)[1:7] == (0,) * 6 and r.repaired_sha256 == hashlib.sha256(b"").hexdigest() for r in gone)


def test_orders_of_forward_vectors_are_those_of_the_edits():
    rng = random.Random(9)
    for _ in range(200):
        codes = bytes(rng.choices(range(16), k=rng.randint(1, 9)))
        costs, order = repair.forward(codes, repair.NONE)
        audits = {s: "".join(repair.edits_between(codes, repair.NONE, s)) for s in range(4) if costs[s] < repair.NEVER}
        assert sorted(audits, key=audits.get) == sorted(audits, key=lambda s: order[s]) and np.all(np.array(repair.backward(codes, 3))[0] >= costs[3])


# -- 2 and 7 again --------------------------------------------------------------------------------


def test_wrapped_notices_in_code_and_sql(spark):
    import textwrap

    import duckdb

    from docweave.llm import license_scan

    rng = random.Random(11)
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "under the MIT\nlicense"), (4, "Licensed\nunder the Apache\nLicense, Version 2.0 and more")]
    for _, notice in license_scan.TEMPLATES:
        for width in (12, 30, 70):
            before, after = (" ".join(rng.choices(["alpha", "beta", "gamma", "the", "license"], k=rng.randint(0, 40))) for _ in range(2))
            rows.append((len(rows), f"{before}\n" + "\n".join(textwrap.wrap(notice, width)) + f"\n{after}"))
            lost = notice.split()
            del lost[:: rng.choice([2, 4, 9])]  # with too few of its words, or just enough
            rows.append((len(rows), "\n".join(textwrap.wrap(" ".join(lost), width))))
    got = sorted(map(tuple, license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    columns = "doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score"
    want = sorted(con.execute(f"select {columns} from ({license_scan.ORACLE_SQL})").fetchall())
    assert got == want and sum(r[6] != "" and r[5] == "" for r in got) > 20


@pytest.mark.parametrize("n", [200, 1000, 5000])
@pytest.mark.parametrize("kind", ["varied", "frequent"])
def test_paraphrases_are_found_however_many_items_there_are(spark, n, kind):
    """Items of 30 words, each once with every sixth word replaced, so that no run of 8 words is left."""
    from docweave.llm import lsa_decontaminate

    rng = np.random.default_rng(n)
    size = 30_000 if kind == "frequent" else 10**9
    draw = lambda k: [f"w{x}" for x in (rng.zipf(1.2, k * 4) % size if kind == "frequent" else rng.integers(0, size, k))[:k]]
    items = [draw(30) for _ in range(n)]
    docs = []
    for i, words in enumerate(items):
        own = list(words)
        for at in range(3, 30, 6):
            own[at] = f"other{i}x{at}"
        docs.append((i, " ".join([*draw(20), *own, *draw(20)])))
    clean = [(n + i, " ".join(draw(80))) for i in range(300)]
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    got = lsa_decontaminate.find_leaks(spark.createDataFrame(docs + clean, "doc_id bigint, text string"), benchmark).collect()
    right = {r.doc_id for r in got if r.doc_id == r.item_id}
    assert len(right) >= 0.9 * n
    assert sum(r.doc_id >= n for r in got) <= 0.01 * n + 3  # clean documents
