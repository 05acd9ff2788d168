"""Each operator against a plain computation of the same, and on odd tables.

Odd: nulls in any column, empty and very long texts, ties and repeated rows, an empty
table, and extra columns whose names clash with those that are added.
"""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import chat_format, ctw, html_extract, jaccard_join, license_scan, lsa_decontaminate, packing, quality, shingles, url_filter, warc
from docweave.llm.common import connected_components
from docweave.llm.queries import tokenizer_path

LONG = "word " * 60_000 + "x" * 3000
DOCS = [
    (0, "Released under the MIT License. Ünder THE mit license", "en", "s0"), (1, None, None, None), (2, "", "en", "s0"), (3, " \n\t ", "en", "s1"),
    (4, "a b c", "en", "s1"), (5, "a b c", "en", "s1"), (5, "a b c", "en", "s1"), (6, LONG, "en", "s0"), (None, "no id here at all", "en", "s0"), (7, "K İ \x00 é\u00a0z <|endoftext|> it's", "en", None),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


# -- 1: language model ---------------------------------------------------------------------------


def tree_probability(train, text, depth):
    """log10 of the mixture for ``text`` by the textbook recursion over one context tree per node."""
    counts = collections.defaultdict(lambda: [0, 0])

    def steps(data):
        padded = b"\0" * depth + data
        for i, byte in enumerate(data):
            for k in range(8):
                node, bit = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1
                yield padded[i : i + depth], node, bit

    for data in train:
        for context, node, bit in steps(data):
            for d in range(depth + 1):
                counts[context[depth - d :], node][bit] += 1
    children = collections.defaultdict(set)
    for context, node in counts:
        if context:
            children[context[1:], node].add(context)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def weighted(context, node):
        key = context, node
        if key not in memo:
            a, b = counts.get(key, (0, 0))
            if len(context) == depth:
                memo[key] = kt(a, b)
            else:
                memo[key] = np.logaddexp(kt(a, b), sum(weighted(c, node) for c in children.get(key, ()))) - math.log(2)
        return memo[key]

    total = 0.0
    for context, node, bit in steps(text):
        one, rest = 0.0, 1.0
        for d in range(depth + 1):
            own = context[depth - d :]
            a, b = counts.get((own, node), (0, 0))
            w = 1.0 if d == depth else math.exp(kt(a, b) - weighted(own, node) - math.log(2))
            one, rest = one + rest * w * (b + 0.5) / (a + b + 1), rest * (1 - w)
        total += math.log10(one if bit else 1 - one)
    return total


def test_ctw_equals_recursion(spark):
    rows = [(0, "the cat sat on the mat"), (1, "the dog sat"), (2, "a Cat, a hat"), (3, None)]
    got = {r.doc_id: r for r in ctw.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), F.col("doc_id") < 2).collect()}
    train = [(t or "").encode().lower() + ctw.END for i, t in rows if i < 2]
    for i, t in rows:
        assert abs(got[i].score - tree_probability(train, (t or "").encode().lower() + ctw.END, ctw.DEPTH)) < 1e-5
        assert got[i].held_out == (i >= 2) and got[i].train_tokens == 11
    counts = collections.Counter(w for i, t in rows[:2] for w in [*words(t), None])
    for i, t in rows:
        own = [*words(t), None]
        assert got[i].n_tokens == len(own) and got[i].n_known == sum(counts[w] > 0 for w in own)
        assert abs(got[i].base_score - sum(math.log10((counts[w] + 1) / (11 + len(counts) + 1)) for w in own)) < 1e-9


def test_ctw_odd_tables(spark, docs, none):
    clash = docs.withColumn("score", F.lit("x")).withColumn("bucket", F.lit(1))
    assert ctw.score_texts(clash, F.lit(None).cast("boolean")).count() == len(DOCS)
    assert ctw.score_texts(none, F.lit(True)).count() == 0
    unlearnt = ctw.score_texts(docs.where("doc_id = 4"), F.lit(False)).first()
    assert abs(unlearnt.bits_per_byte - 8) < 1e-6 and unlearnt.n_known == 0 and unlearnt.base_score == 0


def test_ctw_beats_unigrams_on_held_out(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(1500)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=60))) for i in range(400)]
    got = ctw.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), F.col("doc_id") % 4 != 0)
    held = got.where("held_out").agg(F.avg("bits_per_byte").alias("bits")).first()
    assert held.bits < 3.3  # of about log2(10) = 3.3 per letter if words were not learnt


def test_ctw_deals_out_in_steps(spark, docs, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(0, 90)))) for i in range(300)]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(docs.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text")).repartition(12, "doc_id")
    learn = F.col("doc_id") % 3 != 0
    plain = sorted(map(tuple, ctw.score_texts(texts, learn).collect()), key=str)
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 12_000)
    seen, up = [], ctw.steps_up
    monkeypatch.setattr(ctw, "steps_up", lambda blocks, rows_of, buckets: seen.append((buckets, up(blocks, rows_of, buckets))) or seen[-1][1])
    got = sorted(map(tuple, ctw.score_texts(texts, learn, fan=5).collect()), key=str)
    assert len(got) == len(plain) == len(rows) + len(DOCS)
    for a, b in zip(got, plain, strict=True):
        assert a[:5] == b[:5] and all(abs(x - y) <= 1e-6 * max(1, abs(y)) for x, y in zip(a[5:], b[5:], strict=True))
    for buckets, steps in seen:
        assert len(steps) == len(buckets) == 3 and steps[0].select("member").distinct().count() > 5
        for size, finer in zip(buckets, buckets[1:], strict=False):
            assert finer % size == 0 and finer // size <= 5
        for k, step in enumerate(steps):  # fan rows a block, and one a bucket, not blocks times buckets
            assert step.count() <= buckets[0] * steps[0].select("member").distinct().count() + sum(buckets[1 : k + 1])


def test_ctw_moduli():
    for buckets in [7, 509, 511, 10_001, 12_000_001]:
        steps = ctw.moduli(buckets)
        assert steps[-1] >= buckets and all(b % a == 0 and b // a <= ctw.FAN for a, b in zip(steps, steps[1:], strict=False)) and steps[0] <= ctw.FAN
        assert all(n % 2 for n in steps) and steps[-1] <= 2 * buckets + ctw.FAN


# -- 2: licenses ----------------------------------------------------------------------------------


def test_license_scan(spark, docs, none):
    rows = [(10, "x\nLICENSED under cc-BY-nc 4.0!\nunder the MIT license, cc by nc"), (11, "License, Version 2: Apache"), (12, "This work is licensed under the GNU General Public License, version 3.")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert (got[10].n_words, got[10].n_base, got[10].first_word, got[10].last_word) == (15, 3, 3, 12)
    assert got[10].base_labels == "cc-by-nc,mit" and got[10].score == 1.0
    assert (got[11].n_base, got[11].first_word, got[11].labels, got[11].score) == (0, None, "", 0.0)
    assert (got[12].base_labels, got[12].labels) == ("", "gpl") and got[12].score == 1.0
    odd = license_scan.scan_licenses(docs.withColumn("labels", F.lit(1)).withColumn("n_words", F.lit(2)))
    assert odd.count() == len(DOCS) and odd.where("doc_id = 0").first().n_base == 1  # "ünder" is another word
    assert license_scan.scan_licenses(none).count() == 0


def test_license_join_loses_nothing(spark):
    rng = random.Random(1)
    pool = sorted({w for _, t in license_scan.TEMPLATES for w in license_scan._template_words(t)}) + [f"w{i}" for i in range(20)]
    rows = [(i, "\n".join(" ".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(3))) for i in range(120)]
    rows += [(500 + k, " ".join(rng.sample(ws := license_scan._template_words(t), math.ceil(0.8 * len(ws)))) + " extra") for k, (_, t) in enumerate(license_scan.TEMPLATES)]
    df = spark.createDataFrame(rows, "doc_id bigint, low string")
    got = {(r.doc_id, r.label, round(r.score, 9)) for r in license_scan.match_templates(df, "doc_id", "low", license_scan.TEMPLATES, 0.8).collect()}
    want = {}
    for i, t in rows:
        for line in t.split("\n"):
            for label, template in license_scan.TEMPLATES:
                own = set(license_scan._template_words(template))
                share = len(own & set(line.split())) / len(own)
                if share >= 0.8 - 1e-9:
                    want[i, label] = max(share, want.get((i, label), 0))
    assert got == {(i, label, round(s, 9)) for (i, label), s in want.items()} and len(got) >= len(license_scan.TEMPLATES)


def test_license_notices_are_found_however_wrapped(spark):
    import textwrap

    rows = [(None if k % 2 else k, "Intro\n" + textwrap.fill(f"a b {t} c d", width, break_long_words=False), label) for k, (width, (label, t)) in enumerate((w, x) for w in (12, 40, 72) for x in license_scan.TEMPLATES)]
    rows.append((None, "nothing here\nof the kind", None))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, want string")
    found = license_scan.scan_licenses(docs.select("doc_id", "text")).collect()
    assert len(found) == len(rows)
    labels = collections.Counter((r.doc_id, r.n_words, label) for r in found for label in r.labels.split(","))
    wanted = collections.Counter((i, len([w for w in re.split(license_scan.BREAKS, t.lower()) if w]), label or "") for i, t, label in rows)
    assert not wanted - labels, wanted - labels


# -- 3: html --------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>if(a<b)"</p>"</script></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><article><header><h1>T&eacute;st &amp; more</h1></header><p>Some <a href=x>link</a>ed
 words that are <b>bo</b>ld&nbsp;here, and more of them follow.<p>Second &lt;b&gt; para<br>graph.<div class="ad">buy now</div><section class="comments"><p>Nice post</p></section></article>
<aside>side</aside><form>Name <input></form><footer>&copy; c</footer></body></html>"""


def test_html_extraction(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<p>only words <b>here"), (4, "w", "<p>only words <b>here"), (5, "x", "<<< & <a"), (6, "y", "<p>" + "long " * 50_000)], "page_id bigint, url string, html string")
    got = [r.asDict() for r in html_extract.extract_main_text(pages.withColumn("text", F.lit("clash"))).collect()]
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == "Tést & more Some linked words that are bold here, and more of them follow. Second <b> para graph."
    assert text[2] == "" and text[3] == "" and text[4] == "only words here" and len(got) == 7 and len(text[6].split()) == 50_000
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("part", ["<a ", "<b>x ", "<div>x", "<a<a", "<a '", "<!x ", "</script", '<div class="ad">x <article>y</article>', "<html><body>", "<li><b>x", "<p>x<div>"])
def test_html_never_closed(part):
    """1 MB of what is never closed is read in seconds."""
    page, began = part * (1_000_000 // len(part)) + " '>", time.perf_counter()
    html_extract.extract_text(page, html_extract.Weights())
    assert time.perf_counter() - began < 20  # about 4 s; hours if each tag looked at all others


def test_html_markup_keeps_all_characters():
    """What markup() yields, put together again, is the page without its comments."""
    rng = random.Random(11)
    bits = ["<div>", "</p>", "<a href='x'>", "word ", "<", ">", '"', "'", "<b", "</", "/>", "<x y=\"1\"z>", "é "]
    for _ in range(2000):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(0, 15)))
        found = "".join(text or f"<{'/' * slash}{name}{attributes}>" for name, attributes, text, slash in html_extract.markup(page))
        assert found == page.lower()


def test_html_weights_count_all_tags(spark):
    tag = "x-a-long-name-of-a-custom-element"
    pages = [(f"<nav><{tag}>menu</{tag}></nav><article><p>words here</p></article>",)] * 20 + [("".join(f"<made{i}>" for i in range(300)) + "<main>text</main>",)]
    weights = html_extract.learn_weights(spark.createDataFrame(pages, "html string"))
    assert tag in weights.tags and "made299" in weights.tags and "p" in weights.tags
    counts = collections.Counter()
    for (page,) in pages:
        counts.update(html_extract.count_classes(page))
    inn, out = (sum(n for (_, i), n in counts.items() if i == side) for side in (True, False))
    assert weights.tags[tag] == pytest.approx(min(-0.2, math.log((counts[tag, True] + 0.5) / (inn + 1)) - math.log((counts[tag, False] + 0.5) / (out + 1))))


def test_best_run_is_best():
    rng = random.Random(5)
    for _ in range(300):
        scores = [rng.choice([-2.0, -1.0, 0.5, 1.0, 3.0]) for _ in range(rng.randint(0, 9))]
        a, b = html_extract.best_run(scores)
        best = max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
        assert abs(sum(scores[a:b]) - best) < 1e-9


def test_html_on_labelled_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    texts = {r.page_id: r.text for r in html_extract.extract_main_text(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"<(?!/?b>)[^>]*>", " ", r.html[r.html.index("<article>") : r.html.index("</article>")]).replace("<b>", "").replace("</b>", "")
        assert texts[r.page_id] == " ".join(html_extract.html.unescape(body).split())


# -- 4: quality -----------------------------------------------------------------------------------


def plain_counts(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    marked = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(marked)


def test_quality_counts():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["a ", "b ", "é\u00a0", "c\n", "a b c\n", "#", "|", "\x1c", " \n"]) for _ in range(rng.randint(0, 40)))
        assert quality.base_counts(text) == plain_counts(text)


def test_quality_verdicts(spark, docs, none):
    rng = random.Random(4)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(400))
    noise = "".join(chr(33 + rng.randrange(90)) + (" " if i % 7 == 0 else "") for i in range(4000))
    rows = [(1, prose), (2, "the same line again and again\n" * 300), (3, "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/") + (" " if i % 60 == 59 else "") for i in range(9000)))]
    got = {r.doc_id: r for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].kept and not got[2].kept and not got[3].kept and not got[3].base_failed and noise
    odd = quality.judge_quality(docs.withColumn("kept", F.lit("clash")).withColumn("N_words", F.lit(1)))
    assert odd.count() == len(DOCS) and dict(odd.dtypes)["kept"] == "boolean"
    assert {r.base_failed for r in odd.where("doc_id in (1, 2, 3)").collect()} == {True} and quality.judge_quality(none).count() == 0


# -- 5: chats -------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["<|im_end|>", "<|im_start|>assistant", "\\", "\\|", "<", "|", "<\\|", "\n", "\x00", "\x00+", "é", "n", "ok "]
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem\\n", None]), rng.choice([None, "", "".join(rng.choices(bits, k=rng.randint(0, 9)))])) for c in range(20) for t in range(rng.randint(1, 6))]
    rows += [(0, 0, "user", "again"), (0, 0, "user", "again"), (None, None, "assistant", "null id")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    parts = df.select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("parts"))
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(parts)).collect()}
    for c, own in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or 0)), key=lambda r: r[0]):
        own = [(r or "", t or "", n) for _, n, r, t in own]
        got = [(t.role, t.text) for t in back[c].turns]
        assert collections.Counter(got) == collections.Counter((r, t) for r, t, _ in own)
        if len({n for *_, n in own}) == len(own):
            assert got == [(r, t) for r, t, _ in own] and back[c].loss_text == "".join(t for r, t, _ in own if r == "assistant")
    assert chat_format.digests(df.limit(0)).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see ", None, None), ("image", None, "s3://a", 3), ("audio", "", "b", None), ("?", "<|x|>", None, None), None]
    one = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id int, turn int, role string, parts {chat_format.PARTS}")
    r = chat_format.format_chats(one).first()
    assert r.segments[1].text == "see <|image:1|><|audio:2|><\\|x|>" and not r.segments[1].loss
    assert [(a.turn, a.part, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, 1, "image", "s3://a", 768), (0, 2, "audio", "b", 25)] and r.expanded_tokens == 793


# -- 6: packing -----------------------------------------------------------------------------------


def check_packing(pieces, documents, size=4096):
    by = collections.defaultdict(list)
    for p in pieces:
        by[p["sequence_id"]].append(p)
    filled = []
    for s in sorted(by):
        at = 0
        for p in sorted(by[s], key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        filled.append(at)
    assert all(n == size for n in filled[:-1]) and (not filled or filled[-1] <= size)
    got = collections.defaultdict(bytes)
    for p in sorted(pieces, key=lambda p: p["start"]):
        assert zlib.crc32(bytes(p["ids"])) == p["ids_crc32"]
        if p["doc_id"] in documents:
            assert 4 * p["start"] == len(got[p["doc_id"]])
            got[p["doc_id"]] += bytes(p["ids"])
    assert dict(got) == documents


@pytest.mark.parametrize("weights", [None, {"s0": 3, "s1": 1}, {"s1": 1}])
def test_packing(spark, sf_dir, weights):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text", "if(doc_id % 3 = 0, 's0', 's1') as source")
    docs = docs.unionByName(spark.createDataFrame([r for r in DOCS if r[0] is not None and r[0] != 5], SCHEMA).drop("lang")).withColumn("n", F.lit("clash"))
    pieces = [r.asDict() for r in packing.pack(docs, path, weights, window_tokens=8192).collect()]
    want = {r.doc_id: np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for r in docs.collect()}
    check_packing(pieces, want)
    if weights == {"s0": 3, "s1": 1}:  # windows hold their shares as long as both queues last
        tokens = collections.Counter((p["window_id"], p["source"]) for p in pieces for _ in range(p["length"]))
        assert abs(tokens[0, "s0"] - 3 * tokens[0, "s1"]) <= 4


def test_packing_odd_tables(spark, docs, none):
    path = tokenizer_path("word_bpe_49k.json")
    pieces = packing.pack(docs, path).collect()
    assert sum(p.length for p in pieces if p.doc_id == 5) == 2 * 4 and packing.pack(none, path).count() == 0
    assert {p.source for p in pieces if p.doc_id in (1, 7)} == {""}


# -- 7: decontamination ---------------------------------------------------------------------------


def test_decontamination(spark, none):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ba", "ke", "lo", "mi", "nu", "ti", "ra", "se"]) for _ in range(rng.randint(2, 4)))
    vocabulary = [word() for _ in range(900)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, f"{text(rng.randint(14, 50))}. {text(8)}.") for i in range(30)] + [(90, None), (91, " ,"), (92, "")]
    rows, leaks = [], set()
    for i in range(300):
        rows.append((i, text(rng.randint(30, 300))))
    for k in range(30):
        own = items[k][1].split()
        if k % 3 == 1:  # a paraphrase: a few words replaced
            for j in rng.sample(range(len(own)), max(1, len(own) // 8)):
                own[j] = rng.choice(vocabulary)
        body = " ".join(own).upper() if k % 3 == 2 else " ".join(own)
        rows.append((1000 + k, f"{text(rng.randint(0, 90))} {body} {text(rng.randint(0, 90))}"))
        leaks.add((1000 + k, k))
    rows += [(2000, None), (2001, ""), (2002, "short"), (2003, text(40_000) + " " + items[0][1])]
    leaks.add((2003, 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("start", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in lsa_decontaminate.find_leaks(docs, bench).collect()}
    assert got == leaks
    kept = lsa_decontaminate.remove_leaks(docs, bench)
    assert kept.count() == len(rows) - len({d for d, _ in leaks}) and kept.columns == docs.columns
    assert lsa_decontaminate.find_leaks(none, bench).count() == 0 and lsa_decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_fits_all_documents(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randint(0, 150)}" for _ in range(60)) + (" rare" if i % 300 == 0 else " late" if i % 100 == 7 else "")) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    encoded = lsa_decontaminate.encode(docs, "doc_id", "text")
    words, held = lsa_decontaminate.document_frequencies(encoded, 1)
    plain = collections.Counter(w for _, t in rows for w in set(t.split()))
    hashes, _ = shingles.word_hashes([w.encode() for w in plain])
    assert dict(zip(words.tolist(), held.tolist())) == dict(zip(hashes.tolist(), plain.values()))
    assert len(lsa_decontaminate.document_frequencies(encoded, 12)[0]) == len(plain) - 1

    # a long text's end takes part in the fit, and the fit is the decomposition of all passages
    texts = [lsa_decontaminate.normalized(t) for _, t in rows[:30]] + [b"tail " * 50_000 + b"w1 w2 w3 " * 20]
    words = np.unique(shingles.word_hashes(texts)[0])
    docs = spark.createDataFrame([(0, t.decode()) for t in texts], "doc_id bigint, text string").repartition(3)
    idf, dense = np.ones(len(words)), []
    for t in texts:
        at = np.searchsorted(words, shingles.word_hashes([t])[0])
        for a in range(0, max(1, len(at) - 32), 32):
            dense.append(np.bincount(at[a : a + 64], minlength=len(words)))
    dense = np.array(dense) / np.linalg.norm(dense, axis=1)[:, None]
    item = np.bincount(np.searchsorted(words, shingles.word_hashes([texts[0]])[0]), minlength=len(words)).astype(float)
    item *= np.sqrt(len(dense)) / np.linalg.norm(item)
    space = lsa_decontaminate.fit_space(lsa_decontaminate.batches_of(lsa_decontaminate.encode(docs, "doc_id", "text")), texts[:1], words, idf, 1.0)
    best = np.linalg.svd(np.vstack([dense, item]))[1][: space.vectors.shape[1]]
    assert np.linalg.norm(np.vstack([dense, item]) @ space.vectors) == pytest.approx(np.linalg.norm(best), rel=1e-3)


def test_latent_space_and_search_against_plain_computations(spark):
    rng = np.random.default_rng(12)
    share = 1 / np.arange(1, 1501)  # words of a natural language are this uneven
    text = lambda n: " ".join(f"z{k}" for k in rng.choice(1500, n, p=share / share.sum()))
    texts, items = [text(int(n)) for n in rng.integers(1, 400, 600)], [lsa_decontaminate.normalized(text(30)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    encoded = lsa_decontaminate.encode(docs, "doc_id", "text")
    words = np.unique(np.concatenate((shingles.word_hashes(items)[0], lsa_decontaminate.document_frequencies(encoded, 3)[0])))
    idf = rng.uniform(0.5, 4, len(words))
    space = lsa_decontaminate.fit_space(lsa_decontaminate.batches_of(encoded), items, words, idf, 5.0)

    def rows(texts):
        places, out = {w: i for i, w in enumerate(words.tolist())}, []
        for t in texts:
            own = shingles.word_hashes([t])[0].tolist()
            for a in range(0, max(1, len(own) - 32), 32):
                v = np.zeros(len(words))
                for w in own[a : a + 64]:
                    if w in places:
                        v[places[w]] += idf[places[w]]
                out.append(v / np.linalg.norm(v)) if v.any() else None
        return np.array(out)

    a, own = rows([t.encode() for t in texts]), rows(items)
    a = np.vstack([a, own * np.sqrt(len(a) / len(own))])
    best = (np.linalg.svd(a)[1][: space.vectors.shape[1]] ** 2).sum()
    assert np.allclose(space.vectors.T @ space.vectors, np.eye(space.vectors.shape[1]), atol=1e-4)
    assert ((a @ space.vectors) ** 2).sum() >= 0.9 * best

    hashes, bounds = shingles.word_hashes([t.encode() for t in texts[:40]])
    queries = np.linalg.qr(rng.standard_normal((space.vectors.shape[1], 60)))[0].astype(np.float32)
    got = {(t, s, n, i): c for t, s, n, i, c in lsa_decontaminate.find_windows(space.index(hashes), bounds, space, queries, [(4, np.arange(60))], 0.1)}
    want = {}
    for t in range(40):
        own = hashes[bounds[t] : bounds[t + 1]]
        blocks = -(-len(own) // 8)
        for k in range(max(1, -(-(blocks - 4) // 2) + 1)):
            n = (min(2 * k + 4, blocks) - 2 * k) * 8
            for i in range(60):
                if (c := space.cosine(space.index(own[16 * k : 16 * k + n]), queries[:, i])) >= 0.1:
                    want[t, 16 * k, n, i] = c
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_decontamination_odd_keys(spark):
    leak = "the quick brown fox jumps over the lazy dog near the old mill. It was late in the evening then."
    bench = spark.createDataFrame([(0, leak), (1, leak), (None, leak)], "item_id bigint, text string")
    docs = spark.createDataFrame([(None, leak), (None, "clean words only here"), (7, leak), (7, leak), (8, "word " * 30 + leak)], "doc_id bigint, text string")
    got = collections.Counter((r.doc_id, r.item_id) for r in lsa_decontaminate.find_leaks(docs, bench).collect())
    assert got == collections.Counter((d, i) for d in (None, 7, 7, 8) for i in (0, 1, None))
    named = docs.select(F.concat(F.lit("k"), "doc_id").alias("doc_id"), "text")
    assert {r.doc_id for r in lsa_decontaminate.find_leaks(named, bench).collect()} == {None, "k7", "k8"}


def test_decontamination_of_more_items_than_the_space_holds(spark):
    rng = random.Random(8)
    varied = lambda n: " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(n))
    items = [(k, f"{varied(24)}. {varied(3)} end.") for k in range(1500)] + [(1500, "Short one? Yes.")]
    rows = [(k, f"{varied(40)} {text} {varied(40)}") for k, text in items] + [(5000 + k, varied(100)) for k in range(100)]
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = lsa_decontaminate.find_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k, _ in items}
    assert all(-1 <= r.cosine <= 1.001 for r in got)


def test_rows_that_share_an_id_are_judged_each(spark):
    import corpus_pipeline

    rng = random.Random(6)
    varied = lambda: " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(40))
    bench = spark.createDataFrame([(0, f"{varied()}. The last words.")], "item_id bigint, text string")
    leak = bench.first()["text"]
    clean = [(i, varied()) for i in (None, None, 1, 1, 2)]
    rows = [*clean, (None, leak), (1, leak), (3, leak)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = lsa_decontaminate.remove_leaks(docs, bench)
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter(clean)
    assert lsa_decontaminate.remove_leaks(docs, bench.limit(0)).count() == len(rows)

    got = corpus_pipeline.near_duplicates(spark, docs.union(docs.where("doc_id = 2")), "")
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter([*clean, (None, leak), (1, leak)])


def test_common_subsequence():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 8))] for _ in range(2))
        best = max((len(s) for n in range(len(a) + 1) for s in itertools.combinations(a, n) if is_in(s, b)), default=0)
        assert lsa_decontaminate.common_subsequence(a, b) == best


def test_places_that_lack_an_items_words_are_not_compared(spark, monkeypatch):
    rng = np.random.default_rng(3)
    weights = 1 / np.arange(1, 400)
    text = lambda n: " ".join(f"w{k}" for k in rng.choice(399, n, p=weights / weights.sum()))
    items, docs = [text(n) for n in (3, 9, 30, 30, 90, 30)], [text(int(n)) for n in rng.integers(0, 300, 200)]
    docs[17], docs[30] = f"{docs[17]} {items[2]} {docs[3]}", items[4]
    held = lsa_decontaminate.Held.of([[int(w[1:]) for w in t.split()] for t in items], 399)
    places = np.array([int(w[1:]) if rng.random() < 0.9 else -1 for d in docs for w in d.split()])
    first, count, item = rng.integers(0, len(places) - 100, 500), rng.integers(0, 100, 500), rng.integers(0, len(items), 500)
    monkeypatch.setattr(lsa_decontaminate, "HELD", 1000)  # many steps
    for a, n, i, most in zip(first, count, item, held.most(places, first, count, item).tolist(), strict=True):
        own, around = [int(w[1:]) for w in items[i].split()], places[a : a + n].tolist()
        assert most == sum((collections.Counter(own) & collections.Counter(around)).values()) >= lsa_decontaminate.common_subsequence(own, around)

    compared, common = [], lsa_decontaminate._common
    monkeypatch.setattr(lsa_decontaminate, "_common", lambda places, n, b: compared.append(n) or common(places, n, b))
    encoded = lsa_decontaminate.encode(spark.createDataFrame(list(enumerate(docs)), "k bigint, t string"), "k", "t")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    ((sent, search),) = lsa_decontaminate._searchers(encoded, len(docs), bench, "item_id", lsa_decontaminate.Thresholds(cosine=0.05))
    hashes, bounds = shingles.word_hashes([d.encode() for d in docs])
    places = sent.value[0].index(hashes)
    space, queries = sent.value[:2]
    found = [*lsa_decontaminate.find_windows(places, bounds, space, queries, lsa_decontaminate.windows_for(np.array([len(t.split()) for t in items])), 0.05)]
    texts, leaks = search(places, bounds)
    searched = len(compared)
    assert {(17, 2), (30, 4)} <= {(t, leak[0]) for t, leak in zip(texts, leaks, strict=True)}
    want = set()  # every place, word by word
    for t, start, n, i, _ in found:
        own, split = [int(w) for w in space.index(shingles.word_hashes([items[i].encode()])[0])], places[bounds[t] : bounds[t + 1]].tolist()
        middle, reach = start + n // 2, max(n // 2, len(own))
        around = split[max(0, middle - reach) : middle + reach]
        if lsa_decontaminate.common_subsequence(own, around) / len(own) >= 0.6:
            want.add((t, i))
    assert want <= {(t, leak[0]) for t, leak in zip(texts, leaks, strict=True)} and searched < len(found) // 2


def is_in(s, b):
    it = iter(b)
    return all(x in it for x in s)


# -- 8: WARC --------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "u", big), (2, "u\r\nWARC-Type: x%0A", big), (9, None, big), (9, "t", big), (None, "n", big), (3, "", None), (4, "s", "small"), (5, "s", "small"), (6, "l", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("length", F.lit("clash"))
    index = warc.write_archives(pages, f"file://{tmp_path}/w")
    got = warc.read_records(index).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h or "" for i, u, h in rows if i == r.page_id and (u or "") == (r.url or ""))
        again = len(html.encode()) >= 1000 and r.page_id != 9 and html == big
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 9) if again else ("response", None))
        assert r.payload is None if again else bytes(r.payload) == html.encode()
    some = warc.read_records(index.where("page_id in (4, 6)"))
    assert {r.page_id for r in some.collect()} == {4, 6}
    assert warc.read_records(warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_coalesced_ranges():
    ranges = [(0, 10), (10, 5), (40, 5), (1000, 7)]
    assert warc.coalesce_ranges(ranges, gap=30) == [(0, 45, ranges[:3]), (1000, 7, ranges[3:])]
    assert [r[:2] for r in warc.coalesce_ranges(ranges, gap=5000, most=60)] == [(0, 45), (1000, 7)]


# -- 9: Jaccard join ------------------------------------------------------------------------------


def near_texts(seed):
    rng = random.Random(seed)
    rows = [(i, t) for i, t, *_ in DOCS if i is not None and i != 6] + [(None, "no id here at all")]
    for n in [*range(0, 24), 60, 200]:
        base = [rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(n)]
        for _ in range(5):
            own = base[:]
            for _ in range(rng.randint(0, 2)):
                if own:
                    own[rng.choice([0, -1, rng.randrange(len(own))])] = f"z{rng.randint(0, 9)}"
            own = own[:-1] if rng.random() < 0.3 else own
            rows.append((100 + len(rows), " ".join([*own, "q"] if rng.random() < 0.3 else own)))
    shared = " ".join(f"p{i}" for i in range(30))  # a passage that unlike texts share
    return rows + [(900 + i, f"{shared} {' '.join(f'{i}o{j}' for j in range(12))}") for i in range(40)]


def brute_components(rows):
    def grams(t):
        w = words(t)
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [(i, grams(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize("boundary", [None, 0, 14])
def test_jaccard_join_is_exact(spark, monkeypatch, boundary):
    rows = near_texts(11)
    if boundary is not None:
        monkeypatch.setattr(jaccard_join, "choose_boundary", lambda sizes, percent: boundary)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit("clash")).withColumn("set_id", F.lit("clash"))
    got = jaccard_join.similar_components(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == brute_components(rows)
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def near_copies(n, seed=5):
    """Copies of one text of 120 words, each with one to four words replaced."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    rows = []
    for i in range(n):
        own = base[:]
        for at in rng.sample(range(120), rng.randint(1, 4)):
            own[at] = f"n{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(own)))
    return rows


def test_jaccard_join_near_copies_and_long_text(spark):
    long = [f"v{i % 700}x{i % 997}" for i in range(40_000)]
    rows = near_copies(200) + [(1000, " ".join(long)), (1001, " ".join([*long[:20_000], "cut", *long[20_000:]]))]
    got = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


@pytest.mark.parametrize("n", [200, 400, 800])
def test_jaccard_join_pairs_of_near_copies_are_linear(spark, monkeypatch, n):
    verify, pairs = jaccard_join.verify, []
    monkeypatch.setattr(jaccard_join, "verify", lambda found, *rest: (pairs.append(found.count()), verify(found, *rest))[1])
    docs = spark.createDataFrame(near_copies(n), "doc_id bigint, text string")
    assert jaccard_join.similar_components(docs).select("component_id").distinct().count() < n // 2
    assert sum(pairs) <= 10 * n


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    rng = random.Random(3)
    base = [f"a{i}" for i in range(300)]
    texts = [" ".join(rng.choice([w, w, w, w, f"b{rng.randint(0, 9)}"]) for w in base).encode() for _ in range(30)]
    sets = shingles.shingle_sets(texts)
    bits = np.unpackbits(jaccard_join._sketches(sets).view(np.uint8), axis=1)
    for (i, a), (j, b) in itertools.combinations(enumerate(map(set, sets)), 2):
        assert (bits[i] != bits[j]).sum() <= len(a ^ b)


def test_jaccard_join_deals_out_in_steps(spark, monkeypatch):
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(pool, k=rng.randint(5, 80))) for _ in range(60)]
    rows = [(i, " ".join(w if rng.random() > 0.03 else rng.choice(pool) for w in rng.choice(base).split())) for i in range(500)]
    docs = spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id bigint, text string").repartition(12, "doc_id")
    measured = jaccard_join.measure(docs, "doc_id", "text")
    lists = jaccard_join.write_lists(docs, "text", jaccard_join.word_levels(measured), jaccard_join.frequent_shingles(measured), 75, 3)
    plain = sorted(map(tuple, jaccard_join.shared_entries(lists, 75, 7).collect()))
    monkeypatch.setattr(jaccard_join, "FAN", 5)
    written, keep = [], jaccard_join.settle
    monkeypatch.setattr(jaccard_join, "settle", lambda df: written.append((df.columns, (out := keep(df)).count())) or out)
    assert sorted(map(tuple, jaccard_join.shared_entries(lists, 75, 60).collect())) == plain and len(plain) > 1000
    dealt = [n for columns, n in written if "bucket" in columns]
    blocks = lists.where("kind = 'prefixes'").count()
    assert len(dealt) == 2 and dealt[0] <= 5 * blocks and dealt[1] <= 5 * blocks + 25
    monkeypatch.setattr(jaccard_join, "BUCKET_TEXT", 1000)
    got = jaccard_join.similar_components(docs).collect()
    monkeypatch.undo()
    assert sorted(got) == sorted(jaccard_join.similar_components(docs).collect())


def test_jaccard_join_empty(spark, none):
    assert jaccard_join.similar_components(none).count() == 0


@pytest.mark.parametrize("per_task", [500_000, 7])
def test_components(spark, monkeypatch, per_task):
    from docweave.llm import common

    monkeypatch.setattr(common, "LINKS_PER_TASK", per_task)
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (21, 21), (None, 4), (2, 1), *[(30, i) for i in range(31, 60)], *[(i, i + 1) for i in range(100, 130)]]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {**dict.fromkeys([1, 2, 3, 7, 8, 9], 1), 20: 20, 21: 20, **dict.fromkeys(range(30, 60), 30), **dict.fromkeys(range(100, 131), 100)}
    assert got == want


def test_shingle_sets():
    rng = random.Random(7)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 12))).encode() for _ in range(300)] + [b"x" * 50, b"\n a \t", b"w " * 400_000]
    got = list(shingles.shingle_sets(texts))
    levelled = list(shingles.shingle_sets(texts, level=np.arange(16, dtype=np.uint8)))
    names = {}
    for t, own, other in zip(texts, got, levelled, strict=True):
        w = t.split()
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        assert len(own) == len(other) == len(grams) and (np.diff(own.astype(object)) > 0).all()
        for g in grams:
            names.setdefault(g, []).append(set(own.tolist()))
    assert all(set.intersection(*v) for v in names.values())
    ids = shingles.set_ids(shingles.shingle_sets(texts))
    assert len({(i, tuple(s)) for i, s in zip(ids.tolist(), map(tuple, got), strict=True)}) == len(set(ids.tolist()))


# -- 10: urls -------------------------------------------------------------------------------------


def plain_rule(host, path, rules):
    fits = [(len(h.split(".")), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


@pytest.mark.parametrize("most", [10**6, 0])
def test_url_filter(spark, most):
    rng = random.Random(12)
    rules = [*url_filter.RULES, ("a.example.com", "/en", "block"), ("a.example.com", "/en/x/", "allow"), ("org", "", "block"), ("a.org", "/p", "allow")]
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/en/1", "https://example.com", "x://www.example.com/en/?q#f", "http://b.net/fr/#x", "http://notexample.com/en/", "a\nb://c.com/d", "http://É.com/É"]
    urls += [f"http://{rng.choice(['', 'a.', 'www.', 'b.a.'])}{rng.choice(['example.com', 'x.net', 'y.org', 'org', 'de'])}{rng.choice(['', '/', '/en', '/en/', '/en/x/1', '/english', '/es/q?/fr/', '/p/q'])}" for _ in range(200)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, None)], "page_id bigint, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    got = url_filter.filter_urls(pages, rules, max_broadcast_rules=most).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        assert (r.host, r.path) == (host, path) and (r.rule, r.verdict) == plain_rule(host, path, rules)
    assert url_filter.filter_urls(pages.limit(0), rules, max_broadcast_rules=most).count() == 0
