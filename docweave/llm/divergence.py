"""How far the sources of a language are from each other, in words: exact integer arithmetic.

Identical texts of a language are collapsed first: every distinct text travels with the
number of its documents in each source, is tokenized once, and adds its words' counts and
document frequencies weighted by those numbers.

Pairs of sources are evaluated sparsely.  Most words occur in few sources, and a word that a
source lacks has the same share there as every other such word; so a pair's total is

* one term for all words, as if neither source had any of them,
* a correction for the words of one source, by the distinct counts they have there, and
* a correction for the words that both sources have, found by a join on the word.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.llm.common import settle

#: ASCII letters and whatever isn't ASCII, as UTF-8 bytes.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: A term of a language is in so many of its documents, or more.
MIN_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
#: Bytes of distinct texts, and entries of counts, that a task holds before it passes them on.
HELD_TEXT, HELD_COUNTS = 16 << 20, 400_000

_COLLAPSED = "lang string, digest binary, text string, sources array<struct<source:string,docs:bigint>>"
_COUNTED = "lang string, source string, term string, n bigint, docs bigint"


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's copies as one row: lang, digest and text, with the documents of each source."""
    schema = pa.schema([("lang", pa.string()), ("digest", pa.binary()), ("text", pa.string()), ("sources", pa.list_(pa.struct([("source", pa.string()), ("docs", pa.int64())])))])
    held: dict[tuple[str, bytes], tuple[str, Counter]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        rows = [{"lang": lang, "digest": d, "text": text, "sources": [{"source": s, "docs": n} for s, n in m.items()]} for (lang, d), (text, m) in held.items()]
        for at in range(0, len(rows), 256):
            yield pa.RecordBatch.from_pylist(rows[at : at + 256], schema=schema)
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            key = lang, hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
            if key not in held:
                held[key] = text, Counter()
                size += len(text) + 100
            held[key][1][source] += 1
            if size > HELD_TEXT:
                yield from flush()
                size = 0
    yield from flush()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the rows of ``_collapse``, of which copies come one after the other.

    A row with a null term for every source says that the source occurs.
    """
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    current: tuple[str, bytes] | None = None
    body, weights = "", Counter()

    def add() -> None:
        terms = Counter(TERM.findall(body.encode("utf-8", "surrogatepass").lower()))  # bytes.lower: A-Z only
        for source, m in weights.items():
            n, docs = counts.setdefault((current[0], source), (Counter(), Counter()))
            if m == 1:
                n.update(terms)
                docs.update(terms.keys())
            else:
                for t, c in terms.items():
                    n[t] += m * c
                    docs[t] += m

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            columns = [[None, *n], [0, *n.values()], [0, *[docs[t] for t in n]]]
            for at in range(0, len(columns[0]), 20_000):
                term, k, d = (c[at : at + 20_000] for c in columns)
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(k)), pa.repeat(source, len(k)), pa.array(term, pa.binary()).cast(pa.string()), pa.array(k, pa.int64()), pa.array(d, pa.int64())], schema=schema)
        counts.clear()

    held = 0
    for batch in batches:
        for lang, digest, text, sources in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (lang, digest) != current:
                if current is not None:
                    add()
                    held += len(body) // 8
                    if held > HELD_COUNTS and sum(len(n) for n, _ in counts.values()) > HELD_COUNTS:
                        yield from flush()
                        held = 0
                current, body, weights = (lang, digest), text, Counter()
            for s in sources:
                weights[s["source"]] += s["docs"]
    if current is not None:
        add()
    yield from flush()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """On disk: ``lang, source, term, n, docs``, and a row with a null term for every lang and source.

    Tasks have added up their texts' counts themselves, so these are dealt out by term as they
    are; adding them up once more before that would find little to add.
    """
    empty = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(c), empty).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    texts = rows.mapInArrow(_collapse, _COLLAPSED)
    together = texts.repartition("lang", "digest").sortWithinPartitions("lang", "digest")
    counted = together.mapInArrow(_count, _COUNTED).repartition("lang", "term")
    return settle(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (total + terms)), exact; null where there are no terms."""
    wide = lambda c: c.cast("decimal(27,0)")
    over = F.nullif(wide(total) + wide(terms), F.lit(0))
    high = wide(n + F.lit(1)) * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", high, over)


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most SCALE + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def divergences(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: each source against the others, and its own words.

    Part ``pair``: item is another source of the lang, value the sum of ``excess`` of the
    source's shares over the item's, over all kept terms (those in ``min_docs`` documents of
    the lang).  Part ``term``: item is a term that the source has more of than its lang, value
    the ``excess`` of the two shares, the first ``top`` only.  Ranks begin at 1, value
    descending, item ascending by UTF-8.

    Null lang, source or text is ''.  Texts are read whole.  A source without terms is in all
    pairs of its lang; where a lang has no kept term, values are 0 and no terms are listed;
    repeated rows count each; an empty table gives no rows; other columns are ignored.
    """
    counted = term_counts(docs, lang, source, text)
    own = counted.where("term is not null")
    kept = own.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("lang_docs")).where(F.col("lang_docs") >= min_docs).drop("lang_docs")
    kept = settle(own.join(kept, ["lang", "term"]).drop("docs"))

    langs = kept.groupBy("lang").agg(F.count_distinct("term").alias("terms"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counted.where("term is null").select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("terms", "lang_total", "total")])
    # what a term has that the source lacks
    groups = settle(groups.withColumn("none", share(F.lit(0), F.col("total"), F.col("terms"))))

    shares = kept.join(groups, ["lang", "source"])
    shares = settle(
        shares.select("lang", "source", "term", "n", "none", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    )
    by = lambda df: df.select("lang", "source", "part", "item", "value", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank"))
    words = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))
    return by(source_pairs(groups, shares)).unionByName(by(words).where(F.col("rank") <= top))


def source_pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """``lang, source, part, item, value`` of every two sources of a lang, in both directions."""
    p, q = F.col("p"), F.col("q")
    side = lambda s: groups.select("lang", F.col("source").alias(f"source_{s}"), F.col("none").alias(f"none_{s}"))
    one, two = side("a"), side("b")
    other = F.col("source_a") != F.col("source_b")

    base = one.join(two, "lang").where(other).join(groups.select("lang", F.col("source").alias("source_a"), "terms"), ["lang", "source_a"])
    base = base.select("lang", "source_a", "source_b", F.coalesce(F.col("terms") * excess(F.col("none_a"), F.col("none_b")), F.lit(0)).alias("value"))

    # words of one source as if the other lacked them: by their distinct shares, for both directions
    spread = shares.groupBy("lang", "source", "none", "p").agg(F.count("*").alias("words")).withColumnsRenamed({"source": "source_a", "none": "none_a"})
    alone = spread.join(two, "lang").where(other)
    none_a, none_b = F.col("none_a"), F.col("none_b")
    there = F.sum(F.col("words") * (excess(p, none_b) - excess(none_a, none_b)))
    back = F.sum(F.col("words") * (excess(none_b, p) - excess(none_b, none_a)))
    alone = alone.groupBy("lang", "source_a", "source_b").agg(there.alias("there"), back.alias("back"))

    # words of both
    first = shares.select("lang", "term", F.col("source").alias("source_a"), "p", F.col("none").alias("none_a"))
    second = shares.select("lang", "term", F.col("source").alias("source_b"), F.col("p").alias("q"), F.col("none").alias("none_b"))
    both = first.join(second, ["lang", "term"]).where("source_a < source_b")
    fix = lambda x, y, x0, y0: F.sum(excess(x, y) - excess(x, y0) - excess(x0, y) + excess(x0, y0))
    both = both.groupBy("lang", "source_a", "source_b").agg(fix(p, q, none_a, none_b).alias("there"), fix(q, p, none_b, none_a).alias("back"))

    directions = lambda df: df.select("lang", F.inline(F.array(F.struct("source_a", "source_b", F.col("there").alias("value")), F.struct(F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), F.col("back").alias("value")))))
    parts = base.unionByName(directions(alone)).unionByName(directions(both))
    sums = parts.groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value"))
    return sums.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), "value")


ORACLE_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
numbered AS (SELECT *, row_number() OVER () AS r FROM d),
words AS (SELECT lang, source, r, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM numbered),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 3),
own AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
t AS (SELECT lang, source, sum(n) AS total FROM own GROUP BY ALL),
s AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
             1 + 1000000000::HUGEINT * (coalesce(o.n, 0) + 1) // (coalesce(t.total, 0) + v.v) AS p,
             1 + 1000000000::HUGEINT * (k.lang_n + 1) // (v.lang_total + v.v) AS q
      FROM groups g JOIN kept k USING (lang) JOIN v USING (lang)
      LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
      LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
          FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM s WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
