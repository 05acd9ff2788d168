"""Labels on three axes (region, nc_type, role), their votes and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import rules
from docweave.functions.text import first_rule, strip
from docweave.operators.once import compute_once, let


def nc_type_of(lowered: Column, region: Column, words: dict = rules.NC_TYPE_WORDS) -> Column:
    """By the words of the region; ``lowered``: stripped and lower-cased."""
    out = F.lit(None).cast("string")
    for name, ordered in words.items():
        out = F.when(region == name, first_rule(lowered, ordered, None)).otherwise(out)
    return out


def role_of(lowered: Column, words: list[str] = rules.ROLE_WORDS, pattern: str = rules.ROLE_PATTERN, least: int = 2) -> Column:
    """CLAUSE with at least so many of the words, or a clause's number."""
    hits = sum((F.when(lowered.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    return F.when((hits >= least) | lowered.rlike(pattern), "CLAUSE").otherwise("NON_CLAUSE")


def label_segments(segments: DataFrame, text: str = "text", regions=rules.REGION_WORDS, nc_types=rules.NC_TYPE_WORDS, role_words=rules.ROLE_WORDS, pattern: str = rules.ROLE_PATTERN, least: int = 2) -> DataFrame:
    """All three axes in one pass over the rows."""
    ready = compute_once(segments, _low=F.lower(strip(F.col(text))))
    ready = compute_once(ready, region=first_rule(F.col("_low"), regions, "MAIN"))
    return ready.withColumns({"nc_type": nc_type_of(F.col("_low"), F.col("region"), nc_types), "role": role_of(F.col("_low"), role_words, pattern, least)}).drop("_low")


def annotate_structure(segments: DataFrame, order: str = "order_index", text: str = "text", kind: str = "block_type") -> DataFrame:
    """Region by words and place, role by shape, the finer types by region, clause number and B/I/O boundary."""
    t, heading = F.col(text), F.col(kind) == "heading"
    name, party, number = "合同|协议|章程|规定|办法", "甲方|乙方", rf"第([{rules.CN}\d]+)[条]"
    region = (
        F.when(t.rlike(name) & (F.col(order) <= 5), "COVER").when(t.rlike("甲方|乙方|签字|盖章|日期|签署"), "SIGN").when(t.rlike("附件|附录|附表|补充"), "APPENDIX").otherwise("MAIN")
    )
    r = segments.withColumn("region", region)
    role = (
        F.when(heading, "NON_CLAUSE").when(t.rlike(r"(?i)目录|目次|contents|table\s+of\s+contents"), "NON_CLAUSE").when(t.rlike(f"^{number}"), "CLAUSE")
        .when((F.col(kind) == "paragraph") & (F.col("region") == "MAIN"), "CLAUSE").otherwise("NON_CLAUSE")
    )
    r = r.withColumn("role", role)
    cover = F.when(t.rlike(name), "COVER_TITLE").when(t.rlike("目录|目次"), "TOC").when(t.rlike("编号|版本|日期"), "COVER_META").when(t.rlike(party), "COVER_PARTIES").otherwise("COVER_OTHER")
    main = F.when(heading, "TITLE").when(t.rlike("鉴于|前言"), "RECITAL").otherwise("MAIN_OTHER")
    appendix = F.when(heading, "APPENDIX_TITLE").when(F.col(kind) == "paragraph", "APPENDIX_BODY").otherwise("APPENDIX_OTHER")
    sign = F.when(t.rlike("签字页|签署页"), "SIGN_PAGE_TITLE").when(t.rlike(party), "SIGN_PAGE_PARTY").otherwise("SIGN_PAGE_BODY")
    kinds = F.when(F.col("region") == "COVER", cover).when(F.col("region") == "MAIN", main).when(F.col("region") == "APPENDIX", appendix).otherwise(sign)
    clause = F.col("role") == "CLAUSE"
    found = F.regexp_extract(t, number, 1)
    r = r.withColumns({"nc_type": F.when(~clause, kinds), "clause_number": F.when(clause & (found != ""), found)})
    return r.withColumn("boundary", F.when(clause & F.col("clause_number").isNotNull(), "B").when(clause, "I").otherwise("O"))


def _points(c: Column, table: dict, other: int) -> Column:
    out = F.lit(other)
    for name, points in table.items():
        out = F.when(c.isNull() if name is None else c == name, points).otherwise(out)
    return out


def score_a(region: Column, nc_type: Column, role: Column) -> Column:
    """Level 1 to 4: weighted sum in tenths, rounded half to even."""
    axes = {"region": region, "nc_type": nc_type, "role": role}
    tenths = sum((_points(axes[k], t, o) * round(10 * w) for k, (t, o, w) in rules.SCORE_A.items()), F.lit(0))
    return F.greatest(F.lit(1), F.least(F.lit(4), F.bround((tenths / 10).cast("decimal(10,1)"), 0).cast("int")))


def score_b(region: Column, nc_type: Column, role: Column) -> Column:
    """``{score_float, score}``: weighted sum and its level "1" to "4"."""
    axes = {"region": region, "nc_type": nc_type, "role": role}
    total = sum((_points(axes[k], t, o) * round(10 * w) for k, (t, o, w) in rules.SCORE_B.items()), F.lit(0)) / 10
    level = F.lit("1")
    for least, name in reversed(rules.LEVELS_B):
        level = F.when(total >= least, name).otherwise(level)
    return F.struct(total.alias("score_float"), level.alias("score"))


def regrade(score: Column, members: Column) -> Column:
    """Level of a unit by its least score; units of several members can be "0"."""
    level = F.when(members > 1, F.when(score < 0.5, "0").otherwise("1")).otherwise("1")
    for least, name in reversed(rules.LEVELS_B):
        level = F.when(score >= least, name).otherwise(level)
    return level


def allowed_nc_type(region: Column, nc_type: Column) -> Column:
    out = F.lit(False)
    for name, kinds in rules.ALLOWED_NC_TYPES.items():
        named = [k for k in kinds if k is not None]
        ok = nc_type.isNull() | (nc_type.isin(named) if named else F.lit(False))
        out = F.when(region == name, ok).otherwise(out)
    return out


def vote(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Most frequent label per key, nulls aside, the smallest of equals: counted before the shuffle."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias(label))


def last_window(rows: DataFrame, keys: list[str], window: str, label: str, default: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.coalesce(F.max_by(label, window), F.lit(default)).alias(label))


def keep_from(rows: DataFrame, score: str, least: str) -> DataFrame:
    """Rows whose level is at least ``least``, compared as text; no level is "0"."""
    return rows.where(F.coalesce(F.col(score).cast("string"), F.lit("0")) >= least)


def label_windows(placed: DataFrame, key: str, order: str, text: str = "text", regions=rules.REGION_WORDS, nc_types=rules.NC_TYPE_WORDS, role_words=rules.ROLE_WORDS, pattern: str = rules.ROLE_PATTERN, least: int = 2) -> DataFrame:
    """Rows in windows (``window, row``) to ``key, order, region, nc_type, role``: labelled in each window, then the most frequent label.

    Region and nc_type of a row are those of its own text, in whatever window; its role is
    that of the window's whole text.
    """
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row", F.col(text).alias("_t")))), lambda r: r["_t"])
    whole = placed.groupBy(key, "window").agg(F.array_join(lines, " ").alias("_whole"))
    roles = whole.select(key, "window", role_of(F.lower(strip(F.col("_whole"))), role_words, pattern, least).alias("role"))
    voted = vote(placed.select(key, "row", "window").join(roles, [key, "window"]), [key, "row"], "role")
    own = label_segments(placed.select(key, order, "row", text).dropDuplicates([key, "row"]), text, regions, nc_types, role_words, pattern, least)
    return own.select(key, order, "row", "region", "nc_type").join(voted, [key, "row"]).drop("row")


REPLY = "struct<spans: array<struct<start: bigint, end: bigint, region: string, nc_type: string, role: string>>>"


def reply_spans(reply: Column) -> Column:
    """The spans in a model's reply; none if it isn't the JSON asked for."""
    parsed = F.from_json(reply, REPLY, {"mode": "PERMISSIVE"})
    return F.coalesce(parsed["spans"], F.array().cast("array<struct<start: bigint, end: bigint, region: string, nc_type: string, role: string>>"))


def classify(text: Column, classes: list[tuple[str, list[str]]], divisor: float = 5.0) -> Column:
    """``{label, score, confidence}``: the class with most of its words in the text, the first declared of equals."""
    t = F.lower(text)
    scored = F.array(*[F.struct(sum((F.when(t.contains(w), 1).otherwise(0) for w in words), F.lit(0)).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("label")) for i, (name, words) in enumerate(classes)])
    best = F.array_max(scored)
    return F.struct(best["label"].alias("label"), best["score"].alias("score"), F.least(best["score"] / divisor, F.lit(1.0)).alias("confidence"))


def rank_classes(text: Column, classes: list[tuple[str, list[str]]]) -> Column:
    """All classes with a word in the text, by share of the best, equals as declared: array of ``{label, share}``."""
    words_in = lambda t, words: sum((F.when(t.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    hits = lambda t: F.array(*[F.struct((-words_in(t, words)).alias("s"), F.lit(i).alias("p"), F.lit(name).alias("label")) for i, (name, words) in enumerate(classes)])
    # the best comes first
    ranked = let(F.lower(text), lambda t: F.array_sort(F.filter(hits(t), lambda h: h["s"] < 0)))
    return let(ranked, lambda r: F.transform(r, lambda h: F.struct(h["label"].alias("label"), (h["s"] / F.get(r, 0)["s"]).alias("share"))))


#: Document types that have a domain of their own; any other is OTHER.
DOMAIN_TYPES = ("CONTRACT", "AGREEMENT")


def classify_document(title: Column, content: Column, types=rules.DOCUMENT_TYPES, domains=rules.CONTRACT_DOMAINS, with_domain: tuple[str, ...] = DOMAIN_TYPES) -> Column:
    """``{type, type_confidence, domain, domain_confidence}`` by the words of title and content.

    The first declared of equals wins, also with no word at all; a type outside ``with_domain``
    has the domain OTHER with confidence 0.
    """
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit("")))
    kind, domain = classify(text, types), classify(text, domains)
    own = kind["label"].isin(*with_domain)
    return F.struct(
        kind["label"].alias("type"), kind["confidence"].alias("type_confidence"), F.when(own, domain["label"]).otherwise("OTHER").alias("domain"), F.when(own, domain["confidence"]).otherwise(0.0).alias("domain_confidence")
    )
