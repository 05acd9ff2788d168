"""Text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions import rules

#: White space of all scripts, the ideographic space included.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space of any script at both ends; only the ends are looked at."""
    return F.btrim(c, F.lit(SPACES))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACES))


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def first_rule(c: Column, ordered: list[tuple[str, list[str]]], default: str | None) -> Column:
    """Label of the first rule with a word that ``c`` contains."""
    out = F.lit(default)
    for label, words in reversed(ordered):
        out = F.when(contains_any(c, words), label).otherwise(out)
    return out


def first_pattern(c: Column, patterns: list[str]) -> Column:
    """1-based place of the first pattern that matches, else null."""
    out = F.lit(None).cast("int")
    for i in range(len(patterns), 0, -1):
        out = F.when(c.rlike(f"(?U){patterns[i - 1]}"), i).otherwise(out)
    return out


def last_group(c: Column, pattern: str, groups: int) -> Column:
    return F.regexp_extract(c, f"(?U){pattern}", groups)


def block_type(c: Column, tables: bool = True) -> Column:
    """``{type, level}``: heading, list, table (where such are told apart) or paragraph."""
    kind = lambda t, n: F.struct(F.lit(t).alias("type"), F.lit(n).alias("level"))
    out = kind("paragraph", 1)
    if tables:
        out = F.when(c.contains("\t") | c.contains("|"), kind("table", 1)).otherwise(out)
    for p in reversed(rules.LIST_PATTERNS):
        out = F.when(c.rlike(p), kind("list", 1)).otherwise(out)
    for p, level in reversed(rules.HEADING_PATTERNS):
        out = F.when(c.rlike(p), kind("heading", level)).otherwise(out)
    return out


def detect_language(c: Column) -> Column:
    """zh if over a tenth of the characters are CJK, else en; unknown if empty."""
    cjk = F.length(c) - F.length(F.regexp_replace(c, "[一-鿿]", ""))
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, "unknown").when(cjk > F.length(c) * 0.1, "zh").otherwise("en")


def infer_document_type(text: Column, title: Column, given: Column) -> Column:
    title, text = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(F.coalesce(given, F.lit("")) != "", given)
        .when(contains_any(title, ["合同", "协议"]), "合同").when(title.contains("章程"), "章程").when(title.contains("条款"), "条款")
        .when(contains_any(text, ["第一条", "第1条", "1. "]), "合同").when(contains_any(text, ["附件", "附录"]), "附件").otherwise("文档")
    )


def stable_id(*parts: Column) -> Column:
    """An id that a rerun gives again: a digest of what names the row."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def storage_path(checksum: Column, extension: Column) -> Column:
    """Place of a file by its content: documents/<two digits>/<checksum><extension>."""
    return F.concat_ws("/", F.lit("documents"), F.substring(checksum, 1, 2), F.concat(checksum, extension))


def file_type(name: Column) -> Column:
    """By the name's extension, else unknown."""
    extension = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in rules.FILE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension), F.lit("unknown"))


def sniff_type(content_type: Column, url: Column) -> Column:
    """File type by content type, then by the url's ending; else text."""
    kind, url = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    out = F.when(kind.contains("pdf"), "pdf").when(kind.contains("word") | kind.contains("docx"), "docx")
    out = out.when(kind.contains("excel") | kind.contains("xlsx"), "xlsx").when(kind.contains("html"), "html").when(kind.contains("text"), "text")
    for ending, name in ((".pdf", "pdf"), (".docx", "docx"), (".xlsx", "xlsx"), (".html", "html"), (".txt", "text")):
        out = out.when(url.endswith(ending), name)
    return out.otherwise("text")


def sniff_rich_text(c: Column) -> Column:
    s = strip(c)
    return F.when(s.startswith("<!DOCTYPE") | s.startswith("<html") | s.startswith("<p") | s.contains("<div"), "html").otherwise("text")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def extract_tags(c: Column, patterns: list[str], shortest: int = 1, longest: int = 2**31 - 1) -> Column:
    """Distinct first groups of all matches of all patterns, stripped, sorted."""
    found = F.flatten(F.array(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in patterns]))
    kept = F.filter(F.transform(found, strip), lambda x: (F.length(x) >= shortest) & (F.length(x) <= longest))
    return F.array_sort(F.array_distinct(kept))


def business_tags(c: Column, patterns: dict[str, list[str]] = rules.TAG_PATTERNS) -> dict[str, Column]:
    """The tags of each kind, of the lengths that kind may have."""
    return {kind: extract_tags(c, ps, *rules.TAG_LENGTHS.get(kind, (1, 2**31 - 1))) for kind, ps in patterns.items()}


def to_date(raw: Column) -> Column:
    """A date from its digits: year, month, day, whatever stands between; null without a year or if there's none such."""
    digits = F.regexp_extract_all(raw, F.lit(r"(\d+)"), F.lit(1))
    text = F.concat_ws("-", F.get(digits, 0), F.lpad(F.get(digits, 1), 2, "0"), F.lpad(F.get(digits, 2), 2, "0"))
    return F.when((F.size(digits) == 3) & (F.length(F.get(digits, 0)) == 4), F.try_to_date(text))


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles; 0 where it is no finite number."""
    inner = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.get(F.transform(F.array(inner), lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)), 0)


def like_any(columns: list[Column], keyword: str) -> Column:
    """Whether any column contains the keyword, taken literally; nulls contain nothing."""
    return reduce(lambda a, b: a | b, [F.coalesce(c.contains(keyword), F.lit(False)) for c in columns])
