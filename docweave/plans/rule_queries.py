"""Registered queries: the rules for contract-like documents, on texts made from the given tables' rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import rules, text
from docweave.operators import labels, tree
from docweave.operators.once import share_out
from docweave.plans.registry import query

#: A part's name under one of the numberings that the rules know, or none.
NUMBERINGS = ["第一章 ", "第二节：", "第三部分", "一、", "3. ", "(2) ", "A. ", "第四条 ", "10.1 ", "12：", "10.2", "（一） ", "12) ", "a) ", "① ", "（二）", "1) ", ""]
_LINE = f"CASE p_partkey % {len(NUMBERINGS)} {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NUMBERINGS))} END || p_name"
_TEXTS = f"x AS (SELECT p_partkey, {_LINE} AS text, CASE WHEN p_size % 3 = 0 THEN 'NON_CLAUSE' ELSE 'CLAUSE' END AS role, CASE WHEN p_size % 2 = 0 THEN 'CLAUSE_BODY' ELSE 'TITLE' END AS nc_type, p_size FROM part)"


def _texts(t) -> DataFrame:
    return t("part").selectExpr("p_partkey", f"{_LINE} AS text", "CASE WHEN p_size % 3 = 0 THEN 'NON_CLAUSE' ELSE 'CLAUSE' END AS role", "CASE WHEN p_size % 2 = 0 THEN 'CLAUSE_BODY' ELSE 'TITLE' END AS nc_type", "p_size")


_KINDS = [("section", rules.SECTION_PATTERNS, ""), ("clause", rules.CLAUSE_PATTERNS, " AND role = 'CLAUSE'"), ("clause_item", rules.ITEM_PATTERNS, " AND role = 'CLAUSE'")]
_ARMS = [(f"regexp_matches(text, '{p}'){cond}", kind, i, f"regexp_extract(text, '{p}', {re.compile(p).groups})" if kind != "clause_item" else "NULL") for kind, patterns, cond in _KINDS for i, p in enumerate(patterns, 1)]
_BODY = "role = 'CLAUSE' AND nc_type = 'CLAUSE_BODY'"


@query(f"""
WITH {_TEXTS}
SELECT p_partkey, CASE {' '.join(f"WHEN {w} THEN '{k}'" for w, k, _, _ in _ARMS)} WHEN {_BODY} THEN 'clause' END AS element_type,
       CASE {' '.join(f"WHEN {w} THEN {i}" for w, _, i, _ in _ARMS)} WHEN {_BODY} THEN 0 END AS level_hint,
       CASE {' '.join(f"WHEN {w} THEN {g}" for w, _, _, g in _ARMS)} END AS title,
       CASE WHEN {' OR '.join(f"({w})" for w, _, _, _ in _ARMS)} THEN regexp_split_to_array(text, '[：:]')[1] END AS number_token FROM x""")
def classify_elements(t) -> DataFrame:
    return tree.classify_elements(_texts(t)).select("p_partkey", "element_type", "level_hint", "title", "number_token")


@query(f"""
WITH {_TEXTS}
SELECT p_partkey, CASE {' '.join(f"WHEN regexp_matches(text, '{p}') THEN regexp_extract(text, '{p}', 1)" for p in rules.NUMBER_TITLE_PATTERNS)} END AS number,
       CASE {' '.join(f"WHEN regexp_matches(text, '{p}') THEN regexp_extract(text, '{p}', 2)" for p in rules.NUMBER_TITLE_PATTERNS)} ELSE text END AS title FROM x""")
def split_number(t) -> DataFrame:
    return _texts(t).select("p_partkey", tree.split_number(F.col("text")).alias("_s")).select("p_partkey", "_s.number", "_s.title")


@query(f"""
WITH {_TEXTS}, n AS (SELECT p_partkey, role, CASE WHEN p_size % 4 = 0 THEN 'COVER' ELSE 'MAIN' END AS region, CASE WHEN p_size % 5 < 3 THEN text END AS title, CASE WHEN p_size % 5 >= 2 THEN text END AS content FROM x)
SELECT p_partkey, CASE WHEN title IS NOT NULL AND regexp_matches(title, '{rules.NODE_SECTION}') THEN 'section' WHEN title IS NOT NULL AND (regexp_matches(title, '{rules.NODE_CLAUSE}') OR role = 'CLAUSE') THEN 'clause'
  WHEN content IS NOT NULL AND (regexp_matches(content, '{rules.NODE_ITEM}') OR (role = 'CLAUSE' AND region = 'MAIN')) THEN 'clause_item' WHEN content IS NOT NULL AND role = 'CLAUSE' THEN 'clause' ELSE 'section' END AS kind FROM n""")
def node_types(t) -> DataFrame:
    rows = _texts(t).selectExpr("*", "CASE WHEN p_size % 4 = 0 THEN 'COVER' ELSE 'MAIN' END AS region", "CASE WHEN p_size % 5 < 3 THEN text END AS title", "CASE WHEN p_size % 5 >= 2 THEN text END AS content")
    return rows.select("p_partkey", tree.node_type(F.col("title"), F.col("content"), F.col("role"), F.col("region")).alias("kind"))


_ALLOWED = " ".join(f"WHEN '{r}' THEN nc_type IS NULL{''.join(f" OR nc_type = '{k}'" for k in kinds if k)}" for r, kinds in rules.ALLOWED_NC_TYPES.items())
_REGION = "CASE p_partkey % 6 WHEN 0 THEN 'COVER' WHEN 1 THEN 'TOC' WHEN 2 THEN 'MAIN' WHEN 3 THEN 'APPENDIX' WHEN 4 THEN 'SIGN' ELSE 'OTHER' END"


@query(f"WITH {_TEXTS}, r AS (SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN nc_type END AS nc_type, {_REGION} AS region FROM x) SELECT p_partkey, CASE region {_ALLOWED} ELSE false END AS ok FROM r")
def allowed_nc_types(t) -> DataFrame:
    rows = _texts(t).selectExpr("p_partkey", "CASE WHEN p_size % 5 > 0 THEN nc_type END AS nc_type", f"{_REGION} AS region")
    return rows.select("p_partkey", labels.allowed_nc_type(F.col("region"), F.col("nc_type")).alias("ok"))


_WORDS = ["合同", "目录", "甲方", "附件", "鉴于", "第九条", "签署页", ""]
_STRUCT = f"CASE p_partkey % {len(_WORDS)} {' '.join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_WORDS))} END || p_name"


@query(f"""
WITH x AS (SELECT p_partkey, {_STRUCT} AS t, p_size AS o, CASE WHEN p_size % 3 = 0 THEN 'heading' ELSE 'paragraph' END AS k FROM part),
r AS (SELECT *, CASE WHEN regexp_matches(t, '合同|协议|章程|规定|办法') AND o <= 5 THEN 'COVER' WHEN regexp_matches(t, '甲方|乙方|签字|盖章|日期|签署') THEN 'SIGN' WHEN regexp_matches(t, '附件|附录|附表|补充') THEN 'APPENDIX' ELSE 'MAIN' END AS region FROM x),
s AS (SELECT *, CASE WHEN k = 'heading' OR regexp_matches(t, '目录|目次') THEN 'NON_CLAUSE' WHEN regexp_matches(t, '^第九条') OR region = 'MAIN' THEN 'CLAUSE' ELSE 'NON_CLAUSE' END AS role FROM r)
SELECT p_partkey, region, role, CASE WHEN role = 'CLAUSE' THEN NULL WHEN region = 'COVER' THEN 'COVER_TITLE'
  WHEN region = 'MAIN' THEN CASE WHEN k = 'heading' THEN 'TITLE' WHEN contains(t, '鉴于') THEN 'RECITAL' ELSE 'MAIN_OTHER' END
  WHEN region = 'APPENDIX' THEN CASE WHEN k = 'heading' THEN 'APPENDIX_TITLE' ELSE 'APPENDIX_BODY' END
  WHEN contains(t, '签署页') THEN 'SIGN_PAGE_TITLE' WHEN contains(t, '甲方') THEN 'SIGN_PAGE_PARTY' ELSE 'SIGN_PAGE_BODY' END AS nc_type,
  CASE WHEN role = 'CLAUSE' AND starts_with(t, '第九条') THEN '九' END AS clause_number, CASE WHEN role <> 'CLAUSE' THEN 'O' WHEN starts_with(t, '第九条') THEN 'B' ELSE 'I' END AS boundary FROM s""")
def annotate_structure(t) -> DataFrame:
    rows = t("part").selectExpr("p_partkey", f"{_STRUCT} AS text", "p_size AS order_index", "CASE WHEN p_size % 3 = 0 THEN 'heading' ELSE 'paragraph' END AS block_type")
    return labels.annotate_structure(rows).select("p_partkey", "region", "role", "nc_type", "clause_number", "boundary")


_TAGGED = "'甲方：' || c_name || '，人民币 ' || c_custkey || '万元，2023年' || (c_custkey % 12 + 1) || '月1日。联系人: ' || c_mktsegment"


@query(rf"""
WITH x AS (SELECT c_custkey, {_TAGGED} AS t FROM customer)
SELECT c_custkey, {', '.join(f"array_to_string(list_sort(list_distinct(list_transform(flatten([{', '.join(f"regexp_extract_all(t, '{p}', 1)" for p in ps)}]), lambda s: trim(s)))), '|') AS {name}" for name, ps in rules.TAG_PATTERNS.items())} FROM x""")
def extract_tags(t) -> DataFrame:
    made = F.expr(_TAGGED)
    return share_out(t("customer").select("c_custkey", "c_name", "c_mktsegment")).select("c_custkey", *[F.array_join(text.extract_tags(made, ps), "|").alias(name) for name, ps in rules.TAG_PATTERNS.items()])


_TITLE = "CASE p_partkey % 5 WHEN 0 THEN '买卖合同' WHEN 1 THEN '公司章程' WHEN 2 THEN '一般条款' ELSE p_brand END"


@query(f"""
WITH x AS (SELECT p_partkey, {_LINE} AS t, {_TITLE} AS title, CASE WHEN p_size = 1 THEN 'given' END AS given FROM part)
SELECT p_partkey, CASE WHEN given IS NOT NULL THEN given WHEN contains(title, '合同') THEN '合同' WHEN contains(title, '章程') THEN '章程' WHEN contains(title, '条款') THEN '条款'
  WHEN contains(lower(t), '第一条') OR contains(lower(t), '第1条') OR contains(lower(t), '1. ') THEN '合同' ELSE '文档' END AS kind,
  CASE p_partkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'markdown' ELSE 'unknown' END AS by_name FROM x""")
def document_types(t) -> DataFrame:
    name = F.expr("'f' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.doc' WHEN 2 THEN '.md' ELSE '.xyz' END")
    kind = text.infer_document_type(F.expr(_LINE), F.expr(_TITLE), F.expr("CASE WHEN p_size = 1 THEN 'given' END"))
    return t("part").select("p_partkey", kind.alias("kind"), text.file_type(name).alias("by_name"))


def _ranks(classes: list[tuple[str, list[str]]]) -> str:
    hits = ", ".join(f"{{'label': '{n}', 'place': {i}, 'score': {' + '.join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in ws)}}}" for i, (n, ws) in enumerate(classes))
    return f"SELECT doc_id, unnest([{hits}]) AS s FROM documents"


@query(f"""
WITH s AS ({_ranks(rules.CLAUSE_CATEGORIES)}), m AS (SELECT doc_id, s, max(s.score) OVER (PARTITION BY doc_id) AS most FROM s),
l AS (SELECT doc_id, string_agg(s.label || ':' || CAST(floor(100.0 * s.score / most) AS BIGINT), ',' ORDER BY s.score DESC, s.place) AS ranked FROM m WHERE s.score > 0 GROUP BY doc_id)
SELECT doc_id, coalesce(ranked, '') AS ranked FROM documents LEFT JOIN l USING (doc_id)""")
def rank_categories(t) -> DataFrame:
    ranked = F.transform(labels.rank_classes(F.col("text"), rules.CLAUSE_CATEGORIES), lambda h: F.concat_ws(":", h["label"], F.floor(h["share"] * 100).cast("string")))
    return t("documents").select("doc_id", F.array_join(ranked, ",").alias("ranked"))
