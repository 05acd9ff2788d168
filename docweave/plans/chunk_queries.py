"""Registered query: texts to chunks, with SQL that runs the same folds as recursive queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from docweave.functions import rules
from docweave.operators import chunk
from docweave.plans.registry import query

MODE = "summary"


def _chunk_sql(mode: str) -> str:
    cfg = rules.CHUNK_DEFAULTS | rules.CHUNK_MODES[mode]
    d = lambda v: f"{float(v)!r}::DOUBLE"  # noqa: E731  a plain literal would be a decimal
    w = {k: d(v) for k, v in cfg.items()}
    keep = cfg["ema_alpha"] if 0 < cfg["ema_alpha"] <= 1 else 0.0
    low, high = cfg["sem_margin_neg"], cfg["sem_margin_pos"]
    like = lambda a, b: f"list_inner_product({a}.pairs, {b}.pairs) / ({a}.norm * {b}.norm)"
    return rf"""
WITH RECURSIVE lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(CAST(len(string_split(text, chr(10))) AS INT)))::INT AS pos FROM documents),
b AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS i, regexp_replace(text, '^[\s]+|[\s]+$', '', 'g') AS t FROM lines WHERE trim(text) <> ''),
shape AS (
  SELECT *, regexp_matches(text, '{chunk.ENUM}') OR regexp_matches(text, '^\s*[{re.escape(chunk.BULLETS)}]') AS enum, regexp_matches(t, '[:：]$') AS colon, regexp_matches(t, '[{chunk.SOFT}]$') AS soft,
         len(regexp_extract_all(text, '{chunk.OPENING}')) > len(regexp_extract_all(text, '{chunk.CLOSING}')) AS unclosed, length(t) AS length,
         length(text) - length(regexp_replace(text, '^\s+', '')) AS indent, len(regexp_extract_all(t, '\p{{L}}')) AS letters, len(regexp_extract_all(t, '\p{{Lu}}')) AS upper FROM b),
sig AS (
  SELECT *, t <> '' AND ((length <= 8 AND (colon OR regexp_matches(t, '[{rules.CN}]+\s*[、.．)]?$')))
         OR (length <= 60 AND (colon OR (regexp_matches(t, '{chunk.ENUM}') AND length <= 40) OR (letters > 0 AND upper >= 0.6 * letters)))) AS heading FROM shape),
ch AS (SELECT doc_id, i, unnest(list_transform(range(1, CAST(len(c) AS INT) + 1), lambda k: (unicode(c[k]) * 31 + unicode(coalesce(c[k + 1], ' '))) % {chunk.SLOTS})) AS s FROM (SELECT doc_id, i, string_split(text, '') AS c FROM b)),
m AS (SELECT doc_id, i, histogram(s) AS m FROM ch GROUP BY doc_id, i),
v AS (SELECT doc_id, i, list_transform(range({chunk.SLOTS}), lambda k: coalesce(m[k], 0)::DOUBLE) AS pairs FROM m),
vn AS (SELECT *, sqrt(list_inner_product(pairs, pairs)) AS norm FROM v),
p AS (SELECT a.*, x.pairs, x.norm, y.indent - a.indent AS back, coalesce(y.colon, false) AS b_colon, coalesce(y.soft OR y.unclosed, false) AS b_open, coalesce(CASE WHEN a.i > 0 THEN {like('x', 'z')} END, 0) AS near
      FROM sig a JOIN vn x USING (doc_id, i) LEFT JOIN sig y ON y.doc_id = a.doc_id AND y.i = a.i - 1 LEFT JOIN vn z ON z.doc_id = a.doc_id AND z.i = a.i - 1),
sc AS (
  SELECT doc_id, i, pos, text, enum, heading, pairs, norm, near, i = 0 OR heading OR coalesce(back >= {cfg['indent_jump']}, false) AS fresh,
         {w['w_enum']} * CAST(enum AS INT) + {w['w_heading']} * CAST(heading AS INT) + {w['w_lead']} * CAST(b_colon AND enum AS INT)
         + CASE WHEN back >= {cfg['indent_jump']} THEN {w['w_indent_back']} WHEN -back >= {cfg['indent_jump']} THEN {w['w_indent_forward']} ELSE 0.0::DOUBLE END AS start,
         {w['w_soft']} * CAST(b_open AS INT) + {w['short_len_cont_bonus']} * CAST(length < {cfg['short_len_bias']} AS INT) AS go_on FROM p),
f AS (
  SELECT doc_id, i, pairs, norm, {d(keep)} * 0.0::DOUBLE + {d(1 - keep)} * (a - c) AS balance, a + {w['bias_start']} + 10.0::DOUBLE AS starts, -1e9::DOUBLE AS goes, 0 AS s_from, 0 AS c_from
  FROM (SELECT *, start + CASE WHEN near <= {d(low)} THEN {w['w_sem_start']} ELSE 0.0::DOUBLE END AS a, go_on + CASE WHEN near > {d(low)} AND near >= {d(high)} THEN {w['w_sem_cont']} ELSE 0.0::DOUBLE END AS c FROM sc WHERE i = 0)
  UNION ALL
  SELECT doc_id, i, CASE WHEN anew THEN pairs ELSE h_pairs END, CASE WHEN anew THEN norm ELSE h_norm END, balance, greatest(ss, cs) + (a + {w['bias_start']} + 0.0::DOUBLE), greatest(sc, cc) + c, CASE WHEN ss >= cs THEN 0 ELSE 1 END, CASE WHEN sc >= cc THEN 0 ELSE 1 END
  FROM (SELECT *, fresh OR (balance < {d(2 * high)} AND balance <= {d(2 * low)}) AS anew
    FROM (SELECT *, {d(keep)} * before + {d(1 - keep)} * (a - c) AS balance
      FROM (SELECT *, start + CASE WHEN margin <= {d(low)} THEN {w['w_sem_start']} ELSE 0.0::DOUBLE END AS a, go_on + CASE WHEN margin > {d(low)} AND margin >= {d(high)} THEN {w['w_sem_cont']} ELSE 0.0::DOUBLE END AS c
        FROM (SELECT s.doc_id, s.i, s.pairs, s.norm, s.start, s.go_on, s.fresh, f.pairs AS h_pairs, f.norm AS h_norm, f.balance AS before, s.near - {like('f', 's')} AS margin,
                     f.starts + {w['pen_SS']} AS ss, f.goes + {w['pen_CS']} AS cs, f.starts + {w['pen_SC']} AS sc, f.goes + {w['pen_CC']} AS cc
              FROM f JOIN sc s ON s.doc_id = f.doc_id AND s.i = f.i + 1))))),
last AS (SELECT doc_id, max(i) AS i FROM f GROUP BY doc_id),
r AS (
  SELECT f.doc_id, f.i, CASE WHEN f.starts >= f.goes THEN 0 ELSE 1 END AS state, f.s_from, f.c_from FROM f JOIN last USING (doc_id, i)
  UNION ALL SELECT f.doc_id, f.i, CASE WHEN r.state = 0 THEN r.s_from ELSE r.c_from END, f.s_from, f.c_from FROM r JOIN f ON f.doc_id = r.doc_id AND f.i = r.i - 1),
cut AS (
  SELECT doc_id, i, pos, pairs, norm, state = 0 OR coalesce(lag(state = 0 AND heading) OVER (PARTITION BY doc_id ORDER BY i) AND NOT enum, false) AS start FROM r JOIN sc USING (doc_id, i)),
hd AS (SELECT doc_id, i, pairs, norm, CAST(row_number() OVER x AS INT) AS k, lead(i) OVER x AS stop FROM cut WHERE start WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
hl AS (SELECT a.doc_id, a.i, a.k, coalesce(a.stop, l.i + 1) - a.i = 1 AS one, {like('z', 'a')} AS lft, {like('y', 'a')} AS over, {like('a', 'n')} AS rgt
       FROM hd a JOIN last l USING (doc_id) LEFT JOIN hd z ON z.doc_id = a.doc_id AND z.k = a.k - 1 LEFT JOIN hd y ON y.doc_id = a.doc_id AND y.k = a.k - 2 LEFT JOIN hd n ON n.doc_id = a.doc_id AND n.k = a.k + 1),
g AS (
  SELECT doc_id, 0 AS k, false AS to_left, false AS to_right, false AS before FROM last
  UNION ALL
  SELECT doc_id, k, asked AND l >= greatest(r, 0.6::DOUBLE), asked AND r > l AND r >= 0.6::DOUBLE, was
  FROM (SELECT h.doc_id, h.k, h.one AND NOT g.to_right AS asked, g.to_right AS was, coalesce(CASE WHEN g.before THEN h.over ELSE h.lft END, -1.0::DOUBLE) AS l, coalesce(h.rgt, -1.0::DOUBLE) AS r
        FROM g JOIN hl h ON h.doc_id = g.doc_id AND h.k = g.k + 1)),
kept AS (SELECT h.doc_id, h.i FROM hl h JOIN g USING (doc_id, k) JOIN g q ON q.doc_id = h.doc_id AND q.k = h.k - 1 WHERE NOT g.to_left AND NOT q.to_right),
part AS (SELECT doc_id, i, pos, text, sum(CASE WHEN kept.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY sc.i) - 1 AS chunk FROM sc LEFT JOIN kept USING (doc_id, i))
SELECT doc_id, CAST(chunk AS INT) AS chunk, min(pos) AS first, CAST(count(*) AS INT) AS n, string_agg(text, chr(10) ORDER BY i) AS text FROM part GROUP BY doc_id, chunk"""


@query(_chunk_sql(MODE))
def chunk_text(t) -> DataFrame:
    return chunk.chunk_texts(t("documents"), "doc_id", "text", MODE)
