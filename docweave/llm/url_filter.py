"""URL filters: a trie over reversed host labels, then path segments.

Every rule is a host (which stands for itself and all its subdomains), a path prefix and
a verdict.  A walk down the reversed host labels, then the path segments, meets all rules
that fit a url; the deepest one wins, so a rule for a longer host beats one for a shorter
host, and on the same host the longer path.

The trie is sent to every task inside the function.  That is only done while the rules
are few (``max_broadcast_rules``); larger rule tables are joined instead, on the host
suffixes of the distinct urls.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, str]  # host, path, verdict

HOST = r"^(?s:.*?)://([^/?#]*)"
PATH = r"^(?s:.*?)://[^/?#]*([^?#]*)"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _segments(path: str) -> list[str]:
    """'/en/a' -> ['/', 'en/', 'a']: only the last one can lack its slash."""
    parts = path.split("/")
    return [p + "/" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


class UrlTrie:
    """Nested dicts; the keys are host labels, then, below ``PATHS``, path segments."""

    PATHS, RULE, PARTIAL = 0, 1, 2  # keys that no label or segment equals

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(self.PATHS, {})
            parts = _segments(path)
            partial = parts.pop() if parts and not parts[-1].endswith("/") else None
            for part in parts:
                node = node.setdefault(part, {})
            hit = (f"{host.lower()}{path}", verdict)
            if partial is None:
                node[self.RULE] = hit
            else:
                node.setdefault(self.PARTIAL, {})[partial] = hit

    def _in_path(self, node: dict, parts: list[str]) -> tuple[str, str] | None:
        best = node.get(self.RULE)
        for part in parts:
            fits = [p for p in node.get(self.PARTIAL, ()) if part.startswith(p)]
            if fits:
                best = node[self.PARTIAL][max(fits, key=len)]
            node = node.get(part)
            if node is None:
                break
            best = node.get(self.RULE, best)
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits, else None."""
        node, best, parts = self.root, None, _segments(path)
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if self.PATHS in node:
                best = self._in_path(node[self.PATHS], parts) or best
        return best


def url_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path.  Null urls and urls without '://' have neither: both are empty."""
    text = F.coalesce(F.col(url), F.lit(""))
    return pages.withColumns(
        {"host": F.translate(F.regexp_extract(text, HOST, 1), UPPER, UPPER.lower()), "path": F.regexp_extract(text, PATH, 1)}
    )


def filter_urls(
    pages: DataFrame,
    rules: list[Rule],
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
    max_broadcast_rules: int = 200_000,
) -> DataFrame:
    """Returns ``key, host, path, rule, verdict`` of every row of ``pages``.

    rule: the winning rule as host and path, null where none fits; verdict then is
    ``default``.  Null or malformed urls have an empty host and path and take the default;
    repeated rows stay; of two rules that are alike the last wins; an empty table gives no
    rows; other columns of ``pages`` are ignored.
    """
    parts = url_parts(pages.select(key, url), url)
    if len(rules) > max_broadcast_rules:
        return _by_join(parts.select(key, "host", "path"), rules, key, default)
    trie = UrlTrie(rules)

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for host, path in batches:
            found = [trie.find(h, p) or (None, default) for h, p in zip(host, path, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    return parts.select(key, "host", "path", judge("host", "path").alias("_")).select(key, "host", "path", "_.rule", "_.verdict")


def _by_join(parts: DataFrame, rules: list[Rule], key: str, default: str) -> DataFrame:
    """The same for any number of rules: host suffixes of distinct urls meet the rules' hosts."""
    spark = parts.sparkSession
    latest = {(h.lower(), p): (h.lower(), p, f"{h.lower()}{p}", v) for h, p, v in rules}
    table = spark.createDataFrame(list(latest.values()), "suffix string, prefix string, rule string, found string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    best = (
        parts.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes))
        .join(table, "suffix").where("startswith(path, prefix)")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "found"), F.struct(F.length("suffix"), F.length("prefix"))).alias("_"))
    )
    return parts.join(best, ["host", "path"], "left").select(
        key, "host", "path", "_.rule", F.coalesce("_.found", F.lit(default)).alias("verdict")
    )


#: The rules of the query.
RULES: list[Rule] = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
  END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
