"""All matches of patterns in texts, with their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.chunk import fold
from docweave.operators.once import compute_once


def match_places(pieces: Column, values: Column) -> Column:
    """``{start, value}`` of each match, start from 0: what lies before it, added up along the text.

    pieces: the text split at the matches; values: the matches, one fewer.
    """
    both = F.transform(values, lambda v, i: F.struct(F.length(F.get(pieces, i)).alias("gap"), F.length(v).alias("own"), v.alias("value")))
    step = lambda s, m: F.struct((s["at"] + m["gap"] + m["own"]).alias("at"), F.struct((s["at"] + m["gap"]).alias("start"), m["value"].alias("value")).alias("emit"))
    return F.flatten(fold(both, {"at": F.lit(0)}, step, "struct<start:int,value:string>")["all"])


def find_all(rows: DataFrame, keys: list[str], text: str, patterns: list[tuple[str, str]], around: int = 100) -> DataFrame:
    """``keys, pattern, n, start, end, value, context`` of every match of every (name, pattern).

    n counts a row's matches of one pattern from 1; start and end are characters from 0;
    context is the match with ``around`` characters at both sides.  Matches of one pattern
    don't overlap, as a regular expression finds them; those of several patterns may.  A
    pattern must not match the empty text.  Null and empty texts have none.
    """
    found = None
    for name, pattern in patterns:
        held = rows.where(F.col(text).rlike(pattern)).select(*keys, F.col(text).alias("_t"))
        held = compute_once(held, _p=F.split("_t", pattern, -1), _v=F.regexp_extract_all("_t", F.lit(pattern), F.lit(0)))
        placed = held.select(*keys, "_t", F.posexplode(match_places(F.col("_p"), F.col("_v"))).alias("_n", "_m"))
        hits = placed.select(*keys, "_t", F.lit(name).alias("pattern"), (F.col("_n") + 1).alias("n"), "_m.start", (F.col("_m.start") + F.length("_m.value")).alias("end"), "_m.value")
        found = hits if found is None else found.unionByName(hits)
    begin = F.greatest(F.col("start") - around, F.lit(0))
    return found.withColumn("context", F.substring(F.col("_t"), begin + 1, F.col("end") + around - begin)).drop("_t")
