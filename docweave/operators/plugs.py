"""Models that a caller plugs in: batched by bytes, a failure is a row's own, rules where it failed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[list[str]], list[str | None]]
ANSWER = "value string, error string"
BATCH_BYTES = 1 << 20


def _calls(texts: list[str], most: int) -> Iterator[list[str]]:
    """Texts in order, in batches of about ``most`` bytes, one text at least."""
    batch, size = [], 0
    for t in texts:
        own = len(t.encode())
        if batch and size + own > most:
            yield batch
            batch, size = [], 0
        batch.append(t)
        size += own
    if batch:
        yield batch


def _ask(model: Model, texts: list[str]) -> list[tuple[str | None, str | None]]:
    """Answers and errors; a batch that fails is halved until the texts to blame are alone."""
    try:
        answers = list(model(texts))
        if len(answers) != len(texts):
            raise ValueError(f"{len(answers)} answers to {len(texts)} texts")
    except Exception as e:  # whatever a plug raises is the row's error
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        half = len(texts) // 2
        return _ask(model, texts[:half]) + _ask(model, texts[half:])
    return [(None if a is None else str(a), "no answer" if a is None else None) for a in answers]


def ask(text: Column, model: Model, batch_bytes: int = BATCH_BYTES) -> Column:
    """``{value, error}`` of a model for every text; exactly one of them is null.

    The model gets lists of texts of about ``batch_bytes``.  If it raises, the texts are asked
    in halves, so one bad text costs a few calls and no other row its answer; the job goes on.
    Null texts aren't asked: "no text".
    """

    @F.pandas_udf(ANSWER)
    def answers(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            held = texts[texts.notna()]
            found = [pair for batch in _calls(held.tolist(), batch_bytes) for pair in _ask(model, batch)]
            out = pd.DataFrame({"value": None, "error": "no text"}, index=texts.index, dtype=object)
            if len(held):
                out.loc[held.index] = found
            yield out

    return answers(text)


def ask_or_rule(rows: DataFrame, text: str, model: Model | None, rule: Column, out: str, allowed: list[str] | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Adds ``out``, ``out_by`` ("model" or "rule") and ``out_error``: the model's answer, else the rule's.

    allowed: other answers count as failed ("not allowed: ...").  Without a model every row is
    the rule's, without an error.
    """
    if model is None:
        return rows.withColumns({out: rule, f"{out}_by": F.lit("rule"), f"{out}_error": F.lit(None).cast("string")})
    asked = rows.withColumn("_a", ask(F.col(text), model, batch_bytes))
    strange = F.col("_a.value").isNotNull() & ~F.col("_a.value").isin(allowed) if allowed else F.lit(False)
    error = F.when(strange, F.concat(F.lit("not allowed: "), F.col("_a.value"))).otherwise(F.col("_a.error"))
    return asked.withColumn("_e", error).withColumns(
        {out: F.when(F.col("_e").isNull(), F.col("_a.value")).otherwise(rule), f"{out}_by": F.when(F.col("_e").isNull(), "model").otherwise("rule"), f"{out}_error": F.col("_e")}
    ).drop("_a", "_e")
