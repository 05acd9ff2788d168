"""Files that keep arriving: the batch pipeline on every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docweave.operators.segments import split_segments


def stream_segments(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Segments of new Parquet files, appended to ``target``; each micro-batch is written in its own folder, so a rerun replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        split_segments(batch, key, text).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
