"""Barriers: against repeated expressions, and against a lineage that grows with every round."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later steps can refer to many times without computing them again.

    Projections are merged and their expressions copied to where they are used; those of a
    generator are not.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def share_out(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly among all cores: small files of which much is to be worked out would be read by one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to spark.checkpoint.dir and read from there, so that later rounds begin at files.

    Only a session on one machine that has no such folder gets one of its own; on a cluster
    that is an error.
    """
    _checkpoint_dir(df)
    return df.checkpoint()


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to spark.checkpoint.dir as Parquet and read from there: for tables that are read by parts.

    A checkpoint holds whole rows and is read whole; here each reader takes the columns and
    kinds of rows it needs, of files about a third as large.  They stay as long as the folder.
    """
    path = f"{_checkpoint_dir(df)}/docweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _checkpoint_dir(df: DataFrame) -> str:
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if where is None and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(where or f"file://{tempfile.mkdtemp(prefix='docweave-checkpoint-')}")
    return spark.sparkContext.getCheckpointDir()
