"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import math
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where a session on one machine has none (tests, a laptop) a folder of our own is
    set; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        where = spark.sparkContext.getCheckpointDir()
    if where is None and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if where is None:
        where = f"file://{tempfile.mkdtemp(prefix='docweave-checkpoint-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts the lineage: later stages read the files, also after an executor is lost.
    ``discard`` deletes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def tidily(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``run``, a function for ``mapInArrow``, with the memory that it used given back at its end.

    Spark's Python workers outlive tasks, and what a task freed stays with the worker; side by
    side that is memory that no task uses and that others miss.
    """

    @functools.wraps(run)
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)

    return tidy


def discard(*tables: DataFrame | None) -> None:
    """Deletes the files of tables that ``settle`` wrote and nothing reads any more; others are left alone.

    What was made from them must be settled itself, so that no lost executor asks for them again.
    """
    for t in tables:
        path = None if t is None else t.__dict__.pop("_settled", None)
        if path is not None:
            spark = t.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def collect_garbage(df: DataFrame) -> None:
    """Lets go of what finished steps left: shuffles and broadcasts that nothing refers to are removed on all executors.

    Spark removes them when the driver's JVM collects its garbage, which one with little to do
    puts off for half an hour.
    """
    gc.collect()
    df.sparkSession._jvm.java.lang.System.gc()


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z only, as far as ASCII words can tell.

    ``lower`` also maps other letters, but only U+0130 and U+212A to anything with an
    ASCII letter in it; texts with one of those take the slower exact way.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(c.rlike("[\u0130\u212A]"), F.translate(c, upper, upper.lower())).otherwise(F.lower(c))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once, however often later steps refer to them.

    A projection would be merged into those steps and its expressions repeated there;
    a generator is not.
    """
    new = F.struct(*[c.alias(k) for k, c in columns.items()])
    return df.select("*", F.inline(F.array(new)))


#: Buckets that a block of rows, or a merged group of blocks, is dealt out into at most; odd.
FAN = 509


def moduli(buckets: int, fan: int = FAN) -> list[int]:
    """Numbers of buckets by step: each divides the next one, which is at most ``fan`` times as large; the last is ``buckets`` or a little more.

    All are odd if ``buckets`` and ``fan`` are: a key's lowest bits are the byte alone.
    """
    steps = [min(buckets, fan)]
    while steps[-1] < buckets:
        steps.append(steps[-1] * min(fan, -(-buckets // steps[-1]) | 1))
    return steps


def group_of(member: str, step: int, groups: int) -> Column:
    """The group, of so many, that a member is merged into after a step."""
    return F.pmod(F.crc32(F.concat(F.lit(f"{step} "), member)), F.lit(groups)).cast("string")


#: Links that one task contracts.
LINKS_PER_TASK = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as stars: every id linked to the smallest one it can reach over them."""
    links = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not sum(len(lo) for lo, _ in links):
        return
    lo, hi = (np.concatenate(x) for x in zip(*links, strict=True))
    ids, place = np.unique(np.concatenate((lo, hi)), return_inverse=True)
    a, b = place[: len(lo)], place[len(lo) :]
    label = np.arange(len(ids))
    while True:
        least, before = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    leaves = np.flatnonzero(label != np.arange(len(ids)))
    for at in range(0, len(leaves), 50_000):
        part = leaves[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(ids[label[part]]), pa.array(ids[part])], names=["lo", "hi"])


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``(id, component)`` of every id in ``edges``; component is the smallest id reachable.

    Rounds of two parts, until the links are stars.  Tasks contract the links they hold, a
    bounded number each, to stars; then alternating large-star and small-star steps
    (Kiveris et al., 2014) link neighbours to the smallest id they know, with minima that
    are pre-aggregated before the shuffle and joins whose hot keys adaptive execution
    splits, so no hub gathers its neighbours in one group.  Links that fit one task are
    done after its contraction.
    Each round is written to the shared folder.  Null ids are ignored; self-links and
    repeated links do no harm; no links give no rows.
    """
    e = settle(
        edges.select(F.least(src, dst).cast("bigint").alias("lo"), F.greatest(src, dst).cast("bigint").alias("hi"))
        .where("lo is not null and hi is not null and lo <> hi")
        .distinct()
    )
    while True:
        tasks, before = math.ceil(e.count() / LINKS_PER_TASK), e
        e = settle(e.coalesce(max(1, tasks)).mapInArrow(_contract, "lo bigint, hi bigint"))
        discard(before)
        if tasks <= 1:
            break
        # large star: neighbours larger than u go to the smallest of u's neighbourhood
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            e.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.where("v > u")
            .join(least, "u")
            .select(F.col("m").alias("lo"), F.col("v").alias("hi"))
            .where("lo <> hi")
            .distinct()
        )
        # small star: of the links from v to smaller ids, all go to the smallest
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi")
        small = settle(
            moved.select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
            .where("lo <> hi")
            .unionByName(least.select(F.col("m").alias("lo"), "hi"))
            .distinct()
        )
        # done when it is a forest of stars: no id is both a centre and a leaf, none has two centres
        leaves = small.groupBy("hi").agg(F.count("*").alias("n"))
        bad = leaves.where("n > 1").select("hi").unionByName(small.select(F.col("lo").alias("hi")).distinct().join(leaves, "hi", "left_semi"))
        discard(e)
        e = small
        if bad.isEmpty():
            break
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(
        e.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    )
