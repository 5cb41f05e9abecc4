"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL = 500_000  #: rows of a few short columns up to which a table is sent to every task
LIMIT = 1 << 26  #: components of whole-number vectors end here, so that squared distances in up to 256 dimensions fit 64 bits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a single machine (tests) gets a temporary one; a cluster has no such folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(name: str, df: DataFrame) -> str:
    """The name, with as many underscores as it takes to be none of df's columns."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


def only(df: DataFrame, keys: DataFrame, on: str | list[str], how: str = "left_semi") -> DataFrame:
    """df joined with the distinct keys of a written table: they go to every task if they are at most SMALL rows, else both sides are shuffled."""
    return df.join(F.broadcast(keys) if keys.limit(SMALL + 1).count() <= SMALL else keys, on, how)


def matched(df: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """df joined with the rows of a written table of distinct keys, whose column n counts the rows of df by key (it isn't in the result).

    The keys that hold over a thousandth of what is counted, at most a thousand, go to every task; the others are shuffled.
    """
    total = facts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(facts.where(F.col("n") * 1000 > total).drop("n"))
    cold = facts.where(F.col("n") * 1000 <= total).drop("n")
    return df.join(hot, on).unionByName(df.join(hot.select(*on), on, "left_anti").join(cold, on))


def finite(vector: Column) -> Column:
    """The vector and all its components are there and finite."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as double, cut off at plus and minus LIMIT."""
    return F.transform(vector.cast("array<double>"), lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x * scale))).cast("long"))


def slices(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """The batches in parts of at most so many rows: what a Python worker builds from a part stays small, and in its caches."""
    for pdf in batches:
        for i in range(0, len(pdf), rows):
            yield pdf.iloc[i : i + rows].reset_index(drop=True)


def lean(f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """f, after which the Python worker gives its free memory back: workers live on between tasks, beside the executor's heap."""

    @functools.wraps(f)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from f(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            return

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), in place of uint64 values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
