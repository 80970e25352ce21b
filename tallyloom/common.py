"""Helpers shared by the operators: loading, text keys, current rows, skew."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TWO64 = "18446744073709551616"
_HALF = "9223372036854775808"


_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reach_workers(spark: SparkSession) -> None:
    """Names this package's folder to the Python workers, for a driver that found it by its own path only.

    On a cluster the folder must be there too, or the package be shipped with
    the job; a folder that a worker lacks does no harm.
    """
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if _ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (_ROOT, known) if p)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; a Parquet file or a folder of them."""
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at_once(spark: SparkSession, *steps: Callable):
    """Results of independent steps that start jobs, such as checkpoints, run at the same time so that small jobs share the cluster."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]


def squash(value: Column | str) -> Column:
    """Formatting-free form: letters and digits only, case ignored; null stays null."""
    value = F.col(value) if isinstance(value, str) else value
    return F.lower(F.regexp_replace(value.cast("string"), r"[^\p{L}\p{N}]+", ""))


def null_safe_hash(*columns: Column) -> Column:
    """64-bit hash that tells null from every value (``xxhash64`` skips nulls)."""
    parts: list[Column] = []
    for c in columns:
        parts += [c.isNull(), c]
    return F.xxhash64(*parts)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions)


def stamp_and_payload(stamp: Column, payload: Column) -> Column:
    """Packs a timestamp and a 64-bit payload into one decimal, ordered by timestamp, then payload.

    ``max`` over it keeps its buffer in a hash aggregate (a struct would need a
    sort aggregate) and is deterministic on ties, which ``max_by`` is not. A
    null timestamp comes before every other one.
    """
    micros = F.coalesce(F.unix_micros(stamp.cast("timestamp")), F.lit(-62135596800000000)).cast("decimal(18,0)")
    shifted = payload.cast("decimal(19,0)") + F.lit(_HALF).cast("decimal(19,0)")
    return (micros.cast("decimal(38,0)") * F.lit(_TWO64).cast("decimal(20,0)")).cast("decimal(38,0)") + shifted.cast("decimal(20,0)")


def payload_of(packed: Column) -> Column:
    """The payload packed by :func:`stamp_and_payload`."""
    low = F.pmod(packed, F.lit(_TWO64).cast("decimal(38,0)"))
    return (low - F.lit(_HALF).cast("decimal(38,0)")).cast("bigint")


def current_rows(df: DataFrame, keys: Sequence[str], value: str, stamp: str) -> DataFrame:
    """The row of each key with the latest ``stamp``; of equal stamps the larger value wins, null counts lowest.

    Output: keys and ``value`` (bigint). One shuffle with map-side combining, so
    a key delivered any number of times is never gathered in one task.
    """
    packed = stamp_and_payload(F.col(stamp), F.coalesce(F.col(value).cast("bigint"), F.lit(-(2**63))))
    got = payload_of(F.max("__packed"))
    out = df.select(*keys, packed.alias("__packed")).groupBy(*keys).agg(got.alias(value))
    return out.withColumn(value, F.when(F.col(value) != F.lit(-(2**63)), F.col(value)))


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float = 0.001) -> DataFrame:
    """Keys that hold more than ``share`` of all rows: at most ``1 / share`` of them, whatever the table's size.

    The bound on their number is what makes it right to broadcast the result.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__t")).select("__t").scalar()
    return counts.where(F.col("__n") > total * F.lit(share)).select(*keys)


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = 32, share: float = 0.001, hint: str | None = None, heavy: DataFrame | None = None) -> DataFrame:
    """Equi-join of a large, possibly skewed ``left`` with ``right`` on ``keys``.

    Rows of ``left`` under a heavy key are spread over ``salts`` buckets and the
    matching rows of ``right`` are repeated once per bucket; all other keys join
    as they are. Null keys match nothing (they stay in a left join, spread).
    ``how``: inner, left, left_semi or left_anti; ``hint``: a join strategy;
    ``heavy``: the heavy keys where they are known, at most ``1 / share``.
    """
    if heavy is None:
        heavy = heavy_keys(left.where(all_of([F.col(k).isNotNull() for k in keys])), keys, share)
    heavy = F.broadcast(heavy.select(*keys).withColumn("__hot", F.lit(True)))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns if not left.schema[c].dataType.typeName() == "map"]), F.lit(salts)).cast("int")
    anynull = reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])
    a = left.join(heavy, list(keys), "left").withColumn("__salt", F.when(F.col("__hot") | anynull, spread).otherwise(F.lit(0))).drop("__hot")
    b = right.join(heavy, list(keys), "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return a.join(b.hint(hint) if hint else b, [*keys, "__salt"], how).drop("__salt")
