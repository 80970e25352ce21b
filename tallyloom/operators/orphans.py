"""References to records that do not exist, were deleted, or came later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.common import salted_join

#: A reference key that holds more than this share of the distinct references is spread.
HEAVY_SHARE = 0.001


def parent_intervals(parents: DataFrame, key: Column, created: Column, deleted: Column) -> DataFrame:
    """Validity intervals of the parents by key, as one small array per key.

    Null keys are left out. A parent without ``created`` always existed, one
    without ``deleted`` still does. Keys listed several times keep all their
    distinct intervals.
    """
    return (
        parents.select(key.alias("ref_key"), F.struct(created.alias("created"), deleted.alias("deleted")).alias("span"))
        .where(F.col("ref_key").isNotNull())
        .groupBy("ref_key")
        .agg(F.collect_set("span").alias("spans"))
    )


def orphan_references(refs: DataFrame, intervals: DataFrame, salts: int = 32) -> DataFrame:
    """Reports references whose parent is missing, deleted, or late at the day of the reference.

    ``refs``: ``ref_key``, ``day`` and any further columns, which are kept.
    Repeated references are folded first. References and parents are then
    partitioned alike and sorted by key, and both sorted streams are merged in
    one linear pass (a sort-merge join, asked for by hint). Keys that hold more
    than ``HEAVY_SHARE`` of the references are spread over ``salts`` partitions
    and their parent is repeated there; there are at most ``1 / HEAVY_SHARE``
    such keys, which bounds the broadcast list.

    A reference is right if an interval ``[created, deleted)`` of its parent
    holds its day; else ``missing`` if there is no parent, ``deleted`` if a
    parent's ``deleted`` is not after the day, else ``late``. Null keys refer to
    nothing and are left out. A null day fits an existing parent.
    """
    distinct = refs.where(F.col("ref_key").isNotNull()).distinct()
    merged = salted_join(distinct, intervals, ["ref_key"], "left", salts, HEAVY_SHARE, hint="merge")
    day = F.col("day")
    holds = F.exists(
        "spans",
        lambda s: day.isNull() | ((s["created"].isNull() | (s["created"] <= day)) & (s["deleted"].isNull() | (s["deleted"] > day))),
    )
    ended = F.exists("spans", lambda s: F.coalesce(s["deleted"] <= day, F.lit(False)))
    reason = F.when(F.col("spans").isNull(), "missing").when(holds, None).when(ended, "deleted").otherwise("late")
    return merged.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("spans")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of orphan references and of distinct keys by table, field, period and reason."""
    by = ["table_name", "field_name", "period", "reason"]
    keyed = orphans.groupBy(*by, "ref_key").agg(F.count(F.lit(1)).alias("n"))
    return keyed.groupBy(*by).agg(F.sum("n").alias("n_references"), F.count(F.lit(1)).alias("n_keys"))
