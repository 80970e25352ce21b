"""Per-key results of a join whose keys are very uneven: aggregate first, join the compact states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.common import payload_of, salted_join, stamp_and_payload


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    join_key: str,
    group_left: Sequence[str],
    group_right: Sequence[str],
    value: str,
    stamp: str,
    distinct: str | None = None,
    outer: bool = False,
) -> DataFrame:
    """``left JOIN right ON join_key GROUP BY group_left + group_right`` without the joined rows ever existing.

    Both inputs are first folded by join key (and their group columns): the left
    to (rows, sum, largest, latest), the right to its number of rows. Only these
    states are joined. Counts and sums multiply by the other side's number of
    rows, largest and latest carry over, and the states are rolled up to the
    groups. Each fold combines before its shuffle, so a key with a third of all
    rows reaches a reducer as one record per map task.

    ``distinct``: a left column whose distinct values are counted; it joins the
    first fold's key, which also spreads a hot group over its values. As a join
    key may then have many states, keys with more than a thousandth of them (at
    most 1000) are spread over the tasks of the join too.

    Output: groups, ``n_rows``, ``value_sum``, ``value_max``, ``value_latest``
    (latest ``stamp``, of equal stamps the larger value) and ``n_distinct``.
    Defined cases: null values count as rows but add nothing; a group without
    any value has null results; null join keys match nothing (with ``outer``
    they stay, once); null groups are a group; empty input gives no rows.
    """
    extra = [distinct] if distinct and distinct not in group_left and distinct != join_key else []
    left_keys = list(dict.fromkeys([join_key, *group_left, *extra]))
    v = F.col(value).cast("bigint")
    a = (
        left.select(*[F.col(k) for k in left_keys], v.alias("__v"), F.when(v.isNotNull(), stamp_and_payload(F.col(stamp), v)).alias("__p"))
        .groupBy(*left_keys)
        .agg(F.count(F.lit(1)).alias("__n"), F.sum("__v").alias("__sum"), F.max("__v").alias("__max"), F.max("__p").alias("__last"))
    )
    right_group = [F.col(g).alias(f"__r_{g}") for g in group_right]
    b = right.select(F.col(join_key).alias("__k"), *right_group).groupBy("__k", *[f"__r_{g}" for g in group_right]).agg(F.count(F.lit(1)).alias("__m"))
    how = "left" if outer else "inner"
    if len(left_keys) > 1:
        joined = salted_join(a, b.withColumnRenamed("__k", join_key), [join_key], how)
    else:
        joined = a.join(b, a[join_key] == b["__k"], how)
    joined = joined.withColumn("__m", F.coalesce("__m", F.lit(1)))
    groups = [F.col(g) for g in group_left] + [F.col(f"__r_{g}").alias(g) for g in group_right]
    weighted = joined.select(
        *groups,
        *([F.col(distinct).alias("__d")] if distinct else []),
        (F.col("__n") * F.col("__m")).alias("__n"),
        (F.col("__sum") * F.col("__m")).alias("__sum"),
        "__max",
        "__last",
    )
    names = [*group_left, *group_right]
    fold = [F.sum("__n").alias("__n"), F.sum("__sum").alias("__sum"), F.max("__max").alias("__max"), F.max("__last").alias("__last")]
    if distinct:
        weighted = weighted.groupBy(*names, "__d").agg(*fold)
    last = weighted.groupBy(*names).agg(*fold, *([F.count("__d").alias("n_distinct")] if distinct else []))
    return last.select(
        *names,
        F.col("__n").alias("n_rows"),
        F.col("__sum").alias("value_sum"),
        F.col("__max").alias("value_max"),
        payload_of(F.col("__last")).alias("value_latest"),
        *(["n_distinct"] if distinct else []),
    )
