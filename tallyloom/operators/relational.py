"""Small relational operators that SQL users expect and Spark lacks by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order (``DISTINCT ON``)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def best_row(df: DataFrame, keys: Sequence[str], score: Column, position: str) -> DataFrame:
    """The row with the highest score per key; of equals the first by position. Combines before its shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(score, -F.col(position)))
    return df.groupBy(*keys).agg(best.alias("__b")).select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest])


def distinct_keep_order(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with the position of their first occurrence."""
    return df.groupBy(value).agg(F.min(position).alias(position))


def share_of_total(df: DataFrame, groups: Sequence[str], value: str, digits: int = 2) -> DataFrame:
    """Adds ``share``: percent of the group's total."""
    total = F.sum(value).over(Window.partitionBy(*groups))
    return df.withColumn("share", F.round(100.0 * F.col(value) / F.nullif(total, F.lit(0)), digits))


def top_k_with_ties_left(df: DataFrame, groups: Sequence[str], order: Column, tie: str, k: int) -> DataFrame:
    """First ``k`` rows per group, and how many rows equal to the last one were cut off."""
    w = Window.partitionBy(*groups)
    ranked = df.withColumn("place", F.row_number().over(w.orderBy(order, F.col(tie)))).withColumn("rank", F.rank().over(w.orderBy(order)))
    limit = F.max(F.when(F.col("place") == k, F.col("rank"))).over(w)
    cut = F.count_if((F.col("rank") == limit) & (F.col("place") > k)).over(w)
    return ranked.withColumn("ties_left", F.coalesce(F.when(limit.isNotNull(), cut), F.lit(0))).where(F.col("place") <= k).drop("rank")


def merge_ranked(lists: Sequence[DataFrame], key: str, rank: str, k: int) -> DataFrame:
    """Several ranked lists one after the other, each key once, the first ``k``: ``key``, ``list_no``, ``rank``."""
    tagged = [x.select(key, F.lit(i).alias("list_no"), F.col(rank).alias("rank")) for i, x in enumerate(lists)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    once = both.groupBy(key).agg(F.min(F.struct("list_no", "rank")).alias("b")).select(key, "b.list_no", "b.rank")
    return once.orderBy("list_no", "rank", key).limit(k)


def round_robin(df: DataFrame, stratum: str, key: str, k: int, seed: int = 1) -> DataFrame:
    """``k`` rows taken in turn from every stratum, in an order fixed by a seeded hash (md5, the same in every engine)."""
    n = F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), F.col(key)))
    return df.withColumn("round", n).orderBy("round", stratum).limit(k)


def first_n_per_bucket(df: DataFrame, bucket: Column, order: Column, tie: str, n: int) -> DataFrame:
    """First ``n`` rows of each bucket in rank order."""
    b = df.withColumn("bucket", bucket)
    return b.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(order, F.col(tie)))).where(F.col("place") <= n)


def sliding_count(df: DataFrame, key: str, stamp: str, seconds: int) -> DataFrame:
    """Events of the key in the last ``seconds``, the present one included, one exactly ``seconds`` old excluded."""
    micros = F.unix_micros(F.col(stamp).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("__us").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return df.withColumn("__us", micros).withColumn("n_window", F.count(F.lit(1)).over(w)).withColumn("oldest", F.min(stamp).over(w)).drop("__us")


def running_block(df: DataFrame, group: str, position: str, is_head: Column) -> DataFrame:
    """Numbers blocks: a head row begins one, the rows behind it belong to it."""
    return df.withColumn("block", F.sum(is_head.cast("int")).over(Window.partitionBy(group).orderBy(position)))


def unique_pattern_match(values: DataFrame, value: str, names: DataFrame, name: str) -> DataFrame:
    """Matches values in which ``?`` stands for one non-ASCII character; only unique matches count.

    Values and names meet on the text with ``?`` and non-ASCII characters both
    read as one mark, an equality join instead of a pattern against every name.
    """
    mark = lambda c: F.regexp_replace(c, r"[^\x00-\x7f]|\?", "?")
    left = values.where(F.col(value).contains("?")).select(F.col(value), mark(F.col(value)).alias("__k")).distinct()
    right = names.select(F.col(name).alias("matched"), mark(F.col(name)).alias("__k")).distinct()
    pairs = left.join(right, "__k").where(F.col("matched").rlike(r"[^\x00-\x7f]"))
    return pairs.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min("matched").alias("matched")).where("n = 1").drop("n")
