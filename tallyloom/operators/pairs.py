"""Pairs of items that share a basket, counted without gathering any basket in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Baskets with more distinct items than this are split into chunks of about this many items.
CHUNK = 256
#: A basket with more than this share of all rows is told apart before any shuffle; there are at most ``1 / HOT_SHARE``.
HOT_SHARE = 0.001


def _pairs_of(lists: DataFrame, left: str, right: str | None, scope: Sequence[str]) -> DataFrame:
    """Rows ``item_a < item_b``: within one sorted list, or across two lists of different chunks."""
    if right is None:
        firsts = lists.select(*scope, F.posexplode(left).alias("at", "item_a"), F.col(left).alias("all"))
        rest = F.slice("all", F.col("at") + 2, F.greatest(F.size("all") - F.col("at") - 1, F.lit(0)))
        return firsts.select(*scope, "item_a", F.explode(rest).alias("item_b"))
    across = lists.select(*scope, F.explode(left).alias("x"), F.col(right).alias("others")).select(*scope, "x", F.explode("others").alias("y"))
    return across.select(*scope, F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"))


def _split(rows: DataFrame, basket: list[str], chunk: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary baskets, and those of larger ones with their number of ``chunks``.

    The largest baskets, those with over ``HOT_SHARE`` of all rows, get it by
    broadcast, so their rows are not even shuffled together to learn it.
    """
    sizes = rows.groupBy(*basket).agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size").alias("t")).select("t").scalar()
    huge = sizes.where(F.col("size") > chunk).select(*basket, F.ceil(F.col("size") / chunk).cast("int").alias("chunks"), (F.col("size") > total * F.lit(HOT_SHARE)).alias("hot"))
    hot = F.broadcast(huge.where("hot").drop("hot"))
    # All other baskets are small against the whole: their rows may meet in a task.
    rest = rows.join(hot, basket, "left_anti").join(huge.where("NOT hot").drop("hot"), basket, "left")
    large = rows.join(hot, basket).unionByName(rest.where("chunks IS NOT NULL"))
    chunked = large.withColumn("c", F.pmod(F.xxhash64("item"), F.col("chunks")).cast("int"))
    return rest.where("chunks IS NULL").drop("chunks"), chunked.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))


def _complete(items: DataFrame, basket: list[str], item: str) -> DataFrame:
    whole = F.col(item).isNotNull()
    for b in basket:
        whole = whole & F.col(b).isNotNull()
    return items.where(whole).select(*basket, F.col(item).alias("item"))


def pair_counts(items: DataFrame, basket: Sequence[str], item: str, chunk: int = CHUNK, scope: Sequence[str] = ()) -> DataFrame:
    """Number of baskets that hold both items, for every pair that occurs: ``scope``, ``item_a < item_b``, ``n``.

    ``basket``: the columns that name a basket; ``scope``: those of them by
    which pairs are counted apart. ``items`` must hold each (basket, item) once
    and is read three times, so it should be a written table. Baskets of up to
    ``chunk`` items become one sorted array each, whose pairs are emitted by one
    task. Larger baskets are split into chunks by a hash of the item; every pair
    of chunks is a block of its own that any task may take, so a basket with a
    third of all rows is spread over ``(items / chunk) ** 2 / 2`` blocks. The
    largest baskets, those with over ``HOT_SHARE`` of all rows, get their number
    of chunks by broadcast, so that their rows are not even shuffled together to
    learn it. Pairs within a chunk and across two chunks are added to those of
    ordinary baskets in one aggregation that combines before its shuffle.
    Nothing is capped: all pairs of all baskets are counted. Null baskets and
    items are left out.
    """
    basket = list(basket)
    ordinary, large = _split(_complete(items, basket, item), basket, chunk)
    small = ordinary.groupBy(*basket).agg(F.sort_array(F.collect_list("item")).alias("list")).where(F.size("list") > 1)
    blocks = large.select(*basket, "item", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), (F.col("c") <= F.col("o")).alias("first"))
    lists = blocks.groupBy(*basket, "i", "j").agg(
        F.sort_array(F.collect_list(F.when(F.col("first"), F.col("item")))).alias("left"),
        F.collect_list(F.when(~F.col("first"), F.col("item"))).alias("right"),
    )
    inside = _pairs_of(lists.where("i = j"), "left", None, scope)
    across = _pairs_of(lists.where("i < j"), "left", "right", scope)
    pairs = _pairs_of(small, "list", None, scope).unionByName(inside).unionByName(across)
    return pairs.groupBy(*scope, "item_a", "item_b").agg(F.count(F.lit(1)).alias("n"))


def cross_counts(left: DataFrame, right: DataFrame, basket: Sequence[str], item: str, chunk: int = CHUNK, scope: Sequence[str] = ()) -> DataFrame:
    """Number of baskets that hold ``item_a`` on the left and ``item_b`` on the right: ``scope``, ``item_a``, ``item_b``, ``n``.

    Baskets and chunks as in :func:`pair_counts`; both sides must hold each
    (basket, item) once. An item may be paired with itself.
    """
    basket = list(basket)
    both = _complete(left, basket, item).withColumn("on_left", F.lit(True)).unionByName(_complete(right, basket, item).withColumn("on_left", F.lit(False)))
    ordinary, large = _split(both, basket, chunk)
    sides = [F.collect_list(F.when(F.col("on_left"), F.col("item"))).alias("left"), F.collect_list(F.when(~F.col("on_left"), F.col("item"))).alias("right")]
    blocks = large.select(*basket, "item", "on_left", F.when(F.col("on_left"), F.col("c")).otherwise(F.col("o")).alias("i"), F.when(F.col("on_left"), F.col("o")).otherwise(F.col("c")).alias("j"))
    lists = ordinary.groupBy(*basket).agg(*sides).select(*basket, "left", "right").unionByName(blocks.groupBy(*basket, "i", "j").agg(*sides).select(*basket, "left", "right"))
    pairs = lists.select(*scope, F.explode("left").alias("item_a"), "right").select(*scope, "item_a", F.explode("right").alias("item_b"))
    return pairs.groupBy(*scope, "item_a", "item_b").agg(F.count(F.lit(1)).alias("n"))
