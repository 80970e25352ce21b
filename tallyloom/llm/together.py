"""Items that appear together, and how much more often than by chance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.common import salted_join
from tallyloom.operators.pairs import CHUNK, HOT_SHARE, pair_counts
from tallyloom.session import checkpoint_dir


def basket_counts(items: DataFrame, basket: str, item: str) -> DataFrame:
    """Distinct baskets per item: ``item``, ``m``. ``items`` must hold each (basket, item) once."""
    return items.groupBy(F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("m"))


def lift(n: Column, total: Column, m_a: Column, m_b: Column) -> Column:
    """How much more often than by chance: ``n * total / (m_a * m_b)``."""
    return n.cast("double") * total / (m_a.cast("double") * m_b)


def lift_at_least(n: Column, total: Column, m_a: Column, m_b: Column, least: int) -> Column:
    """The same comparison in whole numbers, without rounding."""
    big = "decimal(38,0)"
    return n.cast("decimal(19,0)").cast(big) * total.cast("decimal(19,0)") >= (m_a.cast("decimal(19,0)") * m_b.cast("decimal(15,0)")).cast(big) * F.lit(least).cast("decimal(3,0)")


def associations(items: DataFrame, basket: str, item: str, least_n: int = 1, least_share: int | None = None, least_lift: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Pairs of items with counts and lift: ``item_a < item_b``, ``n``, ``m_a``, ``m_b``, ``total``, ``lift``.

    ``items``: one row per (basket, item) or more; repeats count once, null
    baskets and items are left out. ``total`` is the number of baskets left.
    Thresholds keep pairs with ``n >= least_n``, ``n >= total / least_share``
    and ``lift >= least_lift``. Before any pair is made they drop the items that
    can't be in such a pair: ``n`` is at most either count, so an item needs the
    least count itself, and a pair with lift ``L`` needs both counts to be at
    most ``total / L``. This is exact. Co-occurring alone, with no thresholds,
    all pairs come out. An empty table gives no rows.

    The distinct rows and the counts of their items are checkpointed once in the
    shared folder, as each is used several times.
    """
    checkpoint_dir(items.sparkSession)
    once = items.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where(F.col("basket").isNotNull() & F.col("item").isNotNull()).distinct().checkpoint()
    total = once.agg(F.countDistinct("basket").alias("t")).select("t").scalar()
    m = basket_counts(once, "basket", "item").checkpoint()
    fits = F.col("m") >= least_n
    if least_share:
        fits = fits & (F.col("m") * least_share >= total)
    if least_lift:
        fits = fits & (F.col("m") * least_lift <= total)
    kept = m.where(fits)
    # Items with more than a thousandth of all rows, at most 1000, are spread over the join.
    popular = kept.where(F.col("m") > m.agg(F.sum("m").alias("t")).select("t").scalar() * F.lit(HOT_SHARE))
    n = pair_counts(salted_join(once, kept.select("item"), ["item"], "left_semi", heavy=popular).checkpoint(), ["basket"], "item", chunk)
    enough = F.col("n") >= least_n
    if least_share:
        enough = enough & (F.col("n") * least_share >= total)
    a = kept.select(F.col("item").alias("item_a"), F.col("m").alias("m_a"))
    b = kept.select(F.col("item").alias("item_b"), F.col("m").alias("m_b"))
    scored = n.where(enough).join(a, "item_a").join(b, "item_b").withColumn("total", total)
    if least_lift:
        scored = scored.where(lift_at_least(F.col("n"), F.col("total"), F.col("m_a"), F.col("m_b"), least_lift))
    return scored.select("item_a", "item_b", "n", "m_a", "m_b", "total", lift(F.col("n"), F.col("total"), F.col("m_a"), F.col("m_b")).alias("lift"))


def associations_given(pairs: DataFrame, counts: DataFrame, totals: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Lift for pairs already counted.

    ``pairs``: scope, ``item_a``, ``item_b``, ``n``; ``counts``: scope, ``item``,
    ``m``; ``totals``: scope, ``total``. The totals are attached to the counts
    first, so the pairs, the largest table, are joined twice only. Pairs without
    counts or total have no lift and are left out. Uneven keys are split by
    adaptive execution, since each pair row matches one row at most.
    """
    known = counts.join(totals, list(scope))
    a = known.select(*scope, F.col("item").alias("item_a"), F.col("m").alias("m_a"), "total")
    b = counts.select(*scope, F.col("item").alias("item_b"), F.col("m").alias("m_b"))
    scored = pairs.join(a, [*scope, "item_a"]).join(b, [*scope, "item_b"])
    return scored.withColumn("lift", lift(F.col("n"), F.col("total"), F.col("m_a"), F.col("m_b")))
