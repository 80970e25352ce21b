"""Statistics from wide game and pick tables: one column per item."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wide_items(df: DataFrame, prefix: str) -> list[str]:
    """Items named by the columns that begin with ``prefix``, sorted."""
    return sorted(c[len(prefix) :] for c in df.columns if c.startswith(prefix))


def truth(c: Column) -> Column:
    """Text in any case read as a flag; null is false."""
    return F.coalesce(F.lower(c.cast("string")) == "true", F.lit(False))


def tier(c: Column) -> Column:
    """First part of a rank such as ``Platinum-4-0``, in lower case; ``none`` where it is missing."""
    return F.lower(F.split_part(F.coalesce(c, F.lit("none")), F.lit("-"), F.lit(1)))


def _present(prefix: str, item: str) -> Column:
    return F.coalesce(F.col(f"`{prefix}{item}`") > 0, F.lit(False))


def _cells(df: DataFrame, keep: Sequence[str], hand: str, drawn: str, deck: str) -> DataFrame:
    """Wide rows as one row per item present: an array of small structs is filtered before it is exploded, so absent cells are never rows."""
    items = wide_items(df, deck)
    cells = [F.struct(F.lit(i).alias("item"), _present(hand, i).alias("oh"), _present(drawn, i).alias("dr"), _present(deck, i).alias("gp")) for i in items]
    some = F.filter(F.array(*cells), lambda c: c["oh"] | c["dr"] | c["gp"])
    return df.select(*keep, F.explode(some).alias("c")).select(*keep, "c.*")


def game_stats(df: DataFrame, won: str = "won", groups: Sequence[str] = (), hand: str = "opening_hand_", drawn: str = "drawn_", deck: str = "deck_") -> DataFrame:
    """Games and wins per item: in hand at all (gih), opening hand (oh), drawn later (gd), in the deck (gp), and win rates.

    Missing counts are absence. Long decks of hundreds of columns are read once;
    the scan reads only the columns of the three prefixes.
    """
    df = df.withColumn("__won", truth(F.col(won)))
    long = _cells(df, ["__won", *groups], hand, drawn, deck)
    flags = {"gih": F.col("oh") | F.col("dr"), "oh": F.col("oh"), "gd": F.col("dr") & ~F.col("oh"), "gp": F.col("gp")}
    counts = [x for k, f in flags.items() for x in (F.count_if(f).alias(f"{k}_games"), F.count_if(f & F.col("__won")).alias(f"{k}_wins"))]
    out = long.groupBy(*groups, "item").agg(*counts)
    return out.select("*", *[F.round(F.col(f"{k}_wins") / F.nullif(F.col(f"{k}_games"), F.lit(0)), 4).alias(f"{k}_wr") for k in flags])


def seen_and_taken(df: DataFrame, draft: str, pack: str, pick_no: str, pick: str, prefix: str = "pack_card_") -> DataFrame:
    """Per item: packs seen and the mean of the last pick it was seen at (alsa), times taken and the mean pick (ata).

    The last pick is a maximum per draft, pack and item, so the order and the
    splitting of the input are of no consequence. Picks of items without a column
    are not among the items; :func:`unknown_picks` counts them.
    """
    items = wide_items(df, prefix)
    at = (F.col(pick_no).cast("double") + 1).alias("at")
    some = F.filter(F.array(*[F.struct(F.lit(i).alias("item"), _present(prefix, i).alias("p")) for i in items]), lambda c: c["p"])
    seen = df.select(F.col(draft).alias("d"), F.col(pack).alias("k"), at, F.explode(some).alias("c")).select("d", "k", "at", "c.item").where(F.col("at").isNotNull())
    last = seen.groupBy("d", "k", "item").agg(F.max("at").alias("last")).groupBy("item").agg(F.count(F.lit(1)).alias("seen_packs"), F.round(F.avg("last"), 4).alias("alsa"))
    taken = df.select(F.col(pick).alias("item"), at).where(F.col("item").isin(items) & F.col("at").isNotNull()).groupBy("item").agg(F.count(F.lit(1)).alias("taken_count"), F.round(F.avg("at"), 4).alias("ata"))
    return last.join(taken, "item", "outer").fillna(0, ["seen_packs", "taken_count"])


def unknown_picks(df: DataFrame, pick: str, prefix: str = "pack_card_") -> DataFrame:
    return df.where(F.col(pick).isNotNull() & ~F.col(pick).isin(wide_items(df, prefix))).groupBy(pick).agg(F.count(F.lit(1)).alias("n"))


def rate_rollup(df: DataFrame, groups: Sequence[str], won: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """Games, wins and win rate by any groups, with further sums."""
    w = truth(F.col(won))
    out = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("games"), F.count_if(w).alias("wins"), *[F.sum(c).alias(n) for n, c in (sums or {}).items()])
    return out.withColumn("wr", F.round(F.col("wins") / F.nullif(F.col("games"), F.lit(0)), 4))


def pick_means(df: DataFrame, pick: str, main: str, side: str, wins: str, losses: str) -> DataFrame:
    """Means per picked item. Both rates are divided by the number of known main rates, as published elsewhere."""
    known = F.count(main)
    both = F.col(wins).isNotNull() & F.col(losses).isNotNull()
    n = F.count_if(both)
    return df.where(F.col(pick).isNotNull()).groupBy(F.col(pick).alias("item")).agg(
        F.count(F.lit(1)).alias("picks"),
        F.round(F.sum(main) / F.nullif(known, F.lit(0)), 4).alias("main_rate"),
        F.round(F.sum(side) / F.nullif(known, F.lit(0)), 4).alias("side_rate"),
        F.when(n > 0, F.coalesce(F.sum(wins), F.lit(0))).alias("wins_sum"),
        F.when(n > 0, F.coalesce(F.sum(losses), F.lit(0))).alias("losses_sum"),
        n.alias("event_picks"),
    )


def two_group_table(colours: DataFrame, scope: str, code: str = "main_colors") -> DataFrame:
    """Two-letter groups without a splash: share of the scope's games and win rate beside the scope's own."""
    w = Window.partitionBy(scope)
    base = colours.withColumn("baseline_wr", F.round(F.sum("wins").over(w) / F.nullif(F.sum("games").over(w), F.lit(0)), 4))
    two = base.where((F.length(code) == 2) & ~F.col("splash"))
    return two.select(scope, code, "games", F.round(100.0 * F.col("games") / F.sum("games").over(w), 2).alias("share_pct"), F.round(F.col("wins") / F.nullif(F.col("games"), F.lit(0)), 4).alias("wr"), "baseline_wr")


def attach_stats(items: DataFrame, stats: DataFrame, key: str, scope: str, allowed: Sequence[str] | DataFrame) -> DataFrame:
    """Statistics of allowed scopes (a list, or a table of them) beside each item, and where else the item has any. Duplicate keys are an error, not a choice."""
    twice = stats.groupBy(key, scope).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("m")).select("m").scalar()
    if isinstance(allowed, DataFrame):
        stats = stats.join(allowed.select(scope).distinct().withColumn("__in", F.lit(True)), scope, "left")
        inside = F.coalesce("__in", F.lit(False))
    else:
        inside = F.col(scope).isin(list(allowed))
    by = stats.groupBy(key).agg(F.array_sort(F.collect_list(F.when(inside, F.struct(scope, "gih_games", "gih_wr")))).alias("stats"), F.array_sort(F.collect_set(F.when(~inside, F.col(scope)))).alias("elsewhere"))
    checked = F.when(F.coalesce(twice, F.lit(1)) > 1, F.raise_error(F.lit("duplicate statistics key")).cast("boolean")).otherwise(F.lit(True))
    return items.join(by, key, "left").where(checked).withColumn("has_stats", F.coalesce(F.size("stats") > 0, F.lit(False)))


#: Kinds of games that may stand before the name of a scope (fixed values).
PREFIXES = ("limited", "quickdraft", "premierdraft", "draft", "sealed")


def resolve_scopes(queries: DataFrame, query: str, scopes: DataFrame, key: str, code: str, name: str) -> DataFrame:
    """A scope for each query by code, by name, or by the only name that contains it or that it contains (four characters or more).

    A leading ``#`` and the kind of game are stripped. Output: ``query``,
    ``key`` (null unless one scope is meant), ``status`` (resolved, ambiguous,
    unknown). Codes and names are looked up by equality; only texts that
    neither finds are compared with all scopes, of which there are some hundred.
    """
    text = F.trim(F.regexp_replace(F.trim(F.col(query)), "^#+", ""))
    bare = F.lower(F.trim(F.regexp_replace(text, f"(?i)^({'|'.join(PREFIXES)})[ _:-]*", "")))
    q = queries.select(F.col(query)).distinct().withColumn("__x", bare)
    s = scopes.select(F.col(key).alias("__key"), F.lower(code).alias("__code"), F.lower(F.coalesce(name, F.lit(""))).alias("__name"))
    by = lambda stage, column: q.where("__x <> ''").join(s, F.col("__x") == F.col(column)).select(query, "__key", F.lit(stage).alias("__stage"))
    equal = by(0, "__code").unionByName(by(1, "__name"))
    left = q.where(F.length("__x") >= 4).join(equal.select(query).distinct(), query, "left_anti")
    part = left.join(s, (F.col("__name") != "") & (F.contains("__name", "__x") | F.contains("__x", "__name"))).select(query, "__key", F.lit(2).alias("__stage"))
    hits = equal.unionByName(part).groupBy(query, "__stage").agg(F.count(F.lit(1)).alias("n"), F.min("__key").alias("hit"))
    best = hits.groupBy(query).agg(F.min(F.struct("__stage", "n", "hit")).alias("b"))
    one = F.col("b.n") == 1
    return q.join(best, query, "left").select(query, F.when(one, F.col("b.hit")).alias(key), F.when(F.col("b").isNull(), "unknown").when(one, "resolved").otherwise("ambiguous").alias("status"))


def pack_report(packs: DataFrame, name: str, stats: DataFrame, scope: str, known: DataFrame, known_name: str, small: int = 500) -> DataFrame:
    """Each name of a pack with its statistics in the pack's own scope: ``scope``, ``name``, ``status``, ``gih_wr``, ``alsa``, ``small_sample``.

    ``exact``, ``ambiguous`` (several entries), ``not in set`` (a known name
    without statistics there), ``unverified`` (no known name); few games are
    flagged. Case is ignored. Names of a pack come out once; null ones are left out.
    """
    p = packs.select(scope, F.col(name).alias("name"), F.lower(name).alias("__n")).where(F.col("name").isNotNull()).distinct()
    by = stats.groupBy(scope, F.lower("card_name").alias("__n")).agg(F.count(F.lit(1)).alias("n"), F.min("gih_games").alias("games"), F.min("gih_wr").alias("gih_wr"), F.min("alsa").alias("alsa"))
    some = known.select(F.lower(known_name).alias("__n"), F.lit(True).alias("known")).distinct()
    one = F.col("n") == 1
    kind = F.when(one, "exact").when(F.col("n") > 1, "ambiguous").when(F.col("known"), "not in set").otherwise("unverified")
    return p.join(by, [scope, "__n"], "left").join(some, "__n", "left").select(scope, "name", kind.alias("status"), F.when(one, F.col("gih_wr")).alias("gih_wr"), F.when(one, F.col("alsa")).alias("alsa"), F.when(one, F.col("games") < small).alias("small_sample"))


def stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
