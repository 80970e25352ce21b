"""Co-occurrence over windowed, signature-deduplicated populations of baskets.

Column roles: baskets have ``basket, format, source, event, day``; lines have
``basket, board, item, raw_name, n``; populations have ``population_id, format,
window_code, floor, has_side, merge_extra``. Every function maps DataFrames to
one DataFrame and reads no clock: the end of the windows is a parameter.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.pairs import cross_counts, pair_counts
from tallyloom.operators.resolve import display_form

RECENT_DAYS = 90


def _reprint(baskets: DataFrame, official: str, aggregator: str, marker: str) -> DataFrame:
    """Baskets with the flag ``reprint``: null where it can't be told."""
    first = baskets.where(F.col("source").like(f"{official}%")).groupBy("format").agg(F.min("day").alias("first_official"))
    return baskets.join(first, "format", "left").withColumn(
        "reprint", F.col("source").like(f"{aggregator}%") & F.col("event").like(f"{marker}%") & (F.col("day") >= F.col("first_official"))
    ).drop("first_official")


def source_coverage(baskets: DataFrame, official: str, aggregator: str, marker: str, keep_unknown: bool = True) -> DataFrame:
    """Drops an aggregator's reprints dated on or after the first official basket of their format.

    ``keep_unknown`` decides about rows whose test is null (no event, no date,
    no official rows): co-occurrence keeps them, adoption drops them.
    """
    test = F.col("reprint")
    flagged = _reprint(baskets, official, aggregator, marker)
    return flagged.where(~F.coalesce(test, F.lit(not keep_unknown))).drop("reprint")


def basket_lines(lines: DataFrame, baskets: DataFrame | None = None) -> DataFrame:
    """Sums counts by basket, board and item; without an item by the raw name (``unresolved``)."""
    if baskets is not None:
        lines = lines.join(baskets.select("basket").distinct(), "basket", "left_semi")
    return (
        lines.withColumn("unresolved", F.when(F.col("item").isNull(), F.col("raw_name")))
        .groupBy("basket", "board", "item", "unresolved")
        .agg(F.sum("n").cast("bigint").alias("n"))
    )


def _label() -> Column:
    return F.coalesce(F.concat(F.lit("i"), F.col("item").cast("string")), F.concat(F.lit("n"), F.col("unresolved")))


def basket_signatures(lines: DataFrame) -> DataFrame:
    """md5 of the sorted ``board:item x count`` parts of each basket; baskets with a count of 0 or less are dropped.

    Baskets are bounded by what one list can hold, so their parts may be
    gathered; parts without a name are skipped, as in ordered string aggregation.
    """
    part = F.struct(F.col("board"), _label().alias("label"), F.concat("board", F.lit(":"), _label(), F.lit("x"), F.col("n").cast("string")).alias("text"))
    return (
        lines.groupBy("basket")
        .agg(F.array_sort(F.collect_list(part)).alias("parts"), F.bool_or(F.col("item").isNull()).alias("has_unresolved"), F.bool_and(F.col("n") > 0).alias("valid"))
        .where("valid")
        .select("basket", F.md5(F.array_join("parts.text", ",")).alias("sig"), "has_unresolved")
    )


def plain_signatures(lines: DataFrame) -> DataFrame:
    """The other signature: boards and items only; counts and unresolved names are ignored."""
    part = F.struct(F.col("board"), F.col("item"), F.concat("board", F.lit(":"), F.col("item").cast("string")).alias("text"))
    return (
        lines.where(F.col("item").isNotNull())
        .groupBy("basket")
        .agg(F.array_sort(F.collect_list(part)).alias("parts"))
        .select("basket", F.md5(F.array_join("parts.text", ",")).alias("sig"))
    )


def population_windows(populations: DataFrame, baskets: DataFrame, end: date, days: int = RECENT_DAYS) -> DataFrame:
    """Half-open windows ``[window_start, window_end)``; null bounds are open, also where a format has no dates."""
    dated = baskets.where(F.col("day").isNotNull()).select("format").distinct().withColumn("dated", F.lit(True))
    start = F.when(F.col("window_code") != "all", F.lit(end - timedelta(days=days)))
    return populations.join(dated, "format", "left").withColumn("window_start", start).withColumn("window_end", F.when(F.col("dated"), F.lit(end))).drop("dated")


def windowed_baskets(windows: DataFrame, baskets: DataFrame, signatures: DataFrame) -> DataFrame:
    """Baskets of each population, not yet deduplicated: a range join by format against the few windows."""
    inside = (F.col("window_end").isNull() | (F.col("day") < F.col("window_end"))) & (F.col("window_start").isNull() | (F.col("day") >= F.col("window_start")))
    few = windows.select("population_id", "format", "window_start", "window_end")
    return baskets.join(few, "format").where(inside).join(signatures, "basket").select("population_id", "basket", "source", "day", "sig", "has_unresolved")


def representatives(raw: DataFrame) -> DataFrame:
    """The smallest basket of each population and signature; windows are applied before, not after."""
    first = F.min(F.struct("basket", "source", "has_unresolved")).alias("r")
    return raw.groupBy("population_id", "sig").agg(first).select("population_id", "r.basket", "r.source", "r.has_unresolved")


def item_sets(reps: DataFrame, lines: DataFrame, windows: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct items of each representative: the main set (with the extra board where a population merges it) and the side set.

    ``excluded``: items that never count. The two boards of the main set are two
    plain branches, so each keeps its equality join.
    """
    known = lines.where(F.col("item").isNotNull()).join(excluded.select("item"), "item", "left_anti").select("basket", "board", "item")
    flags = windows.select("population_id", "has_side", "merge_extra")
    joined = reps.select("population_id", "basket").join(flags, "population_id").join(known, "basket")
    main = joined.where((F.col("board") == "main") | ((F.col("board") == "commander") & F.col("merge_extra")))
    side = joined.where((F.col("board") == "side") & F.col("has_side"))
    return tuple(x.select("population_id", "basket", "item").distinct() for x in (main, side))


def denominators(main: DataFrame, side: DataFrame, windows: DataFrame) -> DataFrame:
    """Baskets per population and item: main count, and side count (null where the population has no side)."""
    both = main.select("population_id", "item", F.lit(1).alias("m"), F.lit(0).alias("s")).unionByName(side.select("population_id", "item", F.lit(0).alias("m"), F.lit(1).alias("s")))
    summed = both.groupBy("population_id", "item").agg(F.sum("m").alias("main_count"), F.sum("s").alias("side"))
    return summed.join(windows.select("population_id", "has_side"), "population_id").select("population_id", "item", "main_count", F.when(F.col("has_side"), F.col("side")).alias("side_count"))


def population_pairs(main: DataFrame, side: DataFrame, windows: DataFrame) -> DataFrame:
    """Pairs with their number of baskets: ``m`` main-main with a < b, ``s`` main-side directed; only from each population's floor up.

    A pair is in no more baskets than either of its items, so items below the
    floor of their population leave before any pair is made. Main and side are
    read several times and should be written tables.
    """
    floors = windows.select("population_id", "floor")
    common = lambda d: d.groupBy("population_id", "item").agg(F.count(F.lit(1)).alias("m")).join(floors, "population_id").where("m >= floor").select("population_id", "item")
    a, b = (d.join(common(d), ["population_id", "item"], "left_semi") for d in (main, side))
    scope = ["population_id"]
    one = pair_counts(a, ["population_id", "basket"], "item", scope=scope).withColumn("relation", F.lit("m"))
    two = cross_counts(a, b, ["population_id", "basket"], "item", scope=scope).withColumn("relation", F.lit("s"))
    counted = one.unionByName(two).select("population_id", "relation", "item_a", "item_b", "n")
    return counted.join(floors, "population_id").where("n >= floor").drop("floor")


def consistency(reps: DataFrame, counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per population: lists, and how many counts, pairs without counts, and impossible pairs there are. Good ones have three zeros."""
    n = reps.groupBy("population_id").agg(F.count(F.lit(1)).alias("n_lists"))
    bad_counts = counts.join(n, "population_id", "left").groupBy("population_id").agg(
        F.count_if((F.col("main_count") > F.coalesce("n_lists", F.lit(0))) | (F.col("side_count") > F.coalesce("n_lists", F.lit(0)))).alias("bad_counts")
    )
    a = counts.select("population_id", F.col("item").alias("item_a"), F.col("main_count").alias("ma"))
    b = counts.select("population_id", F.col("item").alias("item_b"), F.col("main_count").alias("mb"), F.col("side_count").alias("sb"))
    ends = pairs.join(a, ["population_id", "item_a"], "left").join(b, ["population_id", "item_b"], "left").join(n, "population_id", "left")
    nb = F.when(F.col("relation") == "m", F.col("mb")).otherwise(F.col("sb"))
    judged = ends.withColumn("nb", nb).groupBy("population_id").agg(
        F.count_if(F.col("ma").isNull() | F.col("nb").isNull()).alias("orphan_pairs"),
        F.count_if((F.col("n") > F.least("ma", "nb")) & F.col("ma").isNotNull() & F.col("nb").isNotNull() | (F.col("ma") + F.col("nb") - F.col("n") > F.coalesce("n_lists", F.lit(0)))).alias("bad_pairs"),
    )
    return n.join(bad_counts, "population_id", "outer").join(judged, "population_id", "outer").fillna(0)


def publishable(checked: DataFrame) -> DataFrame:
    """Populations that pass; the others keep what was published before."""
    return checked.where("bad_counts = 0 AND orphan_pairs = 0 AND bad_pairs = 0").select("population_id")


def population_stats(windows: DataFrame, raw: DataFrame, reps: DataFrame, counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per population: window, dates, raw and kept lists, rows, and raw and kept lists by source as maps in order of the source; lists of no source are in the totals only."""
    r = raw.groupBy("population_id").agg(F.min("day").alias("first_day"), F.max("day").alias("latest_day"), F.count(F.lit(1)).alias("raw_count"))
    k = reps.groupBy("population_id").agg(F.count(F.lit(1)).alias("deck_count"), F.count_if("has_unresolved").alias("unresolved_count"))

    def by_source(df: DataFrame, name: str) -> DataFrame:
        counted = df.where(F.col("source").isNotNull()).groupBy("population_id", "source").agg(F.count(F.lit(1)).alias("n"))
        return counted.groupBy("population_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias(name))

    c = counts.groupBy("population_id").agg(F.count(F.lit(1)).alias("card_rows"))
    p = pairs.groupBy("population_id").agg(F.count(F.lit(1)).alias("pair_rows"))
    out = windows.select("population_id", "window_start", "window_end")
    for part in (r, k, by_source(raw, "raw_by_source"), by_source(reps, "kept_by_source"), c, p):
        out = out.join(part, "population_id", "left")
    return out.fillna(0, ["raw_count", "deck_count", "unresolved_count", "card_rows", "pair_rows"])


def partner_table(pairs: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Every pair from the side of either item: share of the anchor's baskets and lift, rounded to one digit.

    ``m`` pairs are read in both directions; ``s`` pairs only as stored, without
    an item's pair with itself.
    """
    forward = pairs.where("item_a <> item_b").select("population_id", "relation", F.col("item_a").alias("anchor"), F.col("item_b").alias("partner"), "n")
    back = pairs.where("relation = 'm'").select("population_id", "relation", F.col("item_b").alias("anchor"), F.col("item_a").alias("partner"), "n")
    a = counts.join(totals, "population_id").select("population_id", F.col("item").alias("anchor"), F.col("main_count").alias("ma"), "n_lists")
    b = counts.select("population_id", F.col("item").alias("partner"), F.col("main_count").alias("mb"), F.col("side_count").alias("sb"))
    both = forward.unionByName(back).join(a, ["population_id", "anchor"]).where("ma > 0").join(b, ["population_id", "partner"], "left")
    denominator = F.nullif(F.when(F.col("relation") == "s", F.col("sb")).otherwise(F.col("mb")), F.lit(0))
    return both.select(
        "population_id", "relation", "anchor", "partner", "n",
        F.round(F.lit(100.0) * F.col("n") / F.col("ma"), 1).alias("pct"),
        F.round(F.col("n").cast("double") * F.col("n_lists") / (F.col("ma").cast("double") * denominator), 1).alias("lift"),
        "ma",
    )


def top_partners(partners: DataFrame, k: int, order: str = "count", least_anchor: int = 20, least_n: int = 5) -> DataFrame:
    """The first ``k`` partners of every anchor.

    ``count``: by baskets, then partner. ``lift``: by the rounded lift, then
    baskets, then partner, among pairs with ``least_n`` baskets; anchors with
    fewer than ``least_anchor`` baskets fall back to the order by count.
    """
    by = ["population_id", "relation", "anchor"]
    if order == "count":
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), "partner"))
        return partners.withColumn("place", place).where(F.col("place") <= k).withColumn("ordered_by", F.lit("count"))
    enough = F.col("ma") >= least_anchor
    lifted = partners.where(enough & (F.col("n") >= least_n))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("lift").desc_nulls_last(), F.col("n").desc(), "partner"))
    first = lifted.withColumn("place", place).where(F.col("place") <= k).withColumn("ordered_by", F.lit("lift"))
    return first.unionByName(top_partners(partners.where(~enough), k, "count"))


def widened_window(header: DataFrame, least_anchor: int = 5) -> DataFrame:
    """Which window serves an anchor: the recent one unless it has too few baskets or no pairs, with the reason.

    ``header``: ``format, anchor, window_code, ma, has_pairs``, one row per window.
    """
    recent = F.max(F.when(F.col("window_code") != "all", F.struct("ma", "has_pairs")))
    out = header.groupBy("format", "anchor").agg(recent.alias("r"), F.bool_or(F.col("window_code") == "all").alias("has_all"))
    few = F.coalesce(F.col("r.ma"), F.lit(0)) < least_anchor
    none = ~F.coalesce(F.col("r.has_pairs"), F.lit(False))
    reason = F.when(~F.col("has_all"), None).when(F.col("r").isNull(), "no recent window").when(few, "few baskets").when(none, "no pairs")
    return out.select("format", "anchor", F.when(reason.isNull(), "recent").otherwise("all").alias("window"), reason.alias("reason"))


def readiness(stats: DataFrame, counts: DataFrame, now: Column, stale_days: int = 3) -> DataFrame:
    """State of each published population: ``not ready`` where the counted rows differ from the recorded ones, ``stale`` when old, else ``ready``.

    ``stats``: ``population_id, deck_count, card_rows, computed_at``.
    """
    seen = counts.groupBy("population_id").agg(F.count(F.lit(1)).alias("seen"))
    joined = stats.join(seen, "population_id", "left")
    broken = F.col("deck_count").isNull() | (F.coalesce("seen", F.lit(0)) != F.coalesce("card_rows", F.lit(-1)))
    old = F.col("computed_at") < now - F.make_dt_interval(F.lit(stale_days))
    return joined.select("population_id", F.when(broken, "not ready").when(old, "stale").otherwise("ready").alias("state"))


def colour_partners(baskets: DataFrame, lines: DataFrame, cards: DataFrame, anchor: int | Column, board: str = "main", least_with: int = 3, excluded: str = "Basic Land") -> DataFrame:
    """Partners of one item against lists that have at least the item's colours.

    Lists are deduplicated by their plain signature. Shares in percent; ``ratio``
    is the share with the anchor over the share in lists of those colours.
    ``anchor`` may be a scalar subquery.
    """
    kept = basket_lines(lines.join(baskets.select("basket"), "basket", "left_semi"))
    first = plain_signatures(kept).groupBy("sig").agg(F.min("basket").alias("basket")).select("basket")
    items = kept.where(F.col("item").isNotNull()).join(first, "basket", "left_semi").select("basket", "item", "board").distinct()
    colours = cards.select(F.col("id").alias("item"), F.coalesce("colors", F.array().cast("array<string>")).alias("colors"), F.coalesce("type_line", F.lit("")).alias("type_line"), "card_name")
    wanted = colours.where(F.col("item") == anchor).limit(1).select("colors").scalar()
    per_list = items.where("board = 'main'").join(colours, "item").select("basket", F.explode("colors").alias("c")).groupBy("basket").agg(F.collect_set("c").alias("have"))
    none = F.array().cast("array<string>")
    covers = F.size(F.array_except(wanted, F.coalesce("have", none))) == 0
    flagged = first.join(per_list, "basket", "left").select("basket", F.coalesce(covers, F.lit(False)).alias("same_colours"))
    has = items.where((F.col("item") == anchor) & (F.col("board") == "main")).select("basket").distinct().withColumn("has_anchor", F.lit(True))
    flagged = flagged.join(has, "basket", "left").fillna(False, ["has_anchor"])
    na = flagged.agg(F.count_if("has_anchor").alias("v")).select("v").scalar()
    nc = flagged.agg(F.count_if("same_colours").alias("v")).select("v").scalar()
    counts = items.where(F.col("board") == board).join(flagged, "basket").groupBy("item").agg(F.count_if("has_anchor").alias("n_with"), F.count_if("same_colours").alias("n_partner"))
    pct = lambda a, b: F.round(F.lit(100.0) * a / F.nullif(b, F.lit(0)), 1)
    shown = counts.where((F.col("item") != anchor) & (F.col("n_with") >= least_with)).join(colours, "item").where(~F.col("type_line").contains(excluded))
    return shown.select(
        F.col("item").alias("partner"), "n_with", pct(F.col("n_with"), na).alias("pct_with"), "n_partner", pct(F.col("n_with"), F.col("n_partner")).alias("pct_back"), pct(F.col("n_partner"), nc).alias("pct_base"),
        F.round((F.col("n_with") / F.nullif(na, F.lit(0))) / F.nullif(F.col("n_partner") / F.nullif(nc, F.lit(0)), F.lit(0.0)), 2).alias("ratio"),
        na.alias("n_anchor_lists"), nc.alias("n_color_lists"),
    )


def card_partners(baskets: DataFrame, lines: DataFrame, cards: DataFrame, format_name: str, card: str, since: Column, board: str = "main", least_with: int = 3) -> DataFrame:
    """:func:`colour_partners` of a card by its name, in a format's lists from a day on.

    The name is a full one, else a front; of several cards the smallest id. The
    partners come with their display form, and with the card's colours. An
    unknown card or format gives no rows.
    """
    named = cards.where((F.col("card_name") == card) | (F.col("name_en_front") == card))
    anchor = named.orderBy((F.col("card_name") == card).desc_nulls_last(), "id").limit(1)
    inside = baskets.where((F.col("format") == format_name) & (F.col("day") >= since)).select("basket")
    got = colour_partners(inside, lines, cards, anchor.select("id").scalar(), board, least_with)
    shown = cards.select(F.col("id").alias("partner"), display_form(F.col("japanese_name"), F.col("card_name")).alias("shown"))
    colours = anchor.select(F.array_join(F.filter(F.array(*[F.lit(c) for c in "WUBRG"]), lambda c: F.array_contains("colors", c)), "").alias("c")).select("c").scalar()
    order = ["n_with", "pct_with", "n_partner", "pct_back", "pct_base", "ratio", "n_anchor_lists", "n_color_lists"]
    return got.join(shown, "partner").select(F.col("shown").alias("partner"), *order, F.coalesce(colours, F.lit("")).alias("color_group"))


def adoption(baskets: DataFrame, lines: DataFrame, cards: DataFrame, excluded: str = "land") -> DataFrame:
    """Share of a format's baskets that hold an item on the main board. Not deduplicated; all baskets count below the line.

    Items whose type contains ``excluded``, or has no type, are left out.
    """
    total = baskets.where(F.col("format").isNotNull()).groupBy("format").agg(F.count(F.lit(1)).alias("total_decks"))
    kinds = cards.where(~F.lower("type_line").contains(excluded)).select(F.col("id").alias("item"))
    main = lines.where((F.col("board") == "main") & F.col("item").isNotNull()).select("basket", "item").distinct()
    played = main.join(kinds, "item").join(baskets.where(F.col("format").isNotNull()).select("basket", "format"), "basket").groupBy("item", "format").agg(F.count(F.lit(1)).alias("play_decks"))
    return played.join(total, "format").withColumn("rate", F.round(F.col("play_decks") / F.col("total_decks"), 6))


def constant_populations(formats: Sequence[str], first: int = 1) -> list[tuple[int, str, str, int]]:
    """Two populations per format, recent and all, numbered in the given order: (id, format, window, floor)."""
    out = []
    for f in formats:
        out += [(first + len(out), f, "recent_90d", 1), (first + len(out) + 1, f, "all", 2)]
    return out
