"""Entries over the operators: many questions at once, each answered with a status of a closed list.

An answer tells apart what was found, what does not exist (``no match``), what
could be several things (``ambiguous``), what was asked wrongly (``bad input``)
and what can't be told yet (``not ready``). Every function takes a table of
questions and reads each table it needs once for all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import search_tokens
from tallyloom.operators import resolve as N

OK, NO_MATCH, AMBIGUOUS, BAD_INPUT, NOT_READY = "ok", "no match", "ambiguous", "bad input", "not ready"


def clamp(k: int, low: int, high: int) -> int:
    """A wanted number of rows, brought into its range."""
    return max(low, min(int(k), high))


def first_with_more(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with ``place``, and ``more``: whether there are others. No group is counted to its end."""
    w = Window.partitionBy(*groups)
    probed = df.withColumn("place", F.row_number().over(w.orderBy(*order))).where(F.col("place") <= k + 1)
    return probed.withColumn("more", F.max("place").over(w) > k).where(F.col("place") <= k)


def containing(queries: DataFrame, query: str, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Texts that contain each query, ignoring case: ``query``, ``key``; an exact substring join without comparing all pairs.

    A text with the query in it has all of its three-letter runs, so both meet
    on the query's rarest run alone and only these candidates are compared.
    Queries shorter than three letters have no run and match nothing; null
    queries and texts are left out.
    """
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))
    q = queries.select(F.col(query).alias("query")).where(F.length(query) > 2).distinct().withColumn("low", F.lower("query"))
    t = texts.select(F.col(key).alias("key"), F.lower(text).alias("body")).where(F.length(text) > 2).distinct()
    index = t.select("key", F.explode(runs(F.col("body"))).alias("g"))
    often = index.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    rare = q.select("query", "low", F.explode(runs(F.col("low"))).alias("g")).join(often, "g", "left").groupBy("query", "low").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")).alias("r"))
    return rare.select("query", "low", "r.g").join(index, "g").join(t, "key").where(F.contains("body", "low")).select("query", "key").distinct()


def search_cards(queries: DataFrame, query: str, cards: DataFrame, columns: Sequence[str], k: int = 10, legal: str | None = None, digital: str | None = "digital") -> DataFrame:
    """Ranked card search for many queries: ``query, status, place, id, card_name, stage, more``.

    Stages: 0 the name, of either language, contains the whole query (equal ones
    first); 1 every word of the query stands in one of ``columns``; 2 names that
    are similar by trigrams (above 0.3), only where the others find nothing. A
    card stands once, at its first stage. ``legal`` names a key of the map
    column ``legalities`` that must say ``legal``; digital cards are left out
    unless ``digital`` is None. Words and queries of fewer than three letters
    are looked for in all cards, of which there is a catalogue's worth.
    """
    k = clamp(k, 1, 20)
    pool = cards
    if digital:
        pool = pool.where(~F.col(digital))
    if legal:
        pool = pool.where(F.col("legalities")[legal] == "legal")
    q = queries.select(F.col(query).alias("query")).distinct().withColumn("asked", F.lower(F.trim("query")))
    good = q.where(F.coalesce(F.col("asked") != "", F.lit(False)))
    names = F.array("card_name", "japanese_name")
    named = pool.select("id", F.explode(names).alias("n")).where("n IS NOT NULL")
    bodies = pool.select("id", F.explode(F.array(*columns)).alias("n")).where("n IS NOT NULL")
    whole = _holding(good.select("asked"), named).select("asked", "id", F.lit(0).alias("stage"))
    terms = good.select("asked", F.explode(F.array_distinct(F.filter(F.split("asked", r"\s+"), lambda w: w != ""))).alias("term"))
    n_terms = terms.groupBy("asked").agg(F.count(F.lit(1)).alias("wanted"))
    holds = _holding(terms.select(F.col("term").alias("asked")).distinct(), bodies).withColumnRenamed("asked", "term")
    every = terms.join(holds, "term").groupBy("asked", "id").agg(F.count(F.lit(1)).alias("have")).join(n_terms, "asked").where("have = wanted").select("asked", "id", F.lit(1).alias("stage"))
    found = whole.unionByName(every).groupBy("asked", "id").agg(F.min("stage").alias("stage")).withColumn("close", F.lit(0.0))
    left = good.join(found.select("asked").distinct(), "asked", "left_anti")
    # A card has two names at most.
    close = N.near_names(left, "asked", named, "n", "id", 2 * (k + 1), 0.3, ties=True)
    fuzzy = close.groupBy(F.col("query").alias("asked"), F.col("key").alias("id")).agg(F.max("similarity").alias("close")).select("asked", "id", F.lit(2).alias("stage"), "close")
    hits = found.unionByName(fuzzy).join(pool.select("id", "card_name", "japanese_name", "edhrec_rank"), "id")
    equal = (F.lower("card_name") == F.col("asked")) | F.coalesce(F.lower("japanese_name") == F.col("asked"), F.lit(False))
    order = [F.col("stage"), F.when(F.col("stage") == 0, equal).desc_nulls_last(), F.col("close").desc(), F.col("edhrec_rank").asc_nulls_last(), F.col("card_name"), F.col("id")]
    top = first_with_more(hits, ["asked"], order, k)
    status = F.when(F.coalesce(F.col("asked") == "", F.lit(True)), BAD_INPUT).when(F.col("id").isNull(), NO_MATCH).otherwise(OK)
    return q.join(top, "asked", "left").select("query", status.alias("status"), "place", "id", "card_name", "stage", "more")


def _holding(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """``asked``, ``id`` of texts (``id``, ``n``) that contain it; short ones are compared with all texts."""
    long_ = containing(asked, "asked", texts.select(F.struct("id", "n").alias("k"), "n"), "k", "n").select(F.col("query").alias("asked"), F.col("key")["id"].alias("id"))
    # A stated set of one- and two-letter queries, of which an alphabet has few, against the catalogue.
    short = asked.where(F.length("asked") < 3).distinct().join(texts.select("id", F.lower("n").alias("body")), F.contains("body", "asked")).select("asked", "id")
    return long_.unionByName(short).distinct()


def find_rules(queries: DataFrame, query: str, rules: DataFrame, limit: int = 12) -> DataFrame:
    """Rules by number or by words for many queries: ``query, status, mode, place, number, more``.

    ``rules``: ``number, is_glossary, body``. A number gives that rule and its
    direct children in order. Words give the rules that hold all of them, in
    any form, or, if none does and there are two words or more, any of them;
    more matched words first, then more often and shorter, glossary entries
    before rules, then the number. Where neither finds any, texts that contain
    the query as written, glossary first.
    """
    limit = clamp(limit, 1, 30)
    q = queries.select(F.col(query).alias("query")).distinct().withColumn("asked", F.trim("query"))
    good = q.where(F.coalesce(F.col("asked") != "", F.lit(False)))
    numbered = good.where(F.col("asked").rlike(r"^\d{1,3}(\.\d+[a-z]?)?\.?$")).withColumn("base", F.regexp_replace("asked", r"\.$", ""))
    # A direct child has the number without its last part, or without its letter.
    parent = rules.select("number", "is_glossary", F.explode(F.array_distinct(F.array("number", F.regexp_replace("number", r"\.\d+[a-z]?$", ""), F.regexp_replace("number", r"[a-z]$", "")))).alias("base"))
    by_number = numbered.join(parent, "base").select("asked", "number", "is_glossary", F.lit("number").alias("mode"), F.lit(0.0).alias("score"), F.lit(0).alias("n_terms"))
    worded = good.join(numbered.select("asked"), "asked", "left_anti")
    tokens = rules.select("number", "is_glossary", search_tokens(F.col("body")).alias("tokens"))
    index = tokens.select("number", "is_glossary", F.size("tokens").alias("length"), F.explode("tokens").alias("term")).groupBy("number", "is_glossary", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    terms = worded.select("asked", F.explode(F.array_distinct(search_tokens(F.col("asked")))).alias("term"))
    wanted = terms.groupBy("asked").agg(F.count(F.lit(1)).alias("wanted"))
    hits = terms.join(index, "term").groupBy("asked", "number", "is_glossary").agg(F.count(F.lit(1)).cast("int").alias("n_terms"), F.round(F.sum(F.col("tf") / (F.col("tf") + F.col("length") / 100.0)), 6).alias("score")).join(wanted, "asked")
    most = hits.groupBy("asked").agg(F.max("n_terms").alias("most"))
    by_words = hits.join(most, "asked").where((F.col("n_terms") == F.col("wanted")) | (F.col("most") < F.col("wanted"))).select("asked", "number", "is_glossary", F.when(F.col("most") == F.col("wanted"), "all").otherwise("any").alias("mode"), "score", "n_terms")
    left = worded.join(most.select("asked"), "asked", "left_anti")
    plain = containing(left, "asked", rules.select(F.struct("number", "is_glossary").alias("k"), "body"), "k", "body")
    by_text = plain.select(F.col("query").alias("asked"), F.col("key")["number"].alias("number"), F.col("key")["is_glossary"].alias("is_glossary"), F.lit("substring").alias("mode"), F.lit(0.0).alias("score"), F.lit(0).alias("n_terms"))
    top = first_with_more(by_number.unionByName(by_words).unionByName(by_text), ["asked"], [F.col("n_terms").desc(), F.col("score").desc(), F.col("is_glossary").desc(), F.col("number")], limit)
    status = F.when(F.coalesce(F.col("asked") == "", F.lit(True)), BAD_INPUT).when(F.col("number").isNull(), NO_MATCH).otherwise(OK)
    return q.join(top, "asked", "left").select("query", status.alias("status"), "mode", "place", "number", "more")


def find_rulings(queries: DataFrame, query: str, rulings: DataFrame, cards: DataFrame, limit: int = 20) -> DataFrame:
    """Rulings of many cards: ``query, status, stage, place, id, published_at, more``.

    A name is looked for as the rulings write it (0), then by the resolver over
    all names of the cards and the card's full name (1), ignoring case (2), and
    as part of the only name that holds it, from three letters on (3). The
    first stage that finds a name counts. A name the resolver finds ambiguous,
    or a part of several names, is not guessed. Newest rulings first.
    """
    limit = clamp(limit, 1, 50)
    q = queries.select(F.col(query).alias("query")).distinct().withColumn("asked", N.bare(F.col("query")))
    good = q.where(F.coalesce(F.col("asked") != "", F.lit(False)))
    names = rulings.select("card_name").where("card_name IS NOT NULL").distinct()
    exact = good.join(names, F.col("asked") == F.col("card_name")).select("asked", "card_name", F.lit(0).alias("stage"))
    resolved = N.resolve(good, "asked", N.name_table(cards))
    full = cards.select(F.col("id").alias("id"), F.col("card_name").alias("card_name"))
    by_id = resolved.where("status = 'resolved'").join(full, "id").select(F.col("query").alias("asked"), "card_name", F.lit(1).alias("stage")).join(names, "card_name", "left_semi")
    low = good.join(names, F.lower("asked") == F.lower("card_name")).select("asked", "card_name", F.lit(2).alias("stage"))
    part = containing(good, "asked", names, "card_name", "card_name").groupBy(F.col("query").alias("asked")).agg(F.min("key").alias("card_name"), F.count(F.lit(1)).alias("n"))
    only = part.where("n = 1").select("asked", "card_name", F.lit(3).alias("stage"))
    best = exact.unionByName(by_id).unionByName(low).unionByName(only).groupBy("asked").agg(F.min(F.struct("stage", "card_name")).alias("b")).select("asked", "b.stage", "b.card_name")
    unsure = resolved.where("status = 'ambiguous'").select(F.col("query").alias("asked")).unionByName(part.where("n > 1").select("asked")).distinct().withColumn("unsure", F.lit(True))
    hits = best.join(rulings.select("id", "card_name", "published_at"), "card_name").select("asked", "stage", "id", "published_at")
    top = first_with_more(hits, ["asked"], [F.col("published_at").desc_nulls_last(), F.col("id")], limit)
    status = F.when(F.coalesce(F.col("asked") == "", F.lit(True)), BAD_INPUT).when(F.col("id").isNotNull(), OK).when(F.col("unsure"), AMBIGUOUS).otherwise(NO_MATCH)
    return q.join(top, "asked", "left").join(unsure, "asked", "left").select("query", status.alias("status"), "stage", "place", "id", "published_at", "more")


#: Fewest baskets of a card for which its recent window serves, and for which partners are put in order of lift.
WIDEN_BELOW, LIFT_FROM, LIFT_PAIRS = 5, 20, 5


def find_partners(requests: DataFrame, windows: DataFrame, counts: DataFrame, partners: DataFrame, recorded: DataFrame, lands: DataFrame, limit: int = 15, exclude_lands: bool = False, order_by: str = "count") -> DataFrame:
    """Partners of many cards: ``format, relation, anchor, status, window, reason, ordered_by, place, partner, n, pct, lift, more``.

    ``requests``: ``format, relation, anchor``. The recent window serves unless
    the card has fewer than ``WIDEN_BELOW`` baskets there or no pairs of that
    relation; then the window over all time, with the reason. Status: ``bad
    input`` for an unknown format, relation or a side relation that the format
    does not keep; ``not ready`` where a window's rows differ from their
    recorded number (``recorded``: ``population_id, card_rows``); ``no match``
    for a card without baskets or partners. With ``order_by`` lift, cards of
    ``LIFT_FROM`` baskets or more have their partners of ``LIFT_PAIRS`` or more
    by lift, if there are any; all others by count.
    """
    if order_by not in ("count", "lift"):
        raise ValueError("order_by is count or lift")
    limit = clamp(limit, 1, 30)
    r = requests.select("format", "relation", "anchor").distinct().withColumn("rel", F.when(F.col("relation") == "main", "m").when(F.col("relation") == "side", "s"))
    w = windows.select("population_id", "format", (F.col("window_code") == "all").alias("whole"), "has_side")
    seen = counts.groupBy("population_id").agg(F.count(F.lit(1)).alias("seen"))
    state = recorded.select("population_id", "card_rows").join(seen, "population_id", "left").select("population_id", (F.coalesce("seen", F.lit(0)) == F.col("card_rows")).alias("whole_rows"))
    formats = w.join(state, "population_id", "left").groupBy("format").agg(F.bool_or("has_side").alias("keeps_side"), F.bool_and(F.coalesce("whole_rows", F.lit(False))).alias("ready"))
    pairs = partners.select("population_id", F.col("relation").alias("rel"), "anchor", "partner", "n", "pct", "lift")
    if exclude_lands:
        pairs = pairs.join(lands.select(F.col("item").alias("partner")).distinct(), "partner", "left_anti")
    asked = r.where("rel IS NOT NULL").join(w, "format").join(counts.select("population_id", F.col("item").alias("anchor"), F.col("main_count").alias("ma")), ["population_id", "anchor"], "left")
    having = partners.select("population_id", F.col("relation").alias("rel"), "anchor").distinct().withColumn("has_pairs", F.lit(True))
    header = asked.join(having, ["population_id", "rel", "anchor"], "left").select("format", "rel", "anchor", "population_id", "whole", F.coalesce("ma", F.lit(0)).alias("ma"), F.coalesce("has_pairs", F.lit(False)).alias("has_pairs"))
    both = header.groupBy("format", "rel", "anchor").agg(F.max(F.when(~F.col("whole"), F.struct("population_id", "ma", "has_pairs"))).alias("recent"), F.max(F.when(F.col("whole"), F.struct("population_id", "ma", "has_pairs"))).alias("all"))
    reason = F.when(F.col("recent").isNull() | F.col("all").isNull(), None).when(F.col("recent.ma") < WIDEN_BELOW, "few baskets").when(~F.col("recent.has_pairs"), "no pairs")
    used = F.when(F.col("recent").isNull() | reason.isNotNull(), F.col("all")).otherwise(F.col("recent"))
    chosen = both.select("format", "rel", "anchor", used.alias("u"), reason.alias("reason"), F.when(F.col("recent").isNull() | reason.isNotNull(), "all").otherwise("recent").alias("window"))
    chosen = chosen.select("format", "rel", "anchor", "u.population_id", "u.ma", "reason", "window")
    hits = chosen.join(pairs, ["population_id", "rel", "anchor"])
    if order_by == "lift":
        strong = (F.col("ma") >= LIFT_FROM) & (F.col("n") >= LIFT_PAIRS)
        any_strong = F.max(F.when(strong, 1).otherwise(0)).over(Window.partitionBy("format", "rel", "anchor"))
        hits = hits.withColumn("by_lift", any_strong == 1).where(~F.col("by_lift") | strong)
    else:
        hits = hits.withColumn("by_lift", F.lit(False))
    order = [F.when(F.col("by_lift"), F.col("lift")).desc_nulls_last(), F.col("n").desc(), F.col("partner")]
    top = first_with_more(hits, ["format", "rel", "anchor"], order, limit).select("format", "rel", "anchor", F.when(F.col("by_lift"), "lift").otherwise("count").alias("ordered_by"), "place", "partner", "n", "pct", "lift", "more")
    out = r.join(formats, "format", "left").join(chosen.select("format", "rel", "anchor", "window", "reason", "ma"), ["format", "rel", "anchor"], "left").join(top, ["format", "rel", "anchor"], "left")
    bad = F.col("ready").isNull() | F.col("rel").isNull() | ((F.col("rel") == "s") & ~F.col("keeps_side"))
    status = F.when(bad, BAD_INPUT).when(~F.col("ready"), NOT_READY).when(F.col("partner").isNull(), NO_MATCH).otherwise(OK)
    fine = ~bad & F.col("ready")
    shown = [F.when(fine, F.col(c)).alias(c) for c in ("window", "reason", "ordered_by", "place", "partner", "n", "pct", "lift", "more")]
    return out.select("format", "relation", "anchor", status.alias("status"), *shown)


def draft_pools(requests: DataFrame, key: str, code: str, scope: str, picks: str, version: str = "SD1") -> DataFrame:
    """Pools carried on from their codes: ``key, status, names, code``.

    ``requests``: a code (null for a new pool), the scope, and an array of picks
    (``position`` from 1, ``item``). A code that was changed gives ``bad input``
    with no names; a pick that contradicts the pool gives ``conflict``, one that
    leaves a place open ``gap``, and the pool stays as it was, with its code.
    Else the new names stand behind the known ones, under a new code. Picks that
    are known already change nothing. An empty pool has no code.
    """
    from tallyloom.operators.catalogue import apply_picks, decode_codes, encode_codes

    none = F.array().cast("array<string>")
    r = requests.select(F.col(key).alias("key"), F.col(code).alias("old"), F.col(scope).alias("wanted"), F.col(picks).alias("picks"))
    read = decode_codes(r, "old", [version])
    fine = F.col("old").isNull() | ((F.col("state") == "ok") & (F.col("scope") == F.col("wanted")))
    read = read.select("key", "old", "wanted", "picks", fine.alias("fine"), F.when(F.col("old").isNotNull() & fine, F.col("names")).otherwise(none).alias("known"))
    known = read.select("key", F.posexplode("known").alias("at", "item")).select("key", (F.col("at") + 1).alias("position"), "item")
    sent = read.where("fine").select("key", F.explode("picks").alias("p")).select("key", "p.position", F.col("p.item").cast("string").alias("item"))
    states = apply_picks(known, sent, "key").groupBy("key").agg(
        F.bool_or(F.col("state") == "conflict").alias("conflict"), F.bool_or(F.col("state") == "gap").alias("gap"),
        F.array_sort(F.collect_list(F.when(F.col("state") == "added", F.struct("position", "item")))).alias("added"),
    )
    joined = read.join(states, "key", "left")
    status = F.when(~F.col("fine"), BAD_INPUT).when(F.col("conflict"), "conflict").when(F.col("gap"), "gap").otherwise(OK)
    out = joined.withColumn("status", status).withColumn("names", F.when(F.col("status") == OK, F.concat("known", F.coalesce(F.col("added.item"), none))).otherwise(F.col("known")))
    coded = encode_codes(out.drop("code"), version, "wanted", F.col("names"))
    return coded.select("key", "status", "names", F.when(F.col("fine") & (F.size("names") > 0), F.col("code")).alias("code"))


def display_names(names: DataFrame, name: str, cards: DataFrame, as_of: Column, first: str, kind: str) -> DataFrame:
    """How typed names are shown: ``query, status, id, display, candidates, state``.

    A name that means one card gets its display form and release state; one
    that means several gets all of them in order and no form; an unknown one
    stays as it is.
    """
    from tallyloom.operators.catalogue import release_state

    got = N.resolve(names, name, N.name_table(cards))
    shown = N.display_name(cards).join(cards.select("id", release_state(F.col(first), as_of, F.col(kind)).alias("state")), "id")
    out = got.join(shown, "id", "left")
    return out.select("query", "status", "id", F.when(F.col("status") == "resolved", F.col("display")).when(F.col("status") == "unknown", F.col("query")).alias("display"), "candidates", F.when(F.col("status") == "resolved", F.col("state")).alias("state"))


def partial_matches(queries: DataFrame, query: str, cards: DataFrame, rulings: DataFrame, limit: int = 5) -> DataFrame:
    """Names that contain each query of three letters or more: ``query, source, place, card_name, more``.

    Source 0: cards, physical ones first, then by popularity; source 1: names
    that only the rulings have.
    """
    limit = clamp(limit, 1, 20)
    a = containing(queries, query, cards, "id", "card_name").withColumnRenamed("key", "id").join(cards.select("id", "card_name", "digital", "edhrec_rank"), "id")
    one = first_with_more(a, ["query"], [F.col("digital"), F.col("edhrec_rank").asc_nulls_last(), F.col("id")], limit).select("query", F.lit(0).alias("source"), "place", "card_name", "more")
    other = rulings.select("card_name").where("card_name IS NOT NULL").distinct().join(cards.select("card_name"), "card_name", "left_anti")
    b = containing(queries, query, other, "card_name", "card_name").withColumnRenamed("key", "card_name")
    two = first_with_more(b, ["query"], [F.col("card_name")], limit).select("query", F.lit(1).alias("source"), "place", "card_name", "more")
    return one.unionByName(two)


def report_lines(df: DataFrame, kind: str = "tsv") -> DataFrame:
    """Rows as lines of a report, tab-separated or as a markdown table: ``line``, the header not included (see :func:`report_header`).

    Null is an empty cell; tabs, line ends and bars that would break a cell become blanks.
    """
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"[\t\r\n|]", " ")
    cells = [cell(c) for c in df.columns]
    if kind == "tsv":
        return df.select(F.concat_ws("\t", *cells).alias("line"))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def report_header(columns: Sequence[str], kind: str = "tsv") -> list[str]:
    return ["\t".join(columns)] if kind == "tsv" else ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]


