"""Queries for games, costs, catalogues, readers, guarded SQL and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.common import load, squash
from tallyloom.functions import costs as C
from tallyloom.operators import catalogue as K
from tallyloom.operators import games as G
from tallyloom.plans import names as PN
from tallyloom.plans import sqlgate as Q
from tallyloom.session import checkpoint_dir
from tallyloom.sources import readers as R
from tallyloom.streaming import jobs as J

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


N_ITEMS = 12
_ITEM = "(l_partkey % 12)::INT"


def wide_games(s, d):
    """Orders as games: one column per item class and place, pivoted with a fixed list of columns."""
    l = load(s, d, "lineitem").select("l_orderkey", F.concat(F.when(F.col("l_linenumber") <= 2, "opening_hand_").when(F.col("l_linenumber") <= 4, "drawn_").otherwise("side_"), (F.col("l_partkey") % N_ITEMS).cast("string")).alias("c"), F.concat(F.lit("deck_"), (F.col("l_partkey") % N_ITEMS).cast("string")).alias("k"))
    o = load(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", "True").otherwise("false").alias("won"), F.concat("o_orderpriority", F.lit("-4-0")).alias("rank"), (F.col("o_totalprice") % 9).cast("int").alias("num_turns"), F.substring("o_orderpriority", 3, 2).alias("main_colors"), (F.col("o_custkey") % 4 == 0).alias("splash"))
    cells = l.select("l_orderkey", F.explode(F.array("c", "k")).alias("c"))
    names = [f"{p}{i}" for p in ("opening_hand_", "drawn_", "deck_") for i in range(N_ITEMS)]
    return o.join(cells.groupBy("l_orderkey").pivot("c", names).count(), "l_orderkey", "left")


_LONG = f"""WITH o AS (SELECT o_orderkey, o_orderstatus = 'F' AS won, lower(split_part(o_orderpriority, '-', 1)) AS rank FROM orders),
c AS (SELECT o_orderkey, won, rank, {_ITEM}::VARCHAR AS item, bool_or(l_linenumber <= 2) AS oh, bool_or(l_linenumber IN (3, 4)) AS dr FROM lineitem JOIN o ON o_orderkey = l_orderkey GROUP BY ALL)"""
_FLAGS = {"gih": "oh OR dr", "oh": "oh", "gd": "dr AND NOT oh", "gp": "true"}
_COUNTS = ", ".join(f"count(*) FILTER ({f}) AS {k}_games, count(*) FILTER (({f}) AND won) AS {k}_wins, round(count(*) FILTER (({f}) AND won)::DOUBLE / nullif(count(*) FILTER ({f}), 0), 4) AS {k}_wr" for k, f in _FLAGS.items())


@query("a13_game_stats", f"{_LONG} SELECT item, {_COUNTS} FROM c GROUP BY item")
def _(s, d):
    return G.game_stats(wide_games(s, d))


@query("a17_rank_stats", f"{_LONG} SELECT rank, item, {_COUNTS} FROM c GROUP BY rank, item")
def _(s, d):
    return G.game_stats(wide_games(s, d).withColumn("rank", G.tier(F.col("rank"))), groups=["rank"])


@query("a16_rate_rollup", "SELECT substr(o_orderpriority, 3, 2) AS main_colors, o_custkey % 4 = 0 AS splash, count(*) AS games, count(*) FILTER (o_orderstatus = 'F') AS wins, sum((o_totalprice % 9)::INT - CASE WHEN (o_totalprice % 9)::INT > o_totalprice % 9 THEN 1 ELSE 0 END)::BIGINT AS turns, round(count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*), 4) AS wr FROM orders GROUP BY ALL")
def _(s, d):
    return G.rate_rollup(wide_games(s, d), ["main_colors", "splash"], "won", {"turns": F.col("num_turns")})


@query("d31_two_groups", "WITH c AS (SELECT o_orderstatus AS scope, substr(o_orderpriority, 3, 2) AS main_colors, o_custkey % 4 = 0 AS splash, count(*) AS games, count(*) FILTER (o_totalprice > 100000) AS wins FROM orders GROUP BY ALL), b AS (SELECT scope, sum(games) AS g, sum(wins) AS w FROM c GROUP BY 1) SELECT scope, main_colors, games, round(100.0 * games / sum(games) OVER (PARTITION BY scope), 2) AS share_pct, round(wins::DOUBLE / games, 4) AS wr, round(w::DOUBLE / g, 4) AS baseline_wr FROM c JOIN b USING (scope) WHERE length(main_colors) = 2 AND NOT splash")
def _(s, d):
    o = load(s, d, "orders").select(F.col("o_orderstatus").alias("scope"), F.substring("o_orderpriority", 3, 2).alias("main_colors"), (F.col("o_custkey") % 4 == 0).alias("splash"), (F.col("o_totalprice") > 100000).alias("won"))
    return G.two_group_table(G.rate_rollup(o, ["scope", "main_colors", "splash"], "won"), "scope")


def wide_picks(s, d):
    """Events as picks: packs of a user and day, one column per item class seen."""
    e = load(s, d, "events").select(F.col("user_id").alias("draft_id"), F.dayofmonth("ts").alias("pack_number"), F.hour("ts").alias("pick_number"), F.concat(F.lit("c"), (F.col("event_id") % 9).cast("string")).alias("pick"), "value", "event_id")
    seen = [(F.when((F.col("event_id") % (i + 2)) == 0, 1)).alias(f"pack_card_c{i}") for i in range(8)]
    return e.select("*", *seen)


_SEEN = " UNION ALL ".join(f"SELECT 'c{i}' AS item, user_id, day(ts) AS k, hour(ts) + 1 AS pos FROM events WHERE event_id % {i + 2} = 0" for i in range(8))


@query("a14_a15_seen_and_taken", f"""WITH seen AS ({_SEEN}), l AS (SELECT item, user_id, k, max(pos) AS last FROM seen GROUP BY ALL), a AS (SELECT item, count(*) AS seen_packs, round(avg(last), 4) AS alsa FROM l GROUP BY 1),
t AS (SELECT 'c' || event_id % 9 AS item, count(*) AS taken_count, round(avg(hour(ts) + 1), 4) AS ata FROM events WHERE event_id % 9 < 8 GROUP BY 1)
SELECT item, coalesce(seen_packs, 0) AS seen_packs, alsa, coalesce(taken_count, 0) AS taken_count, ata FROM a FULL JOIN t USING (item)""")
def _(s, d):
    return G.seen_and_taken(wide_picks(s, d), "draft_id", "pack_number", "pick_number", "pick")


@query("a15_unknown_picks", "SELECT 'c' || event_id % 9 AS pick, count(*) AS n FROM events WHERE event_id % 9 = 8 GROUP BY 1")
def _(s, d):
    return G.unknown_picks(wide_picks(s, d), "pick")


@query("a18_pick_means", "WITH e AS (SELECT 'c' || event_id % 9 AS item, CASE WHEN event_id % 3 > 0 THEN value END AS m, CASE WHEN event_id % 4 > 0 THEN value / 2 END AS x, CASE WHEN event_id % 5 > 0 THEN event_id % 7 END AS w, event_id % 3 AS l FROM events) SELECT item, count(*) AS picks, round(sum(m) / nullif(count(m), 0), 4) AS main_rate, round(sum(x) / nullif(count(m), 0), 4) AS side_rate, sum(w)::BIGINT AS wins_sum, sum(l)::BIGINT AS losses_sum, count(w) AS event_picks FROM e GROUP BY 1")
def _(s, d):
    i = F.col("event_id")
    e = wide_picks(s, d).withColumn("m", F.when(i % 3 > 0, F.col("value"))).withColumn("x", F.when(i % 4 > 0, F.col("value") / 2)).withColumn("w", F.when(i % 5 > 0, i % 7)).withColumn("l", i % 3)
    return G.pick_means(e, "pick", "m", "x", "w", "l")


_STATS = "(SELECT db_card_name AS n, expansion, gih_games, gih_wr FROM (SELECT *, row_number() OVER (PARTITION BY expansion, db_card_name ORDER BY computed_at DESC, event_type, card_name) AS rn FROM limited_card_stats WHERE db_card_name IS NOT NULL) WHERE rn = 1)"


@query("d30_attach_stats", f"WITH st AS {_STATS}, a AS (SELECT expansion FROM (SELECT DISTINCT expansion FROM limited_card_stats) ORDER BY expansion DESC LIMIT 2) SELECT id, coalesce(i.stats, '') AS stats, coalesce(i.stats, '') <> '' AS has_stats, e.elsewhere FROM mtg_cards_v2 LEFT JOIN (SELECT n, string_agg(expansion || ':' || gih_games, ',' ORDER BY expansion) AS stats FROM st WHERE expansion IN (SELECT * FROM a) GROUP BY n) i ON i.n = card_name LEFT JOIN (SELECT n, string_agg(DISTINCT expansion, ',' ORDER BY expansion) AS elsewhere FROM st WHERE expansion NOT IN (SELECT * FROM a) GROUP BY n) e ON e.n = card_name")
def _(s, d):
    """Statistics of the two newest sets beside every card, and the other sets that have any."""
    from tallyloom.operators.relational import first_per_key

    stats = load(s, d, "limited_card_stats")
    newest = stats.select("expansion").distinct().orderBy(F.col("expansion").desc()).limit(2)
    once = first_per_key(stats.where("db_card_name IS NOT NULL"), ["expansion", "db_card_name"], [F.col("computed_at").desc(), F.col("event_type"), F.col("card_name")]).select(F.col("db_card_name").alias("card_name"), "expansion", "gih_games", "gih_wr")
    got = G.attach_stats(load(s, d, "mtg_cards_v2").select("id", "card_name"), once, "card_name", "expansion", newest)
    shown = F.array_join(F.transform("stats", lambda x: F.concat_ws(":", x["expansion"], x["gih_games"])), ",")
    return got.select("id", F.coalesce(shown, F.lit("")).alias("stats"), "has_stats", F.when(F.size("elsewhere") > 0, F.array_join("elsewhere", ",")).alias("elsewhere"))


_SCOPES = """WITH q AS (SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN '#Draft N' || n_nationkey WHEN 1 THEN 'limited ' || lower(n_name) WHEN 2 THEN substr(n_name, 1, 4) ELSE 'Sealed: ' || substr(n_name, 1, 3) END AS t FROM nation),
b AS (SELECT k, t, lower(trim(regexp_replace(trim(ltrim(trim(t), '#')), '^(limited|quickdraft|premierdraft|draft|sealed)[ _:-]*', '', 'i'))) AS x FROM q),
h AS (SELECT k, t, n_nationkey AS hit, CASE WHEN lower('N' || n_nationkey) = x THEN 0 WHEN lower(n_name) = x THEN 1 WHEN length(x) >= 4 AND (contains(lower(n_name), x) OR contains(x, lower(n_name))) THEN 2 END AS stage FROM b, nation WHERE x <> ''),
f AS (SELECT k, min(stage) AS first FROM h GROUP BY 1), o AS (SELECT h.k, count(*) AS n, min(hit) AS hit, min(stage) AS stage FROM h JOIN f ON f.k = h.k AND stage = first GROUP BY 1)
SELECT q.k, q.t AS asked, CASE WHEN n = 1 THEN hit END AS hit, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status FROM q LEFT JOIN o USING (k)"""


@query("d29_scope", _SCOPES)
def _(s, d):
    """A code, a name with a prefix, or a part of a name of every nation, against all nations."""
    n = load(s, d, "nation")
    k, name = F.col("n_nationkey"), F.col("n_name")
    asked = F.when(k % 4 == 0, F.concat(F.lit("#Draft N"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("limited "), F.lower(name))).when(k % 4 == 2, F.substring(name, 1, 4)).otherwise(F.concat(F.lit("Sealed: "), F.substring(name, 1, 3)))
    queries = n.select(k.alias("k"), asked.alias("asked"))
    scopes = n.select(k.alias("hit"), F.concat(F.lit("N"), k.cast("string")).alias("code"), name.alias("name"))
    got = G.resolve_scopes(queries, "asked", scopes, "hit", "code", "name")
    return queries.join(got, "asked").select("k", "asked", "hit", "status")


_PACKS = """WITH p AS (SELECT DISTINCT a.expansion, l.card_name AS name FROM (SELECT expansion, row_number() OVER (ORDER BY expansion) AS i FROM (SELECT DISTINCT expansion FROM limited_card_stats)) a
  JOIN (SELECT expansion, row_number() OVER (ORDER BY expansion) AS i FROM (SELECT DISTINCT expansion FROM limited_card_stats)) b ON b.i = a.i + 1 JOIN limited_card_stats l ON l.expansion = b.expansion),
st AS (SELECT DISTINCT expansion, card_name, gih_games, gih_wr, alsa FROM limited_card_stats),
h AS (SELECT p.expansion, name, count(l.card_name) AS n, min(gih_wr) AS gih_wr, min(alsa) AS alsa, min(gih_games) AS g FROM p LEFT JOIN st l ON lower(l.card_name) = lower(name) AND l.expansion = p.expansion GROUP BY ALL),
k AS (SELECT lower(card_name) AS n FROM mtg_cards_v2 UNION SELECT lower(name_en_front) FROM mtg_cards_v2)
SELECT expansion, name, CASE WHEN n = 1 THEN 'exact' WHEN n > 1 THEN 'ambiguous' WHEN lower(name) IN (SELECT n FROM k) THEN 'not in set' ELSE 'unverified' END AS status, CASE WHEN n = 1 THEN gih_wr END AS gih_wr, CASE WHEN n = 1 THEN alsa END AS alsa, CASE WHEN n = 1 THEN g < 500 END AS small_sample FROM h"""


@query("d32_pack", _PACKS)
def _(s, d):
    """A pack for every set, of all names of the set after it."""
    st = load(s, d, "limited_card_stats")
    # One row per set.
    sets = st.select("expansion").distinct().withColumn("i", F.row_number().over(Window.orderBy("expansion")))
    after = sets.select(F.col("expansion").alias("own"), (F.col("i") + 1).alias("i")).join(sets.select(F.col("expansion").alias("other"), "i"), "i")
    packs = after.join(st.select(F.col("expansion").alias("other"), "card_name"), "other").select(F.col("own").alias("expansion"), "card_name")
    cards = load(s, d, "mtg_cards_v2")
    known = cards.select("card_name").unionByName(cards.select(F.col("name_en_front").alias("card_name"))).where("card_name IS NOT NULL")
    stats = st.select("expansion", "card_name", "gih_games", "gih_wr", "alsa").distinct()
    return G.pack_report(packs, "card_name", stats, "expansion", known, "card_name")


def _costs(s, d):
    sym = F.array(*[F.lit(x) for x in ("{2}", "{W}", "{U/R}", "{X}", "{B/P}", "{2/G}", "{C}", "{Q}", "")])
    pick = lambda k: F.element_at(sym, ((F.col("p_partkey") * k) % 9 + 1).cast("int"))
    return load(s, d, "part").select("p_partkey", F.concat(pick(1), pick(5), pick(7)).alias("cost"))


_SYM = "['{{2}}','{{W}}','{{U/R}}','{{X}}','{{B/P}}','{{2/G}}','{{C}}','{{Q}}',''][((p_partkey * {0}) % 9 + 1)::INT]"
_VAL = "[2,1,1,0,1,2,1,NULL,0][((p_partkey * {0}) % 9 + 1)::INT]"


@query("d33_costs", "SELECT p_partkey, {0} || {1} || {2} AS cost, ({3} + {4} + {5}) AS value, CASE WHEN contains(cost, 'Q') THEN 'unknown' WHEN contains(cost, '{{W}}') AND false OR contains(cost, '{{C}}') THEN 'false' ELSE 'true' END AS pay, CASE WHEN contains(cost, '{{W}}') THEN 'W' ELSE '' END || CASE WHEN contains(cost, '{{C}}') THEN 'C' ELSE '' END AS needed FROM part".format(_SYM.format(1), _SYM.format(5), _SYM.format(7), _VAL.format(1), _VAL.format(5), _VAL.format(7)).replace("{{", "{").replace("}}", "}"))
def _(s, d):
    have = F.array(F.lit("W"), F.lit("R"))
    c = F.col("cost")
    return _costs(s, d).select("p_partkey", "cost", C.cost_value(c).alias("value"), C.payable(c, have).alias("pay"), F.array_join(C.colours_needed(c), "").alias("needed"))


@query("d34_pips", ("SELECT p_partkey, array_to_string(list_filter(list_transform([{0}, {1}, {2}], lambda x: CASE x WHEN '{{W}}' THEN 1 WHEN '{{U/R}}' THEN 10 WHEN '{{C}}' THEN 32 END), lambda x: x IS NOT NULL), ',') AS masks, (list_sum(list_transform([{0}, {1}, {2}], lambda x: CASE WHEN x IN ('{{2}}', '{{2/G}}') THEN 2 ELSE 0 END)))::INT AS generic FROM part").format(_SYM.format(1), _SYM.format(5), _SYM.format(7)).replace("{{", "{").replace("}}", "}"))
def _(s, d):
    c = F.col("cost")
    return _costs(s, d).select("p_partkey", F.array_join(F.transform(C.pip_masks(c), lambda x: x.cast("string")), ",").alias("masks"), C.generic(c).alias("generic"))


_PIP = "CASE x WHEN '{W}' THEN 1 WHEN '{U/R}' THEN 10 WHEN '{C}' THEN 32 END"
_LIST = f"[{_SYM.format(1)}, {_SYM.format(5)}, {_SYM.format(7)}]".replace("{{", "{").replace("}}", "}")
_PLANS = f"""WITH s AS (SELECT p_partkey, list_filter({_LIST}, lambda x: x <> '') AS s FROM part),
p AS (SELECT p_partkey, s, CASE WHEN len(s) = 0 THEN 'no symbol' WHEN list_contains(s, '{{Q}}') THEN 'unknown symbol' END AS error, list_filter(list_transform(s, lambda x: {_PIP}), lambda m: m IS NOT NULL) AS pips, len(list_filter(s, lambda x: x = '{{2}}')) * 2 AS generic, len(list_filter(s, lambda x: x = '{{2/G}}')) AS n_two,
  list_concat(CASE WHEN list_contains(s, '{{X}}') THEN ['X counts as 0'] ELSE [] END, CASE WHEN list_contains(s, '{{B/P}}') THEN ['{{B/P}} is paid with life'] ELSE [] END) AS notes FROM s),
t AS (SELECT *, list_sort(list_distinct(list_concat(pips, CASE WHEN n_two > 0 THEN [16] ELSE [] END))) AS types, list_transform(range(0, (1 << n_two)::INT), lambda b: n_two - bit_count(b::INT)) AS greens FROM p)
SELECT p_partkey, error, CASE WHEN error IS NULL THEN array_to_string(notes, ';') END AS notes, CASE WHEN error IS NULL THEN array_to_string(types, ',') END AS types,
  CASE WHEN error IS NULL THEN array_to_string(list_transform(greens, lambda g: CASE WHEN len(types) = 0 THEN '0' ELSE array_to_string(list_transform(types, lambda y: len(list_filter(pips, lambda m: m = y)) + CASE WHEN y = 16 THEN g ELSE 0 END), '+') END || '=' || (generic + 2 * (n_two - g) + len(pips) + g)), ' ') END AS ways FROM t"""


@query("d34_plans", _PLANS)
def _(s, d):
    """What every cost asks of sources, and all ways to pay it."""
    plan = C.cost_plan(F.col("cost"))
    p = _costs(s, d).select("p_partkey", plan.alias("plan"))
    w = p.select("p_partkey", "plan", C.ways_to_pay(F.col("plan")).alias("w"))
    ways = F.transform("w.ways", lambda x: F.concat(F.array_join(x["need"].cast("array<string>"), "+"), F.lit("="), x["mana"].cast("string")))
    good = F.col("plan.error").isNull()
    return w.select("p_partkey", F.col("plan.error").alias("error"), F.when(good, F.array_join("plan.notes", ";")).alias("notes"), F.when(good, F.array_join(F.col("w.types").cast("array<string>"), ",")).alias("types"), F.when(good, F.array_join(ways, " ")).alias("ways"))


@query("f_castable_costs", "WITH RECURSIVE t AS (SELECT p_partkey, CASE WHEN error IS NULL THEN 'ok' ELSE error END AS status FROM (" + _PLANS + ")) SELECT p_partkey, status, CASE WHEN status = 'ok' THEN true END AS rising FROM t")
def _(s, d):
    """The chance to pay every cost by each turn with three classes of sources; it never falls from turn to turn."""
    from tallyloom.functions import probability as P

    plan = C.cost_plan(F.col("cost"))
    lands = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(n).alias("count")) for m, n in ((1, 8), (24, 6), (2, 3), (32, 0), (3, 2))])
    p = _costs(s, d).select("p_partkey", plan.alias("plan"))
    p = p.select("p_partkey", "plan.error", C.ways_to_pay(F.col("plan")).alias("w")).withColumn("c", C.source_classes(lands, F.col("w.types")))
    asked = p.where("error IS NULL").select("p_partkey", "w", "c", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("turn"))
    chance = asked.withColumn("p", P.castable(F.lit(60), F.col("c.count"), F.col("c.canpay"), F.col("w.ways.need"), F.col("w.ways.mana"), F.col("turn"), F.lit(True), F.lit(0)))
    by = chance.groupBy("p_partkey").agg(F.array_sort(F.collect_list(F.struct("turn", "p"))).alias("l"), F.count("p").alias("n"))
    rising = by.select("p_partkey", ((F.col("n") == 6) & F.forall(F.sequence(F.lit(1), F.lit(5)), lambda i: F.get("l", i)["p"] >= F.get("l", i - 1)["p"])).alias("rising"))
    return p.join(rising, "p_partkey", "left").select("p_partkey", F.coalesce("error", F.lit("ok")).alias("status"), "rising")


@query("d35_d36_pool", "SELECT CASE WHEN coalesce(type_line LIKE '%Land%', false) THEN 'lands' WHEN cmc IS NULL THEN 'not castable' ELSE 'curve' END AS bucket, CASE WHEN NOT coalesce(type_line LIKE '%Land%', false) AND cmc IS NOT NULL THEN least(cmc::INT, 7) END AS value, count(*) AS n FROM mtg_cards_v2 GROUP BY ALL")
def _(s, d):
    c = load(s, d, "mtg_cards_v2")
    return K.pool_summary(c, K.classify(F.col("layout"), F.col("type_line"), F.col("cmc").cast("string")), F.col("cmc"))


_TYPES = ("Creature", "Instant", "Sorcery", "Artifact", "Enchantment", "Land")


@query("d36_pool_facets", f"""WITH c AS (SELECT *, CASE WHEN layout IS NULL OR layout NOT IN ({", ".join(repr(x) for x in K.LAYOUTS)}) THEN 'unclassified' WHEN coalesce(type_line LIKE '%Land%', false) THEN 'lands' WHEN cmc IS NULL THEN 'not castable' ELSE 'curve' END AS b, list_filter([{", ".join(repr(x) for x in _TYPES)}], lambda t: contains(coalesce(type_line, ''), t)) AS k FROM mtg_cards_v2)
SELECT 'bucket' AS facet, b AS member, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'curve', least(cmc::INT, 7)::VARCHAR, count(*) FROM c WHERE b = 'curve' GROUP BY ALL
UNION ALL SELECT 'colours', CASE WHEN len(coalesce(colors, [])) = 0 THEN 'C' ELSE array_to_string(list_sort(colors), '') END AS m, count(*) FROM c GROUP BY ALL UNION ALL SELECT 'colour', m, count(*) FROM (SELECT unnest(list_distinct(colors)) AS m FROM c) GROUP BY ALL
UNION ALL SELECT 'type', m, count(*) FROM (SELECT unnest(CASE WHEN len(k) = 0 THEN ['other'] ELSE k END) AS m FROM c) GROUP BY ALL""")
def _(s, d):
    c = load(s, d, "mtg_cards_v2")
    return K.pool_facets(c, K.classify(F.col("layout"), F.col("type_line"), F.col("cmc").cast("string")), F.col("cmc"), F.col("colors"), F.col("type_line"), _TYPES)


@query("d37_codes", "SELECT deck_id, CASE WHEN count(*) > 999 OR bool_or(regexp_matches(card_name, '[\\x00-\\x1f\\x7f]')) THEN 'malformed' ELSE 'ok' END AS state, CASE WHEN state = 'ok' THEN string_agg(card_name, ';' ORDER BY card_name) END AS names FROM (SELECT DISTINCT deck_id, replace(card_name, '|', '/') AS card_name FROM deck_cards) WHERE card_name <> '' GROUP BY deck_id")
def _(s, d):
    """Every deck as a code and back; the bar parts the fields, so it is written as a slash."""
    n = load(s, d, "deck_cards").select("deck_id", F.replace(F.col("card_name"), F.lit("|"), F.lit("/")).alias("n")).where("n <> ''")
    g = n.groupBy("deck_id").agg(F.array_sort(F.collect_set("n")).alias("n")).withColumn("scope", F.lit("ABC"))
    back = K.decode_codes(K.encode_codes(g, "SD1", "scope", F.col("n")).select("deck_id", "code"), "code")
    return back.select("deck_id", "state", F.array_join("names", ";").alias("names"))


@query("d37_apply_picks", """WITH l AS (SELECT l_orderkey AS game, l_linenumber::INT AS position, min(l_partkey) AS item FROM lineitem GROUP BY ALL), k AS (SELECT * FROM l WHERE position <= 2),
p AS (SELECT game, position, CASE WHEN item % 5 = 0 THEN -item ELSE item END AS item FROM l WHERE position <> 4), h AS (SELECT game, max(position) AS last FROM k GROUP BY 1), j AS (SELECT p.*, k.item AS old, coalesce(h.last, 0) AS last FROM p LEFT JOIN k USING (game, position) LEFT JOIN h USING (game))
SELECT game, position, item::VARCHAR AS item, CASE WHEN position <= last THEN CASE WHEN old = item THEN 'resent' ELSE 'conflict' END WHEN position - last = (SELECT count(*) FROM p q WHERE q.game = j.game AND q.position > j.last AND q.position <= j.position) THEN 'added' ELSE 'gap' END AS state FROM j""")
def _(s, d):
    """Picks made of all orders: two lines are recorded, the fourth is never sent, every fifth item is another one."""
    lines = load(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("game"), F.col("l_linenumber").cast("int").alias("position")).agg(F.min("l_partkey").alias("item"))
    sent = lines.where("position <> 4").withColumn("item", F.when(F.col("item") % 5 == 0, -F.col("item")).otherwise(F.col("item")).cast("string"))
    return K.apply_picks(lines.where("position <= 2").withColumn("item", F.col("item").cast("string")), sent, "game")


def _mentions(s, d):
    """Mentions of all documents against the names of all cards."""
    cards = load(s, d, "mtg_cards_v2").select("id", "digital", *[c for columns in K.NAME_COLUMNS for c in columns])
    return K.verify_texts(load(s, d, "documents"), "doc_id", "text", cards)


_DICTIONARY = """WITH f AS (SELECT digital, card_name, coalesce(nullif(name_en_front, ''), split_part(card_name, ' // ', 1)) AS ef, coalesce(nullif(name_ja_front, ''), nullif(split_part(coalesce(japanese_name, ''), ' // ', 1), '')) AS jf, * EXCLUDE (digital, card_name) FROM mtg_cards_v2),
forms AS (SELECT *, CASE WHEN jf IS NOT NULL THEN '《' || jf || '/' || ef || '》' ELSE ef END AS front_form, CASE WHEN coalesce(name_ja_back, '') <> '' THEN '《' || name_ja_back || '/' || name_en_back || '》' ELSE name_en_back END AS back_form FROM f),
n AS (SELECT lower(card_name) AS name, front_form AS form, 0 AS part, digital, card_name AS c, 0 AS rank FROM forms UNION ALL SELECT lower(name_en_front), front_form, 1, digital, card_name, 1 FROM forms UNION ALL SELECT lower(name_en_back), back_form, 2, digital, card_name, 2 FROM forms
  UNION ALL SELECT lower(japanese_name), front_form, 3, digital, card_name, 0 FROM forms UNION ALL SELECT lower(name_ja_front), front_form, 3, digital, card_name, 1 FROM forms WHERE coalesce(name_en_front, '') <> '' UNION ALL SELECT lower(name_ja_back), back_form, 3, digital, card_name, 2 FROM forms WHERE coalesce(name_en_back, '') <> ''),
own AS (SELECT name, form, part, digital, c, rank FROM n WHERE coalesce(name, '') <> ''),
both_ AS (SELECT * FROM own UNION ALL SELECT lower(form), form, 4 + part, digital, c, rank FROM own),
dict AS (SELECT name, arg_min(form, (part, digital, c, rank)) AS form FROM both_ GROUP BY 1),
m AS (SELECT doc_id AS key, unnest(regexp_extract_all(text, '《[^《》]*》')) AS written FROM documents),
parts AS (SELECT DISTINCT written, unnest(string_split(substr(written, 2, length(written) - 2), '/')) AS part, generate_subscripts(string_split(substr(written, 2, length(written) - 2), '/'), 1) AS pos FROM m),
by_part AS (SELECT written, arg_min(form, pos) AS form FROM parts JOIN dict ON name = lower(trim(part)) GROUP BY 1),
judged AS (SELECT key, m.written, coalesce(a.form, b.form, p.form) AS canonical FROM m LEFT JOIN dict a ON a.name = lower(m.written) LEFT JOIN dict b ON b.name = lower(substr(m.written, 2, length(m.written) - 2)) LEFT JOIN by_part p ON p.written = m.written),
bracketed AS (SELECT key, written, canonical, CASE WHEN canonical IS NULL THEN 'unknown' WHEN canonical = written THEN 'ok' ELSE 'rewrite' END AS state FROM judged)"""


@query("d38_verify")
def _(s, d):
    return _mentions(s, d)


@query("d38_bracketed", f"{_DICTIONARY} SELECT key, written, canonical, state, count(*) AS n FROM bracketed GROUP BY ALL")
def _(s, d):
    """The mentions in brackets."""
    return _mentions(s, d).where("state <> 'bare'").groupBy("key", "written", "canonical", "state").agg(F.count(F.lit(1)).alias("n"))


@query("d39_release_state", "SELECT id, CASE WHEN created_on IS NULL OR layout IS NULL THEN 'unknown' WHEN created_on > DATE '2024-06-01' THEN 'upcoming' WHEN DATE '2024-06-01' - created_on < 7 THEN 'awaiting' ELSE 'ordinary' END AS state FROM mtg_cards_v2")
def _(s, d):
    return load(s, d, "mtg_cards_v2").select("id", K.release_state(F.col("created_on"), F.lit("2024-06-01").cast("date"), F.col("layout")).alias("state"))


#: Patterns over the texts of the test tables.
RULES = [("harm", r"deal (?P<amount>\d+) harm to (?P<target>[a-z ]+?)[.,]"), ("look", r"put the top (?P<amount>\d+) cards aside"), ("gain", r"gain (?P<amount>\d+) life(?: for every (?P<target>[a-z ]+?))?[.,]"), ("discount", r"(?P<target>the next spell) you pay for costs (?P<amount>\w+) less")]


@query("d40_d42_clauses", r"""WITH t AS (SELECT id, regexp_replace(oracle_text, '\([^()]*\)', '', 'g') AS x FROM mtg_cards_v2)
SELECT id AS key, 'look' AS rule, regexp_extract(m, '(?i)put the top (\d+)', 1)::INT AS amount, NULL AS target, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(x, '(?i)put the top \d+ cards aside')) AS m FROM t) GROUP BY ALL
UNION ALL SELECT id, 'harm', regexp_extract(m, '(?i)deal (\d+)', 1)::INT, regexp_extract(m, '(?i)harm to ([a-z ]+?)[.,]', 1), count(*) FROM (SELECT id, unnest(regexp_extract_all(x, '(?i)deal \d+ harm to [a-z ]+?[.,]')) AS m FROM t) GROUP BY ALL
UNION ALL SELECT id, 'gain', regexp_extract(m, '(?i)gain (\d+)', 1)::INT, nullif(regexp_extract(m, '(?i)for every ([a-z ]+?)[.,]', 1), ''), count(*) FROM (SELECT id, unnest(regexp_extract_all(x, '(?i)gain \d+ life(?: for every [a-z ]+?)?[.,]')) AS m FROM t) GROUP BY ALL
UNION ALL SELECT id, 'discount', try_cast(regexp_extract(m, '(?i)costs (\w+) less', 1) AS INT), regexp_extract(m, '(?i)the next spell'), count(*) FROM (SELECT id, unnest(regexp_extract_all(x, '(?i)the next spell you pay for costs \w+ less')) AS m FROM t) GROUP BY ALL""")
def _(s, d):
    return K.clauses(load(s, d, "mtg_cards_v2"), "id", "oracle_text", RULES).groupBy("key", "rule", "amount", "target").agg(F.count(F.lit(1)).alias("n"))


_FACES = """SELECT id, [{'c': CASE WHEN type_line LIKE '%Land%' THEN '' ELSE '{' || cmc::INT || '}' END, 't': type_line, 'o': oracle_text},
  {'c': CASE WHEN name_en_back IS NOT NULL AND id % 2 = 0 THEN '{1}' END, 't': CASE WHEN id % 3 = 0 THEN 'Land' ELSE type_line END, 'o': name_en_back}] AS faces FROM mtg_cards_v2"""


@query("d45_faces", f"SELECT id, coalesce(array_to_string(list_transform(list_filter(faces, lambda f: coalesce(f.c, '') <> '' AND NOT coalesce(contains(f.t, 'Land'), false)), lambda f: coalesce(f.o, '')), chr(10) || '//' || chr(10)), '') AS text FROM ({_FACES})")
def _(s, d):
    """Faces of all cards: the front with its cost, unless it is a land, and the back, with a cost on every second card."""
    c = load(s, d, "mtg_cards_v2")
    cost = F.when(F.col("type_line").contains("Land"), "").otherwise(F.concat(F.lit("{"), F.col("cmc").cast("int").cast("string"), F.lit("}")))
    back = F.struct(F.when(F.col("name_en_back").isNotNull() & (F.col("id") % 2 == 0), "{1}").alias("mana_cost"), F.when(F.col("id") % 3 == 0, "Land").otherwise(F.col("type_line")).alias("type_line"), F.col("name_en_back").alias("oracle_text"))
    return c.select("id", K.face_filter(F.array(F.struct(cost.alias("mana_cost"), "type_line", "oracle_text"), back)).alias("text"))


@query("d46_keywords", """WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(type_line), '[^a-z]+')) AS word FROM mtg_cards_v2) WHERE word <> ''), k AS (SELECT list(word) AS words FROM w)
SELECT id, array_to_string(list_sort(list_intersect(list_distinct(regexp_split_to_array(lower(split_part(coalesce(oracle_text, ''), ' // ', 1)), '[^a-z]+')), words)), ',') AS words FROM mtg_cards_v2, k""")
def _(s, d):
    """Which of a vocabulary's words stand in the text of each card's front; the vocabulary is that of all type lines."""
    c = load(s, d, "mtg_cards_v2")
    vocabulary = c.select(F.explode(F.split(F.lower("type_line"), "[^a-z]+")).alias("word")).where("word <> ''").distinct()
    return K.front_keywords(c, "id", F.coalesce("oracle_text", F.lit("")), vocabulary, "word").select("id", F.array_join("words", ",").alias("words"))


@query("d47_printings", "WITH r AS (SELECT card_name, expansion AS c, computed_at AS t, coalesce(db_card_name, '') AS l, event_type <> 'PremierDraft' AS g FROM limited_card_stats) SELECT card_name, string_agg(DISTINCT c, ',' ORDER BY c) FILTER (NOT g OR card_name NOT IN (SELECT card_name FROM r WHERE NOT g)) AS sets, arg_max(l, (t, l)) AS local FROM r GROUP BY 1")
def _(s, d):
    r = load(s, d, "limited_card_stats").select("card_name", "expansion", "computed_at", F.coalesce("db_card_name", F.lit("")).alias("l"), (F.col("event_type") != "PremierDraft").alias("g"))
    got = K.printings(r, "card_name", "expansion", "computed_at", "l", "g")
    return got.select("card_name", F.array_join("sets", ",").alias("sets"), "local")


@query("d48_canonical", "SELECT name_en_front, id FROM (SELECT split_part(name_en_front, ' ', 1) AS name_en_front, id, row_number() OVER (PARTITION BY split_part(name_en_front, ' ', 1) ORDER BY coalesce(edhrec_rank, 0) DESC, id) AS n FROM mtg_cards_v2 WHERE NOT digital) WHERE n = 1")
def _(s, d):
    c = load(s, d, "mtg_cards_v2").select(F.split_part("name_en_front", F.lit(" "), F.lit(1)).alias("name_en_front"), "id", "digital", "edhrec_rank")
    return K.canonical_rows(c, "name_en_front", ~F.col("digital"), F.coalesce("edhrec_rank", F.lit(0)), "id").select("name_en_front", "id")


@query("d49_localised", "SELECT layout, arg_max(japanese_name, (created_on, japanese_name)) AS name FROM mtg_cards_v2 WHERE regexp_matches(japanese_name, '[ぁ-んァ-ン一-龯]') GROUP BY 1")
def _(s, d):
    return K.localised(load(s, d, "mtg_cards_v2"), "layout", "japanese_name", "created_on").select("layout", "name")


@query("d52_preferred", "SELECT id, coalesce(japanese_name, card_name) AS shown FROM mtg_cards_v2")
def _(s, d):
    return load(s, d, "mtg_cards_v2").select("id", K.prefer(F.col("japanese_name"), F.col("card_name")).alias("shown"))


_LIMITED = """WITH RECURSIVE e AS (SELECT {key} AS key, epoch_us(ts) AS us, event_id, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT key, us, event_id, rn, true AS admitted, [us] AS held FROM e WHERE rn = 1
  UNION ALL SELECT e.key, e.us, e.event_id, e.rn, len(list_filter(r.held, lambda h: e.us - h < {us})) < {most},
    CASE WHEN len(list_filter(r.held, lambda h: e.us - h < {us})) < {most} THEN list_append(list_filter(r.held, lambda h: e.us - h < {us}), e.us) ELSE list_filter(r.held, lambda h: e.us - h < {us}) END
  FROM r JOIN e ON e.key = r.key AND e.rn = r.rn + 1)
SELECT key, event_id, admitted, CASE WHEN NOT admitted THEN round((list_min(held) + {us} - us) / 1e6, 3) END AS wait_seconds FROM r"""


@query("d54_rate_limit", _LIMITED.format(key="user_id::VARCHAR", us=6 * 3600 * 1_000_000, most=3))
def _(s, d):
    return J.rate_limit_batch(load(s, d, "events"), "user_id", "ts", 3, 6 * 3600, order="event_id").select("key", "event_id", "admitted", F.round("wait_seconds", 3).alias("wait_seconds"))


@query("d54_rate_limit_total")
def _(s, d):
    """Both limits together: three calls of a key and fifty of all keys in six hours."""
    return J.rate_limit_total(load(s, d, "events"), "user_id", "ts", 3, 50, 6 * 3600, order="event_id").select("key", "event_id", "admitted", "refused_by")


@query("d55_outcomes", "SELECT event_id, CASE event_type WHEN 'error' THEN 'failure' ELSE CASE WHEN value > 90 THEN 'slow' ELSE 'fine' END END AS outcome FROM events")
def _(s, d):
    return load(s, d, "events").select("event_id", K.outcome(F.col("event_type"), F.col("value"), 90.0).alias("outcome"))


@query("d38_candidates", "WITH u AS (SELECT DISTINCT regexp_replace(card_name, '[《》]', '', 'g') AS asked FROM limited_card_stats WHERE db_card_name IS NULL), n AS (SELECT DISTINCT lower(x) AS name FROM (SELECT unnest([card_name, name_en_front, name_en_back, japanese_name, name_ja_front, name_ja_back]) AS x FROM mtg_cards_v2) WHERE x <> ''), "
       "b AS (SELECT asked FROM u WHERE lower(asked) NOT IN (SELECT name FROM n) AND NOT EXISTS (SELECT 1 FROM n WHERE name IN (SELECT lower(trim(part, ' ')) FROM (SELECT unnest(string_split(asked, '/')) AS part)))), "
       "q AS (SELECT asked, len(t) AS qn, unnest(t) AS g FROM (SELECT asked, {0} AS t FROM b)), c AS (SELECT id, card_name, len(t) AS cn, unnest(t) AS g FROM (SELECT id, card_name, {1} AS t FROM mtg_cards_v2)), "
       "s AS (SELECT asked, id, card_name, round(count(*)::DOUBLE / (any_value(qn) + any_value(cn) - count(*)), 6) AS similarity FROM q JOIN c USING (g) GROUP BY ALL) "
       "SELECT * FROM (SELECT asked, id, card_name, similarity, row_number() OVER (PARTITION BY asked ORDER BY similarity DESC, id, card_name) AS place FROM s WHERE similarity > 0.35) WHERE place <= 3".format(PN._TRI.format("asked"), PN._TRI.format("card_name")))
def _(s, d):
    """Candidates for bracketed names that no card has: names typed elsewhere, as texts of one mention each."""
    cards = load(s, d, "mtg_cards_v2")
    typed = load(s, d, "limited_card_stats").where("db_card_name IS NULL").select("card_name").distinct()
    texts = typed.select(F.xxhash64("card_name").alias("k"), F.concat(F.lit("《"), F.regexp_replace("card_name", "[《》]", ""), F.lit("》")).alias("t"))
    found = K.verify_texts(texts, "k", "t", cards.select("id", "digital", *[c for columns in K.NAME_COLUMNS for c in columns]))
    return K.mention_candidates(found, cards)


@query("d38_rewritten", "SELECT doc_id AS key, true AS settled FROM documents WHERE text IS NOT NULL")
def _(s, d):
    """The corrected texts, checked again: nothing is left to rewrite in them, and what was canonical still is."""
    cards = load(s, d, "mtg_cards_v2").select("id", "digital", *[c for columns in K.NAME_COLUMNS for c in columns])
    docs = load(s, d, "documents").where("text IS NOT NULL")
    once = K.verify_texts(docs, "doc_id", "text", cards)
    again = K.verify_texts(K.rewritten(docs, "doc_id", "text", once), "key", "text", cards)
    left = again.groupBy("key").agg(F.count_if(F.col("state") == "rewrite").alias("left"))
    return docs.select(F.col("doc_id").alias("key")).join(left, "key", "left").select("key", (F.coalesce("left", F.lit(0)) == 0).alias("settled"))


@query("d56_fidelity", f"{_DICTIONARY} SELECT key, count(*) AS n, round(count(*) FILTER (state = 'ok')::DOUBLE / count(*), 4) AS faithful FROM bracketed GROUP BY key")
def _(s, d):
    return K.fidelity(_mentions(s, d).where("state IN ('ok', 'rewrite', 'unknown')"))


@query("d57_strata", "SELECT lang, doc_id, place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('3:' || doc_id), doc_id) AS place FROM documents WHERE lang IS NOT NULL) WHERE place <= 5")
def _(s, d):
    from tallyloom.operators.relational import first_n_per_bucket

    docs = load(s, d, "documents").where("lang IS NOT NULL").select("lang", "doc_id")
    order = F.md5(F.concat_ws(":", F.lit("3"), F.col("doc_id")))
    return first_n_per_bucket(docs, F.col("lang"), order, "doc_id", 5).select("lang", "doc_id", "place")


@query("d58_calendar", "SELECT id FROM deck_list WHERE tournament_date BETWEEN DATE '2026-01-01' - 21 AND DATE '2026-01-01' + 45")
def _(s, d):
    return K.calendar_window(load(s, d, "deck_list"), "tournament_date", F.lit("2026-01-01").cast("date"), 21, 45).select("id")


@query("d61_combos", "WITH c AS (SELECT population_id AS id, list_filter(sources, lambda x: x NOT IN ('mtgo', 'mtgtop8')) AS m, deck_count AS p FROM cooccurrence_populations), x AS (SELECT id, p, array_to_string(m, ',') AS missing, CASE len(m) WHEN 0 THEN 'complete' WHEN 1 THEN 'one short' END AS section FROM c) SELECT id AS combo_id, missing, section, place, total FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY p DESC NULLS LAST, id) AS place, count(*) OVER (PARTITION BY section) AS total FROM x WHERE section IS NOT NULL) WHERE place <= 10")
def _(s, d):
    p = load(s, d, "cooccurrence_populations").select(F.col("population_id").alias("combo_id"), F.col("sources").alias("pieces"), F.array().cast("array<string>").alias("identity"), F.col("deck_count").alias("popularity"))
    return K.combo_sections(p, ["mtgo", "mtgtop8"], ["W"]).select("combo_id", F.array_join("missing", ",").alias("missing"), "section", "place", "total")


@query("d62_derived_links", "SELECT b.id AS derived, a.id AS original FROM mtg_cards_v2 b JOIN mtg_cards_v2 a ON b.card_name = 'A-' || a.card_name")
def _(s, d):
    c = load(s, d, "mtg_cards_v2")
    return c.select(F.col("id").alias("derived"), "card_name").join(c.select(F.col("id").alias("original"), F.concat(F.lit("A-"), "card_name").alias("card_name")), "card_name").select("derived", "original")


# Readers over texts made of the tables


@query("s08_deck_text", "SELECT deck_id AS key, CASE WHEN b = 'side' THEN 'side' ELSE 'main' END AS board, \"count\" AS n, card_name FROM (SELECT deck_id, lower(regexp_replace(board, '[^\\p{L}\\p{N}]+', '', 'g')) AS b, \"count\", trim(replace(replace(card_name, chr(10), ''), chr(13), ''), ' ') AS card_name FROM deck_cards) WHERE card_name <> '' AND \"count\" IS NOT NULL")
def _(s, d):
    """Every deck written as text and read back, names as they are."""
    name = F.trim(F.regexp_replace("card_name", r"[\r\n]", ""))
    l = load(s, d, "deck_cards").select("deck_id", squash("board").alias("b"), "count", name.alias("n")).where("n <> ''")
    line = F.concat(F.when(F.col("b") == "side", "SB: ").otherwise(""), F.col("count").cast("string"), F.lit(" [SET] "), F.col("n"))
    text = l.groupBy("deck_id").agg(F.concat_ws("\n", F.lit("// NAME"), F.collect_list(line)).alias("text"))
    return R.deck_text(text, "deck_id", "text").select("key", "board", "n", "card_name")


@query("s07_rulebook", "SELECT id AS key, '12.' || (id % 9) || 'a' AS number, trim(comment) || ' and so on' AS body FROM card_rulings WHERE trim(comment) <> ''")
def _(s, d):
    r = load(s, d, "card_rulings").where(F.trim("comment") != "")
    text = F.concat(F.lit("Preface\n\n12."), (F.col("id") % 9).cast("string"), F.lit("a "), F.col("comment"), F.lit("\nand so on\n"))
    return R.rulebook(r.select("id", text.alias("t")), "id", "t")


@query("s09_links", "SELECT id, '/c/' || id AS href, card_name AS text FROM mtg_cards_v2")
def _(s, d):
    c = load(s, d, "mtg_cards_v2")
    page = F.concat(F.lit('<p><a class="x" href="/c/'), F.col("id").cast("string"), F.lit('"><b>'), F.col("card_name"), F.lit("</b></a></p>"))
    return c.select("id", F.explode(R.html_links(page)).alias("l")).select("id", "l.*")


@query("s10_embedded_json", "SELECT id, id AS n, [card_name] AS names FROM mtg_cards_v2")
def _(s, d):
    c = load(s, d, "mtg_cards_v2")
    page = F.concat(F.lit("<script>window.DATA.lists = "), F.to_json(F.struct(F.col("id").alias("n"), F.array("card_name").alias("names"))), F.lit(";</script>"))
    return c.select("id", R.embedded_json(page, "window.DATA.lists", "n int, names array<string>").alias("j")).select("id", "j.*")


@query("s18_event_log", "SELECT user_id::VARCHAR AS key, arg_max(event_type, (ts, event_type)) = 'purchase' AS alive FROM (SELECT user_id, date_trunc('second', ts) AS ts, event_type FROM events) WHERE event_type IN ('purchase', 'click') GROUP BY 1")
def _(s, d):
    e = load(s, d, "events")
    line = F.concat_ws("\t", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("event_type") == "purchase", "issue").when(F.col("event_type") == "click", "stop").otherwise("junk"), F.col("user_id").cast("string"), F.lit("-"), F.lit("60"), F.lit("memo"))
    # Ties in time go to the larger event name, "stop" before "issue" here as "purchase" before "click" there.
    log = R.event_log(e.select(line.alias("value")).unionByName(e.select(F.lit("broken\tline").alias("value"))), events=("issue", "stop"))
    last = log.groupBy("key").agg(F.max(F.struct("ts", (F.col("event") == "issue").alias("alive"))).alias("l"))
    return last.select("key", F.col("l.alive").alias("alive"))


@query("s14_catalog", "SELECT 'nation' AS table_name, count(*) AS n_rows, 'n_name' AS column_name FROM nation UNION ALL SELECT 'nation', count(*), 'n_nationkey' FROM nation UNION ALL SELECT 'nation', count(*), 'n_regionkey' FROM nation UNION ALL SELECT 'region', count(*), 'r_regionkey' FROM region UNION ALL SELECT 'region', count(*), 'r_name' FROM region")
def _(s, d):
    return R.catalog(s, {"nation": load(s, d, "nation"), "region": load(s, d, "region")}).select("table_name", "n_rows", "column_name")


# Guarded SQL


@query("p16_guarded_sql", "SELECT n_name, n_regionkey FROM nation ORDER BY n_name LIMIT 10")
def _(s, d):
    load(s, d, "nation").createOrReplaceTempView("nation")
    return Q.run_sql(s, "-- #DEMO\nSELECT n_name, n_regionkey FROM nation ORDER BY n_name;", 10)


_TOP = "(SELECT format_name AS f, arg_max(card_id, (n, -card_id)) AS anchor FROM (SELECT format_name, card_id, count(DISTINCT deck_id) AS n FROM deck_cards JOIN deck_list d ON d.id = deck_id WHERE card_id IS NOT NULL AND lower(regexp_replace(board, '[^\\p{L}\\p{N}]+', '', 'g')) = 'main' GROUP BY ALL) WHERE format_name IS NOT NULL GROUP BY 1)"
_PARTNERS = rf"""WITH top AS {_TOP}, a AS (SELECT f, c.id, c.card_name, coalesce(c.colors, []) AS colors FROM top JOIN mtg_cards_v2 c ON c.id = anchor),
l AS (SELECT DISTINCT a.f, deck_id AS basket, lower(regexp_replace(board, '[^\p{{L}}\p{{N}}]+', '', 'g')) AS board, card_id AS item FROM deck_cards JOIN deck_list d ON d.id = deck_id JOIN a ON a.f = d.format_name WHERE card_id IS NOT NULL AND tournament_date >= DATE '2026-07-01' - 400),
firsts AS (SELECT f, min(basket) AS basket FROM (SELECT f, basket, md5(string_agg(board || ':' || item, ',' ORDER BY board, item)) AS s FROM l GROUP BY ALL) GROUP BY f, s), it AS (SELECT l.* FROM l JOIN firsts USING (f, basket)),
have AS (SELECT f, basket, list(DISTINCT c) AS have FROM (SELECT f, basket, unnest(colors) AS c FROM it JOIN mtg_cards_v2 m ON m.id = item WHERE board = 'main') GROUP BY ALL),
j AS (SELECT f, firsts.basket, list_has_all(coalesce(have, []), a.colors) AS same, EXISTS (SELECT 1 FROM it WHERE it.f = f AND it.basket = firsts.basket AND it.item = a.id AND it.board = 'main') AS has FROM firsts JOIN a USING (f) LEFT JOIN have USING (f, basket)),
t AS (SELECT f, count(*) FILTER (has) AS na, count(*) FILTER (same) AS nc FROM j GROUP BY 1), k AS (SELECT f, item, count(*) FILTER (has) AS n_with, count(*) FILTER (same) AS n_partner FROM it JOIN j USING (f, basket) WHERE board = 'side' GROUP BY ALL)
SELECT k.f AS format_name, CASE WHEN japanese_name IS NULL THEN m.card_name ELSE '《' || japanese_name || '/' || m.card_name || '》' END AS partner, n_with, round(100.0::DOUBLE * n_with / nullif(na, 0), 1) AS pct_with, n_partner, round(100.0::DOUBLE * n_with / nullif(n_partner, 0), 1) AS pct_back, round(100.0::DOUBLE * n_partner / nullif(nc, 0), 1) AS pct_base,
  round((n_with::DOUBLE / nullif(na, 0)) / nullif(n_partner::DOUBLE / nullif(nc, 0), 0), 2) AS ratio, na AS n_anchor_lists, nc AS n_color_lists, array_to_string(list_filter(['W', 'U', 'B', 'R', 'G'], lambda c: list_contains(a.colors, c)), '') AS color_group
FROM k JOIN t ON t.f = k.f JOIN a ON a.f = k.f JOIN mtg_cards_v2 m ON m.id = item WHERE item <> a.id AND n_with >= 2 AND NOT contains(coalesce(type_line, ''), 'Basic Land')"""


@query("u_card_partners", _PARTNERS)
def _(s, d):
    """The table function in SQL text, for the most played card of every format, over side boards."""
    from tallyloom.plans import baskets as PB

    decks, cards, lists = load(s, d, "deck_cards").where(squash("board") == "main"), load(s, d, "mtg_cards_v2"), load(s, d, "deck_list")
    counted = decks.join(lists.select(F.col("id").alias("deck_id"), "format_name"), "deck_id").where("card_id IS NOT NULL AND format_name IS NOT NULL").groupBy("format_name", "card_id").agg(F.countDistinct("deck_id").alias("n"))
    top = counted.groupBy("format_name").agg(F.max(F.struct("n", -F.col("card_id"))).alias("b")).select("format_name", (-F.col("b.col2")).alias("id")).join(cards.select("id", "card_name"), "id")
    # One call for each format, of which there are few: they are arguments of the statement.
    calls = [f"SELECT '{r['format_name']}' AS format_name, * FROM mtg_card_partners('{r['format_name']}', '{r['card_name'].replace(chr(39), chr(39) * 2)}', 400, 'side', 2)" for r in top.orderBy("format_name").collect()]
    if not calls:
        calls = ["SELECT '' AS format_name, * FROM mtg_card_partners('none', 'none')"]
    return s.sql(Q.with_partners(s, " UNION ALL ".join(calls), PB.baskets(s, d), PB.lines(s, d), cards, F.lit("2026-07-01").cast("date")))


@query("p18_decorated", "SELECT c.card_name, c.id, CASE WHEN japanese_name IS NULL THEN card_name ELSE japanese_name || '/' || card_name END AS card_name_display FROM mtg_cards_v2 c")
def _(s, d):
    c = load(s, d, "mtg_cards_v2")
    names = c.select("card_name", F.concat_ws("/", "japanese_name", "card_name").alias("display"))
    return Q.decorate(c.select("card_name", "id"), names, "card_name", "display")


# Streams over the events as they stand


def _events(s, d):
    path = f"{d}/events.parquet"
    schema = s.read.parquet(path).schema
    # A single file can't be a stream's source folder; a pattern can.
    return J.read_stream(s, f"{d}/events.parque[t]", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(s, d, build, mode="append"):
    name = "tl_" + uuid.uuid4().hex
    return J.run_once(build(_events(s, d)), name, mode, f"{checkpoint_dir(s)}/{name}")


@query("st_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def _(s, d):
    return _stream(s, d, lambda e: J.first_seen(e.select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", None)).select("user_id", "event_type")


@query("st_tumbling", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(s, d):
    got = _stream(s, d, lambda e: J.tumbling_totals(e, ["event_type"], "ts", "value"), "complete")
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("st_sliding", "SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM (SELECT user_id, unnest([to_timestamp(epoch(ts)::BIGINT // 10 * 10 - 10 * k)::TIMESTAMPTZ AT TIME ZONE 'UTC' FOR k IN range(6)]) AS w FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events)) GROUP BY ALL")
def _(s, d):
    got = J.sliding_totals(_events(s, d), "user_id", "ts", f"{checkpoint_dir(s)}/tl_{uuid.uuid4().hex}")
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "n")


@query("st_paired", "SELECT a.event_id AS opened, b.event_id AS closed FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR")
def _(s, d):
    """Entry and end rows of two streams within an hour of each other; nothing is late in finished input."""
    kinds = lambda e, kind, name: e.where(F.col("event_type") == kind).select("user_id", "ts", F.col("event_id").alias(name))
    return _stream(s, d, lambda e: J.paired_calls(kinds(e, "view", "opened"), kinds(e, "click", "closed"), "ts", "user_id", "1 hour", late="100 days")).select("opened", "closed")


@query("st_changes", "SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def _(s, d):
    """Batches of events upserted by type into a table that is replaced as a whole; a replayed batch leaves the same table."""
    folder = f"{checkpoint_dir(s)}/tl_{uuid.uuid4().hex}"
    version = {"n": 0}
    fields = "event_type string, n bigint, last bigint"

    def old():
        return s.read.schema(fields).parquet(f"{folder}/v{version['n']}") if version["n"] else s.createDataFrame([], fields)

    def write(df):
        df.write.mode("overwrite").parquet(f"{folder}/v{version['n'] + 1}")
        version["n"] += 1

    e = J.read_stream(s, f"{d}/events.parque[t]", s.read.parquet(f"{d}/events.parquet").schema)
    totals = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
    q = totals.writeStream.outputMode("update").foreachBatch(J.apply_changes(old, write, ["event_type"], ["n", "last"])).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start()
    q.awaitTermination()
    return old().select("event_type", "n", "last")
