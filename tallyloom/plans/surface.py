"""The general query surface: predicates, joins, aggregates, windows, sorts, set operations and functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.common import load
from tallyloom.operators import relational as R

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


# Predicates and conditional expressions


@query("p01_ranges", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderkey NOT BETWEEN 100 AND 200 AND o_orderstatus = 'F'")
def _(s, d):
    o = load(s, d, "orders")
    return o.where(F.col("o_totalprice").between(1000, 50000) & ~F.col("o_orderkey").between(100, 200) & (F.col("o_orderstatus") == "F")).select("o_orderkey")


@query("p02_ilike", "SELECT id FROM mtg_cards_v2 WHERE card_name ILIKE '%BORN%' OR oracle_text ILIKE '%rival%'")
def _(s, d):
    c = load(s, d, "mtg_cards_v2")
    return c.where(F.col("card_name").ilike("%BORN%") | F.col("oracle_text").ilike("%rival%")).select("id")


@query("p03_equal_ignoring_case", "SELECT p_partkey FROM part WHERE lower(p_brand) = lower('bRAND#12')")
def _(s, d):
    return load(s, d, "part").where(F.lower("p_brand") == "brand#12").select("p_partkey")


@query("p04_regex", "SELECT id, regexp_matches(type_line, 'Land') AS land FROM mtg_cards_v2 WHERE regexp_matches(card_name, '^[A-M]') AND NOT regexp_matches(card_name, '//')")
def _(s, d):
    c = load(s, d, "mtg_cards_v2")
    return c.where(F.col("card_name").rlike("^[A-M]") & ~F.col("card_name").rlike("//")).select("id", F.col("type_line").rlike("Land").alias("land"))


@query("p05_prefix", "SELECT id FROM deck_list WHERE source LIKE 'mtgo%'")
def _(s, d):
    return load(s, d, "deck_list").where(F.col("source").like("mtgo%")).select("id")


@query("p06_is_distinct_from", "SELECT id FROM card_rulings WHERE published_at IS DISTINCT FROM source_version")
def _(s, d):
    return load(s, d, "card_rulings").where(~F.col("published_at").eqNullSafe(F.col("source_version"))).select("id")


@query("p07_conditionals", "SELECT id, coalesce(archetype, 'none') AS a, nullif(placement, 1) AS b, CASE WHEN bracket IS NULL THEN 'x' WHEN bracket > 2 THEN 'high' ELSE 'low' END AS c, least(placement, bracket) AS lo, greatest(placement, bracket) AS hi FROM deck_list")
def _(s, d):
    c = F.col
    return load(s, d, "deck_list").select("id", F.coalesce("archetype", F.lit("none")).alias("a"), F.nullif(c("placement"), F.lit(1)).alias("b"), F.when(c("bracket").isNull(), "x").when(c("bracket") > 2, "high").otherwise("low").alias("c"), F.least("placement", "bracket").alias("lo"), F.greatest("placement", "bracket").alias("hi"))


@query("p08_json_fields", "SELECT population_id, definition->>'side' AS side, definition->>'basics' AS basics, coalesce(json_exists(definition, 'side'), false) AS has_side FROM cooccurrence_populations")
def _(s, d):
    p = load(s, d, "cooccurrence_populations")
    keys = F.json_object_keys("definition")
    return p.select("population_id", F.get_json_object("definition", "$.side").alias("side"), F.get_json_object("definition", "$.basics").alias("basics"), F.coalesce(F.array_contains(keys, "side"), F.lit(False)).alias("has_side"))


@query("p09_arrays", "SELECT id FROM mtg_cards_v2 WHERE list_has_all(colors, ['W', 'U']) AND NOT list_contains(colors, 'G')")
def _(s, d):
    c = load(s, d, "mtg_cards_v2")
    return c.where((F.size(F.array_except(F.array(F.lit("W"), F.lit("U")), "colors")) == 0) & ~F.array_contains("colors", "G")).select("id")


@query("p10_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 400000)")
def _(s, d):
    c, o = load(s, d, "customer"), load(s, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return c.join(o.where("o_orderstatus = 'P'"), "c_custkey", "left_semi").join(o.where("o_totalprice > 400000"), "c_custkey", "left_anti").select("c_custkey")


@query("p11_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AND p_brand IN (SELECT p_brand FROM part WHERE p_size = 1)")
def _(s, d):
    p, l = load(s, d, "part"), load(s, d, "lineitem")
    used = l.where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return p.join(used, "p_partkey", "left_anti").join(p.where("p_size = 1").select("p_brand"), "p_brand", "left_semi").select("p_partkey")


@query("p12_scalar_subquery", "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def _(s, d):
    o, l = load(s, d, "orders"), load(s, d, "lineitem")
    n = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    mean = o.agg(F.avg("o_totalprice").alias("m")).select("m").scalar()
    return o.where(F.col("o_totalprice") > mean).join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("p13_exact_first", "SELECT card_name FROM mtg_cards_v2 WHERE card_name ILIKE '%kestrel%' ORDER BY (lower(card_name) = 'kestrel of lixpenhi') DESC, length(card_name), card_name LIMIT 10")
def _(s, d):
    c = load(s, d, "mtg_cards_v2").where(F.col("card_name").ilike("%kestrel%"))
    return c.orderBy((F.lower("card_name") == "kestrel of lixpenhi").desc(), F.length("card_name"), "card_name").limit(10).select("card_name")


@query("p14_bits", "SELECT l_orderkey, l_linenumber, l_orderkey & 7 AS low, 1 << (l_linenumber % 5) AS mask, l_orderkey >> 3 AS high FROM lineitem")
def _(s, d):
    l = load(s, d, "lineitem")
    return l.select("l_orderkey", "l_linenumber", F.col("l_orderkey").bitwiseAND(F.lit(7)).alias("low"), F.expr("shiftleft(1, l_linenumber % 5)").alias("mask"), F.shiftright("l_orderkey", 3).alias("high"))


# Joins


@query("j01_inner", "SELECT n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def _(s, d):
    c, n, r = load(s, d, "customer"), load(s, d, "nation"), load(s, d, "region")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"))


@query("j02_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(s, d):
    o = load(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return load(s, d, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("j03_full_outer", "SELECT coalesce(a.k, b.k) AS card_id, a.n AS n_decks, b.n AS n_rulings FROM (SELECT card_id AS k, count(*) AS n FROM deck_cards WHERE card_id IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT card_id AS k, count(*) AS n FROM card_rulings WHERE card_id IS NOT NULL GROUP BY 1) b ON a.k = b.k")
def _(s, d):
    a = load(s, d, "deck_cards").where("card_id IS NOT NULL").groupBy("card_id").agg(F.count(F.lit(1)).alias("n_decks"))
    b = load(s, d, "card_rulings").where("card_id IS NOT NULL").groupBy("card_id").agg(F.count(F.lit(1)).alias("n_rulings"))
    return a.join(b, "card_id", "outer")


@query("j05_inequality_pairs", "SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL HAVING count(*) >= 2")
def _(s, d):
    i = load(s, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    a, b = i.alias("a"), i.alias("b")
    return a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_partkey") < F.col("b.l_partkey"))).groupBy(F.col("a.l_partkey").alias("a"), F.col("b.l_partkey").alias("b")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("j06_directed_pairs", "SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'N') a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'A') b ON a.l_orderkey = b.l_orderkey GROUP BY ALL HAVING count(*) >= 2")
def _(s, d):
    l = load(s, d, "lineitem")
    a, b = (l.where(F.col("l_returnflag") == f).select("l_orderkey", F.col("l_partkey").alias(n)).distinct() for f, n in (("N", "a"), ("A", "b")))
    return a.join(b, "l_orderkey").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("j07_range", "SELECT w, count(*) AS n, sum(o_totalprice) AS total FROM orders JOIN (VALUES ('early', NULL, DATE '1997-01-01'), ('mid', DATE '1996-01-01', DATE '1999-01-01'), ('late', DATE '1998-06-01', NULL)) v(w, a, b) ON (a IS NULL OR o_orderdate >= a) AND (b IS NULL OR o_orderdate < b) GROUP BY w")
def _(s, d):
    w = s.createDataFrame([("early", None, "1997-01-01"), ("mid", "1996-01-01", "1999-01-01"), ("late", "1998-06-01", None)], "w string, a string, b string").select("w", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    o = load(s, d, "orders")
    on = (F.col("a").isNull() | (F.col("o_orderdate") >= F.col("a"))) & (F.col("b").isNull() | (F.col("o_orderdate") < F.col("b")))
    return o.join(F.broadcast(w), on).groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))  # three windows


@query("j08_cross", "SELECT r_name, x FROM region, (VALUES (1), (2), (3)) v(x)")
def _(s, d):
    return load(s, d, "region").crossJoin(F.broadcast(s.range(1, 4).select(F.col("id").cast("int").alias("x")))).select("r_name", "x")  # three rows


@query("j09_lateral_top_k", "SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey) WHERE n <= 2")
def _(s, d):
    load(s, d, "customer").createOrReplaceTempView("tl_customer")
    load(s, d, "orders").createOrReplaceTempView("tl_orders")
    return s.sql("SELECT c_custkey, t.o_orderkey, t.o_totalprice FROM tl_customer, LATERAL (SELECT o_orderkey, o_totalprice FROM tl_orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")


@query("j10_stripped_self_join", "SELECT b.id AS derived, a.id AS original FROM mtg_cards_v2 b JOIN mtg_cards_v2 a ON a.name_en_front = substr(b.name_en_front, 3) AND b.name_en_front LIKE 'A-%' AND (a.name_en_back IS NULL AND b.name_en_back IS NULL OR a.name_en_back = substr(b.name_en_back, 3))")
def _(s, d):
    c = load(s, d, "mtg_cards_v2")
    b = c.where(F.col("name_en_front").startswith("A-")).select(F.col("id").alias("derived"), F.substring("name_en_front", 3, 1000).alias("front"), F.substring("name_en_back", 3, 1000).alias("back"))
    a = c.select(F.col("id").alias("original"), F.col("name_en_front").alias("front"), F.col("name_en_back").alias("b2"))
    return b.join(a, "front").where((F.col("back").isNull() & F.col("b2").isNull()) | (F.col("back") == F.col("b2"))).select("derived", "original")


@query("j11_lookups", "SELECT DISTINCT ON (r.id) r.id, coalesce(c.id, o.id) AS card FROM card_rulings r LEFT JOIN mtg_cards_v2 c ON c.card_name = r.card_name LEFT JOIN mtg_cards_v2 o ON o.oracle_id = lower(r.oracle_id)")
def _(s, d):
    r, c = load(s, d, "card_rulings"), load(s, d, "mtg_cards_v2")
    by_name, by_key = c.select("card_name", F.col("id").alias("a")), c.select(F.col("oracle_id").alias("k"), F.col("id").alias("b"))
    return r.join(by_name, "card_name", "left").join(by_key, F.lower("oracle_id") == F.col("k"), "left").select("id", F.coalesce("a", "b").alias("card"))


@query("j13_exclude_keys", "SELECT id FROM deck_list a WHERE NOT EXISTS (SELECT 1 FROM deck_list b WHERE b.source = a.source AND b.tournament_name = a.tournament_name AND b.placement = 1)")
def _(s, d):
    a = load(s, d, "deck_list")
    return a.join(a.where("placement = 1").select("source", "tournament_name"), ["source", "tournament_name"], "left_anti").select("id")


@query("j14_pattern", r"SELECT v AS card_name, min(m) AS matched FROM (SELECT DISTINCT l.card_name AS v, c.card_name AS m FROM limited_card_stats l JOIN mtg_cards_v2 c ON l.card_name LIKE '%?%' AND regexp_full_match(c.card_name, replace(regexp_replace(l.card_name, '([.()*+\[\]])', '\\\1', 'g'), '?', '[^\x00-\x7F]'))) GROUP BY v HAVING count(*) = 1")
def _(s, d):
    return R.unique_pattern_match(load(s, d, "limited_card_stats"), "card_name", load(s, d, "mtg_cards_v2").select(F.col("card_name").alias("name")), "name")


@query("j_asof", "SELECT e.event_id, o.event_id AS before FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1, 2) o ON e.user_id = o.user_id AND e.ts >= o.ts")
def _(s, d):
    e = load(s, d, "events")
    # One pass over the union: the last click before each purchase, no range join.
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "click", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    both = e.where("event_type IN ('purchase', 'click')").withColumn("before", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w))
    return both.where("event_type = 'purchase'").select("event_id", "before")


# Aggregates


@query("a01_basic", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, min(l_shipdate) AS first, max(l_shipdate) AS last, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY ALL")
def _(s, d):
    l = load(s, d, "lineitem")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@query("a02_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def _(s, d):
    return load(s, d, "orders").groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("n"))


@query("a03_distinct_filter", "SELECT l_partkey, count(DISTINCT l_orderkey) FILTER (WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) AS n_f, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1")
def _(s, d):
    flag = load(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("f"))
    l = load(s, d, "lineitem").select("l_partkey", "l_orderkey").distinct().join(flag, "l_orderkey", "left")
    return l.groupBy("l_partkey").agg(F.count("f").alias("n_f"), F.count(F.lit(1)).alias("n"))


@query("a04_filter", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, sum(value) FILTER (WHERE user_id % 2 = 0) AS even FROM events GROUP BY 1")
def _(s, d):
    return load(s, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("high"), F.sum(F.when(F.col("user_id") % 2 == 0, F.col("value"))).alias("even"))


@query("a05_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12")
def _(s, d):
    return load(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 12")


@query("a06_bool", "SELECT deck_id, bool_or(card_id IS NULL) AS unresolved, bool_and(\"count\" > 0) AS valid FROM deck_cards GROUP BY 1")
def _(s, d):
    return load(s, d, "deck_cards").groupBy("deck_id").agg(F.bool_or(F.col("card_id").isNull()).alias("unresolved"), F.bool_and(F.col("count") > 0).alias("valid"))


@query("a07_listagg", "SELECT l_orderkey, md5(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey)) AS sig FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1")
def _(s, d):
    load(s, d, "lineitem").select("l_orderkey", "l_partkey").distinct().createOrReplaceTempView("tl_lines")
    return s.sql("SELECT l_orderkey, md5(listagg(CAST(l_partkey AS STRING), ',') WITHIN GROUP (ORDER BY l_partkey)) AS sig FROM tl_lines GROUP BY l_orderkey")


@query("a08_collect_set", "SELECT o_custkey, string_agg(p, ',' ORDER BY p) AS kinds FROM (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders) GROUP BY 1")
def _(s, d):
    return load(s, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("kinds"))


@query("a10_json_agg", "SELECT n_regionkey, '[' || string_agg('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS js FROM nation GROUP BY 1")
def _(s, d):
    return load(s, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("js"))


@query("a21_median", "SELECT o_orderpriority, median(o_totalprice) AS med, quantile_cont(o_totalprice, 0.9) AS p90 FROM orders GROUP BY 1")
def _(s, d):
    return load(s, d, "orders").groupBy("o_orderpriority").agg(F.percentile("o_totalprice", 0.5).alias("med"), F.percentile("o_totalprice", 0.9).alias("p90"))


@query("a22_best_row", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def _(s, d):
    return R.best_row(load(s, d, "orders"), ["o_custkey"], F.col("o_orderpriority"), "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("a20_distribution", "SELECT p_size, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct FROM part GROUP BY 1")
def _(s, d):
    n = load(s, d, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.round(F.col("n") * 100.0 / n.agg(F.sum("n").alias("t")).select("t").scalar(), 2))


@query("a26_source_status", "SELECT source, format_name, count(*) AS n, min(tournament_date) AS first, max(tournament_date) AS last, count(DISTINCT deck_name) AS n_names FROM deck_list GROUP BY ALL")
def _(s, d):
    return load(s, d, "deck_list").groupBy("source", "format_name").agg(F.count(F.lit(1)).alias("n"), F.min("tournament_date").alias("first"), F.max("tournament_date").alias("last"), F.countDistinct("deck_name").alias("n_names"))


@query("a_grouping_sets", "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus)::INT AS g, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(s, d):
    return load(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping("o_orderstatus").cast("int").alias("g"), F.count(F.lit(1)).alias("n"))


@query("a_rollup", "SELECT n_regionkey, n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)")
def _(s, d):
    n, c = load(s, d, "nation"), load(s, d, "customer")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).rollup("n_regionkey", "n_name").agg(F.count(F.lit(1)).alias("n"))


@query("a_approximate", "SELECT event_type, abs(approx_count_distinct(user_id) - count(DISTINCT user_id)) <= 0.2 * count(DISTINCT user_id) AS near FROM events GROUP BY 1")
def _(s, d):
    return load(s, d, "events").groupBy("event_type").agg((F.abs(F.approx_count_distinct("user_id") - F.countDistinct("user_id")) <= 0.2 * F.countDistinct("user_id")).alias("near"))


# Windows


@query("w01_first_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def _(s, d):
    return R.first_per_key(load(s, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("w03_share", "SELECT o_orderstatus, o_orderpriority, n, round(100.0 * n / sum(n) OVER (PARTITION BY o_orderstatus), 2) AS share FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)")
def _(s, d):
    return R.share_of_total(load(s, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")), ["o_orderstatus"], "n")


@query("w04_sliding_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW) AS n_window, min(ts) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW) AS oldest FROM events")
def _(s, d):
    return R.sliding_count(load(s, d, "events"), "user_id", "ts", 3600).select("event_id", "n_window", "oldest")


@query("w05_running_block", "SELECT event_id, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS block FROM events")
def _(s, d):
    return R.running_block(load(s, d, "events"), "user_id", "event_id", F.col("event_type") == "signup").select("event_id", "block")


@query("w07_latest_value", "SELECT card_name, arg_max(comment, (published_at, id)) AS latest FROM card_rulings WHERE card_name IS NOT NULL AND published_at IS NOT NULL GROUP BY 1")
def _(s, d):
    r = load(s, d, "card_rulings").where("card_name IS NOT NULL AND published_at IS NOT NULL")
    return r.groupBy("card_name").agg(F.max_by("comment", F.struct("published_at", "id")).alias("latest"))


@query("w08_frames", "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, lag(o_totalprice) OVER w2 AS before, lead(o_orderkey, 2) OVER w2 AS later, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving, ntile(4) OVER w2 AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority), w2 AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def _(s, d):
    w, w2 = Window.partitionBy("o_custkey").orderBy("o_orderpriority"), Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return load(s, d, "orders").select("o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"), F.lag("o_totalprice").over(w2).alias("before"), F.lead("o_orderkey", 2).over(w2).alias("later"), F.round(F.avg("o_totalprice").over(w2.rowsBetween(-2, 0)), 4).alias("moving"), F.ntile(4).over(w2).alias("quarter"))


# Sorts and limits


@query("o01_sort", "SELECT id, placement, row_number() OVER (ORDER BY placement DESC NULLS LAST, id) AS place FROM deck_list ORDER BY placement DESC NULLS LAST, id LIMIT 50")
def _(s, d):
    top = load(s, d, "deck_list").orderBy(F.col("placement").desc_nulls_last(), "id").limit(50)
    return top.select("id", "placement", F.row_number().over(Window.orderBy(F.col("placement").desc_nulls_last(), "id")).alias("place"))


@query("o07_top_k_per_group", "SELECT format_name, id FROM (SELECT *, row_number() OVER (PARTITION BY format_name ORDER BY placement NULLS LAST, id) AS n FROM deck_list) WHERE n <= 3")
def _(s, d):
    return R.first_n_per_bucket(load(s, d, "deck_list"), F.col("format_name"), F.col("placement").asc_nulls_last(), "id", 3).select("format_name", "id")


@query("o08_ties_left", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS place FROM orders), lim AS (SELECT o_custkey, o_orderpriority AS lim FROM r WHERE place = 2) SELECT o_custkey, o_orderkey, place, coalesce((SELECT count(*) FROM r x JOIN lim USING (o_custkey) WHERE x.o_custkey = r.o_custkey AND x.place > 2 AND x.o_orderpriority = lim), 0) AS ties_left FROM r WHERE place <= 2")
def _(s, d):
    return R.top_k_with_ties_left(load(s, d, "orders"), ["o_custkey"], F.col("o_orderpriority"), "o_orderkey", 2).select("o_custkey", "o_orderkey", "place", "ties_left")


@query("o09_merge_ranked", "SELECT id, list_no, rank FROM (SELECT id, list_no, rank, row_number() OVER (PARTITION BY id ORDER BY list_no, rank) AS n FROM (SELECT id, 0 AS list_no, length(card_name) AS rank FROM mtg_cards_v2 WHERE card_name ILIKE '%mirage%' UNION ALL SELECT id, 1, coalesce(edhrec_rank, 99999) FROM mtg_cards_v2 WHERE oracle_text ILIKE '%rival%')) WHERE n = 1 ORDER BY list_no, rank, id LIMIT 300")
def _(s, d):
    c = load(s, d, "mtg_cards_v2")
    a = c.where(F.col("card_name").ilike("%mirage%")).select("id", F.length("card_name").alias("rank"))
    b = c.where(F.col("oracle_text").ilike("%rival%")).select("id", F.coalesce("edhrec_rank", F.lit(99999)).alias("rank"))
    return R.merge_ranked([a, b], "id", "rank", 300)


@query("o10_code_point_sort", "SELECT population_id, array_to_string(list_sort(sources), '|') AS sorted FROM cooccurrence_populations")
def _(s, d):
    return load(s, d, "cooccurrence_populations").select("population_id", F.array_join(F.array_sort("sources"), "|").alias("sorted"))


@query("o11_round_robin", "SELECT id, type_line, round FROM (SELECT id, type_line, row_number() OVER (PARTITION BY type_line ORDER BY md5('1:' || id), id) AS round FROM mtg_cards_v2) ORDER BY round, type_line NULLS FIRST LIMIT 60")
def _(s, d):
    return R.round_robin(load(s, d, "mtg_cards_v2"), "type_line", "id", 60).select("id", "type_line", "round")


@query("d53_bracketed", "SELECT id, bucket, place FROM (SELECT id, least(cmc::INT, 7) AS bucket, row_number() OVER (PARTITION BY least(cmc::INT, 7) ORDER BY edhrec_rank NULLS LAST, id) AS place FROM mtg_cards_v2) WHERE place <= 5")
def _(s, d):
    return R.first_n_per_bucket(load(s, d, "mtg_cards_v2"), F.least(F.col("cmc").cast("int"), F.lit(7)), F.col("edhrec_rank").asc_nulls_last(), "id", 5).select("id", "bucket", "place")


# Set operations


@query("t01_union_all", "SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer")
def _(s, d):
    return load(s, d, "orders").select(F.col("o_custkey").alias("k")).unionAll(load(s, d, "customer").select("c_custkey"))


@query("t02_except", "SELECT 'before' AS side, * FROM (SELECT o_custkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') UNION ALL SELECT 'after', * FROM (SELECT o_custkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')")
def _(s, d):
    """Customers with orders only before, and only after, a day."""
    o = load(s, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("b"))
    a, b = o.where("b").select("k"), o.where("NOT b").select("k")
    return a.subtract(b).withColumn("side", F.lit("before")).unionByName(b.subtract(a).withColumn("side", F.lit("after")))


@query("t03_distinct_in_order", "SELECT event_type, min(event_id) AS event_id FROM events GROUP BY 1")
def _(s, d):
    return R.distinct_keep_order(load(s, d, "events"), "event_type", "event_id")


@query("t04_array_sets", "SELECT id, array_to_string(list_sort(list_distinct(list_concat(colors, ['W', 'B']))), '') AS u, array_to_string(list_sort(list_filter(colors, lambda x: x NOT IN ('W', 'B'))), '') AS e FROM mtg_cards_v2")
def _(s, d):
    wb = F.array(F.lit("W"), F.lit("B"))
    return load(s, d, "mtg_cards_v2").select("id", F.array_join(F.array_sort(F.array_union("colors", wb)), "").alias("u"), F.array_join(F.array_sort(F.array_except("colors", wb)), "").alias("e"))


@query("t05_set_operations", "(SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION (SELECT l_partkey FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size < 40)")
def _(s, d):
    a = load(s, d, "orders").select(F.col("o_custkey").alias("k")).intersect(load(s, d, "customer").where("c_acctbal > 0").select("c_custkey"))
    return a.union(load(s, d, "lineitem").select("l_partkey").subtract(load(s, d, "part").where("p_size < 40").select("p_partkey"))).distinct()


@query("t05_except_all", "SELECT l_partkey FROM lineitem EXCEPT ALL SELECT p_partkey FROM part")
def _(s, d):
    return load(s, d, "lineitem").select("l_partkey").exceptAll(load(s, d, "part").select("p_partkey"))


# Sources and functions of the dialect


@query("s16_series", "SELECT p_partkey, i::INT AS i FROM part, generate_series(1, p_size) t(i)")
def _(s, d):
    return load(s, d, "part").where("p_size >= 1").select("p_partkey", F.explode(F.sequence(F.lit(1), "p_size")).alias("i"))


@query("s17_ordinality", "SELECT population_id, unnest(sources) AS source, (generate_subscripts(sources, 1) - 1)::INT AS at FROM cooccurrence_populations")
def _(s, d):
    return load(s, d, "cooccurrence_populations").select("population_id", F.posexplode("sources").alias("at", "source"))


@query("f_strings", "SELECT id, upper(card_name) AS u, substr(card_name, 2, 3) AS m, split_part(card_name, ' // ', 1) AS front, length(card_name) AS n, concat_ws('/', name_en_front, name_en_back) AS both, trim('  ' || card_name || ' ') AS t, md5(card_name) AS h, len(string_split(card_name, ' ')) AS words, regexp_replace(card_name, '[aeiou]', '', 'g') AS bare FROM mtg_cards_v2")
def _(s, d):
    c = F.col("card_name")
    return load(s, d, "mtg_cards_v2").select("id", F.upper(c).alias("u"), F.substring(c, 2, 3).alias("m"), F.split_part(c, F.lit(" // "), F.lit(1)).alias("front"), F.length(c).alias("n"), F.concat_ws("/", "name_en_front", "name_en_back").alias("both"), F.trim(F.concat(F.lit("  "), c, F.lit(" "))).alias("t"), F.md5(c).alias("h"), F.size(F.split(c, " ")).alias("words"), F.regexp_replace(c, "[aeiou]", "").alias("bare"))


@query("f_dates", "SELECT id, tournament_date - 90 AS back, extract(year FROM tournament_date)::INT AS y, date_trunc('month', tournament_date)::DATE AS m, DATE '2026-07-01' - tournament_date AS age, strftime(tournament_date, '%d/%m/%y') AS text, created_at::DATE AS imported FROM deck_list WHERE tournament_date IS NOT NULL")
def _(s, d):
    t = F.col("tournament_date")
    return load(s, d, "deck_list").where(t.isNotNull()).select("id", F.date_sub(t, 90).alias("back"), F.year(t).alias("y"), F.trunc(t, "month").alias("m"), F.datediff(F.lit("2026-07-01").cast("date"), t).alias("age"), F.date_format(t, "dd/MM/yy").alias("text"), F.to_date("created_at").alias("imported"))


@query("f_month_series", "SELECT format_name, unnest(generate_series(min(date_trunc('month', tournament_date)), max(tournament_date)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m FROM deck_list WHERE tournament_date IS NOT NULL GROUP BY 1")
def _(s, d):
    g = load(s, d, "deck_list").where("tournament_date IS NOT NULL").groupBy("format_name").agg(F.min(F.trunc("tournament_date", "month")).alias("a"), F.max("tournament_date").alias("b"))
    return g.select("format_name", F.explode(F.expr("sequence(a, b, INTERVAL 1 MONTH)")).alias("m"))


@query("f_maths", "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 1) AS r, l_orderkey // 7 AS q, l_orderkey % 7 AS m, round(l_extendedprice / nullif(l_tax, 0), 4) AS g, least(l_quantity::INT // 10, 4) AS bucket FROM lineitem")
def _(s, d):
    c = F.col
    return load(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 1).alias("r"), F.expr("l_orderkey div 7").alias("q"), (c("l_orderkey") % 7).alias("m"), F.round(c("l_extendedprice") / F.nullif(c("l_tax"), F.lit(0.0)), 4).alias("g"), F.least(F.expr("CAST(l_quantity AS INT) div 10").cast("int"), F.lit(4)).alias("bucket"))


@query("f_half_even", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 1) AS q, round_even(l_quantity / 2, 0) AS h FROM lineitem")
def _(s, d):
    return load(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 4, 1).alias("q"), F.bround(F.col("l_quantity") / 2, 0).alias("h"))


@query("f_json", "SELECT event_id, (props->>'k')::INT AS k FROM events")
def _(s, d):
    return load(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("f_variant", "SELECT population_id, (definition->>'side')::BOOLEAN AS side FROM cooccurrence_populations")
def _(s, d):
    return load(s, d, "cooccurrence_populations").select("population_id", F.try_variant_get(F.try_parse_json("definition"), "$.side", "boolean").alias("side"))


@query("f_maps", "SELECT format_name, string_agg(source || '=' || n, ',' ORDER BY source) AS kept FROM (SELECT format_name, source, count(*) AS n FROM deck_list GROUP BY ALL) GROUP BY 1")
def _(s, d):
    g = load(s, d, "deck_list").groupBy("format_name", "source").agg(F.count(F.lit(1)).alias("n")).groupBy("format_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("m"))
    return g.select("format_name", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("kept"))


@query("s13_lookup", "SELECT id, card_name FROM mtg_cards_v2 WHERE id IN (SELECT card_id FROM card_rulings WHERE source_version = (SELECT max(source_version) FROM card_rulings))")
def _(s, d):
    r = load(s, d, "card_rulings")
    latest = r.agg(F.max("source_version").alias("v")).select("v").scalar()
    wanted = r.where(F.col("source_version") == latest).select(F.col("card_id").alias("id"))
    return load(s, d, "mtg_cards_v2").join(wanted, "id", "left_semi").select("id", "card_name")


@query("s15_values", "SELECT n_name, x FROM nation JOIN (VALUES (1, 'a'), (2, 'b')) v(k, x) ON k = n_regionkey")
def _(s, d):
    v = s.createDataFrame([(1, "a"), (2, "b")], "n_regionkey int, x string")
    return load(s, d, "nation").join(F.broadcast(v), "n_regionkey").select("n_name", "x")  # two rows


@query("f_bits", "SELECT deck_id, bit_or(CASE WHEN list_contains(colors, 'W') THEN 1 ELSE 0 END | CASE WHEN list_contains(colors, 'U') THEN 2 ELSE 0 END) AS mask FROM deck_cards JOIN mtg_cards_v2 c ON c.id = card_id GROUP BY 1")
def _(s, d):
    c = load(s, d, "mtg_cards_v2").select(F.col("id").alias("card_id"), (F.when(F.array_contains("colors", "W"), 1).otherwise(0) + F.when(F.array_contains("colors", "U"), 2).otherwise(0)).alias("m"))
    return load(s, d, "deck_cards").join(c, "card_id").groupBy("deck_id").agg(F.bit_or("m").alias("mask"))


@query("f_ratio")
def _(s, d):
    from tallyloom.functions.text import sequence_ratio

    r = load(s, d, "limited_card_stats").where("db_card_name IS NOT NULL").select("card_name", "db_card_name").distinct()
    return r.select("card_name", F.round(sequence_ratio(F.col("card_name"), F.col("db_card_name")), 6).alias("ratio"))


@query("f_stems")
def _(s, d):
    from tallyloom.functions.text import search_tokens

    return load(s, d, "card_rulings").select("id", F.array_join(search_tokens(F.col("comment")), " ").alias("stems"))


@query("sql_dialect", "SELECT format_name, count(*) FILTER (WHERE source ILIKE 'MTGO%') AS n, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, max(tournament_date)::VARCHAR AS last, count(*) // 7 AS q, coalesce(sum(placement), 0)::BIGINT AS p FROM deck_list WHERE regexp_matches(deck_name, '[A-Z]') AND tournament_date >= DATE '2026-07-01' - INTERVAL 900 DAY GROUP BY format_name HAVING count(*) > 1")
def _(s, d):
    load(s, d, "deck_list").createOrReplaceTempView("tl_deck_list")
    return s.sql(
        """SELECT format_name, count(*) FILTER (WHERE source ILIKE 'MTGO%') AS n, listagg(DISTINCT source, '|') WITHIN GROUP (ORDER BY source) AS sources, max(tournament_date)::string AS last,
        count(*) div 7 AS q, coalesce(sum(placement), 0) AS p FROM tl_deck_list WHERE deck_name RLIKE '[A-Z]' AND tournament_date >= DATE '2026-07-01' - INTERVAL 900 DAY GROUP BY format_name HAVING count(*) > 1"""
    )


@query("sql_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1::BIGINT UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
def _(s, d):
    return s.sql("WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")


@query("sql_correlated", "SELECT p_partkey, (SELECT max(l_quantity) FROM lineitem WHERE l_partkey = p_partkey) AS most FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part q WHERE q.p_brand = part.p_brand)")
def _(s, d):
    load(s, d, "part").createOrReplaceTempView("tl_part")
    load(s, d, "lineitem").createOrReplaceTempView("tl_lineitem")
    return s.sql("SELECT p_partkey, (SELECT max(l_quantity) FROM tl_lineitem WHERE l_partkey = p_partkey) AS most FROM tl_part p WHERE p_retailprice > (SELECT avg(p_retailprice) FROM tl_part q WHERE q.p_brand = p.p_brand)")


@query("sql_pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def _(s, d):
    return load(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0).select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("sql_unpivot", "SELECT n_nationkey, k, v FROM (SELECT n_nationkey, n_regionkey::VARCHAR AS region, n_name AS name FROM nation) UNPIVOT (v FOR k IN (region, name))")
def _(s, d):
    n = load(s, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("region"), F.col("n_name").alias("name"))
    return n.unpivot("n_nationkey", ["region", "name"], "k", "v")
