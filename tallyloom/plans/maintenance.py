"""Queries for maintenance: differences between table versions, merges, gates, freshness."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.common import load
from tallyloom.operators import maintain as M
from tallyloom.session import checkpoint_dir

KEYS, VALUES = ["population_id", "card_id"], ["main_deck_count", "side_deck_count"]


def _version(spark, sf_dir, n) -> DataFrame:
    """One snapshot with unique keys: the largest row of each key."""
    rows = load(spark, sf_dir, "card_population_deck_counts").where(F.col("snapshot_no") == n)
    return rows.groupBy(*KEYS).agg(F.max("main_deck_count").alias("main_deck_count"), F.max("side_deck_count").alias("side_deck_count"))


_V = "(SELECT population_id, card_id, max(main_deck_count) AS main_deck_count, max(side_deck_count) AS side_deck_count FROM card_population_deck_counts WHERE snapshot_no = {0} GROUP BY 1, 2)"
A, B = _V.format(3), _V.format(4)
_DIFF = f"""SELECT coalesce(n.population_id, o.population_id) AS population_id, coalesce(n.card_id, o.card_id) AS card_id, n.main_deck_count, n.side_deck_count,
CASE WHEN o.card_id IS NULL THEN 'insert' WHEN n.card_id IS NULL THEN 'delete' WHEN n.main_deck_count IS DISTINCT FROM o.main_deck_count OR n.side_deck_count IS DISTINCT FROM o.side_deck_count THEN 'update' ELSE 'same' END AS action
FROM {A} o FULL JOIN {B} n ON o.population_id = n.population_id AND o.card_id = n.card_id"""


def _old(s, d):
    return _version(s, d, 3)


def _new(s, d):
    return _version(s, d, 4)


def k02_verify(s, d):
    return M.verify_equal(_old(s, d), _new(s, d))


def k02_verify_applied(s, d):
    """After the whole difference nothing differs; after the difference of some populations the others still do."""
    whole = M.verify_equal(M.diff_apply(_old(s, d), _new(s, d), KEYS, VALUES), _new(s, d)).withColumn("applied", F.lit("all"))
    some = M.diff_apply(_old(s, d), _new(s, d).where("population_id < 50"), KEYS, VALUES, F.col("population_id") < 50)
    return whole.unionByName(M.verify_equal(some, _new(s, d)).withColumn("applied", F.lit("some")))


def k06_reload(s, d):
    """A table reloaded twice; each time the pointer leads to the version written last."""
    folder = f"{checkpoint_dir(s)}/tl_{uuid.uuid4().hex}"
    M.reload_table(_old(s, d), folder)
    first = M.current_table(s, folder).withColumn("load_no", F.lit(1))
    M.reload_table(_new(s, d), folder)
    return first.unionByName(M.current_table(s, folder).withColumn("load_no", F.lit(2)))


def k07_sync(s, d):
    cards = load(s, d, "mtg_cards_v2")
    new = cards.select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("  "), F.regexp_replace("oracle_text", " ", "  "))).otherwise(F.col("oracle_text")).alias("oracle_text"),
                       F.when(F.col("id") % 5 == 0, F.reverse("colors")).otherwise(F.col("colors")).alias("colors"), F.when(F.col("id") % 7 == 0, F.lit("Token")).otherwise(F.col("type_line")).alias("type_line"))
    return M.really_changed(cards, new, ["id"], ["oracle_text", "colors", "type_line"]).select("id", F.array_join("changed", ",").alias("changed"))


def k11_publish(s, d):
    df = load(s, d, "deck_list").withColumn("deck_key", F.concat_ws("_", "format_name", F.col("id").cast("string")))
    return M.scrub(df, F.col("source") == "mtgo", ["tournament_name"], ["deck_key"]).select("id", "source", "tournament_name", "deck_key")


def k12_digest(s, d):
    """Digests of a table and of its rows in another order agree; only the verdict is compared, hashes are engine-specific."""
    df = load(s, d, "card_rulings")
    cols = ["id", "oracle_id", "card_id", "comment"]
    a, b = M.digest(df, cols, ["source"]), M.digest(df.repartition(7, "comment"), cols, ["source"])
    return a.join(b.withColumnRenamed("digest", "other"), "source").select("source", (F.col("digest") == F.col("other")).alias("equal"), F.split_part("digest", F.lit(":"), F.lit(1)).cast("bigint").alias("n"))


def a25_completeness(s, d):
    return M.completeness(load(s, d, "card_rulings"), ["card_id", "card_name", "published_at"], ["source"])


def d50_freshness(s, d):
    return M.freshness(load(s, d, "deck_list"), "format_name", "tournament_date", F.lit("2026-07-01").cast("date"), 45)


def d51_health(s, d):
    return M.health({"deck_list": (load(s, d, "deck_list"), "created_at"), "card_rulings": (load(s, d, "card_rulings"), "published_at"), "part": (load(s, d, "part"), None)})


def d60_retention(s, d):
    return M.retention(load(s, d, "events"), "ts", "user_id", F.lit("2024-01-15").cast("timestamp")).select("event_id", "user_id")


def quality_rules(s, d):
    p = load(s, d, "card_cooccurrence_v2")
    return M.broken_rules(p, {"main pairs in order": (F.col("relation") != "m") | (F.col("card_id_a") < F.col("card_id_b")), "counts positive": F.col("cooccurrence_count") > 0})


QUERIES = {
    "k01_diff_actions": lambda s, d: M.diff_actions(_old(s, d), _new(s, d), KEYS, VALUES),
    "k01_diff_apply_scoped": lambda s, d: M.diff_apply(_old(s, d), _new(s, d).where("population_id < 50"), KEYS, VALUES, F.col("population_id") < 50),
    "k02_verify": k02_verify,
    "k02_verify_applied": k02_verify_applied,
    "k03_upsert": lambda s, d: M.upsert(_old(s, d), _new(s, d), KEYS),
    "k04_insert_absent": lambda s, d: M.insert_absent(_old(s, d), _new(s, d), KEYS),
    "k05_sweep": lambda s, d: M.sweep(_old(s, d), F.col("main_deck_count") >= 10, _new(s, d), KEYS),
    "k06_reload": k06_reload,
    "k07_sync": k07_sync,
    "k08_ghosts": lambda s, d: M.ghosts(_old(s, d), _new(s, d), KEYS),
    "k09_changed_only": lambda s, d: M.diff_actions(_old(s, d), _new(s, d), KEYS, VALUES).where("action = 'update'"),
    "k10_union_arrays": lambda s, d: M.union_arrays(load(s, d, "cooccurrence_populations").select("format_name", "sources"), load(s, d, "deck_list").groupBy("format_name").agg(F.collect_set("source").alias("sources")), "format_name", "sources").select("format_name", F.array_join("sources", ",").alias("sources")),
    "k11_publish": k11_publish,
    "k12_digest": k12_digest,
    "a25_completeness": a25_completeness,
    "d50_freshness": d50_freshness,
    "d51_health": d51_health,
    "d60_retention": d60_retention,
    "quality_rules": quality_rules,
    "duplicate_keys": lambda s, d: M.duplicate_keys(load(s, d, "limited_card_stats"), ["expansion", "event_type", "card_name"]),
}
ORACLE = {
    "k01_diff_actions": _DIFF,
    "k01_diff_apply_scoped": f"SELECT * FROM {B} WHERE population_id < 50 UNION ALL SELECT * FROM {A} WHERE population_id >= 50",
    "k02_verify": f"SELECT *, only_in_a = 0 AND only_in_b = 0 AS ok FROM (SELECT (SELECT count(*) FROM (SELECT * FROM {A} EXCEPT ALL SELECT * FROM {B})) AS only_in_a, (SELECT count(*) FROM (SELECT * FROM {B} EXCEPT ALL SELECT * FROM {A})) AS only_in_b)",
    "k02_verify_applied": f"WITH p AS (SELECT * FROM {B} WHERE population_id < 50 UNION ALL SELECT * FROM {A} WHERE population_id >= 50) SELECT 'all' AS applied, 0 AS only_in_a, 0 AS only_in_b, true AS ok UNION ALL SELECT 'some', a, b, a = 0 AND b = 0 FROM (SELECT (SELECT count(*) FROM (SELECT * FROM p EXCEPT ALL SELECT * FROM {B})) AS a, (SELECT count(*) FROM (SELECT * FROM {B} EXCEPT ALL SELECT * FROM p)) AS b)",
    "k03_upsert": f"SELECT * FROM {B} UNION ALL SELECT * FROM {A} o WHERE NOT EXISTS (SELECT 1 FROM {B} n WHERE n.card_id = o.card_id AND n.population_id = o.population_id)",
    "k04_insert_absent": f"SELECT * FROM {B} n WHERE NOT EXISTS (SELECT 1 FROM {A} o WHERE n.card_id = o.card_id AND n.population_id = o.population_id)",
    "k05_sweep": f"SELECT * FROM {A} o WHERE main_deck_count < 10 OR EXISTS (SELECT 1 FROM {B} n WHERE n.card_id = o.card_id AND n.population_id = o.population_id)",
    "k06_reload": f"SELECT *, 1 AS load_no FROM {A} UNION ALL SELECT *, 2 FROM {B}",
    "k07_sync": "SELECT id, 'type_line' AS changed FROM mtg_cards_v2 WHERE id % 7 = 0 AND type_line IS DISTINCT FROM 'Token'",
    "k08_ghosts": f"SELECT * FROM {A} o WHERE NOT EXISTS (SELECT 1 FROM {B} n WHERE n.card_id = o.card_id AND n.population_id = o.population_id)",
    "k09_changed_only": f"SELECT * FROM ({_DIFF}) WHERE action = 'update'",
    "k10_union_arrays": "SELECT format_name, string_agg(s, ',' ORDER BY s) AS sources FROM (SELECT DISTINCT format_name, unnest(sources) AS s FROM cooccurrence_populations UNION SELECT DISTINCT format_name, source FROM deck_list) GROUP BY 1",
    "k11_publish": r"SELECT id, source, CASE WHEN coalesce(source = 'mtgo', false) THEN NULL ELSE tournament_name END AS tournament_name, CASE WHEN source = 'mtgo' THEN regexp_replace(concat_ws('_', format_name, id), '_\d+$', '') ELSE concat_ws('_', format_name, id) END AS deck_key FROM deck_list",
    "k12_digest": "SELECT source, true AS equal, count(*) AS n FROM card_rulings GROUP BY 1",
    "a25_completeness": "SELECT source, count(*) AS n, count(card_id) AS n_card_id, count(card_name) AS n_card_name, count(published_at) AS n_published_at FROM card_rulings GROUP BY 1",
    "d50_freshness": "SELECT format_name, max(tournament_date) AS latest, DATE '2026-07-01' - max(tournament_date) AS age_days, CASE WHEN max(tournament_date) IS NULL THEN 'unknown' WHEN DATE '2026-07-01' - max(tournament_date) > 45 THEN 'stale' ELSE 'fresh' END AS state FROM deck_list GROUP BY 1",
    "d51_health": "SELECT 'deck_list' AS table_name, count(*) AS n_rows, max(created_at)::DATE AS latest FROM deck_list UNION ALL SELECT 'card_rulings', count(*), max(published_at) FROM card_rulings UNION ALL SELECT 'part', count(*), NULL FROM part",
    "d60_retention": "SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN user_id END AS user_id FROM events",
    "quality_rules": "SELECT 'main pairs in order' AS rule, count(*) FILTER (NOT (relation <> 'm' OR card_id_a < card_id_b)) AS n_broken FROM card_cooccurrence_v2 UNION ALL SELECT 'counts positive', count(*) FILTER (NOT cooccurrence_count > 0) FROM card_cooccurrence_v2",
    "duplicate_keys": "SELECT expansion, event_type, card_name, count(*) AS n FROM limited_card_stats GROUP BY ALL HAVING count(*) > 1",
}
