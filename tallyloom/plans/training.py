"""Queries for snapshot differences, uneven keys and orphan references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.common import load
from tallyloom.operators.eager import eager_join_aggregate
from tallyloom.operators.orphans import orphan_references, orphan_report, parent_intervals
from tallyloom.operators.snapshots import snapshot_changes


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of both snapshot tables that were added, removed or changed."""
    counts = snapshot_changes(load(spark, sf_dir, "card_population_deck_counts"), ["population_id", "card_id"], ["main_deck_count", "side_deck_count"])
    pairs = snapshot_changes(load(spark, sf_dir, "card_cooccurrence_v2"), ["population_id", "relation", "card_id_a", "card_id_b"], ["cooccurrence_count"])
    columns = ["snapshot_no", "population_id", "relation", "card_id_a", "card_id_b", "change"]
    one = counts.select(
        F.lit("card_population_deck_counts").alias("table_name"), "snapshot_no", "population_id", F.lit("-").alias("relation"), F.col("card_id").alias("card_id_a"), F.lit(0).alias("card_id_b"), "change"
    )
    two = pairs.select(F.lit("card_cooccurrence_v2").alias("table_name"), *columns)
    return one.unionByName(two)


def p1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_found(spark, sf_dir).groupBy("table_name", "snapshot_no", "change").agg(F.count(F.lit(1)).alias("n"))


def _diff_sql(table: str, keys: str, values: list[str], shown: str) -> str:
    equal = " AND ".join(f"a.{v} IS NOT DISTINCT FROM b.{v}" for v in values)
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    merged = ", ".join(f"coalesce(a.{k}, b.{k}) AS {k}" for k in keys.split(", "))
    return f"""
SELECT '{table}' AS table_name, snapshot_no, {shown}, change FROM (
  SELECT coalesce(b.snapshot_no, a.snapshot_no + 1) AS snapshot_no, {merged},
         CASE WHEN a.snapshot_no IS NULL THEN 'added' WHEN b.snapshot_no IS NULL THEN 'removed'
              WHEN {equal} THEN NULL ELSE 'changed' END AS change
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, {keys} ORDER BY loaded_at DESC) AS rn FROM {table}) WHERE rn = 1) a
  FULL JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, {keys} ORDER BY loaded_at DESC) AS rn FROM {table}) WHERE rn = 1) b
    ON b.snapshot_no = a.snapshot_no + 1 AND {on})
WHERE change IS NOT NULL AND snapshot_no BETWEEN 2 AND 4"""


P1_SQL = (
    _diff_sql("card_population_deck_counts", "population_id, card_id", ["main_deck_count", "side_deck_count"], "population_id, '-' AS relation, card_id AS card_id_a, 0 AS card_id_b")
    + " UNION ALL "
    + _diff_sql("card_cooccurrence_v2", "population_id, relation, card_id_a, card_id_b", ["cooccurrence_count"], "population_id, relation, card_id_a, card_id_b")
)


def p3_card_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per card: rows, populations and the sum, largest and latest main_deck_count, with the card's name."""
    left = load(spark, sf_dir, "card_population_deck_counts").withColumnRenamed("card_id", "id")
    cards = load(spark, sf_dir, "mtg_cards_v2").select("id", "card_name")
    got = eager_join_aggregate(left, cards, "id", ["id"], ["card_name"], "main_deck_count", "loaded_at", distinct="population_id", outer=True)
    return got.withColumnRenamed("id", "card_id").withColumnRenamed("n_distinct", "n_populations")


P3_TOTALS_SQL = """
SELECT t.card_id, c.card_name, count(*) AS n_rows, sum(main_deck_count)::BIGINT AS value_sum, max(main_deck_count)::BIGINT AS value_max,
       max_by(main_deck_count, (loaded_at, main_deck_count))::BIGINT AS value_latest, count(DISTINCT population_id) AS n_populations
FROM card_population_deck_counts t LEFT JOIN mtg_cards_v2 c ON c.id = t.card_id GROUP BY ALL"""


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards with more than one fiftieth of all delivered rows."""
    rows = load(spark, sf_dir, "card_population_deck_counts")
    cards = load(spark, sf_dir, "mtg_cards_v2").select("id")
    got = eager_join_aggregate(rows.withColumnRenamed("card_id", "id"), cards, "id", ["id"], [], "main_deck_count", "loaded_at", outer=True)
    total = rows.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return got.where((F.col("n_rows") * 50 > total) & F.col("id").isNotNull()).select(F.col("id").alias("card_id"))


P3_SQL = """
SELECT card_id FROM card_population_deck_counts WHERE card_id IS NOT NULL GROUP BY card_id
HAVING count(*) * 50 > (SELECT count(*) FROM card_population_deck_counts)"""


def p3_format_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same results by card and format; the format comes from the joined populations."""
    left, right = load(spark, sf_dir, "card_population_deck_counts"), load(spark, sf_dir, "cooccurrence_populations")
    return eager_join_aggregate(left, right, "population_id", ["card_id"], ["format_name"], "main_deck_count", "loaded_at")


P3_FORMAT_SQL = """
SELECT card_id, format_name, count(*) AS n_rows, sum(main_deck_count)::BIGINT AS value_sum, max(main_deck_count)::BIGINT AS value_max,
       max_by(main_deck_count, (loaded_at, main_deck_count))::BIGINT AS value_latest
FROM card_population_deck_counts JOIN cooccurrence_populations USING (population_id) GROUP BY ALL"""


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of card_rulings and card_cooccurrence_v2 to cards that are missing, deleted or late."""
    cards = load(spark, sf_dir, "mtg_cards_v2")
    rulings = load(spark, sf_dir, "card_rulings")
    pairs = load(spark, sf_dir, "card_cooccurrence_v2")
    day = F.coalesce(F.col("published_at"), F.col("source_version"))

    def side(df, table, field, key, when, holder):
        return df.select(F.lit(table).alias("table_name"), F.lit(field).alias("field_name"), key.alias("ref_key"), when.cast("date").alias("day"), holder.cast("bigint").alias("holder_id"))

    # The two kinds of key share one key space: an id is never a uuid, so one merge serves all three fields.
    refs = [
        side(rulings, "card_rulings", "card_id", F.col("card_id").cast("string"), day, F.col("id")),
        side(rulings, "card_rulings", "oracle_id", F.lower("oracle_id"), day, F.col("id")),
        side(pairs, "card_cooccurrence_v2", "card_id_b", F.col("card_id_b").cast("string"), F.col("snapshot_date"), F.col("population_id")),
    ]
    created, deleted = F.col("created_on"), F.col("deleted_on")
    parents = parent_intervals(cards, F.col("id").cast("string"), created, deleted).unionByName(parent_intervals(cards, F.lower("oracle_id"), created, deleted))
    found = orphan_references(reduce(DataFrame.unionByName, refs), parents)
    return found.select("table_name", "field_name", F.date_format("day", "yyyy-MM").alias("period"), "ref_key", "reason", "holder_id").distinct()


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(p6_found(spark, sf_dir))


P6_SQL = """
WITH refs AS (
  SELECT 'card_rulings' AS table_name, 'card_id' AS field_name, card_id::VARCHAR AS ref_key, coalesce(published_at, source_version) AS day, id::BIGINT AS holder_id FROM card_rulings WHERE card_id IS NOT NULL
  UNION SELECT 'card_rulings', 'oracle_id', lower(oracle_id), coalesce(published_at, source_version), id FROM card_rulings WHERE oracle_id IS NOT NULL
  UNION SELECT 'card_cooccurrence_v2', 'card_id_b', card_id_b::VARCHAR, snapshot_date, population_id FROM card_cooccurrence_v2 WHERE card_id_b IS NOT NULL),
parents AS (SELECT id::VARCHAR AS k, created_on, deleted_on FROM mtg_cards_v2 UNION ALL SELECT lower(oracle_id), created_on, deleted_on FROM mtg_cards_v2)
SELECT DISTINCT table_name, field_name, strftime(day, '%Y-%m') AS period, ref_key,
       CASE WHEN k IS NULL THEN 'missing' WHEN deleted_on <= day THEN 'deleted' ELSE 'late' END AS reason, holder_id
FROM refs LEFT JOIN parents ON k = ref_key WHERE k IS NULL OR deleted_on <= day OR created_on > day"""

QUERIES = {
    "p1_found": p1_found,
    "p1_summary": p1_summary,
    "p3_found": p3_found,
    "p3_card_totals": p3_card_totals,
    "p3_format_totals": p3_format_totals,
    "p6_found": p6_found,
    "p6_report": p6_report,
}
ORACLE = {
    "p1_found": P1_SQL,
    "p1_summary": f"SELECT table_name, snapshot_no, change, count(*) AS n FROM ({P1_SQL}) GROUP BY ALL",
    "p3_found": P3_SQL,
    "p3_card_totals": P3_TOTALS_SQL,
    "p3_format_totals": P3_FORMAT_SQL,
    "p6_found": P6_SQL,
    "p6_report": f"SELECT table_name, field_name, period, reason, count(*) AS n_references, count(DISTINCT ref_key) AS n_keys FROM ({P6_SQL}) GROUP BY ALL",
}
