"""Queries for baskets, populations, pairs and partners."""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.common import at_once, load, squash
from tallyloom.operators import basket as B
from tallyloom.operators.pairs import pair_counts
from tallyloom.session import checkpoint_dir

END = date(2026, 7, 1)
FORMATS = ("Commander", "Legacy", "Modern", "Pauper", "Pioneer", "Premodern", "Standard", "Vintage")
OFFICIAL, AGGREGATOR, MARKER = "mtgo", "mtgtop8", "Night"
SINGLETON = ("Commander",)


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.regexp_replace(F.regexp_replace(F.lower("source"), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return load(spark, sf_dir, "deck_list").select(F.col("id").alias("basket"), F.col("format_name").alias("format"), source.alias("source"), F.col("tournament_name").alias("event"), F.col("tournament_date").alias("day"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "deck_cards").select(F.col("deck_id").alias("basket"), squash("board").alias("board"), F.col("card_id").alias("item"), F.col("card_name").alias("raw_name"), F.col("count").alias("n"))


def populations(spark: SparkSession) -> DataFrame:
    rows = [(*p, p[1] not in SINGLETON, p[1] in SINGLETON) for p in B.constant_populations(FORMATS)]
    return spark.createDataFrame(rows, "population_id int, format string, window_code string, floor int, has_side boolean, merge_extra boolean")


class Build:
    """The stages of one build; each is declared where it is needed, item sets that feed pairs are written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.cards = load(spark, sf_dir, "mtg_cards_v2")
        self.decks = B.source_coverage(baskets(spark, sf_dir), OFFICIAL, AGGREGATOR, MARKER)
        self.lines = B.basket_lines(lines(spark, sf_dir), self.decks)
        self.windows = B.population_windows(populations(spark), self.decks, END)
        self._derive()

    def _derive(self, write=lambda *dfs: dfs) -> None:
        self.sigs = B.basket_signatures(self.lines)
        self.raw = B.windowed_baskets(self.windows, self.decks, self.sigs)
        (self.reps,) = write(B.representatives(self.raw))
        basic = self.cards.where(F.col("type_line").startswith("Basic")).select(F.col("id").alias("item"))
        self.main, self.side = write(*B.item_sets(self.reps, self.lines, self.windows, basic))

    @cached_property
    def written(self) -> "Build":
        """The same build with lines, windows, representatives and item sets checkpointed in the shared folder, each derived from the one before."""
        checkpoint_dir(self.spark)

        def write(*dfs: DataFrame) -> list[DataFrame]:
            return at_once(self.spark, *[df.checkpoint for df in dfs])

        self.lines, self.windows = write(self.lines, self.windows)
        self._derive(write)
        return self

    @property
    def counts(self) -> DataFrame:
        return B.denominators(self.main, self.side, self.windows)

    @property
    def pairs(self) -> DataFrame:
        w = self.written
        return B.population_pairs(w.main, w.side, w.windows)

    @property
    def totals(self) -> DataFrame:
        return self.reps.groupBy("population_id").agg(F.count(F.lit(1)).alias("n_lists"))

    def partners(self) -> DataFrame:
        pairs = self.pairs
        return B.partner_table(pairs, self.counts, self.totals)


_POPS = ", ".join(f"({p[0]}, '{p[1]}', '{p[2]}', {p[3]}, {p[1] not in SINGLETON}, {p[1] in SINGLETON})" for p in B.constant_populations(FORMATS))
_SQ = r"lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"
_SOURCE = "regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_TEST = f"(b.source LIKE '{AGGREGATOR}%' AND b.event LIKE '{MARKER}%' AND b.day >= (SELECT min(o.day) FROM b0 o WHERE o.source LIKE '{OFFICIAL}%' AND o.format = b.format))"
CTE = f"""
WITH b0 AS (SELECT id AS basket, format_name AS format, {_SOURCE} AS source, tournament_name AS event, tournament_date AS day FROM deck_list),
decks AS (SELECT * FROM b0 b WHERE NOT coalesce({_TEST}, false)),
adopt AS (SELECT * FROM b0 b WHERE NOT {_TEST}),
l0 AS (SELECT deck_id AS basket, {_SQ.format('board')} AS board, card_id AS item, card_name AS raw_name, "count" AS n FROM deck_cards),
lines AS (SELECT basket, board, item, CASE WHEN item IS NULL THEN raw_name END AS unresolved, sum(n)::BIGINT AS n FROM l0 WHERE basket IN (SELECT basket FROM decks) GROUP BY ALL),
labelled AS (SELECT *, coalesce('i' || item, 'n' || unresolved) AS label FROM lines),
sigs AS (SELECT basket, md5(string_agg(board || ':' || label || 'x' || n, ',' ORDER BY board, label)) AS sig, bool_or(item IS NULL) AS has_unresolved FROM labelled GROUP BY basket HAVING bool_and(n > 0)),
pops(population_id, format, window_code, floor, has_side, merge_extra) AS (VALUES {_POPS}),
windows AS (SELECT *, CASE WHEN window_code <> 'all' THEN DATE '{END}' - 90 END AS window_start,
  CASE WHEN EXISTS (SELECT 1 FROM decks d WHERE d.format = pops.format AND d.day IS NOT NULL) THEN DATE '{END}' END AS window_end FROM pops),
raw AS (SELECT population_id, d.basket, source, day, sig, has_unresolved FROM windows w JOIN decks d ON d.format = w.format JOIN sigs s ON s.basket = d.basket
  WHERE (window_end IS NULL OR day < window_end) AND (window_start IS NULL OR day >= window_start)),
reps AS (SELECT population_id, basket, source, has_unresolved FROM (SELECT *, row_number() OVER (PARTITION BY population_id, sig ORDER BY basket) AS rn FROM raw) WHERE rn = 1),
known AS (SELECT * FROM lines WHERE item IS NOT NULL AND item NOT IN (SELECT id FROM mtg_cards_v2 WHERE type_line LIKE 'Basic%')),
main AS (SELECT DISTINCT population_id, basket, item FROM reps JOIN known USING (basket) JOIN windows USING (population_id) WHERE board = 'main' OR board = 'commander' AND merge_extra),
side AS (SELECT DISTINCT population_id, basket, item FROM reps JOIN known USING (basket) JOIN windows USING (population_id) WHERE board = 'side' AND has_side),
counts AS (SELECT population_id, item, count(*) FILTER (b = 'm') AS main_count, CASE WHEN any_value(has_side) THEN count(*) FILTER (b = 's') END AS side_count
  FROM (SELECT population_id, item, 'm' AS b FROM main UNION ALL SELECT population_id, item, 's' FROM side) JOIN windows USING (population_id) GROUP BY population_id, item),
pairs AS (SELECT population_id, relation, item_a, item_b, n FROM (
  SELECT a.population_id, 'm' AS relation, a.item AS item_a, b.item AS item_b, count(*) AS n FROM main a JOIN main b ON a.population_id = b.population_id AND a.basket = b.basket AND a.item < b.item GROUP BY ALL
  UNION ALL SELECT a.population_id, 's', a.item, b.item, count(*) FROM main a JOIN side b ON a.population_id = b.population_id AND a.basket = b.basket GROUP BY ALL) JOIN windows USING (population_id) WHERE n >= floor),
totals AS (SELECT population_id, count(*) AS n_lists FROM reps GROUP BY 1),
dirs AS (SELECT population_id, relation, item_a AS anchor, item_b AS partner, n FROM pairs WHERE item_a <> item_b UNION ALL SELECT population_id, relation, item_b, item_a, n FROM pairs WHERE relation = 'm'),
partners AS (SELECT d.population_id, relation, anchor, partner, n, round(100.0::DOUBLE * n / a.main_count, 1) AS pct,
  round(n::DOUBLE * n_lists / (a.main_count::DOUBLE * nullif(CASE WHEN relation = 's' THEN b.side_count ELSE b.main_count END, 0)), 1) AS lift, a.main_count AS ma
  FROM dirs d JOIN counts a ON a.population_id = d.population_id AND a.item = anchor AND a.main_count > 0 JOIN totals t ON t.population_id = d.population_id
  LEFT JOIN counts b ON b.population_id = d.population_id AND b.item = partner)
"""


def _stage(pick):
    return lambda spark, sf_dir: pick(Build(spark, sf_dir))


def d03_source_coverage(spark, sf_dir):
    b = baskets(spark, sf_dir)
    kept = B.source_coverage(b, OFFICIAL, AGGREGATOR, MARKER).select(F.lit("keep unknown").alias("rule"), "basket")
    return kept.unionByName(B.source_coverage(b, OFFICIAL, AGGREGATOR, MARKER, keep_unknown=False).select(F.lit("drop unknown").alias("rule"), "basket"))


def _broken(b: Build) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The build with faults put into some populations: counts above the lists, counts taken away, pairs above their items'."""
    pairs = b.pairs.withColumn("n", F.when((F.col("population_id") % 5 == 2) & (F.col("item_a") % 7 == 0), F.col("n") + 100_000).otherwise(F.col("n")))
    counts = b.counts.withColumn("main_count", F.when((F.col("population_id") % 5 == 0) & (F.col("item") % 3 == 0), F.col("main_count") + 100_000).otherwise(F.col("main_count")))
    return b.reps, counts.where("NOT (population_id % 5 = 1 AND item % 11 = 0)"), pairs


def d09_broken(spark, sf_dir):
    """The gate over faulty populations."""
    return B.consistency(*_broken(Build(spark, sf_dir)))


def d09_publishable(spark, sf_dir):
    return B.publishable(B.consistency(*_broken(Build(spark, sf_dir))))


_GATE = """, {counts}, {pairs}, nl AS (SELECT population_id, count(*) AS n_lists FROM reps GROUP BY 1),
bc AS (SELECT c.population_id, count(*) FILTER (main_count > coalesce(n_lists, 0) OR side_count > coalesce(n_lists, 0)) AS bad_counts FROM gc c LEFT JOIN nl USING (population_id) GROUP BY 1),
e AS (SELECT p.*, a.main_count AS ma, CASE WHEN relation = 'm' THEN b.main_count ELSE b.side_count END AS nb, coalesce(n_lists, 0) AS nl FROM gp p
  LEFT JOIN gc a ON a.population_id = p.population_id AND a.item = item_a LEFT JOIN gc b ON b.population_id = p.population_id AND b.item = item_b LEFT JOIN nl ON nl.population_id = p.population_id),
bp AS (SELECT population_id, count(*) FILTER (ma IS NULL OR nb IS NULL) AS orphan_pairs, count(*) FILTER (ma IS NOT NULL AND nb IS NOT NULL AND (n > ma OR n > nb OR ma + nb - n > nl)) AS bad_pairs FROM e GROUP BY 1),
gate AS (SELECT coalesce(nl.population_id, bc.population_id, bp.population_id) AS population_id, coalesce(n_lists, 0) AS n_lists, coalesce(bad_counts, 0) AS bad_counts, coalesce(orphan_pairs, 0) AS orphan_pairs, coalesce(bad_pairs, 0) AS bad_pairs
  FROM nl FULL JOIN bc ON bc.population_id = nl.population_id FULL JOIN bp ON bp.population_id = coalesce(nl.population_id, bc.population_id))
"""
_GOOD = _GATE.format(counts="gc AS (SELECT * FROM counts)", pairs="gp AS (SELECT * FROM pairs)")
_FAULTY = _GATE.format(
    counts="gc AS (SELECT population_id, item, main_count + CASE WHEN population_id % 5 = 0 AND item % 3 = 0 THEN 100000 ELSE 0 END AS main_count, side_count FROM counts WHERE NOT (population_id % 5 = 1 AND item % 11 = 0))",
    pairs="gp AS (SELECT population_id, relation, item_a, item_b, n + CASE WHEN population_id % 5 = 2 AND item_a % 7 = 0 THEN 100000 ELSE 0 END AS n FROM pairs)",
)


def d11_top_partners(spark, sf_dir):
    return B.top_partners(Build(spark, sf_dir).partners(), 5)


def d14_top_partners_by_lift(spark, sf_dir):
    return B.top_partners(Build(spark, sf_dir).partners(), 5, "lift")


def d12_window_choice(spark, sf_dir):
    b = Build(spark, sf_dir)
    has = b.partners().where("relation = 'm'").select("population_id", F.col("anchor").alias("item")).distinct().withColumn("has_pairs", F.lit(True))
    header = b.counts.join(b.windows.select("population_id", "format", "window_code"), "population_id").join(has, ["population_id", "item"], "left")
    return B.widened_window(header.select("format", F.col("item").alias("anchor"), "window_code", F.col("main_count").alias("ma"), F.coalesce("has_pairs", F.lit(False)).alias("has_pairs")))


def d13_readiness(spark, sf_dir):
    rows = load(spark, sf_dir, "card_population_deck_counts").where("snapshot_no = 4")
    stats = rows.where("population_id % 7 <> 0 OR main_deck_count > 3").groupBy("population_id").agg(F.count(F.lit(1)).alias("card_rows"), F.max("loaded_at").alias("computed_at")).withColumn("deck_count", F.lit(1))
    return B.readiness(stats, rows, F.lit("2026-09-05 00:00:00").cast("timestamp_ntz"), 3)


def d15_colour_partners(spark, sf_dir):
    items = lines(spark, sf_dir)
    anchor = items.where("board = 'main' AND item IS NOT NULL").groupBy("item").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "item").limit(1).select("item").scalar()
    return B.colour_partners(baskets(spark, sf_dir), items, load(spark, sf_dir, "mtg_cards_v2"), anchor)


D15_SQL = CTE + """, anchor AS (SELECT id, coalesce(colors, []) AS colors FROM mtg_cards_v2 WHERE id = (SELECT item FROM l0 WHERE board = 'main' AND item IS NOT NULL GROUP BY item ORDER BY count(*) DESC, item LIMIT 1)),
sig AS (SELECT basket, md5(string_agg(board || ':' || item, ',' ORDER BY board, item)) AS s FROM (SELECT DISTINCT basket, board, item FROM l0 WHERE item IS NOT NULL) GROUP BY basket),
firsts AS (SELECT min(basket) AS basket FROM sig GROUP BY s),
it AS (SELECT DISTINCT basket, item, board FROM l0 JOIN firsts USING (basket) WHERE item IS NOT NULL),
cols AS (SELECT basket, list(DISTINCT c) AS have FROM (SELECT basket, unnest(colors) AS c FROM it JOIN mtg_cards_v2 m ON m.id = item WHERE board = 'main') GROUP BY basket),
cl AS (SELECT f.basket FROM firsts f LEFT JOIN cols USING (basket), anchor a WHERE list_has_all(coalesce(have, []), a.colors)),
al AS (SELECT DISTINCT basket FROM it, anchor a WHERE item = a.id AND board = 'main'),
k AS (SELECT item, count(*) FILTER (basket IN (SELECT basket FROM al)) AS n_with, count(*) FILTER (basket IN (SELECT basket FROM cl)) AS n_partner FROM it WHERE board = 'main' GROUP BY item),
na AS (SELECT count(*) AS na FROM al), nc AS (SELECT count(*) AS nc FROM cl)
SELECT item AS partner, n_with, round(100.0::DOUBLE * n_with / nullif(na, 0), 1) AS pct_with, n_partner, round(100.0::DOUBLE * n_with / nullif(n_partner, 0), 1) AS pct_back, round(100.0::DOUBLE * n_partner / nullif(nc, 0), 1) AS pct_base,
  round((n_with::DOUBLE / nullif(na, 0)) / nullif(n_partner::DOUBLE / nullif(nc, 0), 0), 2) AS ratio, na AS n_anchor_lists, nc AS n_color_lists
FROM k JOIN mtg_cards_v2 m ON m.id = item, na, nc, anchor a WHERE item <> a.id AND n_with >= 3 AND NOT contains(coalesce(type_line, ''), 'Basic Land')"""


def d16_adoption(spark, sf_dir):
    b = B.source_coverage(baskets(spark, sf_dir), OFFICIAL, AGGREGATOR, MARKER, keep_unknown=False)
    return B.adoption(b, lines(spark, sf_dir), load(spark, sf_dir, "mtg_cards_v2"))


def order_baskets(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item")).distinct()


def partner_lift(spark, sf_dir):
    """Partners of parts within orders: pairs in two orders or more, share and lift."""
    checkpoint_dir(spark)
    items = order_baskets(spark, sf_dir).checkpoint()
    n = pair_counts(items, ["basket"], "item").where("n >= 2")
    m = items.groupBy("item").agg(F.count(F.lit(1)).alias("m"))
    total = items.agg(F.countDistinct("basket").alias("t")).select("t").scalar()
    scored = n.join(m.select(F.col("item").alias("item_a"), F.col("m").alias("ma")), "item_a").join(m.select(F.col("item").alias("item_b"), F.col("m").alias("mb")), "item_b")
    return scored.select("item_a", "item_b", "n", F.round(100.0 * F.col("n") / F.col("ma"), 1).alias("pct"), F.round(F.col("n").cast("double") * total / (F.col("ma") * F.col("mb")), 1).alias("lift"))


PARTNER_LIFT_SQL = """
WITH i AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), m AS (SELECT p, count(*) AS m FROM i GROUP BY p), t AS (SELECT count(DISTINCT o) AS t FROM i),
n AS (SELECT a.p AS item_a, b.p AS item_b, count(*) AS n FROM i a JOIN i b ON a.o = b.o AND a.p < b.p GROUP BY ALL HAVING count(*) >= 2)
SELECT item_a, item_b, n, round(100.0::DOUBLE * n / x.m, 1) AS pct, round(n::DOUBLE * t / (x.m * y.m), 1) AS lift FROM n JOIN m x ON x.p = item_a JOIN m y ON y.p = item_b, t"""

QUERIES = {
    "partner_lift": partner_lift,
    "d01_basket_lines": _stage(lambda b: b.lines),
    "d02_signatures": _stage(lambda b: b.sigs),
    "d03_source_coverage": d03_source_coverage,
    "d04_population_windows": _stage(lambda b: b.raw),
    "d05_representatives": _stage(lambda b: b.reps),
    "d06_main_items": _stage(lambda b: b.main),
    "d06_side_items": _stage(lambda b: b.side),
    "d07_denominators": _stage(lambda b: b.counts),
    "d08_pairs": _stage(lambda b: b.pairs),
    "d09_consistency": _stage(lambda b: B.consistency(b.written.reps, b.counts, b.pairs)),
    "d09_broken": d09_broken,
    "d09_publishable": d09_publishable,
    "d10_population_stats": _stage(lambda b: B.population_stats(b.written.windows, b.raw, b.reps, b.counts, b.pairs).withColumn("raw_by_source", F.to_json("raw_by_source")).withColumn("kept_by_source", F.to_json("kept_by_source"))),
    "d11_partners": _stage(lambda b: b.partners()),
    "d11_top_partners": d11_top_partners,
    "d12_window_choice": d12_window_choice,
    "d13_readiness": d13_readiness,
    "d14_top_partners_by_lift": d14_top_partners_by_lift,
    "d15_colour_partners": d15_colour_partners,
    "d16_adoption": d16_adoption,
}
ORACLE = {
    "partner_lift": PARTNER_LIFT_SQL,
    "d01_basket_lines": CTE + "SELECT * FROM lines",
    "d02_signatures": CTE + "SELECT * FROM sigs",
    "d03_source_coverage": CTE + "SELECT 'keep unknown' AS rule, basket FROM decks UNION ALL SELECT 'drop unknown', basket FROM adopt",
    "d04_population_windows": CTE + "SELECT * FROM raw",
    "d05_representatives": CTE + "SELECT * FROM reps",
    "d06_main_items": CTE + "SELECT * FROM main",
    "d06_side_items": CTE + "SELECT * FROM side",
    "d07_denominators": CTE + "SELECT * FROM counts",
    "d08_pairs": CTE + "SELECT * FROM pairs",
    "d09_consistency": CTE + _GOOD + "SELECT * FROM gate",
    "d09_broken": CTE + _FAULTY + "SELECT * FROM gate",
    "d09_publishable": CTE + _FAULTY + "SELECT population_id FROM gate WHERE bad_counts = 0 AND orphan_pairs = 0 AND bad_pairs = 0",
    "d10_population_stats": CTE + """SELECT w.population_id, window_start, window_end, min(day) AS first_day, max(day) AS latest_day, count(r.basket) AS raw_count,
  (SELECT count(*) FROM reps x WHERE x.population_id = w.population_id) AS deck_count, (SELECT count(*) FROM reps x WHERE x.population_id = w.population_id AND has_unresolved) AS unresolved_count,
  (SELECT count(*) FROM counts x WHERE x.population_id = w.population_id) AS card_rows, (SELECT count(*) FROM pairs x WHERE x.population_id = w.population_id) AS pair_rows,
  (SELECT '{' || string_agg('"' || source || '":' || n, ',' ORDER BY source) || '}' FROM (SELECT source, count(*) AS n FROM raw x WHERE x.population_id = w.population_id AND source IS NOT NULL GROUP BY 1)) AS raw_by_source,
  (SELECT '{' || string_agg('"' || source || '":' || n, ',' ORDER BY source) || '}' FROM (SELECT source, count(*) AS n FROM reps x WHERE x.population_id = w.population_id AND source IS NOT NULL GROUP BY 1)) AS kept_by_source
FROM windows w LEFT JOIN raw r ON r.population_id = w.population_id GROUP BY w.population_id, window_start, window_end""",
    "d11_partners": CTE + "SELECT * FROM partners",
    "d11_top_partners": CTE + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY population_id, relation, anchor ORDER BY n DESC, partner) AS place, 'count' AS ordered_by FROM partners) WHERE place <= 5",
    "d12_window_choice": CTE + """, h AS (SELECT format, item AS anchor, window_code, main_count AS ma, EXISTS (SELECT 1 FROM dirs d WHERE d.population_id = counts.population_id AND d.anchor = item AND relation = 'm') AS has_pairs FROM counts JOIN windows USING (population_id)),
x AS (SELECT format, anchor, max(CASE WHEN window_code <> 'all' THEN ma END) AS ma, bool_or(window_code <> 'all' AND has_pairs) AS hp, bool_or(window_code = 'all') AS ha FROM h GROUP BY ALL),
y AS (SELECT *, CASE WHEN NOT ha THEN NULL WHEN ma IS NULL THEN 'no recent window' WHEN ma < 5 THEN 'few baskets' WHEN NOT hp THEN 'no pairs' END AS reason FROM x)
SELECT format, anchor, CASE WHEN reason IS NULL THEN 'recent' ELSE 'all' END AS "window", reason FROM y""",
    "d13_readiness": """WITH r AS (SELECT * FROM card_population_deck_counts WHERE snapshot_no = 4),
s AS (SELECT population_id, count(*) AS n, max(loaded_at) AS seen_at FROM r WHERE population_id % 7 <> 0 OR main_deck_count > 3 GROUP BY 1)
SELECT population_id, CASE WHEN n <> (SELECT count(*) FROM r WHERE r.population_id = s.population_id) THEN 'not ready' WHEN seen_at < TIMESTAMP '2026-09-02 00:00:00' THEN 'stale' ELSE 'ready' END AS state FROM s""",
    "d14_top_partners_by_lift": CTE + """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY population_id, relation, anchor ORDER BY lift DESC NULLS LAST, n DESC, partner) AS place, 'lift' AS ordered_by FROM partners WHERE ma >= 20 AND n >= 5) WHERE place <= 5
UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY population_id, relation, anchor ORDER BY n DESC, partner) AS place, 'count' AS ordered_by FROM partners WHERE ma < 20) WHERE place <= 5""",
    "d15_colour_partners": D15_SQL,
    "d16_adoption": CTE + """SELECT item, format, count(DISTINCT basket) AS play_decks, any_value(total_decks) AS total_decks, round(count(DISTINCT basket)::DOUBLE / any_value(total_decks), 6) AS rate
FROM l0 JOIN adopt a USING (basket) JOIN (SELECT format, count(*) AS total_decks FROM adopt GROUP BY 1) USING (format) JOIN mtg_cards_v2 m ON m.id = item WHERE board = 'main' AND lower(type_line) NOT LIKE '%land%' AND format IS NOT NULL GROUP BY item, format""",
}
