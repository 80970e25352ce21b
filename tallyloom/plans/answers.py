"""Queries for the entries over the operators: every question of a whole table answered at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.common import load
from tallyloom.operators import answers as A
from tallyloom.plans import baskets as PB
from tallyloom.plans import names as PN

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


_COLUMNS = ("card_name", "japanese_name", "type_line", "oracle_text")
_ASKED = """q AS (SELECT DISTINCT card_name AS query, lower(trim(card_name, ' ')) AS asked FROM limited_card_stats WHERE db_card_name IS NULL
  UNION SELECT DISTINCT split_part(type_line, ' ', 1) || ' ' || split_part(name_en_front, ' ', 1) AS query, lower(trim(query, ' ')) FROM mtg_cards_v2 WHERE type_line IS NOT NULL AND name_en_front IS NOT NULL
  UNION SELECT ' ', '' UNION SELECT 'a', 'a' UNION SELECT 'zq xj', 'zq xj')"""
_HAS = " OR ".join(f"coalesce(contains(lower({c}), term), false)" for c in _COLUMNS)
_CLOSE = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("t_search_cards", f"""WITH {_ASKED}, pool AS (SELECT * FROM mtg_cards_v2 WHERE NOT digital), good AS (SELECT DISTINCT asked FROM q WHERE asked <> ''),
w AS (SELECT asked, id, 0 AS stage FROM good, pool WHERE coalesce(contains(lower(card_name), asked), false) OR coalesce(contains(lower(japanese_name), asked), false)),
t AS (SELECT DISTINCT asked, unnest(list_filter(regexp_split_to_array(asked, '\\s+'), lambda x: x <> '')) AS term FROM good), d AS (SELECT DISTINCT term FROM t), h AS (SELECT term, id FROM d, pool WHERE {_HAS}),
e AS (SELECT t.asked, id, 1 AS stage FROM t JOIN h USING (term) JOIN (SELECT asked, count(*) AS n FROM t GROUP BY 1) c ON c.asked = t.asked GROUP BY t.asked, id HAVING count(*) = any_value(n)),
f AS (SELECT asked, id, min(stage) AS stage, 0.0::DOUBLE AS close FROM (SELECT * FROM w UNION ALL SELECT * FROM e) GROUP BY ALL),
l AS (SELECT asked, len(g) AS qn, unnest(g) AS g FROM (SELECT asked, {_CLOSE.format('asked')} AS g FROM good WHERE asked NOT IN (SELECT asked FROM f))),
n AS (SELECT id, n, len(g) AS nn, unnest(g) AS g FROM (SELECT id, n, {_CLOSE.format('n')} AS g FROM (SELECT DISTINCT id, unnest([card_name, japanese_name]) AS n FROM pool) WHERE n IS NOT NULL)),
z AS (SELECT asked, id, n, round(count(*)::DOUBLE / (any_value(qn) + any_value(nn) - count(*)), 6) AS s FROM l JOIN n USING (g) GROUP BY ALL),
a AS (SELECT * FROM f UNION ALL SELECT asked, id, 2, max(s) FROM z WHERE s > 0.3 GROUP BY ALL),
r AS (SELECT asked, id, card_name, stage, row_number() OVER (PARTITION BY asked ORDER BY stage, CASE WHEN stage = 0 THEN lower(card_name) = asked OR coalesce(lower(japanese_name) = asked, false) END DESC NULLS LAST, close DESC, edhrec_rank NULLS LAST, card_name, id) AS place, count(*) OVER (PARTITION BY asked) AS n FROM a JOIN pool USING (id))
SELECT query, CASE WHEN q.asked = '' THEN 'bad input' WHEN id IS NULL THEN 'no match' ELSE 'ok' END AS status, place, id, card_name, stage, CASE WHEN id IS NOT NULL THEN n > 3 END AS more FROM q LEFT JOIN (SELECT * FROM r WHERE place <= 3) r ON r.asked = q.asked""")
def search_cards(s, d):
    """Names as typed elsewhere, and a type with the first word of a name, against all cards."""
    cards = load(s, d, "mtg_cards_v2")
    typed = load(s, d, "limited_card_stats").where("db_card_name IS NULL").select(F.col("card_name").alias("q"))
    both = cards.where("type_line IS NOT NULL AND name_en_front IS NOT NULL").select(F.concat_ws(" ", F.split_part("type_line", F.lit(" "), F.lit(1)), F.split_part("name_en_front", F.lit(" "), F.lit(1))).alias("q"))
    odd = s.createDataFrame([(" ",), ("a",), ("zq xj",)], "q string")
    return A.search_cards(typed.unionByName(both).unionByName(odd), "q", cards, _COLUMNS, 3)


_RULES = "(SELECT (id // 5) || ['', '.3', 'a', 'b', '.7a'][id % 5 + 1] AS number, id % 7 = 0 AS is_glossary, comment AS body FROM card_rulings)"


@query("t_find_rules", f"""WITH r AS {_RULES}, q AS (SELECT DISTINCT CASE id % 3 WHEN 0 THEN (id // 5) || '.' WHEN 1 THEN (id // 5) || '.3' ELSE ' ' || (id // 5) END AS query FROM card_rulings UNION SELECT '' UNION SELECT '999.9'),
b AS (SELECT query, trim(query, ' ') AS asked, regexp_replace(trim(query, ' '), '\\.$', '') AS base FROM q WHERE regexp_full_match(trim(query, ' '), '\\d{{1,3}}(\\.\\d+[a-z]?)?\\.?')),
h AS (SELECT query, number, is_glossary FROM b JOIN r ON starts_with(number, base) AND regexp_full_match(substr(number, length(base) + 1), '(\\.\\d+[a-z]?|[a-z])?')),
p AS (SELECT query, number, row_number() OVER (PARTITION BY query ORDER BY is_glossary DESC, number) AS place, count(*) OVER (PARTITION BY query) AS n FROM h)
SELECT q.query, CASE WHEN trim(q.query, ' ') = '' THEN 'bad input' WHEN number IS NULL THEN 'no match' ELSE 'ok' END AS status, CASE WHEN number IS NOT NULL THEN 'number' END AS mode, place, number, CASE WHEN number IS NOT NULL THEN n > 3 END AS more FROM q LEFT JOIN (SELECT * FROM p WHERE place <= 3) p ON p.query = q.query WHERE q.query = '' OR q.query IN (SELECT query FROM b)""")
def find_rules(s, d):
    """Every number of a rulebook made of all rulings, with and without a point, and some that do not exist."""
    r = load(s, d, "card_rulings")
    part = F.element_at(F.array(F.lit(""), F.lit(".3"), F.lit("a"), F.lit("b"), F.lit(".7a")), (F.col("id") % 5 + 1).cast("int"))
    base = F.floor(F.col("id") / 5).cast("string")
    rules = r.select(F.concat(base, part).alias("number"), (F.col("id") % 7 == 0).alias("is_glossary"), F.col("comment").alias("body"))
    asked = F.when(F.col("id") % 3 == 0, F.concat(base, F.lit("."))).when(F.col("id") % 3 == 1, F.concat(base, F.lit(".3"))).otherwise(F.concat(F.lit(" "), base))
    q = r.select(asked.alias("q")).unionByName(s.createDataFrame([("",), ("999.9",)], "q string"))
    # Longer numbers than a rulebook has are words, which SQL can't stem; the words' path has its own test.
    return A.find_rules(q.where(F.trim("q").rlike(r"^(\d{1,3}(\.\d+[a-z]?)?\.?)?$")), "q", rules, 3)


@query("t_find_rulings", PN.RESOLVE_CTE + """, r AS (SELECT q.query AS asked, k.n, k.id FROM q LEFT JOIN k USING (query)),
o AS (SELECT DISTINCT card_name AS query, regexp_replace(card_name, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS asked FROM deck_cards),
n2 AS (SELECT DISTINCT card_name FROM card_rulings WHERE card_name IS NOT NULL), a AS (SELECT DISTINCT asked FROM o WHERE asked <> ''),
part AS (SELECT asked, count(*) AS n, min(card_name) AS card_name FROM a JOIN n2 ON length(asked) > 2 AND contains(lower(card_name), lower(asked)) GROUP BY 1),
st AS (SELECT asked, card_name, 0 AS stage FROM a JOIN n2 ON asked = card_name UNION ALL SELECT asked, m.card_name, 1 FROM r JOIN mtg_cards_v2 m ON m.id = r.id AND r.n = 1 JOIN n2 ON n2.card_name = m.card_name
  UNION ALL SELECT asked, card_name, 2 FROM a JOIN n2 ON lower(asked) = lower(card_name) UNION ALL SELECT asked, card_name, 3 FROM part WHERE n = 1),
best AS (SELECT asked, stage, card_name FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY stage, card_name) AS i FROM st) WHERE i = 1),
un AS (SELECT asked FROM r WHERE n > 1 UNION SELECT asked FROM part WHERE n > 1),
hit AS (SELECT asked, stage, c.id, published_at, row_number() OVER (PARTITION BY asked ORDER BY published_at DESC NULLS LAST, c.id) AS place, count(*) OVER (PARTITION BY asked) AS n FROM best JOIN card_rulings c USING (card_name))
SELECT o.query, CASE WHEN o.asked = '' THEN 'bad input' WHEN id IS NOT NULL THEN 'ok' WHEN o.asked IN (SELECT asked FROM un) THEN 'ambiguous' ELSE 'no match' END AS status, stage, place, id, published_at, CASE WHEN id IS NOT NULL THEN n > 2 END AS more FROM o LEFT JOIN (SELECT * FROM hit WHERE place <= 2) hit USING (asked)""")
def find_rulings(s, d):
    """Rulings for every name written in a deck."""
    return A.find_rulings(load(s, d, "deck_cards"), "card_name", load(s, d, "card_rulings"), load(s, d, "mtg_cards_v2"), 2)


_PARTNERS = PB.CTE + """, lands AS (SELECT id FROM mtg_cards_v2 WHERE lower(type_line) LIKE '%land%'),
rq AS (SELECT * FROM (SELECT DISTINCT f.format, 'main' AS relation, item AS anchor FROM l0, (VALUES ('Modern'), ('Nowhere')) f(format) WHERE item IS NOT NULL UNION SELECT DISTINCT 'Pauper', 'side', item FROM l0 WHERE item IS NOT NULL UNION SELECT DISTINCT 'Commander', 'side', item FROM l0 WHERE item % 50 = 0)),
rr AS (SELECT *, CASE relation WHEN 'main' THEN 'm' WHEN 'side' THEN 's' END AS rel FROM rq),
hp AS (SELECT DISTINCT population_id, relation AS rel, anchor FROM partners),
hd AS (SELECT r.format, r.rel, r.anchor, w.population_id, w.window_code = 'all' AS whole, coalesce(c.main_count, 0) AS ma, hp.anchor IS NOT NULL AS has FROM rr r JOIN windows w ON w.format = r.format LEFT JOIN counts c ON c.population_id = w.population_id AND c.item = r.anchor
  LEFT JOIN hp ON hp.population_id = w.population_id AND hp.rel = r.rel AND hp.anchor = r.anchor),
ch AS (SELECT format, rel, anchor, CASE WHEN a.ma < 5 THEN 'few baskets' WHEN NOT a.has THEN 'no pairs' END AS reason, CASE WHEN reason IS NULL THEN 'recent' ELSE 'all' END AS "window", CASE WHEN reason IS NULL THEN a.population_id ELSE b.population_id END AS population_id, CASE WHEN reason IS NULL THEN a.ma ELSE b.ma END AS ma
  FROM (SELECT * FROM hd WHERE NOT whole) a JOIN (SELECT * FROM hd WHERE whole) b USING (format, rel, anchor)),
ht AS (SELECT ch.*, p.partner, p.n, p.pct, p.lift, p.n >= 5 AND ch.ma >= 20 AS strong FROM ch JOIN partners p ON p.population_id = ch.population_id AND p.relation = ch.rel AND p.anchor = ch.anchor WHERE p.partner NOT IN (SELECT id FROM lands)),
hs AS (SELECT *, bool_or(strong) OVER (PARTITION BY format, rel, anchor) AS by_lift FROM ht),
pl AS (SELECT *, row_number() OVER (PARTITION BY format, rel, anchor ORDER BY CASE WHEN by_lift THEN lift END DESC NULLS LAST, n DESC, partner) AS place, count(*) OVER (PARTITION BY format, rel, anchor) AS total FROM hs WHERE strong OR NOT by_lift)
SELECT r.format, r.relation, r.anchor, CASE WHEN r.format = 'Nowhere' OR r.format = 'Commander' AND r.rel = 's' THEN 'bad input' WHEN p.partner IS NULL THEN 'no match' ELSE 'ok' END AS status,
  CASE WHEN status <> 'bad input' THEN ch."window" END AS "window", CASE WHEN status <> 'bad input' THEN ch.reason END AS reason, CASE WHEN p.by_lift THEN 'lift' WHEN NOT p.by_lift THEN 'count' END AS ordered_by, place, partner, p.n, pct, lift, CASE WHEN partner IS NOT NULL THEN total > 3 END AS more
FROM rr r LEFT JOIN ch ON ch.format = r.format AND ch.rel = r.rel AND ch.anchor = r.anchor LEFT JOIN (SELECT * FROM pl WHERE place <= 3) p ON p.format = r.format AND p.rel = r.rel AND p.anchor = r.anchor"""


@query("t_find_partners", _PARTNERS)
def find_partners(s, d):
    """Partners of every card of a deck, on both boards, with requests for formats and relations that do not exist."""
    b = PB.Build(s, d).written
    counts, partners = b.counts, b.partners()
    items = PB.lines(s, d).where("item IS NOT NULL").select(F.col("item").alias("anchor")).distinct()
    want = lambda f, r, rows: rows.select(F.lit(f).alias("format"), F.lit(r).alias("relation"), "anchor")
    requests = want("Modern", "main", items).unionByName(want("Nowhere", "main", items)).unionByName(want("Pauper", "side", items)).unionByName(want("Commander", "side", items.where("anchor % 50 = 0")))
    # What the build itself recorded: a window without rows is as ready as any other.
    recorded = b.windows.select("population_id").join(counts.groupBy("population_id").agg(F.count(F.lit(1)).alias("card_rows")), "population_id", "left").fillna(0, ["card_rows"])
    lands = load(s, d, "mtg_cards_v2").where(F.lower("type_line").contains("land")).select(F.col("id").alias("item"))
    return A.find_partners(requests, b.windows, counts, partners, recorded, lands, 3, True, "lift")


@query("t_display_names", PN.RESOLVE_CTE + """SELECT query, CASE WHEN n IS NULL THEN 'unknown' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN k.id END AS id, CASE WHEN n = 1 THEN CASE WHEN japanese_name IS NULL THEN m.card_name ELSE '《' || japanese_name || '/' || m.card_name || '》' END WHEN n IS NULL THEN query END AS display,
CASE WHEN n > 1 THEN c END AS candidates, CASE WHEN n = 1 THEN CASE WHEN created_on IS NULL OR layout IS NULL THEN 'unknown' WHEN created_on > DATE '2024-06-01' THEN 'upcoming' WHEN DATE '2024-06-01' - created_on < 7 THEN 'awaiting' ELSE 'ordinary' END END AS state
FROM q LEFT JOIN k USING (query) LEFT JOIN mtg_cards_v2 m ON n = 1 AND m.id = k.id""")
def display_names(s, d):
    """How every name written in a deck is shown."""
    got = A.display_names(load(s, d, "deck_cards"), "card_name", load(s, d, "mtg_cards_v2"), F.lit("2024-06-01").cast("date"), "created_on", "layout")
    return got.withColumn("candidates", F.array_join("candidates", "|"))


@query("d22_partial", """WITH q AS (SELECT DISTINCT split_part(card_name, ' ', 1) || ' ' || substr(split_part(card_name, ' ', 2), 1, 2) AS query FROM card_rulings WHERE card_name IS NOT NULL), r AS (SELECT DISTINCT card_name FROM card_rulings WHERE card_name IS NOT NULL AND card_name NOT IN (SELECT card_name FROM mtg_cards_v2)),
a AS (SELECT query, 0 AS source, row_number() OVER (PARTITION BY query ORDER BY digital, edhrec_rank NULLS LAST, id) AS place, card_name, count(*) OVER (PARTITION BY query) AS n FROM q JOIN mtg_cards_v2 ON length(query) > 2 AND contains(lower(card_name), lower(query))),
b AS (SELECT query, 1, row_number() OVER (PARTITION BY query ORDER BY card_name) AS place, card_name, count(*) OVER (PARTITION BY query) AS n FROM q JOIN r ON length(query) > 2 AND contains(lower(card_name), lower(query)))
SELECT query, source, place, card_name, n > 5 AS more FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE place <= 5""")
def partial_matches(s, d):
    """The beginning of every name that has rulings, against all names."""
    rulings = load(s, d, "card_rulings")
    second = F.substring(F.split_part("card_name", F.lit(" "), F.lit(2)), 1, 2)
    q = rulings.where("card_name IS NOT NULL").select(F.concat(F.split_part("card_name", F.lit(" "), F.lit(1)), F.lit(" "), second).alias("q"))
    return A.partial_matches(q, "q", load(s, d, "mtg_cards_v2"), rulings)


@query("o05_more", "SELECT o_custkey, o_orderkey, place, n > 3 AS more FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE place <= 3")
def more(s, d):
    """The three largest orders of every customer, and whether there are more."""
    return A.first_with_more(load(s, d, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "place", "more")


@query("k13_report", "SELECT '| ' || id || ' | ' || regexp_replace(coalesce(card_name, ''), '[\\t\\r\\n|]', ' ', 'g') || ' | ' || regexp_replace(coalesce(japanese_name, ''), '[\\t\\r\\n|]', ' ', 'g') || ' |' AS line, 'markdown' AS kind FROM mtg_cards_v2 UNION ALL SELECT id || chr(9) || regexp_replace(coalesce(card_name, ''), '[\\t\\r\\n|]', ' ', 'g') || chr(9) || regexp_replace(coalesce(japanese_name, ''), '[\\t\\r\\n|]', ' ', 'g'), 'tsv' FROM mtg_cards_v2")
def report(s, d):
    """All cards as lines of a markdown and of a tab-separated report."""
    c = load(s, d, "mtg_cards_v2").select("id", "card_name", "japanese_name")
    return A.report_lines(c, "markdown").withColumn("kind", F.lit("markdown")).unionByName(A.report_lines(c).withColumn("kind", F.lit("tsv")))


@query("t_draft_pools", """WITH l AS (SELECT l_orderkey AS game, l_linenumber::INT AS position, min(l_partkey) AS item FROM lineitem GROUP BY ALL), g AS (SELECT DISTINCT game FROM l),
c AS (SELECT game, row_number() OVER (PARTITION BY game ORDER BY position) AS position, item::VARCHAR AS item FROM l WHERE position <= 2 AND game % 11 <> 0), h AS (SELECT game, count(*) AS last FROM c GROUP BY 1),
k AS (SELECT * FROM c WHERE game % 7 <> 0), p AS (SELECT game, position, (CASE WHEN item % 5 = 0 AND position <= 2 THEN -item ELSE item END)::VARCHAR AS item FROM l WHERE (position <> 4 OR game % 2 = 0) AND game NOT IN (SELECT game FROM h WHERE game % 7 = 0)),
j AS (SELECT p.*, k.item AS old, coalesce(h.last, 0) AS last FROM p LEFT JOIN k USING (game, position) LEFT JOIN h USING (game)),
s AS (SELECT *, CASE WHEN position <= last THEN CASE WHEN old = item THEN 'resent' ELSE 'conflict' END WHEN position - last = (SELECT count(*) FROM p q WHERE q.game = j.game AND q.position > j.last AND q.position <= j.position) THEN 'added' ELSE 'gap' END AS state FROM j),
a AS (SELECT game, bool_or(state = 'conflict') AS conflict, bool_or(state = 'gap') AS gap, string_agg(CASE WHEN state = 'added' THEN item END, ';' ORDER BY position) AS added FROM s GROUP BY 1), n AS (SELECT game, string_agg(item, ';' ORDER BY position) AS names FROM k GROUP BY 1)
SELECT *, status <> 'bad input' AND names <> '' AS coded FROM (SELECT g.game AS key, CASE WHEN g.game % 7 = 0 AND last IS NOT NULL THEN 'bad input' WHEN conflict THEN 'conflict' WHEN gap THEN 'gap' ELSE 'ok' END AS status, CASE WHEN status = 'ok' THEN concat_ws(';', n.names, added) ELSE coalesce(n.names, '') END AS names
FROM g LEFT JOIN h ON h.game = g.game LEFT JOIN a ON a.game = g.game LEFT JOIN n ON n.game = g.game)""")
def draft_pools(s, d):
    """Every order as a pool: two lines come as a code, which every seventh order has spoilt and every eleventh lacks, the others as picks."""
    from tallyloom.operators import catalogue as K

    lines = load(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("game"), F.col("l_linenumber").cast("int").alias("position")).agg(F.min("l_partkey").alias("item"))
    first = lines.where("position <= 2 AND game % 11 <> 0").groupBy("game").agg(F.array_sort(F.collect_list(F.struct("position", F.col("item").cast("string").alias("item")))).alias("f"))
    codes = K.encode_codes(first.withColumn("scope", F.lit("ABC")), "SD1", "scope", F.col("f.item")).select("game", F.when(F.col("game") % 7 == 0, F.concat("code", F.lit("x"))).otherwise(F.col("code")).alias("code"))
    item = F.when((F.col("item") % 5 == 0) & (F.col("position") <= 2), -F.col("item")).otherwise(F.col("item")).cast("string").alias("item")
    picks = lines.groupBy("game").agg(F.collect_list(F.when((F.col("position") != 4) | (F.col("game") % 2 == 0), F.struct("position", item))).alias("picks"))
    got = A.draft_pools(picks.join(codes, "game", "left").withColumn("scope", F.lit("ABC")), "game", "code", "scope", "picks")
    # The new codes must read back as the names.
    back = K.decode_codes(got.where("code IS NOT NULL").select("key", "code", F.col("names").alias("shown")), "code").where("state = 'ok' AND names = shown").select("key", F.lit(True).alias("coded"))
    return got.join(back, "key", "left").select("key", "status", F.array_join("names", ";").alias("names"), F.coalesce("coded", F.lit(False)).alias("coded"))
