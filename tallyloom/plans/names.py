"""Queries for name resolution and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.common import load
from tallyloom.functions import text as T
from tallyloom.operators import resolve as N
from tallyloom.operators import search as S


def _cards(s, d):
    return load(s, d, "mtg_cards_v2")


def d17_links(s, d):
    lines = load(s, d, "deck_cards")
    return N.repair_links(lines, "card_id", "card_name", _cards(s, d)).select("id", "card_id")


def d18_aliases(s, d):
    """Turned names that only an alias table knows, names in brackets, fronts, and names that are no alias of any."""
    cards = _cards(s, d)
    turned = F.concat_ws("/", "name_en_back", "name_en_front")
    has_alias = F.col("name_en_back").isNotNull() & (F.col("id") % 2 == 0)
    aliases = cards.where(has_alias).select(turned.alias("alias"), "card_name")
    raw = F.when(F.col("name_en_back").isNotNull() & (F.col("id") % 3 > 0), turned).when(F.col("id") % 5 == 0, F.col("name_en_front")).when(F.col("id") % 7 == 0, F.concat(F.lit("[X] "), "card_name")).when(F.col("id") % 11 == 0, F.replace("card_name", F.lit(" // "), F.lit("/"))).otherwise(F.concat("card_name", F.lit(" (new)")))
    lines = cards.select("id", raw.alias("raw"), F.lit(None).cast("int").alias("card_id"))
    return N.repair_links(lines, "card_id", "raw", cards, aliases).select("id", "card_id")


def d19_resolve(s, d):
    got = N.resolve(load(s, d, "deck_cards"), "card_name", N.name_table(_cards(s, d)))
    return got.select("query", "status", "id", F.array_join("candidates", "|").alias("candidates"), "stage")


def d19_resolve_parts(s, d):
    """Ambiguity: many parts share a name."""
    p = load(s, d, "part")
    names = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("card_name"), (F.col("p_size") > 25).alias("digital"), F.col("p_name").alias("name"), F.lit(0).alias("rank"))
    asked = p.select(F.upper("p_name").alias("q")).union(p.select("p_name"))
    got = N.resolve(asked, "q", names)
    return got.select("query", "status", "id", F.size("candidates").alias("n"), "stage")


def d20_bilingual(s, d):
    """Names of either language; ties by entry make a name ambiguous."""
    c = _cards(s, d)
    names = F.array("card_name", "japanese_name", "name_en_front", "name_ja_front", "name_en_back", "name_ja_back")
    flat = c.select("id", F.explode(F.array_distinct(F.array_compact(names))).alias("name"))
    by = flat.groupBy("name").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id"))
    return by.select("name", "n", F.when(F.col("n") == 1, F.col("id")).alias("id"))


def _in_set(s, d, fuzzy):
    rows = load(s, d, "limited_card_stats")
    entries = rows.where("db_card_name IS NOT NULL").select("expansion", "db_card_name").distinct().join(_cards(s, d).select(F.col("card_name").alias("db_card_name"), F.array_compact(F.array("card_name", "japanese_name", "name_en_front", "name_en_back")).alias("names")), "db_card_name")
    return N.near_in_list(rows.where("db_card_name IS NULL"), "card_name", entries, "expansion", "names", "db_card_name", fuzzy=fuzzy)


def d23_near_in_set(s, d):
    return _in_set(s, d, True)


def d23_in_set(s, d):
    """The same without the order-sensitive ratio, which SQL lacks."""
    return _in_set(s, d, False)


def d24_match(s, d):
    return N.match_names(load(s, d, "limited_card_stats"), "card_name", _cards(s, d))


def near_by_trigrams(s, d):
    return N.near_names(load(s, d, "limited_card_stats").where("db_card_name IS NULL"), "card_name", _cards(s, d), "card_name", "id")


_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
NEAR_SQL = f"""
WITH q AS (SELECT query, len(t) AS qn, unnest(t) AS g FROM (SELECT card_name AS query, {_TRI.format('card_name')} AS t FROM (SELECT DISTINCT card_name FROM limited_card_stats WHERE db_card_name IS NULL))),
n AS (SELECT key, name, len(t) AS nn, unnest(t) AS g FROM (SELECT id AS key, card_name AS name, {_TRI.format('card_name')} AS t FROM mtg_cards_v2)),
s AS (SELECT query, key, name, round(count(*)::DOUBLE / (any_value(qn) + any_value(nn) - count(*)), 6) AS similarity FROM q JOIN n USING (g) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, key, name) AS place FROM s WHERE similarity > 0.3) WHERE place <= 3"""


def f_trigrams(s, d):
    """All pairs of names that share a trigram; they meet on their trigrams."""
    p = load(s, d, "part").select("p_name").distinct().select("p_name", T.trigrams(F.col("p_name")).alias("t"))
    g = p.select("p_name", F.explode("t").alias("g"))
    pairs = g.select(F.col("p_name").alias("a"), "g").join(g.select(F.col("p_name").alias("b"), "g"), "g").where("a < b").select("a", "b").distinct()
    joined = pairs.join(p.select(F.col("p_name").alias("a"), F.col("t").alias("x")), "a").join(p.select(F.col("p_name").alias("b"), F.col("t").alias("y")), "b")
    return joined.select("a", "b", F.round(T.similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


_OK = "coalesce(contains(lower(card_name), {0}), false) OR coalesce(contains(lower(japanese_name), {0}), false) OR coalesce(contains(lower(type_line), {0}), false) OR coalesce(contains(lower(oracle_text), {0}), false)"
D25_TEXT_SQL = f"SELECT id FROM mtg_cards_v2 WHERE NOT digital AND ({_OK.format(chr(39) + 'rival' + chr(39))}) AND ({_OK.format(chr(39) + 'gain' + chr(39))})"


def d25_terms(s, d):
    c = _cards(s, d)
    return c.where(~F.col("digital") & S.contains_all(["card_name", "japanese_name", "type_line", "oracle_text"], ["rival", "gain"])).select("id")


def d27_number(s, d):
    """Direct children only: 12, 12.3 and 12a, not 120."""
    p = load(s, d, "part")
    n = F.element_at(F.array(F.lit(""), F.lit(".3"), F.lit("a"), F.lit("0"), F.lit(".3b")), (F.col("p_partkey") % 5 + 1).cast("int"))
    rules = p.select("p_partkey", F.concat((F.col("p_size") % 20).cast("string"), n).alias("number"))
    return S.number_lookup(rules, "12.")


def d27_text(s, d):
    docs = load(s, d, "documents")
    index = S.term_index(docs, "doc_id", "text")
    a = S.ranked_search(index, "the pairings went up late for the control decks", 12).withColumn("q", F.lit("all"))
    b = S.ranked_search(index, "pairings zebra", 12).withColumn("q", F.lit("any"))
    return a.unionByName(b)


#: Small Latin letters and their full-width forms.
_HALF = "abcdefghijklmnopqrstuvwxyz"
_FULL = "".join(chr(ord(c) + 0xFEE0) for c in _HALF)


def f_text_tools(s, d):
    c = _cards(s, d)
    name = F.col("card_name")
    return c.select(
        "id", T.has_word_run(F.col("oracle_text"), F.lit("Each rival")).alias("run"), T.strip_parentheses(F.concat(name, F.lit(" (reminder)"))).alias("bare"), F.coalesce(T.is_japanese(F.col("japanese_name")), F.lit(False)).alias("ja"),
        T.strip_ruby(F.concat(F.col("japanese_name"), F.lit("（かな）"))).alias("no_ruby"), T.html_unescape(F.concat(F.replace(F.replace(name, F.lit("&"), F.lit("&amp;")), F.lit("'"), F.lit("&#39;")), F.lit(" &lt;b&gt;"))).alias("unescaped"), T.name_form(F.translate(name, _HALF, _FULL)).alias("form"),
    )


QUERIES = {
    "d17_links": d17_links,
    "d18_aliases": d18_aliases,
    "d19_resolve": d19_resolve,
    "d19_resolve_parts": d19_resolve_parts,
    "d20_bilingual": d20_bilingual,
    "d21_display": lambda s, d: N.display_name(_cards(s, d)),
    "d23_near_in_set": d23_near_in_set,
    "d23_in_set": d23_in_set,
    "d24_match": d24_match,
    "d23_near_by_trigrams": near_by_trigrams,
    "f_trigrams": f_trigrams,
    "d25_terms": d25_terms,
    "d27_number": d27_number,
    "d27_text": d27_text,
    "f_text_tools": f_text_tools,
}
_ALIASES = r"""WITH c AS (SELECT card_name, min(id) AS id FROM mtg_cards_v2 GROUP BY 1), f AS (SELECT name_en_front, min(id) AS id FROM mtg_cards_v2 GROUP BY 1 HAVING count(*) = 1),
al AS (SELECT name_en_back || '/' || name_en_front AS alias, card_name FROM mtg_cards_v2 WHERE name_en_back IS NOT NULL AND id % 2 = 0),
r AS (SELECT id, CASE WHEN name_en_back IS NOT NULL AND id % 3 > 0 THEN name_en_back || '/' || name_en_front WHEN id % 5 = 0 THEN name_en_front WHEN id % 7 = 0 THEN '[X] ' || card_name WHEN id % 11 = 0 THEN replace(card_name, ' // ', '/') ELSE card_name || ' (new)' END AS raw FROM mtg_cards_v2),
l AS (SELECT id, regexp_replace(regexp_replace(raw, '\[[^\]]*\]', '', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t FROM r)
SELECT l.id, coalesce(a.id, b.id, f.id) AS card_id FROM l LEFT JOIN al ON alias = t LEFT JOIN c a ON a.card_name = coalesce(al.card_name, t) LEFT JOIN c b ON b.card_name = regexp_replace(t, '\s*/+\s*', ' // ', 'g') LEFT JOIN f ON f.name_en_front = coalesce(al.card_name, t)"""
_LINK = r"""WITH c AS (SELECT card_name, min(id) AS id FROM mtg_cards_v2 GROUP BY 1), f AS (SELECT name_en_front, min(id) AS id FROM mtg_cards_v2 GROUP BY 1 HAVING count(*) = 1),
l AS (SELECT id, card_id, regexp_replace(regexp_replace(card_name, '\[[^\]]*\]', '', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t FROM deck_cards)
SELECT l.id, coalesce(card_id, a.id, b.id, f.id) AS card_id FROM l LEFT JOIN c a ON a.card_name = t LEFT JOIN c b ON b.card_name = regexp_replace(t, '\s*/+\s*', ' // ', 'g') LEFT JOIN f ON f.name_en_front = t"""
RESOLVE_CTE = r"""WITH q AS (SELECT DISTINCT regexp_replace(card_name, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS query FROM deck_cards WHERE query <> ''),
n AS (SELECT id, card_name, digital, name, min(rank) AS rank FROM (SELECT id, card_name, digital, card_name AS name, 0 AS rank FROM mtg_cards_v2 UNION ALL SELECT id, card_name, digital, name_en_front, 1 FROM mtg_cards_v2 UNION ALL SELECT id, card_name, digital, name_en_back, 2 FROM mtg_cards_v2) WHERE name IS NOT NULL GROUP BY ALL),
h AS (SELECT query, 0 AS stage, n.* FROM q JOIN n ON query = name UNION ALL SELECT query, 1, n.* FROM q JOIN n ON lower(query) = lower(name)
  UNION ALL SELECT query, 2, n.* FROM q JOIN n ON rank = 0 AND contains(query, ' / ') AND NOT contains(query, ' // ') AND lower(regexp_replace(query, '\s+/\s+', ' // ', 'g')) = lower(name)),
b AS (SELECT query, min((stage, rank, digital)) AS b FROM h GROUP BY query),
k AS (SELECT query, min(stage) AS stage, count(DISTINCT id) AS n, min(id) AS id, string_agg(card_name, '|' ORDER BY id) AS c FROM (SELECT DISTINCT query, h.stage, h.id, h.card_name FROM h JOIN b USING (query) WHERE (stage, rank, digital) = b) GROUP BY query)
"""
_RESOLVE = RESOLVE_CTE + """SELECT query, CASE WHEN n IS NULL THEN 'unknown' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN id END AS id, CASE WHEN n > 1 THEN c END AS candidates, stage FROM q LEFT JOIN k USING (query)"""
_PARTS = """WITH q AS (SELECT DISTINCT upper(p_name) AS query FROM part UNION SELECT p_name FROM part),
h AS (SELECT query, (query <> p_name)::INT AS stage, p_size > 25 AS digital, p_partkey AS id FROM q JOIN part ON lower(query) = lower(p_name)),
b AS (SELECT query, min((stage, digital)) AS b FROM h GROUP BY 1), k AS (SELECT query, min(stage) AS stage, count(*) AS n, min(id) AS id FROM h JOIN b USING (query) WHERE (stage, digital) = b GROUP BY 1)
SELECT query, CASE WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN id END AS id, CASE WHEN n > 1 THEN n END AS n, stage FROM k"""
#: The forms of the terms asked for; all have one stem.
_TERMS = {"pair": "pair(s|ed|ing|ings)?", "went": "wents?", "late": "late(s|d|ly|ness)?", "control": "control(s|led|ling|ler|lers|lings)?", "deck": "deck(s|ed|ing|er|ers|ings)?", "zebra": "zebras?"}
_TF = ", ".join(f"len(list_filter(w, lambda x: regexp_full_match(x, '{form}'))) AS {term}" for term, form in _TERMS.items())


def _ranked(name, terms):
    n = " + ".join(f"({t} > 0)::INT" for t in terms)
    score = " + ".join(f"CASE WHEN {t} > 0 THEN {t} / ({t} + length / 100.0::DOUBLE) ELSE 0 END" for t in terms)
    hits = f"(SELECT key, {n} AS n_terms, round({score}, 6) AS score FROM tf WHERE {n} > 0)"
    return f"(SELECT key, n_terms, score, CASE WHEN most = {len(terms)} THEN 'all' ELSE 'any' END AS mode, '{name}' AS q FROM (SELECT *, max(n_terms) OVER () AS most FROM {hits}) WHERE most < {len(terms)} OR n_terms = {len(terms)} ORDER BY score DESC, key LIMIT 12)"


_RANKED = f"""WITH t AS (SELECT doc_id AS key, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN ({", ".join(repr(w) for w in T.STOP_WORDS)})) AS w FROM documents), tf AS (SELECT key, len(w) AS length, {_TF} FROM t)
SELECT * FROM {_ranked("all", ["pair", "went", "late", "control", "deck"])} UNION ALL SELECT * FROM {_ranked("any", ["pair", "zebra"])}"""
_MATCH = r"""WITH v AS (SELECT DISTINCT card_name AS value FROM limited_card_stats WHERE card_name IS NOT NULL), c AS (SELECT DISTINCT card_name, split_part(card_name, ' // ', 1) AS front FROM mtg_cards_v2),
k AS (SELECT value, CASE WHEN value LIKE 'A-%' THEN substr(value, 3) END AS plain, CASE WHEN contains(value, '?') THEN regexp_replace(value, '[^\x00-\x7f]|\?', '?', 'g') END AS marked FROM v),
m AS (SELECT card_name, regexp_replace(card_name, '[^\x00-\x7f]|\?', '?', 'g') AS marked FROM c WHERE regexp_matches(card_name, '[^\x00-\x7f]') UNION SELECT card_name, regexp_replace(front, '[^\x00-\x7f]|\?', '?', 'g') FROM c WHERE regexp_matches(front, '[^\x00-\x7f]')),
h AS (SELECT value, card_name, 1 AS stage FROM k JOIN c ON value = card_name UNION SELECT value, card_name, 2 FROM k JOIN c ON value = front UNION SELECT value, card_name, 3 FROM k JOIN c ON lower(value) = lower(card_name) UNION SELECT value, card_name, 4 FROM k JOIN c ON lower(value) = lower(front)
  UNION SELECT value, card_name, 5 FROM k JOIN c ON plain = card_name UNION SELECT value, card_name, 6 FROM k JOIN c ON plain = front UNION SELECT value, card_name, 7 FROM k JOIN m USING (marked)),
g AS (SELECT value, stage, min(card_name) AS name, count(*) AS n FROM h GROUP BY ALL), b AS (SELECT value, arg_min(name, stage) AS name, min(stage) AS stage FROM g WHERE stage < 7 OR n = 1 GROUP BY 1)
SELECT value, name AS db_name, CASE WHEN stage IS NULL THEN 'none' WHEN stage IN (1, 3, 5) THEN 'exact' WHEN stage = 7 THEN 'mojibake' ELSE 'front' END AS match_kind FROM v LEFT JOIN b USING (value)"""
_FORM = "regexp_replace(lower({0}), '" + T.MARKS.replace("{", "{{").replace("}", "}}") + "', '', 'g')"
_WORDS_OF = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"
_IN_SET = rf"""WITH q0 AS (SELECT DISTINCT expansion, card_name AS query FROM limited_card_stats WHERE db_card_name IS NULL AND card_name IS NOT NULL), e AS (SELECT DISTINCT expansion, db_card_name AS key FROM limited_card_stats WHERE db_card_name IS NOT NULL),
n0 AS (SELECT DISTINCT expansion, key, unnest([card_name, japanese_name, name_en_front, name_en_back]) AS name FROM e JOIN mtg_cards_v2 ON card_name = key),
q AS (SELECT *, NOT regexp_matches(qf, '[^\x00-\x7f]') AS plain, CASE WHEN plain THEN list_filter(qw, lambda w: length(w) > 1) ELSE list_filter(list_transform(regexp_split_to_array(query, '\s+'), lambda p: {_FORM.format('p')}), lambda p: length(p) > 1) END AS parts, ' ' || array_to_string(qw, ' ') || ' ' AS qr
  FROM (SELECT *, {_FORM.format('query')} AS qf, {_WORDS_OF.format('query')} AS qw FROM q0) WHERE qf <> ''),
n AS (SELECT *, ' ' || array_to_string(nw, ' ') || ' ' AS nr FROM (SELECT *, {_FORM.format('name')} AS nf, {_WORDS_OF.format('name')} AS nw FROM n0 WHERE name IS NOT NULL) WHERE nf <> ''),
p AS (SELECT q.expansion, query, key, qf, nf, plain, parts, nw, CASE WHEN plain THEN len(qw) > 0 AND contains(nr, qr) ELSE length(qf) > 1 AND contains(nf, qf) END AS inside, CASE WHEN plain THEN len(nw) > 0 AND contains(qr, nr) ELSE length(nf) > 1 AND contains(qf, nf) END AS around,
  len(list_filter(parts, lambda x: CASE WHEN plain THEN list_contains(nw, x) ELSE contains(nf, x) END)) AS found FROM q JOIN n ON n.expansion = q.expansion),
s AS (SELECT expansion, query, key, round(max(CASE WHEN qf = nf THEN 1.0 WHEN inside THEN CASE WHEN length(qf) <= 3 THEN 0.6 ELSE 0.9 END WHEN length(qf) <= 3 THEN 0.0 WHEN around THEN 0.85 WHEN len(parts) > 1 AND found > 0 THEN 0.5 + 0.3 * found / len(parts) ELSE 0.0 END::DOUBLE), 6) AS score FROM p GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY expansion, query ORDER BY score DESC, key) AS place FROM s WHERE score >= 0.5), l AS (SELECT *, min(CASE WHEN place <= 3 THEN score END) OVER (PARTITION BY expansion, query) AS last FROM k)
SELECT expansion, query, key, score, place, ties_left FROM (SELECT *, count(*) FILTER (place > 3 AND score = last) OVER (PARTITION BY expansion, query) AS ties_left FROM l) WHERE place <= 3"""
ORACLE = {
    "d17_links": _LINK,
    "d18_aliases": _ALIASES,
    "d19_resolve": _RESOLVE,
    "d19_resolve_parts": _PARTS,
    "d20_bilingual": "SELECT name, count(DISTINCT id) AS n, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS id FROM (SELECT id, unnest([card_name, japanese_name, name_en_front, name_ja_front, name_en_back, name_ja_back]) AS name FROM mtg_cards_v2) WHERE name IS NOT NULL GROUP BY 1",
    "d21_display": "SELECT id, CASE WHEN japanese_name IS NULL THEN card_name ELSE '《' || japanese_name || '/' || card_name || '》' END AS display FROM mtg_cards_v2",
    "d23_near_by_trigrams": NEAR_SQL,
    "f_trigrams": f"SELECT a, b, round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 6) AS similarity FROM (SELECT DISTINCT p_name AS a, {_TRI.format('p_name')} AS x FROM part) JOIN (SELECT DISTINCT p_name AS b, {_TRI.format('p_name')} AS y FROM part) ON a < b AND len(list_intersect(x, y)) > 0",
    "d27_text": _RANKED,
    "d24_match": _MATCH,
    "d23_in_set": _IN_SET,
    "d25_terms": D25_TEXT_SQL,
    "d27_number": "SELECT p_partkey, number FROM (SELECT p_partkey, (p_size % 20) || ['', '.3', 'a', '0', '.3b'][(p_partkey % 5 + 1)::INT] AS number FROM part) WHERE regexp_full_match(number, '12(\\.\\d+[a-z]?|[a-z])?')",
    "f_text_tools": "SELECT id, coalesce(contains(' ' || trim(regexp_replace(lower(oracle_text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ', ' each rival '), NULL) AS run, card_name AS bare, coalesce(regexp_matches(japanese_name, '[ぁ-んァ-ン一-龯]'), false) AS ja, japanese_name AS no_ruby, card_name || ' <b>' AS unescaped, " + _FORM.format("card_name") + " AS form FROM mtg_cards_v2",
}
