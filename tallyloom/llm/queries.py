"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.common import at_once, current_rows, load, squash
from tallyloom.llm.formatting import hidden_duplicates, payload_fields
from tallyloom.llm.containers import fill_containers, fill_report, token_count
from tallyloom.llm.languages import document_languages, fit_languages, language_segments, stated_language
from tallyloom.llm.leaks import leaked_items
from tallyloom.llm.names import resolve_names
from tallyloom.llm.together import associations, associations_given, lift_at_least
from tallyloom.llm.topn import top_items
from tallyloom.session import checkpoint_dir

SQUASH = r"lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"


def _sq(column: str) -> str:
    return SQUASH.format(column)


# 2: duplicates hidden by formatting


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists, cards, raw = (load(spark, sf_dir, t) for t in ("deck_list", "deck_cards", "raw_deck_lines"))
    fields = {k: squash(v) for k, v in payload_fields(F.col("payload"), ("card_name", "count", "board", "source")).items()}
    deck, line, received = at_once(
        spark,
        lambda: hidden_duplicates(spark, lists, "id", {"source": squash("source"), "deck_name": squash("deck_name"), "tournament_date": F.col("tournament_date"), "placement": F.col("placement")}),
        lambda: hidden_duplicates(spark, cards, "id", {"deck_id": F.col("deck_id"), "card_name": squash("card_name"), "board": squash("board"), "count": F.col("count")}),
        lambda: hidden_duplicates(spark, raw, "line_id", {"deck_id": F.col("deck_id"), **fields}),
    )
    named = [d.select(F.lit(n).alias("table_name"), "keep_id", "copy_id") for n, d in (("deck_list", deck), ("deck_cards", line), ("raw_deck_lines", received))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def p2_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of copies of each record that has any."""
    return p2_found(spark, sf_dir).groupBy("table_name", "keep_id").agg((F.count(F.lit(1)) + 1).alias("n_copies"))


def _groups_sql(table: str, row_id: str, keys: list[str], source: str) -> str:
    return f"""SELECT '{table}' AS table_name, keep_id::BIGINT AS keep_id, copy_id::BIGINT AS copy_id FROM (
  SELECT {row_id} AS copy_id, min({row_id}) OVER (PARTITION BY {', '.join(keys)}) AS keep_id FROM {source}) WHERE copy_id <> keep_id"""


_RAW = f"""(
  SELECT line_id, deck_id, {', '.join(f"{_sq('max(v) FILTER (k = ' + repr(n) + ')')} AS {n}" for n in ('cardname', 'count', 'board', 'source'))}
  FROM (SELECT line_id, deck_id, {_sq('key')} AS k, payload->>key AS v FROM (SELECT *, unnest(json_keys(payload)) AS key FROM raw_deck_lines WHERE trim(payload) LIKE '{{%')
        UNION ALL
        SELECT line_id, deck_id, {_sq("split_part(part, '=', 1)")}, substr(part, strpos(part, '=') + 1) FROM (SELECT *, unnest(regexp_split_to_array(payload, '[;|]')) AS part FROM raw_deck_lines WHERE trim(payload) NOT LIKE '{{%'))
  GROUP BY line_id, deck_id)"""
P2_SQL = " UNION ALL ".join(
    (
        _groups_sql("deck_list", "id", [_sq("source"), _sq("deck_name"), "tournament_date", "placement"], "deck_list"),
        _groups_sql("deck_cards", "id", ["deck_id", _sq("card_name"), _sq("board"), '"count"'], "deck_cards"),
        _groups_sql("raw_deck_lines", "line_id", ["deck_id", "cardname", '"count"', "board", "source"], _RAW),
    )
)

# 4: free names to the canonical list

ALIASES = ("name_en_front", "name_en_back", "name_ja_front", "name_ja_back", "card_name", "japanese_name")


def p4_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct name without a card, the card meant and how it was found."""
    open_ = load(spark, sf_dir, "limited_card_stats").where(F.col("db_card_name").isNull())
    cards = load(spark, sf_dir, "mtg_cards_v2")
    got = resolve_names(open_, "card_name", cards, "id", ALIASES)
    return got.select(F.col("value").alias("card_name"), F.col("entry_id").cast("int").alias("card_id"), "match_kind", "similarity")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = load(spark, sf_dir, "limited_card_stats").where(F.col("db_card_name").isNull()).select("expansion", "event_type", "card_name").distinct()
    got = p4_names(spark, sf_dir).select(F.col("card_name").alias("name"), "card_id")
    return keys.join(got, keys["card_name"].eqNullSafe(got["name"])).select("expansion", "event_type", "card_name", "card_id")


# 5: top items in every group


def p5_found(spark: SparkSession, sf_dir: str, n: int = 3) -> DataFrame:
    rows = load(spark, sf_dir, "card_cooccurrence_v2").where("snapshot_no = 4")
    now = current_rows(rows, ["population_id", "relation", "card_id_a", "card_id_b"], "cooccurrence_count", "loaded_at")
    top = top_items(now, ["population_id", "relation", "card_id_a"], "cooccurrence_count", "card_id_b", n, distinct=False)
    return top.select("population_id", "relation", "card_id_a", "card_id_b")


_CURRENT = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY loaded_at DESC) AS rn FROM {table} WHERE snapshot_no = 4) WHERE rn = 1)"""
_PAIRS = _CURRENT.format(keys="population_id, relation, card_id_a, card_id_b", table="card_cooccurrence_v2")
_COUNTS = _CURRENT.format(keys="population_id, card_id", table="card_population_deck_counts")
P5_SQL = f"""SELECT population_id, relation, card_id_a, card_id_b FROM (
  SELECT *, row_number() OVER (PARTITION BY population_id, relation, card_id_a ORDER BY cooccurrence_count DESC, card_id_b) AS place FROM {_PAIRS}) WHERE place <= 3"""

# 7: cards that appear together


def _main_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "deck_cards").where(squash("board") == "main").select("deck_id", squash("card_name").alias("key"))
    cards = load(spark, sf_dir, "mtg_cards_v2").select(F.col("id").alias("card_id"), squash("card_name").alias("key"))
    return lines.join(cards, "key").select("deck_id", "card_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    decks = associations(_main_cards(spark, sf_dir), "deck_id", "card_id", 5, 500, 3)
    one = decks.select(F.lit("decks").alias("scope"), F.lit(0).alias("population_id"), F.col("item_a").alias("card_id_a"), F.col("item_b").alias("card_id_b"))
    two = _population_pairs(spark, sf_dir).select(F.lit("population").alias("scope"), "population_id", F.col("item_a").alias("card_id_a"), F.col("item_b").alias("card_id_b"))
    return one.unionByName(two)


def _population_pairs(spark: SparkSession, sf_dir: str, least_n: int = 5, least_lift: int = 3) -> DataFrame:
    rows = load(spark, sf_dir, "card_cooccurrence_v2").where("snapshot_no = 4 AND relation = 'm'")
    pairs = current_rows(rows, ["population_id", "card_id_a", "card_id_b"], "cooccurrence_count", "loaded_at").where(F.col("cooccurrence_count") >= least_n)
    pairs = pairs.select("population_id", F.col("card_id_a").alias("item_a"), F.col("card_id_b").alias("item_b"), F.col("cooccurrence_count").alias("n"))
    counts = current_rows(load(spark, sf_dir, "card_population_deck_counts").where("snapshot_no = 4"), ["population_id", "card_id"], "main_deck_count", "loaded_at")
    counts = counts.select("population_id", F.col("card_id").alias("item"), F.col("main_deck_count").alias("m"))
    totals = load(spark, sf_dir, "cooccurrence_populations").select("population_id", F.col("deck_count").cast("bigint").alias("total"))
    scored = associations_given(pairs, counts, totals, ["population_id"])
    return scored.where(lift_at_least(F.col("n"), F.col("total"), F.col("m_a"), F.col("m_b"), least_lift))


def p7_deck_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of cards in main boards that share at least two decks, with counts and lift."""
    return associations(_main_cards(spark, sf_dir), "deck_id", "card_id", 2).withColumn("lift", F.round("lift", 6))


_DECK_PAIRS = f"""
WITH lines AS (SELECT DISTINCT deck_id, c.id AS card FROM deck_cards l JOIN mtg_cards_v2 c ON {_sq('l.card_name')} = {_sq('c.card_name')} WHERE {_sq('board')} = 'main'),
m AS (SELECT card, count(*) AS m FROM lines GROUP BY card), t AS (SELECT count(DISTINCT deck_id) AS total FROM lines),
p AS (SELECT a.card AS item_a, b.card AS item_b, count(*) AS n FROM lines a JOIN lines b ON a.deck_id = b.deck_id AND a.card < b.card GROUP BY ALL),
scored AS (SELECT item_a, item_b, n, x.m AS m_a, y.m AS m_b, total FROM p JOIN m x ON x.card = item_a JOIN m y ON y.card = item_b, t)"""
P7_SQL = f"""{_DECK_PAIRS}
SELECT 'decks' AS scope, 0 AS population_id, item_a AS card_id_a, item_b AS card_id_b FROM scored WHERE n >= 5 AND n * 500 >= total AND n * total >= 3 * m_a * m_b
UNION ALL
SELECT 'population', p.population_id, card_id_a, card_id_b FROM {_PAIRS} p
JOIN {_COUNTS} a ON a.population_id = p.population_id AND a.card_id = card_id_a JOIN {_COUNTS} b ON b.population_id = p.population_id AND b.card_id = card_id_b
JOIN cooccurrence_populations q ON q.population_id = p.population_id
WHERE relation = 'm' AND cooccurrence_count >= 5 AND cooccurrence_count::BIGINT * deck_count >= 3 * a.main_deck_count::BIGINT * b.main_deck_count"""

# 8: filling containers

CAPACITY = 2048


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of every text or piece of one."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("n_tokens"), token_count(F.col("text"))).alias("n"))
    return fill_containers(spark, docs, "doc_id", "n", CAPACITY)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p8_containers(spark, sf_dir), CAPACITY)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the packing had to split."""
    return p8_containers(spark, sf_dir).where("n_pieces > 1").select("doc_id").distinct()


_TOKENS = r"coalesce(n_tokens, len(regexp_extract_all(text, '[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]|[A-Za-z0-9\x{c0}-\x{24f}]+|[^\s\x{3000}\x{a0}\x{2000}-\x{200a}\x{202f}]')))"
P8_PACKING = f"""WITH d AS (SELECT doc_id, greatest({_TOKENS}, 0)::BIGINT AS n FROM documents)
SELECT doc_id, n AS tokens, greatest(ceil(n / 2048.0), 1)::BIGINT AS pieces, true AS good FROM d UNION ALL SELECT NULL, ceil(sum(n) / 2048.0)::BIGINT, 0, true FROM d"""
P8_SQL = f"SELECT doc_id FROM documents WHERE {_TOKENS} > 2048"

def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the packing, by document: all of its tokens are placed, in as few pieces as can be; and as one row for the whole, with document null."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("n_tokens"), token_count(F.col("text"))).alias("n"))
    checkpoint_dir(spark)
    filled = fill_containers(spark, docs, "doc_id", "n", CAPACITY).checkpoint()
    by_doc = filled.groupBy("doc_id").agg(F.sum("tokens").cast("bigint").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.lit(True).alias("good"))
    r = fill_report(filled, CAPACITY)
    # A container more than a hundredth above the least number, or an overfull one, is a failure.
    good = (F.col("max_fill") <= CAPACITY) & (F.col("n_containers") * 100 <= F.col("least_possible") * 101 + 100)
    whole = r.select(F.lit(None).cast("bigint").alias("doc_id"), F.col("least_possible").alias("tokens"), F.lit(0).cast("bigint").alias("pieces"), good.alias("good"))
    return by_doc.unionByName(whole)


# 9: evaluation texts in the corpus


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage of an item within two word edits."""
    return leaked_items(load(spark, sf_dir, "documents"), "doc_id", "text", load(spark, sf_dir, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).where("edits = 0 AND passage_words = 12").select("doc_id", "item_id")


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def _runs_sql(row_id: str, table: str) -> str:
    return f"SELECT {row_id}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS run FROM (SELECT {row_id}, {_WORDS} AS w FROM {table})"


P9_SQL = f"SELECT DISTINCT doc_id, item_id FROM ({_runs_sql('doc_id', 'documents')}) d JOIN ({_runs_sql('item_id', 'eval_items')}) e ON d.run = e.run"

def p9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks without edits of items of any length, the short ones included, with the longest passage."""
    return p9_leaks(spark, sf_dir).where("edits = 0").select("doc_id", "item_id", "passage_words")


_SHORT = f"(SELECT item_id, ' ' || array_to_string(w, ' ') || ' ' AS run, len(w) AS n FROM (SELECT item_id, {_WORDS} AS w FROM eval_items) WHERE len(w) BETWEEN 1 AND 11)"
P9_EXACT = f"""WITH f AS ({P9_SQL}), s AS (SELECT doc_id, item_id, n FROM (SELECT doc_id, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS body FROM documents) JOIN {_SHORT} ON contains(body, run))
SELECT doc_id, item_id, 12 AS passage_words FROM f UNION ALL SELECT doc_id, item_id, n FROM s"""

# 10: language labels


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of every document with their language and confidence."""
    documents, checked = load(spark, sf_dir, "documents"), load(spark, sf_dir, "doc_labels")
    return language_segments(documents, fit_languages(documents, checked))


def p10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_languages(p10_segments(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), stated_language(F.col("lang")).alias("stated"))
    found = p10_segments(spark, sf_dir).where(F.col("lang").isNotNull()).select("doc_id", "lang").distinct()
    return found.join(stated, F.col("doc_id") == F.col("id")).where(~F.col("stated").eqNullSafe(F.col("lang"))).select("doc_id", "lang")


def p10_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the main languages of the documents agree with the hand-checked labels and, where these are stated, mostly with the stated ones."""
    found = p10_documents(spark, sf_dir).select("doc_id", "lang")
    checked = load(spark, sf_dir, "doc_labels").select("doc_id", F.col("lang_checked").alias("label"), F.lit("checked").alias("by"))
    stated = load(spark, sf_dir, "documents").select("doc_id", stated_language(F.col("lang")).alias("label"), F.lit("stated").alias("by")).where("label IS NOT NULL")
    both = checked.unionByName(stated).join(found, "doc_id", "left")
    share = F.avg((F.col("label") == F.coalesce("lang", F.lit(""))).cast("double"))
    return both.groupBy("by").agg(F.count(F.lit(1)).alias("n"), (share >= F.when(F.first("by") == "checked", 0.98).otherwise(0.8)).alias("agrees"))


P10_AGREEMENT = "SELECT 'checked' AS by, count(*) AS n, true AS agrees FROM doc_labels UNION ALL SELECT 'stated', count(*), true FROM documents WHERE trim(coalesce(lang, ''), ' ') <> '' AND NOT starts_with(lower(trim(lang, ' ')), 'und')"


def p4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that are, remarks aside, a card's name as it stands, but for case, accents and marks."""
    return p4_names(spark, sf_dir).where("match_kind = 'exact'").select("card_name", "card_id")


_BARE = r"regexp_replace(regexp_replace({0}, '\([^()]*\)|\[[^\[\]]*\]|\*[^*]*\*|^\s*\d+\s*[xX]?\s+', ' ', 'g'), '\([^()]*\)|\[[^\[\]]*\]|\*[^*]*\*|^\s*\d+\s*[xX]?\s+', ' ', 'g')"
#: Katakana parts from other scripts within a word, as a blank between them.
_KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({0})), '[^\p{{L}}\p{{N}}?]+', ' ', 'g'), '([ァ-ヺー])([^ァ-ヺー ])', '\1 \2', 'g'), '([^ァ-ヺー ])([ァ-ヺー])', '\1 \2', 'g'), ' ')"
_VISIBLE = r"regexp_replace(card_name, '[\p{Cf}]', '', 'g')"
P4_EXACT = f"""WITH a AS (SELECT {_KEY.format('n')} AS k, min(id) AS id FROM (SELECT id, unnest([{', '.join(ALIASES)}]) AS n FROM mtg_cards_v2) WHERE n IS NOT NULL GROUP BY 1),
v AS (SELECT DISTINCT card_name, {_KEY.format(_BARE.format(_VISIBLE))} AS k FROM limited_card_stats WHERE db_card_name IS NULL)
SELECT card_name, id AS card_id FROM v JOIN a USING (k) WHERE k <> ''"""

QUERIES = {
    "p2_found": p2_found,
    "p2_copies": p2_copies,
    "p4_found": p4_found,
    "p4_names": p4_names,
    "p4_exact": p4_exact,
    "p5_found": p5_found,
    "p7_found": p7_found,
    "p7_deck_pairs": p7_deck_pairs,
    "p8_found": p8_found,
    "p8_containers": p8_containers,
    "p8_report": p8_report,
    "p8_packing": p8_packing,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
    "p9_exact": p9_exact,
    "p10_found": p10_found,
    "p10_segments": p10_segments,
    "p10_documents": p10_documents,
    "p10_agreement": p10_agreement,
}
ORACLE = {
    "p4_exact": P4_EXACT,
    "p8_packing": P8_PACKING,
    "p9_exact": P9_EXACT,
    "p10_agreement": P10_AGREEMENT,
    "p2_found": P2_SQL,
    "p2_copies": f"SELECT table_name, keep_id, count(*) + 1 AS n_copies FROM ({P2_SQL}) GROUP BY ALL",
    "p5_found": P5_SQL,
    "p7_found": P7_SQL,
    "p8_found": P8_SQL,
    "p9_found": P9_SQL,
    "p7_deck_pairs": f"{_DECK_PAIRS} SELECT *, round(n::DOUBLE * total / (m_a::DOUBLE * m_b), 6) AS lift FROM scored WHERE n >= 2",
}
