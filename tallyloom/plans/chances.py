"""Queries for draw probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.common import load, reach_workers
from tallyloom.functions import probability as P


def _cases(s, d):
    """Draw problems made of the rows of ``part``: deck size, hits, draws, wanted."""
    p = load(s, d, "part")
    n = (F.col("p_size") * 3 + 40).alias("n")
    return p.select("p_partkey", n, (F.col("p_partkey") % 25).cast("int").alias("k"), (F.col("p_partkey") % 11 - 1).cast("int").alias("d"), (F.col("p_partkey") % 5 - 1).cast("int").alias("m"))


_CASES = "(SELECT p_partkey, p_size * 3 + 40 AS n, (p_partkey % 25)::INT AS k, (p_partkey % 11 - 1)::INT AS d, (p_partkey % 5 - 1)::INT AS m FROM part)"
_C = "(CASE WHEN {1} < 0 OR {1} > {0} THEN 0.0::DOUBLE ELSE coalesce((SELECT product(({0} - {1} + j)::DOUBLE / j) FROM generate_series(1, {1}) t(j)), 1.0) END)"


def _c(n, k):
    return _C.format(n, k)


def probabilities(s, d):
    n, k, dd, m = (F.col(x) for x in "nkdm")
    return _cases(s, d).select("p_partkey", P.hypergeom_exact(n, k, dd, m).alias("p_exact"), P.hypergeom_atleast(n, k, dd, m).alias("p_atleast"))


_EXACT = f"CASE WHEN d < 0 THEN NULL WHEN m < 0 OR m > d OR m > k OR d - m > n - k THEN 0.0 ELSE round({_c('k', 'm')} * {_c('(n - k)', '(d - m)')} / {_c('n', 'd')}, 6) END"
_AT = f"CASE WHEN d < 0 THEN NULL WHEN m <= 0 THEN 1.0 ELSE round((SELECT coalesce(sum({_c('k', 'i')} * {_c('(n - k)', '(d - i)')}), 0) FROM generate_series(m, least(k, d)) u(i)) / {_c('n', 'd')}, 6) END"


def turn_functions(s, d):
    c = _cases(s, d)
    turn, play, mull, deck = (F.col("p_partkey") % 12).cast("int"), F.col("p_partkey") % 2 == 0, (F.col("p_partkey") % 3).cast("int"), F.col("n")
    return c.select("p_partkey", P.cards_seen(turn, play, mull).alias("seen"), P.prob_by_turn(deck, F.col("k"), turn, play, F.lit(1), mull).alias("by_turn"), P.land_drops(deck, F.col("k"), turn, play, mull).alias("drops"), P.combo_by_turn(deck, F.lit(4), F.lit(4), turn, play, mull).alias("combo"))


def vary_grid(s, d):
    """A grid of two varied arguments, with the result of each combination."""
    g = P.grid(s, {"copies": [1, 2, 3, 4], "turn": [1, 3, 5]})
    return g.withColumn("p", P.prob_by_turn(F.lit(60), F.col("copies"), F.col("turn"), F.lit(True), F.lit(1), F.lit(0)))


def vary_table(s, d):
    return P.grid_table(vary_grid(s, d), "copies", "turn", "p", [1, 3, 5]).select("copies", F.col("1").alias("turn_1"), F.col("3").alias("turn_3"), F.col("5").alias("turn_5"))


def vary_lines(s, d):
    """Grids of one, two and three arguments as markdown."""
    out = None
    for n, vary in enumerate(({"turn": [2, 1, 5]}, {"copies": [4, 1], "turn": [1, 3, 5]}, {"copies": [1, 4], "turn": [1, 3], "deck": [60, 40]})):
        g = P.grid(s, vary)
        args = {"copies": F.lit(4), "turn": F.lit(1), "deck": F.lit(60)} | {k: F.col(k) for k in vary}
        lines = P.grid_markdown(g.withColumn("p", P.prob_by_turn(args["deck"], args["copies"], args["turn"], F.lit(True), F.lit(1), F.lit(0))), vary, "p").withColumn("grid_no", F.lit(n))
        out = lines if out is None else out.unionByName(lines)
    return out


def _mana_cases(s, d):
    """Mana problems made of all parts: three classes of sources, two ways to pay."""
    p = load(s, d, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    return p.select("p_partkey", (size % 4 + 6).alias("c1"), (key % 3 + 4).cast("int").alias("c2"), (size % 3).alias("c3"), (key % 2 + 1).cast("int").alias("w"), (key % 8 + 1).cast("int").alias("turn"), (key % 2 == 0).alias("on_play"), (size % 2).alias("mull"))


def castable_of_parts(s, d):
    c = F.col
    got = P.castable(F.lit(60), F.array("c1", "c2", "c3"), F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.array(c("w"), F.lit(1)), F.array(F.lit(2), F.lit(0))), F.array(F.lit(3), F.lit(4)), c("turn"), c("on_play"), c("mull"))
    return _mana_cases(s, d).select("p_partkey", got.alias("p"))


def hand_of_parts(s, d):
    c = F.col
    got = P.hand(F.lit(60), F.array(c("c1") + 14, c("c2")), F.array(c("w"), F.lit(1)), F.array(c("w") + 3, F.lit(3)), c("turn") - 1, c("on_play"), c("mull"))
    return _mana_cases(s, d).select("p_partkey", got.alias("p"))


def _sql(text):
    def run(s, d):
        reach_workers(s)
        P.register_sql(s)
        _cases(s, d).createOrReplaceTempView("draw_cases")
        _mana_cases(s, d).createOrReplaceTempView("mana_cases")
        return s.sql(text)

    return run


def chance_calls(s, d):
    """Calls of every kind with good and bad arguments, made of all parts."""
    k = F.col("p_partkey")
    kinds = F.array(*[F.lit(x) for x in (*P.KINDS, "odds")])
    return load(s, d, "part").select(
        "p_partkey", F.element_at(kinds, (k % 5 + 1).cast("int")).alias("kind"), F.when(k % 97 == 0, 501).otherwise(F.col("p_size") + 20).alias("deck_size"), (k % 23).cast("int").alias("copies"), (F.col("p_size") % 31).alias("copies_b"),
        (k % 13).cast("int").alias("draws"), (k % 17).cast("int").alias("turn"), (k % 2 == 0).alias("on_play"), (k % 4).cast("int").alias("at_least"), F.when(k % 89 == 0, None).otherwise((k % 3).cast("int")).alias("mulligans"),
    )


def chances_answered(s, d):
    return P.answer_chances(chance_calls(s, d)).select("p_partkey", "kind", "status", "cards_seen", "probability", "percent")


_GRID = "(SELECT 3 * (copies - 1) + (turn - 1) // 2 AS row_no, copies, turn, round(1 - (SELECT product((60 - copies - j)::DOUBLE / (60 - j)) FROM generate_series(0, 6 + turn - 1) t(j)), 6) AS p FROM (VALUES (1), (2), (3), (4)) a(copies), (VALUES (1), (3), (5)) b(turn))"
QUERIES = {
    "f_hypergeometric": probabilities,
    "f_by_turn": turn_functions,
    "f_vary_grid": vary_grid,
    "d59_vary_table": vary_table,
    "d59_vary_lines": vary_lines,
    "f_castable": castable_of_parts,
    "f_hand": hand_of_parts,
    "f_chances": chances_answered,
    "u_comb": _sql("SELECT p_partkey, mtg_comb(k, m) AS ways FROM draw_cases"),
    "u_hypergeom_exact": _sql("SELECT p_partkey, mtg_hypergeom_exact(n, k, d, m) AS p FROM draw_cases"),
    "u_hypergeom_atleast": _sql("SELECT p_partkey, mtg_hypergeom_atleast(n, k, d, m) AS p FROM draw_cases"),
    "u_cards_seen": _sql("SELECT p_partkey, mtg_cards_seen(CAST(p_partkey % 12 AS INT), p_partkey % 2 = 0, CAST(p_partkey % 3 AS INT)) AS seen FROM draw_cases"),
    "u_prob_by_turn": _sql("SELECT p_partkey, mtg_prob_by_turn(n, k, CAST(p_partkey % 12 AS INT), p_partkey % 2 = 0, 1, CAST(p_partkey % 3 AS INT)) AS p FROM draw_cases"),
    "u_land_drops": _sql("SELECT p_partkey, mtg_land_drops(n, k, CAST(p_partkey % 12 AS INT), p_partkey % 2 = 0, CAST(p_partkey % 3 AS INT)) AS p FROM draw_cases"),
    "u_combo_by_turn": _sql("SELECT p_partkey, mtg_combo_by_turn(n, 4, 4, CAST(p_partkey % 12 AS INT), p_partkey % 2 = 0, CAST(p_partkey % 3 AS INT)) AS p FROM draw_cases"),
    "u_int_array_ok": _sql("SELECT p_partkey, mtg_int_array_ok(array(k, d, m), 3) AS ok, mtg_int_array_ok(array(k, NULL), 2) AS with_null, mtg_int_array_ok(array(k), 2) AS short FROM draw_cases"),
    "u_castable": _sql("SELECT p_partkey, mtg_castable(60, array(c1, c2, c3), array(1, 2, 3), array(array(w, 1), array(2, 0)), array(3, 4), turn, on_play, mull) AS p FROM mana_cases"),
    "u_hand_prob": _sql("SELECT p_partkey, mtg_hand_prob(60, array(c1 + 14, c2), array(w, 1), array(w + 3, 3), turn - 1, on_play, mull) AS p FROM mana_cases"),
}
_T = "(p_partkey % 12)::INT"
_SEEN = f"(7 - (p_partkey % 3)::INT + greatest({_T} - CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END, 0))"
_D = f"least({_SEEN}, n)"


def _sum(m):
    return f"round((SELECT coalesce(sum({_c('k', 'i')} * {_c('(n - k)', '(dd - i)')}), 0) FROM generate_series({m}, least(k, dd)) u(i)) / {_c('n', 'dd')}, 6)"


_MANA = "(SELECT p_partkey, p_size % 4 + 6 AS c1, (p_partkey % 3 + 4)::INT AS c2, p_size % 3 AS c3, (p_partkey % 2 + 1)::INT AS w, (p_partkey % 8 + 1)::INT AS turn, p_partkey % 2 = 0 AS on_play, p_size % 2 AS mull FROM part)"


def _lc(n, k):
    return f"exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1))"


_CASTABLE = f"""WITH q AS {_MANA}, a AS (SELECT DISTINCT c1, c2, c3, w, turn, on_play, mull, 7 - mull + greatest(turn - CASE WHEN on_play THEN 1 ELSE 0 END, 0) AS d FROM q),
x AS (SELECT a.*, x1, x2, x3, d - x1 - x2 - x3 AS y, 60 - c1 - c2 - c3 AS o FROM a, generate_series(0, 9) u(x1), generate_series(0, 6) v(x2), generate_series(0, 2) z(x3) WHERE x1 <= c1 AND x2 <= c2 AND x3 <= c3 AND x1 + x2 + x3 <= d),
g AS (SELECT c1, c2, c3, w, turn, on_play, mull, sum({_lc('c1', 'x1')} * {_lc('c2', 'x2')} * {_lc('c3', 'x3')} * {_lc('o', 'y')} / {_lc('60', 'd')}) AS p FROM x WHERE y <= o AND (
  least(x1 + x2 + x3, turn) >= 3 AND x1 + x3 >= w AND x2 + x3 >= 1 AND x1 + x2 + x3 >= w + 1 OR least(x1 + x2 + x3, turn) >= 4 AND x1 + x3 >= 2) GROUP BY ALL)
SELECT p_partkey, round(coalesce(p, 0), 6) AS p FROM q LEFT JOIN g USING (c1, c2, c3, w, turn, on_play, mull)"""
_HAND = f"""WITH q AS {_MANA}, a AS (SELECT DISTINCT c1, c2, w, turn, on_play, mull, CASE WHEN turn = 1 THEN 7 - mull ELSE 7 - mull + greatest(turn - 1 - CASE WHEN on_play THEN 1 ELSE 0 END, 0) END AS d FROM q),
x AS (SELECT a.*, x1, x2, d - x1 - x2 AS y, 60 - c1 - 14 - c2 AS o FROM a, generate_series(1, 5) u(x1), generate_series(1, 3) v(x2) WHERE x1 BETWEEN w AND w + 3 AND x1 <= c1 + 14 AND x2 <= c2 AND x1 + x2 <= d),
g AS (SELECT c1, c2, w, turn, on_play, mull, sum({_lc('(c1 + 14)', 'x1')} * {_lc('c2', 'x2')} * {_lc('o', 'y')} / {_lc('60', 'd')}) AS p FROM x WHERE y <= o GROUP BY ALL)
SELECT p_partkey, round(coalesce(p, 0), 6) AS p FROM q LEFT JOIN g USING (c1, c2, w, turn, on_play, mull)"""
_BY = f"(SELECT p_partkey, {_SEEN} AS seen, {_sum('1')} AS by_turn, CASE WHEN {_T} <= 0 THEN 1.0 ELSE {_sum('t')} END AS drops, round(1 - ({_c('(n - 4)', 'dd')} * 2 - {_c('(n - 8)', 'dd')}) / {_c('n', 'dd')}, 6) AS combo FROM (SELECT *, {_D} AS dd, {_T} AS t FROM {_CASES}))"
_CALLS = """(SELECT p_partkey, ['at_least', 'by_turn', 'land_drops', 'combo_by_turn', 'odds'][(p_partkey % 5 + 1)::INT] AS kind, CASE WHEN p_partkey % 97 = 0 THEN 501 ELSE p_size + 20 END AS n, (p_partkey % 23)::INT AS k, p_size % 31 AS b,
  (p_partkey % 13)::INT AS draws, (p_partkey % 17)::INT AS turn, p_partkey % 2 = 0 AS on_play, (p_partkey % 4)::INT AS at_least, CASE WHEN p_partkey % 89 = 0 THEN NULL ELSE (p_partkey % 3)::INT END AS mull FROM part)"""
_LEAST = f"CASE WHEN wanted <= 0 THEN 1.0 ELSE (SELECT coalesce(sum({_lc('k', 'i')} * {_lc('(n - k)', '(dd - i)')} / {_lc('n', 'dd')}), 0) FROM generate_series(wanted, least(k, dd)) u(i) WHERE dd - i <= n - k) END"
_CHANCES = f"""WITH c AS (SELECT *, coalesce(n BETWEEN 1 AND 500 AND k BETWEEN 0 AND n AND b BETWEEN 0 AND n AND draws BETWEEN 0 AND n AND turn BETWEEN 1 AND 60 AND at_least BETWEEN 0 AND n AND mull BETWEEN 0 AND 6, false) AS fine,
  CASE kind WHEN 'at_least' THEN draws ELSE 7 - mull + greatest(turn - CASE WHEN on_play THEN 1 ELSE 0 END, 0) END AS seen, CASE kind WHEN 'land_drops' THEN turn ELSE at_least END AS wanted FROM {_CALLS}),
v AS (SELECT *, least(seen, n) AS dd FROM c WHERE kind <> 'odds' AND fine),
p AS (SELECT p_partkey, round(CASE WHEN kind <> 'combo_by_turn' THEN {_LEAST} WHEN k + b > n THEN NULL
  ELSE 1 - ({_c('(n - k)', 'dd')} + {_c('(n - b)', 'dd')} - {_c('(n - k - b)', 'dd')}) / {_c('n', 'dd')} END, 6) AS p FROM v)
SELECT c.p_partkey, kind, CASE WHEN kind = 'odds' THEN 'unknown kind' WHEN NOT fine THEN 'out of range' WHEN p IS NULL THEN 'undefined' ELSE 'ok' END AS status, CASE WHEN p IS NOT NULL THEN seen END AS cards_seen, round(p::DECIMAL(10, 6), 4)::DOUBLE AS probability, printf('%.1f%%', round(p * 100, 1)) AS percent
FROM c LEFT JOIN p ON p.p_partkey = c.p_partkey"""
_LINES = """WITH g AS (SELECT * FROM (VALUES {0}) v(grid_no, table_no, line_no, line)) SELECT * FROM g"""


def _chance(copies, turn, deck):
    """Percent of drawing one of ``copies`` by a turn on the play, for the expected lines."""
    from math import comb

    return f"{100 * round(1 - comb(deck - copies, 6 + turn) / comb(deck, 6 + turn), 6):.1f}%"


def _expected_lines():
    rows = [(0, 0, 0, "| turn | p |"), (0, 0, 1, "| --- | --- |")] + [(0, 0, i + 2, f"| {t} | {_chance(4, t, 60)} |") for i, t in enumerate((2, 1, 5))]
    rows += [(1, 0, 0, "| copies \\ turn | 1 | 3 | 5 |"), (1, 0, 1, "| --- | --- | --- | --- |")] + [(1, 0, i + 2, "| " + " | ".join([str(c), *[_chance(c, t, 60) for t in (1, 3, 5)]]) + " |") for i, c in enumerate((4, 1))]
    for k, deck in enumerate((60, 40)):
        rows += [(2, k, 0, f"| copies \\ turn (deck = {deck}) | 1 | 3 |"), (2, k, 1, "| --- | --- | --- |")] + [(2, k, i + 2, "| " + " | ".join([str(c), *[_chance(c, t, deck) for t in (1, 3)]]) + " |") for i, c in enumerate((1, 4))]
    return _LINES.format(", ".join(str(r) if "\\" not in r[3] else f"({r[0]}, {r[1]}, {r[2]}, '{r[3]}')" for r in rows))


ORACLE = {
    "f_castable": _CASTABLE,
    "u_castable": _CASTABLE,
    "f_hand": _HAND,
    "u_hand_prob": _HAND,
    "f_chances": _CHANCES,
    "d59_vary_lines": _expected_lines(),
    "u_comb": f"SELECT p_partkey, {_c('k', 'm')} AS ways FROM {_CASES}",
    "u_hypergeom_exact": f"SELECT p_partkey, {_EXACT} AS p FROM {_CASES}",
    "u_hypergeom_atleast": f"SELECT p_partkey, {_AT} AS p FROM {_CASES}",
    "u_cards_seen": f"SELECT p_partkey, seen FROM {_BY}",
    "u_prob_by_turn": f"SELECT p_partkey, by_turn AS p FROM {_BY}",
    "u_land_drops": f"SELECT p_partkey, drops AS p FROM {_BY}",
    "u_combo_by_turn": f"SELECT p_partkey, combo AS p FROM {_BY}",
    "u_int_array_ok": f"SELECT p_partkey, d >= 0 AND m >= 0 AS ok, false AS with_null, false AS short FROM {_CASES}",
    "f_hypergeometric": f"SELECT p_partkey, {_EXACT} AS p_exact, {_AT} AS p_atleast FROM {_CASES}",
    "f_by_turn": f"SELECT p_partkey, {_SEEN} AS seen, {_sum('1')} AS by_turn, CASE WHEN {_T} <= 0 THEN 1.0 ELSE {_sum('t')} END AS drops, round(1 - ({_c('(n - 4)', 'dd')} * 2 - {_c('(n - 8)', 'dd')}) / {_c('n', 'dd')}, 6) AS combo FROM (SELECT *, {_D} AS dd, {_T} AS t FROM {_CASES})",
    "f_vary_grid": f"SELECT * FROM {_GRID}",
    "d59_vary_table": f"SELECT copies, max(p) FILTER (turn = 1) AS turn_1, max(p) FILTER (turn = 3) AS turn_3, max(p) FILTER (turn = 5) AS turn_5 FROM {_GRID} GROUP BY copies",
}
