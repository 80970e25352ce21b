"""Exact draw probabilities as native column expressions.

Each function builds one expression, so it inlines into any plan and needs no
Python per row. Counts of combinations are products of doubles, finite up to
C(500, 250) and exact to about 4e-16; results are rounded to six digits.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Draw vectors times alternatives beyond which an enumeration is refused (null).
MOST_WORK = 300_000


def comb(n: Column, k: Column) -> Column:
    """Ways to choose ``k`` of ``n``; 0 where ``k`` is negative or above ``n``."""
    small = F.least(k, n - k)
    product = F.aggregate(F.sequence(F.lit(1), F.greatest(small, F.lit(1))), F.lit(1.0), lambda a, j: a * (n - small + j) / j)
    return F.when(n.isNull() | k.isNull(), None).when((k < 0) | (k > n), F.lit(0.0)).when(small == 0, F.lit(1.0)).otherwise(product)


def _outside(n: Column, k: Column, d: Column) -> Column:
    return (n <= 0) | (d < 0) | (d > n) | (k < 0) | (k > n)


def _any_null(*columns: Column) -> Column:
    return reduce(lambda a, b: a | b, [c.isNull() for c in columns])


def hypergeom_exact(n: Column, k: Column, d: Column, m: Column) -> Column:
    """Chance of exactly ``m`` hits when ``d`` of ``n`` cards are drawn and ``k`` are hits; null outside the ranges."""
    p = F.round(comb(k, m) * comb(n - k, d - m) / comb(n, d), 6)
    return F.when(_any_null(n, k, d, m) | _outside(n, k, d), None).when((m < 0) | (m > d) | (m > k) | (d - m > n - k), F.lit(0.0)).otherwise(p)


def hypergeom_atleast(n: Column, k: Column, d: Column, m: Column) -> Column:
    """Chance of ``m`` hits or more; 1 where ``m`` is 0 or less."""
    top = F.least(k, d)
    hits = F.when(m <= top, F.sequence(F.greatest(m, F.lit(0)), F.greatest(top, F.greatest(m, F.lit(0))))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(hits, F.lit(0.0), lambda a, i: a + comb(k, i) * comb(n - k, d - i))
    return F.when(_any_null(n, k, d, m) | _outside(n, k, d), None).when(m <= 0, F.lit(1.0)).otherwise(F.round(total / comb(n, d), 6))


def cards_seen(turn: Column, on_play: Column, mulligans: Column) -> Column:
    """Cards seen by a turn: seven, less mulligans, and a draw per turn but the first on the play."""
    return F.lit(7) - mulligans + F.greatest(turn - F.when(on_play, 1).otherwise(0), F.lit(0))


def prob_by_turn(deck, copies, turn, on_play, m, mulligans) -> Column:
    return hypergeom_atleast(deck, copies, F.least(cards_seen(turn, on_play, mulligans), deck), m)


def land_drops(deck, lands, turn, on_play, mulligans) -> Column:
    return hypergeom_atleast(deck, lands, F.least(cards_seen(turn, on_play, mulligans), deck), turn)


def combo_by_turn(deck, a, b, turn, on_play, mulligans) -> Column:
    """Chance of one of each of two cards, by inclusion and exclusion; null where they exceed the deck."""
    d = F.least(cards_seen(turn, on_play, mulligans), deck)
    p = F.lit(1.0) - (comb(deck - a, d) + comb(deck - b, d) - comb(deck - a - b, d)) / comb(deck, d)
    return F.when(a + b > deck, None).otherwise(F.round(p, 6))


def _comb_sql(n: str, k: str) -> str:
    small = f"least({k}, {n} - ({k}))"
    product = f"aggregate(sequence(1, greatest({small}, 1)), 1D, (p, j) -> p * ({n} - {small} + j) / j)"
    return f"(CASE WHEN {k} < 0 OR {k} > {n} THEN 0D WHEN {small} = 0 THEN 1D ELSE {product} END)"


def _atleast_sql(n: str, k: str, d: str, m: str) -> str:
    hits = f"CASE WHEN {m} <= least({k}, {d}) THEN sequence(greatest({m}, 0), greatest({k}, {d}, {m}, 0)) ELSE array() END"
    total = f"aggregate({hits}, 0D, (t, i) -> t + CASE WHEN i <= least({k}, {d}) THEN {_comb_sql(k, 'i')} * {_comb_sql(f'({n} - {k})', f'({d} - i)')} ELSE 0D END)"
    return f"CASE WHEN {n} <= 0 OR {d} < 0 OR {d} > {n} OR {k} < 0 OR {k} > {n} THEN NULL WHEN {m} IS NULL THEN NULL WHEN {m} <= 0 THEN 1D ELSE round({total} / {_comb_sql(n, d)}, 6) END"


_SEEN_SQL = "(7 - mulligans + greatest(turn - CASE WHEN on_play THEN 1 ELSE 0 END, 0))"
_DRAWN_SQL = f"least({_SEEN_SQL}, deck)"
_TURN = ("turn INT", "on_play BOOLEAN", "mulligans INT DEFAULT 0")


def register_sql(spark: SparkSession, prefix: str = "mtg_") -> list[str]:
    """Registers all probability functions for SQL users under ``prefix``; gives their names.

    They take numbers only, never text that becomes SQL. Nested lambdas can't
    call SQL functions, so each is one expression with the sums written out.
    ``castable`` and ``hand_prob`` enumerate draws and are Arrow-batched.
    """
    exact = (
        "CASE WHEN n <= 0 OR d < 0 OR d > n OR k < 0 OR k > n THEN NULL WHEN m < 0 OR m > d OR m > k OR d - m > n - k THEN 0D "
        f"ELSE round({_comb_sql('k', 'm')} * {_comb_sql('(n - k)', '(d - m)')} / {_comb_sql('n', 'd')}, 6) END"
    )
    both = f"1D - ({_comb_sql('(deck - a)', _DRAWN_SQL)} + {_comb_sql('(deck - b)', _DRAWN_SQL)} - {_comb_sql('(deck - a - b)', _DRAWN_SQL)}) / {_comb_sql('deck', _DRAWN_SQL)}"
    specs = {
        "comb": (("n INT", "k INT"), "DOUBLE", _comb_sql("n", "k")),
        "hypergeom_exact": (("n INT", "k INT", "d INT", "m INT"), "DOUBLE", exact),
        "hypergeom_atleast": (("n INT", "k INT", "d INT", "m INT"), "DOUBLE", _atleast_sql("n", "k", "d", "m")),
        "cards_seen": (_TURN, "INT", _SEEN_SQL),
        "prob_by_turn": (("deck INT", "copies INT", "turn INT", "on_play BOOLEAN", "m INT DEFAULT 1", "mulligans INT DEFAULT 0"), "DOUBLE", _atleast_sql("deck", "copies", _DRAWN_SQL, "m")),
        "land_drops": (("deck INT", "lands INT", *_TURN), "DOUBLE", _atleast_sql("deck", "lands", _DRAWN_SQL, "turn")),
        "combo_by_turn": (("deck INT", "a INT", "b INT", *_TURN), "DOUBLE", f"CASE WHEN a + b > deck THEN NULL ELSE round({both}, 6) END"),
        "int_array_ok": (("v ARRAY<INT>", "n INT"), "BOOLEAN", "coalesce(size(v) = n AND forall(v, x -> x IS NOT NULL AND x >= 0), false)"),
    }
    for name, (args, kind, text) in specs.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({', '.join(args)}) RETURNS {kind} RETURN {text}")
    spark.udf.register(f"{prefix}castable", _castable_udf())
    spark.udf.register(f"{prefix}hand_prob", _hand_udf())
    return sorted(prefix + name for name in (*specs, "castable", "hand_prob"))


def _draws(counts: list[int], low: list[int], high: list[int], d: int) -> np.ndarray:
    grids = np.meshgrid(*[np.arange(a, b + 1) for a, b in zip(low, high)], indexing="ij")
    x = np.stack([g.ravel() for g in grids], axis=1) if counts else np.zeros((1, 0), np.int64)
    return x[x.sum(axis=1) <= d]


def _choose(n: int) -> np.ndarray:
    row = np.ones(n + 1)
    for j in range(1, n + 1):
        row[j] = row[j - 1] * (n - j + 1) / j
    return row


def _weigh(deck, counts, x, d, keep) -> float:
    other = deck - sum(counts)
    left = d - x.sum(axis=1)
    good = keep & (left <= other)
    x, left = x[good], left[good]
    if not len(x):
        return 0.0
    ways = _choose(other)[left]
    for i, c in enumerate(counts):
        ways = ways * _choose(c)[x[:, i]]
    return round(float(ways.sum() / _choose(deck)[d]), 6)


def _good(values, n, most=None) -> bool:
    return values is not None and len(values) == n and all(v is not None and v >= 0 and (most is None or v < most) for v in values)


def castable_value(deck, counts, canpay, need, mana, turn, on_play, mulligans):
    """Chance that the drawn sources can pay one of the alternatives.

    ``canpay`` holds a bit per kind of cost for each class of sources, ``need``
    the costs by kind of each alternative, ``mana`` the sources each needs in
    all. A draw pays an alternative if no set of kinds asks for more than the
    sources that can pay any of them (Hall's condition). Null on bad input and
    where the enumeration would be too large.
    """
    if any(v is None for v in (deck, turn, on_play, mulligans, counts, canpay, need, mana)):
        return None
    k, alternatives = len(counts), len(mana)
    kinds = len(need[0]) if len(need) and need[0] is not None else 0
    if not (1 <= deck <= 500 and 1 <= turn <= 20 and 0 <= mulligans <= 6 and k <= 8 and 1 <= alternatives <= 8 and 1 <= kinds <= 6):
        return None
    if not (_good(counts, k) and _good(canpay, k, 1 << kinds) and _good(mana, alternatives) and len(need) == alternatives and all(_good(n, kinds) for n in need)):
        return None
    if sum(counts) > deck:
        return None
    d = min(7 - mulligans + max(turn - (1 if on_play else 0), 0), deck)
    if np.prod([min(c, d) + 1.0 for c in counts]) * alternatives > MOST_WORK:
        return None
    if not k:
        return 1.0 if any(m == 0 for m in mana) else 0.0
    x = _draws(counts, [0] * k, [min(c, d) for c in counts], d)
    playable = np.minimum(x.sum(axis=1), turn)
    any_ = np.zeros(len(x), bool)
    pay = np.array(canpay)
    for costs, m in zip(need, mana):
        ok = playable >= m
        for s in range(1, 1 << kinds):
            asked = sum(costs[t] for t in range(kinds) if s >> t & 1)
            if asked:
                ok &= x[:, (pay & s) != 0].sum(axis=1) >= asked
        any_ |= ok
    return _weigh(deck, counts, x, d, any_)


def hand_value(deck, counts, low, high, turn, on_play, mulligans):
    """Chance that the cards seen hold between ``low`` and ``high`` of each group; turn 0 is the opening hand."""
    if any(v is None for v in (deck, turn, on_play, mulligans, counts, low, high)):
        return None
    k = len(counts)
    if not (1 <= deck <= 500 and 0 <= turn <= 20 and 0 <= mulligans <= 6 and 1 <= k <= 6 and _good(counts, k) and _good(low, k) and _good(high, k)):
        return None
    if any(a > b for a, b in zip(low, high)) or sum(counts) > deck:
        return None
    d = min(7 - mulligans if turn == 0 else 7 - mulligans + max(turn - (1 if on_play else 0), 0), deck)
    tops = [min(h, c, d) for h, c in zip(high, counts)]
    if np.prod([max(t - a, 0) + 1.0 for a, t in zip(low, tops)]) > MOST_WORK:
        return None
    if any(a > t for a, t in zip(low, tops)):
        return 0.0
    x = _draws(counts, list(low), tops, d)
    return _weigh(deck, counts, x, d, np.ones(len(x), bool))


def _key(v):
    """A value of an argument row as something that can be compared: numbers, and lists of them as tuples."""
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_key(x) for x in v)
    return None if v is None or v is pd.NA or v != v else int(v)


@lru_cache(50_000)
def _castable_once(*args):
    return castable_value(*args)


@lru_cache(50_000)
def _hand_once(*args):
    return hand_value(*args)


def _each(once, columns) -> pd.Series:
    """Each distinct row of arguments is worked out once in a worker."""
    return pd.Series([once(*map(_key, r)) for r in zip(*columns)], dtype="float64")


def _castable_udf():
    @F.pandas_udf("double")
    def run(deck: pd.Series, counts: pd.Series, canpay: pd.Series, need: pd.Series, mana: pd.Series, turn: pd.Series, on_play: pd.Series, mulligans: pd.Series) -> pd.Series:
        return _each(_castable_once, (deck, counts, canpay, need, mana, turn, on_play, mulligans))

    return run


def _hand_udf():
    @F.pandas_udf("double")
    def run(deck: pd.Series, counts: pd.Series, low: pd.Series, high: pd.Series, turn: pd.Series, on_play: pd.Series, mulligans: pd.Series) -> pd.Series:
        return _each(_hand_once, (deck, counts, low, high, turn, on_play, mulligans))

    return run


def castable(*columns: Column) -> Column:
    """:func:`castable_value` over columns; Arrow-batched, as the enumeration needs arrays of draws."""
    return _castable_udf()(*columns)


def hand(*columns: Column) -> Column:
    """:func:`hand_value` over columns."""
    return _hand_udf()(*columns)


def grid(spark: SparkSession, vary: dict[str, list[int]], most: int = 50) -> DataFrame:
    """All combinations of one to three varied arguments in the given order: ``row_no`` and a column each.

    Values repeated in a list count once. Refused as a whole: no or more than
    three names, a list with fewer than two values, more than ``most`` rows.
    """
    if not 1 <= len(vary) <= 3:
        raise ValueError("vary one to three arguments")
    lists = {k: list(dict.fromkeys(v)) for k, v in vary.items()}
    if any(len(v) < 2 for v in lists.values()):
        raise ValueError("a varied argument needs two values or more")
    size = int(np.prod([len(v) for v in lists.values()]))
    if size > most:
        raise ValueError(f"{size} combinations; at most {most}")
    df = spark.range(1).select(F.lit(0).alias("row_no"))
    for name, values in lists.items():
        df = df.select("*", F.posexplode(F.array(*[F.lit(int(v)) for v in values])).alias("__at", name)).withColumn("row_no", F.col("row_no") * len(values) + F.col("__at")).drop("__at")
    return df


def grid_table(df: DataFrame, down: str, across: str, value: str, columns: list[int]) -> DataFrame:
    """A two-argument grid as a table: a row per ``down``, a column per value of ``across``."""
    return df.groupBy(down).pivot(across, columns).agg(F.first(value))


def grid_markdown(df: DataFrame, vary: dict[str, list[int]], value: str) -> DataFrame:
    """The lines of a grid's tables in markdown: ``table_no``, ``line_no``, ``line``.

    One argument: a row per value. Two: the first down, the second across.
    Three: such a table for each value of the third. Values stand in the order
    given, percent with one digit; undefined ones are a dash. ``df`` has one row
    per combination (see :func:`grid`), of which there are few.
    """
    names = list(vary)
    lists = [list(dict.fromkeys(v)) for v in vary.values()]
    cell = F.coalesce(F.concat(F.format_number(F.col(value) * 100, 1), F.lit("%")), F.lit("-"))
    table = F.lit(0) if len(names) < 3 else F.array_position(F.array(*[F.lit(x) for x in lists[2]]), F.col(names[2])).cast("int") - 1
    down = F.array_position(F.array(*[F.lit(x) for x in lists[0]]), F.col(names[0])).cast("int")
    across = F.lit(0) if len(names) < 2 else F.array_position(F.array(*[F.lit(x) for x in lists[1]]), F.col(names[1])).cast("int")
    bar = lambda first, rest: F.concat(F.lit("| "), F.concat_ws(" | ", first, rest), F.lit(" |"))
    rows = df.groupBy(table.alias("table_no"), (down + 1).alias("line_no"), F.col(names[0]).alias("__d"), *([F.col(names[2]).alias("__t")] if len(names) > 2 else [])).agg(F.array_sort(F.collect_list(F.struct(across.alias("at"), cell.alias("cell")))).alias("cells"))
    body = rows.select("table_no", "line_no", bar(F.col("__d").cast("string"), F.col("cells.cell")).alias("line"))
    heads = [str(x) for x in lists[1]] if len(names) > 1 else [value]
    corner = F.lit(names[0] if len(names) < 2 else f"{names[0]} \\ {names[1]}")
    if len(names) > 2:
        corner = F.concat(corner, F.lit(f" ({names[2]} = "), F.col("__t").cast("string"), F.lit(")"))
    tables = rows.select("table_no", *(["__t"] if len(names) > 2 else [])).distinct()
    top = tables.select("table_no", F.lit(0).alias("line_no"), bar(corner, F.array(*[F.lit(h) for h in heads])).alias("line"))
    rule = tables.select("table_no", F.lit(1).alias("line_no"), F.lit("|" + " --- |" * (len(heads) + 1)).alias("line"))
    return top.unionByName(rule).unionByName(body)


#: What can be asked for (fixed values), and what an answer is: worked out, not such a kind, out of range, or not defined for the input.
KINDS = ("at_least", "by_turn", "land_drops", "combo_by_turn")
OK, UNKNOWN_KIND, OUT_OF_RANGE, UNDEFINED = "ok", "unknown kind", "out of range", "undefined"


def answer_chances(calls: DataFrame) -> DataFrame:
    """One answer per call: adds ``status``, ``cards_seen``, ``probability`` (four digits) and ``percent`` (text, one digit).

    ``calls``: ``kind, deck_size, copies, copies_b, draws, turn, on_play,
    at_least, mulligans``. Argument ranges (fixed values): deck 1 to 500, copies,
    draws and at_least 0 to the deck, turn 1 to 60, mulligans 0 to 6; a null
    argument is out of range. A result that is not defined, such as two cards
    with more copies than the deck holds, is told apart from bad input.
    """
    c = F.col
    deck, turn, play, mull = c("deck_size"), c("turn"), c("on_play"), c("mulligans")
    within = lambda x, low, high: F.coalesce(x.between(low, high), F.lit(False))
    fine = within(deck, 1, 500) & within(turn, 1, 60) & within(mull, 0, 6) & play.isNotNull()
    for name in ("copies", "copies_b", "draws", "at_least"):
        fine = fine & within(c(name), F.lit(0), deck)
    seen = F.when(c("kind") == "at_least", c("draws")).otherwise(cards_seen(turn, play, mull))
    value = (
        F.when(c("kind") == "at_least", hypergeom_atleast(deck, c("copies"), c("draws"), c("at_least")))
        .when(c("kind") == "by_turn", prob_by_turn(deck, c("copies"), turn, play, c("at_least"), mull))
        .when(c("kind") == "land_drops", land_drops(deck, c("copies"), turn, play, mull))
        .when(c("kind") == "combo_by_turn", combo_by_turn(deck, c("copies"), c("copies_b"), turn, play, mull))
    )
    known = F.coalesce(c("kind").isin(list(KINDS)), F.lit(False))
    status = F.when(~known, UNKNOWN_KIND).when(~fine, OUT_OF_RANGE)
    out = calls.withColumn("__p", F.when(known & fine, value)).withColumn("status", F.coalesce(status, F.when(c("__p").isNull(), UNDEFINED).otherwise(OK)))
    good = c("status") == OK
    return out.select("*", F.when(good, seen).alias("cards_seen"), F.when(good, F.round("__p", 4)).alias("probability"), F.when(good, F.concat(F.format_number(F.round(c("__p") * 100, 1), 1), F.lit("%"))).alias("percent")).drop("__p")
