"""Cost strings of bracketed symbols, such as ``{2}{W/U}{X}``, as native expressions.

Symbols (fixed values): whole numbers; X (counts 0); one of W U B R G C (1); two
of these with a slash (1, either pays); ``2/`` and a colour (2); a colour or two
with ``/P`` (1, may be paid otherwise).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COLOURS = "WUBRGC"
_SYMBOL = r"\{([^{}]+)\}"
_KNOWN = r"^(\d+|X|[WUBRGC]|[WUBRG]/P|2/[WUBRG]|([WUBRGC])/(?!\2)[WUBRGC]|([WUBRG])/(?!\3)[WUBRG]/P)$"


def symbols(cost: Column) -> Column:
    """Symbols of a cost in order; empty for none, null where anything stands outside the brackets."""
    found = F.regexp_extract_all(cost, F.lit(_SYMBOL), F.lit(1))
    return F.when(cost.isNull() | (cost == ""), F.array().cast("array<string>")).when(F.regexp_replace(cost, _SYMBOL, "") == "", found)


def _value(s: Column) -> Column:
    return F.when(s.rlike(r"^\d+$"), F.expr("0")).when(s == "X", F.lit(0)).when(s.startswith("2/"), F.lit(2)).otherwise(F.lit(1))


def cost_value(cost: Column) -> Column:
    """Total of a cost; null where a symbol is unknown."""
    s = symbols(cost)
    total = F.aggregate(s, F.lit(0), lambda a, x: a + F.when(x.rlike(r"^\d+$"), x.try_cast("int")).otherwise(_value(x)))
    return F.when(F.forall(s, lambda x: x.rlike(_KNOWN)), total)


def payable(cost: Column, have: Column) -> Column:
    """``true``, ``false``, ``unknown`` (a symbol can't be read) or ``not_judged`` (no colours given).

    ``have``: an array of colour letters. A symbol that can be paid otherwise
    asks for no colour.
    """
    s = symbols(cost)
    asks = F.filter(s, lambda x: x.rlike(r"^[WUBRGC](/[WUBRGC])?$"))
    missing = F.exists(asks, lambda x: ~F.arrays_overlap(F.split(x, "/"), have))
    readable = F.coalesce(F.forall(s, lambda x: x.rlike(_KNOWN)), F.lit(False))
    return F.when(~readable, "unknown").when(have.isNull(), "not_judged").when(missing, "false").otherwise("true")


def colours_needed(cost: Column) -> Column:
    """Colours without which a cost can't be paid, in fixed order."""
    single = F.filter(symbols(cost), lambda x: x.rlike(r"^[WUBRGC]$"))
    return F.filter(F.array(*[F.lit(c) for c in COLOURS]), lambda c: F.array_contains(single, c))


def either_needed(cost: Column) -> Column:
    """Pairs of which either colour is needed, each in fixed order."""
    pairs = F.filter(symbols(cost), lambda x: x.rlike(r"^[WUBRGC]/[WUBRGC]$"))
    order = lambda x: F.array_join(F.filter(F.array(*[F.lit(c) for c in COLOURS]), lambda c: F.array_contains(F.split(x, "/"), c)), "/")
    return F.array_sort(F.array_distinct(F.transform(pairs, order)))


def bucket(value: Column, top: int = 7) -> Column:
    """Curve bucket: whole values below ``top``, the rest together."""
    return F.least(value.cast("int"), F.lit(top))


def pip_masks(cost: Column) -> Column:
    """A bit mask per symbol that asks for colours, in order: W 1, U 2, B 4, R 8, G 16, C 32; either of two has both bits."""
    asks = F.filter(symbols(cost), lambda x: x.rlike(r"^[WUBRGC](/[WUBRGC])?$"))
    bit = lambda x, c, i: F.when(x.contains(c), 1 << i).otherwise(0)
    return F.transform(asks, lambda x: sum((bit(x, c, i) for i, c in enumerate(COLOURS)), F.lit(0)))


def generic(cost: Column) -> Column:
    """The part of a cost that anything pays: whole numbers, and 2 for each symbol that asks for a colour or two."""
    rest = F.filter(symbols(cost), lambda x: x.rlike(r"^\d+$|^2/"))
    return F.aggregate(rest, F.lit(0), lambda a, x: a + F.when(x.startswith("2/"), F.lit(2)).otherwise(x.try_cast("int")))


def _mask(symbol: Column) -> Column:
    return sum((F.when(F.contains(symbol, F.lit(c)), F.lit(1 << i)).otherwise(0) for i, c in enumerate(COLOURS)), F.lit(0))


def cost_plan(cost: Column) -> Column:
    """What a cost asks of sources: ``pips`` (masks), ``generic``, ``either`` (masks of colour-or-two symbols), ``notes``, ``error``.

    X counts as 0 and a symbol that life can pay asks for no source, each with a
    note. ``error`` says why a cost can't be read (``no symbol``, ``text outside
    of symbols``, ``unknown symbol``); then the rest is null.
    """
    s = symbols(cost)
    life, two = F.filter(s, lambda x: x.endswith("/P")), F.filter(s, lambda x: x.startswith("2/"))
    notes = F.concat(F.when(F.array_contains(s, "X"), F.array(F.lit("X counts as 0"))).otherwise(F.array().cast("array<string>")), F.transform(F.array_distinct(life), lambda x: F.concat(F.lit("{"), x, F.lit("} is paid with life"))))
    generic_ = F.aggregate(F.filter(s, lambda x: x.rlike(r"^\d+$")), F.lit(0), lambda a, x: a + x.try_cast("int"))
    error = F.when(cost.isNull() | (F.trim(cost) == ""), "no symbol").when(s.isNull(), "text outside of symbols").when(~F.forall(s, lambda x: x.rlike(_KNOWN)), "unknown symbol")
    good = error.isNull()
    return F.struct(F.when(good, pip_masks(cost)).alias("pips"), F.when(good, generic_).alias("generic"), F.when(good, F.transform(two, lambda x: _mask(x))).alias("either"), F.when(good, notes).alias("notes"), error.alias("error"))


def ways_to_pay(plan: Column) -> Column:
    """The alternatives of a :func:`cost_plan`: ``types`` (distinct masks, ascending) and ``ways``, each with ``need`` by type and ``mana`` in all.

    Every colour-or-two symbol may be paid in its colour or with two of any.
    Without coloured symbols there is one type that nothing needs.
    """
    pips, either = plan["pips"], plan["either"]
    types = F.array_sort(F.array_distinct(F.concat(pips, either)))
    places = F.when(F.size(either) > 0, F.sequence(F.lit(0), F.size(either) - 1)).otherwise(F.array().cast("array<int>"))

    def way(bits: Column) -> Column:
        in_colour = F.transform(F.filter(places, lambda j: F.getbit(bits, j) == 0), lambda j: F.get(either, j))
        paid = F.concat(pips, in_colour)
        need = F.transform(types, lambda t: F.size(F.filter(paid, lambda m: m == t)))
        mana = plan["generic"] + 2 * (F.size(either) - F.size(in_colour)) + F.size(paid)
        return F.struct(F.when(F.size(types) > 0, need).otherwise(F.array(F.lit(0))).alias("need"), mana.alias("mana"))

    return F.struct(types.alias("types"), F.transform(F.sequence(F.lit(0), F.pow(F.lit(2), F.size(either)).cast("int") - 1), way).alias("ways"))


def source_classes(lands: Column, types: Column) -> Column:
    """Sources that can pay the same types, taken together: ``canpay`` (a bit per type) and ``count``, ascending. ``lands``: ``mask``, ``count``."""
    bits = lambda mask: F.aggregate(F.when(F.size(types) > 0, F.sequence(F.lit(0), F.size(types) - 1)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda a, i: a + F.when(mask.bitwiseAND(F.get(types, i)) != 0, F.pow(F.lit(2), i).cast("int")).otherwise(0))
    held = F.filter(lands, lambda x: x["count"] > 0)
    kinds = F.array_sort(F.array_distinct(F.transform(held, lambda x: bits(x["mask"]))))
    return F.transform(kinds, lambda k: F.struct(k.alias("canpay"), F.aggregate(F.filter(held, lambda x: bits(x["mask"]) == k), F.lit(0), lambda a, x: a + x["count"]).alias("count")))
