"""Guarded free SQL: one read-only statement, bounded rows and cells, known names decorated."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and characters returned at most; a row larger than this is an error.
MOST_ROWS, MOST_CELL, MOST_ROW_BYTES = 50, 160, 256 * 1024
_LEAD = re.compile(r"\A(?:\s+|--[^\n]*(?:\n|\Z)|/\*.*?\*/)+", re.DOTALL)
#: Plan nodes that only read, after analysis; every other one is refused.
_READS = frozenset(
    "Aggregate CTERelationDef CTERelationRef Deduplicate Distinct Except Expand Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation LogicalRDD LogicalRelation "
    "Offset OneRowRelation Pivot Project Range Repartition RepartitionByExpression Sample Sort SubqueryAlias Tail Union UnionLoop UnionLoopRef Unpivot View Window WithCTE".split()
)
#: Functions that reach outside of the tables.
_FORBIDDEN = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length".split())


class Refused(ValueError):
    """A statement that is not admitted; ``kind`` says why."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def tags(sql: str) -> list[str]:
    """``#TAG`` words of the leading comments."""
    lead = _LEAD.match(sql)
    return re.findall(r"#(\w+)", lead.group(0)) if lead else []


def admitted(sql: str) -> str:
    """The statement without leading comments, if it is one SELECT or WITH; a semicolon anywhere but at the end is refused."""
    body = _LEAD.sub("", sql).strip()
    body = body[:-1].rstrip() if body.endswith(";") else body
    if not body:
        raise Refused("empty", "no statement")
    if ";" in body:
        raise Refused("several statements", "one statement at a time")
    if not re.match(r"(?i)(select|with)\b", body):
        raise Refused("not a query", "only SELECT and WITH")
    return body


def _nodes(plan) -> set[str]:
    """Kinds of all nodes of an analysed plan, those of its subqueries included."""
    inner = plan.subqueriesAll()
    names, todo = set(), [plan, *[inner.apply(i) for i in range(inner.size())]]
    while todo:
        p = todo.pop()
        names.add(p.getClass().getSimpleName())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return names


def _asked(value, relations: list[str], functions: list[str]) -> None:
    """Collects the relations and functions named anywhere in a parsed plan."""
    if isinstance(value, list):
        for v in value:
            _asked(v, relations, functions)
    elif isinstance(value, dict):
        kind = str(value.get("class", "")).rsplit(".", 1)[-1]
        if kind == "UnresolvedRelation":
            relations.append(str(value.get("multipartIdentifier")))
        elif kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
            functions.append(str(value.get("nameParts", value.get("name"))))
        for v in value.values():
            _asked(v, relations, functions)


#: Name and arguments, with their defaults, of the table function for partners (fixed values).
PARTNERS, DAYS, BOARD, LEAST_WITH = "mtg_card_partners", 90, "main", 3
_CALL = re.compile(PARTNERS + r"\s*\((?P<args>(?:[^()']|'(?:[^'\\]|\\.|'')*')*)\)", re.IGNORECASE)


def with_partners(spark: SparkSession, sql: str, baskets: DataFrame, lines: DataFrame, cards: DataFrame, today: Column | None = None) -> str:
    """The statement with every ``mtg_card_partners(format, card, days = 90, board = 'main', min_with = 3)`` replaced by a view of its rows.

    Spark's own SQL functions can't pass a parameter into nested aggregates, so
    each call becomes the plan of :func:`basket.card_partners`, lazily. The
    arguments must be constants. ``baskets`` and ``lines`` as in that module;
    ``today`` ends the window (the current date if not given).
    """
    from tallyloom.operators.basket import card_partners

    def view(call: re.Match) -> str:
        values = list(spark.sql(f"SELECT {call.group('args')}").first())
        if not 2 <= len(values) <= 5:
            raise Refused("arguments", f"{PARTNERS} takes two to five arguments")
        format_name, card, days, board, least = [*values, *(DAYS, BOARD, LEAST_WITH)[len(values) - 2 :]]
        since = F.date_sub(F.current_date() if today is None else today, int(days))
        name = f"partners_{uuid.uuid4().hex}"
        card_partners(baskets, lines, cards, format_name, card, since, board, int(least)).createOrReplaceTempView(name)
        return name

    return _CALL.sub(view, sql)


def run_sql(spark: SparkSession, sql: str, max_rows: int = 30) -> DataFrame:
    """The admitted query with at most ``max_rows`` rows; oversized rows raise.

    Only named tables and views may be read: a name of several parts must begin
    with a known schema, so files can't be read by their path. Functions that
    call Java or tell file names are refused, and after analysis every plan
    node that is not known to read only.
    """
    body = admitted(sql)
    rows = max(1, min(int(max_rows), MOST_ROWS))
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
    relations: list[str] = []
    functions: list[str] = []
    _asked(json.loads(parsed.toJSON()), relations, functions)
    for name in relations:
        parts = [p.strip() for p in name.strip("[]").split(",")]
        if len(parts) > 1 and not spark.catalog.databaseExists(parts[0]):
            raise Refused("not a table", f"only tables and views can be read: {name}")
    for name in functions:
        last = re.findall(r"\w+", name.lower())
        if last and last[-1] in _FORBIDDEN:
            raise Refused("function", f"{last[-1]} is not admitted")
    df = spark.sql(body)
    bad = _nodes(df._jdf.queryExecution().analyzed()) - _READS
    if bad:
        raise Refused("not a query", f"not admitted: {sorted(bad)}")
    return guard_rows(df, rows)


def guard_rows(df: DataFrame, rows: int, most: int = MOST_ROW_BYTES) -> DataFrame:
    """Limits the rows; a row whose JSON is longer than ``most`` is an error."""
    if not df.columns:
        return df.limit(rows)
    # Under numbers, as two columns may have one name.
    limited = df.limit(rows).toDF(*[f"c{i}" for i in range(len(df.columns))])
    size = F.octet_length(F.to_json(F.struct(*limited.columns)))
    ok = F.when(size > most, F.raise_error(F.lit(f"a row is larger than {most} bytes")).cast("boolean")).otherwise(F.lit(True))
    return limited.where(ok).toDF(*df.columns)


def render(df: DataFrame, most: int = MOST_CELL) -> list[str]:
    """Rows as ``a | b`` lines; null is spelled out and long cells are cut. ``df`` must be limited already."""
    lines = [" | ".join(df.columns)]
    for row in df.collect():
        cells = ["NULL" if v is None else str(v) for v in row]
        lines.append(" | ".join(c if len(c) <= most else c[: most - 1] + "…" for c in cells))
    return lines


def decorate(df: DataFrame, names: DataFrame, name: str, display: str, share: float = 0.5) -> DataFrame:
    """Adds ``<column>_display`` to text columns of which at least half the values are known names.

    ``df`` is a bounded result; its distinct values meet the names in one join
    for all columns. Columns that already have one, or stand twice, are skipped.
    """
    texts = [c for c, t in df.dtypes if t == "string" and df.columns.count(c) == 1 and f"{c}_display" not in df.columns]
    if not texts:
        return df
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").alias("v")) for c in texts])).alias("x")).select("x.*").where("v IS NOT NULL AND v <> ''")
    known = names.select(F.col(name).alias("v"), F.lit(1).alias("k")).distinct()
    shares = values.join(known, "v", "left").groupBy("c").agg((F.count("k") / F.count(F.lit(1))).alias("s"))
    chosen = [r[0] for r in shares.where(F.col("s") >= share).collect()]  # one row per column at most
    shown = names.groupBy(F.col(name).alias("__n")).agg(F.min(display).alias("__d"))
    for c in [c for c in texts if c in chosen]:
        df = df.join(shown, F.col(f"`{c}`") == F.col("__n"), "left").withColumn(f"{c}_display", F.col("__d")).drop("__n", "__d")
    return df
