"""Readers for the file forms the catalogue arrives in; all return DataFrames and none iterates rows on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_array(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A file that is one JSON array. It can't be split: write it out once as lines or Parquet before repeated use."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object per line; lines that don't begin with a brace and trailing commas are tolerated. Compressed files are read as they are."""
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), ",$", "").alias("v")).where(F.col("v").startswith("{"))
    schema = schema if isinstance(schema, str) else schema.simpleString()
    return lines.select(F.from_json("v", schema).alias("r")).select("r.*")


def deck_documents(spark: SparkSession, path: str) -> DataFrame:
    """A folder of JSON documents, one deck each: ``file, deck_name, board, card_name, n``; empty ones give no rows."""
    card = "array<struct<name:string,count:int>>"
    schema = f"data struct<name:string,mainBoard:{card},sideBoard:{card},commander:{card}>"
    docs = spark.read.option("multiLine", True).schema(schema).json(path).select(F.input_file_name().alias("file"), "data.*")
    boards = F.array(*[F.struct(F.lit(b).alias("board"), F.coalesce(c, F.array().cast(card)).alias("cards")) for b, c in (("main", F.col("mainBoard")), ("side", F.col("sideBoard")), ("commander", F.col("commander")))])
    flat = docs.select("file", F.col("name").alias("deck_name"), F.explode(boards).alias("b")).select("file", "deck_name", "b.board", F.explode("b.cards").alias("c"))
    return flat.select("file", "deck_name", "board", F.col("c.name").alias("card_name"), F.col("c.count").alias("n"))


def unreadable_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder of JSON documents that hold no readable deck: ``file``; one row for each, so that none is lost without notice."""
    whole = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("v"))
    return whole.where(F.col("v").isNull() | F.try_variant_get("v", "$.data", "variant").isNull()).select("file")


def deck_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Deck lists as text: ``count [set] name`` lines, ``SB:`` for the side board, ``//`` comments: ``key, line_no, board, n, card_name``.

    A line is a card if its first word is a number and a name follows; all
    other lines are left out.
    """
    lines = df.select(F.col(key).alias("key"), F.posexplode(F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), "\n")).alias("line_no", "line"))
    line = F.trim("line")
    side = line.startswith("SB:")
    body = F.trim(F.when(side, F.substr(line, F.lit(4))).otherwise(line))
    words = F.filter(F.split(body, r"\s"), lambda w: w != "")
    head = F.coalesce(F.get(words, F.lit(0)), F.lit(""))
    count = F.when(F.regexp_count(head, F.lit(r"\D")) == 0, head.try_cast("int"))
    rest = F.trim(F.substr(body, F.length(head) + 1))
    tagged = rest.startswith("[") & (F.instr(rest, "]") > 0)
    name = F.trim(F.when(tagged, F.substr(rest, F.instr(rest, "]") + 1)).otherwise(rest))
    parsed = lines.where(~line.startswith("//") & (F.size(words) > 0)).select("key", "line_no", F.when(side, "side").otherwise("main").alias("board"), count.alias("n"), name.alias("card_name"))
    return parsed.where("n IS NOT NULL AND card_name <> ''")


def wide_csv(spark: SparkSession, path: str, prefixes: tuple[str, ...] = ("opening_hand_", "drawn_", "deck_", "pack_card_")) -> DataFrame:
    """A wide CSV with a header: item columns as numbers, all others as text; columns not used later are never parsed. Compressed files are spread after reading."""
    header = spark.read.option("header", True).csv(path)
    fields = [T.StructField(c, T.FloatType() if c.startswith(prefixes) else T.StringType()) for c in header.columns]
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").schema(T.StructType(fields)).csv(path)
    return df.repartition(max(1, spark.sparkContext.defaultParallelism)) if path.endswith(".gz") else df


def rulebook(df: DataFrame, key: str, text: str) -> DataFrame:
    """Numbered rules of a text: ``key, number, body``; lines without a number go on with the rule above."""
    lines = df.select(F.col(key).alias("key"), F.posexplode(F.split(text, r"\r?\n")).alias("at", "line"))
    number = F.regexp_extract("line", r"^(\d+(?:\.\d+)*[a-z]?)\.?\s+\S", 1)
    head = number != ""
    blocks = lines.withColumn("block", F.sum(head.cast("int")).over(Window.partitionBy("key").orderBy("at"))).where((F.col("block") > 0) & (F.trim("line") != ""))
    joined = blocks.groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    first = F.col("l")[0]["line"]
    body = F.concat_ws(" ", F.array(F.trim(F.regexp_replace(first, r"^\d+(?:\.\d+)*[a-z]?\.?\s+", ""))), F.transform(F.slice("l", 2, F.size("l")), lambda x: F.trim(x["line"])))
    return joined.select("key", F.regexp_extract(first, r"^(\d+(?:\.\d+)*[a-z]?)", 1).alias("number"), body.alias("body"))


def glossary(df: DataFrame, key: str, text: str) -> DataFrame:
    """Glossary of a text: blocks between blank lines, the first line is the term: ``key, term, body``."""
    blocks = df.select(F.col(key).alias("key"), F.explode(F.split(text, r"(?:\r?\n[ \t]*){2,}")).alias("b")).where(F.trim("b") != "")
    parts = F.split("b", r"\r?\n", 2)
    return blocks.select("key", F.trim(parts[0]).alias("term"), F.trim(F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), r"\s+", " ")).alias("body"))


def html_links(html: Column) -> Column:
    """``href`` and text of the links of a page; tags inside the text are dropped."""
    whole = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*href=\"[^\"]*\"[^>]*>.*?</a>"), F.lit(0))
    return F.transform(whole, lambda x: F.struct(F.regexp_extract(x, r"href=\"([^\"]*)\"", 1).alias("href"), F.trim(F.regexp_replace(x, r"(?s)<[^>]*>", "")).alias("text")))


def embedded_json(html: Column, variable: str, schema: str) -> Column:
    """The object assigned to a script variable of a page, read by schema; null where there is none."""
    pattern = variable.replace(".", r"\.") + r"\s*=\s*(\{.*?\})\s*;"
    found = F.regexp_extract(html, "(?s)" + pattern, 1)
    return F.from_json(F.when(found != "", found), schema)


def short_date(text: Column, earliest: str = "1990-01-01") -> Column:
    """``dd/mm/yy`` as a date; impossible or too early ones are null."""
    day = F.to_date(F.try_to_timestamp(F.regexp_extract(text, r"(\d{2}/\d{2}/\d{2})", 1), F.lit("dd/MM/yy")))
    return F.when(day >= F.lit(earliest).cast("date"), day)


def event_log(lines: DataFrame, columns: int = 6, events: tuple[str, ...] = ("issue", "stop")) -> DataFrame:
    """Append-only TSV of ``ts, event, key, ip, per_min, memo``; lines of another shape, time or event are skipped."""
    p = F.split("value", "\t", -1)
    ts = F.try_to_timestamp(F.get(p, F.lit(0)))
    kept = lines.where(F.size(p) == columns).select(ts.alias("ts"), F.get(p, F.lit(1)).alias("event"), F.get(p, F.lit(2)).alias("key"), F.get(p, F.lit(3)).alias("ip"), F.get(p, F.lit(4)).try_cast("int").alias("per_min"), F.get(p, F.lit(5)).alias("memo"))
    return kept.where(F.col("ts").isNotNull() & F.col("event").isin(list(events)))


def latest_state(log: DataFrame) -> DataFrame:
    """The last event of every key: ``alive`` after an issue."""
    return log.groupBy("key").agg(F.max(F.struct("ts", "event")).alias("l")).select("key", (F.col("l.event") == "issue").alias("alive"), F.col("l.ts").alias("ts"))


def call_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A TSV log with two kinds of rows: entries (``ts, tool, arguments, key``) and ends (``ts, tool, outcome, seconds, key``)."""
    p = F.split("value", "\t", -1)
    end = F.get(p, F.lit(1)) == "end"
    entries = lines.where(~end & (F.size(p) >= 4)).select(F.try_to_timestamp(F.get(p, F.lit(0))).alias("ts"), F.get(p, F.lit(1)).alias("tool"), F.get(p, F.lit(2)).alias("arguments"), F.get(p, F.lit(3)).alias("key"))
    ends = lines.where(end & (F.size(p) >= 8)).select(F.try_to_timestamp(F.get(p, F.lit(0))).alias("ts"), F.get(p, F.lit(2)).alias("tool"), F.get(p, F.lit(3)).alias("outcome"), F.get(p, F.lit(4)).try_cast("double").alias("seconds"), F.get(p, F.lit(7)).alias("key"))
    return entries, ends


def catalog(spark: SparkSession, tables: dict[str, DataFrame], counts: bool = True) -> DataFrame:
    """Columns of tables with types, and the number of rows of each table."""
    del spark
    parts = []
    for name, df in tables.items():
        columns = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(c).alias("column_name"), F.lit(t).alias("column_type")) for i, (c, t) in enumerate(df.dtypes)])
        n = df.agg(F.count(F.lit(1)).alias("n_rows")) if counts else df.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("n_rows"))
        parts.append(n.select(F.lit(name).alias("table_name"), "n_rows", F.explode(columns).alias("c")).select("table_name", "n_rows", "c.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
