"""Keeping tables up to date: differences, merges, digests, gates, retention."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.common import null_safe_hash, same


def diff_actions(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str], scope: Column | None = None) -> DataFrame:
    """What has to be done to ``old`` to make it ``new``: keys, new values and ``action`` (insert, update, delete, same).

    Both sides are reduced to a hash of their values and meet in one aggregation
    by key, so each row is shuffled once. Null equals null. Only rows of ``old``
    inside ``scope`` may be deleted or updated. Keys must be unique per side.
    """
    if scope is not None:
        old = old.where(scope)
    h = null_safe_hash(*[F.col(v) for v in values]).alias("__h")
    kinds = {f.name: f.dataType for f in new.schema.fields}
    a = old.select(*keys, h, F.lit(0).alias("__side"), *[F.lit(None).cast(kinds[v]).alias(f"__v_{v}") for v in values])
    b = new.select(*keys, h, F.lit(1).alias("__side"), *[F.col(v).alias(f"__v_{v}") for v in values])
    # Only rows of ``new`` carry values, one of a key: the largest is the only one. Numbers and dates stay in a hash aggregate.
    pick = lambda v: F.first(f"__v_{v}", ignorenulls=True) if kinds[v].typeName() in ("map", "variant") else F.max(f"__v_{v}")
    folded = a.unionByName(b).groupBy(*keys).agg(
        F.max(F.when(F.col("__side") == 0, F.col("__h"))).alias("__old"),
        F.max(F.when(F.col("__side") == 1, F.col("__h"))).alias("__new"),
        *[pick(v).alias(f"__v_{v}") for v in values],
    )
    o, n = F.col("__old"), F.col("__new")
    action = F.when(o.isNull(), "insert").when(n.isNull(), "delete").when(o != n, "update").otherwise("same")
    return folded.select(*keys, *[F.col(f"__v_{v}").alias(v) for v in values], action.alias("action"))


def diff_apply(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str], scope: Column | None = None) -> DataFrame:
    """``old`` after the difference is applied; rows outside ``scope`` stay."""
    kept = diff_actions(old, new, keys, values, scope).where("action <> 'delete'").select(*keys, *values)
    if scope is None:
        return kept
    return kept.unionByName(old.where(~F.coalesce(scope, F.lit(False))).select(*keys, *values))


def verify_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows only in either table, counting repeats: ``only_in_a, only_in_b, ok``. One aggregation, no rows returned."""
    columns = a.columns
    tagged = a.select(*columns).withColumn("__d", F.lit(1)).unionByName(b.select(*columns).withColumn("__d", F.lit(-1)))
    delta = tagged.groupBy(*columns).agg(F.sum("__d").alias("__d"))
    out = delta.agg(F.coalesce(F.sum(F.greatest("__d", F.lit(0))), F.lit(0)).alias("only_in_a"), F.coalesce(F.sum(F.greatest(-F.col("__d"), F.lit(0))), F.lit(0)).alias("only_in_b"))
    return out.withColumn("ok", (F.col("only_in_a") == 0) & (F.col("only_in_b") == 0))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old ones of the same key; all others stay."""
    return new.select(*old.columns).unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key ``old`` lacks, once per key: of equal keys the smallest row by the other columns."""
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])
    return once.join(old.select(*keys), list(keys), "left_anti").select(*new.columns)


def sweep(table: DataFrame, scope: Column, touched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drops rows inside ``scope`` whose key this run did not touch."""
    inside = table.where(scope).join(touched.select(*keys).distinct(), list(keys), "left_semi").select(*table.columns)
    return table.where(~F.coalesce(scope, F.lit(False))).unionByName(inside)


def normalised(kind: str, c: Column) -> Column:
    """Form in which values are compared: white space collapsed, empty text and empty arrays as null, arrays sorted."""
    if kind == "string":
        return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    if kind.startswith("array"):
        return F.when(F.size(c) > 0, F.array_sort(c))
    return c


def really_changed(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows of ``new`` that differ from ``old`` in normalised form, with the names of the changed columns."""
    kinds = dict(new.dtypes)
    a = old.select(*keys, *[F.col(v).alias(f"__o_{v}") for v in values])
    joined = new.select(*keys, *values).join(a, list(keys))
    changed = F.array_compact(F.array(*[F.when(~same(normalised(kinds[v], F.col(v)), normalised(kinds[v], F.col(f"__o_{v}"))), F.lit(v)) for v in values]))
    return joined.select(*keys, *values, changed.alias("changed")).where(F.size("changed") > 0)


def ghosts(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows gone from the source; they are reported, not deleted."""
    return old.join(new.select(*keys), list(keys), "left_anti")


def union_arrays(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Adds values to an array column, never removes any; sorted."""
    both = old.select(key, column).unionByName(new.select(key, column))
    flat = both.select(key, F.explode_outer(column).alias("__v"))
    return flat.groupBy(key).agg(F.array_sort(F.collect_set("__v")).alias(column))


def scrub(df: DataFrame, when: Column, nulls: Sequence[str], suffix: Sequence[str] = ()) -> DataFrame:
    """Nulls columns of some rows and strips a trailing ``_digits`` from others, for publication."""
    for c in nulls:
        df = df.withColumn(c, F.when(~F.coalesce(when, F.lit(False)), F.col(c)))
    for c in suffix:
        df = df.withColumn(c, F.when(F.coalesce(when, F.lit(False)), F.regexp_replace(c, r"_\d+$", "")).otherwise(F.col(c)))
    return df


def retention(df: DataFrame, stamp: str, column: str, cutoff: Column) -> DataFrame:
    """Nulls ``column`` on rows older than ``cutoff`` and on rows whose time can't be read."""
    return df.withColumn(column, F.when(F.col(stamp) >= cutoff, F.col(column)))


def digest(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Order-independent digest of each group: rows and the sum of 64-bit row hashes as text."""
    row = null_safe_hash(*[F.col(c) for c in columns]).cast("decimal(38,0)")
    return df.groupBy(*groups).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)")).cast("string")).alias("digest"))


def row_count_gate(df: DataFrame, least: int, what: str) -> DataFrame:
    """The table itself, or an error when it is read with fewer than ``least`` rows."""
    n = df.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    bad = F.raise_error(F.concat(F.lit(f"{what}: fewer than {least} rows: "), n.cast("string")))
    return df.where(F.when(n >= least, F.lit(True)).otherwise(bad.cast("boolean")))


def broken_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each quality rule; a null test breaks nothing. One pass."""
    counts = df.agg(*[F.count_if(~c).alias(name) for name, c in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_broken")) for n in rules])).alias("r")).select("r.*")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by several rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def completeness(df: DataFrame, columns: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Rows and filled values of each column by group."""
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"n_{c}") for c in columns])


def freshness(df: DataFrame, group: str, stamp: str, as_of: Column, limit_days: int) -> DataFrame:
    """``fresh``, ``stale`` or ``unknown`` by the age of each group's latest row."""
    last = df.groupBy(group).agg(F.max(stamp).alias("latest"))
    age = F.datediff(as_of, F.to_date("latest"))
    return last.select(group, "latest", age.alias("age_days"), F.when(age.isNull(), "unknown").when(age > limit_days, "stale").otherwise("fresh").alias("state"))


def health(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Rows and latest date of several tables; a table without dates has null, not 0."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows"), (F.max(F.to_date(c)) if c else F.lit(None).cast("date")).alias("latest")).select(F.lit(name).alias("table_name"), "n_rows", "latest")
        for name, (df, c) in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reload_table(df: DataFrame, folder: str) -> str:
    """Replaces a table as a whole: writes a new version beside the old one, then turns the pointer to it in one step.

    Readers see the old version until the pointer is renamed, which is atomic on
    a file system that can rename over a file; a failed write leaves the old
    table. Gives the folder of the new version. Old versions are kept.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{version}")
    jvm = spark._jvm
    hadoop = spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(hadoop)
    out = fs.create(path(f"{folder}/.{version}"), True)
    out.write(bytearray(version.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    target = fs.makeQualified(path(folder))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), hadoop).rename(path(target, f".{version}"), path(target, "CURRENT"), over)
    return f"{folder}/{version}"


def current_table(spark: SparkSession, folder: str) -> DataFrame:
    """The version of a table that :func:`reload_table` turned the pointer to last."""
    version = spark.read.text(f"{folder}/CURRENT").first()[0]
    return spark.read.parquet(f"{folder}/{version}")
