"""Duplicates that differ only in white space, case, punctuation or field order."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyloom.common import all_of, same
from tallyloom.session import checkpoint_dir

_LOW = 0xFFFFFFFF
#: Groups with more copies than this share of all rows are spread; there are at most ``1 / HEAVY_SHARE`` of them.
HEAVY_SHARE = 0.001


def fingerprint(fields: Mapping[str, Column]) -> list[Column]:
    """Multiset hash of (field name, value) pairs as four 32-bit sums.

    Each pair is hashed on its own and the hashes are added modulo 2**32 in four
    independent lanes. Addition commutes, so the order of the fields is of no
    consequence and nothing is sorted. Null has a hash of its own.
    """
    lanes: list[Column] = []
    for seed in ("a", "b"):
        hashes = [F.xxhash64(F.lit(seed), F.lit(name), value.isNull(), value) for name, value in fields.items()]
        for part in (lambda h: h.bitwiseAND(F.lit(_LOW)), lambda h: F.shiftrightunsigned(h, 32)):
            total = F.lit(0).cast("bigint")
            for h in hashes:
                total = total + part(h)
            lanes.append(total.bitwiseAND(F.lit(_LOW)))
    return [F.shiftleft(lanes[i], 32).bitwiseOR(lanes[i + 1]) for i in (0, 2)]


def hidden_duplicates(spark: SparkSession, df: DataFrame, row_id: str, fields: Mapping[str, Column]) -> DataFrame:
    """Collapses rows whose normalised fields are equal: one row per copy with the record that is kept.

    ``fields``: the normalised values by name. Rows are grouped by the 128-bit
    fingerprint of their fields; the smallest id of a group is kept. Group sizes
    and smallest ids come from one aggregation that combines before its shuffle.
    Copies are then joined to the kept record of their group and every field is
    compared (null equals null). Rows of another content under the same
    fingerprint are grouped again by the fields themselves, so a collision costs
    time but never a wrong pair. Groups with more than ``HEAVY_SHARE`` of all
    rows, of which there can be few, are broadcast; their rows are told apart
    before the shuffle of the others and are never gathered in one task. The
    groups and their members, only records that have copies, are checkpointed
    in the shared folder, which keeps the plans short.

    Output: ``keep_id``, ``copy_id`` (bigint); a record has one copy more than rows here.
    Ids must be unique; rows with a null id cannot be named and are left out. An
    empty table gives no rows.
    """
    checkpoint_dir(spark)
    names = [f"__f{i}" for i in range(len(fields))]
    a, b = fingerprint(fields)
    rows = df.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("bigint").alias("copy_id"), a.alias("__a"), b.alias("__b"), *[c.alias(n) for c, n in zip(fields.values(), names)])
    pairs, other = _grouped(rows, ["__a", "__b"], names, names)
    if other.isEmpty():
        return pairs
    again, _ = _grouped(other, names, names, [])
    return pairs.unionByName(again)


def _grouped(rows: DataFrame, keys: list[str], names: list[str], check: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of each group by ``keys``, and the rows that differ from the kept one in ``check``."""
    kept = [k.replace("__", "__k") for k in keys]
    seen = Observation()
    sizes = rows.groupBy(*keys).agg(F.min("copy_id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies")).observe(seen, F.sum("n_copies").alias("rows"))
    groups = sizes.where("n_copies > 1").select(*[F.col(k).alias(n) for k, n in zip(keys, kept)], "keep_id", "n_copies").checkpoint()
    most = (seen.get["rows"] or 0) * HEAVY_SHARE
    on = all_of([same(F.col(k), F.col(n)) for k, n in zip(keys, kept)])
    hot, cold = F.broadcast(groups.where(F.col("n_copies") > most)), groups.where(F.col("n_copies") <= most)
    wanted = ["keep_id", "copy_id", "n_copies", *names]
    members = rows.join(hot, on).select(*wanted).unionByName(rows.join(hot, on, "left_anti").join(cold, on).select(*wanted)).checkpoint()
    copies = members.where(F.col("copy_id") != F.col("keep_id"))
    if not check:
        return copies.select("keep_id", "copy_id"), None
    first = members.where(F.col("copy_id") == F.col("keep_id")).select("keep_id", "n_copies", *[F.col(n).alias(f"__o{n}") for n in names])
    hot_pairs = copies.where(F.col("n_copies") > most).join(F.broadcast(first.where(F.col("n_copies") > most).drop("n_copies")), "keep_id")
    cold_pairs = copies.where(F.col("n_copies") <= most).join(first.where(F.col("n_copies") <= most).drop("n_copies"), "keep_id")
    verified = hot_pairs.unionByName(cold_pairs)
    equal = all_of([same(F.col(c), F.col(f"__o{c}")) for c in names])
    return verified.where(equal).select("keep_id", "copy_id"), verified.where(~equal).select("copy_id", *names)


def payload_fields(payload: Column, wanted: tuple[str, ...]) -> dict[str, Column]:
    """Fields of a payload that is a JSON object or ``name=value`` parts joined by ``;`` or ``|``.

    Field names match in any letter case, with or without marks. A field that
    stands twice counts with its first value, a missing one is null; a payload
    that cannot be read has only nulls.
    """
    text = F.trim(payload)
    as_json = F.map_entries(F.from_json(text, "map<string,string>"))
    parts = F.transform(
        F.filter(F.split(text, r"[;|]"), lambda p: F.instr(p, "=") > 0),
        lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.trim(F.substr(p, F.instr(p, "=") + 1)).alias("value")),
    )
    entries = F.when(text.startswith("{"), as_json).otherwise(parts)

    def field(name: str) -> Column:
        plain = "".join(ch for ch in name.lower() if ch.isalnum())
        match = F.filter(entries, lambda e: F.lower(F.regexp_replace(e["key"], r"[^\p{L}\p{N}]+", "")) == plain)
        return F.try_element_at(match, F.lit(1))["value"]

    return {name: field(name) for name in wanted}
