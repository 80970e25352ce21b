"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.common import null_safe_hash, payload_of, stamp_and_payload

#: Snapshots handled in one pass; more are handled in windows that overlap by one.
PER_PASS = 32
#: More snapshots than this in one call are refused rather than listed on the driver.
MOST_SNAPSHOTS = 10_000


def snapshot_numbers(df: DataFrame, snapshot: str) -> list[int]:
    """The snapshot numbers present, ascending; their number is checked."""
    rows = df.select(snapshot).where(F.col(snapshot).isNotNull()).distinct().limit(MOST_SNAPSHOTS + 1).collect()
    if len(rows) > MOST_SNAPSHOTS:
        raise ValueError(f"more than {MOST_SNAPSHOTS} snapshots; pass the ones wanted")
    return sorted(r[0] for r in rows)


def snapshot_changes(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    snapshot: str = "snapshot_no",
    stamp: str = "loaded_at",
    numbers: Sequence[int] | None = None,
) -> DataFrame:
    """Keys added, removed or changed between each snapshot and the one numbered one less.

    All snapshots are read in one pass as one union tagged by snapshot. Each row
    is reduced to a hash of its values before the shuffle; a single aggregation
    by key keeps, per snapshot, the hash of the current row (latest ``stamp``,
    of equal stamps the larger hash), and the change is read off neighbouring
    hashes. Partial aggregation folds repeated deliveries before the shuffle, so
    a hot key costs one record per map task.

    Output: keys, ``snapshot`` (the later of the two), ``change``. Defined
    cases: a null key value is a value like any other; null differs from every
    number; rows with a null snapshot belong to none; where the preceding
    number has no row at all, every row of the snapshot is ``added`` except for
    the first snapshot listed, which has nothing before it; an empty table
    gives no rows; columns not named are ignored.
    """
    numbers = snapshot_numbers(df, snapshot) if numbers is None else sorted(set(numbers))
    kind = df.schema[snapshot].dataType
    if len(numbers) < 2:
        return df.select(*keys, F.col(snapshot), F.lit("").alias("change")).where(F.lit(False))
    later = [n for n in sorted({n for n in numbers} | {n + 1 for n in numbers}) if numbers[0] < n <= numbers[-1]]
    passes = [later[i : i + PER_PASS] for i in range(0, len(later), PER_PASS)]
    return reduce(DataFrame.unionByName, [_pass(df, keys, values, snapshot, stamp, p, kind) for p in passes])


def _pass(df, keys, values, snapshot, stamp, later, kind) -> DataFrame:
    needed = sorted({n for n in later} | {n - 1 for n in later})
    slim = df.where(F.col(snapshot).isin(needed)).select(
        *keys, F.col(snapshot).alias("__s"), stamp_and_payload(F.col(stamp), null_safe_hash(*[F.col(v) for v in values])).alias("__p")
    )
    state = slim.groupBy(*keys).agg(*[payload_of(F.max(F.when(F.col("__s") == n, F.col("__p")))).alias(f"__h{i}") for i, n in enumerate(needed)])
    at = {n: F.col(f"__h{i}") for i, n in enumerate(needed)}

    def change(n):
        old, new = at[n - 1], at[n]
        return (
            F.when(old.isNull() & new.isNotNull(), "added")
            .when(old.isNotNull() & new.isNull(), "removed")
            .when(old != new, "changed")
        )

    found = F.array(*[F.struct(F.lit(n).cast(kind).alias(snapshot), change(n).alias("change")) for n in later])
    return state.select(*keys, F.inline(found)).where(F.col("change").isNotNull())
