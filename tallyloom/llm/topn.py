"""The N highest-scoring items of every group by simultaneous per-group bisection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.common import all_of, heavy_keys, reach_workers
from tallyloom.session import checkpoint_dir

#: Rows a worker holds before it prunes them.
BUFFER_ROWS = 400_000
#: From this ``n`` on, groups that hold more than a thousandth of the rows get their cutoff by counting on the whole cluster.
MANY = 10_000
_CODED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType, T.FloatType, T.DoubleType, T.DecimalType, T.StringType)


def cutoff_by_bisection(code: np.ndarray, starts: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Per group the largest code ``c`` with ``count(code >= c) >= want``.

    ``code`` is unsigned, grouped contiguously from ``starts``; ``want`` is
    between 1 and the group's size. All groups are bisected at once: each round
    counts the rows at or above every group's midpoint and halves its interval.
    """
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(code))))
    low, high = np.minimum.reduceat(code, starts), np.maximum.reduceat(code, starts)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = low + (high - low) // np.uint64(2) + np.uint64(1)
        middle = np.where(open_, middle, low)
        above = np.add.reduceat((code >= middle[group]).astype(np.int64), starts)
        enough = above >= want
        low = np.where(open_ & enough, middle, low)
        high = np.where(open_ & ~enough, middle - np.uint64(1), high)


def keep_top(group: np.ndarray, codes: Sequence[np.ndarray], n: int) -> np.ndarray:
    """Mask of the ``n`` rows of each group with the highest codes; ``group`` is non-decreasing.

    ``codes``: the words of one long code, the first of most weight. Every word
    is bisected among the rows that the words before it have left tied.
    """
    keep = np.ones(len(group), bool)
    if not len(group):
        return keep
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(starts, len(group)))
    big = size > n
    # Rows still tied, the open group of each, and the places left in every open group.
    rows = np.flatnonzero(np.repeat(big, size))
    local = np.repeat(np.arange(int(big.sum())), size[big])
    rest = np.full(int(big.sum()), n)
    keep[rows] = False
    for code in codes:
        if not len(rows):
            break
        at = np.flatnonzero(np.append(True, local[1:] != local[:-1]))
        c = code[rows]
        cut = np.repeat(cutoff_by_bisection(c, at, rest), np.diff(np.append(at, len(rows))))
        over, level = c > cut, c == cut
        keep[rows[over]] = True
        rest = rest - np.add.reduceat(over.astype(np.int64), at)
        n_level = np.add.reduceat(level.astype(np.int64), at)
        # All tied rows of a group fit its places: it is settled.
        fits = n_level <= rest
        settled = np.repeat(fits, np.diff(np.append(at, len(rows))))
        keep[rows[level & settled]] = True
        go = level & ~settled
        rows, local, rest = rows[go], local[go], rest[~fits]
    if len(rows):
        # Rows equal in every word: the first ones.
        at = np.flatnonzero(np.append(True, local[1:] != local[:-1]))
        place = np.arange(len(rows)) - np.repeat(at, np.diff(np.append(at, len(rows))))
        keep[rows[place < np.repeat(rest, np.diff(np.append(at, len(rows))))]] = True
    return keep


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def _codes(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Order-preserving unsigned 64-bit words of a column, the first of most weight; null and NaN lowest.

    Whole numbers and doubles need one word, decimals three (null or not, high,
    low half of the unscaled number), strings one for every eight bytes and one
    for their length.
    """
    null = np.asarray(column.is_null())
    if pa.types.is_temporal(column.type):
        column = column.cast(pa.int32() if pa.types.is_date32(column.type) else pa.int64())
    kind = column.type
    if pa.types.is_floating(kind):
        v = np.asarray(column.cast(pa.float64()).fill_null(np.nan).to_numpy(), np.float64) + 0.0
        bits = v.view(np.uint64)
        top = np.uint64(1 << 63)
        code = np.where(bits & top, ~bits, bits | top)
        return [np.where(null | np.isnan(v), np.uint64(0), code)]
    if pa.types.is_decimal(kind):
        one = pa.concat_arrays(column.cast(pa.decimal128(38, kind.scale)).chunks)
        halves = np.frombuffer(one.buffers()[1], np.uint64)[2 * one.offset : 2 * (one.offset + len(one))].reshape(-1, 2)
        high = halves[:, 1] ^ np.uint64(1 << 63)
        zero = np.uint64(0)
        return [(~null).astype(np.uint64), np.where(null, zero, high), np.where(null, zero, halves[:, 0])]
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        raw = [b"" if v is None else v.encode("utf-8", "surrogatepass") for v in column.to_pylist()]
        size = np.array([len(r) for r in raw], np.int64)
        wide = max(8, -(-int(size.max(initial=0)) // 8) * 8)
        words = [np.array([int.from_bytes(r[k : k + 8].ljust(8, b"\0"), "big") for r in raw], np.uint64) for k in range(0, wide, 8)]
        return [(~null).astype(np.uint64), *words, size.astype(np.uint64)]
    v = _signed(column.fill_null(0).to_numpy())
    return [(~null).astype(np.uint64), np.where(null, np.uint64(0), v)] if null.any() else [v]


def _smaller_first(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Words by which the smaller item is the higher code; a null item is the lowest."""
    null = np.asarray(column.is_null())
    return [(~null).astype(np.uint64), *[~c for c in _codes(column)]]


_TURNED = bytes(255 - b for b in range(256))


def _binary(column: pa.ChunkedArray, turned: bool) -> list[bytes]:
    """The same order as bytes, no code being the beginning of another; ``turned`` puts the smaller first, null last in either case."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        text = [None if v is None else v.encode("utf-8", "surrogatepass").replace(b"\0", b"\0\xff") + b"\0\0" for v in column.to_pylist()]
        return [b"\0" if t is None else b"\1" + (t.translate(_TURNED) if turned else t) for t in text]
    null = np.asarray(column.is_null())
    words = np.stack(_codes(column), axis=1)
    if null.any() and words.shape[1] > 1 and not pa.types.is_floating(column.type) and not pa.types.is_decimal(column.type):
        words = words[:, 1:]
    raw = (~words if turned else words).astype(">u8").tobytes()
    wide = 8 * words.shape[1]
    return [b"\0" + bytes(wide) if n else b"\1" + raw[i * wide : (i + 1) * wide] for i, n in enumerate(null)]


def _dense(table: pa.Table, groups: Sequence[str]) -> np.ndarray:
    """Numbers for the groups of a table in any order; equal for equal groups only."""
    ids = np.zeros(table.num_rows, np.int64)
    for g in groups:
        c = pa.concat_arrays(table[g].chunks).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        width = int(c.max()) + 1 if len(c) else 1
        if len(ids) and int(ids.max()) + 1 > (1 << 62) // width:
            ids = np.unique(ids, return_inverse=True)[1].astype(np.int64)
        ids = ids * width + c
    return ids


def _pruner(groups: Sequence[str], score: str, item: str, n: int, final: bool):
    def prune(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table
        key = _ids(table, groups) if final else _dense(table, groups)
        if not final:
            order = np.argsort(key, kind="stable")
            table, key = table.take(pa.array(order)), key[order]
        return table.filter(pa.array(keep_top(key, [*_codes(table[score]), *_smaller_first(table[item])], n)))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BUFFER_ROWS:
                kept = prune(pa.Table.from_batches(held)).combine_chunks()
                if kept.num_rows * 2 > BUFFER_ROWS:
                    yield from kept.to_batches()
                    held, rows = [], 0
                else:
                    held, rows = kept.to_batches(), kept.num_rows
        if held:
            yield from prune(pa.Table.from_batches(held)).to_batches()

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups arrive together; the last one may go on in the next batch and is carried on, pruned."""
        carried: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if carried is None else pa.concat_tables([carried, table])
            table = prune(table)
            key = _ids(table, groups)
            at = int(np.searchsorted(key, key[-1]))
            carried = table.slice(at)
            yield from table.slice(0, at).to_batches()
        if carried is not None:
            yield from carried.to_batches()

    return last if final else local


def _ids(table: pa.Table, groups: Sequence[str]) -> np.ndarray:
    """Numbers for the groups of a table in which the rows of a group stand together."""
    if not groups:
        return np.zeros(table.num_rows, np.int64)
    new = np.zeros(table.num_rows, bool)
    for g in groups:
        c = pa.concat_arrays(table[g].chunks).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new).astype(np.int64)


def _counted(rows: DataFrame, hot: DataFrame, groups: Sequence[str], score: str, item: str, n: int) -> DataFrame:
    """The ``n`` best rows of the groups in ``hot``, none of which is ever gathered.

    All groups are refined at once: each round counts, per group, the rows of
    the current interval of codes by their next byte, which tells the rows
    above 255 midpoints, and keeps the interval the cutoff lies in. Only these
    counts, at most 256 for each of at most 1000 groups, reach the driver. An
    interval of no more rows than a buffer is settled by ranking them.
    """
    checkpoint_dir(rows.sparkSession)
    kinds = T.StructType([*[rows.schema[c] for c in (*groups, item, score)], T.StructField("__code", T.BinaryType())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            codes = [a + b for a, b in zip(_binary(t[score], False), _binary(t[item], True))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], [*batch.schema.names, "__code"])

    group_types = T.StructType([rows.schema[g] for g in groups])
    state_types = T.StructType([*group_types.fields, T.StructField("__at", T.BinaryType()), T.StructField("__left", T.LongType())])
    same = all_of([F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in groups])

    def attach(df: DataFrame, states: list[tuple]) -> DataFrame:
        # One row for each hot group: at most 1000.
        s = df.sparkSession.createDataFrame(states, state_types)
        return df.join(F.broadcast(s.select(*[F.col(g).alias(f"__g_{g}") for g in groups], "__at", "__left")), same).drop(*[f"__g_{g}" for g in groups])

    states = [(*r, b"", n) for r in hot.collect()]
    coded = attach(rows, states).select(*groups, item, score).mapInArrow(code, kinds).checkpoint()
    settled: list[tuple] = []
    while states:
        deep = len(states[0][-2])
        inside = attach(coded, states).where(F.substring("__code", 1, deep) == F.col("__at"))
        counts = inside.groupBy(*groups, F.substring("__code", deep + 1, 1).alias("__next")).agg(F.count(F.lit(1)).alias("__n")).collect()
        by: dict[tuple, dict[bytes, int]] = {}
        for r in counts:
            by.setdefault(tuple(r[g] for g in groups), {})[bytes(r["__next"])] = r["__n"]
        going = []
        for *g, at, left in states:
            for byte, k in sorted(by[tuple(g)].items(), reverse=True):
                if k >= left:
                    state = (*g, bytes(at) + byte, left)
                    # No next byte: the rows are equal in their whole code.
                    (settled if k <= BUFFER_ROWS or not byte else going).append(state)
                    break
                left -= k
        states = going
    marked = attach(coded, settled).withColumn("__head", F.expr("substring(__code, 1, octet_length(__at))"))
    above = marked.where(F.col("__head") > F.col("__at")).select(*groups, item, score)
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(F.col("__code").desc()))
    level = marked.where(F.col("__head") == F.col("__at")).withColumn("__place", place).where(F.col("__place") <= F.col("__left"))
    return above.unionByName(level.select(*groups, item, score))


def top_items(df: DataFrame, groups: Sequence[str], score: str, item: str, n: int, distinct: bool = True) -> DataFrame:
    """Keeps the ``n`` items with the highest ``score`` of every group, ties by the smaller ``item``.

    Score and identifier form one order-preserving code. Every map task bisects
    the cutoffs of all its groups at once, counting the rows above the midpoints
    until each group holds exactly ``n``; only the survivors are shuffled by
    group, sorted by group and bisected again. A group of any size therefore
    reaches its reducer as at most ``n`` rows per buffer of ``BUFFER_ROWS``
    rows, and no group is ever held or sorted as a whole.

    With ``n`` of ``MANY`` or more the buffers of a hot group would send too
    much: groups that hold more than a thousandth of the survivors, of which
    there can be no more than 1000, get their cutoff by counts over the whole
    cluster instead (see ``_counted``).

    ``item`` and ``score`` may be numbers, decimals of any precision, dates,
    timestamps or strings (by code points); each is compared as it is. Groups
    with ``n`` items or fewer keep all. Output: groups, ``item``, ``score``.
    Defined cases: a null group is a group; null and NaN scores count lowest and
    are equal; a null item counts as the largest; equal rows are one
    (``distinct=False`` where none are); ``n < 1`` is refused; an empty table
    gives no rows.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    for c in (item, score):
        if not isinstance(df.schema[c].dataType, _CODED):
            raise TypeError(f"{c} has no order that a code can keep")
    reach_workers(df.sparkSession)
    slim = df.select(*groups, F.col(item), F.col(score))
    if distinct:
        slim = slim.distinct()
    survivors = slim.mapInArrow(_pruner(groups, score, item, n, False), slim.schema)
    hot_rows = None
    if n >= MANY and groups:
        checkpoint_dir(df.sparkSession)
        survivors = survivors.checkpoint()
        hot = heavy_keys(survivors, groups).checkpoint()
        hot_rows = _counted(survivors, hot, groups, score, item, n)
        on = [F.col(g).eqNullSafe(F.col(f"__h_{g}")) for g in groups]
        # At most 1000 groups.
        survivors = survivors.join(F.broadcast(hot.select(*[F.col(g).alias(f"__h_{g}") for g in groups])), all_of(on), "left_anti")
    # Without groups there is one group, of which each buffer has sent n rows at most.
    arranged = survivors.repartition(*groups).sortWithinPartitions(*groups) if groups else survivors.repartition(1)
    got = arranged.mapInArrow(_pruner(groups, score, item, n, True), slim.schema).select(*groups, item, score)
    return got if hot_rows is None else got.unionByName(hot_rows)
