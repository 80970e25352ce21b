"""Structured Streaming jobs; each also runs over a finished input with ``availableNow``."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.common import reach_workers
from tallyloom.operators.maintain import diff_apply


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_seen(stream: DataFrame, keys: Sequence[str], stamp: str, late: str | None = "1 hour") -> DataFrame:
    """Rows whose key was not seen within the watermark; state is dropped behind it, and rows later than that are lost.

    ``late`` None is for finished input, whose files may come in any order of
    time: no row is too late, and all keys are kept.
    """
    if late is None:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(stamp, late).dropDuplicatesWithinWatermark(list(keys))


def sliding_rates(stream: DataFrame, key: str, stamp: str, size: str = "60 seconds", step: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Events per key in sliding windows."""
    w = F.window(stamp, size, step)
    return stream.withWatermark(stamp, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def sliding_totals(stream: DataFrame, key: str, stamp: str, folder: str, size: int = 60, step: int = 10) -> DataFrame:
    """:func:`sliding_rates` over everything that is there now, ``size`` and ``step`` in seconds; for results of any size.

    The stream holds no state and no row is too late: each batch leaves its
    counts per key and step in ``folder``, and a batch run twice replaces them.
    Windows are summed up when the counts are read, key by key in order of
    time, so that only steps with rows are shuffled, not every window around
    them; a key has at most one count a step, however many rows it has. A row
    without a time counts under a window without a start, as often as others do.
    """
    if size % step:
        raise ValueError("a window must be a whole number of steps")
    counts, seconds = f"{folder}/counts", F.unix_seconds(F.col(stamp))
    rows = stream.select(F.col(key).alias("__k"), (seconds - F.pmod(seconds, F.lit(step))).alias("__s"))

    def leave(batch: DataFrame, number: int) -> None:
        batch.groupBy("__k", "__s").agg(F.count(F.lit(1)).alias("__n")).write.mode("overwrite").parquet(f"{counts}/batch={number}")

    q = rows.writeStream.foreachBatch(leave).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(counts)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    batches = len(files.listStatus(path)) if files.exists(path) else 0
    shape = T.StructType([*rows.schema.fields, T.StructField("__n", T.LongType())])
    steps = (spark.read.schema(shape).parquet(counts) if batches else spark.createDataFrame([], shape)).select("__k", "__s", "__n")
    if batches > 1:
        steps = steps.groupBy("__k", "__s").agg(F.sum("__n").alias("__n"))
    order = Window.partitionBy("__k").orderBy("__s")
    # The window that starts ``back`` before a step holds that step and those after it; it is listed at the first step with rows.
    backs = range(0, size, step)
    sums = [F.sum("__n").over(order.rangeBetween(0, size - step - back)).alias(f"__n{back}") for back in backs]
    placed = steps.select("__k", "__s", "__n", F.lag("__s").over(order).alias("__before"), *sums)
    each = F.array(*[F.struct((F.col("__s") - back).alias("__start"), F.col(f"__n{back}").alias("n")) for back in backs])
    untimed = F.array(F.struct(F.col("__s").alias("__start"), (F.col("__n") * len(backs)).alias("n")))
    listed = placed.select("__k", "__before", F.inline(F.when(F.col("__s").isNull(), untimed).otherwise(each)))
    first = listed.where(F.col("__start").isNull() | F.col("__before").isNull() | (F.col("__start") > F.col("__before")))
    return first.select(F.timestamp_seconds("__start").alias("start"), F.timestamp_seconds(F.col("__start") + size).alias("end"), F.col("__k").alias(key), "n")


def tumbling_totals(stream: DataFrame, groups: Sequence[str], stamp: str, value: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    w = F.window(stamp, size)
    return stream.withWatermark(stamp, late).groupBy(w, *groups).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *groups, "n", "total")


def sessions(stream: DataFrame, key: str, stamp: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = F.session_window(stamp, gap)
    return stream.withWatermark(stamp, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def admit(times: list[float], seen: list[float], most: int, seconds: float) -> tuple[list[bool], list[float], list[float | None]]:
    """Which calls are admitted when only admitted ones count: verdicts, the times kept, and the wait for each refused call.

    A call exactly ``seconds`` old no longer counts.
    """
    held, verdict, wait = deque(seen), [], []
    for t in times:
        good, left = _admit_one(held, t, most, seconds)
        verdict.append(good)
        wait.append(left)
    return verdict, list(held), wait


def rate_limit(stream: DataFrame, key: str, stamp: str, most: int = 60, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """Verdict on each call; refused calls do not count, so it is stateful and in order of time within each batch.

    The state of a key is at most ``most`` times and is dropped when the
    watermark has passed its window.
    """

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values("ts")
        times = [t.timestamp() for t in pdf["ts"]]
        verdict, kept, wait = admit(times, seen, most, seconds)
        state.update((kept,))
        state.setTimeoutTimestamp(max(int(max(times) * 1000) + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [str(k[0])] * len(pdf), "ts": pdf["ts"], "admitted": verdict, "wait_seconds": wait})

    reach_workers(stream.sparkSession)
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(stamp).alias("ts")).withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, admitted boolean, wait_seconds double", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limit_batch(df: DataFrame, key: str, stamp: str, most: int = 60, seconds: int = 60, order: str | None = None) -> DataFrame:
    """:func:`rate_limit` over finished input, with all columns: ``key`` (text), the others, ``admitted``, ``wait_seconds``.

    Verdicts depend on all that was admitted before, so a key's calls are read
    in order (of equal times by ``order``) by one task; they are sorted on disk
    if need be and pass through in batches, and what is held is at most
    ``most`` times. A null time is refused.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, deque()
        for pdf in batches:
            verdicts, waits = [], []
            for k, t in zip(pdf["key"], pdf["us"]):
                if k != current:
                    current, held = k, deque()
                good, wait = (False, None) if t != t or t is None else _admit_one(held, t / 1e6, most, seconds)
                verdicts.append(good)
                waits.append(wait)
            yield pdf.assign(admitted=verdicts, wait_seconds=pd.Series(waits, dtype="float64", index=pdf.index))

    reach_workers(df.sparkSession)
    rest = [c for c in df.columns if c not in (key, "key", "us", "admitted", "wait_seconds")]
    rows = df.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(stamp).cast("timestamp")).alias("us"), *rest)
    arranged = rows.repartition("key").sortWithinPartitions("key", "us", *([order] if order else []))
    return arranged.mapInPandas(run, T.StructType([*arranged.schema.fields, T.StructField("admitted", T.BooleanType()), T.StructField("wait_seconds", T.DoubleType())]))


def _admit_one(held: deque, t: float, most: int, seconds: float) -> tuple[bool, float | None]:
    """Verdict on one call and the wait if it is refused; ``held`` is brought up to date."""
    while held and t - held[0] >= seconds:
        held.popleft()
    if len(held) < most:
        held.append(t)
        return True, None
    return False, held[0] + seconds - t


def rate_limit_total(df: DataFrame, key: str, stamp: str, most: int = 60, most_total: int = 300, seconds: int = 60, order: str | None = None) -> DataFrame:
    """Two limits at once, of a key and of all keys together: adds ``admitted`` and ``refused_by`` (key, total).

    A call counts against both only if both admit it. The verdict on a call
    depends on all calls before it, whatever their key, so this is one stream
    in order of time; long times without calls part it: where no call came for
    ``seconds``, nothing before matters, and the stretches between such gaps
    are dealt to different tasks.
    """
    us = F.unix_micros(F.col(stamp).cast("timestamp"))
    timed = df.where(F.col(stamp).isNotNull()).withColumn("__us", us)
    step = seconds * 1_000_000
    calls = timed.withColumn("__s", F.floor(F.col("__us") / step))
    # Windows that hold calls are few against the calls; a stretch begins where the window before is empty.
    slots = calls.select("__s").distinct().withColumn("__new", F.coalesce(F.col("__s") - F.lag("__s").over(Window.orderBy("__s")) > 1, F.lit(True)))
    stretches = slots.select("__s", F.max(F.when(F.col("__new"), F.col("__s"))).over(Window.orderBy("__s")).alias("__slot"))
    part = calls.join(stretches, "__s")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, every, own = None, deque(), {}
        for pdf in batches:
            verdicts, by = [], []
            for part_, k, t in zip(pdf["__slot"], pdf["key"], pdf["__us"]):
                if part_ != current:
                    current, every, own = part_, deque(), {}
                t = t / 1e6
                mine = own.setdefault(k, deque())
                for held in (mine, every):
                    while held and t - held[0] >= seconds:
                        held.popleft()
                reason = "key" if len(mine) >= most else "total" if len(every) >= most_total else None
                if reason is None:
                    mine.append(t)
                    every.append(t)
                verdicts.append(reason is None)
                by.append(reason)
            yield pdf.drop(columns=["__slot", "__us"]).assign(admitted=verdicts, refused_by=by)

    reach_workers(df.sparkSession)
    rest = [c for c in df.columns if c not in (key, "key", "admitted", "refused_by")]
    rows = part.select("__slot", F.col(key).cast("string").alias("key"), "__us", *rest)
    arranged = rows.repartition("__slot").sortWithinPartitions("__slot", "__us", *([order] if order else []))
    shape = T.StructType([*[f for f in arranged.schema.fields if f.name not in ("__slot", "__us")], T.StructField("admitted", T.BooleanType()), T.StructField("refused_by", T.StringType())])
    return arranged.mapInPandas(run, shape)


def apply_changes(old: Callable[[], DataFrame], write: Callable[[DataFrame], None], keys: Sequence[str], values: Sequence[str], stamp: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each batch's rows replace those of the same key.

    Of several rows for one key in a batch the one with the largest ``stamp``
    counts, of equals or without a stamp the one with the largest values.
    ``write`` must replace the table as a whole (a new version, then a pointer),
    so that a batch run twice leaves the same table.
    """

    def run(batch: DataFrame, _: int) -> None:
        order = F.struct(*([stamp] if stamp else []), *values)
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("newest"))
        latest = newest.select(*keys, *[F.col("newest")[v].alias(v) for v in values])
        base = old()
        rest = base.join(latest.select(*keys), list(keys), "left_anti").select(*keys, *values)
        write(diff_apply(base, rest.unionByName(latest.select(*keys, *values)), keys, values))

    return run


def paired_calls(entries: DataFrame, ends: DataFrame, stamp: str, key: str, within: str = "1 hour", late: str | None = None) -> DataFrame:
    """Entry and end rows of the same call joined within a time bound on both streams; ``late`` is how late rows may come (``within`` if not given)."""
    a = entries.withWatermark(stamp, late or within).alias("a")
    b = ends.withWatermark(stamp, late or within).alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"b.{stamp}") >= F.col(f"a.{stamp}")) & (F.col(f"b.{stamp}") <= F.col(f"a.{stamp}") + F.expr(f"INTERVAL {within}"))
    rest = [F.col(f"a.{c}") for c in entries.columns if c not in (key, stamp)] + [F.col(f"b.{c}") for c in ends.columns if c not in (key, stamp)]
    return a.join(b, on).select(F.col(f"a.{key}").alias(key), F.col(f"a.{stamp}").alias("started"), F.col(f"b.{stamp}").alias("ended"), *rest)


def run_once(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over everything that is there now into a table in memory; for tests and small results."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
