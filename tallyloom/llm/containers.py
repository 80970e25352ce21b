"""Filling containers of fixed capacity with texts, by a grouping genetic algorithm on islands."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.common import reach_workers
from tallyloom.session import checkpoint_dir

#: Items per block (about), islands per block, rounds with a migration of elites between them.
BLOCK_ITEMS, ISLANDS, ROUNDS = 1000, 2, 2
#: Solutions an island keeps, offspring per round, elites sent to the next island.
POPULATION, OFFSPRING, ELITES = 6, 24, 2
#: Blocks are packed again with what is left in badly filled containers, this many times at most.
LEVELS = 3
#: A container this full is final at once.
FULL = 0.995

Solution = list[list[int]]


def token_count(text: Column) -> Column:
    """Matches of: one kana or ideograph, a run of Latin letters and digits, or any other character that is not white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[぀-ヿ㐀-鿿]|[A-Za-z0-9À-ɏ]+|[^\s\u0085   -     　\u001c-\u001f]")), F.lit(0))


def best_fit(bins: Solution, free: list[int], items: list[int], size: np.ndarray, capacity: int) -> None:
    """Puts items, largest first, each into the fullest container that still holds it; a new one where none does."""
    order = sorted((f, b) for b, f in enumerate(free) if f > 0)
    for i in sorted(items, key=lambda k: (-size[k], k)):
        need = int(size[i])
        at = bisect_left(order, (need, -1))
        if need > 0 and at == len(order) or not bins:
            bins.append([i])
            free.append(capacity - need)
            insort(order, (capacity - need, len(bins) - 1))
            continue
        f, b = order.pop(at) if at < len(order) else (free[0], 0)
        bins[b].append(i)
        free[b] = f - need
        if free[b] > 0:
            insort(order, (free[b], b))


def fitness(bins: Solution, size: np.ndarray, capacity: int) -> float:
    """Fewer and more unequally filled containers are better: the mean squared fill."""
    if not bins:
        return 0.0
    fill = np.array([size[b].sum() for b in bins]) / capacity
    return float((fill**2).mean())


def crossover(a: Solution, b: Solution, size: np.ndarray, capacity: int, rng: np.random.Generator) -> Solution:
    """Injects whole well-filled containers of ``b`` into ``a``.

    Containers of ``a`` that hold an injected item are emptied, so no item is
    twice; what they held besides is put back by best fit.
    """
    fill = np.array([int(size[x].sum()) for x in b])
    well = np.argsort(-fill, kind="stable")[: max(1, len(b) // 2)]
    take = rng.permutation(well)[: max(1, int(rng.integers(1, max(2, len(well)))))]
    injected = [b[k] for k in take]
    inside = np.zeros(len(size), bool)
    for x in injected:
        inside[x] = True
    child, displaced = [list(x) for x in injected], []
    for x in a:
        kept = [i for i in x if not inside[i]]
        if len(kept) == len(x):
            child.append(list(x))
        else:
            displaced += kept
    return repack(child, displaced, size, capacity)


def repack(bins: Solution, items: list[int], size: np.ndarray, capacity: int) -> Solution:
    free = [capacity - int(size[x].sum()) for x in bins]
    best_fit(bins, free, items, size, capacity)
    return bins


def mutate(a: Solution, size: np.ndarray, capacity: int, rng: np.random.Generator) -> Solution:
    """Empties the worst containers and a few others, and puts their items back."""
    fill = np.array([int(size[x].sum()) for x in a])
    worst = set(np.argsort(fill, kind="stable")[: max(1, len(a) // 20)].tolist())
    worst |= set(rng.integers(0, len(a), max(1, len(a) // 20)).tolist())
    items = [i for k in worst for i in a[k]]
    return repack([list(x) for k, x in enumerate(a) if k not in worst], items, size, capacity)


def evolve(solutions: list[Solution], size: np.ndarray, capacity: int, seed: int) -> list[Solution]:
    """One round on one island: best solutions first."""
    rng = np.random.default_rng(seed)
    least = -(-int(size.sum()) // capacity)
    pool = list(solutions)
    while len(pool) < POPULATION:
        order = rng.permutation(len(size))
        head = order[: len(order) // (2 + len(pool))]
        start: Solution = []
        free: list[int] = []
        for i in head:
            need = int(size[i])
            for k in range(max(0, len(start) - 4), len(start)):
                if free[k] >= need:
                    start[k].append(int(i))
                    free[k] -= need
                    break
            else:
                start.append([int(i)])
                free.append(capacity - need)
        pool.append(repack(start if len(pool) else [], [int(i) for i in (order[len(head) :] if len(pool) else order)], size, capacity))
    scored = sorted(((fitness(s, size, capacity), -len(s), k, s) for k, s in enumerate(pool)), key=lambda x: (-x[1], -x[0], x[2]))
    for n in range(OFFSPRING):
        if len(scored[0][3]) <= least:
            break
        i, j = sorted(rng.integers(0, len(scored), 2))
        child = crossover(scored[i][3], scored[j][3], size, capacity, rng) if i != j else mutate(scored[i][3], size, capacity, rng)
        scored.append((fitness(child, size, capacity), -len(child), len(pool) + n, child))
        scored = sorted(scored, key=lambda x: (-x[1], -x[0], x[2]))[:POPULATION]
    return [s for *_, s in scored]


def _encode(solution: Solution, n: int) -> list[int]:
    out = [0] * n
    for b, items in enumerate(solution):
        for i in items:
            out[i] = b
    return out


def _decode(code) -> Solution:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(code):
        bins.setdefault(int(b), []).append(i)
    return list(bins.values())


def _pack_level(items: DataFrame, capacity: int, level: int, count: int, islands: int, rounds: int) -> DataFrame:
    """Packs ``item``, ``size`` in blocks of about ``BLOCK_ITEMS``; gives ``bin`` by ``item``."""
    blocks = max(1, -(-count // BLOCK_ITEMS))
    # The row's own number is dealt, not its id: an id that stands many times is spread like any other rows.
    blocked = items.select(F.pmod(F.xxhash64("item", F.lit(level)), F.lit(blocks)).alias("block"), "item", "size")
    state = blocked.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("size", "item")), False).alias("members"))
    state = state.select("block", F.transform("members", lambda m: m["item"]).alias("items"), F.transform("members", lambda m: m["size"]).alias("sizes"))
    state = state.select("*", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.array().cast("array<array<int>>").alias("solutions"))

    def step(turn):
        def run(batches):
            for pdf in batches:
                out = []
                for block, island, sizes, solutions in zip(pdf["block"], pdf["island"], pdf["sizes"], pdf["solutions"]):
                    size = np.array(sizes, np.int64)
                    got = evolve([_decode(s) for s in solutions], size, capacity, hash((int(block), int(island), turn, level)) & 0x7FFFFFFF)
                    out.append([_encode(s, len(size)) for s in got])
                yield pd.DataFrame({"block": pdf["block"], "island": pdf["island"], "items": pdf["items"], "sizes": pdf["sizes"], "solutions": out})

        return run

    # The work lies in the computing, not in the bytes: a fixed number of tasks keeps adaptive execution from joining them into one.
    tasks = max(1, min(blocks * islands, max(3 * items.sparkSession.sparkContext.defaultParallelism, blocks * islands // 16)))
    for turn in range(rounds):
        state = state.repartition(tasks, "block", "island").mapInPandas(step(turn), "block bigint, island int, items array<bigint>, sizes array<int>, solutions array<array<int>>")
        if turn + 1 < rounds:
            # Elites of every island go to the next one; they are the only thing besides its own state that it gets.
            elites = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("solutions", 1, ELITES).alias("guests"))
            state = state.join(elites, ["block", "island"]).select("block", "island", "items", "sizes", F.concat(F.slice("solutions", 1, POPULATION - ELITES), "guests").alias("solutions"))
    best = state.select("block", "items", "sizes", "island", F.element_at("solutions", 1).alias("s")).withColumn("rank", F.struct(-F.array_max("s"), -F.col("island")))
    won = best.groupBy("block").agg(F.max_by(F.struct("items", "sizes", "s"), "rank").alias("w"))
    flat = won.select("block", F.explode(F.arrays_zip("w.items", "w.sizes", "w.s")).alias("m"))
    return flat.select(F.col("m.items").alias("item"), F.col("m.sizes").alias("size"), F.concat_ws(".", F.lit(level), F.col("block"), F.col("m.s")).alias("bin"))


def fill_containers(spark: SparkSession, docs: DataFrame, doc_id: str, tokens: str, capacity: int, islands: int = ISLANDS, rounds: int = ROUNDS, levels: int = LEVELS) -> DataFrame:
    """Puts every text into containers of ``capacity`` tokens with little space left.

    A text longer than a container is split: full pieces get containers of their
    own, the rest is an item like any other. No other text is split. Rows are
    numbered and checkpointed once, with their size and nothing else, and
    dealt into blocks by a hash of their number; each block is solved on several
    islands, each evolving its own solutions by a grouping genetic algorithm
    (whole well-filled containers are injected, items that are then twice are
    removed, displaced items are put back by best fit), with the best solutions
    migrating to the next island between rounds. Containers that are full enough
    are final; items of the others are dealt anew and packed together, so the
    space lost at the borders of the blocks is won back. A block is the largest
    thing a task holds, whatever the number of texts.

    Output: ``container_id`` (string), ``doc_id``, ``piece_no`` (from 1),
    ``n_pieces``, ``tokens``. Defined cases: a text without tokens goes into any
    container; null or negative counts count as 0; every row is a text of its
    own, so repeated and null ids are packed one by one and come out as often as
    they stand in ``docs``; an empty table gives no rows.
    """
    reach_workers(spark)
    checkpoint_dir(spark)
    n = F.greatest(F.coalesce(F.col(tokens), F.lit(0)).cast("bigint"), F.lit(0).cast("bigint"))
    full, rest = F.floor(F.col("n") / capacity), F.col("n") % capacity
    all_ = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), n.alias("n"), F.monotonically_increasing_id().alias("item"))
    sized = all_.select("doc_id", "item", full.cast("int").alias("full"), rest.cast("int").alias("rest"), F.col("n").alias("n")).checkpoint()
    sized = sized.withColumn("n_pieces", F.col("full") + F.when((F.col("rest") > 0) | (F.col("n") == 0), 1).otherwise(0))
    long_ = sized.where("full > 0").select("doc_id", "item", "n_pieces", F.explode(F.sequence(F.lit(1), F.col("full"))).alias("piece_no"))
    own = long_.select(F.concat_ws(".", F.lit("full"), F.col("item"), F.col("piece_no")).alias("container_id"), "doc_id", "piece_no", "n_pieces", F.lit(capacity).alias("tokens"))
    items = sized.where("rest > 0 OR n = 0").select("item", F.col("rest").alias("size"))
    done: list[DataFrame] = []
    for level in range(levels):
        count = items.count()
        if not count:
            break
        packed = _pack_level(items, capacity, level, count, islands, rounds).checkpoint()
        if level + 1 == levels or count <= BLOCK_ITEMS:
            done.append(packed)
            break
        fills = packed.groupBy("bin").agg(F.sum("size").alias("fill"))
        bad = fills.where(F.col("fill") < FULL * capacity).select("bin")
        done.append(packed.join(bad, "bin", "left_anti"))
        items = packed.join(bad, "bin", "left_semi").select("item", "size")
    if not done:
        return own
    placed = done[0]
    for d in done[1:]:
        placed = placed.unionByName(d)
    # Row numbers are unique, so this join adds no row and knows no hot key.
    pieces = sized.select("item", "doc_id", F.col("n_pieces").alias("piece_no"), "n_pieces")
    placed = placed.join(pieces, "item").select(F.col("bin").alias("container_id"), "doc_id", "piece_no", "n_pieces", F.col("size").alias("tokens"))
    return own.unionByName(placed)


def fill_report(filled: DataFrame, capacity: int) -> DataFrame:
    """Containers used, the least number possible by total size, and the share of space used."""
    per = filled.groupBy("container_id").agg(F.sum("tokens").alias("fill"))
    return per.agg(F.count(F.lit(1)).alias("n_containers"), F.ceil(F.sum("fill") / capacity).cast("bigint").alias("least_possible"), F.max("fill").alias("max_fill"), (F.sum("fill") / (F.count(F.lit(1)) * capacity)).alias("used"))
