"""Evaluation texts inside a corpus, found by pigeonhole pieces and verified with Myers' bit-parallel distance."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.common import reach_workers
from tallyloom.session import checkpoint_dir

#: Evaluation items per pass over the corpus; longer lists are matched in blocks of about this many.
BLOCK_ITEMS = 20_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, case ignored."""
    return _WORD.findall(text.lower()) if text else []


def myers(pattern: np.ndarray, size: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Least edit distance of each pattern row to any stretch of its text row; one bit per pattern word.

    ``pattern``: word numbers, rows padded with -1 behind their ``size`` (at most
    64). ``text``: word numbers, padded with -2. All rows advance together.
    """
    one = np.uint64(1)
    bits = one << np.arange(pattern.shape[1], dtype=np.uint64)
    top = one << (size.astype(np.uint64) - one)
    full = top | (top - one)
    plus, minus = full.copy(), np.zeros(len(pattern), np.uint64)
    score = size.astype(np.int64).copy()
    best = score.copy()
    for j in range(text.shape[1]):
        equal = ((pattern == text[:, j : j + 1]) * bits).sum(axis=1, dtype=np.uint64)
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | ~(across | plus), plus & across
        score = score + ((up & top) != 0) - ((down & top) != 0)
        up, down = up << one, down << one
        plus, minus = (down | ~(vertical | up)) & full, up & vertical & full
        best = np.minimum(best, score)
    return best


class Passages:
    """All passages of the items, cut into pieces for exact lookup."""

    def __init__(self, items: list[tuple[int, str]], run_words: int, max_edits: int):
        self.number: dict[str, int] = {}
        rows, owner, size, budget = [], [], [], []
        for item, text in items:
            w = [self.number.setdefault(x, len(self.number) + 1) for x in words(text)]
            m = min(run_words, len(w))
            if not m:
                continue
            for at in range(len(w) - m + 1):
                rows.append(w[at : at + m] + [-1] * (run_words - m))
                owner.append(item)
                size.append(m)
                budget.append(max_edits * m // run_words)
        self.run, self.rows = run_words, np.array(rows, np.int64).reshape(-1, run_words)
        self.owner, self.size, self.budget = (np.array(x, np.int64) for x in (owner, size, budget))
        length = self.size // (self.budget + 1)
        #: By piece length: sorted codes, and for each the passage and the piece's place in it.
        self.pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            codes, passage, place = [], [], []
            for k in range(int(self.budget[own].max()) + 1):
                has = own[self.budget[own] >= k]
                codes.append(gram_codes(self.rows[has, k * n : k * n + n]))
                passage.append(has)
                place.append(np.full(len(has), k * n))
            code, which, off = (np.concatenate(x) for x in (codes, passage, place))
            order = np.argsort(code, kind="stable")
            self.pieces[int(n)] = (code[order], which[order], off[order])


def gram_codes(grams: np.ndarray) -> np.ndarray:
    """A number for each row of word numbers. Hits by a number alone are verified later, so equal numbers of unequal rows do no harm."""
    code = np.zeros(len(grams), np.uint64)
    for j in range(grams.shape[1]):
        code = (code ^ grams[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code


#: Candidates verified at once.
_VERIFY = 100_000


def matches(known: Passages, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text index, item, least edits and passage length of every passage found within its budget; one row per text and item."""
    get = known.number.get
    ids, starts = [], [0]
    gap = [-2]
    for text in texts:
        found = [get(w, 0) for w in words(text)]
        ids += found
        ids += gap
        starts.append(len(ids))
    stream = np.array(ids, np.int64)
    start = np.array(starts, np.int64)
    which_text = np.repeat(np.arange(len(texts)), np.diff(start))
    out = []
    for n, (codes, passage, place) in known.pieces.items():
        if len(stream) < n:
            continue
        windows = np.lib.stride_tricks.sliding_window_view(stream, n)
        usable = np.flatnonzero((windows > 0).all(axis=1))
        grams = gram_codes(windows[usable])
        lo, hi = np.searchsorted(codes, grams, "left"), np.searchsorted(codes, grams, "right")
        count = hi - lo
        hit = np.flatnonzero(count)
        if not len(hit):
            continue
        # Hits are expanded and verified in blocks: a frequent piece can't fill the memory.
        bounds = np.append(0, np.cumsum(count[hit]))
        at = 0
        while at < len(hit):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _VERIFY, "right")) - 1)
            part = hit[at:to]
            rep = np.repeat(part, count[part])
            within = np.arange(len(rep)) - np.repeat(bounds[at:to] - bounds[at], count[part])
            entry = lo[rep] + within
            p, begin = passage[entry], usable[rep] - place[entry]
            out.append(_verify(known, stream, start, which_text[usable[rep]], p, begin))
            at = to
    if not out:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    text, p, edits = (np.concatenate(x) for x in zip(*out))
    return text, known.owner[p], edits, known.size[p]


def _verify(known, stream, start, text, p, begin):
    """Candidates on one diagonal are verified once."""
    _, first = np.unique(np.stack([p, begin]), axis=1, return_index=True)
    text, p, begin = text[first], p[first], begin[first]
    slack = int(known.budget[p].max())
    reach = begin[:, None] - slack + np.arange(known.run + 2 * slack)[None, :]
    inside = (reach >= start[text][:, None]) & (reach < start[text + 1][:, None])
    near = np.where(inside, stream[np.clip(reach, 0, len(stream) - 1)], -2)
    edits = myers(known.rows[p], known.size[p], near)
    good = edits <= known.budget[p]
    return text[good], p[good], edits[good]


_built: dict[str, Passages] = {}


def _passages(token: str, items, run_words: int, max_edits: int) -> Passages:
    """One set of passages per worker process; the token stands for its content."""
    if token not in _built:
        _built.clear()
        _built[token] = Passages(items, run_words, max_edits)
    return _built[token]


def leaked_items(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run_words: int = 12, max_edits: int = 2) -> DataFrame:
    """Documents that hold a passage of an evaluation item, word for word or with a few word edits.

    Every stretch of ``run_words`` words of an item is a passage with a budget of
    ``max_edits`` inserted, dropped or replaced words. It is cut into one piece
    more than its budget, so at least one piece must stand in the document
    unchanged. Pieces are looked up exactly in every document; each hit is
    verified by Myers' bit-parallel distance, a bit per word, between passage and
    surrounding text. Items shorter than ``run_words`` are one passage with a
    proportionate budget.

    The items are matched against all rows in blocks of about ``BLOCK_ITEMS``,
    each sent to every worker as one broadcast; the documents are never
    shuffled, only the pairs found are. Whole texts are read. Any number of
    items is taken: the blocks of a longer list are matched one after another,
    each reading the corpus once, and the pairs of each are checkpointed, so
    neither the driver nor a worker holds more than one block.

    Output: ``doc_id``, ``item_id`` (bigint), ``edits`` (the least), and
    ``passage_words`` (the longest passage among those); one row per pair.
    Defined cases: null or wordless texts and items hold nothing; rows with a
    null id are left out; items listed twice are one.
    """
    if not 1 <= run_words <= 64 or not 0 <= max_edits < run_words:
        raise ValueError("run_words must be 1 to 64, max_edits less")
    reach_workers(documents.sparkSession)
    listed = items.select(F.col(item_id).cast("bigint").alias("item"), F.col(item_text).cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()
    slim = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    schema = "doc_id bigint, item_id bigint, edits int, passage_words int"

    def block(part):
        token = md5(repr((part, run_words, max_edits)).encode("utf-8", "surrogatepass")).hexdigest()
        sent = documents.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _passages(token, sent.value, run_words, max_edits)
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                t, item, edits, size = matches(known, batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(ids[t], pa.int64()), pa.array(item, pa.int64()), pa.array(edits, pa.int32()), pa.array(size, pa.int32())], ["doc_id", "item_id", "edits", "passage_words"])

        return slim.mapInArrow(run, schema)

    count = listed.count()
    if count <= BLOCK_ITEMS:
        found = block(sorted((r[0], r[1]) for r in listed.collect()))
    else:
        checkpoint_dir(documents.sparkSession)
        blocks = -(-count // BLOCK_ITEMS)
        numbered = listed.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))).checkpoint()
        found = None
        for i in range(blocks):
            pairs = block(sorted((r[0], r[1]) for r in numbered.where(F.col("block") == i).collect())).checkpoint()
            found = pairs if found is None else found.unionByName(pairs)
    # Fewest edits first, of these the longest passage; both fit one number.
    best = F.min(F.col("edits") * 1000 - F.col("passage_words"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", F.ceil(F.col("b") / 1000).cast("int").alias("edits"), (F.ceil(F.col("b") / 1000) * 1000 - F.col("b")).cast("int").alias("passage_words")
    )
