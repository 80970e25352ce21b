"""Free-entered names mapped to a canonical list; names of no entry are reported."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.common import reach_workers
from tallyloom.session import checkpoint_dir

#: Names of the canonical list that a worker holds at once; a longer list is matched in blocks of about this many.
BLOCK_NAMES = 200_000
#: Function words that may be added to a name or left out of it, with the short forms of "of" and of the genitive.
FREE_WORDS = frozenset(("a", "an", "the", "o", "of", "s", "to", "and"))
#: Weight of these words in the similarity, against 0.7 or more of any other.
FREE_WEIGHT = 0.1
#: Values longer than this many letters are told apart from tied names by length, not by spelling.
FAR = 1000
#: Remarks added to a name: bracketed text, starred text, a leading count.
REMARKS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|\*[^*]*\*|^\s*\d+\s*x?\s+(?=\S)", re.IGNORECASE)
_WORD = re.compile(r"[^\W_](?:[^\W_]|\?(?=[^\W_]))*|\?[^\W_]+")
_JAPANESE = re.compile(r"[぀-ヿ㐀-鿿々]")
_RUNS = re.compile(r"[ァ-ヺー]+|[^ァ-ヺー]+")


def fold(text: str) -> list[str]:
    """Words of a name without case, accents and punctuation; Japanese is split where katakana begins or ends."""
    if text.isascii():
        return _WORD.findall(text.lower())
    out: list[str] = []
    plain = []
    for ch in unicodedata.normalize("NFKC", text):
        if _JAPANESE.match(ch):
            plain.append(ch)
        else:
            plain.append("".join(x for x in unicodedata.normalize("NFD", ch) if not unicodedata.combining(x) and unicodedata.category(x) != "Cf"))
    for word in _WORD.findall("".join(plain).lower()):
        out += _RUNS.findall(word) if _JAPANESE.search(word) else [word]
    return out


def slips(a: str, b: str, most: int) -> int:
    """Edits between two words (insert, delete, replace, swap of neighbours), ``most + 1`` where there are more. ``?`` replaces any letter freely."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y and x != "?"))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def _deletes(word: str, most: int) -> set[str]:
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


Hit = tuple[int, int, int, int]


def needed(word: str) -> bool:
    """Whether a value can't mean an entry if this word of it belongs to no name."""
    return word not in FREE_WORDS and (len(word) > 2 or bool(_JAPANESE.search(word)))


def longest(hits: Sequence[Hit]) -> list[Hit]:
    """The longest hits that do not overlap; of equals the first, then the smaller id."""
    taken: set[int] = set()
    out = []
    for at, size, letters, entry in sorted(hits, key=lambda h: (-h[2], h[0], h[1], h[3])):
        span = range(at, at + size)
        if taken.isdisjoint(span):
            taken.update(span)
            out.append((at, size, letters, entry))
    return out


def words_of(value: str | None) -> list[str]:
    """Words of a value without the remarks added to it; of the remarks, if there is nothing else."""
    return fold(REMARKS.sub(" ", REMARKS.sub(" ", value or ""))) or fold(value or "")


def decide(words: Sequence[str], hits: Sequence[Hit], known, closest, joined) -> tuple[int, str, float]:
    """``(id, match_kind, similarity)`` of a value; id 0 and kind ``none`` where no entry is meant.

    The longest embedded name wins if nothing but function words is left
    outside of the names found; then, if every word belongs to some name,
    ``closest()``, else ``joined()``, which both give (id, similarity) or None.
    """
    if not words:
        return 0, "none", 0.0
    found = longest(hits)
    if found:
        covered = {i for at, size, *_ in found for i in range(at, at + size)}
        left = [w for i, w in enumerate(words) if i not in covered]
        if FREE_WORDS.issuperset(left):
            return found[0][3], "exact" if len(found) == 1 and not left else "mention", 1.0
    got = closest() if all(known(w) or not needed(w) for w in words) else joined()
    return (got[0], "similar", got[1]) if got else (0, "none", 0.0)


class Canon:
    """Search structures over a canonical list: distinct ``(folded name, id)``, the words of a name parted by blanks."""

    def __init__(self, entries: Sequence[tuple[str, int]]):
        import ahocorasick

        entries = sorted(entries)
        self.names = [tuple(name.split(" ")) for name, _ in entries]
        self.ids = [entry for _, entry in entries]
        self.holders: dict[str, list[int]] = defaultdict(list)
        for i, words in enumerate(self.names):
            for w in set(words):
                self.holders[w].append(i)
        n = max(1, len(self.names))
        self.weight = {w: FREE_WEIGHT if w in FREE_WORDS else math.log(1 + n / len(h)) for w, h in self.holders.items()}
        self.size = [sum(self.weight[w] for w in sorted(set(words))) for words in self.names]
        self.near: dict[str, list[str]] = defaultdict(list)
        self.cut: dict[str, list[str]] = defaultdict(list)
        for w in self.holders:
            for d in _deletes(w, self.allowed(w)):
                self.near[d].append(w)
            for k in range(3, len(w)):
                self.cut[w[:k]].append(w)
        self.automaton = ahocorasick.Automaton()
        for i, words in enumerate(self.names):
            self.automaton.add_word(f" {' '.join(words)} ", i)
        if self.names:
            self.automaton.make_automaton()
        self.known: dict[str, tuple[int, dict[str, float]]] = {}
        self.whole: dict[str, list[int]] = {}
        # Longer words and texts are out of reach of any slip.
        self.longest_word = max(map(len, self.holders), default=0) + 2
        self.longest_text = max((sum(map(len, n)) for n in self.names), default=0) + 2

    @staticmethod
    def allowed(word: str) -> int:
        """Slips allowed in a word of the list."""
        return 0 if len(word) < 3 else 1 if len(word) < 9 else 2

    def hits(self, words: Sequence[str]) -> list[Hit]:
        """All names embedded in ``words``: first word, words, letters, id."""
        if not self.names:
            return []
        text = f" {' '.join(words)} "
        starts = {p: i for i, p in enumerate([0, *[m.start() for m in re.finditer(" ", text)][1:]])}
        return [(starts[end] - len(self.names[i]), len(self.names[i]), sum(map(len, self.names[i])), self.ids[i]) for end, i in self.automaton.iter(text)]

    def attempts(self, word: str, parts: int = 2) -> Iterator[dict[str, float]]:
        """What ``word`` may stand for, in attempts of which the first that finds anything counts.

        A word may have run together with as many as ``parts`` function words.
        The number of an attempt depends on the word alone, not on the list.
        """
        yield {word: 1.0} if word in self.holders else {}
        got: dict[str, float] = {}
        near = len(word) <= self.longest_word
        most = max(1, self.allowed(word)) if near and len(word) > 2 else 0
        for d in _deletes(word, most):
            for w in self.near.get(d, ()):
                bound = max(self.allowed(w), 1 if "?" in word else 0)
                if w not in got and (k := slips(word, w, bound)) <= bound:
                    got[w] = 1 - k / max(len(w), len(word))
        for w in self.cut.get(word, ()):
            got[w] = max(got.get(w, 0), len(word) / len(w))
        yield got
        got = {}
        if near and len(word) > 4:
            for d in _deletes(word, 1):
                for w in self.cut.get(d, ()):
                    if len(w) > len(word) and slips(word, w[: len(word)], 1) <= 1:
                        got[w] = (len(word) - 1) / len(w)
        yield got
        for rest in self._parts(word) if parts else ():
            for got in self.attempts(rest, parts - 1):
                yield {w: 0.9 * share for w, share in got.items()}

    def meant(self, word: str) -> tuple[int, dict[str, float]]:
        """Words of the list that ``word`` may stand for with the share of it that agrees, and the number of the attempt; none: -1."""
        if word in self.known:
            return self.known[word]
        out = next(((i, got) for i, got in enumerate(self.attempts(word)) if got), (-1, {}))
        if len(self.known) < 500_000:
            self.known[word] = out
        return out

    @staticmethod
    def _parts(word: str) -> list[str]:
        """What is left of a word that has run together with a function word."""
        ends = [word[:-1]] if word.endswith("s") and len(word) > 5 else []
        return ends + [word[len(w) :] for w in sorted(FREE_WORDS) if word.startswith(w) and len(word) - len(w) > 4]

    def joined(self, words: Sequence[str]) -> tuple[int, int] | None:
        """Names that differ in a blank put wrongly and little else, compared without any blanks: (slips, id)."""
        text = "".join(words)
        if not 7 < len(text) <= self.longest_text:
            return None
        if not self.whole:
            for i, name in enumerate(self.names):
                for d in _deletes("".join(name), 1):
                    self.whole.setdefault(d, []).append(i)
        near = {i for d in _deletes(text, 1) for i in self.whole.get(d, ())}
        ranked = min(((slips(text, "".join(self.names[i]), 2), self.ids[i]) for i in near), default=None)
        return ranked if ranked and ranked[0] <= 2 else None

    def closest(self, words: Sequence[str], meaning: Mapping[str, Mapping[str, float]], weight: Mapping[str, float], size: Sequence[float], spell: bool = False) -> tuple[float, int, int] | None:
        """The most similar name by its words with slips, ties by the closer spelling, then the smaller id: (similarity, slips, id).

        ``meaning``: for each word of the value what it stands for; ``weight`` and
        ``size``: of the list's words, and of this list's names. Slips are only
        counted between tied names, or with ``spell``.
        """
        meant = [meaning[w] for w in dict.fromkeys(words) if meaning.get(w)]
        # Words that weigh next to nothing are counted last and bring in no name of their own.
        meant.sort(key=lambda got: FREE_WORDS.issuperset(got))
        gain: dict[int, float] = defaultdict(float)
        total = 0.0
        for k, got in enumerate(meant):
            brings = k == 0 or not FREE_WORDS.issuperset(got)
            best: dict[int, float] = {}
            for w, share in got.items():
                for i in self.holders.get(w, ()):
                    if brings or i in gain:
                        best[i] = max(best.get(i, 0.0), share * weight[w])
            for i, g in best.items():
                gain[i] += g
            total += max(weight[w] for w in got)
        if not gain:
            return None
        rank = {i: g / (total + size[i] - g) for i, g in gain.items()}
        best_rank = max(rank.values())
        top = round(best_rank, 9)
        tied = [i for i, r in rank.items() if r > best_rank - 2e-9 and round(r, 9) == top]
        if len(tied) == 1 and not spell:
            return top, 0, self.ids[tied[0]]
        text = " ".join(words)
        far = len(text) > FAR
        distance, entry = min((len(text) - len(name) if far else slips(text, name, max(len(text), len(name))), self.ids[i]) for i in tied for name in [" ".join(self.names[i])])
        return top, distance, entry

    def resolve(self, value: str | None) -> tuple[int, str, float]:
        words = words_of(value)

        def closest():
            got = self.closest(words, {w: self.meant(w)[1] for w in words}, self.weight, self.size)
            return got and (got[2], got[0])

        def joined():
            got = self.joined(words)
            return got and (got[1], 1 - got[0] / len("".join(words)))

        return decide(words, self.hits(words), lambda w: self.meant(w)[1], closest, joined)


_built: dict[str, Canon] = {}


def _canon(token: str, entries) -> Canon:
    """One Canon per list and worker process; the token stands for the list's content."""
    if token not in _built:
        _built.clear()
        _built[token] = Canon(entries)
    return _built[token]


def _shared(names: DataFrame):
    """A function that gives the workers the Canon of ``names``, whose length the caller has checked; the list is sent once to each."""
    entries = sorted((r["name"], r["entry"]) for r in names.select("name", "entry").collect())
    token = md5(repr(entries).encode("utf-8", "surrogatepass")).hexdigest()
    sent = names.sparkSession.sparkContext.broadcast(entries)
    return lambda: _canon(token, sent.value)


def _folded(canon: DataFrame, canon_id: str, aliases: Sequence[str]) -> DataFrame:
    """Distinct names of the list, folded, with the smallest id of each."""
    listed = canon.where(F.col(canon_id).isNotNull()).select(F.col(canon_id).cast("bigint").alias("entry"), F.explode(F.array(*aliases)).alias("alias")).where(F.col("alias").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [" ".join(fold(a)) for a in batch.column("alias").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column("entry")], ["name", "entry"])

    return listed.mapInArrow(run, "name string, entry bigint").where("name <> ''").groupBy("name").agg(F.min("entry").alias("entry"))


_OUT = "value string, entry_id bigint, match_kind string, similarity double"


def resolve_names(values: DataFrame, value: str, canon: DataFrame, canon_id: str, aliases: Sequence[str]) -> DataFrame:
    """Maps every distinct ``value`` to the closest entry of ``canon``.

    ``canon`` lists entries by an integer id with several alias columns; null
    aliases are skipped. A multi-pattern automaton over all aliases finds names
    embedded in a value; the longest non-overlapping one wins, provided nothing
    but remarks and function words is left outside of the names found (of two
    entries named, the longer name). The other values go to a token-set
    similarity with small slips and cut ends. A value with a word of three
    letters or more that belongs to no name at all is reported with id 0 and
    kind ``none``; so are null, empty and unwordy values. Ties go to the closer
    spelling, then to the smaller id.

    Output: ``value``, ``entry_id``, ``match_kind`` (exact, mention, similar,
    none), ``similarity``; one row per distinct value, null included. Each
    distinct value is resolved once, however often it occurs.

    Up to ``BLOCK_NAMES`` names the list goes to every worker as one broadcast.
    A longer one is matched block by block with the same result: weights and
    the meaning of every word of the values are first found over all blocks,
    then each block gives its hits and its closest name, and the best of the
    blocks counts.
    """
    # The work lies in the computing, not in the bytes: a fixed number of tasks keeps adaptive execution from joining them into one.
    tasks = 3 * values.sparkSession.sparkContext.defaultParallelism
    once = values.select(F.col(value).cast("string").alias("value")).distinct().repartition(tasks, "value")
    reach_workers(values.sparkSession)
    checkpoint_dir(values.sparkSession)
    names = _folded(canon, canon_id, aliases).checkpoint()
    count = names.count()
    if count > BLOCK_NAMES:
        return _in_blocks(once, names, count, tasks)
    shared = _shared(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared()
        for batch in batches:
            got = [known.resolve(v) for v in batch.column("value").to_pylist()]
            columns = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("value"), *columns], ["value", "entry_id", "match_kind", "similarity"])

    return once.mapInArrow(run, _OUT)


def _in_blocks(once: DataFrame, names: DataFrame, count: int, tasks: int) -> DataFrame:
    """:func:`resolve_names` for a list too long for one worker; what a task holds is one block of it."""
    import pandas as pd

    blocks = -(-count // BLOCK_NAMES)
    words = names.select("name", F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    free = F.col("word").isin(sorted(FREE_WORDS))
    weights = words.groupBy("word").agg(F.count(F.lit(1)).alias("df")).select("word", F.when(free, F.lit(FREE_WEIGHT)).otherwise(F.log(1 + F.lit(count) / F.col("df"))).alias("weight")).checkpoint()
    sizes = words.join(weights, "word").groupBy("name").agg(F.sum("weight").alias("size"))
    names = names.join(sizes, "name").withColumn("block", F.pmod(F.xxhash64("name"), F.lit(blocks))).checkpoint()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"value": pdf["value"], "words": [words_of(v) for v in pdf["value"]]})

    texts = once.mapInPandas(cut, "value string, words array<string>").checkpoint()
    asked = texts.select(F.explode("words").alias("asked")).distinct().repartition(tasks, "asked").checkpoint()
    meanings, found = [], []
    for b in range(blocks):
        meanings.append(asked.mapInPandas(_meant_in(_shared(names.where(F.col("block") == b))), "asked string, attempt int, word string, share double").checkpoint())
    meaning = meanings[0]
    for m in meanings[1:]:
        meaning = meaning.unionByName(m)
    first = meaning.groupBy("asked").agg(F.min("attempt").alias("attempt"))
    # What a word means is bounded by the words of the list alone, not by how often it is asked for.
    meant = meaning.join(first, ["asked", "attempt"]).join(weights, "word").groupBy("asked").agg(F.collect_list(F.struct("word", "share", "weight")).alias("meant")).checkpoint()
    # Popular words stand in many values: what they mean is attached per distinct value by a join that splits them.
    each = texts.select("value", F.explode(F.array_distinct("words")).alias("asked")).join(meant, "asked").groupBy("value").agg(F.collect_list(F.struct("asked", "meant")).alias("meant"))
    texts = texts.join(each.withColumnRenamed("value", "v"), F.col("value").eqNullSafe(F.col("v")), "left").select("value", "words", "meant").repartition(tasks, "value").checkpoint()
    shape = "value string, hits array<array<bigint>>, similarity double, slips int, entry bigint, joined_slips int, joined_entry bigint"
    for b in range(blocks):
        block = names.where(F.col("block") == b)
        size = block.sparkSession.sparkContext.broadcast({r["name"]: r["size"] for r in block.select("name", "size").collect()})
        found.append(texts.mapInPandas(_best_in(_shared(block), size), shape).checkpoint())
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    # One row of each block for a value.
    best = every.groupBy("value").agg(
        F.flatten(F.collect_list("hits")).alias("hits"),
        F.max(F.when(F.col("entry").isNotNull(), F.struct("similarity", (-F.col("slips")).alias("s"), (-F.col("entry")).alias("e")))).alias("best"),
        F.min(F.when(F.col("joined_entry").isNotNull(), F.struct("joined_slips", "joined_entry"))).alias("joined"),
    )
    rows = texts.join(best.withColumnRenamed("value", "v"), F.col("value").eqNullSafe(F.col("v"))).select("value", "words", F.expr("transform(meant, m -> m.asked)").alias("known"), "hits", "best", "joined")

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for value, ws, known, hits, best, joined in pdf.itertuples(index=False):
                ws = list(ws)
                has = set(known) if known is not None else set()
                nearest = (-best["e"], best["similarity"]) if best else None
                whole = (joined["joined_entry"], 1 - joined["joined_slips"] / len("".join(ws))) if joined else None
                out.append((value, *decide(ws, [tuple(map(int, h)) for h in hits], has.__contains__, lambda n=nearest: n, lambda w=whole: w)))
            yield pd.DataFrame(out, columns=["value", "entry_id", "match_kind", "similarity"])

    return rows.mapInPandas(last, _OUT)


def _meant_in(shared):
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared()
        for pdf in batches:
            rows = [(w, i, x, share) for w in pdf["asked"] for i, got in [known.meant(w)] for x, share in got.items()]
            yield pd.DataFrame(rows, columns=["asked", "attempt", "word", "share"])

    return run


def _best_in(shared, size):
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared()
        sizes = [size.value[" ".join(n)] for n in known.names]
        for pdf in batches:
            rows = []
            for value, ws, meant in zip(pdf["value"], pdf["words"], pdf["meant"]):
                ws = list(ws)
                meaning = {m["asked"]: {x["word"]: x["share"] for x in m["meant"]} for m in meant} if meant is not None else {}
                weight = {x["word"]: x["weight"] for m in meant for x in m["meant"]} if meant is not None else {}
                sure = all(w in meaning or not needed(w) for w in ws)
                best = (known.closest(ws, meaning, weight, sizes, True) if sure else None) or (None, None, None)
                joined = (known.joined(ws) if ws and not sure else None) or (None, None)
                rows.append((value, [list(h) for h in known.hits(ws)], *best, *joined))
            out = pd.DataFrame(rows, columns=["value", "hits", "similarity", "slips", "entry", "joined_slips", "joined_entry"])
            yield out.astype({"slips": "Int32", "entry": "Int64", "joined_slips": "Int32", "joined_entry": "Int64"})

    return run
