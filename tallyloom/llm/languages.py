"""Languages of documents and of the stretches within them, with a confidence."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.common import reach_workers

LANGUAGES = ("en", "ja", "de", "fr", "es", "it")
#: Buckets of the hashed subwords, size of their vectors, lengths of the subwords.
BUCKET_BITS, SIZE, LENGTHS = 16, 16, (2, 3, 4)
BUCKETS = 1 << BUCKET_BITS
#: Labelled documents sampled for training: of each language, by hand-checked label and by stated label.
CHECKED_PER_LANGUAGE, STATED_PER_LANGUAGE = 400, 400
#: Paragraphs taken of one sampled document.
PARAGRAPHS_PER_DOCUMENT = 6
#: Characters of text embedded at once.
CHUNK_CHARS = 100_000

_LINE = r"(?:\r\n|[\n\r\x0b\x0c\x85  ])"
_BLANK = re.compile(rf"{_LINE}(?:[^\S\n\r]|[​﻿])*{_LINE}(?:\s|[​﻿])*")
_ENTRY = re.compile(r"^\s*(?:[-*•·>]\s*)*\d+\s*[x×]?\s+[^.!?。！？\n]*$", re.MULTILINE)
_SENTENCE = re.compile(r"[^\W\d_][^.!?。！？]*[.!?。！？]")


def paragraphs(text: str) -> list[tuple[int, int, str]]:
    """Paragraphs of sentences: first and last position, and the text without list lines. Lists and bare names are left out."""
    out, at = [], 0
    for gap in [*_BLANK.finditer(text), None]:
        end = gap.start() if gap else len(text)
        part = text[at:end]
        if part.strip():
            prose = _ENTRY.sub(" ", part)
            if _SENTENCE.search(prose):
                out.append((at, end, prose))
        at = gap.end() if gap else end
    return out


def _letters() -> np.ndarray:
    """For every code point its lower-case letter, 0 where it is none."""
    codes = np.zeros(0x110000, np.uint32)
    # Beyond the planes of scripts and ideographs no letter is assigned.
    for c in range(0x33480):
        if not 0xD800 <= c < 0xE000 and (ch := chr(c)).isalpha():
            codes[c] = ord(ch.lower()[0])
    return codes


_CODES: list[np.ndarray] = []


def _grams(texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every length of subwords their buckets in the order of the texts, and the text of each."""
    if not _CODES:
        _CODES.append(_letters())
    joined = " " + " ".join(texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
    owner = np.concatenate([owner[:1], owner]) if len(owner) else np.zeros(len(points), np.int32)
    code = _CODES[0][points]
    letter = code > 0
    out = []
    h = np.zeros(len(code), np.uint32)
    some, inner = letter.copy(), None
    for n in range(1, max(LENGTHS) + 1):
        count = len(code) - n + 1
        if count < 1:
            break
        # The hash of a longer subword goes on from that of its beginning.
        h = (h[:count] + code[n - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n == 1:
            continue
        some = some[:count] | letter[n - 1 :]
        if n > 2:
            inner = letter[1 : 1 + count].copy() if n == 3 else inner[:count] & letter[n - 2 : n - 2 + count]
        if n in LENGTHS:
            good = np.flatnonzero(some if inner is None else some & inner)
            # A subword with a text's bound in it belongs to the text of its letters.
            own = owner[good + 1] if n > 2 else np.where(letter[good], owner[good], owner[good + 1])
            out.append(((h[good] >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), own))
    return out


def subwords(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed subwords of all texts: buckets, and the text of each, text by text.

    A subword is a run of letters of any script within a word, case ignored,
    the word's bounds included.
    """
    parts = _grams(texts)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    b, o = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(o, kind="stable")
    return b[order], o[order]


@dataclass
class Model:
    """Logits per bucket (embedding times softmax weights), offsets, temperature and the confidence below which a text is rejected."""

    table: np.ndarray
    offset: np.ndarray
    temperature: float
    least: float
    languages: tuple[str, ...]
    accuracy: float

    def confidences(self, texts: Sequence[str]) -> np.ndarray:
        """Calibrated probabilities, one row per text; all zero where a text has no letters."""
        out = np.zeros((len(texts), len(self.languages)))
        columns = np.ascontiguousarray(self.table.T)
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to]) <= CHUNK_CHARS):
                chars += len(texts[to])
                to += 1
            n = np.zeros(to - at, np.int64)
            total = np.zeros((to - at, len(self.languages)))
            for b, o in _grams(texts[at:to]):
                # The texts of the subwords stand in order: sums are differences of running sums.
                bounds = np.searchsorted(o, np.arange(to - at + 1, dtype=np.int32))
                n += np.diff(bounds)
                for k, row in enumerate(columns):
                    running = np.zeros(len(b) + 1)
                    np.cumsum(row[b], dtype=np.float64, out=running[1:])
                    total[:, k] += running[bounds[1:]] - running[bounds[:-1]]
            logits = (total / np.maximum(n, 1)[:, None] + self.offset) / self.temperature
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[at:to] = p / p.sum(axis=1, keepdims=True) * (n > 0)[:, None]
            at = to
        return out


def _sgd(features, labels, weights, classes, epochs, rate, seed):
    """Stochastic gradient descent on averaged subword vectors and softmax weights together.

    ``features``: for each text its distinct buckets and the share of its subwords in each.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
    softmax = rng.normal(0, 0.1, (SIZE, classes)).astype(np.float32)
    offset = np.zeros(classes, np.float32)
    steps, batch = 0, 16
    total = epochs * max(1, -(-len(features) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(features))
        for i in range(0, len(order), batch):
            lr = rate * (1 - steps / total)
            steps += 1
            own = order[i : i + batch]
            ids = np.concatenate([features[k][0] for k in own])
            share = np.concatenate([features[k][1] for k in own])
            starts = np.append(0, np.cumsum([len(features[k][0]) for k in own])[:-1])
            mean = np.add.reduceat(vectors[ids] * share[:, None], starts)
            logits = mean @ softmax + offset
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), labels[own]] -= 1
            g = (p * weights[own][:, None]).astype(np.float32)
            back = g @ softmax.T
            softmax -= lr * mean.T @ g / batch
            offset -= lr * g.mean(axis=0)
            # A text's buckets are distinct, so its part of the step needs no folding.
            for k, step in zip(own, lr * back):
                at, part = features[k]
                vectors[at] -= part[:, None] * step
    return vectors @ softmax, offset


def train(texts: Sequence[str], labels: Sequence[str], trusted: Sequence[bool], languages: Sequence[str] = LANGUAGES, target: float = 0.995, epochs: int = 4, rate: float = 8.0, seed: int = 7) -> Model:
    """Trains on labelled paragraphs of which those not ``trusted`` may be labelled wrongly.

    A first model is trained on all; paragraphs without a trusted label that it
    contradicts are dropped and the model is trained again. A fifth is held out
    of training for the temperature (least cross-entropy) and for the least
    confidence at which the share of right answers reaches ``target``.
    """
    languages = tuple(languages)
    number = {x: i for i, x in enumerate(languages)}
    parts: list[np.ndarray] = []
    for at in range(0, len(texts), 200):
        b, o = subwords(texts[at : at + 200])
        starts = np.searchsorted(o, np.arange(len(texts[at : at + 200]) + 1))
        parts += [b[i:j].astype(np.int32) for i, j in zip(starts[:-1], starts[1:])]
    keep = [i for i in range(len(texts)) if labels[i] in number and len(parts[i])]
    features = []
    for i in keep:
        at, n = np.unique(parts[i], return_counts=True)
        features.append((at, (n / n.sum()).astype(np.float32)))
    y = np.array([number[labels[i]] for i in keep], np.int64)
    sure = np.array([bool(trusted[i]) for i in keep], bool)
    if not len(y):
        return Model(np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages), np.float32), 1.0, 2.0, languages, 0.0)
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.2

    def fit(use):
        use = np.flatnonzero(use)
        n = np.bincount(y[use], minlength=len(languages))
        w = np.sqrt(n.max() / np.maximum(n, 1))[y[use]] * np.where(sure[use], 2.0, 1.0)
        return _sgd([features[i] for i in use], y[use], w / w.mean(), len(languages), epochs, rate, seed)

    def logits(table, offset):
        return np.stack([part @ table[at] + offset for at, part in features])

    first = logits(*fit(np.ones(len(y), bool))).argmax(axis=1)
    right = sure | (first == y)
    table, offset = fit(right & ~held)
    test = right & held
    z, t = logits(table, offset)[test], y[test]
    if not len(t):
        return Model(table, offset, 1.0, 0.5, languages, 0.0)

    def softmax(temperature):
        e = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
        return e / e.sum(axis=1, keepdims=True)

    temperature = min(np.geomspace(0.25, 4, 40), key=lambda c: -np.log(softmax(c)[np.arange(len(t)), t] + 1e-12).mean())
    p = softmax(temperature)
    top, hit = p.max(axis=1), p.argmax(axis=1) == t
    order = np.argsort(-top)
    share = np.cumsum(hit[order]) / np.arange(1, len(t) + 1)
    enough = np.flatnonzero(share >= target)
    least = float(top[order][enough[-1]]) if len(enough) else 0.9
    return Model(table.astype(np.float32), offset.astype(np.float32), float(temperature), min(max(least, 0.5), 0.9), languages, float(hit.mean()))


def stated_language(lang: Column) -> Column:
    """The language a label states: its first two letters; null where it is null, blank or ``und``."""
    text = F.lower(F.trim(lang))
    return F.when((text != "") & ~text.startswith("und"), F.substring(text, 1, 2))


def training_paragraphs(documents: DataFrame, checked: DataFrame, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """A bounded sample of labelled paragraphs: ``text``, ``label``, ``trusted``.

    At most about ``CHECKED_PER_LANGUAGE`` hand-checked documents of each
    language and ``STATED_PER_LANGUAGE`` by stated label, chosen by a hash of the
    id, with ``PARAGRAPHS_PER_DOCUMENT`` whole paragraphs each.
    """
    labels = checked.select("doc_id", F.col("lang_checked").alias("label")).where(F.col("label").isin(list(languages))).dropDuplicates(["doc_id"])
    stated = documents.select("doc_id", stated_language(F.col("lang")).alias("label")).where(F.col("label").isin(list(languages)))
    unit = (F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) / float(1 << 20)).alias("unit")

    def chosen(df, most, trusted):
        counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        # One row per language: the list is a constant.
        return df.withColumn("unit", unit).join(F.broadcast(counts), "label").where(F.col("unit") * F.col("n") < most).select("doc_id", "label", F.lit(trusted).alias("trusted"))

    # Both samples are bounded by the parameters, so they may be broadcast.
    sample = chosen(labels, CHECKED_PER_LANGUAGE, True).unionByName(chosen(stated, STATED_PER_LANGUAGE, False))
    best = sample.groupBy("doc_id").agg(F.max_by("label", "trusted").alias("label"), F.max("trusted").alias("trusted"))
    reach_workers(documents.sparkSession)
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(best), "doc_id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, a, bool(t)) for x, a, t in zip(pdf["text"], pdf["label"], pdf["trusted"]) for *_, p in paragraphs(x)[:PARAGRAPHS_PER_DOCUMENT]]
            yield pd.DataFrame(rows, columns=["text", "label", "trusted"])

    return texts.select("text", "label", "trusted").mapInPandas(cut, "text string, label string, trusted boolean")


_fitted: dict[tuple, Model] = {}


def fit_languages(documents: DataFrame, checked: DataFrame, languages: Sequence[str] = LANGUAGES) -> Model:
    """Trains the model on the driver from :func:`training_paragraphs`, whose size the parameters bound.

    The last model is kept for the same tables of the same application, so that
    several queries train once.
    """
    app = documents.sparkSession.sparkContext.applicationId
    sizes = (CHECKED_PER_LANGUAGE, STATED_PER_LANGUAGE, PARAGRAPHS_PER_DOCUMENT)
    key = (app, documents.semanticHash(), checked.semanticHash(), tuple(languages), sizes)
    if key not in _fitted:
        rows = sorted(tuple(r) for r in training_paragraphs(documents, checked, languages).collect())
        _fitted.clear()
        _fitted[key] = train([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], languages)
    return _fitted[key]


def language_segments(documents: DataFrame, model: Model) -> DataFrame:
    """The language of every stretch of every document.

    Each paragraph of sentences is embedded as the average of its hashed subword
    vectors and classified by a linear softmax; neighbouring paragraphs of one
    language form a stretch. The documents are read in place and never shuffled;
    whole texts are read. The model (one row of logits per bucket) has a fixed
    size.

    Output: ``doc_id``, ``segment_no`` (from 1), ``first_char``, ``last_char``
    (positions from 0, the last not included), ``n_paragraphs``, ``lang``,
    ``confidence`` (the mean over the stretch). ``lang`` is null where the
    confidence is below the model's calibrated limit. Null, empty and wordless
    texts, card lists and bare names have no stretch.
    """
    schema = "doc_id bigint, segment_no int, first_char int, last_char int, n_paragraphs int, lang string, confidence double"
    reach_workers(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for pdf in batches:
            ids, spans, texts = [], [], []
            for d, text in zip(pdf["doc_id"], pdf["text"]):
                for a, b, prose in paragraphs(text):
                    ids.append(d)
                    spans.append((a, b))
                    texts.append(prose)
            p = model.confidences(texts)
            rows: list[list] = []
            for d, (a, b), q in zip(ids, spans, p):
                k = int(q.argmax())
                sure = float(q[k])
                lang = model.languages[k] if sure >= model.least else None
                if not sure:
                    continue
                last = rows[-1] if rows and rows[-1][0] == d else None
                if last is not None and last[5] == lang:
                    last[6] = (last[6] * last[4] + sure) / (last[4] + 1)
                    last[4] += 1
                    last[3] = b
                else:
                    rows.append([d, last[1] + 1 if last is not None else 1, a, b, 1, lang, sure])
            yield pd.DataFrame(rows, columns=["doc_id", "segment_no", "first_char", "last_char", "n_paragraphs", "lang", "confidence"])

    slim = documents.select(F.col("doc_id").cast("bigint"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return slim.mapInPandas(run, schema)


def document_languages(segments: DataFrame) -> DataFrame:
    """The main language of each document: most paragraphs, of equals the higher confidence, then by name; rejected stretches count for none."""
    by = segments.where(F.col("lang").isNotNull()).groupBy("doc_id", "lang").agg(F.sum("n_paragraphs").alias("n"), (F.sum(F.col("confidence") * F.col("n_paragraphs")) / F.sum("n_paragraphs")).alias("confidence"))
    best = by.groupBy("doc_id").agg(F.max(F.struct("n", "confidence", "lang")).alias("top"), F.sum("n").alias("total"))
    return best.select("doc_id", F.col("top.lang").alias("lang"), F.col("top.confidence").alias("confidence"), (F.col("top.n") / F.col("total")).alias("share"))
