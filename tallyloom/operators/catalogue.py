"""Rollups over catalogues: printings, release states, structured columns from text, codes, verification."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tallyloom.common import reach_workers
from tallyloom.operators.resolve import near_names
from tallyloom.session import checkpoint_dir


def printings(rows: DataFrame, key: str, set_code: str, released: str, local: str, digital: str) -> DataFrame:
    """All sets of each entry (physical ones only, unless it has none) and its latest non-null local value, ties by the larger value."""
    has_physical = F.bool_or(~F.col(digital))
    physical, all_ = F.collect_set(F.when(~F.col(digital), F.col(set_code))), F.collect_set(set_code)
    latest = F.max(F.when(F.col(local).isNotNull(), F.struct(F.col(released).alias("r"), F.col(local).alias("v"))))
    return rows.groupBy(key).agg(F.array_sort(F.when(has_physical, physical).otherwise(all_)).alias("sets"), latest["v"].alias("local"))


def canonical_rows(rows: DataFrame, key: str, eligible: Column, score: Column, position: str) -> DataFrame:
    """The eligible row with the highest score of each key, of equals the first."""
    rest = [c for c in rows.columns if c != key]
    best = rows.where(eligible).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(score, -F.col(position))).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in rest])


def localised(rows: DataFrame, key: str, name: str, released: str, override: DataFrame | None = None) -> DataFrame:
    """Newest name per key that is in the local script; a manual one wins."""
    good = rows.where(F.col(name).rlike("[ぁ-んァ-ン一-龯]"))
    newest = good.groupBy(key).agg(F.max(F.struct(F.col(released).alias("r"), F.col(name).alias("n"))).alias("b")).select(key, F.col("b.n").alias("name"))
    if override is None:
        return newest
    manual = override.select(key, F.col(name).alias("manual"))
    return newest.join(manual, key, "outer").select(key, F.coalesce("manual", "name").alias("name"))


def release_state(first: Column, as_of: Column, kind: Column, waiting_days: int = 7) -> Column:
    """``upcoming`` before the date, ``awaiting`` shortly after it, ``ordinary`` later, ``unknown`` without date or kind."""
    days = F.datediff(as_of, first)
    return F.when(first.isNull() | kind.isNull(), "unknown").when(days < 0, "upcoming").when(days < waiting_days, "awaiting").otherwise("ordinary")


def calendar_window(df: DataFrame, day: str, as_of: Column, before: int, after: int) -> DataFrame:
    """Rows dated from ``before`` days before to ``after`` days after a day."""
    return df.where(F.col(day).between(F.date_sub(as_of, before), F.date_add(as_of, after)))


def prefer(*choices: Column) -> Column:
    """The first of several values that is there and not blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in choices])


def combo_sections(combos: DataFrame, have: Sequence[str], colours: Sequence[str], cap: int = 10) -> DataFrame:
    """Combos by what is missing: complete, one piece short, or one piece and another colour; each section capped with its total.

    ``combos``: ``combo_id, pieces, identity, popularity``.
    """
    missing = F.array_except("pieces", F.array(*[F.lit(x) for x in have]))
    foreign = F.size(F.array_except("identity", F.array(*[F.lit(c) for c in colours]))) > 0
    section = F.when(F.size(missing) == 0, "complete").when((F.size(missing) == 1) & ~foreign, "one short").when(F.size(missing) == 1, "one short, other colour")
    w = Window.partitionBy("section")
    rows = combos.select("combo_id", "popularity", missing.alias("missing"), section.alias("section")).where("section IS NOT NULL")
    ranked = rows.withColumn("place", F.row_number().over(w.orderBy(F.col("popularity").desc_nulls_last(), "combo_id"))).withColumn("total", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("place") <= cap)


#: A structured clause: name, pattern with named groups, and groups read as numbers.
Rule = tuple[str, str]


def clauses(df: DataFrame, key: str, text: str, rules: Sequence[Rule]) -> DataFrame:
    """Structured clauses found in texts: ``key, rule, at, amount, target``; reminder text in brackets is skipped.

    Patterns are compiled once per worker and read in Arrow batches, since named
    groups and several passes over one text are beyond the native functions.
    """
    compiled = [(name, p) for name, p in rules]
    reach_workers(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns = [(n, re.compile(p, re.IGNORECASE)) for n, p in compiled]
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["key"], pdf["text"]):
                plain = re.sub(r"\([^()]*\)", "", t or "")
                for n, p in patterns:
                    for m in p.finditer(plain):
                        g = m.groupdict()
                        amount = g.get("amount")
                        rows.append((k, n, m.start(), int(amount) if amount and amount.isdigit() else None, g.get("target")))
            yield pd.DataFrame(rows, columns=["key", "rule", "at", "amount", "target"]).astype({"amount": "Int32"})

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, "key bigint, rule string, at int, amount int, target string")


def face_filter(faces: Column, castable: Column | None = None) -> Column:
    """Faces that can be used on their own: those with a cost, or all without land type; with their text joined."""
    kept = F.filter(faces, lambda f: f["mana_cost"].isNotNull() & (f["mana_cost"] != "") & ~F.coalesce(f["type_line"].contains("Land"), F.lit(False)))
    return F.array_join(F.transform(kept, lambda f: F.coalesce(f["oracle_text"], F.lit(""))), "\n//\n")


def front_keywords(df: DataFrame, key: str, text: Column, vocabulary: DataFrame, word: str) -> DataFrame:
    """Which words of a vocabulary stand in the front of each text (up to ``//``), ignoring case: ``key``, ``words``, sorted.

    The words of the texts meet the vocabulary in an equality join, so either may be long. A text without any has an empty array.
    """
    front = F.lower(F.split_part(text, F.lit(" // "), F.lit(1)))
    words = df.select(key, F.explode(F.array_distinct(F.split(front, r"[^\p{L}\p{N}]+"))).alias("__w")).where("__w <> ''")
    found = words.join(vocabulary.select(F.lower(word).alias("__w")).distinct(), "__w", "left_semi").groupBy(key).agg(F.array_sort(F.collect_list("__w")).alias("words"))
    return df.select(key).join(found, key, "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


def encode_codes(df: DataFrame, version: str, scope: str, names: Column) -> DataFrame:
    """A state as text: version, scope, number of names, check sum and names, joined by a bar."""
    head = F.concat_ws("|", F.lit(version), F.col(scope), F.size(names).cast("string"))
    body = F.concat_ws("|", head, F.array_join(names, "|"))
    check = F.lpad(F.lower(F.hex(F.crc32(F.encode(body, "UTF-8")))), 8, "0")
    return df.withColumn("code", F.concat_ws("|", head, check, F.array_join(names, "|")))


def decode_codes(df: DataFrame, code: str, versions: Sequence[str] = ("SD1", "SS1")) -> DataFrame:
    """Reads codes back; any change makes the state ``malformed``, ``unsupported``, ``count`` or ``checksum`` instead of ``ok``."""
    p = F.split(code, r"\|", -1)
    names = F.slice(p, 5, F.greatest(F.size(p) - 4, F.lit(0)))
    get = lambda i: F.try_element_at(p, F.lit(i))
    body = F.concat_ws("|", get(1), get(2), get(3), F.array_join(names, "|"))
    check = F.lpad(F.lower(F.hex(F.crc32(F.encode(body, "UTF-8")))), 8, "0")
    shaped = (F.size(p) >= 5) & get(2).rlike(r"^[A-Za-z0-9_]{1,20}$") & get(3).rlike(r"^[1-9]\d{0,2}$") & get(4).rlike(r"^[0-9a-f]{8}$") & F.forall(names, lambda n: (n != "") & ~n.rlike(r"[\x00-\x1f\x7f]"))
    state = (
        F.when(F.col(code).isNull() | ~F.coalesce(shaped, F.lit(False)), "malformed").when(~get(1).isin(list(versions)), "unsupported").when(get(3).try_cast("int") != F.size(names), "count").when(check != get(4), "checksum").otherwise("ok")
    )
    good = state == "ok"
    return df.select("*", state.alias("state"), F.when(good, get(2)).alias("scope"), F.when(good, names).alias("names"))


def apply_picks(known: DataFrame, picks: DataFrame, game: str) -> DataFrame:
    """Picks by position onto a recorded list: ``resent`` (same), ``conflict`` (another), ``added`` (next in line) or ``gap``.

    Both have ``game, position, item``; a position is added only if all before it
    are there.
    """
    p = picks.groupBy(game, "position").agg(F.min("item").alias("item"), F.countDistinct("item").alias("n"))
    have = known.groupBy(game).agg(F.max("position").alias("last"))
    joined = p.join(known.withColumnRenamed("item", "old"), [game, "position"], "left").join(have, game, "left").withColumn("last", F.coalesce("last", F.lit(0)))
    fresh = F.col("position") > F.col("last")
    run = F.row_number().over(Window.partitionBy(game, fresh).orderBy("position"))
    state = F.when(F.col("n") > 1, "conflict").when(~fresh & (F.col("old") == F.col("item")), "resent").when(~fresh, "conflict").when(F.col("position") == F.col("last") + run, "added").otherwise("gap")
    return joined.select(game, "position", "item", state.alias("state"))


def outcome(kind: Column, seconds: Column, slow: float = 10.0) -> Column:
    """Class of a logged call: bad input, no match, busy, timeout, failure, slow or fine."""
    k = F.lower(kind)
    return (
        F.when(k.rlike("invalid|argument|malformed"), "bad input").when(k.rlike("not found|no match|empty"), "no match").when(k.rlike("busy|limit"), "busy").when(k.rlike("timeout|cancel"), "timeout").when(k.rlike("error|fail"), "failure").when(seconds > slow, "slow").otherwise("fine")
    )


_JAPANESE = re.compile("[\u3005-\u3007\u3041-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f]")


def _ends_word(name_end: str, neighbour: str) -> bool:
    """Whether a name may end here: always in Japanese script, which has no blanks, else where no cased letter goes on."""
    return bool(_JAPANESE.match(name_end)) or neighbour.lower() == neighbour.upper()


def _stands_bare(name: str) -> bool:
    """Whether a name is looked for outside brackets: two characters in Japanese script, five letters or two words in others."""
    return len(name) >= 2 if _JAPANESE.search(name) else len(name) >= 5 or " " in name


#: Name columns of a card: in English and Japanese, whole, front and back.
NAME_COLUMNS = ("card_name", "name_en_front", "name_en_back"), ("japanese_name", "name_ja_front", "name_ja_back")


def name_forms(cards: Iterable[Row]) -> list[tuple[str, str]]:
    """All names of cards with their display form; of entries with the same name the first counts.

    A face has the form of its own face, a whole name that of the front; without
    a Japanese name the form is the English one. English names count in the order
    whole, front, back, then physical cards first; Japanese ones physical cards
    first, then in that order.
    """
    by_rank: tuple[list, list, list] = [], [], []
    local = []
    for r in sorted(cards, key=lambda r: (bool(r["digital"]), r["card_name"])):
        en, ja = ([r[c] for c in columns] for columns in NAME_COLUMNS)
        front = en[1] or en[0].split(" // ")[0], ja[1] or (ja[0] or "").split(" // ")[0]
        for rank, (e, j) in enumerate((front, front, (en[2], ja[2]))):
            form = f"《{j}/{e}》" if j else e
            if en[rank]:
                by_rank[rank].append((en[rank], form))
                if ja[rank]:
                    local.append((ja[rank], form))
    return [x for part in (*by_rank, local) for x in part]


#: Names a worker holds at once; a longer dictionary is matched in blocks of about this many.
BLOCK_NAMES = 200_000


def name_dictionary(cards: DataFrame) -> DataFrame:
    """The dictionary of :func:`name_forms` as a table, in lower case, the forms themselves included: ``name``, ``form``."""
    (whole, front, back), (local, local_front, local_back) = NAME_COLUMNS
    blank = lambda c: F.nullif(c, F.lit(""))
    en = F.coalesce(blank(F.col(front)), F.split_part(whole, F.lit(" // "), F.lit(1)))
    ja = F.coalesce(blank(F.col(local_front)), blank(F.split_part(F.coalesce(local, F.lit("")), F.lit(" // "), F.lit(1))))
    form = lambda e, j: F.when(j.isNotNull(), F.concat(F.lit("《"), j, F.lit("/"), e, F.lit("》"))).otherwise(e)
    of_front, of_back = form(en, ja), form(F.col(back), blank(F.col(local_back)))
    named = [(whole, of_front, 0, 0, None), (front, of_front, 1, 1, None), (back, of_back, 2, 2, None), (local, of_front, 3, 0, whole), (local_front, of_front, 3, 1, front), (local_back, of_back, 3, 2, back)]
    rows = []
    for name, shown, part, rank, needs in named:
        there = F.coalesce(F.col(name) != "", F.lit(False)) & (F.coalesce(F.col(needs) != "", F.lit(False)) if needs else F.lit(True))
        for offset, text in ((0, F.col(name)), (4, shown)):
            rows.append(F.when(there, F.struct(F.lower(text).alias("name"), F.lit(part + offset).alias("part"), F.col("digital"), F.col(whole).alias("c"), F.lit(rank).alias("rank"), shown.alias("form"))))
    flat = cards.select(F.explode(F.array_compact(F.array(*rows))).alias("r"))
    return flat.groupBy("r.name").agg(F.min(F.struct("r.part", "r.digital", "r.c", "r.rank", "r.form")).alias("b")).select("name", F.col("b.form").alias("form"))


def _low(text: str) -> str:
    """Lower case that keeps every position."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class _Dictionary:
    """Names in lower case with their forms, and one automaton over them."""

    def __init__(self, known: dict[str, str]):
        import ahocorasick

        self.known = known
        self.tree = ahocorasick.Automaton()
        for n in known:
            self.tree.add_word(n, n)
        if known:
            self.tree.make_automaton()

    def find(self, t: str) -> list[tuple[int, int, int, str | None]]:
        """All mentions of a text: begin, end, level, form. Level 0 to 2 and up: brackets known as a whole, without them, by a part; -1: bare."""
        out: list[tuple[int, int, int, str | None]] = []
        for m in re.finditer("《[^《》]*》", t):
            inner = m.group()[1:-1]
            tries = [m.group(), inner, *[p.strip() for p in inner.split("/")]]
            level = next((i for i, x in enumerate(tries) if _low(x) in self.known), None)
            out.append((m.start(), m.end(), UNKNOWN if level is None else level, None if level is None else self.known[_low(tries[level])]))
        for end, n in self.tree.iter(_low(t)) if self.known else ():
            a, b = end - len(n) + 1, end + 1
            if _stands_bare(n) and _ends_word(n[0], t[a - 1 : a]) and _ends_word(n[-1], t[b : b + 1]):
                out.append((a, b, BARE, self.known[n]))
        return out


#: Levels of brackets that hold no known name, and of names outside of brackets.
UNKNOWN, BARE = 1 << 20, -1


def _settle(found, written) -> list[tuple[int, str, str | None, str]]:
    """Mentions that count: of the findings of one bracket the lowest level, of overlapping bare names the longest, of equals the first."""
    best: dict[tuple[int, int], tuple[int, str | None]] = {}
    bare = []
    for a, b, level, form in found:
        if level == BARE:
            bare.append((a - b, a, b, form))
        elif (a, b) not in best or level < best[a, b][0]:
            best[a, b] = (level, form)
    rows, taken = [], sorted(best)
    for (a, b), (_, form) in sorted(best.items()):
        rows.append((a, written(a, b), form, "unknown" if form is None else "ok" if form == written(a, b) else "rewrite"))
    for _, a, b, form in sorted(bare):
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            rows.append((a, written(a, b), form, "bare"))
    return rows


_MENTIONS = "key bigint, at int, written string, canonical string, state string"


def verify_mentions(texts: DataFrame, key: str, text: str, names: Sequence[tuple[str, str]]) -> DataFrame:
    """Names written in texts against a dictionary of (name, canonical form): ``key, at, written, canonical, state``.

    Bracketed names are ``ok``, ``rewrite`` (another form of a known name) or
    ``unknown``; known names outside brackets are ``bare``, but for one-word names
    of less than five letters and Japanese ones of one character. Names in Japanese
    script are found inside running text, others as whole words. Of overlapping
    names the longest counts, of entries with the same name the first. The dictionary
    is compiled to one automaton per worker; its size is the caller's bound (see
    :func:`verify_texts` for any size).
    """
    known: dict[str, str] = {}
    for n, c in [*names, *((c, c) for _, c in names)]:
        known.setdefault(_low(n), c)
    return _verified(texts, key, text, known)


def _verified(texts: DataFrame, key: str, text: str, known: dict[str, str]) -> DataFrame:
    reach_workers(texts.sparkSession)
    sent = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dictionary = _Dictionary(sent.value)
        for pdf in batches:
            rows = [(k, *r) for k, t in zip(pdf["key"], pdf["text"]) if t for r in _settle(dictionary.find(t), lambda a, b, t=t: t[a:b])]
            yield pd.DataFrame(rows, columns=["key", "at", "written", "canonical", "state"])

    return texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, _MENTIONS)


def verify_texts(texts: DataFrame, key: str, text: str, cards: DataFrame) -> DataFrame:
    """:func:`verify_mentions` against all names of ``cards``, however many.

    Up to ``BLOCK_NAMES`` names go to every worker as one broadcast. More are
    matched block by block: each pass gives all findings of its block, which
    are checkpointed, and the findings of a text, which its length bounds, are
    settled together. Texts need unique keys there.
    """
    checkpoint_dir(texts.sparkSession)
    names = name_dictionary(cards).checkpoint()
    count = names.count()
    if count <= BLOCK_NAMES:
        return _verified(texts, key, text, {r["name"]: r["form"] for r in names.collect()})
    reach_workers(texts.sparkSession)
    blocks = -(-count // BLOCK_NAMES)
    slim = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")

    def found_in(block: DataFrame):
        sent = texts.sparkSession.sparkContext.broadcast({r["name"]: r["form"] for r in block.collect()})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            dictionary = _Dictionary(sent.value)
            for pdf in batches:
                rows = [(k, a, b, level, form, t[a:b]) for k, t in zip(pdf["key"], pdf["text"]) for a, b, level, form in dictionary.find(t)]
                yield pd.DataFrame(rows, columns=["key", "a", "b", "level", "form", "written"])

        return slim.mapInPandas(run, "key bigint, a int, b int, level int, form string, written string").checkpoint()

    parts = [found_in(names.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == i)) for i in range(blocks)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    grouped = every.groupBy("key").agg(F.collect_list(F.struct("a", "b", "level", "form", "written")).alias("found"))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, found in zip(pdf["key"], pdf["found"]):
                words = {(f["a"], f["b"]): f["written"] for f in found}
                rows += [(k, *r) for r in _settle([(f["a"], f["b"], f["level"], f["form"]) for f in found], lambda a, b, w=words: w[a, b])]
            yield pd.DataFrame(rows, columns=["key", "at", "written", "canonical", "state"])

    return grouped.mapInPandas(settle, _MENTIONS)


def mention_candidates(mentions: DataFrame, cards: DataFrame, k: int = 3, least: float = 0.35) -> DataFrame:
    """The cards most similar by trigrams to each distinct unknown mention: ``asked`` (without brackets), ``id``, ``card_name``, ``similarity``, ``place``."""
    asked = mentions.where("state = 'unknown'").select(F.expr("substring(written, 2, length(written) - 2)").alias("asked")).distinct()
    got = near_names(asked, "asked", cards, "card_name", "id", k, least)
    return got.select(F.col("query").alias("asked"), F.col("key").alias("id"), F.col("name").alias("card_name"), "similarity", "place")


def rewritten(texts: DataFrame, key: str, text: str, mentions: DataFrame) -> DataFrame:
    """Texts with every ``rewrite`` and ``bare`` mention replaced by its canonical form: ``key``, ``text``, ``n_changed``.

    Native: the places of a text, in order, cut it into pieces that are joined with the forms between them.
    """
    wrong = mentions.where("state IN ('rewrite', 'bare')").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "written", "canonical"))).alias("m"))
    joined = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).join(wrong, "key", "left")
    start = F.struct(F.lit(1).alias("pos"), F.lit("").alias("out"))
    step = lambda acc, m: F.struct(
        (m["at"] + F.length(m["written"]) + 1).alias("pos"), F.concat(acc["out"], F.substr(F.col("text"), acc["pos"], m["at"] + 1 - acc["pos"]), m["canonical"]).alias("out")
    )
    end = lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["pos"]))
    return joined.select("key", F.when(F.col("m").isNull(), F.col("text")).otherwise(F.aggregate("m", start, step, end)).alias("text"), F.coalesce(F.size("m"), F.lit(0)).alias("n_changed"))


def fidelity(found: DataFrame) -> DataFrame:
    """Share of mentions written in their canonical form, by text."""
    n = F.count(F.lit(1))
    return found.groupBy("key").agg(n.alias("n"), F.round(F.count_if(F.col("state") == "ok") / n, 4).alias("faithful"))


#: Layouts of items that a pool can place (fixed values).
LAYOUTS = ("normal", "adventure", "modal_dfc", "split", "transform", "flip", "saga", "class", "leveler", "mutate", "prototype")


def classify(forms: Column, type_line: Column, cost: Column) -> Column:
    """Bucket of an item in a pool: ``lands``, ``curve``, ``not castable`` (no cost), or ``unclassified`` (unknown layout)."""
    known = forms.isin(list(LAYOUTS))
    return F.when(~known | forms.isNull(), "unclassified").when(F.coalesce(type_line.contains("Land"), F.lit(False)), "lands").when(cost.isNull(), "not castable").otherwise("curve")


def pool_summary(pool: DataFrame, bucket: Column, value: Column) -> DataFrame:
    """Items by bucket and curve value; the counts add up to the pool."""
    v = F.when(bucket == "curve", F.least(value.cast("int"), F.lit(7)))
    return pool.groupBy(bucket.alias("bucket"), v.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def pool_facets(pool: DataFrame, bucket: Column, value: Column, colours: Column, type_line: Column, types: Sequence[str]) -> DataFrame:
    """A pool by bucket, curve value, colours and types: ``facet, member, n``.

    Buckets, curve and colour groups (the colours together, ``C`` for none) each
    add up to their part of the pool. ``colour`` counts an item once under each
    of its colours, ``type`` under each of its types (``other`` for none).
    """
    of = lambda facet, member: F.struct(F.lit(facet).alias("facet"), member.alias("member"))
    have = F.coalesce(colours, F.array().cast("array<string>"))
    line = F.coalesce(type_line, F.lit(""))
    kinds = F.filter(F.array(*[F.lit(t) for t in types]), lambda t: F.contains(line, t))
    single = F.array(of("bucket", bucket), of("curve", F.when(bucket == "curve", F.least(value.cast("int"), F.lit(7)).cast("string"))), of("colours", F.when(F.size(have) > 0, F.array_join(F.array_sort(have), "")).otherwise(F.lit("C"))))
    many = F.concat(F.transform(F.array_distinct(have), lambda c: of("colour", c)), F.transform(F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit("other"))), lambda t: of("type", t)))
    return pool.select(F.inline(F.concat(single, many))).where("member IS NOT NULL").groupBy("facet", "member").agg(F.count(F.lit(1)).alias("n"))
