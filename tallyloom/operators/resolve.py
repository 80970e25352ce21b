"""Names to entries without guessing: ranks, ambiguity, links, display forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import MARKS, name_form, nfkc, ratio_bound, sequence_ratio, similarity, trigrams

#: Scores of a typed name against a name (fixed values): equal, part of it, part of it but short, holds it whole,
#: and the least and the range by the share of its words that are found.
EQUAL, PART, SHORT_PART, WHOLE, WORDS, WORDS_RANGE = 1.0, 0.9, 0.6, 0.85, 0.5, 0.3
#: Typed names of up to this many characters are short.
SHORT = 3

#: Stages in order: as written, ignoring case, with one slash read as two (fixed values).
EXACT, ANY_CASE, SLASH = 0, 1, 2


def bare(c: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def _staged(*pairs: tuple[int, Column]) -> list[Column]:
    return [F.struct(F.lit(stage).alias("stage"), key.alias("key")) for stage, key in pairs]


def name_table(cards: DataFrame) -> DataFrame:
    """Every name of every entry: ``id, card_name, digital, name, rank`` (0 full, 1 front, 2 back)."""
    names = F.array(*[F.struct(F.col(c).alias("name"), F.lit(r).alias("rank")) for c, r in (("card_name", 0), ("name_en_front", 1), ("name_en_back", 2))])
    rows = cards.select("id", "card_name", "digital", F.explode(names).alias("n")).select("id", "card_name", "digital", "n.name", "n.rank").where(F.col("name").isNotNull())
    return rows.groupBy("id", "card_name", "digital", "name").agg(F.min("rank").alias("rank"))


def resolve(queries: DataFrame, query: str, names: DataFrame) -> DataFrame:
    """One entry per query or a list of what it could be.

    Stages are tried in order; the first with a hit decides. Of its hits only
    the best rank counts, of these physical ones before digital ones; if they
    are several entries the query is ``ambiguous`` and nothing is chosen. All
    stages are one equality join on (stage, key), so a long list of queries is
    resolved at once. Output: ``query, status, id, candidates, stage``.
    """
    q = queries.select(bare(F.col(query)).alias("query")).where(F.col("query") != "").distinct()
    slashed = F.when(F.col("query").contains(" / ") & ~F.col("query").contains(" // "), F.lower(F.regexp_replace("query", r"\s+/\s+", " // ")))
    keyed = q.select("query", F.explode(F.array(*_staged((EXACT, F.col("query")), (ANY_CASE, F.lower("query")), (SLASH, slashed)))).alias("k")).select("query", "k.*").where(F.col("key").isNotNull())
    low = F.lower("name")
    forms = F.array(*_staged((EXACT, F.col("name")), (ANY_CASE, low), (SLASH, F.when(F.col("rank") == 0, low))))
    index = names.select("id", "card_name", "digital", "rank", F.explode(forms).alias("k")).select("id", "card_name", "digital", "rank", "k.*").where(F.col("key").isNotNull())
    hits = keyed.join(index, ["stage", "key"])
    best = F.min(F.struct("stage", "rank", "digital")).over(Window.partitionBy("query"))
    kept = hits.withColumn("b", best).where(F.struct("stage", "rank", "digital") == F.col("b"))
    found = kept.groupBy("query").agg(F.array_sort(F.collect_set(F.struct("id", "card_name"))).alias("c"), F.min("stage").alias("stage"))
    out = q.join(found, "query", "left")
    one = F.size("c") == 1
    return out.select(
        "query",
        F.when(F.col("c").isNull(), "unknown").when(one, "resolved").otherwise("ambiguous").alias("status"),
        F.when(one, F.col("c")[0]["id"]).alias("id"),
        F.when(~one, F.col("c.card_name")).alias("candidates"),
        "stage",
    )


def repair_links(lines: DataFrame, link: str, raw: str, cards: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Fills missing links from the raw name: brackets stripped, as a full name, with a double slash, as a front face, after the alias table. Links that exist stay."""
    text = bare(F.regexp_replace(raw, r"\[[^\]]*\]", ""))
    double = F.regexp_replace(text, r"\s*/+\s*", " // ")
    out = lines.withColumn("__t", text).withColumn("__d", double)
    if aliases is not None:
        out = out.join(aliases.select(F.col("alias").alias("__t"), F.col("card_name").alias("__a")), "__t", "left").withColumn("__t", F.coalesce("__a", "__t")).drop("__a")
    full = cards.groupBy("card_name").agg(F.min("id").alias("id"))
    front = cards.groupBy("name_en_front").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1")
    for i, (key, table, name) in enumerate((("__t", full, "card_name"), ("__d", full, "card_name"), ("__t", front, "name_en_front"))):
        out = out.join(table.select(F.col(name).alias(key), F.col("id").alias(f"__i{i}")), key, "left")
    return out.withColumn(link, F.coalesce(link, "__i0", "__i1", "__i2")).drop("__t", "__d", "__i0", "__i1", "__i2")


def match_names(values: DataFrame, value: str, cards: DataFrame) -> DataFrame:
    """Full name, front face, either ignoring case, without a leading ``A-``, then ``?`` for one non-ASCII character if unique: ``value, db_name, match_kind``."""
    mark = lambda c: F.regexp_replace(c, r"[^\x00-\x7f]|\?", "?")
    v = values.select(F.col(value).alias("value")).where(F.col("value").isNotNull()).distinct()
    bare = F.when(F.col("value").startswith("A-"), F.substring("value", 3, 1000))
    forms = [(1, F.col("value")), (2, F.col("value")), (3, F.lower("value")), (4, F.lower("value")), (5, bare), (6, bare), (7, F.when(F.col("value").contains("?"), mark(F.col("value"))))]
    keyed = v.select("value", F.explode(F.array(*_staged(*forms))).alias("k")).select("value", "k.*").where(F.col("key").isNotNull())
    full, front = F.col("card_name"), F.split_part("card_name", F.lit(" // "), F.lit(1))
    back = [(1, full), (2, front), (3, F.lower(full)), (4, F.lower(front)), (5, full), (6, front), (7, F.when(full.rlike(r"[^\x00-\x7f]"), mark(full))), (7, F.when(front.rlike(r"[^\x00-\x7f]"), mark(front)))]
    index = cards.select("card_name", F.explode(F.array(*_staged(*back))).alias("k")).select("card_name", "k.*").where(F.col("key").isNotNull()).distinct()
    hits = keyed.join(index, ["stage", "key"]).groupBy("value", "stage").agg(F.min("card_name").alias("name"), F.count(F.lit(1)).alias("n")).where("stage < 7 OR n = 1")
    best = hits.groupBy("value").agg(F.min(F.struct("stage", "name")).alias("b"))
    kind = F.when(F.col("b").isNull(), "none").when(F.col("b.stage").isin(1, 3, 5), "exact").when(F.col("b.stage") == 7, "mojibake").otherwise("front")
    return v.join(best, "value", "left").select("value", F.col("b.name").alias("db_name"), kind.alias("match_kind"))


def display_form(local: Column, name: Column) -> Column:
    """Local and English name together in brackets, or the English name alone."""
    return F.when(local.isNotNull(), F.concat(F.lit("《"), local, F.lit("/"), name, F.lit("》"))).otherwise(name)


def display_name(cards: DataFrame) -> DataFrame:
    """``id, display``: see :func:`display_form`."""
    return cards.select("id", display_form(F.col("japanese_name"), F.col("card_name")).alias("display"))


def near_names(queries: DataFrame, query: str, names: DataFrame, name: str, key: str, k: int = 3, least: float = 0.3, ties: bool = False) -> DataFrame:
    """The ``k`` names most similar by trigrams to every query; with ``ties`` also those as similar as the last.

    Exact prefix filter: texts that share more than ``least`` of all their
    trigrams agree in one of the rarest ``size - floor(least * size)`` of
    either. Only these, ordered by how many names have them, go into the
    inverted index, so frequent trigrams hardly ever meet. The candidates, one
    row for each pair whose sizes can pass ``least``, get their trigrams back
    and are compared exactly. Ties go to the smaller key, then name.
    """
    q = queries.select(F.col(query).alias("query")).where(F.col("query").isNotNull()).distinct().select("query", trigrams(F.col("query")).alias("qt"), F.xxhash64("query").alias("qid"))
    n = names.select(F.col(key).alias("key"), F.col(name).alias("name")).where(F.col("name").isNotNull()).distinct().select("key", "name", trigrams(F.col("name")).alias("nt"), F.xxhash64("key", "name").alias("nid"))
    n_grams = n.select("nid", F.size("nt").alias("nn"), F.explode("nt").alias("g"))
    df = n_grams.groupBy("g").agg(F.count(F.lit(1)).alias("df"))

    def rarest(grams: DataFrame, id_: str, size: str) -> DataFrame:
        order = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")))
        keep = F.col(size) - F.floor(F.col(size) * F.lit(least) - F.lit(1e-9)).cast("int")
        ranked = grams.join(df, "g", "left").groupBy(id_, size).agg(order.alias("o"))
        return ranked.select(id_, size, F.explode(F.slice("o", F.lit(1), F.greatest(keep, F.lit(1)))).alias("x")).select(id_, size, "x.g")

    left = rarest(q.select("qid", F.size("qt").alias("qn"), F.explode("qt").alias("g")), "qid", "qn")
    right = rarest(n_grams, "nid", "nn")
    fits = (F.col("qn") > F.col("nn") * F.lit(least)) & (F.col("nn") > F.col("qn") * F.lit(least))
    pairs = left.join(right, "g").where(fits).select("qid", "nid").distinct()
    scored = pairs.join(q, "qid").join(n, "nid").select("query", "key", "name", F.round(similarity(F.col("qt"), F.col("nt")), 6).alias("similarity")).where(F.col("similarity") > least)
    w = Window.partitionBy("query")
    place = F.rank().over(w.orderBy(F.col("similarity").desc())) if ties else F.row_number().over(w.orderBy(F.col("similarity").desc(), "key", "name"))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def _forms(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds the compared form of a text, its ASCII words and those as one padded text."""
    low = F.lower(nfkc(F.col(text)))
    words = F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "")
    out = df.withColumn(f"{prefix}form", name_form(F.col(text))).withColumn(f"{prefix}words", words)
    return out.withColumn(f"{prefix}run", F.concat(F.lit(" "), F.array_join(f"{prefix}words", " "), F.lit(" ")))


def name_scores(queries: DataFrame, query: str, entries: DataFrame, scope: str, names: str, key: str, least: float, fuzzy: bool = True) -> DataFrame:
    """How near typed names are to the entries of their scope, from ``least`` up: ``scope, query, key, score``.

    An entry's score is that of its nearest name. 1: equal without marks. 0.9:
    the query is part of the name (0.6 if it has three characters or fewer).
    0.85: the name is part of the query. Else 0.5 to 0.8 by the share of the
    query's words found in the name, or the order-sensitive ratio if that is
    higher (left out with ``fuzzy=False``). Queries in ASCII are compared word
    by word, others by their characters. Short queries are only looked for.

    Every text is brought to its forms once; the rest are native expressions
    over the pairs, and only pairs that none of the rules decides and whose
    lengths let them reach ``least`` are given to the ratio. A query without
    letters scores nothing; null queries and names are left out.
    """
    q = queries.select(scope, F.col(query).alias("query")).where(F.col("query").isNotNull()).distinct()
    q = _forms(q, "query", "q_").where(F.col("q_form") != "").withColumn("q_plain", ~F.col("q_form").rlike(r"[^\x00-\x7f]"))
    cut = F.filter(F.transform(F.split("query", r"\s+"), lambda p: F.regexp_replace(F.lower(p), MARKS, "")), lambda p: F.length(p) > 1)
    q = q.withColumn("q_parts", F.when(F.col("q_plain"), F.filter("q_words", lambda w: F.length(w) > 1)).otherwise(cut))
    n = entries.select(scope, F.col(key).alias("key"), F.explode(names).alias("name")).where(F.col("name").isNotNull()).distinct()
    n = _forms(n, "name", "n_").where(F.col("n_form") != "")
    pairs = q.join(n, scope)
    qf, nf, plain = F.col("q_form"), F.col("n_form"), F.col("q_plain")
    short = F.length(qf) <= SHORT
    inside = F.when(plain, (F.size("q_words") > 0) & F.contains("n_run", "q_run")).otherwise((F.length(qf) > 1) & F.contains(nf, qf))
    around = F.when(plain, (F.size("n_words") > 0) & F.contains("q_run", "n_run")).otherwise((F.length(nf) > 1) & F.contains(qf, nf))
    found = F.size(F.filter("q_parts", lambda p: F.when(plain, F.array_contains("n_words", p)).otherwise(F.contains(nf, p))))
    words = F.when((F.size("q_parts") > 1) & (found > 0), WORDS + WORDS_RANGE * found / F.size("q_parts")).otherwise(F.lit(0.0))
    sure = (
        F.when(qf == nf, F.lit(EQUAL))
        .when(inside, F.when(short, F.lit(SHORT_PART)).otherwise(F.lit(PART)))
        .when(short, F.lit(0.0))
        .when(around, F.lit(WHOLE))
    )
    judged = pairs.select(scope, "query", "key", "q_form", "n_form", sure.alias("sure"), words.alias("words"))
    score = F.coalesce("sure", "words")
    if fuzzy:
        bound = ratio_bound(F.col("q_form"), F.col("n_form"))
        open_ = F.col("sure").isNull() & (bound >= least) & (bound > F.col("words"))
        ratio = sequence_ratio(F.when(open_, F.col("q_form")), F.when(open_, F.col("n_form")))
        score = F.coalesce("sure", F.greatest("words", F.coalesce(ratio, F.lit(0.0))))
    best = judged.withColumn("score", score).groupBy(scope, "query", "key").agg(F.round(F.max("score"), 6).alias("score"))
    return best.where(F.col("score") >= least)


def near_in_list(queries: DataFrame, query: str, entries: DataFrame, scope: str, names: str, key: str, k: int = 3, least: float = 0.5, fuzzy: bool = True) -> DataFrame:
    """The ``k`` nearest entries within the query's own scope (a set of some hundred entries), and the ties cut off.

    ``entries`` has an array of names per entry; both sides have ``scope``. The
    distinct queries are a stated query set against their list; see :func:`name_scores`.
    """
    scored = name_scores(queries, query, entries, scope, names, key, least, fuzzy)
    w = Window.partitionBy(scope, "query")
    ranked = scored.withColumn("place", F.row_number().over(w.orderBy(F.col("score").desc(), "key")))
    last = F.min(F.when(F.col("place") <= k, F.col("score"))).over(w)
    return ranked.withColumn("ties_left", F.count_if((F.col("place") > k) & (F.col("score") == last)).over(w)).where(F.col("place") <= k)


def close_key(value: str, allowed: list[str], cutoff: float = 0.8) -> tuple[str | None, str]:
    """A parameter against a closed list: as it is, or the only close one (``corrected``), else refused as ``ambiguous`` or ``unknown``."""
    import difflib

    low = {a.lower(): a for a in allowed}
    if value.lower() in low:
        return low[value.lower()], "exact"
    near = difflib.get_close_matches(value.lower(), list(low), n=3, cutoff=cutoff)
    return (low[near[0]], "corrected") if len(near) == 1 else (None, "ambiguous" if near else "unknown")


def similarity_of(a: Column, b: Column) -> Column:
    return similarity(trigrams(a), trigrams(b))
