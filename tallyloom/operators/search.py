"""Parts of searches over texts: by number, by ranked terms, by all of several words. The cascades over many questions are in ``answers``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import search_tokens, stems


def number_lookup(rules: DataFrame, number: str) -> DataFrame:
    """The rule of a number and its direct children, not other rules that begin alike."""
    n = number.strip().rstrip(".")
    rest = F.substring("number", len(n) + 1, 1000)
    return rules.where(F.col("number").startswith(n) & rest.rlike(r"^(\.\d+[a-z]?|[a-z])?$"))


def term_index(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Inverted index ``term, key, tf, length``, built once and kept as a table for many searches."""
    tokens = texts.select(F.col(key).alias("key"), search_tokens(F.col(text)).alias("tokens"))
    return tokens.select("key", F.size("tokens").alias("length"), F.explode("tokens").alias("term")).groupBy("key", "term", "length").agg(F.count(F.lit(1)).alias("tf"))


def ranked_search(index: DataFrame, text: str, k: int = 12) -> DataFrame:
    """Texts with all terms, or, if none has all and there are two or more, with any; by matched terms, frequency and brevity.

    The score is the sum over terms of ``tf / (tf + length / 100)``; it is our own
    and compared only within one search.
    """
    terms = sorted(set(stems(text)))
    if not terms:
        return index.select("key", F.lit(0).alias("n_terms"), F.lit(0.0).alias("score"), F.lit("").alias("mode")).limit(0)
    hits = index.where(F.col("term").isin(terms)).groupBy("key").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum(F.col("tf") / (F.col("tf") + F.col("length") / 100.0)), 6).alias("score"))
    most = hits.agg(F.max("n_terms").alias("m")).select("m").scalar()
    mode = F.when(most == len(terms), "all").otherwise("any")
    kept = hits.where((most < len(terms)) | (F.col("n_terms") == len(terms))).withColumn("mode", mode)
    return kept.orderBy(F.col("score").desc(), "key").limit(k)


def contains_all(columns: Sequence[str], terms: Sequence[str]) -> Column:
    """Every term stands in at least one of the columns, ignoring case."""
    out = F.lit(True)
    for t in terms:
        some = F.lit(False)
        for c in columns:
            some = some | F.coalesce(F.contains(F.lower(c), F.lit(t.lower())), F.lit(False))
        out = out & some
    return out
