"""Joins of strings that contain or resemble each other, by shared pieces instead of all pairs.

Strings are named by their MD5 digests while pieces meet, so that a piece never carries its whole string; texts come
back for the pairs that are verified. Pieces are cut from an array of letters, in time linear in the length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave.sources.folders import stored

#: Letters of a gram.
GRAM = 3
#: Terms of so many letters in all are sent to the values' tasks, with their grams at most 60 MB; more of them meet by shuffles.
SENT_LETTERS = 500_000


def _named(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, column): distinct strings that have a letter, each with its digest.

    Dealt to as many tasks as a shuffle has: few bytes of strings give many pieces, and tasks planned by bytes would be one or two.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(column).where(F.col(column) != "").distinct().select(F.md5(F.col(column)).alias(key), column).repartition(tasks, key)


def _grams(text: Column, n: int) -> Column:
    """All runs of `n` letters of a text, in one pass of a pattern that looks `n` letters ahead and goes on by one."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def containing(values: DataFrame, terms: DataFrame, value: str = "value", term: str = "term", least: int = 1) -> DataFrame:
    """(value, term): distinct pairs of which the value contains the term, terms of `least` letters or more.

    A term lies in a value only if all its grams do, so it is looked up by the one that fewest values have; a term of
    fewer letters than a gram is one itself. Terms with a gram that no value has meet nothing. Nulls and empty strings match nothing.
    Pairs are the same whether the terms are sent (`SENT_LETTERS`) or shuffled.
    """
    v, t = _named(values, value, "_value_id"), _named(terms, term, "_term_id").where(F.length(term) >= least)
    width = F.least(F.length(term), F.lit(GRAM))
    widths = t.groupBy(width.alias("n")).agg(F.sum(F.length(term)).alias("letters")).collect()  # up to GRAM rows
    sizes = [r["n"] for r in widths]
    send = F.broadcast if sum(r["letters"] for r in widths) <= SENT_LETTERS else lambda df: df
    if not sizes:
        return values.select(value, F.lit(None).cast("string").alias(term)).limit(0)
    pick = F.array().cast("array<string>")
    for n in sizes:
        pick = F.when(width == n, _grams(F.col(term), n)).otherwise(pick)
    wanted = t.select("_term_id", F.explode(F.array_distinct(pick)).alias("gram"))
    postings = v.select("_value_id", F.explode(F.array_distinct(F.concat(*(_grams(F.col(value), n) for n in sizes)))).alias("gram"))
    # grams that no term has go before anything is shuffled; the rest is read twice
    postings = stored(postings.join(send(wanted.select("gram").distinct()), "gram", "left_semi"), "postings")
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(counts, "gram", "left").groupBy("_term_id").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    pairs = postings.join(send(rarest), "gram").select("_value_id", "_term_id")
    return pairs.join(v, "_value_id").join(send(t), "_term_id").where(F.col(value).contains(F.col(term))).select(value, term)


def _mismatches(length: Column, share: float) -> Column:
    """Letters that may differ among `length` if `share` of them must agree."""
    return (length - F.ceil(F.round(length * share, 9))).cast("int")


def equal_places(a: Column, b: Column) -> Column:
    """How many letters agree at equal places."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0)))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x)


def alike(values: DataFrame, terms: DataFrame, value: str = "value", term: str = "term", share: float = 0.75, least: int = 4) -> DataFrame:
    """(value, term): distinct pairs whose letters agree at `share` of the shorter one's places, which has `least` letters or more.

    With m mismatches allowed, the places are cut into m + 1 segments, of which one must agree letter for letter. Strings meet by
    (length of the shorter, segment, letters); the longer one gives the segments of each length that the other side has.
    """
    if not math.ceil(round(share * least, 9)) > 0:
        raise ValueError("some letter must agree")
    v, t = _named(values, value, "_value_id"), _named(terms, term, "_term_id")

    def segments(df, key, column, short):
        letters, own = F.split(F.col(column), ""), F.length(column)
        long_enough = df.where(own >= least)
        if short is None:
            rows = long_enough.select(key, letters.alias("_l"), own.alias("s"))
        else:  # every length of the other side up to its own
            rows = long_enough.select(key, letters.alias("_l"), F.explode(F.sequence(F.lit(least), own)).alias("s")).join(short, "s", "left_semi")
        n = _mismatches(F.col("s"), share) + 1
        cut = lambda i: F.floor(i * F.col("s") / n).cast("int")
        parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice("_l", cut(i) + 1, cut(i + 1) - cut(i)), ""))
        return rows.select(key, "s", F.posexplode(parts).alias("i", "letters"))

    def lengths(df, column):
        return df.select(F.length(column).alias("s")).where(F.col("s") >= least).distinct()

    place = ["s", "i", "letters"]
    one = segments(v, "_value_id", value, None).join(segments(t, "_term_id", term, lengths(v, value)), place)
    other = segments(v, "_value_id", value, lengths(t, term)).join(segments(t, "_term_id", term, None), place)
    pairs = one.select("_value_id", "_term_id").union(other.select("_value_id", "_term_id")).distinct()
    shorter = F.least(F.length(value), F.length(term))
    return pairs.join(v, "_value_id").join(t, "_term_id").where(equal_places(F.col(value), F.col(term)) >= share * shorter).select(value, term)
