"""Word match modes as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def matches(text: Column, term: Column, mode: str = "substring", short: int = 2) -> Column:
    """`term` in `text`: substring, word, start (of a word), or edge (start or end of a word, never embedded). Terms of `short` letters or less count as whole words only."""
    ws, t = words(text), F.lower(term)
    whole = F.array_contains(ws, t)
    found = {
        "substring": F.lower(text).contains(t),
        "word": whole,
        "start": F.exists(ws, lambda w: w.startswith(t)),
        "edge": F.exists(ws, lambda w: w.startswith(t) | w.endswith(t)),
    }[mode]
    return F.coalesce(F.when(F.length(t) <= short, whole).otherwise(found), F.lit(False))


def any_word(text: Column, terms: Sequence[str]) -> Column:
    """Whether any of some terms is a whole word of `text`."""
    return F.arrays_overlap(words(text), F.array(*map(F.lit, terms))) if terms else F.lit(False)


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    return reduce(lambda a, t: a | F.coalesce(F.lower(text).contains(t), F.lit(False)), terms, F.lit(False))


def shingles(ws: Column, most: int) -> Column:
    """All runs of 1 to `most` words, joined by a space."""

    def of(n):
        starts = F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(ws, i, n), " "))

    return F.flatten(F.array(*(of(n) for n in range(1, most + 1))))


def any_phrase(df: DataFrame, phrases: DataFrame, key: str, text: str, most_words: int = 4) -> DataFrame:
    """(key, phrase): the longest phrase (then the first by name) that stands in the text at word bounds; phrases (phrase) is any size."""
    pieces = df.select(key, words(F.col(text)).alias("_w")).select(key, F.explode(F.array_distinct(shingles(F.col("_w"), most_words))).alias("piece"))
    hits = pieces.join(phrases.select("phrase", F.array_join(words(F.col("phrase")), " ").alias("piece")).distinct(), "piece")
    return hits.groupBy(key).agg(F.min_by("phrase", F.struct((-F.length("phrase")).alias("n"), "phrase")).alias("phrase"))


def compile_recipes(lines: DataFrame, key: str) -> DataFrame:
    """(key, lines, words): one wide row per recipe from (key, line_no, line): its lines with their words in order, and its distinct words."""
    rows = lines.withColumn("words", words(F.col("line")))
    listed = F.sort_array(F.collect_list(F.struct("line_no", "line", "words")))
    return rows.groupBy(key).agg(listed.alias("lines"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words"))


def compile_offers(offers: DataFrame, key: str, name: str, qualifiers: DataFrame, lists: dict[str, Sequence[str]], keyword: Column | None = None) -> DataFrame:
    """One wide row per offer with what the gates look up: text, words, keyword (its last word, if none is given), qualifiers and an array for each named list.

    qualifiers: keyword, qualifier, found by the keyword as whole words; lists: the words of the name that are in a list, in the name's order. A null name has
    no words, no keyword and empty arrays. The other columns of the offers stay.
    """
    rows = offers.withColumns({"text": F.lower(F.trim(F.col(name))), "words": words(F.col(name))})
    rows = rows.withColumn("keyword", F.get("words", F.size("words") - 1) if keyword is None else keyword)

    def listed(xs):
        return F.filter("words", lambda w: w.isin(*xs))

    rows = rows.withColumns({n: listed(xs) for n, xs in lists.items()})
    rules = qualifiers.groupBy("keyword").agg(F.sort_array(F.collect_set("qualifier")).alias("_q"))
    rows = rows.join(rules, "keyword", "left")
    found = F.filter("_q", lambda q: F.array_contains("words", q))
    return rows.withColumn("qualifiers", F.coalesce(found, F.array().cast("array<string>"))).drop("_q")
