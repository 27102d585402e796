"""Predicates over offers and recipes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave.functions.matching import any_word, contains_any, words


@dataclass
class Preferences:
    """One household's or dataset's choices; empty lists switch a test off."""

    excluded_categories: Sequence[str] = ()
    category_exemptions: Sequence[str] = ()
    local_category: str | None = None
    local_words: Sequence[str] = ()
    specialty_words: Sequence[str] = ()
    excluded_words: Sequence[str] = ()
    excluded_brands: Sequence[str] = ()
    non_food_brands: Sequence[str] = ()
    processed_words: Sequence[str] = ()
    processed_exemptions: Sequence[str] = ()
    weights: dict[str, float] = field(default_factory=dict)


def offer_tests(p: Preferences) -> list[tuple[str, Column]]:
    """(reason, condition that removes the offer), in order."""
    name, category, brand = F.col("name"), F.col("category"), F.lower(F.coalesce("brand", F.lit("")))
    lower = lambda xs: [x.lower() for x in xs]
    return [
        ("no_savings", F.coalesce(F.col("savings"), F.lit(0)) <= 0),
        ("excluded_category", F.coalesce(category.isin(*p.excluded_categories), F.lit(False)) & ~any_word(name, lower(p.category_exemptions))),
        ("not_local", (F.coalesce(category, F.lit("")) == (p.local_category or "\0")) & ~any_word(name, lower(p.local_words)) & ~any_word(name, lower(p.specialty_words))),
        ("excluded_word", any_word(name, lower(p.excluded_words))),
        ("excluded_brand", brand.isin(*lower(p.excluded_brands)) if p.excluded_brands else F.lit(False)),
        ("non_food_brand", brand.isin(*lower(p.non_food_brands)) if p.non_food_brands else F.lit(False)),
        ("processed", contains_any(name, lower(p.processed_words)) & ~any_word(name, lower(p.processed_exemptions))),
    ]


def eligible_offers(offers: DataFrame, prefs: Preferences) -> DataFrame:
    """Offers that no test removes."""
    removed = F.lit(False)
    for _, test in offer_tests(prefs):
        removed = removed | F.coalesce(test, F.lit(False))
    return offers.where(~removed)


def audit_offers(offers: DataFrame, prefs: Preferences, keyworded: DataFrame, matched: DataFrame, key: str = "offer_id") -> DataFrame:
    """(key, reason, word): why each offer is out, or matched, no_keywords or no_recipe_match."""
    reason = F.coalesce(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in offer_tests(prefs)))
    listed = {"excluded_word": prefs.excluded_words, "processed": prefs.processed_words}
    word = F.lit(None).cast("string")
    for name, xs in listed.items():
        if xs:
            listed_words = F.array(*(F.lit(x.lower()) for x in xs))
            if name == "excluded_word":
                hits = F.filter(listed_words, lambda x: F.array_contains(words(F.col("name")), x))
            else:
                hits = F.filter(listed_words, lambda x: F.lower("name").contains(x))
            hit = F.get(hits, F.lit(0))
            word = F.when(F.col("reason") == name, hit).otherwise(word)
    out = offers.withColumn("reason", reason).withColumn("word", word)
    out = out.join(keyworded.select(key, F.lit(True).alias("_k")).distinct(), key, "left").join(matched.select(key, F.lit(True).alias("_m")).distinct(), key, "left")
    final = F.coalesce("reason", F.when(F.col("_m"), "matched").when(F.col("_k"), "no_recipe_match").otherwise("no_keywords"))
    return out.select(key, final.alias("reason"), "word")


def visible(df: DataFrame, column: str = "excluded") -> DataFrame:
    return df.where(~F.coalesce(F.col(column), F.lit(False)))


def drop_party(df: DataFrame, phrases: Sequence[str], suspicious: Sequence[str], heads: int = 8, items: int = 30) -> DataFrame:
    """`df` (name, items) without recipes for crowds: a phrase in the name, a head count of `heads` or more, or many items and a suspicious word."""
    name = F.coalesce("name", F.lit(""))
    count = F.coalesce(F.nullif(F.regexp_extract(F.lower(name), r"(\d+) ?(?:persons|people|guests|servings)", 1), F.lit("")).cast("int"), F.lit(0))
    party = contains_any(name, phrases) | (count >= heads) | ((F.size("items") >= items) & contains_any(name, suspicious))
    return df.where(~party)


def drop_trivial(df: DataFrame, phrases: Sequence[str], column: str = "name") -> DataFrame:
    return df.where(~contains_any(F.coalesce(column, F.lit("")), phrases))


def easter(year: Column) -> Column:
    """Date of Easter Sunday (Gregorian), by integer arithmetic on the golden number and the century."""
    y = year.cast("int")
    div = lambda a, b: F.floor(a / b).cast("int")
    golden, century = y % 19, div(y, 100)
    epact = F.pmod(19 * golden + century - div(century, F.lit(4)) - div(century - div(century + 8, F.lit(25)) + 1, F.lit(3)) + 15, F.lit(30))
    to_sunday = F.pmod(32 + 2 * (century % 4) + 2 * div(y % 100, F.lit(4)) - epact - (y % 100) % 4, F.lit(7))
    late = div(golden + 11 * epact + 22 * to_sunday, F.lit(451))
    day = epact + to_sunday - 7 * late + 114
    return F.make_date(y, div(day, F.lit(31)), day % 31 + 1)


def midsummer(year: Column) -> Column:
    """The Saturday of June 20 to 26."""
    first = F.make_date(year.cast("int"), F.lit(6), F.lit(20))
    return F.date_add(first, F.pmod(7 - F.dayofweek(first), F.lit(7)))


def off_season(df: DataFrame, rules: DataFrame, key: str, text: str, date: str) -> DataFrame:
    """(key, keyword, off_season) for rows whose words hold a rule's keyword; the rule of least priority decides.

    rules: priority, keyword, kind (fixed, easter, midsummer), start, end ("MM-dd", or day offsets), inside (the keyword only counts as the start of a longer word).
    """
    # a text is known by its digest, words meet rules by equality, and distinct words by their proper prefixes
    rows = df.withColumn("_d", F.xxhash64(text)).withColumn("_n", F.length(text))
    tokens = rows.select("_d", "_n", F.explode(F.array_distinct(words(F.col(text)))).alias("_w")).distinct()
    vocabulary = tokens.select("_w").distinct()
    prefixes = F.transform(F.sequence(F.lit(1), F.length("_w") - 1), lambda i: F.substring("_w", F.lit(1), i))
    inner = vocabulary.where(F.length("_w") > 1).select("_w", F.explode(prefixes).alias("keyword"))
    ruled = vocabulary.select("_w", F.col("_w").alias("keyword")).join(rules.where(~F.col("inside")), "keyword")
    ruled = ruled.unionByName(inner.join(rules.where("inside"), "keyword"))
    best = tokens.join(ruled, "_w").groupBy("_d", "_n").agg(F.min_by(F.struct("keyword", "kind", "start", "end"), F.struct("priority", "keyword")).alias("r"))
    rows = rows.join(best, ["_d", "_n"])
    d, year = F.col(date).cast("date"), F.year(date)
    anchor = F.when(F.col("r.kind") == "easter", easter(year)).when(F.col("r.kind") == "midsummer", midsummer(year))
    relative = d.between(F.date_add(anchor, F.col("r.start").try_cast("int")), F.date_add(anchor, F.col("r.end").try_cast("int")))
    now = F.date_format(d, "MM-dd")
    straight = now.between(F.col("r.start"), F.col("r.end"))
    over_new_year = (now >= F.col("r.start")) | (now <= F.col("r.end"))
    inside = F.when(F.col("r.kind") != "fixed", relative).when(F.col("r.start") <= F.col("r.end"), straight).otherwise(over_new_year)
    return rows.select(key, F.col("r.keyword").alias("keyword"), (~inside).alias("off_season"))


def exempt(text: Column, explicit: Sequence[str], natural: Sequence[str], blockers: Sequence[str]) -> Column:
    """An explicit label exempts; a natural keyword does so unless a blocking base word is there too."""
    return contains_any(text, explicit) | (any_word(text, natural) & ~any_word(text, blockers))


def items_between(df: DataFrame, low: int, high: int, column: str = "ingredients") -> DataFrame:
    """Rows with low <= items <= high; zero switches a bound off."""
    n = F.coalesce(F.size(column), F.lit(0))
    test = (n >= low) if low else F.lit(True)
    return df.where(test & (n <= high) if high else test)
