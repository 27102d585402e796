"""Boolean and coverage search over token indexes; many queries at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave.functions.matching import words
from dealweave.operators.grams import alike, containing
from dealweave.sources.folders import stored

WEIGHTS = {"A": 1.0, "B": 0.4}
#: Places of a basket that are bits of one number.
PLACES = 60


def token_index(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(key, token, weight): each token of each field (column to weight class), with its best class weight."""
    parts = [df.select(key, F.explode(F.array_distinct(words(F.col(c)))).alias("token"), F.lit(WEIGHTS[w]).alias("weight")) for c, w in fields.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy(key, "token").agg(F.max("weight").alias("weight"))


def parse_boolean(text: str) -> list[list[tuple[str, bool, bool]]]:
    """`a b* OR c -d` as a list of AND groups of (term, is prefix, is negated); AND binds tighter than OR."""
    groups: list[list[tuple[str, bool, bool]]] = [[]]
    for token in text.split():
        if token in ("OR", "|"):
            groups.append([])
        elif token not in ("AND", "&"):
            negated, term = token.startswith("-"), token.lstrip("-").lower()
            if term.strip("*"):
                groups[-1].append((term.rstrip("*"), term.endswith("*"), negated))
    return [g for g in groups if g]


def search(index: DataFrame, key: str, query: str, limit: int | None = None) -> DataFrame:
    """(key, score): documents that meet any group, scored by the weights of the terms of the groups that they meet, best first."""
    out = None
    for group in parse_boolean(query):
        test = lambda t, prefix: F.col("token").startswith(t) if prefix else F.col("token") == t
        wanted = [(t, p) for t, p, no in group if not no]
        if not wanted:
            continue
        any_term = F.lit(False)
        for t, p, _ in group:
            any_term = any_term | test(t, p)
        best = [F.max(F.when(test(t, p), F.col("weight"))).alias(f"w{i}") for i, (t, p) in enumerate(wanted)]
        banned = F.lit(False)
        for t, p, no in group:
            banned = banned | test(t, p) if no else banned
        hits = index.where(any_term).groupBy(key).agg(*best, F.bool_or(banned).alias("no")).where("NOT no")
        for i in range(len(wanted)):
            hits = hits.where(F.col(f"w{i}").isNotNull())
        rows = hits.select(key, sum((F.col(f"w{i}") for i in range(len(wanted))), F.lit(0.0)).alias("score"))
        out = rows if out is None else out.union(rows)
    if out is None:
        return index.select(key, F.lit(0.0).alias("score")).limit(0)
    out = out.groupBy(key).agg(F.round(F.sum("score"), 4).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), key).limit(limit)


def parse_queries(df: DataFrame, key: str, text: str, suffixes: Sequence[str] = ("s", "es"), stop: Sequence[str] = (), least: int = 3) -> DataFrame:
    """(key, part_no, part, term): comma parts with their words and inflections (a listed suffix cut or added); units, numbers and stop words are left out.

    Queries are dealt by key to as many tasks as a shuffle has, since few bytes of them give many terms. Distinct parts have
    distinct rows if each has its terms once, so that parts are compared, not their terms.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.select(key, F.col(text).alias("_text")).repartition(tasks, key).select(key, F.posexplode(F.split("_text", ",")).alias("part_no", "part"))
    parts = parts.withColumn("part", F.trim(F.lower("part"))).where("part <> ''").distinct()
    # Units.
    units = ("kg", "g", "dl", "cl", "ml", "l", "st", "pcs")
    counts = lambda w: ~w.isin(*units, *stop) & ~w.rlike(r"^\d+$") & (F.length(w) >= least)
    cut = lambda w, s: F.when(w.endswith(s) & (F.length(w) - len(s) >= least), F.substring(w, F.lit(1), F.length(w) - len(s)))
    forms = lambda w: F.array_compact(F.array(w, *(F.concat(w, F.lit(s)) for s in suffixes), *(cut(w, s) for s in suffixes)))
    terms = F.array_distinct(F.flatten(F.transform(F.filter(words(F.col("part")), counts), forms)))
    return parts.select(key, F.col("part_no").cast("long").alias("part_no"), "part", F.explode(terms).alias("term"))


def search_terms(df: DataFrame, key: str, text: str, keywords: DataFrame, parents: DataFrame, tails: Sequence[str] = (), least: int = 3) -> DataFrame:
    """(key, term, kind): normalized_word, legacy_subterm (a word less a listed tail), ingredient_keyword (key, keyword), parent_keyword (keyword, parent)."""
    ws = df.select(key, F.explode(F.array_distinct(words(F.col(text)))).alias("w")).where(F.length("w") >= least)
    out = ws.select(key, F.col("w").alias("term"), F.lit("normalized_word").alias("kind"))
    for t in tails:
        cut = ws.where(F.col("w").endswith(t) & (F.length("w") - len(t) >= least))
        out = out.union(cut.select(key, F.expr(f"left(w, length(w) - {len(t)})"), F.lit("legacy_subterm")))
    out = out.union(keywords.select(key, "keyword", F.lit("ingredient_keyword")))
    # of known size, so that keywords are not dealt by name
    parents = stored(parents.select("keyword", "parent"), "parents")
    out = out.union(keywords.join(parents, "keyword").select(key, "parent", F.lit("parent_keyword")))
    return out.distinct()


def near_terms(items: DataFrame, terms: DataFrame, fuzzy: bool = False) -> DataFrame:
    """(item, term): distinct pairs that are equal or of which one contains the other; with `fuzzy` also those of over three letters that agree at 75 % of the shorter one's places."""
    found = containing(items, terms, "item").union(containing(terms, items, "term", "item").select("item", "term"))
    return (found.union(alike(items, terms, "item")) if fuzzy else found).distinct()


def pantry_search(items: DataFrame, queries: DataFrame, key: str, coverage: float = 0.5, missing: int = 3, fuzzy: bool = False) -> DataFrame:
    """(query_id, key, matched, total, coverage, is_full, preview): recipes (key, item) against many pantries (query_id, term).

    An item is matched by the terms of `near_terms`; vocabularies meet by shared pieces. Kept from `coverage` on and up
    to `missing` items short, with three of them; null items are none. A recipe's items are gathered once, and recipes of the same items are one
    basket: baskets are dealt to as many tasks as a shuffle has, since few bytes of them give many rows, and matched places are counted by
    basket and query without a further shuffle, as bits of a number where a basket has no more than `PLACES` of them. Recipes come in last.
    """
    lists = items.where("item IS NOT NULL").groupBy(key).agg(F.sort_array(F.collect_set("item")).alias("_items"))
    lists = stored(lists.select(key, F.unhex(F.md5(F.to_json("_items"))).alias("_basket"), "_items"), "lists")
    baskets = stored(lists.select("_basket", "_items").distinct(), "baskets")
    vocabulary = stored(baskets.select(F.explode("_items").alias("item")).distinct(), "items")
    by_query = stored(queries.join(near_terms(vocabulary, queries, fuzzy), "term").select("query_id", "item").distinct(), "by-query")
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = F.size("_items").cast("long")

    def kept(some: DataFrame, got: Column, lacks: Callable[[Column], Column]) -> DataFrame:
        rows = some.repartition(tasks, "_basket").select("_basket", total.alias("total"), F.posexplode("_items").alias("_i", "item"))
        hits = rows.join(by_query, "item").groupBy("_basket", "query_id", "total").agg(F.count(F.lit(1)).alias("matched"), got.alias("_got"))
        good = hits.where((F.col("matched") >= coverage * F.col("total")) & (F.col("total") - F.col("matched") <= missing)).join(some, "_basket")
        preview = F.array_join(F.slice(F.filter("_items", lambda x, i: lacks(i)), 1, 3), ", ")
        return good.select("_basket", "query_id", "matched", "total", preview.alias("preview"))

    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    few = kept(baskets.where(total <= PLACES), F.bit_or(bit(F.col("_i"))), lambda i: F.col("_got").bitwiseAND(bit(i)) == 0)
    many = kept(baskets.where(total > PLACES), F.collect_list("_i"), lambda i: ~F.array_contains("_got", i))
    out = few.union(many).join(lists.select(key, "_basket"), "_basket")
    return out.select("query_id", key, "matched", "total", F.round(F.col("matched") / F.col("total"), 4).alias("coverage"), (F.col("matched") == F.col("total")).alias("is_full"), "preview")


def query_coverage(index: DataFrame, queries: DataFrame, least: float = 0.5) -> DataFrame:
    """(query_id, coverage, path, reason): share of a query's parts (query_id, part_no, term) with any indexed term (term); under `least` the scan path."""
    known = queries.join(index.select("term").distinct().withColumn("k", F.lit(True)), "term", "left")
    parts = known.groupBy("query_id", "part_no").agg(F.bool_or(F.coalesce("k", F.lit(False))).alias("ok"))
    out = parts.groupBy("query_id").agg(F.round(F.avg(F.col("ok").cast("double")), 4).alias("coverage"))
    low = F.col("coverage") < least
    return out.select("query_id", "coverage", F.when(low, "scan").otherwise("index").alias("path"), F.when(F.col("coverage") == 0, "no_terms").when(low, "low_coverage").alias("reason"))
