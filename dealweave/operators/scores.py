"""Aggregations and windows: groups, scores, counts, histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealweave.operators.grams import containing
from dealweave.sources.folders import stored

SAVING_CAP = 50
FULL_MATCHES = 6


def offers_by_keyword(offers: DataFrame) -> DataFrame:
    """(keyword, offers): the offers (keyword, offer_id, savings, ...) of each keyword once, sorted by id."""
    rest = [c for c in offers.columns if c not in ("keyword", "offer_id")]
    lists = F.sort_array(F.collect_set(F.struct("offer_id", *rest)))
    return offers.groupBy("keyword").agg(lists.alias("offers"))


def build_groups(lines: DataFrame, offers: DataFrame, recipe: str = "recipe_id") -> DataFrame:
    """(recipe, line_no, keywords, offers): one group per line with a hit; offers sorted by id with their savings.

    Offers are grouped by keyword once; lines (recipe, line_no, keyword) meet these groups, never single offers.
    """
    rows = lines.select(recipe, "line_no", "keyword").distinct().join(offers_by_keyword(offers), "keyword")
    found = F.sort_array(F.array_distinct(F.flatten(F.collect_list("offers"))))
    return rows.groupBy(recipe, "line_no").agg(F.sort_array(F.collect_set("keyword")).alias("keywords"), found.alias("offers"))


def group_sizes(lines: DataFrame, offers: DataFrame, recipe: str = "recipe_id") -> DataFrame:
    """(recipe, line_no, n_keywords, n_offers, first_offer): the groups of `build_groups` in numbers, added up over the classes of `offer_atoms`; no offer list is made."""
    postings = stored(offer_atoms(offers.select("keyword", "offer_id"))[1], "postings")
    rows = lines.select(recipe, "line_no", "keyword").distinct().join(postings, "keyword")
    g = rows.groupBy(recipe, "line_no").agg(F.size(F.collect_set("keyword")).cast("long").alias("n_keywords"), F.collect_set(F.struct("class_id", "n", "first_offer")).alias("_c"))
    n = F.aggregate("_c", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return g.select(recipe, "line_no", "n_keywords", n.alias("n_offers"), F.array_min(F.transform("_c", lambda x: x["first_offer"])).alias("first_offer"))


def _closed(sets: DataFrame, step: DataFrame) -> DataFrame:
    """(key, target) of all keys after all moves (short, to) have been followed.

    Each move lengthens the key, so a chain has fewer moves than the longest key has letters; the reach of the moves
    doubles each round, and the rounds are as many as that needs.
    """
    longest = step.agg(F.max(F.length("to"))).first()[0] or 0
    reach = step.select("short", "to")
    for _ in range(longest.bit_length()):
        there = reach.select(F.col("short").alias("to"), F.col("to").alias("further"))
        reach = stored(reach.join(there, "to", "left").select("short", F.coalesce("further", "to").alias("to")), "reach")
    out = sets.select("key").join(reach.withColumnRenamed("short", "key"), "key", "left")
    return out.select("key", F.coalesce("to", "key").alias("target"))


def _key_sets(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.collect_set("group").alias("groups"))


def promote(keys: DataFrame, suffixes: Sequence[str] = ("s", "es")) -> DataFrame:
    """(key, target) of keys (key, group): a key moves to a longer one that is it and a suffix if its groups are a subset, over and over."""
    sets = _key_sets(keys)
    ends = F.array(*map(F.lit, suffixes))
    longer = sets.select(F.col("key").alias("short"), "groups", F.explode(F.transform(ends, lambda e: F.concat("key", e))).alias("key"))
    step = longer.join(sets.select("key", F.col("groups").alias("theirs")), "key").where(F.size(F.array_except("groups", "theirs")) == 0)
    return _closed(sets, step.groupBy("short").agg(F.min_by("key", F.struct((-F.length("key")).alias("n"), "key")).alias("to")))


def promote_contained(keys: DataFrame, least: int = 2, blocked: DataFrame | None = None) -> DataFrame:
    """(key, target) of keys (key, group): a key moves to the shortest longer one that contains it and whose groups hold all of its own, over and over.

    Pairs (short, key) in `blocked` don't count, nor do short keys under `least` letters. Keys meet by shared grams.
    """
    sets = stored(_key_sets(keys), "key-sets")  # read many times below
    pairs = containing(sets, sets.select(F.col("key").alias("short")), "key", "short", least).where("short <> key")
    step = pairs.join(sets.select("key", F.col("groups").alias("theirs")), "key").join(sets.select(F.col("key").alias("short"), "groups"), "short")
    step = step.where(F.size(F.array_except("groups", "theirs")) == 0)
    if blocked is not None:
        step = step.join(blocked.select("short", "key"), ["short", "key"], "left_anti")
    return _closed(sets, step.groupBy("short").agg(F.min_by("key", F.struct(F.length("key").alias("n"), "key")).alias("to")))


def merge_equal(keys: DataFrame) -> DataFrame:
    """(key, target) of keys (key, group, n): of keys with the same groups, the one with most offers (then the longest, then the first) takes those that contain it or lie in it."""
    sets = keys.groupBy("key").agg(F.sort_array(F.collect_set("group")).alias("groups"), F.sum("n").alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("n"), (-F.length("key")).alias("long"), "key")).over(Window.partitionBy("groups"))
    out = sets.withColumn("to", first["key"])
    return out.select("key", F.when(F.col("to").contains(F.col("key")) | F.col("key").contains(F.col("to")), F.col("to")).otherwise(F.col("key")).alias("target"))


def score(groups: DataFrame, n_lines: DataFrame, recipe: str = "recipe_id") -> DataFrame:
    """Per recipe, from (recipe, line_no, offers) and (recipe, n_lines): total_savings, num_matches, coverage_pct, match_score, budget_score, mean_pct, weighted_pct."""
    best = groups.withColumn("b", F.array_max(F.transform("offers", lambda o: F.struct(o["savings"].alias("savings"), o["pct"].alias("pct")))))
    signature = F.array_join(F.transform("offers", lambda o: o["offer_id"].cast("string")), ",")
    return score_signatures(best.select(recipe, signature.alias("sig"), "b"), n_lines, recipe)


def best_by_keyword(offers: DataFrame) -> DataFrame:
    """(keyword, sig, b): the signature of each keyword's offers and the best (savings, pct) of them.

    The signature is a number of offers and two sums of their digests, so that a hot keyword is summed in parts, never listed.
    """
    once = offers.groupBy("keyword", "offer_id").agg(F.max(F.struct("savings", "pct")).alias("b"))
    digest = F.sha2(F.col("offer_id").cast("string"), 256)
    part = lambda start: F.sum(F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return once.groupBy("keyword").agg(F.concat_ws(",", F.count(F.lit(1)).cast("string"), part(1), part(16)).alias("sig"), F.max("b").alias("b"))


def score_signatures(lines: DataFrame, n_lines: DataFrame, recipe: str = "recipe_id") -> DataFrame:
    """The scores of `score`, from (recipe, sig, b) per line; lines with the same offers count once."""
    once = lines.groupBy(recipe, "sig").agg(F.max("b").alias("b"))
    out = once.groupBy(recipe).agg(F.sum(F.least(F.col("b.savings"), F.lit(SAVING_CAP))).alias("total_savings"), F.count(F.lit(1)).alias("num_matches"), F.avg("b.pct").alias("mean"))
    out = out.join(n_lines, recipe)
    coverage = F.least(F.lit(100.0), F.col("num_matches") / F.col("n_lines") * 100)
    out = out.withColumn("coverage", coverage)
    return out.select(
        recipe, F.col("total_savings").cast("decimal(12,2)").alias("total_savings"), "num_matches", F.round("coverage", 1).alias("coverage_pct"),
        F.least(F.lit(100), F.floor(F.col("num_matches") / FULL_MATCHES * 100)).cast("int").alias("match_score"),
        F.round(F.col("total_savings").cast("decimal(12,2)") * F.col("num_matches") * F.least("num_matches", "n_lines") / F.col("n_lines"), 2).cast("double").alias("budget_score"),
        F.round("mean", 1).alias("mean_pct"), F.round(F.col("mean") * F.col("coverage") / 100, 1).alias("weighted_pct"),
    )


def to_entry(scores: DataFrame, lines: DataFrame, offers: DataFrame, version: str, recipe: str = "recipe_id") -> DataFrame:
    """Nested result entry: scores, and match_data with the rules version, the offers and the groups.

    lines: recipe, line_no, keyword; offers: keyword, offer_id, savings, grouped by keyword before lines meet them.
    """
    by_keyword = offers_by_keyword(offers)
    known = offers.select("keyword").distinct()
    groups = lines.join(known, "keyword", "left_semi").groupBy(recipe).agg(F.sort_array(F.collect_set(F.struct("line_no", "keyword"))).alias("groups"))
    wanted = lines.select(recipe, "keyword").distinct().join(by_keyword, "keyword")
    lists = wanted.groupBy(recipe).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("offers")))).alias("offers"))
    return scores.join(lists, recipe).join(groups, recipe).withColumn("match_data", F.struct(F.lit(version).alias("rules_version"), "offers", "groups")).drop("offers", "groups")


def offer_atoms(offers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((class_id, offer_id, ...), (keyword, class_id, n, first_offer)): offers (keyword, offer_id, ...) with equal keywords are one class.

    Classes share no offer, so that numbers of offers add up over any set of classes; a keyword refers to its classes.
    """
    rest = [c for c in offers.columns if c not in ("keyword", "offer_id")]
    of = offers.groupBy("offer_id").agg(F.sort_array(F.collect_set("keyword")).alias("_keywords"), *(F.max(c).alias(c) for c in rest))
    members = of.withColumn("class_id", F.sha2(F.to_json("_keywords"), 256))
    sizes = members.groupBy("class_id").agg(F.any_value("_keywords").alias("_keywords"), F.count(F.lit(1)).alias("n"), F.min("offer_id").alias("first_offer"))
    postings = sizes.select(F.explode("_keywords").alias("keyword"), "class_id", "n", "first_offer")
    return members.select("class_id", "offer_id", *rest), postings


def factorised_entries(scores: DataFrame, lines: DataFrame, offers: DataFrame, version: str, recipe: str = "recipe_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, match_data, members): the result of `to_entry` without an offer list in any entry.

    entries: the scores of each recipe and its line class; match_data: a row for each line class, that is for each set of (line_no, keyword), with the rules
    version, the groups, and the offer classes with their sizes and first offers; members: class_id, offer_id and what else offers
    have. lines: recipe, line_no, keyword; offers: keyword, offer_id, ... Recipes without a hit have no entry, as in `to_entry`.
    """
    members, postings = offer_atoms(offers)
    known = lines.join(postings.select("keyword").distinct(), "keyword", "left_semi")
    groups = known.groupBy(recipe).agg(F.sort_array(F.collect_set(F.struct("line_no", "keyword"))).alias("groups"))
    groups = stored(groups.withColumn("line_class", F.sha2(F.to_json("groups"), 256)), "groups")
    classes = groups.groupBy("line_class").agg(F.any_value("groups").alias("groups"))
    wanted = classes.select("line_class", F.explode(F.array_distinct("groups.keyword")).alias("keyword")).join(postings, "keyword")
    lists = wanted.groupBy("line_class").agg(F.sort_array(F.collect_set(F.struct("first_offer", "n", "class_id"))).alias("classes"))
    match_data = classes.join(lists, "line_class").select("line_class", F.struct(F.lit(version).alias("rules_version"), "classes", "groups").alias("match_data"))
    return scores.join(groups.select(recipe, "line_class"), recipe), match_data, members


def expand_entries(entries: DataFrame, match_data: DataFrame, members: DataFrame) -> DataFrame:
    """Some of `factorised_entries` as `to_entry` has them: offers sorted by id in place of the classes."""
    wanted = match_data.join(entries.select("line_class").distinct(), "line_class", "left_semi")
    rest = [c for c in members.columns if c not in ("class_id", "offer_id")]
    offers = wanted.select("line_class", F.explode("match_data.classes.class_id").alias("class_id")).join(members, "class_id")
    lists = offers.groupBy("line_class").agg(F.sort_array(F.collect_list(F.struct("offer_id", *rest))).alias("offers"))
    whole = wanted.join(lists, "line_class").select("line_class", F.struct("match_data.rules_version", "offers", "match_data.groups").alias("match_data"))
    return entries.join(whole, "line_class").drop("line_class")


def category_counts(df: DataFrame, category: str, keep: Column) -> DataFrame:
    return df.where(keep).groupBy(category).agg(F.count(F.lit(1)).alias("n"))


def latest(df: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """The last row of each key."""
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(ts, tie)).alias("r"))
    return last.select("r.*")


def last_n(df: DataFrame, keys: Sequence[str], ts: str, n: int, tie: str) -> DataFrame:
    """The last `n` rows of each key, with place 1 for the last."""
    w = Window.partitionBy(*keys).orderBy(F.desc(ts), F.desc(tie))
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def source_stats(recipes: DataFrame, runs: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, n, bytes, last_success, enabled) of recipes (source, text) and successful runs (source, run_at)."""
    sizes = recipes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    ok = runs.where("success").groupBy("source").agg(F.max("run_at").alias("last_success"))
    out = sources.join(sizes, "source", "left").join(ok, "source", "left")
    return out.select("source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "last_success", "enabled")


def sync_summary(rows: DataFrame, active: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """One row over (source, ts) and active sources (source): active_sources, rows_active, seen_recently, last_seen, all_synced."""
    recent = F.col("ts") >= now - F.make_dt_interval(F.lit(days))
    mine = rows.join(active.select("source").distinct(), "source", "left_semi")
    sums = mine.agg(F.count(F.lit(1)).alias("rows_active"), F.count_distinct(F.when(recent, F.col("source"))).alias("seen_recently"), F.max("ts").alias("last_seen"))
    n = active.select("source").distinct().agg(F.count(F.lit(1)).alias("active_sources"))
    return n.crossJoin(sums).withColumn("all_synced", F.col("seen_recently") == F.col("active_sources"))  # one row each


def status_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: total, and a count per condition."""
    return df.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()))


def estimate(runs: DataFrame, targets: DataFrame, keys: Sequence[str], last: int = 5, least: int = 3) -> DataFrame:
    """(keys, mean, last, estimate): over the last successful runs; with `least` runs that have attempts and a target, median seconds per attempt times it, at least 1."""
    recent = last_n(runs.where("success"), keys, "run_at", last, "run_id")
    per = F.when(F.col("attempts") > 0, F.col("seconds") / F.col("attempts"))
    agg = recent.groupBy(*keys).agg(F.round(F.avg("seconds"), 2).alias("mean"), F.max(F.when(F.col("place") == 1, F.col("seconds"))).alias("last"), F.count(per).alias("_n"), F.median(per).alias("_m"))
    out = agg.join(targets, list(keys), "left")
    guess = F.when((F.col("_n") >= least) & (F.col("target") > 0), F.greatest(F.lit(1), F.bround(F.col("_m") * F.col("target")).cast("long")))
    return out.select(*keys, "mean", "last", guess.alias("estimate"))


def version_groups(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*(F.coalesce(F.col(c).cast("string"), F.lit("<missing>")).alias(c) for c in cols)).agg(F.count(F.lit(1)).alias("n"))


def summarize_ops(ops: DataFrame, key: str = "dataset", keep: int = 50, short: int = 10) -> DataFrame:
    """Per dataset over its last operations (mode, fallback, error, at, op_id): count, counts and rates of fallbacks and errors, all and last ten, modes, last time."""
    recent = last_n(ops, [key], "at", keep, "op_id")
    tail = F.col("place") <= short
    rate = lambda c: F.round(100.0 * F.count_if(c) / F.count(F.lit(1)), 1)
    modes = recent.groupBy(key, "mode").count().groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "mode", F.col("count").cast("string")))), ",").alias("modes"))
    out = recent.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if("fallback").alias("fallbacks"), rate(F.col("fallback")).alias("fallback_rate"), F.count_if("error").alias("errors"), F.count_if(F.col("error") & tail).alias("errors_recent"), F.max("at").alias("last_at"))
    return out.join(modes, key)


def unmatched_count(offers: DataFrame, matched: DataFrame, key: str = "offer_id") -> DataFrame:
    """One row (unmatched), never under zero."""
    n = offers.agg(F.count(F.lit(1)).alias("n")).crossJoin(matched.agg(F.count_distinct(key).alias("m")))  # one row each
    return n.select(F.greatest(F.col("n") - F.col("m"), F.lit(0)).alias("unmatched"))


def merge_counters(parts: DataFrame) -> DataFrame:
    """Counter maps summed: (reason, n) from rows with counters map<string,long>."""
    return parts.select(F.explode("counters").alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("n"))


def uncapped_total(hits: DataFrame, cap: int = SAVING_CAP, recipe: str = "recipe_id") -> DataFrame:
    """(recipe, capped, uncapped): best saving per keyword, summed with and without the cap."""
    best = hits.groupBy(recipe, "keyword").agg(F.max("savings").alias("s"))
    return best.groupBy(recipe).agg(F.sum(F.least("s", F.lit(cap))).cast("decimal(12,2)").alias("capped"), F.sum("s").cast("decimal(12,2)").alias("uncapped"))


def trailing_streak(df: DataFrame, key: str, order: Sequence[str], ok: Column, neutral: Column | None = None) -> DataFrame:
    """(key, streak): rows that are ok at the end of each dataset; neutral rows are skipped, the first failure from the end stops it."""
    rows = df if neutral is None else df.where(~neutral)
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    out = rows.withColumn("_b", F.sum(F.when(ok, 0).otherwise(1)).over(w)).groupBy(key).agg(F.count_if(F.col("_b") == 0).alias("streak"))
    return df.select(key).distinct().join(out, key, "left").select(key, F.coalesce("streak", F.lit(0)).alias("streak"))


def since_last(df: DataFrame, key: str, at: str, base: Column, counted: Column) -> DataFrame:
    """(key, last_base, n): counted rows after the dataset's last base row, all of them if there is none."""
    last = df.groupBy(key).agg(F.max(F.when(base, F.col(at))).alias("last_base"))
    rows = df.join(last, key).where(F.col("last_base").isNull() | (F.col(at) > F.col("last_base")))
    n = rows.groupBy(key).agg(F.count_if(counted).alias("n"))
    return last.join(n, key, "left").select(key, "last_base", F.coalesce("n", F.lit(0)).alias("n"))


def cap(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """The first `n` rows by an order that ends in an id, with their place."""
    return df.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def rank_results(df: DataFrame, full: str, full_order: Sequence, part_order: Sequence, n_full: int = 100, n_part: int = 200) -> DataFrame:
    """Full and partial hits ranked by their own keys, the first of each kept, with place. Limits come before the ranking, so no kind is sorted in one task."""
    a = cap(df.where(F.col(full)), full_order, n_full)
    b = cap(df.where(~F.col(full)), part_order, n_part)
    return a.unionByName(b)
