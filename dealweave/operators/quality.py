"""Consistency, parity and rule-table checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _check(name: str, failing: DataFrame, status: str) -> DataFrame:
    n = failing.agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.lit(name).alias("check"), F.when(F.col("n") == 0, "ok").otherwise(status).alias("status"), "n")


def doctor(parents: DataFrame, cache: DataFrame, items: DataFrame, version: str, key: str = "recipe_id", item: str = "offer_id") -> DataFrame:
    """Report (check, status, n) over parents (key, excluded), cache (key, version, total, hash, good_hash) and items (key, offer, amount); row `overall` has the worst status.

    Orphans, excluded rows present, missing rows, double rows, stale versions, null totals, negative totals, hash
    mismatches, items without an entry, and totals that are not the sum of their items.
    """
    live, hidden = parents.where("NOT coalesce(excluded, false)"), parents.where("coalesce(excluded, false)")
    sums = items.groupBy(key).agg(F.sum("amount").alias("_s"))
    checks = [
        _check("orphans", cache.join(parents, key, "left_anti"), "error"),
        _check("excluded_present", cache.join(hidden, key, "left_semi"), "error"),
        _check("missing_rows", live.join(cache, key, "left_anti"), "warning"),
        _check("double_rows", cache.groupBy(key).count().where("count > 1"), "error"),
        _check("stale_version", cache.where(~F.col("version").eqNullSafe(F.lit(version))), "warning"),
        _check("null_total", cache.where("total IS NULL"), "error"),
        _check("negative_total", cache.where("total < 0"), "error"),
        _check("hash_mismatch", cache.where("NOT (hash <=> good_hash)"), "error"),
        _check("items_without_entry", items.join(cache, key, "left_anti"), "warning"),
        _check("total_mismatch", cache.join(sums, key, "left").where("abs(coalesce(_s, 0) - total) > 0.005"), "error"),
    ]
    report = reduce(DataFrame.union, checks)
    level = F.max(F.when(F.col("status") == "error", 2).when(F.col("status") == "warning", 1).otherwise(0))
    overall = report.agg(level.alias("l"), F.sum("n").alias("n")).select(F.lit("overall").alias("check"), F.element_at(F.array(F.lit("ok"), F.lit("warning"), F.lit("error")), F.col("l") + 1).alias("status"), "n")
    return report.union(overall)


#: Checks of the whole report and their status when they fail.
REPORT = {
    "orphans": "error", "orphan_items": "error", "excluded_present": "error", "missing_rows": "warning", "missing_with_items": "error", "double_rows": "error", "double_parents": "error",
    "stale_version": "warning", "null_version": "error", "null_total": "error", "negative_total": "error", "hash_mismatch": "error", "null_hash": "error", "items_without_entry": "warning",
    "entry_without_items": "warning", "total_mismatch": "error", "count_mismatch": "error", "negative_amount": "error", "null_amount": "error", "double_items": "warning", "older_than_source": "warning",
}


def full_report(parents: DataFrame, cache: DataFrame, items: DataFrame, version: str, key: str = "recipe_id", item: str = "offer_id") -> DataFrame:
    """`doctor` with all of REPORT: (check, status, n) in one pass, the number of keys that fail each check, and row `overall` with the worst status.

    parents: key, excluded, changed_at; cache: key, version, total, n_items, hash, good_hash, built_at; items: key, item, amount. Each table is scanned once and
    summed by key, the three meet in one full outer join, and every check is a conditional count over it. Null keys are one key.
    """
    p = parents.groupBy(key).agg(F.count(F.lit(1)).alias("p_n"), F.bool_or(F.coalesce("excluded", F.lit(False))).alias("hidden"), F.max("changed_at").alias("changed_at"))
    c = cache.groupBy(key).agg(
        F.count(F.lit(1)).alias("c_n"), F.bool_or(F.coalesce(F.col("version") != version, F.lit(False))).alias("stale"), F.bool_or(F.col("version").isNull()).alias("no_version"),
        F.bool_or(F.col("total").isNull()).alias("no_total"), F.bool_or(F.coalesce(F.col("total") < 0, F.lit(False))).alias("below"), F.max("total").alias("total"), F.max("n_items").alias("n_items"),
        F.bool_or(F.coalesce(F.col("hash") != F.col("good_hash"), F.lit(False))).alias("bad_hash"), F.bool_or(F.col("hash").isNull()).alias("no_hash"), F.min("built_at").alias("built_at"),
    )
    once = items.groupBy(key, item).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("s"), F.count_if(F.col("amount") < 0).alias("low"), F.count_if(F.col("amount").isNull()).alias("none"))
    i = once.groupBy(key).agg(F.sum("n").alias("i_n"), F.sum("s").alias("i_s"), F.sum("low").alias("low"), F.sum("none").alias("none"), F.max("n").alias("most"))
    named = lambda df, k: df.withColumn("_key", F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("n"))).drop(key).withColumn(k, F.lit(True))
    rows = named(p, "is_p").join(named(c, "is_c"), "_key", "full").join(named(i, "is_i"), "_key", "full")
    has = lambda n: F.coalesce(n, F.lit(False))
    in_p, in_c, in_i, hidden = has("is_p"), has("is_c"), has("is_i"), has("hidden")
    failing = {
        "orphans": in_c & ~in_p, "orphan_items": in_i & ~in_p, "excluded_present": in_c & hidden, "missing_rows": in_p & ~hidden & ~in_c, "missing_with_items": in_p & ~hidden & ~in_c & in_i,
        "double_rows": F.col("c_n") > 1, "double_parents": F.col("p_n") > 1, "stale_version": F.col("stale"), "null_version": F.col("no_version"), "null_total": F.col("no_total"),
        "negative_total": F.col("below"), "hash_mismatch": F.col("bad_hash"), "null_hash": F.col("no_hash"), "items_without_entry": in_i & ~in_c, "entry_without_items": in_c & ~in_i,
        "total_mismatch": in_c & (F.abs(F.coalesce("i_s", F.lit(0)) - F.col("total")) > 0.005), "count_mismatch": in_c & (F.coalesce("i_n", F.lit(0)) != F.col("n_items")),
        "negative_amount": F.col("low") > 0, "null_amount": F.col("none") > 0, "double_items": F.col("most") > 1, "older_than_source": in_c & in_p & (F.col("built_at") < F.col("changed_at")),
    }
    counts = rows.agg(*(F.count_if(has(failing[name])).alias(name) for name in REPORT))
    each = F.array(*(F.struct(F.lit(name).alias("check"), F.when(F.col(name) == 0, "ok").otherwise(status).alias("status"), F.col(name).alias("n")) for name, status in REPORT.items()))
    level = F.array_max(F.transform(each, lambda x: F.when(x["status"] == "error", 2).when(x["status"] == "warning", 1).otherwise(0)))
    total = F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    overall = F.struct(F.lit("overall").alias("check"), F.element_at(F.array(F.lit("ok"), F.lit("warning"), F.lit("error")), level + 1).alias("status"), total.alias("n"))
    return counts.select(F.explode(F.concat(each, F.array(overall))).alias("x")).select("x.*")


def path_marks(paths: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """(keys, have): the pairs of any path, with a bit for each path that has them, in the order of the paths' names."""
    rows = reduce(DataFrame.union, (paths[n].select(*keys, F.lit(1 << i).cast("long").alias("have")) for i, n in enumerate(sorted(paths))))
    return rows.groupBy(*keys).agg(F.bit_or("have").alias("have"))


def paths_missing(marks: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, missing_in): pairs whose marks (keys, have) together lack some of the named paths."""
    have = marks.groupBy(*keys).agg(F.bit_or("have").alias("have")).where(F.col("have") != (1 << len(names)) - 1)
    lacking = (F.when(F.col("have").bitwiseAND(1 << i) == 0, n) for i, n in enumerate(sorted(names)))
    return have.select(*keys, F.concat_ws(",", *lacking).alias("missing_in"))


def path_parity(paths: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """(keys, missing_in): pairs that not all paths have, with the paths that lack them."""
    return paths_missing(path_marks(paths, keys), list(paths), keys)


def expect(pairs: DataFrame, rules: DataFrame, subjects: DataFrame, key: str = "offer_id") -> DataFrame:
    """Failures (rule_id, key, other) of expectations over pairs (key, other): rules (rule_id, key, kind, other).

    all: the pair must be there; none: it must not; allowed: the key may only have listed others.
    """
    have = pairs.select(key, "other").distinct()
    lacking = rules.where("kind = 'all'").join(subjects.select(key), key, "left_semi").join(have, [key, "other"], "left_anti").select("rule_id", key, "other")
    unwanted = rules.where("kind = 'none'").join(have, [key, "other"]).select("rule_id", key, "other")
    limited = rules.where("kind = 'allowed'").select("rule_id", key).distinct().join(have, key)
    beyond = limited.join(rules.where("kind = 'allowed'").select("rule_id", key, "other"), ["rule_id", key, "other"], "left_anti").select("rule_id", key, "other")
    return lacking.union(unwanted).union(beyond)


def explain_pairs(expected: DataFrame, stages: Sequence[tuple[str, DataFrame]], keys: Sequence[str], rules: DataFrame | None = None) -> DataFrame:
    """(keys, lost_at): for each expected pair the first stage whose pairs lack it, null if none does; pairs of the last stage that were not expected are `unexpected`.

    Each table tags its pairs with a bit, and the bits of a pair are or-ed in one aggregate, whatever the number of stages. With
    `rules` (keys, stage, rule), the rules that took pairs at a stage, the column rule names the first one of a lost pair's stage.
    """
    tag = lambda df, bit, rule: df.select(*keys, F.lit(1 << bit).cast("long").alias("_bits"), rule)
    nothing = F.lit(None).cast("struct<stage:string,rule:string>").alias("_rule")
    rows = reduce(DataFrame.union, [tag(expected, 0, nothing), *(tag(df, i, nothing) for i, (_, df) in enumerate(stages, 1))])
    if rules is not None:
        rows = rows.union(rules.select(*keys, F.lit(0).cast("long"), F.struct(F.col("stage").cast("string").alias("stage"), F.col("rule").cast("string").alias("rule"))))
    bits = rows.groupBy(*keys).agg(F.bit_or("_bits").alias("_bits"), *([F.collect_set("_rule").alias("_rules")] if rules is not None else []))
    has = lambda i: F.col("_bits").bitwiseAND(F.lit(1 << i)) != 0
    lost = F.coalesce(*(F.when(~has(i), F.lit(n)) for i, (n, _) in enumerate(stages, 1)))
    told = bits.where(has(0) | has(len(stages))).withColumn("lost_at", F.when(has(0), lost).otherwise("unexpected"))
    if rules is None:
        return told.select(*keys, "lost_at")
    mine = F.array_min(F.filter("_rules", lambda r: r["stage"] == F.col("lost_at")))["rule"]
    return told.select(*keys, "lost_at", mine.alias("rule"))


def funnel(explained: DataFrame, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """(stage, by, n): explained pairs by the stage that lost them; with `weight`, a row stands for so many pairs."""
    return explained.groupBy(F.coalesce("lost_at", F.lit("found")).alias("stage"), *by).agg(F.sum(F.lit(1) if weight is None else weight).alias("n"))


def lint_rules(rules: DataFrame, kinds: Sequence[str], statuses: Sequence[str]) -> DataFrame:
    """(entry_id, problem) of rules (entry_id "kind:canonical:n", kind, canonical, status, source, target)."""
    twice = rules.groupBy("entry_id").count().where("count > 1").select("entry_id")
    owners = rules.where("source IS NOT NULL").groupBy("source").agg(F.count_distinct("target").alias("n")).where("n > 1")
    shape = F.col("entry_id").rlike(r"^[^:]+:[^:]+:\d+$")
    prefix = F.concat_ws(":", "kind", F.coalesce("canonical", F.lit("")), F.lit(""))
    tests: list[tuple[str, Column]] = [
        ("unparsable_id", ~shape), ("id_prefix", shape & ~F.col("entry_id").startswith(prefix)), ("unknown_kind", ~F.col("kind").isin(*kinds)),
        ("unknown_status", ~F.col("status").isin(*statuses)), ("no_canonical", F.coalesce(F.trim("canonical"), F.lit("")) == ""),
    ]
    single = rules.select("entry_id", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(True)), F.lit(n)) for n, t in tests)))).alias("problem"))
    double = twice.withColumn("problem", F.lit("duplicate_id"))
    owned = rules.join(owners, "source", "left_semi").select("entry_id", F.lit("mapping_owned_twice").alias("problem"))
    return single.union(double).union(owned).distinct()
