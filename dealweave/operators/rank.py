"""Balanced top-k lists, paging and display order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealweave.sources.folders import new_folder, stored

LEAST_WEIGHT = 0.01


def allocate(weights: DataFrame, n: int, profile: str = "profile", name: str = "category") -> DataFrame:
    """(profile, category, slots) that sum to `n` for every profile, from (profile, category, weight).

    Weights under 0.01 get none, unless no weight passes: then all count alike. Whole shares first, the rest to the
    largest fractions, then larger weights, then names. Where three or more weights are equal, their slots become
    equal too, and what that frees goes to the heaviest category.
    """
    by = Window.partitionBy(profile)
    any_active = F.max(F.col("weight") >= LEAST_WEIGHT).over(by)
    rows = weights.withColumn("_any", any_active).where("NOT _any OR weight >= 0.01")
    rows = rows.withColumn("_w", F.when(F.col("_any"), F.col("weight")).otherwise(F.lit(1.0)))
    rows = rows.withColumn("_x", F.round(n * F.col("_w") / F.sum("_w").over(by), 9)).withColumn("_f", F.floor("_x").cast("int"))
    left = n - F.sum("_f").over(by)
    place = F.row_number().over(by.orderBy(F.desc(F.col("_x") - F.col("_f")), F.desc("_w"), name))
    rows = rows.withColumn("_left", left).withColumn("_s", F.col("_f") + F.when(place <= F.col("_left"), 1).otherwise(0))
    equal = Window.partitionBy(profile, "_w")
    rows = rows.withColumn("_s", F.when(F.count(F.lit(1)).over(equal) >= 3, F.min("_s").over(equal)).otherwise(F.col("_s")))
    heaviest = F.row_number().over(by.orderBy(F.desc("_w"), name)) == 1
    slots = F.col("_s") + F.when(heaviest, n - F.sum("_s").over(by)).otherwise(0)
    return rows.select(profile, name, slots.cast("long").alias("slots"))


def without_excluded(weights: DataFrame, excluded: DataFrame | None) -> DataFrame:
    """Weights without the hard excluded (profile, category): these get no slots and are in no pool, also where the pool has all slots."""
    return weights if excluded is None else weights.join(excluded.select("profile", "category").distinct(), ["profile", "category"], "left_anti")


def balanced_topk(profiles: DataFrame, items: DataFrame, weights: DataFrame, n: int, by: str = "total_savings", pool: str = "budget_score", key: str = "recipe_id", hidden: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """(profile, key, category, kind, place): per category its slots by `by`, then the profile's free slots from all not yet taken by `pool`.

    profiles: profile, n_pool (slots of the pool); weights: profile, category, weight; hidden: profile, key never shown; excluded: profile, category
    never shown, unlike categories without weight, which the pool shows where it has all slots.
    """
    weights = without_excluded(weights, excluded)
    slots = allocate(weights, n).join(profiles, "profile")
    slots = slots.withColumn("slots", F.greatest(F.col("slots") - F.floor(F.col("slots") * F.col("n_pool") / n), F.lit(0)))
    # each category's rows are ranked once; no profile needs more than n of them
    top = items.withColumn("_r", F.row_number().over(Window.partitionBy("category").orderBy(F.desc(by), key)))
    n_hidden = 0 if hidden is None else (hidden.groupBy("profile").count().agg(F.max("count")).first()[0] or 0)
    rows = top.where(F.col("_r") <= n + n_hidden).join(slots, "category")
    # categories without weight are never shown, but where the pool has all slots
    everything = weights.select("profile", "category").join(profiles.where(F.col("n_pool") >= n), "profile").select("profile", "category")
    allowed = slots.select("profile", "category").union(everything).distinct()
    best = items.withColumn("_p", F.row_number().over(Window.partitionBy("category").orderBy(F.desc(pool), key)))
    pool_rows = best.where(F.col("_p") <= 2 * n + n_hidden).drop("_p").join(allowed, "category")  # a bounded list for each profile
    if hidden is not None:
        rows, pool_rows = (x.join(hidden, ["profile", key], "left_anti") for x in (rows, pool_rows))
    place = F.row_number().over(Window.partitionBy("profile", "category").orderBy(F.desc(by), key))
    taken = rows.withColumn("place", place).where(F.col("place") <= F.col("slots"))
    chosen = taken.select("profile", key, "category", F.lit("category").alias("kind"), "place")
    used = chosen.groupBy("profile").agg(F.count(F.lit(1)).alias("_used"))
    rest = pool_rows.join(chosen.select("profile", key), ["profile", key], "left_anti").join(used, "profile", "left")
    rank = F.row_number().over(Window.partitionBy("profile").orderBy(F.desc(pool), key))
    rest = rest.withColumn("place", rank).where(F.col("place") <= n - F.coalesce("_used", F.lit(0)))
    return chosen.union(rest.select("profile", key, "category", F.lit("pool").alias("kind"), "place"))


def serve(profiles: DataFrame, items: DataFrame, weights: DataFrame, n: int, in_season: Column, seen: DataFrame, by: str = "total_savings", pool: str = "budget_score", key: str = "recipe_id", excluded: DataFrame | None = None, size: tuple[str, int, int] | None = None) -> DataFrame:
    """(profile, key, category, kind, place): the pool's slots first, then categories without those; rows out of season or already seen are left out before ranking, favourites break ties.

    excluded: profile, category never shown; size: a column of item counts with its least and greatest value, 0 for no bound.
    """
    rows = items.where(in_season)
    if size is not None:
        column, low, high = size
        rows = rows.where(F.col(column) >= low) if low > 0 else rows
        rows = rows.where(F.col(column) <= high) if high > 0 else rows
    n_seen = seen.groupBy("profile").count().agg(F.max("count")).first()[0] or 0
    best = [F.desc(pool), F.desc("starred"), key]
    # no profile needs more of a category than its slots and what it has seen
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("category").orderBy(*best))).where(F.col("_r") <= n + n_seen).drop("_r")
    first = first.crossJoin(F.broadcast(profiles)).join(seen, ["profile", key], "left_anti")  # a bounded list for each profile
    if excluded is not None:
        first = first.join(excluded.select("profile", "category").distinct(), ["profile", "category"], "left_anti")
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("profile").orderBy(*best))).where(F.col("place") <= F.col("n_pool"))
    first = first.select("profile", key, "category", F.lit("pool").alias("kind"), "place")
    slots = allocate(without_excluded(weights, excluded), n).join(profiles, "profile")
    slots = slots.withColumn("slots", F.greatest(F.col("slots") - F.floor(F.col("slots") * F.col("n_pool") / n), F.lit(0)))
    top = rows.withColumn("_r", F.row_number().over(Window.partitionBy("category").orderBy(F.desc(by), F.desc("starred"), key))).where(F.col("_r") <= 2 * n + n_seen)
    rest = top.join(slots, "category").join(seen, ["profile", key], "left_anti").join(first.select("profile", key), ["profile", key], "left_anti")
    place = F.row_number().over(Window.partitionBy("profile", "category").orderBy(F.desc(by), F.desc("starred"), key))
    rest = rest.withColumn("place", place).where(F.col("place") <= F.col("slots"))
    return first.union(rest.select("profile", key, "category", F.lit("category").alias("kind"), "place"))


def interleave(df: DataFrame, category: str, order: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Adds turn (rank within the category) and place (by turn, then category).

    A row's place follows from its turn and the sizes of the categories of its `by` group, which are few, so that no
    window spans the categories.
    """
    rows = df.withColumn("turn", F.row_number().over(Window.partitionBy(*by, category).orderBy(*order)))
    sizes = df.groupBy(*by, category).agg(F.count(F.lit(1)).alias("n"))
    lists = sizes.groupBy(*by).agg(F.collect_list(F.struct(F.col(category).alias("c"), "n")).alias("_sizes"))
    rows = rows.join(lists, list(by)) if by else rows.crossJoin(F.broadcast(lists))  # one row
    # nulls sort first, as in an ascending window
    not_after = lambda c: F.coalesce(c <= F.col(category), c.isNull())
    earlier = F.aggregate("_sizes", F.lit(0).cast("long"), lambda a, s: a + F.least(s["n"], F.col("turn") - 1))
    here = F.size(F.filter("_sizes", lambda s: (s["n"] >= F.col("turn")) & not_after(s["c"])))
    return rows.withColumn("place", (earlier + here).cast("long")).drop("_sizes")


def page(df: DataFrame, order: Sequence, limit: int, offset: int = 0, seen: DataFrame | None = None, key: str = "id") -> DataFrame:
    """One page, with has_more: the limit is clamped to 1 .. 100, and one row more is read to know whether there are others."""
    limit = max(1, min(100, limit))
    rows = df if seen is None else df.join(seen.select(key), key, "left_anti")
    got = rows.orderBy(*order).offset(offset).limit(limit + 1)
    got = got.withColumn("_n", F.row_number().over(Window.orderBy(*order))).withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > limit)
    return got.where(F.col("_n") <= limit).drop("_n")


class Ordered:
    """A table in order, as stored ranges with the number of rows before each, so that any place or page follows by addition.

    The order ends in a unique key. Ranges are the tasks of one range partitioning, written once; `before` is a row for each of them.
    Rows with equal first columns may be dealt over several ranges, so no value of the order is too frequent.
    """

    def __init__(self, df: DataFrame, order: Sequence, kind: str = "ordered"):
        self.order = [o if isinstance(o, Column) else F.col(o) for o in order]
        dealt = df.repartitionByRange(*self.order).sortWithinPartitions(*self.order).withColumn("_range", F.spark_partition_id())
        path = new_folder(df.sparkSession, kind)
        dealt.write.partitionBy("_range").parquet(path)
        self.rows = df.sparkSession.read.schema(dealt.schema).parquet(path)
        sizes = self.rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
        earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        self.before = stored(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), f"{kind}-directory")

    def _ranked(self, rows: DataFrame) -> DataFrame:
        within = F.row_number().over(Window.partitionBy("_range").orderBy(*self.order))
        return rows.withColumn("_place", within).join(F.broadcast(self.before), "_range")  # a row for each range

    def places(self) -> DataFrame:
        """All rows with their place, from 1."""
        rows = self._ranked(self.rows)
        return rows.withColumn("place", (F.col("_place") + F.col("_before")).cast("long")).drop("_range", "_place", "_n", "_before")

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows offset + 1 to offset + limit with their place and has_more; only the ranges that hold them are read. The limit is clamped to 1 .. 100."""
        limit = max(1, min(100, limit))
        hit = self.before.where((F.col("_before") < offset + limit) & (F.col("_before") + F.col("_n") > offset)).select("_range").collect()  # the ranges of one page
        total = self.before.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        wanted = self.rows.where(F.col("_range").isin(*(r[0] for r in hit))) if hit else self.rows.limit(0)
        rows = self._ranked(wanted).withColumn("place", (F.col("_place") + F.col("_before")).cast("long")).drop("_range", "_place", "_n", "_before")
        return rows.where((F.col("place") > offset) & (F.col("place") <= offset + limit)).withColumn("has_more", F.lit(total > offset + limit))


def rank_offers(hits: DataFrame, by: Sequence[str], frozen_context: str) -> DataFrame:
    """Adds place per recipe line: qualifier rank, qualifier match, context match, savings, then frozen first where the context is frozen, then id."""
    frozen = F.when(F.col(frozen_context), F.col("frozen").cast("int")).otherwise(0)
    w = Window.partitionBy(*by).orderBy(F.desc("q_rank"), F.desc("q_match"), F.desc("context_match"), F.desc("savings"), F.desc(frozen), "offer_id")
    return hits.withColumn("place", F.row_number().over(w))


def browse(df: DataFrame, source: str, active: DataFrame, order: Sequence, n: int) -> DataFrame:
    """The first rows of one source, if it is an active one."""
    return df.where(F.col("source") == source).join(active.select("source").distinct(), "source", "left_semi").orderBy(*order).limit(n)
