"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sizes are words. Targets share 100 % of all words by weight, none above three times its source's size.
Each source's documents fall into `BLOCKS` blocks by a keyed hash. A mix takes every block as often as the
target holds the source whole; of one more epoch it takes a part of the blocks. These block quotas, taken and
left, are split over the output shards by a tree: the first half of a node's shards draws its blocks without
replacement from the node's quotas, source by source (multivariate hypergeometric), so every shard has a fair
and exact share. A shard then takes its run of the source's keyed permutation of blocks, disjoint from all
other shards' runs, and leaves the blocks at the run's end that the tree has left it. As blocks differ in
words, the blocks that the tree has left come last in line, and the line is cut where the target is reached,
inside a block after a document whose middle lies within the target. Shards are written as folders, each
shuffled by a keyed place in itself, and everything that is reported is read back from them.

What is held per source is at most `BLOCKS` rows whatever the corpus; documents meet their block by a
join on (source, block), which splits a hot source 4,096 ways. Sources are few: their targets are worked out
in one task, and a node of the tree holds a row or three for each source.

Defined results: a null text has size 0; null is a source of its own, last in order; sources without
words have target 0; ids need not be unique or set, each row is taken by itself, and equal rows alike;
an empty table gives an empty mix; extra columns are passed through. Reruns agree: draws depend on the
seeds, the ids, the sources and the sizes only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealweave.llm.common import lean_batches, new_path, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
BLOCKS = 4096
SHARDS = 16
#: A shard's rows are dealt in so many parts, which tasks write.
PIECES = 64
SEED = 1
#: Kinds of block draws: of whole epochs, taken and left of the last epoch.
WHOLE, LAST, LEFT = "a_whole", "b_last", "c_left"
#: Odds under this, against the mode's, are nothing in double precision; a task holds so many odds at once.
_LEAST_ODDS, _LONGEST_PIECE = 1e-30, 1 << 20
_ALL = (1 << 63) - 1


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """`docs` with size, m_source (never null), m_block and m_order (the keyed permutation of documents)."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t"))  # null last: "s..." is less than "t"
    # rows without an id are told apart by their texts, or all would be one block
    name = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    order = F.xxhash64(F.lit(seed), name, F.col("source"))
    block = F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), name), F.lit(BLOCKS)).cast("int")
    return docs.withColumns({"size": size, "m_source": source, "m_order": order, "m_block": block})


def targets(blocks: DataFrame, weights=WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """(m_source, source_size, target) from a table with m_source and words: weights by order of source, excess over `most` times the size reshared by weight."""
    sources = blocks.groupBy("m_source").agg(F.sum("words").alias("source_size"))
    place = F.row_number().over(Window.orderBy("m_source")) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (place % len(weights) + 1).cast("int"))
    cap = most * F.col("source_size")
    rows = sources.withColumn("weight", weight).withColumn("cap", cap.cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "m_source")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / F.sum("weight").over(after))
    rows = rows.withColumn("level", F.max("level").over(everything))
    return rows.select("m_source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _hypergeometric(rng, good: int, bad: int, want: int) -> int:
    """How many of `want` draws without replacement are good, by inversion outwards from the mode, at every count.

    Odds are running products of the ratios of neighbouring values, up from the mode and then down, so no factorial is
    taken; they end where they are below a double's precision, some ten deviations out.
    """
    low, high = max(0, want - bad), min(good, want)
    if low == high:
        return low
    mode = min(high, max(low, (good + 1) * (want + 1) // (good + bad + 2)))

    def odds(step: int):
        """(value before, odds relative to the mode's of those after it), piece by piece."""
        at, weight, long = mode, 1.0, 256
        while weight > _LEAST_ODDS and at != (high if step > 0 else low):
            k = at + step * np.arange(min(long, abs((high if step > 0 else low) - at)), dtype=np.float64)
            if step > 0:
                ratios = (good - k) * (want - k) / ((k + 1) * (bad - want + k + 1))
            else:
                ratios = k * (bad - want + k) / ((good - k + 1) * (want - k + 1))
            weights = weight * np.cumprod(ratios)
            yield at, np.cumsum(weights)
            at, weight, long = at + step * len(k), weights[-1], min(2 * long, _LONGEST_PIECE)

    left = rng.random() * (1.0 + sum(sums[-1] for step in (1, -1) for _, sums in odds(step))) - 1.0
    if left < 0:
        return mode
    for step in (1, -1):
        for at, sums in odds(step):
            if left < sums[-1]:
                return at + step * (1 + int(np.searchsorted(sums, left, "right")))
            left -= sums[-1]
    return mode  # what rounding leaves over


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(shard, m_source, kind, quota) from (m_source, kind, quota): the splitting tree over any number of `shards`.

    Kinds of quota are drawn in the order of their names within a source; those left (`LEFT`) don't count for a
    shard's size and are drawn by themselves.
    """

    def split(key, rows: pd.DataFrame) -> pd.DataFrame:
        low, high = int(key[0]), int(key[1])
        if high - low == 1:
            return rows
        middle = (low + high) // 2
        rows = rows.sort_values(["m_source", "kind"])
        rng = np.random.default_rng([seed, low, high])
        here, is_left = rows["quota"].to_numpy(np.int64), (rows["kind"] == LEFT).to_numpy()
        first = np.zeros(len(here), np.int64)
        for group in (np.flatnonzero(~is_left), np.flatnonzero(is_left)):
            rest = int(here[group].sum())
            want = rest * (middle - low) // (high - low)
            for i in group:  # one source after another: each draw is hypergeometric given those before
                rest -= int(here[i])
                first[i] = _hypergeometric(rng, int(here[i]), rest, want)
                want -= int(first[i])
        halves = [rows.assign(low=low, high=middle, quota=first), rows.assign(low=middle, high=high, quota=here - first)]
        return pd.concat(halves)

    lean_batches(quotas.sparkSession)
    ends = [F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("high")]
    nodes = quotas.select(*ends, "m_source", "kind", F.col("quota").cast("long").alias("quota"))
    for _ in range((shards - 1).bit_length()):
        split_by = nodes.groupBy("low", "high")
        nodes = split_by.applyInPandas(split, "low long, high long, m_source string, kind string, quota long")
    return nodes.select(F.col("low").cast("int").alias("shard"), "m_source", "kind", "quota")


def _runs(quotas: DataFrame) -> DataFrame:
    """(m_source, runs): for each source the shards' (end of whole draws, end of the last epoch's run, taken of it, shard)."""
    by_kind = quotas.groupBy("m_source", "shard").pivot("kind", [WHOLE, LAST, LEFT]).sum("quota").na.fill(0)
    order = Window.partitionBy("m_source").orderBy("shard")
    ends = by_kind.select(
        "m_source",
        F.struct(
            F.sum(WHOLE).over(order).alias("whole_end"),
            F.sum(F.col(LAST) + F.col(LEFT)).over(order).alias("end"),
            F.col(LAST).alias("taken"),
            (F.col(LAST) + F.col(LEFT)).alias("long"),
            "shard",
        ).alias("run"),
    )
    return ends.groupBy("m_source").agg(F.sort_array(F.collect_list("run")).alias("runs"))


def draws(
    rows: DataFrame, shards: int = SHARDS, seed: int = SEED, weights=WEIGHTS, most: float = MOST_REPEATS, tree_seed: int = SEED
) -> DataFrame:
    """One row per (m_source, m_block): source_size, target and draws, an array of (epoch, shard, upto).

    `rows` is a sized table. A draw takes the block's documents whose m_order is at most `upto`.
    """
    blocks = written(rows.groupBy("m_source", "m_block").agg(F.sum("size").alias("words")), "blocks")
    goal = written(targets(blocks, weights, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    goal = goal.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    counts = blocks.groupBy("m_source").agg(F.count(F.lit(1)).alias("n")).join(goal, "m_source")
    share = F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0)
    last = F.least(F.col("n"), F.ceil(share * F.col("n")))
    kinds = {WHOLE: F.col("whole") * F.col("n"), LAST: last, LEFT: F.col("n") - last}
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), v.cast("long").alias("quota")) for k, v in kinds.items()))
    runs = _runs(split_quotas(counts.select("m_source", F.inline(kinds)), shards, tree_seed))

    def permuted(epoch):
        return Window.partitionBy("m_source").orderBy(F.xxhash64(F.lit(seed), "m_source", "m_block", epoch), epoch, "m_block")

    # the last epoch: what the shards take of their runs, then what they leave, up to the target
    one = blocks.join(goal, "m_source").join(runs, "m_source").withColumn("epoch", F.col("whole") + 1)
    one = one.withColumn("place", F.row_number().over(permuted("epoch")))
    one = one.withColumn("run", F.get(F.filter("runs", lambda r: r["end"] >= F.col("place")), F.lit(0)))
    is_left = F.col("place") - (F.col("run.end") - F.col("run.long")) > F.col("run.taken")
    in_line = Window.partitionBy("m_source").orderBy(is_left, "place")
    one = one.withColumn("before", F.sum("words").over(in_line) - F.col("words"))
    one = one.withColumn("rest", F.col("rest") - F.col("before")).withColumn("shard", F.col("run.shard"))
    one = one.withColumn("part", (F.col("rest") > 0) & (F.col("rest") < F.col("words")))
    one = written(one.select("m_source", "m_block", "source_size", "target", "whole", "epoch", "shard", "rest", "part"), "draws")
    # the block that reaches the target: its documents in permuted order, up to the one whose middle passes it
    keys = ["m_source", "m_block"]
    cut = rows.select(*keys, "m_order", "size").join(one.where("part").select(*keys, "rest"), keys)
    cut = cut.groupBy(*keys, "m_order").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    inside = Window.partitionBy(*keys).orderBy("m_order")
    cut = cut.withColumn("middle", F.sum("size").over(inside) - F.col("size") / 2).where("middle <= rest")
    cut = cut.groupBy(*keys).agg(F.max("m_order").alias("upto"))
    final = one.join(cut, keys, "left")
    upto = F.when(F.col("part"), F.col("upto")).when(F.col("rest") > 0, F.lit(_ALL))
    final = final.select(*keys, "epoch", "shard", upto.alias("upto")).where("upto IS NOT NULL")
    # whole epochs: each shard takes its run of all their blocks
    each = one.where("whole > 0").select(*keys, F.explode(F.sequence(F.lit(1), F.col("whole"))).alias("epoch"))
    each = each.withColumn("place", F.row_number().over(permuted("epoch"))).join(runs, "m_source")
    of = F.get(F.filter("runs", lambda r: r["whole_end"] >= F.col("place")), F.lit(0))["shard"]
    each = each.select(*keys, "epoch", of.alias("shard"), F.lit(_ALL).alias("upto"))
    lists = each.union(final).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", "upto"))).alias("draws"))
    none = F.array().cast("array<struct<epoch:int,shard:int,upto:bigint>>")
    out = one.select(*keys, "source_size", "target").join(lists, keys, "left")
    return written(out.withColumn("draws", F.coalesce("draws", none)), "quotas")


def with_draws(rows: DataFrame, drawn: DataFrame) -> DataFrame:
    """Sized `rows` with source_size, target and m_draws, the draws that take the row."""
    out = rows.join(drawn, ["m_source", "m_block"])
    return out.withColumn("m_draws", F.filter("draws", lambda d: F.col("m_order") <= d["upto"])).drop("draws")


def _placed(rows: DataFrame, drawn: DataFrame, seed: int, *columns: str) -> DataFrame:
    """`columns` of sized `rows` with shard, epoch and place of every draw; place is a keyed shuffle within the shard."""
    out = with_draws(rows, drawn).withColumn("d", F.explode("m_draws"))
    place = F.xxhash64(F.lit(seed), "m_order", "d.epoch", F.lit("place"))
    return out.select(*columns, F.col("d.shard").alias("shard"), F.col("d.epoch").alias("epoch"), place.alias("place"))


def write_mix(mixed: DataFrame, path: str, pieces: int = PIECES) -> DataFrame:
    """Writes a mix as one Parquet folder per shard, in files of rows dealt by place and sorted by it, and reads it back."""
    dealt = mixed.repartition("shard", F.pmod("place", F.lit(pieces)))
    dealt.sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(path)
    return mixed.sparkSession.read.schema(mixed.schema).parquet(path)


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, tree_seed: int = SEED) -> DataFrame:
    """The mix, written in shards and read back: (row, shard, epoch, place), rows of `docs` as structs, repeated as drawn."""
    rows = sized(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source"), seed)
    sizes = sized(docs.select("doc_id", "text", "source"), seed).select("size", "m_source", "m_block", "m_order")
    drawn = draws(written(sizes, "sizes"), shards, seed, tree_seed=tree_seed)
    return write_mix(_placed(rows, drawn, seed, "row"), new_path(docs.sparkSession, "mix"))


def report(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, tree_seed: int = SEED) -> DataFrame:
    """Per row of `docs`: doc_id, size, source_size, target and taken, the words of it in the written shards of the mix."""
    rows = sized(docs.select("doc_id", "text", "source"), seed)
    rows = rows.select("doc_id", "size", "m_source", "m_block", "m_order", F.monotonically_increasing_id().alias("m_row"))
    rows = written(rows, "sizes")
    drawn = draws(rows, shards, seed, tree_seed=tree_seed)
    mixed = write_mix(_placed(rows, drawn, seed, "m_row", "size"), new_path(docs.sparkSession, "mix"))
    taken = mixed.groupBy("m_row").agg(F.sum("size").alias("taken"))
    # by source and block, as a source alone may be most of the rows
    goal = drawn.select("m_source", "m_block", "source_size", "target")
    out = rows.join(goal, ["m_source", "m_block"]).join(taken, "m_row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
