"""Incremental upkeep: index refreshes, deltas, decisions, and the streaming forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from dealweave.operators import diff, ingest, scores
from dealweave.sources.folders import stored
from dealweave.sources.versions import Conflict, Rejected, Versions

# Thresholds in percent, and reconciliation limits.
IMPACTED_FULL, CHANGED_FULL, RECIPES_FULL = 15.0, 50.0, 5.0
RECONCILE_DAYS, RECONCILE_RUNS = 7, 25


def refresh_ids(index: DataFrame, fresh: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """`index` with the rows of some ids replaced by those of `fresh`."""
    ids = ids.select(key).distinct()
    return index.join(ids, key, "left_anti").unionByName(fresh.join(ids, key, "left_semi"))


def apply_delta(cache: DataFrame, plan: DataFrame, recompute: Callable[[DataFrame], DataFrame], key: str = "recipe_id") -> DataFrame:
    """The cache after a plan (key, action): impacted keys are recomputed, removed ones go, a key that yields nothing any more goes too."""
    plan = stored(plan.select(key, "action"), "plan")
    impacted, removed = plan.where("action <> 'remove'").select(key), plan.where("action = 'remove'").select(key)
    return diff.apply_patch(cache, stored(recompute(impacted), "patch"), impacted, removed, key)


def publish_delta(table: Versions, plan: DataFrame, recompute: Callable[[DataFrame], DataFrame], full: DataFrame | None = None, version: tuple[str, str] | None = None) -> DataFrame:
    """Applies a plan (key, action) to a versioned table, or says why a full rebuild must: one row (applied, reason, version, changed, removed, patched).

    Reasons: no_changes, cache_not_ready (no version yet), active_cache_empty, cache_entry_version_mismatch (rows whose column
    version[0] is not version[1]), patch_outside_scope, verification_mismatch (the staged version is not `full`, the rows
    of a full rebuild), conflict (another version came first). In all of them the table stays as it was.
    """
    spark, key = table.spark, table.key
    rows = plan.groupBy(key).agg(F.bool_or(F.col("action") == "remove").alias("gone"))
    rows = stored(rows, "plan")
    removed, changed = rows.where("gone").select(key), rows.where("NOT gone").select(key)
    n_removed, n_changed = removed.count(), changed.count()

    def report(applied: bool, reason: str | None, patched: int = 0) -> DataFrame:
        row = (applied, reason, table.current(), n_changed, n_removed, patched)
        return spark.createDataFrame([row], "applied boolean, reason string, version long, changed long, removed long, patched long")

    if not n_removed + n_changed:
        return report(False, "no_changes")
    if not table.current():
        return report(False, "cache_not_ready")
    active = table.read()
    if active.isEmpty():
        return report(False, "active_cache_empty")
    if version is not None and not active.where(~F.col(version[0]).eqNullSafe(F.lit(version[1]))).isEmpty():
        return report(False, "cache_entry_version_mismatch")
    patch = stored(recompute(changed), "patch")
    if not patch.join(changed, key, "left_anti").isEmpty():
        return report(False, "patch_outside_scope")

    def same(staged: DataFrame) -> bool:
        columns = [c for c in staged.columns if c != key]
        compared = stored(diff.compare(full, staged, key, columns), "compared")  # its report reads it twice
        return diff.parity(compared, key).first()["ok"]

    try:
        table.patch(patch, changed, removed, None if full is None else same)
    except Rejected:
        return report(False, "verification_mismatch")
    except Conflict:
        return report(False, "conflict")
    return report(True, None, patch.count())


def refresh_indexes(indexes: dict[str, tuple[DataFrame, DataFrame]], ids: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(name to refreshed index, one row for each (index, kept, replaced, added)): in every index (old, fresh) the rows of some ids are replaced."""
    ids = ids.select(key).distinct()
    out, status = {}, None
    for name, (old, fresh) in indexes.items():
        out[name] = refresh_ids(old, fresh, ids, key)
        count = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
        row = count(old.join(ids, key, "left_anti"), "kept").crossJoin(count(old.join(ids, key, "left_semi"), "replaced")).crossJoin(count(fresh.join(ids, key, "left_semi"), "added"))  # one row each
        row = row.select(F.lit(name).alias("index"), "kept", "replaced", "added")
        status = row if status is None else status.union(row)
    return out, status


def stream_refresh(ids: DataFrame, tables: dict[str, tuple[Versions, Callable[[DataFrame], DataFrame]]], key: str, checkpoint: str) -> int:
    """Runs a stream of changed ids until it is used up: each micro-batch publishes a version of every index, its rows of these ids made anew by the index's function; the number of batches."""
    done = []

    def save(batch: DataFrame, number: int) -> None:
        changed = stored(batch.select(key).distinct(), "ids")
        for table, fresh in tables.values():
            rows = fresh(changed)
            table.patch(rows.join(changed, key, "left_semi"), changed, changed.limit(0))
        done.append(number)

    run = ids.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return len(done)


def estimate_impact(changes: DataFrame, n_offers: DataFrame, impacted: DataFrame, n_recipes: DataFrame, unknown_terms: DataFrame) -> DataFrame:
    """One row: changed_pct, impacted_pct (100 if the index lacks a changed term)."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).cast("double").alias(name))
    row = one(changes.where("action IS NOT NULL"), "c").crossJoin(one(n_offers, "o")).crossJoin(one(impacted, "i")).crossJoin(one(n_recipes, "r")).crossJoin(one(unknown_terms, "u"))  # one row each
    pct = lambda a, b: F.when(F.col(b) > 0, F.round(100 * F.col(a) / F.col(b), 2)).otherwise(0.0)
    return row.select(pct("c", "o").alias("changed_pct"), F.when(F.col("u") > 0, 100.0).otherwise(pct("i", "r")).alias("impacted_pct"))


def decide(metrics: DataFrame) -> DataFrame:
    """(dataset, decision, reason) from (dataset, ready, changed, changed_pct, impacted_pct, recipes_pct)."""
    reason = (
        F.when(~F.col("ready"), "cache_not_ready").when(F.col("changed") == 0, "no_changes").when(F.col("changed_pct") > CHANGED_FULL, "too_many_changed")
        .when(F.col("impacted_pct") > IMPACTED_FULL, "too_many_impacted").when(F.col("recipes_pct") > RECIPES_FULL, "too_many_recipes").otherwise("small_change")
    )
    decision = F.when(F.col("reason") == "no_changes", "skip").when(F.col("reason") == "small_change", "delta").otherwise("full")
    return metrics.withColumn("reason", reason).select("dataset", decision.alias("decision"), "reason")


def reconcile_due(ops: DataFrame, now: Column, key: str = "dataset") -> DataFrame:
    """(dataset, due, reason) over an operation log (dataset, mode, at, ok, active): full rebuild when none is recorded, it is old, or many increments followed; not while one is active."""
    good = ops.where("ok")
    counted = scores.since_last(good, key, "at", F.col("mode") == "full", F.col("mode") == "delta")
    active = ops.groupBy(key).agg(F.bool_or("active").alias("running"))
    rows = active.join(counted, key, "left")
    reason = F.when(F.col("running"), "active").when(F.col("last_base").isNull(), "never_built").when(F.col("last_base") <= now - F.make_dt_interval(F.lit(RECONCILE_DAYS)), "too_old").when(F.col("n") >= RECONCILE_RUNS, "too_many_deltas")
    return rows.select(key, F.coalesce(reason != "active", F.lit(False)).alias("due"), reason.alias("reason"))


def gate(history: DataFrame, versions: DataFrame, streak: int = 3, runs: int = 3, key: str = "dataset") -> DataFrame:
    """(dataset, streak, ready_runs, trusted): delta is trusted after a streak of ready runs and enough on the current version (dataset, version)."""
    s = scores.trailing_streak(history, key, ["at", "op_id"], F.col("ready"), F.col("neutral"))
    current = history.join(versions, [key, "version"]).groupBy(key).agg(F.count_if("ready").alias("ready_runs"))
    out = s.join(current, key, "left").withColumn("ready_runs", F.coalesce("ready_runs", F.lit(0)))
    return out.withColumn("trusted", (F.col("streak") >= streak) & (F.col("ready_runs") >= runs))


def append_history(history: DataFrame, new: DataFrame, key: str, ts: str, tie: str, keep: int = 50) -> DataFrame:
    """The log with new rows, the last `keep` of each dataset."""
    return scores.last_n(history.unionByName(new), [key], ts, keep, tie).drop("place")


def staleness(meta: DataFrame, cache: DataFrame, sources: DataFrame, version: str, preferences: str, key: str = "dataset") -> DataFrame:
    """(dataset, state, reasons) from meta (dataset, status, rows, scope, preferences, built_at), cache (dataset, version) and sources (dataset, changed_at)."""
    c = cache.groupBy(key).agg(F.count(F.lit(1)).alias("c_rows"), F.count_if(F.col("version") != version).alias("c_other"))
    s = sources.groupBy(key).agg(F.max("changed_at").alias("s_last"), F.count(F.lit(1)).alias("s_scope"))
    rows = meta.join(c, key, "left").join(s, key, "left")
    tests = (
        ("status", F.col("status") != "ready"), ("row_count", F.coalesce("c_rows", F.lit(0)) != F.col("rows")), ("version", F.coalesce("c_other", F.lit(0)) > 0), ("scope", F.coalesce("s_scope", F.lit(0)) != F.col("scope")),
        ("preferences", F.col("preferences") != preferences), ("source_newer", F.coalesce(F.col("s_last") > F.col("built_at"), F.lit(False))),
    )
    reasons = F.sort_array(F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests))))
    state = F.when(F.coalesce("c_rows", F.lit(0)) == 0, "missing").when(F.size("reasons") > 0, "stale").otherwise("fresh")
    return rows.withColumn("reasons", reasons).select(key, state.alias("state"), F.array_join("reasons", ",").alias("reasons"))


def _folders(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the finished folders `v=N` under `root`; a folder without _SUCCESS was left by a batch that did not end."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(root)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(root))]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(path(f"{root}/{n}/_SUCCESS")))


def _drop_folders(spark: SparkSession, root: str, before: int) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for n in _folders(spark, root):
        if n < before:
            fs.delete(path(f"{root}/v={n}"), True)


def stream_upsert(stream: DataFrame, root: str, key: str, order: str, checkpoint: str, compact_every: int = 16) -> DataFrame:
    """Runs a stream of rows into a keyed target under `root` until its input is used up; of each key the last row by `order` counts, whenever it comes.

    A micro-batch writes a folder with the last rows of its own keys, every `compact_every`-th one with those of the
    whole target; readers merge the folders since the last whole one. A rerun of a batch writes the same folder again; a run
    without new input returns the target as it is, empty if nothing ever came. Folders before the last whole one but one are removed.
    """
    spark = stream.sparkSession

    def merged(rows: DataFrame) -> DataFrame:
        return ingest.keep_first(rows, key, [F.desc(order)], "drop")[0]

    def current(version: int) -> DataFrame:
        whole = max((version + 1) // compact_every * compact_every - 1, 0)
        there = [f"{root}/v={n}" for n in _folders(spark, root) if whole <= n <= version]
        return merged(spark.read.schema(stream.schema).parquet(*there)) if there else spark.createDataFrame([], stream.schema)

    def save(batch: DataFrame, number: int) -> None:
        whole = (number + 1) % compact_every == 0
        rows = merged(current(number - 1).unionByName(batch) if whole else batch)
        rows.write.mode("overwrite").parquet(f"{root}/v={number}")
        if whole:  # a reader may still have the whole folder before this one open
            _drop_folders(spark, root, number - compact_every)

    run = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return current(max(_folders(spark, root), default=-1))


def final_sync(target: DataFrame, seen: DataFrame, key: str, source: Column) -> DataFrame:
    """After the last batch: the target without rows of the source that the run has not seen."""
    return ingest.drop_stale(target, seen, key, source, F.lit(False))[0]


class _RetryState(StatefulProcessor):
    """Count and last reason of one key; a success deletes them, also a miss of the same moment. With `days`, a key ends so long after its last change."""

    def __init__(self, key: str, days: int | None):
        self.key, self.days = key, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("retry", "retry_count long")

    def _row(self, key, count, reason, due) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "retry_count": [count], "last_reason": [reason], "next_retry_at": [due]})

    def _set_timer(self, timer) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        if self.days is not None:
            self.handle.registerTimer(timer.getCurrentProcessingTimeInMs() + int(self.days * 86_400_000))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self.state.update((int(initialState["retry_count"].iloc[0]),))
        if self.days is not None:
            self._set_timer(timerValues)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        batch = pd.concat(list(rows)).sort_values(["at", "ok", "reason"])
        count = self.state.get()[0] if self.state.exists() else 0
        last = None
        for row in batch.itertuples():
            count, last = (0, None) if row.ok else (count + 1, row)
        if self.days is not None:
            self._set_timer(timer)
        if last is None:
            self.state.clear()
            yield self._row(key, 0, None, pd.NaT)
            return
        self.state.update((count,))
        days = ingest.TEMPORARY_DAYS if last.temporary else ingest.RETRY_DAYS[count % 4]
        yield self._row(key, count, last.reason, last.at + pd.Timedelta(days=days))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield self._row(key, 0, "expired", pd.NaT)

    def close(self) -> None:
        pass


RETRY_SCHEMA = "user_id long, retry_count long, last_reason string, next_retry_at timestamp"


def retry_state(stream: DataFrame, key: str = "user_id", start: DataFrame | None = None, days: float | None = None) -> DataFrame:
    """Streaming form of `record_misses` for a key of any simple type: per key and batch the state after it; retry_count 0 says that the key was deleted.

    `start` is the table (key, retry_count) of `record_misses` from which the state begins. With `days`, a key that has had no row for
    so long by the clock is dropped (reason "expired").
    """
    schema = f"`{key}` {stream.schema[key].dataType.simpleString()}, retry_count long, last_reason string, next_retry_at timestamp"
    begin = None if start is None else start.select(key, F.col("retry_count").cast("long").alias("retry_count")).groupBy(key)
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_RetryState(key, days), outputStructType=schema, outputMode="Update", timeMode="None" if days is None else "ProcessingTime", initialState=begin
    )


def stream_retry_state(stream: DataFrame, root: str, key: str, checkpoint: str, start: DataFrame | None = None, days: float | None = None) -> DataFrame:
    """Runs `retry_state` until the input is used up: the last state of each key that has misses, those of the table `start` (as of `record_misses`) included.

    Each micro-batch writes the keys that it changed under `root`, a rerun of it the same folder again; a run without new input
    returns what earlier ones left. With `days`, a run is one micro-batch, since a stream with timers by the clock has always another one.
    """
    spark, setting = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    updates, before = retry_state(stream, key, start, days), spark.conf.get(setting)

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/v={number}")

    # keyed state of this kind lives in RocksDB only
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = updates.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", checkpoint)
        run = (writer.trigger(availableNow=True) if days is None else writer.trigger(once=True)).start()
        run.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    there = [f"{root}/v={n}" for n in _folders(spark, root)]
    schema = StructType(updates.schema.fields).add("_batch", "long")
    states = spark.read.schema(schema).parquet(*there) if there else spark.createDataFrame([], schema)
    if start is not None:
        states = states.unionByName(start.select(key, F.col("retry_count").cast("long").alias("retry_count"), "last_reason", "next_retry_at", F.lit(-1).cast("long").alias("_batch")))
    return ingest.keep_first(states, key, [F.desc("_batch")], "drop")[0].where("retry_count > 0").drop("_batch")


def run_to_memory(stream: DataFrame, name: str, checkpoint: str, mode: str = "update") -> DataFrame:
    """Runs a stream until its input is used up and returns what it put out; for reports of bounded size."""
    run = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.table(name)


def file_stream(spark: SparkSession, path: str, schema, per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
