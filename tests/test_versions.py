"""Versioned tables: all or nothing, pinned readers, conflicts, and the deltas that are published to them."""

import pytest
from pyspark.sql import functions as F

from dealweave.operators import ingest
from dealweave.sources.versions import Conflict, Rejected, Versions
from dealweave.streaming import incremental as J

SCHEMA = "id long, v string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    t = Versions(spark, f"file://{tmp_path}/t", "id", 8)
    t.replace(spark.createDataFrame([(i, f"a{i}") for i in range(40)], SCHEMA))
    return t


def ids(spark, *n):
    return spark.createDataFrame([(i,) for i in n], "id long")


def test_patch_touches_its_buckets_only(spark, table):
    before = table.manifest()["folders"]
    pinned = table.read()
    assert table.patch(spark.createDataFrame([(3, "new"), (77, "more")], SCHEMA), ids(spark, 3, 77, 5), ids(spark, 8)) == 2
    want = {i: f"a{i}" for i in range(40) if i not in (5, 8)} | {3: "new", 77: "more"}
    assert dict(rows(table.read())) == want
    assert dict(rows(pinned)) == dict(rows(table.read(1))) == {i: f"a{i}" for i in range(40)}  # readers keep their version
    after, touched = table.manifest()["folders"], table.buckets_of(ids(spark, 3, 77, 5, 8))
    assert 0 < len(touched) < 8 and {b for b in before if after.get(b) != before[b]} == {str(b) for b in touched if str(b) in before}
    assert rows(table.lookup(ids(spark, 3, 5, 9))) == [(3, "new"), (9, "a9")]


def test_killed_before_commit(spark, table, monkeypatch):
    """A run that dies between write and commit leaves the old version; the next one goes on from it, and vacuum clears what it left."""
    patch = spark.createDataFrame([(3, "new")], SCHEMA)

    def dies(self, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Versions, "_commit", dies)
        with pytest.raises(KeyboardInterrupt):
            table.patch(patch, ids(spark, 3), ids(spark))
    again = Versions(spark, table.root, "id", 8)
    assert again.current() == 1 and dict(rows(again.read()))[3] == "a3"
    assert again.patch(patch, ids(spark, 3), ids(spark)) == 2 and dict(rows(again.read()))[3] == "new"
    left = len(again._names("data"))
    again.vacuum(1)
    assert len(again._names("data")) == left - 1 and again.versions() == [2] and again.read().count() == 40


def test_conflict_and_verification(spark, table, monkeypatch):
    patch, real = spark.createDataFrame([(3, "new")], SCHEMA), Versions._commit

    def late(self, manifest):  # another writer comes first
        real(self, manifest | {"folders": {}})
        return real(self, manifest)

    with monkeypatch.context() as m:
        m.setattr(Versions, "_commit", late)
        with pytest.raises(Conflict):
            table.patch(patch, ids(spark, 3), ids(spark))
    assert table.current() == 2 and table.read().count() == 0
    with pytest.raises(Rejected):
        table.replace(patch, lambda staged: staged.count() == 2)
    with pytest.raises(ValueError, match="outside"):
        table.patch(patch, ids(spark, 4), ids(spark))
    with pytest.raises(ValueError, match="outside"):  # what is removed is not changed
        table.patch(patch, ids(spark, 3), ids(spark, 3))
    assert table.current() == 2


def test_empty_tables(spark, tmp_path):
    t = Versions(spark, f"file://{tmp_path}/t", "id")
    assert t.current() == 0
    with pytest.raises(ValueError, match="no version"):
        t.read()
    assert t.replace(spark.createDataFrame([], SCHEMA)) == 1 and t.read().count() == 0 and t.read().columns == ["id", "v"]
    assert t.patch(spark.createDataFrame([(1, None)], SCHEMA), ids(spark, 1), ids(spark)) == 2 and rows(t.read()) == [(1, None)]


def plan(spark, *acts):
    return spark.createDataFrame(list(acts), "id long, action string")


def test_publish_reasons(spark, table, tmp_path):
    redo = lambda changed: changed.select("id", F.lit("z").alias("v"))
    full = table.read().where("id <> 2").withColumn("v", F.when(F.col("id") == 1, "z").otherwise(F.col("v")))

    def said(*a, t=table, **b):
        return tuple(J.publish_delta(t, *a, **b).first())

    assert said(plan(spark), redo) == (False, "no_changes", 1, 0, 0, 0)
    none = Versions(spark, f"file://{tmp_path}/none", "id")
    assert said(plan(spark, (1, "rematch")), redo, t=none)[1] == "cache_not_ready"
    none.replace(spark.createDataFrame([], SCHEMA))
    assert said(plan(spark, (1, "rematch")), redo, t=none)[1] == "active_cache_empty"
    acts = plan(spark, (1, "rematch"), (2, "remove"), (2, "rescore"))
    assert said(acts, redo, version=("v", "a1"))[1] == "cache_entry_version_mismatch"
    assert said(acts, lambda changed: redo(changed.union(ids(spark, 9))))[1] == "patch_outside_scope"
    assert said(acts, redo, full=full.where("id <> 7")) == (False, "verification_mismatch", 1, 1, 1, 0)
    assert rows(table.read()) == rows(table.read(1)) and table.current() == 1
    assert said(acts, redo, full=full) == (True, None, 2, 1, 1, 1)
    assert rows(table.read()) == rows(full)


def test_snapshot_versions(spark, tmp_path):
    t = Versions(spark, f"file://{tmp_path}/t", "id")
    df = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    publish = lambda new: ingest.publish_snapshot(new, t, ["id", "v"], F.col("v").isNotNull()).first()
    assert publish(df)["action"] == "replace" and t.current() == 1
    assert publish(df)["action"] == "keep" and publish(df.limit(0))["action"] == "stale" and t.current() == 1
    assert publish(df.where("id = 1").union(spark.createDataFrame([(3, None)], SCHEMA)))["action"] == "replace" and rows(t.read()) == [(1, "a")]


def test_refresh_indexes(spark, tmp_path):
    old = spark.createDataFrame([(i, f"old{i}") for i in range(10)], SCHEMA)
    fresh = old.where("id <> 4").withColumn("v", F.lit("new"))
    out, status = J.refresh_indexes({"terms": (old, fresh), "search": (old.where("id < 3"), fresh)}, ids(spark, 2, 4, 4, 99), "id")
    assert rows(status) == [("search", 2, 1, 1), ("terms", 8, 2, 1)]
    assert dict(rows(out["terms"])) == {i: f"old{i}" for i in range(10) if i not in (2, 4)} | {2: "new"}
    tables = {n: (Versions(spark, f"file://{tmp_path}/{n}", "id", 4), lambda changed: fresh.join(changed, "id", "left_semi")) for n in ("a", "b")}
    for t, _ in tables.values():
        t.replace(old)
    for k, batch in enumerate([(2, 4), (7,)]):
        ids(spark, *batch).coalesce(1).write.parquet(f"file://{tmp_path}/in/k={k}")
    source = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    assert J.stream_refresh(source(), tables, "id", f"file://{tmp_path}/log") == 2
    for t, _ in tables.values():
        assert dict(rows(t.read())) == {i: f"old{i}" for i in range(10) if i not in (2, 4, 7)} | {2: "new", 7: "new"}
    assert J.stream_refresh(source(), tables, "id", f"file://{tmp_path}/log") == 0
