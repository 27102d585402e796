"""Streams that are run again, that are empty, that start from a table, and whose keys end."""

import datetime as dt
import time

from pyspark.sql import functions as F

from dealweave.operators import ingest as A
from dealweave.streaming import incremental as J

KEYED = "k long, n long, v string"
MISSES = "url string, at timestamp, ok boolean, temporary boolean, reason string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def day(n):
    return dt.datetime(2024, 1, n)


def test_upsert_again_and_again(spark, tmp_path):
    src, root, log = (f"file://{tmp_path}/{x}" for x in ("in", "out", "log"))
    (tmp_path / "in").mkdir()
    run = lambda: J.stream_upsert(J.file_stream(spark, src, KEYED), root, "k", "n", log, compact_every=2)
    assert run().count() == 0 and run().columns == ["k", "n", "v"]
    came = []
    for k in range(7):
        batch = [(k % 3, k, f"v{k}"), (5, -k, "first")]
        came += batch
        spark.createDataFrame(batch, KEYED).coalesce(1).write.mode("append").parquet(src)
        want = rows(A.keep_first(spark.createDataFrame(came, KEYED), "k", [F.desc("n")], "drop")[0])
        assert rows(run()) == want  # a new file
        assert rows(run()) == want  # nothing new
    left = sorted(int(p.name[2:]) for p in (tmp_path / "out").iterdir() if p.name.startswith("v="))
    assert left[0] >= 3 and left[-1] == 6  # what the whole folders replaced is gone


def test_upsert_ignores_a_folder_without_an_end(spark, tmp_path):
    src, root, log = (f"file://{tmp_path}/{x}" for x in ("in", "out", "log"))
    spark.createDataFrame([(1, 1, "a")], KEYED).coalesce(1).write.parquet(src)
    run = lambda: J.stream_upsert(J.file_stream(spark, src, KEYED), root, "k", "n", log)
    assert rows(run()) == [(1, 1, "a")]
    broken = tmp_path / "out" / "v=1"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")
    assert rows(run()) == [(1, 1, "a")]
    spark.createDataFrame([(1, 2, "b")], KEYED).coalesce(1).write.mode("append").parquet(src)
    assert rows(run()) == [(1, 2, "b")]


def test_retries_from_a_table(spark, tmp_path):
    """Batch, then stream, equals the stream alone and the batch alone."""
    one = [("a", day(1), False, False, "404"), ("b", day(1), False, True, "503"), ("c", day(1), False, False, "404"), ("d", day(1), False, False, "x")]
    two = [("a", day(2), False, False, "410"), ("b", day(3), True, False, ""), ("e", day(2), False, False, "404"), ("c", day(4), False, True, "503")]
    empty = spark.createDataFrame([], "url string, retry_count long, last_reason string, next_retry_at timestamp")
    first = A.record_misses(empty, spark.createDataFrame(one, MISSES), ["url"])
    both = A.record_misses(first, spark.createDataFrame(two, MISSES), ["url"])
    for name, batches, start in (("alone", [one, two], None), ("after", [two], first)):
        src = f"file://{tmp_path}/{name}"
        for batch in batches:
            spark.createDataFrame(batch, MISSES).coalesce(1).write.mode("append").parquet(src)
        run = lambda: J.stream_retry_state(J.file_stream(spark, src, MISSES), f"{src}-out", "url", f"{src}-log", start)  # noqa: B023, E731
        assert rows(run()) == rows(both)
        assert rows(run()) == rows(both)  # nothing new


def test_retries_end(spark, tmp_path):
    """A key without rows for the retention time is dropped by the clock, and counts anew after that."""
    src, out, log = (f"file://{tmp_path}/{x}" for x in ("in", "out", "log"))

    def come(*batch):
        spark.createDataFrame(list(batch), MISSES).coalesce(1).write.mode("append").parquet(src)
        return {r["url"]: r["retry_count"] for r in J.stream_retry_state(J.file_stream(spark, src, MISSES), out, "url", log, days=2 / 86_400).collect()}

    assert come(("a", day(1), False, False, "404"), ("b", day(1), False, False, "404")) == {"a": 1, "b": 1}
    time.sleep(3)
    assert come(("c", day(2), False, False, "404"))["c"] == 1
    time.sleep(3)
    after = come(("a", day(3), False, False, "404"))
    assert after["a"] == 1 and "b" not in after
