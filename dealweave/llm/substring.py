"""Substring dedup by a log-structured fingerprint index.

A window is `WINDOW` = 20 consecutive words. Each window is filed under its fingerprint: the least hash of
its ten-word runs (11 in a window). Equal windows have the same fingerprint at the same offset, and
neighbouring windows mostly share theirs, so a document has about one fingerprint per six words.

The index is a log: every batch of documents adds one immutable run, a table of (h, key, n) bucketed by
h and sorted by it, a row for each document and fingerprint. A new batch's run is merge-joined with the
runs before it, bucket by bucket; what it shares with them, or repeats itself, names candidates. Only
windows filed under those are then verified, by 128-bit digests of their words: a window is repeated if
its digest also starts earlier, in the history or in the batch. From `COMPACT_AT` runs on, runs are
compacted into one, which later batches are joined with. A manifest in the index's folder lists the runs, so that a later session can open
the index and add batches to it.

Tasks drop windows that they see repeated in a slice of their documents, so a huge group of copies sends
few rows per task and window to the shuffle, not a row per copy.

Defined results: null and empty texts have no words; texts under 20 words lose none; a null id counts as
the least; rows with one id share their windows' places, so equal rows keep or lose the same words; an
empty table gives an empty result; extra columns are ignored. Whole texts are read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealweave.llm.common import flat_words, lean_batches, new_path, slices, written

WINDOW = 20
RUN = 10
COMPACT_AT = 2
#: Batches of the log in `dedup`: the third meets the run that the first two were compacted into.
BATCHES = 3
#: Documents in a bucket of a table, about; a session's shuffle partitions are the least number of buckets.
BUCKET_ROWS = 20_000
_LEAST_KEY = -(1 << 63)
_RUNS = "h long, key long, n int"


def _factors(seed: int, count: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, count, np.uint64) | np.uint64(1)


_RUN_FACTORS, _HIGH_FACTORS, _LOW_FACTORS = _factors(1, RUN), _factors(2, WINDOW), _factors(3, WINDOW)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


class _Words:
    """Words of some texts as one array of hashes, with the fingerprint of each window."""

    def __init__(self, data: pa.Array):
        from xxhash import xxh64_intdigest

        words, self.bounds = flat_words(data)
        coded = words.dictionary_encode()
        of_word = np.fromiter(map(xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        self.hashes = of_word[coded.indices.to_numpy()]
        n = len(self.hashes)
        lengths = np.diff(self.bounds)
        inside = np.maximum(lengths - WINDOW + 1, 0)
        #: Places of all windows, and the text of each.
        self.text = np.repeat(np.arange(len(lengths)), inside)
        ends = np.cumsum(inside)
        self.starts = np.arange(len(self.text)) + np.repeat(self.bounds[:-1] - (ends - inside), inside)
        if not len(self.starts):
            self.anchors, self.runs = np.empty(0, np.int64), np.empty(0, np.uint64)
            return
        runs = np.zeros(n - RUN + 1, np.uint64)
        for j in range(RUN):
            runs += self.hashes[j : n - RUN + 1 + j] * _RUN_FACTORS[j]
        self.runs = runs = _mixed(runs)
        low, at, width, most = runs, np.arange(len(runs), dtype=np.int32), 1, WINDOW - RUN + 1
        while width < most:  # the least of `width` runs, from two halves that may overlap
            by = min(width, most - width)
            right = low[by:] < low[:-by]
            low, at = np.where(right, low[by:], low[:-by]), np.where(right, at[by:], at[:-by])
            width += by
        #: Place of the fingerprint of each window.
        self.anchors = at[self.starts]

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, fingerprint, number of places) of each text and fingerprint once."""
        first = np.append(True, self.anchors[1:] != self.anchors[:-1])[: len(self.anchors)]
        text, h = self.text[first], self.runs[self.anchors[first]]
        order = np.lexsort((h, text))
        text, h = text[order], h[order]
        at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))[: len(h)])
        return text[at], h[at].view(np.int64), np.diff(np.append(at, len(h))).astype(np.int32)

    def filed_under(self, hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Windows whose text has their fingerprint among its `hashes`; `text` names the text of each hash."""

        def code(h, t):
            return _mixed(h + t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

        return np.flatnonzero(np.isin(code(self.runs[self.anchors], self.text), code(hashes.view(np.uint64), text)))

    def digests(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit digests of some windows, as two halves."""
        high, low, starts = np.zeros((2, len(windows)), np.uint64), None, self.starts[windows]
        high, low = high
        for j in range(WINDOW):
            word = self.hashes[starts + j]
            high += word * _HIGH_FACTORS[j]
            low += word * _LOW_FACTORS[j]
        return _mixed(high).view(np.int64), _mixed(low).view(np.int64)


def _anchors(docs: DataFrame) -> DataFrame:
    """(h, key, n) of packed `docs` (key, data): each document's fingerprints once, with the number of places."""

    def run(batches):
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for low, high in slices(b.column(1)):
                text, h, n = _Words(b.column(1).slice(low, high - low)).fingerprints()
                columns = [pa.array(h), pa.array(keys[low:high][text]), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "key", "n"])

    return docs.select("key", "data").mapInArrow(run, _RUNS)


def _bucketed(df: DataFrame, column: str, kind: str, path: str, buckets: int) -> str:
    """Writes `df` to `path`, bucketed by `column` and sorted by it; returns the table's name."""
    name = f"{kind}_{uuid.uuid4().hex}"
    out = df.repartition(buckets, column).sortWithinPartitions(column).write.bucketBy(buckets, column).sortBy(column)
    out.option("path", path).option("compression", "zstd").saveAsTable(name)
    return name


def buckets_for(docs: DataFrame) -> int:
    """Buckets for tables over `docs`: by the number of its rows, which Parquet knows without a scan."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-docs.count() // BUCKET_ROWS))


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = 0) -> str:
    """Name of a table (key, data) of `docs`, bucketed by key, so that later joins with it move no text."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LEAST_KEY)).alias("key"), data.alias("data"))
    return _bucketed(rows, "key", "texts", new_path(docs.sparkSession, "texts"), buckets or buckets_for(docs))


class FingerprintIndex:
    """The log: its runs, oldest first, in a folder with a manifest of them."""

    def __init__(self, spark: SparkSession, folder: str | None = None, compact_at: int = COMPACT_AT):
        self.spark, self.folder, self.compact_at = spark, folder or new_path(spark, "index"), compact_at
        self.version, self.compactions = 0, 0
        #: (table, path, buckets) of each run.
        self.runs: list[tuple[str, str, int]] = []

    @classmethod
    def open(cls, spark: SparkSession, folder: str, compact_at: int = COMPACT_AT) -> FingerprintIndex:
        """The index that an earlier session left in `folder`."""
        index = cls(spark, folder, compact_at)
        listed = spark.read.parquet(f"{folder}/manifest")
        newest = listed.where(F.col("version") == listed.agg(F.max("version")).first()[0]).orderBy("place").collect()
        index.version, index.compactions = newest[0]["version"], newest[0]["compactions"]
        for r in newest:
            name = f"run_{uuid.uuid4().hex}"
            clustered = f"CLUSTERED BY (h) SORTED BY (h) INTO {r['buckets']} BUCKETS"
            columns = _RUNS.replace("long", "BIGINT").replace("int", "INT")
            spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {clustered} LOCATION '{r['path']}'")
            index.runs.append((name, r["path"], r["buckets"]))
        return index

    def _note(self) -> None:
        """A new version of the manifest."""
        self.version += 1
        rows = [(self.version, i, path, buckets, self.compactions) for i, (_, path, buckets) in enumerate(self.runs)]
        columns = "version int, place int, path string, buckets int, compactions int"
        self.spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def _write(self, rows: DataFrame, buckets: int) -> tuple[str, str, int]:
        path = f"{self.folder}/run-{uuid.uuid4().hex}"
        return _bucketed(rows, "h", "run", path, buckets), path, buckets

    def append(self, anchors: DataFrame, buckets: int) -> str:
        """Adds a run of (h, key, n); returns its table."""
        self.runs.append(self._write(anchors, buckets))
        self._note()
        return self.runs[-1][0]

    def compact(self) -> None:
        """All runs as one."""
        old = self.runs
        merged = self.spark.table(old[0][0])
        for name, _, _ in old[1:]:
            merged = merged.union(self.spark.table(name))
        self.runs = [self._write(merged, max(buckets for _, _, buckets in old))]
        self.compactions += 1
        self._note()
        for name, _, _ in old:
            self.spark.sql(f"DROP TABLE {name}")

    def close(self) -> None:
        """Takes the runs' names out of the catalogue; their files and the manifest stay."""
        for name, _, _ in self.runs:
            self.spark.sql(f"DROP TABLE {name}")
        self.runs = []

    def candidates(self, new: str) -> DataFrame:
        """(key, old, hashes) of documents with fingerprints that the run `new` repeats or shares with older runs."""
        run = self.spark.table(new)
        hits = run.groupBy("h").agg((F.sum("n") > 1).alias("twice"))
        older, shared = [self.spark.table(name) for name, _, _ in self.runs if name != new], F.lit(False)
        for k, other in enumerate(older):
            hits = hits.join(other.groupBy("h").agg(F.lit(True).alias(f"old{k}")), "h", "left")
            shared = shared | F.coalesce(F.col(f"old{k}"), F.lit(False))
        hits = written(hits.select("h", "twice", shared.alias("shared")).where("twice OR shared"), "hits")
        found = run.join(hits.select("h"), "h").select("key", F.lit(False).alias("old"), "h")
        for other in older:
            more = other.join(hits.where("shared").select("h"), "h").select("key", F.lit(True).alias("old"), "h")
            found = found.union(more)
        return found.groupBy("key", "old").agg(F.collect_list("h").alias("hashes"))


def _verify(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (hi, lo, key, old, start) of windows to compare, and rows with starts of windows that the task saw repeated."""

    def compared(keys, olds, lists, data):
        words = _Words(data)
        counts = np.diff(lists.offsets.to_numpy())
        hashes, of = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(counts)), counts)
        windows = words.filed_under(hashes, of)
        hi, lo = words.digests(windows)
        text = words.text[windows]
        key, old, start = keys[text], olds[text], (words.starts[windows] - words.bounds[text]).astype(np.int32)
        order = np.lexsort((start, key, ~old, lo, hi))
        hi, lo, key, old, start = (x[order] for x in (hi, lo, key, old, start))
        head = np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))[: len(hi)]
        leader = np.maximum.accumulate(np.where(head, np.arange(len(hi)), 0))
        again = ~head & ~old & ((key != key[leader]) | (start != start[leader]))
        order = np.lexsort((start[again], key[again]))
        key2, start2 = key[again][order], start[again][order]
        at = np.flatnonzero(np.append(True, key2[1:] != key2[:-1])[: len(key2)])
        n, m = int(head.sum()), len(at)
        spread = np.arange(m, dtype=np.int64)  # these rows only pass through the shuffle
        seen = pa.ListArray.from_arrays(pa.array(np.append(at, len(key2)), pa.int32()), pa.array(start2))
        columns = [
            pa.array(np.concatenate([hi[head], spread])),
            pa.array(np.concatenate([lo[head], spread])),
            pa.array(np.concatenate([key[head], key2[at]])),
            pa.array(np.concatenate([old[head], np.zeros(m, bool)])),
            pa.concat_arrays([pa.array(start[head]), pa.nulls(m, pa.int32())]),
            pa.concat_arrays([pa.nulls(n, seen.type), seen]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["hi", "lo", "key", "old", "start", "starts"])

    def run(batches):
        for b in batches:
            keys, olds = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for low, high in slices(b.column(3)):
                part = [x.slice(low, high - low) for x in (b.column(2), b.column(3))]
                yield compared(keys[low:high], olds[low:high].astype(bool), *part)

    # a document's hashes are fewer than its words, so a bucket of them fits where the bucket's texts do
    rows = texts.join(found.hint("shuffle_hash"), "key").select("key", "old", "hashes", "data")
    return rows.mapInArrow(run, "hi long, lo long, key long, old boolean, start int, starts array<int>")


def repeated_windows(index: FingerprintIndex, batch: DataFrame, texts: DataFrame, buckets: int, last: bool = False) -> DataFrame:
    """(key, starts) of windows of `batch` that also start earlier; the batch joins the index, which is compacted unless this was its `last`.

    `batch` and `texts` are packed rows (key, data); `texts` has the batch and all that the index covers.
    """
    new = index.append(_anchors(batch), buckets)
    place = F.when(F.col("starts").isNull(), F.struct((~F.col("old")).alias("new"), "key", "start"))
    windows = _verify(index.candidates(new), texts)
    windows = windows.withColumn("first", F.min(place).over(Window.partitionBy("hi", "lo")))
    later = windows.where(F.col("starts").isNotNull() | (~F.col("old") & (place != F.col("first"))))
    starts = F.coalesce("starts", F.array("start"))
    found = written(later.groupBy("key").agg(F.flatten(F.collect_list(starts)).alias("starts")), "repeats")
    if not last and len(index.runs) >= index.compact_at:
        index.compact()
    return found


def _kept(rows: DataFrame) -> DataFrame:
    """(key, n_words, n_removed, kept: binary) of (key, data, starts)."""

    def run(batches):
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for data, starts in zip(b.column(1), b.column(2), strict=True):
                words = (data.as_py() or b"").split()
                n_words.append(len(words))
                if starts.is_valid:
                    starts = starts.values.to_numpy()
                    edges = np.zeros(len(words) + WINDOW + 1, np.int64)
                    np.add.at(edges, starts[starts < len(words)], 1)
                    np.add.at(edges, starts[starts < len(words)] + WINDOW, -1)
                    keep = np.cumsum(edges)[: len(words)] == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            columns = [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, "key long, n_words long, n_removed long, kept binary")


def dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES, index: FingerprintIndex | None = None
) -> DataFrame:
    """(key, n_words, n_removed, kept: binary) of every row: `docs` as a log of `batches` batches by ascending id.

    With the default of `COMPACT_AT`, the runs are compacted after each batch but the first, and but the last of an index that
    is not kept. `index` takes an index that is: it may hold older batches of `docs` already, and more can be added to it later.
    """
    lean_batches(docs.sparkSession)
    spark, buckets = docs.sparkSession, buckets_for(docs)
    name = pack(docs, key, text, buckets)
    texts = spark.table(name)
    parts = F.array(*(F.lit(k / batches) for k in range(1, batches)))
    cuts = texts.agg(F.percentile_approx("key", parts, 1000)).first()[0] if batches > 1 else []
    bounds = [None, *sorted(set(cuts or [])), None]
    log, repeats = index or FingerprintIndex(spark), None
    for low, high in zip(bounds, bounds[1:], strict=False):
        upto = texts if high is None else texts.where(F.col("key") < high)
        batch = upto if low is None else upto.where(F.col("key") >= low)
        found = repeated_windows(log, batch, upto, buckets, last=high is None and index is None)
        repeats = found if repeats is None else repeats.union(found)
    if index is None:
        log.close()
    out = _kept(texts.join(repeats, "key", "left").select("key", "data", "starts"))
    spark.sql(f"DROP TABLE {name}")
    return out.withColumn(key, F.when(F.col("key") != _LEAST_KEY, F.col("key"))).select(key, "n_words", "n_removed", "kept")
