"""A keyed table kept as immutable folders, each version of it named by a manifest.

Rows lie in buckets by the hash of their key. A version is a small JSON file that names the folder of each bucket; a change
writes new folders for the buckets that it touches and refers to the others where they are. A version exists
once its manifest does: a run that dies before leaves folders that nothing names, and readers keep the version they have opened.
The manifest is written beside its place and renamed into it; a rename that finds the place taken loses, as on HDFS.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dealweave.operators import diff


class Conflict(RuntimeError):
    """Another version was committed since the change was begun."""


class Rejected(RuntimeError):
    """The staged version failed its verification; the table is as before."""


class Versions:
    """The table under `root`, keyed by `key`."""

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 32):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())

    def current(self) -> int:
        """The last committed version, 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.current() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "folders": {}}
        lines = self.spark.read.text(f"{self.root}/manifests/{version}.json", wholetext=True)
        return json.loads(lines.first()[0])

    def _frame(self, manifest: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        if manifest["schema"] is None:
            raise ValueError("the table has no version yet")
        schema = StructType.fromJson(manifest["schema"])
        wanted = None if buckets is None else {str(b) for b in buckets}
        folders = [f"{self.root}/{f}" for b, f in sorted(manifest["folders"].items()) if wanted is None or b in wanted]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one by default; later commits don't change what has been opened."""
        return self._frame(self.manifest(version))

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets of some keys: as many numbers as there are buckets at most."""
        return sorted(r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect())

    def lookup(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of some keys, read from their buckets alone."""
        rows = self._frame(self.manifest(version), self.buckets_of(keys))
        return rows.join(keys.select(self.key).distinct(), self.key, "left_semi")

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _stage(self, rows: DataFrame, base: dict, touched: Iterable[int]) -> dict:
        """Writes the rows of the touched buckets to a new folder; the manifest that would follow `base`."""
        folder = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self._bucket()).hint("rebalance", F.col("_bucket"))  # large buckets are split
        dealt.write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        new = {n.removeprefix("_bucket="): f"{folder}/{n}" for n in self._names(folder) if n.startswith("_bucket=")}
        kept = {b: f for b, f in base["folders"].items() if int(b) not in set(touched)}
        schema = base["schema"] or json.loads(rows.schema.json())
        return {"version": base["version"] + 1, "schema": schema, "folders": kept | new}

    def _commit(self, manifest: dict) -> int:
        number = manifest["version"]
        place, beside = (self._path(f"{self.root}/manifests/{n}") for n in (f"{number}.json", f"{number}.{uuid.uuid4().hex}.tmp"))
        out = self._fs.create(beside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self.current() != number - 1 or self._fs.exists(place) or not self._fs.rename(beside, place):
            self._fs.delete(beside, False)
            raise Conflict(f"version {number} is there already")
        return number

    def _publish(self, manifest: dict, verify: Callable[[DataFrame], bool] | None) -> int:
        if verify is not None and not verify(self._frame(manifest)):
            raise Rejected("the staged version differs from what it must be")
        return self._commit(manifest)

    def replace(self, rows: DataFrame, verify: Callable[[DataFrame], bool] | None = None) -> int:
        """A version of these rows alone."""
        base = self.manifest()
        return self._publish(self._stage(rows, base | {"folders": {}, "schema": None}, ()), verify)

    def patch(self, patch: DataFrame, changed: DataFrame, removed: DataFrame, verify: Callable[[DataFrame], bool] | None = None) -> int:
        """All or nothing: changed keys get their rows of `patch`, removed ones go; only their buckets are read and written.

        `verify` sees the whole staged version before it is committed.
        """
        base = self.manifest()
        touched = self.buckets_of(changed.select(self.key).union(removed.select(self.key)))
        rows = diff.apply_patch(self._frame(base, touched), patch, changed, removed, self.key)
        return self._publish(self._stage(rows, base, touched), verify)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes manifests before the last `keep` and folders that no kept one names; not while a change is being staged."""
        kept = self.versions()[-keep:]
        named = {f.split("/")[1] for v in kept for f in self.manifest(v)["folders"].values()}
        for v in self.versions()[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/{v}.json"), False)
        for name in self._names("data"):
            if name not in named:
                self._fs.delete(self._path(f"{self.root}/data/{name}"), True)
