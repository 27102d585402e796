"""Helpers that the training-data operators share: tables, the shared folder, connected components."""

from __future__ import annotations

import functools
import shutil
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression of the white space between words.
SPACES = "[\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only in local mode where none is named, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or _own_folder()).rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/dealweave/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str = "stage") -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: lineage ends here, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@functools.cache
def _package_archive() -> str:
    root = Path(__file__).resolve().parents[2]
    return shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/dealweave", "zip", root, "dealweave")


def lean_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Readies this session's Python stages: the package goes to the executors once, and Arrow batches, whose rows are whole documents, stay small."""
    context = spark.sparkContext
    if not getattr(context, "_has_dealweave", False):
        context.addPyFile(_package_archive())
        context._has_dealweave = True
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def word_array(text) -> F.Column:
    """The words of a text column, null as no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def flat_words(data: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words, bounds) of binary or string `data`: text i has words[bounds[i]:bounds[i + 1]]; null has none."""
    cells = pc.ascii_split_whitespace(data.cast(pa.binary()).view(pa.string()))
    cells = pc.fill_null(cells, pa.scalar([], cells.type)) if cells.null_count else cells
    words, bounds = cells.flatten(), cells.offsets.to_numpy().astype(np.int64)
    filled = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    return words.filter(filled).view(pa.binary()), upto[bounds - bounds[0]]


def slices(data: pa.Array, size: int = 4_000_000):
    """(low, high) of runs of rows of about `size` bytes of binary or string `data`."""
    ends, low = np.cumsum(pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while low < len(ends):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + size, "right")))
        yield low, high
        low = high


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected `edges` (u, v: long); root names the component.

    Each round points every node to its least neighbour in an order shuffled by hash, contracts the
    graph along the pointers and drops loops and repeats, so the edge table shrinks geometrically;
    the rounds' small maps are composed at the end. Rows stay distributed throughout; the driver only
    learns whether edges are left. Null ends and loops are ignored; an empty table gives an empty one.
    """

    def order(c):
        return F.struct(F.xxhash64(c).alias("h"), c.alias("n"))

    edges = written(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct(), "edges")
    maps = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(order(F.col("v"))).alias("m"))
        step = written(
            least.select(F.col("u").alias("node"), F.least(F.col("m"), order(F.col("u")))["n"].alias("up")), "step"
        )
        maps.append(step)
        left, right = step.select(F.col("node").alias("u"), F.col("up").alias("a")), step.select(F.col("node").alias("v"), F.col("up").alias("b"))
        edges = written(
            edges.join(left, "u").join(right, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges"
        )
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = maps[-1].select("node", F.col("up").alias("root"))
    for step in reversed(maps[:-1]):
        further = roots.select(F.col("node").alias("up"), "root")
        roots = step.join(further, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    return written(roots, "roots")
