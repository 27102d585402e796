"""SimHash near-duplicates through an inverted index over byte positions, with count filtering.

A fingerprint is eight bytes at fixed positions. Two fingerprints at most `MAX_BITS` = 2 bits apart share
at least 8 - 2 = 6 positional bytes. The index keys each fingerprint by every choice of five positions
with their bytes (56 postings). Pairs that meet in postings are tallied: with 5, 6 or 7 shared bytes they
meet 1, 6 or 21 times, so the count filter keeps pairs that meet 6 times, the guaranteed minimum, and those
are verified bit by bit. Members of one posting differ in three bytes only, hence a posting holds 2**24
members at most (128 MB) whatever the corpus. Members of postings over `PAIR_LIMIT`, whose pairs would grow
with the square, are linked through shared one-bit neighbours as well, which needs 65 rows a fingerprint and
loses no link: two fingerprints at most two bits apart share such a neighbour.

Defined results: null and empty texts have fingerprint zero and link like any other; equal fingerprints
are one node, so repeated rows, ties and huge groups of copies cost one row; a null id gets the
component of its fingerprint and never names one unless all ids are null. Whole texts are read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave.llm.common import connected_components, lean_batches, written

SHINGLE = 3
SEED = 42
MAX_BITS = 2
BYTES = 8
LEAST_SHARED = BYTES - MAX_BITS
KEY_BYTES = 5
#: Pairs that share `LEAST_SHARED` bytes meet in so many postings.
LEAST_MEETINGS = comb(LEAST_SHARED, KEY_BYTES)
PAIR_LIMIT = 64
#: So many shingle hashes are turned into bits at once, which bounds a task's memory for any text.
_CHUNK = 1 << 15


def fingerprint(data: bytes | None) -> int:
    """The 64-bit SimHash of one text, signed."""
    from xxhash import xxh64_intdigest

    words = (data or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        hashes = [xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(at, min(n, at + _CHUNK))]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp: long) for every row of `docs`."""
    lean_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = pa.array((fingerprint(x.as_py()) for x in b.column(1)), pa.int64(), size=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), fps], names=[key, "fp"])

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("binary").alias("data"))
    return rows.mapInArrow(run, f"{key} long, fp long")


def byte_at(fp, k: int) -> F.Column:
    return F.shiftright(fp, 8 * k).bitwiseAND(F.lit(0xFF))


def postings(fps: DataFrame) -> DataFrame:
    """(slot: long, fp: long) of distinct fingerprints: one row for each choice of `KEY_BYTES` byte positions."""
    keys = []
    for number, places in enumerate(combinations(range(BYTES), KEY_BYTES)):
        key = F.lit(number).cast("long")
        for k in places:
            key = F.shiftleft(key, 8).bitwiseOR(byte_at(F.col("fp"), k))
        keys.append(key)
    return fps.select(F.explode(F.array(*keys)).alias("slot"), "fp")


def tallied(lists: DataFrame) -> DataFrame:
    """(u, v, meetings) of the pairs u < v that meet in posting `lists` (fps: array)."""
    pairs = lists.select("fps", F.explode("fps").alias("u"))
    pairs = pairs.select("u", F.explode(F.filter("fps", lambda b: b > F.col("u"))).alias("v"))
    return pairs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("meetings"))


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v: long) over distinct fingerprints `fps` (fp) that connect all pairs at most `MAX_BITS` apart."""
    lists = postings(fps).groupBy("slot").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    lists = written(lists.select("fps"), "postings")
    counted = tallied(lists.where(F.size("fps") <= PAIR_LIMIT)).where(F.col("meetings") >= LEAST_MEETINGS)
    pairs = counted.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS).select("u", "v")
    big = lists.where(F.size("fps") > PAIR_LIMIT).select(F.explode("fps").alias("u")).distinct()
    one_bit = [F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]
    spots = big.select("u", F.explode(F.array(F.lit(0).cast("long"), *one_bit)).alias("flip"))
    spots = spots.select("u", F.col("u").bitwiseXOR(F.col("flip")).alias("spot"))
    least = spots.groupBy("spot").agg(F.min("u").alias("v"))
    stars = spots.join(least, "spot").where("u <> v").select("u", "v")
    return pairs.union(stars)


def components(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp, component_id) for every row: the least key that is linked, directly or not."""
    fps = written(fingerprints(docs, text, key), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min(key).alias("first")), "nodes")
    # a number of its own keeps the small rows, each of which gives 56 postings, from being dealt to one or two tasks
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    roots = connected_components(links(nodes.select("fp").repartition(tasks, "fp")))
    grouped = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    grouped = written(grouped, "groups")
    firsts = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = written(grouped.join(firsts, "root").select("fp", "component_id"), "components")
    return fps.join(of_fp, "fp").select(key, "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each group, that with the least key; of repeated rows of that key, one."""
    first = components(docs, text, key).where(F.col(key).eqNullSafe(F.col("component_id")))
    counted = written(first.groupBy(key).agg(F.count(F.lit(1)).alias("copies")), "kept")
    # the kept ids grow with the corpus: a merge join at every size, never a broadcast
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("long").alias("row_key"))
    kept = rows.join(counted.select(F.col(key).alias("kept_key"), "copies").hint("merge"), F.col("row_key").eqNullSafe(F.col("kept_key")))
    if not counted.where("copies > 1").isEmpty():
        once = kept.where("copies = 1").select("row", "row_key")
        kept = once.union(kept.where("copies > 1").select("row", "row_key").dropDuplicates(["row_key"]))
    return kept.select("row.*")
