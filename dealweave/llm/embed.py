"""Embedding near-duplicates by NN-descent.

Equal vectors are one node. A forest of random hyperplane cells gives every node its first `K` neighbours. The
planes of a cell go through its mean, whatever direction the vectors share, and cells that are still too large
are split again; there are so many trees that a pair at the threshold shares a cell of one with probability
`MET`, in a very narrow cone as many as the audit asks for. Then each round joins the neighbour graph with itself at every node (its neighbours and those that have it
as a neighbour are compared with each other) and keeps the best lists. Lists of which all members are over
the threshold are saturated and are enlarged for the next round. Lists only steer the search: of all pairs
that are ever compared, those over the threshold are kept as ties (as a spanning forest of each compared group,
which joins the same nodes). Ties are verified in double precision and give components; components with
saturated lists are searched again with fresh planes until nothing more joins them. Inside each component all
pairs are compared in blocks, which counts links exactly however large a group of copies is. The audit compares every node whose digest is divisible by
`AUDIT_EVERY` with all nodes, in blocks, and only measures: the mean share of its links that each audited node
has, over all of them and over those of each size of group, must reach `RECALL`. Until then longer lists and as
many fresh trees again are added; when `ATTEMPTS` are used up, the run fails and names the shares.

Defined results: vectors that are null, zero or hold null or non-finite components link with nothing;
vectors of different lengths never link; equal vectors link with each other; rows with one id count as
rows each; a null id is never a component's name unless all ids in it are null; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealweave.llm.common import connected_components, lean_batches, written

THRESHOLD = 0.95
#: Room for rounding of 32-bit similarities, which only propose edges.
SLACK = 1e-4
K = 8
SATURATED_K = 32
#: Probability that a pair at the threshold meets in a cell, which gives the number of trees; so many of them are built at a time.
MET = 0.99
TREES = 8
#: A very narrow cone starts with so many trees; the audit then asks for more.
FIRST_TREES = 64
CELL = 256
#: Splits of too large cells, and planes at once. What no plane splits is dealt out by hash.
SPLITS = 8
PLANES = 20
ROUNDS = 3
#: A round that changes fewer of its links than this is the last.
SETTLED = 0.01
BLOCK = 256
AUDIT_EVERY = 50
#: Nodes that are asked for at least, if there are so many.
AUDIT_LEAST = 200
RECALL = 0.98
#: Each one doubles lists and trees.
ATTEMPTS = 6
SEED = 7


def nodes_of(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(raw: binary, node, copies, dim, v: binary float64 of length one): distinct valid vectors."""

    def run(batches):
        for b in batches:
            ids, raws, dims, units = [], [], [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                values = x.as_py()
                if not values or None in values:
                    continue
                a = np.array(values, np.float64)
                if not np.isfinite(a).all() or not a.any():
                    continue
                a = a / np.abs(a).max()
                ids.append(i)
                raws.append((np.array(values, np.float64) + 0.0).tobytes())
                dims.append(len(a))
                units.append((a / np.linalg.norm(a)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raws, pa.binary()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["id", "raw", "dim", "v"])

    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("x")).mapInArrow(run, "id long, raw binary, dim int, v binary")
    return rows.groupBy("raw", "dim", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


def _groups(batches, n_keys: int):
    """(table) of each run of rows with equal first `n_keys` columns; the input is sorted by them."""
    rest = None
    for b in batches:
        table = pa.Table.from_batches([b])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        if not table.num_rows:
            continue
        keys = [table.column(i).to_numpy() for i in range(n_keys)]
        change = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        at = [0, *(np.flatnonzero(change) + 1).tolist()]
        for low, high in zip(at, at[1:], strict=False):
            yield table.slice(low, high - low)
        rest = table.slice(at[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _matrix(column, dtype) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1)


class _Links:
    """Collects (u, v, sim, tie) rows into batches of bounded size."""

    def __init__(self, limit: int = 100_000):
        self.limit, self.parts, self.n = limit, [], 0

    def add(self, u, v, sim, tie):
        self.parts.append((u, v, sim, tie))
        self.n += len(u)
        return self.n >= self.limit

    def batch(self):
        u, v, sim, tie = (np.concatenate([p[i] for p in self.parts]) if self.parts else np.empty(0) for i in range(4))
        self.parts, self.n = [], 0
        return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(sim.astype(np.float32)), pa.array(tie.astype(bool))], names=["u", "v", "sim", "tie"])


_LINKS = "u long, v long, sim float, tie boolean"


def _forest(sims: np.ndarray):
    """(rows, cols): pairs that join what all pairs over the threshold join.

    Pairs surely over it give a spanning forest; pairs that rounding could move over or under it are all given
    where the sure ones don't join their ends.
    """
    sure, maybe = sims >= THRESHOLD + SLACK, np.abs(sims - THRESHOLD) < SLACK
    label, rows, cols = np.full(len(sims), -1), [], []
    for start in np.flatnonzero(sure.any(axis=1)).tolist():
        if label[start] >= 0:
            continue
        label[start], edge = start, np.array([start])
        while len(edge):
            fresh = np.flatnonzero(sure[edge].any(axis=0) & (label < 0))
            rows.append(edge[sure[np.ix_(edge, fresh)].argmax(axis=0)])
            cols.append(fresh)
            label[fresh], edge = start, fresh
    a, b = np.nonzero(np.triu(maybe, 1))
    apart = (label[a] != label[b]) | (label[a] < 0)
    return np.concatenate([*rows, a[apart]]).astype(np.int64), np.concatenate([*cols, b[apart]]).astype(np.int64)


def _best(ids: np.ndarray, x: np.ndarray, keep: np.ndarray, floor: np.ndarray):
    """(u, v, sim, tie): for each row its `keep` best others whose similarity passes its floor, and the ties among all rows."""
    sims = x @ x.T
    sims[ids[:, None] == ids[None, :]] = -2
    most = min(int(keep.max()), len(ids) - 1)
    if most < 1:
        return np.empty(0), np.empty(0), np.empty(0), np.empty(0)
    a, b = _forest(sims)
    top = np.argpartition(-sims, most - 1, axis=1)[:, :most]
    values = np.take_along_axis(sims, top, axis=1)
    order = np.argsort(-values, axis=1, kind="stable")
    top, values = np.take_along_axis(top, order, axis=1), np.take_along_axis(values, order, axis=1)
    good = (np.arange(most)[None, :] < keep[:, None]) & (values > floor[:, None]) & (values > -1.5)
    rows, cols = np.nonzero(good)
    tie = np.arange(len(rows) + len(a)) >= len(rows)
    return np.concatenate([ids[rows], ids[a]]), np.concatenate([ids[top[rows, cols]], ids[b]]), np.concatenate([values[rows, cols], sims[a, b]]), tie


def split(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates for lists, ties) of what a comparison found; both come from one written table."""
    found = written(found, "found")
    return found.where("not tie").drop("tie"), found.where("tie").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "sim").distinct()


def spread(nodes: DataFrame) -> float:
    """Root mean square distance of the vectors from the mean of their length; the least of all lengths."""

    def run(batches):
        for b in batches:
            dims = b.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                x = _matrix(b.column(1).take(pa.array(np.flatnonzero(dims == dim))), np.float32).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(x)], pa.int64()), pa.array(np.arange(dim)[None].tolist(), pa.list_(pa.int32())), pa.array([x.sum(axis=0).tolist()], pa.list_(pa.float64()))], names=["dim", "n", "at", "total"])

    parts = nodes.select("dim", "v").mapInArrow(run, "dim int, n long, at array<int>, total array<double>")
    each = parts.select("dim", "n", F.explode(F.arrays_zip("at", "total")).alias("x")).groupBy("dim", "x.at").agg((F.sum("x.total") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    # vectors have length one, so their mean square distance is one less the mean's square
    norms = each.groupBy("dim").agg(F.sum(F.col("mean") * F.col("mean")).alias("square"), F.max("n").alias("n")).where(F.col("n") > CELL)
    most = norms.agg(F.max("square")).first()[0]
    return float(np.sqrt(max(0.0, 1.0 - (most or 0.0))))


def trees_for(count: int, width: float = 1.0) -> int:
    """Trees in which a pair at the threshold shares a cell with probability `MET`, among vectors that are `width` away from their mean; `FIRST_TREES` at most."""
    bits = max(0, round(np.log2(max(1, count / CELL))))
    chord = np.sqrt(2 - 2 * THRESHOLD)
    angle = 2 * np.arcsin(min(1.0, chord / max(2 * width, 1e-9)))
    shared = (1 - min(0.5, angle / np.pi)) ** bits
    return 1 if shared >= 1 else int(min(FIRST_TREES, np.ceil(np.log(1 - MET) / np.log1p(-shared))))


def cells(nodes: DataFrame, trees: range, seed: int = SEED) -> DataFrame:
    """(tree, dim, cell, node): cells are split by planes through their mean while they are over twice `CELL`."""

    def projected(turn):
        def run(batches):
            planes: dict = {}
            for b in batches:
                trees, dims = b.column(0).to_numpy(), b.column(1).to_numpy()
                out = np.zeros((b.num_rows, PLANES))
                for t, dim in {*zip(trees.tolist(), dims.tolist(), strict=True)}:
                    if (t, dim) not in planes:
                        planes[t, dim] = np.random.default_rng([seed, t, dim, turn]).standard_normal((dim, PLANES)).astype(np.float32)
                    mine = np.flatnonzero((trees == t) & (dims == dim))
                    out[mine] = _matrix(b.column(5).take(pa.array(mine)), np.float32) @ planes[t, dim]
                yield pa.RecordBatch.from_arrays([*b.columns[:5], *(pa.array(c) for c in out.T)], names=["tree", "dim", "cell", "node", "bits", *(f"p{i}" for i in range(PLANES))])

        return run

    key = ["tree", "dim", "cell"]
    rows = nodes.select(F.explode(F.array(*(F.lit(t) for t in trees))).alias("tree"), "dim", F.lit(0).cast("long").alias("cell"), "node")
    for turn in range(SPLITS):
        sizes = rows.groupBy(*key).count().where(F.col("count") > 2 * CELL)
        sizes = written(sizes.select(*key, F.least(F.lit(PLANES), F.greatest(F.lit(1), F.round(F.log2(F.col("count") / CELL)))).cast("int").alias("bits")), "sizes")
        if sizes.isEmpty():
            break
        large = rows.join(sizes, key).join(nodes.select("node", "v"), "node").select(*key, "node", "bits", "v")
        large = written(large.mapInArrow(projected(turn), "tree int, dim int, cell long, node long, bits int, " + ", ".join(f"p{i} double" for i in range(PLANES))), "planes")
        means = large.groupBy(*key).agg(*(F.avg(f"p{i}").alias(f"m{i}") for i in range(PLANES)))
        code = sum((F.when((F.col("bits") > i) & (F.col(f"p{i}") > F.col(f"m{i}")), 1 << i).otherwise(0) for i in range(PLANES)), F.lit(0))
        large = large.join(means, key).select("tree", "dim", F.xxhash64("cell", F.lit(turn), code).alias("cell"), "node")
        rows = written(rows.join(sizes, key, "left_anti").select(*key, "node").union(large), "cells")
    return rows


def first_graph(nodes: DataFrame, count: int, trees: int = TREES, seed: int = SEED, grow: int = 1) -> tuple[DataFrame, DataFrame]:
    """(lists, ties) from the cells of so many trees, `TREES` at a time."""

    def local(batches):
        out = _Links()
        for g in _groups(batches, 4):
            ids = g.column("node").to_numpy()
            if len(ids) > 1 and out.add(*_best(ids, _matrix(g.column("v"), np.float32), np.full(len(ids), K * grow), np.full(len(ids), -2.0))):
                yield out.batch()
        yield out.batch()

    lists, ties, key = None, None, ["tree", "dim", "cell"]
    for low in range(0, trees, TREES):
        rows = cells(nodes, range(low, min(trees, low + TREES)), seed)
        rows = rows.join(rows.groupBy(*key).count(), key).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("count") / (2 * CELL))).cast("int"))
        rows = rows.join(nodes.select("node", "v"), "node")
        rows = rows.select(*key, "part", "node", "v").repartition(*key, "part").sortWithinPartitions(*key, "part")
        near, more = split(rows.mapInArrow(local, _LINKS))
        lists = written(best_lists(near if lists is None else near.union(lists), grow), "graph")
        ties = more if ties is None else ties.union(more)
    return lists, ties


def best_lists(links: DataFrame, grow: int = 1) -> DataFrame:
    """The `K` best of each node, `SATURATED_K` where the first `K` are all over the threshold; both times `grow`."""
    once = links.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    by = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    ranked = once.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= SATURATED_K * grow)
    return ranked.where((F.col("rank") <= K * grow) | (F.col("sim") >= THRESHOLD - SLACK)).drop("rank")


def descend(graph: DataFrame, nodes: DataFrame, grow: int = 1, turn: int = 0) -> tuple[DataFrame, DataFrame]:
    """(lists, ties) of one round: every node compares its neighbours and reverse neighbours with each other; lists improve.

    A hub's neighbours are dealt out in parts, other ones in each `turn`.
    """
    full = F.col("n") >= K * grow
    saturated = F.when(full & (F.col("low") < THRESHOLD - SLACK), F.col("low"))
    limits = graph.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("low")).select(F.col("u").alias("node"), F.coalesce(saturated, F.when(full, F.lit(THRESHOLD - SLACK)).otherwise(F.lit(-2.0))).cast("float").alias("floor"))
    carried = nodes.select("node", "dim", "v").join(limits, "node", "left")
    pairs = graph.select(F.col("u").alias("at"), F.col("v").alias("node")).union(graph.select(F.col("v").alias("at"), F.col("u").alias("node"))).union(graph.select(F.col("u").alias("at"), F.col("u").alias("node"))).distinct()
    degree = pairs.groupBy("at").count()
    pairs = pairs.join(degree, "at").withColumn("part", F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("count") / (4 * SATURATED_K * grow))).cast("int"))
    rows = pairs.select("at", "part", "node").join(carried, "node")

    def local(batches):
        out = _Links()
        for g in _groups(batches, 2):
            ids = g.column("node").to_numpy()
            if len(ids) > 1:
                floor = g.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
                floor = np.where(np.isnan(floor), -2.0, floor)
                x = _matrix(g.column("v"), np.float32)
                if out.add(*_best(ids, x, np.full(len(ids), SATURATED_K * grow), floor)):
                    yield out.batch()
        yield out.batch()

    rows = rows.select("at", "part", "node", "floor", "v").repartition("at", "part").sortWithinPartitions("at", "part")
    near, ties = split(rows.mapInArrow(local, _LINKS))
    return best_lists(near.union(graph), grow), ties


def verified(ties: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v) with u < v of the ties whose cosine in double precision passes the threshold."""

    def run(batches):
        for b in batches:
            a, c = _matrix(b.column(2), np.float64), _matrix(b.column(3), np.float64)
            good = np.flatnonzero(np.einsum("ij,ij->i", a, c) >= THRESHOLD) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(good)), b.column(1).take(pa.array(good))], names=["u", "v"])

    near = ties.where(F.col("sim") >= THRESHOLD - SLACK).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    exact = nodes.select(F.col("node").alias("u"), F.col("exact").alias("a"), "dim")
    rows = near.join(exact, "u").join(exact.select(F.col("u").alias("v"), F.col("a").alias("b"), F.col("dim").alias("dim2")), "v").where("dim = dim2")
    return rows.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def joined(graph: DataFrame, edges: DataFrame, nodes: DataFrame, seed: int, grow: int = 1) -> tuple[DataFrame, DataFrame]:
    """(edges, roots): components of `edges`, after those with saturated lists were searched again until no search joins any."""
    while True:
        roots = connected_components(edges)
        lists = graph.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("low"))
        full = lists.where((F.col("n") >= SATURATED_K * grow) & (F.col("low") >= THRESHOLD - SLACK)).select(F.col("u").alias("node"))
        groups = full.join(roots, "node").select("root").distinct()
        among = written(roots.join(groups, "root").join(nodes, "node").select(*nodes.columns, "root"), "saturated")
        if among.agg(F.count_distinct("root")).first()[0] < 2:
            return edges, roots
        seed += 1
        _, ties = first_graph(among, size := among.count(), trees_for(size, spread(among)), seed)
        of = among.select("node", "root")
        apart = ties.join(of.select(F.col("node").alias("u"), F.col("root").alias("a")), "u").join(of.select(F.col("node").alias("v"), F.col("root").alias("b")), "v")
        more = written(verified(apart.where("a <> b").select("u", "v", "sim"), nodes), "links")
        if more.isEmpty():
            return edges, roots
        edges = edges.union(more)


def _blocked(rows: DataFrame) -> DataFrame:
    """(node, links) from (grp, node, dim, copies, exact, size): all pairs of each group, block by block of `BLOCK` nodes."""

    def run(batches):
        for g in _groups(batches, 3):
            block, ids, copies = g.column("block").to_numpy(), g.column("node").to_numpy(), g.column("copies").to_numpy()
            low, high = g.column("low")[0].as_py(), g.column("high")[0].as_py()
            x = _matrix(g.column("exact"), np.float64)
            a, b = block == low, block == high
            near = x[a] @ x[b].T >= THRESHOLD
            if low == high:
                np.fill_diagonal(near, False)
                n, c = ids[a], near @ copies[b]
            else:
                n, c = np.concatenate([ids[a], ids[b]]), np.concatenate([near @ copies[b], copies[a] @ near])
            yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), pa.array(c.astype(np.int64))], names=["node", "links"])

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    out = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    out = out.select("grp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "copies", "exact")
    out = out.repartition("grp", "low", "high").sortWithinPartitions("grp", "low", "high")
    return out.mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def audit(nodes: DataFrame, every: int = AUDIT_EVERY) -> DataFrame:
    """(u, v, sim, links): for each node with a digest divisible by `every` (more of them in small tables), compared with all nodes in blocks, its links in a block and the nearest of them."""
    everything = nodes.count()
    asked = nodes.where(F.pmod("node", F.lit(max(1, min(every, everything // AUDIT_LEAST)))) == 0)
    count = max(1, asked.count())
    blocks = -(-count // BLOCK)
    strips = max(1, -(-everything // (8 * BLOCK)))

    def run(batches):
        for g in _groups(batches, 2):
            query, ids, copies = g.column("query").to_numpy(zero_copy_only=False).astype(bool), g.column("node").to_numpy(), g.column("copies").to_numpy()
            q, x = np.flatnonzero(query), _matrix(g.column("exact"), np.float64)
            rest = np.flatnonzero(~query)
            if not len(q) or not len(rest):
                continue
            sims = x[q] @ x[rest].T
            sims[ids[q][:, None] == ids[rest][None, :]] = -2
            best = sims.argmax(axis=1)
            links = (sims >= THRESHOLD) @ copies[rest]
            hit = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q][hit]), pa.array(ids[rest][best[hit]]), pa.array(sims[hit, best[hit]].astype(np.float32)), pa.array(links[hit].astype(np.int64))], names=["u", "v", "sim", "links"])

    def each(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    everyone = nodes.withColumn("strip", F.pmod(F.xxhash64("node"), F.lit(strips))).withColumn("block", each(blocks)).withColumn("query", F.lit(False))
    queries = asked.withColumn("strip", each(strips)).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(blocks))).withColumn("query", F.lit(True))
    columns = ["dim", F.col("strip").cast("long").alias("strip"), F.col("block").cast("long").alias("block"), "query", "node", "copies", "exact"]
    rows = everyone.select(*columns).union(queries.select(*columns)).withColumn("cell", F.col("strip") * blocks + F.col("block"))
    rows = rows.select("dim", "cell", "query", "node", "copies", "exact").repartition("dim", "cell").sortWithinPartitions("dim", "cell")
    return rows.mapInArrow(run, "u long, v long, sim float, links long")


def recalls(truth: DataFrame, counted: DataFrame) -> dict[int, float]:
    """Mean share of its links that each audited node has: of all under 0, and by the doublings of group size (1, 2-3, 4-7, ... links) from 1."""
    wanted = truth.groupBy("u").agg(F.sum("links").alias("true"))
    both = wanted.join(counted.select(F.col("node").alias("u"), "links"), "u", "left")
    share = F.least(F.lit(1.0), F.coalesce("links", F.lit(0)) / F.col("true"))
    by = both.withColumn("share", share).withColumn("size", F.explode(F.array(F.lit(0), F.length(F.bin("true")))))
    return {r["size"]: r["share"] for r in by.groupBy("size").agg(F.avg("share").alias("share")).collect()}


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept, audited_recall) for every row of `vectors`; the last is the mean share of its links
    that each audited vector has, the same in all rows, null where no audited vector has links."""
    lean_batches(vectors.sparkSession, 10_000)
    found = written(nodes_of(vectors, key, column), "vectors")
    # a node is known by the digest of its bytes, whatever the ids; another seed serves if two share one
    for seed in range(SEED, SEED + 100):
        named = written(found.withColumn("node", F.xxhash64(F.lit(seed), "raw")), "named")
        if named.groupBy("node").count().where("count > 1").isEmpty():
            break
    shrink = F.col("v")

    def small(batches):
        for b in batches:
            v = [np.frombuffer(x, np.float64).astype(np.float32).tobytes() for x in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(v, pa.binary()), b.column(4)], names=["node", "id", "dim", "copies", "v", "exact"])

    nodes = named.select("node", "id", "dim", "copies", shrink.alias("exact"))
    nodes = written(nodes.mapInArrow(small, "node long, id long, dim int, copies long, v binary, exact binary"), "nodes")
    count = nodes.count()
    graph, ties, trees, grow = None, None, trees_for(count, spread(nodes)), 1
    truth = written(audit(nodes), "audit")
    for attempt in range(ATTEMPTS):
        lists, more = first_graph(nodes, count, trees, SEED + 1000 * attempt, grow)
        graph = written(lists if graph is None else best_lists(lists.union(graph), grow), "graph")
        ties = more if ties is None else ties.union(more)
        for turn in range(ROUNDS):
            better, more = descend(graph, nodes, grow, attempt * ROUNDS + turn)
            better, ties = written(better, "graph"), ties.union(more)
            size, same = better.count(), better.join(graph, ["u", "v"], "left_semi").count()
            graph = better
            if size - same <= SETTLED * size:
                break
        _, roots = joined(graph, written(verified(ties, nodes), "links"), nodes, SEED + 1000 * attempt + 500, grow)
        sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
        members = roots.join(sizes, "root").join(nodes, "node").select(F.col("root").alias("grp"), "node", "copies", "exact", "size")
        counted = written(_blocked(members), "counts")
        shares = recalls(truth, counted)
        if all(x >= RECALL for x in shares.values()):
            break
        trees, grow = 2 * trees if attempt else trees, 2 * grow
    else:
        raise RuntimeError(f"near-duplicate recall is under {RECALL} after {ATTEMPTS} attempts; by doublings of group size, 0 for all: {dict(sorted(shares.items()))}")
    groups = nodes.select("node", "id", "copies").join(roots, "node", "left").join(counted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = groups.groupBy("root").agg(F.min("id").alias("component_id"))
    groups = groups.join(firsts, "root").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    of_raw = written(named.select("raw", "node").join(groups, "node").select("raw", "component_id", "n_links"), "groups")
    # the raw bytes again, from the rows themselves
    rows = vectors.select(F.col(key).cast("long").alias(key), F.col(column).cast("array<double>").alias("x"))

    def raws(batches):
        for b in batches:
            raw = []
            for x in b.column(1):
                values = x.as_py()
                raw.append((np.array(values, np.float64) + 0.0).tobytes() if values and None not in values else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=[key, "raw"])

    out = rows.mapInArrow(raws, f"{key} long, raw binary").join(of_raw, "raw", "left")
    component = F.coalesce("component_id", F.col(key))
    return out.select(
        key,
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col(key).eqNullSafe(component).alias("kept"),
        F.lit(shares.get(0)).cast("double").alias("audited_recall"),
    )
