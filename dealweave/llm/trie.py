"""Prefix trie of rebuilt conversations by composable fingerprints.

A rebuilt conversation is the head of a base conversation followed by the rest of its own; its texts are never put
together. Every turn has a hash t, and a run of turns the monoid element (n, sum of t * r^place mod p): two runs
compose as (n + m, a + r^n * b). Running products of the stored turns therefore give the fingerprint of every prefix of
every rebuilt conversation from three numbers: the base's product at the cut, its own product at the cut, and its own
product at the turn. Prefixes of one depth and fingerprint form a node.

Equality is verified, not assumed. Each turn hash is held against the stored turns that bear it: one role and text
only. Each node's members must come from one fingerprint of the depth before, which fixes their last turn's hash; by
induction on the depth all members then have the same turns. If either test fails, all is done again with other
hashes and multipliers.

No conversation lies in one task: turns are dealt by ranges of their order, scanned, and the pieces' products composed.
Sums over subtrees need no pairs of nodes and ancestors: a member m of a node owns the depths where it is the least
member, and what it shares before them, U(m), is enough: the saving under a node v is the sum of U over its members,
less U of its least member, less (n_convs - 1) times the bytes before v. Digests of ends come from sorted chunks of ids, hashed in
order, so a node with very many ends sends packed text, not rows, to the task that hashes it.

Defined results: turns go by (turn, role, text), null turns first, null roles and texts empty; repeated rows are turns
of their own; rows without a conversation id belong to none and are left out, as are plan rows without one; a base that
is missing or short gives what it has; rebuilt conversations without turns are members of the root; extra columns are
ignored; an empty plan gives an empty table, without a root.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealweave.llm.common import lean_batches, written

PRIME = (1 << 31) - 1
#: Residues of one fingerprint, each with its own multiplier.
PARTS = range(3)
#: Bytes of packed ids in one row.
CHUNK = 1 << 20
NODE = ["depth", "f12", "f3"]


def multipliers(attempt: int) -> list[int]:
    """The multiplier of each residue; other ones for each attempt."""
    draw = random.Random(attempt)
    return [draw.randrange(1 << 20, PRIME - 1) for _ in PARTS]


def turn_hashes(role: Column, text: Column, attempt: int) -> list[Column]:
    """Three residues below `PRIME` from two 64-bit hashes of a turn."""
    a, b = (F.xxhash64(F.lit(2 * attempt + i), role, text) for i in range(2))
    mixed = [a.bitwiseAND(F.lit(PRIME)), F.shiftrightunsigned(a, 33), b.bitwiseAND(F.lit(PRIME))]
    return [F.pmod(x, F.lit(PRIME)) for x in mixed]


def _power(base: int, exponent: Column, bits: int = 40) -> Column:
    """base ** exponent mod PRIME for exponents below 2 ** bits."""
    out = F.lit(1).cast("long")
    for bit in range(bits):
        factor = F.when(F.shiftright(exponent, bit).bitwiseAND(F.lit(1)) == 1, F.lit(base)).otherwise(F.lit(1)).cast("long")
        out = F.pmod(out * factor, F.lit(PRIME))
        base = base * base % PRIME
    return out


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    out = np.ones(len(exponents), np.int64)
    for bit in range(int(exponents.max(initial=0)).bit_length()):
        out = np.where(exponents >> bit & 1, out * base % PRIME, out)
        base = base * base % PRIME
    return out


def _scan(batches, by: list[int]):
    """Running products within one range of ordered turns: place, term and product of each residue, bytes and their sum."""
    part, last, count, size = TaskContext.get().partitionId(), None, 0, 0
    sums = np.zeros(len(by), np.int64)
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        conv, length = b.column(0).to_numpy(), b.column(1).to_numpy()
        new = np.append(last is None or conv[0] != last, conv[1:] != conv[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        carried = np.cumsum(new) == 0
        place = np.arange(n) - start + 1 + np.where(carried, count, 0)

        def running(x, carry):
            total = np.cumsum(x)
            return total - (total - x)[start] + np.where(carried, carry, 0)  # noqa: B023

        terms = [b.column(2 + j).to_numpy() * _powers(r, place) % PRIME for j, r in enumerate(by)]
        products = [running(t, s) % PRIME for t, s in zip(terms, sums, strict=True)]
        sizes = running(length, size)
        last, count, size, sums = conv[-1], int(place[-1]), int(sizes[-1]), np.array([x[-1] for x in products])
        columns = [np.full(n, part), conv, place, *terms, *products, length, sizes]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=_SCAN)


_SCAN = ["part", "conv", "place", *(f"t{j}" for j in PARTS), *(f"s{j}" for j in PARTS), "bytes", "upto"]


def running_products(turns: DataFrame, by: list[int], attempt: int) -> DataFrame:
    """(conv, place, t0.., s0.., bytes, upto) of every turn of `turns` (conv, turn, role, text): its weighted hash and the product and bytes up to it."""
    hashes = [h.alias(f"h{j}") for j, h in enumerate(turn_hashes(F.col("role"), F.col("text"), attempt))]
    rows = turns.select("conv", "turn", "role", "text", F.octet_length("text").cast("long").alias("bytes"), *hashes, F.rand(attempt).alias("tie"))
    order = ["conv", "turn", "role", "text", "tie"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    scanned = dealt.select("conv", "bytes", *(f"h{j}" for j in PARTS)).mapInArrow(lambda b: _scan(b, by), ", ".join(f"{c} long" for c in _SCAN))
    scanned = written(scanned, "scan")
    piece = scanned.groupBy("conv", "part").agg(F.max(F.struct("place", *(f"s{j}" for j in PARTS), "upto")).alias("end")).select("conv", "part", "end.*")
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    piece = piece.withColumn("places", F.coalesce(F.sum("place").over(earlier), zero))
    piece = piece.withColumns({f"x{j}": _power(r, F.col("places")) for j, r in enumerate(by)})
    moved = {f"o{j}": F.pmod(F.coalesce(F.sum(F.pmod(F.col(f"s{j}") * F.col(f"x{j}"), F.lit(PRIME))).over(earlier), zero), F.lit(PRIME)) for j in PARTS}
    piece = piece.withColumns(moved | {"before": F.coalesce(F.sum("upto").over(earlier), zero)})
    piece = piece.select("conv", "part", "places", "before", *(f"x{j}" for j in PARTS), *(f"o{j}" for j in PARTS))
    out = scanned.join(piece, ["conv", "part"])
    shifted = [F.pmod(F.col(f"t{j}") * F.col(f"x{j}"), F.lit(PRIME)).alias(f"t{j}") for j in PARTS]
    composed = [F.pmod(F.col(f"o{j}") + F.col(f"s{j}") * F.col(f"x{j}"), F.lit(PRIME)).alias(f"s{j}") for j in PARTS]
    return out.select("conv", (F.col("place") + F.col("places")).alias("place"), *shifted, *composed, "bytes", (F.col("upto") + F.col("before")).alias("upto"))


def _distinct_turns(turns: DataFrame, attempt: int) -> bool:
    """Whether each turn hash stands for one stored role and text."""
    keys = [h.alias(f"h{j}") for j, h in enumerate(turn_hashes(F.col("role"), F.col("text"), attempt))]
    rows = turns.select(*keys, F.struct("role", "text").alias("stored"))
    ends = rows.groupBy(*(f"h{j}" for j in PARTS)).agg(F.min("stored").alias("least"), F.max("stored").alias("most"))
    return ends.where("least <> most").isEmpty()


def _members(products: DataFrame, plan: DataFrame, by: list[int]) -> DataFrame:
    """(conv, depth, f12, f3, g12, g3, bytes, upto, last) of every prefix of every rebuilt conversation: its fingerprint and that of the prefix before."""
    zero = F.lit(0).cast("long")
    longest = plan.agg(F.max("head")).first()[0] or 0
    sums = [f"s{j}" for j in PARTS]
    heads = products.where(F.col("place") <= longest)
    lengths = products.groupBy("conv").agg(F.max("place").alias("n"))
    spec = plan.join(lengths, "conv", "left").join(lengths.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    spec = spec.withColumn("k", F.least("head", F.coalesce("base_n", zero)))
    at_base = heads.select(F.col("conv").alias("base"), F.col("place").alias("k"), *(F.col(s).alias(f"b{s}") for s in sums), F.col("upto").alias("b_upto"))
    at_own = heads.select("conv", F.col("place").alias("head"), *(F.col(s).alias(f"o{s}") for s in sums), F.col("upto").alias("o_upto"))
    spec = spec.join(at_base, ["base", "k"], "left").join(at_own, ["conv", "head"], "left")
    spec = spec.na.fill(0, [f"{side}{s}" for side in "bo" for s in sums] + ["b_upto", "o_upto"])
    long_ = F.col("k") + F.greatest(F.coalesce("n", zero) - F.col("head"), zero)
    back = {f"x{j}": _power(pow(r, -1, PRIME), F.col("head") - F.col("k")) for j, r in enumerate(by)}
    spec = written(spec.withColumn("long", long_).withColumns(back), "spec")

    def rows(df, depth, prints, before, size, upto):
        f, g = [F.shiftleft(x[0], 31).bitwiseOR(x[1]) for x in (prints, before)], [prints[2], before[2]]
        return df.select(
            "conv", depth.cast("long").alias("depth"), f[0].alias("f12"), g[0].alias("f3"), f[1].alias("g12"), g[1].alias("g3"),
            size.alias("bytes"), upto.alias("upto"), (depth == F.col("long")).alias("last"),
        )

    def less(a, b):
        return F.pmod(a - b, F.lit(PRIME))

    joined = products.join(spec.drop("base", "base_n", "n"), "conv").where(F.col("place") > F.col("head"))
    prints = [F.pmod(F.col(f"bs{j}") + less(F.col(f"s{j}"), F.col(f"os{j}")) * F.col(f"x{j}"), F.lit(PRIME)) for j in PARTS]
    joined = joined.withColumns({f"f{j}": x for j, x in enumerate(prints)})
    prints = [F.col(f"f{j}") for j in PARTS]
    before = [less(F.col(f"f{j}"), F.pmod(F.col(f"t{j}") * F.col(f"x{j}"), F.lit(PRIME))) for j in PARTS]
    own = rows(joined, F.col("place") - F.col("head") + F.col("k"), prints, before, F.col("bytes"), F.col("b_upto") + F.col("upto") - F.col("o_upto"))
    first = heads.withColumnRenamed("conv", "base").join(spec.select("conv", "base", "k", "long"), "base").where(F.col("place") <= F.col("k"))
    head = rows(first, F.col("place"), [F.col(s) for s in sums], [less(F.col(f"s{j}"), F.col(f"t{j}")) for j in PARTS], F.col("bytes"), F.col("upto"))
    root = rows(spec, zero, [zero] * 3, [zero] * 3, zero, zero)
    return own.union(head).union(root)


def _ends(rows: DataFrame) -> DataFrame:
    """NODE and ends_sha256 of `rows` (NODE, conv): the digest of a node's ids in order, joined by commas."""

    def packed(batches):
        node, first, ids, size = None, None, [], 0

        def row():
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (*node, first)), pa.array([",".join(ids)])], names=[*NODE, "first", "ids"])

        for b in batches:
            for *at, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if node is not None and (at != node or size > CHUNK):
                    yield row()
                    ids, size = [], 0
                if not ids:
                    node, first = at, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield row()

    def hashed(batches):
        node, digest, out = None, None, []
        for b in batches:
            for *at, ids in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if at == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = at, hashlib.sha256()
                digest.update(ids.encode())
            yield _table(out)
            out = []
        if node is not None:
            yield _table([(*node, digest.hexdigest())])

    def _table(out):
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:3]), pa.array(columns[3], pa.string())], names=[*NODE, "ends_sha256"])

    dealt = rows.select(*NODE, "conv").repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv")
    chunks = dealt.mapInArrow(packed, "depth long, f12 long, f3 long, first long, ids string")
    together = chunks.repartition(*(F.col(c) for c in NODE)).sortWithinPartitions(*NODE, "first").select(*NODE, "ids")
    return together.mapInArrow(hashed, "depth long, f12 long, f3 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, plan: DataFrame) -> DataFrame:
    """The nodes of the trie of the conversations that `plan` (conv_id, base_id, head) rebuilds from `turns` (conv_id, turn, role, text).

    A rebuilt conversation has the first `head` turns of base_id, then its own turns after its first `head`. One row per node: conv_id (least
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, as the module's text says.
    """
    lean_batches(turns.sparkSession, 10_000)
    empty = F.lit("")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).where("conv IS NOT NULL")
    wanted = plan.select(F.col("conv_id").cast("long").alias("conv"), F.col("base_id").cast("long").alias("base"), F.greatest(F.coalesce(F.col("head").cast("long"), F.lit(0)), F.lit(0)).alias("head")).where("conv IS NOT NULL")
    attempt, verified = 0, False
    while not verified:
        by = multipliers(attempt)
        products = written(running_products(rows, by, attempt), "products")
        members = written(_members(products, wanted, by), "members")
        nodes = members.groupBy(*NODE).agg(
            F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if("last").alias("n_ends"),
            F.min(F.col("upto") - F.col("bytes")).alias("before"),
            *(f(g).alias(f"{name}{g}") for g in ("g12", "g3") for name, f in (("", F.min), ("most_", F.max))),
        )
        nodes = written(nodes, "nodes")
        verified = nodes.where("g12 <> most_g12 OR g3 <> most_g3").isEmpty() and _distinct_turns(rows, attempt)
        attempt += 1
    held = written(members.join(nodes.select(*NODE, "conv_id", (F.col("n_ends") == F.col("n_convs")).alias("childless")), NODE), "held")
    least = F.col("conv_id") == F.col("conv")
    shared = held.groupBy("conv").agg(
        F.coalesce(F.max(F.when(~least, F.col("upto"))), F.lit(0)).cast("long").alias("u"),
        F.max((F.col("last") & least & F.col("childless")).cast("long")).alias("leaf"),
    )
    sums = held.join(shared, "conv").groupBy(*NODE).agg(F.sum("u").alias("shared"), F.max(F.when(least, F.col("u"))).alias("own"), F.sum("leaf").alias("n_leaves"))
    below = nodes.where("depth > 0")
    kids = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("g12").alias("f12"), F.col("g3").alias("f3")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f12").alias("g12"), F.col("f3").alias("g3"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, NODE).join(kids, NODE, "left").join(_ends(held.where("last")), NODE, "left").join(parents, ["depth", "g12", "g3"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("shared") - F.col("own") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
