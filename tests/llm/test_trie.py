"""The prefix trie of rebuilt conversations against a trie of real texts."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from dealweave.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, f12 string"


def brute_trie(rows, plan):
    """Rows of (conv_id, turn, role, text), plan of (conv, base, head): the contract's columns by materialised prefixes."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    rebuilt = {c: own.get(base, [])[:head] + own.get(c, [])[head:] for c, base, head in plan}
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in list(members.items())
    )


def as_rows(df):
    return sorted((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def contract_plan(rows):
    return [(c, c - c % 5, zlib.crc32(str(c).encode()) % 9) for c in sorted({r[0] for r in rows if r[0] is not None})]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    said = ["", "a", "hello there", "é" * 7, "日本", "x" * 3000, None, "b\nc"]
    out = []
    for c in [*range(0, 60), 1003, 10**15, -4]:
        if c % 11 != 5:  # some bases are absent
            out += [(c, rng.choice([None, i, i, i // 2]), rng.choice(["user", "assistant", None]), rng.choice(said)) for i in range(rng.choice([1, 2, 3, 5, 9, 14]))]
    out += [(70 + i, t, "user", f"same {t}") for i in range(12) for t in range(10)]  # copies
    out += [(90, t // 3, "user", str(t % 40)) for t in range(700)]  # long
    out += [(90, 5, "user", "again")] * 30  # repeated rows
    return out + [(None, 0, "user", "nobody's")]


def test_brute(spark, rows):
    plan = contract_plan(rows)
    turns = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(7)
    found = trie.prefix_trie(turns, spark.createDataFrame(plan, "conv_id long, base_id long, head long"))
    assert as_rows(found) == brute_trie(rows, plan)


def test_plan_without_turns(spark, rows):
    plan = [(5, 90, 12), (6, 90, 700), (7, 12345, 3), (8, None, None), (999, 90, 12), (998, 997, 2)]
    found = trie.prefix_trie(spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA), spark.createDataFrame([*plan, (None, 1, 1)], "conv_id long, base_id long, head long"))
    assert as_rows(found) == brute_trie(rows, [(c, b, h or 0) for c, b, h in plan])


def test_collisions_are_found(spark, rows, monkeypatch):
    plan, real, tried = contract_plan(rows), trie.turn_hashes, []

    def weak(role, text, attempt):
        tried.append(attempt)
        from pyspark.sql import functions as F

        if attempt == 0:  # texts of one length are one
            return [F.length(text).cast("long") + i for i in range(3)]
        return real(role, text, attempt)

    monkeypatch.setattr(trie, "turn_hashes", weak)
    monkeypatch.setattr(trie, "multipliers", lambda attempt, real=trie.multipliers: [1, 1, 1] if attempt == 1 else real(attempt))
    found = trie.prefix_trie(spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA), spark.createDataFrame(plan, "conv_id long, base_id long, head long"))
    assert as_rows(found) == brute_trie(rows, plan)
    assert max(tried) == 2  # a turn's collision in the first attempt, a swap of turns in the second


def test_pieces_compose(spark):
    """Products that cross the bounds of ranges, and digests of several chunks, in small pieces."""
    rows = [(1, t, "user", str(t)) for t in range(400)] + [(2, t, "user", str(t)) for t in range(399)] + [(c, 0, "user", "same") for c in range(1000, 3000)]
    plan = contract_plan(rows)
    trie_chunk, trie.CHUNK = trie.CHUNK, 50
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), spark.createDataFrame(plan, "conv_id long, base_id long, head long"))
        assert as_rows(found) == brute_trie(rows, plan)
    finally:
        trie.CHUNK = trie_chunk
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_empty(spark):
    found = trie.prefix_trie(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "conv_id long, base_id long, head long"))
    assert found.count() == 0


def test_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    found = queries.op13_prefix_trie(spark, sf_dir)
    want = brute_trie(rows, contract_plan(rows))
    assert as_rows(found) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    sql = con.execute(f"SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM ({queries.ORACLES['op13_prefix_trie']})").fetchall()
    assert sorted(sql) == want
