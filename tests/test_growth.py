"""Queries of matches make and shuffle rows in proportion to their lines, not to the pairs of lines and offers."""

import pytest
from pyspark.sql import functions as F

from dealweave.operators import match as C
from dealweave.plans.registry import QUERIES

MADE, SENT = "number of output rows", "shuffle records written"


def most(spark, name, sf_dir, metric):
    """The greatest value of a metric over all plans that a query runs, those of its stored steps included."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    found, runs = [0], store.executionsList()
    for i in range(before, runs.size()):
        key = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(key), store.planGraph(key).allNodes()
        for j in range(nodes.size()):
            metrics = nodes.apply(j).metrics()
            for m in (metrics.apply(k) for k in range(metrics.size())):
                if m.name() == metric and values.contains(m.accumulatorId()):
                    found.append(int(values.apply(m.accumulatorId()).split("\n")[-1].split(" ")[0].replace(",", "")))
    return max(found)


@pytest.mark.parametrize(
    ("name", "metric", "times"),
    [
        ("c08_offer_to_recipes", MADE, 2),  # F1
        ("c03_refresh_scope", SENT, 2),  # F2
        ("c04_line_hints", SENT, 2),  # F3
        ("d17_validate", MADE, 3),  # F4
        ("c09_enrich", MADE, 2),  # F6
        ("e14_unmatched_count", MADE, 2),  # F7
        ("k04_seven_stages", MADE, 8),  # F8
        ("e02_build_groups", MADE, 2),  # F10
        ("d16_select_winner", MADE, 2),  # F11
        ("d16_flavour_winner", MADE, 5),  # F12
        ("f08_uncapped_total", MADE, 2),  # F13
        ("g06_rank_offers", MADE, 2),  # F14
        ("k02_path_parity", SENT, 2),  # F15
        ("k04_explain_pairs", MADE, 2),  # F16
        ("l01_custom_gate", MADE, 2),  # F17
        ("d01_keyword_hits", MADE, 20),  # F22
    ],
)
def test_rows_follow_the_lines(spark, sf_dir, name, metric, times):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert most(spark, name, sf_dir, metric) <= times * lines


def test_texts_stay_where_they_are(spark, sf_dir):
    assert most(spark, "d02_block_false_hits", sf_dir, SENT) <= 10  # the rules alone are shuffled


def test_queries_are_shuffled_before_they_are_parsed(spark, sf_dir):  # F31, F32
    pantries = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    assert most(spark, "i15_parse_queries", sf_dir, SENT) <= pantries
    assert most(spark, "i19_query_coverage", sf_dir, SENT) <= pantries


@pytest.mark.parametrize("name", ["c08_recipes_with_any", "h07_plan_offer_delta", "h08_combine_plans", "j04_estimate_impact", "h07_by_index"])
def test_recipes_meet_terms_and_no_classes(spark, sf_dir, name):  # F33, F35, F36, F34, F29
    assert "class_id" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()


def reads(spark, name, sf_dir, table):
    """How often a query's plans, those of its stored steps included, read all rows of a table."""
    store, rows = spark._jsparkSession.sharedState().statusStore(), spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    before, found = store.executionsList().size(), 0
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    for i in range(before, runs.size()):
        key = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(key), store.planGraph(key).allNodes()
        for j in range(nodes.size()):
            if nodes.apply(j).name().startswith("Scan parquet"):
                metrics = nodes.apply(j).metrics()
                ids = [m.accumulatorId() for m in (metrics.apply(k) for k in range(metrics.size())) if m.name() == MADE and values.contains(m.accumulatorId())]
                found += any(int(values.apply(a).split("\n")[-1].split(" ")[0].replace(",", "")) == rows for a in ids)
    return found


@pytest.mark.parametrize(
    ("name", "table", "times"),
    [
        ("e03_contained", "documents", 2),  # F19
        ("c13_known_forms", "documents", 1),  # F30
        ("j02_apply_offer_delta", "lineitem", 18),  # F23
        ("j03_publish_reasons", "lineitem", 10),  # F24
        ("j02_published", "lineitem", 19),  # F25
        ("k02_path_parity", "lineitem", 2),  # F1 of round 4
        ("c04_routing_saved", "lineitem", 2),  # F6 of round 4
    ],
)
def test_tables_are_read_once(spark, sf_dir, name, table, times):
    assert reads(spark, name, sf_dir, table) <= times


def named(spark, key, n, names):
    """(key, term) of n rows, each of one of some names."""
    return spark.range(n).select(F.col("id").alias(key), F.concat(F.lit("name "), F.pmod(F.xxhash64("id"), F.lit(names)).cast("string")).alias("term"))


def matches(spark, n_recipes, n_offers, names):
    offer_terms = named(spark, "offer_id", n_offers, names).withColumn("kind", F.lit("keyword"))
    return C.candidates(named(spark, "recipe_id", n_recipes, names), offer_terms)


def test_a_class_is_put_out_by_many_tasks(spark):  # F9
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sizes = [r["count"] for r in matches(spark, 1000, 600, 1).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 1000 * 600 and max(sizes) <= sum(sizes) / 2


def test_matches_pack_well_in_files(spark, tmp_path):  # F9
    matches(spark, 20_000, 20_000, 64).write.parquet(str(tmp_path / "out"))
    n = spark.read.parquet(str(tmp_path / "out")).count()
    assert n > 6_000_000 and sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < n / 2


def test_members_without_a_key_are_put_in(spark):
    rows = spark.createDataFrame([(1, "a", ["x"]), (None, "a", ["y"]), (3, "b", None), (4, "z", [])], "recipe_id long, class_id string, terms array<string>")
    members = spark.createDataFrame([(10, "a"), (None, "a"), (11, "b"), (12, "c")], "offer_id long, class_id string")
    got = C.with_members(rows, members).select("recipe_id", "offer_id", "terms").collect()
    want = rows.join(members, "class_id").select("recipe_id", "offer_id", "terms").collect()
    assert len(want) == 5 and sorted(map(repr, got)) == sorted(map(repr, want))


def test_lines_without_a_text_are_scanned(spark):
    lines = spark.createDataFrame([(1, 0), (1, None), (2, 1), (2, 0), (3, 0), (3, None), (4, 2)], "recipe_id long, text_id long")
    found = spark.createDataFrame([(0, "a", True), (1, "a", False), (1, "b", False)], "text_id long, class_id string, strong boolean")
    members = spark.createDataFrame([(10, "a"), (11, "a"), (12, "b")], "offer_id long, class_id string")
    # recipes 1 to 3 have both offers of a; each has two lines, of which 1, 2 and 1 are hinted
    assert C.routing_saved_by_text(lines, found, members).collect() == [(6, 12, 8, 33.33)]


def test_long_texts_are_put_out_by_many_tasks(spark, sf_dir, monkeypatch):  # F5 of round 4
    monkeypatch.setattr(C, "TEXT_BYTES", 4096, raising=False)
    sizes = [r[1] for r in QUERIES["c08_offer_to_recipes"](spark, sf_dir).groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("recipe_ids"))).collect()]
    assert sum(sizes) > 16 * 4096 and max(sizes) <= 8 * 4096


def test_members_have_their_classes_texts(spark):
    texts = spark.createDataFrame([("a", "x" * 50_000), ("b", ""), ("c", "y")], "class_id string, t string")
    members = spark.createDataFrame([(i, "a") for i in range(3000)] + [(-1, "b"), (None, "c"), (-2, "d")], "offer_id long, class_id string")
    got = C.with_texts(texts, members, "t")
    assert got.columns == ["offer_id", "t"]
    assert sorted(map(repr, got.select("offer_id", F.length("t")).collect())) == sorted(map(repr, members.join(texts, "class_id").select("offer_id", F.length("t")).collect()))


def test_tasks_that_put_members_in_go_by_the_cores(spark):  # F2 to F4 of round 4
    rows = spark.range(2000).selectExpr("id AS recipe_id", "concat('c', id % 40) AS class_id")
    members = spark.range(400).selectExpr("id AS offer_id", "concat('c', id % 40) AS class_id")
    sizes = [r["count"] for r in C.with_members(rows, members).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2000 * 10 and len(sizes) > 40
