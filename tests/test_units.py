"""Golden rows, null rules and properties that SQL on the tables does not reach."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dealweave.functions import matching as M
from dealweave.functions import text as T
from dealweave.operators import diff as H
from dealweave.operators import filters as B
from dealweave.operators import gates as D
from dealweave.operators import ingest as A
from dealweave.operators import match as C
from dealweave.operators import rank as G
from dealweave.operators import scores as E
from dealweave.operators import search as I
from dealweave.plans.base import offers
from dealweave.sources import plugins as L
from dealweave.streaming import incremental as J


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_keep_first_null_policies(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), (None, 4)], "url string, n int")
    kept, dropped = A.keep_first(df, "url", ["n"])
    assert rows(kept) == [("a", 1), (None, 3), (None, 4)] and dropped.first()[0] == 1
    kept, dropped = A.keep_first(df, "url", ["n"], "drop")
    assert rows(kept) == [("a", 1)] and dropped.first()[0] == 3


def test_split_valid_null_fails(spark):
    ok, bad = A.split_valid(spark.createDataFrame([("x", 1.0), (None, 1.0), ("y", None)], "name string, price double"), [("no_name", F.col("name").isNotNull()), ("bad_price", F.col("price") > 0)])
    assert rows(ok) == [("x", 1.0)] and rows(bad) == [("bad_price", 1), ("no_name", 1)]


def test_normalize_defaults(spark):
    df = spark.createDataFrame([(1.005, None, -3.0, None, None, "c", 0.0)], "price double, original_price double, savings double, unit string, brand_category string, category string, multi_buy_total double")
    r = A.normalize_offers(df).first()
    assert (r["original_price"], float(r["savings"]), r["unit"], r["category"], r["multi_buy_total"]) == (r["price"], 0.0, "st", "c", None)


def test_retry_days(spark):
    df = spark.createDataFrame([(n,) for n in range(1, 7)], "n long")
    assert [r[0] for r in df.select(A.retry_days(F.col("n"), F.lit(False))).collect()] == [30, 45, 90, 180, 30, 45]
    assert df.select(A.retry_days(F.col("n"), F.lit(True))).first()[0] == 3 and A.MISS_RETENTION_DAYS == 690


def test_replace_snapshot_writes_a_version(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "id int, p double")
    root = f"file://{tmp_path}"
    assert A.replace_snapshot(df, df.limit(0), ["id", "p"], root, "v1").first()["action"] == "replace"
    stored = spark.read.parquet(f"{root}/v1")
    assert A.replace_snapshot(df, stored, ["id", "p"], root, "v2").first()["action"] == "keep"
    assert A.replace_snapshot(df.limit(0), stored, ["id", "p"], root, "v3").first()["action"] == "stale"


def test_drop_stale_with_nothing_seen(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    kept, gone = A.drop_stale(df, df.limit(0), "id", F.lit(True), F.lit(False))
    assert kept.count() == 2 and gone.count() == 0


def test_jsonld_forms(spark):
    block = '<script type="application/ld+json">{}</script>'
    pages = [(1, block.format('{"@type":"Recipe","name":"a"}')), (2, block.format('[{"@type":"X"},{"@type":"Recipe","name":"b"}]')), (3, block.format("{oops") + block.format('{"@graph":[{"@type":["Y","Recipe"],"name":"c"}]}')), (4, "<p>none</p>"), (5, None)]
    got = A.extract_jsonld(spark.createDataFrame(pages, "page_id long, html string"), "Recipe", "struct<name:string>")
    assert rows(got.select("page_id", "found.name")) == [(1, "a"), (2, "b"), (3, "c")]


def test_durations_sizes_and_promotions(spark):
    d = spark.createDataFrame([("PT1H30M",), ("P1DT5M",), ("PT0M",), ("soon",), (None,)], "d string")
    assert [r[0] for r in d.select(A.iso_minutes(F.col("d"))).collect()] == [90, 1445, None, None, None]
    s = spark.createDataFrame([("ca 1,5 kg",), ("x/500g",), ("3 dl",), ("6 pack",), (None,)], "s string")
    assert [r[0] for r in s.select(A.package_grams(F.col("s"))).collect()] == [1500.0, 500.0, 300.0, None, None]
    p = spark.createDataFrame([("3 for 50", 20.0, 500), ("9,90 kr", 12.0, 100), (None, 1.0, 1)], "promo string, ordinary_price double, weight_grams int")
    assert [(r["deal_price"] and float(r["deal_price"]), r["deal_quantity"]) for r in A.price_promotions(p).collect()] == [(16.67, 3), (9.9, None), (None, None)]


def test_easter_and_midsummer(spark):
    y = spark.createDataFrame([(2000,), (2024,), (2025,), (2038,)], "y int")
    got = [tuple(r) for r in y.select(B.easter(F.col("y")), B.midsummer(F.col("y"))).collect()]
    assert got == [(dt.date(2000, 4, 23), dt.date(2000, 6, 24)), (dt.date(2024, 3, 31), dt.date(2024, 6, 22)), (dt.date(2025, 4, 20), dt.date(2025, 6, 21)), (dt.date(2038, 4, 25), dt.date(2038, 6, 26))]


def test_match_modes_on_nulls(spark):
    df = spark.createDataFrame([("Rödlök, lök",), (None,)], "t string")
    got = df.select(*(M.matches(F.col("t"), F.lit("lök"), m) for m in ("substring", "word", "start", "edge")), M.matches(F.col("t"), F.lit("rö"), "substring")).collect()
    assert [tuple(r) for r in got] == [(True, True, True, True, False), (False,) * 5]


def test_route_terms_equals_containment(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["ab", "abc", "cab", "bc a", "c"]) for _ in range(8))) for i in range(30)]
    terms = ["ab", "abc", "b c", "c ab", "ab c ca"]
    got = C.route_terms(spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(t, "keyword") for t in terms], "term string, kind string"), "id", "t")
    want = sorted((i, t) for i, x in texts for t in terms if (t in x.split() if len(t) <= 2 else t in x))
    assert rows(got) == sorted(want, key=repr)


def test_suggest_against_all_pairs(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(4, 7))) for _ in range(150)})
    known, unknown = words[::3], [w for w in words if len(w) >= 5]

    def near(a, b):
        return a != b and any(a[:i] + a[i + 1 :] == b or b[:i] + b[i + 1 :] == a or (len(a) == len(b) and a[:i] + a[i + 1 :] == b[:i] + b[i + 1 :]) for i in range(max(len(a), len(b))))

    want = []
    for w in set(unknown) - set(known):
        c = [k for k in known if near(w, k)]
        if len(c) == 1:
            want.append((w, c[0]))
    make = lambda xs: spark.createDataFrame([(x,) for x in xs], "word string")
    assert rows(C.suggest(make(unknown), make(known))) == sorted(want)


def test_validate_against_a_loop(spark):
    rng = random.Random(4)
    data = [(p, 1, n, rng.random() < 0.6, rng.random() < 0.7, rng.random() < 0.6) for p in range(60) for n in range(rng.randint(1, 5))]
    stages = [("a", F.col("a"), "retry"), ("b", F.col("b"), "void"), ("c", F.col("c"), "retry")]
    want = []
    for p in range(60):
        lines = [r for r in data if r[0] == p]
        at = 0
        for k, kind in ((3, "retry"), (4, "void"), (5, "retry")):
            if kind == "void":
                at = at if lines[at][k] else None
            else:
                at = next((i for i in range(at, len(lines)) if lines[i][k]), None)
            if at is None:
                break
        if at is not None:
            want.append((p, 1, at))
    df = spark.createDataFrame(data, "recipe_id long, offer_id long, line_no long, a boolean, b boolean, c boolean")
    assert rows(D.validate(df, stages)) == sorted(want, key=repr)


def test_allocate_equal_weights(spark):
    w = spark.createDataFrame([("p", "a", 1.0), ("p", "b", 1.0), ("p", "c", 1.0), ("p", "d", 0.0), ("q", "x", 0.0), ("q", "y", 0.0)], "profile string, category string, weight double")
    assert rows(G.allocate(w, 10)) == [("p", "a", 4), ("p", "b", 3), ("p", "c", 3), ("q", "x", 5), ("q", "y", 5)]


def test_apply_patch_rejects_foreign_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "recipe_id long, v string")
    with pytest.raises(ValueError, match="outside"):
        H.apply_patch(df, df, df.where("recipe_id = 1"), df.limit(0))


def test_change_classes(spark):
    cols = "offer_id long, version string, match_hash string, score_hash string, display_hash string"
    cur = spark.createDataFrame([(1, "v", "m", "s", "d"), (2, "v", "M", "S", "d"), (3, "v", "m", "S", "D"), (4, "v", "m", "s", "D"), (5, "v", "m", "s", "d"), (6, "v", "m", "s", "d"), (7, "w", "m", "s", "d")], cols)
    old = spark.createDataFrame([(k, "v", "m", "s", "d", k != 5) for k in (1, 2, 3, 4, 5, 7, 8)], cols + ", is_active boolean")
    assert rows(H.classify_offers(cur, old).select("offer_id", "change")) == [(1, "unchanged"), (2, "match_changed"), (3, "score_changed"), (4, "display_changed"), (5, "added"), (6, "added"), (7, "version_mismatch"), (8, "removed")]


def test_delta_equals_full(spark, sf_dir):
    from dealweave.plans.base import next_offers
    from dealweave.plans.match_queries import line_terms
    from dealweave.plans.serve_queries import _matches, j02

    full = _matches(line_terms(spark, sf_dir), next_offers(spark, sf_dir))
    diff = H.compare(full, j02(spark, sf_dir), "recipe_id", ["n_offers", "savings", "prices"]).where("status <> 'equal'")
    assert diff.count() == 0 and full.count() > 0


def test_boolean_search_precedence(spark):
    docs = spark.createDataFrame([(1, "beta gamma"), (2, "alpha"), (3, "beta"), (4, "beta gammas delta")], "id long, t string")
    index = I.token_index(docs, "id", {"t": "A"})
    assert [r[0] for r in rows(I.search(index, "id", "alpha OR beta gam*"))] == [1, 2, 4]
    assert [r[0] for r in rows(I.search(index, "id", "beta -delta"))] == [1, 3] and I.search(index, "id", "").count() == 0


def test_streamed_upsert_and_final_sync(spark, tmp_path):
    src, root = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for k, batch in enumerate([[(1, 1, "a"), (1, 2, "b")], [(2, 3, "c")], [(1, 4, "d"), (3, 5, "e")]]):
        spark.createDataFrame(batch, "k long, n long, v string").coalesce(1).write.mode("append").parquet(src)
        del k
    stream = J.file_stream(spark, src, "k long, n long, v string")
    out = J.stream_upsert(stream, root, "k", "n", f"file://{tmp_path}/log")
    assert rows(out.select("k", "v")) == [(1, "d"), (2, "c"), (3, "e")]
    compacted = J.stream_upsert(stream, f"{root}2", "k", "n", f"file://{tmp_path}/log2", compact_every=2)
    assert rows(compacted.select("k", "v")) == [(1, "d"), (2, "c"), (3, "e")]
    assert spark.read.parquet(f"{root}2/v=1").count() == 2 and spark.read.parquet(f"{root}2/v=2").count() == 2
    assert rows(J.final_sync(out, out.where("k < 3"), "k", F.lit(True)).select("k")) == [(1,), (2,)]


def test_retry_stream_equals_batch(spark, tmp_path, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type IN ('error', 'view', 'purchase')")
    batch = e.select("user_id", F.col("ts").alias("at"), (F.col("event_type") == "purchase").alias("ok"), (F.col("event_type") == "view").alias("temporary"), F.col("event_type").alias("reason"))
    path = f"file://{tmp_path}/events"
    batch.coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = J.run_to_memory(J.retry_state(J.file_stream(spark, path, batch.schema)), "retries", f"file://{tmp_path}/state")
    want = A.record_misses(spark.createDataFrame([], J.RETRY_SCHEMA), batch, ["user_id"])
    assert rows(out.where("retry_count > 0")) == rows(want)


def test_retry_stream_with_text_keys_over_batches(spark, tmp_path):
    src, schema = f"file://{tmp_path}/in", "url string, at timestamp, ok boolean, temporary boolean, reason string"
    day = lambda n: dt.datetime(2024, 1, n)
    for batch in ([("a", day(1), False, False, "404"), ("b", day(1), False, True, "503"), ("c", day(2), True, False, ""), ("c", day(2), False, False, "404")], [("a", day(2), False, False, "410"), ("b", day(3), True, False, "")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
    out = J.stream_retry_state(J.file_stream(spark, src, schema), f"file://{tmp_path}/out", "url", f"file://{tmp_path}/log")
    assert rows(out) == [("a", 2, "410", day(2) + dt.timedelta(days=45))]


def test_offer_keywords(spark):
    df = spark.createDataFrame([(1, "Acme rice", "ACME"), (2, "Acme", "ACME"), (3, None, None), (4, "mix", "x"), (5, "rye bread ryebread", None), (6, "cola", "Fizz")], "id int, name string, brand string")
    stop, syn = spark.createDataFrame([], "word string"), spark.createDataFrame([("rice", "reis")], "word string, canonical string")
    got = T.offer_keywords(
        df, "id", "name", stop, syn, "brand", spark.createDataFrame([("fizz", "drink")], "brand string, word string"), F.col("name") == "none",
        compounds=spark.createDataFrame([("rye", "ryebread"), ("bread", "ryebread"), ("cola", "colabox")], "part string, compound string"), generic=spark.createDataFrame([("mix",)], "word string"),
    )
    assert rows(got) == [(1, "reis", 0), (2, "acme", 0), (5, "ryebread", 2), (6, "cola", 1), (6, "drink", 0)]


def test_history_streaks_and_decisions(spark):
    ops = spark.createDataFrame([("a", i, i != 3) for i in range(1, 7)] + [("b", 1, False)], "dataset string, at long, ok boolean")
    assert rows(E.trailing_streak(ops, "dataset", ["at"], F.col("ok"))) == [("a", 3), ("b", 0)]
    m = spark.createDataFrame([("x", True, 0, 0.0, 0.0, 0.0), ("y", True, 1, 51.0, 0.0, 0.0), ("z", True, 1, 1.0, 15.0, 5.0), ("w", False, 1, 0.0, 0.0, 0.0)], "dataset string, ready boolean, changed int, changed_pct double, impacted_pct double, recipes_pct double")
    assert rows(J.decide(m)) == [("w", "full", "cache_not_ready"), ("x", "skip", "no_changes"), ("y", "full", "too_many_changed"), ("z", "delta", "small_change")]


def test_text_rules(spark):
    df = spark.createDataFrame([("2 dl milk or cream",), ("salt e.g. a, b",), (None,)], "t string")
    assert [r[0] for r in df.select(T.alternatives(F.col("t"))).collect()] == [["2 dl milk", "2 dl cream"], ["a", "b"], [None]]
    lines = spark.createDataFrame([(1, 1, "milk or"), (1, 2, "cream"), (1, 3, "or butter"), (1, 4, "salt")], "g int, n int, line string")
    assert rows(T.merge_lines(lines, "g", "n", "line")) == [(1, 1, "milk or cream or butter"), (1, 4, "salt")]


def test_plugins(spark, tmp_path, sf_dir):
    import pandas as pd

    pack = L.RulePack({"stop_words": spark.createDataFrame([("the",)], L.RULE_SCHEMAS["stop_words"])})
    pack.save(f"file://{tmp_path}/pack")
    loaded = L.RulePack.load(spark, f"file://{tmp_path}/pack", ["stop_words"])
    assert rows(loaded["stop_words"]) == [("the",)] and loaded.version().first() == pack.version().first()
    L.register_gate("long_name", _long_name(pd))
    assert L.apply_gate(offers(spark, sf_dir), "long_name", "name").where("long_name").count() > 0
    L.register_source(spark, "numbers", "i int, s string", 3, lambda p: iter([(p, "x"), (p, "y")]))
    assert spark.read.format("numbers").load().count() == 6


def _long_name(pd):
    @F.pandas_udf("boolean")
    def longer(s: pd.Series) -> pd.Series:
        return s.str.len() > 8

    return longer


def test_empty_tables(spark):
    none = spark.createDataFrame([], "recipe_id long, term string")
    terms = spark.createDataFrame([], "offer_id long, term string, kind string")
    assert C.candidates(none, terms).count() == 0 and C.manifest(terms, "offer_id").first()["rows"] == 0
    assert C.count_duplicate_pairs(spark.createDataFrame([], "id long, items array<string>"), "items").first()[0] == 0


def test_promotion_follows_long_chains(spark):
    """Six moves and more, by suffix and by containment; equal sets merge only what contains another."""
    chain = ["aaa" + "s" * i for i in range(7)]
    rows = [(k, g) for k in chain for g in (1, 2)] + [("bbb", 1), ("bbbs", 3)]
    found = {r["key"]: r["target"] for r in E.promote(spark.createDataFrame(rows, "key string, group long")).collect()}
    assert found == {k: chain[-1] for k in chain} | {"bbb": "bbb", "bbbs": "bbbs"}
    rows = [("ost", 1), ("getost", 1), ("getost", 2), ("xgetosty", 1), ("xgetosty", 2), ("kal", 3), ("kall", 4), ("vitkal", 3)]
    keys = spark.createDataFrame(rows, "key string, group long")
    contained = {r["key"]: r["target"] for r in E.promote_contained(keys).collect() if r["key"] != r["target"]}
    assert contained == {"ost": "xgetosty", "getost": "xgetosty", "kal": "vitkal"}
    blocked = spark.createDataFrame([("kal", "vitkal"), ("ost", "getost")], "short string, key string")
    contained = {r["key"]: r["target"] for r in E.promote_contained(keys, blocked=blocked).collect() if r["key"] != r["target"]}
    assert contained == {"ost": "xgetosty", "getost": "xgetosty"}
    sets = [("ost", 1, 5), ("ostar", 1, 2), ("mjölk", 1, 9), ("ris", 2, 1), ("rist", 2, 1)]
    merged = {r["key"]: r["target"] for r in E.merge_equal(spark.createDataFrame(sets, "key string, group long, n long")).collect()}
    assert merged == {"ost": "ost", "ostar": "ostar", "mjölk": "mjölk", "ris": "rist", "rist": "rist"}


def test_zero_weight_categories_are_not_shown(spark):
    """Neither by slots nor in the pool, but in a profile of which the pool has all slots."""
    items = spark.createDataFrame([(i, "ab"[i % 2], float(i), float(i)) for i in range(40)], "recipe_id long, category string, total_savings double, budget_score double")
    weights = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.0), (2, "a", 1.0), (2, "b", 0.0)], "profile long, category string, weight double")
    profiles = spark.createDataFrame([(1, 2), (2, 6)], "profile long, n_pool int")
    rows = G.balanced_topk(profiles, items, weights, 6).collect()
    assert {r["category"] for r in rows if r["profile"] == 1} == {"a"} and sum(r["profile"] == 1 for r in rows) == 6
    assert {r["category"] for r in rows if r["profile"] == 2} == {"a", "b"}


def test_repair_by_row(spark):
    """Repeated and null keys keep their own texts; repeated rules don't multiply rows."""
    rows = spark.createDataFrame([(1, "Alpha beta"), (1, "gamma delta"), (None, "beta x"), (2, None), (3, "")], "id long, t string")
    fixes = spark.createDataFrame([("beta", "BETA"), ("beta", "BETA"), ("delta", "D")], "wrong string, right string")
    assert sorted(r["t"] for r in T.repair(rows, "t", fixes).collect()) == ["", "", "BETA x", "alpha BETA", "gamma D"]


def test_interleave_places(spark):
    from pyspark.sql import functions as F

    rows = [(p, c, i) for p in (1, 2) for c, n in (("x", 3), ("y", 1), (None, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "p long, c string, i long")
    got = sorted((r["p"], r["place"], r["c"], r["turn"]) for r in G.interleave(df, "c", [F.col("i")], ["p"]).collect())
    one = [(1, None, 1), (2, "x", 1), (3, "y", 1), (4, None, 2), (5, "x", 2), (6, "x", 3)]
    assert got == [(p, place, c, t) for p in (1, 2) for place, c, t in one]
    assert sorted(r["place"] for r in G.interleave(df, "c", [F.col("p"), F.col("i")]).collect()) == list(range(1, 13))


def test_candidates_equal_pairwise_rule(spark):
    import random

    rng = random.Random(3)
    kinds = ["keyword", "parent_keyword", "name_word"]
    recipes = [(i, rng.choice("abcdef")) for i in range(12) for _ in range(3)]
    terms = [(i, rng.choice("abcdefgh"), rng.choice(kinds)) for i in range(15) for _ in range(2)] + [(99, "a", "name_word"), (100, "b", "keyword"), (101, "b", "keyword")]
    got = C.candidates(spark.createDataFrame(recipes, "recipe_id long, term string"), spark.createDataFrame(terms, "offer_id long, term string, kind string"))
    want = set()
    for r in {x[0] for x in recipes}:
        for o in {x[0] for x in terms}:
            shared = [(t, k) for i, t, k in terms if i == o and (r, t) in recipes]
            if any(k != "name_word" for _, k in shared):
                want.add((r, o, tuple(sorted({t for t, _ in shared}))))
    assert {(r.recipe_id, r.offer_id, tuple(r.terms)) for r in got.collect()} == want


def test_keyword_hits_by_class(spark):
    from dealweave.operators import gates as D

    pairs = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (2, 9), (3, 10)], "recipe_id long, offer_id long")
    lines = spark.createDataFrame([(1, 1, "red bolt"), (1, 2, "old red ring"), (2, 1, "gear"), (2, 2, "Red thing"), (3, 1, "red")], "recipe_id long, line_no long, line string")
    keywords = spark.createDataFrame([(7, "red bolt", 0), (8, "red bolt", 0), (8, "bolt", 1), (9, "gear", 2)], "offer_id long, keyword string, rank int")
    parents = spark.createDataFrame([(7, "red"), (8, "red"), (10, "red")], "offer_id long, parent string")
    want = [(1, 7, 1, "red bolt", 0), (1, 7, 2, "red", None), (1, 8, 1, "red bolt", 0), (1, 8, 2, "red", None), (2, 7, 2, "red", None), (2, 9, 1, "gear", 2), (3, 10, 1, "red", None)]
    assert sorted(map(tuple, D.keyword_hits(pairs, lines, keywords, parents).collect()), key=lambda r: r[:3]) == want


def test_path_parity_names_the_path_that_lacks_a_pair(spark):
    from dealweave.operators import quality as K

    df = lambda *r: spark.createDataFrame(list(r), "recipe_id long, offer_id long")
    found = K.path_parity({"a": df((1, 1), (1, 2)), "b": df((1, 1), (1, 1)), "c": df((1, 1), (1, 2), (3, 3))}, ["recipe_id", "offer_id"])
    assert sorted(map(tuple, found.collect())) == [(1, 2, "b"), (3, 3, "a,b")]


def test_parse_queries_of_a_key_in_several_rows(spark):
    rows = [(1, "Bolts, bolt bolts"), (1, "bolts, nut"), (1, "bolts, nut"), (2, "2 kg, nuts"), (3, None)]
    found = I.parse_queries(spark.createDataFrame(rows, "q int, t string"), "q", "t").collect()
    want = {(1, 0, "bolts", t) for t in ("bolts", "boltss", "boltses", "bolt")} | {(1, 1, "bolt bolts", t) for t in ("bolt", "boltes", "bolts", "boltss", "boltses")}
    want |= {(1, 1, "nut", t) for t in ("nut", "nuts", "nutes")} | {(2, 1, "nuts", t) for t in ("nuts", "nutss", "nutses", "nut")}
    assert sorted(tuple(r) for r in found) == sorted(want)
