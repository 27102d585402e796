"""Joins by shared pieces against all pairs, and the plans and long words of what is built on them."""

import random

import pytest
from pyspark.sql import functions as F

from dealweave.operators import grams, ingest, match, scores, search

rng = random.Random(7)


def words(n, most=9, letters="abcé"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, most))) for _ in range(n)]


def column(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def nested_loops(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return "NestedLoop" in text or "CartesianProduct" in text


@pytest.mark.parametrize("least,sent", [(1, grams.SENT_LETTERS), (3, grams.SENT_LETTERS), (1, 0)])
def test_containing(spark, monkeypatch, least, sent):
    """Terms that are sent and terms that are shuffled give the same pairs."""
    monkeypatch.setattr(grams, "SENT_LETTERS", sent)
    a, b = [*words(400), "", None, "日本語テキスト", "x" * 3000, "a\U0001f600b"], [*words(300, 5), "", None, "語", "本語", "\U0001f600", "x" * 2999, "zzz"]
    found = grams.containing(column(spark, a, "value"), column(spark, b, "term"), least=least)
    assert sorted(map(tuple, found.collect())) == sorted({(x, y) for x in a for y in b if x and y and y in x and len(y) >= least})
    assert not nested_loops(found)
    assert grams.containing(column(spark, a, "value"), column(spark, [], "term")).count() == 0
    assert grams.containing(column(spark, [], "value"), column(spark, b, "term")).count() == 0


def same_places(a, b):
    return sum(x == y for x, y in zip(a, b, strict=False))


def test_alike(spark):
    a, b = [*words(2000, 12, "abc"), "", None, "q" * 400 + "r"], [*words(2000, 14, "abc"), "", None, "q" * 300 + "s" * 99]
    found = grams.alike(column(spark, a, "value"), column(spark, b, "term"))
    want = {(x, y) for x in set(a) for y in set(b) if x and y and min(len(x), len(y)) > 3 and same_places(x, y) >= 0.75 * min(len(x), len(y))}
    assert set(map(tuple, found.collect())) == want and found.count() == len(want)
    assert not nested_loops(found)


@pytest.mark.parametrize("fuzzy", [False, True])
def test_pantry(spark, fuzzy):
    items = [(k, w) for k in range(60) for w in words(rng.randint(1, 6), 6)] + [(99, None)]
    queries = [(q, w) for q in range(25) for w in words(3, 5)]
    rows = search.pantry_search(spark.createDataFrame(items, "recipe long, item string"), spark.createDataFrame(queries, "query_id long, term string"), "recipe", fuzzy=fuzzy)
    want = set()
    for q in range(25):
        terms = [t for n, t in queries if n == q]
        for k in range(60):
            own = sorted({w for n, w in items if n == k})
            hit = lambda w: any(w in t or t in w or fuzzy and min(len(w), len(t)) > 3 and same_places(w, t) >= 0.75 * min(len(w), len(t)) for t in terms)  # noqa: B023, E731
            lacking = [w for w in own if not hit(w)]
            matched = len(own) - len(lacking)
            if matched and matched >= 0.5 * len(own) and len(lacking) <= 3:
                want.add((q, k, matched, len(own), round(matched / len(own), 4), not lacking, ", ".join(lacking[:3])))
    assert set(map(tuple, rows.collect())) == want
    assert not nested_loops(rows)


def test_route_terms(spark):
    texts = [(i, " ".join(words(rng.randint(0, 12), 5, "abd")) if i else None) for i in range(80)] + [(5, "b d abd"), (200, "  a  b\tdab ")]
    terms = [(w, rng.choice(["keyword", "parent_keyword", "name_word"])) for w in {*words(40, 4, "abd")}] + [(f"{a} {b}", "keyword") for a, b in zip(words(15, 2, "abd"), words(15, 2, "abd"), strict=True)] + [("a b d", "keyword"), ("d ab", "parent_keyword")]
    found = match.route_terms(spark.createDataFrame(texts, "doc long, text string"), spark.createDataFrame(terms, "term string, kind string"), "doc", "text")
    want = set()
    for k, text in texts:
        ws = (text or "").lower().split()
        for t, kind in terms:
            if " " in t:
                ok = t in " ".join(ws)
            else:
                ok = t in ws if kind == "name_word" or len(t) <= 2 else any(t in w for w in ws)
            if ok:
                want.add((k, t))
    assert set(map(tuple, found.collect())) == want and found.count() == len(want)
    assert not nested_loops(found)


def test_categorize(spark):
    texts = [(i, w, v) for i, (w, v) in enumerate(zip(words(80, 6), words(80, 6), strict=True))] + [(500, None, "Abc"), (501, None, None)]
    rules = [(w.upper(), f"c{i % 4}", i % 5) for i, w in enumerate({*words(12, 3)})]
    found = ingest.categorize(spark.createDataFrame(texts, "k long, a string, b string"), spark.createDataFrame(rules, "keyword string, target string, priority int"), "k", ["a", "b"], "none")

    def first(text):
        hits = [(p, t) for w, t, p in rules if text and w.lower() in text.lower()]
        return min(hits)[1] if hits else None

    assert {(r["k"], r["target"]) for r in found.collect()} == {(k, first(a) or first(b) or "none") for k, a, b in texts}
    assert not nested_loops(found)


def test_long_words(spark):
    """Words of very many letters cost no more than their length."""
    long = "ab" * 200_000
    keys = [("ab", 1), ("abab", 1), (long, 1), ("abab" + "c" * 2000, 1), ("zz", 2)]
    found = {r["key"]: r["target"] for r in scores.promote_contained(spark.createDataFrame(keys, "key string, group int")).collect()}
    assert found["ab"] == found["abab"] == "abab" + "c" * 2000 and found["zz"] == "zz" and found[long] == long
    vocabulary, known = column(spark, [long, "helo", "hello", "worlds", "helloworld", "helloszzzz", "hellosworld", "wirld", "wor"], "word"), column(spark, ["hello", "world"], "word")
    assert {(r["word"], r["fix"]) for r in match.suggest(vocabulary, known, least=4).collect()} == {("helo", "hello"), ("worlds", "world"), ("wirld", "world")}
    assert {(r["word"], r["fix"]) for r in match.suggest(vocabulary, known, least=4, suffixes=["s"], compound=True).collect()} == {("helo", "hello"), ("wirld", "world")}
    assert {tuple(r) for r in match.compounds(vocabulary, known).collect()} == {("helloworld", "hello", "world"), ("hellosworld", "hello", "world")}


def test_compound_words_are_no_typos(spark):
    known = column(spark, ["apple", "pie", "appletie", "cart"], "word")
    vocabulary = column(spark, ["applepie", "appletie", "piescart", "appleties"], "word")
    found = lambda **more: {(r["word"], r["fix"]) for r in match.suggest(vocabulary, known, **more).collect()}
    assert found() == {("applepie", "appletie"), ("appleties", "appletie")}
    assert found(compound=True) == {("appleties", "appletie")} and found(suffixes=["s"]) == {("applepie", "appletie")}


def test_stars(spark):
    sources, starred = ["Alpha.x", "beta", "gam", None, ""], ["ALPHA", "gamma shop", "", None]
    found = match.star_join(column(spark, sources, "source"), column(spark, starred, "name"))
    assert {(r["source"], r["starred"]) for r in found.collect()} == {("Alpha.x", True), ("beta", False), ("gam", True), ("", False), (None, False)}
    assert not nested_loops(found) and found.where(F.col("starred")).count() == 2


def test_pantry_search_of_long_and_equal_lists(spark):
    names = [f"item{i:03}" for i in range(130)]
    items = [(r, x) for r, n in ((1, 60), (2, 61), (3, 130), (4, 60), (5, 2)) for x in names[:n]] + [(6, None)]
    pantries = {1: names[3:60], 2: names[:130], 3: names[:1] + names[2:61], 4: names[:127]}
    got = search.pantry_search(spark.createDataFrame(items, "recipe long, item string"), spark.createDataFrame([(q, t) for q, ts in pantries.items() for t in ts], "query_id long, term string"), "recipe").collect()
    want = []
    for r in (1, 2, 3, 4, 5):
        own = sorted(x for k, x in items if k == r)
        for q, ts in pantries.items():
            lacking = [x for x in own if x not in ts]
            n = len(own) - len(lacking)
            if n and n >= 0.5 * len(own) and len(lacking) <= 3:
                want.append((q, r, n, len(own), round(n / len(own), 4), not lacking, ", ".join(lacking[:3])))
    assert sorted(tuple(x) for x in got) == sorted(want)
