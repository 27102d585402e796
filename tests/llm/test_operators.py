"""Each operator against a brute-force version on small fixtures, with the odd cases its docstring defines."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dealweave.llm import chat, embed, html, mixing, pii, piece, quality, queries, simhash, substring, wavelet
from dealweave.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, copies string, fp string, shard string"
rng = random.Random(5)
VOCAB = ["the", "of", "and", *("".join(rng.choice("abcdeéort") for _ in range(rng.randint(2, 7))) for _ in range(150))]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = [prose(rng.randint(1, 90)) for _ in range(40)]
    shared = prose(30)
    base += [prose(15) + " " + shared + " " + prose(15) for _ in range(5)]
    base += [base[3], base[3], base[5] + " x", None, "", " \n\t ", "A b", "x" * 30_000, "word " * 4_000, "##### %%% |||| " * 20, prose(3000)]
    base += ["call +1 (988) 555-2485", "日本語 テキスト 漢字 😀", "one\nline\nline\none"]
    return base


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None, "xx"][i % 4], [None, "s1", "s2"][i % 3], None, "k", "z", None, "f", "h") for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, "no id here at all", "en", "s1", 1, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_components(spark):
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            parent[root(u)] = root(v)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert set(found) == nodes
    groups = lambda f: sorted(sorted(x for x in nodes if f(x) == g) for g in {f(x) for x in nodes})
    assert groups(root) == groups(found.get)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_quality_counts(docs, empty):
    rows = quality.judge(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r["text"] or ""
        w = words_of(text)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n, covered = Counter(windows), set()
        for i, x in enumerate(windows):
            if n[x] > 1:
                covered |= set(range(i, i + 5))
        lines = [x for x in text.split("\n") if words_of(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and {r["kept"] for r in good.collect()} <= {"k", None}
    assert quality.keep_good(empty).count() == 0


def test_quality_distance(spark):
    df = spark.createDataFrame([([1, 3, 0], [0.5, 0.25, 0.25])], "c array<long>, q array<double>")
    p, q = np.array([0.25, 0.75, 0]), np.array([0.5, 0.25, 0.25])
    m = (p + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    assert df.select(quality.js_distance(F.col("c"), F.col("q"))).first()[0] == pytest.approx(np.sqrt((kl(p) + kl(q)) / 2))


def test_quality_keeps_clean_and_drops_junk(spark):
    d = "/root/testdata/sf0.01"
    kept = queries.op5_quality_rules(spark, d).select("doc_id", "kept", "base_failed").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    clean = [r["kept"] for r in kept if r["quality"] == 1 and not r["base_failed"]]
    assert np.mean(clean) > 0.99


def fingerprint(text):
    import xxhash

    w = words_of(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, empty, texts):
    rows = simhash.components(docs).collect()
    assert len(rows) == docs.count()
    fps = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in rows}
    assert all(fps[i] == fingerprint(t) for i, t in enumerate(texts))
    ids = [i for i in fps if i is not None]
    comp = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and comp[b] is not None and (comp[a] is None or comp[b] < comp[a]):
                    comp[a] = comp[b]
                    changed = True
    assert all(r["component_id"] == comp[r["doc_id"]] for r in rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(got, key=str) == sorted({c for c in comp.values() if c is not None} | ({None} if comp[None] is None else set()), key=str)
    assert simhash.keep_one(empty).count() == 0


def test_simhash_tally(spark):
    """Pairs meet once, six or 21 times by their shared bytes, and only from six meetings on they are kept."""
    a = 0x0102030405060708
    fps = {a: None, a ^ 1: 21, a ^ 1 << 8 ^ 2: 6, a ^ 1 << 8 ^ 1 << 16 ^ 4: 1, a ^ 0x7F7F7F7F << 16: None, a ^ 0x7F << 24: 21}
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    lists = simhash.postings(table).groupBy("slot").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    met = {frozenset((r["u"], r["v"])): r["meetings"] for r in simhash.tallied(lists).collect()}
    assert {x: met.get(frozenset((a, x))) for x in fps if x != a} == {x: n for x, n in fps.items() if x != a}
    want = {frozenset((x, y)) for x in fps for y in fps if x != y and (x ^ y).bit_count() <= 2}
    assert {frozenset((r["u"], r["v"])) for r in simhash.links(table).collect()} == want


def test_simhash_dense_group(spark, monkeypatch):
    base = rng.getrandbits(63)
    near = {base} | {base ^ 1 << rng.randint(0, 15) ^ 1 << rng.randint(0, 15) for _ in range(90)}
    near = {x - (1 << 64) if x >= 1 << 63 else x for x in near}
    monkeypatch.setattr(simhash, "PAIR_LIMIT", 8)
    roots = connected_components(simhash.links(spark.createDataFrame([(x,) for x in near], "fp long"))).collect()
    assert {r["node"] for r in roots} == near and len({r["root"] for r in roots}) == 1


def test_pii_formats(spark):
    cases = ["+1 (988) 555-2485", "4041894974608795", "4041 8949 7460 8795", "bosbt.42@mail8.example.com", "42.144.35.254", "1984-02-29", "31/12/1999", "DE89 3704 0044 0532 0130 00", "123-45-6789", 'token = "0641917ea4e9feb9cda83477"']
    df = spark.createDataFrame([(i, f"see {c} here, and {c}.", "x") for i, c in enumerate(cases)], "doc_id long, text string, n_found string")
    out = {r["row"]["doc_id"]: r for r in pii.pseudonymise(df, "k").collect()}
    luhn = lambda s: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(re.sub(r"\D", "", s)))) % 10
    for i, c in enumerate(cases):
        text = out[i]["row"]["text"]
        assert c not in text and out[i]["n_found"] == 2 and out[i]["row"]["n_found"] == "x"
        a, b = re.fullmatch(r"see (.*) here, and (.*)\.", text).groups()
        assert a == b  # equal values stay linked
        if "@" not in c and "." not in c:
            assert re.sub(r"\d", "9", re.sub("[a-z]", "x", a))[:4] == re.sub(r"\d", "9", re.sub("[a-z]", "x", c))[:4]
    assert luhn(out[1]["row"]["text"].split()[1]) == 0
    same = spark.createDataFrame([(1, "version 1.2.3, 1.2.3.4-beta, 000-12-3456, 123-45-0000, 300.1.1.1, 2001-02-30, 4041894974608796, 12345 7-8"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["row"]["doc_id"]: (r["row"]["text"], r["n_found"]) for r in pii.pseudonymise(same, "k").collect()}
    assert got == {r["doc_id"]: (r["text"], 0) for r in same.collect()}


def test_pii_is_a_permutation(spark):
    rows = spark.range(17 * 23).select("id", pii.feistel_number(F.col("id"), 17, 23, "k", "t").alias("n"), pii.feistel_text(F.format_string("%03d", "id"), "k", "t").alias("s")).collect()
    assert sorted(r["n"] for r in rows) == list(range(17 * 23))
    assert len({r["s"] for r in rows}) == len(rows)


def shifted(key, label, number, value):
    return int(hashlib.sha256(f"{key}:{label}:{number}:{value}".encode()).hexdigest()[:15], 16)


def brute_number(value, a, b, key, label):
    high, low = divmod(value, b)
    for r in range(pii.ROUNDS):
        if r % 2 == 0:
            high = (high + shifted(key, label, r, low)) % a
        else:
            low = (low + shifted(key, label, r, high)) % b
    return high * b + low


def brute_text(value, key, label):
    half = (len(value) + 1) // 2
    parts = [value[:half], value[half:]]
    for r in range(pii.ROUNDS):
        mine, other = parts[r % 2], parts[1 - r % 2]
        stream, out = hashlib.sha512(f"{key}:{label}:{r}:{other}".encode()).hexdigest(), ""
        for i, c in enumerate(mine):
            block = stream if i < 60 else hashlib.sha512(f"{stream}:{i // 60}".encode()).hexdigest()
            by = int(block[i % 60 * 2 : i % 60 * 2 + 4], 16)
            for alphabet in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
                if c in alphabet:
                    c = alphabet[(alphabet.index(c) + by) % len(alphabet)]
                    break
            out += c
        parts[r % 2] = out
    return "".join(parts)


def test_pii_by_another_feistel(spark, empty):
    """Whole documents against a network written on its own, a very long one among them; an empty table stays empty."""
    from datetime import date, timedelta

    names = [f"ann.b{i}x" for i in range(6)] + ["Z" * 64]
    tails = [f"{i:03d}-{i + 10}-{4000 + i}" for i in range(1, 7)] + ["899-99-9999"]
    days = [date(1950, 1, 1) + timedelta(997 * i) for i in range(7)]
    rows, want = [], {}
    for i, (n, s, d) in enumerate(zip(names, tails, days, strict=True)):
        pad = "no data " * (200_000 if i == 3 else 2)
        rows.append((i, f"{pad}{n}@x.example.com and {s}, {d} or 10.0.{i}.7 {pad}"))
        day = date(1900, 1, 1) + timedelta(brute_number((d - date(1900, 1, 1)).days, pii.DAYS_A, pii.DAYS_B, "k", "date"))
        ip = brute_number((10 << 24) + (i << 8) + 7, 1 << 16, 1 << 16, "k", "ip")
        address = ".".join(str(ip >> x & 255) for x in (24, 16, 8, 0))
        want[i] = f"{pad}{brute_text(n, 'k', 'email')}@x.example.com and {brute_text(s, 'k', 'ssn')}, {day} or {address} {pad}"
    found = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    assert {r["row"]["doc_id"]: r["row"]["text"] for r in found} == want and {r["n_found"] for r in found} == {4}
    assert pii.pseudonymise(empty, "k").count() == 0


def water_fill(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if most * sizes[s] < level * weight[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def test_mixing(docs, empty):
    rows, again = mixing.report(docs).collect(), mixing.report(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == docs.count()
    sources = {(r["doc_id"], r["text"]): r["source"] for r in docs.collect()}
    by_id = {i: s for (i, _), s in sources.items()}
    sizes, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in rows:
        s = by_id[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    goal = water_fill(sizes)
    assert all(target[s] == pytest.approx(goal[s]) and abs(taken[s] - target[s]) <= 2 * largest[s] for s in sizes)
    mixed = mixing.mix(docs)
    assert mixed.agg(F.sum(F.size(F.filter(F.split("row.text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")))).first()[0] == sum(taken.values())
    assert mixed.select("row.*").columns == docs.columns
    assert mixing.report(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_splitting_tree(spark):
    quotas = [("a", "b_last", 100), ("b", "b_last", 7), ("c", "b_last", 0), ("d", "a_whole", 33), ("d", "c_left", 50)]
    table = spark.createDataFrame(quotas, "m_source string, kind string, quota long")
    for shards in (8, 5, 1):
        total, per_shard = Counter(), Counter()
        for r in mixing.split_quotas(table, shards).collect():
            total[r["m_source"], r["kind"]] += r["quota"]
            per_shard[r["shard"]] += r["quota"] * (r["kind"] != "c_left")
            assert r["quota"] >= 0
        assert total == Counter({(s, k): n for s, k, n in quotas})
        assert len(per_shard) == shards and max(per_shard.values()) - min(per_shard.values()) <= 3


@pytest.mark.parametrize("good,bad,want", [(3, 4, 5), (9, 1, 4), (40, 60, 30), (5, 200, 50), (1, 1, 1), (700, 300, 500)])
def test_hypergeometric_law(good, bad, want):
    """Draws against exact odds from binomials, by their chi-square."""
    r, n = np.random.default_rng(2), 20_000
    got = Counter(mixing._hypergeometric(r, good, bad, want) for _ in range(n))
    expected = {k: n * math.comb(good, k) * math.comb(bad, want - k) / math.comb(good + bad, want) for k in range(max(0, want - bad), min(good, want) + 1)}
    assert set(got) <= set(expected)
    often = [k for k, e in expected.items() if e >= 5]
    chi = sum((got[k] - expected[k]) ** 2 / expected[k] for k in often)
    assert chi < len(often) + 5 * (2 * len(often)) ** 0.5 + 5


def test_hypergeometric_any_count():
    """Sure draws, and mean and spread of counts beyond any sampler's limit."""
    r = np.random.default_rng(1)
    assert [mixing._hypergeometric(r, *x) for x in ((0, 5, 3), (5, 0, 3), (4, 4, 0), (4, 4, 8))] == [0, 3, 0, 4]
    for good, bad, want in ((10**10, 10**10, 10**10), (3 * 10**9, 7 * 10**10, 10**10)):
        n = good + bad
        mean, spread = want * good / n, (want * (good / n) * (bad / n) * ((n - want) / n)) ** 0.5
        z = (np.array([mixing._hypergeometric(r, good, bad, want) for _ in range(60)]) - mean) / spread
        assert abs(z.mean()) < 0.7 and 0.6 < z.std() < 1.5
    assert 0.49e12 < mixing._hypergeometric(r, 10**12, 10**12, 10**12) < 0.51e12


def test_rows_without_id_are_dealt_by_text(spark):
    rows = [(None, f"w{i} " * 5, "a") for i in range(60)]
    sized = mixing.sized(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sized.select("m_block").distinct().count() > 40


def test_the_tree_decides(spark):
    """Another seed of the tree alone takes other documents, and both meet the targets; shards hold what is reported."""
    rows = [(i, "w " * (5 + i % 40), "abc"[i % 7 % 3], i) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard long")
    found = [{r["doc_id"]: r for r in mixing.report(df, shards=4, tree_seed=s).collect()} for s in (1, 2)]
    assert {i for i, r in found[0].items() if r["taken"]} != {i for i, r in found[1].items() if r["taken"]}
    for by_id in found:
        taken, target = Counter(), {}
        for i, _, source, _ in rows:
            taken[source] += by_id[i]["taken"]
            target[source] = by_id[i]["target"]
        assert all(abs(taken[s] - target[s]) <= 45 for s in target)
    mixed = mixing.mix(df, shards=4)
    parts = {r["shard"]: r for r in mixed.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("row.source").alias("s")).collect()}
    sizes = [r["n"] for r in parts.values()]
    assert set(parts) == {0, 1, 2, 3} and max(sizes) < 1.3 * min(sizes) and {r["s"] for r in parts.values()} == {3}
    drawn = Counter(r[0] for r in mixed.select("row.doc_id").collect())
    assert all(found[0][i]["taken"] == found[0][i]["size"] * drawn[i] for i, *_ in rows)
    files = mixed.select(F.input_file_name().alias("f"), "place").collect()
    order = {}
    for r in files:
        order.setdefault(r["f"], []).append(r["place"])
    assert all(x == sorted(x) for x in order.values())


def test_piece_equals_library():
    import sentencepiece

    path = queries.piece_model_path()
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), piece.model(path)
    cases = ["", " ", "  a  ", "▁x ▁▁", "\n\n a\n b", "日本語 漢字 😀", "<s> </s> <0x41>", "a\x00b", "th" * 40, "9" * 57, "\tdef f(x):\n        return", "".join(rng.choice("abcdeinortth") for _ in range(5000))]
    cases += ["".join(rng.choice("abcdeth inor▁  \nééß漢9.,-_½²") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for c in cases:
        ids = sp.encode(c)
        assert m.encode(c) == ids and m.decode(ids) == sp.decode(ids)


def test_piece_digests(docs, empty, texts):
    import sentencepiece

    path = queries.piece_model_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = {r["doc_id"]: r for r in piece.digests(docs, path).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"], rows[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    assert piece.digests(empty, path).count() == 0
    assert piece.encode(docs.where("doc_id = 3"), path).first()["ids"] == sp.encode(texts[3])


def test_wavelet_matrix():
    ids = np.array([rng.randint(0, 900) for _ in range(5000)] + [7] * 50, np.uint16)
    matrix, docs, lengths = wavelet.unpack_shard(wavelet.pack_shard(ids, [4, None], [5000, 50], 10))
    assert (matrix.decode() == ids).all() and docs == [4, None] and lengths.tolist() == [5000, 50]
    at = np.array([0, 63, 64, 65, 4999, 5049])
    assert (matrix.access(at) == ids[at]).all()
    for s in (7, 0, 899, 901):
        places = np.flatnonzero(ids == s)
        assert matrix.count(s) == len(places) and matrix.rank(s, 2500) == (places < 2500).sum()
        assert [matrix.select(s, k) for k in range(len(places))][:40] == places.tolist()[:40] and matrix.select(s, len(places)) == -1
    assert wavelet.WaveletMatrix.build(np.empty(0, np.uint16), 10).count(3) == 0


def test_wavelet_blocks(monkeypatch):
    """Ranks come from the stored directory, and only the blocks that are asked for are opened."""
    monkeypatch.setattr(wavelet, "BLOCK", 256)
    r = np.random.default_rng(1)
    ids = np.concatenate([r.integers(0, 50, 3000), np.full(700, 9), r.integers(0, 600, 2001)]).astype(np.uint16)
    matrix = wavelet.unpack_shard(wavelet.pack_shard(ids, [1], [len(ids)], 10))[0]
    assert (matrix.access(np.array([4000])) == ids[4000]).all()
    assert all(len(p.opened) == 1 and len(p.blocks) == 23 for p in matrix.planes)
    assert (matrix.access(np.arange(len(ids))) == ids).all() and (matrix.decode() == ids).all()
    for s in (9, 0, 599, 1000):
        places = np.flatnonzero(ids == s).tolist()
        assert [matrix.select(s, k) for k in range(len(places))] == places and matrix.select(s, len(places)) == -1
        assert all(matrix.rank(s, e) == (ids[:e] == s).sum() for e in (0, 255, 256, 257, 3000, len(ids)))


def test_wavelet_documents(docs, empty, texts):
    from tokenizers import Tokenizer

    path = queries.word_tokenizer_path()
    t = Tokenizer.from_file(path)
    rows = wavelet.documents(wavelet.write_shards(docs, path, shard_tokens=700)).collect()
    pairs = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    got, start = sorted(rows, key=lambda r: r["start"]), 0
    assert [r["doc_id"] for r in got] == [i for i, _ in pairs]
    for r, (_, text) in zip(got, pairs, strict=True):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert wavelet.documents(wavelet.write_shards(empty, path)).count() == 0


def test_word_encoder_on_odd_texts(monkeypatch):
    from tokenizers import Tokenizer

    path = queries.word_tokenizer_path()
    t, e = Tokenizer.from_file(path), wavelet.WordEncoder(path)
    cases = ["It's THE ÉTÉ, don't!", "ΣΑΣ İ", "áb é", "<|endoftext|> x", "x<|endoftext|>y", "'s's 'll", "\x1c a\x85b", "½²³ ª º", "x1y22", "漢字 😀"]
    cases += ["".join(rng.choice("abDE'stre 19.,!\n\té%") for _ in range(50)) for _ in range(300)]
    want = [t.encode(c, add_special_tokens=False).ids for c in cases]

    def encoded(texts):
        ids, lengths = e.encode(pa.array(texts, pa.string()))
        return [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]

    assert encoded(cases) == want and encoded(cases[:1]) == want[:1] and encoded(cases[3:4]) == want[3:4]
    monkeypatch.setattr(wavelet, "PIECE_MEMORY", 40)
    assert encoded(cases) == want and [encoded([c])[0] for c in cases[-20:]] == want[-20:]
    monkeypatch.setattr(wavelet, "BYTE_MEMORY", 10)
    assert encoded(cases) == want


def removed(items):
    seen, out = set(), {}
    for i, t in items:
        w = (t or "").encode().split()
        cover = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                cover[s : s + 20] = [True] * 20
            seen.add(k)
        out[i] = (len(w), sum(cover), b" ".join(x for x, c in zip(w, cover, strict=True) if not c))
    return out


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_substring(spark, docs, texts, batches):
    want = removed(enumerate(texts))
    once, index = docs.dropDuplicates(["doc_id"]), substring.FingerprintIndex(spark, compact_at=3)
    rows = substring.dedup(once, batches=batches, index=index).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], bytes(r["kept"])) for r in rows}
    assert {i: got[i] for i in want} == want
    assert got[None][1] == 0 and (index.compactions > 0) == (batches > 2)
    index.close()


def test_substring_index_is_kept(spark, docs, texts):
    """A later session opens the index by its manifest and adds a batch; the registered query compacts."""
    once = docs.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL")
    name = substring.pack(once)
    packed, index = spark.table(name), substring.FingerprintIndex(spark)
    half = len(texts) // 2
    first = substring.repeated_windows(index, packed.where(F.col("key") < half), packed.where(F.col("key") < half), 8)
    index.close()
    later = substring.FingerprintIndex.open(spark, index.folder)
    second = substring.repeated_windows(later, packed.where(F.col("key") >= half), packed, 8)
    found = {r["key"]: set(r["starts"]) for r in first.union(second).collect()}
    seen, want = set(), {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        for s in range(len(w) - 19):
            if tuple(w[s : s + 20]) in seen:
                want.setdefault(i, set()).add(s)
            seen.add(tuple(w[s : s + 20]))
    assert found == want and later.compactions == 1 and len(later.runs) == 1
    assert substring.FingerprintIndex.open(spark, index.folder).version == later.version


def test_substring_meets_a_compacted_run(docs, texts, monkeypatch):
    """The query's last batch is joined with the run that the first two were compacted into, and nothing is compacted in vain."""
    joined, compacted, look, compact = [], [], substring.FingerprintIndex.candidates, substring.FingerprintIndex.compact
    monkeypatch.setattr(substring.FingerprintIndex, "candidates", lambda self, new: joined.append((self.compactions, len(self.runs))) or look(self, new))
    monkeypatch.setattr(substring.FingerprintIndex, "compact", lambda self: compacted.append(len(self.runs)) or compact(self))
    rows = substring.dedup(docs.dropDuplicates(["doc_id"])).collect()
    assert joined == [(0, 1), (0, 2), (1, 2)] and compacted == [2]
    want = removed(enumerate(texts))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], bytes(r["kept"])) for r in rows}
    assert {i: got[i] for i in want} == want


def test_substring_odd_tables(docs, empty):
    assert substring.dedup(empty).count() == 0
    rows = substring.dedup(docs).collect()
    assert len(rows) == docs.count()


def test_embeddings(spark):
    r = np.random.default_rng(3)
    x = [v.tolist() for v in r.standard_normal((300, 16))]
    centre = r.standard_normal(16)
    x += [(centre + 0.08 * r.standard_normal(16)).tolist() for _ in range(120)]
    x += [x[0], x[0], [2 * v for v in x[1]], None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0], []]
    df = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(x)] + [(None, x[5], "c")], "vec_id long, embedding array<double>, node string")
    rows = embed.near_duplicates(df).collect()
    assert len(rows) == len(x) + 1
    ok = [i for i, v in enumerate(x) if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    unit = np.array([x[i] for i in ok])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    links = dict.fromkeys(range(len(x)), 0) | {i: int(near[k].sum()) - 1 for k, i in enumerate(ok)}
    links[5] += 1  # the row without id
    comp = {i: i for i in range(len(x))}
    for _ in range(30):
        for k, i in enumerate(ok):
            comp[i] = min(comp[ok[j]] for j in np.flatnonzero(near[k]))
    for r in rows:
        if r["vec_id"] is None:
            assert r["component_id"] == 5 and not r["kept"]
        else:
            i = r["vec_id"]
            assert (r["n_links"], r["component_id"], r["kept"]) == (links[i], comp[i], comp[i] == i)
    assert embed.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_repeated_ids(spark):
    """Rows are rows, whatever their ids: different vectors under one id are nodes of their own."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [-1.0, 0.0])]
    found = embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"], r["audited_recall"]) for r in found)
    assert got == [(1, 1, 1, True, 1.0), (1, 1, 1, True, 1.0), (2, 1, 1, False, 1.0), (3, 1, 1, False, 1.0), (4, 0, 4, True, 1.0)]


def test_embeddings_join_dense_subgroups(spark):
    """Two groups of which every list is full of its own, with links from each to all of the other."""
    r = np.random.default_rng(8)
    x = np.zeros((80, 16))
    x[:, 0], x[40:, 1] = 1.0, 0.255
    x += 0.005 * r.standard_normal(x.shape)
    x /= np.linalg.norm(x, axis=1)[:, None]
    sims = x @ x.T
    assert sims[:40, :40].min() > 0.998 and sims[:40, 40:].min() > 0.95 and sims[:40, 40:].max() < 0.98
    df = spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert {(r["n_links"], r["component_id"]) for r in embed.near_duplicates(df).collect()} == {(79, 1)}


def test_embeddings_ties():
    r = np.random.default_rng(2)
    x = r.standard_normal((60, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    sims = x @ x.T
    np.fill_diagonal(sims, -2)

    def parts(pairs):
        name = list(range(60))
        for _ in range(60):
            for a, b in pairs:
                name[a] = name[b] = min(name[a], name[b])
        return name

    ties = list(zip(*embed._forest(sims), strict=True))
    assert len(ties) < 60 and parts(ties) == parts(np.argwhere(sims >= 0.95).tolist())


def test_embeddings_recall_of_each_vector(spark):
    """One large group that is whole doesn't hide that every pair is missed."""
    truth = spark.createDataFrame([(i, 0, 1.0, 4_999) for i in range(100)] + [(i, 0, 1.0, 1) for i in range(100, 150)], embed._LINKS.replace("tie boolean", "links long"))
    counted = spark.createDataFrame([(i, 4_999) for i in range(100)], "node long, links long")
    got = embed.recalls(truth, counted)
    assert got == {0: pytest.approx(2 / 3), 1: 0.0, 13: 1.0}
    assert embed.recalls(truth.limit(0), counted) == {}


def test_embeddings_fail_on_low_recall(spark, monkeypatch):
    """A search that finds nothing is not made good by the audit's own answers."""
    r = np.random.default_rng(4)
    x = [v.tolist() for v in r.standard_normal((50, 8))]
    df = spark.createDataFrame([(50 * (i + 1) + j, v) for i, v in enumerate(x) for j in (0, 1)], "vec_id long, embedding array<double>")
    df = df.withColumn("embedding", F.transform("embedding", lambda e: e + 0.001 * (F.col("vec_id") % 50)))
    blind = spark.createDataFrame([], "u long, v long, sim float")
    tried = []
    monkeypatch.setattr(embed, "first_graph", lambda nodes, count, trees=0, seed=0, grow=1: tried.append((trees, grow)) or (blind, blind))
    monkeypatch.setattr(embed, "ATTEMPTS", 3)
    monkeypatch.setattr(embed, "ROUNDS", 0)
    with pytest.raises(RuntimeError, match="recall"):
        embed.near_duplicates(df)
    assert [g for _, g in tried] == [1, 2, 4] and tried[0][0] <= tried[1][0] < tried[2][0]


def test_embeddings_trees_grow():
    """A pair at cosine 0.95 meets in some tree, however many planes the table takes."""
    for count in (100, 50_000, 1_000_000, 16_000_000):
        bits = max(0, round(np.log2(count / embed.CELL)))
        assert 1 - (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** embed.trees_for(count) >= embed.MET
    assert embed.trees_for(50_000, 0.7) > embed.trees_for(50_000)


def test_embeddings_common_mean(spark):
    """Pairs near the threshold meet in cells though all vectors lean one way, and no cell stays a lump."""
    r = np.random.default_rng(6)
    x = r.standard_normal((6000, 32))
    x[:, 0] += 6
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x[:600] + 0.28 * (d := r.standard_normal((600, 32))) / np.linalg.norm(d, axis=1)[:, None]
    y /= np.linalg.norm(y, axis=1)[:, None]
    close = np.flatnonzero(np.einsum("ij,ij->i", x[:600], y) >= 0.95)
    rows = [(i, 32, v.astype(np.float32).tobytes()) for i, v in enumerate(np.concatenate([x, y]))]
    nodes = spark.createDataFrame(rows, "node long, dim int, v binary").cache()
    found = embed.cells(nodes, range(embed.trees_for(len(rows), embed.spread(nodes)))).cache()
    assert found.groupBy("tree", "cell").count().agg(F.max("count")).first()[0] <= 2 * embed.CELL
    pairs = found.join(found.select("tree", "cell", F.col("node").alias("other")), ["tree", "cell"]).where("other = node + 6000").select("node").distinct()
    assert len(close) > 300 and len({p["node"] for p in pairs.collect()} & set(close.tolist())) >= 0.95 * len(close)


PAGE = "<html><head><title>T</title><style>p{}</style></head><body class=has-sidebar><nav><ul><li><a href=/x>Menu</a></ul></nav><div class='cookie-notice'>We use cookies</div>{}<div class=sidebar>Side</div><section id=comments><p>nice post</section><footer>&copy; F</footer></body></html>"


def test_html(spark):
    body = "<article><h1>Head &amp; more</h1><p><b>One two\n three<br>four<p>Fünf&nbsp;six <script>x</script><form>q</form><aside>aside</aside><ul><li>a<li>b</ul><p>{}</article>"
    rows = [(i, f"http://www.h.example/{i}", PAGE.replace("{}", body.replace("{}", f"tail {i} " + "text " * 20))) for i in range(6)]
    rows += [(6, "http://h.example/6", PAGE.replace("{}", "<div class='content'><p>only a div " + "text " * 9 + "</div>")), (7, None, None), (8, "x", ""), (9, "http://h.example/9", "<" * 50 + "div>" * 3000 + "deep")]
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash"))).collect()}
    for i in range(6):
        assert got[i] == f"Head & more\nOne two three four\nFünf six\na\nb\ntail {i} " + "text " * 19 + "text"
    assert got[6] == "only a div " + "text " * 8 + "text" and got[7] == "" and got[8] == "" and got[9].endswith("deep")
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("name", ["has-sidebar", "no-comments", "nav-open", "social-article", "post widget", "hidden-xs", "promo"])
def test_html_class_words_keep_the_article(name):
    text = "long text " * 29 + "long text"
    aside = "<div class=sidebar>side words</div><section id=comments><article class=comment-body>nice post</article></section>"
    for page in ("<article class='{}'><p>{}</article>", "<div class='{}'><article><p>{}</article></div>", "<div class='{}'><main><p>{}</main></div>", "<div class='{}'><p>{}</div>"):
        assert html.extract("<body>" + page.format(name, text) + aside + "</body>") == text


def test_html_depth_is_linear():
    from time import process_time

    def seconds(depth):
        page = "<p>x" + "<div class=a1><span><header>" * depth + "<h1>head</h1> deep text " + "</span><section>y</section>" * depth
        start = process_time()
        text = html.extract(page, next(iter(html.page_votes(page)))[0])
        return process_time() - start, text

    seconds(1000)
    (short, _), (long, text) = seconds(8000), seconds(64_000)
    assert text and long < 30 * short


def test_html_pages_by_another_method(spark, sf_dir):
    """All given pages, whose articles have no markup errors, against regular expressions."""
    from html import unescape

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want, drop = {}, r"<(script|style|aside|nav|form|header|footer)\b.*?</\1>|<!--.*?-->|<div class=\"(?:ad|share|related)\">.*?</div>"
    for r in pages.collect():
        body = re.search(r"<article[^>]*>(.*?)</article>", re.sub(drop, "", r["html"], flags=re.S | re.I), re.S | re.I)[1]
        blocks = re.split(r"</?(?:p|h\d|ul|ol|li|div|blockquote|pre|table|tr|td|th|section|figure|figcaption)\b[^>]*>", body, flags=re.I)
        lines = [" ".join(unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br[^>]*>", " ", x))).split()) for x in blocks]
        want[r["page_id"]] = "\n".join(x for x in lines if x)
    got = {r["page_id"]: r["text"] for r in html.extract_pages(pages).collect()}
    assert {i: (got[i], t) for i, t in want.items() if got[i] != t} == {}


def test_html_votes_overrule_a_page(spark):
    good = "<body><article><p>" + "long text " * 30 + "</article><div class=teaser><p>short</div></body>"
    odd = "<body><article><p>brief</article><div class=box><p>" + "other words " * 30 + "</div></body>"
    rows = [(i, "http://h/", good) for i in range(5)] + [(9, "http://h/", odd), (10, "http://other/", odd)]
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "brief" and got[10].startswith("other words")


def test_html_hosts_have_several_templates(spark):
    news = "<body><article><p>" + "long text " * 30 + "</article><div class=teaser><p>short</div></body>"
    shop = "<body><article><p>see also</article><div class=box><p>" + "other words " * 30 + "</div></body>"
    rows = [(i, "http://h/", news) for i in range(12)] + [(i, "http://h/", shop) for i in range(20, 24)]
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {t for i, t in got.items() if i < 20} == {("long text " * 30).strip()}
    assert {t for i, t in got.items() if i >= 20} == {("other words " * 30).strip()}


def test_chat_linear(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a </turn> \\1 ### b"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, None, "\\### x"), (2, 0, None, "\\### x"), (None, 5, "a: b", "no conv"), *((3, i, ["user", "assistant"][i % 2], f"t{i}\n### {i}") for i in range(70))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(chat.as_tree(df))).collect()}
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        want.setdefault(None if c is None else str(c), []).append((role or "", text or ""))
    assert {c: [tuple(t) for t in r["turns"]] for c, r in got.items()} == want
    assert {c: list(r["learned"]) for c, r in got.items()} == {c: [t for role, t in v if role == "assistant"] for c, v in want.items()}
    one = got["1"]
    assert one["formatted"].count(chat.TURN_END) == 4 and "".join(one["formatted"][s["start"] : s["end"]] for s in one["mask"]) == "a \\2 \\01 \\1 b"
    assert chat.format_chats(chat.as_tree(df.limit(0))).count() == 0


def test_chat_trees(spark):
    #       1 -> 2 -> 4 -> 7,  1 -> 3 -> 5,  3 -> 6;  8 is a root by its missing parent;  9 and 10 are a cycle
    tree = [(1, None, 0.0), (2, 1, 1.0), (3, 1, 5.0), (4, 2, 9.0), (5, 3, 1.0), (6, 3, 4.0), (7, 4, 0.5), (8, 99, 0.1), (9, 10, 9.0), (10, 9, 9.0)]
    df = spark.createDataFrame([(1, m, p, "user", f"m{m}", s) for m, p, s in tree], "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    best = chat.paths(df, branches=2).collect()
    by = {}
    for r in sorted(best, key=lambda r: r["place"]):
        by.setdefault(r["path"], []).append(r["text"])
    assert by == {6: ["m1", "m3", "m6"], 7: ["m1", "m2", "m4", "m7"]}
