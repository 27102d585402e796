"""The kernel classifier: its statistics, sums and fit against plain versions, and its held-out accuracy."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from dealweave.llm import kernel, queries


def plain_statistics(text):
    data = (text or "").encode()
    words = data.split()
    n, share = len(words), lambda a, b: a / max(b, 1)
    out = {name: share(sum(c in members for c in data), len(data)) for name, members in kernel.CLASSES.items()}
    counts = Counter(words)
    triples = [tuple(words[i : i + 3]) for i in range(n - 2)]
    seen = Counter(triples)
    lines = [x for x in data.split(b"\n") if x]
    letter = lambda c: bytes([c]).isalpha() or c >= 128
    out |= {
        "words": np.log1p(n), "word_bytes": np.log1p(share(sum(map(len, words)), n)),
        "distinct": share(np.log1p(len(counts)), np.log1p(n)) if n else 0, "top_word": share(max(counts.values(), default=0), n),
        "same_next": share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n),
        "repeats": share(sum(seen[t] > 1 for t in triples), n - 2), "lines": np.log1p(share(n, len(lines))),
        "same_lines": share(len(lines) - len(set(lines)), len(lines)),
        "lone_marks": share(sum(len(w) == 1 and not letter(w[0]) for w in words), n),
        "capitals": share(sum(65 <= w[0] <= 90 for w in words), n),
    }
    return [out[s] for s in kernel.STATISTICS]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocab = ["the", "Of", "ÉTÉ", "x|y", "!", "|", "42", "word", "日本", "it's", "#a"]
    out = [rng.choice([" ", "\n", "  \t"]).join(rng.choice(vocab) for _ in range(rng.randint(1, 60))) for _ in range(50)]
    return [*out, None, "", " ", "\n\n", "a", "a a a a", "l one\nl one\nl one", "z" * 5000, "w " * 9000]


def test_statistics(texts):
    found = kernel.statistics(pa.array(texts, pa.string()))
    assert np.allclose(found, [plain_statistics(t) for t in texts])
    assert np.allclose(kernel.statistics(pa.array(texts, pa.string())[7:20]), found[7:20])
    assert kernel.statistics(pa.array([], pa.string())).shape == (0, len(kernel.STATISTICS))


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, len(kernel.STATISTICS)))
    z = kernel.Fourier(np.zeros(x.shape[1]), np.ones(x.shape[1]))(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * kernel.WIDTH**2))
    assert np.abs(z @ z.T - exact).max() < 6 / np.sqrt(kernel.FEATURES) and np.abs(z @ z.T - exact).mean() < 1.5 / np.sqrt(kernel.FEATURES)


def test_isotonic():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = 12
        w, g = rng.integers(1, 5, n).astype(float), rng.random(n)
        at = np.sort(rng.random(n))
        places, values = kernel.isotonic(at, w, g * w)
        assert (np.diff(values) > 0).all() and (np.diff(places) > 0).all()
        # the fit at i is the greatest over starts of the least over ends of the means
        mean = lambda a, b: np.average(g[a : b + 1], weights=w[a : b + 1])  # noqa: E731, B023
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(np.unique(np.round(want, 12)), np.round(values, 12))


def test_sums_and_scores(spark, texts):
    """Partition sums are those of all rows; scores follow labels and learn from no held-out row."""
    rng = np.random.default_rng(8)
    rows = [(i, int(i % 4 + 1), float(1 + i % 2), float(i % 2), *map(float, rng.normal(size=len(kernel.STATISTICS)))) for i in range(300)]
    names = ["doc_id", "fold", "weight", "good", *kernel.STATISTICS]
    taught = spark.createDataFrame(rows, "doc_id long, fold int, weight double, good double, " + ", ".join(f"{s} double" for s in kernel.STATISTICS)).repartition(7)
    fourier = kernel.Fourier(np.zeros(len(kernel.STATISTICS)), np.ones(len(kernel.STATISTICS)))
    sums = kernel.normal_equations(taught.select(*names[1:]), fourier)
    data = np.array(rows)
    for f in range(kernel.FOLDS):
        mine = data[data[:, 1] == f]
        z = fourier(mine[:, 4:])
        assert np.allclose(sums[f], np.column_stack([(z * mine[:, 2:3]).T @ z, z.T @ mine[:, 3]]))
    weights = kernel.ridge(sums.sum(axis=0))
    z, w, y = fourier(data[:, 4:]), data[:, 2], data[:, 3]
    gradient = z.T @ (w * (z @ weights) - y) + kernel.RIDGE * w.sum() * np.append(weights[:-1], 0)
    assert np.abs(gradient).max() < 1e-5


def test_odd_tables(spark, texts):
    docs = spark.createDataFrame([(i if i % 7 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, fold string, weight int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r["score"], r["predicted"]) for r in kernel.quality_scores(docs, none).collect()} == {(0.5, 1)}
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (999, 1), (3, 1), (4, 0), (6, 1)], "doc_id long, quality int")
    found = kernel.quality_scores(docs, labels).collect()
    assert len(found) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0) for r in found)
    # labels of held-out rows, and other labels of theirs, change nothing
    held = [i for i in range(1, len(texts)) if i % 7 and zlib.crc32(str(i).encode()) % 5 == 0]
    more = labels.union(spark.createDataFrame([(i, i % 2) for i in held], "doc_id long, quality int"))
    assert sorted(map(str, kernel.quality_scores(docs, more).collect())) == sorted(map(str, found))
    assert kernel.quality_scores(docs.limit(0), labels).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    scored = queries.op11_kernel_quality(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good = np.array([r["score"] for r in scored if r["quality"] == 1])
    bad = np.array([r["score"] for r in scored if r["quality"] == 0])
    assert len(bad) > 20 and (good[:, None] > bad[None]).mean() + (good[:, None] == bad[None]).mean() / 2 > 0.95
    assert (good >= 0.3).mean() > 0.97 and (bad < 0.3).mean() > 0.6
