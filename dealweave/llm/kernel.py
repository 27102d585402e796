"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Every whole text gives a few statistics (shares of character classes, lengths, repetition). They are standardised by
their means and deviations over all documents, and random Fourier features turn them into coordinates whose inner products
approximate a Gaussian kernel. Ridge scores need only the sums of outer products of labelled rows: each partition
sums its own, one matrix for each fold, and the partitions' matrices are added row by row; the driver gets the fixed number of
rows that a matrix has. The same sums less one fold's give scores of that fold's rows by a model that has not
seen them, and these are counted on a grid of fixed size and made monotone by pooling adjacent violators. A score is
interpolated between the pools, so that the ranking stays.

Statistics are sums over bytes and words of the text; its label, language, source and id are no part of them.

Defined results: null and empty texts have all statistics zero and a score like others; a document is held out if crc32 of
its id as text is divisible by 5, as is one without id, and held-out rows never teach; null labels and labels of no document
teach nothing, several labels of one id all count; documents with one id are scored each; without labelled rows every score is 0.5; extra
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave.llm.common import flat_words, lean_batches, slices, written

#: Fourier features, width of the kernel in deviations, ridge, folds, steps of the grid for one unit of score.
FEATURES, WIDTH, RIDGE, FOLDS, GRID = 256, 4.0, 1e-3, 5, 4096
THRESHOLD = 0.3
#: The grid covers scores from -1 to 2, others count at its ends.
LEAST, MOST = -GRID, 2 * GRID
CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>", "exclaim": b"!", "mark": b".,;:?'\"()-", "wide": bytes(range(128, 256))}
STATISTICS = ("words", "word_bytes", *CLASSES, "distinct", "same_next", "top_word", "repeats", "lines", "same_lines", "lone_marks", "capitals")


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[bounds])


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _repeated(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text: (different keys, keys that occur twice or more, occurrences of the most frequent); owner: the text of each key."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (o[1:] != o[:-1]))[: len(k)])
    times, of = np.diff(np.append(first, len(k))), o[first]
    most = np.zeros(n, np.int64)
    np.maximum.at(most, of, times)
    return np.bincount(of, minlength=n), np.bincount(of, weights=np.where(times > 1, times, 0), minlength=n), most


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of `STATISTICS` for each of the binary `texts`."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, 4 * texts.offset).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]
    n_bytes, out = np.diff(bounds), {}
    for name, members in CLASSES.items():
        table = np.zeros(256, bool)
        table[list(members)] = True
        out[name] = _share(_per_text(table[data], bounds), n_bytes)
    words, upto = flat_words(texts)
    n_words = np.diff(upto)
    owner = np.repeat(np.arange(n), n_words)
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    encoded = words.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    heads = np.array([w[0] for w in encoded.dictionary.to_pylist()], np.int64)[codes] if len(codes) else codes
    out["words"], out["word_bytes"] = np.log1p(n_words), np.log1p(_share(_per_text(lengths, upto), n_words))
    different, _, most = _repeated(codes, owner, n)
    out["distinct"], out["top_word"] = _share(np.log1p(different), np.log1p(n_words)), _share(most, n_words)
    same = np.append(False, (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1]))[: len(codes)]
    out["same_next"] = _share(_per_text(same, upto), n_words)
    triple = np.flatnonzero(owner[2:] == owner[:-2])
    keys = (codes[triple] * 0x9E3779B1 + codes[triple + 1]) * 0x85EBCA77 + codes[triple + 2]
    _, twice, _ = _repeated(keys, owner[triple], n)
    out["repeats"] = _share(twice, np.maximum(n_words - 2, 0))
    letters = (heads >= 97) & (heads <= 122) | (heads >= 65) & (heads <= 90) | (heads >= 128)
    out["lone_marks"] = _share(_per_text((lengths == 1) & ~letters, upto), n_words)
    out["capitals"] = _share(_per_text((heads >= 65) & (heads <= 90), upto), n_words)
    cells = pc.split_pattern(texts.view(pa.string()), "\n")
    lines, starts = cells.flatten(), cells.offsets.to_numpy().astype(np.int64)
    filled = pc.binary_length(lines).to_numpy(zero_copy_only=False) > 0
    line_owner = np.repeat(np.arange(n), np.diff(starts))[filled]
    line_codes = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[filled]
    n_lines = np.bincount(line_owner, minlength=n)
    different, _, _ = _repeated(line_codes, line_owner, n)
    out["lines"], out["same_lines"] = np.log1p(_share(n_words, n_lines)), _share(n_lines - different, n_lines)
    return np.stack([np.asarray(out[name], float) for name in STATISTICS], axis=1)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, fold, STATISTICS) of every row of `docs` (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fold", pa.int32()), *((s, pa.float64()) for s in STATISTICS)])

    def run(batches):
        for b in batches:
            for low, high in slices(b.column(2)):
                found = statistics(b.column(2)[low:high])
                columns = [b.column(0)[low:high], b.column(1)[low:high], *(pa.array(x) for x in found.T)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    key = F.col("doc_id").cast("long")
    fold = (F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % FOLDS).cast("int")
    rows = docs.select(key.alias("doc_id"), fold.alias("fold"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fold int, " + ", ".join(f"{s} double" for s in STATISTICS))


class Fourier:
    """Random Fourier features of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = draw.normal(0, 1 / WIDTH, (len(mean), FEATURES))
        self.b = draw.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones(len(x))])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(s).to_numpy() for s in STATISTICS], axis=1)


def normal_equations(taught: DataFrame, fourier: Fourier) -> np.ndarray:
    """For each fold the sums over its rows of w z zT, and in a last column of y z; `taught` has fold, weight, good and STATISTICS.

    Each partition sums its own rows; as many rows as FOLDS matrices have reach the driver.
    """
    size = FEATURES + 1
    schema = pa.schema([("fold", pa.int32()), ("place", pa.int32()), ("part", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def partial(batches):
        sums, part = {}, TaskContext.get().partitionId()
        for b in batches:
            folds, x, w, y = b.column("fold").to_numpy(), _matrix(b), b.column("weight").to_numpy(), b.column("good").to_numpy()
            for f in np.unique(folds).tolist():
                mine = folds == f
                z = fourier(x[mine])
                gram = np.column_stack([(z * w[mine, None]).T @ z, z.T @ y[mine]])
                sums[f] = sums.get(f, 0) + gram
        for f, gram in sums.items():
            columns = [pa.array(np.full(size, f), pa.int32()), pa.array(np.arange(size), pa.int32()), pa.array(np.full(size, part), pa.int32()), pa.array(list(gram), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def added(table: pa.Table) -> pa.Table:
        # one row a partition, always in the same order
        table = table.sort_by("part")
        total = np.sum(table["sums"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1), axis=0)
        return pa.table({"fold": table["fold"][:1], "place": table["place"][:1], "sums": pa.array([total], pa.list_(pa.float64()))})

    parts = taught.mapInArrow(partial, "fold int, place int, part int, sums array<double>")
    rows = parts.groupBy("fold", "place").applyInArrow(added, "fold int, place int, sums array<double>").collect()
    out = np.zeros((FOLDS, size, size + 1))
    for r in rows:
        out[r["fold"], r["place"]] = r["sums"]
    return out


def ridge(sums: np.ndarray) -> np.ndarray:
    """Weights of the features from one matrix of `normal_equations`."""
    rows = max(sums[-1, -2], 1.0)  # the constant's square summed
    penalty = RIDGE * rows * np.eye(len(sums))
    penalty[-1, -1] = 1e-9 * rows
    return np.linalg.solve(sums[:, :-1] + penalty, sums[:, -1])


def isotonic(at: np.ndarray, weight: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the pools of the monotone fit of good / weight at ascending `at`, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for x, w, g in zip(at.tolist(), weight.tolist(), good.tolist(), strict=True):
        pools.append([x * w, w, g])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    found = np.array(pools).reshape(-1, 3)
    return found[:, 0] / found[:, 1], found[:, 2] / found[:, 1]


def calibration(taught: DataFrame, fourier: Fourier, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The monotone fit over scores of the rows of each fold by weights[fold], counted on the grid."""

    def run(batches):
        for b in batches:
            folds = b.column("fold").to_numpy()
            raw = np.einsum("ij,ij->i", fourier(_matrix(b)), weights[folds])
            place = np.clip(np.rint(raw * GRID), LEAST, MOST).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), b.column("weight"), b.column("good")], names=["place", "weight", "good"])

    counted = taught.mapInArrow(run, "place int, weight double, good double").groupBy("place").agg(F.sum("weight").alias("weight"), F.sum("good").alias("good"))
    rows = np.array([tuple(r) for r in counted.collect()]).reshape(-1, 3)  # as many as the grid has places
    rows = rows[np.argsort(rows[:, 0])]
    return isotonic(rows[:, 0] / GRID, rows[:, 1], rows[:, 2])


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of `docs` (doc_id, text), learnt from `labels` (doc_id, quality) of documents that are not held out."""
    lean_batches(docs.sparkSession)
    rows = written(measured(docs), "statistics")
    about = rows.agg(*(f(s).alias(f"{name}_{s}") for s in STATISTICS for name, f in (("mean", F.avg), ("deviation", F.stddev_pop)))).first()
    mean, deviation = (np.array([about[f"{name}_{s}"] or 0.0 for s in STATISTICS]) for name in ("mean", "deviation"))
    fourier = Fourier(mean, deviation)
    quality = F.col("quality").cast("double")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), quality.alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.count("quality").cast("double").alias("weight"), F.sum("quality").alias("good"))
    taught = written(rows.where("fold <> 0").join(known, "doc_id").select("fold", "weight", "good", *STATISTICS), "taught")
    sums = normal_equations(taught, fourier)
    if sums[:, -1, -2].sum() > 0:
        final = ridge(sums.sum(axis=0))
        unseen = np.stack([ridge(sums.sum(axis=0) - sums[f]) for f in range(FOLDS)])
        places, values = calibration(taught, fourier, unseen)
    else:
        final, places, values = np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5])

    def score(batches):
        for b in batches:
            found = np.interp(fourier(_matrix(b)) @ final, places, values)
            columns = [b.column("doc_id"), pc.equal(b.column("fold"), 0), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
