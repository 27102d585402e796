"""Alignment of two tokenizers' tokens by merge-path partitioning.

Tokenizer A is a byte-level BPE, B a SentencePiece BPE; both cut the same bytes, a space and the text. The ends of A's
and B's tokens are two sorted lists, and merging them gives every overlap: each distinct end closes the overlap of one
A and one B token. The merge is cut along diagonals: a binary search on each finds how many ends of A and of B come
first, so pieces have equal work whatever the documents' lengths, and none needs another. A piece emits the overlaps
of its ends and the ends that A and B share; the pieces' shared ends, put together, cut the tokens into groups, with
one end looked at across each bound, as a shared end may lie on both its sides.

Counts of linked id pairs cover the corpus. Documents are aligned in blocks of about `BLOCK_BYTES` of text; a block keeps
its own list of pairs with the number of its documents that hold each, and its documents refer to places of that list. Only
these lists are summed by pair and joined back, block by block, so that what is shuffled is a block's distinct pairs, not
every document's, and nothing that grows with the corpus is broadcast.

Defined results: null and empty texts, and texts whose tokens of either side don't give back space and text (a text
with U+2581 for one), have zeros and an empty digest; rows stand for themselves, so that repeated ids or rows count as
documents of their own, and null ids stay; special tokens' strings are plain text; extra columns are ignored; an empty
table gives an empty one. Whole texts are encoded.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealweave.llm.common import lean_batches, slices, written

#: Ends merged in one piece, bytes of text encoded together, bytes of text in a block, bytes of words that a worker remembers.
PIECE, SLICE_BYTES, BLOCK_BYTES, MEMORY = 1 << 16, 2_000_000, 8_000_000, 50_000_000
#: Characters that are surely no white space: printable ASCII and Latin letters.
SAFE = frozenset(map(chr, [*range(0x21, 0x7F), *range(0xC0, 0x250)]))
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next letter from 256 on."""
    prints = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenizers with the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel unit
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        entries = dict(spec["model"]["vocab"]) | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry)
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.vocab_size()))
        ]
        self.a_length, self.b_length = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.n_b = len(self.b_bytes)
        self.n_pairs = len(self.a_bytes) * self.n_b
        # text of an id, and what follows it: inside its side of a group, or at that side's end
        self.texts = [f"{i}{end}".encode() for i in range(len(self.a_bytes)) for end in ",|"]
        self.texts += [f"{i}{end}".encode() for i in range(self.n_b) for end in ",;"]

        self.words = _Words(self)

    def encode_each(self, texts: list[str], before: str = "") -> tuple[list, list, np.ndarray]:
        """(ids of A, ids of B, whether both give back space and text) of each text; `before` is what A gets in front of it."""
        a = [e.ids for e in self.a.encode_batch_fast([before + t for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        ok = np.zeros(len(texts), bool)
        for k, t in enumerate(texts):
            whole = b" " + t.encode()
            ok[k] = b"".join(map(self.a_bytes.__getitem__, a[k])) == whole and b"".join(map(self.b_bytes.__getitem__, b[k])) == whole
        return a, b, ok

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """[ids of A, their number by text, ids of B, their number by text]; no ids where either side does not give back space and text."""
        texts = pc.fill_null(texts, "")
        cells = pc.split_pattern(texts, " ")
        bounds = cells.offsets.to_numpy().astype(np.int64)
        found = cells.flatten().dictionary_encode()
        codes, slots = found.indices.to_numpy(zero_copy_only=False), self.words.slots(found.dictionary.to_pylist())
        safe = np.concatenate([[0], np.cumsum(slots[codes] >= 0)])
        plain = np.diff(safe[bounds - bounds[0]]) == np.diff(bounds)
        odd = np.flatnonzero(~plain & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)).tolist()
        odd_a, odd_b, odd_ok = self.encode_each([texts[k].as_py() for k in odd], " ")
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        slot = slots[codes]
        good = plain.copy()
        good[owner[(slot >= 0) & ~self.words.ok[slot]]] = False
        slot, owner = slot[good[owner]], owner[good[owner]]
        out = []
        for kept, others in ((self.words.a, odd_a), (self.words.b, odd_b)):
            n = kept.count[slot]
            sizes = np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64)
            ids = kept.ids[np.repeat(kept.start[slot] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(int(n.sum()))]
            mine = np.repeat(np.arange(len(texts)), sizes)
            before = np.concatenate([[0], np.cumsum(sizes)])
            for k, x, ok in zip(odd, others, odd_ok, strict=True):
                sizes[k] = len(x) if ok else 0
            bounds_all = np.concatenate([[0], np.cumsum(sizes)])
            flat = np.empty(bounds_all[-1], np.int64)
            flat[np.arange(len(ids)) + (bounds_all - before)[mine]] = ids
            for k, x in zip(odd, others, strict=True):
                flat[bounds_all[k] : bounds_all[k + 1]] = x[: sizes[k]]
            out += [flat, sizes]
        return out


class _Kept:
    """Ids of words in one array that grows."""

    def __init__(self):
        self.ids, self.start, self.count = (np.empty(0, np.int64) for _ in range(3))

    def add(self, ids: np.ndarray, n: np.ndarray):
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
        self.count = np.concatenate([self.count, n])
        self.ids = np.concatenate([self.ids, ids])


class _Words:
    """The ids of words that stand between single spaces, each encoded once; up to `MEMORY` bytes of them are remembered.

    A word whose first and last characters are surely no white space has the same tokens wherever it stands: A's pattern begins a new token
    at a space between two such characters, and no piece of B has a word mark after another character. Other words have slot -1.
    """

    def __init__(self, pair: Pair):
        self.pair = pair
        if any("▁" in pair.b.id_to_piece(i).lstrip("▁") for i in range(pair.b.vocab_size())):
            raise ValueError("pieces must not hold a word mark inside")
        self.clear()

    def clear(self):
        self.known, self.size, self.ok, self.a, self.b = {}, 0, np.empty(0, bool), _Kept(), _Kept()

    def _learn(self, words: list[str]):
        """Encodes different words: A's as one text, which its pattern cuts at their spaces, B's one by one."""
        pair, text = self.pair, "".join([" " + w for w in words])
        ids = pair.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        lists = pair.b.encode(words, num_threads=1)
        whole, flat = text.encode(), list(chain.from_iterable(lists))
        a, b = np.array(ids, np.int64), np.array(flat, np.int64)
        n_b = np.fromiter(map(len, lists), np.int64, len(lists))
        word_ends = np.cumsum(pc.binary_length(pa.array(words)).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        ends, ends_b = np.cumsum(pair.a_length[a]), np.cumsum(pair.b_length[b])
        last = np.minimum(np.searchsorted(ends, word_ends), len(a) - 1)
        exact = b"".join(map(pair.a_bytes.__getitem__, ids)) == whole and b"".join(map(pair.b_bytes.__getitem__, flat)) == whole
        if exact and np.array_equal(ends[last], word_ends) and np.array_equal(ends_b[np.cumsum(n_b) - 1], word_ends):
            self.a.add(a, np.diff(np.append(-1, last)))
            self.b.add(b, n_b)
            self.ok = np.append(self.ok, np.ones(len(words), bool))
            return
        lists_a, lists_b, ok = pair.encode_each(words, " ")  # some word is not given back
        for kept, found in ((self.a, lists_a), (self.b, lists_b)):
            kept.add(np.fromiter(chain.from_iterable(found), np.int64), np.fromiter(map(len, found), np.int64, len(found)))
        self.ok = np.append(self.ok, ok)

    def slots(self, words: list[str]) -> np.ndarray:
        """The slot of each of some different words."""
        if self.size > MEMORY:
            self.clear()
        new = [w for w in words if w not in self.known]
        fit = [w for w in new if w and w[0] in SAFE and w[-1] in SAFE]
        at = len(self.ok)
        if fit:
            self._learn(fit)
        self.known.update(dict.fromkeys(new, -1))
        self.known.update(zip(fit, range(at, at + len(fit)), strict=True))
        self.size += sum(map(len, new)) + 100 * len(new)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


@functools.cache
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """(of a, of b): how many ends of each come before every `piece`-th place of their merge, an end of `a` before an equal one of `b`."""
    at = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        x, y = a[np.minimum(mid, len(a) - 1)], b[np.clip(at - mid - 1, 0, len(b) - 1)]
        more = open_ & (x <= y)
        low, high = np.where(more, mid + 1, low), np.where(open_ & ~more, mid, high)
    return low, at - low


def overlaps(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the piece a[i0:i1], b[j0:j1] of a merge: (tokens of a, of b) that overlap, and (tokens of a, of b) that end together."""
    ends_a, ends_b = a[i0:i1], b[j0:j1]
    with_a = j0 + np.searchsorted(ends_b, ends_a)
    place = np.searchsorted(ends_a, ends_b)
    shared = np.zeros(len(ends_b), bool)
    inside = np.flatnonzero(place < len(ends_a))
    shared[inside] = ends_a[place[inside]] == ends_b[inside]
    partner = i0 + place
    if len(ends_b) and i0 and a[i0 - 1] == ends_b[0]:  # its equal end lies across the bound
        shared[0], partner[0] = True, i0 - 1
    alone = np.flatnonzero(~shared)
    both = np.flatnonzero(shared)
    return np.append(np.arange(i0, i1), partner[alone]), np.append(with_a, j0 + alone), partner[both], j0 + both


def _aligned(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, pair: Pair):
    """Of some documents: (counts by document, digests, pair codes, their bounds by document, their multiplicities)."""
    bounds_a, bounds_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
    ends_a, ends_b = np.cumsum(pair.a_length[a]), np.cumsum(pair.b_length[b])
    found = [overlaps(ends_a, ends_b, *x) for x in zip(*(y[k:][: len(y) - 1] for y in diagonals(ends_a, ends_b, PIECE) for k in (0, 1)), strict=True)] if len(a) else []
    link_a, link_b, cut_at, cut_b_at = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.empty(0, np.int64)] * 4
    cut_a, cut_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    cut_a[cut_at], cut_b[cut_b_at] = 1, 1
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    total = int(cut_a.sum())
    before_a, before_b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=total))]) for g in (group_a, group_b))
    words = np.empty(len(a) + len(b), np.int64)
    words[np.arange(len(a)) + before_b[group_a]] = 2 * a + cut_a
    words[np.arange(len(b)) + before_a[group_b + 1]] = 2 * (len(pair.a_bytes) + b) + cut_b
    texts, ends = list(map(pair.texts.__getitem__, words.tolist())), (bounds_a + bounds_b).tolist()
    digests = [hashlib.sha256(b"".join(texts[low:high])[:-1]).hexdigest() if high > low else "" for low, high in zip(ends, ends[1:], strict=False)]
    doc = np.searchsorted(bounds_a, link_a, "right") - 1
    codes, times = np.unique(doc * pair.n_pairs + a[link_a] * pair.n_b + b[link_b], return_counts=True)
    n_groups = np.diff(np.concatenate([[0], np.cumsum(cut_a)])[bounds_a])
    n_links = np.bincount(doc, minlength=len(n_a))
    pairs_upto = np.searchsorted(codes, np.arange(len(n_a) + 1) * pair.n_pairs)
    return np.stack([n_a, n_b, n_groups, n_links]), digests, codes % pair.n_pairs, pairs_upto, times


_LONGS = pa.list_(pa.int64())
_BLOCK = pa.schema(
    [("block", pa.int64()), ("doc_id", _LONGS), ("counts", _LONGS), ("digest", pa.list_(pa.string())), ("upto", _LONGS), ("places", pa.binary()), ("times", pa.binary()), ("pairs", _LONGS), ("docs", _LONGS)]
)


class _Block:
    """Aligned documents whose pairs are listed together."""

    def __init__(self):
        self.ids, self.parts, self.size = [], [], 0

    def add(self, ids: list, part, size: int):
        self.ids += ids
        self.parts.append(part)
        self.size += size

    def row(self, number: int) -> pa.RecordBatch:
        counts, digests, pairs, upto, times = zip(*self.parts, strict=True)
        listed, places, docs = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
        ends = np.cumsum([0, *(len(p) for p in pairs)])
        upto = np.concatenate([[0], *(u[1:] + e for u, e in zip(upto, ends, strict=False))])
        steps = np.diff(places, prepend=0).astype("<i4")
        times = np.concatenate(times).astype("<i4")
        values = [number, self.ids, np.concatenate(counts, axis=1).ravel(), [d for x in digests for d in x], upto, zlib.compress(steps.tobytes(), 1), zlib.compress(times.tobytes(), 1), listed, docs]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCK, strict=True)], schema=_BLOCK)


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of aligned documents: ids, counts, digests, and their pairs as places in the block's list `pairs`, of which `docs` documents hold each."""

    def run(batches):
        both, part, number, block = pair(a_path, b_path), TaskContext.get().partitionId(), 0, _Block()
        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            for low, high in slices(column, SLICE_BYTES):
                encoded = both.encode(column[low:high])
                block.add(ids[low:high], _aligned(*encoded, both), int(sizes[low:high].sum()))
                if block.size >= BLOCK_BYTES:
                    yield block.row(part << 32 | number)
                    number, block = number + 1, _Block()
        if block.ids:
            yield block.row(part << 32 | number)

    ddl = "block long, doc_id array<long>, counts array<long>, digest array<string>, upto array<long>, places binary, times binary, pairs array<long>, docs array<long>"
    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, ddl)


def pair_counts(blocks: DataFrame, n_b: int) -> DataFrame:
    """(pair, total, best): in how many documents of the corpus each linked pair occurs, and whether no pair of its A id occurs in more."""
    listed = blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.docs").alias("n"))
    totals = listed.groupBy("pair").agg(F.sum("n").alias("total"))
    # an A id has at most as many pairs as B has ids
    most = F.max("total").over(Window.partitionBy(F.expr(f"pair div {n_b}")))
    return totals.withColumn("best", F.col("total") == most)


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of `docs`."""
    lean_batches(docs.sparkSession)
    blocks = written(aligned_blocks(docs, a_path, b_path, key, text), "aligned")
    counts = pair_counts(blocks, pair(a_path, b_path).n_b)
    placed = blocks.select("block", F.posexplode("pairs").alias("place", "pair")).join(counts, "pair")
    # a block's list is as long as its texts have pairs
    found = placed.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "total", "best"))).alias("found"))
    found = found.select("block", F.col("found.total").alias("total"), F.col("found.best").alias("best"))
    whole = blocks.drop("pairs", "docs").join(found, "block", "left")
    schema = pa.schema([(key, pa.int64()), *((n, pa.int64()) for n in RESULTS[:-1]), (RESULTS[-1], pa.string())])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = dict(zip(batch.schema.names, (c[k] for c in batch.columns), strict=True))
                values = {n: row[n].values.to_numpy(zero_copy_only=False) if row[n].is_valid else np.empty(0, np.int64) for n in ("counts", "upto", "total", "best")}
                places, times = (np.frombuffer(zlib.decompress(row[n].as_py()), "<i4").astype(np.int64) for n in ("places", "times"))
                places = np.cumsum(places)
                total = np.concatenate([[0], np.cumsum(times * values["total"][places])]) if len(places) else np.zeros(1, np.int64)
                best = np.concatenate([[0], np.cumsum(times * values["best"][places].astype(np.int64))]) if len(places) else np.zeros(1, np.int64)
                sums = [np.diff(x[values["upto"]]) for x in (best, total)]
                columns = [row["doc_id"].values, *values["counts"].reshape(4, -1), *sums, row["digest"].values]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return whole.mapInArrow(run, ", ".join(f"{f.name} {'string' if f.name == RESULTS[-1] else 'long'}" for f in schema))
