"""SentencePiece encoding and decoding of a BPE model by vectorised merge rounds.

A text is cut where no piece can cross: before a run of word marks, and around line feeds and between
letters and other characters if the vocabulary has no piece across them. The distinct words of a batch are then encoded together: their characters are one flat array of symbol ids, and each
round finds every word's least pair rank by a segmented minimum, merges the pairs of that rank from the
left, all words at once, and compacts the array, until no pair is left. Ranks are the model's: the
piece of higher score first, then the leftmost pair. A piece whose merge could open a better pair than
its own is merged one place at a time, so the result is that of the library. Words of more than `LONG` symbols
take as many rounds as they have ranks, so these few go through a heap of pairs instead, by the same rules.

Each Python worker remembers up to `MEMORY` words, which bounds its memory and changes no result.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows, ids and
extra columns need no rule, as each row stands alone. Whole texts of any length are encoded.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave.llm.common import lean_batches

MARK = "▁"
MEMORY = 300_000
#: Characters of text that are handled together, and symbols of words merged together.
BATCH_CHARS, BATCH_SYMBOLS = 4_000_000, 1_000_000
LONG = 2_000
_NONE = np.iinfo(np.int64).max


class PieceModel:
    """The tables of one BPE model file. Character symbols outside the vocabulary get ids past its end."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        model.ParseFromString(processor.serialized_model_proto())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("a BPE model with identity normalisation and a dummy prefix is needed")
        kinds = pb.ModelProto.SentencePiece
        pieces = [p.piece for p in model.pieces]
        if any(p.type == kinds.USER_DEFINED for p in model.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.UNUSED)}
        self.size = len(pieces)
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        if len(self.byte) != 256:
            raise ValueError("a model with byte fallback is needed")
        order = sorted(self.normal.values(), key=lambda i: (-model.pieces[i].score, i))
        rank = {i: r for r, i in enumerate(order)}
        keys, ranks, merged = [], [], []
        for piece, i in self.normal.items():
            for cut in range(1, len(piece)):
                a, b = self.normal.get(piece[:cut]), self.normal.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    ranks.append(rank[i])
                    merged.append(i)
        at = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.ranks, self.merged = (np.array(x, np.int64)[at] for x in (keys, ranks, merged))
        self.by_rank = np.array(order, np.int64)
        # pieces that take part in a merge that comes before their own
        unsafe = np.zeros(len(order), bool)
        for side in (self.keys // self.size, self.keys % self.size):
            own = np.array([rank[i] for i in side.tolist()], np.int64)
            unsafe[own[self.ranks < own]] = True
        self.unsafe = unsafe
        self.line_alone = not any("\n" in p and len(p) > 1 for p in self.normal)
        if any(MARK in p.lstrip(MARK) for p in self.normal):
            raise ValueError("pieces must not hold a word mark inside")
        mixed = any(a != MARK and a.isalpha() != b.isalpha() for p in self.normal for a, b in zip(p, p[1:], strict=False))
        numeric = "".join({c for p in self.normal for c in p if re.match("[^\\W\\d_]", c) and not c.isalpha()})  # others are in no piece
        line = "\n" if self.line_alone else ""
        parts = [f"{MARK}*[^{MARK}{line}]+"] if mixed else [f"{MARK}*[^\\W\\d_{numeric}]+", f"{MARK}*(?:[\\W\\d_{numeric}](?<![{MARK}{line}]))+"]
        self.cut = re.compile("|".join([*line, *parts, f"{MARK}+"]))
        byte_of = {i: bytes([b]) for b, i in self.byte.items()}
        self.bytes_of = [byte_of.get(i, p.replace(MARK, " ").encode()) for i, p in enumerate(pieces)]

    def words(self, text: str) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def pair_ranks(self, symbols: np.ndarray, same: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each symbol, `_NONE` where no piece joins it; same: the next symbol is of the same word."""
        out = np.full(len(symbols), _NONE, np.int64)
        inside = np.flatnonzero(same)
        if len(inside):
            a, b = symbols[inside], symbols[inside + 1]
            key = np.where((a < self.size) & (b < self.size), a * self.size + b, -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[inside] = np.where(self.keys[at] == key, self.ranks[at], _NONE)
        return out

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list[np.ndarray] = []
        start = 0
        while start < len(words):
            end, symbols = start, 0
            while end < len(words) and (end == start or symbols + len(words[end]) <= BATCH_SYMBOLS and max(len(words[start]), len(words[end])) <= LONG):
                symbols += len(words[end])
                end += 1
            out += self._encode_long(words[start]) if len(words[start]) > LONG else self._encode(words[start:end])
            start = end
        return out

    def _with_bytes(self, symbols: list[int]) -> np.ndarray:
        ids: list[int] = []
        for s in symbols:
            ids += [s] if s < self.size else [self.byte[b] for b in chr(s - self.size).encode("utf-8", "surrogatepass")]
        return np.array(ids, np.int64)

    @functools.cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))

    def _encode_long(self, word: str) -> list[np.ndarray]:
        """One long word: the least pair from a heap, ties from the left."""
        symbols = [self.normal.get(c, self.size + ord(c)) for c in word]
        n, pairs = len(symbols), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(i):
            j = after[i]
            return pairs.get(symbols[i] * self.size + symbols[j]) if j < n and symbols[i] < self.size and symbols[j] < self.size else None

        heap = [(found[0], i, symbols[i], symbols[after[i]]) for i in range(n) if (found := pair(i))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if symbols[i] != a or after[i] >= n or symbols[after[i]] != b or not (found := pair(i)):
                continue
            j = after[i]
            symbols[i], symbols[j], after[i] = found[1], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (found := pair(k)):
                    heapq.heappush(heap, (found[0], k, symbols[k], symbols[after[k]]))
        return [self._with_bytes([s for s in symbols if s >= 0])]

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        chars, place = np.unique(codes, return_inverse=True)
        known = np.array([self.normal.get(chr(c), self.size + c) for c in chars.tolist()], np.int64)
        symbols = known[place]
        word = np.repeat(np.arange(len(words)), lengths)
        done_words, done_symbols = [], []
        while len(symbols):
            same = np.append(word[1:] == word[:-1], False)
            ranks = self.pair_ranks(symbols, same)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(ranks, starts)
            spans = np.diff(np.append(starts, len(symbols)))
            least_at = np.repeat(least, spans)
            final = least_at == _NONE
            if final.any():  # words without a pair leave the array
                done_words.append(word[final])
                done_symbols.append(symbols[final])
                live = ~final
                symbols, word, ranks, least_at = symbols[live], word[live], ranks[live], least_at[live]
                if not len(symbols):
                    break
            hit = np.flatnonzero(ranks == least_at)
            # within a chain of overlapping hits, every other one from the left
            run_start = np.append(True, hit[1:] != hit[:-1] + 1)
            first = np.maximum.accumulate(np.where(run_start, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            first_of_word = np.append(True, word[hit[1:]] != word[hit[:-1]])
            hit = hit[first_of_word | ~self.unsafe[ranks[hit]]]
            symbols[hit] = self.by_rank[ranks[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_words:
            return [np.empty(0, np.int64) for _ in words]
        word, symbols = np.concatenate(done_words), np.concatenate(done_symbols)
        order = np.argsort(word, kind="stable")
        word, symbols = word[order], symbols[order]
        out = np.split(symbols, np.searchsorted(word, np.arange(1, len(words))))
        for k in np.unique(word[symbols >= self.size]).tolist():  # characters outside the vocabulary
            out[k] = self._with_bytes(out[k].tolist())
        return out

    def text_of(self, ids) -> str:
        """The text of some ids that begin and end at character bounds, its first space kept."""
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")

    def encode(self, text: str) -> list[int]:
        words = self.words(text)
        return np.concatenate(self.encode_words(words)).tolist() if words else []

    def decode(self, ids) -> str:
        text = self.text_of(ids)
        return text[1:] if text.startswith(" ") else text


@functools.cache
def model(path: str) -> PieceModel:
    return PieceModel(path)


_memory: dict[str, dict] = {}


def _remembered(path: str, lists: list[list[str]]) -> dict:
    """Word to (its ids in decimal, joined by commas; its text), for all words of `lists`."""
    memory = _memory.setdefault(path, {})
    wanted = set().union(*lists)
    if len(memory) + len(wanted) > MEMORY:
        memory = {w: memory[w] for w in wanted if w in memory}
        _memory[path] = memory
    new = [w for w in wanted if w not in memory]
    m = model(path)
    for w, ids in zip(new, m.encode_words(new), strict=True):
        ids = ids.tolist()
        memory[w] = (",".join(map(str, ids)), m.text_of(ids))
    return memory


def _groups(texts):
    group, chars = [], 0
    for t in texts:
        if group and chars + len(t) > BATCH_CHARS:
            yield group
            group, chars = [], 0
        group.append(t)
        chars += len(t)
    if group:
        yield group


def encode_texts(path: str, texts: list[str]):
    """Yields (ids as decimal text joined by commas, number of ids, decoded text) for each text."""
    m = model(path)
    for group in _groups(texts):
        lists = [m.words(t) for t in group]
        memory = _remembered(path, lists)
        for words in lists:
            found = [memory[w] for w in words]
            ids, text = ",".join([f[0] for f in found]), "".join([f[1] for f in found])
            yield ids, ids.count(",") + bool(ids), text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids: array<int>, decoded) per row of `docs`."""
    lean_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            ids, decoded = [], []
            for joined, _, t in encode_texts(path, texts):
                ids.append([int(x) for x in joined.split(",")] if joined else [])
                decoded.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=[key, "ids", "decoded"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string")).mapInArrow(run, f"{key} long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) per row of `docs`; the ids themselves don't leave the task."""
    lean_batches(docs.sparkSession)

    def run(batches):
        sha = hashlib.sha256
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            n, ids, decoded = [], [], []
            for joined, count, t in encode_texts(path, texts):
                n.append(count)
                ids.append(sha(joined.encode()).hexdigest())
                decoded.append(sha(t.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string")).mapInArrow(run, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
