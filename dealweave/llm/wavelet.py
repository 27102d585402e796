"""Token ids in compressed wavelet-matrix shards.

A shard is one self-contained blob: the ids of consecutive documents as a wavelet matrix (one bit plane
per id bit, each plane in the stable order that the planes above it give), the documents' ids and their
lengths. A plane is kept in blocks that are compressed one by one, with a directory of the ones before
each block, so access, counting and occurrence lookup open only the blocks that they touch; whole shards
are read back plane by plane. A shard table is Parquet with one blob a row, in document order, which any
Hadoop file system holds.

Defined results: null and empty texts have the end id only; documents go by id, null first, repeated ids
by text; an empty table gives an empty shard table; extra columns are ignored. Whole texts are encoded,
and a document is never split over shards.
"""

from __future__ import annotations

import functools
import json
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealweave.llm.common import flat_words, lean_batches, new_path, slices

MAGIC = b"WVMX"
END_ID = 1
SHARD_TOKENS = 1 << 20
#: Distinct pieces of words, and bytes of them, that a Python worker remembers.
PIECE_MEMORY, BYTE_MEMORY = 1_800_000, 64_000_000
#: Bits of a plane that are compressed together, and blocks of a plane that stay open.
BLOCK, OPENED = 1 << 17, 64
_SHARD_DDL = "part int, number int, n_docs long, n_tokens long, blob binary"
_SHARD = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("blob", pa.binary())])


class Plane:
    """One bit plane in blocks of `BLOCK` bits, each compressed by itself, with the number of ones before each block."""

    def __init__(self, blocks: list, before: np.ndarray, n: int):
        self.blocks, self.before, self.n, self.opened = blocks, before, n, {}

    @classmethod
    def build(cls, bits: np.ndarray) -> Plane:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        packed = np.packbits(bits, bitorder="little")
        blocks = [packed[low : low + BLOCK // 8] for low in range(0, len(packed), BLOCK // 8)]
        ones = [int(np.bitwise_count(x).sum(dtype=np.int64)) for x in blocks]
        return cls([squeeze(x.tobytes()) for x in blocks], np.concatenate([[0], np.cumsum(ones, dtype=np.int64)]), len(bits))

    def _bytes(self, i: int) -> bytes:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(self.blocks[i])

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(words, ones before each word, all of them last) of one block; some are remembered."""
        if i not in self.opened:
            if len(self.opened) >= OPENED:
                self.opened.clear()
            raw = self._bytes(i)
            words = np.frombuffer(raw + bytes(8 + -len(raw) % 8), "<u8")
            counts = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self.opened[i] = words, self.before[i] + np.concatenate([[0], counts[:-1]])
        return self.opened[i]

    def look(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bit, ones before) at some positions up to `n`."""
        bit, ones = np.zeros(len(at), bool), np.full(len(at), self.before[-1])
        inside = np.minimum(at // BLOCK, len(self.blocks))
        for i in np.unique(inside).tolist():
            if i < len(self.blocks):
                mine = np.flatnonzero(inside == i)
                words, before = self.block(i)
                place = at[mine] - i * BLOCK
                word, low = words[place >> 6], (place & 63).astype(np.uint64)
                bit[mine] = word >> low & np.uint64(1)
                ones[mine] = before[place >> 6] + np.bitwise_count(word & (np.uint64(1) << low) - np.uint64(1))
        return bit, ones

    def find(self, one: bool, nth: int) -> int:
        """Position of the `nth` (from 0) set or unset bit, which must exist."""
        sums = self.before if one else np.minimum(np.arange(len(self.before)) * BLOCK, self.n) - self.before
        i = int(np.searchsorted(sums, nth, "right")) - 1
        words, before = self.block(i)
        sums = before if one else i * BLOCK + np.arange(len(words)) * 64 - before
        w = int(np.searchsorted(sums, nth, "right")) - 1
        bits = np.unpackbits(words[w : w + 1].view(np.uint8), bitorder="little") == one
        return i * BLOCK + w * 64 + int(np.flatnonzero(bits)[nth - int(sums[w])])

    def bits(self) -> np.ndarray:
        whole = np.frombuffer(b"".join(self._bytes(i) for i in range(len(self.blocks))), np.uint8)
        return np.unpackbits(whole, count=self.n, bitorder="little").view(bool)


class WaveletMatrix:
    """Rank, select and access over a sequence of ids below 2**levels."""

    def __init__(self, planes: list[Plane], zeros: list[int], n: int):
        self.planes, self.zeros, self.n, self.levels = planes, zeros, n, len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        planes, zeros, now = [], [], ids
        for level in reversed(range(levels)):
            bits = (now >> level & 1).astype(bool)
            planes.append(Plane.build(bits))
            low = np.flatnonzero(~bits)
            zeros.append(len(low))
            now = np.concatenate([now[low], now[np.flatnonzero(bits)]])
        return cls(planes, zeros, len(ids))

    def access(self, at) -> np.ndarray:
        """The ids at some positions."""
        at = np.asarray(at, np.int64)
        out = np.zeros(at.shape, np.int64)
        for k, plane in enumerate(self.planes):
            bit, ones = plane.look(at)
            out = out << 1 | bit
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return out

    def _range(self, symbol: int, end: int) -> list[tuple[int, int]]:
        """The ranges that the occurrences of `symbol` before `end` lie in, from plane to plane."""
        low, high, out = 0, end, [(0, end)]
        for k, plane in enumerate(self.planes):
            a, b = plane.look(np.array([low, high]))[1].tolist()
            one = symbol >> (self.levels - 1 - k) & 1
            low, high = (self.zeros[k] + a, self.zeros[k] + b) if one else (low - a, high - b)
            out.append((low, high))
        return out

    def rank(self, symbol: int, end: int) -> int:
        """Occurrences of `symbol` before position `end`."""
        low, high = self._range(symbol, end)[-1]
        return high - low

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, nth: int) -> int:
        """Position of the `nth` (from 0) occurrence of `symbol`, -1 if there are fewer."""
        low, high = self._range(symbol, self.n)[-1]
        if not 0 <= nth < high - low:
            return -1
        at = low + nth
        for k in reversed(range(self.levels)):
            one = bool(symbol >> (self.levels - 1 - k) & 1)
            at = self.planes[k].find(one, at - self.zeros[k] if one else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids, plane by plane from the last."""
        now = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for k in reversed(range(self.levels)):
            bits, out = self.planes[k].bits(), np.empty_like(now)
            out[np.flatnonzero(~bits)] = now[: self.zeros[k]]
            out[np.flatnonzero(bits)] = now[self.zeros[k] :] | now.dtype.type(1 << (self.levels - 1 - k))
            now = out
        return now


def pack_shard(ids: np.ndarray, doc_ids: list, lengths: list[int], levels: int) -> bytes:
    """One shard: magic, header length, JSON header, the documents' sections, then each plane's directory and its blocks."""
    import zstandard

    matrix = WaveletMatrix.build(ids, levels)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    has_id = np.array([d is not None for d in doc_ids], bool)
    about = [np.array([d or 0 for d in doc_ids], "<i8"), np.packbits(has_id), np.array(lengths, "<i8")]
    sections = [squeeze(x.tobytes()) for x in about]
    for plane in matrix.planes:
        sizes = np.array([len(x) for x in plane.blocks], "<i8")
        sections.append(squeeze(np.concatenate([plane.before.astype("<i8"), sizes]).tobytes()))
        sections.append(b"".join(plane.blocks))
    info = {"n": matrix.n, "docs": len(doc_ids), "zeros": matrix.zeros, "sections": [len(x) for x in sections]}
    head = json.dumps(info).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *sections])


def unpack_shard(blob: bytes) -> tuple[WaveletMatrix, list, np.ndarray]:
    """(matrix, document ids, lengths) of one shard; blocks of planes stay compressed until they are asked for."""
    import zstandard

    if blob[:4] != MAGIC:
        raise ValueError("not a shard")
    size = struct.unpack_from("<I", blob, 4)[0]
    head, at, view, parts = json.loads(blob[8 : 8 + size]), 8 + size, memoryview(blob), []
    for n in head["sections"]:
        parts.append(view[at : at + n])
        at += n
    open_ = zstandard.ZstdDecompressor().decompress
    has_id = np.unpackbits(np.frombuffer(open_(parts[1]), np.uint8), count=head["docs"])
    doc_ids = [int(d) if h else None for d, h in zip(np.frombuffer(open_(parts[0]), "<i8"), has_id, strict=True)]
    planes = []
    for directory, data in zip(parts[3::2], parts[4::2], strict=True):
        numbers = np.frombuffer(open_(directory), "<i8")
        before, ends = numbers[: len(numbers) // 2 + 1], np.cumsum(numbers[len(numbers) // 2 + 1 :]).tolist()
        blocks = [data[low:high] for low, high in zip([0, *ends], ends, strict=False)]
        planes.append(Plane(blocks, before, head["n"]))
    return WaveletMatrix(planes, head["zeros"], head["n"]), doc_ids, np.frombuffer(open_(parts[2]), "<i8")


class _Places(dict):
    """Piece of a word to its place, -1 for unknown ones."""

    def __missing__(self, word: str) -> int:
        return -1


def _gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slices of `flat` one after another, their bounds)."""
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return flat[np.repeat(starts - bounds[:-1], lengths) + np.arange(bounds[-1])], bounds


class WordEncoder:
    """Encodes texts with the tokenizers library, each distinct piece of a word once.

    Texts of ASCII and Latin-1 letters are lower-cased and cut into words, and distinct words into pieces, by Arrow, as
    the tokenizer itself cuts them, which is checked when it is loaded; the library encodes pieces that haven't been
    seen, many in one text. Other texts, and texts that might hold a special token, go to the library whole.
    """

    # The tokenizer's own pattern, over the letters of plain texts without white space.
    PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+"
    PLAIN = r"^[\t\n\r\x0b\x0c\x20-\x7eÀ-ÖØ-öø-ÿ]*$"
    NORMALIZERS = ["NFC", "Replace", "Lowercase"]
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        norm = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.cuts = norm == self.NORMALIZERS and pre[0].get("pattern", {}).get("Regex") == self.PATTERN
        self.special = [t["content"] for t in spec["added_tokens"]]
        size = self.tokenizer.get_vocab_size()
        self.levels, self.dtype = max(1, (size - 1).bit_length()), np.uint16 if size <= 1 << 16 else np.uint32
        suffix = spec["model"].get("end_of_word_suffix") or "\0"
        self.ends_word = np.zeros(size, bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.clear()

    def clear(self):
        self.place, self.bytes = _Places(), 0
        self.flat = np.empty(0, self.dtype)
        self.starts, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, pieces: pa.Array):
        """Adds some pieces of words; they go to the library many in one text, and come apart at their ends."""
        names, flat, lengths = pieces.to_pylist(), [self.flat], [self.lengths]
        for low in range(0, len(names), 1000):
            part = names[low : low + 1000]
            found = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids
            found = np.array(found, self.dtype)
            ends = np.flatnonzero(self.ends_word[found]) + 1
            if len(ends) == len(part):
                lengths.append(np.diff(ends, prepend=0))
            else:  # a piece that the library cuts further
                each = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                found = np.fromiter(chain.from_iterable(each), self.dtype)
                lengths.append(np.array([len(x) for x in each], np.int64))
            flat.append(found)
        self.flat, self.lengths = np.concatenate(flat), np.concatenate(lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.place.update(zip(names, range(len(self.place), len(self.place) + len(names)), strict=True))
        self.bytes += pc.sum(pc.binary_length(pieces)).as_py() or 0

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Places of distinct pieces, after those not known were learned."""
        at = np.fromiter(map(self.place.__getitem__, pieces.to_pylist()), np.int64, len(pieces))
        unknown = np.flatnonzero(at < 0)
        if not len(unknown):
            return at
        new = pieces.take(pa.array(unknown))
        more = pc.sum(pc.binary_length(new)).as_py()
        if len(self.place) + len(new) > PIECE_MEMORY or self.bytes + more > BYTE_MEMORY:
            self.clear()
            self._learn(pieces)
            return np.arange(len(pieces))
        at[unknown] = np.arange(len(self.place), len(self.place) + len(unknown))
        self._learn(new)
        return at

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of distinct lower-case words, one after another."""
        pieces, bounds = flat_words(pc.replace_substring_regex(words, self.PIECES, r"\0 "))
        coded = pieces.view(pa.string()).dictionary_encode()
        at = self._places(coded.dictionary)[coded.indices.to_numpy()]
        ids, ends = _gathered(self.flat, self.starts[at], self.lengths[at])
        return ids, np.diff(ends[bounds])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths): the ids of all texts, none of them null, one after another."""
        texts = texts.cast(pa.string())
        plain = np.full(len(texts), self.cuts)
        if self.cuts:
            plain = pc.match_substring_regex(texts, self.PLAIN).to_numpy(zero_copy_only=False)
            for s in self.special:
                plain = plain & ~pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(~plain)
        words, bounds = flat_words(pc.utf8_lower(texts.filter(pa.array(plain)) if len(whole) else texts))
        coded = words.view(pa.string()).dictionary_encode()
        flat, lengths = self._encode_words(coded.dictionary)
        at = coded.indices.to_numpy()
        ids, ends = _gathered(flat, (np.cumsum(lengths) - lengths)[at], lengths[at])
        upto = ends[bounds]
        if not len(whole):
            return ids, np.diff(upto)
        rest = self.tokenizer.encode_batch_fast(texts.take(pa.array(whole)).to_pylist(), add_special_tokens=False)
        rest, cut = iter(rest), iter(np.split(ids, upto[1:-1]) if len(upto) > 1 else [])
        each = [next(cut) if p else np.array(next(rest).ids, self.dtype) for p in plain.tolist()]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)


@functools.cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_shards(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes `docs`, writes the shard table in document order to the shared folder and returns it as read back."""
    lean_batches(docs.sparkSession)

    def run(batches):
        enc, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, doc_ids, lengths, total = [], [], [], 0

        def shard():
            blob = pack_shard(np.concatenate(ids), doc_ids, lengths, enc.levels)
            row = {"part": part, "number": number, "n_docs": len(doc_ids), "n_tokens": total, "blob": blob}
            return pa.RecordBatch.from_pylist([row], schema=_SHARD)

        for b in batches:
            for low, high in slices(b.column(1)):
                keys = b.column(0).slice(low, high - low).to_pylist()
                found, sizes = enc.encode(b.column(1).slice(low, high - low))
                ends = np.cumsum(sizes)
                # the end id after each document
                found, ends = np.insert(found, ends, END_ID), (ends + np.arange(1, len(ends) + 1)).tolist()
                at = first = 0
                for i, end in enumerate(ends):
                    start = ends[i - 1] if i else 0
                    if total and total + end - start > shard_tokens:
                        ids.append(found[at:start])
                        doc_ids += keys[first:i]
                        yield shard()
                        number, at, first = number + 1, start, i
                        ids, doc_ids, lengths, total = [], [], [], 0
                    lengths.append(end - start)
                    total += end - start
                ids.append(found[at:])
                doc_ids += keys[first:]
        if doc_ids:
            yield shard()

    rows = docs.select(F.col(key).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.repartitionByRange("d", F.xxhash64("t")).sortWithinPartitions("d", F.xxhash64("t"), "t")
    path = new_path(docs.sparkSession, "shards")
    rows.mapInArrow(run, _SHARD_DDL).write.option("compression", "none").parquet(path)
    return open_shards(docs.sparkSession, path)


def open_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SHARD_DDL).parquet(path)


def documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, all from the shard table."""

    def run(batches):
        for b in batches:
            for part, number, blob in zip(b.column(0), b.column(1), b.column(2), strict=True):
                matrix, doc_ids, lengths = unpack_shard(blob.as_py())
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part.as_py()] * n, pa.int32()), "number": pa.array([number.as_py()] * n, pa.int32()), "doc_id": pa.array(doc_ids, pa.int64()), "inside": pa.array(ends - lengths, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("part", "number", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    rows = shards.select("part", "number", "blob").mapInArrow(run, "part int, number int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    rows = rows.join(bases, ["part", "number"])
    return rows.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
