"""Cross-tokenizer alignment against a brute-force version that looks at every pair of tokens."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from dealweave.llm import align, queries


def brute(texts):
    """The contract's columns for each text, by offsets and all pairs, with another library for A's ids."""
    import public_tokenizers
    import sentencepiece
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    a = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out, holders = [], Counter()
    for t in texts:
        groups, links, ids_a, ids_b = [], [], [], []
        whole = b" " + (t or "").encode()
        if t:
            ids_a, ids_b = a.encode_ordinary(" " + t), b.encode(t)
            bytes_a = [a.decode_single_token_bytes(i) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
                ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
            spans = []
            for tokens in (bytes_a, bytes_b):
                ends = np.cumsum([0, *map(len, tokens)]).tolist()
                spans.append(list(zip(ends, ends[1:], strict=False)))
            links = [(ids_a[i], ids_b[j]) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
            cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
            start = 0
            for cut in cuts:
                groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, span, strict=True) if s >= start and e <= cut) for ids, span in zip((ids_a, ids_b), spans, strict=True)))
                start = cut
        out.append((len(ids_a), len(ids_b), groups, links))
        holders.update(set(links))
    most = defaultdict(int)
    for (x, _), n in holders.items():
        most[x] = max(most[x], n)
    return [
        (n_a, n_b, len(groups), len(links), sum(holders[x] == most[x[0]] for x in links), sum(holders[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for n_a, n_b, groups, links in out
    ]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    words = ["the", "Straße", "niño", "tokenization", "日本語", "\U0001f600", "x1y2", "don't", "<|endoftext|>", "<0x41>", "  ", "\n\n", "\t", "\u0000", "é", "123456", "...", "</s>"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    return out + [None, "", " ", "\n", "a", "▁", "x▁y", "same text here", "same text here", "​", "z" * 700, " lead", "trail ", "﻿bom", "\r\n"]


def check(df, ids, texts):
    found = sorted((tuple(r) for r in df.select("doc_id", *align.RESULTS).collect()), key=str)
    assert found == sorted(((i, *x) for i, x in zip(ids, brute(texts), strict=True)), key=str)


def test_brute(spark, texts):
    ids = [*range(len(texts) - 2), 7, None]
    rows = [(i, t, "clash", 1, "x") for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, pair int, n_a string").repartition(3)
    check(align.align(docs, queries.byte_tokenizer_path(), queries.piece_model_path()), ids, texts)
    empty = spark.createDataFrame([], docs.schema)
    assert align.align(empty, queries.byte_tokenizer_path(), queries.piece_model_path()).count() == 0


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64])
def test_pieces(texts, piece, monkeypatch):
    """Pieces of any size give the same overlaps and groups, each with its share of the ends."""
    both = align.pair(queries.byte_tokenizer_path(), queries.piece_model_path())
    ids = both.encode(pa.array(texts))
    whole = align._aligned(*ids, both)
    monkeypatch.setattr(align, "PIECE", piece)
    cut = align._aligned(*ids, both)
    for x, y in zip(whole, cut, strict=True):
        assert np.array_equal(x, y)
    ends = [np.cumsum(n[flat]) for n, flat in ((both.a_length, ids[0]), (both.b_length, ids[2]))]
    low, lower = align.diagonals(*ends, piece)
    assert set(np.diff(low + lower)[:-1]) == {piece}
    order = np.argsort(np.concatenate(ends), kind="stable")
    assert np.array_equal(low, np.concatenate([[0], np.cumsum(order < len(ends[0]))])[low + lower])


def test_blocks(texts):
    """Documents added in parts are one block with one list of pairs."""
    both, block = align.pair(queries.byte_tokenizer_path(), queries.piece_model_path()), align._Block()
    parts = [align._aligned(*both.encode(pa.array(texts[k : k + 5])), both) for k in range(0, len(texts), 5)]
    for k, part in enumerate(parts):
        block.add(list(range(5 * k, min(5 * k + 5, len(texts)))), part, 100)
    row = block.row(3).to_pylist()[0]
    assert row["doc_id"] == list(range(len(texts))) and row["upto"][-1] == sum(len(p[2]) for p in parts)
    held = Counter(x for p in parts for x in p[2].tolist())
    assert dict(zip(row["pairs"], row["docs"], strict=True)) == dict(held)


def test_words_stand_alone(monkeypatch):
    """Texts put together from remembered words have the ids of the libraries, whatever stands around the words, also after the memory was cleared."""
    both, rng = align.pair(queries.byte_tokenizer_path(), queries.piece_model_path()), random.Random(6)
    words = ["don't", "'s", "a", "É", "été", "x\ny", "1", "12ab", "...", "-", "日本", "a日", "日a", "", "\t", "a\t", "\u00a0b", "ж", "¿que?", "…", "x▁y", "▁", "<s>", "ab\u3000cd", "\u2028"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    monkeypatch.setattr(align, "MEMORY", 1000)
    for k in range(0, len(texts), 500):
        part = texts[k : k + 500]
        a, n_a, b, n_b = both.encode(pa.array(part))
        want_a, want_b, ok = both.encode_each(part, " ")
        assert a.tolist() == [i for x, y in zip(want_a, ok, strict=True) if y for i in x] and b.tolist() == [i for x, y in zip(want_b, ok, strict=True) if y for i in x]
        assert n_a.tolist() == [len(x) * int(y) for x, y in zip(want_a, ok, strict=True)] and n_b.tolist() == [len(x) * int(y) for x, y in zip(want_b, ok, strict=True)]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in rows if len(r["text"] or "") < 3000][:60]
    docs = spark.createDataFrame(short, "doc_id long, text string")
    check(align.align(docs, queries.byte_tokenizer_path(), queries.piece_model_path()), [r["doc_id"] for r in short], [r["text"] for r in short])
    assert queries.op12_alignment(spark, d).count() == len(rows)
