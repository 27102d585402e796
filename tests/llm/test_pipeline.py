"""The pipeline's stages against brute force on a small corpus with odd rows."""

from collections import Counter

import corpus_pipeline
import sentencepiece

from dealweave.llm import pii, quality, queries
from dealweave.llm.common import written
from tests.llm.test_operators import SCHEMA, brute_text, docs, empty, fingerprint, texts, water_fill, words_of  # noqa: F401


def near(a, b):
    return (a ^ b).bit_count() <= 2


def test_stages(spark, docs):  # noqa: F811
    now, key = docs, pii.session_key(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, now, ""))
        assert after.columns == docs.columns, name
        before, left = now.select("doc_id", "text", "source").collect(), after.select("doc_id", "text", "source").collect()
        if "quality" in name:
            verdict = {r["doc_id"]: r["kept"] for r in quality.judge(now.drop("kept")).collect()}
            for r in before:
                w, covered = words_of(r["text"]), set()
                seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
                for i in range(len(w) - 4):
                    covered |= set(range(i, i + 5)) if seen[tuple(w[i : i + 5])] > 1 else set()
                if len(w) < 10 or 100 * len(covered) > 20 * len(w):
                    assert not verdict[r["doc_id"]]
            assert sorted(map(str, left)) == sorted(str(r) for r in before if verdict[r["doc_id"]])
        elif "SimHash" in name:
            rows = sorted(before, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
            prints, group = [fingerprint(r["text"]) for r in rows], list(range(len(rows)))
            for _ in rows:
                for i in range(len(rows)):
                    group[i] = min(group[j] for j in range(len(rows)) if near(prints[i], prints[j]))
            assert sorted(r["doc_id"] for r in left) == sorted(rows[i]["doc_id"] for i in set(group))
            assert {(r["doc_id"], r["text"]) for r in left} <= {(r["doc_id"], r["text"]) for r in rows}
        elif name == "PII":
            number = brute_text(" (988) 555-2485", key, "phone")
            want = [(r["doc_id"], r["text"].replace("+1 (988) 555-2485", "+1" + number)) for r in before]
            assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["text"])) for r in left)
        else:
            sizes, taken, most = Counter(), Counter(), Counter()
            for r in before:
                sizes[r["source"]] += len(words_of(r["text"]))
            for r in left:
                taken[r["source"]] += len(words_of(r["text"]))
                most[r["source"]] = max(most[r["source"]], len(words_of(r["text"])))
            assert all(abs(taken[s] - goal) <= 2 * most[s] for s, goal in water_fill(sizes).items())
            times = Counter((r["doc_id"], r["text"]) for r in left)
            assert max(times.values()) <= 3 and set(times) <= {(r["doc_id"], r["text"]) for r in before}
        now = after
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model_path())
    coded = corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
    want = [(r["doc_id"], len(sp.encode(r["text"]))) for r in now.collect()]
    assert sorted((r["doc_id"], r["n_tokens"]) for r in coded) == sorted(want)


def test_empty(spark, empty):  # noqa: F811
    now = empty
    for _, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, ""))
    assert now.count() == 0 and SCHEMA
