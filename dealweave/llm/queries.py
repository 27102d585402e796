"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealweave.llm import align, chat, embed, html, kernel, mixing, pii, piece, quality, simhash, substring, trie, wavelet
from dealweave.llm.common import read_table, written


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text"))
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").union(extra)
    read = chat.read_back(chat.format_chats(chat.as_tree(rows)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(F.array_join("learned", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("learned", ""), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract_pages(read_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet.write_shards(read_table(spark, sf_dir, "documents"), word_tokenizer_path())
    return wavelet.documents(shards)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.judge(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pii.session_key(spark)).select("row.doc_id", "row.text", "n_found")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece.digests(read_table(spark, sf_dir, "documents"), piece_model_path())


def op11_kernel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def byte_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(read_table(spark, sf_dir, "documents"), byte_tokenizer_path(), piece_model_path())


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv = F.col("conv_id").cast("long")
    plan = turns.select(conv.alias("conv_id")).distinct().select("conv_id", (conv - F.pmod(conv, F.lit(5))).alias("base_id"), (F.crc32(conv.cast("string")) % 9).alias("head"))
    return trie.prefix_trie(turns, plan)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_chat": op1_chat,
    "op2_html": op2_html,
    "op3_mixing": op3_mixing,
    "op4_wavelet": op4_wavelet,
    "op5_quality_rules": op5_quality_rules,
    "op6_embeddings": op6_embeddings,
    "op7_pii": op7_pii,
    "op8_simhash": op8_simhash,
    "op9_substring": op9_substring,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_kernel_quality": op11_kernel_quality,
    "op12_alignment": op12_alignment,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": pipeline,
}

_WORDS_SQL = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _quality_sql() -> str:
    """The quality rules over `documents`, whose ids are unique and set."""
    words = ", ".join(f"('{lang}', {i}, '{w}')" for lang, ws in quality.COMMON_WORDS.items() for i, w in enumerate(ws))
    term = "(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END) / 2"
    return f"""
        WITH lists(lang, bin, word) AS (VALUES {words}), d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS_SQL} AS ws FROM documents),
        s1 AS (SELECT *, regexp_replace(text, '[\\p{{Ll}}]+', '', 'g') AS a FROM d), s2 AS (SELECT *, regexp_replace(a, '[\\x20\\x09-\\x0D]+', '', 'g') AS b FROM s1), s3 AS (SELECT *, regexp_replace(b, '\\p{{L}}+', '', 'g') AS c FROM s2),
        s4 AS (SELECT *, regexp_replace(c, '\\p{{Nd}}+', '', 'g') AS e FROM s3), s5 AS (SELECT *, regexp_replace(e, '[.,;:!?''"()\\-]+', '', 'g') AS f FROM s4),
        cls AS (SELECT doc_id, lang, unnest([length(text) - length(a), length(b) - length(c), length(c) - length(e), length(a) - length(b), length(e) - length(f), length(f)]) AS n, unnest([0, 1, 2, 3, 4, 5]) AS bin FROM s5),
        cref AS (SELECT lang, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM cls WHERE lang IN (SELECT lang FROM lists) GROUP BY 1, 2), call AS (SELECT bin, sum(n) / sum(sum(n)) OVER () AS q FROM cls GROUP BY 1),
        cp AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p, coalesce(cref.q, call.q) AS q FROM cls JOIN call USING (bin) LEFT JOIN cref ON cref.lang = cls.lang AND cref.bin = cls.bin),
        cd AS (SELECT doc_id, sqrt(greatest(sum({term.format(p="p", q="q")}), 0)) AS dist FROM cp GROUP BY 1),
        tok AS (SELECT doc_id, lang, unnest(ws) AS word FROM d), hit AS (SELECT doc_id, bin, count(*) AS n FROM tok JOIN lists ON lists.lang = tok.lang AND lists.word = lower(tok.word) GROUP BY 1, 2),
        com AS (SELECT d.doc_id, d.lang, lists.bin, coalesce(n, 0) AS n FROM d JOIN lists ON lists.lang = d.lang LEFT JOIN hit ON hit.doc_id = d.doc_id AND hit.bin = lists.bin
            UNION ALL SELECT d.doc_id, d.lang, 999, len(ws) - coalesce((SELECT sum(n) FROM hit WHERE hit.doc_id = d.doc_id), 0) FROM d WHERE lang IN (SELECT lang FROM lists)),
        wref AS (SELECT lang, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM com GROUP BY 1, 2), wp AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p, q FROM com JOIN wref USING (lang, bin)),
        wd AS (SELECT doc_id, sqrt(greatest(sum({term.format(p="p", q="q")}), 0)) AS dist FROM wp GROUP BY 1),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM d WHERE len(ws) >= 5)),
        rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1) GROUP BY 1),
        base AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
            CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, length(text) AS chars
            FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d) LEFT JOIN rep USING (doc_id)),
        failed AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND NOT coalesce(chars >= {quality.MIN_CHARS_FOR_CLASSES} AND cd.dist > {quality.MAX_CLASS_DISTANCE}, false) AND NOT coalesce(n_words >= {quality.MIN_WORDS_FOR_COMMON} AND wd.dist > {quality.MAX_COMMON_DISTANCE}, false) AS kept
        FROM failed LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id)
    """


#: CRC-32 of a decimal number, bit by bit.
_CRC_SQL = """xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda x: [CAST(256 + ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x & 255) >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384 ELSE 0 END)))"""

ORACLES: dict[str, str] = {
    "op13_prefix_trie": f"""
        WITH own AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
        plan AS (SELECT c, c - ((c % 5) + 5) % 5 AS b, {_CRC_SQL.format(c="c")} % 9 AS h FROM own),
        rebuilt AS (SELECT plan.c, list_concat(coalesce(base.ts, [])[1:h], own.ts[h + 1:]) AS ts FROM plan JOIN own USING (c) LEFT JOIN own AS base ON base.c = plan.b),
        members AS (SELECT c, ts[1:d] AS p, d, d = len(ts) AS at_end FROM (SELECT c, ts, unnest(generate_series(0, len(ts))) AS d FROM rebuilt)),
        nodes AS (SELECT p, min(c) AS conv_id, min(d) AS depth, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (at_end), '')) AS ends_sha256 FROM members GROUP BY p),
        kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
        spread AS (SELECT p[1:d] AS p, sum(own) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM (
            SELECT nodes.p, unnest(generate_series(0, depth)) AS d, kids.p IS NULL AS leaf, CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(nodes.p[-1].t) ELSE 0 END AS own FROM nodes LEFT JOIN kids ON kids.p = nodes.p) GROUP BY 1)
        SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM nodes n JOIN spread ON spread.p = n.p LEFT JOIN kids ON kids.p = n.p LEFT JOIN nodes up ON n.depth > 0 AND up.p = n.p[1:n.depth - 1]
    """,
    "op5_quality_rules": _quality_sql(),
    "op9_substring": f"""
        WITH w AS (SELECT doc_id, {_WORDS_SQL} AS ws FROM documents),
        s AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM (SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM w WHERE len(ws) >= 20))),
        cut AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS pos FROM s WHERE n > 1), tok AS (SELECT doc_id, unnest(ws) AS word, CAST(generate_subscripts(ws, 1) AS BIGINT) AS pos FROM w),
        r AS (SELECT doc_id, count(*) AS n FROM cut GROUP BY 1), k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t FROM tok ANTI JOIN cut USING (doc_id, pos) GROUP BY 1)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
    """,
    "op1_chat": """
        WITH rows AS (
            SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
        ), parts AS (
            SELECT *, length(replace(replace(replace(text, '\\', '\\0'), '###', '\\1'), '</turn>', '\\2'))
                + length(replace(replace(replace(replace(role, '\\', '\\0'), '###', '\\1'), '</turn>', '\\2'), ':', '\\3')) + 14 AS part_chars
            FROM rows
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(part_chars) AS BIGINT) AS formatted_chars
        FROM parts GROUP BY conv_id
    """,
}
