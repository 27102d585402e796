"""Quality rules by distribution divergence, in DataFrame functions only.

Every text gives two histograms: its characters by class, and its words over the common words of its
language. Both are held against references of the language, which are sums over the whole corpus, by
Jensen-Shannon distance (base 2, so 0 to 1). Texts under a minimum length are not judged by it. The texts are read
once: their counts are written, and references and verdicts come from that small table.

Defined results: a null or empty text has no words and fails the base rules; a null or unlisted
language is compared by characters alone, with all languages together as its reference; repeated rows
and ids get the same verdict each, as nothing is grouped by id; extra columns are passed through, those
with the name of a result give way to it in `judge` and stay in `keep_good`; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave.llm.common import SPACES, word_array, written

# Common words by language.
COMMON_WORDS = {
    "en": "the of and to in a is that was it for on are as with by at from this be or an".split(),
    "de": "die der und in den von zu das mit sich des auf für ist im dem nicht ein eine es".split(),
    "fr": "de la le et les des en un une du que est pour qui dans sur pas au avec par".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo".split(),
}
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Guards: shorter texts are not judged by the histogram.
MIN_CHARS_FOR_CLASSES = 200
MIN_WORDS_FOR_COMMON = 100
MAX_CLASS_DISTANCE = 0.30
MAX_COMMON_DISTANCE = 0.30
CLASSES = ("lower", "upper", "digit", "space", "mark", "other")
RESULTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "class_distance", "common_distance", "base_failed", "kept",
)


def _by_language(values: dict, lang) -> F.Column:
    chosen = F.lit(None)
    for key, value in values.items():
        chosen = F.when(lang == key, value).otherwise(chosen)
    return chosen


def _histograms(rows: DataFrame) -> DataFrame:
    """Adds q_classes (counts by character class) and q_common (counts by common word, others last; null for unlisted
    languages) to rows with q_text, q_words and q_lang."""
    # each class is cut out of what the classes before it have left
    out = rows.withColumn("q_a", F.regexp_replace("q_text", "[\\p{Ll}]+", ""))
    for name, left, pattern in (
        ("q_b", "q_a", SPACES), ("q_c", "q_b", "\\p{L}+"), ("q_d", "q_c", "\\p{Nd}+"), ("q_e", "q_d", "[.,;:!?'\"()\\-]+"),
    ):
        out = out.withColumn(name, F.regexp_replace(left, pattern, ""))
    size = [F.length(x) for x in ("q_text", "q_a", "q_b", "q_c", "q_d", "q_e")]
    lower, space, upper, digit, mark = (size[i] - size[i + 1] for i in range(5))
    out = out.withColumn("q_classes", F.array(*(x.cast("long") for x in (lower, upper, digit, space, mark, size[5]))))

    def places(words):
        listed = F.filter("q_words", lambda w: F.lower(w).isin(*words))
        return F.transform(listed, lambda w: F.array_position(F.array(*map(F.lit, words)), F.lower(w)).cast("int"))

    out = out.withColumn("q_place", _by_language({k: places(v) for k, v in COMMON_WORDS.items()}, F.col("q_lang")))
    most = max(map(len, COMMON_WORDS.values()))
    hits = [(F.size("q_place") - F.size(F.array_remove("q_place", i + 1))).cast("long") for i in range(most)]
    others = (F.size("q_words") - F.size("q_place")).cast("long")
    out = out.withColumn("q_common", F.when(F.col("q_place").isNotNull(), F.array(*hits, others)))
    return out.drop("q_a", "q_b", "q_c", "q_d", "q_e", "q_place")


def _repeats(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words covered by a window of five words that the text holds twice or more."""
    n = F.size("q_words")

    def following(column, by):
        return F.slice(column, by + 1, F.greatest(n, F.lit(1)))

    # hashes of runs of one, two, four and five words, each from shorter ones
    out = rows.withColumn("q_h1", F.transform("q_words", lambda w: F.xxhash64(w)))
    out = out.withColumn("q_h2", F.zip_with("q_h1", following("q_h1", 1), lambda a, b: F.xxhash64(a, b)))
    out = out.withColumn("q_h4", F.zip_with("q_h2", following("q_h2", 2), lambda a, b: F.xxhash64(a, b)))
    whole = F.zip_with("q_h4", following("q_h1", WINDOW - 1), lambda a, b: F.xxhash64(a, b))
    out = out.withColumn("q_win", F.slice(whole, F.lit(1), F.greatest(n - WINDOW + 1, F.lit(0))))
    ordered = F.sort_array(F.transform("q_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("q_sorted", F.when(F.size(F.array_distinct("q_win")) < F.size("q_win"), ordered))

    def twice(x, k):
        before, after = F.get("q_sorted", k - 1)["h"], F.get("q_sorted", k + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    starts = F.sort_array(F.transform(F.filter("q_sorted", twice), lambda x: x["i"]))
    out = out.withColumn("q_starts", F.when(F.col("q_sorted").isNotNull(), starts))
    until = lambda p, k: F.coalesce(F.get("q_starts", k + 1) - p, F.lit(WINDOW))
    covered = F.transform("q_starts", lambda p, k: F.least(F.lit(WINDOW), until(p, k)))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long")))
    return out.drop("q_h1", "q_h2", "q_h4", "q_win", "q_sorted", "q_starts")


def measured(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(q_row, q_lang, q_chars, q_classes, q_common and the base counts) of every row of `docs` (text, lang), in one pass
    over the texts, written; q_row has the columns `carry`, all by default."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.struct(*(docs.columns if carry is None else carry)).alias("q_row"),
        F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).alias("q_lang"),
        text.alias("q_text"),
        word_array(F.col("text")).alias("q_words"),
    )
    out = _repeats(_histograms(rows))
    lines = F.filter(F.split("q_text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = out.withColumn("q_lines", lines)
    spaces = F.get("q_classes", F.lit(CLASSES.index("space")))
    return written(
        out.select(
            "q_row", "q_lang", "q_classes", "q_common",
            F.length("q_text").alias("q_chars"),
            F.size("q_words").cast("long").alias("n_words"),
            (F.length("q_text") - spaces).cast("long").alias("word_chars"),
            F.length(F.regexp_replace("q_text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
            "n_repeat_words",
        ),
        "quality",
    )


def references(rows: DataFrame) -> dict:
    """Language to its two reference distributions: sums over all of the measured `rows`. As many rows as listed languages
    and one reach the driver."""
    most = max(map(len, COMMON_WORDS.values())) + 1
    sums = [F.sum(F.get("q_classes", F.lit(i))).alias(f"k{i}") for i in range(len(CLASSES))]
    sums += [F.sum(F.get("q_common", F.lit(i))).alias(f"w{i}") for i in range(most)]
    found = rows.groupBy("q_lang").agg(*sums).collect()

    def shares(counts):
        total = sum(counts)
        return [x / total for x in counts] if total else None

    classes = {r["q_lang"]: [r[f"k{i}"] or 0 for i in range(len(CLASSES))] for r in found}
    common = {r["q_lang"]: [r[f"w{i}"] or 0 for i in range(most)] for r in found}
    every = [sum(x) for x in zip(*classes.values(), strict=True)] if found else [0] * len(CLASSES)
    listed = {k: (shares(classes[k]), shares(common[k])) for k in classes if k is not None}
    return {None: (shares(every), None)} | listed


def js_distance(counts, shares) -> F.Column:
    """Jensen-Shannon distance, base 2, between an array of counts and an array of shares; null if either is null or empty of counts."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)

    def part(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def term(c, q):
        p = c / total
        return (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2

    summed = F.aggregate(F.zip_with(counts, shares, term), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.sqrt(F.greatest(summed, F.lit(0.0))))


def score(rows: DataFrame, refs: dict) -> DataFrame:
    """Measured `rows` with class_distance, common_distance (null where a guard holds), base_failed and kept."""

    def as_array(shares):
        return F.array(*map(F.lit, shares)) if shares else F.lit(None).cast("array<double>")

    lang, every = F.col("q_lang"), as_array(refs[None][0])
    classes = F.coalesce(_by_language({k: as_array(a) for k, (a, _) in refs.items() if k}, lang), every)
    common = _by_language({k: as_array(b) for k, (_, b) in refs.items() if k}, lang).cast("array<double>")
    judged = F.col("q_chars") >= MIN_CHARS_FOR_CLASSES
    repeats = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    out = rows.withColumns(
        {
            "class_distance": F.when(judged, js_distance(F.col("q_classes"), classes)),
            "common_distance": F.when(F.col("n_words") >= MIN_WORDS_FOR_COMMON, js_distance(F.col("q_common"), common)),
            "base_failed": (F.col("n_words") < MIN_WORDS) | repeats,
        }
    )
    far = F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE, F.lit(False))
    far = far | F.coalesce(F.col("common_distance") > MAX_COMMON_DISTANCE, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~far)


def judge(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of `docs`, all by default, with counts, distances and verdict, against references from `docs`."""
    rows = measured(docs, carry)
    own = [c for c in (docs.columns if carry is None else carry) if c not in RESULTS]
    return score(rows, references(rows)).select(*(F.col("q_row")[c].alias(c) for c in own), *RESULTS)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, with its own columns, whatever their names."""
    rows = measured(docs)
    return score(rows, references(rows)).where("kept").select("q_row.*")
