"""Text repair, rewriting, expansion and keyword extraction. Rules are tables or ordered lists of the user's."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealweave.functions.matching import shingles, words
from dealweave.sources.folders import stored


def repair(df: DataFrame, text: str, fixes: DataFrame, substrings: Sequence[tuple[str, str]] = (), accents: tuple[str, str] = ("", "")) -> DataFrame:
    """`df` with text lower-cased, accents mapped, listed substrings replaced (longest first) and whole words fixed from a table (wrong, right) of any size; rows stand alone, and equal texts are looked up once."""
    c = F.lower(F.coalesce(F.col(text), F.lit("")))
    c = F.translate(c, *accents) if accents[0] else c
    c = reduce(lambda a, p: F.replace(a, F.lit(p[0]), F.lit(p[1])), sorted(substrings, key=lambda p: (-len(p[0]), p[0])), c)
    base = df.withColumn(text, c)
    once = stored(fixes.groupBy(F.col("wrong").alias("_w")).agg(F.min("right").alias("_right")), "fixes")  # of known size
    digest = [F.md5(F.col(text)).alias("_t"), F.length(text).alias("_n")]
    words_of = base.select(*digest, F.explode(F.array_distinct(F.split(text, " "))).alias("_w"))
    # only texts with a wrong word meet the rows again
    changes = words_of.join(once, "_w").groupBy("_t", "_n").agg(F.map_from_entries(F.collect_set(F.struct("_w", "_right"))).alias("_fixes"))
    right = F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(F.col("_fixes")[w], w)), " ")
    rows = base.select("*", *digest).join(changes, ["_t", "_n"], "left")
    return rows.withColumn(text, F.when(F.col("_fixes").isNotNull(), right).otherwise(F.col(text))).select(*df.columns)


def join_phrases(df: DataFrame, text: str, phrases: Sequence[tuple[str, str]]) -> DataFrame:
    """Spaced variants to one token, longest first, at word bounds."""
    out = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    for phrase, token in sorted(phrases, key=lambda p: (-len(p[0].split()), -len(p[0]), p[0])):
        out = F.replace(out, F.lit(f" {phrase} "), F.lit(f" {token} "))
    return df.withColumn(text, F.trim(out))


def join_by_table(df: DataFrame, text: str, phrases: DataFrame, most: int = 4) -> DataFrame:
    """`df` with spaced variants of a table (phrase, token) of any size joined to their token, in lower case with single blanks: from the left, the longest phrase at each word.

    Runs of up to `most` words meet the table by equality, longer phrases never match. Only found runs are gathered, by a digest of
    their text and its length, and the rows meet the choice among them by the same; no word is dealt.
    The matches of a text are chosen in one pass from the left, a word is part of one only. Of several tokens of a phrase the first in
    order is taken. Null texts stay null.
    """
    tokens = F.array_remove(F.split(F.lower(text), r"\s+"), "")
    key = [F.unhex(F.md5(F.array_join("_ws", " "))).alias("_d"), F.size("_ws").alias("_n")]
    starts = F.transform("_ws", lambda w, i: F.struct(i.alias("at"), F.slice("_ws", i + 1, F.lit(most)).alias("run")))
    # the digest is made before a text is taken apart; an inner explode would have all starts made a second time, for a filter in which each cuts the text anew
    runs = df.select(tokens.alias("_ws")).select(*key, starts.alias("_s")).select("_d", "_n", F.explode_outer("_s").alias("s")).where("s IS NOT NULL")
    table = phrases.groupBy(F.array_join(F.array_remove(F.split(F.lower("phrase"), r"\s+"), ""), " ").alias("phrase")).agg(F.min("token").alias("token"))
    table = stored(table, "phrases")  # of known size: a short table goes to the runs, which are many times the texts
    # runs are made where a phrase may begin, as long as it may be
    firsts = stored(table.groupBy(F.split_part("phrase", F.lit(" "), F.lit(1)).alias("first")).agg(F.max(F.size(F.split("phrase", " "))).alias("longest")), "firsts")
    runs = runs.select("_d", "_n", "s.at", "s.run", F.get("s.run", F.lit(0)).alias("first")).join(firsts, "first")
    runs = runs.select("_d", "_n", "at", "run", F.explode(F.sequence(F.lit(1), F.least(F.size("run"), F.col("longest")))).alias("len"))
    runs = runs.select("_d", "_n", "at", "len", F.array_join(F.slice("run", F.lit(1), F.col("len")), " ").alias("phrase"))
    found = runs.join(table, "phrase").groupBy("_d", "_n").agg(F.sort_array(F.collect_set(F.struct("at", (-F.col("len")).alias("less"), "token"))).alias("_m"))
    # the longest at each place comes first; then from the left those that begin after the last chosen one
    state = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<at:int,less:int,token:string>>").alias("kept"))
    walk = lambda a, m: F.when(m["at"] >= a["free"], F.struct((m["at"] - m["less"]).alias("free"), F.concat(a["kept"], F.array(m)).alias("kept"))).otherwise(a)
    kept = found.select("_d", "_n", F.aggregate("_m", state, walk)["kept"].alias("_kept"))
    # the words up to each match and its token, then the words after the last
    before = lambda j: F.coalesce(F.get("_kept", j - 1)["at"] - F.get("_kept", j - 1)["less"], F.lit(0))
    own = lambda j: F.slice("_ws", before(j) + 1, F.coalesce(F.get("_kept", j)["at"], F.size("_ws")) - before(j))
    token = lambda j: F.when(j < F.size("_kept"), F.array(F.get("_kept", j)["token"])).otherwise(F.array().cast("array<string>"))
    pieces = F.transform(F.sequence(F.lit(0), F.size("_kept")), lambda j: F.concat(own(j), token(j)))
    # words are cut anew behind the join, so that the texts alone are dealt
    rows = df.withColumn("_ws", tokens).select(*df.columns, *key).join(kept, ["_d", "_n"], "left").withColumn("_ws", tokens)
    joined = F.when(F.col("_kept").isNotNull(), F.flatten(pieces)).otherwise(F.col("_ws"))
    return rows.withColumn(text, F.array_join(joined, " ")).select(*df.columns)


def normalize_name(c: Column, variants: Sequence[tuple[str, str]] = (), cut_words: Sequence[str] = (), brand: Column | None = None) -> Column:
    """Lower case, variants unified, brand and state words cut, and everything from an amount with a unit on."""
    out = F.lower(c)
    if brand is not None:
        out = F.replace(out, F.lower(F.coalesce(brand, F.lit("\0"))), F.lit(" "))
    out = reduce(lambda a, p: F.replace(a, F.lit(p[0]), F.lit(p[1])), variants, out)
    out = F.regexp_replace(out, r"\d+(?:[.,]\d+)?\s*(?:kg|g|dl|cl|ml|l|st|pcs)(?![a-z]).*$", "")
    if cut_words:
        out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(cut_words)})(?![\p{{L}}\p{{N}}])", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def rewrite_lines(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered regular-expression rewrites, one after another."""
    return F.trim(F.regexp_replace(reduce(lambda a, r: F.regexp_replace(a, r[0], r[1]), rules, c), r"\s+", " "))


def expand_lines(df: DataFrame, key: Sequence[str], line: str, bundles: Sequence[str] = ()) -> DataFrame:
    """(key, part_no, part): `a + b` to rows, `x (a/b)` to its alternatives, and bundle words to a row each where a line holds several."""
    c = F.col(line)
    inner = F.regexp_extract(c, r"^(.*?)\s*\(([^()/]{1,20})/([^()/]{1,20})\)\s*$", 0)
    alternatives = F.array(*(F.trim(F.concat(F.regexp_extract(c, r"^(.*?)\s*\(([^()/]{1,20})/([^()/]{1,20})\)\s*$", 1), F.lit(" "), F.regexp_extract(c, r"^(.*?)\s*\(([^()/]{1,20})/([^()/]{1,20})\)\s*$", i))) for i in (2, 3)))
    herbs = F.filter(words(c), lambda w: w.isin(*bundles)) if bundles else F.array().cast("array<string>")
    parts = F.when(c.contains(" + "), F.split(c, r" \+ ")).when(inner != "", alternatives).when(F.size(herbs) > 1, herbs).otherwise(F.array(c))
    return df.select(*key, F.posexplode(parts).alias("part_no", "part")).withColumn("part_no", F.col("part_no").cast("long"))


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


# Words of measure.
MEASURES = ("kg", "g", "dl", "cl", "ml", "l", "st", "tbsp", "tsp", "pcs")


def alternatives(c: Column, word: str = "or", usage: str | None = None, suffix: bool = False) -> Column:
    """`N x or y z`: branches at the word or after `e.g.`; the first branch's amount is copied to the others.

    With `usage`, a pattern of a trailing use (`to fry in`): found at the end of the last branch, it is said of all of them. With `suffix`,
    a last branch of more words than the first shares what follows its first word (`frozen or fresh berries`) with the branches that are
    shorter than it, unless the first has it, it holds a measure, or the last begins with a number or measure. The use is cut off before
    and set after the rest. With either, `N a, b or c` of single words has a branch for each.
    """
    measure = "|".join(MEASURES)
    amount = F.regexp_extract(c, rf"^(\d+(?:[.,]\d+)?(?: (?:{measure}))? )", 1)
    branches = F.when(c.contains(f" {word} "), F.split(c, f" {word} ")).when(c.contains("e.g. "), F.split(F.element_at(F.split(c, r"e\.g\. "), 2), ", ")).otherwise(F.array(c))
    if usage is None and not suffix:
        return F.transform(branches, lambda b: F.when((amount != "") & ~b.rlike(r"^\d"), F.concat(amount, b)).otherwise(b))
    n_words = lambda b: F.size(F.split(b, " "))

    def bare(x):
        """Branches without the first one's amount, which they get back at the end, and the branches of a measured list."""
        first = F.substring(x["branches"][0], F.length(x["amount"]) + 1, F.length(x["branches"][0]))
        leaves = F.split(first, ", *")
        single = F.forall(leaves, lambda y: y.rlike(r"^[^ ]+$")) & F.element_at(x["branches"], -1).rlike(r"^[^ ]+$")
        listed = (x["amount"] != "") & (F.size(x["branches"]) == 2) & (F.size(leaves) > 1) & single
        rest = F.slice(x["branches"], F.lit(2), F.size(x["branches"]))
        return F.struct(x["amount"].alias("amount"), F.when(listed, F.concat(leaves, rest)).otherwise(F.concat(F.array(first), rest)).alias("branches"))

    def without_use(x):
        """Adds tail, the use that the last branch ends with, and cuts it there."""
        end, n = F.element_at(x["branches"], -1), F.size(x["branches"])
        found = F.when(n > 1, F.regexp_extract(end, rf"(?: |^)({usage})$", 1)).otherwise("") if usage else F.lit("")

        def cut(tail):
            said = F.exists(F.slice(x["branches"], F.lit(1), F.greatest(n - 1, F.lit(0))), lambda y: y.contains(tail))
            apart = (tail != "") & ~said
            whole = F.when(apart, F.concat(F.slice(x["branches"], F.lit(1), n - 1), F.array(F.trim(F.substring(end, F.lit(1), F.length(end) - F.length(tail)))))).otherwise(x["branches"])
            return F.struct(x["amount"].alias("amount"), whole.alias("branches"), F.when(apart, tail).otherwise("").alias("tail"))

        return _let(found, cut)

    def with_suffix(x):
        """The branches with what follows the last one's first word."""
        head, end, n = x["branches"][0], F.element_at(x["branches"], -1), F.size(x["branches"])
        found = F.when((n > 1) & (n_words(end) > n_words(head)), F.regexp_extract(end, r"^[^ ]+ (.+)$", 1)).otherwise("")

        def shared(text):
            odd = F.arrays_overlap(F.split(text, " "), F.array(*map(F.lit, MEASURES))) | end.rlike(rf"^(?:\d|(?:{measure}) )") | head.contains(text)
            return F.transform(x["branches"], lambda y, i: F.when((i < n - 1) & (text != "") & ~odd & (n_words(y) < n_words(end)), F.concat(y, F.lit(" "), text)).otherwise(y))

        return F.struct(x["amount"].alias("amount"), _let(found, shared).alias("branches"), x["tail"].alias("tail")) if suffix else x

    def whole(x):
        measured = F.transform(x["branches"], lambda y: F.when((x["amount"] != "") & ~y.rlike(r"^\d"), F.concat(x["amount"], y)).otherwise(y))
        return F.transform(measured, lambda y: F.when(x["tail"] != "", F.concat(y, F.lit(" "), x["tail"])).otherwise(y))

    begin = F.struct(amount.alias("amount"), branches.alias("branches"))
    return F.when(c.isNotNull(), _let(_let(_let(_let(begin, bare), without_use), with_suffix), whole))


def merge_lines(df: DataFrame, group: str, order: str, line: str, word: str = "or") -> DataFrame:
    """(group, first order, line): a line that ends with the word, or whose next line is or starts with it, is joined with its neighbour."""
    w = Window.partitionBy(group).orderBy(order)
    text = F.trim(F.lower(line))
    ends = text.endswith(f" {word}") | (text == word)
    starts = text.startswith(f"{word} ") | (text == word)
    glued = F.coalesce(F.lag(ends).over(w), F.lit(False)) | (starts & F.lag(F.lit(True)).over(w).isNotNull())
    rows = df.withColumn("_island", F.sum(F.when(glued, 0).otherwise(1)).over(w))
    out = rows.groupBy(group, "_island").agg(F.min(order).alias(order), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line))), lambda x: x[line]), " ").alias(line))
    return out.drop("_island")


def extract_keywords(
    df: DataFrame, key: str | Sequence[str], text: str, stop: DataFrame, synonyms: DataFrame, keep_short: Sequence[str] = (), least: int = 3, most: int | None = None,
    compounds: DataFrame | None = None, implicit: DataFrame | None = None, parents: DataFrame | None = None, generic: DataFrame | None = None,
) -> DataFrame:
    """(key, keyword, pos): words without numbers, stop words (word) and short words, synonyms (word, canonical) applied, each once at its first place.

    With `most` (line side), keys with more keywords than that give none. A word after `not` or `without` is dropped. Further rules are
    tables: `compounds` (part, compound) drops a part where the compound stands in the same text, `implicit` (trigger, keyword) adds a keyword
    at its trigger, `parents` (word, parent) lifts keywords after the synonyms, and keys whose only keyword is in `generic` (word) give none.
    """
    keys = [key] if isinstance(key, str) else list(key)
    ws = df.select(*keys, words(F.col(text)).alias("_w"))
    before = F.slice(F.concat(F.array(F.lit("")), "_w"), F.lit(1), F.size("_w"))
    kept = F.zip_with("_w", before, lambda w, p: F.when(~p.isin("not", "without"), w))
    ws = ws.select(*keys, F.array_compact(kept).alias("_w"))
    rows = ws.select(*keys, F.posexplode("_w").alias("pos", "word"))
    rows = rows.where(((F.length("word") >= least) | F.col("word").isin(*keep_short)) & ~F.col("word").rlike(r"^\d"))
    # rule tables are stored, of known size: short ones go to the words, which are not dealt by word
    stop, synonyms = stored(stop.select("word"), "stop"), stored(synonyms.select("word", "canonical"), "synonyms")
    rows = rows.join(stop, "word", "left_anti")
    if compounds is not None:
        whole = rows.select(*keys, F.col("word").alias("compound")).join(compounds.select("part", "compound"), "compound")
        rows = rows.join(whole.select(*keys, F.col("part").alias("word")).distinct(), [*keys, "word"], "left_anti")
    if implicit is not None:
        more = rows.join(implicit.select(F.col("trigger").alias("word"), F.col("keyword").alias("_k")), "word")
        rows = rows.select(*keys, "pos", "word").unionByName(more.select(*keys, "pos", F.col("_k").alias("word")))
    rows = rows.join(synonyms.select("word", "canonical"), "word", "left").withColumn("word", F.coalesce("canonical", "word"))
    if parents is not None:
        rows = rows.join(parents.select("word", "parent"), "word", "left").withColumn("word", F.coalesce("parent", "word"))
    out = rows.groupBy(*keys, F.col("word").alias("keyword")).agg(F.min("pos").cast("long").alias("pos"))
    if most is not None:
        few = out.groupBy(*keys).count().where(F.col("count") <= most).select(*keys)
        out = out.join(few, keys, "left_semi")
    if generic is not None:
        alone = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("keyword").alias("word")).where("_n = 1").join(generic.select("word"), "word", "left_semi")
        out = out.join(alone.select(*keys), keys, "left_anti")
    return out


def offer_keywords(
    df: DataFrame, key: str, name: str, stop: DataFrame, synonyms: DataFrame, brand: str | None = None, completions: DataFrame | None = None, non_food: Column | None = None, **rules,
) -> DataFrame:
    """(key, keyword, pos) of product names, by the rules of `extract_keywords`.

    `non_food` rows give none. A brand of `completions` (brand, word) puts its word before names that lack it. The brand is cut from the
    name where it stands as whole words, unless nothing but the brand gives keywords. Null names and brands count as empty; keys are unique.
    """
    rows = df if non_food is None else df.where(~F.coalesce(non_food, F.lit(False)))
    owner = F.lower(F.coalesce(F.col(brand) if brand else F.lit(""), F.lit("")))
    rows = rows.select(key, F.lower(F.coalesce(F.col(name), F.lit(""))).alias("_name"), owner.alias("_brand"))
    if completions is not None:
        rows = rows.join(completions.select(F.lower("brand").alias("_brand"), F.col("word").alias("_more")), "_brand", "left")
        lacks = F.col("_more").isNotNull() & ~F.col("_name").contains(F.col("_more"))
        rows = rows.withColumn("_name", F.when(lacks, F.concat("_more", F.lit(" "), "_name")).otherwise(F.col("_name")))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), "_brand", F.lit(r"\E(?![\p{L}\p{N}])"))
    cut = F.when(F.col("_brand") != "", F.regexp_replace("_name", pattern, F.lit(" "))).otherwise(F.col("_name"))
    # the name without its brand is tried first
    rows = rows.select(key, F.posexplode(F.array_distinct(F.array(cut, "_name"))).alias("_try", "_text"))
    found = extract_keywords(rows, [key, "_try"], "_text", stop, synonyms, **rules)
    first = found.withColumn("_first", F.min("_try").over(Window.partitionBy(key)))
    return first.where("_try = _first").select(key, "keyword", "pos")


def expand_terms(keywords: DataFrame, key: str, maps: DataFrame) -> DataFrame:
    """(key, term, rank): own keywords rank 0, mapped terms (term, other, kind) rank 1; synonym and parent go one way, and a term's least rank stays."""
    own = keywords.select(key, F.col("keyword").alias("term"), F.lit(0).alias("rank"))
    more = keywords.join(maps, keywords["keyword"] == maps["term"]).select(key, F.col("other").alias("term"), F.lit(1).alias("rank"))
    return own.union(more).groupBy(key, "term").agg(F.min("rank").cast("long").alias("rank"))


def ranked_terms(keywords: DataFrame, key: str, maps: DataFrame, exclusions: DataFrame | None = None) -> DataFrame:
    """(key, term, kind, place): own keywords and those that maps (term, other, kind) add, own before derived, then longest, then first.

    parent, extra and synonym add `other` to `term`; synonym also the reverse; reverse_parent adds to a parent `other` its children
    `term`, unless exclusions (term, other) name the pair. A term that comes by several ways keeps the first kind of own, synonym,
    parent, extra, reverse_parent.
    """
    kinds = ("own", "synonym", "parent", "extra", "reverse_parent")
    steps = maps.where(F.col("kind") != "reverse_parent").select("term", "other", "kind")
    steps = steps.union(maps.where("kind = 'synonym'").select(F.col("other").alias("term"), F.col("term").alias("other"), "kind"))
    down = maps.where("kind = 'reverse_parent'").select(F.col("other").alias("term"), F.col("term").alias("other"), "kind")
    if exclusions is not None:
        down = down.join(exclusions.select(F.col("term").alias("other"), F.col("other").alias("term")).distinct(), ["term", "other"], "left_anti")
    own = keywords.select(key, F.col("keyword").alias("term"), F.lit("own").alias("kind"))
    more = keywords.select(key, F.col("keyword").alias("term")).join(steps.union(down), "term").select(key, F.col("other").alias("term"), "kind")
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    out = own.union(more).groupBy(key, "term").agg(F.min_by("kind", rank).alias("kind"))
    order = Window.partitionBy(key).orderBy(F.col("kind") != "own", F.desc(F.length("term")), "term")
    return out.withColumn("place", F.row_number().over(order).cast("long"))


def classify(df: DataFrame, key: str, text: str, classes: DataFrame, default: str, label: Column | None = None, masks: Sequence[str] = ()) -> DataFrame:
    """(key, class): a label decides; else the class (class, keyword) whose keyword comes first in the text, masked compounds left out; else the default."""
    t = reduce(lambda a, m: F.replace(a, F.lit(m), F.lit("_" * len(m))), masks, F.lower(F.coalesce(text, F.lit(""))))
    rows = df.select(key, t.alias("_t"), (label if label is not None else F.lit(None).cast("string")).alias("_l"))
    # the rules are one row, tried within each row of the texts
    rules = classes.agg(F.collect_list(F.struct("class", "keyword")).alias("_rules"))
    at = F.transform("_rules", lambda r: F.struct(F.position(r["keyword"], F.col("_t")).alias("at"), r["class"].alias("class")))
    first = F.array_min(F.filter(at, lambda x: x["at"] > 0))["class"]
    rows = rows.crossJoin(F.broadcast(rules))  # one row
    return rows.select(key, F.coalesce("_l", first, F.lit(default)).alias("class"))


def pattern_frequency(lines: DataFrame, key: Sequence[str], line: str, patterns: Sequence[tuple[str, str]], examples: int = 3) -> DataFrame:
    """(pattern, n, examples): lines per pattern class (a line may hit many, else other) with the first examples by key."""
    hits = F.array_compact(F.array(*(F.when(F.col(line).rlike(p), F.lit(name)) for name, p in patterns)))
    rows = lines.select(*key, line, F.explode(F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("other")))).alias("pattern"))
    # only the first rows of each class are ranked and kept as examples
    w = Window.partitionBy("pattern").orderBy(*key)
    firsts = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= examples).groupBy("pattern").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", line))), lambda x: x[line]), " | ").alias("examples"))
    return rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).join(firsts, "pattern")


def phrase_pieces(c: Column, most: int = 4) -> Column:
    return F.array_distinct(shingles(words(c), most))
