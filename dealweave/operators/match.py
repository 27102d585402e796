"""Term indexes, candidate generation and the joins around them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealweave.functions.matching import words
from dealweave.operators.grams import containing
from dealweave.sources.folders import stored


def offer_terms(offers: DataFrame, key: str = "offer_id", name: str = "name", least: int = 4) -> DataFrame:
    """(key, term, kind): the full name as keyword, its last word as parent_keyword, its first word of `least` letters as name_word."""
    n = F.lower(F.trim(F.col(name)))
    ws = F.split(n, " ")
    first = F.get(ws, F.lit(0))
    terms = F.array(F.struct(n.alias("term"), F.lit("keyword").alias("kind")), F.struct(F.element_at(ws, -1).alias("term"), F.lit("parent_keyword").alias("kind")), F.when(F.length(first) >= least, F.struct(first.alias("term"), F.lit("name_word").alias("kind"))))
    return offers.where(F.col(name).isNotNull()).select(key, F.explode(F.array_compact(terms)).alias("t")).select(key, "t.*").distinct()


def manifest(terms: DataFrame, key: str) -> DataFrame:
    """One row (rows, manifest): a digest of the distinct postings, from the sorted digests of each key, so that no key's list meets another's."""
    per_key = terms.groupBy(key).agg(F.sha2(F.array_join(F.sort_array(F.collect_set(F.concat_ws("\x1f", F.col(key).cast("string"), "term", "kind"))), "\n"), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    # an order-free sum of the digests' leading bits
    part = F.conv(F.substring("d", 1, 12), 16, 10).cast("decimal(20,0)")
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"), F.coalesce(F.sum(part), F.lit(0)).cast("decimal(38,0)").cast("string").alias("manifest"))


#: Columns by which postings of one build are told from another's; those that both sides have are part of the join.
STAMPS = ("version", "manifest")


def stamped(postings: DataFrame, version: str, manifest: str) -> DataFrame:
    """Postings of one build of the rules and one manifest."""
    return postings.withColumns({"version": F.lit(version), "manifest": F.lit(manifest)})


def posting_classes(offer_terms: DataFrame, offer: str = "offer_id") -> tuple[DataFrame, DataFrame]:
    """((offer, class_id), (class_id, term, kind, stamps)): offers with equal postings are one class, so that one row stands for all of them.

    Both are stored: Catalyst knows their sizes, and sends the few postings of the classes to the recipes instead of dealing all recipes by term.
    """
    stamps = [c for c in STAMPS if c in offer_terms.columns]
    lists = offer_terms.groupBy(offer).agg(F.sort_array(F.collect_set(F.struct("term", "kind", *stamps))).alias("_postings"))
    # a digest as bytes, since every pair of a recipe and a class bears it
    members = stored(lists.withColumn("class_id", F.unhex(F.md5(F.to_json("_postings")))), "members")
    postings = members.groupBy("class_id").agg(F.any_value("_postings").alias("_postings")).select("class_id", F.explode("_postings").alias("p"))
    return members.select(offer, "class_id"), stored(postings.select("class_id", "p.*"), "postings")


def class_sizes(members: DataFrame) -> DataFrame:
    """(class_id, m): how many offers each class has, stored as it is a row for each class only."""
    return stored(members.groupBy("class_id").agg(F.count(F.lit(1)).alias("m")), "sizes")


def class_candidates(recipe_terms: DataFrame, postings: DataFrame, recipe: str = "recipe_id", strong: Sequence[str] | None = ("keyword", "parent_keyword")) -> DataFrame:
    """(recipe, class_id, terms, stamps): the factorised candidates, a row for each recipe and class of offers that share a term of one build.

    With `strong`, one of the shared terms must be of such a kind on the offers' side.
    """
    stamps = [c for c in STAMPS if c in recipe_terms.columns and c in postings.columns]
    # terms that a recipe has twice are one in its sets: they need no pass of their own
    rows = recipe_terms.select(recipe, "term", *stamps).join(postings.select("class_id", "term", "kind", *stamps), ["term", *stamps])
    fits = F.bool_or(F.col("kind").isin(*strong) if strong else F.lit(True))
    pairs = rows.groupBy(recipe, "class_id", *stamps).agg(F.sort_array(F.collect_set("term")).alias("terms"), fits.alias("_strong"))
    return pairs.where("_strong").select(recipe, "class_id", "terms", *stamps)


def candidates(recipe_terms: DataFrame, offer_terms: DataFrame, recipe: str = "recipe_id", offer: str = "offer_id", strong: Sequence[str] | None = ("keyword", "parent_keyword")) -> DataFrame:
    """(recipe, offer, terms, stamps): pairs that share a term of one build, with their sorted shared terms; `class_candidates` with the classes' members put in."""
    members, postings = posting_classes(offer_terms, offer)
    pairs = class_candidates(recipe_terms, postings, recipe, strong)
    return with_members(pairs, members, recipe).select(recipe, offer, *(c for c in pairs.columns if c not in (recipe, "class_id")))


#: About how many members of a class lie in one row, into how many parts the rows of a class are dealt, and how many tasks a core has.
PACK, PARTS, TASKS = 256, 16, 16


def with_members(rows: DataFrame, members: DataFrame, by: str = "recipe_id") -> DataFrame:
    """`rows` (class_id, by, ...) with the members (class_id, ...) of their classes put in.

    The rows of a class are dealt by `by`, so that no class is put out by one task alone, and its members come to each part in
    packs. A pack goes over all rows of its part before the next one does: few members take turns in a file, which then packs well.
    What is dealt is small and what comes of it large, so tasks go by the cores, not by the bytes dealt.
    """
    own = [c for c in members.columns if c != "class_id"]
    packs = members.join(class_sizes(members), "class_id").withColumn("_pack", F.pmod(F.xxhash64(*own), F.ceil(F.col("m") / PACK)))
    packs = packs.groupBy("class_id", "_pack").agg(F.collect_list(F.struct(*own)).alias("_members"))
    packs = packs.select("class_id", "_members", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int"))
    session, place = rows.sparkSession, ["class_id", "_part"]
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), TASKS * session.sparkContext.defaultParallelism)
    # a merge join: sent whole, packs would meet the rows one by one
    met = packs.repartition(tasks, *place).join(dealt.repartition(tasks, *place).hint("merge"), place)
    return met.select(*rows.columns, F.inline("_members"))


#: About how many bytes of its column a task of `with_texts` puts out, and how many members it keeps in one row.
TEXT_BYTES, TEXT_ROWS = 64 << 20, 4096


def with_texts(texts: DataFrame, members: DataFrame, text: str) -> DataFrame:
    """(members' columns, text): the members (class_id, ...) with the text (class_id, text) of their class, which may be long; both are stored tables.

    Members meet it in packs that are smaller the longer the text is, and as many tasks put the packs out as the whole column
    needs. So a task holds no more than some packs, even if a writer keeps all of its rows, and few texts take turns in a file.
    """
    own = [c for c in members.columns if c != "class_id"]
    sizes = class_sizes(members).join(texts.select("class_id", F.octet_length(text).alias("_n")), "class_id")
    share = F.least(F.lit(TEXT_ROWS), F.greatest(F.lit(1), F.floor(TEXT_BYTES / F.greatest(F.col("_n"), F.lit(1)))))
    sizes = stored(sizes.select("class_id", "m", "_n", F.ceil(F.col("m") / share).alias("_packs")), "packs")
    packs = members.join(sizes, "class_id").withColumn("_pack", F.pmod(F.xxhash64(*own), F.col("_packs")))
    packs = packs.groupBy("class_id", "_pack").agg(F.collect_list(F.struct(*own)).alias("_members"))
    whole = sizes.agg(F.sum(F.col("m") * F.col("_n"))).first()[0] or 0
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(whole / TEXT_BYTES))
    return packs.join(texts, "class_id").repartition(tasks, "class_id", "_pack").select(F.inline("_members"), text)


def having_any(pairs: DataFrame, keys: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """(keys, n_terms) of pairs (keys, term, kind) with any term of some kinds."""
    return pairs.groupBy(*keys).agg(F.count_distinct("term").alias("n_terms"), F.bool_or(F.col("kind").isin(*kinds)).alias("_s")).where("_s").drop("_s")


def route_terms(texts: DataFrame, terms: DataFrame, key: str, text: str, short: int = 2) -> DataFrame:
    """(key, term): terms (term, kind) in texts; keyword and parent_keyword as substrings of a word, name_word and short terms as whole words.

    The vocabulary meets the terms by shared grams, not the texts: a term without blanks that lies in a text lies in one
    of its words. Terms with blanks are looked for in the texts that have their rarest word, once for all terms of a text.
    Terms of blanks alone are found nowhere.
    """
    tokens = texts.select(key, F.explode(F.array_distinct(F.split(F.lower(F.trim(text)), r"\s+"))).alias("w"))
    single, multi = terms.where(~F.col("term").contains(" ")), terms.where(F.col("term").contains(" "))
    # read several times below; without it every reading would split all texts anew
    vocabulary = stored(tokens.groupBy("w").agg(F.count(F.lit(1)).alias("docs")), "vocabulary")
    exact = (F.col("kind") == "name_word") | (F.length("term") <= short)
    equal, inside = (single.where(c).select("term").distinct() for c in (exact, ~exact))
    words_of = multi.select("term", F.split("term", " ").alias("ts")).distinct()
    if words_of.isEmpty():
        parts = containing(vocabulary, inside, "w").union(vocabulary.join(equal, F.col("w") == F.col("term")).select("w", "term"))
        return tokens.join(parts, "w").select(key, "term").distinct()
    # a text with the term has a word for each of the term's: the first ends with it, the last starts with it, others equal it
    pieces = words_of.select("term", F.size("ts").alias("n"), F.posexplode("ts").alias("i", "t")).where("t <> ''")
    outer = (F.col("i") == 0) | (F.col("i") == F.col("n") - 1)
    # one lookup for plain terms and the outer words of others
    found = stored(containing(vocabulary, inside.union(pieces.where(outer).select("t")).distinct(), "w"), "contained")
    parts = found.join(inside, "term").select("w", "term").union(vocabulary.join(equal, F.col("w") == F.col("term")).select("w", "term"))
    ends = F.when(F.col("i") == 0, F.col("w").endswith(F.col("t"))).otherwise(F.col("w").startswith(F.col("t")))
    fitting = found.withColumnRenamed("term", "t").join(pieces.where(outer), "t").where(ends).select("w", "term", "i")
    fitting = fitting.union(pieces.where(~outer).join(vocabulary, F.col("w") == F.col("t")).select("w", "term", "i"))
    # of the term's words the rarest in all texts names the texts that are read again
    counts = fitting.join(vocabulary, "w").groupBy("term", "i").agg(F.sum("docs").alias("docs"))
    rarest = counts.groupBy("term").agg(F.min_by("i", F.struct("docs", "i")).alias("i"))
    marks = parts.withColumn("sure", F.lit(True)).union(fitting.join(rarest, ["term", "i"]).select("w", "term", F.lit(False)))
    hits = stored(tokens.join(marks, "w").select(key, "term", "sure").distinct(), "hits")
    lists = hits.where("NOT sure").groupBy(key).agg(F.collect_set("term").alias("_terms"))
    flat = F.concat_ws(" ", F.split(F.lower(F.trim(text)), r"\s+"))
    hit = texts.select(key, flat.alias("_t")).join(lists, key)
    hit = hit.select(key, F.explode(F.filter("_terms", lambda t: F.col("_t").contains(t))).alias("term"))
    return hits.where("sure").select(key, "term").union(hit).distinct()


def line_hints(lines: DataFrame, pairs: DataFrame, recipe: str = "recipe_id", offer: str = "offer_id") -> DataFrame:
    """(recipe, offer, term, line_nos): for each pair (recipe, offer, terms), the lines (recipe, line_no, term) that hold each shared term."""
    wanted = pairs.select(recipe, offer, F.explode("terms").alias("term"))
    return wanted.join(lines.select(recipe, "term", "line_no").distinct(), [recipe, "term"]).groupBy(recipe, offer, "term").agg(F.sort_array(F.collect_set("line_no")).alias("line_nos"))


def routing_saved(lines: DataFrame, class_pairs: DataFrame, members: DataFrame, recipe: str = "recipe_id") -> DataFrame:
    """One row: pairs, scanned (line tests if every pair looks at all lines of its recipe), hinted (tests of hinted lines only) and saved_pct.

    Counted from the factorised pairs (recipe, class_id, terms): a class counts as often as it has members.
    """
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("_m"))
    all_lines = lines.groupBy(recipe).agg(F.count_distinct("line_no").alias("_n"))
    rows = class_pairs.select(recipe, "class_id", F.explode("terms").alias("term"))
    hinted = rows.join(lines.select(recipe, "term", "line_no").distinct(), [recipe, "term"]).groupBy(recipe, "class_id").agg(F.count_distinct("line_no").alias("_h"))
    each = class_pairs.select(recipe, "class_id").join(sizes, "class_id").join(all_lines, recipe).join(hinted, [recipe, "class_id"], "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = each.agg(total(F.col("_m")).alias("pairs"), total(F.col("_m") * F.col("_n")).alias("scanned"), total(F.col("_m") * F.coalesce("_h", F.lit(0))).alias("hinted"))
    return sums.withColumn("saved_pct", F.when(F.col("scanned") > 0, F.round(100 - 100 * F.col("hinted") / F.col("scanned"), 2)).otherwise(0.0))


def text_classes(texts: DataFrame, postings: DataFrame, text: str = "text", strong: Sequence[str] = ("keyword", "parent_keyword")) -> DataFrame:
    """(text, class_id, strong): the classes that share a term with each of some texts (text, term), stored, and whether a shared term is of a strong kind."""
    rows = texts.select(text, "term").distinct().join(postings.select("class_id", "term", "kind"), "term")
    return stored(rows.groupBy(text, "class_id").agg(F.bool_or(F.col("kind").isin(*strong)).alias("strong")), "text-classes")


def routing_saved_by_text(lines: DataFrame, found: DataFrame, members: DataFrame, recipe: str = "recipe_id") -> DataFrame:
    """The row of `routing_saved`, from lines (recipe, text_id), each a row, and the classes of their texts (text_id, class_id, strong).

    Texts meet the classes once, and recipes with the same texts are counted and looked at once. Lines without a text are scanned too.
    Lists of texts are dealt once, as sorted numbers, and their classes are counted where they then lie.
    """
    lists = lines.groupBy(recipe).agg(F.sort_array(F.collect_list(F.coalesce("text_id", F.lit(-1)))).alias("_texts"))
    lists = lists.groupBy("_texts").agg(F.count(F.lit(1)).alias("_r"))
    sized = stored(found.join(class_sizes(members), "class_id"), "sized")
    rows = lists.select("_texts", "_r", F.explode("_texts").alias("text_id")).join(sized, "text_id")
    each = rows.groupBy("_texts", "_r", "class_id", "m").agg(F.count(F.lit(1)).alias("_h"), F.bool_or("strong").alias("_s")).where("_s")
    total = lambda c: F.coalesce(F.sum(F.col("_r") * F.col("m") * c), F.lit(0)).cast("long")
    sums = each.agg(total(F.lit(1)).alias("pairs"), total(F.size("_texts")).alias("scanned"), total(F.col("_h")).alias("hinted"))
    return sums.withColumn("saved_pct", F.when(F.col("scanned") > 0, F.round(100 - 100 * F.col("hinted") / F.col("scanned"), 2)).otherwise(0.0))


def refresh_scope(pairs: DataFrame, fresh: DataFrame, recipe_ids: DataFrame, offer_ids: DataFrame, recipe: str = "recipe_id", offer: str = "offer_id", manifest: str | None = None) -> DataFrame:
    """`pairs` with those in scope (recipe in one set or offer in the other) replaced by those of `fresh` in scope; with `manifest`, all rows bear it from then on."""

    def in_scope(df, keep):
        marked = df.join(recipe_ids.select(recipe, F.lit(True).alias("_r")).distinct(), recipe, "left").join(offer_ids.select(offer, F.lit(True).alias("_o")).distinct(), offer, "left")
        scope = F.coalesce("_r", F.lit(False)) | F.coalesce("_o", F.lit(False))
        return marked.where(scope if keep else ~scope).select(*pairs.columns)

    out = in_scope(pairs, False).unionByName(in_scope(fresh, True))
    return out if manifest is None else out.withColumn("manifest", F.lit(manifest))


def duplicate_pairs(df: DataFrame, key: str, items: str, least: int = 2) -> DataFrame:
    """(a, b): rows b with more than `least` items and the same sorted items as a, the least key of its class; a class of n rows gives n - 1 pairs."""
    rows = df.where(F.size(items) > least).select(key, F.sha2(F.array_join(F.sort_array(items), "\x1f"), 256).alias("h"))
    # the classes are made with partial sums, so that a hot list is never gathered
    first = rows.groupBy("h").agg(F.min(key).alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.select(F.col(key).alias("b"), "h").join(first, "h").where("a < b").select("a", "b")


def count_duplicate_pairs(df: DataFrame, items: str, least: int = 2) -> DataFrame:
    """One row (pairs): n (n - 1) / 2 summed over equal item lists, without making the pairs."""
    sizes = df.where(F.size(items) > least).groupBy(F.sha2(F.array_join(F.sort_array(items), "\x1f"), 256).alias("h")).count().where("count > 1")
    return sizes.agg(F.coalesce(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.lit(0)).cast("long").alias("pairs"))


def resolve_sources(actual: DataFrame, enabled: DataFrame) -> DataFrame:
    """(source): actual names equal to an enabled one, whole or up to the first dot; all of them if none is."""
    head = lambda c: F.lower(F.element_at(F.split(c, r"\."), 1))
    keys = enabled.select(F.lower("name").alias("k")).union(enabled.select(head(F.col("name")).alias("k"))).distinct()
    rows = actual.select("source").distinct().withColumn("h", head(F.col("source")))
    matched = rows.join(keys, rows["h"] == keys["k"], "left").select("source", F.col("k").isNotNull().alias("ok"))
    return matched.withColumn("any", F.max("ok").over(Window.partitionBy())).where("ok OR NOT any").select("source").distinct()


def star_join(sources: DataFrame, starred: DataFrame) -> DataFrame:
    """(source, starred): whether a favourite (name) equals, contains or lies in the source, case aside; empty names are nobody's. Names meet by shared grams."""
    s, n = sources.select(F.lower("source").alias("s")), starred.select(F.lower("name").alias("n"))
    near = containing(s, n, "s", "n").select("s").union(containing(n, s, "n", "s").select("s")).distinct()
    hits = sources.select("source").distinct().join(near, F.lower("source") == F.col("s"), "left_semi")
    return sources.select("source").distinct().join(hits.withColumn("starred", F.lit(True)), "source", "left").select("source", F.coalesce("starred", F.lit(False)).alias("starred"))


def recipes_of_classes(pairs: DataFrame, members: DataFrame, recipe: str = "recipe_id", offer: str = "offer_id") -> tuple[DataFrame, DataFrame]:
    """((offer, class_id), (class_id, recipe)): the matches (recipe, class_id) turned round without a list for any offer: an offer's recipes are its class's."""
    inverse = pairs.select("class_id", recipe).distinct()
    return members.join(inverse.select("class_id").distinct(), "class_id", "left_semi").select(offer, "class_id"), inverse


def recipes_with_any(pairs: DataFrame, members: DataFrame, offers: DataFrame, recipe: str = "recipe_id", offer: str = "offer_id") -> DataFrame:
    """(recipe): recipes that hold an offer of a set (EXISTS), found through the classes of the set alone."""
    wanted = members.join(offers.select(offer).distinct(), offer, "left_semi").select("class_id").distinct()
    return pairs.join(wanted, "class_id", "left_semi").select(recipe).distinct()


def recipes_with_terms(recipe_terms: DataFrame, offer_terms: DataFrame, offers: DataFrame, recipe: str = "recipe_id", offer: str = "offer_id", strong: Sequence[str] = ("keyword", "parent_keyword")) -> DataFrame:
    """(recipe): the recipes of `recipes_with_any` over the matches of `candidates`, found by the strong terms of the set's offers; no match is made."""
    wanted = offer_terms.where(F.col("kind").isin(*strong)).join(offers.select(offer).distinct(), offer, "left_semi").select("term").distinct()
    return recipe_terms.join(stored(wanted, "wanted"), "term", "left_semi").select(recipe).distinct()


def offer_to_recipes(cache: DataFrame, recipe: str = "recipe_id", matched: str = "matched") -> DataFrame:
    """(offer_id, recipe_ids): the nested matches turned round, a list for each offer; `recipes_of_classes` makes no list."""
    return cache.select(recipe, F.explode(matched).alias("m")).groupBy(F.col("m.offer_id").alias("offer_id")).agg(F.sort_array(F.collect_set(recipe)).alias("recipe_ids"))


def enrich(hits: DataFrame, cache: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Hits with the stored columns; missing ones take their default."""
    return hits.join(cache, key, "left").fillna(defaults)


def refresh_class_scope(pairs: DataFrame, fresh: DataFrame, members: DataFrame, recipe_ids: DataFrame, offer_ids: DataFrame, recipe: str = "recipe_id", offer: str = "offer_id", manifest: str | None = None) -> DataFrame:
    """`refresh_scope` for pairs (recipe, class_id, ...): recipes and members are marked before they meet, so that no pair of a recipe and an offer is shuffled.

    The result has the pairs with the classes' members put in; `fresh` has the same classes.
    """
    marked = members.join(offer_ids.select(offer, F.lit(True).alias("_o")).distinct(), offer, "left")

    def in_scope(df, keep):
        rows = df.join(recipe_ids.select(recipe, F.lit(True).alias("_r")).distinct(), recipe, "left")
        rows = with_members(rows, marked, recipe)
        scope = F.coalesce("_r", F.lit(False)) | F.coalesce("_o", F.lit(False))
        return rows.where(scope if keep else ~scope).select(recipe, offer, *(c for c in df.columns if c not in (recipe, "class_id")))

    out = in_scope(pairs, False).unionByName(in_scope(fresh, True))
    return out if manifest is None else out.withColumn("manifest", F.lit(manifest))


def status_by_parent(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, ts: str) -> DataFrame:
    """(parent, n, last): children counted per parent, parents without any kept with 0."""
    agg = children.groupBy(F.col(child_key).alias("_k")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last"))
    return parents.join(agg, F.col(parent_key) == F.col("_k"), "left").select(parent_key, F.coalesce("n", F.lit(0)).alias("n"), "last")


def review_list(fixes: DataFrame, recipes: DataFrame, key: str, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Fixes joined to their recipe, with place by the columns `by`, never null, then by a mixed order, and unreviewed, the number of open ones.

    Only the sizes of the groups of `by` meet in one task; rows are ranked group by group.
    """
    unreviewed = fixes.agg(F.count_if(~F.col("reviewed")).alias("unreviewed"))
    out = fixes.join(recipes, key).crossJoin(F.broadcast(unreviewed))  # one row
    # places within each reviewed state by the rest of the order, after all rows of the states before it
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    sizes = out.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    out = out.withColumn("_place", place).join(before, list(by))
    return out.withColumn("place", (F.col("_place") + F.col("_before")).cast("long")).drop("_place", "_before")


def compounds(vocabulary: DataFrame, dictionary: DataFrame, head: int = 4, tail: int = 3, binding: str = "s") -> DataFrame:
    """(word, head, tail): words of a known word (>= head letters), an optional binding letter and a known rest (>= tail letters); the longest head."""
    d = dictionary.select("word").distinct()
    # neither part is longer than the longest known word, so only cuts that leave such parts are made
    longest = d.agg(F.max(F.length("word"))).first()[0] or 0
    first, last = F.greatest(F.lit(head), F.length("word") - longest - len(binding)), F.least(F.length("word") - tail, F.lit(longest))
    split = vocabulary.select("word").distinct().where((F.length("word") >= head + tail) & (first <= last))
    split = split.withColumn("n", F.explode(F.sequence(first, last)))
    split = split.withColumn("h", F.substring("word", F.lit(1), F.col("n"))).withColumn("t", F.substring("word", F.col("n") + 1, F.length("word")))
    bound = split.where((F.substring("t", 1, 1) == binding) & (F.length("t") > tail)).withColumn("t", F.substring("t", F.lit(2), F.length("t")))
    parts = split.union(bound).join(d.select(F.col("word").alias("h")), "h", "left_semi").join(d.select(F.col("word").alias("t")), "t", "left_semi")
    return parts.groupBy("word").agg(F.min_by(F.struct("h", "t"), F.struct((-F.col("n")).alias("n"), (-F.length("t")).alias("m"))).alias("p")).select("word", F.col("p.h").alias("head"), F.col("p.t").alias("tail"))


def inflected(words_: DataFrame, known: DataFrame, suffixes: Sequence[str], least: int = 3) -> DataFrame:
    """(word): those of `words_` (word) that are a known word (word) of `least` letters or more and one of some suffixes."""
    w = F.col("word")
    stems = [F.when(w.endswith(s) & (F.length(w) - len(s) >= least), F.substring(w, F.lit(1), F.length(w) - len(s))) for s in suffixes]
    rows = words_.select("word", F.explode(F.array_compact(F.array(*stems, F.lit(None).cast("string")))).alias("stem"))
    return rows.join(known.select(F.col("word").alias("stem")), "stem", "left_semi").select("word").distinct()


def suggest(vocabulary: DataFrame, dictionary: DataFrame, excluded: DataFrame | None = None, least: int = 5, suffixes: Sequence[str] = (), compound: bool = False) -> DataFrame:
    """(word, fix): unknown words of `least` letters or more with exactly one dictionary word at edit distance 1.

    Words that are a dictionary word and one of `suffixes`, and with `compound` those made of two dictionary words, need no
    fix. Words that are one edit apart share a form with at most one letter deleted, so an equi-join on those forms finds
    all of them; words of more than one letter over the longest of the other side have no such partner and make no forms.
    """

    def forms(df, name):
        cut = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))))
        return df.select(name, F.explode(F.array_distinct(F.concat(F.array(F.col(name)), cut))).alias("form"))

    # both are read many times below
    d = stored(dictionary.select(F.col("word").alias("fix")).distinct(), "dictionary")
    known = d.select(F.col("fix").alias("word"))
    unknown = stored(vocabulary.select("word").distinct().where(F.length("word") >= least).join(known, "word", "left_anti"), "unknown")
    longest = d.agg(F.max(F.length("fix"))).first()[0] or 0
    unknown = unknown.where(F.length("word") <= longest + 1)
    if suffixes:
        unknown = unknown.join(inflected(unknown, known, suffixes), "word", "left_anti")
    if compound:
        made = compounds(unknown, known).select("word").union(compounds(unknown, known, 3, 4).select("word"))  # either part may be the longer known one
        unknown = unknown.join(made, "word", "left_anti")
    longest = unknown.agg(F.max(F.length("word"))).first()[0] or 0
    d = d.where(F.length("fix") <= longest + 1)
    pairs = forms(unknown, "word").join(forms(d, "fix"), "form").select("word", "fix").distinct()
    pairs = pairs.where(F.levenshtein("word", "fix", 1) == 1)
    if excluded is not None:
        pairs = pairs.join(excluded.select("word", "fix"), ["word", "fix"], "left_anti")
    return pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("fix").alias("fix")).where("n = 1").drop("n")


def repair_spelling(lines: DataFrame, fixes: DataFrame, key: Sequence[str], line: str) -> tuple[DataFrame, DataFrame]:
    """(lines with the first occurrence of each unique correction applied, log (key, word, fix))."""
    tokens = lines.select(*key, F.explode(F.array_distinct(words(F.col(line)))).alias("word"))
    log = tokens.join(fixes, "word").select(*key, "word", "fix")
    per_line = log.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("word", "fix"))).alias("f"))
    marked = lines.join(per_line, list(key), "left")
    # one fix after another; the first place of the word at word bounds
    fixed = F.aggregate(F.coalesce("f", F.array().cast("array<struct<word:string,fix:string>>")), F.lower(line), lambda a, x: F.regexp_replace(a, F.concat(F.lit(r"(?s)^((?:.*?[^\p{L}\p{N}])??)"), x["word"], F.lit(r"(?![\p{L}\p{N}])")), F.concat(F.lit("$1"), x["fix"])))
    return marked.withColumn(line, fixed).drop("f"), log


def undo_spelling(log: DataFrame, lines_before: DataFrame, lines_after: DataFrame, key: Sequence[str], undo: DataFrame) -> DataFrame:
    """Lines as before for keys in `undo`, as after for the others."""
    k = list(key)
    return lines_after.join(undo.select(*k).distinct(), k, "left_anti").unionByName(lines_before.join(undo.select(*k).distinct(), k, "left_semi"))
