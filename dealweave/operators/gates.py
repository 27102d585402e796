"""Gates on hits: rule tables decide whether an offer may match a recipe line.

A hit is a row with at least keyword, line and name (of the product). Rules depend on these three texts
only, so a gate runs on the distinct texts and its verdict is joined back: a hot product or line costs
one evaluation. Rule tables may be of any size and are joined, not broadcast by hand.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealweave.functions.matching import words
from dealweave.functions.text import alternatives
from dealweave.sources.folders import stored

TEXTS = ("keyword", "line", "name")


def _distinct(hits: DataFrame) -> DataFrame:
    return hits.select(*TEXTS).distinct()


def _without(hits: DataFrame, void: DataFrame) -> DataFrame:
    return hits.join(void.select(*TEXTS).distinct(), list(TEXTS), "left_anti")


def _has(text: Column, word: Column) -> Column:
    return F.array_contains(words(text), word)


def keyword_classes(keywords: DataFrame, parents: DataFrame, offer: str = "offer_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """((offer, class_id), (class_id, keyword, rank), (class_id, parent)): offers with the same keywords and parents are one class."""
    own_sets = keywords.groupBy(offer).agg(F.sort_array(F.collect_set(F.struct("keyword", "rank"))).alias("_keywords"))
    parent_sets = parents.groupBy(offer).agg(F.sort_array(F.collect_set("parent")).alias("_parents"))
    sets = own_sets.join(parent_sets, offer, "full").withColumn("class_id", F.sha2(F.to_json(F.struct("_keywords", "_parents")), 256))
    classes = sets.groupBy("class_id").agg(F.any_value("_keywords").alias("_keywords"), F.any_value("_parents").alias("_parents"))
    own = classes.select("class_id", F.explode("_keywords").alias("k")).select("class_id", "k.*")
    return sets.select(offer, "class_id"), own, classes.select("class_id", F.explode("_parents").alias("parent"))


def class_hits(pairs: DataFrame, lines: DataFrame, keywords: DataFrame, parents: DataFrame, recipe: str = "recipe_id") -> DataFrame:
    """(recipe, class_id, line_no, keyword, rank): `keyword_hits` for pairs (recipe, class_id) of recipes and classes.

    A class and a line's text are tried once, however many recipes have the line.
    """
    text = F.lower("line")
    rows = pairs.select(recipe, "class_id").distinct().join(lines.select(recipe, "line_no", text.alias("_text")), recipe)
    texts = rows.select("class_id", "_text").distinct()
    own = texts.join(keywords, "class_id").where(F.col("_text").contains(F.col("keyword")))
    own = own.groupBy("class_id", "_text").agg(F.min_by(F.struct("keyword", "rank"), F.struct("rank", "keyword")).alias("h")).select("class_id", "_text", "h.keyword", "h.rank")
    rest = texts.join(own, ["class_id", "_text"], "left_anti").join(parents, "class_id").where(F.col("_text").contains(F.col("parent")))
    rest = rest.groupBy("class_id", "_text").agg(F.min("parent").alias("keyword")).withColumn("rank", F.lit(None).cast("int"))
    return rows.join(own.union(rest), ["class_id", "_text"]).select(recipe, "class_id", "line_no", "keyword", "rank")


def keyword_hits(pairs: DataFrame, lines: DataFrame, keywords: DataFrame, parents: DataFrame, recipe: str = "recipe_id", offer: str = "offer_id") -> DataFrame:
    """(recipe, offer, line_no, keyword, rank): the first keyword (offer, keyword, rank) found in each line of a pair; else its parent (offer, parent), rank null.

    The pairs take what their offer's class found: `class_hits` with the members put in.
    """
    members, own, parent_terms = keyword_classes(keywords, parents, offer)
    rows = pairs.select(recipe, offer).join(members, offer)
    found = class_hits(rows, lines, own, parent_terms, recipe)
    return found.join(rows, [recipe, "class_id"]).select(recipe, offer, "line_no", "keyword", "rank")


def block_false_hits(hits: DataFrame, blockers: DataFrame) -> DataFrame:
    """Without hits whose blockers (keyword, blocker) are in the line, if the keyword neither stands alone nor starts a word that is no blocker; a blocker of several words voids at once."""
    # stored, so that Catalyst knows how few they are: whole texts are judged where they lie, and never dealt by keyword
    rules = stored(blockers.groupBy("keyword").agg(F.collect_set("blocker").alias("_all")), "blockers")
    rows = hits.join(rules, "keyword", "left").withColumn("_b", F.filter("_all", lambda b: F.lower("line").contains(b)))
    free = F.exists(words(F.col("line")), lambda w: w.startswith(F.col("keyword")) & ~F.array_contains("_b", w))
    void = (F.size("_b") > 0) & (F.exists("_b", lambda b: b.contains(" ")) | ~(free | _has(F.col("line"), F.col("keyword"))))
    return rows.where(~F.coalesce(void, F.lit(False))).select(*hits.columns)


def compound_strict(hits: DataFrame, aliases: DataFrame) -> DataFrame:
    """Where the keyword is only an end or start of line words, the product must have the other part or its alias (part, alias)."""
    rows = _distinct(hits).where(~_has(F.col("line"), F.col("keyword")))
    k = F.col("keyword")
    others = F.filter(
        F.transform(words(F.col("line")), lambda w: F.when(w.endswith(k), F.substring(w, F.lit(1), F.length(w) - F.length(k))).when(w.startswith(k), F.substring(w, F.length(k) + 1, F.length(w)))),
        lambda p: p.isNotNull() & (p != ""),
    )
    parts = rows.select(*TEXTS, F.explode(others).alias("part")).join(aliases, "part", "left")
    ok = F.lower("name").contains(F.col("part")) | F.coalesce(F.lower("name").contains(F.col("alias")), F.lit(False))
    judged = parts.groupBy(*TEXTS).agg(F.bool_or(ok).alias("ok"))
    return _without(hits, judged.where("NOT ok"))


def need_qualifier(hits: DataFrame, keywords: DataFrame) -> DataFrame:
    """For listed keywords (keyword), another word of the product must be in the line."""
    rows = _distinct(hits).join(keywords.select("keyword").distinct(), "keyword", "left_semi")
    others = F.filter(words(F.col("name")), lambda w: w != F.col("keyword"))
    return _without(hits, rows.where(~F.arrays_overlap(others, words(F.col("line")))))


def specialty_gate(hits: DataFrame, qualifiers: DataFrame, equivalents: DataFrame) -> DataFrame:
    """Hits with q_rank 2 (same qualifier on both sides), 1 (an equivalent one), 0 (no qualifier concerned); others go.

    qualifiers: keyword, qualifier, two_way; equivalents: qualifier, other. A qualifier in the line must be in the
    product, itself or an equivalent; a two-way one in the product must be in the line.
    """
    own = equivalents.select("qualifier", "other").union(equivalents.select("other", "qualifier")).distinct()
    rows = _distinct(hits).join(qualifiers, "keyword").withColumns({"in_line": _has(F.col("line"), F.col("qualifier")), "in_name": _has(F.col("name"), F.col("qualifier"))})
    rows = rows.where(F.col("in_line") | F.col("in_name")).join(own, "qualifier", "left")
    line_other, name_other = F.coalesce(_has(F.col("line"), F.col("other")), F.lit(False)), F.coalesce(_has(F.col("name"), F.col("other")), F.lit(False))
    each = rows.groupBy(*TEXTS, "qualifier", "in_line", "in_name", "two_way").agg(F.bool_or(line_other).alias("lo"), F.bool_or(name_other).alias("no"))
    fails = (F.col("in_line") & ~F.col("in_name") & ~F.col("no")) | (F.col("two_way") & F.col("in_name") & ~F.col("in_line") & ~F.col("lo"))
    rank = F.when(F.col("in_line") & F.col("in_name"), 2).when(F.col("in_line") | F.col("two_way"), 1).otherwise(0)
    judged = each.groupBy(*TEXTS).agg(F.bool_or(fails).alias("bad"), F.max(rank).alias("q_rank"))
    return hits.join(judged, list(TEXTS), "left").where("bad IS NULL OR NOT bad").withColumn("q_rank", F.coalesce("q_rank", F.lit(0))).drop("bad")


def specialty_branches(hits: DataFrame, qualifiers: DataFrame, equivalents: DataFrame, word: str = "or") -> DataFrame:
    """`specialty_gate` for lines with alternatives (`x or y`), with skipped qualifiers and packaging words.

    qualifiers: keyword, qualifier, two_way, packaging, skip; equivalents: qualifier, other. Of the line's branches those that have the keyword are
    looked at, and one of them must be answered: it names no qualifier but skipped ones, or the product has one of those that it names or
    an equivalent. Packaging words count only where a branch names nothing more specific. Each two-way qualifier of the product must stand
    in some branch, itself or an equivalent. q_rank is 2 if a branch and the product share a qualifier, 1 if they have equivalent ones or only
    the product names one that the line answers, else 0.
    """
    both = equivalents.select("qualifier", "other").union(equivalents.select(F.col("other").alias("qualifier"), F.col("qualifier").alias("other"))).distinct()
    others = both.groupBy("qualifier").agg(F.collect_set("other").alias("others"))
    # a keyword's rules are a short list, tried within each row
    rules = qualifiers.join(others, "qualifier", "left").withColumn("same", F.array_union(F.array("qualifier"), F.coalesce("others", F.array().cast("array<string>"))))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    rules = rules.groupBy("keyword").agg(F.collect_list(F.struct("qualifier", "same", flag("two_way"), flag("packaging"), flag("skip"))).alias("rules"))
    rows = _distinct(hits).join(rules, "keyword").withColumns({"_n": words(F.col("name")), "_b": F.transform(alternatives(F.lower("line"), word), words)})
    asked = F.filter("_b", lambda b: F.array_contains(b, F.col("keyword")))

    def named(b):
        listed = F.filter("rules", lambda r: ~r["skip"] & F.array_contains(b, r["qualifier"]))
        specific = F.filter(listed, lambda r: ~r["packaging"])
        return F.when(F.size(specific) > 0, specific).otherwise(listed)

    met = lambda r: F.arrays_overlap(r["same"], F.col("_n"))
    exact = lambda r: F.array_contains("_n", r["qualifier"])
    first = F.exists(asked, lambda b: (F.size(named(b)) == 0) | F.exists(named(b), met)) | (F.size(asked) == 0)
    in_line = lambda r: F.exists("_b", lambda b: F.arrays_overlap(r["same"], b))
    second = F.forall("rules", lambda r: ~(r["two_way"] & exact(r)) | in_line(r))
    rank = F.when(F.exists(asked, lambda b: F.exists(named(b), exact)), 2).when(F.exists(asked, lambda b: F.exists(named(b), met)) | F.exists("rules", lambda r: r["two_way"] & exact(r)), 1).otherwise(0)
    judged = rows.select(*TEXTS, (first & second).alias("_ok"), rank.alias("q_rank"))
    return hits.join(judged, list(TEXTS), "left").where("coalesce(_ok, true)").withColumn("q_rank", F.coalesce("q_rank", F.lit(0))).drop("_ok")


def form_gate(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Forms of a product (keyword, form, mode, partner) that the line must answer.

    strict: a form in the product needs itself or its partner in the line; loose: any form of the keyword; block: a
    form in the product voids a line that has the partner; require: a form in the line needs itself or the partner in the product.
    """
    rows = _distinct(hits).join(rules, "keyword")
    line, name, form, partner = F.col("line"), F.col("name"), F.col("form"), F.coalesce("partner", F.lit("\0"))
    forms = rules.groupBy("keyword").agg(F.collect_set("form").alias("forms"))
    rows = rows.join(forms, "keyword")
    in_line, in_name = _has(line, form), _has(name, form)
    bad = (
        F.when(F.col("mode") == "strict", in_name & ~in_line & ~_has(line, partner))
        .when(F.col("mode") == "loose", in_name & ~F.arrays_overlap("forms", words(line)))
        .when(F.col("mode") == "block", in_name & _has(line, partner))
        .when(F.col("mode") == "require", in_line & ~in_name & ~_has(name, partner))
    )
    return _without(hits, rows.where(bad))


state_gate = form_gate


def secondary_gate(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Without products that have a blocker and no exception word (keyword, blocker, exception) of their keyword."""
    rows = _distinct(hits).join(rules, "keyword")
    return _without(hits, rows.where(_has(F.col("name"), F.col("blocker")) & ~F.coalesce(_has(F.col("name"), F.col("exception")), F.lit(False))))


def name_blockers(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Blocker words on products (keyword or null for all, blocker, satisfier) void the hit unless the line has the blocker or its satisfier."""
    rows = _distinct(hits)
    scoped = rows.join(rules.where("keyword IS NOT NULL"), "keyword").select(*TEXTS, "blocker", "satisfier")
    everywhere = rows.withColumn("blocker", F.explode(words(F.col("name")))).join(rules.where("keyword IS NULL").drop("keyword"), "blocker").select(*TEXTS, "blocker", "satisfier")
    both = scoped.union(everywhere).where(_has(F.col("name"), F.col("blocker")))
    met = _has(F.col("line"), F.col("blocker")) | F.coalesce(F.lower("line").contains(F.col("satisfier")), F.lit(False))
    judged = both.groupBy(*TEXTS, "blocker").agg(F.bool_or(met).alias("met"))
    return _without(hits, judged.where("NOT met"))


def carrier_gate(hits: DataFrame, carriers: Sequence[str], flavours: Sequence[str]) -> DataFrame:
    """A flavour word of a carrier product does not match alone: the carrier must be in the line. Adds flavour_match, whether the line names a flavour of the product."""
    listed = lambda c, xs: F.array_intersect(words(c), F.array(*map(F.lit, xs)))
    carrier, flavour = listed(F.col("name"), carriers), listed(F.col("name"), flavours)
    alone = (F.size(carrier) > 0) & F.col("keyword").isin(*flavours) & ~F.arrays_overlap(carrier, words(F.col("line")))
    return hits.where(~alone).withColumn("flavour_match", F.arrays_overlap(flavour, words(F.col("line"))))


def context_gate(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (kind, keyword or null, word): product (a word in the product needs itself in the line), line (the reverse), suppress (a word in the line voids the keyword); exempt keywords are rows of kind exempt."""
    exempt = rules.where("kind = 'exempt'").select("keyword", "word", F.lit(True).alias("_e"))
    base = _distinct(hits)
    tokens = base.withColumn("word", F.explode(F.array_union(words(F.col("name")), words(F.col("line")))))
    rows = tokens.join(rules.where("kind <> 'exempt'").select("kind", F.col("keyword").alias("_k"), "word"), "word").where("_k IS NULL OR _k = keyword")
    rows = rows.join(exempt, ["keyword", "word"], "left").where("_e IS NULL")
    in_line, in_name = _has(F.col("line"), F.col("word")), _has(F.col("name"), F.col("word"))
    bad = F.when(F.col("kind") == "product", in_name & ~in_line).when(F.col("kind") == "line", in_line & ~in_name).otherwise(in_line)
    return _without(hits, rows.where(bad))


def apply_policies(hits: DataFrame, policies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits left, (texts, policies) of void ones): policies (policy_id, line_pattern, allowed_word, blocked_keyword) by the blocked keyword."""
    rows = _distinct(hits).join(policies, F.col("keyword") == F.col("blocked_keyword"))
    allowed = F.coalesce(_has(F.col("line"), F.col("allowed_word")), F.lit(False))
    void = rows.where(F.regexp_like(F.col("line"), F.col("line_pattern")) & ~allowed).groupBy(*TEXTS).agg(F.sort_array(F.collect_set("policy_id")).alias("policies"))
    return _without(hits, void), void


def apply_bridges(pairs: DataFrame, bridges: DataFrame) -> DataFrame:
    """(pair columns, bridge_id): positive rules (bridge_id, line_pattern, name_pattern, negative_pattern, anchor) for pairs whose product has the anchor word."""
    texts = pairs.select("line", "name").distinct()
    rows = texts.withColumn("anchor", F.explode(words(F.col("name")))).join(bridges, "anchor")
    no = F.coalesce(F.regexp_like(F.col("line"), F.col("negative_pattern")), F.lit(False))
    hit = rows.where(F.regexp_like(F.col("line"), F.col("line_pattern")) & F.regexp_like(F.col("name"), F.col("name_pattern")) & ~no)
    return pairs.join(hit.groupBy("line", "name").agg(F.min("bridge_id").alias("bridge_id")), ["line", "name"])


def requirement_gate(hits: DataFrame, rules: DataFrame, scope: Column | None = None) -> DataFrame:
    """Rules (line_cue, need, forbid, unless): with the cue in the line, the product must have `need`, must not have `forbid`, unless it has `unless`."""
    texts = _distinct(hits)
    rows = texts.withColumn("line_cue", F.explode(words(F.col("line")))).join(rules, "line_cue")
    name_has = lambda c: F.coalesce(_has(F.col("name"), F.col(c)), F.lit(False))
    bad = ((F.col("need").isNotNull() & ~name_has("need")) | name_has("forbid")) & ~name_has("unless")
    void = rows.where(bad).select(*TEXTS).distinct()
    if scope is None:
        return _without(hits, void)
    return hits.join(void.withColumn("_v", F.lit(True)), list(TEXTS), "left").where(F.col("_v").isNull() | ~scope).drop("_v")


def label_gate(hits: DataFrame, label: str, recipe_labelled: Column, plant: Sequence[str]) -> DataFrame:
    """Where the line or the recipe says `label`, only products that say it, or are plant-based by a word, may match."""
    asked = _has(F.col("line"), F.lit(label)) | F.coalesce(recipe_labelled, F.lit(False))
    ok = _has(F.col("name"), F.lit(label)) | F.arrays_overlap(words(F.col("name")), F.array(*map(F.lit, plant)))
    return hits.where(~asked | ok)


def select_winner(hits: DataFrame, n_keywords: str, recipe: str = "recipe_id", offer: str = "offer_id", flavour: str | None = None) -> DataFrame:
    """One hit per pair: the first line fixes the keyword; among its lines the one with the fewest keywords, then the lowest index, wins.

    With `flavour` (whether the line names a flavour that the product's carrier took in), a winner that names none gives way to the
    first line of the keyword that does.
    """
    pair = Window.partitionBy(recipe, offer)
    keyword = F.min_by("keyword", F.struct("line_no", "keyword")).over(pair)
    rows = hits.withColumn("_k", keyword).where("keyword = _k").drop("_k")
    order: list = [n_keywords, "line_no"]
    if flavour:
        named = F.coalesce(F.col(flavour), F.lit(False))
        rows = rows.withColumns({"_w": F.min(F.struct(n_keywords, "line_no")).over(pair)["line_no"], "_f": F.min(F.when(named, F.col("line_no"))).over(pair)})
        keeps = F.bool_or(named & (F.col("line_no") == F.col("_w"))).over(pair)
        rows = rows.withColumn("_to", F.when(keeps, F.col("_w")).otherwise(F.coalesce("_f", "_w")))
        order = [F.col("line_no") != F.col("_to"), *order]
    return rows.withColumn("_n", F.row_number().over(pair.orderBy(*order))).where("_n = 1").drop("_n", *(["_w", "_f", "_to"] if flavour else []))


def validate(hits: DataFrame, stages: Sequence[tuple[str, Column, str]], keys: Sequence[str] = ("recipe_id", "offer_id"), start: Column | None = None) -> DataFrame:
    """(keys, line_no): the line on which each pair passes all stages, in their order.

    A stage is (name, condition on the hit, on_fail). The pair stands on one line, first its `start` or its lowest.
    If a stage fails there, `void` ends the pair, `retry` moves on to the next line that passes the stage.
    """
    pair = Window.partitionBy(*keys)
    at = F.min("line_no").over(pair) if start is None else F.min(F.when(start, F.col("line_no"))).over(pair)

    def step(rows, stage):
        _, ok, on_fail = stage
        ok = F.coalesce(ok, F.lit(False))
        if on_fail == "void":
            passed = F.bool_or((F.col("line_no") == F.col("_at")) & ok).over(pair)
            return rows.withColumn("_p", passed).where("_p").drop("_p")
        moved = F.min(F.when(ok & (F.col("line_no") >= F.col("_at")), F.col("line_no"))).over(pair)
        return rows.withColumn("_at", moved).where("_at IS NOT NULL")

    out = reduce(step, stages, hits.withColumn("_at", at).where("_at IS NOT NULL"))
    return out.where("line_no = _at").select(*keys, "line_no").distinct()


def drop_unbuyable(lines: DataFrame, names: DataFrame, line: str = "line") -> DataFrame:
    """Lines that are a listed name (name), for tools, leftovers and references, become empty and match nothing: they go."""
    key = F.array_join(words(F.col(line)), " ")
    return lines.join(names.select(F.array_join(words(F.col("name")), " ").alias("_x")).distinct(), key == F.col("_x"), "left_anti")
