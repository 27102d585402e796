"""Snapshot comparison, fingerprints, change classes and delta plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from dealweave.sources import folders

# Actions by precedence.
ACTIONS = ("rematch", "remove", "rescore", "display")


def _struct(cols: Sequence[str], name: str) -> Column:
    return F.struct(*cols).alias(name)


def compare(base: DataFrame, cand: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """(key, status): baseline_only, candidate_only, mismatch or equal."""
    both = base.select(key, _struct(cols, "a")).join(cand.select(key, _struct(cols, "b")), key, "full")
    status = F.when(F.col("b").isNull(), "baseline_only").when(F.col("a").isNull(), "candidate_only").when(F.col("a").eqNullSafe(F.col("b")), "equal").otherwise("mismatch")
    return both.select(key, status.alias("status"))


def parity(compared: DataFrame, key: str, sample: int = 5) -> DataFrame:
    """One row: counts per status, ok, and a sample of the least differing keys."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    sums = compared.agg(n("baseline_only"), n("candidate_only"), n("mismatch"), n("equal"))
    first = compared.where("status <> 'equal'").orderBy(key).limit(sample).agg(F.array_join(F.array_sort(F.collect_list(F.col(key))).cast("array<string>"), ",").alias("sample"))
    return sums.crossJoin(first).withColumn("ok", F.col("baseline_only") + F.col("candidate_only") + F.col("mismatch") == 0)  # one row each


def field_diffs(base: DataFrame, cand: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """(field, keys): how many common keys differ in each field."""

    def long(df, name):
        fields = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(name)) for c in cols))
        return df.select(key, F.explode(fields).alias("f")).select(key, "f.*")

    rows = long(base, "a").join(long(cand, "b"), [key, "field"]).where(~F.col("a").eqNullSafe(F.col("b")))
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("keys"))


def canonical(c: Column, kind: str) -> Column:
    """Text form for fingerprints: numbers without trailing zeros, arrays sorted, `a / b` labels sorted, null marked."""
    if kind.startswith("array"):
        text = F.array_join(F.sort_array(F.transform(c, lambda x: x.cast("string"))), "\x1e")
    elif kind in ("double", "float") or kind.startswith("decimal"):
        text = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,10)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    elif kind == "string":
        text = F.when(c.contains(" / "), F.array_join(F.sort_array(F.split(c, " / ")), " / ")).otherwise(c)
    else:
        text = c.cast("string")
    return F.coalesce(F.concat(F.lit("v"), text), F.lit("n"))


def canonical_text(c: Column, kind: DataType, path: str = "", volatile: Sequence[str] = ()) -> Column:
    """Text form of a nested value, driven by its type: struct fields by name without those whose path is in `volatile`, arrays and maps in the order of their texts.

    Leaves are as in `canonical`, preceded by their length, so that no text can look like another's parts. Paths go by field names alone,
    with `key` and `value` for maps: `match_data.offers.offer_id` is the id of each element of an array of structs.
    """
    below = lambda name: f"{path}.{name}" if path else name
    if isinstance(kind, StructType):
        fields = sorted((f for f in kind.fields if below(f.name) not in volatile), key=lambda f: f.name)
        parts = [F.concat(F.lit(f"{f.name}="), canonical_text(c[f.name], f.dataType, below(f.name), volatile)) for f in fields]
        text = F.concat(F.lit("{"), *parts, F.lit("}"))
    elif isinstance(kind, ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.array_sort(F.transform(c, lambda x: canonical_text(x, kind.elementType, path, volatile))), ""), F.lit("]"))
    elif isinstance(kind, MapType):
        entry = lambda e: F.concat(canonical_text(e["key"], kind.keyType, below("key"), volatile), F.lit("="), canonical_text(e["value"], kind.valueType, below("value"), volatile))
        text = F.concat(F.lit("("), F.array_join(F.array_sort(F.transform(F.map_entries(c), entry)), ""), F.lit(")"))
    else:
        leaf = canonical(c, kind.simpleString())
        text = F.concat(F.length(leaf).cast("string"), F.lit(":"), leaf)
    return F.coalesce(F.when(c.isNotNull(), text), F.lit("n"))


def fingerprint(df: DataFrame, cols: Sequence[str], volatile: Sequence[str] = ()) -> Column:
    """SHA-256 of the canonical forms of some columns, in the order of their names; nested ones by `canonical_text`."""
    nested = lambda k: isinstance(k, (StructType, MapType)) or isinstance(k, ArrayType) and isinstance(k.elementType, (StructType, MapType, ArrayType))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    text = lambda n: canonical_text(F.col(n), kinds[n], n, volatile) if nested(kinds[n]) else canonical(F.col(n), kinds[n].simpleString())
    return F.sha2(F.concat_ws("\x1f", *(text(c) for c in sorted(cols) if c not in volatile)), 256)


def changed_ids(base: DataFrame, cand: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Keys on one side only or with unequal fingerprints."""
    a, b = (df.select(key, fingerprint(df, cols).alias(n)) for df, n in ((base, "fa"), (cand, "fb")))
    return a.join(b, key, "full").where(~F.col("fa").eqNullSafe(F.col("fb"))).select(key)


def identity(url: Column, content: Sequence[Column]) -> Column:
    """SHA-256 of the URL, else of a content tuple without prices."""
    parts = F.concat_ws("\x1f", *(F.coalesce(F.lower(F.trim(c.cast("string"))), F.lit("")) for c in content))
    return F.sha2(F.coalesce(F.concat(F.lit("u:"), url), F.concat(F.lit("c:"), parts)), 256)


def content_hashes(df: DataFrame, match: Sequence[str], score: Sequence[str], display: Sequence[str]) -> DataFrame:
    """Adds match_hash, score_hash and display_hash over three sets of fields."""
    return df.withColumns({"match_hash": fingerprint(df, match), "score_hash": fingerprint(df, score), "display_hash": fingerprint(df, display)})


def classify_offers(cur: DataFrame, old: DataFrame, key: str = "offer_id") -> DataFrame:
    """(key, change, action) of hashed snapshots (key, version, match_hash, score_hash, display_hash, is_active); the first difference decides.

    added also for rows that were inactive; action is rematch, rescore, display, remove or null.
    """
    cols = ["version", "match_hash", "score_hash", "display_hash"]
    both = cur.select(key, _struct(cols, "c")).join(old.select(key, _struct([*cols, "is_active"], "o")), key, "full")
    active = F.coalesce(F.col("o.is_active"), F.lit(False))
    differs = lambda c: ~F.col(f"c.{c}").eqNullSafe(F.col(f"o.{c}"))
    change = (
        F.when(F.col("c").isNull() & active, "removed").when(F.col("c").isNull(), "gone").when(~active, "added").when(differs("version"), "version_mismatch")
        .when(differs("match_hash"), "match_changed").when(differs("score_hash"), "score_changed").when(differs("display_hash"), "display_changed").otherwise("unchanged")
    )
    action = F.when(F.col("change").isin("added", "version_mismatch", "match_changed"), "rematch").when(F.col("change") == "removed", "remove").when(F.col("change") == "score_changed", "rescore").when(F.col("change") == "display_changed", "display")
    return both.withColumn("change", change).where("change <> 'gone'").withColumn("action", action).select(key, "change", "action")


def classify_recipes(cur: DataFrame, old: DataFrame, key: str = "recipe_key", row: str = "recipe_id") -> tuple[DataFrame, DataFrame]:
    """((key, change), (row id, action)): as for offers with one source hash; a key whose row id moved gives the new id to rematch and the old to remove."""
    a = cur.select(key, F.struct("version", "source_hash", F.col(row).alias("id")).alias("c"))
    b = old.select(key, F.struct("version", "source_hash", "is_active", F.col(row).alias("id")).alias("o"))
    both = a.join(b, key, "full")
    active = F.coalesce(F.col("o.is_active"), F.lit(False))
    change = (
        F.when(F.col("c").isNull() & active, "removed").when(F.col("c").isNull(), "gone").when(~active, "added").when(F.col("c.version") != F.col("o.version"), "version_mismatch")
        .when(F.col("c.source_hash") != F.col("o.source_hash"), "match_changed").when(F.col("c.id") != F.col("o.id"), "rekeyed").otherwise("unchanged")
    )
    both = both.withColumn("change", change).where("change <> 'gone'")
    redo = F.when(F.col("change").isin("added", "version_mismatch", "match_changed", "rekeyed"), F.struct(F.col("c.id").alias("id"), F.lit("rematch").alias("action")))
    moved = F.col("o.is_active") & (F.col("c").isNull() | (F.col("c.id") != F.col("o.id")))
    drop = F.when(moved, F.struct(F.col("o.id").alias("id"), F.lit("remove").alias("action")))
    acts = both.select(F.explode(F.array_compact(F.array(redo, drop))).alias("x")).select(F.col("x.id").alias(row), "x.action")
    return both.select(key, "change"), acts.distinct()


def _least_action(acts: DataFrame, key: str) -> DataFrame:
    actions = F.array(*map(F.lit, ACTIONS))
    # places are numbers, whose least is found by hashing; least texts would have all rows sorted
    first = F.min(F.array_position(actions, F.col("action"))).cast("int")
    return acts.groupBy(key).agg(F.element_at(actions, first).alias("action"))


def term_actions(changes: DataFrame, terms_old: DataFrame, terms_new: DataFrame, offer: str = "offer_id", strong: Sequence[str] = ("keyword", "parent_keyword")) -> DataFrame:
    """(term, action), stored: the first action that the offers of a term (offer, term, kind) ask of recipes with it.

    Offers to rematch ask by all their terms, old and new; others by the old ones of a strong kind, as a recipe matches an offer by
    such a term (`match.candidates`).
    """
    acts = changes.where("action IS NOT NULL").select(offer, F.when(F.col("action") == "remove", "rematch").otherwise(F.col("action")).alias("action"))
    by_match = terms_old.where(F.col("kind").isin(*strong)).select(offer, "term").join(acts, offer).select("term", "action")
    redo = changes.where("action = 'rematch'").select(offer)
    by_term = terms_old.select(offer, "term").union(terms_new.select(offer, "term")).join(redo, offer, "left_semi").select("term", F.lit("rematch").alias("action"))
    return folders.stored(_least_action(by_match.union(by_term), "term"), "term-actions")


def plan_by_terms(recipe_terms: DataFrame, actions: DataFrame, recipe: str = "recipe_id") -> DataFrame:
    """(recipe, action): the plan of `plan_offer_delta` over the matches of `match.candidates`, from recipes' terms and `term_actions`; no match is made or stored."""
    return _least_action(recipe_terms.select(recipe, "term").join(actions, "term").select(recipe, "action"), recipe)


def plan_offer_delta(changes: DataFrame, terms_old: DataFrame, terms_new: DataFrame, recipe_terms: DataFrame, stored: DataFrame, offer: str = "offer_id", recipe: str = "recipe_id", members: DataFrame | None = None) -> DataFrame:
    """(recipe, action): offers to rematch reach recipes by their terms, old and new, and by stored matches; others by stored matches alone. Each recipe has its first action.

    `stored` has a row for each recipe and offer, or with `members` (offer, class_id) for each recipe and class: then a class takes the first
    action of its members, and the pairs of recipes and offers are never made.
    """
    redo = changes.where("action = 'rematch'").select(offer)
    terms = terms_old.select(offer, "term").union(terms_new.select(offer, "term")).join(redo, offer, "left_semi").select("term").distinct()
    by_term = recipe_terms.join(terms, "term", "left_semi").select(recipe, F.lit("rematch").alias("action"))
    # a recipe that loses an offer is matched again too
    acts = changes.where("action IS NOT NULL").select(offer, F.when(F.col("action") == "remove", "rematch").otherwise(F.col("action")).alias("action"))
    if members is not None:
        acts = _least_action(acts.join(members.select(offer, "class_id"), offer), "class_id")
    by_match = stored.join(acts, offer if members is None else "class_id").select(recipe, "action")
    return _least_action(by_term.union(by_match), recipe)


def combine_plans(a: DataFrame, b: DataFrame, key: str = "recipe_id") -> DataFrame:
    """Two plans as one: rematch before remove before rescore before display."""
    return _least_action(a.select(key, "action").union(b.select(key, "action")), key)


def apply_patch(cache: DataFrame, patch: DataFrame, changed: DataFrame, removed: DataFrame, key: str = "recipe_id") -> DataFrame:
    """`cache` with changed keys replaced by their patch rows and removed ones gone; a key in both sets is removed. Fails before anything is written if the patch has a key outside `changed`."""
    declared = changed.select(key).join(removed.select(key), key, "left_anti")
    if not patch.join(declared, key, "left_anti").isEmpty():
        raise ValueError("the patch has rows outside the declared set")
    touched = changed.select(key).union(removed.select(key)).distinct()
    return cache.join(touched, key, "left_anti").unionByName(patch)


def blocked_list(*lists: tuple[str, DataFrame]) -> DataFrame:
    """(kind, columns of all lists): typed union, with n, the size of the row's list."""
    out = None
    for kind, df in lists:
        n = df.agg(F.count(F.lit(1)).alias("n"))
        rows = df.crossJoin(F.broadcast(n)).withColumn("kind", F.lit(kind))  # one row
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def coverage_diff(cur: DataFrame, base: DataFrame, family: str, key: str) -> DataFrame:
    """(family, missing, extra): ids of the baseline that the current vocabulary lacks, and the reverse, per family."""
    a, b = cur.select(family, key).distinct(), base.select(family, key).distinct()
    both = a.withColumn("in_cur", F.lit(1)).join(b.withColumn("in_base", F.lit(1)), [family, key], "full")
    return both.groupBy(family).agg(F.count_if(F.col("in_cur").isNull()).alias("missing"), F.count_if(F.col("in_base").isNull()).alias("extra"))
