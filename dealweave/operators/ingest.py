"""Scans, cleaning and sinks of offers and recipes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealweave.operators.grams import containing

def scan_offers(df: DataFrame, categories: Sequence[str], side_rules: Sequence[tuple[str, Column]] = (), column: str = "category") -> DataFrame:
    """Rows of some categories, and of each side category those that pass its test. One predicate, so that the scan gets it."""
    wanted = F.col(column).isin(*categories)
    for category, test in side_rules:
        wanted = wanted | ((F.col(column) == category) & test)
    return df.where(wanted)


def keep_first(df: DataFrame, key: str, order: Sequence, nulls: str = "keep") -> tuple[DataFrame, DataFrame]:
    """(rows with the first of each key, one row with dropped: rows that went). Rows without key all stay, or go with nulls="drop"."""
    keyed = df.where(F.col(key).isNotNull())
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    out = first if nulls == "drop" else first.unionByName(df.where(F.col(key).isNull()))
    # counted from the keys alone
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    kept = F.when(F.col(key).isNotNull(), F.lit(1)).otherwise(F.col("n") if nulls == "keep" else F.lit(0))
    return out, per_key.agg(F.coalesce(F.sum(F.col("n") - kept), F.lit(0)).cast("long").alias("dropped"))


def split_valid(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all checks, reason and rows of the rest). A check is (reason, condition that must hold); null fails."""
    reason = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks))
    marked = df.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def normalize_offers(df: DataFrame, unit: str = "st") -> DataFrame:
    """Money in decimals: price rounded, original price defaulting to it, savings not negative, unit defaulted, brand over category, multi-buy total rounded or null."""
    money = "decimal(10,2)"
    price = F.round("price", 2).cast(money)
    return df.withColumns(
        {
            "price": price,
            "original_price": F.coalesce(F.round("original_price", 2).cast(money), price),
            "savings": F.greatest(F.coalesce(F.round("savings", 2), F.lit(0)).cast(money), F.lit(0).cast(money)),
            "unit": F.coalesce("unit", F.lit(unit)),
            "category": F.coalesce("brand_category", "category"),
            "multi_buy_total": F.when(F.col("multi_buy_total") > 0, F.round("multi_buy_total", 2).cast(money)),
        }
    )


def signature(cols: Sequence[str]) -> Column:
    """A row's digest; decimals and doubles are normalised, null is a value of its own."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in cols)), 256)


def snapshot_change(new: DataFrame, old: DataFrame, cols: Sequence[str], valid: Column | None = None) -> DataFrame:
    """One row: n_new, n_old, n_added, n_gone (as multisets of signatures) and action: stale (nothing valid came), keep or replace."""
    good = new if valid is None else new.where(valid)
    a = good.select(signature(cols).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    b = old.select(signature(cols).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("m"))
    both = a.join(b, "s", "full").select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    sums = both.agg(*(F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(k) for k, x in (("n_new", F.col("n")), ("n_old", F.col("m")), ("n_added", F.greatest(F.col("n") - F.col("m"), F.lit(0))), ("n_gone", F.greatest(F.col("m") - F.col("n"), F.lit(0))))))
    action = F.when(F.col("n_new") == 0, "stale").when((F.col("n_added") == 0) & (F.col("n_gone") == 0), "keep").otherwise("replace")
    return sums.withColumn("action", action)


def replace_snapshot(new: DataFrame, old: DataFrame, cols: Sequence[str], root: str, version: str, valid: Column | None = None) -> DataFrame:
    """Writes `new` as version folder `root/version` if it differs from `old`; returns the statistics. Readers of older versions are left alone."""
    stats = snapshot_change(new, old, cols, valid)
    stats = new.sparkSession.createDataFrame(stats.collect(), stats.schema)
    if stats.first()["action"] == "replace":
        (new if valid is None else new.where(valid)).write.mode("errorifexists").parquet(f"{root}/{version}")
    return stats


def publish_snapshot(new: DataFrame, table, cols: Sequence[str], valid: Column | None = None) -> DataFrame:
    """`replace_snapshot` on a versioned table: its next version has the valid rows of `new` alone, if they differ; returns the statistics. Readers keep their version."""
    old = table.read() if table.current() else new.limit(0)
    stats = snapshot_change(new, old, cols, valid)
    stats = new.sparkSession.createDataFrame(stats.collect(), stats.schema)
    if stats.first()["action"] == "replace":
        table.replace(new if valid is None else new.where(valid))
    return stats


def upsert(incoming: DataFrame, target: DataFrame, key: str, excluded: DataFrame | None = None, clear: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(target with the incoming rows, (key, action: created, updated, changed, kept or removed) of each row). Excluded keys do not come in.

    With `clear`, a condition on target rows (those of a source that are not hidden), such rows that do not come in again go.
    """
    if excluded is not None:
        incoming = incoming.join(excluded.select(key), key, "left_anti")
    cols = [c for c in target.columns if c != key]
    a = incoming.select(key, F.struct(*cols).alias("new"))
    b = target.select(key, F.struct(*cols).alias("old"), F.coalesce(F.lit(False) if clear is None else clear, F.lit(False)).alias("_clear"))
    both = a.join(b, key, "full")
    action = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), F.when(F.col("_clear"), "removed").otherwise("kept")).when(F.col("old") == F.col("new"), "updated").otherwise("changed")
    both = both.withColumn("action", action).withColumn("row", F.coalesce("new", "old"))
    return both.where("action <> 'removed'").select(key, "row.*"), both.select(key, "action")


def drop_stale(target: DataFrame, seen: DataFrame, key: str, mine: Column, hidden: Column) -> tuple[DataFrame, DataFrame]:
    """(target without rows of the source that were not seen, removed keys). Hidden rows stay; if nothing was seen, nothing goes."""
    any_seen = seen.agg((F.count(F.lit(1)) > 0).alias("any_seen"))
    marked = target.join(seen.select(key, F.lit(True).alias("was_seen")).distinct(), key, "left").crossJoin(F.broadcast(any_seen))  # one row
    gone = F.col("any_seen") & mine & ~F.coalesce(hidden, F.lit(False)) & F.col("was_seen").isNull()
    marked = marked.withColumn("gone", F.coalesce(gone, F.lit(False)))
    return marked.where("NOT gone").select(*target.columns), marked.where("gone").select(key)


def extract_jsonld(pages: DataFrame, wanted: str, schema: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, found struct): the first object of type `wanted` in the page's JSON-LD blocks, plain, in @graph or in an array; bad JSON is skipped."""
    blocks = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    rows = pages.select(key, F.posexplode(blocks).alias("block", "json"))
    rows = rows.withColumn("v", F.try_parse_json("json"))
    items = F.coalesce(
        F.try_variant_get("v", "$.@graph", "array<variant>"),
        F.try_variant_get("v", "$", "array<variant>"),
        F.when(F.col("v").isNotNull(), F.array("v")),
    )
    rows = rows.select(key, "block", F.posexplode(items).alias("item", "o"))
    kinds = F.coalesce(F.try_variant_get("o", "$.@type", "array<string>"), F.array(F.try_variant_get("o", "$.@type", "string")))
    hits = rows.where(F.array_contains(kinds, wanted))
    first = hits.groupBy(key).agg(F.min_by("o", F.struct("block", "item")).alias("o"))
    return first.select(key, F.from_json(F.to_json("o"), schema).alias("found"))


def iso_minutes(c: Column) -> Column:
    """ISO-8601 duration to minutes by its days, hours and minutes; zero and other texts are null."""
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(c, rf"(\d+){unit}", 1), F.lit("")).cast("long"), F.lit(0))
    total = part("D") * 1440 + part("H") * 60 + F.coalesce(F.nullif(F.regexp_extract(c, r"T(?:\d+H)?(\d+)M", 1), F.lit("")).cast("long"), F.lit(0))
    return F.when(c.rlike("^P") & (total > 0), total)


def tidy_line(c: Column) -> Column:
    """Float noise rounded (1.3333333 to 1.33), common character references decoded, white space squeezed."""
    c = F.regexp_replace(c, r"(\d+\.\d{2})\d{3,}", "$1")
    # Character references.
    for code, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def split_serving(c: Column, word: str = "och", most: int = 60) -> Column:
    """`X, Y och Z` to its three parts if the line is short and holds no digit; other lines as they are."""
    m = rf"^([^,\d]{{2,}}), ([^,\d]{{2,}}) {word} ([^,\d]{{2,}})$"
    parts = F.array(*(F.regexp_extract(c, m, i) for i in (1, 2, 3)))
    return F.when((F.length(c) <= most) & c.rlike(m), parts).otherwise(F.array(c))


def clean_recipes(df: DataFrame, word: str = "och") -> DataFrame:
    """`df` (duration, image_url, lines) with minutes, image_url only if it is http, and lines tidied and split."""
    lines = F.flatten(F.transform("lines", lambda x: split_serving(tidy_line(x), word)))
    return df.withColumns({"minutes": iso_minutes(F.col("duration")), "image_url": F.when(F.col("image_url").rlike("^https?://"), F.col("image_url")), "lines": lines})


def package_grams(c: Column) -> Column:
    """Grams or millilitres of a size text: the part after the last slash, comma decimals, units by precedence; null without a unit."""
    tail = F.lower(F.replace(F.element_at(F.split(c, "/"), -1), F.lit(","), F.lit(".")))
    # Units in order of precedence, with their factors.
    units = (("kg", 1000), ("g", 1), ("dl", 100), ("cl", 10), ("ml", 1), ("l", 1000))
    found = [F.nullif(F.regexp_extract(tail, rf"(\d+(?:\.\d+)?)\s*{u}(?![a-z])", 1), F.lit("")).cast("double") * f for u, f in units]
    return F.round(F.coalesce(*found), 1)


def parse_rate(df: DataFrame, source: str, value: str) -> DataFrame:
    """(source, rows, parsed, rate in percent) of a parsed column."""
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("rows"), F.count(value).alias("parsed"), F.round(100.0 * F.count(value) / F.count(F.lit(1)), 1).alias("rate"))


def price_promotions(df: DataFrame, text: str = "promo", ordinary: str = "ordinary_price", weight: str = "weight_grams") -> DataFrame:
    """Adds deal_price, deal_quantity, deal_total from a promotion text, by the first form that fits.

    Forms: `N for T`, `buy N pay for M`, `p % off`, `X kr/kg` times the package weight, `short date` (half
    price), `X kr`. Ordinary price is the base where a form needs one.
    """
    t, money = F.lower(F.replace(F.col(text), F.lit(","), F.lit("."))), "decimal(10,2)"
    number = lambda pattern, i=1: F.nullif(F.regexp_extract(t, pattern, i), F.lit("")).cast("decimal(10,2)")
    n_for, total = number(r"(\d+) for (\d+(?:\.\d+)?)"), number(r"(\d+) for (\d+(?:\.\d+)?)", 2)
    buy, pay = number(r"buy (\d+) pay for (\d+)"), number(r"buy (\d+) pay for (\d+)", 2)
    percent, per_kg, headline = number(r"(\d+(?:\.\d+)?) ?% off"), number(r"(\d+(?:\.\d+)?) kr/kg"), number(r"(\d+(?:\.\d+)?) kr(?!/)")
    base = F.col(ordinary).cast(money)
    price = F.coalesce(
        total / n_for,
        base * pay / buy,
        base * (100 - percent) / 100,
        per_kg * F.col(weight).cast(money) / 1000,
        F.when(t.contains("short date"), base / 2),
        headline,
    )
    return df.withColumns(
        {
            "deal_price": F.round(price, 2).cast(money),
            "deal_quantity": F.coalesce(n_for, buy).cast("int"),
            "deal_total": F.round(F.coalesce(total, base * pay), 2).cast(money),
        }
    )


def collapse_duplicates(df: DataFrame, url: str, name: str, others: Sequence[str], fill: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per logical product (URL, else name and `others`): lowest price, then highest savings, then first; its nulls in `fill` come from the others.

    The winner's original price rises to the best of the group if the saving that follows is not above its price.
    """
    key = F.coalesce(F.concat(F.lit("u"), F.col(url)), F.concat_ws("\x1f", F.lit("n"), F.lower(F.trim(F.col(name))), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in others)))
    by = [F.col("price"), F.desc("savings"), *map(F.col, order)]
    ranked = Window.partitionBy("_key").orderBy(*by)
    all_rows = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = df.withColumn("_key", key).withColumn("_n", F.row_number().over(ranked))
    out = out.withColumns({c: F.coalesce(c, F.first(c, ignorenulls=True).over(all_rows)) for c in fill})
    out = out.withColumn("_best", F.max("original_price").over(all_rows)).where("_n = 1")
    gain = F.col("_best") - F.col("price")
    return out.withColumn("original_price", F.when(gain <= F.col("price"), F.col("_best")).otherwise(F.col("original_price"))).drop("_key", "_n", "_best")


def propagate_in_group(df: DataFrame, bucket: Sequence[str]) -> DataFrame:
    """Fills a null original_price from its bucket where all members that have one agree, unless the saving would exceed the price."""
    agreed = df.groupBy(*bucket).agg(F.count_distinct("original_price").alias("_n"), F.max("original_price").alias("_v")).where("_n = 1").drop("_n")
    out = df.join(agreed, list(bucket), "left")
    fits = F.col("_v") - F.col("price") <= F.col("price")
    return out.withColumn("original_price", F.coalesce("original_price", F.when(fits, F.col("_v")))).drop("_v")


def drop_parents(df: DataFrame, group: str, is_parent: Column) -> DataFrame:
    """`df` without parent rows whose group has a concrete row."""
    concrete = df.where(~is_parent).select(F.col(group).alias("_g")).distinct()
    parents = df.where(is_parent).join(concrete, F.col(group) == F.col("_g"), "left_anti")
    return df.where(~is_parent).unionByName(parents)


def nearest_above(df: DataFrame, candidates: DataFrame, key: str, price: str, hard: Column | None = None) -> DataFrame:
    """Adds reference_price: the least candidate price of the key strictly above the row's price; null if the saving exceeds the price, or for hard goods over five times it."""
    c = candidates.select(F.col(key).alias("_k"), F.col("candidate").alias("_c")).distinct()
    joined = df.withColumn("_id", F.struct(*df.columns)).join(c, (F.col(key) == F.col("_k")) & (F.col("_c") > F.col(price)), "left")
    best = joined.groupBy("_id").agg(F.min("_c").alias("reference_price")).select("_id.*", "reference_price")
    limit = F.when(F.coalesce(hard, F.lit(False)), F.col(price) * 5).otherwise(F.col(price) * 2) if hard is not None else F.col(price) * 2
    return best.withColumn("reference_price", F.when(F.col("reference_price") <= limit, F.col("reference_price")))


def cascade_filter(df: DataFrame, rules: Sequence[tuple[str, Column, bool]], unknown: str = "unknown") -> DataFrame:
    """Adds accepted and reason by the first rule (reason, condition, accepts) that holds; no rule rejects as `unknown`."""
    first = F.coalesce(*(F.when(cond, F.struct(F.lit(name).alias("reason"), F.lit(ok).alias("accepted"))) for name, cond, ok in rules), F.struct(F.lit(unknown).alias("reason"), F.lit(False).alias("accepted")))
    return df.withColumn("_r", first).select(*df.columns, "_r.accepted", "_r.reason")


def drop_exact(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """`df` without rows whose trimmed lower name is in `names` (name)."""
    key = F.lower(F.trim(F.col(column)))
    return df.join(names.select(F.lower(F.trim("name")).alias("_x")).distinct(), key == F.col("_x"), "left_anti")


def categorize(df: DataFrame, rules: DataFrame, key: str, columns: Sequence[str], default: str) -> DataFrame:
    """(key, target): by `columns` in turn, the category of least priority of which a keyword (rules: keyword, target, priority) is contained."""
    out = df.select(key, *columns)
    for n, column in enumerate(columns):
        # distinct texts meet the keywords by shared grams
        texts, lower = df.select(F.lower(column).alias("_t")), rules.withColumn("_k", F.lower("keyword"))
        hit = containing(texts, lower, "_t", "_k").join(lower, "_k").groupBy("_t").agg(F.min_by("target", F.struct("priority", "target")).alias(f"_c{n}"))
        out = out.withColumn("_t", F.lower(column)).join(hit, "_t", "left").drop("_t")
    return out.select(key, F.coalesce(*(F.col(f"_c{n}") for n in range(len(columns))), F.lit(default)).alias("target"))


# Tracking parameters that are dropped from URLs, besides those that start with utm_.
TRACKING = ("fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid")


def canonical_url(c: Column) -> Column:
    """Scheme and host in lower case, no default port, fragment, trailing slash or tracking parameters; other parameters in order."""
    c = F.regexp_replace(F.trim(c), "#.*$", "")
    scheme = F.lower(F.regexp_extract(c, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(c, "://([^/?]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(c, "://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(c, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?i:utm_[^=]*|{'|'.join(TRACKING)})(=|$)"))
    return F.concat(scheme, F.lit("://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def select_frontier(candidates: DataFrame, known: DataFrame, excluded: DataFrame, misses: DataFrame, budget: int, now: Column, order: str) -> DataFrame:
    """Candidates (url, order) with url canonical and reason: duplicate, known, excluded, retry_later, over_budget, or null for the selected."""
    rows = candidates.withColumn("url", canonical_url(F.col("url")))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy(order)))
    for name, other in (("known", known), ("excluded", excluded)):
        rows = rows.join(other.select(canonical_url(F.col("url")).alias("url"), F.lit(True).alias(f"_{name}")).distinct(), "url", "left")
    waiting = misses.where(F.col("next_retry_at") > now).select(canonical_url(F.col("url")).alias("url"), F.lit(True).alias("_wait")).distinct()
    rows = rows.join(waiting, "url", "left")
    reason = F.when(F.col("_n") > 1, "duplicate").when(F.col("_known"), "known").when(F.col("_excluded"), "excluded").when(F.col("_wait"), "retry_later")
    rows = rows.withColumn("reason", reason)
    # the budget goes by order among the free ones: only the first `budget` of them are ranked
    chosen = rows.where("reason IS NULL").orderBy(order).limit(budget).select("url", F.lit(True).alias("_in"))
    rows = rows.join(chosen, "url", "left")
    return rows.withColumn("reason", F.when(F.col("reason").isNull() & F.col("_in").isNull(), "over_budget").otherwise(F.col("reason"))).select(*candidates.columns, "reason")


# Days until the next try of permanent misses by retry count modulo four, of temporary ones, and until misses are purged.
RETRY_DAYS = (180, 30, 45, 90)
TEMPORARY_DAYS = 3
MISS_RETENTION_DAYS = 690
RUN_RETENTION_DAYS = 30


def retry_days(count: Column, temporary: Column) -> Column:
    return F.when(temporary, F.lit(TEMPORARY_DAYS)).otherwise(F.element_at(F.array(*map(F.lit, RETRY_DAYS)), (count % 4 + 1).cast("int")))


def record_misses(state: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State (keys, retry_count, last_reason, next_retry_at) after a batch (keys, at, ok, temporary, reason).

    A success deletes the key; later misses count anew. The last miss sets reason and next try.
    """
    last_ok = batch.where("ok").groupBy(*keys).agg(F.max("at").alias("_ok"))
    misses = batch.where("NOT ok").join(last_ok, list(keys), "left").where(F.col("_ok").isNull() | (F.col("at") > F.col("_ok")))
    new = misses.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max_by(F.struct("reason", "temporary", "at"), F.struct("at", "reason")).alias("_m"))
    both = state.join(new, list(keys), "full").join(last_ok, list(keys), "left")
    before = F.when(F.col("_ok").isNull(), F.coalesce("retry_count", F.lit(0))).otherwise(F.lit(0))
    both = both.withColumn("_c", before + F.coalesce("_n", F.lit(0))).where("_n IS NOT NULL OR _ok IS NULL")
    due = F.col("_m.at") + F.make_dt_interval(retry_days(F.col("_c"), F.col("_m.temporary")))
    return both.select(*keys, F.col("_c").cast("long").alias("retry_count"), F.coalesce("_m.reason", "last_reason").alias("last_reason"), F.coalesce(due, F.col("next_retry_at")).alias("next_retry_at"))


def purge_older(df: DataFrame, ts: str, days: int, now: Column) -> DataFrame:
    return df.where(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))
