"""Queries of the scans, cleaning and predicates."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from dealweave.functions import matching as M
from dealweave.operators import filters as B
from dealweave.operators import ingest as A
from dealweave.plans.base import doc_lines, next_offers, offers, query, recipes, runs, table, views

CATEGORIES = ["ECONOMY", "STANDARD"]


@query("a01_scan_offers", "SELECT p_partkey, p_name, p_type FROM part WHERE p_type IN ('ECONOMY', 'STANDARD') OR (p_type = 'PROMO' AND p_name LIKE '%bolt%') OR (p_type = 'SMALL' AND p_size > 40)")
def a01(spark, d):
    rules = [("PROMO", F.col("p_name").contains("bolt")), ("SMALL", F.col("p_size") > 40)]
    return A.scan_offers(table(spark, d, "part"), CATEGORIES, rules, "p_type").select("p_partkey", "p_name", "p_type")


@query("a02_keep_first", "WITH u AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS link FROM pages), k AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_id) AS n FROM u) SELECT page_id, link, (SELECT count(*) FROM k WHERE n > 1) AS dropped FROM k WHERE n = 1")
def a02(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("link"))
    first, dropped = A.keep_first(pages, "link", ["page_id"])
    return first.crossJoin(F.broadcast(dropped))  # one row


@query("a03_split_valid", "SELECT CASE WHEN p_name LIKE 'red%' THEN 'red_name' WHEN p_retailprice <= 920 THEN 'low_price' END AS reason, count(*) AS rows FROM part WHERE p_name LIKE 'red%' OR p_retailprice <= 920 GROUP BY 1")
def a03(spark, d):
    return A.split_valid(table(spark, d, "part"), [("red_name", ~F.col("p_name").startswith("red")), ("low_price", F.col("p_retailprice") > 920)])[1]


@query(
    "a04_normalize_offers",
    """SELECT l_orderkey, l_partkey, price, CASE WHEN l_discount = 0 THEN price ELSE CAST(l_extendedprice + 1 AS DECIMAL(10,2)) END AS original_price, greatest(savings, 0) AS savings,
    CASE WHEN l_linestatus = 'O' THEN 'kg' ELSE 'st' END AS unit, CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE l_linestatus END AS category,
    CASE WHEN l_quantity > 40 THEN price * 2 END AS multi_buy_total
    FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(10,2)) AS price, CAST(l_quantity - 25 AS DECIMAL(10,2)) AS savings FROM lineitem)""",
)
def a04(spark, d):
    li = table(spark, d, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(10,2)")
    rows = li.select(
        "l_orderkey", "l_partkey", price.alias("price"), F.when(F.col("l_discount") != 0, F.col("l_extendedprice") + 1).alias("original_price"), (F.col("l_quantity") - 25).alias("savings"),
        F.when(F.col("l_linestatus") == "O", "kg").alias("unit"), F.when(F.col("l_returnflag") == "R", "returned").alias("brand_category"), F.col("l_linestatus").alias("category"),
        F.when(F.col("l_quantity") > 40, price * 2).alias("multi_buy_total"),
    )
    return A.normalize_offers(rows).drop("brand_category")


@query(
    "a05_snapshot_change",
    views("offers", "next_offers") + """, a AS (SELECT offer_id, original_price, savings, count(*) AS n FROM next_offers GROUP BY ALL), b AS (SELECT offer_id, original_price, savings, count(*) AS n FROM offers GROUP BY ALL)
    SELECT CAST(coalesce(sum(a.n), 0) AS BIGINT) AS n_new, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS n_old, CAST(sum(greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0)) AS BIGINT) AS n_added,
    CAST(sum(greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0)) AS BIGINT) AS n_gone, 'replace' AS action FROM a FULL JOIN b USING (offer_id, original_price, savings)""",
)
def a05(spark, d):
    return A.snapshot_change(next_offers(spark, d), offers(spark, d), ["offer_id", "original_price", "savings"])


@query(
    "a06_upsert",
    """WITH t AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0), i AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 11 <> 0)
    SELECT o_orderkey, CASE WHEN t.o_totalprice IS NULL THEN 'created' WHEN i.o_totalprice IS NULL THEN 'kept' WHEN t.o_totalprice = i.o_totalprice THEN 'updated' ELSE 'changed' END AS action FROM t FULL JOIN i USING (o_orderkey)""",
)
def a06(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    new = o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return A.upsert(new, o.where("o_orderkey % 5 <> 0"), "o_orderkey", o.where("o_orderkey % 11 = 0"))[1]


@query("a07_drop_stale", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 <> 0 AND o_orderpriority <> '5-LOW'")
def a07(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return A.drop_stale(o, o.where("o_orderkey % 4 = 0"), "o_orderkey", F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "5-LOW")[1]


@query(
    "a08_extract_jsonld",
    """WITH h AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '<script type="application/ld+json">{bad</script>' ELSE '' END || html ||
        CASE WHEN page_id % 3 = 0 THEN '<script type="application/ld+json">{"@graph":[{"@type":"Thing"},{"@type":["Recipe","X"],"name":"n' || page_id || '"}]}</script>' ELSE '' END AS html FROM pages),
    b AS (SELECT page_id, unnest(l) AS j, generate_subscripts(l, 1) AS block FROM (SELECT page_id, regexp_extract_all(html, '(?is)<script[^>]*type=["'']application/ld\\+json["''][^>]*>(.*?)</script>', 1) AS l FROM h)),
    v AS (SELECT page_id, block, CAST(j AS JSON) AS j FROM b WHERE json_valid(j)),
    i AS (SELECT page_id, block, CASE WHEN json_type(j -> '$."@graph"') = 'ARRAY' THEN CAST(j -> '$."@graph"' AS JSON[]) WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) ELSE [j] END AS items FROM v),
    o AS (SELECT page_id, block, unnest(items) AS o, generate_subscripts(items, 1) AS item FROM i)
    SELECT page_id, arg_min(o ->> '$.name', block * 100000 + item) AS name FROM o
    WHERE CASE WHEN json_type(o -> '$."@type"') = 'ARRAY' THEN list_contains(CAST(o -> '$."@type"' AS VARCHAR[]), 'Recipe') ELSE (o ->> '$."@type"') = 'Recipe' END GROUP BY 1""",
)
def a08(spark, d):
    pages = table(spark, d, "pages").select("page_id", "html")
    one = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"Thing"},{"@type":["Recipe","X"],"name":"n'), F.col("page_id"), F.lit('"}]}</script>'))
    bad = F.lit('<script type="application/ld+json">{bad</script>')
    pages = pages.withColumn("html", F.concat(F.when(F.col("page_id") % 2 == 0, bad).otherwise(F.lit("")), F.col("html"), F.when(F.col("page_id") % 3 == 0, one).otherwise(F.lit(""))))
    return A.extract_jsonld(pages, "Recipe", "struct<name:string>").select("page_id", F.col("found.name").alias("name"))


@query(
    "a09_clean_recipes",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE (doc_id % 24) * 60 + doc_id % 60 END AS minutes, CASE WHEN doc_id % 2 = 0 THEN 'http://x/' || doc_id END AS image_url,
    CASE WHEN doc_id % 3 = 0 THEN 'rice' || '|' || 'salad' || '|' || 'bread' ELSE '1.33 dl ' || source || ' & ' || lang END AS lines
    FROM documents""",
)
def a09(spark, d):
    docs = table(spark, d, "documents")
    duration = F.when(F.col("doc_id") % 4 == 0, "PT0M").otherwise(F.concat(F.lit("PT"), F.col("doc_id") % 24, F.lit("H"), F.col("doc_id") % 60, F.lit("M")))
    line = F.when(F.col("doc_id") % 3 == 0, F.lit("rice, salad och bread")).otherwise(F.concat(F.lit("1.3333333 dl  "), "source", F.lit(" &amp; "), "lang"))
    rows = docs.select("doc_id", duration.alias("duration"), F.concat(F.when(F.col("doc_id") % 2 == 0, "http://x/").otherwise("data:"), "doc_id").alias("image_url"), F.array(line).alias("lines"))
    return A.clean_recipes(rows).select("doc_id", "minutes", "image_url", F.array_join("lines", "|").alias("lines"))


@query(
    "a10_package_sizes",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size * 1000.0 WHEN 1 THEN CAST(p_size AS DOUBLE) WHEN 2 THEN p_size * 100 + 50.0 WHEN 3 THEN p_size * 10.0 END AS grams FROM part""",
)
def a10(spark, d):
    k, size = F.col("p_partkey") % 5, F.col("p_size")
    text = F.when(k == 0, F.concat(F.lit("x 9 g/"), size, F.lit(" kg"))).when(k == 1, F.concat(size, F.lit("g"))).when(k == 2, F.concat(size, F.lit(",5 dl"))).when(k == 3, F.concat(size, F.lit("cl"))).otherwise(F.concat(size, F.lit(" pcs")))
    return table(spark, d, "part").select("p_partkey", A.package_grams(text).alias("grams"))


@query("a10_parse_rate", "SELECT p_type, count(*) AS rows, count(CASE WHEN p_partkey % 5 <> 4 THEN 1 END) AS parsed, round(100.0 * count(CASE WHEN p_partkey % 5 <> 4 THEN 1 END) / count(*), 1) AS rate FROM part GROUP BY p_type")
def a10_rate(spark, d):
    sizes = a10(spark, d).join(table(spark, d, "part").select("p_partkey", "p_type"), "p_partkey")
    return A.parse_rate(sizes, "p_type", "grams")


@query(
    "a11_price_promotions",
    """WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(10,2)) AS p, CAST(l_quantity AS INTEGER) AS q FROM lineitem)
    SELECT l_orderkey, l_partkey, l_linenumber,
    CAST(round(CASE l_partkey % 6 WHEN 0 THEN CAST(q AS DECIMAL(10,2)) * 5 WHEN 1 THEN CAST(p * 2 AS DOUBLE) / 3 WHEN 2 THEN CAST(round(p * 0.75, 2) AS DOUBLE) WHEN 3 THEN CAST(q AS DECIMAL(10,2)) * 0.5 WHEN 4 THEN CAST(round(p * 0.5, 2) AS DOUBLE) ELSE CAST(q AS DECIMAL(10,2)) END, 2) AS DECIMAL(10,2)) AS deal_price,
    CASE l_partkey % 6 WHEN 0 THEN 2 WHEN 1 THEN 3 END AS deal_quantity, CAST(CASE l_partkey % 6 WHEN 0 THEN CAST(q AS DECIMAL(10,2)) * 10 WHEN 1 THEN p * 2 END AS DECIMAL(10,2)) AS deal_total FROM r""",
)
def a11(spark, d):
    k, q = F.col("l_partkey") % 6, F.col("l_quantity").cast("int")
    text = F.when(k == 0, F.concat(F.lit("2 for "), q * 10)).when(k == 1, F.lit("Buy 3 pay for 2")).when(k == 2, F.lit("25 % off")).when(k == 3, F.concat(q, F.lit(" kr/kg"))).when(k == 4, F.lit("Short date")).otherwise(F.concat(q, F.lit(",00 kr")))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", text.alias("promo"), F.col("l_extendedprice").alias("ordinary_price"), F.lit(500).alias("weight_grams"))
    return A.price_promotions(rows).select("l_orderkey", "l_partkey", "l_linenumber", "deal_price", "deal_quantity", "deal_total")


@query(
    "a12_collapse_duplicates",
    """WITH r AS (SELECT l_partkey, CAST(l_extendedprice AS DECIMAL(10,2)) AS price, CAST(l_discount * 100 AS BIGINT) AS savings, CAST(CAST(l_extendedprice AS DECIMAL(10,2)) * 1.5 AS DECIMAL(10,2)) AS original_price, CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey END AS image, l_orderkey, l_linenumber, l_suppkey, l_shipdate FROM lineitem),
    w AS (SELECT *, row_number() OVER o AS n, first_value(image IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS img, max(original_price) OVER (PARTITION BY l_partkey) AS best FROM r WINDOW o AS (PARTITION BY l_partkey ORDER BY price, savings DESC, l_orderkey, l_linenumber, l_suppkey, l_shipdate))
    SELECT l_partkey, price, savings, CASE WHEN best - price <= price THEN best ELSE original_price END AS original_price, coalesce(image, img) AS image FROM w WHERE n = 1""",
)
def a12(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select(
        "l_partkey", F.col("l_extendedprice").cast("decimal(10,2)").alias("price"), F.round(F.col("l_discount") * 100).cast("long").alias("savings"), (F.col("l_extendedprice").cast("decimal(10,2)") * F.lit(Decimal("1.5"))).cast("decimal(10,2)").alias("original_price"),
        F.when(F.col("l_suppkey") % 3 == 0, F.col("l_suppkey")).alias("image"), "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", F.lit(None).cast("string").alias("url"), F.concat(F.lit("P"), F.col("l_partkey")).alias("name"),
    )
    out = A.collapse_duplicates(rows, "url", "name", [], ["image"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate"])
    return out.select("l_partkey", "price", "savings", "original_price", "image")


@query(
    "a13_propagate_in_group",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity AS price, CASE WHEN l_suppkey % 2 = 0 THEN l_quantity + (l_orderkey % 3) * 20 END AS original_price FROM lineitem),
    g AS (SELECT l_orderkey, l_returnflag, price, max(original_price) AS v FROM r GROUP BY 1, 2, 3 HAVING count(DISTINCT original_price) = 1)
    SELECT r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey, r.price, coalesce(original_price, CASE WHEN v - r.price <= r.price THEN v END) AS original_price
    FROM r LEFT JOIN g ON r.l_orderkey = g.l_orderkey AND r.l_returnflag = g.l_returnflag AND r.price = g.price""",
)
def a13(spark, d):
    price = F.when(F.col("l_suppkey") % 2 == 0, F.col("l_quantity") + F.col("l_orderkey") % 3 * 20)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_quantity").alias("price"), price.alias("original_price"))
    return A.propagate_in_group(rows, ["l_orderkey", "l_returnflag", "price"]).drop("l_returnflag")


@query("a14_drop_parents", "SELECT o_orderkey, o_custkey FROM orders o WHERE o_orderstatus <> 'P' OR NOT EXISTS (SELECT 1 FROM orders c WHERE c.o_custkey = o.o_custkey AND c.o_orderstatus <> 'P')")
def a14(spark, d):
    return A.drop_parents(table(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") == "P").select("o_orderkey", "o_custkey")


@query(
    "a15_nearest_above",
    views("offers") + """, c AS (SELECT l_partkey, CAST(floor(l_extendedprice / l_quantity) AS DECIMAL(10,2)) AS candidate FROM lineitem WHERE l_quantity > 0),
    b AS (SELECT offer_id, original_price, brand, min(candidate) AS reference_price FROM offers LEFT JOIN c ON l_partkey = offer_id AND candidate > original_price GROUP BY 1, 2, 3)
    SELECT offer_id, original_price, CASE WHEN reference_price <= original_price * (CASE WHEN brand = 'Brand#2' THEN 5 ELSE 2 END) THEN reference_price END AS reference_price FROM b""",
)
def a15(spark, d):
    cand = table(spark, d, "lineitem").where("l_quantity > 0").select(F.col("l_partkey").alias("offer_id"), F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(10,2)").alias("candidate"))
    rows = offers(spark, d).select("offer_id", "original_price", "brand")
    return A.nearest_above(rows, cand, "offer_id", "original_price", F.col("brand") == "Brand#2").drop("brand")


@query(
    "a16_cascade_filter",
    """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN false WHEN p_name LIKE '%bolt%' THEN false WHEN p_type IN ('ECONOMY','STANDARD') THEN true WHEN p_name LIKE 'red%' THEN true ELSE false END AS accepted,
    CASE WHEN p_type = 'PROMO' THEN 'promo' WHEN p_name LIKE '%bolt%' THEN 'hardware' WHEN p_type IN ('ECONOMY','STANDARD') THEN 'listed' WHEN p_name LIKE 'red%' THEN 'red' ELSE 'unknown' END AS reason FROM part""",
)
def a16(spark, d):
    name, kind = F.col("p_name"), F.col("p_type")
    rules = [("promo", kind == "PROMO", False), ("hardware", name.contains("bolt"), False), ("listed", kind.isin("ECONOMY", "STANDARD"), True), ("red", name.startswith("red"), True)]
    return A.cascade_filter(table(spark, d, "part"), rules).select("p_partkey", "accepted", "reason")


@query("a17_drop_exact", "SELECT p_partkey, p_name FROM part WHERE lower(trim(p_name)) NOT IN ('red bolt', 'old gear', 'new rod')")
def a17(spark, d):
    names = spark.createDataFrame([("Red bolt ",), ("old gear",), ("NEW rod",)], "name string")
    return A.drop_exact(table(spark, d, "part"), names, "p_name").select("p_partkey", "p_name")


RULES = [("widget", "tools", 3), ("gear", "machines", 1), ("red", "colours", 2), ("economy", "cheap", 4), ("promo", "deals", 5)]


@query(
    "a18_categorize",
    """WITH r(keyword, target, priority) AS (VALUES ('widget','tools',3), ('gear','machines',1), ('red','colours',2), ('economy','cheap',4), ('promo','deals',5)),
    a AS (SELECT p_partkey, arg_min(target, priority) AS t FROM part JOIN r ON contains(lower(p_type), keyword) GROUP BY 1), b AS (SELECT p_partkey, arg_min(target, priority) AS t FROM part JOIN r ON contains(lower(p_name), keyword) GROUP BY 1)
    SELECT p_partkey, coalesce(a.t, b.t, 'other') AS target FROM part LEFT JOIN a USING (p_partkey) LEFT JOIN b USING (p_partkey)""",
)
def a18(spark, d):
    rules = spark.createDataFrame(RULES, "keyword string, target string, priority int")
    return A.categorize(table(spark, d, "part"), rules, "p_partkey", ["p_type", "p_name"], "other")


URL_SQL = """u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS c FROM pages),
    p AS (SELECT page_id, lower(regexp_extract(c, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(c, '://([^/?]*)', 1)) AS host, regexp_replace(regexp_extract(c, '://[^/?]*([^?]*)', 1), '/+$', '') AS path,
        list_filter(string_split(regexp_extract(c, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid)(=|$)', 'i')) AS q FROM u),
    canon AS (SELECT page_id, scheme || '://' || host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM p)"""


@query("a19_canonical_url", f"WITH {URL_SQL} SELECT page_id, url FROM canon")
def a19(spark, d):
    return table(spark, d, "pages").select("page_id", A.canonical_url(F.col("url")).alias("url"))


@query(
    "a20_select_frontier",
    f"""WITH {URL_SQL}, n AS (SELECT page_id, url, row_number() OVER (PARTITION BY url ORDER BY page_id) AS k FROM canon),
    m AS (SELECT *, CASE WHEN k > 1 THEN 'duplicate' WHEN url IN (SELECT url FROM canon WHERE page_id % 5 = 0) THEN 'known' WHEN url IN (SELECT url FROM canon WHERE page_id % 7 = 0) THEN 'excluded' WHEN url IN (SELECT url FROM canon WHERE page_id % 9 = 0) THEN 'retry_later' END AS r FROM n),
    f AS (SELECT *, row_number() OVER (PARTITION BY r IS NULL ORDER BY page_id) AS free FROM m)
    SELECT page_id, url, CASE WHEN r IS NULL AND free > 20 THEN 'over_budget' ELSE r END AS reason FROM f""",
)
def a20(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    misses = pages.where("page_id % 9 = 0").withColumn("next_retry_at", F.lit("2024-02-01").cast("timestamp"))
    return A.select_frontier(pages, pages.where("page_id % 5 = 0"), pages.where("page_id % 7 = 0"), misses, 20, F.lit("2024-01-15").cast("timestamp"), "page_id")


@query(
    "a21_record_misses",
    """WITH b AS (SELECT CAST(user_id AS BIGINT) AS user_id, ts, event_type FROM events WHERE event_type IN ('error', 'view', 'purchase')), ok AS (SELECT user_id, max(ts) AS t FROM b WHERE event_type = 'purchase' GROUP BY 1),
    m AS (SELECT b.*, row_number() OVER (PARTITION BY b.user_id ORDER BY b.ts DESC, event_type DESC) AS k, count(*) OVER (PARTITION BY b.user_id) AS n FROM b LEFT JOIN ok USING (user_id) WHERE event_type <> 'purchase' AND (t IS NULL OR ts > t))
    SELECT user_id, n AS retry_count, event_type AS last_reason, ts + to_days(CAST(CASE WHEN event_type = 'view' THEN 3 WHEN n % 4 = 0 THEN 180 WHEN n % 4 = 1 THEN 30 WHEN n % 4 = 2 THEN 45 ELSE 90 END AS INTEGER)) AS next_retry_at FROM m WHERE k = 1""",
)
def a21(spark, d):
    e = table(spark, d, "events").where("event_type IN ('error', 'view', 'purchase')")
    batch = e.select("user_id", F.col("ts").alias("at"), (F.col("event_type") == "purchase").alias("ok"), (F.col("event_type") == "view").alias("temporary"), F.col("event_type").alias("reason"))
    state = spark.createDataFrame([], "user_id long, retry_count long, last_reason string, next_retry_at timestamp")
    return A.record_misses(state, batch, ["user_id"])


@query("a22_purge_older", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-02-14' - INTERVAL 30 DAY")
def a22(spark, d):
    return A.purge_older(table(spark, d, "events").select("event_id", "ts"), "ts", A.RUN_RETENTION_DAYS, F.lit("2024-02-14").cast("timestamp"))


PREFS = B.Preferences(excluded_categories=["PROMO"], category_exemptions=["ring"], local_category="ECONOMY", local_words=["red", "blue"], specialty_words=["gizmo"], excluded_words=["anvil"], excluded_brands=["brand#3"], non_food_brands=["Brand#4"], processed_words=["hot g", "cold"], processed_exemptions=["plate"])

REASON_SQL = """CASE WHEN coalesce(savings, 0) <= 0 THEN 'no_savings' WHEN category = 'PROMO' AND NOT list_contains(w, 'ring') THEN 'excluded_category'
    WHEN category = 'ECONOMY' AND NOT list_has_any(w, ['red', 'blue']) AND NOT list_contains(w, 'gizmo') THEN 'not_local' WHEN list_contains(w, 'anvil') THEN 'excluded_word'
    WHEN lower(brand) = 'brand#3' THEN 'excluded_brand' WHEN lower(brand) = 'brand#4' THEN 'non_food_brand' WHEN (contains(lower(name), 'hot g') OR contains(lower(name), 'cold')) AND NOT list_contains(w, 'plate') THEN 'processed' END"""


@query("b01_eligible_offers", views("offers") + f", o AS (SELECT *, string_split(lower(name), ' ') AS w FROM offers) SELECT offer_id, name, savings FROM o WHERE ({REASON_SQL}) IS NULL")
def b01(spark, d):
    return B.eligible_offers(offers(spark, d), PREFS).select("offer_id", "name", "savings")


@query(
    "b02_audit_offers",
    views("offers") + f""", o AS (SELECT *, string_split(lower(name), ' ') AS w FROM offers), r AS (SELECT *, {REASON_SQL} AS r FROM o)
    SELECT offer_id, coalesce(r, CASE WHEN offer_id % 2 = 0 THEN 'matched' WHEN offer_id % 3 = 0 THEN 'no_recipe_match' ELSE 'no_keywords' END) AS reason,
    CASE WHEN r = 'excluded_word' THEN 'anvil' WHEN r = 'processed' THEN CASE WHEN contains(lower(name), 'hot g') THEN 'hot g' ELSE 'cold' END END AS word FROM r""",
)
def b02(spark, d):
    o = offers(spark, d)
    return B.audit_offers(o, PREFS, o.where("offer_id % 3 = 0"), o.where("offer_id % 2 = 0"))


WORDS_SQL = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@query(
    "b03_match_modes",
    f"""WITH w AS (SELECT doc_id, lower(text) AS t, {WORDS_SQL.format('text')} AS w FROM documents)
    SELECT doc_id, contains(t, 'tion') AS substring, list_contains(w, 'the') AS word, len(list_filter(w, lambda x: starts_with(x, 'ther'))) > 0 AS start, len(list_filter(w, lambda x: starts_with(x, 'ing') OR ends_with(x, 'ing'))) > 0 AS edge, list_contains(w, 'of') AS short FROM w""",
)
def b03(spark, d):
    t = F.col("text")
    modes = {"substring": ("tion", "substring"), "word": ("the", "word"), "start": ("ther", "start"), "edge": ("ing", "edge"), "short": ("of", "substring")}
    return table(spark, d, "documents").select("doc_id", *(M.matches(t, F.lit(term), mode).alias(k) for k, (term, mode) in modes.items()))


@query(
    "b04_any_phrase",
    f"""WITH w AS (SELECT doc_id, ' ' || array_to_string({WORDS_SQL.format('text')}, ' ') || ' ' AS t FROM documents), p(phrase) AS (VALUES ('in the'), ('of the'), ('de la'), ('that the'), ('und'), ('to'))
    SELECT doc_id, arg_min(phrase, lpad(CAST(100 - length(phrase) AS VARCHAR), 3, '0') || phrase) AS phrase FROM w JOIN p ON contains(t, ' ' || phrase || ' ') GROUP BY 1""",
)
def b04(spark, d):
    phrases = spark.createDataFrame([(p,) for p in ("in the", "of the", "de la", "that the", "und", "to")], "phrase string")
    return M.any_phrase(table(spark, d, "documents"), phrases, "doc_id", "text", 2)


@query("b05_visible", "SELECT o_orderkey FROM orders WHERE coalesce(CASE WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus = 'O' THEN false END, false) = false")
def b05(spark, d):
    hidden = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return B.visible(table(spark, d, "orders").withColumn("excluded", hidden)).select("o_orderkey")


@query(
    "b06_drop_party",
    views("recipe_lines", "recipes") + """, n AS (SELECT recipe_id, ingredients, category || ' ' || (recipe_id % 12) || ' people' AS name FROM recipes)
    SELECT recipe_id FROM n WHERE NOT (contains(lower(name), '5-low 1') OR recipe_id % 12 >= 8 OR (len(ingredients) >= 7 AND contains(lower(name), 'urgent')))""",
)
def b06(spark, d):
    rows = recipes(spark, d).select("recipe_id", F.concat("category", F.lit(" "), F.col("recipe_id") % 12, F.lit(" people")).alias("name"), F.col("ingredients").alias("items"))
    return B.drop_party(rows, ["5-low 1"], ["urgent"], items=7).select("recipe_id")


@query("b07_drop_trivial", "SELECT p_partkey FROM part WHERE NOT (contains(lower(p_name), 'old') OR contains(lower(p_name), 'ring'))")
def b07(spark, d):
    return B.drop_trivial(table(spark, d, "part"), ["old", "ring"], "p_name").select("p_partkey")


SEASONS = [(1, "the", "fixed", "03-01", "05-31", False), (2, "der", "fixed", "11-01", "02-10", False), (3, "de", "easter", "-7", "1", False), (4, "con", "midsummer", "-10", "3", True)]


@query(
    "b08_off_season",
    f"""WITH s(priority, keyword, kind, lo, hi, inside) AS (VALUES (1,'the','fixed','03-01','05-31',false), (2,'der','fixed','11-01','02-10',false), (3,'de','easter','-7','1',false), (4,'con','midsummer','-10','3',true)),
    e(y, easter, mid) AS (VALUES (1995, DATE '1995-04-16', DATE '1995-06-24'), (1996, DATE '1996-04-07', DATE '1996-06-22'), (1997, DATE '1997-03-30', DATE '1997-06-21'), (1998, DATE '1998-04-12', DATE '1998-06-20'), (1999, DATE '1999-04-04', DATE '1999-06-26'), (2000, DATE '2000-04-23', DATE '2000-06-24'), (2001, DATE '2001-04-15', DATE '2001-06-23')),
    w AS (SELECT doc_id, unnest(list_distinct({WORDS_SQL.format('text')})) AS w FROM documents),
    h AS (SELECT doc_id, min(priority) AS priority FROM w JOIN s ON CASE WHEN inside THEN starts_with(w, keyword) AND length(w) > length(keyword) ELSE w = keyword END GROUP BY 1),
    r AS (SELECT doc_id, s.*, CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%m-%d') AS md FROM h JOIN s USING (priority) JOIN orders ON o_orderkey = doc_id)
    SELECT doc_id, keyword, NOT CASE WHEN kind = 'fixed' AND lo <= hi THEN md BETWEEN lo AND hi WHEN kind = 'fixed' THEN md >= lo OR md <= hi
        WHEN kind = 'easter' THEN d BETWEEN easter + TRY_CAST(lo AS INTEGER) AND easter + TRY_CAST(hi AS INTEGER) ELSE d BETWEEN mid + TRY_CAST(lo AS INTEGER) AND mid + TRY_CAST(hi AS INTEGER) END AS off_season FROM r JOIN e ON y = year(d)""",
)
def b08(spark, d):
    rules = spark.createDataFrame(SEASONS, "priority int, keyword string, kind string, start string, end string, inside boolean")
    docs = table(spark, d, "documents").join(table(spark, d, "orders"), F.col("doc_id") == F.col("o_orderkey")).select("doc_id", "text", "o_orderdate")
    return B.off_season(docs, rules, "doc_id", "text", "o_orderdate")


@query("b09_exempt", f"WITH w AS (SELECT doc_id, lower(text) AS t, {WORDS_SQL.format('text')} AS w FROM documents) SELECT doc_id, contains(t, 'license') OR (list_has_any(w, ['is', 'und']) AND NOT list_has_any(w, ['was'])) AS exempt FROM w")
def b09(spark, d):
    return table(spark, d, "documents").select("doc_id", B.exempt(F.col("text"), ["license"], ["is", "und"], ["was"]).alias("exempt"))


@query("b10_items_between", views("recipe_lines", "recipes") + "SELECT recipe_id, len(ingredients) AS n FROM recipes WHERE len(ingredients) BETWEEN 3 AND 5")
def b10(spark, d):
    return B.items_between(recipes(spark, d), 3, 5).select("recipe_id", F.size("ingredients").cast("long").alias("n"))
