"""Queries over the analytic tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import QueryError
from .operators import construct, mining, mutate, search, traverse
from .sources.tables import engine_over

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def ask(name: str, tables: str, text: str, sql: str | None, binds: dict | None = None) -> None:
    """A query of the language over some tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine_over(spark, sf_dir, tables.split()).query(text, binds)

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def calls(sql: str | None = None):
    """A query that calls an operator."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- scans, filters, expressions ------------------------------------------------

SEGMENTS = "FOR c IN customer FILTER c.c_acctbal > @min COLLECT seg = c.c_mktsegment AGGREGATE total = SUM(c.c_acctbal) WITH COUNT INTO n SORT n DESC, seg LIMIT 5 RETURN {seg, total: ROUND(total), n}"
ask("segments", "customer", SEGMENTS, "SELECT c_mktsegment AS seg, round(sum(c_acctbal)) AS total, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1 ORDER BY n DESC, seg LIMIT 5", {"min": 0})
ask("scan_projection", "nation", "FOR n IN nation RETURN {key: n._key, id: n._id, name: n.n_name, none: n.missing}", "SELECT n_nationkey::VARCHAR AS key, 'nation/' || n_nationkey AS id, n_name AS name, NULL::VARCHAR AS none FROM nation")
ask("filter_conjunction", "lineitem", 'FOR l IN lineitem FILTER l.l_shipdate >= "1996-01-01" AND l.l_discount > 0.05 AND l.l_quantity < 24 COLLECT flag = l.l_returnflag AGGREGATE q = SUM(l.l_quantity), most = MAX(l.l_quantity), least = MIN(l.l_quantity) WITH COUNT INTO n RETURN {flag, q, most, least, n}', "SELECT l_returnflag AS flag, sum(l_quantity) AS q, max(l_quantity) AS most, min(l_quantity) AS least, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_discount > 0.05 AND l_quantity < 24 GROUP BY 1")
ask("filter_in", "orders", 'FOR o IN orders FILTER o.o_orderstatus IN ["F", "P"] AND o.o_custkey IN @some RETURN {k: o._key, s: o.o_orderstatus}', "SELECT o_orderkey::VARCHAR AS k, o_orderstatus AS s FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey IN (1, 2, 3, 5, 8, 13, 21)", {"some": [1, 2, 3, 5, 8, 13, 21]})
ask("filter_null_rules", "part", 'FOR p IN part FILTER p.missing == null AND NOT p.missing AND (p.p_size > 40 OR p.missing) AND p.p_name != null AND NOT (p.p_size > "40") RETURN p._key', "SELECT p_partkey::VARCHAR AS value FROM part WHERE p_size > 40 AND p_name IS NOT NULL")
ask("ternary_and_arithmetic", "part", 'FOR p IN part LET band = p.p_size < 10 ? "small" : p.p_size < 30 ? "medium" : "large" RETURN {k: p._key, band, half: p.p_size / 2, none: p.p_size / 0, neg: -p.p_size, sum: p.p_size * 2 + 1}', "SELECT p_partkey::VARCHAR AS k, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band, p_size / 2.0::DOUBLE AS half, NULL::DOUBLE AS none, -p_size::DOUBLE AS neg, p_size * 2.0::DOUBLE + 1 AS sum FROM part")
ask("string_functions", "part", 'FOR p IN part RETURN {k: p._key, up: UPPER(p.p_name), low: LOWER(p.p_brand), n: LENGTH(p.p_name), sub: SUBSTRING(p.p_name, 1, 4), tail: SUBSTRING(p.p_name, 3), has: CONTAINS(p.p_name, "1"), pre: STARTS_WITH(p.p_brand, "Brand#1"), cat: CONCAT(p.p_brand, "-", p.missing, p.p_size), trimmed: TRIM(CONCAT("  ", p.p_type, "\\t"))}', "SELECT p_partkey::VARCHAR AS k, upper(p_name) AS up, lower(p_brand) AS low, length(p_name) AS n, substr(p_name, 2, 4) AS sub, substr(p_name, 4) AS tail, contains(p_name, '1') AS has, starts_with(p_brand, 'Brand#1') AS pre, concat(p_brand, '-', p_size) AS cat, p_type AS trimmed FROM part")
ask("number_functions", "customer", "FOR c IN customer RETURN {k: c._key, a: ABS(c.c_acctbal), f: FLOOR(c.c_acctbal), c: CEIL(c.c_acctbal), r: ROUND(c.c_acctbal), s: TO_STRING(c.c_custkey), n: TO_NUMBER(c._key), b: TO_BOOL(c.c_nationkey)}", "SELECT c_custkey::VARCHAR AS k, abs(c_acctbal) AS a, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, round(c_acctbal) AS r, c_custkey::VARCHAR AS s, c_custkey::DOUBLE AS n, c_nationkey <> 0 AS b FROM customer")
ask("array_functions", "documents", 'FOR d IN documents LET w = SPLIT(d.text, " ") RETURN {k: d._key, n: LENGTH(w), first: FIRST(w), last: LAST(w), some: SLICE(w, 1, 2), end: SLICE(w, -1), uniq: LENGTH(UNIQUE(w)), both: INTERSECTION(["a", "b"], ["b", "c"]), less: MINUS(["a", "b", "a"], ["b"]), flat: FLATTEN([[1, 2], [3]]), total: SUM([1, 2, 3.5]), mean: AVG([1, 2, 3]), lo: MIN([3, 1]), hi: MAX([3, 1])}', "SELECT doc_id::VARCHAR AS k, len(w) AS n, w[1] AS first, w[-1] AS last, w[2:3] AS some, w[-1:] AS end, len(list_distinct(w)) AS uniq, ['b'] AS both, ['a'] AS less, [1.0::DOUBLE, 2.0, 3.0] AS flat, 6.5::DOUBLE AS total, 2.0::DOUBLE AS mean, 1.0::DOUBLE AS lo, 3.0::DOUBLE AS hi FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
ask("date_functions", "orders", 'FOR o IN orders RETURN {k: o._key, y: DATE_YEAR(o.o_orderdate), m: DATE_MONTH(o.o_orderdate), d: DATE_DAY(o.o_orderdate), h: DATE_HOUR(o.o_orderdate), ms: DATE_TIMESTAMP(o.o_orderdate), days: DATE_DIFF("1992-01-01", o.o_orderdate, "days"), later: DATE_ADD("2024-02-28T12:00:00Z", 1.5, "days"), bad: DATE_YEAR("x")}', "SELECT o_orderkey::VARCHAR AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, epoch_ms(date_trunc('second', o_orderdate)) AS ms, (epoch_ms(date_trunc('second', o_orderdate)) - epoch_ms(TIMESTAMP '1992-01-01'))::DOUBLE / 86400000 AS days, '2024-03-01T00:00:00+00:00' AS later, NULL::BIGINT AS bad FROM orders")
ask("time_and_array_functions", "orders", 'FOR o IN orders RETURN {k: o._key, mi: DATE_MINUTE(o.o_orderdate), s: DATE_SECOND(o.o_orderdate), m2: DATE_MINUTE("2024-02-28T12:34:56Z"), s2: DATE_SECOND("2024-02-28T12:34:56Z"), now: DATE_YEAR(NOW()) >= 2024, first: NOT_NULL(o.missing, o.o_orderstatus, "x"), u: SORTED_UNIQUE([3, 1, 3, 2, 1])}', "SELECT o_orderkey::VARCHAR AS k, minute(o_orderdate) AS mi, second(o_orderdate) AS s, 34::BIGINT AS m2, 56::BIGINT AS s2, true AS now, o_orderstatus AS first, [1.0::DOUBLE, 2.0, 3.0] AS u FROM orders")
ask("regex_functions", "part", 'FOR p IN part FILTER REGEX_TEST(p.p_brand, "^brand#[12]", true) RETURN {k: p._key, swapped: REGEX_REPLACE(p.p_brand, "([A-Za-z]+)#([0-9]+)", "$2-$1"), bad: REGEX_TEST(p.p_brand, "(")}', "SELECT p_partkey::VARCHAR AS k, regexp_replace(p_brand, '([A-Za-z]+)#([0-9]+)', '\\2-\\1', 'g') AS swapped, NULL::VARCHAR AS bad FROM part WHERE regexp_matches(p_brand, '^[Bb]rand#[12]')")
ask("identifier_functions", "customer_nation", 'FOR e IN customer_nation LET p = PARSE_IDENTIFIER(e._to) RETURN {k: e._key, coll: p.collection, key: p.key, same: IS_SAME_COLLECTION("nation", e._to), kind: TYPENAME(e.confidence), has: HAS(e, "_from"), hasnt: HAS(e, "x"), coal: COALESCE(e.x, e.relation_type)}', "SELECT 'customer-' || c_custkey AS k, 'nation' AS coll, c_nationkey::VARCHAR AS key, true AS same, 'number' AS kind, true AS has, false AS hasnt, 'of_nation' AS coal FROM customer")
ask("unicode_normalisation", "region", 'FOR r IN region RETURN {k: r._key, nfc: NORMALIZE_NFC(CONCAT(r.r_name, "cafe\\u0301"))}', "SELECT r_regionkey::VARCHAR AS k, nfc_normalize(r_name || 'cafe' || chr(769)) AS nfc FROM region")
ask("no_source", "region", 'RETURN {a: 1 + 1, b: [1, 2], c: "x"}', "SELECT 2.0::DOUBLE AS a, [1.0::DOUBLE, 2.0] AS b, 'x' AS c")

# -- grouping, order ---------------------------------------------------------------

ask("collect_many_keys", "lineitem", "FOR l IN lineitem COLLECT flag = l.l_returnflag, status = l.l_linestatus AGGREGATE q = SUM(l.l_quantity), rev = SUM(l.l_extendedprice * (1 - l.l_discount)), disc = AVG(l.l_discount) WITH COUNT INTO n RETURN {flag, status, q, rev: ROUND(rev), disc: ROUND(disc * 10000), n}", "SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS q, round(sum(l_extendedprice * (1 - l_discount))) AS rev, round(avg(l_discount) * 10000) AS disc, count(*) AS n FROM lineitem GROUP BY 1, 2")
ask("collect_into", "nation", "FOR n IN nation COLLECT r = n.n_regionkey INTO names = n.n_name RETURN {r, names: SORTED(names), some: LENGTH(names)}", "SELECT n_regionkey AS r, list(n_name ORDER BY n_name) AS names, count(*) AS some FROM nation GROUP BY 1")
ask("collect_into_bare", "nation", "FOR n IN nation COLLECT r = n.n_regionkey INTO g RETURN {r, n: LENGTH(g), first: FIRST(g).n.n_name}", "SELECT n_regionkey AS r, count(*) AS n, min_by(n_name, n_nationkey::VARCHAR) AS first FROM nation GROUP BY 1")
ask("collect_keyless", "orders", 'FOR o IN orders FILTER o.o_orderstatus == "none" COLLECT AGGREGATE s = SUM(o.o_totalprice) WITH COUNT INTO n RETURN {s, n}', "SELECT 0.0::DOUBLE AS s, 0::BIGINT AS n WHERE false")
ask("collect_having", "orders", "LET busy = (FOR o IN orders COLLECT c = o.o_custkey WITH COUNT INTO n RETURN {c, n}) FOR b IN busy FILTER b.n >= 18 RETURN {c: b.c, n: b.n}", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 18")
ask("return_distinct", "orders", "FOR o IN orders RETURN DISTINCT {s: o.o_orderstatus, p: o.o_orderpriority}", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")
ask("sort_limit_offset", "customer", "FOR c IN customer SORT c.c_mktsegment DESC, c.c_custkey LIMIT 5, 20 RETURN {k: c.c_custkey, s: c.c_mktsegment}", "SELECT c_custkey AS k, c_mktsegment AS s FROM customer ORDER BY s DESC, k LIMIT 20 OFFSET 5")
ask("sort_collated", "nation", 'FOR n IN nation SORT n.n_name COLLATE "de" LIMIT @n RETURN n.n_name', "SELECT n_name AS value FROM nation ORDER BY lower(n_name) LIMIT 7", {"n": 7})

# -- joins and subqueries -------------------------------------------------------------

ask("join_equal", "customer orders nation", "FOR c IN customer FILTER c.c_acctbal > 5000 FOR o IN orders FILTER o.o_custkey == c.c_custkey FOR n IN nation FILTER n.n_nationkey == c.c_nationkey COLLECT name = n.n_name WITH COUNT INTO k RETURN {name, k}", "SELECT n_name AS name, count(*) AS k FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 5000 GROUP BY 1")
ask("join_theta", "nation region", "FOR n IN nation FOR r IN region FILTER n.n_regionkey < r.r_regionkey RETURN {n: n.n_name, r: r.r_name}", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey < r_regionkey")
ask("join_semi", "customer orders", "FOR c IN customer FILTER LENGTH((FOR o IN orders FILTER o.o_custkey == c.c_custkey AND o.o_totalprice > 300000 RETURN 1)) > 0 RETURN c.c_custkey", "SELECT c_custkey AS value FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
ask("join_anti", "customer orders", "FOR c IN customer FILTER LENGTH((FOR o IN orders FILTER o.o_custkey == c.c_custkey RETURN 1)) == 0 RETURN c.c_custkey", "SELECT c_custkey AS value FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
ask("join_nested_array", "region nation", "FOR r IN region LET names = (FOR n IN nation FILTER n.n_regionkey == r.r_regionkey SORT n.n_name RETURN n.n_name) RETURN {r: r.r_name, names, one: FIRST(names)}", "SELECT r_name AS r, list(n_name ORDER BY n_name) AS names, min(n_name) AS one FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
ask("subquery_top_k", "customer orders", "FOR c IN customer LET top = (FOR o IN orders FILTER o.o_custkey == c.c_custkey SORT o.o_totalprice DESC, o.o_orderkey LIMIT 2 RETURN o.o_orderkey) RETURN {c: c.c_custkey, top}", "SELECT c_custkey AS c, coalesce(list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) FILTER (WHERE n <= 2), []) AS top FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) ON o_custkey = c_custkey AND n <= 2 GROUP BY 1")
ask("subquery_uncorrelated", "nation orders", "LET n = LENGTH((FOR o IN orders RETURN 1)) FOR x IN nation RETURN {name: x.n_name, n}", "SELECT n_name AS name, (SELECT count(*) FROM orders) AS n FROM nation")
ask("subquery_nested", "region nation customer", "FOR r IN region LET per = (FOR n IN nation FILTER n.n_regionkey == r.r_regionkey SORT n.n_nationkey RETURN LENGTH((FOR c IN customer FILTER c.c_nationkey == n.n_nationkey RETURN 1))) RETURN {r: r.r_name, per}", "SELECT r_name AS r, list(k ORDER BY n_nationkey) AS per FROM region JOIN (SELECT n_nationkey, n_regionkey, count(c_custkey) AS k FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2) ON n_regionkey = r_regionkey GROUP BY 1")
ask("array_for", "documents", 'FOR d IN documents FOR w IN SPLIT(d.text, " ") FILTER LENGTH(w) > 20 COLLECT word = w WITH COUNT INTO n RETURN {word, n}', "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE length(word) > 20 GROUP BY 1")
ask("document_lookup_array", "nation region", 'FOR n IN nation LET some = DOCUMENT([CONCAT("region/", n.n_regionkey), "region/0"]) RETURN {k: n._key, names: SORTED([FIRST(some).r_name, LAST(some).r_name])}', "SELECT n_nationkey::VARCHAR AS k, list_sort([r.r_name, z.r_name]) AS names FROM nation JOIN region r ON r.r_regionkey = n_regionkey JOIN region z ON z.r_regionkey = 0")
ask("traverse_each_outer_row", "region geo nation customer", 'FOR r IN region FOR v IN 1..1 INBOUND "nation/7" geo COLLECT name = r.r_name WITH COUNT INTO n RETURN {name, n}', "SELECT r_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = 7) AS n FROM region WHERE (SELECT count(*) FROM customer WHERE c_nationkey = 7) > 0")
ask("document_lookup", "order_customer customer", 'FOR e IN order_customer FILTER e.confidence > 0.9 LET c = DOCUMENT(e._to) RETURN {k: e._key, name: c.c_name, none: DOCUMENT("customer/none").c_name}', "SELECT 'orders-' || o_orderkey AS k, c_name AS name, NULL::VARCHAR AS none FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE 1.0::DOUBLE - (o_orderkey % 10) / 20.0::DOUBLE > 0.9")

# -- graph ------------------------------------------------------------------------

_GEO = "WITH RECURSIVE e AS (SELECT 'orders/' || o_orderkey AS f, 'customer/' || o_custkey AS t, 1.0::DOUBLE - (o_orderkey % 10) / 20.0::DOUBLE AS c FROM orders UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey, 1.0::DOUBLE FROM customer UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey, 1.0::DOUBLE FROM nation), "
ask("traverse_outbound", "geo orders customer nation region", 'FOR v, e, p IN 1..3 OUTBOUND "orders/1" geo RETURN {v: v._id, d: p.depth, s: ROUND(p.score * 1000000), r: e.relation_type}', _GEO + "w AS (SELECT 'orders/1' AS v, 0 AS d, 1.0::DOUBLE AS s UNION ALL SELECT t, d + 1, s * c * 0.8 FROM w JOIN e ON f = v WHERE d < 3) SELECT v, d::BIGINT AS d, round(s * 1000000) AS s, 'of_' || split_part(v, '/', 1) AS r FROM w WHERE d >= 1")
ask("traverse_inbound", "geo orders customer nation region", 'FOR v, e IN 1..2 INBOUND "nation/7" geo FILTER e.confidence >= 0.8 RETURN {v: v._id}', _GEO + "w AS (SELECT 'nation/7' AS v, 0 AS d, 1.0::DOUBLE AS k UNION ALL SELECT f, d + 1, c FROM w JOIN e ON t = v WHERE d < 2) SELECT v FROM w WHERE d >= 1 AND k >= 0.8")
ask("traverse_any_depth0", "nation_region nation region", 'FOR v, e, p IN 0..2 ANY "nation/3" nation_region RETURN {v: v._key, d: p.depth, root: e == null}', "WITH n AS (SELECT n_nationkey, n_regionkey FROM nation), m AS (SELECT n_regionkey AS r FROM n WHERE n_nationkey = 3) SELECT '3' AS v, 0::BIGINT AS d, true AS root UNION ALL SELECT r::VARCHAR, 1, false FROM m UNION ALL SELECT n_nationkey::VARCHAR, 2, false FROM n JOIN m ON n_regionkey = r WHERE n_nationkey <> 3")
ask("traverse_correlated", "customer geo nation region", 'FOR c IN customer FILTER c.c_acctbal > 9000 FOR v IN 2..2 OUTBOUND c._id geo RETURN {c: c._key, region: v.r_name}', "SELECT c_custkey::VARCHAR AS c, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal > 9000")
ask("traverse_path", "nation_region nation region", 'FOR v, e, p IN 1..1 OUTBOUND "nation/5" nation_region RETURN {ids: LENGTH(p.vertices), first: FIRST(p.vertices).n_name, last: LAST(p.vertices).r_name, edges: LENGTH(p.edges)}', "SELECT 2::BIGINT AS ids, n_name AS first, r_name AS last, 1::BIGINT AS edges FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey = 5")


@calls("SELECT 'orders-' || o_orderkey AS k FROM orders WHERE o_custkey = 7")
def edge_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_over(spark, sf_dir, ["order_customer"]).edges("order_customer", "customer/7", "INBOUND").select(F.col("_key").alias("k"))


@calls("SELECT start, count(*) AS paths FROM (SELECT 'orders/' || o_orderkey AS start FROM orders WHERE 1.0::DOUBLE - (o_orderkey % 10) / 20.0::DOUBLE >= 0.75) GROUP BY 1")
def traverse_many_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = engine_over(spark, sf_dir, ["geo"]).catalog["geo"].df
    starts = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("orders/"), "o_orderkey").alias("start"))
    return traverse.traverse(edges, starts, 1, 1, min_confidence=0.75, edge_fields=set()).groupBy("start").agg(F.count(F.lit(1)).alias("paths"))


@calls("SELECT 'nation-' || n_nationkey AS k, 'region/' || n_regionkey AS t, CASE WHEN n_nationkey < 3 THEN 0.5 ELSE 1.0 END::DOUBLE AS c FROM nation UNION ALL SELECT 'new-1', 'region/9', 0.25")
def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = engine_over(spark, sf_dir, ["nation_region"]).catalog["nation_region"].df
    changed = edges.filter(F.split("_from", "/")[1].cast("int") < 3).withColumn("confidence", F.lit(0.5)).withColumn("_key", F.lit("ignored"))
    row = ("new-1", "nation_region/new-1", "nation/99", "region/9", "of_region", 0.25)
    new = spark.createDataFrame([row], "_key string, _id string, _from string, _to string, relation_type string, confidence double")
    return traverse.upsert_edges(edges, changed.unionByName(new)).select(F.col("_key").alias("k"), F.col("_to").alias("t"), F.col("confidence").alias("c"))


@calls("SELECT 'nation-' || n_nationkey AS k FROM nation ORDER BY n_nationkey <> 4, 'nation/' || n_nationkey LIMIT 6")
def edge_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = engine_over(spark, sf_dir, ["nation_region"]).catalog["nation_region"].df
    return traverse.select_edges(edges, ["nation/4"], 6).select(F.col("_key").alias("k"))


@calls("""WITH e AS (SELECT 'customer/' || c_custkey AS f, 'nation/' || c_nationkey AS t, CASE c_custkey % 4 WHEN 0 THEN 'mentions' WHEN 1 THEN 'HAS_CHUNK' WHEN 2 THEN 'treats' ELSE 'related_to' END AS r FROM customer),
s AS (SELECT f, r, t, CASE upper(r) WHEN 'MENTIONS' THEN 20 WHEN 'HAS_CHUNK' THEN 10 WHEN 'TREATS' THEN 105 ELSE 100 END AS w, (f IN ('customer/2', 'customer/3'))::INT + (t = 'nation/3')::INT AS seeds FROM e)
SELECT f, r, t, w::DOUBLE AS s FROM s ORDER BY w DESC, seeds DESC, lower(f), lower(r), lower(t) LIMIT 12""")
def edge_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = engine_over(spark, sf_dir, ["customer_nation"]).catalog["customer_nation"].df
    n = F.split("_from", "/")[1].cast("int") % 4
    edges = edges.withColumn("relation_type", F.when(n == 0, "mentions").when(n == 1, "HAS_CHUNK").when(n == 2, "treats").otherwise("related_to"))
    best = traverse.select_edges(edges, ["customer/2", "customer/3", "nation/3"], boosts={"TREATS": 5.0, "treats": 1000.0})
    return best.select(F.col("_from").alias("f"), F.col("relation_type").alias("r"), F.col("_to").alias("t"), F.col("_score").alias("s"))


#: From, relation, to, evidence: duplicates, hubs, and more that say little than may be taken.
_TRACE = [("a", "TREATS", "b", "c2"), ("a", "TREATS", "b", "c1"), ("a", "TREATS", "b", None), ("x", "related_to", "y", None), ("a", "MENTIONS", "b", "c1"), ("a", "MENTIONS", "b", "c2"), ("a", "MENTIONS", "b", "c2"), ("a", "MENTIONS", "c", "c3"), ("c", "HAS_CHUNK", "b", "c4"), ("c", "HAS_CHUNK", "d", "c5"), ("e", "co_occurs_with", "f", None), ("e", "co_occurs_with", "g", "c6"), ("h", "HAS_CHUNK", "i", None)]


@calls("SELECT * FROM (VALUES ('a', 'TREATS', 'b', 'c1'), ('x', 'related_to', 'y', NULL), ('a', 'MENTIONS', 'b', 'c1'), ('a', 'MENTIONS', 'b', 'c2'), ('c', 'HAS_CHUNK', 'd', 'c5'), ('e', 'co_occurs_with', 'g', 'c6')) AS t(f, r, t, e)")
def edge_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.createDataFrame(_TRACE, "_from string, relation_type string, _to string, evidence_chunk_id string")
    return traverse.select_edges(edges, ["a"]).select(F.col("_from").alias("f"), F.col("relation_type").alias("r"), F.col("_to").alias("t"), F.col("evidence_chunk_id").alias("e"))


# -- retrieval -----------------------------------------------------------------------

_VECTOR = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_V = "[" + ", ".join(f"{x}::DOUBLE" for x in _VECTOR) + "]"
_COS = f"list_cosine_similarity(embedding::DOUBLE[], {_V}::DOUBLE[])"
ask("vector_search", "embeddings", "FOR d IN VECTOR_SEARCH(embeddings, @v) LIMIT 10 RETURN {k: d._key, s: ROUND(d._score * 1000000)}", f"SELECT vec_id::VARCHAR AS k, round({_COS} * 1000000) AS s FROM embeddings ORDER BY {_COS} DESC, k LIMIT 10", {"v": _VECTOR})
ask("vector_threshold", "embeddings", "FOR d IN VECTOR_SEARCH(embeddings, @v) FILTER d._score >= 0.2 RETURN d._key", f"SELECT vec_id::VARCHAR AS value FROM embeddings WHERE {_COS} >= 0.2 ORDER BY {_COS} DESC LIMIT 100", {"v": _VECTOR})
ask("cosine_function", "embeddings", "FOR d IN embeddings RETURN {k: d._key, s: ROUND(COSINE_SIMILARITY(d.embedding, @v) * 1000000)}", f"SELECT vec_id::VARCHAR AS k, round({_COS} * 1000000) AS s FROM embeddings", {"v": _VECTOR})
_WORDS = ("license", "the", "apache")
_BM25 = f"""WITH t AS (SELECT doc_id::VARCHAR AS k, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
tf AS (SELECT k, len(w) AS l, q, len(list_filter(w, lambda x: x = q)) AS f FROM t, (SELECT unnest({list(_WORDS)!r}) AS q)),
df AS (SELECT q, count(*) AS d FROM tf WHERE f > 0 GROUP BY 1),
r AS (SELECT k, sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / mean))) AS score FROM tf JOIN df USING (q), s WHERE f > 0 GROUP BY 1 ORDER BY score DESC, k LIMIT 20)"""


@calls(_BM25 + " SELECT k, round(score * 1000000) AS s FROM r")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = engine_over(spark, sf_dir, ["documents"]).text_search("documents", " ".join(_WORDS), fields=["text"], limit=20)
    return hits.select(F.col("_key").alias("k"), F.round(F.col("_score") * 1000000).alias("s"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as chunks: each belongs to the document with its number."""
    engine = engine_over(spark, sf_dir, ["embeddings"])
    return engine.catalog["embeddings"].df.withColumn("document_id", F.concat(F.lit("documents/"), "vec_id"))


_NEAR = f"v AS (SELECT 'documents/' || vec_id AS id, row_number() OVER (ORDER BY {_COS} DESC, 'documents/' || vec_id) - 1 AS n FROM (SELECT * FROM embeddings ORDER BY {_COS} DESC, vec_id::VARCHAR LIMIT 30))"


@calls(_BM25.replace("LIMIT 20", "LIMIT 30") + f", {_NEAR}, b AS (SELECT 'documents/' || k AS id, row_number() OVER (ORDER BY score DESC, 'documents/' || k) - 1 AS n FROM r) SELECT id, round(sum(0.5 / (60 + n + 1)) * 1000000000) AS s FROM (SELECT * FROM v UNION ALL SELECT * FROM b) GROUP BY 1 ORDER BY sum(0.5 / (60 + n + 1)) DESC, id LIMIT 10")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = engine_over(spark, sf_dir, ["documents"]).catalog["documents"].df
    found = search.hybrid_search(docs, _chunks(spark, sf_dir), " ".join(_WORDS), _VECTOR, fields=["text"], threshold=None)
    return found.select("id", F.round(F.col("score") * 1000000000).alias("s"))


@calls(f"SELECT 'documents/' || vec_id AS id, round({_COS} * 1000000) AS s FROM embeddings ORDER BY {_COS} DESC, vec_id::VARCHAR LIMIT 5")
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.semantic_search(_chunks(spark, sf_dir), "anything", lambda _: _VECTOR, limit=5, threshold=None)
    return found.select("id", F.round(F.col("score") * 1000000).alias("s"))


@calls(_BM25.replace("LIMIT 20", "LIMIT 30") + f", {_NEAR}, b AS (SELECT 'documents/' || k AS id, row_number() OVER (ORDER BY score DESC, 'documents/' || k) - 1 AS n FROM r) SELECT id, round(sum(w / (60 + n + 1)) * 1000000000) AS s FROM (SELECT *, 1.0 AS w FROM v UNION ALL SELECT *, 0.5 FROM b) GROUP BY 1 ORDER BY sum(w / (60 + n + 1)) DESC, id LIMIT 10")
def hybrid_search_with_side_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, chunks = engine_over(spark, sf_dir, ["documents"]).catalog["documents"].df, _chunks(spark, sf_dir)
    found = search.hybrid_search(docs, chunks, " ".join(_WORDS), _VECTOR, fields=["text"], threshold=None, side_views=chunks)
    return found.select("id", F.round(F.col("score") * 1000000000).alias("s"))


@calls(f"SELECT vec_id AS i, round(power(greatest(({_COS} - 0.1) / 0.9, 0), 3) / (1 + 0.15 * (vec_id % 7)) * 1000000) AS w FROM embeddings")
def cache_fusion_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engine_over(spark, sf_dir, ["embeddings"]).query("FOR d IN embeddings RETURN {i: d.vec_id, s: COSINE_SIMILARITY(d.embedding, @v)}", {"v": _VECTOR})
    return rows.select("i", F.round(search.cache_weight(F.col("s"), F.col("i") % 7, 0.1) * 1000000).alias("w"))


@calls("SELECT doc_id AS i, [length(coalesce(text, ''))::DOUBLE, length(replace(coalesce(text, ''), 'e', ''))::DOUBLE] AS v, 'sizes' AS m FROM documents")
def embedding_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = search.embedded(docs, lambda some: [[len(t), len(t.replace("e", ""))] for t in some], text="text", model_name="sizes")
    return made.select(F.col("doc_id").alias("i"), F.col("embedding").alias("v"), F.col("model_name").alias("m"))


@calls(f"WITH s AS (SELECT vec_id, label, {_COS} AS c FROM embeddings ORDER BY c DESC, vec_id::VARCHAR LIMIT 5), g AS (SELECT 'label/' || label AS id, max(c) * 0.8 AS s FROM s GROUP BY 1) SELECT 'embeddings/' || vec_id AS id, round(c * 1000000) AS s FROM s UNION ALL SELECT id, round(s * 1000000) FROM g")
def graph_augmented_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = engine_over(spark, sf_dir, ["embeddings"]).catalog["embeddings"].df
    edges = docs.select(F.concat(F.lit("l"), "vec_id").alias("_key"), F.concat(F.lit("l/l"), "vec_id").alias("_id"), F.col("_id").alias("_from"), F.concat(F.lit("label/"), "label").alias("_to"), F.lit("of").alias("relation_type"), F.lit(1.0).alias("confidence"))
    found = search.graph_augmented_search(docs, edges, _VECTOR, threshold=None)
    return found.select("id", F.round(F.col("score") * 1000000).alias("s"))


@calls(f"SELECT vec_id::VARCHAR AS k FROM embeddings ORDER BY {_COS} DESC, k LIMIT 10")
def two_stage_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = search.quantised(engine_over(spark, sf_dir, ["embeddings"]).catalog["embeddings"].df)
    return search.two_stage_search(docs, _VECTOR).select(F.col("_key").alias("k"))


@calls("SELECT item_id AS i, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS q FROM benchmark")
def query_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("i"), search.normalise_query("text").alias("q"))


# -- changes, pages, snapshots -----------------------------------------------------------


def _changed(spark: SparkSession, sf_dir: str, text: str, binds: dict | None = None) -> DataFrame:
    engine = engine_over(spark, sf_dir, ["region"])
    engine.query(text, binds)
    return engine.query("FOR r IN region RETURN {k: r._key, name: r.r_name, note: r.note}")


def change(name: str, text: str, sql: str, binds: dict | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: _changed(spark, sf_dir, text, binds)
    SQL[name] = sql


_OLD = "SELECT r_regionkey::VARCHAR AS k, r_name AS name, "
change("mutation_insert", 'INSERT {_key: "9", r_name: "NOWHERE", note: "new"} INTO region', _OLD + "NULL::VARCHAR AS note FROM region UNION ALL SELECT '9', 'NOWHERE', 'new'")
change("mutation_update", 'FOR r IN region FILTER r.r_regionkey < 2 UPDATE r._key WITH {note: CONCAT("was ", r.r_name)} IN region', _OLD + "CASE WHEN r_regionkey < 2 THEN 'was ' || r_name END AS note FROM region")
change("mutation_replace", 'REPLACE "3" WITH {note: "only"} IN region', "SELECT r_regionkey::VARCHAR AS k, CASE WHEN r_regionkey <> 3 THEN r_name END AS name, CASE WHEN r_regionkey = 3 THEN 'only' END AS note FROM region")
change("mutation_by_id", 'FOR r IN region FILTER r.r_regionkey == 1 REMOVE r._id IN region', _OLD + "NULL::VARCHAR AS note FROM region WHERE r_regionkey <> 1")
change("mutation_by_document", 'FOR r IN region FILTER r.r_regionkey == 1 UPDATE {_key: r._key} WITH {note: "by document"} IN region', _OLD + "CASE WHEN r_regionkey = 1 THEN 'by document' END AS note FROM region")
change("mutation_remove", "FOR r IN region FILTER r.r_regionkey >= 3 REMOVE r._key IN region", _OLD + "NULL::VARCHAR AS note FROM region WHERE r_regionkey < 3")
change("mutation_upsert", 'FOR x IN ["AFRICA", "MARS"] UPSERT {r_name: x} INSERT {_key: "m", r_name: x, note: "in"} UPDATE {note: "up"} IN region', _OLD + "CASE WHEN r_name = 'AFRICA' THEN 'up' END AS note FROM region UNION ALL SELECT 'm', 'MARS', 'in' WHERE (SELECT count(*) FROM region WHERE r_name = 'AFRICA') = 1")


@calls("SELECT r_regionkey::VARCHAR AS k FROM region WHERE r_regionkey <> 1 UNION ALL SELECT unnest(['a', 'b'])")
def batch_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir, ["region"])
    new = {"op": "insert", "collection": "region"}
    engine.batch([{**new, "document": {"_key": "a", "r_name": "A"}}, {"op": "remove", "collection": "region", "key": "1"}, {**new, "document": {"_key": "b"}}, {"op": "update", "collection": "region", "key": "a", "document": {"r_name": "AA"}}])
    return engine.query("FOR r IN region RETURN {k: r._key}")


@calls("SELECT '{\"f0\":' || l_orderkey || ',\"f1\":' || l_linenumber || '}' AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.duplicates(engine_over(spark, sf_dir, ["lineitem"]).catalog["lineitem"].df, ["l_orderkey", "l_linenumber"])


def _refused(spark: SparkSession, *tries) -> DataFrame:
    """Which of some calls an engine refuses, and by which error."""
    rows = []
    for name, f in tries:
        try:
            f()
            rows.append((name, None))
        except QueryError as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "name string, error string")


@calls("SELECT * FROM (VALUES ('o_orderkey', NULL), ('again', NULL), ('other', 'Conflict'), ('o_custkey', CASE WHEN (SELECT count(*) > count(DISTINCT o_custkey) FROM orders) THEN 'UniqueViolation' END), ('missing sparse', NULL), ('missing', CASE WHEN (SELECT count(*) FROM orders) > 1 THEN 'UniqueViolation' END)) AS t(name, error)")
def unique_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir, ["orders"])
    return _refused(
        spark,
        ("o_orderkey", lambda: engine.ensure_index("orders", "a", ["o_orderkey"])),
        ("again", lambda: engine.ensure_index("orders", "a", ["o_orderkey"])),
        ("other", lambda: engine.ensure_index("orders", "a", ["o_orderkey"], unique=False)),
        ("o_custkey", lambda: engine.ensure_index("orders", "b", ["o_custkey"])),
        ("missing sparse", lambda: engine.ensure_index("orders", "c", ["nothing"], sparse=True)),
        ("missing", lambda: engine.ensure_index("orders", "d", ["nothing"])),
    )


@calls("SELECT * FROM (VALUES ('a', 'n_name', true, false), ('b', 'n_regionkey,n_name', false, true)) AS t(name, fields, \"unique\", sparse)")
def index_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir, ["nation"])
    engine.ensure_index("nation", "b", ["n_regionkey", "n_name"], unique=False, sparse=True)
    engine.ensure_index("nation", "c", ["n_regionkey"], unique=False)
    engine.ensure_index("nation", "a", ["n_name"])
    engine.drop_index("nation", "c")
    rows = [(i["name"], ",".join(i["fields"]), i["unique"], i["sparse"]) for i in engine.indexes("nation")]
    return spark.createDataFrame(rows, "name string, fields string, unique boolean, sparse boolean")


@calls("SELECT r_regionkey::VARCHAR AS k, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation")
def bulk_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir, ["region"])
    engine.bulk_insert("region", spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("n"), "n_nationkey").alias("_key"), F.col("n_name").alias("r_name")))
    return engine.query("FOR r IN region RETURN {k: r._key, name: r.r_name}")


@calls("SELECT * FROM (VALUES ('no key', 'BadKey'), ('bad key', 'BadKey'), ('twice', 'Conflict'), ('taken', 'Conflict'), ('no ends', 'TypeMismatch'), ('fine', NULL)) AS t(name, error)")
def bulk_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir, ["nation", "nation_region"])
    keys = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("_key"))
    new = keys.select(F.concat(F.lit("x"), "_key").alias("_key"))
    tries = {"no key": ("nation", new.withColumnRenamed("_key", "key")), "bad key": ("nation", new.withColumn("_key", F.concat("_key", F.lit("/")))), "twice": ("nation", new.unionByName(new)), "taken": ("nation", keys), "no ends": ("nation_region", new), "fine": ("nation", new)}
    return _refused(spark, *[(n, lambda c=c, df=df: engine.bulk_insert(c, df)) for n, (c, df) in tries.items()])


@calls("SELECT * FROM (VALUES ('made', 'document', 0), ('links', 'edge', 0)) AS t(name, kind, count)")
def collections_made_and_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir, ["region"])
    engine.ensure_collection("made")
    engine.ensure_collection("links", "edge")
    engine.drop_collection("region")
    return engine.collections().withColumn("count", F.col("count").cast("int"))


@calls("SELECT n_name AS name, n_regionkey AS region, 'nation/7' AS id, true AS none FROM nation WHERE n_nationkey = 7")
def point_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir, ["nation"])
    found = engine.document("nation", "7")
    return spark.createDataFrame([(found["n_name"], found["n_regionkey"], found["_id"], engine.document("nation", "none") is None)], "name string, region int, id string, none boolean")


@calls("SELECT c_custkey::VARCHAR AS k FROM customer ORDER BY k LIMIT 15 OFFSET 30")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_over(spark, sf_dir, ["customer"]).documents("customer", limit=15, offset=30).select(F.col("_key").alias("k"))


@calls("SELECT r_regionkey::VARCHAR AS k, CASE r_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN NULL ELSE r_name END AS name, CASE r_regionkey WHEN 0 THEN 'was AFRICA' WHEN 1 THEN 'alone' END AS note FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 'new', 'NEW', NULL")
def single_document_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir, ["region"])
    old = engine.need("region", "0")["r_name"]
    engine.update("region", "0", {"r_name": "zero", "note": f"was {old}"})
    engine.replace("region", "1", {"note": "alone"})
    engine.remove("region", "2")
    engine.insert("region", {"_key": "new", "r_name": "NEW"})
    return engine.query("FOR r IN region RETURN {k: r._key, name: r.r_name, note: r.note}")


@calls("SELECT 'region/1' AS t, 2::BIGINT AS n, 0.5::DOUBLE AS c UNION ALL SELECT 'region/9', 1, 1.0")
def single_edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir, ["nation_region"])
    engine.upsert_edge("nation_region", "nation/1", "region/9", "of_region")
    engine.upsert_edge("nation_region", "nation/1", "region/1", "of_region", {"confidence": 0.5})
    kept = engine.query('FOR e IN nation_region FILTER e._from == "nation/1" RETURN {t: e._to, c: e.confidence}')
    return kept.select("t", F.when(F.col("t") == "region/1", 2).otherwise(1).cast("long").alias("n"), "c")


@calls("SELECT * FROM (VALUES ('budget', 'BudgetExceeded'), ('within', NULL), ('depth', 'ValidationError'), ('unknown', 'UnknownDocument'), ('search in the key', 'QueryError'), ('search twice', 'QueryError')) AS t(name, error)")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir, ["geo", "nation", "region"])
    return _refused(
        spark,
        ("budget", lambda: engine.traverse("geo", "nation/7", 1, 2, "ANY", budget=1)),
        ("within", lambda: engine.traverse("geo", "nation/7", 1, 1, "OUTBOUND", budget=1)),
        ("depth", lambda: engine.query('FOR v IN 1..11 OUTBOUND "nation/7" geo RETURN v')),
        ("unknown", lambda: engine.need("nation", "none")),
        ("search in the key", lambda: engine.text_search("nation", "x", fields=["_key"])),
        ("search twice", lambda: engine.text_search("nation", "x", fields=["n_name", "n_name"])),
    )


@calls("SELECT c_custkey::VARCHAR AS k FROM customer WHERE k > '50' ORDER BY k LIMIT 25")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_over(spark, sf_dir, ["customer"]).documents("customer", limit=25, after="50", fields=["c_name"]).select(F.col("_key").alias("k"))


@calls("SELECT 'customer' AS name, 'document' AS kind, (SELECT count(*) FROM customer) AS count UNION ALL SELECT 'nation_region', 'edge', (SELECT count(*) FROM nation)")
def collection_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_over(spark, sf_dir, ["customer", "nation_region"]).collections()


@calls("SELECT n_nationkey::VARCHAR AS k, n_name AS name FROM nation")
def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .engine import Engine
    from .sources import snapshot

    again = Engine(spark)
    snapshot.load(again, snapshot.export(engine_over(spark, sf_dir, ["nation"])))
    return again.query("FOR n IN nation RETURN {k: n._key, name: n.n_name}")


@calls()
def explain_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_over(spark, sf_dir, ["customer"]).query("EXPLAIN FOR c IN customer FILTER c.c_acctbal >= 2 LIMIT 3 RETURN c.c_name")


# -- construction ----------------------------------------------------------------------

SPACE = construct.Space.from_json({
    "id": "corpus",
    "entities": [{"name": "MIT License", "type": "license", "aliases": ["mit license"]}, {"name": "Apache License", "type": "license", "aliases": ["Apache License, Version 2.0"]}, {"name": "document", "type": "thing", "aliases": ["this work", "released", "licensed"]}],
    "relation_rules": [{"source": "document", "relation": "UNDER", "target": "MIT License", "when_any": ["released under the {target}"]}, {"source": "document", "relation": "UNDER", "target": "Apache License", "when_any": ["licensed under the apache license"], "require_in_sentence": ["target"]}],
})


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), "text")


@calls("SELECT doc_id::VARCHAR AS chunk_id, e AS entity FROM documents, (SELECT unnest(['MIT License', 'Apache License', 'document']) AS e, unnest(['mit license', 'apache license', 'this work']) AS s) WHERE contains(lower(text), s) OR (e = 'document' AND (contains(lower(text), 'released') OR contains(lower(text), 'licensed')))")
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.mentions(_corpus(spark, sf_dir), SPACE.entities)


@calls()
def ground_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.ground(_corpus(spark, sf_dir), SPACE)


@calls()
def derive_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.derive(construct.prepare(_corpus(spark, sf_dir), skip_bad=True), SPACE)


@calls()
def prepare_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.prepare(_corpus(spark, sf_dir), 1200, skip_bad=True)


@calls()
def advise_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.advise_gates(_corpus(spark, sf_dir), SPACE)


@calls("SELECT 2::BIGINT AS expected_total, 2::BIGINT AS expected_found, 1::BIGINT AS forbidden_total, 0::BIGINT AS forbidden_triggered")
def evaluate_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = construct.ground(_corpus(spark, sf_dir), SPACE)
    return construct.score(construct.evaluate(facts, ["document --UNDER--> MIT License", "document --UNDER--> Apache License"], ["MIT License --UNDER--> document"]))


@calls("SELECT word, count(*) AS documents FROM (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS word FROM documents) GROUP BY 1 HAVING count(*) >= 3")
def document_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.vocabulary(_corpus(spark, sf_dir), 3)


@calls()
def materialised_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.materialise(_corpus(spark, sf_dir), SPACE)["facts"]


# -- construction, by hand-worked cases ---------------------------------------------------

CASES = construct.Space.from_json({
    "id": "Case Space",
    "entities": [{"name": "Acme", "type": "org", "aliases": ["Acme Corp"]}, {"name": "Bolt", "type": "thing"}, {"name": "Cog", "type": "thing"}],
    "relation_rules": [{"source": "Acme", "relation": "MAKES", "target": "Bolt", "when_any": ["makes bolts", "{source} builds the {target}"]}, {"source": "Acme", "relation": "SELLS", "target": "Cog", "when_any": ["sells"], "require_in_sentence": ["source", "target"]}],
})
_HINT = {"id": "h", "type": "relation_hint", "status": "accepted", "source": "Acme", "relation": "MAKES", "target": "Bolt", "triggers": ["forges"], "reviewed_by": "me"}
_BLOCK = {"id": "b", "type": "relation_blocker", "status": "accepted", "source": "Acme", "relation": "MAKES", "target": "Bolt", "triggers": ["rumour"]}
_IDLE = {"id": "i", "type": "relation_blocker", "status": "accepted", "source": "Acme", "relation": "HATES", "target": "Cog", "triggers": ["hates"]}
_DEAD = {"id": "d", "type": "relation_hint", "status": "accepted", "source": "Cog", "relation": "FITS", "target": "Bolt", "triggers": ["fits on"]}
_TEXTS = [("1", "Straße: Acme makes bolts"), ("2", "ACME CORP Builds The BOLT today"), ("3", "Acme never makes bolts; it makes bolts"), ("4", "It isn't so that Acme makes bolts"), ("5", "Acme sells. Cog is here"), ("6", "Dr. Acme sells a Cog."), ("7", "Acme v1.5 sells a Cog"), ("8", "rumour: Acme forges"), ("9", None)]


def _cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_TEXTS, "id string, text string")


_GROUNDED = "SELECT * FROM (VALUES ('1', 'MAKES', 'makes bolts', 14, 25), ('2', 'MAKES', 'Acme Corp builds the Bolt', 0, 25), ('3', 'MAKES', 'makes bolts', 27, 38), ('6', 'SELLS', 'sells', 9, 14), ('7', 'SELLS', 'sells', 10, 15)) AS t(c, r, w, a, b)"


@calls(_GROUNDED)
def grounded_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans, case, negation and later affirmation, sentence gates, abbreviations."""
    return construct.ground(_cases(spark), CASES).select(F.col("chunk_id").alias("c"), F.col("relation").alias("r"), F.col("trigger").alias("w"), F.col("trigger_start").alias("a"), F.col("trigger_end").alias("b"))


@calls("SELECT 'Acme' AS source, r AS relation, CASE r WHEN 'MAKES' THEN 'Bolt' ELSE 'Cog' END AS target, c AS evidence_chunk_id FROM (" + _GROUNDED + ")")
def derived_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.derive(_cases(spark), CASES)


@calls("SELECT * FROM (VALUES ('with hint', 'h', 'me'), ('with both', NULL, NULL)) AS t(name, n, r) WHERE n IS NOT NULL")
def neuron_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted neurons add triggers and vetoes, and sign what they licence."""
    out = None
    for name, neurons in (("with hint", [_HINT]), ("with both", [_BLOCK, _HINT]), ("proposed", [{**_HINT, "status": "proposed"}])):
        found = construct.ground(_cases(spark).filter("id = '8'"), CASES.with_neurons(neurons)).select(F.lit(name).alias("name"), F.col("neuron_id").alias("n"), F.col("reviewed_by").alias("r"))
        out = found if out is None else out.unionByName(found)
    return out


_D = "'d-' || sha256('doc') || '-c0000000' || "


@calls(f"SELECT {_D} i AS id, t AS text FROM (VALUES (0, 'One two.'), (1, 'Three four five'), (2, 'six seven.'), (3, 'ééééé')) AS v(i, t) UNION ALL SELECT 'd-' || sha256('x') || '-c00000000', 'a b c'")
def chunk_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame([("doc", "One two. Three four five six seven.\n\nééééé"), ("x", "\ufeffa\tb\r\n\r\nc"), ("bad", "a\x00"), ("none", None)], "id string, text string")
    return construct.prepare(docs, 16, skip_bad=True).select("id", "text")


@calls("SELECT 'facts' AS part, 'entities/acme' AS f, 'entities/' || t AS t, c FROM (SELECT *, CASE r WHEN 'MAKES' THEN 'bolt' ELSE 'cog' END AS t FROM (" + _GROUNDED + ")) UNION ALL SELECT 'mentions', 'chunks/case-space-' || c, 'entities/' || e, c FROM (VALUES ('1', 'acme'), ('1', 'bolt'), ('2', 'acme'), ('2', 'bolt'), ('3', 'acme'), ('3', 'bolt'), ('4', 'acme'), ('4', 'bolt'), ('5', 'acme'), ('5', 'cog'), ('6', 'acme'), ('6', 'cog'), ('7', 'acme'), ('7', 'cog'), ('8', 'acme')) AS v(c, e) UNION ALL SELECT 'entities', 'entities/' || e, NULL, NULL FROM (VALUES ('acme'), ('bolt'), ('cog')) AS v(e) UNION ALL SELECT 'chunks', 'chunks/case-space-' || c, NULL, c::VARCHAR FROM range(1, 10) AS v(c)")
def materialised_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, null = construct.materialise(_cases(spark), CASES), F.lit(None).cast("string")
    out = graph["entities"].select(F.lit("entities").alias("part"), F.col("_id").alias("f"), null.alias("t"), null.alias("c"))
    out = out.union(graph["chunks"].select(F.lit("chunks"), "_id", null, "chunk_id"))
    for part in ("mentions", "facts"):
        out = out.union(graph[part].select(F.lit(part), "_from", "_to", "evidence_chunk_id"))
    return out


@calls("SELECT 'facts' AS part, '2' AS c UNION ALL SELECT 'facts', '3' UNION ALL SELECT 'facts', '6' UNION ALL SELECT 'facts', '7' UNION ALL SELECT 'facts', 'n' UNION ALL SELECT 'chunks', c::VARCHAR FROM range(1, 10) AS v(c) UNION ALL SELECT 'chunks', 'n'")
def ingested_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk that comes again replaces what was derived from it; a new one adds."""
    graph = construct.materialise(_cases(spark), CASES)
    new = spark.createDataFrame([("1", "Cog"), ("n", "Acme makes bolts")], "id string, text string")
    graph = construct.ingest(graph, new, CASES)
    return graph["facts"].select(F.lit("facts").alias("part"), F.col("evidence_chunk_id").alias("c")).union(graph["chunks"].select(F.lit("chunks"), "chunk_id"))


@calls("SELECT * FROM (VALUES ('none', 'MAKES', 3), ('source', 'MAKES', 3), ('target', 'MAKES', 3), ('both', 'MAKES', 3), ('none', 'SELLS', 3), ('source', 'SELLS', 3), ('target', 'SELLS', 2), ('both', 'SELLS', 2)) AS t(gate, relation, chunks)")
def advised_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.advise_gates(_cases(spark), CASES).select("gate", "relation", F.col("chunks").cast("int").alias("chunks"))


@calls("SELECT 'Acme' AS source, 'MAKES' AS relation, 'Cog' AS target, 3::BIGINT AS support")
def gap_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = construct.Space("s", CASES.entities, (construct.Rule("Acme", "MAKES", "Bolt", ("makes",)),))
    facts = spark.createDataFrame([("Acme", "Bolt")], "source string, target string")
    return construct.gaps(_cases(spark), space, facts)


@calls("SELECT 'h' AS neuron_id, 'MAKES' AS relation, '8' AS chunk_id, 'lost' AS change")
def ablation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.ablate(_cases(spark), CASES, [_HINT, _IDLE]).select("neuron_id", "relation", "chunk_id", "change")


@calls("SELECT * FROM (VALUES ('MAKES', 'still_violated', 'b'), ('HATES', 'never_fired', 'i'), ('FORGES', 'suppressed', 'f')) AS t(relation, status, blockers)")
def blocker_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = {**_HINT, "id": "g", "relation": "FORGES"}
    block = {**_BLOCK, "id": "f", "relation": "FORGES"}
    found = construct.blocker_report(_cases(spark), CASES, [_HINT, _BLOCK, _IDLE, hint, block], [("Acme", "MAKES", "Bolt"), ("Acme", "HATES", "Cog"), ("Acme", "FORGES", "Bolt")])
    return found.select("relation", "status", F.array_join("attributed_to", ",").alias("blockers"))


@calls("SELECT * FROM (VALUES ('h', 'covered_by_base'), ('i', 'inert_blocker'), ('o', 'covered_by_others'), ('s', 'covered_by_others')) AS t(n, reason)")
def graduation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = {**_HINT, "relation": "FORGES"}
    neurons = [_HINT, _IDLE, _DEAD, {**new, "id": "o", "triggers": ["makes bolts"]}, {**new, "id": "p", "triggers": ["never said"], "relation": "NEVER"}, {**new, "id": "q", "triggers": ["forges"], "status": "proposed"}, {**new, "id": "r", "triggers": ["rumour"], "relation": "ONLY"}, {**new, "id": "s", "triggers": ["forges"], "source": "Acme"}]
    found = construct.graduation_report(_cases(spark), CASES, neurons)
    return found.select(F.col("neuron_id").alias("n"), "reason")


@calls("SELECT * FROM (VALUES ('rule:2', 'base_rule', 'LOST'), ('d', 'neuron', 'FITS')) AS t(id, kind, relation)")
def degradation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (construct.Rule("Acme", "MAKES", "Bolt", ("makes bolts",)), construct.Rule("Acme", "SELLS", "Cog", ("sells",)), construct.Rule("Acme", "LOST", "Cog", ("so that Acme", "absent")))
    space = construct.Space("s", CASES.entities, rules)
    return construct.degradation_report(_cases(spark), space, [_HINT, _BLOCK, _DEAD]).select("id", "kind", "relation")


_LICENCES = construct.Space.from_json({"entities": [{"name": "MIT License", "aliases": []}, {"name": "Apache License", "aliases": ["apache licence"]}]})


@calls(r"""WITH f AS (SELECT doc_id AS i, lower(coalesce(text, '')) AS x FROM documents),
p AS (SELECT i, x, [{'a': s, 'b': 'mit license'} FOR s IN ['apache license', 'apache licence']] AS ab FROM f),
q AS (SELECT i, x, list_concat(ab, [{'a': y.b, 'b': y.a} FOR y IN ab]) AS ab FROM p),
r AS (SELECT i, x, [{'a': y.a, 'b': y.b, 'z': substr(x, strpos(x, y.a) + length(y.a))} FOR y IN ab] AS ab FROM q),
s AS (SELECT i, x, len([1 FOR y IN ab IF strpos(x, y.a) > 0 AND strpos(y.z, y.b) > 0 AND regexp_replace(substr(y.z, 1, strpos(y.z, y.b) - 1), '^[\s,;]+|[\s,;]+$', '', 'g') IN ('', 'and', 'or', 'and/or')]) > 0 AS beside FROM r)
SELECT i, NOT contains(x, 'mit license') AS absent, beside, NOT (contains(x, 'relea') OR contains(x, 'unde')) AS silent FROM s""")
def semantic_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals against the fact that a text releases Apache code under MIT."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    facts = docs.select(F.col("doc_id").alias("i"), F.lit("Apache License").alias("source"), F.lit("RELEASED_UNDER_the").alias("relation"), F.lit("MIT License").alias("target"), F.coalesce("text", F.lit("")).alias("sentence"))
    said = construct.semantic_signals(facts, _LICENCES.entities)
    return said.select("i", *[F.array_join("signals", ";").contains(w).alias(n) for n, w in (("absent", "target absent"), ("beside", "co-listed"), ("silent", "vocabulary"))])


@calls("SELECT n_regionkey::VARCHAR AS predicate, '{target} and {source} meet' AS template, count(*) AS n, 1 AS place FROM nation WHERE n_regionkey <> 4 GROUP BY 1 HAVING min(n_regionkey) = (SELECT min(n_regionkey) FROM (SELECT n_regionkey, count(*) AS c FROM nation WHERE n_regionkey <> 4 GROUP BY 1) WHERE c = (SELECT max(c) FROM (SELECT count(*) AS c FROM nation WHERE n_regionkey <> 4 GROUP BY n_regionkey)))")
def mined_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All regions share one phrase, which goes to the one that has it most often."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("id", F.col("n_nationkey").cast("string"))
    triples = nation.select("id", F.col("n_name").alias("subject"), F.col("n_regionkey").cast("string").alias("predicate"), F.lit("Lord_Y").alias("object"))
    docs = nation.select("id", F.concat(F.lit("Lord Y and "), F.translate("n_name", "_", " "), F.lit(" meet!")).alias("text"))
    two = triples.filter("predicate = '4'")
    return mining.mine(docs, triples.unionByName(two))


@calls("SELECT * FROM (VALUES ('1', 'Aarhus', 'leader', 'Jacob_B'), ('2', 'X', 'born', '1990-03-02'), ('4', 'Pim', 'near', 'Bob'), ('4', 'Bob', 'near', 'Pim')) AS t(id, subject, predicate, object)")
def fuzzy_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = [("1", "The current leader of the city of Aarhus is, notably, Jacob B.", ["Aarhus", "Jacob_B"]), ("2", "X was born on the 2nd March, 1990!", ["X", "1990-03-02"]), ("3", "X was later and much later and indeed at last born in 1990", ["X", "1990"]), ("4", "Pim is near Bob. Bob is near Pim", ["Pim", "Bob", "Cat"]), ("5", None, ["A"]), ("6", "Pim is. Near Bob", ["Pim", "Bob"])]
    rules = {"leader": ["the leader of {source} is {target}"], "born": ["{source} was born {target}"], "near": ["{source} is near {target}"]}
    return mining.ground_fuzzy(spark.createDataFrame(docs, "id string, text string, entities array<string>"), rules)


@calls("SELECT * FROM (VALUES (NULL, 3, 4, 1, 1 / 3.0::DOUBLE, 0.25::DOUBLE, 1, 2), ('born in', 1, 1, 0, 0.0, 0.0, 0, 1), ('leader', 2, 2, 1, 0.5, 0.5, 0, 0), ('head', 0, 1, 0, NULL, 0.0, 1, 1)) AS t(predicate, known, built, correct, recall, precision, mislabeled, pairs)")
def fact_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "id string, subject string, predicate string, object string"
    known = spark.createDataFrame([("1", "Aarhus", "leader", "Jacob_B"), ("1", "aarhus ", "Leader", "jacob b"), ("2", "P", "leader", "Q"), ("2", "X", "born_in", "1990.0")], schema)
    built = spark.createDataFrame([("1", "Aarhus", "leader", "Jacob B"), ("1", "Z", "leader", "Y"), ("2", "P", "head", "Q"), ("2", "1990", "born in", "X")], schema)
    out = mining.score(known, built)
    return out.select("predicate", *[F.col(c).cast("int").alias(c) for c in ("known", "built", "correct")], "recall", "precision", *[F.col(c).cast("int").alias(c) for c in ("mislabeled", "pairs")])
