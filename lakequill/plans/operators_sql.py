"""One query for each operator of the inventory that returns rows, over the benchmark tables."""

from __future__ import annotations

_D = "cast({} AS decimal(15,2))"

#: name -> (Spark text, DuckDB text or None when it is the same)
SQL: dict[str, tuple[str, str | None]] = {
    # scans, projection, filter, expressions
    "s02_scan": ("SELECT * FROM lineitem", None),
    "p01_project": ("SELECT n_name, n_regionkey + 1 AS next_region FROM nation", None),
    "p02_star": ("SELECT p.* FROM part p", None),
    "p03_alias": ("SELECT s.s_name AS supplier_name FROM supplier AS s", None),
    "p04_filter": ("SELECT o_orderkey, o_totalprice FROM orders WHERE nullif(o_orderstatus, 'F') = 'O'", None),
    "p05_compare": ("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_quantity <> 40 AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00'", None),
    "p06_arith": ("SELECT l_orderkey, l_linenumber, l_orderkey / 7 AS d, l_quantity / 4 AS q, 7 / 2 AS whole, l_orderkey % 7 AS m, l_linenumber * 3 - 1 AS t FROM lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS d, l_quantity / 4 AS q, cast(3 AS bigint) AS whole, l_orderkey % 7 AS m, l_linenumber * 3 - 1 AS t FROM lineitem"),
    "p07_logic": ("SELECT l_orderkey, l_linenumber, (nullif(l_linenumber, 2) > 3) OR (l_linenumber > 4) AS either, (nullif(l_linenumber, 2) > 3) AND (l_linenumber > 4) AS both_true, NOT (nullif(l_linenumber, 2) > 3) AS negated FROM lineitem", None),
    "p08_unary": ("SELECT l_orderkey, l_linenumber, -l_linenumber AS neg, +l_linenumber AS pos FROM lineitem", None),
    "p09_is_null": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE nullif(l_linenumber, 3) IS NULL OR nullif(l_linenumber, 5) IS NOT NULL", None),
    "p10_is_true": ("SELECT o_orderkey, (nullif(o_orderstatus, 'P') = 'O') IS TRUE AS is_open, (nullif(o_orderstatus, 'P') = 'O') IS FALSE AS is_closed FROM orders", None),
    "p11_between": ("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_partkey NOT BETWEEN 100 AND 200", None),
    "p12_in": ("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)", None),
    "p13_like": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ol_' AND p_type NOT LIKE 'PROMO%'", None),
    "p14_cast": ("SELECT p_partkey, try_cast(p_name AS int) AS as_int, cast(p_size AS double) AS as_double, cast(p_retailprice AS decimal(12,2)) AS as_decimal FROM part", None),
    "p14_typed_literal": ("SELECT o_orderkey FROM orders WHERE cast(o_orderdate AS date) > DATE '2000-01-01'", None),
    "p15_case": ("SELECT l_linenumber, CASE WHEN nullif(l_linenumber, 4) > 5 THEN 'high' WHEN nullif(l_linenumber, 4) > 2 THEN 'mid' WHEN nullif(l_linenumber, 4) > 1 THEN 'low' END AS band, count(*) AS n FROM lineitem GROUP BY 1, 2", None),
    "p16_simple_case": ("SELECT o_orderkey, CASE nullif(o_orderstatus, 'P') WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS code FROM orders", None),
    "p17_coalesce": ("SELECT l_linenumber, coalesce(nullif(l_linenumber, 1), nullif(l_linenumber, 2), 0) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2", None),
    "p18_nullif": ("SELECT nullif(l_linenumber, 3) AS v, count(*) AS n FROM lineitem GROUP BY 1", None),
    "p20_literals": ("SELECT n_nationkey, 1 AS i, 'text' AS s, true AS b, DATE '2020-02-29' AS d, TIMESTAMP '2020-02-29 12:00:00' AS t, cast(2.50 AS decimal(4,2)) AS dec, cast(NULL AS bigint) AS nothing FROM nation", None),
    # joins
    "j01_inner": ("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey = 3", None),
    "j02_left": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey", None),
    "j02_right": ("SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c RIGHT JOIN orders ON c_custkey = o_custkey", None),
    "j02_full": ("SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 0) c FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) o ON c_custkey = o_custkey", None),
    "j03_left_residual": ("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '1-%' GROUP BY c_custkey", None),
    "j05_theta": ("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey > r_regionkey", None),
    "j05_left_theta": ("SELECT r_name, n_name FROM region LEFT JOIN nation ON n_nationkey < r_regionkey AND n_regionkey <> r_regionkey", None),
    "j06_cross": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "j06_comma": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", None),
    "j07_semi": ("SELECT s_suppkey, s_name FROM supplier LEFT SEMI JOIN (SELECT * FROM lineitem WHERE l_quantity > 49) l ON s_suppkey = l_suppkey", "SELECT s_suppkey, s_name FROM supplier SEMI JOIN (SELECT * FROM lineitem WHERE l_quantity > 49) l ON s_suppkey = l_suppkey"),
    "j08_anti": ("SELECT c_custkey FROM customer LEFT ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 100000) o ON nullif(c_custkey, 5) = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 100000) o ON nullif(c_custkey, 5) = o_custkey"),
    "j09_in": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", None),
    "j09_not_in": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", None),
    "j09_not_in_null": ("SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 7) FROM orders)", None),
    "j10_exists": ("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)", None),
    "j10_not_exists": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)", None),
    "j11_self_join": ("SELECT n1.n_name AS a, n2.n_name AS b, count(*) AS n FROM nation n1 JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey AND n1.n_nationkey < n2.n_nationkey GROUP BY n1.n_name, n2.n_name", None),
    "j12_derived": ("SELECT big.k, big.n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) big WHERE big.n > 10", None),
    "j13_using": ("SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y USING (k)", None),
    "j15_nested": ("SELECT c_custkey, n_name, r_name FROM customer JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey", None),
    # aggregation
    "a01_group": (f"SELECT l_returnflag, l_linestatus, count(*) AS n, cast(sum({_D.format('l_extendedprice')}) AS double) AS total FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "a01_group_null": ("SELECT nullif(o_orderstatus, 'F') AS status, count(*) AS n FROM orders GROUP BY nullif(o_orderstatus, 'F')", None),
    "a02_global": ("SELECT count(*) AS n, min(o_orderdate) AS first_day, max(o_totalprice) AS most FROM orders", None),
    "a02_empty": ("SELECT sum(l_linenumber) AS total, count(*) AS n, min(l_shipmode) AS low FROM (SELECT l_linenumber, l_returnflag AS l_shipmode FROM lineitem WHERE false) none", "SELECT cast(sum(l_linenumber) AS bigint) AS total, count(*) AS n, min(l_shipmode) AS low FROM (SELECT l_linenumber, l_returnflag AS l_shipmode FROM lineitem WHERE false) none"),
    "a03_count": ("SELECT l_returnflag, count(*) AS n, count(nullif(l_linenumber, 2)) AS some FROM lineitem GROUP BY l_returnflag", None),
    "a04_sum": (f"SELECT l_suppkey, sum(l_linenumber) AS lines, sum({_D.format('l_extendedprice')}) AS money FROM lineitem GROUP BY l_suppkey", f"SELECT l_suppkey, cast(sum(l_linenumber) AS bigint) AS lines, cast(sum({_D.format('l_extendedprice')}) AS decimal(25,2)) AS money FROM lineitem GROUP BY l_suppkey"),
    "a05_avg": ("SELECT p_brand, round(avg(p_size), 6) AS mean_size FROM part GROUP BY p_brand", None),
    "a06_min_max": ("SELECT p_type, min(p_name) AS first_name, max(p_name) AS last_name, min(p_size) AS smallest, max(p_retailprice) AS dearest FROM part GROUP BY p_type", None),
    "a07_count_distinct": ("SELECT p_brand, count(DISTINCT l_suppkey) AS suppliers, sum(DISTINCT l_linenumber) AS lines FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand", "SELECT p_brand, count(DISTINCT l_suppkey) AS suppliers, cast(sum(DISTINCT l_linenumber) AS bigint) AS lines FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand"),
    "a08_group_expr": ("SELECT l_orderkey % 10 AS bucket, count(*) AS n FROM lineitem GROUP BY l_orderkey % 10", None),
    "a09_having": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 400000 AND count(*) > 5", None),
    "a10_ratio": ("SELECT l_returnflag, round(100.0 * cast(sum(l_linenumber) AS double) / cast(count(*) AS double), 6) AS ratio, CASE WHEN count(*) > 10000 THEN 'many' ELSE 'few' END AS size FROM lineitem GROUP BY l_returnflag", None),
    "a11_agg_expr": (f"SELECT l_linestatus, cast(sum({_D.format('l_extendedprice')} * (1 - {_D.format('l_discount')})) AS double) AS revenue, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS big FROM lineitem GROUP BY l_linestatus", f"SELECT l_linestatus, cast(sum({_D.format('l_extendedprice')} * (1 - {_D.format('l_discount')})) AS double) AS revenue, cast(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS bigint) AS big FROM lineitem GROUP BY l_linestatus"),
    "a12_two_phase": ("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type", None),
    # windows
    "w01_row_number": ("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rn FROM orders"),
    "w02_rank": ("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY nullif(p_size, 7)) AS r FROM part", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY nullif(p_size, 7) NULLS LAST) AS r FROM part"),
    "w03_dense_rank": ("SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY nullif(p_size, 7)) AS r FROM part", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY nullif(p_size, 7) NULLS LAST) AS r FROM part"),
    "w04_partition_agg": (f"SELECT o_orderkey, sum({_D.format('o_totalprice')}) OVER (PARTITION BY o_custkey) AS total, max(o_totalprice) OVER (PARTITION BY o_custkey) AS most, min(o_totalprice) OVER (PARTITION BY o_custkey) AS least FROM orders", f"SELECT o_orderkey, cast(sum({_D.format('o_totalprice')}) OVER (PARTITION BY o_custkey) AS double) AS total, max(o_totalprice) OVER (PARTITION BY o_custkey) AS most, min(o_totalprice) OVER (PARTITION BY o_custkey) AS least FROM orders"),
    "w05_partition_count": ("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, count(nullif(o_orderstatus, 'F')) OVER (PARTITION BY o_custkey) AS open FROM orders", None),
    "w06_running": (f"SELECT o_orderkey, sum({_D.format('o_totalprice')}) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) AS running, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) AS so_far FROM orders", f"SELECT o_orderkey, cast(sum({_D.format('o_totalprice')}) OVER w AS double) AS running, count(*) OVER w AS so_far FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
    # order, limit
    "w06_running_ties": ("SELECT x.k, sum(x.v) OVER (ORDER BY x.k) AS s, count(*) OVER (ORDER BY x.k) AS n FROM (SELECT * FROM (VALUES (1, 10), (2, 20), (2, 20), (3, 5)) v(k, v)) x", "SELECT k, s, n FROM (VALUES (1, 10.0::double, 1::bigint), (2, 30.0::double, 2::bigint), (2, 50.0::double, 3::bigint), (3, 55.0::double, 4::bigint)) v(k, s, n)"),
    "o01_order": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey", None),
    "o02_nulls_last": ("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status, row_number() OVER (ORDER BY nullif(o_orderstatus, 'F') DESC, o_orderkey) AS place, rank() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'F')) AS up FROM orders ORDER BY nullif(o_orderstatus, 'F') DESC, o_orderkey", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status, row_number() OVER (ORDER BY nullif(o_orderstatus, 'F') DESC NULLS LAST, o_orderkey) AS place, rank() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'F') NULLS LAST) AS up FROM orders"),
    "o03_order_alias": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, count(*) + o_custkey", None),
    "o02_nulls_top": ("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders ORDER BY nullif(o_orderstatus, 'F') DESC, o_orderkey DESC LIMIT 20", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders ORDER BY nullif(o_orderstatus, 'F') DESC NULLS LAST, o_orderkey DESC LIMIT 20"),
    "o04_order_unselected": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30", None),
    "o05_order_ordinal": ("SELECT o_custkey, o_orderkey FROM orders ORDER BY 1 DESC, 2 LIMIT 30", None),
    "o06_limit_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", None),
    "o07_top_k": ("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 100", None),
    # sets
    "t01_union_all": ("SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier", None),
    "t02_union": ("SELECT c_nationkey AS k FROM customer UNION SELECT r_regionkey FROM region", None),
    "t04_distinct": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "t05_intersect": ("SELECT n_nationkey AS k FROM nation INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900", None),
    "t06_except": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000", None),
    "t07_align": ("SELECT n_nationkey AS v FROM nation UNION ALL SELECT o_orderkey FROM orders UNION ALL SELECT s_acctbal FROM supplier", None),
    "t08_chained": ("(SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region) EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000", None),
    # subqueries
    "q01_scalar": ("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) + 20 FROM part)", None),
    "q01_scalar_empty": ("SELECT n_nationkey, (SELECT r_name FROM region WHERE r_regionkey = 99) AS nothing FROM nation", None),
    "q03_correlated": ("SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice = (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", None),
    "q04_cte": ("WITH per_customer(k, n) AS (SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey), busy(k, n) AS (SELECT k, n FROM per_customer WHERE n > 10) SELECT a.k, a.n, b.n AS same FROM busy a JOIN per_customer b ON a.k = b.k", None),
    "q04_cte_shadow": ("WITH nation AS (SELECT r_regionkey AS x, r_name AS y FROM region), region AS (SELECT x + 1 AS z FROM nation) SELECT n.x, n.y, r.z FROM nation n JOIN region r ON n.x = r.z", None),
    "p_extract_from": ("SELECT extract(YEAR FROM orders) AS y, substring(region FROM 1 FOR 2) AS s, count(*) AS n FROM (SELECT cast(o_orderdate AS date) AS orders, o_orderstatus || '-' AS region FROM orders) x GROUP BY 1, 2", None),
    "q06_from": ("SELECT r_name, sub.n FROM region JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) sub ON sub.n_regionkey = r_regionkey", None),
}
