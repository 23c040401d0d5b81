"""Benchmark queries, adapted to the tables at hand.

There is no partsupp: what a supplier offers is taken from lineitem. Dates lie in 1995 to
2001, nations are numbered, part types are one word. Sums of money are decimal, so that
both engines give one value.
"""

from __future__ import annotations

_PRICE = "cast(l_extendedprice AS decimal(15,2))"
_REVENUE = f"{_PRICE} * (1 - cast(l_discount AS decimal(15,2)))"

#: Sizes of the sixteenth query, as published; fixed values.
_SIZES = "49, 14, 23, 45, 19, 3, 36, 9"

#: name -> (Spark text, DuckDB text or None when it is the same)
SQL: dict[str, tuple[str, str | None]] = {
    "tpch_q01": (
        f"""
        SELECT l_returnflag, l_linestatus,
               cast(sum(cast(l_quantity AS decimal(15,2))) AS double) AS sum_qty,
               cast(sum({_PRICE}) AS double) AS sum_base_price,
               cast(sum({_REVENUE}) AS double) AS sum_disc_price,
               count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00'
        GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus
        """,
        None,
    ),
    "tpch_q02": (
        f"""
        SELECT s_acctbal, s_name, n_name, p_partkey, p_brand, cast(low AS double) AS unit_price
        FROM (SELECT l_partkey AS mp, min({_PRICE}) AS low FROM lineitem GROUP BY l_partkey) m
        JOIN lineitem ON l_partkey = mp AND {_PRICE} = low
        JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
        JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
        WHERE p_size = 15 AND r_name = 'EUROPE'
        ORDER BY s_acctbal DESC NULLS LAST, n_name NULLS LAST, s_name NULLS LAST, p_partkey NULLS LAST, unit_price LIMIT 100
        """,
        None,
    ),
    "tpch_q03": (
        f"""
        SELECT l_orderkey, cast(sum({_REVENUE}) AS double) AS revenue, o_orderdate
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
        GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC NULLS LAST, o_orderdate NULLS LAST, l_orderkey LIMIT 10
        """,
        None,
    ),
    "tpch_q04": (
        """
        SELECT o_orderpriority, count(*) AS order_count FROM orders
        WHERE o_orderdate >= TIMESTAMP '1997-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-10-01 00:00:00'
          AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)
        GROUP BY o_orderpriority ORDER BY o_orderpriority
        """,
        None,
    ),
    "tpch_q05": (
        f"""
        SELECT n_name, cast(sum({_REVENUE}) AS double) AS revenue
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00'
        GROUP BY n_name ORDER BY revenue DESC NULLS LAST
        """,
        None,
    ),
    "tpch_q06": (
        f"""
        SELECT cast(sum({_PRICE} * cast(l_discount AS decimal(15,2))) AS double) AS revenue FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00'
          AND cast(l_discount AS decimal(15,2)) BETWEEN 0.05 AND 0.07 AND l_quantity < 24
        """,
        None,
    ),
    "tpch_q07": (
        f"""
        SELECT supp_nation, cust_nation, l_year, cast(sum(volume) AS double) AS revenue FROM (
          SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, cast(extract(YEAR FROM l_shipdate) AS bigint) AS l_year, {_REVENUE} AS volume
          FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
          JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
          WHERE (n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1')) shipping
        GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year
        """,
        None,
    ),
    "tpch_q08": (
        f"""
        SELECT o_year, round(cast(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) AS double) / cast(sum(volume) AS double), 6) AS mkt_share FROM (
          SELECT cast(extract(YEAR FROM o_orderdate) AS bigint) AS o_year, {_REVENUE} AS volume, n2.n_name AS nation
          FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey
          JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey
          JOIN nation n2 ON s_nationkey = n2.n_nationkey WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY') all_nations
        GROUP BY o_year ORDER BY o_year
        """,
        None,
    ),
    "tpch_q09": (
        f"""
        SELECT nation, o_year, cast(sum(amount) AS double) AS sum_profit FROM (
          SELECT n_name AS nation, cast(extract(YEAR FROM o_orderdate) AS bigint) AS o_year, {_REVENUE} - cast(p_retailprice AS decimal(15,2)) AS amount
          FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
          JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%blue%') profit
        GROUP BY nation, o_year ORDER BY nation, o_year DESC
        """,
        None,
    ),
    "tpch_q10": (
        f"""
        SELECT c_custkey, c_name, cast(sum({_REVENUE}) AS double) AS revenue, c_acctbal, n_name
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
        WHERE o_orderdate >= TIMESTAMP '1997-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AND l_returnflag = 'R'
        GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC NULLS LAST, c_custkey LIMIT 20
        """,
        None,
    ),
    "tpch_q11": (
        f"""
        SELECT l_partkey, cast(sum({_PRICE}) AS double) AS value
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7'
        GROUP BY l_partkey HAVING sum({_PRICE}) > (
          SELECT sum({_PRICE}) * 0.001 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7')
        ORDER BY value DESC, l_partkey
        """,
        None,
    ),
    "tpch_q12": (
        """
        SELECT l_linestatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high_line_count,
               sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS low_line_count
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        WHERE l_returnflag IN ('A', 'N') AND l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00'
        GROUP BY l_linestatus ORDER BY l_linestatus
        """,
        """
        SELECT l_linestatus, cast(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS bigint) AS high_line_count,
               cast(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS bigint) AS low_line_count
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        WHERE l_returnflag IN ('A', 'N') AND l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00'
        GROUP BY l_linestatus ORDER BY l_linestatus
        """,
    ),
    "tpch_q13": (
        """
        SELECT c_count, count(*) AS custdist FROM (
          SELECT c_custkey, count(o_orderkey) AS c_count FROM customer
          LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '1-%' GROUP BY c_custkey) c_orders
        GROUP BY c_count ORDER BY custdist DESC, c_count DESC
        """,
        None,
    ),
    "tpch_q14": (
        f"""
        SELECT round(100.0 * cast(sum(CASE WHEN p_type LIKE 'PROMO%' THEN {_REVENUE} ELSE 0 END) AS double) / cast(sum({_REVENUE}) AS double), 6) AS promo_revenue
        FROM lineitem JOIN part ON l_partkey = p_partkey
        WHERE l_shipdate >= TIMESTAMP '1997-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-10-01 00:00:00'
        """,
        None,
    ),
    "tpch_q15": (
        f"""
        WITH revenue(supplier_no, total) AS (
          SELECT l_suppkey, sum({_REVENUE}) FROM lineitem
          WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-04-01 00:00:00' GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, cast(total AS double) AS total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no
        WHERE total = (SELECT max(total) FROM revenue) ORDER BY s_suppkey
        """,
        None,
    ),
    "tpch_q16": (
        f"""
        SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt
        FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE p_brand <> 'Brand#4' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN ({_SIZES})
        GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size
        """,
        None,
    ),
    "tpch_q17": (
        f"""
        SELECT cast(sum({_PRICE}) AS double) AS total FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE p_type = 'STANDARD' AND l_quantity < (SELECT 0.4 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)
        """,
        None,
    ),
    "tpch_q18": (
        """
        SELECT c_name, c_custkey, o_orderkey, o_totalprice, cast(sum(cast(l_quantity AS decimal(15,2))) AS double) AS qty
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(cast(l_quantity AS decimal(15,2))) > 200)
        GROUP BY c_name, c_custkey, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100
        """,
        None,
    ),
    "tpch_q19": (
        f"""
        SELECT cast(sum({_REVENUE}) AS double) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE (p_brand = 'Brand#1' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
           OR (p_brand = 'Brand#2' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)
           OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 45)
        """,
        None,
    ),
    "tpch_q20": (
        """
        SELECT s_name, s_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
        WHERE n_name IN ('NATION_3', 'NATION_7', 'NATION_12') AND s_suppkey IN (
          SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'STANDARD')
          GROUP BY l_suppkey, l_partkey
          HAVING sum(l_quantity) > (SELECT 1.2 * avg(l_quantity) FROM lineitem))
        ORDER BY s_name
        """,
        None,
    ),
    "tpch_q21": (
        """
        SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation
        WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_returnflag = 'R'
          AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
          AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
          AND s_nationkey = n_nationkey AND n_regionkey = 1
        GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100
        """,
        None,
    ),
    "tpch_q22": (
        """
        SELECT c_mktsegment, count(*) AS numcust, cast(sum(cast(c_acctbal AS decimal(15,2))) AS double) AS totacctbal FROM customer
        WHERE cast(c_acctbal AS decimal(15,2)) > (SELECT avg(cast(c_acctbal AS decimal(15,2))) FROM customer WHERE c_acctbal > 0)
          AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
        GROUP BY c_mktsegment ORDER BY c_mktsegment
        """,
        None,
    ),
}
