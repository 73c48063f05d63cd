"""The open SQL surface: one text for each shape of query, the same for Spark and for the SQL it is held against."""

from __future__ import annotations

from tidemark.sources.tables import sql

from .catalog import register

D = "CAST(o_orderdate AS DATE)"
QUERIES = {
    # scans, projections, filters
    "scan_types_select": "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer",
    "filter_range_dates": f"SELECT o_orderkey, {D} AS d FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00'",
    "filter_isin": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "filter_between_null_safe": "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND NOT (p_brand IS NULL)",
    "search_contains": "SELECT p_partkey, p_name FROM part WHERE lower(concat_ws(' ', p_name, p_brand, p_type)) LIKE '%a%1%'",
    "try_cast_coerce": "SELECT event_id, coalesce(try_cast(substr(props, 7, 2) AS INT), -1) AS n FROM events",
    "case_expression": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size FROM orders",
    "string_functions": "SELECT s_suppkey, upper(s_name) AS up, lower(s_name) AS low, length(s_name) AS n, substr(s_name, 1, 4) AS head, replace(s_name, '0', 'o') AS rep, lpad(CAST(s_nationkey AS VARCHAR(10)), 4, '0') AS pad, trim(concat(' ', s_name, ' ')) AS t FROM supplier",
    "math_functions": "SELECT p_partkey, round(exp(ln(p_retailprice)), 4) AS e, round(sqrt(p_retailprice), 6) AS s, abs(-p_size) AS a, ceil(p_retailprice / 7) AS c, floor(p_retailprice / 7) AS f, round(pow(p_size, 2), 2) AS p, greatest(p_size, 25) AS g, least(p_size, 25) AS l, sign(p_size - 25) AS sg FROM part",
    "date_functions": f"SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, last_day({D}) AS e FROM orders",
    "null_functions": "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS s, nullif(o_orderstatus, 'O') IS NULL AS o FROM orders",
    # joins
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "join_right": "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey",
    "join_full": "SELECT coalesce(c.k, s.k) AS k, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 15 GROUP BY 1) c FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 10 GROUP BY 1) s ON c.k = s.k",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey <> n_regionkey",
    "join_theta_range": "SELECT r.r_name, count(*) AS n FROM region r JOIN nation n ON n.n_nationkey > r.r_regionkey * 5 GROUP BY r.r_name",
    "join_self": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_multi_way": "SELECT r_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "join_null_safe": "SELECT a.n_nationkey, b.s_suppkey FROM nation a JOIN supplier b ON nullif(a.n_nationkey, 3) IS NOT DISTINCT FROM nullif(b.s_nationkey, 3)",
    "join_lateral": "SELECT n_name, x.s_suppkey FROM nation, LATERAL (SELECT max(s_suppkey) AS s_suppkey FROM supplier WHERE s_nationkey = n_nationkey) x",
    "join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    # aggregation
    "group_by_having": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 5",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "rollup": "SELECT l_returnflag, l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "distinct_agg": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_orderstatus",
    "filter_clause": "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS large, round(sum(l_tax) FILTER (WHERE l_discount > 0.05), 2) AS tax FROM lineitem GROUP BY l_returnflag",
    "corr_covar": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_discount), 6) AS c, round(var_samp(l_quantity), 4) AS v, round(stddev_pop(l_tax), 6) AS s FROM lineitem GROUP BY l_returnflag",
    "bool_aggregates": "SELECT o_orderpriority, bool_and(o_totalprice > 0) AS every_positive, bool_or(o_totalprice > 400000) AS any_large FROM orders GROUP BY o_orderpriority",
    "aggregate_q1": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    # windows
    "row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders",
    "rank": "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS n FROM part",
    "dense_rank": "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS n FROM part",
    "percent_rank": "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS n FROM part",
    "cume_dist": "SELECT p_partkey, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS n FROM part",
    "ntile": "SELECT p_partkey, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS n FROM part",
    "lag_lead": "SELECT o_orderkey, coalesce(lag(o_orderkey, 1) OVER w, -1) AS before, coalesce(lead(o_orderkey, 2) OVER w, -1) AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "first_last_nth": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, coalesce(nth_value(o_orderkey, 2) OVER w, -1) AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "range_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM part",
    "rows_frame": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s FROM events",
    "top_k_latest": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) t WHERE n <= 3",
    # sets and shapes
    "union_all": "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), mean AS (SELECT avg(t) AS m FROM big) SELECT o_custkey, round(t, 2) AS t FROM big, mean WHERE t > m",
    "recursive_cte": "WITH RECURSIVE steps(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM steps WHERE n < 50) SELECT n, total FROM steps",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "correlated_subquery": "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "in_subquery": "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)",
    "order_limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10",
    "dedupe_keep_first": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) t WHERE n = 1",
    "dedupe_keep_last": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) t WHERE n = 1",
    "values_lookup": "SELECT o_orderstatus, w, count(*) AS n FROM orders JOIN (VALUES ('F', 1), ('O', 2), ('P', 3)) AS v(s, w) ON o_orderstatus = s GROUP BY o_orderstatus, w",
    "conversation_turns": "SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role",
}
for _name, _query in QUERIES.items():
    register(_name, _query)(lambda spark, sf_dir, q=_query: sql(spark, sf_dir, q))
