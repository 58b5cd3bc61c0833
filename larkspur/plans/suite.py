"""Registered queries over the driver's tables: dialect text, and the DuckDB SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text, time_series
from ..sql.session import Session
from . import function_suite

TABLES = function_suite.TABLES
_sessions: dict[tuple[str, str], Session] = {}


def session(spark: SparkSession, sf_dir: str) -> Session:
    """A session that reads the tables of sf_dir; one per Spark session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _sessions:
        s = _sessions[key] = Session(spark)
        for t in TABLES:
            s.register_table(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    return _sessions[key]


#: name -> (dialect SQL, DuckDB SQL); None: the dialect SQL is DuckDB SQL as well.
SQL: dict[str, tuple[str, str | None]] = {
    "pricing_summary": (
        "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base_price, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS count_order FROM lineitem WHERE l_shipdate <= DATETIME '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    ),
    "shipping_priority": (
        "SELECT l_orderkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATETIME '1995-03-15 00:00:00' AND l_shipdate > DATETIME '1995-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10",
        "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10",
    ),
    "local_supplier": (
        "SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name",
        None,
    ),
    "forecast_revenue": (
        "SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= DATETIME '1994-01-01 00:00:00' AND l_shipdate < DATETIME '1995-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
        "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    ),
    "promo_revenue": (
        "SELECT ROUND(100 * SUM(IF(p_type LIKE 'PROMO%', l_extendedprice * (1 - l_discount), 0)) / SUM(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey",
        "SELECT round(100 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey",
    ),
    "project_except_replace": ("SELECT * EXCEPT (c_name) REPLACE (c_custkey + 1 AS c_custkey) FROM customer", "SELECT * EXCLUDE (c_name) REPLACE (c_custkey + 1 AS c_custkey) FROM customer"),
    "filter_having": ("SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey HAVING COUNT(*) > 5", None),
    "qualify_top_per_group": ("SELECT c_custkey, c_nationkey, c_acctbal FROM customer QUALIFY ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 2", None),
    "join_left": ("SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", None),
    "join_right": ("SELECT n_name, COUNT(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name", None),
    "join_full": ("SELECT c.k AS a, s.k AS b FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey < 15) AS c FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_nationkey > 10) AS s ON c.k = s.k", None),
    "join_using": ("SELECT r_regionkey, n_name FROM region JOIN (SELECT n_regionkey AS r_regionkey, n_name FROM nation) AS n USING (r_regionkey)", None),
    "join_cross": ("SELECT a.r_name AS a, b.r_name AS b FROM region AS a CROSS JOIN region AS b", None),
    "join_theta": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation AS a JOIN nation AS b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey", None),
    "semi_join_in": ("SELECT COUNT(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)", None),
    "anti_join_exists": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", None),
    "scalar_subquery": ("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer)", None),
    "correlated_subquery": ("SELECT s_suppkey, (SELECT n_name FROM nation WHERE n_nationkey = s_nationkey) AS nation FROM supplier", None),
    "array_subquery": ("SELECT r_name, ARRAY_TO_STRING(ARRAY(SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name), ',') AS names FROM region", "SELECT r_name, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey) AS names FROM region"),
    "empty_aggregate": ("SELECT COUNT(*) AS n, SUM(c_acctbal) AS s FROM customer WHERE c_custkey < 0", None),
    "grouping_sets": ("SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag) AS g, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", None),
    "rollup": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", None),
    "cube": ("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", None),
    "distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "group_by_all": ("SELECT c_mktsegment, c_nationkey, COUNT(*) AS n FROM customer GROUP BY ALL", None),
    "aggregate_modifiers": (
        "SELECT c_nationkey, STRING_AGG(c_mktsegment ORDER BY c_custkey LIMIT 3) AS s, ANY_VALUE(c_custkey HAVING MAX c_acctbal) AS top, COUNT(DISTINCT c_mktsegment) AS d, COUNTIF(c_acctbal < 0) AS neg FROM customer GROUP BY c_nationkey",
        "SELECT c_nationkey, array_to_string(list_slice(list(c_mktsegment ORDER BY c_custkey), 1, 3), ',') AS s, arg_max(c_custkey, c_acctbal) AS top, count(DISTINCT c_mktsegment) AS d, count(*) FILTER (WHERE c_acctbal < 0) AS neg FROM customer GROUP BY c_nationkey",
    ),
    "array_agg": ("SELECT n_regionkey, ARRAY_TO_STRING(ARRAY_AGG(n_name ORDER BY n_name DESC LIMIT 2), '|') AS a FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_slice(list(n_name ORDER BY n_name DESC), 1, 2), '|') AS a FROM nation GROUP BY n_regionkey"),
    "statistical_aggregates": (
        "SELECT ROUND(CORR(l_quantity, l_extendedprice), 8) AS c, ROUND(COVAR_POP(l_quantity, l_discount), 8) AS cp, ROUND(COVAR_SAMP(l_quantity, l_discount), 8) AS cs, ROUND(STDDEV(l_quantity), 8) AS sd, ROUND(STDDEV_POP(l_quantity), 8) AS sp, ROUND(VARIANCE(l_quantity), 8) AS v, ROUND(VAR_POP(l_quantity), 8) AS vp FROM lineitem",
        "SELECT round(corr(l_quantity, l_extendedprice), 8) AS c, round(covar_pop(l_quantity, l_discount), 8) AS cp, round(covar_samp(l_quantity, l_discount), 8) AS cs, round(stddev_samp(l_quantity), 8) AS sd, round(stddev_pop(l_quantity), 8) AS sp, round(var_samp(l_quantity), 8) AS v, round(var_pop(l_quantity), 8) AS vp FROM lineitem",
    ),
    "bit_and_logical_aggregates": ("SELECT BIT_AND(o_orderkey) AS a, BIT_OR(o_orderkey) AS o, BIT_XOR(o_orderkey) AS x, LOGICAL_AND(o_totalprice > 0) AS la, LOGICAL_OR(o_totalprice < 0) AS lo FROM orders", "SELECT bit_and(o_orderkey) AS a, bit_or(o_orderkey) AS o, bit_xor(o_orderkey) AS x, bool_and(o_totalprice > 0) AS la, bool_or(o_totalprice < 0) AS lo FROM orders"),
    "max_by_min_by": ("SELECT c_nationkey, MAX_BY(c_custkey, c_acctbal) AS a, MIN_BY(c_custkey, c_acctbal) AS b FROM customer GROUP BY c_nationkey", None),
    "union_all": ("SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region", None),
    "union_distinct": ("SELECT c_nationkey AS x FROM customer UNION DISTINCT SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS x FROM customer UNION SELECT s_nationkey FROM supplier"),
    "intersect": ("SELECT c_nationkey AS x FROM customer INTERSECT DISTINCT SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS x FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "except": ("SELECT c_custkey AS x FROM customer EXCEPT DISTINCT SELECT o_custkey FROM orders", "SELECT c_custkey AS x FROM customer EXCEPT SELECT o_custkey FROM orders"),
    "except_all": ("SELECT c_nationkey AS x FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", None),
    "intersect_all": ("SELECT c_nationkey AS x FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", None),
    "union_by_name": ("SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL BY NAME SELECT r_name AS v, r_regionkey AS k FROM region", "SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL BY NAME SELECT r_name AS v, r_regionkey AS k FROM region"),
    "order_limit_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", None),
    "window_ranks": ("SELECT o_orderkey, RANK() OVER w AS r, DENSE_RANK() OVER w AS d, ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS n, NTILE(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS t, ROUND(PERCENT_RANK() OVER w, 8) AS p, ROUND(CUME_DIST() OVER w, 8) AS c FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice)", "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS n, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS t, round(percent_rank() OVER w, 8) AS p, round(cume_dist() OVER w, 8) AS c FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice)"),
    "window_navigation": ("SELECT event_id, LAG(value, 1, 0) OVER w AS a, LEAD(value) OVER w AS b, FIRST_VALUE(value) OVER w AS f, LAST_VALUE(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, NTH_VALUE(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", None),
    "window_frames": ("SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS run, ROUND(AVG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS mov, COUNT(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS c FROM events", None),
    "window_distinct": ("SELECT DISTINCT user_id, COUNT(DISTINCT event_type) OVER (PARTITION BY user_id) AS k FROM events", "SELECT user_id, count(DISTINCT event_type) AS k FROM events GROUP BY user_id"),
    "percentiles": ("SELECT DISTINCT event_type, ROUND(PERCENTILE_CONT(value, 0.5) OVER (PARTITION BY event_type), 8) AS c, PERCENTILE_DISC(value, 0.25) OVER (PARTITION BY event_type) AS d FROM events", "SELECT event_type, round(quantile_cont(value, 0.5), 8) AS c, quantile_disc(value, 0.25) AS d FROM events GROUP BY event_type"),
    "cte": ("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000), per AS (SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey) SELECT n, COUNT(*) AS customers FROM per GROUP BY n", None),
    "recursive_cte": ("WITH RECURSIVE t AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n, n * n AS sq FROM t", None),
    "session_funnel": ("WITH gaps AS (SELECT user_id, event_id, ts, IF(DATETIME_DIFF(ts, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), SECOND) > 1800, 1, 0) AS new FROM events), sess AS (SELECT user_id, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM gaps) SELECT user_id, COUNT(DISTINCT sid) AS sessions FROM sess GROUP BY user_id", "WITH gaps AS (SELECT user_id, event_id, ts, CASE WHEN date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) > 1800 THEN 1 ELSE 0 END AS new FROM events), sess AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM gaps) SELECT user_id, count(DISTINCT sid) AS sessions FROM sess GROUP BY user_id"),
    "pivot": ("SELECT * FROM (SELECT n_name, c_mktsegment, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey) PIVOT (COUNT(c_acctbal) FOR c_mktsegment IN ('BUILDING' AS building, 'MACHINERY' AS machinery))", "SELECT n_name, count(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, count(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    "unpivot": ("SELECT k, col, v FROM (SELECT l_orderkey * 10 + l_linenumber AS k, l_quantity, l_tax FROM lineitem) UNPIVOT (v FOR col IN (l_quantity AS 'q', l_tax AS 't'))", "SELECT k, 'q' AS col, l_quantity AS v FROM (SELECT l_orderkey * 10 + l_linenumber AS k, l_quantity FROM lineitem) UNION ALL SELECT l_orderkey * 10 + l_linenumber, 't', l_tax FROM lineitem"),
    "unnest_correlated": ("SELECT vec_id, COUNT(*) AS n, ROUND(SUM(x * x), 4) AS s FROM embeddings, UNNEST(embedding) AS x GROUP BY vec_id", "SELECT vec_id, count(*) AS n, round(sum(x::DOUBLE * x), 4) AS s FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id"),
    "unnest_offset": ("SELECT x, o FROM UNNEST([5, 6, 7]) AS x WITH OFFSET AS o", "SELECT unnest([5, 6, 7]) AS x, unnest([0, 1, 2]) AS o"),
    "unnest_structs": ("SELECT k, SUM(v) AS s FROM UNNEST([STRUCT('a' AS k, 1 AS v), ('b', 2), ('a', 3)]) GROUP BY k", "SELECT k, sum(v) AS s FROM (VALUES ('a', 1), ('b', 2), ('a', 3)) t(k, v) GROUP BY k"),
    "pipe_chain": ("FROM orders |> WHERE o_totalprice > 1000 |> EXTEND o_totalprice * 2 AS twice |> AGGREGATE COUNT(*) AS n, ROUND(SUM(twice), 2) AS s GROUP BY o_orderstatus |> RENAME s AS total |> WHERE n > 1 |> ORDER BY n DESC |> LIMIT 5", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice * 2), 2) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC LIMIT 5"),
    "pipe_set_drop_distinct": ("FROM customer |> SELECT c_mktsegment, c_nationkey |> SET c_nationkey = c_nationkey + 1 |> DISTINCT |> DROP c_mktsegment |> DISTINCT |> AS t |> SELECT t.c_nationkey AS k", "SELECT DISTINCT c_nationkey + 1 AS k FROM customer"),
    "pipe_join_union": ("FROM nation |> JOIN region ON n_regionkey = r_regionkey |> SELECT n_name AS x |> UNION ALL (SELECT r_name FROM region) |> EXCEPT DISTINCT (SELECT 'ASIA')", "SELECT * FROM (SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region) EXCEPT SELECT 'ASIA'"),
    "json_pipeline": ("SELECT event_type, COUNT(*) AS n, SUM(CAST(JSON_VALUE(props, '$.k') AS INT64)) AS k FROM events GROUP BY event_type", "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY event_type"),
    "date_functions": (
        "SELECT o_orderkey, EXTRACT(YEAR FROM o_orderdate) AS y, EXTRACT(ISOWEEK FROM o_orderdate) AS w, EXTRACT(DAYOFWEEK FROM o_orderdate) AS dow, DATE_DIFF(DATE '2000-01-01', DATE(o_orderdate), MONTH) AS m, DATE_TRUNC(DATE(o_orderdate), MONTH) AS t, DATE_ADD(DATE(o_orderdate), INTERVAL 1 MONTH) AS a, LAST_DAY(DATE(o_orderdate)) AS l, FORMAT_DATE('%Y-%m', DATE(o_orderdate)) AS f, UNIX_DATE(DATE(o_orderdate)) AS u FROM orders",
        "SELECT o_orderkey, extract(year FROM o_orderdate) AS y, extract(week FROM o_orderdate) AS w, extract(dow FROM o_orderdate) + 1 AS dow, date_diff('month', o_orderdate::DATE, DATE '2000-01-01') AS m, date_trunc('month', o_orderdate)::DATE AS t, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE AS a, last_day(o_orderdate::DATE) AS l, strftime(o_orderdate, '%Y-%m') AS f, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS u FROM orders",
    ),
    "datetime_bucket": ("SELECT DATETIME_BUCKET(ts, INTERVAL 6 HOUR) AS b, COUNT(*) AS n FROM events GROUP BY b", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1950-01-01') AS b, count(*) AS n FROM events GROUP BY 1"),
    "string_functions": (
        "SELECT c_custkey, UPPER(c_name) AS u, LENGTH(c_name) AS l, SUBSTR(c_name, 2, 5) AS s, STRPOS(c_name, '#') AS p, REPLACE(c_mktsegment, 'B', 'b') AS r, LPAD(c_mktsegment, 12, '*') AS lp, REVERSE(c_mktsegment) AS rv, STARTS_WITH(c_mktsegment, 'B') AS sw, CONCAT(c_name, '-', c_mktsegment) AS cc, TRIM(c_mktsegment, 'BG') AS tr, ASCII(c_mktsegment) AS asc_, REPEAT('x', 3) AS rp, TO_HEX(MD5(c_name)) AS h FROM customer",
        "SELECT c_custkey, upper(c_name) AS u, length(c_name) AS l, substr(c_name, 2, 5) AS s, strpos(c_name, '#') AS p, replace(c_mktsegment, 'B', 'b') AS r, lpad(c_mktsegment, 12, '*') AS lp, reverse(c_mktsegment) AS rv, starts_with(c_mktsegment, 'B') AS sw, concat(c_name, '-', c_mktsegment) AS cc, trim(c_mktsegment, 'BG') AS tr, ascii(c_mktsegment) AS asc_, repeat('x', 3) AS rp, md5(c_name) AS h FROM customer",
    ),
    "regexp_functions": ("SELECT c_custkey, REGEXP_CONTAINS(c_name, r'0+1') AS a, REGEXP_EXTRACT(c_name, r'(\\d+)') AS b, REGEXP_REPLACE(c_name, r'\\d', '') AS c FROM customer", "SELECT c_custkey, regexp_matches(c_name, '0+1') AS a, nullif(regexp_extract(c_name, '(\\d+)', 1), '') AS b, regexp_replace(c_name, '\\d', '', 'g') AS c FROM customer"),
    "math_functions": ("SELECT c_custkey, ABS(c_acctbal) AS a, ROUND(SQRT(ABS(c_acctbal)), 8) AS s, FLOOR(c_acctbal) AS f, CEIL(c_acctbal) AS c, MOD(c_custkey, 7) AS m, DIV(c_custkey, 7) AS d, ROUND(LN(c_custkey + 1), 8) AS l, POW(c_custkey, 2) AS p, SIGN(c_acctbal) AS g, GREATEST(c_custkey, 10) AS gr, SAFE_DIVIDE(c_acctbal, c_custkey - 5) AS sd, BIT_COUNT(c_custkey) AS bc FROM customer", "SELECT c_custkey, abs(c_acctbal) AS a, round(sqrt(abs(c_acctbal)), 8) AS s, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, c_custkey % 7 AS m, c_custkey // 7 AS d, round(ln(c_custkey + 1), 8) AS l, pow(c_custkey, 2) AS p, sign(c_acctbal)::DOUBLE AS g, greatest(c_custkey, 10) AS gr, CASE WHEN c_custkey = 5 THEN NULL ELSE c_acctbal / (c_custkey - 5) END AS sd, bit_count(c_custkey) AS bc FROM customer"),
    "conditional_functions": ("SELECT c_custkey, IF(c_acctbal > 0, 'p', 'n') AS a, CASE c_mktsegment WHEN 'BUILDING' THEN 1 ELSE 0 END AS b, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS c, IFNULL(NULL, c_custkey) AS d, c_mktsegment IN ('BUILDING', 'MACHINERY') AS e, c_custkey BETWEEN 3 AND 9 AS f, c_mktsegment IS DISTINCT FROM 'BUILDING' AS g FROM customer", "SELECT c_custkey, if(c_acctbal > 0, 'p', 'n') AS a, CASE c_mktsegment WHEN 'BUILDING' THEN 1 ELSE 0 END AS b, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS c, ifnull(NULL, c_custkey) AS d, c_mktsegment IN ('BUILDING', 'MACHINERY') AS e, c_custkey BETWEEN 3 AND 9 AS f, c_mktsegment IS DISTINCT FROM 'BUILDING' AS g FROM customer"),
    "array_functions": ("SELECT c_custkey, ARRAY_LENGTH(SPLIT(c_name, '#')) AS n, ARRAY_TO_STRING(ARRAY_REVERSE([c_name, c_mktsegment]), '/') AS r, [c_custkey, 2][OFFSET(0)] AS o, ARRAY_SUM(ARRAY_TRANSFORM(GENERATE_ARRAY(1, 4), e -> e * c_custkey)) AS s, ARRAY_LENGTH(ARRAY_FILTER([1, 2, 3], e -> e > MOD(c_custkey, 3))) AS f FROM customer", "SELECT c_custkey, len(string_split(c_name, '#')) AS n, c_mktsegment || '/' || c_name AS r, c_custkey AS o, 10 * c_custkey AS s, CASE c_custkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS f FROM customer"),
    "cast_functions": ("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT64) AS i, CAST(l_orderkey AS STRING) AS s, SAFE_CAST('x' AS INT64) AS n, CAST(l_shipdate AS DATE) AS d FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS i, CAST(l_orderkey AS VARCHAR) AS s, TRY_CAST('x' AS BIGINT) AS n, CAST(l_shipdate AS DATE) AS d FROM lineitem"),
    "vector_distance": ("SELECT a.vec_id AS a, b.vec_id AS b, ROUND(COSINE_DISTANCE(a.embedding, b.embedding), 5) AS c, ROUND(EUCLIDEAN_DISTANCE(a.embedding, b.embedding), 5) AS e FROM embeddings AS a JOIN embeddings AS b ON b.vec_id = a.vec_id + 1", "SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS c, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS e FROM embeddings AS a JOIN embeddings AS b ON b.vec_id = a.vec_id + 1"),
    "text_search": ("SELECT doc_id FROM documents WHERE SEARCH(text, 'the of')", "SELECT doc_id FROM documents WHERE list_has_all(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['the', 'of'])"),
    "term_frequency": ("SELECT doc_id, term, COUNT(*) AS n FROM documents, UNNEST(TEXT_ANALYZE(text)) AS term GROUP BY doc_id, term", "SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}\\p{Nl}\\p{No}]+')) AS term FROM documents) GROUP BY 1, 2"),
    "net_host": ("SELECT page_id, NET.HOST(url) AS h FROM pages", "SELECT page_id, nullif(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '') AS h FROM pages"),
    "conversation_turns": ("SELECT conv_id, STRING_AGG(role, '>' ORDER BY turn) AS roles, MAX(turn) AS last FROM conversations GROUP BY conv_id", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, max(turn) AS last FROM conversations GROUP BY conv_id"),
    "hash_functions": ("SELECT c_custkey, TO_HEX(SHA256(c_name)) AS a, TO_HEX(MD5(c_name)) AS b, TO_BASE64(CAST(c_mktsegment AS BYTES)) AS c, TO_HEX(SHA1(c_name)) AS d FROM customer", "SELECT c_custkey, sha256(c_name) AS a, md5(c_name) AS b, base64(c_mktsegment::BLOB) AS c, sha1(c_name) AS d FROM customer"),
    "geo_distance": ("SELECT c_custkey, ROUND(ST_DISTANCE(ST_GEOGPOINT(MOD(c_custkey, 180), MOD(c_custkey, 80)), ST_GEOGPOINT(10, 50)), 3) AS d FROM customer", "SELECT c_custkey, round(2 * asin(least(1, sqrt(pow(sin(radians(50 - c_custkey % 80) / 2), 2) + cos(radians(c_custkey % 80)) * cos(radians(50)) * pow(sin(radians(10 - c_custkey % 180) / 2), 2)))) * 6371010.0, 3) AS d FROM customer"),
    "array_unnest_zip": ("SELECT l_orderkey, l_linenumber, ARRAY_SUM(ARRAY_ZIP([l_orderkey, l_partkey], [1, 2], (x, y) -> x * y)) AS s FROM lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey + 2 * l_partkey AS s FROM lineitem"),
    "date_arrays": ("SELECT c_custkey, ARRAY_LENGTH(GENERATE_DATE_ARRAY(DATE '2024-01-01', DATE_ADD(DATE '2024-01-01', INTERVAL MOD(c_custkey, 30) DAY), INTERVAL 7 DAY)) AS n FROM customer", "SELECT c_custkey, (c_custkey % 30) // 7 + 1 AS n FROM customer"),
    "week_parts": ("SELECT o_orderkey, DATE_DIFF(DATE(o_orderdate), DATE '1990-01-01', WEEK) AS w, DATE_DIFF(DATE(o_orderdate), DATE '1990-01-01', ISOWEEK) AS i, DATE_TRUNC(DATE(o_orderdate), ISOWEEK) AS t, EXTRACT(DAYOFYEAR FROM o_orderdate) AS y, EXTRACT(QUARTER FROM o_orderdate) AS q FROM orders", "SELECT o_orderkey, floor(date_diff('day', DATE '1970-01-04', o_orderdate::DATE) / 7)::BIGINT - floor(date_diff('day', DATE '1970-01-04', DATE '1990-01-01') / 7)::BIGINT AS w, date_diff('week', DATE '1990-01-01', o_orderdate::DATE) AS i, date_trunc('week', o_orderdate)::DATE AS t, dayofyear(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders"),
    "safe_functions": ("SELECT c_custkey, SAFE_CAST(SUBSTR(c_name, -2) AS INT64) AS a, SAFE_DIVIDE(1, MOD(c_custkey, 3)) AS b, IFERROR(CAST(c_mktsegment AS INT64), -1) AS c, SAFE.SQRT(c_acctbal) IS NULL AS d FROM customer", "SELECT c_custkey, TRY_CAST(right(c_name, 2) AS BIGINT) AS a, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 1.0 / (c_custkey % 3) END AS b, -1 AS c, c_acctbal < 0 AS d FROM customer"),
    "text_tokens": ("SELECT doc_id, ARRAY_LENGTH(TEXT_ANALYZE(text)) AS n, ARRAY_LENGTH(BAG_OF_WORDS(TEXT_ANALYZE(text))) AS d FROM documents", "SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS n, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS d FROM documents"),
    "approx_count_distinct": ("SELECT APPROX_COUNT_DISTINCT(o_orderstatus) AS n FROM orders", "SELECT count(DISTINCT o_orderstatus) AS n FROM orders"),
}


def _runner(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: session(spark, sf_dir).sql(sql)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _runner(v[0]) for k, v in SQL.items()}
ORACLE_SQL: dict[str, str] = {k: v[1] or v[0] for k, v in SQL.items()}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _events(spark, sf_dir).groupBy("event_type", F.date_trunc("day", "ts").alias("d")).agg(F.count("*").alias("n")).filter("n % 3 <> 0")
    return time_series.gap_fill(daily, "d", 86_400_000_000, partition=["event_type"], values=[("n", "locf")])


def range_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _events(spark, sf_dir).select("user_id", F.struct(F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("end")).alias("r"))
    found = time_series.sessionize(spans, "r", ["user_id"])
    return found.select("user_id", F.col("session_range.start").alias("s"), F.col("session_range.end").alias("e")).distinct()


def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).filter("event_id % 2 = 0").select("event_id", "user_id", "ts")
    p = _events(spark, sf_dir).filter("event_id % 2 = 1").groupBy("user_id", F.col("ts").alias("rts")).agg(F.max("event_id").alias("last"))
    return time_series.as_of_join(e, p, on=["user_id"], left_ts="ts", right_ts="rts", values=["last"]).select("event_id", "last")


def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    bands = spark.createDataFrame([(i, i * 10.0, i * 10.0 + 15.0) for i in range(5)], "band int, lo double, hi double")
    return time_series.range_join(parts, bands, point="p_size", start="lo", end="hi", width=10.0).groupBy("band").agg(F.count("*").alias("n"))


def tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.tf_idf(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="item_id", text_col="text")
    return found.withColumn("tf_idf", F.round("tf_idf", 8))


def merge_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MERGE over all orders: those of other states make the target, those of state F the source."""
    s = Session(spark)
    s.register_table("orders", spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return s.sql(
        """
        CREATE TABLE tgt AS SELECT o_custkey AS k, COUNT(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey;
        MERGE tgt T USING (SELECT o_custkey AS k, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) S ON T.k = S.k
        WHEN MATCHED AND S.n > 6 THEN DELETE
        WHEN MATCHED THEN UPDATE SET n = T.n + S.n
        WHEN NOT MATCHED BY TARGET THEN INSERT (k, n) VALUES (k, -n)
        WHEN NOT MATCHED BY SOURCE AND MOD(T.k, 2) = 0 THEN DELETE;
        SELECT k, n FROM tgt
        """
    )


def property_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.sql(
        """
        CREATE PROPERTY GRAPH IF NOT EXISTS trade
        NODE TABLES (customer KEY (c_custkey) LABEL Buyer, orders KEY (o_orderkey) LABEL Purchase, nation KEY (n_nationkey) LABEL Land)
        EDGE TABLES (orders AS placed KEY (o_orderkey) SOURCE KEY (o_custkey) REFERENCES customer (c_custkey) DESTINATION KEY (o_orderkey) REFERENCES orders (o_orderkey),
                     customer AS lives KEY (c_custkey) SOURCE KEY (c_custkey) REFERENCES customer (c_custkey) DESTINATION KEY (c_nationkey) REFERENCES nation (n_nationkey))
        """
    )
    return s.sql("SELECT land, COUNT(*) AS n FROM GRAPH_TABLE(trade MATCH (l:Land)<-[:lives]-(b:Buyer)-[:placed]->(o:Purchase) WHERE o.o_totalprice > 100000 RETURN l.n_name AS land) GROUP BY land")


QUERIES |= {"tf_idf": tf_idf, "gap_fill": gap_fill, "range_sessionize": range_sessions, "as_of_join": as_of_join, "range_join": range_join, "merge": merge_orders, "property_graph": property_graph}
ORACLE_SQL |= {
    "tf_idf": """WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark), c AS (SELECT item_id, term, count(*) AS c FROM w GROUP BY 1, 2),
n AS (SELECT item_id, count(*) AS n FROM w GROUP BY 1), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1)
SELECT c.item_id, c.term, round(c / n * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1), 8) AS tf_idf FROM c JOIN n ON c.item_id = n.item_id JOIN d ON c.term = d.term""",
    "gap_fill": """WITH daily AS (SELECT event_type, date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) % 3 <> 0),
bounds AS (SELECT event_type, min(d) AS lo, max(d) AS hi FROM daily GROUP BY 1), grid AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM bounds)
SELECT g.d::TIMESTAMP AS d, g.event_type, last_value(daily.n IGNORE NULLS) OVER (PARTITION BY g.event_type ORDER BY g.d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM grid g LEFT JOIN daily ON daily.event_type = g.event_type AND daily.d = g.d""",
    "range_sessionize": """WITH r AS (SELECT user_id, ts AS s, ts + INTERVAL 1 HOUR AS e FROM events), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM m) SELECT user_id, min(s) AS s, max(e) AS e FROM i GROUP BY user_id, sid""",
    "as_of_join": """WITH p AS (SELECT user_id, ts AS rts, max(event_id) AS last FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) SELECT e.event_id, p.last FROM (SELECT * FROM events WHERE event_id % 2 = 0) e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.rts""",
    "range_join": "SELECT band, count(*) AS n FROM part JOIN (SELECT i AS band, i * 10 AS lo, i * 10 + 15 AS hi FROM range(5) t(i)) b ON p_size >= lo AND p_size < hi GROUP BY band",
    "merge": """WITH t AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), s AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT coalesce(t.k, s.k) AS k, CASE WHEN t.k IS NULL THEN -s.n WHEN s.k IS NULL THEN t.n ELSE t.n + s.n END AS n FROM t FULL JOIN s ON t.k = s.k WHERE NOT (t.k IS NOT NULL AND s.k IS NOT NULL AND s.n > 6) AND NOT (s.k IS NULL AND t.k % 2 = 0)""",
    "property_graph": "SELECT n_name AS land, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 100000 GROUP BY 1",
}

QUERIES |= {name: _runner(text) for name, (text, _) in function_suite.SQL.items()} | function_suite.RUN
ORACLE_SQL |= {name: oracle or text for name, (text, oracle) in function_suite.SQL.items()} | function_suite.RUN_ORACLE
