"""The registered queries of the engine: dialect SQL over the test tables, and what DuckDB calls the same."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.api import Engine
from quillon.session import shared_dir

TABLES = "region nation customer supplier part orders lineitem events".split()
#: Columns that tell a table's rows apart; lineitem has none.
KEYS = {"orders": ["o_orderkey"], "events": ["event_id"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"]}


def engine(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    out = Engine(spark)
    for t in tables or TABLES:
        out.register(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"), KEYS.get(t))
    return out


FLAGSHIP = """
SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(AVG(l_extendedprice * (1 - l_discount)), 4) AS avg_net
FROM lineitem WHERE l_shipdate >= '1996-01-01' AND l_quantity BETWEEN 5 AND 40
GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 10 ORDER BY 1, 2
"""

#: name: dialect SQL, or (dialect SQL, DuckDB SQL) where the two differ.
QUERIES: dict[str, str | tuple[str, str]] = {
    "flagship": FLAGSHIP,
    # projection and expressions
    "proj_columns": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
    "proj_star": "SELECT * FROM nation",
    "proj_qualified": "SELECT o.o_orderkey, o.o_custkey FROM orders o",
    "proj_alias": "SELECT o_orderkey AS id, o_totalprice AS price FROM orders",
    "proj_arith": "SELECT o_orderkey, ROUND(o_totalprice * 2 + 1, 3) AS a, ROUND(-o_totalprice / 4 - 0.5, 3) AS b FROM orders",
    "proj_concat": "SELECT o_orderkey, o_orderstatus || '-' || o_orderpriority AS tag FROM orders",
    "case_searched": "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders",
    "case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders",
    "case_null": "SELECT event_id, CASE WHEN value > 100 THEN value END AS v FROM events",
    "coalesce": "SELECT event_id, COALESCE(CASE WHEN value > 100 THEN value END, -1.0) AS v FROM events",
    "cast": "SELECT o_orderkey, CAST(o_orderkey AS TEXT) AS t, CAST(o_totalprice AS DOUBLE) AS p FROM orders",
    "try_cast": "SELECT event_id, TRY_CAST(event_type AS DOUBLE) AS v FROM events",
    # predicates
    "filter_eq": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'",
    "filter_ne": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'",
    "filter_range": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 200000",
    "filter_reversed": "SELECT o_orderkey FROM orders WHERE 400000 < o_totalprice",
    "filter_between": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20",
    "filter_not_between": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity NOT BETWEEN 3 AND 48",
    "filter_in": "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "filter_not_in": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (1, 2, 3, 4)",
    "filter_like": "SELECT event_id FROM events WHERE event_type LIKE 'p%'",
    "filter_like_inner": "SELECT event_id FROM events WHERE event_type LIKE '%r_h%'",
    "filter_not_like": "SELECT event_id FROM events WHERE event_type NOT LIKE '%c%'",
    "filter_ilike": "SELECT event_id FROM events WHERE event_type ILIKE 'PUR%'",
    "filter_rlike": ("SELECT event_id, event_type FROM events WHERE event_type RLIKE 'c[kl]|^v'", "SELECT event_id, event_type FROM events WHERE regexp_matches(event_type, 'c[kl]|^v')"),
    "filter_is_null": "SELECT event_id FROM events WHERE (CASE WHEN value > 10 THEN value END) IS NULL",
    "filter_is_not_null": "SELECT event_id FROM events WHERE (CASE WHEN value > 10 THEN value END) IS NOT NULL",
    "filter_and_or": "SELECT event_id FROM events WHERE (event_type = 'click' OR event_type = 'view') AND value > 50 OR user_id = 7",
    "filter_not": "SELECT event_id FROM events WHERE NOT (event_type = 'click' AND value > 5)",
    "filter_xor": ("SELECT event_id FROM events WHERE event_type = 'click' XOR value > 50", "SELECT event_id FROM events WHERE (event_type = 'click') <> (value > 50)"),
    "filter_bool": "SELECT event_id FROM events WHERE CASE WHEN value > 20 THEN TRUE ELSE FALSE END",
    "filter_ts_literal": "SELECT event_id, ts FROM events WHERE ts >= '2024-01-10 00:00:00' AND ts < '2024-01-12'",
    "filter_text_numeric": ("SELECT event_id FROM events WHERE CAST(user_id AS TEXT) > 42", "SELECT event_id FROM events WHERE CAST(user_id AS BIGINT) > 42"),
    "filter_null_3vl": "SELECT event_id FROM events WHERE NOT ((CASE WHEN value > 30 THEN value END) BETWEEN 40 AND 60)",
    "filter_arith": "SELECT o_orderkey FROM orders WHERE o_totalprice / 2 - 10 > 200000",
    # order, limit, distinct
    "sort_multi": "SELECT o_orderstatus, o_totalprice, o_orderkey FROM orders ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey LIMIT 50",
    "sort_expr": "SELECT o_orderkey FROM orders ORDER BY o_totalprice * -1, o_orderkey LIMIT 30",
    "sort_ordinal": "SELECT o_totalprice, o_orderkey FROM orders ORDER BY 1 DESC, 2 LIMIT 30",
    "sort_hidden": "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "sort_alias": "SELECT o_orderkey, o_totalprice AS p FROM orders ORDER BY p DESC, o_orderkey LIMIT 20",
    "sort_nulls_first": "SELECT event_id, CASE WHEN value > 50 THEN value END AS v FROM events ORDER BY CASE WHEN value > 50 THEN value END ASC NULLS FIRST, event_id LIMIT 40",
    "sort_nulls_last": "SELECT event_id, CASE WHEN value > 50 THEN value END AS v FROM events ORDER BY CASE WHEN value > 50 THEN value END DESC NULLS LAST, event_id LIMIT 40",
    "sort_default_nulls": (
        "SELECT event_id, CASE WHEN value > 50 THEN value END AS v FROM events ORDER BY v DESC, event_id LIMIT 40",
        "SELECT event_id, CASE WHEN value > 50 THEN value END AS v FROM events ORDER BY v DESC NULLS FIRST, event_id LIMIT 40",
    ),
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 100",
    "offset_limit": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 700 LIMIT 25", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 700"),
    "offset_only": "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 1000",
    "limit_zero": "SELECT o_orderkey FROM orders LIMIT 0",
    "limit_all": ("SELECT r_regionkey FROM region LIMIT ALL", "SELECT r_regionkey FROM region"),
    "distinct_one": "SELECT DISTINCT event_type FROM events",
    "distinct_many": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
    "distinct_sorted": "SELECT DISTINCT o_orderpriority FROM orders ORDER BY o_orderpriority DESC LIMIT 3",
    # aggregates
    "agg_count_star": "SELECT COUNT(*) AS n FROM lineitem",
    "agg_count_expr": "SELECT COUNT(CASE WHEN value > 40 THEN 1 END) AS n, COUNT(value) AS m FROM events",
    "agg_count_distinct": "SELECT event_type, COUNT(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "agg_basic": "SELECT l_returnflag, ROUND(SUM(l_quantity), 2) AS s, ROUND(AVG(l_extendedprice), 4) AS a, MIN(l_discount) AS lo, MAX(l_tax) AS hi FROM lineitem GROUP BY l_returnflag",
    "agg_min_max_any": "SELECT event_type, MIN(ts) AS first_ts, MAX(ts) AS last_ts, MIN(props) AS p FROM events GROUP BY event_type",
    "agg_variance": (
        "SELECT event_type, ROUND(VARIANCE(value), 3) AS v, ROUND(VAR_POP(value), 3) AS vp, ROUND(VAR_SAMP(value), 3) AS vs, ROUND(STDDEV(value), 4) AS s, ROUND(STDDEV_POP(value), 4) AS sp, ROUND(STDDEV_SAMP(value), 4) AS ss FROM events GROUP BY event_type",
        "SELECT event_type, ROUND(var_pop(value), 3) AS v, ROUND(var_pop(value), 3) AS vp, ROUND(var_samp(value), 3) AS vs, ROUND(stddev_pop(value), 4) AS s, ROUND(stddev_pop(value), 4) AS sp, ROUND(stddev_samp(value), 4) AS ss FROM events GROUP BY event_type",
    ),
    "agg_percentile_cont": "SELECT event_type, ROUND(PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY value), 4) AS p50, ROUND(PERCENTILE_CONT(0.9) WITHIN GROUP (ORDER BY value), 4) AS p90 FROM events GROUP BY event_type",
    "agg_percentile_two_args": (
        "SELECT event_type, ROUND(PERCENTILE_CONT(0.25, value), 4) AS q FROM events GROUP BY event_type",
        "SELECT event_type, ROUND(quantile_cont(value, 0.25), 4) AS q FROM events GROUP BY event_type",
    ),
    "agg_quantile_lower": (
        "SELECT event_type, APPROX_QUANTILE(value, 0.3) AS q FROM events GROUP BY event_type",
        "SELECT event_type, list_sort(list(value))[CAST(floor((count(value) - 1) * 0.3) AS BIGINT) + 1] AS q FROM events GROUP BY event_type",
    ),
    "agg_filter": "SELECT event_type, COUNT(*) FILTER (WHERE value > 50) AS n, ROUND(SUM(value) FILTER (WHERE user_id < 20), 2) AS s FROM events GROUP BY event_type",
    "agg_if": (
        "SELECT event_type, ROUND(sumIf(value, user_id < 20), 2) AS s, ROUND(avgIf(value, value > 50), 4) AS a, countIf(value > 80) AS n FROM events GROUP BY event_type",
        "SELECT event_type, ROUND(sum(value) FILTER (WHERE user_id < 20), 2) AS s, ROUND(avg(value) FILTER (WHERE value > 50), 4) AS a, count(*) FILTER (WHERE value > 80) AS n FROM events GROUP BY event_type",
    ),
    "agg_expr_over_agg": "SELECT event_type, COUNT(*) - COUNT(CASE WHEN value > 30 THEN 1 END) AS d, ROUND(AVG(value) / 2, 3) AS h FROM events GROUP BY event_type",
    "agg_case_over_agg": "SELECT event_type, CASE WHEN COUNT(*) > 100 THEN 'many' ELSE 'few' END AS size FROM events GROUP BY event_type",
    "agg_scalar_inside": "SELECT l_returnflag, ROUND(AVG(ABS(l_discount - 0.05)), 6) AS a, ROUND(SUM(POWER(l_quantity, 2)), 1) AS p FROM lineitem GROUP BY l_returnflag",
    "agg_null_arith": "SELECT ROUND(SUM(value + CASE WHEN user_id > 10 THEN 1.0 END), 2) AS s FROM events",
    "agg_empty_input": "SELECT COUNT(*) AS n, SUM(value) AS s, MAX(ts) AS t FROM events WHERE value < -1",
    "agg_text_number": ("SELECT ROUND(SUM(CAST(user_id AS TEXT)), 1) AS s FROM events", "SELECT ROUND(CAST(SUM(user_id) AS DOUBLE), 1) AS s FROM events"),
    "agg_sum_distinct": "SELECT SUM(DISTINCT l_quantity) AS s FROM lineitem",
    # groups
    "group_cols": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority",
    "group_expr": "SELECT o_custkey % 10 AS b, COUNT(*) AS n FROM orders GROUP BY o_custkey % 10",
    "group_case": "SELECT CASE WHEN value > 50 THEN 'hi' ELSE 'lo' END AS band, COUNT(*) AS n FROM events GROUP BY CASE WHEN value > 50 THEN 'hi' ELSE 'lo' END",
    "group_ordinal": "SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1",
    "group_alias": "SELECT user_id % 5 AS b, COUNT(*) AS n FROM events GROUP BY b",
    "group_null_key": "SELECT CASE WHEN value > 50 THEN event_type END AS k, COUNT(*) AS n FROM events GROUP BY 1",
    "group_only": "SELECT o_orderstatus FROM orders GROUP BY o_orderstatus",
    "rollup": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)",
    "cube": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "mixed_rollup": "SELECT l_linenumber, l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY l_linenumber, ROLLUP(l_returnflag)",
    "rollup_agg_key": "SELECT l_linenumber, SUM(l_quantity) AS q, MAX(l_linenumber) AS m FROM lineitem GROUP BY ROLLUP(l_linenumber)",
    "having": "SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id HAVING COUNT(*) > 10 AND AVG(value) > 20",
    "qualify_agg_alias": ("SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id QUALIFY n > 12", "SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id HAVING COUNT(*) > 12"),
    "distinct_agg": "SELECT DISTINCT COUNT(*) AS n FROM events GROUP BY user_id",
    "group_top": "SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id ORDER BY COUNT(*) DESC, user_id LIMIT 10",
    # windows
    "win_row_number": "SELECT event_id, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events",
    "win_rank": "SELECT event_id, RANK() OVER (PARTITION BY event_type ORDER BY user_id) AS r FROM events",
    "win_dense_rank": "SELECT event_id, DENSE_RANK() OVER (PARTITION BY event_type ORDER BY user_id DESC) AS r FROM events",
    "win_sum_running": (
        "SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts), 2) AS s FROM events",
        "SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS s FROM events",
    ),
    "win_sum_rows": "SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM events",
    "win_sum_range": "SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY event_type ORDER BY user_id RANGE BETWEEN 3 PRECEDING AND CURRENT ROW), 2) AS s FROM events",
    "win_avg_count": "SELECT event_id, ROUND(AVG(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS a, COUNT(*) OVER (PARTITION BY event_type) AS n FROM events",
    "win_lag": "SELECT event_id, LAG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events",
    "win_lead": "SELECT event_id, LEAD(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events",
    "win_lag_default": "SELECT event_id, LAG(value, 1, 0.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events",
    "win_lead_text_default": (
        "SELECT event_id, LEAD(user_id, 2, 'missing') OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events",
        "SELECT event_id, LEAD(CAST(user_id AS VARCHAR), 2, 'missing') OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events",
    ),
    "win_first_value": "SELECT event_id, FIRST_VALUE(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS f FROM events",
    "win_last_value": (
        "SELECT event_id, LAST_VALUE(value) OVER (PARTITION BY user_id ORDER BY ts) AS f FROM events",
        "SELECT event_id, LAST_VALUE(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS f FROM events",
    ),
    "win_qualify": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) <= 5",
    "win_qualify_alias": "SELECT o_orderkey, RANK() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS r FROM orders QUALIFY r <= 3",
    "win_multi_partition": "SELECT event_id, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS a, RANK() OVER (PARTITION BY user_id ORDER BY value) AS b FROM events",
    "win_over_agg": "SELECT user_id, COUNT(*) AS n, RANK() OVER (ORDER BY COUNT(*) DESC) AS r FROM events GROUP BY user_id",
    "win_filtered": "SELECT event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events WHERE value > 20 AND event_type <> 'view'",
    # scalar functions
    "fn_abs": "SELECT event_id, ABS(value - 100) AS v FROM events",
    "fn_round": "SELECT l_orderkey, l_partkey, ROUND(l_extendedprice * l_discount, 2) AS r, ROUND(l_extendedprice * l_discount) AS z FROM lineitem",
    "fn_ceil_floor": "SELECT event_id, CEIL(value) AS c, CEILING(value) AS cc, FLOOR(value) AS f FROM events",
    "fn_exp": "SELECT event_id, ROUND(EXP(value / 100), 6) AS e FROM events",
    "fn_ln": "SELECT event_id, ROUND(LN(value + 1), 9) AS l FROM events",
    "fn_log10": "SELECT event_id, ROUND(LOG(value + 1), 9) AS l FROM events",
    "fn_log_base": "SELECT event_id, ROUND(LOG(2, value + 1), 9) AS l FROM events",
    "fn_power": "SELECT event_id, ROUND(POWER(value, 2), 4) AS p FROM events",
    "fn_width_bucket": (
        "SELECT l_orderkey, l_quantity, WIDTH_BUCKET(l_quantity, 1, 50, 7) AS b FROM lineitem",
        "SELECT l_orderkey, l_quantity, CASE WHEN l_quantity < 1 THEN 0 WHEN l_quantity > 50 THEN 8 WHEN l_quantity = 50 THEN 7 ELSE CAST(floor((l_quantity - 1) / (50 - 1) * 7) AS BIGINT) + 1 END AS b FROM lineitem",
    ),
    "fn_div_zero": "SELECT event_id, value / 0.0 AS inf, (value - value) / (value - value) AS nan, 7.0 / NULL AS n FROM events",
    "fn_modulo": "SELECT o_orderkey, o_orderkey % 7 AS m, -o_orderkey % 5 AS n FROM orders",
    # time
    "ts_time_bucket": "SELECT TIME_BUCKET(INTERVAL '1 hour', ts) AS b, COUNT(*) AS n, ROUND(SUM(value), 2) AS s FROM events GROUP BY TIME_BUCKET(INTERVAL '1 hour', ts)",
    "ts_time_bucket_text": ("SELECT TIME_BUCKET('15 minutes', ts) AS b, COUNT(*) AS n FROM events GROUP BY 1", "SELECT TIME_BUCKET(INTERVAL '15 minutes', ts) AS b, COUNT(*) AS n FROM events GROUP BY 1"),
    "ts_time_bucket_seconds": ("SELECT TIME_BUCKET(90, ts) AS b, COUNT(*) AS n FROM events GROUP BY 1", "SELECT TIME_BUCKET(INTERVAL '90 seconds', ts, TIMESTAMP '1970-01-01') AS b, COUNT(*) AS n FROM events GROUP BY 1"),
    "ts_time_bucket_week": ("SELECT TIME_BUCKET('7 days', ts) AS b, COUNT(*) AS n FROM events GROUP BY 1", "SELECT TIME_BUCKET(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS b, COUNT(*) AS n FROM events GROUP BY 1"),
    "ts_time_bucket_origin": "SELECT TIME_BUCKET(INTERVAL '5 hours', ts, TIMESTAMP '2024-01-01 00:30:00') AS b, COUNT(*) AS n FROM events GROUP BY 1",
    "ts_numeric_bucket": ("SELECT TIME_BUCKET(25, user_id) AS b, COUNT(*) AS n FROM events GROUP BY 1", "SELECT floor(user_id / 25.0) * 25.0 AS b, COUNT(*) AS n FROM events GROUP BY 1"),
    "ts_trunc_second": "SELECT event_id, DATE_TRUNC('second', ts) AS t FROM events",
    "ts_trunc_minute": "SELECT DATE_TRUNC('minute', ts) AS t, COUNT(*) AS n FROM events GROUP BY 1",
    "ts_trunc_hour": "SELECT DATE_TRUNC('hour', ts) AS t, COUNT(*) AS n FROM events GROUP BY DATE_TRUNC('hour', ts) HAVING COUNT(*) > 1",
    "ts_trunc_day": "SELECT DATE_TRUNC('day', ts) AS t, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2",
    "ts_trunc_week": "SELECT DATE_TRUNC('week', ts) AS t, COUNT(*) AS n FROM events GROUP BY 1 ORDER BY 1",
    "ts_bucket_window": (
        "SELECT TIME_BUCKET('1 day', ts) AS b, COUNT(*) AS n, SUM(COUNT(*)) OVER (ORDER BY TIME_BUCKET('1 day', ts)) AS total FROM events GROUP BY 1",
        "SELECT TIME_BUCKET(INTERVAL '1 day', ts) AS b, COUNT(*) AS n, CAST(SUM(COUNT(*)) OVER (ORDER BY TIME_BUCKET(INTERVAL '1 day', ts)) AS BIGINT) AS total FROM events GROUP BY 1",
    ),
    # what has rules of its own
    "agg_percentile_desc": "SELECT event_type, ROUND(PERCENTILE_CONT(0.3) WITHIN GROUP (ORDER BY value DESC), 4) AS p FROM events GROUP BY event_type",
    "filter_like_escape": "SELECT o_orderkey FROM orders WHERE o_orderstatus || '%' || o_orderpriority LIKE 'F!%2%' ESCAPE '!'",
    "filter_not_rlike_null": (
        "SELECT event_id FROM events WHERE CASE WHEN event_type = 'view' THEN NULL ELSE event_type END NOT RLIKE '^c'",
        "SELECT event_id FROM events WHERE NOT regexp_matches(CASE WHEN event_type = 'view' THEN NULL ELSE event_type END, '^c')",
    ),
    "filter_bad_pattern": ("SELECT event_id FROM events WHERE event_type RLIKE '[' OR event_id < 5", "SELECT event_id FROM events WHERE event_id < 5"),
    "expr_convert": ("SELECT o_orderkey, CONVERT(o_custkey, TEXT) AS c, TRY_CONVERT(o_orderpriority, BIGINT) AS n FROM orders", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS c, TRY_CAST(o_orderpriority AS BIGINT) AS n FROM orders"),
    "expr_now": ("SELECT event_id, NOW() > ts AS past, CURRENT_TIMESTAMP >= ts AS too FROM events", "SELECT event_id, CAST(now() AS TIMESTAMP) > ts AS past, CAST(now() AS TIMESTAMP) >= ts AS too FROM events"),
    "filter_now_literal": ("SELECT event_id FROM events WHERE ts < 'now'", "SELECT event_id FROM events WHERE ts < CAST(now() AS TIMESTAMP)"),
    "win_range_interval": "SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '1 hour' PRECEDING AND CURRENT ROW), 4) AS s FROM events",
    "win_range_seconds": (
        "SELECT event_id, COUNT(*) OVER (PARTITION BY event_type ORDER BY ts DESC RANGE BETWEEN 7200 PRECEDING AND 600 FOLLOWING) AS n FROM events",
        "SELECT event_id, COUNT(*) OVER (PARTITION BY event_type ORDER BY ts DESC RANGE BETWEEN INTERVAL '7200 seconds' PRECEDING AND INTERVAL '600 seconds' FOLLOWING) AS n FROM events",
    ),
    "ts_micros_bucket": (
        "SELECT TIME_BUCKET('1 hour', 1700000000000000 + event_id * 1000000000) AS b, COUNT(*) AS n FROM events GROUP BY 1",
        "SELECT floor((1700000000000000 + event_id * 1000000000) / 3600000000.0) * 3600000000.0 AS b, COUNT(*) AS n FROM events GROUP BY 1",
    ),
    # the benchmark shapes
    "b1_point": "SELECT * FROM orders WHERE o_orderkey = 77",
    "b2_range": "SELECT * FROM orders WHERE o_orderkey BETWEEN 500 AND 1499",
    "b3_prefix": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority LIKE '1%' ORDER BY o_orderkey LIMIT 100",
    "b4_equals_limit": "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' ORDER BY event_id LIMIT 1000",
    "b6_count_filtered": "SELECT COUNT(*) AS n FROM events WHERE event_type = 'click'",
    "b7_first_page": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100",
    "b8_deep_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 7000",
    "b10_conjunction": "SELECT event_id, value FROM events WHERE event_type = 'purchase' AND event_id BETWEEN 100 AND 5000",
}


def _run(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    table = sql.split(" FROM ", 1)[1].split()[0] if " FROM " in sql else sql.split("FROM ", 1)[1].split()[0]
    return lambda spark, sf_dir: engine(spark, sf_dir, table).query(sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(FLAGSHIP)(spark, sf_dir)


#: Tables that statements change a copy of: columns, and sort key (none for bare).
COPIES = {
    "nation": ("n_nationkey BIGINT, n_name TEXT, n_regionkey BIGINT", " ORDER BY n_nationkey"),
    "orders": ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus TEXT, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority TEXT", " ORDER BY o_orderkey"),
    "events": ("event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type TEXT, value DOUBLE, props TEXT", " ORDER BY ts, event_id"),
    "region": ("r_regionkey BIGINT, r_name TEXT", ""),
}
_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
#: Source, statements that change a copy t of it, a SELECT over t, and a SELECT over the source that gives the same.
DML: dict[str, tuple[str, list[str], str, str]] = {
    "dml_insert": ("nation", ["INSERT INTO t VALUES (100, 'ATLANTIS', 3), (101, NULL, -1)"], "SELECT * FROM t", _NATION + " UNION ALL SELECT * FROM (VALUES (100, 'ATLANTIS', 3), (101, NULL, -1)) v"),
    "dml_insert_default": (
        "nation",
        ["INSERT INTO t (n_nationkey) VALUES (200)", "INSERT INTO t VALUES (201, DEFAULT, 5)"],
        "SELECT * FROM t",
        _NATION + " UNION ALL SELECT * FROM (VALUES (200, NULL, NULL), (201, NULL, 5)) v",
    ),
    "dml_update": ("nation", ["UPDATE t SET n_name = 'X' WHERE n_regionkey = 2"], "SELECT * FROM t", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'X' ELSE n_name END AS n_name, n_regionkey FROM nation"),
    "dml_update_sort_key": (
        "nation",
        ["UPDATE t SET n_nationkey = 999 WHERE n_nationkey = 3"],
        "SELECT * FROM t",
        "SELECT CASE WHEN n_nationkey = 3 THEN 999 ELSE n_nationkey END AS n_nationkey, n_name, n_regionkey FROM nation",
    ),
    "dml_update_expr": ("nation", ["UPDATE t SET n_regionkey = n_regionkey * 10 + 1"], "SELECT * FROM t", "SELECT n_nationkey, n_name, n_regionkey * 10 + 1 AS n_regionkey FROM nation"),
    "dml_delete": ("nation", ["DELETE FROM t WHERE n_regionkey IN (1, 3) OR n_name LIKE 'A%'"], "SELECT * FROM t", _NATION + " WHERE NOT (n_regionkey IN (1, 3) OR n_name LIKE 'A%')"),
    "dml_lifecycle": (
        "nation",
        ["INSERT INTO t VALUES (50, 'NEW', 1)", "UPDATE t SET n_name = 'NEWER' WHERE n_nationkey = 50", "DELETE FROM t WHERE n_nationkey < 20"],
        "SELECT * FROM t",
        _NATION + " WHERE n_nationkey >= 20 UNION ALL SELECT 50, 'NEWER', 1",
    ),
    # b11 and b12 of the benchmark, and reads by the sort key
    "dml_orders_update": (
        "orders",
        ["UPDATE t SET o_orderstatus = 'Z', o_totalprice = o_totalprice + 1 WHERE o_orderkey BETWEEN 500 AND 1499"],
        "SELECT * FROM t",
        "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey BETWEEN 500 AND 1499 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, "
        "CASE WHEN o_orderkey BETWEEN 500 AND 1499 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders",
    ),
    "dml_orders_delete": ("orders", ["DELETE FROM t WHERE o_orderkey BETWEEN 1000 AND 1099 AND o_orderstatus <> 'P'"], "SELECT * FROM t", "SELECT * FROM orders WHERE NOT (o_orderkey BETWEEN 1000 AND 1099 AND o_orderstatus <> 'P')"),
    "dml_orders_point": ("orders", [], "SELECT * FROM t WHERE o_orderkey = 77", "SELECT * FROM orders WHERE o_orderkey = 77"),
    "dml_events_update": (
        "events",
        ["UPDATE t SET value = value * 2 WHERE event_type = 'purchase' AND ts >= '2024-01-15'", "INSERT INTO t VALUES (-1, '2024-03-01 10:00:00', 7, 'view', 1.5, NULL)"],
        "SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 3) AS s, MAX(ts) AS last FROM t GROUP BY event_type",
        "SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 3) AS s, MAX(ts) AS last FROM (SELECT event_type, ts, CASE WHEN event_type = 'purchase' AND ts >= '2024-01-15' THEN value * 2 ELSE value END AS value "
        "FROM events UNION ALL SELECT 'view', TIMESTAMP '2024-03-01 10:00:00', 1.5) x GROUP BY event_type",
    ),
    "dml_events_delete": ("events", ["DELETE FROM t WHERE ts < '2024-01-10' OR user_id IN (1, 2, 3)"], "SELECT event_id, user_id FROM t", "SELECT event_id, user_id FROM events WHERE NOT (ts < '2024-01-10' OR user_id IN (1, 2, 3))"),
    "ddl_without_order": (
        "region",
        ["INSERT INTO t VALUES (9, 'NOWHERE')", "UPDATE t SET r_name = 'SOUTH' WHERE r_regionkey = 1", "DELETE FROM t WHERE r_regionkey = 2"],
        "SELECT * FROM t",
        "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'SOUTH' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 9, 'NOWHERE'",
    ),
}


def copy_of(spark: SparkSession, sf_dir: str, source: str) -> Engine:
    """An engine over a new catalog folder with t, a copy of a table; the folder goes when the driver ends."""
    e = Engine(spark, f"{shared_dir(spark)}/quillon-catalog/{uuid.uuid4().hex}")
    atexit.register(_remove, e)
    columns, order = COPIES[source]
    e.execute(f"CREATE TABLE t ({columns}){order}")
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    e.catalog.append("t", rows.select(*[F.col(f.name).cast(f.dataType) for f in e.catalog.schema("t").fields]))
    return e


def _remove(e: Engine) -> None:
    try:
        e.catalog.files.delete(e.catalog.root)
    except Exception:  # the session is gone already; the folder's own retention clears the rest
        return


def _run_dml(source: str, statements: list[str], select: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = copy_of(spark, sf_dir, source)
        for s in statements:
            e.execute(s)
        return e.query(select)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _run(q if isinstance(q, str) else q[0]) for name, q in QUERIES.items()}
    return out | {name: _run_dml(*q[:3]) for name, q in DML.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: q if isinstance(q, str) else q[1] for name, q in QUERIES.items()}
    wide = {"nation": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM ({}) s", "region": "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM ({}) s"}
    return out | {name: wide.get(source, "{}").format(q) for name, (source, _, _, q) in DML.items()}
