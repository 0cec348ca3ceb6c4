"""Queries of the dialect by name, with the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.context import StreamContext
from windrose.functions import DelimiterConverter
from windrose.shared import remove, scratch
from windrose.sinks import KeyValueSink, ParquetSink, ParquetStore
from windrose.sources import replay

STREAMS = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}
TABLES = ("region", "nation", "customer", "supplier", "part")


def context(spark: SparkSession, d: str, **kw) -> StreamContext:
    ctx = StreamContext(spark, **kw)
    for name, ts in STREAMS.items():
        ctx.register_stream(spark.read.parquet(f"{d}/{name}.parquet"), name, ts)
    for name in TABLES:
        ctx.register_table(spark.read.parquet(f"{d}/{name}.parquet"), name)
    return ctx


FLAGSHIP = "SELECT event_type, COUNT(*) AS c, SUM(event_id) AS ids FROM events OVER (WINDOW '180' MINUTES, SLIDE '60' MINUTES) AS t GROUP BY event_type"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return context(spark, d).sql(FLAGSHIP)


def _win(table: str, ts: str, width: int, slide: int, name: str) -> str:
    n = -(-width // slide)
    # Starts are multiples of the slide.
    return f"""{name} AS (SELECT *, ws + INTERVAL {width} MINUTE AS we FROM (
        SELECT t.*, time_bucket(INTERVAL {slide} MINUTE, {ts}, TIMESTAMP '1970-01-01') - i * INTERVAL {slide} MINUTE AS ws FROM {table} t, range({n}) r(i)) q
        WHERE {ts} < ws + INTERVAL {width} MINUTE)"""


E180, E180T = "events OVER (WINDOW '180' MINUTES, SLIDE '60' MINUTES)", _win("events", "ts", 180, 60, "h")
BOUNDS = "ws AS window_start, we AS window_end"

#: name: (dialect text, DuckDB's SQL)
PLAIN: dict[str, tuple[str, str | None]] = {
    # projection, filter, expressions
    "proj_filter": ("SELECT event_id AS id, user_id u, value * 2 AS v2 FROM events AS e WHERE e.value > 50 AND NOT (event_type = 'view')", "SELECT event_id AS id, user_id AS u, value * 2 AS v2 FROM events WHERE value > 50 AND NOT (event_type = 'view')"),
    "select_star": ("SELECT e.*, 1 AS one FROM events e", "SELECT e.*, 1 AS one FROM events e"),
    "predicates_all": (
        "SELECT event_id FROM events WHERE (value BETWEEN 10 AND 90) AND value NOT BETWEEN 40 AND 45 AND event_type IN ('view', 'click', 'error') AND event_type NOT IN ('error') AND event_type LIKE '%i%' AND event_type NOT LIKE 'x%' AND event_type RLIKE '^[vc]' AND event_type REGEXP 'i' AND props IS NOT NULL AND NOT (ts IS NULL) AND user_id <=> user_id AND user_id >= 1 AND user_id != 3 AND user_id <> 4",
        "SELECT event_id FROM events WHERE value BETWEEN 10 AND 90 AND value NOT BETWEEN 40 AND 45 AND event_type IN ('view', 'click') AND event_type LIKE '%i%' AND regexp_matches(event_type, '^[vc]') AND props IS NOT NULL AND ts IS NOT NULL AND user_id >= 1 AND user_id NOT IN (3, 4)"),
    "case_cast": (
        "SELECT event_id, CASE WHEN value > 66 THEN 'high' WHEN value > 33 THEN 'mid' ELSE 'low' END AS band, CASE event_type WHEN 'view' THEN 1 ELSE 0 END AS is_view, CAST(value AS INT) AS whole, CAST(user_id AS STRING) AS who FROM events",
        "SELECT event_id, CASE WHEN value > 66 THEN 'high' WHEN value > 33 THEN 'mid' ELSE 'low' END AS band, CASE event_type WHEN 'view' THEN 1 ELSE 0 END AS is_view, CAST(trunc(value) AS INT) AS whole, CAST(user_id AS VARCHAR) AS who FROM events"),
    "arithmetic_bitwise": ("SELECT event_id, -event_id AS neg, +user_id AS pos, ~user_id AS inv, event_id % 10 AS m, (event_id & 6) AS a, (event_id | 1) AS o, (event_id ^ 3) AS x, value / 4 AS q FROM events", "SELECT event_id, -event_id AS neg, user_id AS pos, ~user_id AS inv, event_id % 10 AS m, event_id & 6 AS a, event_id | 1 AS o, xor(event_id, 3) AS x, value / 4 AS q FROM events"),
    "struct_array_access": ("SELECT event_id, array(user_id, event_id)[1] AS second, named_struct('a', user_id, 'b', event_type).b AS b, map('k', event_type)['k'] AS k FROM events", "SELECT event_id, event_id AS second, event_type AS b, event_type AS k FROM events"),
    "intervals": ("SELECT event_id, ts + INTERVAL 1 MONTH 2 DAYS 3 HOURS AS later, ts - INTERVAL '30' MINUTES AS before FROM events", "SELECT event_id, ts + INTERVAL 1 MONTH + INTERVAL 2 DAY + INTERVAL 3 HOUR AS later, ts - INTERVAL 30 MINUTE AS before FROM events"),
    "having_no_group": ("SELECT event_type AS t, value * 2 AS v FROM events HAVING v > 150 AND t = 'click'", "SELECT event_type AS t, value * 2 AS v FROM events WHERE value * 2 > 150 AND event_type = 'click'"),
    "select_distinct": ("SELECT DISTINCT event_type, user_id FROM events", "SELECT DISTINCT event_type, user_id FROM events"),
    "group_having": ("SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 HAVING count(*) > 10"),
    "cte": ("WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000), n AS (SELECT o_custkey, COUNT(*) AS c FROM big GROUP BY o_custkey) SELECT c, COUNT(*) AS customers FROM n GROUP BY c", "WITH n AS (SELECT o_custkey, count(*) AS c FROM orders WHERE o_totalprice > 100000 GROUP BY 1) SELECT c, count(*) AS customers FROM n GROUP BY c"),
    "derived": ("SELECT s.u, s.v FROM (SELECT user_id AS u, value AS v FROM events WHERE value > 20) AS s WHERE s.v < 60", "SELECT user_id AS u, value AS v FROM events WHERE value > 20 AND value < 60"),
    "order_limit": ("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20"),
    "sort_by": ("SELECT event_id, user_id FROM events SORT BY user_id DESC", "SELECT event_id, user_id FROM events"),
    "grouping_sets": ("SELECT event_type, user_id, COUNT(*) AS n FROM events GROUP BY event_type, user_id WITH ROLLUP", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ROLLUP(event_type, user_id)"),
    # set operations
    "union_all": ("SELECT user_id FROM events WHERE value > 90 UNION ALL SELECT c_custkey FROM customer", "SELECT user_id FROM events WHERE value > 90 UNION ALL SELECT c_custkey FROM customer"),
    "union_distinct": ("SELECT user_id FROM events UNION SELECT c_custkey FROM customer", "SELECT user_id FROM events UNION SELECT c_custkey FROM customer"),
    "intersect": ("SELECT user_id FROM events INTERSECT SELECT c_custkey FROM customer", "SELECT user_id FROM events INTERSECT SELECT c_custkey FROM customer"),
    "except_": ("SELECT user_id FROM events EXCEPT SELECT r_regionkey FROM region", "SELECT user_id FROM events EXCEPT SELECT r_regionkey FROM region"),
    "setops_left_to_right": ("SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region INTERSECT SELECT s_nationkey FROM supplier", "SELECT * FROM (SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region) INTERSECT SELECT s_nationkey FROM supplier"),
    "branch_limits": ("SELECT event_id FROM events ORDER BY event_id LIMIT 3 UNION ALL SELECT event_id FROM events ORDER BY event_id DESC LIMIT 2", "(SELECT event_id FROM events ORDER BY event_id LIMIT 3) UNION ALL (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 2)"),
    # joins
    "join_inner": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT OUTER JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 200000", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000"),
    "join_right": ("SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey"),
    "join_full": ("SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL OUTER JOIN customer c ON s.s_suppkey = c.c_custkey", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey"),
    "join_semi": ("SELECT c.c_custkey FROM customer c LEFT SEMI JOIN orders o ON o.o_custkey = c.c_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "join_theta": ("SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey < n.n_nationkey", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey"),
    "join_comma": ("SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o, customer c, nation n WHERE o.o_custkey = c.c_custkey AND c.c_nationkey = n.n_nationkey", "SELECT o_orderkey, c_name, n_name FROM orders, customer, nation WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey"),
    "self_join": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    # aggregates over windows
    "tumbling_count": ("SELECT event_type, COUNT(*) AS c FROM events OVER (WINDOW '60' MINUTES) AS t GROUP BY event_type", f"WITH {_win('events', 'ts', 60, 60, 'h')} SELECT {BOUNDS}, event_type, count(*) AS c FROM h GROUP BY ALL"),
    "sliding_count": (f"SELECT event_type, COUNT(*) AS c, COUNT(value) AS cv FROM {E180} t GROUP BY event_type", f"WITH {E180T} SELECT {BOUNDS}, event_type, count(*) AS c, count(value) AS cv FROM h GROUP BY ALL"),
    "sliding_sum": (f"SELECT event_type, SUM(user_id) AS s, ROUND(SUM(value), 4) AS sv FROM {E180} t GROUP BY event_type", f"WITH {E180T} SELECT {BOUNDS}, event_type, CAST(sum(user_id) AS BIGINT) AS s, round(sum(value), 4) AS sv FROM h GROUP BY ALL"),
    "sliding_avg": (f"SELECT user_id, AVG(user_id) AS m FROM {E180} t GROUP BY user_id", f"WITH {E180T} SELECT {BOUNDS}, user_id, avg(user_id) AS m FROM h GROUP BY ALL"),
    "sliding_min_max": (f"SELECT event_type, MIN(value) AS lo, MAX(value) AS hi, MIN(props) AS p FROM {E180} t GROUP BY event_type", f"WITH {E180T} SELECT {BOUNDS}, event_type, min(value) AS lo, max(value) AS hi, min(props) AS p FROM h GROUP BY ALL"),
    "sliding_count_distinct": (f"SELECT event_type, COUNT(DISTINCT user_id) AS u, COUNT(DISTINCT user_id, value) AS uv FROM {E180} t GROUP BY event_type", f"WITH {E180T} SELECT {BOUNDS}, event_type, count(DISTINCT user_id) AS u, count(DISTINCT CASE WHEN user_id IS NOT NULL AND value IS NOT NULL THEN (user_id, value) END) AS uv FROM h GROUP BY ALL"),
    "sliding_sum_distinct": (f"SELECT event_type, SUM(DISTINCT user_id) AS s FROM {E180} t GROUP BY event_type", f"WITH {E180T} SELECT {BOUNDS}, event_type, CAST(sum(DISTINCT user_id) AS BIGINT) AS s FROM h GROUP BY ALL"),
    "sliding_global": (f"SELECT COUNT(*) AS c, MAX(value) AS hi FROM {E180} t", f"WITH {E180T} SELECT {BOUNDS}, count(*) AS c, max(value) AS hi FROM h GROUP BY ALL"),
    "sliding_group_expr": (f"SELECT user_id % 3 AS g, COUNT(*) AS c FROM {E180} t GROUP BY user_id % 3", f"WITH {E180T} SELECT {BOUNDS}, user_id % 3 AS g, count(*) AS c FROM h GROUP BY ALL"),
    "sliding_where": (f"SELECT event_type, COUNT(*) AS c FROM {E180} t WHERE t.value > 50 GROUP BY event_type", f"WITH {E180T} SELECT {BOUNDS}, event_type, count(*) AS c FROM h WHERE value > 50 GROUP BY ALL"),
    "window_unaligned": ("SELECT event_type, COUNT(*) AS c FROM events OVER (WINDOW '540' MINUTES, SLIDE '360' MINUTES) t GROUP BY event_type", f"WITH {_win('events', 'ts', 540, 360, 'h')} SELECT {BOUNDS}, event_type, count(*) AS c FROM h GROUP BY ALL"),
    "window_long": ("SELECT event_type, COUNT(*) AS c, MIN(value) AS lo FROM events OVER (WINDOW '1440' MINUTES, SLIDE '60' MINUTES) t GROUP BY event_type", f"WITH {_win('events', 'ts', 1440, 60, 'h')} SELECT {BOUNDS}, event_type, count(*) AS c, min(value) AS lo FROM h GROUP BY ALL"),
    "window_sampled": ("SELECT event_type, COUNT(*) AS c FROM events OVER (WINDOW '60' MINUTES, SLIDE '180' MINUTES) t GROUP BY event_type", f"WITH {_win('events', 'ts', 180, 180, 'k')}, h AS (SELECT * EXCLUDE (ws), we - INTERVAL 60 MINUTE AS ws FROM k WHERE ts >= we - INTERVAL 60 MINUTE) SELECT {BOUNDS}, event_type, count(*) AS c FROM h GROUP BY ALL"),
    "window_avg_where": (f"SELECT event_type, ROUND(AVG(value), 6) AS m, COUNT(*) AS c FROM {E180} t WHERE value < 80 GROUP BY event_type", f"WITH {E180T} SELECT {BOUNDS}, event_type, round(avg(value), 6) AS m, count(*) AS c FROM h WHERE value < 80 GROUP BY ALL"),
    "window_plain": (f"SELECT event_id, value FROM {E180} t WHERE value > 95", f"WITH {E180T} SELECT {BOUNDS}, event_id, value FROM h WHERE value > 95"),
    "window_subquery": ("SELECT u, COUNT(*) AS c FROM (SELECT user_id AS u, ts FROM events WHERE value > 30) OVER (WINDOW '120' MINUTES) AS s GROUP BY u", f"WITH {_win('events', 'ts', 120, 120, 'h')} SELECT {BOUNDS}, user_id AS u, count(*) AS c FROM h WHERE value > 30 GROUP BY ALL"),
    "window_having": (f"SELECT user_id, COUNT(*) AS c FROM {E180} t GROUP BY user_id HAVING COUNT(*) > 1", f"WITH {E180T} SELECT {BOUNDS}, user_id, count(*) AS c FROM h GROUP BY ALL HAVING count(*) > 1"),
    "window_distinct": (f"SELECT DISTINCT event_type FROM {E180} t", f"WITH {E180T} SELECT DISTINCT {BOUNDS}, event_type FROM h"),
    "window_nested_agg": (f"SELECT MAX(s.c) AS most, COUNT(*) AS kinds FROM (SELECT event_type, COUNT(*) AS c FROM {E180} t GROUP BY event_type) AS s", f"WITH {E180T}, g AS (SELECT ws, we, event_type, count(*) AS c FROM h GROUP BY ALL) SELECT {BOUNDS}, max(c) AS most, count(*) AS kinds FROM g GROUP BY ALL"),
    "window_topk": (f"SELECT event_id, value FROM {E180} t ORDER BY value DESC, event_id LIMIT 2", f"WITH {E180T} SELECT {BOUNDS}, event_id, value FROM h QUALIFY row_number() OVER (PARTITION BY we ORDER BY value DESC, event_id) <= 2"),
    "window_topk_agg": (f"SELECT event_type, COUNT(*) AS c FROM {E180} t GROUP BY event_type ORDER BY c DESC, event_type LIMIT 1", f"WITH {E180T}, g AS (SELECT ws, we, event_type, count(*) AS c FROM h GROUP BY ALL) SELECT {BOUNDS}, event_type, c FROM g QUALIFY row_number() OVER (PARTITION BY we ORDER BY c DESC, event_type) <= 1"),
    "window_union": (f"SELECT user_id FROM {E180} a WHERE value > 80 UNION SELECT user_id FROM {E180} b WHERE value < 20", f"WITH {E180T} SELECT DISTINCT {BOUNDS}, user_id FROM h WHERE value > 80 OR value < 20"),
    "window_union_all": (f"SELECT user_id FROM {E180} a WHERE value > 80 UNION ALL SELECT user_id FROM {E180} b WHERE value > 90", f"WITH {E180T} SELECT {BOUNDS}, user_id FROM h WHERE value > 80 UNION ALL SELECT {BOUNDS}, user_id FROM h WHERE value > 90"),
    "window_intersect": (f"SELECT user_id FROM {E180} a WHERE value > 50 INTERSECT SELECT user_id FROM {E180} b WHERE value < 50", f"WITH {E180T} SELECT {BOUNDS}, user_id FROM h WHERE value > 50 INTERSECT SELECT {BOUNDS}, user_id FROM h WHERE value < 50"),
    "window_except": (f"SELECT user_id FROM {E180} a WHERE value > 50 EXCEPT SELECT user_id FROM {E180} b WHERE value < 50", f"WITH {E180T} SELECT {BOUNDS}, user_id FROM h WHERE value > 50 EXCEPT SELECT {BOUNDS}, user_id FROM h WHERE value < 50"),
    "window_rank": (f"SELECT event_id, RANK() OVER (PARTITION BY event_type ORDER BY value) AS r FROM {E180} t", f"WITH {E180T} SELECT {BOUNDS}, event_id, CAST(rank() OVER (PARTITION BY we, event_type ORDER BY value) AS INT) AS r FROM h"),
    "window_rollup": (f"SELECT event_type, user_id, COUNT(*) AS c FROM {E180} t GROUP BY event_type, user_id WITH ROLLUP", f"WITH {E180T} SELECT {BOUNDS}, event_type, user_id, count(*) AS c FROM h GROUP BY ws, we, ROLLUP(event_type, user_id)"),
    # other aggregates
    "approx_distinct": (f"SELECT event_type, APPROXIMATE COUNT(DISTINCT user_id) AS u FROM {E180} t GROUP BY event_type", None),
    "approx_distinct_rsd": (f"SELECT event_type, APPROXIMATE(0.01) COUNT(DISTINCT user_id) AS u FROM {E180} t GROUP BY event_type", None),
    "approx_distinct_bound": (f"SELECT event_type, ABS((APPROXIMATE COUNT(DISTINCT user_id)) - COUNT(DISTINCT user_id)) <= 1 + 0.15 * COUNT(DISTINCT user_id) AS near FROM {E180} t GROUP BY event_type", f"WITH {E180T} SELECT DISTINCT {BOUNDS}, event_type, true AS near FROM h"),
    "approx_distinct_rsd_bound": (f"SELECT event_type, ABS((APPROXIMATE(0.01) COUNT(DISTINCT user_id)) - COUNT(DISTINCT user_id)) <= 1 + 0.03 * COUNT(DISTINCT user_id) AS near FROM {E180} t GROUP BY event_type", f"WITH {E180T} SELECT DISTINCT {BOUNDS}, event_type, true AS near FROM h"),
    "percentile": (f"SELECT event_type, ROUND(percentile(value, 0.5), 6) AS p FROM {E180} t GROUP BY event_type", f"WITH {E180T} SELECT {BOUNDS}, event_type, round(quantile_cont(value, 0.5), 6) AS p FROM h GROUP BY ALL"),
    "stddev": (f"SELECT event_type, ROUND(stddev_pop(value), 4) AS sd FROM {E180} t GROUP BY event_type", f"WITH {E180T} SELECT {BOUNDS}, event_type, round(stddev_pop(value), 4) AS sd FROM h GROUP BY ALL"),
    # functions
    "scalar_string": ("SELECT event_id, upper(event_type) AS u, substr(event_type, 1, 2) AS s, concat(event_type, '-', CAST(user_id AS STRING)) AS c, length(props) AS n, trim('  x ') AS t FROM events", "SELECT event_id, upper(event_type) AS u, substr(event_type, 1, 2) AS s, concat(event_type, '-', CAST(user_id AS VARCHAR)) AS c, CAST(length(props) AS INT) AS n, trim('  x ') AS t FROM events"),
    "scalar_date": ("SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h FROM events", "SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS m, CAST(day(ts) AS INT) AS d, CAST(hour(ts) AS INT) AS h FROM events"),
    "scalar_math": ("SELECT event_id, abs(value - 50) AS a, floor(value) AS f, round(sqrt(value), 6) AS r, coalesce(NULLIF(user_id, 1), -1) AS c FROM events", "SELECT event_id, abs(value - 50) AS a, CAST(floor(value) AS BIGINT) AS f, round(sqrt(value), 6) AS r, coalesce(nullif(user_id, 1), -1) AS c FROM events"),
    "json_props": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"),
    "udtf_explode": ("SELECT e.event_id, w FROM events e LATERAL VIEW explode(array(e.event_type, 'all')) x AS w", "SELECT event_id, unnest([event_type, 'all']) AS w FROM events"),
    "udtf_explode_window": (f"SELECT w, COUNT(*) AS c FROM {E180} e LATERAL VIEW explode(array(e.event_type, 'all')) x AS w GROUP BY w", f"WITH {E180T}, x AS (SELECT ws, we, unnest([event_type, 'all']) AS w FROM h) SELECT {BOUNDS}, w, count(*) AS c FROM x GROUP BY ALL"),
    "no_from": ("SELECT 1 AS one, 'a' AS a", "SELECT 1 AS one, 'a' AS a"),
}

_O, _L = _win("orders", "o_orderdate", 2880, 1440, "o"), _win("lineitem", "l_shipdate", 2880, 1440, "l")
OW, LW = "orders OVER (WINDOW '2880' MINUTES, SLIDE '1440' MINUTES) AS o", "lineitem OVER (WINDOW '2880' MINUTES, SLIDE '1440' MINUTES) AS l"
_JOIN = "o.we = l.we AND o.o_orderkey = l.l_orderkey"
_BOTH = "coalesce(o.ws, l.ws) AS window_start, coalesce(o.we, l.we) AS window_end"
PLAIN |= {
    f"window_join_{k}": (f"SELECT o.o_orderkey, l.l_linenumber FROM {OW} {word} JOIN {LW} ON o.o_orderkey = l.l_orderkey", f"WITH {_O}, {_L} SELECT {_BOTH}, o_orderkey, l_linenumber FROM o {word} JOIN l ON {_JOIN}")
    for k, word in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL"))
}
PLAIN |= {
    "window_join_semi": (f"SELECT o.o_orderkey FROM {OW} LEFT SEMI JOIN {LW} ON o.o_orderkey = l.l_orderkey", f"WITH {_O}, {_L} SELECT ws AS window_start, we AS window_end, o_orderkey FROM o WHERE EXISTS (SELECT 1 FROM l WHERE {_JOIN})"),
    "window_join_agg": (f"SELECT o.o_orderpriority, COUNT(*) AS n FROM {OW} JOIN {LW} ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderpriority", f"WITH {_O}, {_L} SELECT o.ws AS window_start, o.we AS window_end, o_orderpriority, count(*) AS n FROM o JOIN l ON {_JOIN} GROUP BY ALL"),
    "window_join_static_agg": (f"SELECT c.c_mktsegment, COUNT(*) AS n, ROUND(SUM(l.l_extendedprice), 2) AS total FROM {OW} JOIN {LW} ON o.o_orderkey = l.l_orderkey JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment", f"WITH {_O}, {_L} SELECT o.ws AS window_start, o.we AS window_end, c_mktsegment, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM o JOIN l ON {_JOIN} JOIN customer ON o_custkey = c_custkey GROUP BY ALL"),
    "window_join_widths": ("SELECT o.o_orderkey, l.l_linenumber FROM orders OVER (WINDOW '2880' MINUTES, SLIDE '1440' MINUTES) o JOIN lineitem OVER (WINDOW '4320' MINUTES, SLIDE '1440' MINUTES) l ON o.o_orderkey = l.l_orderkey", f"WITH {_O}, {_win('lineitem', 'l_shipdate', 4320, 1440, 'l')} SELECT o.we AS window_end, o_orderkey, l_linenumber FROM o JOIN l ON {_JOIN}"),
    "window_static_join": (f"SELECT c.c_mktsegment, COUNT(*) AS n FROM {OW} JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment", f"WITH {_O} SELECT ws AS window_start, we AS window_end, c_mktsegment, count(*) AS n FROM o JOIN customer ON o_custkey = c_custkey GROUP BY ALL"),
    "three_way_star": (f"SELECT * FROM {OW} JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 400000", f"WITH {_O} SELECT ws AS window_start, we AS window_end, o.* EXCLUDE (ws, we), c.*, n.* FROM o JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey WHERE o_totalprice > 400000"),
}


def _text(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: context(spark, d).sql(PLAIN[name][0])


def udf_scalar(spark: SparkSession, d: str) -> DataFrame:
    ctx = context(spark, d)

    @F.pandas_udf("double")
    def twice(x: pd.Series) -> pd.Series:
        return x * 2

    ctx.udf.register("twice", twice)
    return ctx.sql("SELECT event_id, twice(value) AS v FROM events")


def delimiter_parse(spark: SparkSession, d: str) -> DataFrame:
    """Rows to messages and back through the delimiter converter."""
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", "user_id")
    c = DelimiterConverter("|")
    return events.select(c.to_message(events).alias("value")).select(*c.to_row(F.col("value"), events.schema))


def _streamed(text: str, **kw) -> Callable[[SparkSession, str], DataFrame]:
    """The answer over events as streams (two, events and again) of five batches, closed by a row past all windows.

    Tables are bounded; so is the stream of orders.
    """

    def run(spark: SparkSession, d: str) -> DataFrame:
        e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
        last = e.limit(1).withColumn("ts", F.lit("2100-01-01 00:00:00").cast("timestamp")).withColumn("event_type", F.lit("__last"))
        folders, out, state = [scratch(spark, "replay") for _ in range(1 + ("again" in text))], scratch(spark, "out"), scratch(spark, "query")
        ctx = context(spark, d, **kw)
        for name, folder in zip(("events", "again"), folders):
            ctx.register_stream(replay(spark, e, folder, 5, "ts", last), name, "ts")
        q = ctx.sql(text).start(ParquetSink(out), trigger={"availableNow": True}, checkpoint=state)
        q.awaitTermination()
        remove(spark, *folders, state)
        got = spark.read.parquet(out).drop("batch")
        return got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end") if c in got.columns}).filter("window_end < TIMESTAMP_NTZ '2090-01-01'")

    return run


def insert_into_sink(spark: SparkSession, d: str) -> DataFrame:
    ctx = context(spark, d)
    path = scratch(spark, "sink")
    ctx.register_sink("target", ParquetSink(path))
    ctx.sql("INSERT INTO TABLE target SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type")
    return spark.read.parquet(path).drop("batch")


def insert_overwrite_table(spark: SparkSession, d: str) -> DataFrame:
    ctx = context(spark, d)
    name = f"t_{uuid.uuid4().hex}"
    path = scratch(spark, "table")
    spark.sql(f"CREATE TABLE {name} (kind STRING, n STRING) USING parquet LOCATION '{path}'")
    for _ in range(2):  # the second run replaces the first
        ctx.sql(f"INSERT OVERWRITE TABLE {name} SELECT event_type, COUNT(*) FROM events GROUP BY event_type")
    out = spark.read.parquet(path)
    spark.sql(f"DROP TABLE {name}")
    return out


def kv_sink(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "kv")
    got = context(spark, d).sql("SELECT event_type, COUNT(*) AS n FROM events OVER (WINDOW '60' MINUTES) t GROUP BY event_type")
    KeyValueSink("q1", ParquetStore(path), 60).write(got, 0)
    return spark.read.parquet(path).drop("batch")


def ddl_source(spark: SparkSession, d: str) -> DataFrame:
    ctx = StreamContext(spark)
    ctx.command(f"CREATE TEMPORARY TABLE ddl_events USING parquet OPTIONS (path '{d}/events.parquet', ts 'ts'); SET spark.sql.ansi.enabled = true")
    return ctx.sql("SELECT event_type, COUNT(*) AS c FROM ddl_events OVER (WINDOW '60' MINUTES) t GROUP BY event_type")


def json_stream(spark: SparkSession, d: str) -> DataFrame:
    """JSON texts to rows; the schema comes from a sample."""
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type")
    path = scratch(spark, "json")
    events.limit(50).write.json(path)
    texts = events.select(F.to_json(F.struct("*")).alias("value"))
    return StreamContext(spark).json_stream(texts, path)


_STREAM_TEXTS = {
    "stream_replay_sliding": f"SELECT event_type, COUNT(*) AS c, MAX(value) AS hi FROM {E180} t GROUP BY event_type",
    "stream_replay_topk": f"SELECT event_id, value FROM {E180} t ORDER BY value DESC, event_id LIMIT 2",
    "stream_replay_distinct": f"SELECT event_type, COUNT(DISTINCT user_id) AS u FROM {E180} t GROUP BY event_type",
    "stream_replay_sum_distinct": f"SELECT event_type, SUM(DISTINCT user_id) AS s, COUNT(*) AS c, COUNT(DISTINCT user_id) AS u FROM {E180} t GROUP BY event_type",
    "stream_replay_static_topk": f"SELECT t.event_id, o.o_orderkey FROM {E180} t JOIN orders o ON t.user_id = o.o_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey, t.event_id LIMIT 2",
    "stream_replay_batch_slide": "SELECT event_type, COUNT(*) AS c FROM events OVER (WINDOW '180' MINUTES) t GROUP BY event_type",
    "stream_replay_unwindowed_topk": "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN again b ON a.user_id = b.user_id ORDER BY a.event_id, b.event_id LIMIT 3",
    "stream_replay_join": "SELECT a.event_id AS a, b.event_id AS b FROM events OVER (WINDOW '60' MINUTES) AS a JOIN events OVER (WINDOW '60' MINUTES) AS b ON a.user_id = b.user_id WHERE a.event_id < b.event_id",
}
_H60 = _win("events", "ts", 60, 60, "h")
_STREAM_CONTEXT = {"stream_replay_batch_slide": {"batch_interval": "60 minutes", "default_slide": "batch"}, "stream_replay_unwindowed_topk": {"batch_interval": "60 minutes"}}
_STREAM_SQL = {
    "stream_replay_sliding": f"WITH {E180T} SELECT {BOUNDS}, event_type, count(*) AS c, max(value) AS hi FROM h GROUP BY ALL",
    "stream_replay_topk": PLAIN["window_topk"][1],
    "stream_replay_distinct": f"WITH {E180T} SELECT {BOUNDS}, event_type, count(DISTINCT user_id) AS u FROM h GROUP BY ALL",
    "stream_replay_sum_distinct": f"WITH {E180T} SELECT {BOUNDS}, event_type, CAST(sum(DISTINCT user_id) AS BIGINT) AS s, count(*) AS c, count(DISTINCT user_id) AS u FROM h GROUP BY ALL",
    "stream_replay_static_topk": f"WITH {E180T} SELECT {BOUNDS}, event_id, o_orderkey FROM h JOIN orders ON user_id = o_custkey QUALIFY row_number() OVER (PARTITION BY we ORDER BY o_totalprice DESC, o_orderkey, event_id) <= 2",
    "stream_replay_batch_slide": f"WITH {E180T} SELECT {BOUNDS}, event_type, count(*) AS c FROM h GROUP BY ALL",
    "stream_replay_unwindowed_topk": f"WITH {_H60} SELECT a.ws AS window_start, a.we AS window_end, a.event_id AS a, b.event_id AS b FROM h a JOIN h b ON a.we = b.we AND a.user_id = b.user_id QUALIFY row_number() OVER (PARTITION BY a.we ORDER BY a.event_id, b.event_id) <= 3",
    "stream_replay_join": f"WITH {_H60} SELECT a.ws AS window_start, a.we AS window_end, a.event_id AS a, b.event_id AS b FROM h a JOIN h b ON a.we = b.we AND a.user_id = b.user_id WHERE a.event_id < b.event_id",
}
_MORE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "udf_scalar": (udf_scalar, "SELECT event_id, value * 2 AS v FROM events"),
    "delimiter_parse": (delimiter_parse, "SELECT event_id, event_type, user_id FROM events"),
    "json_stream": (json_stream, "SELECT event_id, event_type FROM events"),
    "insert_into_sink": (insert_into_sink, "SELECT event_type, count(*) AS n FROM events GROUP BY 1"),
    "insert_overwrite_table": (insert_overwrite_table, "SELECT event_type AS kind, CAST(count(*) AS VARCHAR) AS n FROM events GROUP BY 1"),
    "kv_sink": (kv_sink, f"WITH {_H60} SELECT 'q1.' || CAST(CAST(epoch(we) AS BIGINT) AS VARCHAR) AS key, event_type AS field, CAST(count(*) AS VARCHAR) AS value, 60 AS ttl_seconds FROM h GROUP BY we, event_type"),
    "ddl_source": (ddl_source, PLAIN["tumbling_count"][1]),
} | {k: (_streamed(t, **_STREAM_CONTEXT.get(k, {})), _STREAM_SQL[k]) for k, t in _STREAM_TEXTS.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"flagship": flagship} | {k: _text(k) for k in PLAIN} | {k: f for k, (f, _) in _MORE.items()}


def oracle_sql() -> dict[str, str]:
    flag = f"WITH {E180T} SELECT {BOUNDS}, event_type, count(*) AS c, CAST(sum(event_id) AS BIGINT) AS ids FROM h GROUP BY ALL"
    return {"flagship": flag} | {k: sql for k, (_, sql) in PLAIN.items() if sql} | {k: sql for k, (_, sql) in _MORE.items()}
