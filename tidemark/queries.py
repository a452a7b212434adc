"""Registered queries of the engine and their DuckDB SQL.

Each query is a script of the dialect over registered tables; its last statement
gives the result. Doubles are rounded on both sides, as window sums differ in
the last bit between engines."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.engine import TIME, Engine
from tidemark.streaming.stateful import live_script, read_stream, run_live, stream_view

DIGITS = 4
#: Added before rounding, so that exact halves do not fall apart by a last bit.
NUDGE = 3e-6
#: Total order of lineitem, which has no key.
LINE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


KINDS = ("click", "view", "purchase")
EVENT = ["event_id", "user_id", "value", "event_type"]
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]


def engine(spark: SparkSession, sf_dir: str, sql: str, **options) -> Engine:
    """An engine with those of the driver's tables that a script names, as
    streams and keyed tables; the others' files are not even listed."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    named = set(re.findall(r"\w+", sql))
    e = Engine(spark, **options)
    if named & {"events", *KINDS}:
        events = read("events")
        e.register("events", events, "ts", ["event_id"], EVENT)
        for kind in KINDS:
            e.register(kind, events.filter(F.col("event_type") == kind), "ts", ["event_id"], EVENT[:3])
    if "lineitem" in named:
        e.register("lineitem", read("lineitem"), "l_shipdate", LINE_ORDER[1:], LINE)
    if "orders" in named:
        e.register("orders", read("orders"), "o_orderdate", ["o_orderkey"], ["o_orderkey", "o_custkey", "o_totalprice"])
    if "customer" in named:
        e.register_table("customer", read("customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey")
    if "nation" in named:
        e.register_table("nation", read("nation").select("n_nationkey", "n_regionkey"), "n_nationkey")
    if "member" in named:
        e.register_table("member", read("customer").filter("c_custkey % 3 <> 0").select("c_custkey", "c_acctbal"), "c_custkey")
    return e


def rounded(df: DataFrame) -> DataFrame:
    """Without the time, doubles rounded, without negative zeros."""
    out = []
    for f in df.schema.fields:
        if f.name == TIME:
            continue
        c = F.col(f"`{f.name}`")
        out.append((F.round(c + F.lit(NUDGE), DIGITS) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else c)
    return df.select(*out)


def add(name: str, sql: str, oracle: str, **options) -> None:
    """Registers a script and its DuckDB SQL; options are the engine's."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(engine(spark, sf_dir, sql, **options).script(sql)[-1])

    QUERIES[name] = run
    ORACLE_SQL[name] = oracle


def _x(x: str) -> str:
    return f"round({x} + {NUDGE}, {DIGITS}) + 0.0"


def _r(x: str, name: str) -> str:
    return f"{_x(x)} AS {name}"


E = "PARTITION BY user_id ORDER BY ts, event_id"
G = "ORDER BY ts, event_id"


def every(select: str) -> str:
    """All rows a view emits; a read of a keyed view would give the latest."""
    return f"CREATE MATERIALIZED VIEW q AS {select}; CREATE VIEW every AS SELECT * FROM q; SELECT * FROM every"


# projection and scalars
add("select_project", every("SELECT event_id, value FROM events"), f"SELECT event_id, {_r('value', 'value')} FROM events")
add("select_star", every("SELECT * FROM events"), f"SELECT event_id, user_id, {_r('value', 'value')}, event_type FROM events")
add("scalar_arith", every("SELECT event_id, value * 2 + 1 AS a, value - user_id AS b, value / 4 AS c, -value AS d, value % 7 AS m FROM events"),
    f"SELECT event_id, {_r('value * 2 + 1', 'a')}, {_r('value - user_id', 'b')}, {_r('value / 4', 'c')}, {_r('-value', 'd')}, {_r('value::DOUBLE % 7', 'm')} FROM events")
add("const_select", every("SELECT event_id, 42 AS answer, 1.5 + 1 AS two_and_half FROM events"), "SELECT event_id, 42.0::DOUBLE AS answer, 2.5::DOUBLE AS two_and_half FROM events")
add("math_all", every("SELECT event_id, ABS(value) AS f_abs, FLOOR(value) AS f_floor, CEIL(value) AS f_ceil, ROUND(value) AS f_round, SIGN(value) AS f_sign, SQRT(ABS(value)) AS f_sqrt, EXP(value / 1000) AS f_exp, SIN(value) AS f_sin, COS(value) AS f_cos, TAN(value / 1000) AS f_tan, POWER(value, 2) AS f_pow FROM events"),
    f"SELECT event_id, {_r('abs(value)', 'f_abs')}, floor(value)::DOUBLE + 0.0 AS f_floor, ceil(value)::DOUBLE + 0.0 AS f_ceil, round(value)::DOUBLE + 0.0 AS f_round, sign(value)::DOUBLE AS f_sign, {_r('sqrt(abs(value))', 'f_sqrt')}, {_r('exp(value / 1000)', 'f_exp')}, {_r('sin(value)', 'f_sin')}, {_r('cos(value)', 'f_cos')}, {_r('tan(value / 1000)', 'f_tan')}, {_r('pow(value, 2)', 'f_pow')} FROM events")
add("log_guards", every("SELECT event_id, LN(FLOOR(value) - 10) AS a, LOG10(FLOOR(value) - 10) AS b, LOG2(FLOOR(value) - 10) AS c FROM events"),
    "SELECT event_id, " + ", ".join(f"CASE WHEN floor(value) - 10 > 0 THEN {_x(f'{f}(floor(value) - 10)')} WHEN floor(value) - 10 = 0 THEN '-infinity'::DOUBLE ELSE 'nan'::DOUBLE END AS {n}" for f, n in (("ln", "a"), ("log10", "b"), ("log2", "c"))) + " FROM events")
add("div_by_zero_guard", every("SELECT event_id, value / (user_id - FLOOR(user_id / 2) * 2) AS q FROM events"),
    f"SELECT event_id, CASE WHEN user_id % 2 <> 0 THEN {_x('value')} WHEN value > 0 THEN 'infinity'::DOUBLE WHEN value < 0 THEN '-infinity'::DOUBLE ELSE 'nan'::DOUBLE END AS q FROM events")
add("case_tiers", every("SELECT event_id, CASE WHEN value > 100 THEN 3 WHEN value > 50 THEN 2 ELSE 1 END AS tier, CASE user_id WHEN 1 THEN 10 WHEN 2 THEN 20 ELSE 0 END AS pick FROM events"),
    "SELECT event_id, CASE WHEN value > 100 THEN 3.0 WHEN value > 50 THEN 2.0 ELSE 1.0 END::DOUBLE AS tier, CASE user_id WHEN 1 THEN 10.0 WHEN 2 THEN 20.0 ELSE 0.0 END::DOUBLE AS pick FROM events")
add("case_no_else", every("SELECT event_id, CASE WHEN value > 50 THEN value END AS high FROM events"), f"SELECT event_id, {_r('value', 'high')} FROM events WHERE value > 50")
add("alias_chain", every("SELECT event_id, value * 2 AS dbl, dbl + 1 AS inc, inc / 2 AS half FROM events WHERE inc > 20"),
    f"SELECT event_id, {_r('value * 2', 'dbl')}, {_r('value * 2 + 1', 'inc')}, {_r('(value * 2 + 1) / 2', 'half')} FROM events WHERE value * 2 + 1 > 20")

# predicates
add("where_cmp", every("SELECT event_id, value FROM events WHERE value > 50"), f"SELECT event_id, {_r('value', 'value')} FROM events WHERE value > 50")
add("where_and_or_not", every("SELECT event_id, value FROM events WHERE (value > 80 OR user_id = 3) AND NOT (value > 120)"),
    f"SELECT event_id, {_r('value', 'value')} FROM events WHERE (value > 80 OR user_id = 3) AND NOT (value > 120)")
add("where_between", every("SELECT event_id, value FROM events WHERE value BETWEEN 20 AND 60 AND user_id NOT IN (1, 2)"),
    f"SELECT event_id, {_r('value', 'value')} FROM events WHERE value BETWEEN 20 AND 60 AND user_id NOT IN (1, 2)")
add("where_columns", every("SELECT event_id, value FROM events WHERE value > user_id"), f"SELECT event_id, {_r('value', 'value')} FROM events WHERE value > user_id")
add("where_alias", every("SELECT event_id, value * value AS sq FROM events WHERE sq > 2500"), f"SELECT event_id, {_r('value * value', 'sq')} FROM events WHERE value * value > 2500")
add("intrusion_rules", every("SELECT event_id, CASE WHEN value > 150 AND user_id < 5 THEN 2 WHEN value > 100 THEN 1 ELSE 0 END AS alert FROM events WHERE alert > 0"),
    "SELECT * FROM (SELECT event_id, CASE WHEN value > 150 AND user_id < 5 THEN 2.0 WHEN value > 100 THEN 1.0 ELSE 0.0 END::DOUBLE AS alert FROM events) WHERE alert > 0")
add("where_window", every("SELECT event_id, value FROM events WHERE value > MOVING_AVERAGE(value, 10)"),
    f"SELECT event_id, {_r('value', 'value')} FROM (SELECT *, avg(value) OVER w AS m, count(*) OVER w AS c FROM events WINDOW w AS ({G} ROWS 9 PRECEDING)) WHERE c = 10 AND value > m")

add("is_null_and_cast", every("SELECT event_id, CAST(FLOOR(value) AS BIGINT) AS whole, CASE WHEN value IS NULL THEN 0 ELSE 1 END AS there FROM events WHERE value IS NOT NULL AND 1 < 2"),
    "SELECT event_id, floor(value)::BIGINT AS whole, 1.0::DOUBLE AS there FROM events WHERE value IS NOT NULL")
add("logical_all", every("SELECT event_id, CASE WHEN XOR(value > 50, user_id < 70) THEN 1 ELSE 0 END AS x, CASE WHEN NOR(value > 50, user_id < 70) THEN 1 ELSE 0 END AS n, CASE WHEN IMPLIES(value > 50, user_id < 70) THEN 1 ELSE 0 END AS i, CASE WHEN NAND(value > 50, user_id < 70) THEN 1 ELSE 0 END AS a FROM events"),
    "SELECT event_id, ((value > 50) <> (user_id < 70))::INT::DOUBLE AS x, (NOT (value > 50 OR user_id < 70))::INT::DOUBLE AS n, (NOT (value > 50) OR user_id < 70)::INT::DOUBLE AS i, (NOT (value > 50 AND user_id < 70))::INT::DOUBLE AS a FROM events")
add("log_and_ceiling", every("SELECT event_id, LOG(value + 1000) AS l, CEILING(value) AS c, SQRT(value - 50) AS s FROM events"),
    f"SELECT event_id, {_r('ln(value + 1000)', 'l')}, ceil(value)::DOUBLE + 0.0 AS c, CASE WHEN value >= 50 THEN {_x('sqrt(greatest(value - 50, 0))')} ELSE 'nan'::DOUBLE END AS s FROM events")

# running aggregates
RUN = f"OVER ({E} ROWS UNBOUNDED PRECEDING)"
add("cum_sum", every("SELECT user_id, event_id, SUM(value) AS total FROM events GROUP BY user_id"), f"SELECT user_id, event_id, {_r(f'sum(value) {RUN}', 'total')} FROM events")
add("cum_count", every("SELECT user_id, event_id, COUNT(*) AS n FROM events GROUP BY user_id"), f"SELECT user_id, event_id, (count(*) {RUN})::DOUBLE AS n FROM events")
add("cum_avg", every("SELECT user_id, event_id, AVG(value) AS mean, MIN(value) AS low, MAX(value) AS high FROM events GROUP BY user_id"),
    f"SELECT user_id, event_id, {_r(f'avg(value) {RUN}', 'mean')}, {_r(f'min(value) {RUN}', 'low')}, {_r(f'max(value) {RUN}', 'high')} FROM events")
L = f"PARTITION BY l_suppkey ORDER BY {', '.join(LINE_ORDER)} ROWS UNBOUNDED PRECEDING"
add("vwap", every("SELECT l_suppkey, l_orderkey, l_linenumber, SUM(l_extendedprice * l_quantity) / SUM(l_quantity) AS vwap FROM lineitem GROUP BY l_suppkey"),
    f"SELECT l_suppkey, l_orderkey, l_linenumber, {_r('sum(l_extendedprice * l_quantity) OVER w / sum(l_quantity) OVER w', 'vwap')} FROM lineitem WINDOW w AS ({L})")
add("keyed_running_sum", every("SELECT l_suppkey, l_orderkey, l_linenumber, SUM(l_quantity) AS quantity FROM lineitem GROUP BY l_suppkey"),
    f"SELECT l_suppkey, l_orderkey, l_linenumber, {_r('sum(l_quantity) OVER w', 'quantity')} FROM lineitem WINDOW w AS ({L})")
add("cum_composite_key", every("SELECT user_id, event_type, event_id, SUM(value) AS total FROM events GROUP BY user_id, event_type"),
    f"SELECT user_id, event_type, event_id, {_r('sum(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)', 'total')} FROM events")
add("passthrough_latest", "CREATE MATERIALIZED VIEW q AS SELECT user_id, event_id, value, COUNT(*) AS n FROM events GROUP BY user_id; SELECT * FROM q",
    f"SELECT user_id, event_id, {_r('value', 'value')}, n FROM (SELECT *, (count(*) OVER (PARTITION BY user_id))::DOUBLE AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
add("ungrouped_running", every("SELECT event_id, SUM(value) AS total, COUNT(*) AS n FROM events"),
    f"SELECT event_id, {_r(f'sum(value) OVER ({G} ROWS UNBOUNDED PRECEDING)', 'total')}, (count(*) OVER ({G} ROWS UNBOUNDED PRECEDING))::DOUBLE AS n FROM events")


add("ungrouped_ranges", every("SELECT event_id, SUM(value) AS total, COUNT(*) AS n, AVG(value) AS mean, MIN(value) AS lo, MAX(value) AS hi FROM events"),
    f"SELECT event_id, {_r('sum(value) OVER w', 'total')}, (count(*) OVER w)::DOUBLE AS n, {_r('avg(value) OVER w', 'mean')}, {_r('min(value) OVER w', 'lo')}, {_r('max(value) OVER w', 'hi')} FROM events WINDOW w AS ({G} ROWS UNBOUNDED PRECEDING)", block_rows=300)
add("group_by_expression", every("SELECT FLOOR(user_id / 10) AS g, event_id, SUM(value) AS total FROM events GROUP BY FLOOR(user_id / 10)"),
    f"SELECT floor(user_id / 10)::DOUBLE AS g, event_id, {_r('sum(value) OVER (PARTITION BY floor(user_id / 10) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)', 'total')} FROM events")


# moving windows
def moving(name: str, call: str, sql: str, n: int) -> None:
    add(name, every(f"SELECT user_id, event_id, {call} AS m FROM events GROUP BY user_id"),
        f"SELECT user_id, event_id, {_r('m', 'm')} FROM (SELECT user_id, event_id, ({sql} OVER w)::DOUBLE AS m, count(*) OVER w AS c FROM events WINDOW w AS ({E} ROWS {n - 1} PRECEDING)) WHERE c = {n}")


moving("mov_avg", "MOVING_AVERAGE(value, 10)", "avg(value)", 10)
moving("mov_sum", "MOVING_SUM(value, 5)", "sum(value)", 5)
moving("mov_std", "MOVING_STD(value, 8)", "stddev_samp(value)", 8)
moving("mov_min", "MOVING_MIN(value, 6)", "min(value)", 6)
moving("mov_max", "MOVING_MAX(value, 6)", "max(value)", 6)
moving("mov_count", "MOVING_COUNT(4)", "count(*)", 4)
add("mov_large", every("SELECT event_id, MOVING_SUM(value, 600) AS s, MOVING_AVERAGE(value, 600) AS a FROM events"),
    f"SELECT event_id, {_r('s', 's')}, {_r('a', 'a')} FROM (SELECT event_id, sum(value) OVER w AS s, avg(value) OVER w AS a, count(*) OVER w AS c FROM events WINDOW w AS ({G} ROWS 599 PRECEDING)) WHERE c = 600")

LARGE = f"SELECT *, count(*) OVER w AS c, sum(x) OVER w AS s, stddev_samp(x) OVER w AS d, min(x) OVER w AS lo, max(x) OVER w AS hi FROM (SELECT *, {{x}} AS x FROM events) WINDOW w AS ({G} ROWS 599 PRECEDING)"
add("mov_large_all", every("SELECT event_id, MOVING_STD(value, 600) AS d, MOVING_MIN(value, 600) AS lo, MOVING_MAX(value, 600) AS hi FROM events"),
    f"SELECT event_id, {_r('d', 'd')}, {_r('lo', 'lo')}, {_r('hi', 'hi')} FROM ({LARGE.format(x='value')}) WHERE c = 600")
add("mov_large_inf", every("SELECT event_id, MOVING_SUM(1 / (event_id - 200), 600) AS s FROM events"),
    f"SELECT event_id, {_r('s', 's')} FROM ({LARGE.format(x='CASE WHEN event_id = 200 THEN ' + chr(39) + 'infinity' + chr(39) + '::DOUBLE ELSE 1.0::DOUBLE / (event_id - 200) END')}) WHERE c = 600")
add("mov_large_cancel", "CREATE MATERIALIZED VIEW q AS SELECT event_id, MOVING_SUM(CASE WHEN event_id = 300 THEN 100000000000000000 ELSE value END, 600) AS s FROM events; CREATE VIEW every AS SELECT event_id, s FROM q WHERE s < 1000000; SELECT * FROM every",
    f"SELECT event_id, {_r('s', 's')} FROM ({LARGE.format(x='CASE WHEN event_id = 300 THEN 1e17::DOUBLE ELSE value END')}) WHERE c = 600 AND s < 1000000")
add("mov_blocks", every("SELECT event_id, MOVING_AVERAGE(value, 50) AS m FROM events"),
    f"SELECT event_id, {_r('m', 'm')} FROM (SELECT event_id, avg(value) OVER w AS m, count(*) OVER w AS c FROM events WINDOW w AS ({G} ROWS 49 PRECEDING)) WHERE c = 50", block_rows=700)

BAND = f"SELECT user_id, event_id, value, avg(value) OVER w AS mid, stddev_samp(value) OVER w AS sd, count(*) OVER w AS c FROM events WINDOW w AS ({E} ROWS 19 PRECEDING)"
BOLLINGER = "SELECT user_id, event_id, value, MOVING_AVERAGE(value, 20) AS mid_band, MOVING_AVERAGE(value, 20) + 2 * MOVING_STD(value, 20) AS upper_band, MOVING_AVERAGE(value, 20) - 2 * MOVING_STD(value, 20) AS lower_band FROM events GROUP BY user_id"
_BANDS = f"user_id, event_id, {_r('value', 'value')}, {_r('mid', 'mid_band')}, {_r('mid + 2 * sd', 'upper_band')}, {_r('mid - 2 * sd', 'lower_band')}"
add("bollinger", every(BOLLINGER), f"SELECT {_BANDS} FROM ({BAND}) WHERE c = 20")
add("multi_resolution", every("SELECT user_id, event_id, MOVING_AVERAGE(value, 5) AS fast, MOVING_AVERAGE(value, 20) AS slow, fast - slow AS gap FROM events GROUP BY user_id"),
    f"SELECT user_id, event_id, {_r('f', 'fast')}, {_r('s', 'slow')}, {_r('f - s', 'gap')} FROM (SELECT user_id, event_id, avg(value) OVER (w ROWS 4 PRECEDING) AS f, avg(value) OVER (w ROWS 19 PRECEDING) AS s, count(*) OVER (w ROWS 19 PRECEDING) AS c FROM events WINDOW w AS ({E})) WHERE c = 20")
add("zscore", every("SELECT user_id, event_id, (value - MOVING_AVERAGE(value, 20)) / MOVING_STD(value, 20) AS z FROM events GROUP BY user_id"),
    f"SELECT user_id, event_id, {_r('(value - mid) / sd', 'z')} FROM ({BAND}) WHERE c = 20")
add("nested_windows", every("SELECT user_id, event_id, MOVING_MAX(ABS(value - MOVING_AVERAGE(value, 5)), 4) AS peak, MOVING_AVERAGE(SUM(value), 3) AS smooth FROM events GROUP BY user_id"),
    f"WITH a AS (SELECT *, avg(value) OVER (w ROWS 4 PRECEDING) AS m, count(*) OVER (w ROWS 4 PRECEDING) AS c, sum(value) OVER (w ROWS UNBOUNDED PRECEDING) AS t FROM events WINDOW w AS ({E})), b AS (SELECT *, CASE WHEN c = 5 THEN abs(value - m) END AS d FROM a), e AS (SELECT user_id, event_id, max(d) OVER (w ROWS 3 PRECEDING) AS p, count(d) OVER (w ROWS 3 PRECEDING) AS k, avg(t) OVER (w ROWS 2 PRECEDING) AS s FROM b WINDOW w AS ({E})) SELECT user_id, event_id, {_r('p', 'peak')}, {_r('s', 'smooth')} FROM e WHERE k = 4")
add("sparse_window", every("SELECT user_id, event_id, MOVING_AVERAGE(CASE WHEN value > 50 THEN value END, 3) AS m FROM events GROUP BY user_id"),
    f"SELECT user_id, event_id, {_r('m', 'm')} FROM (SELECT user_id, event_id, avg(value) OVER w AS m, count(*) OVER w AS c FROM events WHERE value > 50 WINDOW w AS ({E} ROWS 2 PRECEDING)) WHERE c = 3")

# HAVING
add("having_bollinger", every(BOLLINGER + " HAVING value > upper_band"), f"SELECT {_BANDS} FROM ({BAND}) WHERE c = 20 AND value > mid + 2 * sd")
add("having_two_sided", every(BOLLINGER + " HAVING value > upper_band OR value < lower_band"), f"SELECT {_BANDS} FROM ({BAND}) WHERE c = 20 AND (value > mid + 2 * sd OR value < mid - 2 * sd)")
add("having_drop_baseline", every("SELECT user_id, event_id, value FROM events GROUP BY user_id HAVING value < MOVING_AVERAGE(value, 10) * 0.5"),
    f"SELECT user_id, event_id, {_r('value', 'value')} FROM (SELECT *, avg(value) OVER w AS m, count(*) OVER w AS c FROM events WINDOW w AS ({E} ROWS 9 PRECEDING)) WHERE c = 10 AND value < m * 0.5")
add("having_count", every("SELECT user_id, event_id, COUNT(*) AS n, SUM(value) AS total FROM events GROUP BY user_id HAVING n > 5 AND total > 100"),
    f"SELECT user_id, event_id, n, {_r('t', 'total')} FROM (SELECT user_id, event_id, (count(*) {RUN})::DOUBLE AS n, sum(value) {RUN} AS t FROM events) WHERE n > 5 AND t > 100")
add("velocity_alert", every("SELECT user_id, event_id, MOVING_COUNT(100) AS n FROM events GROUP BY user_id HAVING MOVING_COUNT(100) > 2"),
    f"SELECT user_id, event_id, n FROM (SELECT user_id, event_id, (count(*) OVER (PARTITION BY user_id ORDER BY g RANGE BETWEEN 99 PRECEDING AND CURRENT ROW))::DOUBLE AS n FROM (SELECT *, row_number() OVER ({G}) AS g FROM events)) WHERE n > 2")

# reads of keyed views
KEYED = "CREATE MATERIALIZED VIEW q AS SELECT user_id, SUM(value) AS total, COUNT(*) AS n FROM events GROUP BY user_id; "
TOTALS = "SELECT user_id, sum(value) AS t, count(*)::DOUBLE AS n FROM events GROUP BY user_id"
add("keyed_latest", KEYED + "SELECT * FROM q", f"SELECT user_id, {_r('t', 'total')}, n FROM ({TOTALS})")
add("key_lookup", KEYED + "SELECT user_id, total FROM q WHERE user_id = 3", f"SELECT user_id, {_r('t', 'total')} FROM ({TOTALS}) WHERE user_id = 3")
add("cross_key_aggs", KEYED + "SELECT SUM(total) AS s, COUNT(*) AS c, AVG(total) AS a, MIN(total) AS lo, MAX(total) AS hi FROM q WHERE n > 10",
    f"SELECT {_r('coalesce(sum(t), 0)', 's')}, count(*)::DOUBLE AS c, {_r('coalesce(avg(t), 0)', 'a')}, {_r('coalesce(min(t), 0)', 'lo')}, {_r('coalesce(max(t), 0)', 'hi')} FROM ({TOTALS}) WHERE n > 10")
add("composite_latest", "CREATE MATERIALIZED VIEW q AS SELECT user_id, event_type, SUM(value) AS total FROM events GROUP BY user_id, event_type; SELECT * FROM q",
    f"SELECT user_id, event_type, {_r('sum(value)', 'total')} FROM events GROUP BY user_id, event_type")

# order and limit
add("topk_desc", "CREATE VIEW q AS SELECT event_id, value FROM events; SELECT * FROM q ORDER BY value DESC, event_id LIMIT 10", f"SELECT event_id, {_r('value', 'value')} FROM events ORDER BY events.value DESC, event_id LIMIT 10")
add("topk_asc", "CREATE MATERIALIZED VIEW q AS SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 15; CREATE VIEW every AS SELECT * FROM q; SELECT * FROM every", f"SELECT event_id, {_r('value', 'value')} FROM events ORDER BY events.value, event_id LIMIT 15")
add("limit_latest", "SELECT event_id, value FROM events LIMIT 7", f"SELECT event_id, {_r('value', 'value')} FROM events ORDER BY ts DESC, event_id DESC LIMIT 7")
add("limit_first", "SELECT event_id, value * 2 AS v FROM events WHERE value > 10 LIMIT 7", f"SELECT event_id, {_r('value * 2', 'v')} FROM events WHERE value > 10 ORDER BY ts, event_id LIMIT 7")

# chains of views
MA3 = f"avg(x) OVER ({E} ROWS 2 PRECEDING)"
add("chain_2", "CREATE MATERIALIZED VIEW a AS SELECT user_id, event_id, SUM(value) AS total FROM events GROUP BY user_id; " + every("SELECT user_id, event_id, MOVING_AVERAGE(total, 3) AS m FROM a GROUP BY user_id"),
    f"SELECT user_id, event_id, {_r('m', 'm')} FROM (SELECT user_id, event_id, avg(t) OVER w AS m, count(*) OVER w AS c FROM (SELECT *, sum(value) {RUN} AS t FROM events) WINDOW w AS ({E} ROWS 2 PRECEDING)) WHERE c = 3")
add("chain_3", "CREATE MATERIALIZED VIEW a AS SELECT user_id, event_id, SUM(value) AS total FROM events GROUP BY user_id; CREATE MATERIALIZED VIEW b AS SELECT user_id, event_id, MOVING_AVERAGE(total, 3) AS m FROM a GROUP BY user_id; " + every("SELECT user_id, event_id, MOVING_AVERAGE(m, 2) AS mm FROM b GROUP BY user_id"),
    f"WITH a AS (SELECT *, sum(value) {RUN} AS t FROM events), b AS (SELECT user_id, event_id, ts, avg(t) OVER w AS m, count(*) OVER w AS c FROM a WINDOW w AS ({E} ROWS 2 PRECEDING)), d AS (SELECT user_id, event_id, avg(m) OVER w AS mm, count(*) OVER w AS k FROM b WHERE c = 3 WINDOW w AS ({E} ROWS 1 PRECEDING)) SELECT user_id, event_id, {_r('mm', 'mm')} FROM d WHERE k = 2")
add("chain_agg_filter", "CREATE MATERIALIZED VIEW a AS SELECT user_id, event_id, value FROM events WHERE value > 30; CREATE VIEW b AS SELECT user_id, event_id, SUM(value) AS total FROM a GROUP BY user_id; " + every("SELECT user_id, event_id, total FROM b WHERE total > 200"),
    f"SELECT user_id, event_id, {_r('t', 'total')} FROM (SELECT user_id, event_id, sum(value) {RUN} AS t FROM events WHERE value > 30) WHERE t > 200")

# tables
add("table_semi_join", every("SELECT o_orderkey, o_custkey, o_totalprice FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey WHERE o_totalprice > 1000"),
    f"SELECT o_orderkey, o_custkey, {_r('o_totalprice', 'o_totalprice')} FROM orders SEMI JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000")
add("table_enrich", every("SELECT o_orderkey, c.c_nationkey, o_totalprice + c.c_acctbal AS both_sum FROM orders JOIN customer c ON orders.o_custkey = c.c_custkey"),
    f"SELECT o_orderkey, c_nationkey, {_r('o_totalprice + c_acctbal', 'both_sum')} FROM orders JOIN customer ON o_custkey = c_custkey")


add("table_chain", every("SELECT o_orderkey, n.n_regionkey, o_totalprice + c.c_acctbal AS both_sum FROM orders JOIN customer c ON orders.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"),
    f"SELECT o_orderkey, n_regionkey, {_r('o_totalprice + c_acctbal', 'both_sum')} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
add("table_left", every("SELECT o_orderkey, m.c_acctbal AS balance FROM orders LEFT JOIN member m ON orders.o_custkey = m.c_custkey"),
    f"SELECT o_orderkey, {_r('c_acctbal', 'balance')} FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey")


def _changing(kind: str, name: str, join: str, oracle_join: str) -> None:
    """Clicks with what their user has bought last: a table whose keys change
    between the events that look them up."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = every(f"SELECT event_id, p.value AS last_value FROM click {join} bought p ON click.user_id = p.user_id")
        e = engine(spark, sf_dir, "click")
        e.execute("CREATE TABLE bought (user_id DOUBLE PRECISION PRIMARY KEY, value DOUBLE PRECISION)")
        events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'purchase'")
        e.change("bought", events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("user_id").cast("double").alias("user_id"), "value"), "at")
        return rounded(e.script(sql)[-1])

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT c.event_id, {_r('p.value', 'last_value')} FROM (SELECT * FROM events WHERE event_type = 'click') c {oracle_join} (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts >= p.ts"


_changing("inner", "table_changes", "JOIN", "ASOF JOIN")
_changing("left", "table_changes_left", "LEFT JOIN", "ASOF LEFT JOIN")

# statements: rows given one by one, at the clock's times
add("statements", """CREATE STREAM s (k DOUBLE PRECISION, x DOUBLE PRECISION); CREATE TABLE names (k DOUBLE PRECISION PRIMARY KEY, weight DOUBLE PRECISION);
CREATE MATERIALIZED VIEW q AS SELECT s.k AS k, x * n.weight AS w FROM s JOIN names n ON s.k = n.k; CREATE VIEW every AS SELECT * FROM q;
INSERT INTO names VALUES (1, 10), (2, 20); INSERT INTO s VALUES (1, 1), (2, 2), (3, 3); DELETE FROM names WHERE k = 1; INSERT INTO s VALUES (1, 4), (2, 5);
INSERT INTO names (weight, k) VALUES (30, 2); INSERT INTO s (x, k) VALUES (6, 2); CREATE STREAM gone (a DOUBLE); DROP STREAM gone; DROP VIEW IF EXISTS gone;
SELECT * FROM every""", "SELECT k::DOUBLE AS k, w::DOUBLE AS w FROM (VALUES (1, 10), (2, 40), (2, 100), (2, 180)) t(k, w)")


def insert_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream filled from a DataFrame with other names for its columns."""
    e = Engine(spark)
    e.execute("CREATE STREAM s (k DOUBLE PRECISION, x DOUBLE PRECISION)")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.insert("s", events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("time"), F.col("user_id").cast("double").alias("u"), F.col("value").alias("v")), {"k": "u", "x": "v"})
    return rounded(e.script("CREATE MATERIALIZED VIEW q AS SELECT k, SUM(x) AS total, COUNT(*) AS n FROM s GROUP BY k; SELECT * FROM q")[-1])


QUERIES["insert_frame"] = insert_frame
ORACLE_SQL["insert_frame"] = f"SELECT user_id::DOUBLE AS k, {_r('sum(value)', 'total')}, count(*)::DOUBLE AS n FROM events GROUP BY user_id"


def range_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's reads by time: a range, the last ones, the last before."""
    e = engine(spark, sf_dir, "events")
    low, high = 1704412800000000, 1704499200000000  # 2024-01-05 and the day after, in microseconds
    reads = {"range": e.read_range("events", low, high, 50), "latest": e.latest("events", 5), "before": e.latest_before("events", low), "keys": e.latest_per_key("events", "event_type")}
    out = None
    for name, df in reads.items():
        own = df.select(F.lit(name).alias("read"), "event_id")
        out = own if out is None else out.unionByName(own)
    return out


QUERIES["range_reads"] = range_reads
ORACLE_SQL["range_reads"] = """SELECT 'range' AS read, event_id FROM (SELECT * FROM events WHERE ts BETWEEN '2024-01-05' AND '2024-01-06' ORDER BY ts, event_id LIMIT 50)
UNION ALL SELECT 'latest', event_id FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 5)
UNION ALL SELECT 'before', event_id FROM (SELECT * FROM events WHERE ts <= '2024-01-05' ORDER BY ts DESC, event_id DESC LIMIT 1)
UNION ALL SELECT 'keys', event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"""


def table_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = every("SELECT o_orderkey, o_custkey FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey")
    e = engine(spark, sf_dir, sql)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    e.delete_where("customer", customers.filter("c_custkey % 3 = 0").select("c_custkey"))
    return rounded(e.script(sql)[-1])


QUERIES["table_delete"] = table_delete
ORACLE_SQL["table_delete"] = "SELECT o_orderkey, o_custkey FROM orders SEMI JOIN customer ON o_custkey = c_custkey WHERE o_custkey % 3 <> 0"

# several streams in event time

def _asof(kinds: tuple[str, ...], select: str, where: str = "TRUE") -> str:
    last = ", ".join(f"last_value(CASE WHEN event_type = '{k}' THEN value END IGNORE NULLS) OVER (ORDER BY ts, r, event_id ROWS UNBOUNDED PRECEDING) AS v{i}" for i, k in enumerate(kinds))
    ranks = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(kinds))
    ready = " AND ".join(f"v{i} IS NOT NULL" for i in range(len(kinds)))
    return f"SELECT {select} FROM (SELECT *, {last} FROM (SELECT *, CASE event_type {ranks} END AS r FROM events WHERE event_type IN ({', '.join(map(repr, kinds))}))) WHERE {ready} AND {where}"


add("asof_two", every("SELECT click.value AS a, purchase.value AS b, a - b AS spread FROM click, purchase"), _asof(("click", "purchase"), f"{_r('v0', 'a')}, {_r('v1', 'b')}, {_r('v0 - v1', 'spread')}"))
add("asof_three", every("SELECT c.value + v.value + p.value AS total FROM click c, view v, purchase p WHERE total > 100"), _asof(KINDS, _r("v0 + v1 + v2", "total"), "v0 + v1 + v2 > 100"))
add("asof_correlation", "CREATE MATERIALIZED VIEW pair AS SELECT c.value AS x, v.value AS y FROM click c, view v; " + every("SELECT (MOVING_AVERAGE(x * y, 20) - MOVING_AVERAGE(x, 20) * MOVING_AVERAGE(y, 20)) / (MOVING_STD(x, 20) * MOVING_STD(y, 20)) AS rho FROM pair"),
    f"SELECT {_r('(xy - mx * my) / (sx * sy)', 'rho')} FROM (SELECT avg(x * y) OVER w AS xy, avg(x) OVER w AS mx, avg(y) OVER w AS my, stddev_samp(x) OVER w AS sx, stddev_samp(y) OVER w AS sy, count(*) OVER w AS n FROM ({_asof(('click', 'view'), 'v0 AS x, v1 AS y, ts, r, event_id')}) WINDOW w AS (ORDER BY ts, r, event_id ROWS 19 PRECEDING)) WHERE n = 20")

add("asof_ranges", every("SELECT click.value AS a, purchase.value AS b FROM click, purchase"), _asof(("click", "purchase"), f"{_r('v0', 'a')}, {_r('v1', 'b')}"), block_rows=200)
add("asof_self", every("SELECT a.event_id AS event_id, a.value - b.value AS d FROM click a, click b"),
    f"WITH c AS (SELECT event_id, value, lag(value) OVER ({G}) AS p FROM events WHERE event_type = 'click') SELECT event_id, {_r('value - p', 'd')} FROM c WHERE p IS NOT NULL UNION ALL SELECT event_id, {_x('0.0::DOUBLE')} FROM c")
add("views_in_step", "CREATE MATERIALIZED VIEW a AS SELECT event_id, MOVING_AVERAGE(value, 5) AS fast FROM events; CREATE MATERIALIZED VIEW b AS SELECT MOVING_AVERAGE(value, 20) AS slow FROM events; " + every("SELECT a.event_id AS event_id, a.fast - b.slow AS gap FROM a, b"),
    f"SELECT event_id, {_r('f - s', 'gap')} FROM (SELECT event_id, avg(value) OVER (w ROWS 4 PRECEDING) AS f, avg(value) OVER (w ROWS 19 PRECEDING) AS s, count(*) OVER (w ROWS 19 PRECEDING) AS c FROM events WINDOW w AS ({G})) WHERE c = 20")

# signals
add("difference", every("SELECT user_id, event_id, DIFFERENCE(value) AS d FROM events GROUP BY user_id"),
    f"SELECT user_id, event_id, {_r('d', 'd')} FROM (SELECT *, value - lag(value) OVER ({E}) AS d FROM events) WHERE d IS NOT NULL")
add("time_shift", "CREATE MATERIALIZED VIEW a AS SELECT event_id, TIME_SHIFT(value, 3600000000) AS later FROM events; " + every("SELECT v.event_id AS event_id, a.later AS an_hour_ago, v.value AS value FROM view v, a"),
    f"WITH u AS (SELECT ts, 0 AS r, event_id, event_id AS e, value AS v, NULL AS l FROM events WHERE event_type = 'view' UNION ALL SELECT ts + INTERVAL 1 HOUR, 1, event_id, NULL, NULL, value FROM events), f AS (SELECT last_value(e IGNORE NULLS) OVER w AS e, last_value(v IGNORE NULLS) OVER w AS v, last_value(l IGNORE NULLS) OVER w AS l FROM u WINDOW w AS (ORDER BY ts, r, event_id ROWS UNBOUNDED PRECEDING)) SELECT e AS event_id, {_r('l', 'an_hour_ago')}, {_r('v', 'value')} FROM f WHERE e IS NOT NULL AND l IS NOT NULL")
add("peak_even", every("SELECT user_id, PEAK_DETECT(value, 4) AS peak FROM events GROUP BY user_id"),
    f"SELECT user_id, {_r('c', 'peak')} FROM (SELECT user_id, lag(value, 3) OVER w AS e, lag(value, 2) OVER w AS c, lag(value, 1) OVER w AS b, value AS a FROM events WINDOW w AS ({E})) WHERE e IS NOT NULL AND c > a AND c > b AND c > e")
add("resample_hermite", every("SELECT user_id, RESAMPLE_HERMITE(value, 7200000000) AS v FROM events GROUP BY user_id"),
    f"""WITH e AS (SELECT user_id, epoch_us(ts) AS t, value AS x, row_number() OVER ({E}) - 1 AS i FROM events), p AS (
  SELECT user_id, t, x, lag(t) OVER w AS t0, lag(x) OVER w AS x0, lead(t) OVER w AS t2, lead(x) OVER w AS x2, lead(t, 2) OVER w AS t3, lead(x, 2) OVER w AS x3 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, i)),
m AS (SELECT *, t2 - t AS w, (COALESCE(x2, x) - COALESCE(x0, x)) / NULLIF(COALESCE(t2, t) - COALESCE(t0, t), 0)::DOUBLE AS m1, (COALESCE(x3, x2) - x) / NULLIF(COALESCE(t3, t2) - t, 0)::DOUBLE AS m2 FROM p),
g AS (SELECT user_id, unnest(generate_series(min(t), max(t), 7200000000)) AS s FROM e GROUP BY user_id),
k AS (SELECT g.user_id, s, m.*, COALESCE((s - t)::DOUBLE / w, 0) AS q FROM g ASOF JOIN m ON g.user_id = m.user_id AND g.s >= m.t)
SELECT user_id, {_r('CASE WHEN q = 0 THEN x ELSE (2*q*q*q - 3*q*q + 1) * x + (q*q*q - 2*q*q + q) * w * m1 + (3*q*q - 2*q*q*q) * x2 + (q*q*q - q*q) * w * m2 END', 'v')} FROM k""")
add("fir_five", every("SELECT event_id, FIR(value, ARRAY[0.1, 0.2, 0.4, 0.2, 0.1]) AS y FROM events"),
    f"SELECT event_id, {_r('y', 'y')} FROM (SELECT event_id, 0.1 * value + 0.2 * lag(value, 1) OVER w + 0.4 * lag(value, 2) OVER w + 0.2 * lag(value, 3) OVER w + 0.1 * lag(value, 4) OVER w AS y FROM events WINDOW w AS ({G})) WHERE y IS NOT NULL")
add("fir", every("SELECT user_id, event_id, FIR(value, ARRAY[0.5, 0.3, 0.2]) AS y FROM events GROUP BY user_id"),
    f"SELECT user_id, event_id, {_r('y', 'y')} FROM (SELECT user_id, event_id, 0.5 * value + 0.3 * lag(value, 1) OVER w + 0.2 * lag(value, 2) OVER w AS y FROM events WINDOW w AS ({E})) WHERE y IS NOT NULL")
add("iir", every("SELECT user_id, event_id, IIR(value, ARRAY[1, -0.5], ARRAY[0.5]) AS y FROM events GROUP BY user_id"),
    f"SELECT user_id, event_id, {_r('list_reduce(list_prepend(0.0::DOUBLE, list(value::DOUBLE) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), lambda y, x: 0.5 * x + 0.5 * y)', 'y')} FROM events")
add("peak_detect", every("SELECT user_id, PEAK_DETECT(value, 3) AS peak FROM events GROUP BY user_id"),
    f"SELECT user_id, {_r('c', 'peak')} FROM (SELECT user_id, lag(value, 1) OVER w AS c, lag(value, 2) OVER w AS b, value AS a FROM events WINDOW w AS ({E})) WHERE b IS NOT NULL AND c > a AND c > b")
add("resample", every("SELECT user_id, RESAMPLE(value, 3600000000) AS v FROM events GROUP BY user_id"),
    f"WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_id, value FROM events), last AS (SELECT user_id, t, arg_max(value, event_id) AS value FROM e GROUP BY user_id, t), g AS (SELECT user_id, unnest(generate_series(min(t), max(t), 3600000000)) AS t FROM e GROUP BY user_id) SELECT g.user_id, {_r('last.value', 'v')} FROM g ASOF JOIN last ON g.user_id = last.user_id AND g.t >= last.t")


# the streaming twins of batch queries
def streaming(name: str, twin: str, select: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = f"{sf_dir}/events.parquet"
        return rounded(stream_view(spark, source, "ts", "event_id", select))

    QUERIES[name] = run
    ORACLE_SQL[name] = ORACLE_SQL[twin]


streaming("stream_cum_sum", "cum_sum", "SELECT user_id, event_id, SUM(value) AS total FROM events GROUP BY user_id")
streaming("stream_mov_avg", "mov_avg", "SELECT user_id, event_id, MOVING_AVERAGE(value, 10) AS m FROM events GROUP BY user_id")
streaming("stream_bollinger", "bollinger", BOLLINGER)
streaming("stream_iir", "iir", "SELECT user_id, event_id, IIR(value, ARRAY[1, -0.5], ARRAY[0.5]) AS y FROM events GROUP BY user_id")
streaming("stream_peak", "peak_detect", "SELECT user_id, PEAK_DETECT(value, 3) AS peak FROM events GROUP BY user_id")
streaming("stream_resample", "resample", "SELECT user_id, RESAMPLE(value, 3600000000) AS v FROM events GROUP BY user_id")
streaming("stream_velocity", "velocity_alert", "SELECT user_id, event_id, MOVING_COUNT(100) AS n FROM events GROUP BY user_id HAVING MOVING_COUNT(100) > 2")
streaming("stream_large", "mov_large_all", "SELECT event_id, MOVING_STD(value, 600) AS d, MOVING_MIN(value, 600) AS lo, MOVING_MAX(value, 600) AS hi FROM events")


def live(name: str, twin: str, sql: str) -> None:
    """A script over live streams: events and its kinds, with the customers of
    a batch and what users have bought last as tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def make() -> DataFrame:
            named = set(re.findall(r"\w+", sql))
            events = lambda: read_stream(spark, f"{sf_dir}/events.parquet", "ts", "event_id")
            streams = {"events": events().withColumn("event_id", F.col("_seq"))} if "events" in named else {}
            streams |= {k: events().withColumn("event_id", F.col("_seq")).filter(F.col("event_type") == k).drop("event_type") for k in KINDS if k in named}
            orders = lambda: read_stream(spark, f"{sf_dir}/orders.parquet", "o_orderdate", "o_orderkey")
            if "orders" in named:
                streams["orders"] = orders().select("_ts", "_seq", F.col("_seq").alias("o_orderkey"), "o_custkey", "o_totalprice")
            tables = {}
            if "customer" in named:
                tables["customer"] = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey"
            if "bought" in named:
                changes = events().filter("event_type = 'purchase'").select("_ts", "_seq", F.lit(False).alias("_deleted"), "user_id", "value")
                tables["bought"] = changes, "user_id"
            return live_script(streams, sql, tables)

        return rounded(run_live(spark, make))

    QUERIES[name] = run
    ORACLE_SQL[name] = ORACLE_SQL[twin]


live("live_chain", "chain_3", "CREATE VIEW a AS SELECT user_id, event_id, SUM(value) AS total FROM events GROUP BY user_id; CREATE VIEW b AS SELECT user_id, event_id, MOVING_AVERAGE(total, 3) AS m FROM a GROUP BY user_id; SELECT user_id, event_id, MOVING_AVERAGE(m, 2) AS mm FROM b GROUP BY user_id")
live("live_asof", "asof_two", "SELECT click.value AS a, purchase.value AS b, click.value - purchase.value AS spread FROM click, purchase")
live("live_asof_view", "asof_correlation", "CREATE VIEW pair AS SELECT c.value AS x, v.value AS y FROM click c, view v; SELECT (MOVING_AVERAGE(x * y, 20) - MOVING_AVERAGE(x, 20) * MOVING_AVERAGE(y, 20)) / (MOVING_STD(x, 20) * MOVING_STD(y, 20)) AS rho FROM pair")
live("live_table", "table_enrich", "SELECT o_orderkey, c.c_nationkey AS c_nationkey, o_totalprice + c.c_acctbal AS both_sum FROM orders JOIN customer c ON orders.o_custkey = c.c_custkey")
live("live_table_changes", "table_changes", "SELECT event_id, p.value AS last_value FROM click JOIN bought p ON click.user_id = p.user_id")
