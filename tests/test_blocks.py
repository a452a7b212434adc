"""Windows without a key give the same in blocks as in one task."""

from __future__ import annotations

import pytest

from tidemark.engine import Engine
from tidemark.plans.parser import parse
from tidemark.plans.planner import reach

SELECTS = [
    "SELECT id, MOVING_AVERAGE(x, 7) AS a, MOVING_COUNT(5) AS c FROM t",
    "SELECT id, MOVING_MAX(MOVING_SUM(x, 4), 3) AS m, FIR(x, ARRAY[0.5, 0.25, 0.25]) AS f FROM t WHERE x > MOVING_AVERAGE(x, 6)",
    "SELECT PEAK_DETECT(x, 5) AS p FROM t",
    "SELECT id, SUM(x) AS s FROM t",
    "SELECT k, id, MOVING_COUNT(9) AS n FROM t GROUP BY k HAVING MOVING_COUNT(9) > 1",
    "SELECT id, x FROM t WHERE x > 3",
    "SELECT k, id, MOVING_STD(x, 4) AS a, MOVING_MIN(MOVING_SUM(x, 3), 2) AS m FROM t GROUP BY k HAVING a > 1",
    "SELECT k, id, SUM(x) AS s FROM t GROUP BY k",
]


@pytest.mark.parametrize("select", SELECTS)
@pytest.mark.parametrize("block", [10, 37])
def test_blocks(spark, select, block):
    df = spark.createDataFrame([(i // 2, i, i % 5 if i % 3 else None, float((i * 13) % 17)) for i in range(300)], "ts long, id long, k long, x double").repartition(5)
    found = []
    for rows in (None, block):
        e = Engine(spark, block_rows=rows, hot_keys=True)
        e.register("t", df, "ts", ["id"], ["id", "k", "x"])
        e.execute(f"CREATE MATERIALIZED VIEW q AS {select}")
        e.execute("CREATE VIEW every AS SELECT * FROM q")
        found.append(sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in e.execute("SELECT * FROM every").collect()), key=repr))
    assert found[0] == found[1] and found[0]


def test_reach():
    at = lambda sql: reach(*[i.expr for i in parse(f"SELECT {sql} FROM t").items])
    assert at("x + 1") == 0 and at("MOVING_SUM(x, 5)") == 4 and at("MOVING_SUM(MOVING_SUM(x, 5), 3)") == 6
    assert at("SUM(x)") is None and at("IIR(x, ARRAY[1], ARRAY[1])") is None and at("MOVING_SUM(CASE WHEN x > 1 THEN x END, 3)") is None
