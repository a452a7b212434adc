from __future__ import annotations

import math
import random
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.errors import SqlError
from tidemark.plans.parser import parse
from tidemark.streaming.stateful import STATE_STORE, LatestProcessor, Machine, live_script, live_view, moved, read_stream, run_live, stream_view


def frame(n, keys=2):
    return pd.DataFrame({"ts": pd.to_datetime([1_700_000_000 + i for i in range(n)], unit="s"), "id": range(n), "k": [i % keys for i in range(n)], "x": [float((i * 7) % 11) for i in range(n)]})


def emitted(sql, values, columns=("x",)):
    m = Machine(parse(sql), list(columns))
    return [[r[2:] for r in m.step(i, i, {"x": v})] for i, v in enumerate(values)]


def test_machine_emits_when_all_windows_are_full():
    assert emitted("SELECT MOVING_AVERAGE(x, 2) AS m, SUM(x) AS s FROM t", (1.0, 3.0, 5.0)) == [[], [[2.0, 4.0]], [[4.0, 9.0]]]
    assert emitted("SELECT MOVING_STD(x, 1) AS m, x / 0 AS d FROM t WHERE x > 1", (1.0, 3.0)) == [[], [[0.0, math.inf]]]
    assert emitted("SELECT PEAK_DETECT(x, 3) AS p FROM t", (1.0, 3.0, 2.0, 2.0, 5.0, 4.0)) == [[], [], [[3.0]], [], [], [[5.0]]]
    assert emitted("SELECT DIFFERENCE(x) AS d FROM t", (1.0, 3.0)) == [[], [[2.0]]]


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_windows_of_two_parts_match_whole_ones(n):
    rnd = random.Random(n)
    values = [rnd.uniform(-5, 5) for _ in range(60)]
    values[20], values[35] = math.inf, 1e17
    states = {k: [] for k in ("SUM", "AVERAGE", "MIN", "MAX", "STD")}
    for i, x in enumerate(values):
        last = values[max(0, i - n + 1) : i + 1]
        found = {k: moved(k, n, s, x) for k, s in states.items()}
        if len(last) < n:
            assert set(found.values()) == {None}
        elif math.inf in last:
            assert found["SUM"] == found["MAX"] == math.inf
        else:
            assert found["SUM"] == pytest.approx(math.fsum(last)) and found["AVERAGE"] == pytest.approx(math.fsum(last) / n)
            assert (found["MIN"], found["MAX"]) == (min(last), max(last))
            assert found["STD"] == pytest.approx(statistics.stdev(last) if n > 1 else 0.0)


def test_what_streams_refuse(spark):
    for sql in ("SELECT RESAMPLE_HERMITE(x, 3) AS p FROM t", "SELECT x FROM t WHERE x > MOVING_AVERAGE(x, 3)", "SELECT RESAMPLE(x, 2) AS a, RESAMPLE(x, 3) AS b FROM t"):
        with pytest.raises(SqlError):
            Machine(parse(sql), ["k", "x"])
    with pytest.raises(SqlError):
        live_view(spark.range(1), "SELECT id FROM t LIMIT 1")
    for sql in ("SELECT x FROM nowhere", "DROP VIEW a", "SELECT t.x FROM t JOIN w ON t.k = w.k"):
        with pytest.raises(SqlError):
            live_script({"t": spark.createDataFrame([], "_ts long, _seq long, k long, x double")}, sql)


def test_restart_goes_on_where_it_stopped(spark, tmp_path):
    data = frame(40)
    source, place = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    sql = "SELECT k, id, SUM(x) AS s, MOVING_AVERAGE(x, 3) AS m FROM t GROUP BY k"
    schema = "ts timestamp, id long, k long, x double"
    spark.createDataFrame(data[:25], schema).coalesce(1).write.parquet(str(source / "a"))
    glob = str(source / "*")

    def run():
        return {r["id"]: (r["s"], r["m"]) for r in stream_view(spark, glob, "ts", "id", sql, place).collect()}

    from tidemark.streaming import stateful

    stateful_folder = stateful._is_folder
    stateful._is_folder = lambda s, p: True
    try:
        first = run()
        spark.createDataFrame(data[25:], schema).coalesce(1).write.parquet(str(source / "b"))
        found = run()
    finally:
        stateful._is_folder = stateful_folder
    assert len(first) == 25 - 4
    for _, group in data.groupby("k"):
        sums, means = group.x.cumsum(), group.x.rolling(3).mean()
        for i, s, m in zip(group.id, sums, means, strict=True):
            if m == m:
                assert found[i] == pytest.approx((s, m))
    assert len(found) == 40 - 4


def test_messages_go_out_and_come_in(spark, tmp_path):
    """A live view of messages in files, its rows as messages in files again."""
    from tidemark.sources import streams

    events = spark.createDataFrame([(10 * i, i, float(i), float(i % 3)) for i in range(20)], "_ts long, _seq long, x double, k double")
    streams.encoded(events).write.text(f"{tmp_path}/in")
    spark.createDataFrame([("no message",), ('{"time": 1, "values": [1]}',), ('{"values": [1, 2]}',)], "value string").write.mode("append").text(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        live = live_view(streams.source(spark, ["x", "k"], "text", path=f"{tmp_path}/in"), "SELECT k, SUM(x) AS s FROM t GROUP BY k")
        streams.sink(live, f"{tmp_path}/progress", "text", path=f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    found = sorted(tuple(r) for r in streams.decoded(spark.read.text(f"{tmp_path}/out"), ["k", "s"]).collect())
    assert found == [(10 * i, i, float(i % 3), float(sum(j for j in range(i + 1) if j % 3 == i % 3))) for i in range(20)]


@pytest.mark.parametrize(("first", "expected"), [
    ([0, 1], [[5, 1, 3.0, 7.0], [5, 2, 3.0, 8.0], [6, 3, 9.0, 8.0]]),
    ([0, 0], [[5, 1, 4.0, 7.0], [5, 2, 3.0, 7.0], [5, 3, 3.0, 8.0], [6, 4, 9.0, 8.0]]),
])
def test_live_streams_at_one_time(first, expected):
    """Sources of one time in their order, those of one stream event by event;
    the rows' sequence keeps that order."""
    p = LatestProcessor([], ["a.x", "b.x"], None, [[0], [1]], first)
    events = [[5, 2, 1, None, 8.0], [5, 1, 1, None, 7.0], [5, 2, 0, 3.0, None], [5, 1, 0, 4.0, None], [6, 3, 0, 9.0, None]]
    state: dict = {}
    assert p.work(state, sorted(events[:4], key=p.order)) + p.work(state, events[4:]) == expected


def test_live_rows_keep_nan(spark, tmp_path):
    """NaN is a value, in the rows of a view and in those it hands on."""
    df = spark.createDataFrame([(i, i, 0.0 if i % 2 else 1.0) for i in range(4)], "ts long, id long, x double").selectExpr("timestamp_seconds(ts) AS ts", "id", "x")
    df.coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    sql = "CREATE VIEW a AS SELECT id, x, x / (x - x) AS y FROM t; SELECT id, y, y + 1 AS z, CASE WHEN y > 0 THEN 1 ELSE FLOOR(y) END AS w FROM a"
    read = lambda: live_script({"t": read_stream(spark, f"{tmp_path}/t.parquet", "ts", "id").withColumn("id", F.col("_seq"))}, sql)
    found = sorted((repr(tuple(r)) for r in run_live(spark, read).collect()))
    assert found == ["(0, inf, inf, 1.0)", "(1, nan, nan, nan)", "(2, inf, inf, 1.0)", "(3, nan, nan, nan)"]
