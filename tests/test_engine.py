from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.errors import SqlError
from tidemark.operators.signal import Recurrence, iir
from tidemark.sources.events import catalog_from_json


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.execute("CREATE STREAM t (k DOUBLE PRECISION, price DOUBLE PRECISION, qty DOUBLE PRECISION)")
    return e


def fill(e, data, step=10):
    assert e.insert("t", [(step * (i + 1), *map(float, r)) for i, r in enumerate(data)]) == len(data)


def everything(e, select):
    e.execute(f"CREATE MATERIALIZED VIEW made AS {select}")
    e.execute("CREATE VIEW every AS SELECT * FROM made")
    out = sorted(rows(e.execute("SELECT * FROM every")))
    e.execute("DROP VIEW every")
    e.execute("DROP MATERIALIZED VIEW made")
    return out


TRADES = [(1, 10, 10), (1, 30, 20), (2, 20, 5), (1, 15, 30), (2, 25, 15), (1, 10, 1)]


def test_running_aggregates_emit_for_each_event(engine):
    fill(engine, [(1, 1, 10), (1, 1, 20), (2, 1, 5), (1, 1, 30), (2, 1, 15)])
    found = everything(engine, "SELECT k, SUM(qty) AS total, COUNT(*) AS n, AVG(qty) AS mean FROM t GROUP BY k")
    assert found == [(10, 1, 10, 1, 10), (20, 1, 30, 2, 15), (30, 2, 5, 1, 5), (40, 1, 60, 3, 20), (50, 2, 20, 2, 10)]


def test_moving_windows_emit_when_full(engine):
    fill(engine, [(1, p, 1) for p in (10, 20, 30, 40, 50)])
    assert [r[1] for r in everything(engine, "SELECT MOVING_AVERAGE(price, 3) AS m FROM t")] == [20, 30, 40]
    assert everything(engine, "SELECT MOVING_SUM(price, 5) AS s, MOVING_MIN(price, 4) AS a, MOVING_MAX(price, 2) AS b, MOVING_COUNT(3) AS c FROM t") == [(50, 150, 20, 50, 3)]
    assert everything(engine, "SELECT STDDEV(price, 1) AS s FROM t LIMIT 1")[0][1] == 0
    assert everything(engine, "SELECT MOVING_STD(price, 3) AS s FROM t")[0][1] == pytest.approx(10)


def test_chains(engine):
    fill(engine, [(1, p, p) for p in (10, 20, 30, 40, 50, 60)])
    engine.script("CREATE MATERIALIZED VIEW a AS SELECT SUM(qty) AS s FROM t; CREATE MATERIALIZED VIEW b AS SELECT MOVING_AVERAGE(s, 3) AS m FROM a")
    assert [r[1] for r in everything(engine, "SELECT MOVING_AVERAGE(m, 2) AS mm FROM b")] == pytest.approx([145 / 3, 250 / 3, 385 / 3])
    fill(engine, [(1, 70, 70)], step=1000)
    assert len(everything(engine, "SELECT m FROM b")) == 5
    with pytest.raises(SqlError, match="used by"):
        engine.execute("DROP MATERIALIZED VIEW a")


def test_peaks(engine):
    fill(engine, [(1, p, 1) for p in (10, 30, 20, 15, 25, 10)])
    assert everything(engine, "SELECT PEAK_DETECT(price, 3) AS p FROM t") == [(20, 30), (50, 25)]


def test_sparse_arguments_count_what_was_emitted(engine):
    fill(engine, [(1, p, 1) for p in (5, 20, 6, 30, 7, 40)])
    assert everything(engine, "SELECT MOVING_SUM(CASE WHEN price > 10 THEN price END, 2) AS s FROM t") == [(40, 50), (60, 70)]
    assert everything(engine, "SELECT CASE WHEN price > 10 THEN price END AS p FROM t") == [(20, 20), (40, 30), (60, 40)]


def test_where_comes_before_windows_and_sees_all_keys(engine):
    fill(engine, TRADES)
    assert everything(engine, "SELECT SUM(qty) AS s FROM t WHERE price > 12") == [(20, 20), (30, 25), (40, 55), (50, 70)]
    assert [r[0] for r in everything(engine, "SELECT k, SUM(qty) AS s FROM t WHERE price > MOVING_AVERAGE(price, 2) GROUP BY k")] == [20, 50]


def test_having_gates_output_only(engine):
    fill(engine, TRADES)
    assert everything(engine, "SELECT k, SUM(qty) AS s FROM t GROUP BY k HAVING s > 25") == [(20, 1, 30), (40, 1, 60), (60, 1, 61)]
    assert everything(engine, "SELECT k, COUNT(*) AS n FROM t GROUP BY k HAVING MOVING_COUNT(4) > 2") == [(40, 1, 1)]


def test_reads_of_keyed_views(engine):
    fill(engine, TRADES)
    engine.execute("CREATE MATERIALIZED VIEW v AS SELECT k, SUM(qty) AS s FROM t GROUP BY k")
    assert rows(engine.execute("SELECT * FROM v")) == [(60, 1, 61), (50, 2, 20)]
    assert rows(engine.execute("SELECT s FROM v WHERE k = 2")) == [(50, 20)]
    assert rows(engine.execute("SELECT SUM(s) AS a, COUNT(*) AS n, AVG(s) AS m, MIN(s) AS lo, MAX(s) AS hi FROM v")) == [(81, 2, 40.5, 20, 61)]
    assert rows(engine.execute("SELECT SUM(s) AS a, MIN(s) AS lo FROM v WHERE k > 9")) == [(0, 0)]
    assert rows(engine.execute("SELECT k, s FROM v ORDER BY s LIMIT 1")) == [(50, 2, 20)]
    assert rows(engine.execute("SELECT MAX(s) - MIN(s) AS spread FROM v")) == [(41,)]


def test_composite_keys_do_not_collide(engine):
    fill(engine, [(1, 0, 1), (0, 1000003, 2)])
    assert [r[3] for r in everything(engine, "SELECT k, price, SUM(qty) AS s FROM t GROUP BY k, price")] == [1, 2]


def test_limits(engine):
    fill(engine, TRADES)
    assert [r[0] for r in rows(engine.execute("SELECT * FROM t LIMIT 2"))] == [50, 60]
    assert [r[0] for r in rows(engine.execute("SELECT price * 2 AS p FROM t LIMIT 2"))] == [10, 20]
    assert [r[0] for r in rows(engine.execute("SELECT price FROM t WHERE price > 12 LIMIT 2"))] == [20, 30]
    with pytest.raises(SqlError, match="LIMIT"):
        engine.execute("SELECT * FROM t")


def test_ieee(engine):
    fill(engine, [(0, 0, 0)])
    found = everything(engine, "SELECT 1 / price AS a, -1 / price AS b, price / qty AS c, LN(price) AS d, LN(price - 1) AS e, SQRT(price - 1) AS f, SIGN(price / qty) AS g FROM t")[0]
    assert found[1:3] == (math.inf, -math.inf) and math.isnan(found[3]) and found[4] == -math.inf and math.isnan(found[5]) and math.isnan(found[6]) and found[7] == 0
    assert everything(engine, "SELECT CASE WHEN price / qty = price / qty THEN 1 ELSE 0 END AS same, CASE WHEN price / qty > 1 THEN 1 ELSE 0 END AS more FROM t")[0][1:] == (0, 0)
    assert everything(engine, "SELECT ROUND(2.5) AS a, ROUND(-2.5) AS b, FLOOR(-1.5) AS c, POWER(2, 3) AS d FROM t")[0][1:] == (3, -3, -2, 8)


def test_filters(engine):
    fill(engine, [(1, p, 1) for p in (4, 8, 0, 2)])
    assert [r[1] for r in everything(engine, "SELECT FIR(price, ARRAY[0.5, 0.5]) AS y FROM t")] == [6, 4, 1]
    assert [r[1] for r in everything(engine, "SELECT IIR(price, ARRAY[1, -0.5], ARRAY[0.5]) AS y FROM t")] == [2, 5, 2.5, 2.25]


def test_resample(engine):
    engine.insert("t", [(0, 1.0, 10.0, 1.0), (25, 1.0, 20.0, 1.0), (40, 1.0, 30.0, 1.0)])
    assert everything(engine, "SELECT RESAMPLE(price, 10) AS p FROM t") == [(0, 10), (10, 10), (20, 10), (30, 20), (40, 30)]


def test_as_of(spark):
    e = Engine(spark)
    e.script("CREATE STREAM a (price DOUBLE); CREATE STREAM b (price DOUBLE); CREATE MATERIALIZED VIEW s AS SELECT a.price AS x, b.price AS y, x - y AS spread FROM a, b WHERE spread < 7")
    e.insert("a", [(1000, 100.0), (1300, 102.0)])
    e.insert("b", [(1200, 95.0), (1700, 97.0)])
    assert rows(e.execute("SELECT spread FROM s LIMIT 9")) == [(1200, 5), (1700, 5)]


def test_tables(spark):
    e = Engine(spark)
    e.script("CREATE STREAM o (k DOUBLE, v DOUBLE); CREATE TABLE w (k DOUBLE PRIMARY KEY, risk DOUBLE)")
    e.script("INSERT INTO w VALUES (1, 5), (2, 6); DELETE FROM w WHERE k = 2; INSERT INTO w (risk, k) VALUES (9, 1)")
    e.insert("o", [(1 << 45, 1.0, 10.0), (1 << 45, 2.0, 20.0)])
    e.execute("CREATE MATERIALIZED VIEW j AS SELECT o.k, v, w.risk FROM o JOIN w ON o.k = w.k")
    assert [r[1:] for r in rows(e.execute("SELECT * FROM j LIMIT 5"))] == [(1, 10, 9)]
    assert rows(e.execute("SELECT k, risk FROM w"))[0][1:] == (1, 9)
    for bad in ("SELECT v FROM o JOIN w ON o.k = w.risk LIMIT 1", "SELECT v FROM o RIGHT JOIN w ON o.k = w.k LIMIT 1", "SELECT o.v FROM o JOIN o ON o.k = o.k LIMIT 1", "DELETE FROM o WHERE k = 1"):
        with pytest.raises(SqlError):
            e.execute(bad)


@pytest.mark.parametrize("sql", [
    "SELECT nope FROM t LIMIT 1", "SELECT NOPE(k) FROM t LIMIT 1", "SELECT k FROM missing LIMIT 1", "CREATE STREAM t (x DOUBLE)", "CREATE TABLE u (a DOUBLE PRIMARY KEY, b DOUBLE PRIMARY KEY)",
    "SELECT k FROM t WHERE SUM(k) > 1 LIMIT 1", "CREATE VIEW v AS SELECT k FROM t ORDER BY k", "INSERT INTO t VALUES (1)", "INSERT INTO t VALUES (1, 2, k)", "DROP STREAM missing",
    "CREATE VIEW v AS SELECT MOVING_SUM(k, 0) AS s FROM t", "CREATE VIEW v AS SELECT MOVING_SUM(k, qty) AS s FROM t", "CREATE VIEW v AS SELECT COUNT(k) AS n FROM t", "CREATE VIEW v AS SELECT FIR(k, 3) AS n FROM t",
])
def test_errors(engine, sql):
    with pytest.raises(SqlError):
        engine.execute(sql)


def test_aliases_do_not_shadow_columns(engine):
    fill(engine, [(1, 2, 3)])
    assert everything(engine, "SELECT price * 2 AS price, qty AS q, q + price AS both_sum FROM t") == [(10, 4, 3, 5)]
    assert everything(engine, "SELECT 1 + 1, price + 1, qty + 1 FROM t") == [(10, 2, 3, 4)]
    assert everything(engine, "SELECT k AS id, SUM(qty) FROM t GROUP BY k") == [(10, 1, 3)]


def test_insert_forms(engine, spark):
    engine.execute("INSERT INTO t (qty, k) VALUES (1, 2), (3, 4)")
    engine.insert("t", pd.DataFrame({"ts": [5], "k": [1], "p": [2], "qty": [3]}), {"price": "p"})
    engine.insert("t", spark.createDataFrame([(7, 1.0, 2.0, 3.0)], "time long, k double, price double, qty double"))
    engine.insert("t", [{"timestamp": 6, "k": 1, "price": 2, "qty": 3}])
    assert engine.events("t").count() == 5
    assert engine.execute("SELECT k FROM t LIMIT 9").first()["time"] == 5
    seen = []
    engine.subscribe("t", seen.append)
    engine.insert("t", [(9, 1.0, 2.0, 3.0)])
    assert seen[0].count() == 1
    engine.configure_time_format("s")
    assert str(engine.execute("SELECT k FROM t LIMIT 9").first()["time"]).startswith("1970")


def test_explain_and_catalog(engine):
    fill(engine, TRADES)
    assert "Window" in engine.explain("SELECT k, SUM(qty) AS s FROM t GROUP BY k LIMIT 5")
    assert catalog_from_json('{"a": ["x", "y"], "b": {"columns": [{"name": "z"}]}}') == {"a": ("x", "y"), "b": ("z",)}


def test_spike_alert(engine):
    data = [20 + 2 * math.sin(2 * math.pi * i / 60) + 0.3 * math.sin(7.1 * i) for i in range(200)]
    data[80], data[130], data[170] = 35.0, 5.0, 38.0
    engine.insert("t", [(i, 1.0, v, 1.0) for i, v in enumerate(data)])
    found = everything(engine, "SELECT price FROM t WHERE ABS(price - MOVING_AVERAGE(price, 20)) > 3 * MOVING_STD(price, 20)")
    assert [r[0] for r in found] == [80, 130, 170]


def test_functions_of_spark_are_at_hand(engine, spark):
    spark.udf.register("twice", lambda x: x * 2, "double")
    fill(engine, [(1, 2, 3)])
    assert everything(engine, "SELECT TWICE(price) AS a, GREATEST(k, qty) AS b FROM t") == [(10, 4, 3)]


def test_graph_and_command_line(engine, spark, tmp_path, capsys):
    from tidemark.__main__ import main

    engine.execute("CREATE VIEW v AS SELECT k FROM t")
    assert "t --> v" in engine.show_graph()
    (tmp_path / "catalog.json").write_text('{"s": ["a", "b"]}')
    (tmp_path / "script.sql").write_text("INSERT INTO s VALUES (1, 2), (3, 4); SELECT a + b AS total FROM s WHERE b > 0 LIMIT 5")
    assert main(["--file", str(tmp_path / "script.sql"), "--catalog", str(tmp_path / "catalog.json"), "--format", "json"]) == 0
    assert '"total":3.0' in capsys.readouterr().out
    assert main(["SELECT a FROM nowhere LIMIT 1"]) == 1


def test_reads_by_time(engine):
    from tidemark.operators.keyed import between, latest, latest_before
    from tidemark.operators.windows import TS

    fill(engine, TRADES)
    events = engine.events("t")
    at = lambda df: sorted(r[TS] for r in df.collect())
    assert at(latest(events, 2)) == [50, 60] and at(latest_before(events, 35)) == [30]
    assert at(between(events, 20, 40)) == [20, 30, 40] and at(between(events, 20, 60, 2)) == [20, 30]


def test_files(spark, tmp_path):
    from tidemark.operators.windows import SEQ, TS
    from tidemark.sources.events import read_events, write_events

    df = spark.createDataFrame([(5, 1, 2.0), (6, 2, 3.0)], "time long, id long, x double")
    for kind, schema in (("parquet", None), ("csv", df.schema), ("json", df.schema), ("orc", None)):
        write_events(df, f"{tmp_path}/{kind}", kind)
        found = read_events(spark, f"{tmp_path}/{kind}", "time", ["id"], kind, schema)
        assert sorted((r[TS], r[SEQ], r["x"]) for r in found.collect()) == [(5, 1, 2.0), (6, 2, 3.0)]


def test_rows_given_one_by_one_become_files(spark, monkeypatch):
    monkeypatch.setattr("tidemark.engine.BUFFER_ROWS", 4)
    e = Engine(spark)
    e.execute("CREATE STREAM s (x DOUBLE)")
    e.execute("CREATE MATERIALIZED VIEW q AS SELECT SUM(x) AS t FROM s")
    for i in range(10):
        e.execute(f"INSERT INTO s VALUES ({i})")
    stream = e.catalog["s"]
    assert len(stream.rows.buffer) == 2 and stream.rows.folder
    assert [r[1] for r in rows(e.execute("SELECT x FROM s LIMIT 100").orderBy("time"))] == list(range(10))
    assert max(r[1] for r in rows(e.get_store("q"))) == 45
    # the plan does not grow with the rows
    assert e.explain("SELECT x FROM s LIMIT 1").count("Scan") <= 6
    e.clear("s")
    assert e.get_store("q").count() == 0


def test_views_are_kept_until_a_source_changes(spark):
    e = Engine(spark)
    e.execute("CREATE STREAM s (x DOUBLE)")
    e.insert("s", [(1, 1.0), (2, 2.0)])
    e.execute("CREATE MATERIALIZED VIEW q AS SELECT SUM(x) AS t FROM s")
    view = e.catalog["q"]
    assert e.execute("SELECT t FROM q").count() == 2 and view.kept is None
    assert e.execute("SELECT t FROM q").count() == 2 and view.kept is not None
    assert "InMemory" in e.explain("SELECT t FROM q")
    e.insert("s", [(3, 3.0)])
    assert view.kept is None
    assert [r[1] for r in rows(e.execute("SELECT t FROM q"))] == [1, 3, 6]


def test_watchers_of_views_get_new_rows(spark):
    e = Engine(spark)
    e.execute("CREATE STREAM s (x DOUBLE)")
    e.insert("s", [(1, 1.0)])
    e.execute("CREATE VIEW q AS SELECT SUM(x) AS t FROM s")
    e.execute("CREATE VIEW r AS SELECT t * 2 AS d FROM q")
    seen = []
    e.subscribe("r", lambda df: seen.append(rows(df)))
    e.insert("s", [(2, 2.0), (3, 3.0)])
    e.insert("s", [(4, 4.0)])
    assert [sorted(x) for x in seen] == [[(2, 6), (3, 12)], [(4, 20)]]


def test_what_there_is(spark):
    e = Engine(spark)
    e.script("CREATE STREAM s (k DOUBLE, x DOUBLE); CREATE TABLE w (k DOUBLE PRIMARY KEY, y DOUBLE); CREATE MATERIALIZED VIEW q AS SELECT k, SUM(x) AS t FROM s GROUP BY k")
    found = e.get_catalog()
    assert found["q"]["keys"] == ["k"] and found["q"]["columns"] == ["k", "t"] and found["w"]["key"] == "k" and found["s"]["kind"] == "stream"
    assert e.debug("SELECT k, t FROM q")["views"] == ["q"] and e.debug("SELECT k, t FROM q")["fields"]["t"] == 2
    assert "unknown source" in e.debug("SELECT * FROM nowhere")["errors"][0]
    again = Engine(spark)
    again.script(e.export())
    assert again.get_catalog() == found
    with pytest.raises(SqlError, match="no keys"):
        e.latest_per_key("s")
    with pytest.raises(SqlError, match="one shift"):
        e.execute("SELECT TIME_SHIFT(x, 1) AS a, TIME_SHIFT(x, 2) AS b FROM s LIMIT 1")


@pytest.mark.parametrize(("a", "b"), [([1, -0.5], [0.5]), ([2, 0.3, -0.7, 0.1], [0.2, 0.0, 0.4]), ([1.0], [0.5, 0.5]), ([1, -1.7, 0.8], [1])])
def test_recursive_filters_run_alike_in_blocks(a, b):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(500)
    x[300] = math.inf
    filter_ = Recurrence(a, b)
    found = np.concatenate([filter_(x[i : i + 130]) for i in range(0, 500, 130)])
    xs, ys = [0.0] * len(b), [0.0] * (len(a) - 1)
    for i, v in enumerate(x):
        xs = [v, *xs[:-1]]
        y = (sum(c * w for c, w in zip(b, xs, strict=True)) - sum(c * w for c, w in zip(a[1:], ys, strict=True))) / a[0]
        ys = [y, *ys][: len(a) - 1]
        assert found[i] == pytest.approx(y, rel=1e-9, abs=1e-12, nan_ok=True)


def test_recursive_filters_pass_over_nulls_and_keep_keys_apart(spark):
    df = spark.createDataFrame([(1, 1, "a", 1.0), (2, 2, "a", None), (3, 3, "b", 4.0), (4, 4, "a", 1.0), (5, 5, None, 2.0), (6, 6, None, float("nan"))], "_ts long, _seq long, k string, x double")
    found = {r["_ts"]: r["y"] for r in iir(df, "x", [1, -0.5], [0.5], ["k"], "y").collect()}
    assert [found[i] for i in (1, 2, 3, 4, 5)] == [0.5, None, 2.0, 0.75, 1.0] and math.isnan(found[6])


def test_the_module_has_an_engine_of_its_own(spark):
    import tidemark

    tidemark.reset()
    tidemark.execute("CREATE STREAM s (x DOUBLE)")
    assert tidemark.insert("s", [(1, 2.0), (2, 3.0)]) == 2
    assert rows(tidemark.execute("SELECT x FROM s LIMIT 1")) == [(2, 3)]
    with pytest.raises(SqlError, match="LIMIT"):
        tidemark.execute("SELECT MOVING_SUM(x, 2) AS m FROM s ORDER BY m")
    tidemark.reset()


TOTALS = "SELECT id, SUM(x) AS a, COUNT(*) AS n, AVG(x) AS m, MIN(x) AS lo, MAX(x) AS hi FROM t"


def test_totals_by_ranges_read_the_events_twice(spark):
    """However many totals: what is before a range is found for all at once."""
    e = Engine(spark, block_rows=50)
    df = spark.range(400).selectExpr("id DIV 3 AS ts", "id", "(id * 37 % 101) - 50.0D AS x")
    e.register("t", df, ts="ts", order=["id"])
    e.execute(f"CREATE VIEW v AS {TOTALS}")
    out = e.execute("SELECT * FROM v LIMIT 1000")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("Range (0, 400") <= 2
    total, lo, hi = 0.0, math.inf, -math.inf
    for n, r in enumerate(sorted(out.collect(), key=lambda r: r["id"])):
        x = n * 37 % 101 - 50.0
        total, lo, hi = total + x, min(lo, x), max(hi, x)
        assert (r["id"], r["a"], r["n"], r["lo"], r["hi"]) == (n, total, n + 1, lo, hi)
        assert r["m"] == pytest.approx(total / (n + 1))


@pytest.mark.parametrize("cuts", [[], [5.0], [1.0, 2.0, 4.0], [float(i) for i in range(0, 50, 2)]])
def test_place_among_cuts(spark, cuts):
    from tidemark.operators.blocks import place_of

    found = spark.range(60).select("id", place_of(F.col("id").cast("double"), cuts).alias("p")).collect()
    assert all(r["p"] == sum(c <= r["id"] for c in cuts) for r in found)


@pytest.mark.parametrize("block_rows", [2_000_000, 3])
def test_a_stream_with_itself_at_one_time(spark, block_rows):
    """Each event reaches both sides before the next of its time."""
    e = Engine(spark, block_rows=block_rows)
    df = spark.createDataFrame([(10, 1, 1.0), (10, 2, 5.0), (10, 3, 6.0), (20, 4, 9.0), (20, 5, 2.0)], "ts long, id long, x double")
    e.register("t", df, ts="ts", order=["id"])
    e.execute("CREATE VIEW v AS SELECT a.id AS id, a.x - b.x AS d FROM t a, t b")
    found = sorted((r["id"], r["d"]) for r in e.execute("SELECT * FROM v LIMIT 99").collect())
    assert found == [(1, 0.0), (2, 0.0), (2, 4.0), (3, 0.0), (3, 1.0), (4, 0.0), (4, 3.0), (5, -7.0), (5, 0.0)]


@pytest.mark.parametrize("block_rows", [2_000_000, 3])
def test_windows_over_streams_at_one_time(spark, block_rows):
    """Rows of one time go on in the order of the sources, not of the events."""
    e = Engine(spark, block_rows=block_rows)
    for name, rows_ in {"a": [(1, 1, 1.0), (5, 8, 2.0), (5, 9, 3.0)], "b": [(2, 2, 10.0), (5, 3, 20.0), (6, 4, 30.0)]}.items():
        e.register(name, spark.createDataFrame(rows_, "ts long, id long, x double"), ts="ts", order=["id"])
    e.execute("CREATE VIEW p AS SELECT a.x + b.x AS s FROM a, b")
    e.execute("CREATE VIEW v AS SELECT s, DIFFERENCE(s) AS d FROM p")
    assert sorted((r["s"], r["d"]) for r in e.execute("SELECT * FROM v LIMIT 99").collect()) == [(12.0, 1.0), (13.0, 1.0), (23.0, 10.0), (33.0, 10.0)]


@pytest.mark.parametrize(("n", "block_rows", "key"), [(17, 2_000_000, None), (20, 2_000_000, None), (20, 90, None), (20, 2_000_000, "k"), (20, 90, "k"), (45, 90, None), (300, 2_000_000, None)])
def test_quotients_by_a_deviation_are_the_sqls_in_constant_windows(spark, n, block_rows, key):
    """0 divides what rounding leaves there: NaN or which infinity."""
    duckdb = pytest.importorskip("duckdb")
    data = pd.DataFrame({"ts": range(1500), "id": range(1500), "k": [i % 7 // 5 for i in range(1500)]})
    data["x"], data["y"] = [0.1 + (i // 700) * 0.6 for i in range(1500)], [(i * i % 97) / 10 for i in range(1500)]
    e = Engine(spark, block_rows=block_rows, hot_keys=True)
    e.register("t", spark.createDataFrame(data), "ts", ["id"], ["id", "k", "x", "y"])
    rho = f"(MOVING_AVERAGE(x * y, {n}) - MOVING_AVERAGE(x, {n}) * MOVING_AVERAGE(y, {n})) / (MOVING_STD(x, {n}) * MOVING_STD(y, {n}))"
    found = {r[-2]: r[-1] for r in everything(e, f"SELECT {'k, ' if key else ''}id, {rho} AS rho FROM t {'GROUP BY k' if key else ''}")}
    sql = f"""SELECT id, (avg(x * y) OVER w - avg(x) OVER w * avg(y) OVER w) / (stddev_samp(x) OVER w * stddev_samp(y) OVER w) AS rho FROM data
      WINDOW w AS ({'PARTITION BY k' if key else ''} ORDER BY ts, id ROWS {n - 1} PRECEDING) QUALIFY count(*) OVER w = {n}"""
    expected = dict(duckdb.sql(sql).fetchall())
    assert {i: repr(round(v, 6)) for i, v in found.items()} == {i: repr(round(v, 6)) for i, v in expected.items()}
    assert len({repr(v) for v in expected.values() if not math.isfinite(v)}) > 1
