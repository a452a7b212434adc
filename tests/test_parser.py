from __future__ import annotations

import pytest

from tidemark.errors import SqlError
from tidemark.plans import ast as A
from tidemark.plans.parser import parse, parse_many, validate


def test_select():
    s = parse("SELECT k, SUM(x) AS total FROM s WHERE x > 1 AND NOT y = 2 GROUP BY k HAVING total > 3 ORDER BY total DESC LIMIT 5;")
    assert s.items[1] == A.Item(A.Call("SUM", (A.Col("x"),)), "total")
    assert s.limit == 5 and s.order_by == (A.Order(A.Col("total"), True),)
    assert s.where == A.Binary("and", A.Binary(">", A.Col("x"), A.Num(1.0)), A.Unary("not", A.Binary("=", A.Col("y"), A.Num(2.0))))


def test_precedence():
    e = parse("SELECT 1 + 2 * -x FROM s LIMIT 1").items[0].expr
    assert e == A.Binary("+", A.Num(1.0), A.Binary("*", A.Num(2.0), A.Unary("-", A.Col("x"))))


def test_simple_case_keeps_its_operand():
    e = parse("SELECT CASE k WHEN 1 THEN 2 END FROM s LIMIT 1").items[0].expr
    assert e.whens[0][0] == A.Binary("=", A.Col("k"), A.Num(1.0))


def test_ddl():
    assert parse("CREATE TABLE t (k DOUBLE PRECISION PRIMARY KEY, v DOUBLE PRECISION)") == A.CreateStream("t", ("k", "v"), ("k",), True)
    assert parse("CREATE STREAM s (a DOUBLE, b NUMERIC(10, 2))").columns == ("a", "b")
    assert parse("CREATE MATERIALIZED VIEW v AS SELECT a FROM s").materialized
    assert not parse("CREATE VIEW v AS SELECT a FROM s").materialized
    assert parse("DROP MATERIALIZED VIEW IF EXISTS v") == A.Drop("materialized view", "v", True)
    assert parse("DELETE FROM t WHERE 3 = k") == A.Delete("t", "k", A.Num(3.0))
    assert len(parse("INSERT INTO s (b, a) VALUES (1, 2), (3, 4)").rows) == 2


@pytest.mark.parametrize("sql", [
    "SELECT DISTINCT a FROM s", "SELECT a FROM s OFFSET 1", "WITH x AS (SELECT 1) SELECT 1", "SELECT SUM(a) OVER () FROM s", "SELECT a FROM s HAVING a > 1",
    "SELECT a FROM s UNION SELECT b FROM s", "SELECT a FROM s LIMIT x", "SELECT a FROM s; SELECT b FROM s", "SELECT a FROM s RIGHT JOIN t ON s.a = t.a",
    "SELECT a LIKE 'x' FROM s", "", "SELECT", "CREATE STREAM s", "SELECT a FROM s WHERE", "SELECT 'a", "DELETE FROM t",
])
def test_refused(sql):
    with pytest.raises(SqlError):
        parse(sql)


def test_validate_and_many():
    assert validate("SELECT a FROM s LIMIT 1; SELECT b FROM s LIMIT 2") is None
    assert "position" in validate("SELECT ? FROM s")
    assert len(parse_many("SELECT 1; SELECT 2")) == 2
