"""Parser of the dialect: one statement to its syntax tree."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tidemark.errors import SqlError
from tidemark.plans import ast as A

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      |(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
      |(?P<name>[A-Za-z_][A-Za-z_0-9$]*)
      |(?P<quoted>"(?:[^"]|"")+")
      |(?P<string>'(?:[^']|'')*')
      |(?P<op><>|<=|>=|!=|\|\||[-+*/%<>=(),.;\[\]])""",
    re.VERBOSE | re.DOTALL,
)
#: Words that end an unquoted alias.
_RESERVED = frozenset("from where group having order limit join inner left right full on as and or not between in is case when then else end union intersect except offset cross using window asc desc by".split())
_COMPARE = {"=", "<>", "!=", "<", "<=", ">", ">="}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int

    @property
    def word(self) -> str:
        return self.text.lower() if self.kind == "name" else ""


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SqlError(f"unexpected character {sql[at]!r}", at)
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup or "", m[0], at))
        at = m.end()
    out.append(Token("end", "", len(sql)))
    return out


def parse(sql: str) -> object:
    """The syntax tree of one statement; more than one is an error."""
    return _Parser(sql).statement()


def parse_many(sql: str) -> list[object]:
    """The statements of a script."""
    parser, out = _Parser(sql), []
    while parser.now.kind != "end":
        if not parser.take_op(";"):
            out.append(parser.one())
    return out


def validate(sql: str) -> str | None:
    """What is wrong with the syntax, or None."""
    try:
        parse_many(sql)
    except SqlError as e:
        return str(e)
    return None


class _Parser:
    def __init__(self, sql: str) -> None:
        self.sql, self.all, self.i = sql, tokens(sql), 0

    @property
    def now(self) -> Token:
        return self.all[self.i]

    def fail(self, what: str) -> SqlError:
        return SqlError(f"{what} at {self.now.text!r}" if self.now.text else f"{what} at the end", self.now.at)

    def peek(self, n: int = 1) -> Token:
        return self.all[min(self.i + n, len(self.all) - 1)]

    def take(self, *words: str) -> bool:
        """Takes the words if they come next."""
        if all(self.peek(k).word == w for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise self.fail(f"expected {' '.join(words).upper()}")

    def take_op(self, op: str) -> bool:
        if self.now.kind == "op" and self.now.text == op:
            self.i += 1
            return True
        return False

    def need_op(self, op: str) -> None:
        if not self.take_op(op):
            raise self.fail(f"expected {op}")

    def name(self) -> str:
        t = self.now
        if t.kind == "name":
            self.i += 1
            return t.text
        if t.kind == "quoted":
            self.i += 1
            return t.text[1:-1].replace('""', '"')
        raise self.fail("expected a name")

    def list_of(self, one) -> tuple:
        out = [one()]
        while self.take_op(","):
            out.append(one())
        return tuple(out)

    def statement(self) -> object:
        out = self.one()
        self.take_op(";")
        if self.now.kind != "end":
            raise self.fail("one statement only; unexpected input")
        return out

    def one(self) -> object:
        if self.take("create"):
            return self.create()
        if self.take("insert", "into"):
            return self.insert()
        if self.take("delete", "from"):
            return self.delete()
        if self.take("drop"):
            return self.drop()
        if self.take("explain"):
            return A.Explain(self.select())
        if self.now.word == "select":
            return self.select()
        if self.now.word == "with":
            raise self.fail("WITH is not supported")
        raise self.fail("expected a statement")

    def create(self) -> object:
        if self.take("materialized", "view") or self.take("view"):
            materialized = self.peek(-2).word == "materialized" if self.i >= 2 else False
            name = self.name()
            self.need("as")
            start = self.now.at
            select = self.select()
            return A.CreateView(name, select, materialized, self.sql[start : self.now.at].strip().rstrip(";"))
        table = self.take("table")
        if not table:
            self.need("stream")
        name = self.name()
        self.need_op("(")
        columns: list[str] = []
        keys: list[str] = []

        def column() -> None:
            if self.take("primary", "key"):
                self.need_op("(")
                keys.extend(self.list_of(self.name))
                self.need_op(")")
                return
            columns.append(self.name())
            while self.now.kind == "name":
                if self.take("primary", "key"):
                    keys.append(columns[-1])
                else:
                    self.i += 1
                    if self.take_op("("):
                        while not self.take_op(")"):
                            self.i += 1

        self.list_of(column)
        self.need_op(")")
        return A.CreateStream(name, tuple(columns), tuple(keys), table)

    def insert(self) -> A.Insert:
        name = self.name()
        columns: tuple[str, ...] = ()
        if self.take_op("("):
            columns = self.list_of(self.name)
            self.need_op(")")
        self.need("values")

        def row() -> tuple:
            self.need_op("(")
            out = self.list_of(self.expression)
            self.need_op(")")
            return out

        return A.Insert(name, columns, self.list_of(row))

    def delete(self) -> A.Delete:
        name = self.name()
        self.need("where")
        where = self.expression()
        if isinstance(where, A.Binary) and where.op == "=":
            for a, b in ((where.left, where.right), (where.right, where.left)):
                if isinstance(a, A.Col) and not isinstance(b, A.Col):
                    return A.Delete(name, a.name, b)
        raise self.fail("DELETE takes WHERE key = constant; unexpected input")

    def drop(self) -> A.Drop:
        if self.take("materialized", "view"):
            kind = "materialized view"
        else:
            kind = self.name().lower()
            if kind not in ("stream", "table", "view"):
                raise self.fail("expected STREAM, TABLE, VIEW or MATERIALIZED VIEW before")
        exists = self.take("if", "exists")
        return A.Drop(kind, self.name(), exists)

    def select(self) -> A.Select:
        self.need("select")
        if self.take("distinct"):
            raise self.fail("DISTINCT is not supported")
        items = self.list_of(self.item)
        if not self.take("from"):
            return self.tail(A.Select(items, ()))
        sources = [self.source()]
        joins: list[A.Join] = []
        while True:
            if self.take_op(","):
                if joins:
                    raise self.fail("a source list cannot follow JOIN")
                sources.append(self.source())
            elif (kind := self.join_kind()) is not None:
                joins.append(self.join(kind))
            else:
                break
        return self.tail(A.Select(items, tuple(sources), tuple(joins)))

    def join_kind(self) -> str | None:
        if self.take("join") or self.take("inner", "join"):
            return "inner"
        if self.take("left", "join") or self.take("left", "outer", "join"):
            return "left"
        if self.now.word in ("right", "full", "cross"):
            raise self.fail(f"{self.now.text.upper()} JOIN is not supported")
        return None

    def join(self, kind: str) -> A.Join:
        source = self.source()
        self.need("on")
        on = self.expression()
        if not (isinstance(on, A.Binary) and on.op == "=" and isinstance(on.left, A.Col) and isinstance(on.right, A.Col)):
            raise self.fail("JOIN takes ON column = column; unexpected input")
        left, right = on.left, on.right
        if left.table == source.label or (right.table is not None and right.table != source.label):
            left, right = right, left
        return A.Join(source, left, right, kind)

    def source(self) -> A.Source:
        name = self.name()
        if self.take("as"):
            return A.Source(name, self.name())
        if self.now.kind in ("name", "quoted") and self.now.word not in _RESERVED:
            return A.Source(name, self.name())
        return A.Source(name)

    def tail(self, s: A.Select) -> A.Select:
        where = self.expression() if self.take("where") else None
        group = self.list_of(self.expression) if self.take("group", "by") else ()
        having = self.expression() if self.take("having") else None
        if having is not None and not group:
            raise self.fail("HAVING needs GROUP BY; unexpected input")
        order = self.list_of(self.order) if self.take("order", "by") else ()
        limit = None
        if self.take("limit"):
            t = self.now
            if t.kind != "number" or not t.text.isdigit():
                raise self.fail("LIMIT takes an integer")
            self.i += 1
            limit = int(t.text)
        for word in ("offset", "union", "intersect", "except", "window", "qualify"):
            if self.now.word == word:
                raise self.fail(f"{word.upper()} is not supported")
        return A.Select(s.items, s.sources, s.joins, where, group, having, order, limit)

    def order(self) -> A.Order:
        e = self.expression()
        return A.Order(e, self.take("desc") or (self.take("asc") and False))

    def item(self) -> A.Item:
        if self.take_op("*"):
            return A.Item(A.Star())
        e = self.expression()
        if self.take("as"):
            return A.Item(e, self.name())
        if self.now.kind in ("name", "quoted") and self.now.word not in _RESERVED:
            return A.Item(e, self.name())
        return A.Item(e)

    # expressions, from the loosest to the tightest binding

    def expression(self) -> A.Expr:
        left = self.conjunction()
        while self.take("or"):
            left = A.Binary("or", left, self.conjunction())
        return left

    def conjunction(self) -> A.Expr:
        left = self.negation()
        while self.take("and"):
            left = A.Binary("and", left, self.negation())
        return left

    def negation(self) -> A.Expr:
        return A.Unary("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self) -> A.Expr:
        left = self.sum()
        while True:
            if self.now.kind == "op" and self.now.text in _COMPARE:
                op = "<>" if self.now.text == "!=" else self.now.text
                self.i += 1
                left = A.Binary(op, left, self.sum())
            elif self.take("is"):
                negated = self.take("not")
                self.need("null")
                left = A.IsNull(left, negated)
            else:
                negated = self.now.word == "not" and self.peek().word in ("between", "in")
                self.i += negated
                if self.take("between"):
                    low = self.sum()
                    self.need("and")
                    left = A.Between(left, low, self.sum(), negated)
                elif self.take("in"):
                    self.need_op("(")
                    left = A.InList(left, self.list_of(self.expression), negated)
                    self.need_op(")")
                elif self.now.word in ("like", "ilike", "similar"):
                    raise self.fail(f"{self.now.text.upper()} is not supported")
                else:
                    return left

    def sum(self) -> A.Expr:
        left = self.product()
        while self.now.kind == "op" and self.now.text in "+-":
            op = self.now.text
            self.i += 1
            left = A.Binary(op, left, self.product())
        return left

    def product(self) -> A.Expr:
        left = self.unary()
        while self.now.kind == "op" and self.now.text in "*/%":
            op = self.now.text
            self.i += 1
            left = A.Binary(op, left, self.unary())
        return left

    def unary(self) -> A.Expr:
        if self.take_op("-"):
            e = self.unary()
            return A.Num(-e.value) if isinstance(e, A.Num) else A.Unary("-", e)
        if self.take_op("+"):
            return self.unary()
        return self.primary()

    def primary(self) -> A.Expr:
        t = self.now
        if t.kind == "number":
            self.i += 1
            return A.Num(float(t.text))
        if t.kind == "string":
            self.i += 1
            return A.Str(t.text[1:-1].replace("''", "'"))
        if self.take_op("("):
            e = self.expression()
            self.need_op(")")
            return e
        if t.word in ("true", "false"):
            self.i += 1
            return A.Num(float(t.word == "true"))
        if self.take("null"):
            return A.Null()
        if self.take("case"):
            return self.case()
        if t.word == "cast" and self.peek().text == "(":
            self.i += 2
            e = self.expression()
            self.need("as")
            kind = self.name()
            self.need_op(")")
            return A.Cast(e, kind.lower())
        if t.word == "array" and self.peek().text == "[":
            self.i += 2
            items = self.list_of(self.expression)
            self.need_op("]")
            return A.Array(items)
        if t.kind in ("name", "quoted") and t.word not in _RESERVED:
            name = self.name()
            if self.take_op("("):
                return self.call(name)
            if self.take_op("."):
                return A.Col(self.name(), name)
            return A.Col(name)
        raise self.fail("expected an expression")

    def call(self, name: str) -> A.Expr:
        args: tuple[A.Expr, ...] = ()
        if self.take_op("*"):
            args = (A.Star(),)
        elif not (self.now.kind == "op" and self.now.text == ")"):
            if self.now.word == "distinct":
                raise self.fail("DISTINCT is not supported")
            args = self.list_of(self.expression)
        self.need_op(")")
        if self.now.word in ("over", "filter"):
            raise self.fail(f"{self.now.text.upper()} is not supported")
        return A.Call(name.upper(), args)

    def case(self) -> A.Case:
        operand = None if self.now.word == "when" else self.expression()
        whens: list[tuple[A.Expr, A.Expr]] = []
        while self.take("when"):
            test = self.expression()
            self.need("then")
            whens.append((test if operand is None else A.Binary("=", operand, test), self.expression()))
        if not whens:
            raise self.fail("CASE without WHEN")
        default = self.expression() if self.take("else") else None
        self.need("end")
        return A.Case(tuple(whens), default)
