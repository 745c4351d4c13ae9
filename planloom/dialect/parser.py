"""Recursive descent over the tokens.

Operators have no precedence and are right-associative (1 - 2 - 3 is 1 - (2 - 3)); `and` binds loosest. A conjunction may
also stand in parentheses.
"""

from __future__ import annotations

import datetime

from planloom.dialect import syntax as S
from planloom.dialect.tokens import ParseError, Token, tokenize

OPERATORS = ("+", "-", "*", "/", "==", "=", "<>", "!=", "<=", ">=", "<", ">")


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def peek(self, kind: str, *values: str) -> bool:
        return self.now.kind == kind and (not values or self.now.value in values)

    def take(self, kind: str, *values: str) -> Token | None:
        if not self.peek(kind, *values):
            return None
        self.at += 1
        return self.tokens[self.at - 1]

    def need(self, kind: str, *values: str) -> Token:
        found = self.take(kind, *values)
        if not found:
            raise ParseError(f"expected {' or '.join(values) or kind}, found {self.now.value or 'the end'!r} at {self.now.at}")
        return found

    def listed(self, item) -> tuple:
        out = [item()]
        while self.take("symbol", ","):
            out.append(item())
        return tuple(out)

    def end(self, x):
        self.need("end")
        return x

    # queries

    def select(self) -> S.Select:
        self.need("keyword", "select")
        distinct = bool(self.take("keyword", "distinct"))
        targets = self.listed(self.target)
        sources = self.listed(self.source) if self.take("keyword", "from") else ()
        where = self.conjunction() if self.take("keyword", "where") else None
        groups = self.listed(self.expr) if self.pair("group") else ()
        having = self.conjunction() if self.take("keyword", "having") else None
        order = self.listed(self.sort_key) if self.pair("order") else ()
        limit = self.expr() if self.take("keyword", "limit") else None
        offset = self.expr() if limit is not None and self.take("keyword", "offset") else None
        if self.peek("keyword", "union"):
            raise ParseError("UNION is not supported")
        return S.Select(targets, sources, where, groups, having, order, limit, offset, distinct)

    def pair(self, first: str) -> bool:
        return bool(self.take("keyword", first) and self.need("keyword", "by"))

    def target(self) -> S.Target:
        if self.take("symbol", "*"):
            return S.Target(S.Star())
        if self.peek("name") and [t.value for t in self.tokens[self.at + 1 : self.at + 3]] == [".", "*"]:
            table = self.need("name").value
            self.at += 2
            return S.Target(S.Star(table))
        return S.Target(self.conjunction(), self.alias())

    def alias(self) -> str | None:
        return self.need("name").value if self.take("keyword", "as") else None

    def source(self):
        if self.take("symbol", "("):
            query = self.select()
            self.need("symbol", ")")
            return S.DerivedRef(query, self.alias())
        name = self.need("name").value
        if self.peek("symbol", "("):
            return S.FunctionRef(self.call(name), self.alias())
        return S.TableRef(name, self.alias() or name)

    def sort_key(self) -> S.SortKey:
        e = self.expr()
        order = self.take("keyword", "asc", "desc")
        return S.SortKey(e, not order or order.value == "asc")

    # expressions

    def conjunction(self) -> S.Expr:
        parts = [self.expr()]
        while self.take("keyword", "and"):
            parts.append(self.expr())
        return S.conjunction(parts)

    def expr(self) -> S.Expr:
        if (sign := self.take("symbol", "+", "-")) or (sign := self.take("keyword", "not")):
            return S.Unary(sign.value, self.expr())
        left = self.value()
        if self.take("keyword", "between"):
            low = self.value()
            self.need("keyword", "and")
            return S.Between(left, low, self.value())
        if self.take("keyword", "in"):
            self.need("symbol", "(")
            if self.peek("keyword", "select"):
                raise ParseError("IN (SELECT ...) is not supported")
            items = self.listed(self.expr)
            self.need("symbol", ")")
            return S.InList(left, items)
        op = self.take("symbol", *OPERATORS) or self.take("keyword", "or", "like")
        if not op:
            return left
        spelled = {"==": "=", "!=": "<>"}.get(op.value, op.value)
        return S.Binary(spelled, left, self.expr())

    def value(self) -> S.Expr:
        if self.take("symbol", "("):
            inner = S.Subquery(self.select()) if self.peek("keyword", "select") else self.conjunction()
            self.need("symbol", ")")
            return inner
        if t := self.take("number"):
            return S.Number(float(t.value) if "." in t.value or int(t.value) < 1 << 53 else int(t.value))
        if t := self.take("string"):
            return S.Text(t.value)
        if t := self.take("keyword", "true", "false"):
            return S.Boolean(t.value == "true")
        if self.take("keyword", "date"):
            t = self.need("string")
            try:
                return S.Date(datetime.date.fromisoformat(t.value))
            except ValueError:
                raise ParseError(f"not a date: {t.value!r}") from None
        name = self.need("name").value
        if self.peek("symbol", "("):
            return self.call(name)
        if self.take("symbol", "."):
            return S.Column(self.need("name").value, name)
        return S.Column(name)

    def call(self, name: str) -> S.Call:
        self.need("symbol", "(")
        args = () if self.peek("symbol", ")") else self.listed(self.expr)
        self.need("symbol", ")")
        return S.Call(name, args)


def parse(text: str) -> S.Select:
    p = _Parser(text)
    return p.end(p.select())


def parse_expression(text: str) -> S.Expr:
    """A condition or expression on its own, for plans built by hand."""
    p = _Parser(text)
    return p.end(p.conjunction())
