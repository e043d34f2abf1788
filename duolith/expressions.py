"""The query language: trees of literals, their text form, and Spark columns.

A query is a tree of groups (all of, any of) over literals on the columns of
one side. Missing values follow Kleene's logic, which is SQL's: a literal on a
missing value is neither true nor false, and negation leaves it so.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import reduce
from itertools import product
from typing import Union

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = math.inf


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Bool:
    var: str
    neg: bool = False


@dataclass(frozen=True)
class Cat:
    var: str
    values: tuple[str, ...]
    neg: bool = False

    def __post_init__(self):
        object.__setattr__(self, "values", tuple(sorted(set(self.values))))
        if not self.values:
            raise QueryError(f"no category for {self.var}")


@dataclass(frozen=True)
class Num:
    """Closed interval; one of the bounds may be infinite."""

    var: str
    low: float = -INF
    high: float = INF
    neg: bool = False
    time: bool = False

    def __post_init__(self):
        if self.low > self.high or (self.low == -INF and self.high == INF):
            raise QueryError(f"empty or unbounded interval for {self.var}")


@dataclass(frozen=True)
class Const:
    value: bool
    neg: bool = False


@dataclass(frozen=True)
class Anon:
    """A place for a literal on a variable, to be filled in."""

    var: str
    neg: bool = False


@dataclass(frozen=True)
class Expr:
    """A derived Boolean or numeric column, as a Spark SQL expression over row columns; only functions in ALLOWED."""

    var: str
    sql: str
    neg: bool = False


Literal = Union[Bool, Cat, Num, Const, Anon, Expr]
LITERALS = (Bool, Cat, Num, Const, Anon, Expr)


@dataclass(frozen=True)
class Group:
    op: str  #: "and" or "or"
    items: tuple["Node", ...] = field(default=())
    neg: bool = False


Node = Union[Literal, Group]
TRUE = Group("and")


def other(op: str) -> str:
    return "or" if op == "and" else "and"


# Text form.
_TOKEN = re.compile(r"\s*(?:(!=|!!+|[()\[\]{},&|<>=!?]|[∧∨≤≥∈∉≠¬])|(@[^<>=!\[\](){}&|,\n\t∧∨≤≥∈∉≠¬]+)|([^<>=!\[\](){}?&|,\n\t∧∨≤≥∈∉≠¬]+))")
_NUMBER = re.compile(r"[+-]?\d+\.?\d*([Ee][-+]?\d+)?")
_OPS = {"∧": "&", "∨": "|", "≤": "<", "≥": ">", "∈": "=", "≠": "!=", "∉": "!=", "¬": "!"}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"can't read {text[at:]!r}")
        at = m.end()
        if m[1]:
            out.append(("bangs" if m[1].startswith("!!") else "op", _OPS.get(m[1], m[1])))
        elif m[2]:
            out.append(("time", m[2][1:].strip()))
        elif word := m[3].strip():
            out.append(("number" if _NUMBER.fullmatch(word) else "word", word))
    return out


def seconds(text: str) -> float:
    """A time in ISO form or parts of it, UTC, as seconds."""
    for form in ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y-%m", "%Y", "%Y/%m/%d", "%d/%m/%Y"):
        try:
            return datetime.strptime(text, form).replace(tzinfo=timezone.utc).timestamp()
        except ValueError:
            continue
    raise QueryError(f"not a time: {text}")


class _Parser:
    def __init__(self, text: str):
        self.left = tokens(text)

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.left[k] if k < len(self.left) else ("end", "")

    def take(self, *ops: str) -> str | None:
        kind, value = self.peek()
        if kind == "op" and value in ops:
            self.left.pop(0)
            return value
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise QueryError(f"expected {op!r} before {self.peek()[1]!r}")

    def group(self) -> Node:
        items, op = [self.item()], None
        while sign := self.take("&", "|"):
            now = "and" if sign == "&" else "or"
            if op not in (None, now):
                raise QueryError("and and or on one level need parentheses")
            op = now
            items.append(self.item())
        return Group(op, tuple(items)) if op else items[0]

    def item(self) -> Node:
        if self.peek()[0] == "bangs":
            return Const(len(self.left.pop(0)[1]) % 2 == 0)
        neg = bool(self.take("!"))
        if self.take("("):
            inner = self.group()
            self.need(")")
        elif self.take("["):
            inner = self.literal()
            self.need("]")
        else:
            inner = self.literal()
        return replace(inner, neg=inner.neg != neg)

    def value(self) -> tuple[float, bool]:
        kind, text = self.left.pop(0) if self.left else ("end", "")
        if kind == "number":
            return float(text), False
        if kind == "time":
            return seconds(text), True
        raise QueryError(f"expected a number or a time, not {text!r}")

    def word(self) -> str:
        kind, text = self.left.pop(0) if self.left else ("end", "")
        if kind != "word":
            raise QueryError(f"expected a name, not {text!r}")
        return text

    def literal(self) -> Literal:
        if self.take("?"):
            return Anon(self.word())
        if self.peek()[0] in ("number", "time"):
            bound, time = self.value()
            sign = self.take("<", ">") or self.need("<")
            var = self.word()
            last = self.value() if self.take(sign) else (INF if sign == "<" else -INF, time)
            low, high = (bound, last[0]) if sign == "<" else (last[0], bound)
            return Num(var, low, high, time=time or last[1])
        var = self.word()
        if sign := self.take("<", ">"):
            bound, time = self.value()
            return Num(var, -INF, bound, time=time) if sign == "<" else Num(var, bound, INF, time=time)
        if sign := self.take("=", "!="):
            if self.take("{"):
                values = [self.left.pop(0)[1]]
                while self.take(","):
                    values.append(self.left.pop(0)[1])
                self.need("}")
            else:
                values = [self.left.pop(0)[1] if self.peek()[0] in ("word", "number") else self.word()]
            return Cat(var, tuple(values), sign == "!=")
        return Bool(var)


def parse(text: str) -> Node:
    """A query from its text form; the empty text is always true."""
    if not text.strip():
        return TRUE
    p = _Parser(text)
    out = p.group()
    if p.left:
        raise QueryError(f"left over: {p.peek()[1]!r}")
    return out


def parse_many(text: str) -> list[Node]:
    return [parse(line) for line in text.splitlines() if line.strip()]


STYLES = {
    "text": {"and": " & ", "or": " | ", "not": "!", "le": "<", "in": "=", "nin": "!="},
    "unicode": {"and": " ∧ ", "or": " ∨ ", "not": "¬", "le": "≤", "in": "∈", "nin": "∉"},
    "tex": {"and": r" \land ", "or": r" \lor ", "not": r"\neg ", "le": r" \leq ", "in": r" \in ", "nin": r" \not\in "},
}


def show(node: Node, style: str = "text", names: dict[str, str] | None = None, digits: int | None = None) -> str:
    s, name = STYLES[style], lambda v: (names or {}).get(v, v)

    def number(v: float, time: bool) -> str:
        if time:
            return "@" + datetime.fromtimestamp(v, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        return f"{round(v, digits) if digits is not None else v:.15g}"

    def go(n: Node, top: bool) -> str:
        no = s["not"] if n.neg else ""
        if isinstance(n, Group):
            inner = s[n.op].join(go(x, False) for x in n.items)
            return f"{no}({inner})" if n.neg or (not top and len(n.items) != 1) else inner
        if isinstance(n, Num):
            low = number(n.low, n.time) + s["le"] if n.low > -INF else ""
            high = s["le"] + number(n.high, n.time) if n.high < INF else ""
            return f"{no}[{low}{name(n.var)}{high}]"
        if isinstance(n, Cat):
            values = n.values[0] if len(n.values) == 1 else "{" + ",".join(n.values) + "}"
            return f"[{name(n.var)}{s['nin'] if n.neg else s['in']}{values}]"
        if isinstance(n, Const):
            return "!!" if n.value != n.neg else "!!!"
        return f"{no}{'?' if isinstance(n, Anon) else ''}{name(n.var)}"

    return go(node, True)


# Trees.
def literals(node: Node) -> Iterator[Literal]:
    if isinstance(node, Group):
        for x in node.items:
            yield from literals(x)
    else:
        yield node


def variables(node: Node) -> set[str]:
    return {x.var for x in literals(node) if not isinstance(x, Const)}


def length(node: Node) -> int:
    return sum(1 for _ in literals(node))


def push_negation(node: Node, flip: bool = False) -> Node:
    """Negation at the literals alone, by De Morgan's laws; groups of one and groups inside groups of the same kind are dissolved."""
    if not isinstance(node, Group):
        return replace(node, neg=node.neg != flip)
    flip = node.neg != flip
    op = other(node.op) if flip else node.op
    items: list[Node] = []
    for x in (push_negation(x, flip) for x in node.items):
        items += x.items if isinstance(x, Group) and x.op == op and x.items else [x]
    return items[0] if len(items) == 1 else Group(op, tuple(items))


unfold = push_negation


def extend(node: Node, op: str, literal: Node) -> Node:
    """node op literal: the same operator appends, the other one wraps the whole query."""
    if isinstance(node, Group) and not node.items:
        return literal
    if isinstance(node, Group) and node.op == op and not node.neg:
        return replace(node, items=(*node.items, literal))
    return Group(op, (node, literal))


append_group = extend


def map_literals(node: Node, fn: Callable[[Literal], Node | None]) -> Node | None:
    """The tree with each literal replaced, or left out where fn gives None."""
    if not isinstance(node, Group):
        return fn(node)
    items = tuple(x for x in (map_literals(x, fn) for x in node.items) if x is not None)
    if not items:
        return None
    return items[0] if len(items) == 1 and not node.neg else replace(node, items=items)


def without(node: Node, k: int) -> Node:
    """The query without its k-th literal."""
    n = iter(range(length(node)))
    return map_literals(node, lambda x: None if next(n) == k else x) or TRUE


def minus_one(node: Node) -> list[Node]:
    return [without(node, k) for k in range(length(node))] if length(node) > 1 else []


def minus_anon(node: Node, keep: str | None = None) -> Node:
    """Without anonymous literals, but for those on `keep`."""
    return map_literals(node, lambda x: None if isinstance(x, Anon) and x.var != keep else x) or TRUE


def fill(node: Node, var: str, literal: Literal) -> Node:
    return map_literals(node, lambda x: literal if isinstance(x, Anon) and x.var == var else x)


def context(node: Node, k: int) -> tuple[str | None, list[Node], list[Node]]:
    """The operator over the k-th literal, and what stands beside it and its groups: in conjunctions, in disjunctions."""
    found: dict[str, list[Node]] = {"and": [], "or": []}

    def go(n: Node, at: int) -> str | None:
        for x in n.items:
            size = length(x)
            if at < size:
                found[n.op] += [y for y in n.items if y is not x]
                return go(x, at) if isinstance(x, Group) else n.op
            at -= size
        return None

    node = push_negation(node)
    return (go(node, k) if isinstance(node, Group) else None), found["and"], found["or"]


def literal_key(x: Literal) -> tuple:
    kind = LITERALS.index(type(x))
    return (getattr(x, "var", ""), kind, x.neg, *({Cat: lambda: x.values, Num: lambda: (x.low, x.high), Const: lambda: (x.value,), Expr: lambda: (x.sql,)}.get(type(x), tuple)()))


def ordered(node: Node) -> Node:
    """The same query in canonical order, for comparison: literals by key, then groups; repeated items once."""
    node = push_negation(node)
    if not isinstance(node, Group):
        return node
    items = sorted({show(x): x for x in map(ordered, node.items)}.values(), key=lambda x: (isinstance(x, Group), length(x), literal_key(x) if not isinstance(x, Group) else (), show(x)))
    return items[0] if len(items) == 1 else Group(node.op, tuple(items))


def sort_key(node: Node) -> tuple:
    """Shorter queries first, then those of fewer groups, conjunctions, and by their text."""
    groups = lambda n: 1 + sum(map(groups, n.items)) if isinstance(n, Group) else 0
    return (length(node), groups(node), isinstance(node, Group) and node.op == "or", sorted(variables(node)), show(ordered(node)))


# Truth tables.
def truth(node: Node, values: dict[Literal, bool | None]) -> bool | None:
    """Kleene's logic; values: of the plain literals."""
    if isinstance(node, Const):
        return node.value != node.neg
    if not isinstance(node, Group):
        v = values[replace(node, neg=False)]
        return None if v is None else v != node.neg
    vs = [truth(x, values) for x in node.items]
    stop = node.op == "or"
    v = stop if stop in vs else (None if None in vs else not stop)
    return None if v is None else v != node.neg


def plain_literals(node: Node) -> list[Literal]:
    return list(dict.fromkeys(replace(x, neg=False) for x in literals(node) if not isinstance(x, Const)))


def truth_table(node: Node) -> list[tuple[tuple[bool, ...], bool]]:
    lits = plain_literals(node)
    return [(row, truth(node, dict(zip(lits, row)))) for row in product([False, True], repeat=len(lits))]


def implicants(rows: set[tuple], width: int) -> list[tuple]:
    """A small cover of the rows by prime implicants; None in an implicant stands for either value."""
    primes, now = set(), set(rows)
    while now:
        merged, used = set(), set()
        for a in now:
            for i in range(width):
                if a[i] is not None and (b := (*a[:i], not a[i], *a[i + 1 :])) in now:
                    merged.add((*a[:i], None, *a[i + 1 :]))
                    used |= {a, b}
        primes |= now - used
        now = merged
    covers = {p: {r for r in rows if all(x is None or x == y for x, y in zip(p, r))} for p in primes}
    left, out = set(rows), []
    while left:
        best = max(covers, key=lambda p: (len(covers[p] & left), sum(x is None for x in p), str(p)))
        out.append(best)
        left -= covers[best]
    return out


def simplified(node: Node) -> Node:
    """The query by absorption, without a truth table: what a sibling implies goes, and so does in a group what a sibling literal rules out.
    It isn't always the shortest form."""
    node = ordered(node)
    while isinstance(node, Group):
        lone = [x for x in node.items if not isinstance(x, Group)]
        if any(replace(x, neg=not x.neg) in lone for x in lone):
            return Const(node.op == "or")
        items = []
        for x in map(simplified, node.items):
            if isinstance(x, Group):
                left = tuple(y for y in x.items if isinstance(y, Group) or replace(y, neg=not y.neg) not in lone)
                x = Group(x.op, left) if left else Const(node.op == "or")
            items.append(x)
        if any(isinstance(x, Const) for x in items):
            stop = node.op == "or"
            if any(isinstance(x, Const) and (x.value != x.neg) == stop for x in items):
                return Const(stop)
            items = [x for x in items if not isinstance(x, Const)]
            if not items:
                return Const(not stop)
        parts = [frozenset(x.items) if isinstance(x, Group) and x.op != node.op else frozenset({x}) for x in items]
        kept = [x for i, x in enumerate(items) if not any(parts[j] < parts[i] or (parts[j] == parts[i] and j < i) for j in range(len(items)) if j != i)]
        new = ordered(Group(node.op, tuple(kept)))
        if new == node:
            break
        node = new
    return node


def normalize(node: Node, most: int = 10) -> Node:
    """The shortest of the query and of its minimal forms as an or of ands and as an and of ors. The truth table of a query has 2 ** literals
    rows; one of more than `most` literals is simplified by absorption alone."""
    lits = plain_literals(node)
    plain = ordered(node)
    if not lits:
        return plain
    if len(lits) > most:
        return min(simplified(plain), plain, key=sort_key)
    table = truth_table(node)
    forms = []
    for wanted, inner in ((True, "and"), (False, "or")):
        rows = {r for r, v in table if v is wanted}
        if not rows:
            return Const(not wanted)
        terms = [[replace(lits[i], neg=(not x) == wanted) for i, x in enumerate(p) if x is not None] for p in implicants(rows, len(lits))]
        forms.append(ordered(Group(other(inner), tuple(Group(inner, tuple(t)) for t in terms))))
    return min([*forms, plain], key=sort_key)


def branches(node: Node) -> list[list[Literal]]:
    """The query as a tree's branches: conjunctions of which one holds."""
    node = push_negation(node)
    if not isinstance(node, Group):
        return [[node]]
    parts = [branches(x) for x in node.items]
    if node.op == "or":
        return [b for p in parts for b in p]
    return [[x for b in choice for x in b] for choice in product(*parts)]


# Spark.
ALLOWED = frozenset("abs ceil floor round sqrt exp ln log10 pow least greatest coalesce nullif if isnull isnotnull length lower upper substr trim year month day hour minute cast double int and or not is null in between case when then else end true false as like".split())


def checked_expression(sql: str, columns: set[str]) -> str:
    """sql, if it has only columns, numbers, strings, operators and allowed functions."""
    bare = re.sub(r"'[^']*'", " ", sql)
    unknown = [w for w in re.findall(r"[A-Za-z_]\w*", bare) if w not in columns and w.lower() not in ALLOWED]
    if unknown or re.search(r"[;`\"\\]|--|/\*", bare):
        raise QueryError(f"not allowed in an expression: {unknown or sql}")
    return sql


def literal_column(x: Literal) -> Column:
    if isinstance(x, Const):
        return F.lit(x.value != x.neg)
    if isinstance(x, Anon):
        raise QueryError(f"?{x.var} is still to be filled in")
    c = F.expr(x.sql) if isinstance(x, Expr) else F.col(f"`{x.var}`")
    if isinstance(x, Cat):
        c = c.isin(*x.values)
    elif isinstance(x, Num):
        c = F.unix_timestamp(c) if x.time else c
        c = c.between(x.low, x.high) if x.low > -INF and x.high < INF else (c >= x.low if x.low > -INF else c <= x.high)
    return ~c if x.neg else c


def to_column(node: Node) -> Column:
    """The query as a Boolean column: null where it is unknown."""
    if not isinstance(node, Group):
        return literal_column(node)
    if not node.items:
        return F.lit(not node.neg)
    parts = [to_column(x) for x in node.items]
    c = reduce(Column.__and__ if node.op == "and" else Column.__or__, parts)
    return ~c if node.neg else c


def probability(node: Node, of: dict[Literal, float]) -> float:
    """The chance of the query if its literals were independent. of: the share of rows of each literal with its negation."""
    node = push_negation(node)
    if not isinstance(node, Group):
        return float(node.value != node.neg) if isinstance(node, Const) else of[node]
    out = 1.0 if node.op == "and" else 0.0
    for p in (probability(x, of) for x in node.items):
        out = out * p if node.op == "and" else out + p - out * p
    return out
