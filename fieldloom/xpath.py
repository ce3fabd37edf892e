"""XPath 1.0 over the document tree: location paths with all axes but namespaces, predicates, operators and the core functions."""

from __future__ import annotations

import math
import re
from functools import lru_cache

from .dom import Node

LEXER = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d*)?|\.\d+)|(?P<str>"[^"]*"|'[^']*')|(?P<op>//|::|!=|<=|>=|\.\.|[()\[\]@,|/+\-=<>*.$])|(?P<name>[A-Za-z_][\w.-]*(?::[A-Za-z_*][\w.-]*)?))""")
AXES = frozenset("child descendant descendant-or-self self parent ancestor ancestor-or-self following-sibling preceding-sibling following preceding attribute".split())
REVERSE = frozenset(("ancestor", "ancestor-or-self", "preceding", "preceding-sibling", "parent"))


class XPathError(ValueError):
    """An expression that can't be read or evaluated; rules made of it match nothing."""


class Attribute:
    __slots__ = ("owner", "name", "value")

    def __init__(self, owner: Node, name: str, value: str):
        self.owner, self.name, self.value = owner, name, value


def place(n) -> tuple:
    return (n.owner.order, 1, n.name) if isinstance(n, Attribute) else (n.order, 0, "")


def text_of(n) -> str:
    return n.value if isinstance(n, Attribute) else n.data if n.tag is None or n.tag == "#comment" else n.string_value()


def to_string(v) -> str:
    if isinstance(v, list):
        return text_of(v[0]) if v else ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else ("-" if v < 0 else "") + "Infinity" if math.isinf(v) else str(int(v)) if v == int(v) else repr(v)
    return v


def to_number(v) -> float:
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, float):
        return v
    s = to_string(v).strip()
    return float(s) if re.fullmatch(r"-?(?:\d+\.?\d*|\.\d+)", s) else math.nan


def to_bool(v) -> bool:
    return bool(v) and not (isinstance(v, float) and math.isnan(v))


def compare(op: str, a, b) -> bool:
    if isinstance(a, list) or isinstance(b, list):
        if isinstance(a, bool) or isinstance(b, bool):
            return compare(op, to_bool(a), to_bool(b))
        if isinstance(a, list):
            return any(compare(op, to_number([x]) if isinstance(b, float) else text_of(x), b) for x in a)
        return any(compare(op, a, to_number([x]) if isinstance(a, float) else text_of(x)) for x in b)
    if op in ("=", "!="):
        kind = to_bool if isinstance(a, bool) or isinstance(b, bool) else to_number if isinstance(a, float) or isinstance(b, float) else to_string
        return (kind(a) == kind(b)) == (op == "=")
    x, y = to_number(a), to_number(b)
    return {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]


def axis_nodes(axis: str, n) -> list:
    if isinstance(n, Attribute):
        up = [n.owner, *n.owner.ancestors()]
        return {"self": [n], "parent": up[:1], "ancestor": up, "ancestor-or-self": [n, *up]}.get(axis, [])
    if axis == "child":
        return n.children
    if axis in ("descendant", "descendant-or-self"):
        every = list(n.walk())
        return every if axis == "descendant-or-self" else every[1:]
    if axis == "attribute":
        return [Attribute(n, k, v) for k, v in n.attrs.items()]
    if axis in ("self", "parent"):
        return [n] if axis == "self" else [n.parent] if n.parent is not None else []
    if axis in ("ancestor", "ancestor-or-self"):
        return ([n] if axis != "ancestor" else []) + list(n.ancestors())
    row = n.parent.children if n.parent is not None else [n]
    at = next(k for k, c in enumerate(row) if c is n)
    if axis == "following-sibling":
        return row[at + 1 :]
    if axis == "preceding-sibling":
        return row[:at][::-1]
    root = n
    while root.parent is not None:
        root = root.parent
    inside, above = {id(x) for x in n.walk()}, {id(x) for x in n.ancestors()}
    rest = [x for x in root.walk() if id(x) not in inside and id(x) not in above and (x.order > n.order) == (axis == "following")]
    return rest if axis == "following" else rest[::-1]


FUNCTIONS = {
    "position": lambda c: float(c[1]), "last": lambda c: float(c[2]), "count": lambda c, v: float(len(v)), "not": lambda c, v: not to_bool(v), "true": lambda c: True, "false": lambda c: False,
    "boolean": lambda c, v: to_bool(v), "string": lambda c, v=None: to_string([c[0]] if v is None else v), "number": lambda c, v=None: to_number([c[0]] if v is None else v),
    "concat": lambda c, *v: "".join(map(to_string, v)), "contains": lambda c, a, b: to_string(b) in to_string(a), "starts-with": lambda c, a, b: to_string(a).startswith(to_string(b)),
    "substring-before": lambda c, a, b: to_string(a).partition(to_string(b))[0] if to_string(b) in to_string(a) else "", "substring-after": lambda c, a, b: to_string(a).partition(to_string(b))[2],
    "string-length": lambda c, v=None: float(len(to_string([c[0]] if v is None else v))), "normalize-space": lambda c, v=None: " ".join(to_string([c[0]] if v is None else v).split()),
    "translate": lambda c, s, a, b: translate(to_string(s), to_string(a), to_string(b)), "substring": lambda c, s, a, n=None: substring(to_string(s), to_number(a), None if n is None else to_number(n)),
    "name": lambda c, v=None: name_of([c[0]] if v is None else v), "local-name": lambda c, v=None: name_of([c[0]] if v is None else v), "sum": lambda c, v: math.fsum(to_number([x]) for x in v),
    "floor": lambda c, v: float(math.floor(to_number(v))), "ceiling": lambda c, v: float(math.ceil(to_number(v))), "round": lambda c, v: float(math.floor(to_number(v) + 0.5)),
    "id": lambda c, v: [n for n in root_of(c[0]).elements() if n.attrs.get("id") in to_string(v).split()],
}


def root_of(n) -> Node:
    n = n.owner if isinstance(n, Attribute) else n
    while n.parent is not None:
        n = n.parent
    return n


def name_of(v: list) -> str:
    return "" if not v else v[0].name if isinstance(v[0], Attribute) else v[0].tag or ""


def translate(s: str, a: str, b: str) -> str:
    table = {}
    for k, c in enumerate(a):
        table.setdefault(c, b[k] if k < len(b) else "")
    return "".join(table.get(c, c) for c in s)


def substring(s: str, start: float, n: float | None) -> str:
    if math.isnan(start) or n is not None and math.isnan(n):
        return ""
    first = math.floor(start + 0.5)
    end = math.inf if n is None else first + math.floor(n + 0.5)
    return "".join(c for k, c in enumerate(s, 1) if first <= k < end)


class _Reader:
    """A recursive descent over tokens that builds closures of the context (node, position, size)."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = LEXER.match(text, at)
            if not m:
                raise XPathError(text)
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, k: int = 0) -> str | None:
        return self.tokens[self.at + k][1] if self.at + k < len(self.tokens) else None

    def kind(self, k: int = 0) -> str | None:
        return self.tokens[self.at + k][0] if self.at + k < len(self.tokens) else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted and self.kind() != "str":
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if self.take(wanted) is None:
            raise XPathError(f"{wanted} expected")

    def binary(self, below, *ops):
        left = below()
        while (op := self.take(*ops)) is not None:
            left = self.join(op, left, below())
        return left

    @staticmethod
    def join(op, a, b):
        if op == "or":
            return lambda c: to_bool(a(c)) or to_bool(b(c))
        if op == "and":
            return lambda c: to_bool(a(c)) and to_bool(b(c))
        if op in ("=", "!=", "<", ">", "<=", ">="):
            return lambda c: compare(op, a(c), b(c))
        if op == "|":
            return lambda c: ordered([*nodes(a(c)), *nodes(b(c))])
        sums = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "div": lambda x, y: x / y if y else math.nan if not x or math.isnan(x) else math.copysign(math.inf, x), "mod": lambda x, y: math.fmod(x, y) if y else math.nan}
        return lambda c: sums[op](to_number(a(c)), to_number(b(c)))

    def expression(self):
        levels = [("or",), ("and",), ("=", "!="), ("<", ">", "<=", ">="), ("+", "-"), ("*", "div", "mod")]

        def level(k: int):
            return self.unary() if k == len(levels) else self.binary(lambda: level(k + 1), *levels[k])

        return level(0)

    def unary(self):
        if self.take("-"):
            inner = self.unary()
            return lambda c: -to_number(inner(c))
        return self.binary(self.path, "|")

    def path(self):
        kind, now, after = self.kind(), self.peek(), self.peek(1)
        if kind in ("num", "str") or now == "(" or kind == "name" and after == "(" and now not in ("text", "node", "comment"):
            start = self.filtered()
            if self.peek() not in ("/", "//"):
                return start
            steps = []
        elif self.take("//"):
            start, steps = (lambda c: [root_of(c[0])]), [step("descendant-or-self", lambda n: True, []), self.step()]
        elif self.take("/"):
            start, steps = (lambda c: [root_of(c[0])]), [] if self.peek() in (None, ")", "]", "|", ",") else [self.step()]
        else:
            start, steps = (lambda c: [c[0]]), [self.step()]
        while (slash := self.take("/", "//")) is not None:
            if slash == "//":
                steps.append(step("descendant-or-self", lambda n: True, []))
            steps.append(self.step())

        def run(c):
            found = nodes(start(c))
            for s in steps:
                found = ordered([x for n in found for x in s(n)])
            return found

        return run

    def filtered(self):
        kind, now = self.kind(), self.peek()
        if now is None:
            raise XPathError("ends early")
        if kind == "num":
            self.at += 1
            inner = lambda c, v=float(now): v
        elif kind == "str":
            self.at += 1
            inner = lambda c, v=now[1:-1]: v
        elif self.take("("):
            inner = self.expression()
            self.need(")")
        else:
            inner = self.call()
        tests = self.predicates()
        return inner if not tests else lambda c: keep(nodes(inner(c)), tests)

    def call(self):
        name = self.peek()
        self.at += 1
        self.need("(")
        args = []
        while self.take(")") is None:
            args.append(self.expression())
            if self.peek() != ")":
                self.need(",")
        if name not in FUNCTIONS:
            raise XPathError(name)
        f = FUNCTIONS[name]
        return lambda c: f(c, *[a(c) for a in args])

    def predicates(self) -> list:
        tests = []
        while self.take("["):
            tests.append(self.expression())
            self.need("]")
        return tests

    def step(self):
        if self.take("."):
            return step("self", lambda n: True, [])
        if self.take(".."):
            return step("parent", lambda n: True, [])
        axis = "child"
        if self.take("@"):
            axis = "attribute"
        elif self.kind() == "name" and self.peek(1) == "::":
            axis = self.peek()
            self.at += 2
            if axis not in AXES:
                raise XPathError(axis)
        name, kind = self.peek(), self.kind()
        self.at += 1
        if kind == "name" and self.peek() == "(" and name in ("text", "node", "comment"):
            self.need("(")
            self.need(")")
            test = {"text": lambda n: not isinstance(n, Attribute) and n.tag is None, "node": lambda n: True, "comment": lambda n: not isinstance(n, Attribute) and n.tag == "#comment"}[name]
        elif name == "*":
            test = (lambda n: True) if axis == "attribute" else lambda n: not isinstance(n, Attribute) and n.is_element
        elif kind == "name":
            test = (lambda n: n.name == name) if axis == "attribute" else lambda n: not isinstance(n, Attribute) and n.tag == name
        else:
            raise XPathError(str(name))
        return step(axis, test, self.predicates())


def nodes(v) -> list:
    if not isinstance(v, list):
        raise XPathError("a set of nodes expected")
    return v


def keep(found: list, tests: list) -> list:
    for t in tests:
        n = len(found)
        found = [x for k, x in enumerate(found, 1) if (float(k) == v if isinstance(v := t((x, k, n)), float) else to_bool(v))]
    return found


def ordered(found: list) -> list:
    """In document order, each node once."""
    return list({(place(n)): n for n in sorted(found, key=place)}.values())


def step(axis: str, test, tests: list):
    return lambda n: keep([x for x in axis_nodes(axis, n) if test(x)], tests)


@lru_cache(4096)
def read(expression: str):
    reader = _Reader(expression)
    out = reader.expression()
    if reader.at < len(reader.tokens):
        raise XPathError(expression)
    return out


def evaluate(root: Node, expression: str) -> list:
    """What an expression selects: elements and attributes as they are, texts and scalars as they print; [] if it can't be evaluated."""
    start = next((c for c in root.children if c.is_element), root) if root.tag == "#root" else root
    try:
        found = read(expression)((start, 1, 1))
    except (XPathError, RecursionError, TypeError, ValueError):
        return []
    return [text_of(x) if isinstance(x, Attribute) or x.tag is None else x for x in found] if isinstance(found, list) else [found]
