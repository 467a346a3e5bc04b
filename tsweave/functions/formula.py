"""Formulas over symbols: parsed on the driver, compiled to columns.

formula = term {("+" | "-") term}; term = factor {("*" | "/") factor}; factor = symbol | "(" formula ")". A symbol is a run
of letters, digits and _ . # or any text in double quotes; there are no numbers, unary signs or functions, so 100 is a symbol.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidFormulaError

TOKEN = re.compile(r'\s*(?:"([^"]+)"|([A-Za-z0-9_.#]+)|([-+*/()]))')


@dataclass(frozen=True)
class Node:
    """A symbol (op 'symbol', name) or an operation on two nodes."""

    op: str
    name: str = ""
    left: Node | None = None
    right: Node | None = None

    def symbols(self) -> frozenset[str]:
        return frozenset((self.name,)) if self.op == "symbol" else self.left.symbols() | self.right.symbols()

    def __str__(self) -> str:
        if self.op == "symbol":
            return self.name if re.fullmatch(r"[A-Za-z0-9_.#]+", self.name) else f'"{self.name}"'
        return f"({self.left}{self.op}{self.right})"


def parse(text: str) -> Node:
    tokens, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise InvalidFormulaError(f"unexpected text at {at}: {text[at:at + 10]!r}")
        tokens.append(("op", m[3]) if m[3] else ("symbol", m[1] or m[2]))
        at = m.end()
    pos = 0

    def peek(ops: str) -> str | None:
        return tokens[pos][1] if pos < len(tokens) and tokens[pos][0] == "op" and tokens[pos][1] in ops else None

    def chain(part, ops: str) -> Node:
        nonlocal pos
        node = part()
        while op := peek(ops):
            pos += 1
            node = Node(op, left=node, right=part())
        return node

    def formula() -> Node:
        return chain(term, "+-")

    def term() -> Node:
        return chain(factor, "*/")

    def factor() -> Node:
        nonlocal pos
        if pos >= len(tokens):
            raise InvalidFormulaError("the formula ends too early")
        kind, value = tokens[pos]
        pos += 1
        if kind == "symbol":
            return Node("symbol", value)
        if value != "(":
            raise InvalidFormulaError(f"unexpected {value!r}")
        inner = formula()
        if not peek(")"):
            raise InvalidFormulaError("a parenthesis isn't closed")
        pos += 1
        return inner

    found = formula()
    if pos != len(tokens):
        raise InvalidFormulaError(f"unexpected {tokens[pos][1]!r}")
    return found


def monomial(node: Node) -> dict[str, int] | None:
    """Exponents by symbol of a formula of products and quotients, without zeros; None where it has sums."""
    if node.op == "symbol":
        return {node.name: 1}
    if node.op not in "*/":
        return None
    left, right = monomial(node.left), monomial(node.right)
    if left is None or right is None:
        return None
    total = Counter(left)
    for s, n in right.items():
        total[s] += n if node.op == "*" else -n
    return {s: n for s, n in sorted(total.items()) if n}


def canonical(node: Node) -> str:
    """One text for formulas that differ in the order and grouping of the terms of sums, or the factors of products."""
    if node.op == "symbol":
        return str(node)
    pair = "+-" if node.op in "+-" else "*/"
    parts: list[str] = []

    def walk(n: Node, sign: str) -> None:
        if n.op != "symbol" and n.op in pair:
            walk(n.left, sign)
            walk(n.right, sign if n.op == pair[0] else pair[1] if sign == pair[0] else pair[0])
        else:
            parts.append(sign + canonical(n))

    walk(node, pair[0])
    return "(" + "".join(sorted(parts)) + ")"


def semantic_key(node: Node) -> str:
    """Equal for formulas that are the same function as far as products and quotients show it."""
    exponents = monomial(node)
    return canonical(node) if exponents is None else "*".join(f"{s!r}^{n}" for s, n in exponents.items()) or "1"


def equivalent(a: str, b: str) -> bool:
    return semantic_key(parse(a)) == semantic_key(parse(b))


def to_column(node: Node, strict: bool = False, prices=F.col) -> Column:
    """The formula over a wide panel; a zero denominator gives null, or an error where strict."""
    if node.op == "symbol":
        return prices(f"`{node.name}`") if prices is F.col else prices(node.name)
    a, b = to_column(node.left, strict, prices), to_column(node.right, strict, prices)
    if node.op == "/":
        zero = F.raise_error(F.lit("a formula divides by zero")).cast("double") if strict else F.lit(None).cast("double")
        return a / F.when(b == 0, zero).otherwise(b)
    return {"+": a + b, "-": a - b, "*": a * b}[node.op]


def to_interval(node: Node, bid, ask) -> tuple[Column, Column]:
    """(low, high) of the formula where each symbol lies between bid(symbol) and ask(symbol), for prices over zero.

    A denominator that reaches zero or less gives null.
    """
    if node.op == "symbol":
        return bid(node.name), ask(node.name)
    (a, b), (c, d) = to_interval(node.left, bid, ask), to_interval(node.right, bid, ask)
    if node.op == "+":
        return a + c, b + d
    if node.op == "-":
        return a - d, b - c
    if node.op == "*":
        return a * c, b * d
    ok = c > 0
    return F.when(ok, a / F.nullif(d, F.lit(0.0))), F.when(ok, b / F.nullif(c, F.lit(0.0)))


def discrepancy(bid: Column, ask: Column, low: Column, high: Column, theory: Column) -> dict[str, Column]:
    """Columns of an actual quote against a synthetic interval and mid: buy_edge, sell_edge, difference, percent, kind."""
    mid = (bid + ask) / 2
    buy, sell = bid - high, low - ask
    best = F.greatest(buy, sell)
    kind = F.when(best > 0, "executable").when(mid != theory, "theoretical").when(theory.isNotNull(), "none")
    return {"buy_edge": buy, "sell_edge": sell, "difference": mid - theory, "percent": (mid - theory) / F.nullif(theory, F.lit(0.0)) * 100, "kind": kind}


def default_target(node: Node) -> str:
    return min(node.symbols())


def product(names: list[str]) -> Node:
    return reduce(lambda a, b: Node("*", left=a, right=b), [Node("symbol", n) for n in names])
