"""Formulas over a row as Columns. Text of callers is parsed, never evaluated.

The grammar is the useful part of the expressions that schemas carry: literals, field('x'), fields('x'), row['x'], i,
arithmetic, comparison, logic, the conditional, text methods, Math functions and the helpers normalize, concat, pad
and rand.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.modules import padded
from .rules import Invalid

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|([A-Za-z_$][\w$]*)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(===|!==|==|!=|<=|>=|&&|\|\||\?\?|[-+*/%<>!?:().,\[\]]))")


@dataclass
class Value:
    """A Column and whether it is a text, a number or a truth value ("" if unknown: a field)."""

    column: Column
    kind: str = ""

    def text(self) -> Column:
        c = self.column
        if self.kind == "number":
            return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))
        return c.cast("string")

    def shown(self) -> Column:
        return F.coalesce(self.text(), F.lit(""))

    def number(self) -> Column:
        return self.column.cast("double") if self.kind in ("number", "truth") else self.column.cast("string").try_cast("double")

    def truth(self) -> Column:
        if self.kind == "truth":
            return F.coalesce(self.column, F.lit(False))
        if self.kind == "number":
            return F.coalesce(self.column != 0, F.lit(False))
        return F.coalesce(self.column.cast("string") != "", F.lit(False))


@dataclass
class Scope:
    """How a formula reaches fields (by name), whole repeats, its repeat index and draws."""

    field: Callable[[str], Column]
    fields: Callable[[str], Column]
    index: Column
    kinds: Callable[[str], str]
    draw: Callable[[int], Column]


class Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            found = TOKEN.match(text, at)
            if not found:
                raise Invalid(f"the formula cannot be read at {text[at : at + 12]!r}")
            self.tokens.append(next((k, v) for k, v in zip(("number", "name", "text", "sign"), found.groups()) if v is not None))
            at = found.end()
        self.at = self.draws = 0

    def peek(self, *signs):
        return self.at < len(self.tokens) and self.tokens[self.at][0] == "sign" and self.tokens[self.at][1] in signs

    def take(self, sign=None):
        if self.at >= len(self.tokens):
            raise Invalid("the formula ends too early")
        kind, value = self.tokens[self.at]
        if sign is not None and (kind, value) != ("sign", sign):
            raise Invalid(f"expected {sign!r} before {value!r}")
        self.at += 1
        return kind, value

    def parse(self):
        out = self.conditional()
        if self.at < len(self.tokens):
            raise Invalid(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def conditional(self):
        test = self.binary(0)
        if not self.peek("?"):
            return test
        self.take()
        yes = self.conditional()
        self.take(":")
        return ("if", test, yes, self.conditional())

    LEVELS = [("??",), ("||",), ("&&",), ("===", "!==", "==", "!="), ("<", ">", "<=", ">="), ("+", "-"), ("*", "/", "%")]

    def binary(self, level):
        if level == len(self.LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek(*self.LEVELS[level]):
            left = ("op", self.take()[1], left, self.binary(level + 1))
        return left

    def unary(self):
        if self.peek("!", "-", "+"):
            return ("unary", self.take()[1], self.unary())
        return self.postfix()

    def arguments(self):
        out = []
        self.take("(")
        while not self.peek(")"):
            out.append(self.conditional())
            if not self.peek(")"):
                self.take(",")
        self.take(")")
        return out

    def postfix(self):
        kind, value = self.take()
        if kind == "number":
            out = ("number", float(value))
        elif kind == "text":
            out = ("text", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        elif (kind, value) == ("sign", "("):
            out = self.conditional()
            self.take(")")
        elif kind == "name":
            if value == "Math":
                self.take(".")
                value = "Math." + self.take()[1]
            if self.peek("("):
                out = ("call", value, self.arguments())
                if value == "rand":
                    out = ("rand", out[2], self.draws)
                    self.draws += 1
            else:
                out = ("name", value)
        else:
            raise Invalid(f"unexpected {value!r}")
        while self.peek(".", "["):
            if self.take()[1] == "[":
                out = ("index", out, self.conditional())
                self.take("]")
            else:
                kind, value = self.take()
                if kind != "name":
                    raise Invalid("a method needs a name")
                out = ("method", value, out, self.arguments()) if self.peek("(") else ("length", out) if value == "length" else ("index", out, ("text", value))
        return out


MATH = {"round": lambda x: F.floor(x + 0.5), "floor": F.floor, "ceil": F.ceil, "abs": F.abs, "sqrt": F.sqrt}


def compile_formula(text: str) -> Callable[[Scope], Value]:
    """Parse now; the result makes the Column for a scope."""
    tree = Parser(text).parse()
    _check(tree)
    return lambda scope: _build(tree, scope)


KNOWN = {"field", "fields", "normalize", "concat", "pad", "rand", "String", "Number", *(f"Math.{k}" for k in MATH), "Math.min", "Math.max"}
METHODS = {"toUpperCase", "toLowerCase", "trim", "slice", "substring", "charAt", "replace", "includes", "startsWith", "endsWith", "padStart", "join", "concat", "toFixed", "toString", "repeat", "indexOf"}


def _check(tree) -> None:
    if isinstance(tree, (tuple, list)):
        if tree and tree[0] == "call" and tree[1] not in KNOWN:
            raise Invalid(f"unknown function {tree[1]!r}")
        if tree and tree[0] == "method" and tree[1] not in METHODS:
            raise Invalid(f"unknown method {tree[1]!r}")
        if tree and tree[0] == "name" and tree[1] not in ("i", "row", "true", "false", "null", "undefined"):
            raise Invalid(f"unknown name {tree[1]!r}")
        for x in tree:
            _check(x)


def _literal(tree) -> str:
    if tree[0] != "text":
        raise Invalid("a field is named by a text")
    return tree[1]


def _build(tree, s: Scope) -> Value:
    kind = tree[0]
    build = lambda t: _build(t, s)
    if kind == "number":
        return Value(F.lit(tree[1]), "number")
    if kind == "text":
        return Value(F.lit(tree[1]), "text")
    if kind == "name":
        return {"i": lambda: Value(s.index.cast("double"), "number"), "true": lambda: Value(F.lit(True), "truth"), "false": lambda: Value(F.lit(False), "truth")}.get(tree[1], lambda: Value(F.lit(None).cast("string"), "text"))()
    if kind == "rand":
        lo, hi = (build(x).number() for x in tree[1])
        return Value(F.floor(s.draw(tree[2]) * (hi - lo + 1)) + lo, "number")
    if kind == "if":
        test, yes, no = build(tree[1]).truth(), build(tree[2]), build(tree[3])
        same = yes.kind if yes.kind == no.kind else "text"
        side = (lambda v: v.column) if same == yes.kind and same else (lambda v: v.text())
        return Value(F.when(test, side(yes)).otherwise(side(no)), same or "text")
    if kind == "unary":
        x = build(tree[2])
        return Value(~x.truth(), "truth") if tree[1] == "!" else Value(-x.number() if tree[1] == "-" else x.number(), "number")
    if kind == "op":
        return _operator(tree[1], build(tree[2]), build(tree[3]))
    if kind == "length":
        x = tree[1]
        if x[0] == "call" and x[1] == "fields":
            return Value(F.size(s.fields(_literal(x[2][0]))).cast("double"), "number")
        return Value(F.length(build(x).shown()).cast("double"), "number")
    if kind == "index":
        if tree[1] == ("name", "row"):
            return Value(s.field(_literal(tree[2])), s.kinds(_literal(tree[2])))
        if tree[1][0] == "call" and tree[1][1] == "fields":
            name = _literal(tree[1][2][0])
            return Value(F.try_element_at(s.fields(name), (build(tree[2]).number() + 1).cast("int")), s.kinds(name))
        return Value(F.substring(build(tree[1]).shown(), (build(tree[2]).number() + 1).cast("int"), F.lit(1)), "text")
    if kind == "call":
        return _call(tree[1], tree[2], s)
    return _method(tree[1], tree[2], tree[3], s)


def _operator(sign: str, a: Value, b: Value) -> Value:
    if sign == "+":
        if "text" in (a.kind, b.kind) or "" in (a.kind, b.kind):
            return Value(F.concat(a.shown(), b.shown()), "text")
        return Value(a.number() + b.number(), "number")
    if sign in "-*/%":
        x, y = a.number(), b.number()
        safe = F.when(y != 0, y)
        return Value({"-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / safe, "%": lambda: x % safe}[sign](), "number")
    if sign in ("&&", "||", "??"):
        if a.kind == b.kind == "truth":
            return Value(a.truth() & b.truth() if sign == "&&" else a.truth() | b.truth(), "truth")
        first = a.column.isNotNull() if sign == "??" else a.truth()
        return Value(F.when(first, b.text() if sign == "&&" else a.text()).otherwise(a.text() if sign == "&&" else b.text()), "text")
    if "number" in (a.kind, b.kind):
        x, y = a.number(), b.number()
    else:
        x, y = a.text(), b.text()
    test = {"===": lambda: x.eqNullSafe(y), "==": lambda: x.eqNullSafe(y), "!==": lambda: ~x.eqNullSafe(y), "!=": lambda: ~x.eqNullSafe(y), "<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y}[sign]()
    return Value(F.coalesce(test, F.lit(False)), "truth")


def _call(name: str, args: list, s: Scope) -> Value:
    build = lambda t: _build(t, s)
    if name == "field":
        return Value(s.field(_literal(args[0])), s.kinds(_literal(args[0])))
    if name == "fields":
        return Value(F.array_join(F.transform(s.fields(_literal(args[0])), lambda x: x.cast("string")), ",", ""), "text")
    if name == "normalize":
        return Value(F.regexp_replace(F.lower(build(args[0]).shown()), "[^a-z0-9]", ""), "text")
    if name == "concat":
        return Value(F.concat(*[build(a).shown() for a in args]) if args else F.lit(""), "text")
    if name == "pad":
        width = int(args[1][1])
        fill = _literal(args[2]) if len(args) > 2 else "0"
        text = build(args[0]).shown()
        return Value(padded(text, width) if fill == "0" else F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, fill)), "text")
    if name == "String":
        return Value(build(args[0]).text(), "text")
    if name == "Number":
        return Value(build(args[0]).number(), "number")
    if name in ("Math.min", "Math.max"):
        return Value((F.least if name == "Math.min" else F.greatest)(*[build(a).number() for a in args]), "number")
    return Value(MATH[name.removeprefix("Math.")](build(args[0]).number()).cast("double"), "number")


def _method(name: str, of, args: list, s: Scope) -> Value:
    build = lambda t: _build(t, s)
    if name == "join" and of[0] == "call" and of[1] == "fields":
        return Value(F.array_join(F.transform(s.fields(_literal(of[2][0])), lambda x: x.cast("string")), _literal(args[0]) if args else ",", ""), "text")
    x, n = build(of), F.length(build(of).shown())
    text = x.shown()
    if name in ("slice", "substring", "charAt"):
        start = build(args[0]).number().cast("int") if args else F.lit(0)
        start = F.when(start < 0, F.greatest(F.lit(0), n + start)).otherwise(start)
        stop = start + 1 if name == "charAt" else build(args[1]).number().cast("int") if len(args) > 1 else n
        stop = F.when(stop < 0, n + stop).otherwise(stop)
        return Value(F.substring(text, start + 1, F.greatest(F.lit(0), stop - start)), "text")
    if name in ("includes", "startsWith", "endsWith"):
        test = {"includes": F.contains, "startsWith": F.startswith, "endsWith": F.endswith}[name]
        return Value(test(text, build(args[0]).shown()), "truth")
    if name == "toFixed":
        places = int(args[0][1]) if args else 0
        return Value(F.format_string(f"%.{places}f", x.number()), "text")
    plain = {
        "toUpperCase": lambda: F.upper(text),
        "toLowerCase": lambda: F.lower(text),
        "trim": lambda: F.regexp_replace(text, r"(?U)^\s+|\s+$", ""),
        "toString": lambda: text,
        "concat": lambda: F.concat(text, *[build(a).shown() for a in args]),
        "repeat": lambda: F.repeat(text, build(args[0]).number().cast("int")),
        "padStart": lambda: _call("pad", [of, *args] if len(args) > 1 else [of, args[0], ("text", " ")], s).column,
        "replace": lambda: F.when(F.instr(text, _literal(args[0])) > 0, F.overlay(text, build(args[1]).shown(), F.instr(text, _literal(args[0])), F.lit(len(_literal(args[0]))))).otherwise(text),
    }
    if name == "indexOf":
        return Value((F.locate(_literal(args[0]), text) - 1).cast("double"), "number")
    return Value(plain[name](), "text")
