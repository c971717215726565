"""Chat templates as column expressions: the usual template syntax is compiled, so rendering stays in the JVM.

A template has text, `{{ expression }}`, `{% for m in messages %}`, `{% if %}` / `{% elif %}` / `{% else %}` and
`{% set name = expression %}`; `-` inside a tag strips the white space beside it, a line end after a block tag goes, and
so do blanks before one that begins a line. Expressions have names, subscripts and attributes, slices, literals, `+`,
comparisons, `in`, `and`, `or`, `not`, `a if b else c`, `is defined` and `is none`, the filters trim, upper,
lower, length, tojson and default, `loop.first`, `loop.last`, `loop.index0` and `loop.index`, and `raise_exception`.
What a template can't mean here is an error when it is compiled, not when rows are read.

A null or absent string renders as nothing and is false, as are empty strings and arrays, zero and null.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG = re.compile(r"\{([{%#])(-?)(.*?)(-?)[}%#]\}", re.S)


class TemplateError(ValueError):
    """The template says something that can't be compiled."""


@dataclass(frozen=True)
class Value:
    """A column with its type; `missing` for a name or field that isn't there."""

    column: Column | None
    kind: T.DataType
    missing: bool = False


_MISSING = Value(None, T.NullType(), True)
_STRING, _BOOL, _INT = T.StringType(), T.BooleanType(), T.LongType()


def _tokens(template: str) -> list[tuple[str, str]]:
    """(kind, text): text, expression or statement, white space settled."""
    out, at, strip = [], 0, False
    for m in _TAG.finditer(template):
        text = template[at : m.start()]
        text = text.lstrip() if strip else text
        if m[2]:
            text = text.rstrip()
        elif m[1] != "{":
            text = re.sub(r"(^|\n)[ \t]+\Z", r"\1", text) if at == 0 or "\n" in text else text
        out.append(("text", text))
        at, strip = m.end(), bool(m[4])
        if m[1] != "#":
            out.append(("expression" if m[1] == "{" else "statement", m[3].strip()))
        if m[1] != "{" and not strip and template[at : at + 1] == "\n":
            at += 1
    out.append(("text", template[at:].lstrip() if strip else template[at:]))
    return [x for x in out if x != ("text", "")]


def _truth(v: Value) -> Column:
    if v.missing or isinstance(v.kind, T.NullType):
        return F.lit(False)
    if isinstance(v.kind, T.StringType):
        return F.coalesce(v.column != "", F.lit(False))
    if isinstance(v.kind, T.ArrayType | T.MapType):
        return F.coalesce(F.size(v.column) > 0, F.lit(False))
    if isinstance(v.kind, T.BooleanType):
        return F.coalesce(v.column, F.lit(False))
    if isinstance(v.kind, T.NumericType):
        return F.coalesce(v.column != 0, F.lit(False))
    return v.column.isNotNull()


def _text(v: Value) -> Column:
    if v.missing or isinstance(v.kind, T.NullType):
        return F.lit("")
    if isinstance(v.kind, T.ArrayType | T.MapType | T.StructType):
        raise TemplateError("a list or object renders by tojson only")
    return F.coalesce(v.column.cast("string"), F.lit(""))


class _Expression:
    """Evaluates one expression over the names in reach."""

    def __init__(self, source: str, names: dict[str, Value], loop: dict[str, Value] | None):
        self.source, self.names, self.loop = source, names, loop

    def value(self) -> Value:
        try:
            tree = ast.parse(self.source, mode="eval").body
        except SyntaxError as e:
            raise TemplateError(f"not an expression: {self.source}") from e
        return self.of(tree)

    def of(self, node: ast.expr) -> Value:
        made = getattr(self, "of_" + type(node).__name__, None)
        if made is None:
            raise TemplateError(f"can't compile {ast.unparse(node)}")
        return made(node)

    def of_Constant(self, node: ast.Constant) -> Value:
        kinds = {str: _STRING, bool: _BOOL, int: _INT, type(None): T.NullType()}
        if type(node.value) not in kinds:
            raise TemplateError(f"can't compile {node.value!r}")
        return Value(F.lit(node.value), kinds[type(node.value)])

    def of_Name(self, node: ast.Name) -> Value:
        if node.id in ("true", "false", "none"):
            return self.of_Constant(ast.Constant({"true": True, "false": False, "none": None}[node.id]))
        return self.names.get(node.id, _MISSING)

    def _field(self, v: Value, name: str) -> Value:
        if v.missing:
            return _MISSING
        if not isinstance(v.kind, T.StructType):
            raise TemplateError(f"no field {name} here")
        return Value(v.column[name], v.kind[name].dataType) if name in v.kind.names else _MISSING

    def of_Attribute(self, node: ast.Attribute) -> Value:
        if isinstance(node.value, ast.Name) and node.value.id == "loop":
            if self.loop is None or node.attr not in self.loop:
                raise TemplateError(f"no loop.{node.attr} here")
            return self.loop[node.attr]
        return self._field(self.of(node.value), node.attr)

    def of_Subscript(self, node: ast.Subscript) -> Value:
        v = self.of(node.value)
        if isinstance(node.slice, ast.Slice):
            low = node.slice.lower.value if isinstance(node.slice.lower, ast.Constant) else 0 if node.slice.lower is None else None
            if not isinstance(v.kind, T.ArrayType) or low is None or node.slice.upper or node.slice.step:
                raise TemplateError("only slices of lists from a number on")
            return Value(F.slice(v.column, low + 1, F.greatest(F.size(v.column), F.lit(1))), v.kind)
        if isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
            return self._field(v, node.slice.value)
        if isinstance(v.kind, T.ArrayType):
            at = node.slice.operand.value * -1 if isinstance(node.slice, ast.UnaryOp) and isinstance(node.slice.op, ast.USub) else node.slice.value if isinstance(node.slice, ast.Constant) else None
            if at is not None:
                return Value(F.try_element_at(v.column, F.lit(at if at < 0 else at + 1)), v.kind.elementType)
        raise TemplateError(f"can't compile {ast.unparse(node)}")

    def of_BinOp(self, node: ast.BinOp) -> Value:
        if isinstance(node.op, ast.BitOr):
            # Filters bind tighter than sums in templates, and looser in Python's grammar.
            left, right = node.left, node.right
            if isinstance(right, ast.BinOp) and isinstance(right.op, ast.Add):
                inner = ast.BinOp(left, ast.BitOr(), right.left, col_offset=left.col_offset)
                return self.of(ast.BinOp(inner, ast.Add(), right.right, col_offset=left.col_offset))
            if isinstance(left, ast.BinOp) and isinstance(left.op, ast.Add) and self.source[left.col_offset - 1 : left.col_offset] != "(":
                inner = ast.BinOp(left.right, ast.BitOr(), right, col_offset=left.right.col_offset)
                return self.of(ast.BinOp(left.left, ast.Add(), inner, col_offset=left.col_offset))
            return self.filtered(self.of(node.left), node.right)
        if not isinstance(node.op, ast.Add):
            raise TemplateError(f"can't compile {ast.unparse(node)}")
        one, two = self.of(node.left), self.of(node.right)
        if isinstance(one.kind, T.NumericType) and isinstance(two.kind, T.NumericType):
            return Value(one.column + two.column, _INT)
        return Value(F.concat(_text(one), _text(two)), _STRING)

    def filtered(self, v: Value, node: ast.expr) -> Value:
        name = node.id if isinstance(node, ast.Name) else node.func.id if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) else ""
        if name == "trim":
            return Value(F.regexp_replace(_text(v), r"^\s+|\s+$", ""), _STRING)
        if name in ("upper", "lower"):
            return Value(getattr(F, name)(_text(v)), _STRING)
        if name == "length":
            return Value(F.coalesce((F.size(v.column) if isinstance(v.kind, T.ArrayType | T.MapType) else F.length(_text(v))).cast("long"), F.lit(0)), _INT)
        if name == "tojson" and v.missing:
            return Value(F.lit("null"), _STRING)
        if name == "tojson":
            if isinstance(v.kind, T.ArrayType | T.MapType | T.StructType):
                return Value(F.coalesce(F.to_json(v.column), F.lit("null")), _STRING)
            inside = F.regexp_extract(F.to_json(F.struct(v.column.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
            return Value(F.when(v.column.isNull(), "null").otherwise(inside), _STRING)
        if name == "default" and isinstance(node, ast.Call) and len(node.args) == 1:
            other = self.of(node.args[0])
            return other if v.missing else Value(F.coalesce(v.column, other.column), v.kind)
        raise TemplateError(f"no filter {ast.unparse(node)}")

    def of_Compare(self, node: ast.Compare) -> Value:
        if len(node.ops) > 1:
            raise TemplateError("one comparison at a time")
        op, right = node.ops[0], node.comparators[0]
        left = self.of(node.left)
        if isinstance(op, ast.Is | ast.IsNot):
            word = right.id if isinstance(right, ast.Name) else "none" if isinstance(right, ast.Constant) and right.value is None else ""
            if word not in ("defined", "none", "undefined", "string"):
                raise TemplateError(f"can't compile {ast.unparse(node)}")
            there = F.lit(False) if left.missing else left.column.isNotNull()
            found = {"defined": there, "undefined": ~there, "none": ~there, "string": there if isinstance(left.kind, T.StringType) else F.lit(False)}[word]
            return Value(~found if isinstance(op, ast.IsNot) else found, _BOOL)
        two = self.of(right)
        if isinstance(op, ast.In | ast.NotIn):
            if isinstance(two.kind, T.ArrayType) and left.missing:
                found = F.lit(False)
            elif isinstance(two.kind, T.ArrayType):
                found = F.coalesce(F.array_contains(two.column, left.column), F.lit(False))
            else:
                found = F.contains(_text(two), _text(left))
            return Value(~found if isinstance(op, ast.NotIn) else found, _BOOL)
        if left.missing or two.missing:
            same = F.lit(left.missing and two.missing)
        else:
            same = left.column.eqNullSafe(two.column)
        made = {ast.Eq: lambda: same, ast.NotEq: lambda: ~same, ast.Lt: lambda: left.column < two.column, ast.Gt: lambda: left.column > two.column, ast.LtE: lambda: left.column <= two.column, ast.GtE: lambda: left.column >= two.column}[type(op)]
        return Value(F.coalesce(made(), F.lit(False)), _BOOL)

    def of_BoolOp(self, node: ast.BoolOp) -> Value:
        tests = [_truth(self.of(x)) for x in node.values]
        out = tests[0]
        for t in tests[1:]:
            out = out & t if isinstance(node.op, ast.And) else out | t
        return Value(out, _BOOL)

    def of_UnaryOp(self, node: ast.UnaryOp) -> Value:
        if not isinstance(node.op, ast.Not):
            raise TemplateError(f"can't compile {ast.unparse(node)}")
        return Value(~_truth(self.of(node.operand)), _BOOL)

    def of_IfExp(self, node: ast.IfExp) -> Value:
        return Value(F.when(_truth(self.of(node.test)), _text(self.of(node.body))).otherwise(_text(self.of(node.orelse))), _STRING)

    def of_List(self, node: ast.List) -> Value:
        return Value(F.array(*[_text(self.of(x)) for x in node.elts]), T.ArrayType(_STRING))

    def of_Call(self, node: ast.Call) -> Value:
        if isinstance(node.func, ast.Name) and node.func.id == "raise_exception" and len(node.args) == 1:
            return Value(F.raise_error(_text(self.of(node.args[0]))).cast("string"), _STRING)
        raise TemplateError(f"can't compile {ast.unparse(node)}")


class _Compiler:
    def __init__(self, template: str):
        self.tokens, self.at = _tokens(template), 0

    def block(self, names: dict[str, Value], loop: dict[str, Value] | None, ends: tuple[str, ...]) -> Column:
        """The text up to one of the statements `ends`, which is left to be read."""
        parts, names = [], dict(names)
        while self.at < len(self.tokens):
            kind, text = self.tokens[self.at]
            word = text.split(None, 1)[0] if kind == "statement" and text else ""
            if kind == "statement" and word in ends:
                return F.concat(*parts) if parts else F.lit("")
            self.at += 1
            if kind == "text":
                parts.append(F.lit(text))
            elif kind == "expression":
                parts.append(_text(_Expression(text, names, loop).value()))
            elif word == "for":
                parts.append(self.loop(text, names, loop))
            elif word == "if":
                parts.append(self.condition(text[2:], names, loop))
            elif word == "set" and (m := re.fullmatch(r"set\s+(\w+)\s*=\s*(.+)", text, re.S)):
                names[m[1]] = _Expression(m[2], names, loop).value()
            else:
                raise TemplateError(f"unexpected statement: {text}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return F.concat(*parts) if parts else F.lit("")

    def condition(self, test: str, names: dict[str, Value], loop: dict[str, Value] | None) -> Column:
        asked = _truth(_Expression(test.strip(), names, loop).value())
        then = self.block(names, loop, ("elif", "else", "endif"))
        word, _, rest = self.tokens[self.at][1].partition(" ")
        self.at += 1
        if word == "elif":
            other = self.condition(rest, names, loop)
        elif word == "else":
            other = self.block(names, loop, ("endif",))
            self.at += 1
        else:
            other = F.lit("")
        return F.when(asked, then).otherwise(other)

    def loop(self, text: str, names: dict[str, Value], outer: dict[str, Value] | None) -> Column:
        m = re.fullmatch(r"for\s+(\w+)\s+in\s+(.+)", text, re.S)
        over = _Expression(m[2], names, outer).value() if m else _MISSING
        if over.missing:
            self.block({**names, m[1]: _MISSING} if m else names, {}, ("endfor",)) if m else None
            self.at += 1
            return F.lit("")
        if not isinstance(over.kind, T.ArrayType):
            raise TemplateError(f"not a list: {text}")
        start, ended = self.at, 0

        def body(item: Column, place: Column) -> Column:
            nonlocal ended
            self.at = start
            last = F.size(over.column) - 1
            own = {"first": Value(place == 0, _BOOL), "last": Value(place == last, _BOOL), "index0": Value(place.cast("long"), _INT), "index": Value((place + 1).cast("long"), _INT)}
            out = self.block({**names, m[1]: Value(item, over.kind.elementType)}, own, ("endfor",))
            ended = self.at
            return out

        out = F.coalesce(F.array_join(F.transform(over.column, body), ""), F.lit(""))
        self.at = ended + 1
        return out


def compile_template(template: str, names: dict[str, tuple[Column, T.DataType]]) -> Column:
    """The template over columns as one string column; `names` gives each name's column and type.

    Python values are columns too: a name of a constant is `(F.lit(True), BooleanType())`.
    """
    compiler = _Compiler(template)
    return compiler.block({k: Value(c, t) for k, (c, t) in names.items()}, None, ())
