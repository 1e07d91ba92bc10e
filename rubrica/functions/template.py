"""Templates with {{ expressions }} compiled to Column expressions.

Inside the braces: a column, a.b, a[i], 'text', a number, and the methods
strip, lower, upper, title, replace, index, join, and the filters trim, lower,
upper, length, join, regex_replace. An unknown column fails when the plan is
analysed.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rubrica.functions.text import strip

_HOLE = re.compile(r"\{\{-?\s*(.*?)\s*-?\}\}", re.S)


def render(template: str) -> Column:
    """A string column."""
    if "{%" in template:
        raise ValueError("statements aren't supported, only {{ expressions }}")
    parts, at = [], 0
    for m in _HOLE.finditer(template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        parts.append(expression(m[1]).cast("string"))
        at = m.end()
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts) if parts else F.lit("")


def resolve(spec: str | int, columns: list[str]) -> Column:
    """A column's name, a template, a number, or plain text."""
    if isinstance(spec, int):
        return F.lit(spec)
    return F.col(f"`{spec}`") if spec in columns else render(spec)


def expression(text: str) -> Column:
    first, *filters = re.split(r"\|(?=(?:[^'\"]*['\"][^'\"]*['\"])*[^'\"]*$)", text)
    out = _build(ast.parse(first.strip(), mode="eval").body)
    for f in filters:
        node = ast.parse(f.strip(), mode="eval").body
        name, args = (node.func.id, [ast.literal_eval(a) for a in node.args]) if isinstance(node, ast.Call) else (node.id, [])
        out = _call(out, {"trim": "strip"}.get(name, name), args)
    return out


def _build(node: ast.expr) -> Column:
    match node:
        case ast.Name(id=name):
            return F.col(f"`{name}`")
        case ast.Constant(value=value):
            return F.lit(value)
        case ast.Attribute(value=inner, attr=name):
            return _build(inner)[name]
        case ast.Subscript(value=inner, slice=ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=int(i)))):
            return F.element_at(_build(inner), -i)
        case ast.Subscript(value=inner, slice=ast.Constant(value=key)):
            return F.get(_build(inner), F.lit(key)) if isinstance(key, int) else _build(inner)[key]
        case ast.Subscript(value=inner, slice=key):
            return F.get(_build(inner), _build(key).cast("int"))
        case ast.BinOp(left=a, op=ast.Add(), right=b) if any(isinstance(x, ast.Constant) and isinstance(x.value, str) for x in (a, b)):
            return F.concat(_build(a), _build(b))
        case ast.BinOp(left=a, op=op, right=b):
            x, y = _build(a), _build(b)
            return {ast.Add: x + y, ast.Sub: x - y, ast.Mult: x * y}[type(op)]
        case ast.Call(func=ast.Attribute(value=inner, attr=name), args=args):
            if name == "index":
                return F.array_position(_build(inner), _build(args[0])) - 1
            return _call(_build(inner), name, [ast.literal_eval(a) for a in args])
    raise ValueError(f"{ast.unparse(node)!r} isn't supported in a template")


def _call(c: Column, name: str, args: list) -> Column:
    match name, args:
        case "strip", []:
            return strip(c)
        case ("lower" | "upper"), []:
            return getattr(F, name)(c)
        case ("title" | "capitalize"), []:
            return F.initcap(c)
        case "length", []:
            return F.size(c)
        case "join", [str(sep)]:
            return F.array_join(c, sep)
        case "replace", [str(a), str(b)]:
            return F.replace(c, F.lit(a), F.lit(b))
        case "regex_replace", [str(a), str(b)]:
            return F.regexp_replace(c, a, b)
    raise ValueError(f"{name}{args} isn't supported in a template")
