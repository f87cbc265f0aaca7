"""JSON expression trees as Columns: constants, fields, operators, functions, a ternary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_BINARY = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b), "%": F.try_mod, "pow": F.pow,
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "and": lambda a, b: a & b, "or": lambda a, b: a | b,
}
#: Fixed alternative spellings.
_SPELLED = {"**": "pow", "==": "eq", "!=": "ne", "<": "lt", "<=": "lte", "le": "lte", ">": "gt", ">=": "gte", "ge": "gte", "&&": "and", "||": "or"}
_UNARY = {"-": lambda a: -a, "neg": lambda a: -a, "!": lambda a: ~a, "not": lambda a: ~a}
_FUNCTIONS = {
    "abs": F.abs, "sqrt": lambda a: F.when(a >= 0, F.sqrt(a)), "min": F.least, "max": F.greatest, "floor": F.floor, "ceil": F.ceil, "round": F.round, "log": F.ln, "ln": F.ln, "log10": F.log10, "exp": F.exp, "pow": F.pow, "sin": F.sin, "cos": F.cos, "tan": F.tan,
}


def expression(tree) -> Column:
    """The Column of a tree; anything malformed raises ValueError."""
    if not isinstance(tree, dict):
        return F.lit(tree)
    kind = tree.get("type")
    if "const" in tree or kind == "const":
        return F.lit(tree.get("const", tree.get("value")))
    if "field" in tree and not ({"op", "func", "function"} & set(tree)):
        column = F.col(tree["field"])
        cast = {"int64": "bigint", "float64": "double", "bool": "boolean", "string": "string"}.get(tree.get("data_type") or tree.get("dataType") or "")
        return column.cast(cast) if cast else column
    args = tree.get("args", tree.get("operands"))
    if args is None:
        args = [tree[k] for k in ("left", "right") if k in tree] or [tree[k] for k in ("operand", "arg") if k in tree]
    if kind == "ternary" or "if" in tree or "condition" in tree:
        cond = tree.get("if", tree.get("condition"))
        return F.when(expression(cond), expression(tree.get("then", tree.get("true")))).otherwise(expression(tree.get("else", tree.get("false"))))
    columns = [expression(a) for a in args]
    if name := tree.get("func") or tree.get("function"):
        if name not in _FUNCTIONS:
            raise ValueError(f"unknown function {name!r}")
        return _FUNCTIONS[name](*columns)
    op = tree.get("op") or tree.get("operator")
    if op is None:
        raise ValueError("an expression is a const, a field, an op or a func")
    if op in ("?", "?:", "ternary", "if") and len(columns) == 3:
        return F.when(columns[0], columns[1]).otherwise(columns[2])
    if len(columns) == 1 and op in _UNARY:
        return _UNARY[op](columns[0])
    op = _SPELLED.get(op, op)
    if op not in _BINARY or len(columns) < 2:
        raise ValueError(f"unknown operator {op!r}")
    return reduce(_BINARY[op], columns)
