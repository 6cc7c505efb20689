"""The derived-column language: a small Python-like syntax compiled to column expressions, never evaluated."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame, functions as F

from millrace.errors import ExpressionError

_COMPARE = {ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__", ast.Eq: "__eq__", ast.NotEq: "__ne__"}


class _Compiler:
    def __init__(self, kinds: dict[str, str], today: str | None):
        self.kinds, self.today = kinds, today

    def kind(self, node: ast.AST) -> str:
        if isinstance(node, ast.Name):
            return self.kinds.get(node.id, "")
        if isinstance(node, ast.Call) and getattr(node.func, "id", "") == "today":
            return "date"
        return ""

    def truth(self, node: ast.AST) -> Column:
        """Comparisons as they are; values are true when neither null nor 0 nor empty."""
        if isinstance(node, (ast.Compare, ast.BoolOp)) or isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not) or isinstance(node, ast.Call) and getattr(node.func, "id", "") == "all":
            return F.coalesce(self.value(node), F.lit(False))
        c = self.value(node)
        kind = self.kind(node)
        if kind == "boolean":
            return F.coalesce(c, F.lit(False))
        if kind == "string":
            return c.isNotNull() & (c != "")
        if kind in ("date", "timestamp"):
            return c.isNotNull()
        return c.isNotNull() & (c != 0)

    def value(self, node: ast.AST) -> Column:
        match node:
            case ast.Constant(value=bool() | int() | float() | str() | None as v):
                return F.lit(v)
            case ast.Name(id=("null" | "None")):
                return F.lit(None)
            case ast.Name(id=name):
                if name not in self.kinds:
                    raise ExpressionError(f"no column {name}")
                return F.col(f"`{name}`")
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -self.value(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return self.value(x)
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return ~self.truth(x)
            case ast.BinOp(left=a, op=op, right=b):
                x, y = self.value(a), self.value(b)
                if isinstance(op, ast.Sub) and "date" in (self.kind(a), self.kind(b)):
                    return F.datediff(x, y)
                match op:
                    case ast.Add():
                        return F.try_add(x, y)
                    case ast.Sub():
                        return F.try_subtract(x, y)
                    case ast.Mult():
                        return F.try_multiply(x, y)
                    case ast.Div():
                        return F.try_divide(x.cast("double"), y.cast("double"))
                raise ExpressionError(f"operator {type(op).__name__}")
            case ast.Compare(left=a, ops=ops, comparators=rest):
                done, left = None, a
                for op, right in zip(ops, rest):
                    if type(op) not in _COMPARE:
                        raise ExpressionError(f"comparison {type(op).__name__}")
                    one = getattr(self.value(left), _COMPARE[type(op)])(self.value(right))
                    done, left = one if done is None else done & one, right
                return done
            case ast.BoolOp(op=op, values=values):
                done = self.truth(values[0])
                for v in values[1:]:
                    done = done & self.truth(v) if isinstance(op, ast.And) else done | self.truth(v)
                return done
            case ast.IfExp(test=t, body=a, orelse=b):
                return F.when(self.truth(t), self.value(a)).otherwise(self.value(b))
            case ast.Call(func=ast.Name(id="all"), args=[ast.List(elts=elts) | ast.Tuple(elts=elts)], keywords=[]):
                done = F.lit(True)
                for e in elts:
                    done = done & self.truth(e)
                return done
            case ast.Call(func=ast.Name(id="today"), args=[], keywords=[]):
                return F.lit(self.today).cast("date") if self.today else F.current_date()
        raise ExpressionError(f"{type(node).__name__} isn't part of the language")


def compile_expression(text: str, df: DataFrame, today: str | None = None) -> Column:
    """text over df's columns -> Column. today (ISO) makes results repeatable. Division by 0 gives null."""
    try:
        tree = ast.parse(re.sub(r"\bnull\b", "None", text.strip()), mode="eval")
    except SyntaxError as e:
        raise ExpressionError(str(e)) from e
    return _Compiler(dict(df.dtypes), today).value(tree.body)


def derive(df: DataFrame, fields: dict[str, str], today: str | None = None) -> tuple[DataFrame, list[str], dict[str, str]]:
    """Adds derived columns in order, later ones over earlier: (df, added, skipped with the reason)."""
    added, skipped = [], {}
    for name, text in fields.items():
        try:
            df = df.withColumn(name, compile_expression(text, df, today))
            df.schema  # noqa: B018 - types are checked here
            added.append(name)
        except Exception as e:  # a bad expression costs its column, not the run
            skipped[name] = str(e).split("\n")[0]
    return df, added, skipped
