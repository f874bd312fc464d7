"""Expressions to Spark columns, and constant parts to literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions import types as K
from keyloom.functions.typed import SPARK_TYPES
from keyloom.plans import ast as A


def _constant(op: str, a: object, b: object) -> A.Literal | None:
    if op in ("==", "!="):
        return A.Literal((a == b) == (op == "=="), "BOOLEAN")
    if op in A.COMPARE:
        return A.Literal({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op], "BOOLEAN")
    if op in A.LOGICAL:
        return A.Literal(a and b if op == "AND" else a or b, "BOOLEAN")
    if op == "/":
        if b == 0:
            return None  # left to fail where it runs
        if isinstance(a, int) and isinstance(b, int):
            q = abs(a) // abs(b)
            return A.Literal(q if (a < 0) == (b < 0) else -q, "I64")
        return A.Literal(a / b, "F64")
    v = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}[op]()
    if isinstance(v, int) and not K.fits(v, "I64"):
        return None
    return A.Literal(v, "I64" if isinstance(v, int) else "F64")


def fold(e: A.Expr | None) -> A.Expr | None:
    """The expression with its constant parts computed. Spark would fold them too; access paths need the values earlier."""
    if isinstance(e, A.Unary):
        of = fold(e.of)
        if e.op == "+":
            return of
        return A.Literal(-of.value, of.kind) if isinstance(of, A.Literal) and of.value is not None else A.Unary(e.op, of)
    if isinstance(e, A.Binary):
        left, right = fold(e.left), fold(e.right)
        if isinstance(left, A.Literal) and isinstance(right, A.Literal) and None not in (left.value, right.value):
            numbers = left.kind in K.NUMBERS and right.kind in K.NUMBERS
            if (numbers or left.kind == right.kind) and (out := _constant(e.op, left.value, right.value)) is not None:
                return out
        return A.Binary(e.op, left, right)
    return e


def _number(e: A.Expr, types: dict[str, str]) -> tuple[Column, bool]:
    """A number widened for arithmetic, and whether it is floating."""
    c, kind = _typed(e, types)
    if kind in K.FLOATS:
        return c.cast("double"), True
    return (c, False) if kind == "U64" else (c.cast("bigint"), False)


def _typed(e: A.Expr, types: dict[str, str]) -> tuple[Column, str]:
    if isinstance(e, A.Literal):
        return F.lit(e.value).cast(SPARK_TYPES.get(e.kind, "void")), e.kind
    if isinstance(e, A.Name):
        return F.col(f"`{e.name}`"), types[e.name]
    if isinstance(e, A.Unary):
        c, floating = _number(e.of, types)
        return (-c if e.op == "-" else c), "F64" if floating else "I64"
    if e.op in A.LOGICAL:
        a, b = _typed(e.left, types)[0], _typed(e.right, types)[0]
        return (a & b if e.op == "AND" else a | b), "BOOLEAN"
    if e.op in A.COMPARE:
        a, b = _typed(e.left, types)[0], _typed(e.right, types)[0]
        if e.op in ("==", "!="):
            same = a.eqNullSafe(b)
            return (same if e.op == "==" else ~same), "BOOLEAN"
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e.op], "BOOLEAN"
    (a, f), (b, g) = _number(e.left, types), _number(e.right, types)
    if f or g:
        a, b = a.cast("double"), b.cast("double")
    if e.op == "/":
        return (a / b, "F64") if f or g else (F.call_function("div", a, b), "I64")
    return {"+": a + b, "-": a - b, "*": a * b}[e.op], "F64" if f or g else "I64"


def column(e: A.Expr, types: dict[str, str]) -> Column:
    """The expression as a column.

    == and != are null-safe; < and the like, and arithmetic, give null on null; AND and OR are
    three-valued. Integers are computed as bigint and divided towards zero, floats as double;
    overflow and division by zero raise. U64 columns stay decimals.
    """
    return _typed(e, types)[0]


def casted(e: A.Expr, types: dict[str, str], kind: str) -> Column:
    """The expression as a value of a column type; an integer beyond the type's range raises."""
    c, source = _typed(e, types)
    out = c.cast(SPARK_TYPES[kind])
    if kind in K.UNSIGNED and source != kind:
        low, high = (F.lit(x).cast("decimal(20,0)") for x in (0, (1 << int(kind[1:])) - 1))
        out = F.when(c.isNull() | c.cast("decimal(20,0)").between(low, high), out).otherwise(F.raise_error(F.lit(f"out of the range of {kind}")).cast(SPARK_TYPES[kind]))
    return out


__all__ = ["casted", "column", "fold"]
