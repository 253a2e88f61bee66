"""Bound expressions as Spark columns, with two-valued logic.

A comparison with NULL is false, and AND and OR take a NULL for false. Where NULL and false both
drop a row (a filter, below any ANDs and ORs, as there is no NOT) comparisons stay bare, so that
they reach the Parquet scan; anywhere else they are wrapped.
"""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import bound

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_LOGIC: dict[str, Callable[[Column, Column], Column]] = {"and": operator.and_, "or": operator.or_}


def _operands(e: bound.Compare) -> tuple[Column, Column]:
    order = (lambda c: c) if e.op in ("=", "<>") else e.left.type.order
    return order(value(e.left)), order(value(e.right))


def value(e: bound.Expr) -> Column:
    """The expression's value; a computed boolean is never NULL."""
    match e:
        case bound.Column():
            return F.col(f"`{e.name}`")
        case bound.Value():
            return F.lit(e.value).cast(e.type.spark)
        case bound.Compare():
            return F.coalesce(_COMPARE[e.op](*_operands(e)), F.lit(False))
    return _LOGIC[e.op](_truth(e.left), _truth(e.right))


def _truth(e: bound.Expr) -> Column:
    return F.coalesce(value(e), F.lit(False)) if isinstance(e, bound.Column) else value(e)


def predicate(e: bound.Expr) -> Column:
    """The expression where a row is kept only if it is true."""
    match e:
        case bound.Logical():
            return _LOGIC[e.op](predicate(e.left), predicate(e.right))
        case bound.Compare():
            return _COMPARE[e.op](*_operands(e))
    return value(e)
