"""The five relational operators."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..errors import Code, EngineError
from ..functions.expressions import predicate, value
from ..plans import logical

if TYPE_CHECKING:
    from ..sources.catalog import Catalog


def run(plan: logical.Plan, catalog: Catalog) -> DataFrame:
    """Runs CreateTable and Insert at once; gives the lazy DataFrame of a query."""
    match plan:
        case logical.CreateTable():
            return _create(plan, catalog)
        case logical.Insert():
            return _insert(plan, catalog)
        case logical.Scan():
            return catalog.dataframe(plan.table)
        case logical.Filter():
            return run(plan.child, catalog).filter(predicate(plan.predicate))
    return run(plan.child, catalog).select(*(value(e).alias(name) for name, e in plan.items))


def nothing(catalog: Catalog) -> DataFrame:
    """No rows and no columns: the result of a statement that isn't a query."""
    return catalog.spark.createDataFrame([], T.StructType([]))


def _create(plan: logical.CreateTable, catalog: Catalog) -> DataFrame:
    s = plan.statement
    try:
        catalog.create_table(s.name, s.columns)
    except EngineError as e:
        if not (s.if_not_exists and e.code is Code.AlreadyExists):
            raise
    return nothing(catalog)


def _insert(plan: logical.Insert, catalog: Catalog) -> DataFrame:
    catalog.open_table(plan.statement.table.name).insert_rows(plan.statement.rows)
    return nothing(catalog)
