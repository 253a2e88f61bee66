"""Bound statements: names are resolved and every expression has a type."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from ..functions.types import SqlType


@dataclass(frozen=True)
class Column:
    """A column of a table, in its declared spelling; ``number`` counts from 1."""

    name: str
    type: SqlType
    nullable: bool = True
    number: int = 0
    param: int | None = None
    primary_key: bool = False
    unique: bool = False


@dataclass(frozen=True)
class Value:
    type: SqlType
    value: Any


@dataclass(frozen=True)
class Compare:
    op: str
    left: Expr
    right: Expr
    type: SqlType


@dataclass(frozen=True)
class Logical:
    op: str
    left: Expr
    right: Expr
    type: SqlType


Expr = Column | Value | Compare | Logical


@dataclass(frozen=True)
class Relation:
    oid: int
    name: str
    columns: tuple[Column, ...]


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[Column, ...]
    if_not_exists: bool


@dataclass(frozen=True)
class Insert:
    table: Relation
    targets: tuple[Column, ...]
    rows: tuple[tuple[Any, ...], ...]


@dataclass(frozen=True)
class Select:
    table: Relation
    #: (output name, expression) of each item; a star is already spread.
    items: tuple[tuple[str, Expr], ...]
    where: Expr | None


Statement = CreateTable | Insert | Select
