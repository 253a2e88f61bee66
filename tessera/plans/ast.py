"""Statements and expressions as written."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Literal:
    """``kind``: int, float, str, bool or null."""

    kind: str
    value: int | float | str | bool | None = None


@dataclass(frozen=True)
class ColumnRef:
    name: str


@dataclass(frozen=True)
class Binary:
    """``op``: one of = <> < <= > >= and or."""

    op: str
    left: Expr
    right: Expr


Expr = Literal | ColumnRef | Binary


@dataclass(frozen=True)
class TypeName:
    name: str
    param: int | None = None


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: TypeName
    not_null: bool = False
    primary_key: bool = False
    unique: bool = False


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnDef, ...]
    if_not_exists: bool = False


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple[Expr, ...], ...]


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Select:
    items: tuple[Star | Item, ...]
    table: str
    where: Expr | None = None


Statement = CreateTable | Insert | Select
