"""Logical plans: five operators, a SELECT always Project(Filter?(Scan))."""

from __future__ import annotations

from dataclasses import dataclass

from . import bound


@dataclass(frozen=True)
class CreateTable:
    statement: bound.CreateTable


@dataclass(frozen=True)
class Insert:
    statement: bound.Insert


@dataclass(frozen=True)
class Scan:
    table: bound.Relation


@dataclass(frozen=True)
class Filter:
    child: Scan
    predicate: bound.Expr


@dataclass(frozen=True)
class Project:
    child: Scan | Filter
    items: tuple[tuple[str, bound.Expr], ...]


Plan = CreateTable | Insert | Scan | Filter | Project


def plan(statement: bound.Statement) -> Plan:
    match statement:
        case bound.CreateTable():
            return CreateTable(statement)
        case bound.Insert():
            return Insert(statement)
    scan = Scan(statement.table)
    return Project(Filter(scan, statement.where) if statement.where is not None else scan, statement.items)
