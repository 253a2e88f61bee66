"""The type registry: what a value of each SQL type is in Spark, and its functions.

A type has a Spark type, a parser of literal text, and column functions for text, order and hash,
all from built-in expressions. Five types are built in; any other is registered under a new name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Code, EngineError

#: White space of the C locale, which number literals may have around them.
_SPACE = " \t\n\v\f\r"


def _same(c: Column) -> Column:
    return c


@dataclass(frozen=True)
class SqlType:
    """A registered type. ``order`` is None where values can't be compared."""

    name: str
    spark: T.DataType
    parse: Callable[[str], Any]
    fixed_size: int | None = None
    text: Callable[[Any], str] = str
    format: Callable[[Column], Column] = field(default=lambda c: c.cast("string"))
    order: Callable[[Column], Column] | None = _same
    hash: Callable[[Column], Column] = field(default=lambda c: F.xxhash64(c))
    oid: int = 0

    def value(self, text: str) -> Any:
        try:
            return self.parse(text)
        except ValueError as e:
            raise EngineError(Code.InvalidArgument, f"'{text}' is no {self.name}") from e


def _integer(bits: int) -> Callable[[str], int]:
    def parse(text: str) -> int:
        if not re.fullmatch(rf"[{_SPACE}]*[+-]?[0-9]+[{_SPACE}]*", text):
            raise ValueError(text)
        value = int(text)
        if not -(1 << bits - 1) <= value < 1 << bits - 1:
            raise ValueError(text)
        return value

    return parse


def _double(text: str) -> float:
    """The longest C number with optional white space before it and nothing behind; the empty text is zero."""
    if text == "":
        return 0.0
    body = text.lstrip(_SPACE)
    if re.fullmatch(r"[+-]?0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)(?:[pP][+-]?[0-9]+)?", body):
        try:
            value = float.fromhex(body)
        except OverflowError as e:
            raise ValueError(text) from e
    elif re.fullmatch(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", body):
        value = float(body)
    else:
        raise ValueError(text)
    if not math.isfinite(value):
        raise ValueError(text)
    return value


def double_text(value: float) -> str:
    """The shortest text that reads back as the same double, in fixed or exponent form; fixed if both are as long.

    ``double_format`` says the same of columns.
    """
    if not math.isfinite(value):
        return str(value)
    digits, exponent = f"{value:.17e}".split("e")
    for n in range(17):
        digits, exponent = f"{value:.{n}e}".split("e")
        if float(f"{digits}e{exponent}") == value:
            break
    scientific = f"{digits}e{exponent}"
    places = max(0, len(digits.partition(".")[2]) - int(exponent))
    fixed = f"{value:.{places}f}"
    return fixed if len(fixed) <= len(scientific) else scientific


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` has it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def double_format(c: Column) -> Column:
    """``double_text`` of a column, from the digits that Spark's own cast gives.

    These may be one more than needed, so that one less is tried.
    """
    size = F.abs(c)

    def split(s: Column) -> Column:
        mantissa, power = F.split_part(s, F.lit("E"), F.lit(1)), F.split_part(s, F.lit("E"), F.lit(2))
        whole = F.split_part(mantissa, F.lit("."), F.lit(1))
        return F.struct(F.concat(whole, F.split_part(mantissa, F.lit("."), F.lit(2))).alias("every"), (F.length(whole) + F.coalesce(power.try_cast("int"), F.lit(0))).alias("point"))

    def trimmed(x: Column) -> Column:
        bare = F.regexp_replace(x["every"], "^0+", "")
        return F.struct(bare.alias("bare"), (x["point"] - F.length(x["every"]) + F.length(bare) - 1).alias("first"))

    def tried(x: Column) -> Column:
        fewer = ((x["bare"].try_cast("bigint") + 5) / 10).cast("bigint").cast("string")
        return F.struct(x["bare"].alias("bare"), x["first"].alias("first"), fewer.alias("fewer"), F.concat(fewer, F.lit("E"), (x["first"] - F.length(x["bare"]) + 2).cast("string")).try_cast("double").alias("again"))

    def digits(x: Column) -> Column:
        shorter = (F.length(x["bare"]) > 1) & (x["again"] == size)
        first = F.when(shorter, x["first"] + F.length(x["fewer"]) - F.length(x["bare"]) + 1).otherwise(x["first"])  # the first digit's power of ten
        return F.struct(F.regexp_replace(F.when(shorter, x["fewer"]).otherwise(x["bare"]), "0+$", "").alias("digits"), first.alias("first"))

    def forms(x: Column) -> Column:
        d, first, n = x["digits"], x["first"], F.length(x["digits"])
        power = F.abs(first).cast("string")
        scientific = F.concat(F.substring(d, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substr(d, F.lit(2)))).otherwise(""), F.when(first < 0, "e-").otherwise("e+"), F.when(F.length(power) < 2, F.concat(F.lit("0"), power)).otherwise(power))
        # whole numbers are written exactly; above 2**62 they are multiples of 512
        exact = F.when(size < 2.0**62, size.try_cast("bigint").cast("string")).otherwise(((size / 512).try_cast("bigint").cast("decimal(20,0)") * F.lit(512).cast("decimal(4,0)")).cast("string"))
        fixed = (
            F.when(first < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -first - 1), d))
            .when((first >= n - 1) & (first < 21), exact)
            .when(first >= n - 1, F.concat(d, F.repeat(F.lit("0"), first - n + 1)))
            .otherwise(F.concat(F.substr(d, F.lit(1), first + 1), F.lit("."), F.substr(d, first + 2)))
        )
        return F.struct(scientific.alias("scientific"), fixed.alias("fixed"))

    text = _let(F.abs(c).cast("string"), split)
    for step in (trimmed, tried, digits, forms):
        text = _let(text, step)
    shortest = _let(text, lambda x: F.when(F.length(x["fixed"]) <= F.length(x["scientific"]), x["fixed"]).otherwise(x["scientific"]))
    sign = F.when(c.cast("string").startswith("-"), "-").otherwise("")
    return F.when(F.isnan(c), "nan").when(size == float("inf"), F.concat(sign, F.lit("inf"))).when(c == 0, F.concat(sign, F.lit("0"))).when(c.isNotNull(), F.concat(sign, shortest))


def _boolean(text: str) -> bool:
    if text not in ("true", "false"):
        raise ValueError(text)
    return text == "true"


def _timestamp(text: str) -> datetime:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?", text):
        raise ValueError(text)
    return datetime.fromisoformat(text)


def _no_literal(text: str) -> Any:
    raise ValueError(text)


BUILTIN = [
    SqlType("int32", T.IntegerType(), _integer(32), 4),
    SqlType("int64", T.LongType(), _integer(64), 8),
    SqlType("float64", T.DoubleType(), _double, 8, text=double_text, format=double_format),
    SqlType("bool", T.BooleanType(), _boolean, 1, text=lambda v: "true" if v else "false"),
    SqlType("text", T.StringType(), str),
]
#: Types beyond the built-in five, for tables that come from Parquet files.
EXTENSIONS = [
    SqlType("timestamp", T.TimestampNTZType(), _timestamp, 8, text=lambda v: v.isoformat(sep=" ")),
    SqlType("float32_array", T.ArrayType(T.FloatType()), _no_literal, order=None),
]
#: SQL spellings of the built-in types (fixed values); matched in lower case.
ALIASES = {
    "integer": "int32", "int": "int32", "int4": "int32", "int32": "int32",
    "bigint": "int64", "int8": "int64", "int64": "int64",
    "double precision": "float64", "double": "float64", "float8": "float64", "float64": "float64",
    "boolean": "bool", "bool": "bool",
    "varchar": "text", "character varying": "text", "text": "text",
}


class TypeRegistry:
    """Types by name and by the number they got when they were registered, from 1 on."""

    def __init__(self, types: list[SqlType] | None = None):
        self._by_oid: dict[int, SqlType] = {}
        self._by_name: dict[str, SqlType] = {}
        for t in BUILTIN + EXTENSIONS if types is None else types:
            self.register(t)

    def register(self, new: SqlType) -> SqlType:
        if not new.name:
            raise EngineError(Code.InvalidArgument, "a type needs a name")
        if new.name in self._by_name:
            raise EngineError(Code.AlreadyExists, f"type '{new.name}' is registered")
        own = SqlType(**{**new.__dict__, "oid": len(self._by_oid) + 1})
        self._by_oid[own.oid] = self._by_name[own.name] = own
        return own

    def lookup(self, key: str | int) -> SqlType:
        found = (self._by_name if isinstance(key, str) else self._by_oid).get(key)
        if found is None:
            raise EngineError(Code.NotFound, f"no type {key!r}")
        return found

    def of_spark(self, spark: T.DataType) -> SqlType:
        for t in self._by_oid.values():
            if t.spark == spark or isinstance(spark, T.ArrayType) and isinstance(t.spark, T.ArrayType) and t.spark.elementType == spark.elementType:
                return t
        raise EngineError(Code.TypeNotFound, f"no registered type stands for {spark.simpleString()}")

    def all(self) -> list[SqlType]:
        return list(self._by_oid.values())
