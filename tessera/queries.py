"""The registered queries of the engine and the same in DuckDB SQL.

Each SELECT is given in the engine's dialect. Where that differs from standard SQL (two-valued
logic, literals that take a column's type) the DuckDB text spells the meaning out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .engine import Engine
from .functions.types import SqlType, TypeRegistry
from .plans.bound import Column, Relation
from .sources.store import scratch
from .sources.table import TupleId

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def engine(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    """An engine in a folder of its own with some of the driver's tables registered."""
    e = Engine(spark, scratch(spark, "engine"))
    for t in tables:
        e.register_parquet(t, f"{sf_dir}/{t}.parquet")
    return e


def _select(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    table = sql.split(" FROM ")[1].split()[0]
    return lambda spark, sf_dir: engine(spark, sf_dir, table).execute(sql)


FLAGSHIP = "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45"

#: name: (statement in the dialect, DuckDB SQL or None where it is the same)
SELECTS: dict[str, tuple[str, str | None]] = {
    "flagship": (FLAGSHIP, None),
    "scan_star": ("SELECT * FROM nation", None),
    "project_cols": ("SELECT N_NAME, n_nationkey FROM nation", "SELECT n_name, n_nationkey FROM nation"),
    "project_alias": ("SELECT p_partkey AS pk, p_name AS nm FROM part", None),
    "project_star_plus": ("SELECT *, n_name AS nm FROM nation", None),
    "project_literals": ("SELECT 1 AS i, 'it''s' AS s, TRUE AS b, 2.5 AS f FROM region", "SELECT CAST(1 AS BIGINT) AS i, 'it''s' AS s, TRUE AS b, CAST(2.5 AS DOUBLE) AS f FROM region"),
    "project_unnamed": ("SELECT r_regionkey = 2 FROM region", 'SELECT r_regionkey = 2 AS "?column?" FROM region'),
    "project_computed_bool": ("SELECT o_orderkey, o_totalprice > 1000 AS big FROM orders", "SELECT o_orderkey, coalesce(o_totalprice > 1000, FALSE) AS big FROM orders"),
    "project_logic": ("SELECT l_orderkey, l_linenumber, l_quantity > 10 OR l_tax < 0.02 AND l_returnflag = 'A' AS hit FROM lineitem", "SELECT l_orderkey, l_linenumber, coalesce(l_quantity > 10, FALSE) OR (coalesce(l_tax < CAST(0.02 AS DOUBLE), FALSE) AND coalesce(l_returnflag = 'A', FALSE)) AS hit FROM lineitem"),
    "filter_eq": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 3", None),
    "filter_neq": ("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'", None),
    "filter_lt": ("SELECT p_partkey, p_size FROM part WHERE p_size < 10", None),
    "filter_le": ("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount <= 0.02", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount <= CAST(0.02 AS DOUBLE)"),
    "filter_gt": ("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 100", None),
    "filter_ge": ("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment >= 'F'", None),
    "filter_and": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 10", None),
    "filter_or": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' OR l_quantity < 5", None),
    "filter_precedence": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 1 OR l_linenumber = 2 AND l_returnflag = 'R'", None),
    "filter_parens": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_linenumber = 1 OR l_linenumber = 2) AND l_returnflag = 'R'", None),
    "filter_col_col": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = l_suppkey", None),
    "filter_nested_bool": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 10) = FALSE", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE coalesce(l_quantity > 10, FALSE) = FALSE"),
    "filter_bool_literal": ("SELECT n_name FROM nation WHERE TRUE AND n_regionkey = 1", None),
    "coerce_int_to_float": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 45", None),
    "coerce_str_to_int": ("SELECT p_partkey, p_size FROM part WHERE p_size = ' +15 '", "SELECT p_partkey, p_size FROM part WHERE p_size = 15"),
    "coerce_negative": ("SELECT c_custkey FROM customer WHERE c_acctbal < '-500'", "SELECT c_custkey FROM customer WHERE c_acctbal < -500"),
    "coerce_int_to_text": ("SELECT p_partkey, p_brand FROM part WHERE p_brand > 5", "SELECT p_partkey, p_brand FROM part WHERE p_brand > '5'"),
    "coerce_float_to_int": ("SELECT p_partkey FROM part WHERE p_size = 15.0", "SELECT p_partkey FROM part WHERE p_size = 15"),
    "literal_left": ("SELECT p_partkey FROM part WHERE 15 = p_size", None),
    "coerce_timestamp_ext": ("SELECT o_orderkey FROM orders WHERE o_orderdate >= '1995-01-01'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'"),
    "array_project_ext": ("SELECT vec_id, label FROM embeddings WHERE label = 3", None),
    "comments_and_case": ("select n_name as NAME -- a comment\n FROM nation where /* another */ N_REGIONKEY <> 0", "SELECT n_name AS NAME FROM nation WHERE n_regionkey <> 0"),
}

#: NULL in every combination of two integers and two booleans, as INSERT rows.
_NULLS = [(i, a, c, b, d) for i, (a, c, b, d) in enumerate((a, c, b, d) for a in ("NULL", 1, 2) for c in ("NULL", 1, 2) for b in ("NULL", "TRUE", "FALSE") for d in ("NULL", "TRUE", "FALSE"))]
_NULL_ROWS = ", ".join(f"({', '.join(map(str, r))})" for r in _NULLS)
_NULL_VIEW = f"(SELECT CAST(x AS INTEGER) AS rid, CAST(y AS INTEGER) AS a, CAST(z AS INTEGER) AS c, CAST(v AS BOOLEAN) AS b, CAST(w AS BOOLEAN) AS d FROM (VALUES {_NULL_ROWS}) t(x, y, z, v, w)) nulls"

#: name: (SELECT over the table nulls, the same for DuckDB)
NULL_SELECTS = {
    "insert_nulls_filter": ("SELECT rid FROM nulls WHERE a = 1 OR b", "SELECT rid FROM {nulls} WHERE a = 1 OR b"),
    "null_nested_false": ("SELECT rid FROM nulls WHERE (a = 1) = FALSE AND (b OR a < c) = d", "SELECT rid FROM {nulls} WHERE coalesce(a = 1, FALSE) = FALSE AND (coalesce(b, FALSE) OR coalesce(a < c, FALSE)) = d"),
    "null_projected": ("SELECT rid, a <> c AS ne, b AND d AS both, b FROM nulls", "SELECT rid, coalesce(a <> c, FALSE) AS ne, coalesce(b, FALSE) AND coalesce(d, FALSE) AS both, b FROM {nulls}"),
}


def _nulls(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        e.execute("CREATE TABLE nulls (rid INT NOT NULL, a INT, c INT, b BOOLEAN, d BOOL)")
        e.execute(f"INSERT INTO nulls VALUES {_NULL_ROWS}")
        return e.execute(sql)

    return run


def ddl_insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.execute("CREATE TABLE users (id INTEGER NOT NULL, name VARCHAR(3), active BOOLEAN, score DOUBLE PRECISION)")
    e.execute("CREATE TABLE IF NOT EXISTS users (other TEXT)")
    e.execute("INSERT INTO users VALUES (1, 'alice', TRUE, 1.5), (2, 'bob', FALSE, 2)")
    e.execute("INSERT INTO users (active, id) VALUES ('true', '3')")
    return Engine(spark, e.catalog.root).execute("SELECT * FROM users WHERE active = TRUE")


def insert_multirow(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.execute("CREATE TABLE t (k BIGINT, v TEXT)")
    e.execute("INSERT INTO t VALUES " + ", ".join(f"({i}, 'v{i}')" for i in range(50)))
    return e.execute("SELECT v, k FROM t WHERE k >= 10 AND k < 40")


def _system(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        e.execute("CREATE TABLE users (id INT NOT NULL, name TEXT)")
        return e.execute(sql)

    return run


def _loaded(spark: SparkSession, sf_dir: str, name: str):
    """The driver's table ``name`` copied into a stored table of the same columns."""
    e = engine(spark, sf_dir, name)
    source = e.catalog.relation(name)
    e.catalog.create_table(f"{name}_copy", source.columns)
    table = e.catalog.open_table(f"{name}_copy")
    table.append(e.table(name))
    return e, table


def storage_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, table = _loaded(spark, sf_dir, "orders")
    table.delete_where(table.dataframe(identity=True).where(F.col("o_orderstatus") == "F"))
    return e.execute("SELECT o_orderkey, o_orderstatus FROM orders_copy WHERE o_totalprice > 1000")


def storage_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, table = _loaded(spark, sf_dir, "region")
    rows = {values[0]: (tid, values) for tid, values in table.scan_rows()}
    table.update(rows[2][0], (2, "changed"))
    table.delete(rows[4][0])
    table.compact()
    return e.execute("SELECT * FROM region_copy")


def table_scan_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan with row identities: every live row has one of its own."""
    _, table = _loaded(spark, sf_dir, "nation")
    return table.dataframe(identity=True).agg(F.countDistinct("_tid_page", "_tid_slot").alias("ids"), F.count("*").alias("n"))


def type_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns as text by the registry."""
    e = engine(spark, sf_dir, "part")
    return e.table("part").select("p_partkey", e.catalog.types.lookup("int32").format(F.col("p_size")).alias("size_text"))


def hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows grouped by the hash of a value: equal values fall together, unlike ones don't."""
    e = engine(spark, sf_dir, "part")
    text, number = (e.catalog.types.lookup(t) for t in ("text", "int32"))
    return e.table("part").groupBy(text.hash(F.col("p_brand")).alias("h"), number.hash(F.col("p_size")).alias("g")).agg(F.min("p_brand").alias("brand"), F.max("p_size").alias("size"), F.count("*").alias("n")).drop("h", "g")


def float_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """float64 columns as text."""
    e = engine(spark, sf_dir, "customer")
    return e.execute("SELECT c_custkey, c_acctbal FROM customer").select("c_custkey", e.catalog.types.lookup("float64").format(F.col("c_acctbal")).alias("balance"))


def array_select_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array column through SELECT, spread to a row an element."""
    e = engine(spark, sf_dir, "embeddings")
    got = e.execute("SELECT vec_id AS v, embedding FROM embeddings WHERE label = 3")
    return got.select("v", F.posexplode("embedding").alias("place", "x")).select("v", "place", F.col("x").cast("double").alias("x"))


def coerce_bool_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.execute("CREATE TABLE t (a TEXT, b VARCHAR(2))")
    e.execute("INSERT INTO t VALUES (TRUE, FALSE), (NULL, 'x')")
    return e.execute("SELECT a, b FROM t WHERE a = TRUE OR b = 'x'")


def statement_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script whose semicolons also stand in strings and comments, as lines of its output."""
    e = engine(spark, sf_dir)
    out = e.run_script("CREATE TABLE t (a INT, b TEXT); -- not; here\nINSERT INTO t VALUES (1, 'x;y') /* nor; here 'or this */ ;; SELECT b FROM t;")
    return spark.createDataFrame(list(enumerate(out.split("\n"))), "k int, line string")


def table_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, table = _loaded(spark, sf_dir, "nation")
    return spark.createDataFrame([(c.number, c.name, c.type.name, c.nullable) for c in table.schema().columns], "number int, name string, type string, nullable boolean")


class MemoryTable:
    """A table format of its own: rows in a list on the driver."""

    def __init__(self, spark: SparkSession, relation: Relation, path: str):
        self.spark, self.relation, self.path, self.rows = spark, relation, path, []

    def schema(self) -> Relation:
        return self.relation

    def dataframe(self, identity: bool = False) -> DataFrame:
        names = ", ".join(f"{c.name} {c.type.spark.simpleString()}" for c in self.relation.columns) + ", _tid_page bigint, _tid_slot bigint"
        rows = self.spark.createDataFrame([(*r, 0, i) for i, r in enumerate(self.rows) if r is not None], names)
        return rows if identity else rows.drop("_tid_page", "_tid_slot")

    def insert_rows(self, rows) -> list[TupleId]:
        at = len(self.rows)
        self.rows += [tuple(r) for r in rows]
        return [TupleId(0, i) for i in range(at, len(self.rows))]

    def delete(self, ids) -> None:
        for t in [ids] if isinstance(ids, TupleId) else ids:
            self.rows[t.slot_idx] = None

    def update(self, tid: TupleId, row: tuple) -> TupleId:
        self.delete(tid)
        return self.insert_rows([row])[0]

    def drop(self) -> None:
        self.rows.clear()


def table_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements over a table format, a factory and a path resolver that are not the engine's own."""
    opened = []

    def opener(session: SparkSession, relation: Relation, path: str) -> MemoryTable:
        opened.append((relation.oid, relation.name, path.rpartition("/")[2]))
        return MemoryTable(session, relation, path)

    e = Engine(spark, scratch(spark, "engine"), opener=opener, place=lambda oid, name: f"/elsewhere/{name}-{oid}")
    e.execute("CREATE TABLE t (a INT, b TEXT)")
    e.execute("INSERT INTO t VALUES (1, 'x'), (2, 'y')")
    e.catalog.open_table("t").delete(TupleId(0, 0))
    (oid, name, place), = opened
    return e.execute("SELECT a, b FROM t").withColumns({"oid": F.lit(oid), "name": F.lit(name), "place": F.lit(place)})


def custom_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered type with its own parser and order: comparisons go by it."""
    types = TypeRegistry()
    grade = types.register(SqlType("grade", T.StringType(), lambda s: s.strip().lower(), 4, order=lambda c: F.length(c)))
    e = Engine(spark, scratch(spark, "engine"), types)
    e.catalog.create_table("t", [Column("k", types.lookup("int32"), False), Column("g", grade)])
    e.catalog.open_table("t").insert_rows([(1, "a"), (2, "bbb"), (3, "cc"), (4, None)])
    return e.execute("SELECT k, g FROM t WHERE g >= ' ZZ ' OR g = 'A'")


def catalog_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a catalog holds after a drop, a close and a new start: the number of a dropped table isn't used again."""
    e = engine(spark, sf_dir)
    for name in ("one", "two"):
        e.execute(f"CREATE TABLE {name} (a INT)")
    e.catalog.drop_table(e.catalog.get_class("two")["oid"])
    e.catalog.close()
    again = Engine(spark, e.catalog.root)
    again.execute("CREATE TABLE three (a INT)")
    return again.execute("SELECT oid, name FROM sys_class WHERE relkind = 'table'")


OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "ddl_insert_select": (ddl_insert_select, "SELECT CAST(id AS INTEGER) AS id, name, active, CAST(score AS DOUBLE) AS score FROM (VALUES (1, 'alice', TRUE, 1.5), (3, NULL, TRUE, NULL)) t(id, name, active, score)"),
    "insert_multirow": (insert_multirow, "SELECT 'v' || k AS v, CAST(k AS BIGINT) AS k FROM range(10, 40) t(k)"),
    "catalog_type": (_system("SELECT * FROM sys_type"), "SELECT CAST(oid AS INTEGER) AS oid, name, CAST(typlen AS INTEGER) AS typlen FROM (VALUES (1, 'int32', 4), (2, 'int64', 8), (3, 'float64', 8), (4, 'bool', 1), (5, 'text', -1)) t(oid, name, typlen)"),
    "catalog_class": (_system("SELECT * FROM sys_class WHERE oid > 0"), "SELECT CAST(oid AS INTEGER) AS oid, name, relkind FROM (VALUES (1, 'sys_type', 'system'), (2, 'sys_class', 'system'), (3, 'sys_attribute', 'system'), (4, 'sys_index', 'index'), (5, 'users', 'table')) t(oid, name, relkind)"),
    "catalog_attribute": (_system("SELECT attnum, name, type_oid, nullable FROM sys_attribute WHERE attrelid = 5"), "SELECT CAST(attnum AS INTEGER) AS attnum, name, CAST(type_oid AS INTEGER) AS type_oid, nullable FROM (VALUES (1, 'id', 1, FALSE), (2, 'name', 5, TRUE)) t(attnum, name, type_oid, nullable)"),
    "catalog_index": (_system("SELECT oid, am_name FROM sys_index"), "SELECT CAST(1 AS INTEGER) AS oid, 'x' AS am_name WHERE FALSE"),
    "storage_delete": (storage_delete, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 1000 AND o_orderstatus <> 'F'"),
    "storage_update": (storage_update, "SELECT r_regionkey, CASE r_regionkey WHEN 2 THEN 'changed' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 4"),
    "table_scan_ids": (table_scan_ids, "SELECT count(*) AS ids, count(*) AS n FROM nation"),
    "type_text": (type_text, "SELECT p_partkey, CAST(p_size AS VARCHAR) AS size_text FROM part"),
    "hash_groups": (hash_groups, "SELECT p_brand AS brand, p_size AS size, count(*) AS n FROM part GROUP BY ALL"),
    "float_text": (float_text, "SELECT c_custkey, regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', '') AS balance FROM customer"),
    "array_select_ext": (array_select_ext, "SELECT vec_id AS v, CAST(i - 1 AS INTEGER) AS place, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE label = 3)"),
    "coerce_bool_to_text": (coerce_bool_to_text, "SELECT a, b FROM (VALUES ('true', 'false'), (NULL, 'x')) t(a, b)"),
    "statement_separators": (statement_separators, "SELECT CAST(k AS INTEGER) AS k, line FROM (VALUES (0, 'OK'), (1, ''), (2, 'OK'), (3, ''), (4, 'b'), (5, 'x;y'), (6, '(1 row)'), (7, ''), (8, '')) t(k, line)"),
    "table_schema": (table_schema, "SELECT CAST(n AS INTEGER) AS number, name, type, TRUE AS nullable FROM (VALUES (1, 'n_nationkey', 'int32'), (2, 'n_name', 'text'), (3, 'n_regionkey', 'int32')) t(n, name, type)"),
    "table_plugin": (table_plugin, "SELECT CAST(2 AS INTEGER) AS a, 'y' AS b, CAST(5 AS INTEGER) AS oid, 't' AS name, 't-5' AS place"),
    "custom_type": (custom_type, "SELECT CAST(k AS INTEGER) AS k, g FROM (VALUES (1, 'a'), (2, 'bbb'), (3, 'cc')) t(k, g)"),
    "catalog_reopened": (catalog_reopened, "SELECT CAST(oid AS INTEGER) AS oid, name FROM (VALUES (5, 'one'), (7, 'three')) t(oid, name)"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _select(sql) for name, (sql, _) in SELECTS.items()},
    **{name: _nulls(sql) for name, (sql, _) in NULL_SELECTS.items()},
    **{name: run for name, (run, _) in OTHERS.items()},
}
ORACLE_SQL: dict[str, str] = {
    **{name: oracle or sql for name, (sql, oracle) in SELECTS.items()},
    **{name: oracle.format(nulls=_NULL_VIEW) for name, (_, oracle) in NULL_SELECTS.items()},
    **{name: oracle for name, (_, oracle) in OTHERS.items()},
}
