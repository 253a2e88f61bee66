"""Lexer, parser, binder and plans, without a session."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.errors import Code, EngineError
from tessera.functions.types import ALIASES, SqlType, TypeRegistry, double_text
from tessera.plans import ast, bound, logical
from tessera.plans.binder import Binder, literal_text
from tessera.plans.lexer import KEYWORDS, tokens
from tessera.plans.parser import parse


class Tables:
    """A catalog in memory."""

    def __init__(self):
        self.types = TypeRegistry()
        columns = (("id", "int32", False), ("big", "int64", True), ("name", "text", True), ("active", "bool", True), ("score", "float64", True), ("at", "timestamp", True), ("v", "float32_array", True))
        self._users = bound.Relation(5, "users", tuple(bound.Column(n, self.types.lookup(t), nullable, i) for i, (n, t, nullable) in enumerate(columns, 1)))

    def relation(self, name):
        if name != "users":
            raise EngineError(Code.NotFound)
        return self._users

    def get_type(self, name):
        return self.types.lookup(name)


def bind(sql):
    return Binder(Tables()).bind(parse(sql)[0])


def code(f, *args):
    with pytest.raises(EngineError) as e:
        f(*args)
    return e.value


def kinds(sql):
    return [t.kind for t in tokens(sql)][:-1]


# --- lexer


def test_keywords_in_any_case_and_identifiers_as_written():
    assert len(KEYWORDS) == 21
    assert kinds("SELECT Select sElEcT") == ["select"] * 3
    assert [t.text for t in tokens("Users _a1 select1")][:-1] == ["Users", "_a1", "select1"]


def test_numbers():
    assert kinds("1 1.5 1e3 1.5E-2 1. .5") == ["integer", "float", "float", "float", "integer", ".", ".", "integer"]


def test_operators_strings_and_unknown():
    assert kinds("= <> < <= > >= ( ) , ; * .") == "= <> < <= > >= ( ) , ; * .".split()
    assert [t.text for t in tokens("'it''s' 'a'")][:-1] == ["'it''s'", "'a'"]
    assert kinds("- ! \"") == ["unknown"] * 3


def test_comments_and_places():
    got = list(tokens("-- one\n/* two\n */ a /* not closed"))
    assert [(t.kind, t.line, t.column) for t in got] == [("word", 3, 5), ("end", 3, 20)]


@given(st.text(max_size=60))
def test_lexer_takes_any_text(text):
    assert list(tokens(text))[-1].kind == "end"


@given(st.text(alphabet="SELECT FROMWHERE()*,;'=<>.abcANDORNOT12 \n-/", max_size=60))
def test_parser_raises_only_its_error(text):
    try:
        parse(text)
    except EngineError as e:
        assert e.code is Code.ParseError


# --- parser


def test_create():
    (s,) = parse("CREATE TABLE IF NOT EXISTS Users (id INTEGER NOT NULL, name VARCHAR(100) UNIQUE, k double precision PRIMARY KEY NULL,)")
    assert (s.table, s.if_not_exists) == ("Users", True)
    assert s.columns == (
        ast.ColumnDef("id", ast.TypeName("INTEGER"), not_null=True),
        ast.ColumnDef("name", ast.TypeName("VARCHAR", 100), unique=True),
        ast.ColumnDef("k", ast.TypeName("double precision"), primary_key=True),
    )


def test_insert_and_select():
    (s,) = parse("INSERT INTO t (a, b) VALUES (1, 'x'), (NULL, TRUE);")
    assert s == ast.Insert("t", ("a", "b"), ((ast.Literal("int", 1), ast.Literal("str", "x")), (ast.Literal("null"), ast.Literal("bool", True))))
    (s,) = parse("SELECT *, a AS x, b = 1 FROM t WHERE a = 1 OR b < 2 AND c >= 3")
    assert s.items == (ast.Star(), ast.Item(ast.ColumnRef("a"), "x"), ast.Item(ast.Binary("=", ast.ColumnRef("b"), ast.Literal("int", 1))))
    assert s.where.op == "or" and s.where.right.op == "and"


def test_chains_lean_left_and_parentheses_hold():
    (s,) = parse("SELECT a FROM t WHERE a AND b AND (c OR d)")
    assert s.where.left.op == "and" and s.where.right.op == "or"


def test_several_statements_with_or_without_separators():
    assert len(parse("SELECT a FROM t; SELECT b FROM t SELECT c FROM t;")) == 3
    assert parse("") == [] and parse(";") == []


@pytest.mark.parametrize(
    "sql",
    ["DELETE FROM t", "SELECT * users", "CREATE TABLE", "SELECT a FROM t WHERE (a = 1", "SELECT a FROM t WHERE a = b = c", "SELECT a FROM t WHERE NOT a", "SELECT a", "SELECT t.a FROM t", "SELECT a AS select FROM t",
     "SELECT a FROM t WHERE a != 1", "SELECT a FROM t WHERE a = -1", "SELECT 99999999999999999999 FROM t", "SELECT 1e999 FROM t", "SELECT 1e FROM t", "SELECT 'open FROM t", "CREATE TABLE t (a Double Precision)", "CREATE TABLE t (a VARCHAR(x))",
     "CREATE TABLE t (a character varying)", "INSERT INTO t VALUES 1", "SELECT a, FROM t", "CREATE TABLE t (a INT DEFAULT 1)", "SELECT a b FROM t"],
)
def test_refused(sql):
    assert code(parse, sql).code is Code.ParseError


# --- types


def test_registration_numbers_and_refusals():
    r = TypeRegistry()
    assert [t.name for t in r.all()][:5] == ["int32", "int64", "float64", "bool", "text"] and [t.oid for t in r.all()][:5] == [1, 2, 3, 4, 5]
    code4 = SqlType("code4", r.lookup("text").spark, str, 4)
    assert r.register(code4).oid == len(r.all())
    assert code(r.register, code4).code is Code.AlreadyExists
    assert code(r.register, SqlType("", code4.spark, str)).code is Code.InvalidArgument
    assert code(r.lookup, "Code4").code is Code.NotFound and code(r.lookup, 99).code is Code.NotFound


@pytest.mark.parametrize(
    ("name", "text", "value"),
    [("int32", "-42", -42), ("int32", " +7 ", 7), ("int64", "123456789", 123456789), ("float64", "3.5", 3.5), ("float64", "", 0.0), ("float64", " 0x1p4", 16.0), ("float64", ".5e1", 5.0), ("bool", "true", True), ("text", " hello", " hello")],
)
def test_parsed(name, text, value):
    assert TypeRegistry().lookup(name).value(text) == value


@pytest.mark.parametrize(("name", "text"), [("int32", "abc"), ("int32", "2147483648"), ("int32", "1 2"), ("int32", ""), ("int32", "1.0"), ("int64", "9223372036854775808"), ("float64", "nan"), ("float64", "inf"), ("float64", "1e999"), ("float64", "1 "), ("float64", " "), ("bool", "yes"), ("bool", "TRUE")])
def test_rejected(name, text):
    assert code(TypeRegistry().lookup(name).value, text).code is Code.InvalidArgument


def test_float_text():
    assert [double_text(x) for x in (3.0, 0.1, 1e-7, 1e5, 1e20, 123456.0, -0.5, 0.0, 1.7976931348623157e308)] == ["3", "0.1", "1e-07", "1e+05", "1e+20", "123456", "-0.5", "0", "1.7976931348623157e+308"]


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_float_text_reads_back(x):
    assert float(double_text(x)) == x


def test_aliases_name_builtin_types():
    assert set(ALIASES.values()) == {"int32", "int64", "float64", "bool", "text"} and ALIASES["int8"] == "int64"


# --- binder


def test_create_resolves_types_and_nullability():
    s = bind("CREATE TABLE t (id INTEGER NOT NULL, name TEXT, nick VARCHAR(100) UNIQUE, d DOUBLE PRECISION)")
    assert [(c.name, c.type.name, c.nullable, c.param, c.unique) for c in s.columns] == [("id", "int32", False, None, False), ("name", "text", True, None, False), ("nick", "text", True, 100, True), ("d", "float64", True, None, False)]


@pytest.mark.parametrize(
    ("sql", "kind", "part"),
    [
        ("CREATE TABLE t (id UUID)", Code.TypeNotFound, "not known"),
        ("CREATE TABLE t (id INTEGER, ID TEXT)", Code.AnalyzerError, "twice"),
        ("INSERT INTO users (missing) VALUES (1)", Code.AnalyzerError, "unknown column"),
        ("INSERT INTO users (id) VALUES (1, 2)", Code.AnalyzerError, "values"),
        ("INSERT INTO users (id, ID) VALUES (1, 2)", Code.AnalyzerError, "twice"),
        ("INSERT INTO users (id) VALUES ('oops')", Code.AnalyzerError, "cannot coerce literal"),
        ("INSERT INTO users (id) VALUES (NULL)", Code.AnalyzerError, "no NULL"),
        ("INSERT INTO users (name) VALUES ('x')", Code.AnalyzerError, "not nullable"),
        ("INSERT INTO users (id) VALUES (big)", Code.AnalyzerError, "has to be a literal"),
        ("SELECT * FROM missing", Code.AnalyzerError, "unknown table"),
        ("SELECT * FROM Users", Code.AnalyzerError, "unknown table"),
        ("SELECT missing FROM users", Code.AnalyzerError, "unknown column"),
        ("SELECT * FROM users WHERE active = 1", Code.AnalyzerError, "cannot coerce literal"),
        ("SELECT * FROM users WHERE id", Code.AnalyzerError, "bool"),
        ("SELECT * FROM users WHERE id = big", Code.AnalyzerError, "compared with"),
        ("SELECT * FROM users WHERE id AND active", Code.AnalyzerError, "bools only"),
        ("SELECT * FROM users WHERE name = NULL", Code.AnalyzerError, "NULL alone"),
        ("SELECT NULL FROM users", Code.AnalyzerError, "NULL alone"),
        ("SELECT * FROM users WHERE 'a' = 1", Code.AnalyzerError, "cannot coerce literal"),
        ("SELECT * FROM users WHERE id = 2147483648", Code.AnalyzerError, "cannot coerce literal"),
        ("SELECT * FROM users WHERE v = v", Code.AnalyzerError, "can't be compared"),
        ("SELECT * FROM users WHERE v = 'x'", Code.AnalyzerError, "cannot coerce literal"),
    ],
)
def test_binding_errors(sql, kind, part):
    e = code(bind, sql)
    assert e.code is kind and part in e.message


def test_insert_reorders_and_fills():
    s = bind("INSERT INTO users (name, ID) VALUES ('alice', '1')")
    assert s.rows == ((1, None, "alice", None, None, None, None),)


@pytest.mark.parametrize(("sql", "value"), [("id = ' 5'", 5), ("score = 5", 5.0), ("name < 10", "10"), ("name = TRUE", "true"), ("id = 3.0", 3), ("1 = name", "1"), ("score = 0.1", 0.1)])
def test_literals_take_the_other_sides_type(sql, value):
    w = bind(f"SELECT * FROM users WHERE {sql}").where
    literal = w.right if isinstance(w.right, bound.Value) else w.left
    assert literal.value == value and type(literal.value) is type(value)


def test_output_names():
    s = bind("SELECT ID, name AS user_name, id = 1, 2 FROM users")
    assert [n for n, _ in s.items] == ["id", "user_name", "?column?", "?column?"]
    assert [n for n, _ in bind("SELECT *, id FROM users").items] == ["id", "big", "name", "active", "score", "at", "v", "id"]


def test_literal_text():
    assert literal_text(ast.Literal("bool", True)) == "true" and literal_text(ast.Literal("float", 2.0)) == "2"


# --- plans


def test_plan_shapes():
    shape = logical.plan(bind("SELECT id FROM users WHERE active"))
    assert isinstance(shape, logical.Project) and isinstance(shape.child, logical.Filter) and isinstance(shape.child.child, logical.Scan)
    assert isinstance(logical.plan(bind("SELECT id FROM users")).child, logical.Scan)
    assert isinstance(logical.plan(bind("INSERT INTO users (id) VALUES (1)")), logical.Insert)
    assert isinstance(logical.plan(bind("CREATE TABLE t (a INT)")), logical.CreateTable)
