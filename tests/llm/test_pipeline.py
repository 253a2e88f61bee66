import random
import re

import duckdb

import corpus_pipeline as P
from tessera.llm import decontaminate, quality
from tessera.llm.common import table
from tessera.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"
METHODS = ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding and decoding"]


def test_stages_by_name_and_columns(spark):
    assert [n for n, _ in P.STAGES] == METHODS
    docs = table(spark, DATA, "documents")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns


def test_run_against_the_stages_one_by_one(spark):
    """Each stage's decisions, taken again by other means on its own input."""
    docs = table(spark, DATA, "documents")
    keep = {r.doc_id for r in quality.scores(docs, table(spark, DATA, "labels")).collect() if r.predicted}
    first = P.quality_classifier(spark, docs, DATA).collect()
    assert {r.doc_id for r in first} == keep
    from test_line_templates import expected

    lines = {i: t for i, t, n, dropped in expected([(r.doc_id, r.text) for r in first], 10) if t or not dropped}
    second = P.line_dedup(spark, spark.createDataFrame(first, docs.schema), DATA).collect()
    assert {r.doc_id: r.text for r in second} == lines and all(r.n_chars == len(r.text) for r in second)
    from test_ngram_join import shingles

    sets = [(r.doc_id, shingles(r.text, P.SHINGLE)) for r in sorted(second)]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and len(a) * 100 >= P.PERCENT * len(b) and len(b) * 100 >= P.PERCENT * len(a) and 100 * len(a & b) >= P.PERCENT * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    third = P.ngram_jaccard_join(spark, spark.createDataFrame(second, docs.schema), DATA).collect()
    assert {r.doc_id for r in third} == {i for i in root if find(i) == i}
    fourth = P.benchmark_decontamination(spark, spark.createDataFrame(third, docs.schema), DATA).collect()
    leaked = {r.doc_id for r in decontaminate.matches(spark.createDataFrame(third, docs.schema), table(spark, DATA, "benchmark")).collect()}
    assert {r.doc_id for r in fourth} == {r.doc_id for r in third} - leaked
    norm = lambda t: " " + " ".join(re.findall(r"[a-z0-9\u0080-￿]+", t.lower())) + " "
    items = [norm(r.text) for r in table(spark, DATA, "benchmark").collect()]
    assert leaked >= {r.doc_id for r in third if any(i in norm(r.text) for i in items)}
    last = P.run(spark, DATA).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in fourth} and all(r.lossless for r in last)


def test_registered_queries(spark):
    assert len([n for n in QUERIES if re.match(r"op\d+_", n)]) == 10
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES}) == list(range(1, 11))


def test_oracles_on_a_small_scale(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        want, got = con.sql(sql), QUERIES[name](spark, "/root/testdata/sf0.001")
        assert sorted(got.columns) == sorted(want.columns), name
        assert sorted(map(repr, map(tuple, got.select(*sorted(got.columns)).collect()))) == sorted(repr(tuple(r[want.columns.index(c)] for c in sorted(want.columns))) for r in want.fetchall()), name


def test_random_order_of_rows_changes_nothing(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.collect()
    random.Random(1).shuffle(rows)
    other = spark.createDataFrame(rows, docs.schema).repartition(7)
    for stage in (P.line_dedup, P.ngram_jaccard_join, P.benchmark_decontamination):
        a, b = (sorted(map(str, stage(spark, d, "/root/testdata/sf0.001").collect())) for d in (docs, other))
        assert a == b


def test_odd_clashing_and_empty_tables(spark, tmp_path, odd, clashing, empty, odd_rows):
    """Every stage takes them, and rows are only lost to the stages' own decisions."""
    bench = spark.createDataFrame([(1, "same id other text of several words"), (None, None)], "item_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for name, docs in (("odd", odd), ("clashing", clashing), ("empty", empty)):
        for t, df in (("documents", docs), ("benchmark", bench), ("labels", labels)):
            df.write.parquet(f"{tmp_path}/{name}/{t}.parquet")
        got = P.run(spark, f"{tmp_path}/{name}").collect()
        assert all(r.lossless for r in got)
        if name == "empty":
            assert got == []
            continue
        ids = sorted((r.doc_id for r in got), key=str)
        # 10 repeats 9, a row of 6 the other, and the benchmark has one text of 7; what has no words stays
        assert ids == sorted([None, None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12], key=str)


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    rows = [(1, "a b c d e f"), (7, "a b c d e f"), (7, "unrelated text under this id"), (None, "a b c d e f"), (None, "one more text without an id"), (9, "x"), (9, "y z")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {(r.doc_id, r.text) for r in P.ngram_jaccard_join(spark, docs, DATA).collect()}
    assert got == {rows[0], rows[2], rows[4], rows[5], rows[6]}


def test_intermediate_folders_go(spark):
    from tessera.llm.common import shared_folder
    from tessera.sources.store import Folder

    folder = Folder(spark, shared_folder(spark))
    before = set(folder.names())
    rows = P.run(spark, "/root/testdata/sf0.001").collect()
    left = [n for n in folder.names() if n not in before and "pipeline" in n]
    assert rows and len(left) == 1  # what the last stage reads
