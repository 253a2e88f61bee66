import zlib

import numpy as np
import pytest
from conftest import frame
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import quality as Q
from tessera.llm import toxicity as T
from tessera.llm.common import table

DATA = "/root/testdata/sf0.01"
EMPTY_LABELS = "doc_id bigint, quality int, toxic int"


def auc(score, y):
    order = np.argsort(np.argsort(score))
    n = y.sum()
    return (order[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def held(doc, modulus):
    return zlib.crc32(str(doc).encode()) % modulus


def judged(spark, got, label):
    truth = {r.doc_id: r[label] for r in table(spark, DATA, "labels").collect()}
    return [(r.held_out, truth[r.doc_id], r.score, r.predicted) for r in got if r.doc_id in truth]


def test_gam_learns_tables_and_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only the pair tells
    model = Q.fit(x[:3000], y[:3000], n_pairs=1, pair_rounds=80)
    assert {model.pairs[0][0], model.pairs[0][1]} == {0, 1}
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.85


@given(st.lists(st.text(max_size=50), max_size=5))
def test_features_are_finite_and_per_text(texts):
    parts = [t.encode("utf-8", "ignore") for t in texts]
    pack = lambda p: (np.frombuffer(b"".join(p), np.uint8), np.concatenate(([0], np.cumsum([len(b) for b in p]))).astype(np.int64))
    got = Q.features(*pack(parts))
    assert got.shape == (len(parts), len(Q.FEATURES)) and np.isfinite(got).all()
    for i, p in enumerate(parts):
        assert np.allclose(Q.features(*pack([p]))[0], got[i])


def test_quality_on_held_out_rows(spark):
    got = Q.scores(table(spark, DATA, "documents"), table(spark, DATA, "labels")).collect()
    assert len(got) == 1000 and all(r.held_out == (held(r.doc_id, Q.FOLDS) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= Q.THRESHOLD) for r in got)
    rows = [r for r in judged(spark, got, "quality") if r[0]]
    assert np.mean([p == y for _, y, _, p in rows]) > 0.97


def test_quality_keep(spark):
    docs = table(spark, DATA, "documents")
    kept = Q.keep(docs, table(spark, DATA, "labels"))
    assert kept.columns == docs.columns
    want = {r.doc_id for r in Q.scores(docs, table(spark, DATA, "labels")).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == want


def test_keep_on_odd_rows_clashing_columns_and_empty_tables(spark, odd, clashing, empty, odd_rows):
    labels = spark.createDataFrame([(None, 1, 1), (4, None, None), (5, 7, 7), (6, 1, 1), (6, 1, 1), (8, 1, 1), (9, 0, 0), (11, 0, 0), (12, 1, 0)], EMPTY_LABELS)
    want = sorted(str((r.doc_id, r.predicted)) for r in Q.scores(odd, labels).collect() if r.predicted)
    for docs in (odd, clashing):
        got = Q.keep(docs, labels)
        assert got.columns == docs.columns
        assert sorted(str((r.doc_id, 1)) for r in got.collect()) == want
    none = spark.createDataFrame([], EMPTY_LABELS)
    assert Q.keep(empty, labels).collect() == [] and Q.keep(odd, none).count() == len(odd_rows)  # every score is 0.5


def test_toxicity_on_held_out_rows(spark):
    got = T.scores(table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")).collect()
    truth = {r.doc_id: r.toxic for r in table(spark, "/root/testdata/sf0.1", "labels").collect()}
    rows = [(truth[r.doc_id], r.score, r.predicted) for r in got if r.doc_id in truth and r.held_out]
    y, score, predicted = map(np.array, zip(*rows, strict=True))
    assert auc(score, y) > 0.93
    assert predicted[y == 1].mean() > 0.75 and predicted[y == 0].mean() < 0.01


@pytest.mark.parametrize("module", [Q, T])
def test_odd_rows_and_labels(spark, odd, clashing, empty, odd_rows, module):
    label = "quality" if module is Q else "toxic"
    none = spark.createDataFrame([], EMPTY_LABELS)
    got = module.scores(odd, none).collect()
    assert len(got) == len(odd_rows) and {r.score for r in got} == {0.5}
    assert module.scores(empty, none).collect() == []
    odd_labels = spark.createDataFrame([(None, 1, 1), (4, None, None), (5, 7, 7), (6, 1, 1), (6, 1, 1), (8, 1, 1), (9, 0, 0), (11, 0, 0), (12, 1, 0)], EMPTY_LABELS)
    a, b = (sorted((str(r.doc_id), r.score) for r in module.scores(d, odd_labels, label_col=label).collect()) for d in (odd, clashing))
    assert a == b and len(a) == len(odd_rows)


def test_scores_do_not_use_ids_labels_or_sources(spark):
    """The same text scores alike under any id, language or source."""
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    text = docs.where("doc_id = 3").first().text
    more = docs.select("doc_id", "text", "lang", "source").unionByName(frame(spark, [(10**6, text), (None, text)]).select("doc_id", "text", "lang", "source"))
    for module in (Q, T):
        got = {r.doc_id: r.score for r in module.scores(more, labels).collect()}
        assert got[3] == got[10**6] == got[None]


def test_toxic_segments_are_trained_and_then_tried(spark):
    """What the toxic dictionary keeps comes from the trainer and saves bytes on toxic words, and the fit doesn't depend on partitions."""
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    a, b = T.dictionaries(docs, labels), T.dictionaries(docs.repartition(9), labels.repartition(5))
    assert a.parts == b.parts and b" clown" in a.parts[0]
    assert a.of(b"clown") >= 2 and a.of(b"and this is a clown and a loser too") > a.of(b"the and of in on with by or at")


def test_toxicity_takes_a_hot_labelled_id_once(spark):
    """An id that many rows repeat is one document of the fit, whatever the order of its rows."""
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    marked = labels.where("toxic = 1").first().doc_id
    hot = frame(spark, [(marked, f"zzz {k % 3}") for k in range(300)]).select(*docs.columns)
    a = T.dictionaries(docs.unionByName(hot), labels)
    b = T.dictionaries(hot.repartition(7).unionByName(docs), labels)
    assert a.parts == b.parts
