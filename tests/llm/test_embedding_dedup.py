import numpy as np
import pytest

from tessera.llm import embedding_dedup as E

NAN, INF = float("nan"), float("inf")


def expected(rows, cosine=E.COSINE):
    unit = []
    for _, v in rows:
        x = np.array([np.nan if e is None else e for e in v or []], float)
        with np.errstate(all="ignore"):
            x = x / np.abs(x).max() if len(x) else x
            x = x / np.linalg.norm(x) if len(x) else x
        unit.append(x if len(x) and np.isfinite(x).all() else None)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(len(rows)):
            x, y = unit[a], unit[b]
            if a != b and x is not None and y is not None and len(x) == len(y) and x @ y >= cosine:
                links[a] += 1
                root[find(a)] = find(b)
    least = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least[find(i)] = min(v, least.get(find(i), v))
    return sorted(((v, links[i], least.get(find(i)), v == least.get(find(i))) for i, (v, _) in enumerate(rows)), key=str)


def run(spark, rows, parts=4):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(parts)
    return sorted(map(tuple, E.near_duplicates(df).collect()), key=str)


def cloud(seed, n, size=8):
    """Points around few centres at all distances, chains and copies."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, size))
    x = centres[rng.integers(0, 5, n)] + rng.normal(size=(n, size)) * rng.choice([0.02, 0.15, 0.4], n)[:, None]
    x[: n // 6] = x[n // 6 : 2 * (n // 6)]
    x[-5:] = x[:5] * 3
    return [(int(i), [float(v) for v in p]) for i, p in zip(rng.permutation(n), x, strict=True)]


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(E, "PART", 20)
    monkeypatch.setattr(E, "MOST_PIVOTS", [40, 12, 3][seed])  # enough pivots, more of them in later rounds, and parts
    rows = cloud(seed, 300)
    assert run(spark, rows) == expected(rows)


def test_one_hot_group(spark, monkeypatch):
    monkeypatch.setattr(E, "PART", 8)
    rng = np.random.default_rng(4)
    rows = [(i, (np.ones(4) + rng.normal(size=4) * 0.05).tolist()) for i in range(120)] + [(200 + i, rng.normal(size=4).tolist()) for i in range(60)]
    assert run(spark, rows) == expected(rows)


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [NAN, 1.0]), (6, [INF, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1e200, 1e200]), (10, [1e-200, 1e-200]),
            (11, [1.0]), (12, [1.0, 0.0, 0.0]), (None, [1.0, 0.01]), (None, [-1.0, 0.0]), (None, [-1.0, 0.0]), (None, None), (13, [-0.0, -1.0]), (14, [0.0, -1.0])]
    got = run(spark, rows)
    assert got == sorted([(v, n, c, True if v is None and c is None else k) for v, n, c, k in expected(rows)], key=str)
    assert run(spark, []) == []
    assert run(spark, rows[:6]) == sorted([(i, 0, i, True) for i in range(1, 7)], key=str)


def test_extra_columns_and_float_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 5, "k"), (2, [1.0, 0.1], 6, "k")], "vec_id int, embedding array<float>, key int, point string")
    assert sorted(map(tuple, E.near_duplicates(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_several_cells_from_the_start(spark):
    """500 vectors are cut into several cells; clustered ones are copied to few, and every two points within reach meet once."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 64))
    x = centres[rng.integers(0, 30, 500)] + rng.normal(size=(500, 64)) * 0.02
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    _, points = E.distinct_points(df)
    dealt, basis, tasks = E.deal(points, 64, E.COSINE)
    rows = dealt.collect()
    own = {r.key: r.task for r in rows if r.role == 0}
    assert tasks >= 4 and len(own) == 500 and len(set(own.values())) >= 4 and basis.shape == (64, E.AXES)
    assert len(rows) < 1.5 * 500
    unit = {r.key: np.frombuffer(r.point) for r in rows}
    there = {}
    for r in rows:
        there.setdefault(r.task, set()).add(r.key)
    keys = sorted(own)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if unit[a] @ unit[b] >= E.COSINE:
                assert sum(b in there[t] and a in there[t] and t in (own[a], own[b]) for t in {own[a], own[b]}) == 1


def test_pivots_follow_the_number_of_points():
    assert [E.n_pivots(n) for n in (1, 3, 500, 10_256, 51_282)] == [1, 3, 4, 7, 16]
    assert E.n_pivots(10**8) > 3000 and E.n_pivots(10**12) == E.MOST_PIVOTS


def test_pivots_of_no_distance_are_near():
    d = np.array([[0.5, 0.5, 1.9]])
    between = np.array([[0, 1e-9, 1.5], [1e-9, 0, 1.5], [1.5, 1.5, 0]])
    assert E.near_cells(d, np.array([0]), between, np.full(3, 0.6), 0.3).tolist() == [[True, True, False]]


def test_unclustered_vectors(spark):
    """In 64 dimensions without clusters nearly all copies are sent, and the result is the same."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 64))
    x[200:230] = x[:30] + rng.normal(size=(30, 64)) * 0.1
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert run(spark, rows) == expected(rows)
