import pathlib

import numpy as np
import pyarrow as pa
import pytest

from fathomline.llm import ann

KIND = "vec_id long, embedding array<float>, label int"


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(a) for a in v], 0) for i, v in zip(ids, x, strict=True)], KIND)


def clusters(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((12, dim))
    return (centre[rng.integers(0, 12, n)] + 0.6 * rng.standard_normal((n, dim))).astype(np.float32)


def brute(x, ids, k=5):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(np.array(ids) % 50 == 0):
        s = u @ u[i]
        s[np.array(ids) == ids[i]] = -np.inf
        order = np.lexsort((ids, -s))[:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order if np.isfinite(s[j])]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_one_part_is_exact_with_ties(spark):
    x = np.concatenate([clusters(150), clusters(150)[:60]])
    ids = np.arange(len(x))
    got, want = found(ann.search(table(spark, x))), brute(x, ids)
    assert got.keys() == want.keys()
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)


def recall(got, want):
    return sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) / sum(map(len, want.values()))


@pytest.mark.parametrize("n", [600, 4000, 50_000])
def test_recall_with_the_defaults(spark, n, monkeypatch):
    x, fitted = clusters(n), []
    balanced = ann.balanced_parts
    monkeypatch.setattr(ann, "balanced_parts", lambda x, graph, parts: fitted.append((len(x), parts)) or balanced(x, graph, parts))
    vectors = pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), pa.list_(pa.float32()))})
    got = found(ann.search(spark.createDataFrame(vectors), block_rows=500))
    assert fitted[0][1] == min(n // 64, int(n**0.5 / 2)) and fitted[0][0] <= 1.1 * 12_288
    assert recall(got, brute(x, np.arange(n))) >= 0.9


def test_recall_on_the_standard_table(spark):
    path = pathlib.Path("/root/testdata/sf0.1/embeddings.parquet")
    if not path.exists():
        pytest.skip("no standard tables here")
    table = spark.read.parquet(str(path))
    got, want = found(ann.search(table)), found(ann.exact_search(table))
    assert recall(got, want) >= 0.9
    assert all(abs(s - dict(want[q]).get(v, s)) < 1e-12 for q in got for v, s in got[q])


def test_rows_of_one_id(spark):
    """Candidates of equal id all count; clashing columns do not matter."""
    x = clusters(300)
    ids = [0] * 100 + list(range(1, 201))
    rows = [(i, v.tolist(), 1, 2) for i, v in zip(ids, x, strict=True)]
    got = found(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int, part int"), block_rows=20))
    assert got.keys() == {0, 50, 100, 150, 200}
    assert all(len(v) == 5 and v == sorted(v, key=lambda r: (-r[1], r[0])) for v in got.values())
    assert all(i != 0 for i, _ in got[0]) and any(i == 0 for q in got for i, _ in got[q])


def test_parts_are_balanced_and_keep_neighbours():
    x = ann._unit(clusters(1200).astype(float))
    graph = ann.neighbour_graph(x, 8)
    part = ann.balanced_parts(x, graph, 6)
    assert np.bincount(part, minlength=6).max() <= np.ceil(1.1 * 200)
    assert (part[graph] == part[:, None]).mean() > 0.5
    assert (ann.Router(x, part, graph, 6).probabilities(x).argmax(axis=1) == part).mean() > 0.6


def test_vectors_without_a_cosine_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (8, [1.0]), (None, [1.0, 2.0]), (9, [3e38, 3e38])]
    got = found(ann.search(spark.createDataFrame([(a, b, 0) for a, b in rows], KIND)))
    assert got.keys() == {0, 50}
    assert {v for v, _ in got[0]} == {1, 9, 50} and got[50][0][0] == 9 and abs(got[50][0][1] - 1) < 1e-12
    assert ann.search(spark.createDataFrame([], KIND)).count() == 0
    assert ann.search(spark.createDataFrame([(0, [0.0], 1)], KIND)).count() == 0
