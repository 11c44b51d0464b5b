import collections
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from fathomline.llm import neardup as nd

from .conftest import ODD


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(n))


def changed(rng, t, k):
    w = t.split()
    for i in rng.sample(range(len(w)), k):
        w[i] = "changed" + str(rng.random())[2:8]
    return " ".join(w)


def corpus():
    rng = random.Random(3)
    rows, n = [], itertools.count(1)
    for _ in range(6):  # pairs and small groups of copies with few changes
        t = text(rng, 200)
        rows += [(next(n), t), (next(n), changed(rng, t, 2)), (next(n), changed(rng, t, 1)), (next(n), t)]
    rows += [(next(n), text(rng, 150)) for _ in range(20)]
    shared = text(rng, 60)  # a common passage does not make documents alike
    rows += [(next(n), text(rng, 100) + " " + shared + " " + text(rng, 100)) for _ in range(12)]
    t = text(rng, 150)  # a large group
    rows += [(next(n), changed(rng, t, rng.randint(0, 4))) for _ in range(60)]
    return rows


def brute(rows, similarity=0.8):
    """Classes by comparing all pairs, with weights of their own working out."""
    bags = []
    for _, t in rows:
        w = (t or "").lower().split()
        bags.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))))
    df = collections.Counter(s for b in bags for s in b)
    n = len(rows)
    near = {s: 2 ** (round(2 * math.log2(k)) / 2) for s, k in df.items()}
    weigh = [{s: k * (1 + 0.25 * min(max(math.log((n + 1) / (near[s] + 1)) / math.log(n + 2), 0), 1)) for s, k in b.items()} for b in bags]
    label = list(range(n))
    for i, j in itertools.combinations(range(n), 2):
        a, b = weigh[i], weigh[j]
        low = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
        whole = sum(a.values()) + sum(b.values()) - low
        alike = (rows[i][1] or "") == (rows[j][1] or "") or (whole > 0 and low / whole >= similarity)
        if alike and label[i] != label[j]:
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    return {frozenset(k for k in range(n) if label[k] == x) for x in set(label)}


def test_classes_equal_all_pairs(docs):
    rows = corpus()
    got = {}
    for r in nd.classes(docs(rows)).collect():
        got.setdefault(r.class_id, set()).add(r.doc_id)
        assert r.class_size >= 1
    want = {frozenset(rows[k][0] for k in c) for c in brute(rows)}
    assert {frozenset(c) for c in got.values()} == want
    assert all(k == min(c) for k, c in got.items())


def test_levels_of_all_document_frequencies(docs, monkeypatch):
    """Every shingle has its level, however the rows are cut into slices."""
    rows = [(1, "a b c d e f"), (2, "a b c d e g"), (3, "A b c d E"), (3, "a b c d e a b c d e"), (5, "x y"), (6, "")] + [(10 + i, "q r s t u v") for i in range(300)]
    h = {t: int(nd.shingles(pa.array([t]))[1][0]) for t in ("a b c d e", "b c d e f", "x y", "q r s t u")}
    for size in (10, 1 << 20):
        monkeypatch.setattr(nd, "SLICE", size)
        source = docs(rows).coalesce(1).selectExpr("monotonically_increasing_id() AS row", "doc_id", "text")
        found = {}
        keys = {r["batch"]: nd._distinct(pa.ipc.open_stream(r["docs"]).read_all()["text"].combine_chunks())[0] for r in nd.packed_slices(source).collect()}
        answers = {}
        for r in sorted(nd.frequency_levels(source, 32).collect(), key=lambda r: r["bucket"]):
            answers[r["batch"]] = answers.get(r["batch"], b"") + bytes(r["levels"])
        for batch, levels in answers.items():
            assert len(levels) == len(keys[batch])
            found |= dict(zip(keys[batch].tolist(), levels, strict=True))
        assert [found[h[t]] for t in h] == [4, 0, 0, round(2 * math.log2(300))]


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_samples_agree_as_often_as_weights_do(share):
    rng = np.random.default_rng(1)
    sampler, same, n = nd.Sampler(16, 8), [], 200
    for _ in range(40):
        u = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        w = rng.uniform(1, 12, 2 * n)
        c = int(2 * n * share / (1 + share))
        a, b = np.arange(n), np.concatenate([np.arange(c), np.arange(n, 2 * n - c)])
        true = w[:c].sum() / (w[a].sum() + w[b].sum() - w[:c].sum())
        same.append((sampler.signature(u[a], w[a]) == sampler.signature(u[b], w[b])).mean() - true)
    assert abs(np.mean(same)) < 0.02


def test_larger_weights_are_sampled_alike():
    rng = np.random.default_rng(2)
    u, w = rng.integers(0, 1 << 63, 300).astype(np.uint64), rng.uniform(1, 5, 300)
    w2 = w * rng.uniform(0.7, 1, 300)
    s = nd.Sampler(32, 8)
    assert abs((s.signature(u, w) == s.signature(u, w2)).mean() - w2.sum() / w.sum()) < 0.1


def test_components_follow_chains_and_circles(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (102, 100), (200, 201), (200, 201), (201, 200)]
    got = {r.node: r.comp for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys((100, 101, 102), 100), 200: 200, 201: 200}
    assert nd.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows_and_the_one_that_stays(docs, spark, tmp_path):
    got = nd.classes(docs(ODD)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].class_id == by[2].class_id == 1 and by[4].class_size == 2 and by[3].class_id == 3
    kept = nd.drop_near_duplicates(docs(ODD + corpus()[:4])).collect()
    assert len([r for r in kept if r.text == "one"]) == 1 and len(kept) == len({r.text or "" for r in kept})
    assert nd.classes(docs([])).count() == 0 and nd.drop_near_duplicates(docs([])).count() == 0
    clash = spark.createDataFrame([(1, "a", b"x", 3, 7), (2, "a", b"y", 4, 8)], "doc_id long, text string, node binary, _node int, _id int")
    assert nd.drop_near_duplicates(clash).collect() == [clash.first()]


def test_large_bands_are_compared_in_rounds(docs, monkeypatch):
    monkeypatch.setattr(nd, "CHUNK", 8)
    monkeypatch.setattr(nd, "MOST_BROADCAST", 0)
    rows = corpus()
    got = {}
    for r in nd.classes(docs(rows)).collect():
        got.setdefault(r.class_id, set()).add(r.doc_id)
    assert {frozenset(c) for c in got.values()} == {frozenset(rows[k][0] for k in c) for c in brute(rows)}


def test_survivors_are_the_same_with_and_without_broadcast(docs, monkeypatch):
    rows = corpus()[:40] + ODD
    one = sorted(map(str, nd.drop_near_duplicates(docs(rows)).collect()))
    monkeypatch.setattr(nd, "MOST_BROADCAST", 0)
    assert sorted(map(str, nd.drop_near_duplicates(docs(rows)).collect())) == one
