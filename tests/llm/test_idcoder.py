import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from fathomline.llm import idcoder

from .conftest import ODD
from .test_packing import ids_of


@given(arrays(np.int64, st.integers(1, 400), elements=st.integers(0, 999)), st.sampled_from([1, 3, 64]))
@settings(max_examples=40, deadline=None)
def test_ids_come_back(ids, lanes):
    assert (idcoder.decode_ids(idcoder.encode_ids(ids, 1000, lanes), len(ids), 1000, lanes) == ids).all()


def test_repeats_cost_little():
    ids = np.tile(np.random.default_rng(1).integers(0, 5000, 200), 100)
    assert len(idcoder.encode_ids(ids, 5000, 4)) < len(ids) / 2


def test_damage_is_seen():
    data = idcoder.write_block(np.array([3, 2]), np.array([5, 6, 1, 7, 1]), 100, 4)
    assert idcoder.read_block(data)[1].tolist() == [5, 6, 1, 7, 1]
    for k in (0, 20, len(data) - 1):
        bad = bytearray(data)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            idcoder.read_block(bytes(bad))


def test_files_in_order_of_the_ids(docs):
    rows = idcoder.round_trip(docs(ODD), block_ids=50, lanes=8, part_bytes=20).collect()
    want, start = [], 0
    for doc_id, text in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(text)
        want.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = sorted(rows, key=lambda r: r.start)
    for r in got:
        assert r.start == start
        start += r.n_tokens
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=key) == sorted(want, key=key)
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known)


def test_empty_table(docs):
    assert idcoder.round_trip(docs([])).count() == 0


def test_columns_that_clash_do_not_matter(spark, docs):
    rows = [(2, "two words"), (1, None), (1, "one"), (None, "none")]
    names = ["part", "block", "place", "tie", "data", "n_ids", "start"]
    wide = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    assert sorted(map(str, idcoder.round_trip(wide).collect())) == sorted(map(str, idcoder.round_trip(docs(rows)).collect()))


def test_lanes_grow_where_ids_are_dear():
    # ids that the model does not foretell take more words than a lane's row has at first
    ids = np.random.default_rng(5).permutation(1 << 16)
    for lanes in (5, 218, 1024):
        assert (idcoder.decode_ids(idcoder.encode_ids(ids, 1 << 16, lanes), len(ids), 1 << 16, lanes) == ids).all()


def test_coding_does_few_passes(monkeypatch):
    # a block costs what its array passes cost: ids are found by looks alone, and order 0 is renewed as the block grows by half
    ids = np.minimum(np.random.default_rng(7).zipf(1.2, 1 << 17), 49_999) - 1
    renewals, renew = [], idcoder._Model._renew
    monkeypatch.setattr(idcoder._Model, "_renew", lambda model: (renewals.append(1), renew(model))[1])
    monkeypatch.setattr(np, "searchsorted", None)
    body = idcoder.encode_ids(ids, 50_000, 512)
    assert (idcoder.decode_ids(body, len(ids), 50_000, 512) == ids).all()
    assert len(renewals) <= 2 * 11
    assert len(body) < 1.3 * len(ids)


@given(st.integers(1, 3000), st.sampled_from([1, 2, 7, 300, 4096]), st.sampled_from([2, 1000, 70_000, 300_000]), st.integers(0, 99))
@settings(max_examples=60, deadline=None)
def test_frequent_and_rare_ids_of_all_vocabularies(n, lanes, vocab, seed):
    # runs, a few frequent ids, and ids that have no cell of the scale
    rng = np.random.default_rng(seed)
    ids = np.where(rng.random(n) < 0.5, rng.integers(0, 2, n), rng.integers(0, vocab, n)).repeat(rng.integers(1, 6, n))
    assert (idcoder.decode_ids(idcoder.encode_ids(ids, vocab, lanes), len(ids), vocab, lanes) == ids).all()


def test_more_ids_than_the_scale_holds():
    with pytest.raises(ValueError):
        idcoder.encode_ids(np.array([1, 2]), 1 << 21, 4)
