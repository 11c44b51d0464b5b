import collections

import pytest

import corpus_pipeline

from .conftest import ODD
from .test_neardup import brute, corpus
from .test_packing import ids_of
from .test_substrings import repeated_words, tokens


@pytest.fixture
def table(docs, tmp_path):
    rows = [(d, t, "en", "s") for d, t in corpus()[:60]] + [(1000 + i, t, None, None) for i, (_, t) in enumerate(ODD)]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), rows


def test_stages_keep_the_columns_and_do_their_part(spark, table):
    path, rows = table
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, path)
        df.write.parquet(f"{path}/{name}")
        docs = out[name] = spark.read.parquet(f"{path}/{name}")
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    told = {r.doc_id for r in out["language_id"].collect()}
    assert told == {r[0] for r in rows if any(c.isalpha() for c in r[1] or "")}
    before = [(r.doc_id, r.text) for r in out["language_id"].collect() if r.doc_id is not None]
    kept = [(r.doc_id, r.text) for r in out["near_dedup"].collect()]
    single = {min(before[k][0] for k in c) for c in brute(before)}
    assert {d for d, _ in kept if d is not None} == single and len(kept) == len({t for _, t in kept})
    cut = {(r.doc_id, i): r.text for i, r in enumerate(out["substring_dedup"].orderBy("doc_id").collect())}
    kept = sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0))
    repeats = repeated_words(kept, 20)
    assert len(cut) == len(kept)
    for i, (d, text) in enumerate(kept):
        lost = len(tokens(text)) - len(tokens(cut[d, i]))
        assert 0 <= lost <= sum(repeats[i]) and (lost or sum(repeats[i]) < 60)
        assert lost or text == cut[d, i]
    assert any(sum(r) >= 60 for r in repeats.values())
    mixed = out["mixing"].collect()
    n = collections.Counter()
    for r in mixed:
        n[r.doc_id] += len(ids_of(r.text))
    packed = collections.Counter()
    for r in out["packing"].collect():
        packed[r.doc_id] += r.length
    assert packed == n


def test_run_gives_the_last_stage(spark, table):
    path, _ = table
    assert corpus_pipeline.run(spark, path).columns[:3] == ["doc_id", "start", "length"]


def test_an_empty_table_goes_through(spark, docs, tmp_path):
    docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
