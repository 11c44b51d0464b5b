import math

import numpy as np
import pyarrow as pa
import pytest

from fathomline.llm import langid

from .conftest import ODD

EN = "the cat and the dog went to the house with that old man who was there before them and is not here "
DE = "der hund und die katze gingen mit dem alten mann in das haus und nicht zu der frau die schon da war "


def brute_bits(train: bytes, text: bytes, order: int = 3) -> float:
    """Code length by walking the contexts of every byte."""
    counts = {}
    for pad in [b"\n" * order + train]:
        for i in range(order, len(pad)):
            for k in range(order + 1):
                counts.setdefault(pad[i - k : i], {}).setdefault(pad[i], 0)
                counts[pad[i - k : i]][pad[i]] += 1
    out, pad = 0.0, b"\n" * order + text
    for i in range(order, len(pad)):
        for k in range(order, -1, -1):
            seen = counts.get(pad[i - k : i])
            if seen is None:
                continue
            n, d = sum(seen.values()), len(seen)
            if pad[i] in seen:
                out += math.log2((n + d) / seen[pad[i]])
                break
            out += math.log2((n + d) / d)
        else:
            out += 8
    return out


def scorer(texts: dict) -> langid.Scorer:
    rows = {"lang_no": [], "gram": [], "n": []}
    for i, t in enumerate(texts.values()):
        codes, first, end = langid.grams(pa.array([t]))
        keys, n = np.unique(codes[first[0] : end[0]], return_counts=True)
        rows["lang_no"] += [i] * len(keys)
        rows["gram"] += keys.tolist()
        rows["n"] += n.tolist()
    return langid.Scorer(list(texts), pa.table(rows))


@pytest.mark.parametrize("text", ["the cat", "qqq zzz", "der alte mann", "", "öäü \U0001f600"])
def test_code_lengths_are_exact(text):
    s = scorer({"en": EN * 3, "de": DE * 3})
    got = s.lengths(pa.array([text, "the", text]))
    for i, train in enumerate((EN * 3, DE * 3)):
        want = brute_bits(train.encode(), text.encode())
        assert got[0, i] == pytest.approx(want, abs=1e-3) and got[2, i] == pytest.approx(want, abs=1e-3)


def test_languages_are_told(docs):
    words = {"en": EN.split(), "de": DE.split()}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words[("en", "de")[i % 2]], 30)), ("en", "de")[i % 2]) for i in range(80)]
    got = {r.doc_id: r for r in langid.identify(docs(rows + [(900 + i, t, None) for i, (d, t) in enumerate(ODD)])).collect()}
    assert len(got) == 80 + len(ODD)
    assert all(got[i].lang_pred == ("en", "de")[i % 2] and got[i].score > 0.9 for i in range(80))
    for i, (_, t) in enumerate(ODD):
        if t is None or not any(c.isalpha() for c in t):
            assert (got[900 + i].lang_pred, got[900 + i].score) == ("und", 0.0)
        else:
            assert got[900 + i].lang_pred in words
    assert sum(r.held_out for r in got.values()) not in (0, len(got))


def test_nothing_learned_and_empty(docs):
    assert [r.lang_pred for r in langid.identify(docs([(1, "some text")])).collect()] == ["und"]
    assert langid.identify(docs([])).count() == 0


def test_kept_documents_keep_their_columns(docs):
    rows = [(i, EN, "en", "s", 1) for i in range(5)] + [(7, "123 !!!"), (8, None)]
    kept = langid.keep_identified(docs(rows).withColumnRenamed("n_chars", "score"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "score"]
    assert sorted((r.doc_id, r.score) for r in kept.collect()) == [(i, 1) for i in range(5)]
