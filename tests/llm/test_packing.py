import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fathomline.llm.packing import Bins, pack, plan
from fathomline.llm.tokens import WordEncoder, kept_encoder, vocabulary

from .conftest import ODD


def ids_of(text):
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return tok.encode(text or "", add_special_tokens=False).ids + [1]


def test_first_fit_takes_the_first_bin_with_room():
    rng = np.random.default_rng(3)
    sizes = sorted(rng.integers(1, 100, 300).tolist(), reverse=True)
    tree, rooms = Bins(len(sizes), 100), [100] * len(sizes)
    for n in sizes:
        want = next(i for i, r in enumerate(rooms) if r >= n)
        rooms[want] -= n
        assert tree.put(n) == want


@given(st.lists(st.integers(1, 700), max_size=60), st.integers(1, 20))
@settings(max_examples=60, deadline=None)
def test_plan_holds_every_token_once_and_pads_little(sizes, min_cut):
    seen = [np.zeros(n, int) for n in sizes]
    padding = 0
    for sequence in plan(sizes, 256, min_cut):
        total = sum(n for _, _, n in sequence)
        assert 0 < total <= 256
        padding += 0 if total & (total - 1) == 0 else 256 - total
        for doc, at, n in sequence:
            seen[doc][at : at + n] += 1
    assert all((s == 1).all() for s in seen)
    assert padding <= (min_cut - 1) * (sum(sizes) // 256 + 1) + (min_cut if sizes else 0)


def test_pieces_rebuild_every_document(docs):
    rows = pack(docs(ODD), group_docs=3, with_ids=True).collect()
    fits = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        fits.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in fits.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for doc_id in {d for d, _ in ODD}:
        want = [ids_of(t) for d, t in ODD if d == doc_id]
        assert sum(len(i) for _, i in got[doc_id]) == sum(map(len, want))
        if len(want) == 1:
            assert [x for _, part in sorted(got[doc_id]) for x in part] == want[0]


def test_empty_table_and_clashing_columns(docs, spark):
    assert pack(docs([])).count() == 0
    clash = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id int, text string, part int, ids string")
    assert pack(clash).collect()[0].doc_tokens == 3


@pytest.mark.parametrize("text", ["", "The QUICK brown fox, it's 3.14!", "<|ENDOFTEXT|> <|endoftext|>a", "É́e ΣΑΣ İ ſ K", "a,b. c .'s d.'s ...x"])
def test_word_encoder_equals_the_library(text):
    import pyarrow as pa

    n, ids = WordEncoder("word_bpe_49k.json").encode(pa.array([text, text + " " + text]))
    assert ids[: n[0]].tolist() == ids_of(text)[:-1]
    assert ids[n[0] :].tolist() == ids_of(text + " " + text)[:-1]


#: The letters of PLAIN with capitals, signs that may follow them, marks that combine, the specials' signs.
SIGNS = "aZsßéÉÿÞØ×÷'.,!?;:*%&$#)]}\"(<|>- \t\ń̸ 7"


@given(st.lists(st.text(SIGNS, max_size=25) | st.sampled_from(["it's***", "É́***", "a<|endoftext|>* b*", "ÀÖ×Þ) ÷é]}\"", "d'***, 's$$$"]), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_word_encoder_equals_the_library_where_signs_follow(texts):
    import pyarrow as pa

    encoder = kept_encoder("word_bpe_49k.json")
    n, ids = encoder.encode(pa.array(texts))
    at = [0, *np.cumsum(n).tolist()]
    assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)] == [encoder.tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_are_encoded_once():
    import pyarrow as pa

    # signs after a word made another word of it before, and every task began with no words
    encoder = WordEncoder("word_bpe_49k.json")
    encoder.encode(pa.array(["so so*** so) so$$$ so*** Ça ça***"]))
    assert encoder.known.n == 6  # so, Ça, ça and three runs of signs
    one = kept_encoder("word_bpe_49k.json")
    one.encode(pa.array(["a word"]))
    assert kept_encoder("word_bpe_49k.json") is one and one.known.n >= 2


def test_word_encoder_is_emptied_at_many_ids():
    import pyarrow as pa

    # words were counted alone, so long ones could hold any number of ids
    encoder = WordEncoder("word_bpe_49k.json", most_words=10)
    for k in range(40):
        text = f"{k}" * 30
        n, ids = encoder.encode(pa.array([text]))
        assert ids.tolist() == encoder.tok.encode(text, add_special_tokens=False).ids
        assert encoder.at[encoder.known.n] <= 16 * 10 + 60
