import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fathomline.llm import substrings

from .conftest import ODD

LEAST = 20


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def sentences(rng, n):
    return " ".join(words(rng, rng.randint(4, 12)).capitalize() + "." for _ in range(n))


def tokens(text):
    """(start, end, normal form) of the words of a text, by a splitter of its own."""
    found = ((m.start(), m.end(), re.sub(r"[\W_]", "", m[0].lower())) for m in re.finditer(r"[^ \t-\r]+", text or ""))
    return [t for t in found if t[2]]


def repeated_words(rows, n):
    """For every row the words that lie in a window of n words which stood somewhere before."""
    seen, out = set(), {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)):
        norm = [t[2] for t in tokens(rows[i][1])]
        cover = [False] * len(norm)
        for k in range(len(norm) - n + 1):
            window = tuple(norm[k : k + n])
            if window in seen:
                cover[k : k + n] = [True] * n
            seen.add(window)
        out[i] = cover
    return out


def check(rows, got, lost=0.0):
    """Every reported word is a repeat, and at most a share of repeats goes unreported."""
    want = repeated_words(rows, LEAST)
    reported = {i: [False] * len(c) for i, c in want.items()}
    for r in got:
        inside = [j for j, (a, b, _) in enumerate(tokens(rows[r.row][1])) if a >= r.span_start and b <= r.span_end]
        assert r.n_words == len(inside) >= LEAST and r.doc_id == rows[r.row][0]
        for j in inside:
            reported[r.row][j] = True
    assert all(w or not g for i in want for w, g in zip(want[i], reported[i], strict=True))
    missing = sum(w and not g for i in want for w, g in zip(want[i], reported[i], strict=True))
    assert missing <= lost * max(1, sum(map(sum, want.values())))


def spans(docs, rows):
    return substrings.repeated_spans(docs(rows).coalesce(1)).collect()


def test_units_begin_at_lines_sentences_and_chosen_pairs():
    text = 'One two. Three -- four\n\nfive "six." Ünder_way: ... last'
    keys, start, end, before, first, last = substrings.units(pa.array([text, "", "One"]))
    raw = text.encode() + b"One"
    assert [raw[a:b].decode() for a, b in zip(start, end, strict=True)] == ["One", "two.", "Three", "four", "five", '"six."', "Ünder_way:", "last", "One"]
    assert list(before) == [0, 8, 8, 9] and keys[0] == keys[-1]
    assert {0, 2, 4, 6, 8} <= set(first.tolist())
    assert [int(a) for a in np.append(first, 9)[1:][last]] == [4, 8, 9]


def test_runs_are_the_shortest_and_hash_by_words_alone():
    rng = random.Random(9)
    texts = [sentences(rng, rng.randint(0, 12)) for _ in range(60)]
    texts += [words(rng, 7) + ". " + t.upper().replace(" ", "\t") for t in texts]
    keys, start, end, before, first, last = substrings.units(pa.array(texts))
    found, digest = substrings.runs(pa.array(texts), LEAST), {}
    got = [(int(t), int(a), int(b)) for t, a, b in zip(found["text"], found["k"], found["k_end"], strict=True)]
    want = []
    for t in range(len(texts)):
        cuts = [int(x - before[t]) for x in first if before[t] <= x < before[t + 1]] + [int(before[t + 1] - before[t])]
        want += [(t, a, min(b for b in cuts if b >= a + LEAST)) for a in cuts[:-1] if a + LEAST <= cuts[-1]]
        want += [(t, max(a for a in cuts if a <= cuts[-1] - LEAST), cuts[-1])] if cuts[-1] >= LEAST else []  # every text is one line
    assert got == sorted(set(want))
    for (t, a, b), h1, h2, lo, hi in zip(got, *(found[c].tolist() for c in ("h1", "h2", "span_start", "span_end")), strict=True):
        run = tokens(texts[t])[a:b]
        assert (lo, hi) == (run[0][0], run[-1][1])
        assert digest.setdefault((h1, h2), tuple(w for *_, w in run)) == tuple(w for *_, w in run)
    assert len(set(digest.values())) == len(digest)


def test_spans_against_brute_force(docs):
    rng = random.Random(7)
    passage, line = sentences(rng, 12), "All rights reserved here."
    rows = [(i, f"{sentences(rng, 5)}\n{line}\n{sentences(rng, 3)}") for i in range(20)]
    for i in (3, 8, 15):
        cut = rows[i][1].split(" ")
        cut.insert(7, passage)
        rows[i] = (i, " ".join(cut))
    rows += [(40, rows[5][1]), (40, rows[5][1]), (None, rows[6][1]), (41, sentences(rng, 6) + "\n" + passage + "\n" + passage)] + ODD
    got = spans(docs, rows)
    check(rows, got, 0.2)
    found = {r.doc_id for r in got}
    assert {8, 15, 40, 41, None} <= found and not found & {0, 1, 3, 5}
    assert sum(r.doc_id == 40 for r in got) == 2


def test_removal_leaves_the_rest_alone(docs, tmp_path):
    rng = random.Random(1)
    passage, other = sentences(rng, 8), sentences(rng, 6)
    rows = [(1, "Start of one. " + passage + "\n" + other), (2, "Other start. " + passage + " And the end."), (3, "Clean  text."), (4, passage), (5, None), (6, f"Start here. {passage}  Middle stays.\n{other}\nThe end.")]
    want = {1: rows[0][1], 2: "Other start. And the end.", 3: "Clean  text.", 4: "", 5: None, 6: "Start here. Middle stays.\n\nThe end."}
    path = str(tmp_path / "d")
    docs(rows).write.parquet(path)
    stored = docs(rows).sparkSession.read.parquet(path)
    shuffled = stored.repartition(3, F.rand())  # not the same rows in each place every time
    for table in (stored, docs(rows), shuffled):
        assert {r.doc_id: r.text for r in substrings.remove_repeats(table).collect()} == want


def test_empty_and_clashing(docs, spark):
    assert substrings.repeated_spans(docs([])).count() == 0
    assert substrings.remove_repeats(docs([])).count() == 0
    clash = spark.createDataFrame([(1, "a", 5, 6, "x")], "doc_id long, text string, row long, _row int, _spans string")
    assert substrings.remove_repeats(clash).collect() == clash.collect()


def test_fragments_that_never_stood_together_stay(docs):
    """Every sentence and every name has occurred before, the texts as such have not."""
    rng = random.Random(3)
    names = [f"N{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    short = [words(rng, 3).capitalize() + "." for _ in range(60)]
    rows = [(i, f"{names[i]} {words(rng, 3)}") for i in range(60)] + [(60 + i, s) for i, s in enumerate(short)]
    rows += [(200, " ".join(names)), (201, " ".join(reversed(names))), (202, " ".join(reversed(short))), (203, " ".join(short))]
    assert spans(docs, rows) == []
    rows += [(300, " ".join(names[5:50])), (301, " ".join(short[10:40]))]
    got = spans(docs, rows)
    assert {r.doc_id for r in got} == {300, 301}
    check(rows, got, 0.3)


def test_repeats_inside_sentences_are_found(docs):
    rng = random.Random(11)
    rows, n = [], 100
    for i in range(n):
        passage = words(rng, 60)
        rows += [(i, f"{words(rng, 30)} {passage} {words(rng, 30)}"), (1000 + i, f"{words(rng, 25)} {passage} {words(rng, 35)}")]
    got = spans(docs, rows)
    check(rows, got, 0.6)  # no stop and no line here: cuts are CUT_EVERY words apart
    assert all(r.doc_id >= 1000 for r in got) and len({r.doc_id for r in got}) >= 0.8 * n
    # sentences as in prose
    rows = []
    for i in range(n):
        passage = sentences(rng, 8)
        rows += [(i, f"{words(rng, 30)} {passage} {words(rng, 30)}"), (1000 + i, f"{words(rng, 25)} {passage} {words(rng, 35)}")]
    got = spans(docs, rows)
    check(rows, got, 0.2)
    assert len({r.doc_id for r in got}) >= 0.98 * n
