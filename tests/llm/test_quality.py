import collections
import math
import re
import statistics

import numpy as np
import pyarrow as pa
import pytest

from fathomline.llm import quality

from .conftest import ODD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORDS.findall(text)
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    cover = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover), failed


def corpus():
    rng = np.random.default_rng(4)
    common = "the of and to a in is that it for was on with as be by this are at from".split()
    rare = ["".join(rng.choice(list("abcdefghijklmnoprstuvw"), 6)) for _ in range(400)]

    def text(n):
        return " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) for _ in range(n)) + "."

    good = [(i, text(int(rng.integers(60, 400))), "en") for i in range(100)]
    signs = [(200 + i, " ".join(w + "%%%" for w in text(200).split()), "en") for i in range(5)]
    loud = [(300 + i, " ".join(w.upper() + "!!" for w in text(200).split()), "en") for i in range(5)]
    table = [(400 + i, " | ".join(rng.choice(rare, 150)), "en") for i in range(5)]
    return good, signs + loud + table


def test_base_counts_equal_brute_force(docs):
    rows = ODD + [(50, "a b c a b c a b c\nx\n x\nx\n\n" * 9), (51, "a b c d " * 5)]
    got = quality.assess(docs(rows)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], key=key) == sorted([(d, *base(t)) for d, t in rows], key=key)
    assert all(r.kept is False for r in got if r.base_failed)


def test_poor_documents_go_and_good_ones_stay(docs):
    good, poor = corpus()
    kept = {r.doc_id: r.kept for r in quality.assess(docs(good + poor)).collect()}
    assert all(kept[r[0]] for r in good) and not any(kept[r[0]] for r in poor)


CLASS_OF = {" ": "blank", "\t": "blank", "!": "bang"} | dict.fromkeys("\n\r\x0b\x0c", "break") | dict.fromkeys(".,;:?'\"()-", "stop") | dict.fromkeys("#*$%&|<>", "symbol")


def brute_kept(rows, limits=(0.17, 0.25), common=24, least=50):
    """The verdict of every text, one text and one bin at a time."""

    def class_of(c):
        if c in CLASS_OF:
            return CLASS_OF[c]
        kind = "wide" if ord(c) > 127 else "digit" if c.isdigit() else "lower" if c.islower() else "upper" if c.isupper() else "other"
        return kind

    def stem(w):
        return w.lower().strip(".,;:!?'\"()-#*$%&|<>")

    def histograms(text, top):
        words = WORDS.findall(text)
        classes = collections.Counter(map(class_of, text))
        found = collections.Counter(stem(w) if stem(w) in top else None for w in words)
        return [classes[c] for c in quality.CLASSES], [found[w] for w in [*top, None]]

    def away(counts, ref):
        n = sum(counts)
        js = 0.0
        for p, q in zip((c / max(n, 1) for c in counts), ref, strict=True):
            m = (p + q) / 2
            js += (p * math.log2(p / m) if p else 0) / 2 + (q * math.log2(q / m) if q else 0) / 2
        return math.sqrt(max(js - (len(counts) - 1) / (8 * max(n, 1) * math.log(2)), 0))

    refs = []
    for lang in sorted({r[2] for r in rows if r[2]}):
        own = [r[1] or "" for r in rows if r[2] == lang]
        n = collections.Counter(stem(w) for t in own for w in WORDS.findall(t))
        top = [w for w, _ in sorted(((w, k) for w, k in n.items() if w), key=lambda x: (-x[1], x[0]))[:common]]
        shares = []
        for t in own:
            if len(WORDS.findall(t)) >= least:
                c, w = histograms(t, top)
                shares.append([math.floor(x / sum(c) * 4096) for x in c] + [math.floor(x / sum(w) * 4096) for x in w[:-1]])
        if shares:
            middle = [(statistics.median(x) + (0.5 if statistics.median(x) else 0)) / 4096 for x in zip(*shares, strict=True)]
            c, w = middle[:10], middle[10:]
            refs.append((top, [x / sum(c) for x in c], [x / max(sum(w), 1) for x in [*w, max(1 - sum(w), 0)]]))
    out = []
    for _, text, *_ in rows:
        if base(text)[-1]:
            out.append(False)
            continue
        far = []
        for top, c_ref, w_ref in refs:
            c, w = histograms(text, top)
            far.append((away(c, c_ref), away(w, w_ref)))
        nearest = min(far, key=sum, default=(0, 0))
        out.append(nearest[0] <= limits[0] and nearest[1] <= limits[1])
    return out


def test_verdicts_equal_brute_force(docs):
    good, poor = corpus()
    rng = np.random.default_rng(8)
    german = "der die das und in zu den mit ist ein von nicht es sich auch auf für an".split()
    more = [(500 + i, " ".join(rng.choice(german) if rng.random() < 0.5 else "Wörter" + chr(97 + i % 26) + str(rng.integers(9)) for _ in range(50 + 4 * i)), "de") for i in range(30)]
    mixed = [(600 + i, " ".join((good[i][1].split() + ["5%" * k] * k * 9)[-120:]), "en") for i in range(20) for k in (1, 3)]
    rows = good + poor + more + mixed + [(700, "kurz " * 20, "xx"), *[(d, t, "en") for d, t in ODD]]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    got = quality.assess(docs(rows)).collect()
    want = brute_kept(rows)
    assert sorted([(r.doc_id, r.kept) for r in got], key=key) == sorted([(r[0], k) for r, k in zip(rows, want, strict=True)], key=key)
    assert 0 < sum(want) < len(want)


def test_labels_bound_and_clashing_columns(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(60)), f"l{i}", 1, "x") for i in range(4)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int, n_words string")
    assert all(r.kept is True and r.n_words == 60 for r in quality.assess(table).collect())
    with pytest.raises(ValueError):
        quality.assess(table, most_langs=3)


def test_without_any_language_only_the_base_judges(docs):
    rows = [(1, " ".join(f"w{i}" for i in range(80)))]
    r = quality.assess(docs(rows)).collect()[0]
    assert r.kept and r.class_distance is None
    assert quality.assess(docs([])).count() == 0


def test_divergence_is_the_distance_of_two_distributions():
    p, q = np.array([[2.0, 2.0, 0.0], [0.0, 0.0, 5.0], [0.0, 0.0, 0.0]]), np.array([0.5, 0.5, 0.0])
    d = quality.divergence(p, q)
    assert abs(d[0]) < 1e-12 and abs(d[1] - 1) < 1e-12


def test_classes_count_characters():
    c = quality.class_counts(pa.array(["x", "aB1 .!#é漢\n~"]).slice(1))[0]
    assert dict(zip(quality.CLASSES, c.tolist(), strict=True)) == {"lower": 1, "upper": 1, "digit": 1, "blank": 1, "break": 1, "stop": 1, "bang": 1, "symbol": 1, "other": 1, "wide": 2}
