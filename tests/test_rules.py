import json

import numpy as np
import pytest

from fathomline import config as cfg
from fathomline.operators import gramsets
from fathomline.operators import imports as imp
from fathomline.operators import rules as r
from fathomline.operators import similar
from fathomline.plans import check as plans
from fathomline.schema import FILES


def files(spark, **texts):
    rows = []
    for path, text in texts.items():
        ext = "." + path.rsplit(".", 1)[-1] if "." in path.rsplit("/", 1)[-1] else ""
        rows.append((path, path, path, ext, len((text or "").encode()), text))
    return spark.createDataFrame(rows, FILES)


def got(df):
    return sorted((v.file_path, v.message, v.fix, v.severity) for v in df.collect())


def test_long_lines_pass_over_inline_markup(spark):
    long = "x" * 12
    f = files(spark, **{"a.ts": f"{long}\n<svg>\n{long}\n</svg>\n{long}\n</svg></svg>\n{long}", "b.svg": long, "c.txt": f"ok\r\n{long}é\n", "d.txt": "", "e.ts": long + "\n"})
    assert [(p, m.split()[1]) for p, m, _, _ in got(r.max_characters_per_line(f, 10))] == [("a.ts", "1"), ("a.ts", "5"), ("a.ts", "6"), ("a.ts", "7"), ("c.txt", "2"), ("e.ts", "1")]


def test_file_sizes_count_code_and_warn_for_the_rest(spark):
    f = files(spark, **{"a.ts": "x\ny\nz\n", "b.ts": "x\n// c\n\n\n", "c.ts": "", "d.ts": "/* a\nb */ x\n"})
    found = {(p, s): m for p, m, _, s in got(r.max_file_lines(f, 2))}
    assert found == {("a.ts", None): "file has 3 lines and exceeds the limit of 2", ("b.ts", "warning"): "file has 5 physical lines, but only 1 code lines count toward the limit of 2", ("d.ts", "warning"): "file has 3 physical lines, but only 1 code lines count toward the limit of 2"}
    assert {p for p, *_ in got(r.min_file_lines(f, 1))} == {"b.ts", "c.ts", "d.ts"}


def test_banned_patterns_overlap_and_skip_specifiers(spark):
    f = files(spark, **{"a.ts": 'import x from "./lodash";\nconst a = "AAAA";\n', "b.ts": "lodash aaa .fathomline/lodash/x ", "c.txt": "aa", "ok.ts": "lodash"})
    rows = {(v.file_path, json.loads(v.details)["pattern"]): json.loads(v.details)["occurrences"] for v in r.banned_patterns(f, [{"value": "aa", "allowed_files": []}, {"value": "Lodash", "allowed_files": ["ok.ts"]}]).collect()}
    assert rows == {("a.ts", "aa"): 3, ("b.ts", "aa"): 2, ("b.ts", "Lodash"): 1, ("c.txt", "aa"): 1}


@pytest.mark.parametrize("glob,path,hit", [("a/**", "a", True), ("a/**", "a/b/c.ts", True), ("**/*.ts", "x.ts", True), ("*.ts", "a/x.ts", False), ("a/**/b", "a/b", True), ("a?.ts", "ab.ts", True), ("a?.ts", "a/.ts", False), ("x**y", "xzzy", True), ("x**y", "x/y", False)])
def test_globs(spark, glob, path, hit):
    from pyspark.sql import functions as F

    from fathomline.functions import paths

    assert paths.py_glob_matches(path, glob) is hit
    assert spark.range(1).select(paths.glob_matches(F.lit(path), glob)).first()[0] is hit


@pytest.mark.parametrize("entry,path,out", [({"pattern": "gen"}, "a/gen/x.ts", True), ({"pattern": "gen"}, "gen.ts", False), ({"pattern": "a/b"}, "a/b/c/x.ts", True), ({"pattern": "a/b"}, "z/a/b/x.ts", True), ({"pattern": "a/b"}, "a/bc/x.ts", False), ({"type": "file", "pattern": "**/*.min.js"}, "q/a.min.js", True), ({"pattern": "ge*"}, "gen/x", True)])
def test_exclusions(spark, entry, path, out):
    from pyspark.sql import functions as F

    from fathomline.functions import paths

    assert paths.py_excluded(path, [entry]) is out
    assert spark.range(1).select(paths.excluded(F.lit(path), [entry])).first()[0] is out


def test_path_segments(spark):
    f = files(spark, **{k: "" for k in ("src/user_route.ts", "src/user_model.ts", "src/other.ts", "src/pages/home_page.ts", "src/pages/home_route.ts", "user/user_api.go", "x/a_b.txt", "x/a_c.txt", "src/_x.ts", "src/y_.ts")})
    rows = {v.file_path: (v.suggested_path, json.loads(v.details)["mode"]) for v in r.redundant_path_segments(f, ["_"]).collect()}
    assert rows == {"src/user_route.ts": ("src/user/route.ts", "same-directory-group"), "src/user_model.ts": ("src/user/model.ts", "same-directory-group"), "src/pages/home_page.ts": ("src/pages/home.ts", "redundant-path-segment"), "user/user_api.go": ("user/api.go", "repeated-folder-prefix")} | ({"src/pages/home_route.ts": ("src/pages/home/route.ts", "same-directory-group")} if "src/pages/home_route.ts" in rows else {})


def test_functions_names_comments_and_spacing(spark):
    f = files(spark, **{"a.ts": "function f() {\n  a();\n  b();\n  c();\n}\nconst x = 1; // c\n", "b.py": "def long_enough():\n    pass\ndef g():\n    pass\n"})
    assert got(r.max_function_lines(f, 4)) == [("a.ts", "function f has 5 lines and exceeds the limit of 4", False, None)]
    assert [m for _, m, _, _ in got(r.declaration_names(f, minimum=2))] == ["const x has 1 character and below the minimum name length of 2", "function f has 1 character and below the minimum name length of 2", "function g has 1 character and below the minimum name length of 2"]
    assert [m for _, m, _, _ in got(r.declaration_names(f, maximum=5))] == ["function long_enough has 11 characters and exceeds the maximum name length of 5"]
    assert got(r.remove_comments(f)) == [("a.ts", "file contains 1 removable comment", True, None)] and not got(r.remove_comments(f, ["// c"]))
    assert [(p, m) for p, m, _, _ in got(r.structural_blank_lines(f))] == [("a.ts", "file has 1 structural boundary with incorrect blank line spacing"), ("b.py", "file has 1 structural boundary with incorrect blank line spacing")]


def test_duplicate_functions_group_by_language(spark):
    body = "{{\n  const total = {a} + {b};\n  return other(total, {a});\n}}\n"
    f = files(spark, **{"a.ts": "function one(x, y) " + body.format(a="x", b="y"), "b.ts": "\nfunction two(p, q) " + body.format(a="p", b="q"), "c.ts": "function small() {\n}\n", "d.ts": "function tiny() {\n}\n", "a.sh": "f() {\n  x\n}\n", "b.sh": "g() {\n  x\n}\n"})
    groups = [json.loads(v.details) for v in r.dry(f).collect()]
    assert sorted(g["locations"] for g in groups) == [["a.sh#f", "b.sh#g"], ["a.ts#one", "b.ts#two"]]
    assert all(g["signals"] == ["exact-normalized"] and g["confidence"] == 1 for g in groups)


def test_imports(spark):
    f = files(spark, **{"src/a.ts": "import { used, gone as away } from '../lib/b';\nimport './side';\nimport z from './missing';\nimport './lost';\nused(z);\n", "lib/b.ts": "export const used = 1;\n", "src/side/index.ts": "x\n", "s/m.scss": "@use 'part';\n@use './part';\n", "s/_part.scss": "a{}\n"})
    alias = spark.createDataFrame([("#b", "lib/b.ts"), ("#side", "src/side/index.ts")], "id string, path string")
    rows = got(imp.imports(f, alias, remove_dead=True))
    assert [(m, fix) for _, m, fix, _ in rows] == [("relative import ../lib/b should be rewritten to #b", True), ("unresolved import ./lost should be removed", True), ("unresolved import ./missing should be removed", False), ("unused import away should be removed", True)]
    edges = {(e.path, e.target) for e in imp.import_edges(f).collect()}
    assert edges == {("src/a.ts", "lib/b.ts"), ("src/a.ts", "src/side/index.ts"), ("s/m.scss", "s/_part.scss")}


def test_shims_follow_their_chain(spark):
    f = files(spark, **{"a.ts": "export * from './b';\n", "b.ts": "// note\nexport { x } from './c';\n", "c.ts": "export const x = 1;\n", "d.ts": "export * from './e';\n", "e.ts": "export * from './d';\n", "f.ts": "import './a';\n"})
    assert {(s.path, s.target) for s in imp.redirect_shims(f).collect()} == {("a.ts", "c.ts"), ("b.ts", "c.ts")}


def test_check_joins_rules_with_severities_in_order(spark):
    config = cfg.normalize({"rules": {"max-file-lines": {"max": 1, "severity": "warning"}, "max-characters-per-line": {"max": 3}, "dry": False, "remove-empty-folders": {}}})
    f = files(spark, **{"b.txt": "a\nb", "a.txt": "long line"})
    dirs = spark.createDataFrame([("", 0), ("e", 0), ("b", 1)], "path string, n_entries int")
    v = plans.ordered(plans.check(config, f, dirs)).collect()
    assert [(x.rule, x.file_path, x.severity) for x in v] == [("max-characters-per-line", "a.txt", None), ("max-file-lines", "b.txt", "warning"), ("remove-empty-folders", "e", None)]
    s = plans.summary(plans.check(config, f, dirs)).first()
    assert (s.ok, s.violation_count, s.blocking_count) == (False, 3, 2)


def test_similar_texts(spark):
    t = spark.createDataFrame([(1, "x", "the quick brown fox jumps"), (2, "x", "the quick brown fox jumped"), (3, "x", "entirely other words here"), (4, "y", "the quick brown fox jumps"), (5, "x", ""), (6, "x", "")], "id long, language string, text string")
    pairs = [(p.a, p.b) for p in similar.exact_pairs(t, 0.7).collect()]
    assert sorted(pairs) == [(1, 2), (5, 6)]
    assert {(p.a, p.b) for p in similar.band_pairs(t, 0.8).collect()} <= {(1, 2), (5, 6)}
    assert {(g.id, g.grp) for g in similar.groups(similar.exact_pairs(t, 0.7)).collect()} == {(1, 1), (2, 1), (5, 5), (6, 5)}


def brute(rows, threshold, length_ratio=0.75):
    """(a, b, common, whole) of all pairs of rows (id, language, text)."""
    grams = [{f"  {t}  "[i : i + 3] for i in range(len(t) + 2)} for _, _, t in rows]
    out = []
    for i, (a, la, ta) in enumerate(rows):
        for j, (b, lb, tb) in enumerate(rows):
            common, whole = len(grams[i] & grams[j]), len(grams[i] | grams[j])
            if a < b and la == lb and min(len(ta), len(tb)) >= max(len(ta), len(tb)) * length_ratio and common / whole >= threshold:
                out.append((a, b, common, whole))
    return sorted(out)


def odd_texts(seed=3, n=150):
    """Texts of three alphabets, near copies, exact copies, short and empty ones."""
    import random

    g = random.Random(seed)
    words = [["the", "tion", "an", "er", "oth"], ["ché", "è", "été", "où"], ["你好", "世界", "𝒳𝒴", "文"]]
    texts = []
    for i in range(n):
        t = " ".join(g.choice(words[i % 3]) + g.choice(words[i % 3]) for _ in range(g.choice([0, 1, 3, 8, 20, 40])))
        texts += [t, t[: len(t) - g.randrange(3)] + g.choice(["", "x", "yz"])] + [t] * (i % 10 == 0)
    return [(i * 7 % 1009, "xy"[g.random() < 0.2], t) for i, t in enumerate(texts)]


def test_bands_do_not_list_the_pairs_that_share_one(spark):
    # all pairs of a band travelled before, two rows for each; now the best of each record do
    plan = similar.band_pairs(spark.createDataFrame([(1, "x", "abc")], "id long, language string, text string"), 0.3)._jdf.queryExecution().analyzed().toString()
    assert "row_number" not in plan and plan.count("Join") == 1  # that join is with the list of large bands


@pytest.mark.parametrize("large", [4096, 5])
def test_band_pairs_equal_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(similar, "BAND_TEXTS", large)
    rows = odd_texts()
    found = {(p.a, p.b): p.similarity for p in similar.band_pairs(spark.createDataFrame(rows, "id long, language string, text string"), 0.3, most_candidates=6).collect()}

    def fnv(gram):
        h, units = 2166136261, gram.encode("utf-16-le")
        for i in range(0, len(units), 2):
            h = (h ^ int.from_bytes(units[i : i + 2], "little")) * 16777619 % 2**32
        return h

    least = {i: sorted(fnv(g) for g in {f"  {t}  "[k : k + 3] for k in range(len(t) + 2)})[:16] for i, _, t in rows}
    bands = {i: {(k, *h[k : k + 4]) for k in range(0, len(h), 4)} for i, h in least.items()}
    size, expected = {i: len(t) for i, _, t in rows}, {}
    near = {}
    for a, b, common, whole in brute(rows, 0):
        if hits := len(bands[a] & bands[b]):
            near.setdefault(b, []).append((-hits, abs(size[a] - size[b]), a, common / whole))
    for b, of in near.items():
        expected |= {(a, b): s for _, _, a, s in sorted(of)[:6] if s >= 0.3}
    assert expected.keys() == found.keys() and len(found) > 100 and max(map(len, near.values())) > 6
    assert all(abs(found[p] - s) < 0.00051 for p, s in expected.items())


def test_best_in_band_takes_the_nearest_lengths():
    # from 32 characters apart on the key overflowed before, as lengths come with 32 bits
    n = np.arange(1000, 1400, 5, dtype=np.int32)[::-1].copy()
    best = gramsets.best_in_band(n, np.arange(80), np.zeros((80, 1), np.int64), 0, np.ones(80, bool), 0.75, 20)
    got = {(b, a) for bs, as_, _ in best for b, a in zip(bs.tolist(), as_.tolist(), strict=True)}
    fits = lambda a, b: min(n[a], n[b]) >= max(n[a], n[b]) * 0.75
    want = {(b, a) for b in range(80) for a in sorted((a for a in range(b) if fits(a, b)), key=lambda a: (abs(int(n[a]) - int(n[b])), a))[:20]}
    assert got == want


def test_band_pairs_far_apart_in_length(spark):
    # one band, the last text is the shortest: the nearest of the others are chosen, 40 characters and more away
    head = "".join(f"{chr(97 + i % 26)}{chr(97 + i * 7 % 26)}{chr(97 + i * 11 % 26)} " for i in range(26)) * 5
    rows = [(i, "x", head + " " * (300 - 40 * i)) for i in range(7)]
    found = similar.band_pairs(spark.createDataFrame(rows, "id long, language string, text string"), 0.3, length_ratio=0.5, most_candidates=2).collect()
    assert {(p.a, p.b) for p in found} == {(a, b) for b in range(7) for a in range(max(0, b - 2), b)}


def test_similarity_is_rounded_as_a_double(spark):
    s = spark.createDataFrame([(406, 800), (9, 16), (1, 1)], "common int, whole int")
    # 0.5075 is a little less than its decimals say, and was 0.508 before
    assert [r.s for r in s.select(similar.rounded(s.common / s.whole).alias("s")).collect()] == [0.507, 0.563, 1.0]


@pytest.mark.parametrize("most", [8192, 9])
def test_exact_pairs_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(similar, "PART_TEXTS", most)
    rows = odd_texts(5)
    for threshold in (0.4, 0.8):
        found = similar.exact_pairs(spark.createDataFrame(rows, "id long, language string, text string"), threshold)
        assert sorted((p.a, p.b, p.common, p.whole) for p in found.collect()) == brute(rows, threshold)


def test_exact_pairs_keep_to_a_language_where_ids_meet(spark):
    # the pair came twice before, as its ids were looked up in both languages
    t = spark.createDataFrame([(1, "x", "the quick fox"), (2, "x", "the quick fax"), (1, "y", "the quick fox"), (None, "x", "the quick fox"), (3, None, "the quick fox")], "id long, language string, text string")
    assert [(p.a, p.b, p.common, p.whole) for p in similar.exact_pairs(t, 0.5).collect()] == [(1, 2, 12, 18)]


@pytest.mark.parametrize("bits, first", [(16384, 32), (128, 1), (64, 1)])
def test_cell_pairs_equal_brute_force(monkeypatch, bits, first):
    monkeypatch.setattr(gramsets, "BITS", bits)
    monkeypatch.setattr(gramsets, "FIRST_WORDS", first)
    rows = [(i, "x", t) for i, (_, _, t) in enumerate(odd_texts(7))]
    texts = [t for _, _, t in rows]
    sets, n = gramsets.Sets(texts), np.array([len(t) for t in texts])
    x, y = np.arange(0, len(rows), 2), np.arange(1, len(rows), 2)
    parts = [p for cell in ((x, None), (y, None), (x, y)) for p in gramsets.cell_pairs(*cell, n, sets, 0.4, 0.75)]
    found = [(int(min(p, q)), int(max(p, q)), int(c), int(sets.size[p] + sets.size[q] - c)) for a, b, common in parts for p, q, c in zip(a, b, common, strict=True)]
    assert sorted(found) == brute(rows, 0.4)


def test_components_come_from_few_links(spark):
    rows = [(i, "x", "the quick brown fox") for i in range(40)] + [(90, "x", "the quick brown fix"), (91, "y", "the quick brown fox"), (92, "x", "")]
    links = similar.exact_links(spark.createDataFrame(rows, "id long, language string, text string"), 0.6)
    # of 820 pairs, all of which were linked before
    assert links.count() == 40
    assert {(g.id, g.grp) for g in similar.groups(links).collect()} == {(i, 0) for i in [*range(40), 90]}


def test_similar_functions_join_equal_and_near_ones(spark):
    body = "{{\n  const total = {a} + {b};\n  return other(total, {a}, 'some longer text that both of them share {n}');\n}}\n"
    f = files(spark, **{"a.ts": "function one(x, y) " + body.format(a="x", b="y", n=""), "b.ts": "function two(p, q) " + body.format(a="p", b="q", n=""), "c.ts": "function three(p, q) " + body.format(a="p", b="q", n="!"), "d.ts": "function far(p) {\n  const other_things = p.map(String).join('-').trim();\n  return other_things;\n}\n"})
    d = r.exploded(f, "dry_descriptors")
    groups = [json.loads(v.details) for v in similar.similar_functions(d, threshold=0.9).collect()]
    assert [g["locations"] for g in groups] == [["a.ts#one", "b.ts#two", "c.ts#three"]]
    assert groups[0]["signals"] == ["exact-normalized", "similar-normalized"] and 0.9 <= groups[0]["confidence"] < 1
