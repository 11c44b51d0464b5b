import json
import os
from datetime import datetime

import pytest

from fathomline import cli, engine
from fathomline import config as cfg
from fathomline.plans import fix as fixes
from fathomline.sources import manifests, sinks, tree


def make(root, **texts):
    for path, text in texts.items():
        p = root / path
        if text is None:
            p.mkdir(parents=True, exist_ok=True)
        else:
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


def test_scan_sees_what_spark_passes_over(spark, tmp_path):
    root = make(tmp_path, **{"_p.scss": "a{}", ".dot/x.ts": "x", "_d/y.ts": "y", "bad.ts": b"\xff\xfe", "node_modules/z.ts": "z", "skip/a.ts": "", "out/b.ts": "", "k.TXT": "", "up.TS": "u", "a/empty": None, "gen.min.ts": ""})
    files, dirs = tree.read_tree(spark, root, exclude=[{"type": "folder", "pattern": "skip"}, {"type": "file", "pattern": "*.min.ts"}], ignore=["out/"])
    assert sorted((f.path, f.ext) for f in files.collect()) == [(".dot/x.ts", ".ts"), ("_d/y.ts", ".ts"), ("_p.scss", ".scss"), ("up.TS", ".ts")]
    assert {d.path for d in dirs.filter("n_entries = 0").collect()} == {"a/empty"}
    assert tree.scan_metrics(files, dirs) == {"directories": 5, "files": 4, "bytes": 6}


def test_ignore_files(tmp_path):
    root = make(tmp_path, **{".gitignore": "# c\n!keep\nlogs/\n*.tmp\n.cache\nplain\nfile.txt\n/top/\n"})
    assert tree.ignored_folders(root) == ["logs", ".cache", "plain", "top"]
    assert tree.ignore_patterns(root) == ["logs", "*.tmp", ".cache", "plain", "file.txt", "top"]


SOURCES = {
    "src/user_route.ts": "import { m } from './user_model'; // note\nexport const r = m;\n", "src/user_model.ts": "export const m = 1;\n", "src/main.ts": "import { r } from './user_route';\nimport { m } from './shim';\nimport './gone';\nconsole.log(r, m);\n",
    "src/shim.ts": "export { m } from './user_model';\n", "src/old.bak.ts": "x\n", "py/a.py": "def a():\n    pass\ndef b():\n    pass\n", "deep/er/none": None,
}
RULES = {"banned-files": {"patterns": ["**/*.bak.ts"]}, "min-file-lines": {"min": 1}, "redundant-path-segments": {}, "imports": {}, "remove-comments": {}, "structural-blank-lines": {}, "remove-empty-folders": {}}


def test_fix_then_check_is_clean_and_fix_again_changes_nothing(spark, tmp_path):
    root = make(tmp_path, **SOURCES)
    runner = engine.Runner(spark, root, {"rules": RULES})
    before = runner.check()
    assert not before.ok and set(before.rules) >= {"banned-files", "min-file-lines", "redundant-path-segments", "imports", "remove-comments", "structural-blank-lines", "remove-empty-folders"}
    result = runner.fix()
    c = result.counters
    assert c["banned-files"]["deleted"] == 1 and c["min-file-lines"]["deleted"] == 1 and c["redundant-path-segments"]["moved"] == 2 and c["remove-empty-folders"]["deleted"] == 3
    assert sorted(os.listdir(f"{root}/src")) == ["main.ts", "user"]
    text = (tmp_path / "src/main.ts").read_text()
    assert "'./user/route'" in text and "'./user/model'" in text and "./gone" not in text
    assert "'./model'" in (tmp_path / "src/user/route.ts").read_text() and "//" not in (tmp_path / "src/user/route.ts").read_text()
    assert (tmp_path / "py/a.py").read_text() == "def a():\n    pass\n\ndef b():\n    pass\n"
    left = {v["rule"] for v in result.violations}
    assert left <= {"min-file-lines"}
    again = runner.fix()
    assert all(not any(n.values()) for n in again.counters.values())


def test_format_and_string_fixes(spark, tmp_path):
    long = "one two three four five six seven eight nine ten"
    root = make(tmp_path, **{"a.ts": f"const a={{\nkey:'{long}'\n}}\n"})
    engine.Runner(spark, root, {"rules": {"format": {}, "max-characters-per-line": {"max": 40}}}).fix()
    text = (tmp_path / "a.ts").read_text()
    assert max(map(len, text.split("\n"))) <= 40 and "".join(text.split('"')[1::2]) == long


def test_aliases_are_rewritten(spark, tmp_path):
    root = make(tmp_path, **{"src/a/x.ts": "import { y } from '../b/y';\nimport { z } from './z';\ny(z);\n", "src/a/z.ts": "export const z = 1;\n", "src/b/y.ts": "export const y = 1;\n"})
    engine.Runner(spark, root, {"rules": {"imports": {"alias": {"strategy": "relative-path-slug"}}}}).fix()
    assert (tmp_path / "src/a/x.ts").read_text() == "import { y } from '#src-b-y';\nimport { z } from './z';\ny(z);\n"


def test_dead_names_are_trimmed():
    text = "import d from 'a';\nimport u, { v, w as x } from 'b';\nimport * as n from 'c';\nimport 'side';\nimport type { T } from 't';\nx(u);\n"
    assert fixes.without_dead_names(text, ".ts") == "import u, { w as x } from 'b';\nimport 'side';\nx(u);\n"


@pytest.mark.parametrize("source,target,like,want", [("a/x.ts", "a/b/y.ts", "./y", "./b/y"), ("a/b/x.ts", "c/index.ts", "../c", "../../c"), ("x.ts", "y.ts", "./y.ts", "./y.ts"), ("x.ts", "y.ts", "./y.js", "./y.js")])
def test_relative_specifiers(source, target, like, want):
    assert fixes.relative_specifier(source, target, like) == want


def test_moves_are_checked_before_anything_moves(tmp_path):
    root = make(tmp_path, **{"a": "1", "b": "2", "c": "3"})
    for bad in ([("a", "z"), ("b", "z")], [("a", "c")]):
        with pytest.raises(sinks.PlanConflict):
            sinks.commit(root, {"b": "new"}, moves=bad)
    assert (tmp_path / "b").read_text() == "2"
    sinks.commit(root, moves=[("a", "b"), ("b", "a")])
    assert (tmp_path / "a").read_text() == "2" and (tmp_path / "b").read_text() == "1"


def test_configs_merge_and_are_checked():
    low = {"rules": {"max-file-lines": {"max": 10}, "banned-patterns": {"patterns": [{"value": "Foo", "allowed_files": ["a"]}, "x"]}}}
    high = {"presets": ["p"], "helpers": {"process_boundary": {"env_files": ["env.ts"]}}, "rules": {"max-file-lines": {"max": 20}, "banned-patterns": {"patterns": [{"value": "foo", "allowed_files": ["b"]}]}}}
    out = cfg.normalize(cfg.resolve(high, {"p": low}))
    patterns = {p["value"]: p["allowed_files"] for p in out["rules"]["banned-patterns"]["patterns"]}
    assert out["rules"]["max-file-lines"]["max"] == 20 and patterns["Foo"] == ["a", "b"] and patterns["process.env"] == ["env.ts"] and patterns["process.argv"] == [] and "x" in patterns
    assert out["selected"] == ["banned-patterns", "max-file-lines"]


@pytest.mark.parametrize("config,code", [
    ({"rules": {"nope": {}}}, "rule-unknown"), ({"rules": {"max-file-lines": {}}}, "option-required"), ({"rules": {"max-file-lines": {"max": float("nan")}}}, "threshold-invalid"), ({"rules": {"banned-files": {"patterns": [" "]}}}, "option-required"),
    ({"rules": {"remove-comments": {"odd": 1}}}, "option-unknown"), ({"rules": {"dry": {"severity": "loud"}}}, "severity-invalid"), ({"rules": {"dry": {"exclude_dirs": [{"type": "x"}]}}}, "exclusion-invalid"), ({"ignore": {"use_gitignore": "yes"}}, "ignore-invalid"),
])
def test_bad_configs(config, code):
    with pytest.raises(cfg.ConfigError) as e:
        cfg.normalize(config)
    assert e.value.code == code


def test_selectors_presets_and_versions():
    for only, mode, code in ((["zzz"], "check", "selector-unknown"), (["format"], "check", "selector-unconfigured"), (["dry"], "fix", "selector-not-fixable")):
        with pytest.raises(cfg.ConfigError) as e:
            cfg.normalize({"rules": {"dry": {}}}, only=only, mode=mode)
        assert e.value.code == code
    for config, code in (({"presets": ["x"]}, "preset-unknown"), ({"presets": ["p"]}, "preset-nested")):
        with pytest.raises(cfg.ConfigError) as e:
            cfg.resolve(config, {"p": {"presets": []}})
        assert e.value.code == code
    cfg.check_version({"for_version": "1.2.9"}, "1.2.0")
    for config in ({"for_version": "1.3"}, {"a": 1, "for_version": "1.2"}):
        with pytest.raises(cfg.ConfigError):
            cfg.check_version(config, "1.2.0")
    assert cfg.normalize({"rules": {"min-file-lines": {"min": 2.9}}})["rules"]["min-file-lines"]["min"] == 2


def test_manifests(tmp_path):
    p = str(tmp_path / "t.json")
    open(p, "w").write('{ // c\n "compilerOptions": {"baseUrl": ".", "paths": {"ext": ["./e"]},}, /* d */ "u": "//x" }')
    value = manifests.read_manifest(p)
    assert value["u"] == "//x"
    new = manifests.with_paths(value, {"#a": "src/a.ts"})
    assert new["compilerOptions"] == {"paths": {"ext": ["./e"], "#a": ["./src/a.ts"]}}
    assert manifests.write_manifest(p, new) and not manifests.write_manifest(p, new)
    assert manifests.with_managed_imports({"imports": {"#old": "./x", "keep": "y"}}, {"#a": "src/a.ts"})["imports"] == {"keep": "y", "#a": "./src/a.ts"}
    folder, many = str(tmp_path / "f"), {f"#{i:04d}": f"p{i}" for i in range(25)}
    manifests.write_alias_folder(folder, many, 10)
    assert manifests.read_alias_folder(folder) == many and len(os.listdir(folder)) == 3
    manifests.write_alias_folder(folder, {"#1": "p"}, 10)
    assert os.listdir(folder) == ["aliases-1.json"]
    assert manifests.with_include({"include": ["a/**/*.ts"]}, ["a", "b"])["include"] == ["a/**/*.ts", "b/**/*.ts"]
    assert manifests.add_ignore_entry(str(tmp_path), "x/") and not manifests.add_ignore_entry(str(tmp_path), "x/")


def test_alias_allocation(tmp_path):
    a = engine.sync_aliases("", ["a/b.ts", "a-b.ts", "c.ts"], strategy="relative-path-slug", existing={"#kept": "./c.ts", "bad id": "a/b.ts"})
    assert a == {"#kept": "c.ts", "#a-b": "a-b.ts", "#a-b-2": "a/b.ts"}
    r = engine.sync_aliases("", ["x"], seed=1)
    assert len(next(iter(r))) == 13 and r == engine.sync_aliases("", ["x"], seed=1)
    with pytest.raises(cfg.ConfigError):
        engine.sync_aliases("", ["x", "y"], strategy=lambda path, taken, prefix: "#same")
    (tmp_path / "package.json").write_text(json.dumps({"imports": {}}))
    assert engine.manifest_drift(str(tmp_path), {"#a": "a.ts"}) == ["package.json"]


def test_command_line(spark, tmp_path, capsys):
    root = make(tmp_path, **{"a.ts": "const x = 1;\n", "fathomline.config.json": json.dumps({"rules": {"max-file-lines": {"max": 5}}})})
    assert cli.main(["check", "--root", root, "save"]) == 0 and "ok" in capsys.readouterr().out
    assert cli.main(["gate", "--root", root, "--", "sh", "-c", "exit 3"]) == 3
    assert cli.main(["gate", "--root", root, "--", "sh", "-c", "kill -TERM $$"]) == 143
    assert cli.main(["check", "dry", "--root", root]) == 1 and "selector-unconfigured" in capsys.readouterr().err
    assert cli.main(["gate", "--root", root]) == 1
    make(tmp_path, **{"b.ts": "x\n" * 9})
    assert cli.main(["check", "--root", root]) == 1


def test_reports_and_hooks(spark, tmp_path):
    root, calls = make(tmp_path, **{"a.ts": "x\n"}), []
    hooks = {k: (lambda state, k=k: calls.append(k)) for k in ("before_run", "before_mode", "after_mode", "after_run")}
    result = engine.Runner(spark, root, {"rules": {"max-file-lines": {"max": 1}, "min-file-lines": {"min": 1, "severity": "warning"}}, "lifecycle": hooks}).check()
    assert calls == ["before_run", "before_mode", "after_mode", "after_run"] and result.ok
    assert engine.render(result, warnings=False).split()[1].startswith("violation")
    assert engine.save_report(str(tmp_path / "r"), result, datetime(2026, 1, 2, 3, 4, 5)).endswith("report-2026-01-02-03-04-05.txt")


def test_arrivals(spark, tmp_path):
    from pyspark.sql import functions as F

    from fathomline.sources.table import from_table
    from fathomline.streaming.arrivals import check_arrivals

    spark.createDataFrame([("a", "x\ny"), ("b", "z")], "p string, t string").write.parquet(str(tmp_path / "in"))
    config = cfg.normalize({"rules": {"max-file-lines": {"max": 1}}})
    q = check_arrivals(spark, str(tmp_path / "in"), "p string, t string", lambda d: from_table(d, F.col("p"), F.col("t"), F.lit(".txt")), config, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r.file_path for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]


def test_imports_call_brings_everything_in_line(spark, tmp_path):
    root = make(tmp_path, **{"src/a/x.ts": "import { y } from '../b/y';\ny();\n", "src/b/y.ts": "export const y = 1;\n", "tsconfig.json": '{"include": ["lib/**/*.ts"], "compilerOptions": {"baseUrl": "."}}', "package.json": '{"imports": {"keep": "k"}}'})
    before = engine.imports(spark, root)
    assert {v["message"] for v in before.violations} == {"relative import ../b/y should be rewritten to #src-b-y", "tsconfig.json does not match the aliases", "package.json does not match the aliases", "include does not cover src"}
    engine.imports(spark, root, fix=True)
    assert engine.imports(spark, root).ok
    assert json.loads((tmp_path / "package.json").read_text())["imports"] == {"keep": "k", "#src-a-x": "./src/a/x.ts", "#src-b-y": "./src/b/y.ts"}
    other = make(tmp_path / "o", **{"a.ts": "x\n"})
    engine.imports(spark, other, fix=True, output="folder")
    assert manifests.read_alias_folder(os.path.join(other, ".fathomline", "imports")) == {"#a": "a.ts"}


def test_paths_are_put_back(tmp_path):
    p = tmp_path / "tsconfig.json"
    p.write_text('{"compilerOptions": {"paths": {"#a": ["src/a.ts"]}}} // c')
    with engine.tsconfig_paths(str(tmp_path)):
        assert json.loads(p.read_text())["compilerOptions"]["paths"] == {"#a": ["./src/a.ts"]}
    assert p.read_text().endswith("// c")


def test_format_targets(spark, tmp_path):
    root = make(tmp_path, **{"src/a.ts": "", "src/gen/b.ts": "", "src/c.min.js": "", "lib/d.ts": "", "src/lock.ts": ""})
    files, _ = tree.read_tree(spark, root)
    got = engine.format_targets(files, ["./src"], {"names": ["lock.ts"], "name_globs": ["*.min.*"], "prefixes": ["src/gen/"]})
    assert [f.path for f in got.collect()] == ["src/a.ts"]


def test_folded_strings_are_searched(spark):
    from fathomline.lex.fold import folded_strings
    from fathomline.operators import rules
    from fathomline.schema import FILES

    text = "const a = 'for' + 'bid';\nconst b = `${a}den`;\nconst c = ['x', a].join('-');\nfunction f(d) { const z = d + 'q'; }\nconst e = b + unknown();\n"
    assert folded_strings(text, ".ts") == ["forbid", "forbidden", "x-forbid"]
    f = spark.createDataFrame([("a", "a.ts", "a.ts", ".ts", 1, text)], FILES)
    assert rules.banned_patterns(f, [{"value": "forbidden"}]).count() == 0
    d = json.loads(rules.banned_patterns(f, [{"value": "forbidden"}], fold=True).first().details)
    assert d["foldedOccurrences"] == 1 and d["foldedMatches"] == ["forbidden"]


def test_duration_and_bytes_read_well():
    assert [engine.format_duration(x) for x in (0, 5.26, 99.94, 100, 150.5, 999.4, 1000, 9990, 12345)] == ["0.0ms", "5.3ms", "99.9ms", "100ms", "151ms", "999ms", "1.00s", "9.99s", "12.3s"]
    assert [engine.format_bytes(x) for x in (0, 1023, 1024, 1536, 1 << 20, 5 << 19)] == ["0B", "1023B", "1.0KiB", "1.5KiB", "1.0MiB", "2.5MiB"]


def test_events_pass_by_level(spark, tmp_path, capsys):
    root = make(tmp_path, **{"a.ts": "// one\nx();\n"})
    seen = []
    log = engine.EventLog(lambda level, message, facts: seen.append((level, message.split()[0])), "info")
    engine.Runner(spark, root, {"rules": {"remove-comments": {}}}, on_event=log).check()
    assert seen == [("warn", "rule"), ("info", "checked"), ("error", "blocked")]
    assert log.counts == {"debug": 1, "info": 1, "warn": 1, "error": 1}
    loud = engine.EventLog("console", "debug")
    loud("scan", {"root": "r"})
    assert capsys.readouterr().err == "[debug] scan root=r\n"


def test_relative_imports_allowed_by_a_function(spark, tmp_path):
    root = make(tmp_path, **{"src/a.ts": "import { b } from './b';\nimport { c } from '../lib/c';\nb(c);\n", "src/b.ts": "export const b = 1;\n", "lib/c.ts": "export const c = 1;\n"})
    folder = lambda p: p.rpartition("/")[0]
    within = lambda specifier, context: folder(context["source_file"]) == folder(context["resolved_file"])
    result = engine.imports(spark, root, strategy="relative-path-slug", allow_relative=within)
    assert [v["message"] for v in result.violations if v["message"].startswith("relative")] == ["relative import ../lib/c should be rewritten to #lib-c"]


def test_candidates_are_worked_out_in_the_engine(spark):
    from fathomline.lex.imports import resolution_candidates
    from fathomline.operators.imports import candidates

    cases = [("src/a/m.ts", "../b.js"), ("m.ts", "./x"), ("m.ts", "../x"), ("a/m.ts", ".././../x"), ("a/b/m.scss", "./x"), ("a/m.scss", "../y/z"), ("a/m.tsx", "./"), ("a/m.ts", "../"), ("a/m.ts", "./q.JSX"), ("m.scss", "./")]
    rows = [(p, "." + p.rsplit(".", 1)[1], i, s, 0, 0, None, None) for i, (p, s) in enumerate(cases)]
    found = spark.createDataFrame(rows, "path string, ext string, ordinal int, specifier string, start int, end int, removal_start int, removal_end int")
    got = {}
    for r in sorted(candidates(found, [".ts", ".tsx"]).collect(), key=lambda r: r["rank"] or 0):
        got.setdefault(r["ordinal"], []).extend([r["candidate"]] if r["candidate"] is not None else [])
    assert got == {i: resolution_candidates(p.rpartition("/")[0], s, e, [".ts", ".tsx"]) for i, (p, e, *_) in enumerate(rows) for s in [rows[i][3]]}


def test_the_plan_of_check_gives_its_rows(spark, tmp_path):
    runner = engine.Runner(spark, make(tmp_path, **SOURCES), {"rules": RULES})
    plan, result = runner.violations(["remove-comments", "banned-files"]), runner.check(["remove-comments", "banned-files"])
    assert sorted((r["rule"], r["file_path"], r["message"]) for r in plan.collect()) == sorted((v["rule"], v["file_path"], v["message"]) for v in result.violations)


def test_every_import_of_a_statement_line_is_rewritten(spark, tmp_path):
    root = make(tmp_path, **{"src/a.ts": "import { b } from './b'; import {\n  c,\n} from '../lib/c';\nconst d = import('./b');\nd(b, c);\n", "src/b.ts": "export const b = 1;\n", "lib/c.ts": "export const c = 1;\n"})
    engine.imports(spark, root, fix=True, strategy="relative-path-slug", allow_relative=[])
    assert (tmp_path / "src/a.ts").read_text() == "import { b } from '#src-b'; import {\n  c,\n} from '#lib-c';\nconst d = import('#src-b');\nd(b, c);\n"
