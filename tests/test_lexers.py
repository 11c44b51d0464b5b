import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.lex import comments, declarations, dry, formatter, functions, imports, units
from fathomline.lex.languages import DEFAULT_EXTENSIONS


@pytest.mark.parametrize("ext,text,want", [
    (".ts", 'const u = "http://x"; // go\n/* a\nb */\nlet r = /[/*]"/g; let t = `// ${x}`;\n', 'const u = "http://x";\nlet r = /[/*]"/g; let t = `// ${x}`;\n'),
    (".ts", "const a = b / c; // half\nreturn /re\\/x/ /* in */;\n", "const a = b / c;\nreturn /re\\/x/  ;\n"),
    (".go", "s := `// raw`\n// gone\nx := '\"' // y\n", "s := `// raw`\nx := '\"'\n"),
    (".css", "a { color: red; /* x */ }\n// line\n", "a { color: red;   }\n"),
    (".rs", "let a = r#\"// no\"#; /* o /* i */ o */\nlet c = '\\''; // q\nfn f<'a>() {} // z\n", "let a = r#\"// no\"#;  \nlet c = '\\'';\nfn f<'a>() {}\n"),
    (".cpp", 'auto s = R"x(// no )" still)x"; // yes\n', 'auto s = R"x(// no )" still)x";\n'),
    (".cs", 'var p = @"c:\\// ""q"" "; // z\nvar q = $@"//"; /* y */\n', 'var p = @"c:\\// ""q"" ";\nvar q = $@"//";  \n'),
    (".py", '#!/usr/bin/env python\n# coding: utf-8\ns = """# no"""  # yes\nr = f"#{x}"\n    # whole\n', '#!/usr/bin/env python\n# coding: utf-8\ns = """# no"""\nr = f"#{x}"\n'),
    (".sh", "#!/bin/sh\necho \"# a\" '# b' # c\ncat <<-'END'\n\t# kept\n\tEND\necho $# a#b\n# gone\n", "#!/bin/sh\necho \"# a\" '# b'\ncat <<-'END'\n\t# kept\n\tEND\necho $# a#b\n"),
    (".qml", "Item { // a\n  x: /\\/\\//.test(s) /* b\n */ }\n", "Item {\n  x: /\\/\\//.test(s) \n }\n"),
])
def test_comments_go_and_look_alikes_stay(ext, text, want):
    got, _, _ = comments.strip_comments(text, ext)
    assert got == want
    assert comments.strip_comments(got, ext)[0] == got


def test_kept_comments():
    assert comments.strip_comments("// keep: me\n// not me\n", ".ts", ("keep:",)) == ("// keep: me\n", 1, 0)


@given(st.text(alphabet="ab\"'`/*#\\\n {}()<>r@$R;=", max_size=120), st.sampled_from(DEFAULT_EXTENSIONS))
@settings(max_examples=300, deadline=None)
def test_masks_keep_lengths_and_line_breaks(text, ext):
    for masked in (comments.mask_comments(text, ext), comments.mask_literals(text, ext), comments.mask_code(text)):
        assert len(masked) == len(text) and [i for i, c in enumerate(masked) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
    assert len(comments.literal_lines(text, ext)) == text.count("\n") + 1


@given(st.text(alphabet="ab\"'`/#\n {}();=,", max_size=80), st.sampled_from(DEFAULT_EXTENSIONS))
@settings(max_examples=200, deadline=None)
def test_lexers_take_any_text(text, ext):
    functions.function_spans(text, ext)
    declarations.declarations(text, ext)
    imports.module_specifiers(text, ext)
    units.structural_units(text, ext)
    dry.descriptors(text, ext)


@pytest.mark.parametrize("ext,text,want", [
    (".ts", "const go = async (a) => {\n  x();\n};\nfunction run() {\n}\n", [("go", 1, 3, 3), ("run", 4, 5, 2)]),
    (".go", "func (s *T) Name(a int) {\n\t// note\n\treturn\n}\n", [("Name", 1, 4, 3)]),
    (".rs", "trait T {\n  fn later(&self);\n}\npub async fn now(\n  a: i32,\n) -> X\nwhere A: B {\n  1\n}\n", [("now", 4, 9, 6)]),
    (".cpp", "int f(int a);\nint A::f(int a) {\n  if (a) {\n  }\n}\n", [("f", 2, 5, 4)]),
    (".cs", "class C {\n  public int Run(int a)\n  {\n    return a;\n  }\n}\n", [("Run", 2, 5, 4)]),
    (".py", 'def a():\n    """\ndef fake():\n    """\n    return 1\n\n\nx = 1\n', [("a", 1, 7, 5)]),
    (".sh", "run() {\n  echo '}'\n}\nfunction go {\n  :\n}\n", [("run", 1, 3, 3), ("go", 4, 6, 3)]),
    (".qml", "Item {\n  onClicked: {\n    a()\n  }\n  function f(x) {\n    b()\n  }\n}\n", [("onClicked", 2, 4, 3), ("f", 5, 7, 3)]),
    (".css", "a { b: c }\n", []),
])
def test_function_spans(ext, text, want):
    assert [(s["name"], s["start_line"], s["end_line"], s["code_line_count"]) for s in functions.function_spans(text, ext)] == want


@pytest.mark.parametrize("ext,text,want", [
    (".ts", "export const a = 1\nfunction bb() {}\n  const inner = 2\n  function deep() {}\n", ["a", "bb", "inner", "deep"]), (".go", "type T struct{}\nvar v = 1\nconst c = 2\nfunc f() {}\nfunc (t T) m() {}\n", ["T", "v", "c", "f", "m"]),
    (".go", "const (\n\tA = 1\n\n\tB\n)\nvar (\n\tx, y int\n)\ntype (\n\tT struct{}\n)\nfunc f() {}\nconst (C = 3)\nvar z int\n", ["A", "B", "x", "T", "f", "z"]), (".py", "async def a():\n    def b(): pass\n    c = 1\nif c == 2: pass\n", ["a", "b", "c"]),
    (".rs", "pub struct S;\nenum E {}\nmod m {}\nstatic X: i32 = 1;\n", ["S", "E", "m", "X"]), (".py", "x = 1\nclass C:\n    def m(self): pass\nx == 2\n", ["x", "C", "m"]),
    (".sh", "a=1\nf() {\n}\n", ["a", "f"]), (".scss", "$v: 1;\n@mixin mm {}\n%p {}\n.c { --d: 1 }\n", ["v", "mm", "p", "c", "d"]), (".qml", "id: me\nproperty int n: 1\nsignal done\n", ["me", "n", "done"]),
    (".cpp", "namespace n {\nclass C {};\nusing U = int;\n}\n", ["n", "C", "U"]), (".cs", "interface I {}\npublic sealed class K {}\n", ["I", "K"]),
])
def test_declarations(ext, text, want):
    names = [re.sub(r"^(--|[$%])", "", d["name"]) for d in declarations.declarations(text, ext)]
    assert sorted(names) == sorted(want)
    assert declarations.name_length("--ab") == 2 and declarations.name_length("$a") == 1


def test_specifiers_and_names():
    text = "import a, { b as c } from './x';\nimport './side';\nexport * from \"../y\";\nconst m = import('./z');\nimport type { T } from 'pkg'\nconst s = \"import './no'\";\n"
    found = imports.module_specifiers(text, ".ts")
    assert [f["specifier"] for f in found] == ["./x", "./side", "../y", "./z", "pkg"]
    assert all(text[f["start"] : f["end"]] == f["specifier"] for f in found)
    assert [text[f["removal_start"] : f["removal_end"]] for f in found if f["removal_start"] is not None] == ["import './side';\n"]
    assert imports.imported_names(text) == ["a", "c", "T"]
    assert [f["specifier"] for f in imports.module_specifiers("@use 'a';\n@import 'b', \"c\";\n", ".scss")] == ["a", "b", "c"]


def test_resolution_order():
    assert imports.resolution_candidates("src/a", "../b.js", ".ts", [".ts", ".tsx"]) == ["src/b.js", "src/b.ts", "src/b.tsx", "src/b.js.ts", "src/b.js.tsx", "src/b.js/index.ts", "src/b.js/index.tsx"]
    assert imports.resolution_candidates("src", "./x", ".scss", []) == ["src/x.scss", "src/_x.scss", "src/x/index.scss", "src/x/_index.scss"]
    assert imports.resolution_candidates("", "../../x", ".ts", [".ts"]) == []


@pytest.mark.parametrize("ext,a,b", [
    (".ts", "function one(a, b) {\n  const c = a + 1; // x\n  return call(c, b.name);\n}", "function two(x, y) {\n  const z = x + 1;\n  return call(z, y.name);\n}"),
    (".go", "func one(a int) int {\n\treturn a * 2\n}", "func two(b int) int { return b * 2 }"), (".py", "def one(a):\n    return a + [1, 'x']", "def two(b):\n    return b + [1, 'x']  # note"),
    (".rs", "fn one(a: i32) -> i32 { a + LIMIT }", "fn two(b: i32) -> i32 {\n  b + LIMIT\n}"), (".cs", "int One(int a) { return a; }", "int Two(int b) { return b; }"), (".sh", "one() { echo $v; }", "two() {\n  echo $v;\n}"),
])
def test_renamed_copies_have_one_normal_form(ext, a, b):
    assert dry.normal_form(a, ext) == dry.normal_form(b, ext)
    assert dry.normal_form(a, ext) != dry.normal_form(a.replace("1", "3").replace("2", "3").replace("LIMIT", "OTHER").replace("$v", "3").replace("return a;", "return 3;"), ext)


CASES = [
    (".rs", "trait T {\n    fn a(&self);\n\n    fn b(&self) {}\n}\n", False), (".rs", 'extern "C" {\n}\nfn a() {\n}\nfn b() {\n}\n', True), (".rs", "fn f<'a>() {\n}\n\n\n\nfn g() {\n}\n", True), (".rs", "pub struct S {\n}\nimpl<T> S {\n}\n", True),
    (".rs", "#[derive(A)]\nstruct U;\n\n#[x]\nstruct V(i32);\n", False), (".ts", "const a = () => 1;\nconst b = () => 2;\n", False), (".ts", "class C {\n  a() {\n  }\n  b() {\n  }\n}\n", True), (".ts", "function f(a: number): void;\nfunction f(a: string): void;\nfunction f(a: any) {\n}\n", False),
    (".sh", "a() {\n  cat <<E\nb() {\n}\nE\n}\n", False), (".py", "def a():\n    pass\ndef b():\n    pass\n", True), (".cpp", "int a() {\n}\nint b() {\n}\n", True), (".cs", "class A {\n}\nclass B {\n}\n", True), (".css", "a {\n}\nb {\n}\n", True), (".go", "func a() {\n}\nfunc b() {\n}\n", True), (".qml", "Item {\n  function a() {\n  }\n  function b() {\n  }\n}\n", True),
]


@pytest.mark.parametrize("ext,text,flagged", CASES)
def test_blank_lines_are_flagged_exactly_where_a_fix_changes(ext, text, flagged):
    edits = units.boundary_edits(text, ext)
    fixed = units.apply_edits(text, edits)
    assert bool(edits) == flagged == (fixed != text)
    assert units.boundary_edits(fixed, ext) == []


@pytest.mark.parametrize("ext,text", [
    (".ts", "import a from 'x'\nfunction f(a,b){\nif(a===b){\nreturn {a:1}\n}\n}\nconst long = call(first_argument, second_argument, third)\n"), (".qml", "Item { width: 3; height: 4 }\n"), (".css", "a{\ncolor:red;\n}\n"), (".rs", 'fn main(){\nlet s = r#"\n   keep\n"#;\n}\n'),
    (".go", "func a(){\nx := `\n  raw\n`\n}\n"), (".cpp", 'int main(){\nprintf("one two three four five seven eight nine");\n}\n'), (".cs", 'class A {\nstring s = "one two three four five six seven eight nine";\n}\n'), (".py", "def f():\n    return 'x'   \n\n\n\nx = \"one two three four five six seven eight nine ten\"\n"), (".sh", "if a; then\n  b   \nfi\n"),
])
def test_formatting_settles_and_keeps_literals(ext, text):
    once = formatter.format_text(text, ext, 44)
    assert formatter.format_text(once, ext, 44) == once and once.endswith("\n") and not re.search(r"[ \t]+$", re.sub(r"`[^`]*`|r#\".*?\"#", "s", once, flags=re.S), re.M)
    assert formatter._literals(once, ext) == formatter._literals(text, ext)
    for literal in ("\n   keep\n", "\n  raw\n"):
        assert (literal in once) == (literal in text)


def test_golden_forms():
    assert formatter.format_text("function f(a,b){\nif(a){\nreturn b\n}\n}\n", ".ts") == "function f(a, b) {\n  if (a) {\n    return b;\n  }\n}\n"
    assert formatter.format_text("x = 'a'\n", ".py") == "x = 'a'\n"
    assert formatter.format_text("a\r\n\r\n\r\nb  ", ".txt") == "a\n\nb\n"
    assert formatter.format_text("", ".ts") == ""


def test_long_strings_split_where_it_is_safe():
    long = "one two three four five seven eight nine ten eleven twelve"
    safe = f'const a = {{\n  key: "{long}",\n}};\nfunction f() {{\n  return "{long}";\n}}\n'
    got = formatter.split_long_strings(safe, ".ts", 44)
    assert max(map(len, got.split("\n"))) <= 44 and formatter._literals(got, ".ts") == formatter._literals(safe, ".ts")
    for odd in (f'import "{long}";\n', f'call("{long}"); // why\n', 'x = "https://a.example/very/long/path/that/has/no/blank/in/it";\n', f'"{long}";\n', f'x = "{long}\\n";\n'):
        assert formatter.split_long_strings(odd, ".ts", 44) == odd
    assert formatter.generated_source("a/generated/b.ts") and formatter.generated_source("a.min.js") and not formatter.generated_source("a/b.ts")


@pytest.mark.parametrize("ext,text,want", [
    (".tsx", 'const a = (\n  <Field name="first" onChange={(e) => set(e.target.value)} label="A label" />\n);\n',
     'const a = (\n  <Field\n    name="first"\n    onChange={(e) => set(e.target.value)}\n    label="A label" />\n);\n'),
    (".jsx", '<a href="x" title="one two three four five">text</a>\n', '<a\n  href="x"\n  title="one two three four five">text</a>\n'),
    (".ts", "const total = firstNumber + secondNumber(a + b) + thirdNumber;\n", "const total = firstNumber +\n  secondNumber(a + b) +\n  thirdNumber;\n"),
    (".cpp", "int t = first_number + second_number + \"+ +\" + third;\n", "int t = first_number +\n  second_number +\n  \"+ +\" +\n  third;\n"),
    (".ts", "counter_of_many += another_number + third_number_here;\n", "counter_of_many += another_number + third_number_here;\n"),
])
def test_long_tags_and_sums_are_wrapped(ext, text, want):
    assert formatter.format_text(text, ext, 44) == want
    assert formatter.format_text(want, ext, 44) == want


STATEMENTS = """import a from './a'; import b, { c } from "./b"; // import x from './no'
import {
  d, // note
  e as f,
} from '../d';
import './side'
import type { T } from './t'; import './two'
export * as g from './g'; export { h } from './h';
const m = await import('./dyn'), n = import(`./tpl`), o: import("./type").O = x;
const s = "import z from './str'"; myimport('./nope'); x.import('./nope2'); import(`./${v}`);
import{i}from'./i';
export const from = './not';
import.meta.url; import("./last")
"""


def test_specifiers_of_statements():
    found = imports.statement_specifiers(STATEMENTS, ".ts")
    assert [f["specifier"] for f in found] == ["./a", "./b", "../d", "./side", "./t", "./two", "./g", "./h", "./dyn", "./tpl", "./type", "./i", "./last"]
    assert all(STATEMENTS[f["start"] : f["end"]] == f["specifier"] for f in found)
    assert [STATEMENTS[f["removal_start"] : f["removal_end"]] for f in found if f["removal_start"] is not None] == ["import './side'\n"]
    assert imports.statement_specifiers("@use 'a';", ".scss") == imports.module_specifiers("@use 'a';", ".scss")
    assert imports.statement_specifiers("", ".ts") == [] and imports.statement_specifiers("import", ".ts") == []
