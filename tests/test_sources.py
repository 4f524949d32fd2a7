import random
import subprocess

import pytest
from pyspark.sql import functions as F

from loomgraph import tools
from loomgraph.sources import files as S
from loomgraph.sources import gitlog, symbols

LOG = "\x1eabc123|John Doe|john@example.com|1640995200|Initial | commit\nREADME.md\nmain.go\n\n\x1edef456|Jane Smith|jane@example.com|1640995300|Add tests\nM\tmain.go\nA\tmain_test.go\nR100\told name.go\tnew name.go\n"


def test_log(spark, tmp_path):
    (tmp_path / "log").write_text(LOG)
    found = gitlog.parse_log(gitlog.read_log(spark, str(tmp_path / "log"))).orderBy("hash").collect()
    assert [(r.hash, r.author, r.message) for r in found] == [("abc123", "John Doe", "Initial | commit"), ("def456", "Jane Smith", "Add tests")]
    assert [(f.change, f.path) for f in found[1].files] == [("M", "main.go"), ("A", "main_test.go"), ("R", "new name.go")]
    assert gitlog.file_changes(gitlog.parse_log(gitlog.read_log(spark, str(tmp_path / "log")))).count() == 5


@pytest.mark.parametrize(
    "path, content, name",
    [
        ("a.tsx", "import x from 'y'\nimport React from 'react'", "React"),
        ("a.vue", "", "Vue"),
        ("app/x.component.ts", "", "Angular"),
        ("a.ts", "import { a } from '@angular/core'", "Angular"),
        ("a.js", "import next from 'next/router'", "Next.js"),
        ("a.ts", "import { onMount } from 'svelte'", "Svelte"),
        ("m.py", "from django.db import models", "Django"),
        ("m.py", "import flask", "Flask"),
        ("A.java", "@RestController\nclass A {}", "Spring Boot"),
        ("pkg/src/a.ts", "const a = 1", "Vue"),
        ("other/a.ts", "const a = 1", None),
    ],
)
def test_frameworks(spark, path, content, name):
    files = spark.createDataFrame([(path, content)], "path string, content string")
    manifests = spark.createDataFrame([("pkg", {"vue": "3", "svelte": "4"})], "dir string, dependencies map<string,string>")
    assert S.frameworks(files, manifests).first().framework == name


@pytest.mark.parametrize(
    "path, content, expected",
    [
        ("a.ts", "export class Foo {\n  bar(x: number): void {\n}\nexport interface Baz { id: number }\ntype T = string\nexport const f = (a: number) => a\nfunction g() {}\nlet v = 1", {("Foo", "class"), ("bar", "method"), ("Baz", "interface"), ("T", "type"), ("f", "function"), ("g", "function"), ("v", "variable")}),
        ("a.py", "class A:\n    def m(self):\n        pass\nx = 1", {("A", "class"), ("m", "function"), ("x", "variable")}),
        ("A.java", "public class A {\n    private int n;\n    public int get(int a) {\n", {("A", "class"), ("n", "variable"), ("get", "method")}),
        ("a.go", "func (s *S) Run() {}\nfunc Main() {}\ntype S struct {}\nvar x = 1", {("Run", "method"), ("Main", "function"), ("S", "type"), ("x", "variable")}),
        ("a.rs", "pub fn run() {}\nstruct S;\nimpl S {}\nenum E {}\npub trait T {}", {("run", "function"), ("S", "class"), ("E", "type"), ("T", "interface")}),
        ("a.json", "{}", set()),
    ],
)
def test_symbols(spark, path, content, expected):
    found = symbols.extract_symbols(spark.createDataFrame([(path, content)], "path string, content string"))
    assert {(r.name, r.type) for r in found.collect()} == expected


def test_imports(spark):
    text = "import { UserType, Other as O } from './types';\nimport React, { x } from 'react'\nimport './side'\n"
    found = symbols.extract_imports(spark.createDataFrame([("a.ts", text)], "path string, content string")).orderBy("line_no").collect()
    assert [(r.import_path, r.specifiers, r.is_default) for r in found] == [("./types", ["UserType", "Other"], False), ("react", ["x"], True), ("./side", [], False)]


def test_tools_over_a_tree(spark, tmp_path):
    src = tmp_path / "proj" / "src"
    src.mkdir(parents=True)
    (src / "user.ts").write_text("import { T } from './types'\nexport class User {}\n")
    (src / "types.ts").write_text("export interface T { id: number }\n")
    (tmp_path / "proj" / "node_modules").mkdir()
    (tmp_path / "proj" / "node_modules" / "x.ts").write_text("class X {}")
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "proj"), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "src")
    git("commit", "-qm", "one")
    gitlog.write_log(str(tmp_path / "proj"), str(tmp_path / "log"))
    a = tools.analyse(spark, str(tmp_path / "proj"), str(tmp_path / "log"))
    assert {r.path for r in a.files.collect()} == {"src/user.ts", "src/types.ts"}
    assert [(r.direction, r.other) for r in tools.dependencies(a, "src/user.ts", "imports").collect()] == [("imports", "src/types.ts")]
    assert tools.search_symbols(a, "USER").first().name == "User"
    assert tools.symbol_info(a, "T").first().type == "interface"
    assert tools.semantic_neighborhoods(a).count() == 1
    text = tools.report(a)
    assert "- Files: 2" in text and "| src/types.ts | 1 |" in text and "| User | class | src/user.ts | 2-2 |" in text
    assert [x for x in text.split("\n") if x.startswith("## ")] == ["## " + x for x in ("Files", "Symbols", "Declarations", "Languages", "Imports", "Relationships", "Hotspots", "Cycles", "Neighborhoods", "Structure")]
    assert tools.file_analysis(a, "src/user.ts")["symbols"].count() == 1


def test_file_context_by_part_of_a_path(spark):
    hoods = spark.createDataFrame([("one", ["src/user.ts", "src/a.ts"]), ("two", ["lib/b.ts"]), ("three", ["user.ts"])], "id string, members array<string>")
    clusters = spark.createDataFrame([("one", "c1"), ("two", "c2"), ("three", "c1")], "id string, cluster string")
    found = {(r.kind, r.name) for r in tools.file_context(hoods, "src/user.ts", clusters).collect()}
    assert found == {("neighborhood", "one"), ("neighborhood", "three"), ("cluster", "c1")}
    assert {r.name for r in tools.file_context(hoods, "user").collect()} == {"one", "three"}


CODE = """/* class Old {
 */
import {
  A,
  B as C,
} from './types'
// import x from 'nowhere'
export class Box<T>
  extends Base {
  name = "class Hidden {"
  open(a: number,
    b: string): Map<string, T> { if (a) { return "}" } }
}
const go = async (
  a: number
) => {
  a
}; function last() { return `
}` }"""


def test_declarations_over_several_lines(spark):
    files = spark.createDataFrame([("a.ts", CODE)], "path string, content string")
    found = {r.name: (r.type, r.start_line, r.start_column, r.end_line, r.end_column, r.signature) for r in symbols.extract_symbols(files).collect()}
    assert found == {
        "Box": ("class", 8, 1, 13, 2, "export class Box<T> extends Base"),
        "open": ("method", 11, 3, 12, 57, "open(a: number, b: string): Map<string, T>"),
        "go": ("function", 14, 1, 18, 2, "const go = async ( a: number ) =>"),
    }
    imports = symbols.extract_imports(files).collect()
    assert [(r.line_no, r.import_path, r.specifiers, r.name) for r in imports] == [(3, "./types", ["A", "B"], "A")]
    nodes = {(r.kind, r.name, r.start_line, r.end_line, (r.parent or "").split("-")[0]) for r in symbols.nodes(files).collect()}
    assert ("comment", None, 1, 2, "") in nodes and ("string", None, 10, 10, "class") in nodes and ("method", "open", 11, 12, "class") in nodes


def test_python_blocks_end_by_indent(spark):
    text = "class A:\n    def f(self,\n          x):\n        return {\n            1: 2}\n\n    # note\n    y = 1\n\ndef g(): pass\nz = 1\n"
    found = {r.name: (r.type, r.start_line, r.end_line) for r in symbols.extract_symbols(spark.createDataFrame([("a.py", text)], "path string, content string")).collect()}
    assert found == {"A": ("class", 1, 8), "f": ("function", 2, 5), "g": ("function", 10, 10), "z": ("variable", 11, 11)}


@pytest.mark.parametrize(
    "path, content, expected",
    [
        ("a.tsx", "import React from 'react'\nfunction useThing() { return 1 }\nfunction Card() {\n  return <div/>\n}\nconst x = 1", {("useThing", "hook"), ("Card", "component")}),
        ("a.service.ts", "import { Injectable } from '@angular/core'\n@Injectable()\nexport class Api {}", {("Api", "service")}),
        ("s.ts", "import { writable } from 'svelte/store'\nexport const count = writable(0)", {("count", "store")}),
        ("src/pages/api/x.ts", "import next from 'next/server'\nexport function handler(req, res) {}", {("handler", "route")}),
        ("App.svelte", "<h1>x</h1>", {("App", "component")}),
        ("v.ts", "import { computed } from 'vue'\nconst total = computed(() => 1)", {("total", "computed")}),
        ("plain.ts", "function f() {}", set()),
    ],
)
def test_framework_symbols(spark, path, content, expected):
    files = spark.createDataFrame([(path, content)], "path string, content string")
    found = symbols.framework_symbols(files, S.frameworks(files))
    assert {(r.name, r.type) for r in found.collect()} == expected


def test_ignore_file():
    assert S.ignore_patterns(["# note", "", " dist/ ", "*.log"]) == ["dist/", "*.log"] and "vendor/" in S.ignore_patterns(None)


def found_in(spark, path, content):
    rows = symbols.extract_symbols(spark.createDataFrame([(path, content)], "path string, content string")).collect()
    return {(r.type, r.name, r.start_line, r.start_column, r.end_line, r.end_column) for r in rows}


def test_deep_brackets_on_one_line(spark):
    text = "class A { b() { if (x) { for (;;) { while (y) { z() } } } } } function late() {}\n  run(a = f(g(h(1), (2)))): void { return }\n  call(() => {\n    1 })\nconst o = { a: { b: { c: { d: { } } } } }\nfunction f({ a, b = { c: 1 } }, d) {\n  return { a: { } } }\n"
    assert found_in(spark, "a.ts", text) == {("class", "A", 1, 1, 1, 62), ("method", "run", 2, 3, 2, 44), ("variable", "o", 5, 1, 5, 42), ("function", "f", 6, 1, 7, 22)}


def test_heads_of_many_lines(spark):
    arguments = ",\n".join(f"  a{k}: Map<string, number>" for k in range(100))
    text = f"function wide(\n{arguments}\n): void\n{{\n  go()\n}}\nclass C\n  extends B\n  implements D,\n{{\n}}\nconst wrapped = memo(function () {{\n  return 1\n}})\n"
    assert found_in(spark, "a.ts", text) == {("function", "wide", 1, 1, 105, 2), ("class", "C", 106, 1, 110, 2), ("variable", "wrapped", 111, 1, 113, 2)}
    names = ",\n".join(f"  N{k}" for k in range(100))
    imports = symbols.extract_imports(spark.createDataFrame([("a.ts", f"import {{\n{names}\n}} from './far'\nimport x from 'y'")], "path string, content string")).collect()
    assert sorted((r.line_no, r.import_path, len(r.specifiers)) for r in imports) == [(1, "./far", 100), (103, "y", 0)]
    python = "def f(a, b={\n    'x': [\n" + "        1,\n" * 90 + "    ]}):\n    return a\n\nclass G(B):\n  def g(self): return {\n    1: 2}\n# end\n"
    assert found_in(spark, "a.py", python) == {("function", "f", 1, 1, 94, 13), ("class", "G", 96, 1, 98, 10), ("function", "g", 97, 3, 98, 10)}


def test_a_file_of_many_lines(spark):
    text = "".join(f"function f{k}(a: number) {{\n  if (a) {{\n    return {k}\n  }}\n}}\n" for k in range(10_000)) + "class Open {\n  m() {\n"
    found = found_in(spark, "big.ts", text)
    assert found == {("function", f"f{k}", 5 * k + 1, 1, 5 * k + 5, 2) for k in range(10_000)} | {("class", "Open", 50_001, 1, 50_003, 1), ("method", "m", 50_002, 3, 50_003, 1)}


def test_next_line_at_most(spark):
    rng = random.Random(4)
    depth = {(f, n): rng.randrange(-2, 6) for f in "ab" for n in range(1, 60)}
    lines = spark.createDataFrame([(f, n, d) for (f, n), d in depth.items()], "path string, line_no int, d int")
    starts = [(f, n, rng.randrange(-3, 6)) for f, n in depth if rng.random() < 0.5]
    found = {(r.path, r.line_no, r.most): r.next for r in symbols.next_at_most(spark.createDataFrame(starts, "path string, line_no int, most int"), lines, F.col("d")).collect()}
    want = {(f, n, m): next((k for k in range(n + 1, 60) if depth[f, k] <= m), None) for f, n, m in starts}
    assert found == {k: v for k, v in want.items() if v is not None}


def test_files_are_dealt_by_path_before_the_scan(spark):
    files = spark.createDataFrame([(f"src/{k}.ts", "class A {\n}") for k in range(40)], "path string, content string").coalesce(1)
    plan = symbols.lines_of(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan.split("posexplode", 1)[1]  # small files in few partitions were scanned by as few tasks
    assert plan.count("regexp_extract_all") == 3  # once for each way of scanning
