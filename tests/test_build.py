"""Files in, graph out: extraction, import and call resolution, update, stream."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from symloom.plans import build
from symloom.sources import discovery, extract, imports
from symloom.streaming import incremental

REPO = {
    "src/base.ts": "export class Base {\n  save() { return 1; }\n}\n",
    "src/repo.ts": "import { Base } from './base';\nexport class UserRepo extends Base {\n  get(id: string): User { return load(id); }\n}\nexport interface User { id: string }\nfunction load(id) { return null; }\n",
    "src/index.ts": "export { UserRepo } from './repo';\n",
    "src/service.ts": "import { UserRepo } from './index';\nexport class Service {\n  constructor(private readonly repo: UserRepo) {}\n  find(id: string) { return this.repo.get(id); }\n  keep() { return this.find('1'); }\n}\n",
    "src/service.test.ts": "import { Service } from './service';\ntest('finds', () => {\n  const s = new Service(null);\n  s.find('1');\n});\n",
}


def table(spark, files):
    rows = [(p, "typescript" if p.endswith(".ts") else "python", c, hashlib.sha256(c.encode()).hexdigest()) for p, c in files.items()]
    return spark.createDataFrame(rows, "file_path string, language string, content string, file_hash string")


def edges(graph):
    return {(r.kind, r.source_qualified, r.target_qualified, r.tier) for r in graph.edges.collect()}


def test_graph_of_a_small_repository(spark):
    got = edges(build.graph_of_files(table(spark, REPO)))
    assert ("CALLS", "src/service.ts::Service.find", "src/repo.ts::UserRepo.get", "di") in got
    assert ("CALLS", "src/service.ts::Service.keep", "src/service.ts::Service.find", "same") in got
    assert ("CALLS", "src/repo.ts::UserRepo.get", "src/repo.ts::load", "same") in got
    assert ("CALLS", "src/service.test.ts::finds", "src/service.ts::Service.find", "receiver") in got
    assert ("INHERITS", "src/repo.ts::UserRepo", "src/base.ts::Base", None) in got
    assert ("IMPORTS", "src/service.ts", "src/index.ts", None) in got
    assert ("TESTED_BY", "src/service.ts::Service.find", "src/service.test.ts", None) in got
    assert ("USES_TYPE", "src/repo.ts::UserRepo.get", "src/repo.ts::User", None) in got
    assert ("CONTAINS", "src/base.ts", "src/base.ts::Base", None) in got


def test_barrel_and_direct_import_give_the_same_calls(spark):
    direct = REPO | {"src/service.ts": REPO["src/service.ts"].replace("./index", "./repo")}
    calls = [{e for e in edges(build.graph_of_files(table(spark, r))) if e[0] == "CALLS"} for r in (REPO, direct)]
    assert calls[0] == calls[1]


def test_update_agrees_with_a_full_build(spark):
    plain = {k: v.replace("./index", "./repo") for k, v in REPO.items() if k not in ("src/index.ts", "src/service.test.ts")}
    first = build.graph_of_files(table(spark, plain))
    later = {k: v for k, v in plain.items() if k != "src/base.ts"} | {"src/new.ts": "import { Service } from './service';\nexport function run(s: Service) { return s.find('2'); }\n"}
    updated, full = build.update(first, table(spark, later)), build.graph_of_files(table(spark, later))
    calls = [{e for e in edges(g) if e[0] == "CALLS"} for g in (updated, full)]
    assert calls[0] == calls[1]
    assert {r[0] for r in updated.nodes.select("file_path").collect()} == {r[0] for r in full.nodes.select("file_path").collect()}
    assert build.update(first, table(spark, plain)) is first


def test_discovery_rules(spark, tmp_path):
    for p in ("a.ts", "node_modules/x.ts", "dist/y.js", "lib/z.min.js", "lib/w.py", "notes.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    found = {r.file_path: r.language for r in discovery.discover(spark, str(tmp_path)).collect()}
    assert found == {"a.ts": "typescript", "lib/w.py": "python"}
    assert {r.file_path for r in discovery.discover(spark, str(tmp_path), exclude=["lib/**"]).collect()} == {"a.ts"}
    assert discovery.discover(spark, str(tmp_path), max_files=1, allow_partial=True).count() == 1
    try:
        discovery.inside(str(tmp_path), "../up")
    except ValueError:
        pass
    else:
        raise AssertionError("a path outside the root has to be refused")


def test_diff_hunks(spark):
    diff = "--- a/x.ts\n+++ b/x.ts\n@@ -1,2 +3,4 @@\n+a\n@@ -9 +12 @@\n--- a/y.ts\n+++ /dev/null\n@@ -1 +0,0 @@\n"
    assert [tuple(r) for r in discovery.diff_hunks_of(spark, diff).collect()] == [("x.ts", 3, 4), ("x.ts", 12, 1)]


def test_python_extraction():
    got = extract.extract_file("a.py", "python", "from .x import y\nclass A(B):\n  def __init__(self, r: Repo):\n    self.r = r\n  async def m(self):\n    if self.r:\n      self.r.get()\n    raise BadThing()\ndef test_a():\n  A(1).m()\n")
    kinds = {(s["kind"], s["owner"], s["name"]) for s in got["symbols"]}
    assert kinds == {("Class", None, "A"), ("Constructor", "A", "__init__"), ("Method", "A", "m"), ("Function", None, "test_a"), ("Test", None, "test_a")}
    m = next(s for s in got["symbols"] if s["name"] == "m")
    assert m["is_async"] and m["complexity"] == 2 and m["throws"] == ["BadThing"]
    assert [c["receiver_type"] for c in got["calls"] if c["name"] == "get"] == ["Repo"]
    assert extract.extract_file("b.py", "python", "def (")["error"].startswith("SyntaxError")


def test_every_language_has_an_extractor():
    samples = {
        "go": ("package x\ntype S struct {\n}\nfunc (s *S) Get(a int) int {\n return f(a)\n}\n", ("Method", "S", "Get")), "java": ("public class X extends Y {\n  public int get(int a) {\n    return f(a);\n  }\n}\n", ("Method", "X", "get")),
        "rust": ("pub fn f(a: i32) -> i32 { g(a) }\n", ("Function", None, "f")), "ruby": ("class A\n  def x(a)\n    foo(a)\n  end\nend\n", ("Method", "A", "x")), "kotlin": ("class A {\n  fun x(a: Int): Int {\n    return f(a)\n  }\n}\n", ("Method", "A", "x")),
        "csharp": ("public class A {\n  public int X(int a) {\n    return F(a);\n  }\n}\n", ("Method", "A", "X")), "swift": ("class A {\n  func x(a: Int) -> Int {\n    return f(a)\n  }\n}\n", ("Method", "A", "x")), "scala": ("class A {\n  def x(a: Int): Int = {\n    f(a)\n  }\n}\n", ("Method", "A", "x")),
        "dart": ("class A {\n  int x(int a) {\n    return f(a);\n  }\n}\n", ("Method", "A", "x")), "php": ("<?php\nclass A {\n  public function x($a) {\n    return f($a);\n  }\n}\n", ("Method", "A", "x")), "c": ("int x(int a) {\n  return f(a);\n}\n", ("Function", None, "x")),
        "cpp": ("int A::x(int a) {\n  return f(a);\n}\n", ("Method", "A", "x")), "elixir": ("defmodule A do\n  def x(a) do\n    f(a)\n  end\nend\n", ("Method", "A", "x")), "bash": ("x() {\n  echo 1\n}\n", ("Function", None, "x")),
    }
    for language, (source, want) in samples.items():
        got = extract.extract_file("a", language, source)
        assert got["error"] is None and want in {(s["kind"], s["owner"], s["name"]) for s in got["symbols"]}, (language, got["symbols"])


def test_import_candidates():
    assert imports.candidates("typescript", "src/a/b.ts", "../c")[:2] == ["src/c", "src/c.ts"]
    assert imports.candidates("python", "pkg/a.py", ".b") == ["pkg/b.py", "pkg/b/__init__.py"]
    assert imports.candidates("java", "x.java", "java.util.List") == []
    assert "src/App/User.php" in imports.candidates("php", "x.php", "App\\User")
    assert imports.candidates("rust", "src/m/a.rs", "crate::m::b::C")[2] == "src/m/b.rs"
    assert imports.external_package("typescript", "@x/y/z", {"dependencies": ["@x/y"]}) == "@x/y"


def test_stream_keeps_the_graph_current(spark, tmp_path):
    src = str(tmp_path / "in")
    table(spark, REPO).write.parquet(src)
    schema = "file_path string, language string, content string, file_hash string"
    for _ in range(2):
        incremental.follow(spark, spark.readStream.schema(schema).parquet(src), str(tmp_path / "g"), str(tmp_path / "c")).awaitTermination()
        table(spark, {"src/base.ts": "export class Base {\n  keep() { return 1; }\n}\n"}).write.mode("append").parquet(src)
    names = {r[0] for r in incremental.current(spark, str(tmp_path / "g")).nodes.filter(F.col("file_path") == "src/base.ts").select("name").collect()}
    assert names == {"Base", "keep"}


def test_skipped_folders_and_extensions(spark, tmp_path):
    for p in ("bin/a.ts", "obj/b.py", ".turbo/c.ts", ".mypy_cache/d.py", "e.mts", "f.pyi", "g.es6", "h.test.min.js"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    assert {r.file_path for r in discovery.discover(spark, str(tmp_path)).collect()} == {"bin/a.ts", "obj/b.py", "g.es6"}


def test_update_with_noise_names_agrees_with_parse(spark, tmp_path):
    files = {"a.ts": "export function log(x) { return x; }\nexport function other() { return 1; }\n", "b.ts": "import { other } from './a';\nexport function run(x) { log(x); x.map(other); return other(); }\n"}
    for p, text in files.items():
        (tmp_path / p).write_text(text)
    first = build.parse(spark, str(tmp_path))
    (tmp_path / "b.ts").write_text(files["b.ts"] + "export function more(x) { log(x); return other(); }\n")
    after = build.update(first, discovery.discover(spark, str(tmp_path)))
    full = build.parse(spark, str(tmp_path))
    calls = [{e for e in edges(g) if e[0] == "CALLS"} for g in (after, full)]
    assert calls[0] == calls[1] and not any(t == "a.ts::log" for _, _, t, _ in calls[0]) and len(calls[0]) == 2


def test_comments_of_configuration_files():
    text = '{\n  // paths\n  "compilerOptions": { "baseUrl": ".", /* all */ "paths": {"@/*": ["./src/*"], "u": ["http://x//y",], }, }, // behind\n  "include": ["src/**/*.ts"]\n}'
    found = imports.read_manifest({"tsconfig.json": text, "package.json": "not json"})
    assert found["aliases"]["@/*"] == ["src/*"] and imports.read_json(text)["include"] == ["src/**/*.ts"]


RECEIVERS = {
    "src/base.ts": "export class BaseStore {\n  save(x: string): string { return x; }\n}\n",
    "src/store.ts": "import { BaseStore } from './base';\nexport class UserStore extends BaseStore {\n  byName(n: string): string { return n; }\n}\nexport function makeStore(): Promise<UserStore> { return null; }\n",
    "src/query.ts": "export class Query {\n  where(c: string): Query { return this; }\n  run(): string { return ''; }\n  static getInstance() { return new Query(); }\n}\nexport function makeQuery(): Query { return new Query(); }\n",
    "src/other.ts": "export class Other {\n  run(): number { return 1; }\n  where(): number { return 2; }\n  byName() { return 3; }\n}\n",
    "src/db.ts": "import { UserStore, makeStore } from './store';\nexport const db = new UserStore();\nexport const made = makeStore();\n",
    "src/app.ts": "import { UserStore, makeStore } from './store';\nimport { Query, makeQuery } from './query';\nimport { Other } from './other';\nimport { db, made } from './db';\n"
    "export function inherited() {\n  const r = new UserStore();\n  return r.save('a');\n}\nexport function chain() {\n  return makeQuery().where('x = (1)').run();\n}\nexport function factory() {\n  const s = makeStore();\n  return s.byName('n');\n}\n"
    "export function value() { return db.byName('m'); }\nexport function valueOfCall() { return made.byName('m'); }\nexport function single() { return Query.getInstance().run(); }\n"
    "export function scopes(r: Other) { return r.run(); }\nexport function scopes2(r: Query) { return r.run(); }\n",
}


def test_receivers_by_scope_chain_value_and_factory(spark):
    got = {(s.split("::")[1], t.split("::")[1]): tier for k, s, t, tier in edges(build.graph_of_files(table(spark, RECEIVERS))) if k == "CALLS" and s.startswith("src/app.ts")}
    assert got[("inherited", "BaseStore.save")] == "receiver"
    assert got[("chain", "Query.run")] == "receiver"
    assert {got[(f, "UserStore.byName")] for f in ("factory", "value", "valueOfCall")} == {"receiver"}
    assert got[("single", "Query.run")] == "receiver"
    assert got[("scopes", "Other.run")] == got[("scopes2", "Query.run")] == "receiver"
    assert not {t for (s, t) in got if s in ("factory", "value", "valueOfCall")} & {"Other.byName"}


def test_python_chains_and_factories():
    got = extract.extract_file("a.py", "python", "def f():\n  q = make()\n  q.go()\n  make().where(\n    1).run()\n")
    calls = {c["name"]: c for c in got["calls"]}
    assert calls["go"]["receiver_call"] == "make" and (calls["run"]["chained_line"], calls["run"]["chained_col"]) == (calls["where"]["line"], calls["where"]["col"])
