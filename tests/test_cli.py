"""Commands and renderers on a tiny repository."""

from __future__ import annotations

import json
import subprocess

import pytest

from symloom import cli
from symloom.graph import CodeGraph
from symloom.operators import changes
from symloom.render import context
from symloom.sources import discovery

FILES = {"src/a.py": "class Base:\n    def save(self):\n        return 1\n\n\ndef helper(x):\n    if x:\n        return x\n    return 0\n", "src/b.py": "from .a import helper\n\n\ndef run(x):\n    return helper(x)\n", "src/test_b.py": "from .b import run\n\n\ndef test_run():\n    assert run(1)\n"}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for path, text in FILES.items():
        (root / path).parent.mkdir(exist_ok=True)
        (root / path).write_text(text)
    return root


@pytest.fixture(scope="module")
def made(spark, repo, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out") / "g.json")
    assert cli.run(cli.parser().parse_args(["parse", str(repo), "--out", out]), spark) is None
    return out


def call(spark, made, *args):
    return cli.run(cli.parser().parse_args([args[0], "--graph", made, *args[1:]]), spark)


def test_graph_and_lookups(spark, made):
    g = CodeGraph.load_json(spark, made)
    assert {("src/b.py::run", "src/a.py::helper"), ("src/test_b.py::test_run", "src/b.py::run")} <= {(r.source_qualified, r.target_qualified) for r in g.of_kind("CALLS").collect()}
    assert [r.qualified_name for r in call(spark, made, "search", "help*").collect()] == ["src/a.py::helper"]
    assert [r.qualified_name for r in call(spark, made, "search", "--callers-of", "src/a.py::helper").collect()] == ["src/b.py::run"]
    assert [r.qualified_name for r in call(spark, made, "path", "src/test_b.py::test_run", "src/a.py::helper").collect()] == ["src/test_b.py::test_run", "src/b.py::run", "src/a.py::helper"]


def test_context_in_text_and_xml(spark, made):
    text = call(spark, made, "context", "--files", "src/a.py")
    assert text.startswith("RISK ") and "## BLAST RADIUS" in text and "src/b.py::run" in text
    xml = call(spark, made, "context", "--files", "src/a.py", "--format", "xml")
    assert xml.startswith("<CallGraph risk=") and "ChangedFunction" in xml


def test_diff_and_status(spark, made, repo):
    assert json.loads(call(spark, made, "diff", "--old", made))["nodes"] == []
    assert {r.status for r in call(spark, made, "status", str(repo)).collect()} == {"fresh"}


def test_signatures_as_differences():
    assert context.params_diff("(a)", "(a, b)") == "(a) -> (a, b)"
    long = "(" + ", ".join(f"parameter{k}: int" for k in range(9)) + ")"
    assert context.params_diff(long, long[:-1] + ", more: str)") == "+more: str"


def test_changes_by_git_and_risk_settings(spark, made, tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)

    git("init", "-q")
    for k in range(2):
        (tmp_path / "src").mkdir(exist_ok=True)
        (tmp_path / "src" / "a.py").write_text(FILES["src/a.py"] + "\n" * k)
        (tmp_path / "src" / "b.py").write_text(FILES["src/b.py"])
        git("add", "-A")
        git("commit", "-q", "-m", str(k))
    assert discovery.git_changed(str(tmp_path), "HEAD~1") == ["src/a.py"]
    assert discovery.git_file(str(tmp_path), "HEAD~1", "src/b.py") == FILES["src/b.py"] and discovery.git_file(str(tmp_path), "HEAD", "none") is None
    settings = tmp_path / "risk.json"
    settings.write_text('{"weights": {"blast_radius": 0.0, "test_gaps": 1.0, "complexity": 0.0, "inheritance": 0.0}}')
    found = json.loads(call(spark, made, "context", "--repo", str(tmp_path), "--base", "HEAD~1", "--risk-config", str(settings), "--format", "json"))
    assert {r["qualified_name"].split("::")[0] for r in found["seeds"]} == {"src/a.py"} and found["risk"][0]["score"] == found["risk"][0]["test_gaps"]
    with pytest.raises(ValueError):
        changes.risk_config({"weights": {"other": 1.0}})
