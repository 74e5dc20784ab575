"""Extraction: one file in, its symbols, imports, calls and bindings out.

Python is read with its own parser. Other languages are read with patterns of
their declarations and the nesting of their blocks: names, lines, heritage,
signatures, imports and calls are found; a receiver has the type that the
innermost function binding it gives, else the file.
Extractors are kept in a registry and run in ``mapInPandas``; a file that
cannot be read gives a row with ``error`` set.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOL = "kind string, name string, owner string, line_start int, line_end int, params string, return_type string, modifiers string, is_test boolean, is_exported boolean, is_async boolean, decorators array<string>, throws array<string>, complexity int, extends string, implements array<string>"
#: ``col``: where the callee ends; ``chained``: where the callee of the call whose value is the receiver ends; ``receiver_call``: the
#: function whose result the receiver holds; ``receiver_import``: a receiver that no scope of the file binds.
CALL = "name string, receiver string, receiver_type string, line int, col int, in_class string, chained_line int, chained_col int, receiver_call string, receiver_import string"
VALUE = "name string, type string, callee string"
IMPORT = "module string, names array<string>, line int, re_export boolean"
BINDING = "owner string, field string, type string"


def _nested(spec: str) -> str:
    return "array<struct<" + ", ".join(p.replace(" ", ":", 1) for p in spec.split(", ")) + ">>"


EXTRACTED = f"file_path string, language string, file_hash string, symbols {_nested(SYMBOL)}, calls {_nested(CALL)}, imports {_nested(IMPORT)}, bindings {_nested(BINDING)}, values {_nested(VALUE)}, error string"

_FIELDS = [p.split(" ")[0] for p in SYMBOL.split(", ")]
EXTRACTORS: dict[str, Callable[[str, str], dict]] = {}


def extractor(*languages: str):
    def keep(f):
        for language in languages:
            EXTRACTORS[language] = f
        return f

    return keep


def symbol(kind: str, name: str, start: int, end: int, **more) -> dict:
    return dict.fromkeys(_FIELDS) | {"kind": kind, "name": name, "line_start": start, "line_end": end, "is_test": False, "decorators": [], "throws": [], "implements": []} | more


# ---- Python

_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.BoolOp, ast.match_case, ast.comprehension)


def _dotted(node) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}"
    if isinstance(node, ast.Subscript):
        return _dotted(node.value)
    if isinstance(node, ast.Call):
        return _dotted(node.func)
    return ""


class _PythonReader(ast.NodeVisitor):
    def __init__(self, path: str, source: str):
        self.path, self.source = path, source
        self.symbols, self.calls, self.imports, self.bindings = [], [], [], []
        self.classes: list[str] = []
        self.types: list[dict[str, str]] = [{}]
        self.made: list[dict[str, str]] = [{}]
        self.fields: dict[str, str] = {}

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = [b for b in map(_dotted, node.bases) if b]
        self.symbols.append(symbol("Class", node.name, node.lineno - 1, node.end_lineno - 1, extends=bases[0].split(".")[-1] if bases else None, is_exported=not node.name.startswith("_"), decorators=[_dotted(d) for d in node.decorator_list]))
        self.classes.append(node.name)
        self.generic_visit(node)
        self.classes.pop()

    def _function(self, node) -> None:
        owner = self.classes[-1] if self.classes else None
        throws = [t for t in dict.fromkeys(_dotted(r.exc) for r in ast.walk(node) if isinstance(r, ast.Raise) and r.exc is not None) if len(t) > 2]
        args = ast.unparse(node.args)
        branches = sum(isinstance(n, _BRANCHES) for n in ast.walk(node))
        test = node.name.startswith("test_")
        row = dict(owner=owner, params=f"({args})", return_type=ast.unparse(node.returns) if node.returns else None, is_async=isinstance(node, ast.AsyncFunctionDef), is_exported=not node.name.startswith("_"), decorators=[_dotted(d) for d in node.decorator_list], throws=throws, complexity=1 + branches)
        kind = "Constructor" if owner and node.name == "__init__" else "Method" if owner else "Function"
        self.symbols.append(symbol(kind, node.name, node.lineno - 1, node.end_lineno - 1, **row))
        if test:
            self.symbols.append(symbol("Test", node.name, node.lineno - 1, node.end_lineno - 1, **row | {"is_test": True}))
        scope = {}
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
            if a.annotation is not None:
                scope[a.arg] = self._type(a.annotation)
                if owner and node.name == "__init__":
                    self.bindings.append({"owner": owner, "field": a.arg, "type": scope[a.arg]})
        self.types.append(scope)
        self.made.append({})
        held, self.classes = self.classes, list(self.classes)
        self.generic_visit(node)
        self.classes = held
        self.types.pop()
        self.made.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    @staticmethod
    def _type(node) -> str:
        text = ast.unparse(node).strip("'\"")
        inner = re.fullmatch(r"(?:Optional|List|list|Type|type)\[(.*)\]", text)
        return (inner[1] if inner else text.split("|")[0]).strip().split("[")[0].split(".")[-1]

    def visit_Assign(self, node: ast.Assign) -> None:
        if isinstance(node.value, ast.Call):
            made = _dotted(node.value.func).split(".")[-1]
            if made[:1].isupper():
                for t in node.targets:
                    if isinstance(t, ast.Name):
                        self.types[-1].setdefault(t.id, made)
                    elif isinstance(t, ast.Attribute) and _dotted(t.value) == "self":
                        self.fields.setdefault(f"{self.classes[-1] if self.classes else ''}.{t.attr}", made)
            elif isinstance(node.value.func, ast.Name):
                for t in node.targets:
                    if isinstance(t, ast.Name):
                        self.made[-1].setdefault(t.id, made)
        elif isinstance(node.value, ast.Name) and self.types[-1].get(node.value.id):
            for t in node.targets:
                if isinstance(t, ast.Attribute) and _dotted(t.value) == "self":
                    self.fields.setdefault(f"{self.classes[-1] if self.classes else ''}.{t.attr}", self.types[-1][node.value.id])
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if isinstance(node.target, ast.Name):
            self.types[-1].setdefault(node.target.id, self._type(node.annotation))
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.imports.append({"module": a.name, "names": [a.asname or a.name.split(".")[0]], "line": node.lineno - 1, "re_export": False})

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        self.imports.append({"module": "." * node.level + (node.module or ""), "names": [a.asname or a.name for a in node.names], "line": node.lineno - 1, "re_export": node.level > 0 and self.path.endswith("__init__.py")})

    def visit_Call(self, node: ast.Call) -> None:
        name, receiver = _dotted(node.func).split(".")[-1], ""
        if isinstance(node.func, ast.Attribute):
            receiver = _dotted(node.func.value)
        in_class = None
        kind = None
        owner = self.classes[-1] if self.classes else None
        if receiver in ("self", "cls", "super") and owner:
            in_class = owner
        elif receiver.startswith("self.") and owner:
            kind = self.fields.get(f"{owner}.{receiver[5:]}")
        elif receiver:
            kind = next((s[receiver] for s in reversed(self.types) if receiver in s), receiver if receiver[:1].isupper() and "." not in receiver else None)
        made = None if kind or in_class else next((s[receiver] for s in reversed(self.made) if receiver in s), None)
        inner = node.func.value if isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Call) else None
        chained = (inner.func.end_lineno - 1, inner.func.end_col_offset) if inner else (None, None)
        if name:
            self.calls.append({"name": name, "receiver": receiver or None, "receiver_type": kind, "line": node.func.end_lineno - 1, "col": node.func.end_col_offset, "in_class": in_class, "chained_line": chained[0], "chained_col": chained[1], "receiver_call": made, "receiver_import": None})
        self.generic_visit(node)


@extractor("python")
def read_python(path: str, source: str) -> dict:
    reader = _PythonReader(path, source)
    reader.visit(ast.parse(source))
    values = [{"name": n, "type": t, "callee": None} for n, t in reader.types[0].items()] + [{"name": n, "type": None, "callee": c} for n, c in reader.made[0].items() if n not in reader.types[0]]
    return {"symbols": reader.symbols, "calls": reader.calls, "imports": reader.imports, "bindings": reader.bindings, "values": values}


# ---- languages read by patterns

_ID = r"[A-Za-z_$][\w$]*"
_TYPE = rf"(?:{_ID}(?:\.{_ID})*)"


class Grammar:
    """Patterns of one language; groups: name, extends, implements, params, result, mods."""

    def __init__(self, types: str, functions: str, imports: str, exported: Callable[[str, str], bool], branches: str = r"\b(?:if|for|while|case|catch|when|elif|elsif|rescue)\b|&&|\|\||\?(?![.?:])", blocks: str = "brace", tests: str = r"^$", enums: str = r"\benum\s+(?:class\s+)?(?P<name>\w+)", interfaces: str = r"\b(?:interface|protocol|trait)\s+(?P<name>\w+)"):
        self.types, self.functions, self.imports = re.compile(types, re.M), re.compile(functions, re.M), re.compile(imports, re.M)
        self.enums, self.interfaces, self.branches, self.tests = re.compile(enums), re.compile(interfaces), re.compile(branches), re.compile(tests)
        self.exported, self.blocks = exported, blocks


_MODS = r"(?P<mods>(?:(?:public|private|protected|internal|static|final|abstract|async|override|export|default|open|sealed|suspend|virtual|readonly|unsafe|pub(?:\([^)]*\))?|const|fileprivate|data|inline|extern)\s+)*)"
_CLASS = rf"^[ \t]*{_MODS}(?:class|struct|record|object|mixin)\s+(?P<name>{_ID})(?:<[^>{{]*>)?(?:\s*\([^)]*\))?(?:\s*(?:extends|:|<)\s*(?P<extends>{_TYPE}))?[^{{;\n]*?(?:(?:implements|with|,)\s*(?P<implements>[^{{\n]*))?"
_PUBLIC = lambda mods, name: "public" in mods
_JS = Grammar(
    rf"^[ \t]*{_MODS}class\s+(?P<name>{_ID})(?:<[^>{{]*>)?(?:\s+extends\s+(?P<extends>{_TYPE}))?(?:<[^>{{]*>)?(?:\s+implements\s+(?P<implements>[^{{]*))?",
    rf"^[ \t]*{_MODS}(?:function\s*\*?\s*(?P<name>{_ID})|(?:const|let)\s+(?P<name2>{_ID})\s*=\s*(?:async\s*)?(?=\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=]+)?=>)|(?P<name3>{_ID})(?=\s*(?:<[^>]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{{;=]+)?\{{))\s*(?:<[^>]*>)?(?P<params>\([^()]*(?:\([^()]*\)[^()]*)*\))\s*(?::\s*(?P<result>[^{{=;]+?))?\s*(?:=>|\{{)",
    rf"^\s*(?:import\s+(?:type\s+)?(?P<names>[^'\"]*?)\s*(?:from\s*)?|(?P<re>export)\s+(?:type\s+)?(?P<names2>\{{[^}}]*\}}|\*)(?:\s+as\s+\w+)?\s+from\s*|(?:const|let|var)\s+(?P<names3>[^=]+)=\s*require\()['\"](?P<module>[^'\"]+)['\"]",
    lambda mods, name: "export" in mods,
    tests=r"\b(?:describe|it|test)(?:\.\w+)?\(\s*['\"`](?P<name>[^'\"`]+)['\"`]",
)
GRAMMARS = {
    "typescript": _JS, "tsx": _JS, "javascript": _JS,
    "java": Grammar(_CLASS.replace("implements|with|,", "implements"), rf"^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*{_MODS}(?:<[^>]+>\s+)?(?P<result>[\w<>\[\],.? ]+?)\s+(?P<name>{_ID})\s*(?P<params>\([^()]*\))\s*(?:throws\s+(?P<throws>[\w., ]+))?\s*\{{", r"^\s*import\s+(?:static\s+)?(?P<module>[\w.*]+)\s*;", _PUBLIC),
    "kotlin": Grammar(_CLASS, rf"^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*{_MODS}fun\s+(?:<[^>]+>\s+)?(?P<name>[\w.]+)\s*(?P<params>\([^()]*\))\s*(?::\s*(?P<result>[\w<>?., ]+))?", r"^\s*import\s+(?P<module>[\w.*]+)", lambda m, n: not re.search("private|protected|internal", m)),
    "csharp": Grammar(_CLASS, rf"^[ \t]*(?:\[[^\]]*\]\s*)*{_MODS}(?P<result>[\w<>\[\],.?]+)\s+(?P<name>{_ID})\s*(?:<[^>]*>)?(?P<params>\([^()]*\))\s*(?:\{{|=>|where)", r"^\s*using\s+(?:static\s+)?(?P<module>[\w.]+)\s*;", _PUBLIC),
    "go": Grammar(r"^type\s+(?P<name>\w+)\s+struct\b", r"^func\s+(?:\(\s*\w*\s*\*?(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*)?(?P<name>\w+)(?:\[[^\]]*\])?(?P<params>\([^()]*(?:\([^()]*\)[^()]*)*\))\s*(?P<result>[^{\n]*?)\s*\{", r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"(?P<module>[^"\n]+)"\s*$', lambda m, n: n[:1].isupper(), interfaces=r"\btype\s+(?P<name>\w+)\s+interface\b", enums=r"^$"),
    "rust": Grammar(r"^[ \t]*(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)struct\s+(?P<name>\w+)", r"^[ \t]*(?P<mods>(?:(?:pub(?:\([^)]*\))?|async|const|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*)fn\s+(?P<name>\w+)(?:<[^>]*>)?\s*(?P<params>\([^()]*(?:\([^()]*\)[^()]*)*\))\s*(?:->\s*(?P<result>[^{;]+?))?\s*(?:where[^{]*)?\{", r"^\s*(?:pub\s+)?use\s+(?P<module>[\w:]+)(?:::\{(?P<names>[^}]*)\})?", lambda m, n: "pub" in m),
    "swift": Grammar(_CLASS, rf"^[ \t]*(?:@\w+\s+)*{_MODS}func\s+(?P<name>\w+)(?:<[^>]*>)?\s*(?P<params>\([^()]*(?:\([^()]*\)[^()]*)*\))\s*(?:async\s*)?(?:throws\s*)?(?:->\s*(?P<result>[^{{\n]+?))?\s*\{{", r"^\s*import\s+(?:class\s+|struct\s+)?(?P<module>[\w.]+)", lambda m, n: bool(re.search("public|open", m))),
    "scala": Grammar(_CLASS, rf"^[ \t]*{_MODS}def\s+(?P<name>\w+)(?:\[[^\]]*\])?\s*(?P<params>\([^()]*\))?\s*(?::\s*(?P<result>[\w\[\], .]+))?\s*=?", r"^\s*import\s+(?P<module>[\w.]+)(?:\.\{(?P<names>[^}]*)\})?", lambda m, n: not re.search("private|protected", m)),
    "dart": Grammar(_CLASS, rf"^[ \t]*{_MODS}(?P<result>[\w<>?, ]+?)\s+(?P<name>\w+)\s*(?P<params>\([^()]*\))\s*(?:async\*?\s*)?(?:\{{|=>)", r"^\s*(?:import|export)\s+'(?P<module>[^']+)'", lambda m, n: not n.startswith("_")),
    "php": Grammar(_CLASS.replace("implements|with|,", "implements"), rf"^[ \t]*{_MODS}function\s+&?(?P<name>\w+)\s*(?P<params>\([^()]*(?:\([^()]*\)[^()]*)*\))\s*(?::\s*(?P<result>[?\w|\\]+))?", r"^\s*use\s+(?P<module>[\w\\]+)", lambda m, n: not re.search("private|protected", m)),
    "c": Grammar(r"^[ \t]*(?:typedef\s+)?struct\s+(?P<name>\w+)", r"^(?P<mods>(?:static\s+|inline\s+|extern\s+)*)(?P<result>[\w*]+(?:\s+[\w*]+)*?[\s*]+)(?P<name>\w+)\s*(?P<params>\([^()]*\))\s*\{", r'^\s*#\s*include\s+[<"](?P<module>[^>"]+)[>"]', lambda m, n: "extern" in m, interfaces=r"^$"),
    "cpp": Grammar(r"^[ \t]*(?:template\s*<[^>]*>\s*)?(?:class|struct|namespace)\s+(?P<name>\w+)(?:\s*(?:final\s*)?:\s*(?:public|private|protected)?\s*(?P<extends>[\w:]+))?", r"^[ \t]*(?P<mods>(?:static\s+|inline\s+|virtual\s+|extern\s+|constexpr\s+)*)(?P<result>[\w:<>*&]+(?:\s+[\w:<>*&]+)*?[\s*&]+)(?:(?P<owner>\w+)::)?(?P<name>~?\w+)\s*(?P<params>\([^()]*(?:\([^()]*\)[^()]*)*\))\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?\{", r'^\s*#\s*include\s+[<"](?P<module>[^>"]+)[>"]', lambda m, n: "extern" in m, interfaces=r"^$"),
    "ruby": Grammar(r"^[ \t]*(?:class|module)\s+(?P<name>[\w:]+)(?:\s*<\s*(?P<extends>[\w:]+))?", r"^[ \t]*def\s+(?:self\.)?(?P<name>[\w?!=]+)\s*(?P<params>\([^)]*\))?", r"^\s*(?:require|require_relative|load)\s*\(?['\"](?P<module>[^'\"]+)['\"]", lambda m, n: True, blocks="end", tests=r"\b(?:describe|it|context)\s*\(?['\"](?P<name>[^'\"]+)['\"]", enums=r"^$", interfaces=r"^$"),
    "elixir": Grammar(r"^[ \t]*defmodule\s+(?P<name>[\w.]+)", r"^[ \t]*(?P<mods>defp?)\s+(?P<name>[\w?!]+)\s*(?P<params>\([^)]*\))?", r"^\s*(?:alias|import|use|require)\s+(?P<module>[\w.]+)", lambda m, n: m.strip() != "defp", blocks="end", tests=r"\btest\s+\"(?P<name>[^\"]+)\"", enums=r"^$", interfaces=r"^$"),
    "bash": Grammar(r"^$(?P<name>)", r"^[ \t]*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*\{", r"^\s*(?:source|\.)\s+['\"]?(?P<module>[^'\"\s;]+)", lambda m, n: True, enums=r"^$", interfaces=r"^$"),
}
#: Words before a parenthesis that are no calls.
_KEYWORDS = frozenset("if for while switch catch return function new typeof await async throw super class def fn func fun do else elif match when unless until sizeof defined and or not in is as with yield lambda case try".split())
_CALLED = re.compile(rf"(?:(?P<receiver>(?:{_ID}(?:\(\))?(?:\.|->|::|\?\.))*{_ID})(?:\.|->|::|\?\.))?(?P<name>{_ID})\s*(?:<[\w, <>\[\].]*>)?\(")
_TYPED = re.compile(rf"\b(?:const|let|var|val|final)?\s*(?P<name>{_ID})\s*(?::\s*(?P<type>[A-Z]\w*)|(?::=|=)\s*(?:await\s+)?(?:new\s+|&)?(?P<made>[A-Z]\w*)\s*[({{])")
_OTHER_ORDER = re.compile(rf"\b(?P<type>[A-Z]\w*)(?:<[^>]*>)?\s+(?P<name>{_ID})\s*(?=[=;,)])")
#: What else gives a TypeScript variable its type: an assertion, or a plain call, whose result type is looked up later.
_ASSERTED = re.compile(rf"\b(?:const|let|var)\s+(?P<name>{_ID})\s*=[^;\n]*\bas\s+(?P<type>[A-Z]\w*)")
_FACTORY = re.compile(rf"\b(?:const|let|var)\s+(?P<name>{_ID})\s*=\s*(?P<callee>{_ID})\s*(?:<[\w, <>\[\].]*>)?\(")
_SCRIPTS = ("typescript", "tsx", "javascript")
_DI = re.compile(rf"\b(?:private|protected|public|readonly|final|val)\s+(?:readonly\s+|final\s+)*(?:(?P<field>{_ID})\s*:\s*(?P<type>[A-Z]\w*)|(?P<type2>[A-Z]\w*)(?:<[^>]*>)?\s+\$?(?P<field2>{_ID}))")
_TEST_MARK = re.compile(r"@(?:Test|ParameterizedTest)\b|\[(?:Fact|Test|Theory|TestMethod)|#\[(?:\w+::)?test\]")
_STRINGS = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)


def _blanked(source: str, hashes: bool) -> str:
    """The source with comments and the inside of strings as spaces; places and lines stay."""
    out = _STRINGS.sub(lambda m: m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1] if m[0][0] in "\"'`" and len(m[0]) > 1 else re.sub(r"[^\n]", " ", m[0]), source)
    return re.sub(r"#(?!\[|!|include|\{)[^\n]*", lambda m: " " * len(m[0]), out) if hashes else out


def _block_end(text: str, at: int, blocks: str) -> int:
    """Where the block that opens at or behind ``at`` ends."""
    if blocks == "end":
        indent = re.match(r"[ \t]*", text[text.rfind("\n", 0, at) + 1 :])[0]
        m = re.compile(rf"^{indent}end\b", re.M).search(text, at)
        return m.start() if m else len(text) - 1
    start = text.find("{", at)
    line_end = text.find("\n\n", at)
    if start < 0 or 0 <= line_end < start:
        return max(at, text.find("\n", at) if text.find("\n", at) > 0 else len(text) - 1)
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, start):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.start()
    return len(text) - 1


def read_by_patterns(language: str) -> Callable[[str, str], dict]:
    grammar = GRAMMARS[language]

    def read(path: str, source: str) -> dict:
        text = _blanked(source, language in ("ruby", "elixir", "bash", "php"))
        starts = [0, *(m.end() for m in re.finditer("\n", source))]
        import bisect

        line = lambda at: bisect.bisect_right(starts, at) - 1
        symbols, owners, spans = [], [], []
        for kind, pattern in (("Class", grammar.types), ("Interface", grammar.interfaces), ("Enum", grammar.enums)):
            for m in pattern.finditer(text):
                g = m.groupdict()
                if not g.get("name") or (kind == "Class" and any(m.start() <= s <= m.end() for s, _ in ((x["_at"], 0) for x in symbols))):
                    continue
                begin, end = m.start("name"), _block_end(text, m.end(), grammar.blocks)
                mods = (g.get("mods") or "").strip()
                across = [re.sub(r"<.*", "", x).strip().split(".")[-1] for x in (g.get("implements") or "").split(",")]
                symbols.append(symbol(kind, g["name"], line(begin), line(end), extends=(g.get("extends") or "").split(".")[-1] or None, implements=[x for x in across if re.fullmatch(_ID, x)], modifiers=mods or None, is_exported=grammar.exported(mods, g["name"]) or None, _at=begin))
                if kind != "Enum":
                    owners.append((begin, end, g["name"]))
        for m in grammar.functions.finditer(text):
            g = m.groupdict()
            name = g.get("name") or g.get("name2") or g.get("name3")
            if not name or name in _KEYWORDS:
                continue
            begin, end = m.start(), _block_end(text, m.end() - 1, grammar.blocks)
            spans.append((begin, end))
            owner = g.get("owner") or max(((a, n) for a, b, n in owners if a < m.end() <= b), default=(0, None))[1]
            mods = (g.get("mods") or "").strip()
            body = text[m.end() : end]
            marked = bool(_TEST_MARK.search(source[max(0, source.rfind("}", 0, begin)) : m.end()])) or (language == "go" and path.endswith("_test.go") and bool(re.match("Test|Benchmark", name))) or (language == "php" and name.startswith("test"))
            throws = list(dict.fromkeys([t.strip().split(".")[-1] for t in (g.get("throws") or "").split(",") if t.strip()] or re.findall(r"\bthrow\s+(?:new\s+)?([A-Z]\w+)", body)))
            constructor = owner is not None and name in ("constructor", "__construct", "init", "initialize", owner)
            row = dict(owner=owner, params=source[m.start("params") : m.end("params")] if g.get("params") else "()", return_type=(g.get("result") or "").strip() or None, modifiers=mods or None, is_exported=grammar.exported(mods, name) or None, is_async="async" in mods or "suspend" in mods or None, throws=throws, complexity=1 + len(grammar.branches.findall(body)))
            at = line(m.start(next(k for k in ("name", "name2", "name3") if g.get(k))))
            symbols.append(symbol("Constructor" if constructor else "Method" if owner else "Function", name, at, line(end), **row))
            if marked:
                symbols.append(symbol("Test", name, at, line(end), **row | {"is_test": True}))
        if grammar.tests.pattern != "^$":
            for m in grammar.tests.finditer(source):
                end = _block_end(text, m.end(), grammar.blocks)
                symbols.append(symbol("Test", m["name"], line(m.start()), line(end), is_test=True))
        bound: dict[str, list[tuple[int, str | None, str | None]]] = {}
        for pattern in (_OTHER_ORDER, _TYPED, *((_ASSERTED,) if language in _SCRIPTS else ())):
            for m in pattern.finditer(text):
                bound.setdefault(m["name"], []).append((m.start("name"), m["type"] or m.groupdict().get("made"), None))
        if language in _SCRIPTS:
            for m in _FACTORY.finditer(text):
                if m["callee"] not in _KEYWORDS and not any(at == m.start("name") for at, _, _ in bound.get(m["name"], ())):
                    bound.setdefault(m["name"], []).append((m.start("name"), None, m["callee"]))
        for places in bound.values():
            places.sort(key=lambda x: x[0])

        def binding_of(name: str, at: int) -> tuple[str | None, str | None]:
            """(type, callee) of a variable at a place: by the innermost function that binds it, else by the file."""
            places = bound.get(name)
            if not places:
                return None, None
            for a, b in sorted(((a, b) for a, b in spans if a <= at <= b), key=lambda x: x[1] - x[0]):
                inside = [x for x in places if a <= x[0] <= b]
                if inside:
                    return inside[-1][1:]
            return places[-1][1:]

        def called_before(at: int) -> tuple[int, int] | tuple[None, None]:
            """Where the callee ends whose value the call at ``at`` is made on, if it is made on one."""
            head = text[:at].rstrip()
            mark = next((x for x in ("?.", "->", "::", ".") if head.endswith(x)), None)
            head = head[: len(head) - len(mark)].rstrip() if mark else ""
            if not head.endswith(")"):
                return None, None
            depth, k = 0, len(head) - 1
            while k >= 0:
                depth += (head[k] == ")") - (head[k] == "(")
                if depth == 0:
                    break
                k -= 1
            end = len(head[: max(0, k)].rstrip())
            if not end or not re.match(r"[\w$]", head[end - 1]):
                return None, None
            return line(end), end - starts[line(end)]

        bindings = [{"owner": max(((a, n) for a, b, n in owners if a < m.start() <= b), default=(0, None))[1], "field": m["field"] or m["field2"], "type": m["type"] or m["type2"]} for m in _DI.finditer(text)]
        calls = []
        declared = {(s["name"], s["line_start"]) for s in symbols}
        for m in _CALLED.finditer(text):
            name, receiver = m["name"], m["receiver"]
            at = line(m.start("name"))
            if name in _KEYWORDS or ((name, at) in declared and not receiver):
                continue
            owner = max(((a, n) for a, b, n in owners if a < m.start() <= b), default=(0, None))[1]
            own = receiver in ("this", "self", "super", "Self", "static", "parent", "$this")
            field = re.sub(r"^(?:\$?this|self)(?:\.|->)", "", receiver or "")
            kind = made = None
            chained = called_before(m.start("name"))
            if receiver and not own and chained[0] is None:
                kind, made = binding_of(field, m.start())
                if not made:
                    kind = kind or next((b["type"] for b in bindings if b["field"] == field), None) or (receiver if re.fullmatch(r"[A-Z]\w*", receiver) else None)
            unknown = language in _SCRIPTS and receiver and not own and chained[0] is None and not kind and not made and re.fullmatch(r"[a-z_$][\w$]*", receiver)
            calls.append({"name": name, "receiver": receiver, "receiver_type": kind, "line": line(m.end("name")), "col": m.end("name") - starts[line(m.end("name"))], "in_class": owner if own else None, "chained_line": chained[0], "chained_col": chained[1], "receiver_call": made, "receiver_import": receiver if unknown else None})
        values = [{"name": n, "type": places[-1][1], "callee": places[-1][2]} for n, places in bound.items()] if language in _SCRIPTS else []
        imports = []
        for m in grammar.imports.finditer(source):
            g = m.groupdict()
            raw = g.get("names") or g.get("names2") or g.get("names3") or ""
            names = [n for n in (re.split(r"\s+as\s+", x.strip())[-1].strip() for x in re.sub(r"[{}*]", ",", raw).replace("type ", "").split(",")) if re.fullmatch(_ID, n)]
            imports.append({"module": g["module"], "names": names or [re.split(r"[./\\:]", g["module"].rstrip(".*"))[-1]], "line": line(m.start("module")), "re_export": bool(g.get("re"))})
        for s in symbols:
            s.pop("_at", None)
        return {"symbols": symbols, "calls": calls, "imports": imports, "bindings": [b for b in bindings if b["field"]], "values": values}

    return read


for _language in GRAMMARS:
    EXTRACTORS[_language] = read_by_patterns(_language)


def extract_file(path: str, language: str, content: str) -> dict:
    read = EXTRACTORS.get(language)
    none = {"symbols": [], "calls": [], "imports": [], "bindings": [], "values": []}
    if read is None or content is None:
        return none | {"error": f"no extractor for {language}"}
    try:
        found = read(path, content)
    except (SyntaxError, ValueError, RecursionError) as e:
        return none | {"error": f"{type(e).__name__}: {e}"}
    seen, kept = set(), []
    for s in found["symbols"]:  # the first of equal declarations counts
        key = (s["kind"] if s["kind"] in ("Class", "Interface", "Enum", "Test") else "f", s["owner"], s["name"], None if s["kind"] in ("Class", "Interface", "Enum") else s["line_start"])
        if key not in seen:
            seen.add(key)
            kept.append(s)
    return found | {"symbols": kept, "error": None}


def extract(files: DataFrame) -> DataFrame:
    """One row per file of ``files`` (file_path, language, content, file_hash) with arrays of what it holds."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [extract_file(*r) for r in zip(pdf["file_path"], pdf["language"], pdf["content"], strict=True)]
            yield pd.DataFrame({"file_path": pdf["file_path"], "language": pdf["language"], "file_hash": pdf["file_hash"]} | {c: [r[c] for r in rows] for c in ("symbols", "calls", "imports", "bindings", "values", "error")})

    return files.select("file_path", "language", "content", "file_hash").mapInPandas(run, EXTRACTED)


def nodes_of(extracted: DataFrame) -> DataFrame:
    """Nodes with ``ord``; members are named ``file::Class.member``. ``is_exported`` is true or unknown, never false."""
    rows = extracted.select("file_path", "language", "file_hash", F.posexplode("symbols").alias("k", "s")).select("file_path", "language", "file_hash", "k", "s.*")
    member = F.when(F.col("owner").isNotNull(), F.concat("owner", F.lit("."), "name")).otherwise(F.col("name"))
    return rows.select(
        "kind", F.lit(None).cast("string").alias("ast_kind"), "name", F.concat("file_path", F.lit("::"), member).alias("qualified_name"), "file_path", "line_start", "line_end", "language", F.col("owner").alias("parent_name"), "params", "return_type", "modifiers", "is_test", "file_hash",
        F.sha2(F.concat_ws("|", "kind", member, "params", "return_type", (F.col("line_end") - F.col("line_start")).cast("string"), F.col("complexity").cast("string")), 256).alias("content_hash"),
        F.when(F.col("is_exported"), True).alias("is_exported"), "is_async", "decorators", "throws", "complexity", (F.xxhash64("file_path").bitwiseAND(F.lit((1 << 40) - 1)) * 4096 + F.col("k")).alias("ord"), "extends", "implements",
    )
