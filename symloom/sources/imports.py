"""Where an import may lead: candidate paths in order, tried against the table of files; manifests; external packages."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.resolve import first_existing

_TS = (".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs")
# Prefixes of standard libraries, which never lead into a repository.
STANDARD = {
    "java": ("java.", "javax.", "jakarta."), "kotlin": ("kotlin.", "kotlinx.", "java.", "javax."), "scala": ("scala.", "java.", "javax."), "rust": ("std::", "core::", "alloc::"), "csharp": ("System", "Microsoft."),
    "swift": ("Foundation", "UIKit", "SwiftUI", "Combine"), "dart": ("dart:",), "bash": ("$",),
}


def _probe(base: str, extensions: tuple[str, ...], index: tuple[str, ...] = ()) -> list[str]:
    return [base + e for e in extensions] + [f"{base}/{i}" for i in index]


def _snake(name: str) -> str:
    return re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()


def candidates(language: str, file: str, module: str, manifest: dict | None = None) -> list[str]:
    """Paths that ``module``, imported by ``file``, may stand for, the first existing one wins. Empty for standard libraries."""
    m = manifest or {}
    here = posixpath.dirname(file)
    join = lambda *p: posixpath.normpath(posixpath.join(*p))
    if module.startswith(STANDARD.get(language, ("\0",))):
        return []
    out: list[str] = []
    if language in ("typescript", "tsx", "javascript"):
        module = module.split("!")[-1].split("?")[0]
        index = tuple(f"index{e}" for e in _TS)
        bases = [join(here, module)] if module.startswith(".") else []
        for prefix, targets in (m.get("aliases") or {}).items():
            stem = prefix.rstrip("*")
            if module.startswith(stem):
                bases += [join(t.replace("*", module[len(stem) :]) if "*" in t else posixpath.join(t, module[len(stem) :])) for t in targets]
        for name, folder in (m.get("workspaces") or {}).items():
            if module == name or module.startswith(name + "/"):
                bases += [join(folder, "src", module[len(name) + 1 :] or "index"), join(folder, module[len(name) + 1 :] or "index")]
        for b in bases:
            bare = re.sub(r"\.(js|jsx|mjs|cjs)$", "", b)
            out += [b] + _probe(bare, _TS, index)
    elif language == "python":
        dots = len(module) - len(module.lstrip("."))
        rest = module[dots:].replace(".", "/")
        if dots:
            base = here
            for _ in range(dots - 1):
                base = posixpath.dirname(base)
            bases = [posixpath.join(base, rest) if rest else base]
        else:
            bases, base = [], here
            for _ in range(11):
                bases.append(posixpath.join(base, rest))
                if not base:
                    break
                base = posixpath.dirname(base)
            bases += [posixpath.join(d, rest) for d in (m.get("package_dirs") or ())]
        for b in bases:
            out += [f"{b}.py", f"{b}/__init__.py"]
    elif language == "go":
        name = m.get("module")
        for prefix, folder in [*((m.get("replace") or {}).items()), *([(name, "")] if name else [])]:
            if module == prefix or module.startswith(prefix + "/"):
                out.append(join(folder, module[len(prefix) + 1 :]) + "/*")
        out.append(f"vendor/{module}/*")
    elif language in ("java", "kotlin", "scala"):
        parts = module.rstrip("*").rstrip(".").split(".")
        for n in range(len(parts), min(2, len(parts)) - 1, -1):
            for root in m.get("source_roots") or ("src/main/java", "src/main/kotlin", "src/main/scala", "src/test/java", "src", ""):
                path = join(root, "/".join(parts[:n]))
                out += [f"{path}/*"] if module.endswith("*") and n == len(parts) else [path + e for e in (".java", ".kt", ".scala")]
    elif language == "rust":
        parts = module.split("::")
        if parts[0] == "crate":
            base, parts = "src", parts[1:]
        elif parts[0] in ("super", "self"):
            base = here if parts[0] == "self" else posixpath.dirname(here) if posixpath.basename(file) == "mod.rs" else here
            parts = parts[1:]
        else:
            base = join((m.get("crates") or {}).get(parts[0], "\0"), "src")
            parts = parts[1:]
        for n in range(len(parts), 0, -1):
            out += [join(base, *parts[:n]) + ".rs", join(base, *parts[:n], "mod.rs")]
    elif language == "csharp":
        parts = module.split(".")
        for n in range(1, len(parts) + 1):
            out += [join(root, *parts[-n:]) + ".cs" for root in ("", "src", "lib", "Source", *(m.get("projects") or ()))]
        out += [join(root, *parts[-n:]) + "/*" for n in range(1, len(parts) + 1) for root in ("", "src")]
    elif language == "php":
        path = module.strip("\\").replace("\\", "/")
        for prefix, folder in (m.get("psr4") or {}).items():
            stem = prefix.replace("\\", "/").rstrip("/")
            if path.startswith(stem + "/"):
                out.append(join(folder, path[len(stem) + 1 :]) + ".php")
        out += [join(here, path), path] + [join(d, path) + ".php" for d in ("", "src", "lib", "app")]
    elif language == "ruby":
        out = [join(here, module) + ".rb", join(here, module), module + ".rb", f"lib/{module}.rb", f"app/{module}.rb"] + [join(g, "lib", module) + ".rb" for g in (m.get("gems") or ())]
    elif language == "swift":
        out = [f"{r}/{module}/*" for r in ("Sources", "Source", "src", "App", "Modules")] + [f"{module}/*", f"{module}.swift"]
    elif language == "dart":
        own = m.get("package")
        if module.startswith("package:"):
            name, _, rest = module[8:].partition("/")
            out = [f"lib/{rest}"] if name == own else [f"packages/{name}/lib/{rest}"]
        else:
            out = [join(here, module), join(here, module) + ".dart"]
    elif language == "elixir":
        path = "/".join(_snake(p) for p in module.split("."))
        bases = [f"lib/{path}", f"apps/{path.split('/')[0]}/lib/{path}", f"apps/{path.split('/')[0]}/lib/{'/'.join(path.split('/')[1:])}", join(here, path.split("/")[-1])]
        out = [b + e for b in bases for e in (".ex", ".exs")]
    elif language in ("c", "cpp"):
        out = [join(d, module) for d in (here, "", "src", "include", "inc")]
        out += [p + e for p in out for e in (".h", ".hpp", ".c", ".cpp")]
    elif language == "bash":
        bases = [module.lstrip("/")] if module.startswith("/") else [join(here, module), join(module)]
        out = [b + e for b in bases for e in ("", ".sh", ".bash")]
    return [p for p in dict.fromkeys(out) if p and not p.startswith("..")]


def resolve_imports(imports: DataFrame, files: DataFrame, manifest: dict | None = None) -> DataFrame:
    """``imports`` (file, language, module, ...) with ``target``: a file of ``files``, or null; ``dir/*`` is a folder's first file."""
    rows = imports.withColumn("id", F.xxhash64("file", "module"))

    def tries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "paths": [candidates(a, b, c, manifest) for a, b, c in zip(pdf["language"], pdf["file"], pdf["module"], strict=True)]})

    wanted = rows.select("id", "language", "file", "module").dropDuplicates(["id"]).mapInPandas(tries, "id long, paths array<string>")
    folders = files.select(F.concat(F.regexp_replace("file_path", "[^/]*$", ""), F.lit("*")).alias("alias"), "file_path").groupBy("alias").agg(F.min("file_path").alias("real"))
    known = files.select("file_path").union(folders.select("alias"))
    found = first_existing(wanted, known).join(folders, F.col("target") == F.col("alias"), "left").select("id", F.coalesce("real", "target").alias("target"))
    return rows.join(found, "id", "left").drop("id")


def external_package(language: str, module: str, manifest: dict | None = None) -> str | None:
    """Name of the outside package that a module belongs to, by standard prefixes and declared dependencies."""
    if module.startswith(STANDARD.get(language, ("\0",))):
        return module.split(":")[0].split(".")[0].rstrip(":") or module
    names = (manifest or {}).get("dependencies") or ()
    head = "/".join(module.split("/")[:2]) if module.startswith("@") else re.split(r"[/.:\\]", module)[0]
    return next((n for n in names if module == n or module.startswith((n + "/", n + ".", n + "::")) or n == head), None)


_JSON_PART = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)
_JSON_TAIL = re.compile(r'"(?:\\.|[^"\\])*"|,(?=\s*[}\]])', re.S)


def read_json(text: str) -> dict:
    """JSON with comments and trailing commas; what stands in strings is left alone. Empty where it cannot be read."""
    plain = _JSON_PART.sub(lambda m: m[0] if m[0][0] == '"' else " ", text.removeprefix("\ufeff"))
    try:
        found = json.loads(_JSON_TAIL.sub(lambda m: "" if m[0] == "," else m[0], plain))
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def read_manifest(texts: dict[str, str]) -> dict:
    """One manifest from the files of a root: package.json, tsconfig.json, go.mod, Cargo.toml, composer.json, pubspec.yaml, pyproject.toml, Gemfile."""
    out: dict = {"dependencies": [], "aliases": {}, "workspaces": {}}
    if "package.json" in texts:
        p = read_json(texts["package.json"])
        out["dependencies"] += [*p.get("dependencies", {}), *p.get("devDependencies", {}), *p.get("peerDependencies", {})]
        out["aliases"] |= {k: [v] if isinstance(v, str) else [x for x in v.values() if isinstance(x, str)] for k, v in p.get("imports", {}).items()}
    if "tsconfig.json" in texts:
        c = read_json(texts["tsconfig.json"]).get("compilerOptions", {})
        base = c.get("baseUrl", ".")
        out["aliases"] |= {k: [posixpath.normpath(posixpath.join(base, t)) for t in v] for k, v in c.get("paths", {}).items()}
    if "go.mod" in texts:
        m = re.search(r"^module\s+(\S+)", texts["go.mod"], re.M)
        out["module"] = m[1] if m else None
        out["replace"] = dict(re.findall(r"^\s*(?:replace\s+)?(\S+)(?:\s+v\S+)?\s+=>\s+(\.\S*)", texts["go.mod"], re.M))
        out["dependencies"] += re.findall(r"^\s*(?:require\s+)?([\w.-]+\.[\w./-]+)\s+v", texts["go.mod"], re.M)
    if "Cargo.toml" in texts:
        name = re.search(r'^name\s*=\s*"([^"]+)"', texts["Cargo.toml"], re.M)
        out["crates"] = dict(re.findall(r'^([\w-]+)\s*=\s*\{[^}]*path\s*=\s*"([^"]+)"', texts["Cargo.toml"], re.M)) | ({name[1].replace("-", "_"): ""} if name else {})
    if "composer.json" in texts:
        p = read_json(texts["composer.json"])
        out["psr4"] = {k: v if isinstance(v, str) else v[0] for part in ("autoload", "autoload-dev") for k, v in p.get(part, {}).get("psr-4", {}).items()}
        out["dependencies"] += list(p.get("require", {}))
    if "pubspec.yaml" in texts:
        name = re.search(r"^name:\s*(\S+)", texts["pubspec.yaml"], re.M)
        out["package"] = name[1] if name else None
    if "pyproject.toml" in texts:
        out["package_dirs"] = re.findall(r'(?:package-dir|package_dir|where)\s*=\s*[\[{]?\s*(?:""\s*=\s*)?"([^"]+)"', texts["pyproject.toml"])
    if "Gemfile" in texts:
        out["gems"] = re.findall(r"path:\s*['\"]([^'\"]+)['\"]", texts["Gemfile"])
        out["dependencies"] += re.findall(r"^\s*gem\s+['\"]([^'\"]+)['\"]", texts["Gemfile"], re.M)
    return out
