"""Source files of a folder, their languages, unified diffs, git, and the path guard."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Folders that hold no sources, names of built files, languages by extension.
SKIPPED = (
    "node_modules", ".git", "dist", "build", ".next", "coverage", "vendor", "__pycache__", ".venv", "venv", "target", ".turbo",
    ".cache", ".output", "out", ".nuxt", ".svelte-kit", ".idea", ".mypy_cache", ".tox", ".pytest_cache", ".eggs", "bower_components",
)
BUILT = r"(\.min\.\w+|[.-]bundle\.\w+|\.chunk\.\w+|\.packed\.\w+)$"
EXTENSIONS = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "es6": "javascript",
    "py": "python", "rb": "ruby", "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "rs": "rust", "cs": "csharp", "php": "php", "swift": "swift", "dart": "dart",
    "scala": "scala", "sc": "scala", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "ex": "elixir", "exs": "elixir", "sh": "bash", "bash": "bash",
}


def language_of(path: str | Column) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    pairs = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.try_element_at(pairs, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def glob_regex(glob: str) -> str:
    """``**`` any folders, ``*`` within one part."""
    parts = re.split(r"(\*\*/|\*\*|\*)", glob)
    return "^" + "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*"}.get(p, re.escape(p)) for p in parts) + "$"


def keep_path(path: str, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    """Whether a repository-relative path is a source: no skipped folder, no built file, a known language, the globs."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    out = ~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED))) & ~F.col(path).rlike(BUILT) & language_of(path).isNotNull()
    include, exclude = list(include), list(exclude)
    if include:
        out = out & F.col(path).rlike("|".join(map(glob_regex, include)))
    return out & ~F.col(path).rlike("|".join(map(glob_regex, exclude))) if exclude else out


def inside(root: str, path: str) -> str:
    """The real path, refused where it leaves the root."""
    root, real = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if real != root and not real.startswith(root + os.sep):
        raise ValueError(f"{path} is outside {root}")
    return real


def discover(spark: SparkSession, root: str, files: Iterable[str] | None = None, include: Iterable[str] = (), exclude: Iterable[str] = (), max_files: int | None = None, allow_partial: bool = False) -> DataFrame:
    """(file_path, language, content) of a folder's sources; a list of ``files`` skips all rules.

    Paths are decided on before any content is read: the reader prunes the column.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if files is not None:
        listed = [inside(root, f) for f in files]
        rows = reader.load(listed) if listed else reader.load(root).limit(0)
    else:
        rows = reader.load(root)
    base = f"^(?:file:/*)?/?{re.escape(os.path.realpath(root).strip('/'))}/"
    rows = rows.withColumn("file_path", F.regexp_replace("path", base, ""))
    if files is None:
        rows = rows.filter(keep_path("file_path", include, exclude))
        if max_files is not None and rows.select("file_path").count() > max_files:
            if not allow_partial:
                raise ValueError(f"more than {max_files} files; allow_partial reads the first ones by path")
            rows = rows.orderBy("file_path").limit(max_files)
    return rows.select("file_path", language_of("file_path").alias("language"), F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("file_hash"))


def diff_hunks(lines: DataFrame, text: str = "value", order: str = "line_no") -> DataFrame:
    """(file, new_start, new_count) of a unified diff given as numbered lines; a missing count is one."""
    name = F.regexp_extract(text, r"^\+\+\+ (?:b/)?(.*?)(?:\t.*)?$", 1)
    head = F.when(F.col(text).startswith("+++ "), F.when(name == "/dev/null", F.lit("")).otherwise(name))
    at = Window.orderBy(order)
    rows = lines.withColumn("file", F.last(head, ignorenulls=True).over(at)).filter(F.col(text).rlike(r"^@@ -\d+(,\d+)? \+\d+(,\d+)? @@"))
    count = F.regexp_extract(text, r"\+\d+,(\d+) @@", 1)
    return rows.filter("file <> ''").select("file", F.regexp_extract(text, r"\+(\d+)", 1).cast("int").alias("new_start"), F.when(count == "", 1).otherwise(count.cast("int")).alias("new_count"))


def diff_hunks_of(spark: SparkSession, diff: str) -> DataFrame:
    return diff_hunks(spark.createDataFrame(list(enumerate(diff.splitlines())) or [(0, "")], "line_no int, value string"))


def git_changed(repo: str, base: str) -> list[str]:
    """Files changed between ``base`` and HEAD; arguments are passed as a list, never through a shell."""
    out = subprocess.run(["git", "-C", repo, "diff", "--name-only", f"{base}..HEAD", "--"], capture_output=True, text=True, check=True)
    return [x for x in out.stdout.splitlines() if x]


def git_file(repo: str, ref: str, path: str) -> str | None:
    out = subprocess.run(["git", "-C", repo, "show", f"{ref}:{path}"], capture_output=True)
    return out.stdout.decode("utf-8", "replace") if out.returncode == 0 else None
