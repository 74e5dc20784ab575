"""Column functions of the graph: signatures, names, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_params(c: Column | str) -> Column:
    """White space collapsed, none inside brackets or before them, no trailing comma, marks of unused names dropped.

    Fixed values: a mark is one underscore before a letter, behind an opening bracket or a comma; white space between goes too.
    """
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(c, r"\s+", " ")
    c = F.regexp_replace(c, r"([({\[,])\s*_([a-zA-Z])", "$1$2")
    c = F.regexp_replace(c, r",\s*([)}\]])", "$1")
    c = F.regexp_replace(c, r"([({\[])\s+", "$1")
    return F.trim(F.regexp_replace(c, r"\s+([)}\]])", "$1"))


def normalize_return(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(c, r"\s+", " ")
    c = F.regexp_replace(c, r"([(<\[{])\s+", "$1")
    return F.trim(F.regexp_replace(c, r"\s+([)>\]}])", "$1"))


def identifiers(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.col(c) if isinstance(c, str) else c, F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)))


#: Marks of test files, taken off one after the other.
TEST_MARKS = (r"_spec$", r"_test$", r"^test_", r"\.test$", r"\.spec$", r"-test$", r"-spec$", r"^spec_", r"Test$", r"Spec$")


def file_stem(path: Column | str) -> Column:
    name = F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def test_stem(path: Column | str) -> Column:
    """Stem of the file that a test file tests; null where the name holds no mark of a test."""
    stem = file_stem(path)
    out = stem
    for mark in TEST_MARKS:
        out = F.regexp_replace(out, mark, "")
    return F.when((out != stem) & (out != ""), out)


def camel_to_snake(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(c, r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2"))


def content_hash(c: Column | str) -> Column:
    return F.sha2((F.col(c) if isinstance(c, str) else c).cast("binary"), 256)


def signature(name: str = "name", params: str = "params", result: str = "return_type") -> Column:
    return F.concat(F.col(name), F.coalesce(F.col(params), F.lit("()")), F.when(F.col(result).isNotNull(), F.concat(F.lit(": "), F.col(result))).otherwise(""))


def tokenize_top_level(text: str) -> list[str]:
    """Parts of a parameter list at commas outside brackets; driver side, for rendering."""
    out, depth, part = [], 0, []
    inner = text.strip()
    if inner[:1] == "(" and inner[-1:] == ")":
        inner = inner[1:-1]
    for c in inner:
        depth += c in "([{<"
        depth -= c in ")]}>"
        if c == "," and depth == 0:
            out.append("".join(part).strip())
            part = []
        else:
            part.append(c)
    last = "".join(part).strip()
    return [p for p in [*out, last] if p]


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of leading path parts that two paths share."""
    pairs = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    return F.aggregate(pairs, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, same: F.struct((s["on"] & same).alias("on"), (s["n"] + (s["on"] & same).cast("int")).alias("n")))["n"]


def directory(path: Column | str) -> Column:
    return F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"^(.*)/[^/]*$", 1)
