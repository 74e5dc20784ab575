"""Schemas of the property graph and of what extraction stages."""

from __future__ import annotations

from pyspark.sql import types as T

NODE_KINDS = ("Function", "Method", "Constructor", "Class", "Interface", "Enum", "Test")
EDGE_KINDS = ("CALLS", "IMPORTS", "INHERITS", "IMPLEMENTS", "TESTED_BY", "CONTAINS", "USES_TYPE")
TIERS = ("receiver", "di", "same", "import", "unique", "ambiguous")
SCHEMA_VERSION = "2.1"
DEFAULT_DEPTH, DEFAULT_CONFIDENCE = 3, 0.5


def _struct(spec: str) -> T.StructType:
    """``name type`` pairs; ``!`` marks a column that is never null."""
    out = T.StructType()
    for part in spec.split(","):
        name, kind = part.split()
        required = kind.endswith("!")
        types = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "strings": T.ArrayType(T.StringType())}
        out.add(name, types[kind.rstrip("!")], not required)
    return out


NODES = _struct(
    "kind string!, ast_kind string, name string!, qualified_name string!, file_path string!, line_start int!, line_end int!, language string!,"
    "parent_name string, params string, return_type string, modifiers string, is_test boolean!, file_hash string, content_hash string,"
    "is_exported boolean, is_async boolean, decorators strings, throws strings, complexity int"
)
EDGES = _struct("kind string!, source_qualified string!, target_qualified string!, file_path string!, line int!, confidence double, tier string, alternatives strings")
CALL_SITES = _struct("source string!, call_name string!, line int!, column int, di_field string, di_class string, resolve_in_class string, receiver_type string, chained_from_line int, chained_from_column int, ord long!")
IMPORTS = _struct("file string!, module string!, line int!, names strings, lang string!, ord long!")
RE_EXPORTS = _struct("file string!, module string!, line int!")
DI_BINDINGS = _struct("file string!, class_name string, field string!, type string!")
VALUE_BINDINGS = _struct("file string!, name string!, type string!")
HUNKS = _struct("file string!, new_start int!, new_count int!")
SYMBOLS = _struct("file string!, name string!, qualified string!, kind string!, ord long!")

#: Per language: async, decorators, exceptions, static types, kind of interface (fixed values).
CAPABILITIES = [
    ("typescript", True, True, True, True, "structural"),
    ("tsx", True, True, True, True, "structural"),
    ("javascript", True, True, True, False, "structural"),
    ("python", True, True, True, False, "duck"),
    ("ruby", False, False, True, False, "duck"),
    ("go", False, False, False, True, "structural"),
    ("java", True, True, True, True, "nominal"),
    ("kotlin", True, True, True, True, "nominal"),
    ("csharp", True, True, True, True, "nominal"),
    ("swift", True, True, True, True, "nominal"),
    ("dart", True, True, True, True, "nominal"),
    ("scala", True, True, True, True, "structural"),
    ("rust", True, True, False, True, "nominal"),
    ("php", False, True, True, False, "nominal"),
    ("c", False, False, False, True, "nominal"),
    ("cpp", False, False, True, True, "nominal"),
    ("elixir", False, True, False, False, "duck"),
    ("bash", False, False, False, False, "duck"),
]
CAPABILITY_SCHEMA = "language string, has_async boolean, has_decorators boolean, has_exceptions boolean, has_static_types boolean, interface_kind string"


def compare_versions(found: str | None, current: str = SCHEMA_VERSION) -> str:
    """``ok``, ``newer`` (refused), ``older`` or ``missing`` (both read with a warning)."""
    if not found:
        return "missing"
    a, b = (int(v.split(".")[0]) for v in (found, current))
    return "newer" if a > b else "older" if a < b else "ok"
