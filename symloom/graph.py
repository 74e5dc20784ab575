"""A property graph of source code as two DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import EDGES, NODES, SCHEMA_VERSION, compare_versions

if TYPE_CHECKING:
    from .operators.numbered import Calls


@dataclass(frozen=True)
class CodeGraph:
    """``nodes`` and ``edges``; ``ord`` of a node, where present, is its order of input."""

    nodes: DataFrame
    edges: DataFrame

    def of_kind(self, *kinds: str) -> DataFrame:
        return self.edges.filter(F.col("kind").isin(*kinds))

    def call_pairs(self, name_hash: Callable[[str], Column]) -> DataFrame:
        """(a, b): hashes of caller and callee of each call; a pair may come again."""
        return self.of_kind("CALLS").select(name_hash("source_qualified").alias("a"), name_hash("target_qualified").alias("b"))

    def numbered_calls(self, name_hash: Callable[[str], Column]) -> Calls | None:
        """All calls between numbered nodes, where a graph can give them; then IMPORTS link names of files only."""
        return None

    def known(self) -> DataFrame:
        """One node for each qualified name: of several the last one read."""
        if "ord" not in self.nodes.columns:
            return self.nodes.dropDuplicates(["qualified_name"])
        # Combined map-side, unlike a sort of whole nodes; columns that a caller does not read are pruned from the struct.
        rest = [c for c in self.nodes.columns if c != "qualified_name"]
        last = self.nodes.groupBy("qualified_name").agg(F.max_by(F.struct(*rest), "ord").alias("_n"))
        return last.select(*(F.col("qualified_name") if c == "qualified_name" else F.col(f"_n.{c}").alias(c) for c in self.nodes.columns))

    def save(self, path: str) -> None:
        """Edges by kind, so that an operator reads the kinds it needs."""
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/edges")

    @staticmethod
    def load(spark: SparkSession, path: str) -> CodeGraph:
        return CodeGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))

    @staticmethod
    def load_json(spark: SparkSession, path: str) -> CodeGraph:
        """Reads ``{metadata, nodes, edges}``; all fields are kept, unknown ones dropped, a newer major version refused."""
        from pyspark.sql import types as T

        whole = T.StructType().add("metadata", T.StructType().add("schema_version", T.StringType())).add("sha", T.StringType()).add("nodes", T.ArrayType(NODES)).add("edges", T.ArrayType(EDGES))
        raw = spark.read.schema(whole).option("multiLine", True).json(path)
        version = raw.select("metadata.schema_version").first()
        if compare_versions(version[0] if version else None) == "newer":
            raise ValueError(f"graph schema {version[0]} is newer than {SCHEMA_VERSION}")
        nodes = raw.select(F.posexplode("nodes").alias("ord", "n")).select("n.*", F.col("ord").cast("long"))
        return CodeGraph(nodes, raw.select(F.inline("edges")))

    def save_json(self, path: str, metadata: dict | None = None) -> None:
        """One document, one object a line, streamed from the partitions."""
        import json

        with open(path, "w", encoding="utf-8") as out:
            out.write('{"metadata":' + json.dumps({"schema_version": SCHEMA_VERSION} | (metadata or {})))
            for name, rows in (("nodes", self.nodes.drop("ord")), ("edges", self.edges)):
                out.write(f',\n"{name}":[')
                for k, row in enumerate(rows.toJSON().toLocalIterator()):
                    out.write((",\n" if k else "\n") + row)
                out.write("\n]")
            out.write("}\n")


def file_of(qualified: str | Column) -> Column:
    """What stands before the first ``::``."""
    return F.split(F.col(qualified) if isinstance(qualified, str) else qualified, "::")[0]


def short_name(qualified: str | Column) -> Column:
    return F.element_at(F.split(F.col(qualified) if isinstance(qualified, str) else qualified, "::"), -1)


def round2(value: Column) -> Column:
    """Half up, as on the other side of every comparison."""
    return F.floor(value * 100 + F.lit(0.5)) / F.lit(100.0)
