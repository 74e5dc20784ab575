"""Keeping a graph up to date from a stream of changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..graph import CodeGraph
from ..plans.build import graph_of_files
from ..operators.changes import merge
from ..sources.noise import noise_table


def follow(spark: SparkSession, files: DataFrame, path: str, checkpoint: str, manifest: dict | None = None) -> StreamingQuery:
    """``files``: a stream of (file_path, language, content, file_hash). Each batch replaces what the graph at ``path`` has of its files.

    A batch writes the next version beside the last one and then names it, so
    a batch that is run again after a failure gives the same graph.
    """

    def step(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("file_path").agg(F.max_by(F.struct("language", "content", "file_hash"), "file_hash").alias("f")).select("file_path", "f.*")
        latest = latest.persist()
        try:
            before = current(spark, path)
            local = graph_of_files(latest, manifest, before, noise_table(spark))
            after = merge(before, local, latest.select("file_path")) if before is not None else local
            after.save(f"{path}/v{number:012d}")
            spark.createDataFrame([(number,)], "version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/current")
        finally:
            latest.unpersist()

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> CodeGraph | None:
    from pyspark.errors import AnalysisException

    try:
        number = spark.read.parquet(f"{path}/current").first()[0]
    except AnalysisException:
        return None
    return CodeGraph.load(spark, f"{path}/v{number:012d}")


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums of events by type and window, closed by a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
