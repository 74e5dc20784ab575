"""Connected components of a link table: forests where it is small, else minimum labels with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash

#: Links up to which one task may hold the forest of all (16 bytes each); a larger table goes by rounds of joins.
FOREST_LINKS = 2_000_000


def _forest(links: np.ndarray) -> np.ndarray:
    """(node, smallest node linked to it) of (n, 2) links, for every node of them."""
    nodes, at = np.unique(links, return_inverse=True)
    at = at.reshape(-1, 2)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[at[:, 0]], label[at[:, 1]])
        new = label.copy()
        np.minimum.at(new, at[:, 0], low)
        np.minimum.at(new, at[:, 1], low)
        np.minimum.at(new, label[at[:, 0]], low)
        np.minimum.at(new, label[at[:, 1]], low)
        new = new[new]
        if (new == label).all():
            return np.stack([nodes, nodes[label]], 1)
        label = new


def _in_forests(links: DataFrame) -> DataFrame:
    """Every task replaces its links by a forest of them; one task joins the forests, which are no longer than the links."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches if b.num_rows]
        if held:
            out = _forest(np.concatenate(held))
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0], pa.int64()), pa.array(out[:, 1], pa.int64())], ["node", "component"])

    shape = "node long, component long"
    return stash(links.mapInArrow(reduce, shape).repartition(1).mapInArrow(reduce, shape))


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for each node of ``links``.

    Every round takes the smallest label of a node's neighbours (combined
    map-side) and then the label of its label, so that long chains shrink
    fast. Labels are written each round; nothing is collected but a count.
    """
    links = stash(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")))
    if links.count() <= FOREST_LINKS:
        return _in_forests(links)
    a, b = "a", "b"
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(links.select(F.col(b), F.col(a))).distinct()
    both = stash(both)
    labels = stash(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("m"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        lower = stash(lower)
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = stash(lower.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")))
        if labels.filter("label <> old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.drop("old")
