"""Connected components of an edge table: forests of blocks of edges of
bounded size, then rounds of smallest labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .encoding import tidy

EDGE_BLOCK = 1_000_000  # edges whose forest is made at once


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of the nodes that reach a smaller one."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        hooked = root.copy()
        np.minimum.at(hooked, root[x], low)
        np.minimum.at(hooked, root[y], low)
        while (hooked[hooked] != hooked).any():
            hooked = hooked[hooked]
        if (hooked == root).all():
            below = root != np.arange(len(ids))
            return ids[below], ids[root[below]]
        root = hooked


def _forests(batches):
    held, rows = [], 0

    def made():
        a, b = (np.concatenate([x[c].to_numpy() for x in held]) for c in ("a", "b"))
        node, low = forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(low, pa.int64())], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= EDGE_BLOCK:
            yield made()
            held, rows = [], 0
    if rows:
        yield made()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) of every node that an edge of ``edges`` (a, b: long) joins
    to another: ``comp`` is the smallest node reachable. The edges are dealt
    into blocks of about ``EDGE_BLOCK``, whatever tasks they lie in, and each
    block becomes stars, so few rounds are left. Every round takes
    the smallest label among a node's neighbours (pre-aggregated, so a hub's
    edges are combined before they are shuffled) and then the label's own
    label, so long chains need a logarithm of their length; rounds end when no
    label changes. Each round's labels are a written table."""
    edges = edges.select("a", "b").where("a != b")
    blocks = -(-edges.count() // EDGE_BLOCK) or 1
    edges = edges.repartition(blocks).mapInArrow(tidy(_forests), "a long, b long")
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct()
    both = scratch.table(both, f"{name}-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))
    labels = scratch.table(labels.withColumn("comp", F.least("node", "comp")), f"{name}-0")
    k = 0
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        stepped = labels.join(near, "node").select("node", F.least("comp", "near").alias("up"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("up"), F.col("comp").alias("top"))
        new = stepped.join(jump, "up").select("node", F.least("up", "top").alias("comp"), (F.least("up", "top") != F.col("old")).alias("moved"))
        new = scratch.table(new, f"{name}-{k + 1}")
        scratch.drop(f"{name}-{k}")
        k += 1
        labels = new.select("node", "comp")
        if new.where("moved").isEmpty():
            scratch.drop(f"{name}-edges")
            return labels
