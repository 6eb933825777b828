"""Connected components by repeated contraction, entirely in DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import Tables

#: Links that one task solves at once.
ONE_TASK = 1 << 14


def forest(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of links among 0..n-1, one link (node, smallest node of its component) per linked node."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            break
    nodes = np.flatnonzero(label != np.arange(n))
    return nodes, label[nodes]


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links -> (node, root): root is the same for all nodes that links connect.

    While there are over ONE_TASK links, every round maps each node to its smallest neighbour and on to the
    end of that chain, rewrites the links between the ends and drops repeats: at least half the linked nodes
    go in each round. What is left is solved by union-find in one task. Nothing but row counts comes to the
    driver. Nodes without links have no row; an empty input gives no rows; links of a node to itself and
    repeated links change nothing. Each step is a table in the checkpoint folder (the planner's sizes would
    multiply from join to join otherwise); all but the result's go.
    """
    with Tables(edges.sparkSession) as made:
        links = made.table(edges.select("u", "v").where("u <> v").distinct())
        roots = None
        while True:
            last = links.count() <= ONE_TASK
            hop = made.table(solved(links)) if last else contracted(links, made)
            if roots is None:
                roots = hop
            else:
                moved = hop.select(F.col("node").alias("root"), F.col("root").alias("next"))
                roots = made.table(roots.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
            if last:
                return made.keep(roots)
            a = hop.select(F.col("node").alias("u"), F.col("root").alias("ru"))
            b = hop.select(F.col("node").alias("v"), F.col("root").alias("rv"))
            links = links.join(a, "u").join(b, "v").where("ru <> rv")
            links = made.table(links.select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct())


def contracted(links: DataFrame, made: Tables) -> DataFrame:
    """(node, root): every linked node and the end of its chain of smallest neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = made.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    hop = low.select(F.col("u").alias("node"), F.col("m").alias("root"))
    while True:  # follow to the end: doubling, so a chain takes the logarithm of its length
        onto = hop.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = F.col("next") != F.col("root")
        far = made.table(hop.join(onto, "root").select("node", F.col("next").alias("root"), moved.alias("moved")))
        hop = far.select("node", "root")
        if far.where("moved").isEmpty():
            return hop


def solved(links: DataFrame) -> DataFrame:
    """(node, root) of all linked nodes, in one task; for at most ONE_TASK links."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        pairs = pa.Table.from_batches(held)
        ends = pa.chunked_array([*pairs.column("u").chunks, *pairs.column("v").chunks])
        names = pc.unique(ends)
        names = names.take(pc.sort_indices(names))
        at = pc.index_in(ends, names).to_numpy()
        node, root = forest(at[: len(pairs)], at[len(pairs) :], len(names))
        label = np.arange(len(names))
        label[node] = root
        yield pa.record_batch([names, names.take(pa.array(label))], ["node", "root"])

    kind = links.schema["u"].dataType.simpleString()
    return links.coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")
