"""Connected components of an undirected graph, by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.operators.staging import importable, salted_join, staged

#: Edges (two longs each) up to which a graph is finished in one task; larger graphs are contracted first.
ONE_TASK = 1 << 20


def _follow(hook: DataFrame, beyond: DataFrame) -> DataFrame:
    """hook (node, to) with `to` sent on through beyond (node, to) where that has it; hot targets are salted."""
    ends = hook.groupBy("to").agg(F.count(F.lit(1)).alias("size")).join(beyond.select(F.col("node").alias("to"), F.col("to").alias("end")), "to", "left")
    return salted_join(hook, ends.select("to", F.coalesce("end", "to").alias("end"), "size"), ["to"], "size", F.col("node")).select("node", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved"))


def lowest_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), and of each the smallest node that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        for side in (x, y):
            np.minimum.at(label, label[side], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[label]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, to) of a graph of at most ONE_TASK edges of longs."""
    importable(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches if x.num_rows]
        if held:
            nodes, to = lowest_labels(*(np.concatenate(side) for side in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(to)], ["node", "to"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, to long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """The component of each node that has an edge: columns node, component (the smallest node of it).

    Each round hooks every node to the smallest of itself and its neighbours, follows the hooks to their ends by
    pointer doubling, and contracts the edges; at least half of the nodes that still have edges disappear, so there
    are at most log2(nodes) rounds. Once no more than `one_task` edges of longs are left (counted, 16 MB), one task
    finishes the graph. Hubs are safe: minima combine before the shuffle, and joins salt hot nodes. Each round's tables
    are staged; only counts of rows come to the driver. A self-loop gives a node its own component; edges with a null
    end are dropped; repeated edges change nothing.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    live = staged(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    nodes = live.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    live = live.where("a <> b")
    small = live.schema["a"].dataType.typeName() == "long"
    rounds: list[DataFrame] = []
    while left := live.count():
        if small and left <= one_task:
            rounds.append(staged(_in_one_task(live), "cc-hooks"))
            break
        both = live.union(live.select("b", "a"))
        near = staged(both.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("degree")).select(F.col("a").alias("node"), F.least("a", "low").alias("to"), "degree"), "cc-hooks")
        hook = near.select("node", "to")
        while True:
            step = staged(_follow(hook, hook), "cc-hooks")
            hook = step.select("node", "to")
            if step.where("moved").isEmpty():
                break
        rounds.append(hook)
        sized = hook.join(near.select("node", "degree"), "node")
        half = salted_join(live, sized.select(F.col("node").alias("a"), F.col("to").alias("ta"), "degree"), ["a"], "degree", F.col("b")).drop("degree")
        done = salted_join(half, sized.select(F.col("node").alias("b"), F.col("to").alias("tb"), "degree"), ["b"], "degree", F.col("a"))
        live = staged(done.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "cc-edges")
    if not rounds:
        return nodes.select("node", F.col("node").alias("component"))
    root = rounds.pop()
    while rounds:
        root = staged(_follow(rounds.pop(), root).select("node", "to"), "cc-roots")
    return nodes.join(root, "node", "left").select("node", F.coalesce("to", "node").alias("component"))
