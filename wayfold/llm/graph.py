"""Connected components over links, as joins and grouped minima; no task ever holds the whole graph."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import stage

#: Links that a task contracts at a time.
LINKS = 500_000


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links that a task sees by stars around the smallest node of each local component."""
    held, size = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        size += batch.num_rows
        if size >= LINKS:
            yield _stars(np.concatenate(held, 1))
            held, size = [], 0
    if held:
        yield _stars(np.concatenate(held, 1))


def _stars(links: np.ndarray) -> pa.RecordBatch:
    nodes, flat = np.unique(links, return_inverse=True)
    a, b = flat.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    away = label != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[away]), pa.array(nodes[label[away]])], names=["a", "b"])


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``links`` (two bigint columns a, b): component is its smallest node.

    Each round contracts links inside tasks, hooks every node to its smallest neighbour, follows the pointers and
    keeps the links between what is left; pointers only lead to smaller nodes, so roots are the smallest of theirs.
    Null ends and loops are ignored.
    """
    current = stage(links.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long"), f"{name}-links")
    maps: list[DataFrame] = []
    while not current.isEmpty():
        both = current.union(current.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        hooks = hooks.select("node", F.least("node", "to").alias("to"))
        jump = hooks.select(F.col("node").alias("to"), F.col("to").alias("next"))
        hooks = stage(hooks.join(jump, "to").select("node", F.col("next").alias("to")), f"{name}-hooks")
        maps.append(hooks)
        ends = [hooks.select(F.col("node").alias(end), F.col("to").alias(f"{end}2")) for end in ("a", "b")]
        left = current.join(ends[0], "a").join(ends[1], "b").where("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        current = stage(left.distinct().mapInArrow(_forest, "a long, b long"), f"{name}-links")
    if not maps:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0].select("node", F.col("to").alias("component"))
    for hooks in maps[1:]:
        step = hooks.select(F.col("node").alias("component"), F.col("to").alias("further"))
        out = out.join(step, "component", "left").select("node", F.coalesce("further", "component").alias("component"))
    return stage(out, f"{name}-labels") if len(maps) > 1 else out
