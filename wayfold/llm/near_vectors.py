"""Embedding near-dedup by counting collisions of one-dimensional projections.

Each of many trials draws two families of random directions and one more direction. A vector enters the sorted list of
the two directions, one of each family, on which its projections are most extreme, and lies there at its projection on
the third. Around every vector of a list a window is centred; a vector inside it is a collision of the pair. The
number of trials, and the collisions from which a pair is verified in double precision, are calibrated on simulated
pairs that lie exactly at the threshold. With more vectors the lists get a third and a fourth family, so lists stay short.

Equal vectors are taken together first, so a vector that a third of all rows share counts as one. Lists with many
members are split in blocks of pairs of blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different length do not link; repeated rows are copies of each other; a null id is kept and never the smallest; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import mix64, stage
from wayfold.llm.graph import connected_components

#: Directions of a family; half the width of a window, as projections on a direction of standard normal components.
DIRECTIONS, WINDOW = 128, 0.8
#: Share of the pairs at the threshold that must pass the count, by calibration.
RECALL = 0.995
#: Members of a list that one task pairs with each other.
BLOCK = 4096
_LISTED = "cell long, at double, vec_id long"


def _directions(trial: int, families: int, dim: int) -> np.ndarray:
    return np.random.default_rng([20_240_101, trial, dim]).standard_normal((dim, families * DIRECTIONS + 1))


def _lists(unit: np.ndarray, trial: int, families: int) -> tuple[np.ndarray, np.ndarray]:
    """The list of each vector in a trial, and its place there."""
    dim = unit.shape[1]
    shadow = unit @ _directions(trial, families, dim)
    cell = np.full(len(unit), (trial << 20) + dim, np.uint64)
    for family in range(families):
        own = shadow[:, family * DIRECTIONS : (family + 1) * DIRECTIONS]
        far = np.abs(own).argmax(1)
        side = (own[np.arange(len(own)), far] > 0).astype(np.uint64)
        cell = mix64(cell * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2) * far.astype(np.uint64) + side)
    return cell.astype(np.int64), shadow[:, -1]


def calibrate(dim: int, families: int, cosine: float, recall: float = RECALL, pairs: int = 4_000) -> tuple[int, int]:
    """(trials, least count): the fewest trials for which two collisions at least reach ``recall`` at the threshold.

    The chance that a pair collides is measured on simulated pairs of exactly this cosine.
    """
    rng = np.random.default_rng(7)
    u = rng.standard_normal((pairs, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = rng.standard_normal((pairs, dim))
    v -= (v * u).sum(1, keepdims=True) * u
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    v = cosine * u + math.sqrt(1 - cosine * cosine) * v
    hits = 0
    for trial in range(8):
        (cell_u, at_u), (cell_v, at_v) = _lists(u, trial, families), _lists(v, trial, families)
        hits += np.count_nonzero((cell_u == cell_v) & (np.abs(at_u - at_v) <= WINDOW))
    p = hits / (8 * pairs)
    if p < 1e-3:
        raise ValueError(f"{families} families of directions are too many for vectors of {dim} components")
    trials = 8
    while 1 - (1 - p) ** trials - trials * p * (1 - p) ** (trials - 1) < recall:
        trials += 1
    return trials, 2


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = values.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(1, keepdims=True)  # so that no square overflows or vanishes
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    lengths = np.diff(batch.column(column).offsets.to_numpy())
    for n in np.unique(lengths):
        yield batch.filter(pa.array(lengths == n))


def _listed(trials: int, families: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in _by_length(batch, 1):
                unit = _matrix(own.column(1))
                for trial in range(trials):
                    cell, at = _lists(unit, trial, families)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(at), own.column(0)], names=["cell", "at", "vec_id"])

    return run


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The collisions of each list, counted over the lists of the task. Columns: cell, unit, block, at, vec_id."""
    held = [[b.column(i).to_numpy() for i in range(5)] for b in batches if b.num_rows]
    if not held:
        return
    cell, unit, block, at, vec = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((vec, at, unit, cell))
    cell, unit, block, at, vec = cell[order], unit[order], block[order], at[order], vec[order]
    bounds = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (unit[1:] != unit[:-1]), [True]]))
    ends = np.empty(len(vec), np.int64)  # of the window right of each vector
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        ends[a:b] = a + np.searchsorted(at[a:b], at[a:b] + WINDOW, side="right") if b - a > 1 else b
    many = ends - np.arange(len(vec)) - 1
    found, size = [], 0
    total = np.cumsum(many)
    start = 0
    while start < len(vec):
        base = int(total[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + 1_000_000, side="right")))
        own = many[start:stop]
        left = np.repeat(np.arange(start, stop), own)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(own) - own, own)
        ok = (unit[left] % 2 == 0) | (block[left] != block[right])
        a, b = vec[left[ok]], vec[right[ok]]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
        size += found[-1].shape[1]
        if size > 2_000_000:
            yield _counted(found)
            found, size = [], 0
        start = stop
    if size:
        yield _counted(found)


def _counted(found: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(found, 1)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True]]))
    return pa.RecordBatch.from_arrays([pa.array(a[at[:-1]]), pa.array(b[at[:-1]]), pa.array(np.diff(at))], names=["a", "b", "n"])


def _close(cosine: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in _by_length(batch, 2):
                near = (_matrix(own.column(2)) * _matrix(own.column(3))).sum(1) >= cosine
                yield own.filter(pa.array(near)).select(["a", "b"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept (vec_id = component_id)."""
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("v", lambda x: x != 0)
    usable = F.coalesce((F.size("v") > 0) & ~bad & ~zero, F.lit(False))
    hashed = plain.select("vec_id", "v", F.when(usable, F.xxhash64("v")).alias("h1"), F.when(usable, F.hash("v")).alias("h2"))
    reps = hashed.where("h1 is not null and vec_id is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    reps = stage(reps, "vectors-reps")
    shape = reps.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    # Lists hold a handful of unrelated vectors: another family for each factor of 2 * DIRECTIONS in the input.
    families = max(2, math.ceil(math.log(max(2, shape["n"] / 16), 2 * DIRECTIONS)))
    trials, least = calibrate(shape["dim"] or 2, families, cosine)

    listed = reps.select("rep", "v").mapInArrow(_listed(trials, families), _LISTED)
    listed = stage(listed.repartition("cell"), "vectors-lists")
    large = stage(listed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks")).where("blocks > 1"), "vectors-large")
    if large.isEmpty():
        units = listed.select("cell", F.lit(0).cast("long").alias("unit"), F.lit(0).cast("long").alias("block"), "at", "vec_id")
    else:
        own = listed.join(large, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        own = own.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        low, high = F.least("block", "other"), F.greatest("block", "other")
        units = own.select("cell", (2 * (low * F.col("blocks") + high) + (low != high).cast("long")).alias("unit"), "block", "at", "vec_id")
    hits = units.repartition("cell", "unit").mapInArrow(_windows, "a long, b long, n long")
    pairs = hits.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    ends = [reps.select(F.col("rep").alias(end), F.col("v").alias(f"v_{end}")) for end in ("a", "b")]
    tried = pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "v_a", "v_b")
    links = stage(tried.mapInArrow(_close(cosine), "a long, b long"), "vectors-links")

    sizes = reps.select(F.col("rep").alias("b"), "copies")
    both = links.union(links.select("b", "a"))
    degrees = both.join(sizes, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("linked"))
    comps = connected_components(links, "vectors").withColumnRenamed("node", "rep")
    facts = reps.select("h1", "h2", "rep", "copies").join(degrees, "rep", "left").join(comps, "rep", "left")
    facts = facts.select("h1", "h2", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = hashed.where("h1 is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = hashed.where("h1 is not null and vec_id is not null").select("vec_id", "h1", "h2").join(facts, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
