"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the bytes and words of the whole text alone. The trees are grown on quantile histograms from a
bounded sample of labelled rows (``SAMPLE``, a parameter: the rows with the smallest hashes of their ids), then laid out
as flat arrays: children of node i are 2 i + 1 and 2 i + 2, so numpy walks all trees over a batch at once.

Defined results: null text is empty and is scored like any text; labels that are null do not count, and a document with
several labels takes their rounded mean; without labels every score is 0.5; repeated rows are scored alike; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import id_text, pieces_of, utf8
from wayfold.llm.shingles import hash_sums, inverse_powers, word_hashes

#: Labelled rows that the trees are grown on, at most.
SAMPLE = 20_000
FEATURES = (
    "log_bytes", "log_words", "letters", "upper", "digits", "blank", "other_bytes", "stops", "commas", "signs", "marks",
    "bars", "word_length", "word_spread", "longest_word", "lines_per_word", "line_length", "repeated_lines",
    "distinct_words", "distinct_pairs", "next_repeats", "upper_of_letters", "signs_per_word", "marks_per_word",
)
#: Classes of bytes: 0 other signs, 1 upper, 2 lower, 3 digit, 4 space, 5 line feed, 6 beyond ASCII, 7 stops, 8 commas, 9 bars, 10 exclamation and question marks.
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
_CLASS[128:] = 6
_CLASS[ord(".")] = 7
_CLASS[ord(",")] = 8
_CLASS[ord("|")] = 9
_CLASS[[ord("!"), ord("?")]] = 10


def _distinct(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((values, rows))
    r, v = rows[order], values[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return np.bincount(r[new], minlength=n)


def _lengths(stop: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs that end at ``stop``; a closing blank does not count."""
    start = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
    return start, stop - start + ~blank


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    n, size = len(offs) - 1, np.diff(offs)
    row = np.repeat(np.arange(n), size)
    kind = np.bincount(row * 11 + _CLASS[data], minlength=11 * n).reshape(n, 11).astype(float)
    words, at = word_hashes(data, offs)
    count = np.bincount(at, minlength=n)
    w, b = np.maximum(count, 1), np.maximum(size, 1)
    blank = kind[:, 4] + kind[:, 5]
    letters = kind[:, 1] + kind[:, 2] + kind[:, 6]
    last = np.zeros(len(data) + 1, bool)
    last[offs] = True  # a byte is the last of its row if the next place starts one
    stop = np.flatnonzero(((_CLASS[data] == 4) | (_CLASS[data] == 5)) | last[1:])
    length = _lengths(stop, _CLASS[data[stop]] // 2 == 2)[1]
    mean = (size - blank) / w
    square = np.bincount(row[stop], weights=length.astype(float) ** 2, minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, row[stop], length)
    # Lines: their number, and the share that stood before in the same text.
    lines = kind[:, 5] + 1
    stop = np.flatnonzero((data == 10) | last[1:])
    start, length = _lengths(stop, data[stop] == 10)
    sums = hash_sums(data)
    line = (sums[start + length] - sums[start]) * inverse_powers(len(data))[start] + length.astype(np.uint64)
    repeated = 1 - _distinct(row[stop], line, n) / np.maximum(np.bincount(row[stop], minlength=n), 1)
    pair = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
    same = at[:-1] == at[1:]
    pairs = np.maximum(np.bincount(at[:-1][same], minlength=n), 1)
    again = np.bincount(at[:-1][same & (words[:-1] == words[1:])], minlength=n)
    return np.stack(
        [
            np.log1p(size), np.log1p(count), letters / b, kind[:, 1] / b, kind[:, 3] / b, blank / b, kind[:, 6] / b,
            kind[:, 7] / w, kind[:, 8] / w, kind[:, 0] / b, kind[:, 10] / b, kind[:, 9] / w, mean,
            np.sqrt(np.maximum(square / w - mean**2, 0)), np.log1p(longest), lines / w, np.log1p(size / lines), repeated,
            _distinct(at, words, n) / w, _distinct(at[:-1][same], pair[same], n) / pairs, again / pairs,
            kind[:, 1] / np.maximum(letters, 1), kind[:, 0] / w, kind[:, 10] / w,
        ],
        1,
    )


@dataclass
class FlatTrees:
    """Complete binary trees of one depth as arrays of shape (trees, nodes); ``prior`` is the log-odds to start from."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: every tree is walked level by level, all rows and trees at once."""
        trees, rows = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(trees)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        total = self.prior + self.value[trees, node - (1 << self.depth) + 1].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, penalty: float = 1.0) -> FlatTrees:
    """Gradient boosting on the logistic loss over histograms of quantile bins."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if len(y) == 0:
        return FlatTrees(feature, threshold, value, depth, 0.0)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    prior = float(np.log(share / (1 - share)))
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], 1)
    total = np.full(len(y), prior)
    offset = np.arange(width) * bins
    for tree in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, bend = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            start, nodes = (1 << level) - 1, 1 << level
            cell = ((node - start)[:, None] * (width * bins) + offset + binned).ravel()
            shape = (nodes, width, bins)
            g = np.bincount(cell, np.repeat(slope, width), nodes * width * bins).reshape(shape).cumsum(2)
            h = np.bincount(cell, np.repeat(bend, width), nodes * width * bins).reshape(shape).cumsum(2)
            gain = g**2 / (h + penalty) + (g[..., -1:] - g) ** 2 / (h[..., -1:] - h + penalty) - g[..., -1:] ** 2 / (h[..., -1:] + penalty)
            gain[(h < 2) | (h[..., -1:] - h < 2)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for k in range(nodes):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[tree, start + k], threshold[tree, start + k] = f, edges[f][b]
            go = x[np.arange(len(y)), feature[tree, node]] > threshold[tree, node]
            node = 2 * node + 1 + go
        leaf = node - inner
        g, h = np.bincount(leaf, slope, leaves), np.bincount(leaf, bend, leaves)
        value[tree] = -rate * g / (h + penalty)
        total += value[tree, leaf]
    return FlatTrees(feature, threshold, value, depth, prior)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that no label is learnt from: crc32 of the id as text, modulo 3, is 1. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def _measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of(batches):
        x = statistics(*utf8(batch.column(1)))
        listed = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), listed], names=["doc_id", "x"])


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE) -> FlatTrees:
    """Grow the trees on at most ``sample`` labelled documents outside the held-out fold."""
    known = labels.where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg(label_col)).alias("y"))
    known = known.where("y is not null and doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = id_text(docs).join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi").mapInArrow(_measured, "doc_id long, x array<double>")
    found = rows.join(F.broadcast(known), "doc_id").orderBy("doc_id").limit(2 * sample).toPandas()
    x = np.array(found["x"].tolist(), float).reshape(len(found), len(FEATURES))
    return grow(x, found["y"].to_numpy(float))


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    trees = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, label_col, sample))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            score = trees.value.score(statistics(*utf8(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    scored = id_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
