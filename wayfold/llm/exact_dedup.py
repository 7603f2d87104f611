"""Exact dedup with Patricia-trie owners.

Texts are equal when they are identical after deleting the characters ``[\\x20\\x09-\\x0D]``. Each map task first folds
its own copies in a small trie, so a text that a third of all rows share reaches the shuffle once per task. The folded
strings are partitioned by (length, content hash); each partition inserts the full byte strings into a compressed radix
trie whose terminal nodes hold the owner. A trie that outgrows its memory writes its largest subtree to a task-local
file and takes that subtree up again afterwards.

Defined results: null text is empty text, and empty texts are one group; a null id comes after all others; repeated
rows count as copies; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import BLANKS, id_text, pieces_of, utf8

#: Bytes of labels that a trie keeps in memory before it spills (reduce side) or is emitted (map side).
TRIE_BYTES = 48 << 20
_FOLDED = "n_bytes int, h long, body binary, best_len long, best_id long, copies long"


def _better(a: list, b: list) -> list:
    """The owner of two equal strings: most code points, then smallest id (null last); copies add up."""
    first = (-a[0], a[1] is None, a[1] or 0) <= (-b[0], b[1] is None, b[1] or 0)
    own = a if first else b
    return [own[0], own[1], a[2] + b[2]]


class PatriciaTrie:
    """A compressed radix trie over byte strings. A node is [label, children by first byte, owner]; a spilled subtree is [b"", None, file]."""

    def __init__(self, most_bytes: int = TRIE_BYTES):
        self.root: list = [b"", {}, None]
        self.most_bytes, self.size, self.files = most_bytes, 0, []

    def insert(self, key: bytes, owner: list) -> None:
        node, at, n = self.root, 0, len(key)
        while at < n:
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, owner]
                self._grown(n - at)
                return
            if child[1] is None:
                pickle.dump((key, owner), child[2])
                return
            label = child[0]
            if not key.startswith(label, at):
                cut = _shared(label, key, at)
                middle = [label[:cut], {label[cut]: child}, None]
                child[0] = label[cut:]
                node[1][key[at]] = middle
                node, at = middle, at + cut
            else:
                node, at = child, at + len(label)
        if node[2] is None:
            node[2] = owner
            self._grown(64)
        else:
            node[2] = _better(node[2], owner)

    def _grown(self, n: int) -> None:
        self.size += n
        if self.size > self.most_bytes:
            self._spill()

    def _spill(self) -> None:
        """Move the largest subtree below the first branching node to a file."""
        node, prefix = self.root, b""
        while len(node[1]) == 1 and node[2] is None:
            child = next(iter(node[1].values()))
            if child[1] is None:
                return
            node, prefix = child, prefix + child[0]
        weights = {b: _weight(c) for b, c in node[1].items() if c[1] is not None}
        if len(node[1]) < 2 or not weights:
            self.size = 0  # one string, or nothing left but files: memory cannot shrink
            return
        byte = max(weights, key=weights.get)
        file = tempfile.TemporaryFile(prefix="trie-")
        for key, owner in _terminals(node[1][byte], prefix):
            pickle.dump((key, owner), file)
        node[1][byte] = [b"", None, file]
        self.files.append(file)
        self.size = max(0, self.size - weights[byte])

    def owners(self) -> Iterator[tuple[bytes, list]]:
        """Every distinct string with its owner; spilled subtrees come last, each in a trie of its own."""
        yield from _terminals(self.root, b"")
        self.root = [b"", {}, None]
        for file in self.files:
            again = PatriciaTrie(self.most_bytes)
            end = file.seek(0, os.SEEK_END)
            file.seek(0)
            while file.tell() < end:
                again.insert(*pickle.load(file))
            file.close()
            yield from again.owners()


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``, which differ or end within the label."""
    lo, hi = 0, min(len(label), len(key) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if label[lo:mid] == key[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _weight(node: list) -> int:
    total, stack = 0, [node]
    while stack:
        label, children, owner = stack.pop()
        total += len(label) + 64 * (owner is not None)
        stack += [c for c in children.values() if c[1] is not None] if children else []
    return total


def _terminals(node: list, prefix: bytes) -> Iterator[tuple[bytes, list]]:
    stack = [(node, prefix)]
    while stack:
        (label, children, owner), path = stack.pop()
        if children is None:
            continue
        path += label
        if owner is not None:
            yield path, owner
        stack += [(c, path) for c in children.values()]


def _normalised(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes, int]]:
    data, offs = utf8(batch.column(1))
    ahead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=ahead[1:])
    points = np.diff(ahead[offs]).tolist()
    raw, cuts = data.tobytes(), offs.tolist()
    for i, doc in enumerate(batch.column(0).to_pylist()):
        yield doc, raw[cuts[i] : cuts[i + 1]].translate(None, BLANKS), points[i]


def _folded(trie: PatriciaTrie) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for body, (points, doc, copies) in trie.owners():
        h = int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)
        rows.append((len(body), h, body, points, doc, copies))
        held += len(body)
        if held > 4 << 20:
            yield _rows(rows)
            rows, held = [], 0
    if rows:
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = ("n_bytes", "h", "body", "best_len", "best_id", "copies")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))


def fold_copies(batches: Iterator[pa.RecordBatch], most_bytes: int = TRIE_BYTES) -> Iterator[pa.RecordBatch]:
    """Map side: one row per distinct text and task (or per ``most_bytes`` of distinct text)."""
    trie, size = PatriciaTrie(1 << 62), 0
    for batch in pieces_of(batches):
        for doc, body, points in _normalised(batch):
            trie.insert(body, [points, doc, 1])
        if trie.size > most_bytes:
            yield from _folded(trie)
            trie = PatriciaTrie(1 << 62)
    yield from _folded(trie)


def merge_owners(batches: Iterator[pa.RecordBatch], most_bytes: int = TRIE_BYTES) -> Iterator[pa.RecordBatch]:
    """Reduce side: insert the full strings of a partition, give the owner of each."""
    trie = PatriciaTrie(most_bytes)
    for batch in batches:
        body, points, doc, copies = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
        for key, *owner in zip(body, points, doc, copies):
            trie.insert(key, owner)
    sha, keep, size = [], [], []
    for key, (_, doc, copies) in trie.owners():
        sha.append(hashlib.sha256(key).digest())
        keep.append(doc)
        size.append(copies)
    yield pa.RecordBatch.from_arrays([pa.array(sha, pa.binary()), pa.array(keep, pa.int64()), pa.array(size, pa.int64())], names=["sha", "keep_id", "group_size"])


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of(batches):
        ids, sha = [], []
        for doc, body, points in _normalised(batch):
            ids.append(doc)
            sha.append(hashlib.sha256(body).digest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sha, pa.binary())], names=["doc_id", "sha"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sha, keep_id, group_size): one row per distinct normalised text."""
    folded = id_text(docs, id_col, text_col).mapInArrow(fold_copies, _FOLDED)
    return folded.repartition("n_bytes", "h").mapInArrow(merge_owners, "sha binary, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    marked = id_text(docs, id_col, text_col).mapInArrow(fingerprints, "doc_id long, sha binary")
    joined = marked.join(exact_groups(docs, id_col, text_col), "sha", "left")
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(body) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY body ORDER BY points DESC, doc_id)
"""
