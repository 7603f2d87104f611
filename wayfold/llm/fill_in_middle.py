"""Fill-in-middle transformation by secondary sort.

A document is cut into lines, and at two of their ends (drawn from the hash of its id) into prefix, middle and suffix.
Map tasks emit chunks of whole lines, keyed by document and by their place in the *output*; a shuffle by document sorts
them within partitions, and a reader streams them into a digest, so that no output is ever assembled in memory. The
reader finds the parts by the marks in the output and the form alone, gives each chunk its place in the *restored* text,
and a second sort within the same partitions (no exchange) streams them into the digest of the restoration.

A document is keyed by its id and a 128-bit hash of its text, so rows that share an id are apart, and rows that are
equal in both are read once and given as often as they occur.

Defined results: null text is empty; empty texts and texts that hold a mark stay plain; a null id is an empty id in the
seed; repeated rows give repeated results; texts of any length are taken whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayfold.llm.common import id_text, parallelism, pieces_of, slim, utf8

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: The order of the parts in the output of each form.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: The order of the parts in the text.
IN_TEXT = (PREFIX, MIDDLE, SUFFIX)
#: Bytes of a chunk; a longer line is a chunk of its own pieces.
CHUNK = 64 << 10
#: Places of a part: chunk i of part p stands at p * PART + i, in the output and in the restored text.
PART = 1 << 40

_CHUNKS = "doc_id long, text_hash binary, place long, bytes binary, n long, form string, prefix_chars long, middle_chars long"
_DIGESTED = "doc_id long, text_hash binary, place long, bytes binary, n long, form string, prefix_chars long, middle_chars long, output_sha256 string"
_RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
_BATCH = 4 << 20


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))


def cut(doc_id: int | None, text: bytes, line_ends: np.ndarray, seed: int, rate: int, spm_rate: int) -> tuple[str, int, int, int]:
    """The form, the number of lines, and the bytes after which prefix and middle end. ``line_ends`` are the places of line feeds."""
    n = len(line_ends) + (len(text) > 0 and text[-1] != 10)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(mark in text for mark in IN_TEXT):
        return "plain", n, 0, 0
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    end = lambda lines: 0 if lines == 0 else int(line_ends[lines - 1]) + 1 if lines <= len(line_ends) else len(text)
    return "spm" if h4 % 100 < spm_rate else "psm", n, end(low), end(high)


def chunks(part: bytes, line_ends: np.ndarray, start: int) -> Iterator[bytes]:
    """``part`` in chunks of whole lines of about ``CHUNK`` bytes; it stands at ``start`` of its text."""
    at = 0
    while at < len(part):
        to = at + CHUNK
        if to < len(part):
            k = int(np.searchsorted(line_ends, start + to)) - 1
            to = int(line_ends[k]) + 1 - start if k >= 0 and line_ends[k] + 1 - start > at else to
        yield part[at:to]
        at = to


def _characters(data: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))


def _emit(seed: int, rate: int, spm_rate: int):
    """Map side: the chunks of each document at their places in the output; the first one carries what is known of the document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, most_bytes=_BATCH):
            data, offs = utf8(batch.column(1))
            out: list[tuple] = []
            for row, doc_id in enumerate(batch.column(0).to_pylist()):
                own = data[offs[row] : offs[row + 1]]
                text, ends = own.tobytes(), np.flatnonzero(own == 10)
                form, n, first, second = cut(doc_id, text, ends, seed, rate, spm_rate)
                key = hashlib.blake2b(text, digest_size=16).digest()
                if form == "plain":
                    parts, known = [(b"", text, 0)], (n, form, None, None)
                else:
                    spans = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, len(text))}
                    parts = [(mark, text[slice(*spans[mark])], spans[mark][0]) for mark in ORDERS[form]]
                    known = (n, form, _characters(text[:first]), _characters(text[first:second]))
                for p, (mark, part, start) in enumerate(parts):
                    for i, piece in enumerate(chunks(part, ends, start) if part else [b""]):
                        out.append((doc_id, key, p * PART + i, mark + piece if i == 0 else piece, *(known if p == i == 0 else (None,) * 4)))
            yield _batch(out, _emitted_schema)

    return run


_emitted_schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.binary()), ("place", pa.int64()), ("bytes", pa.binary()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])
_digested_schema = _emitted_schema.append(pa.field("output_sha256", pa.string()))
_result_schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


class _Copies:
    """Chunks of rows that are equal in id and text come one after the other: the first of each place counts, the others are counted."""

    def __init__(self):
        self.key, self.place, self.copies = None, None, 1

    def new_document(self, key: tuple) -> bool:
        if key == self.key:
            return False
        self.key, self.place, self.copies = key, None, 0
        return True

    def repeated(self, place: int, first: bool) -> bool:
        same = place == self.place
        self.place = place
        self.copies += first
        return same


def _digest_outputs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in the order of the output: digest them, and give each its place in the restored text, found by form and marks.

    The digest of the output goes with one more row of each copy, which comes last in the restored order.
    """
    out, size, seen = [], 0, _Copies()
    digest, known, marks, part, at = hashlib.sha256(), None, (), None, 0

    def closed() -> list[tuple]:
        return [] if seen.key is None else [(*seen.key, len(IN_TEXT) * PART + k, b"", *known, digest.hexdigest()) for k in range(seen.copies)]

    for doc_id, text_hash, place, data, *about in _rows(batches):
        if (doc_id, text_hash) != seen.key:
            out += closed()
            seen.new_document((doc_id, text_hash))
            digest, known, part, at = hashlib.sha256(), tuple(about), 0, 0
            marks = ORDERS.get(known[1], ())
        if seen.repeated(place, place == 0):
            continue
        digest.update(data)
        for k, mark in enumerate(marks):
            if data.startswith(mark):
                part, at, data = IN_TEXT.index(mark), 0, data[len(mark) :]
                marks = marks[k + 1 :]  # a mark opens one part, in the order of the form
                break
        out.append((doc_id, text_hash, part * PART + at, data, None, None, None, None, None))
        at, size = at + 1, size + len(data)
        if size >= _BATCH or len(out) >= 20_000:
            yield _batch(out, _digested_schema)
            out, size = [], 0
    yield _batch(out + closed(), _digested_schema)


def _digest_restored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in the order of the text: digest them, and give the results where a document ends."""
    key, digest, out = None, hashlib.sha256(), []
    for doc_id, text_hash, place, data, n, form, prefix_chars, middle_chars, output in _rows(batches):
        if (doc_id, text_hash) != key:
            key, digest = (doc_id, text_hash), hashlib.sha256()
        if output is None:
            digest.update(data)
            continue
        out.append((doc_id, n, form, prefix_chars, middle_chars, output, digest.hexdigest()))
        if len(out) >= 20_000:
            yield _batch(out, _result_schema)
            out = []
    yield _batch(out, _result_schema)


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n (lines), form, prefix_chars, middle_chars, output_sha256, restored_sha256.

    ``rate`` percent of the documents are transformed, ``spm_rate`` percent of these with the suffix first.
    """
    pieces = id_text(docs, id_col, text_col).mapInArrow(slim(_emit(seed, rate, spm_rate)), _CHUNKS)
    dealt = pieces.repartition(parallelism(docs.sparkSession), "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "place")
    digested = dealt.mapInArrow(slim(_digest_outputs), _DIGESTED)
    return digested.sortWithinPartitions("doc_id", "text_hash", "place").mapInArrow(slim(_digest_restored), _RESULT)


def outputs(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chunks of the outputs: doc_id, text_hash, place, bytes, and form with the first of a document. Concatenated by place they are its output."""
    return id_text(docs, id_col, text_col).mapInArrow(slim(_emit(seed, rate, spm_rate)), _CHUNKS)
