"""Best-fit packing by hierarchical residual packing.

Every map task tokenizes its documents, cuts those that exceed a sequence and packs the pieces best-fit decreasing.
Nearly full sequences are final. Underfull ones go up a tree as items: each round deals them to fewer tasks, which
best-fit them again, until the items fit one task of bounded size or no round is left. A sequence holds at most
``capacity`` pieces, so its list of pieces is bounded and no join is needed to place them.

Defined results: null text is empty and gives the end id alone; a null id is kept; repeated rows are packed as often as
they occur; an empty table gives an empty result; other columns are ignored; texts of any length are cut exactly.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import id_text, pieces_of, slim, stage

#: Remembered words and remembered pre-tokens of a worker; each takes some 250 bytes.
MEMO = 100_000
#: Free tokens that a final sequence may have before the last round.
SLACK = 6
#: Underfull sequences that one task takes up, and rounds at most.
ITEMS, ROUNDS = 50_000, 6
#: Pieces that a task packs at a time.
PIECES = 100_000

_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_BIN = "sequence_id long, fill int, pieces array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long>>"
#: Characters that split() and the tokenizer do not treat alike.
_ODD = re.compile("[\x1c-\x1f\x85᠎]")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: Byte-level spelling: bytes that print stand for themselves, the others for characters from U+0100 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SPELT = dict(zip((b for b in range(256) if b not in _PRINTED), range(256, 512)))
_LATIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class _Memo(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        out = self.make(word)
        if len(word) < 60:
            self[word] = out
        return out


class WordTokenizer:
    """Packed ids of a text by the ``tokenizers`` library.

    The tokenizer lower-cases, cuts at white space and then into pre-tokens; merges never leave a pre-token. So the ids
    of a text are those of its words, one after the other, and the library is asked once per pre-token.
    """

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec.decode())
        # Added tokens are found in the text before anything else is done to it, so texts that hold one go to the library whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.parts = _Memo(self._part)
        self.words = _Memo(self._word)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        """One pre-token, lower-cased: its bytes as the model spells them, merged by the library."""
        spelt = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(_SPELT)
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = unicodedata.normalize("NFC", word)
            if max(word) >= "\u0130":  # from here on lower case may depend on the neighbours
                return self.whole(word)
        low, parts = word.lower(), self.parts
        if low.isalpha():
            return parts[low]
        if low[:-1].isalpha():
            return parts[low[:-1]] + parts[low[-1]]
        return b"".join(map(parts.__getitem__, (_ASCII if low.isascii() else _LATIN).findall(low)))

    def encode(self, text: str) -> bytes:
        return self.whole(text) if _ODD.search(text) or any(map(text.__contains__, self.added)) else b"".join(map(self.words.__getitem__, text.split()))


_KEPT: dict[str, WordTokenizer] = {}


def _tokenizer(shared) -> WordTokenizer:
    spec, mark = shared.value
    if mark not in _KEPT:
        _KEPT.clear()
        _KEPT[mark] = WordTokenizer(spec)
    return _KEPT[mark]


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes to the fullest bin that still takes it. Gives the items of each bin."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    rooms = 0  # bit r: some bin has r free
    for item in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        n = lengths[item]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[own].append(item)
        else:
            room, own = capacity, len(bins)
            bins.append([item])
        room -= n
        if room:
            by_room[room].append(own)
            rooms |= 1 << room
    return bins


def _packed(pieces: list[list[tuple]], fills: list[int], capacity: int, first_id: int) -> Iterator[pa.RecordBatch]:
    """Best-fit items (lists of pieces with their fill) into sequences."""
    ids, fill, out = [], [], []
    for k, items in enumerate(best_fit(fills, capacity)):
        ids.append(first_id + k)
        fill.append(sum(fills[i] for i in items))
        out.append([p for i in items for p in pieces[i]])
        if len(ids) == 2_000:
            yield _bins(ids, fill, out)
            ids, fill, out = [], [], []
    if ids:
        yield _bins(ids, fill, out)


def _bins(ids: list[int], fill: list[int], pieces: list[list[tuple]]) -> pa.RecordBatch:
    flat = [p for own in pieces for p in own]
    columns = [pa.array(c, f.type) for c, f in zip(zip(*flat), _PIECE)]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(_PIECE)))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fill, pa.int32()), listed], names=["sequence_id", "fill", "pieces"])


def _first_id(round_no: int) -> int:
    return round_no << 56 | TaskContext.get().partitionId() << 32


def cut(doc_id: int | None, packed: bytes, capacity: int) -> list[tuple]:
    """The pieces of a document: (doc_id, piece, start, length, ids_crc32)."""
    wide = 4 * capacity
    return [(doc_id, k, at // 4, min(wide, len(packed) - at) // 4, zlib.crc32(packed[at : at + wide])) for k, at in enumerate(range(0, len(packed), wide))]


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    with open(tokenizer_path, "rb") as file:
        spec = file.read()  # a vocabulary has a fixed, small size
    shared = docs.sparkSession.sparkContext.broadcast((spec, hashlib.sha256(spec).hexdigest()))
    end = np.array([end_id], "<u4").tobytes()

    def first_round(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, next_id, held = _tokenizer(shared), _first_id(0), []
        for batch in pieces_of(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held += cut(doc, tokenizer.encode(text) + end, capacity)
            if len(held) >= PIECES:
                yield from _packed([[p] for p in held], [p[3] for p in held], capacity, next_id)
                next_id, held = next_id + len(held), []
        yield from _packed([[p] for p in held], [p[3] for p in held], capacity, next_id)

    bins = stage(id_text(docs, id_col, text_col).mapInArrow(slim(first_round), _BIN), "packing-0")
    full = F.col("fill") >= capacity - SLACK
    final, under = bins.where(full), bins.where(~full)
    for round_no in range(1, ROUNDS + 1):
        items = under.count()
        tasks = max(1, -(-items // ITEMS))
        last = tasks == 1 or round_no == ROUNDS
        merged = _merge_round(under, tasks, round_no, capacity)
        if last:
            final = final.unionByName(merged)
            break
        merged = stage(merged, f"packing-{round_no}")
        final, under = final.unionByName(merged.where(full)), merged.where(~full)
    return _placed(final)


def _merge_round(under: DataFrame, tasks: int, round_no: int, capacity: int) -> DataFrame:
    """Deal underfull sequences to ``tasks`` tasks, at most about ``ITEMS`` each, and best-fit them as items."""

    def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id, fills, pieces = _first_id(round_no), [], []
        for batch in batches:
            fills += batch.column(1).to_pylist()
            pieces += [[tuple(p.values()) for p in own] for own in batch.column(2).to_pylist()]
        yield from _packed(pieces, fills, capacity, next_id)

    return under.repartition(tasks, F.xxhash64("sequence_id", F.lit(round_no))).mapInArrow(slim(again), _BIN)


def _placed(bins: DataFrame) -> DataFrame:
    """Lay the pieces of each sequence one after the other."""
    # Running sums by one pass: each element is the sum so far, carried at the end of the growing array.
    before = F.aggregate(
        "pieces",
        F.array(F.lit(0).cast("long")),
        lambda sums, p: F.concat(sums, F.array(F.element_at(sums, -1) + p["length"])),
    )
    laid = bins.select("sequence_id", F.explode(F.arrays_zip(F.col("pieces").alias("p"), before.alias("at"))).alias("x"))
    laid = laid.where(F.col("x.p").isNotNull())
    return laid.select("x.p.*", "sequence_id", F.col("x.at").alias("offset"))
