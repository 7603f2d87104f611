"""Byte-level BPE encoding and decoding with a lazily determinised transducer.

A token sequence is the BPE encoding of its bytes exactly when every neighbouring pair of tokens encodes to itself, so
encodings form a language that is decided two tokens at a time. The nondeterministic transducer guesses token ends: a
hypothesis is (last token, node of the token trie, tokens not yet emitted). Reading a byte moves every hypothesis down
the trie; one that reaches a token compatible with its last token opens a new hypothesis. Sets of hypotheses are
determinised lazily; what all of them have pending in common is emitted, after a lookahead bounded by the longest
token. Each pre-token is read from the start state; outputs of frequent pre-tokens and of the chunks between single
spaces are remembered in bounded tables.

Decoding streams: tokens' bytes go through an incremental UTF-8 state machine that only lets whole characters out.

Defined results: null text is empty (no tokens); nulls in the id, repeated rows and other columns do not matter; an
empty table gives an empty result. Invalid UTF-8 in decoded ids becomes U+FFFD in text, and stays as it is in bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wayfold.llm.common import id_text, pieces_of

#: Bounds of the tables that a worker keeps: remembered chunks, remembered pre-tokens, deterministic transitions.
MEMO, TRANSITIONS = 400_000, 600_000
#: Texts longer than this are matched piece by piece.
LONG_TEXT = 1 << 20
#: White space other than the space and the line feed: such texts are not cut at single spaces.
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file, read through the driver once; a vocabulary has a fixed, small size."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.by_id = {i: b for b, i in ranks.items()}
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.inner = bytearray(1)
        for word, rank in ranks.items():
            node = 0
            for byte in word:
                key = node << 8 | byte
                down = self.child.get(key)
                if down is None:
                    down = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(0)
                    self.inner[node] = 1
                node = down
            self.token[node] = rank
        self.pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((-1, 0, ()),)
        self.states, self.ids = [start], {start: 0}
        self.moves: dict[int, tuple[int, bytes]] = {}

    def merged(self, word: bytes) -> list[bytes]:
        """BPE by definition: join the neighbours whose union has the lowest rank, leftmost first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            low = min(ranks)
            if low == 1 << 60:
                break
            at = ranks.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, last: int, token: int) -> bool:
        """Whether ``token`` may follow ``last`` (-1: the start)."""
        known = self.pairs.get((last, token))
        if known is None:
            pair = [self.by_id[token]] if last < 0 else [self.by_id[last], self.by_id[token]]
            known = self.pairs[last, token] = self.merged(b"".join(pair)) == pair
        return known

    def _move(self, state: int, byte: int) -> tuple[int, bytes]:
        alive, opened = [], None
        for last, node, pending in self.states[state >> 8]:
            down = self.child.get(node << 8 | byte)
            if down is None:
                continue
            token = self.token[down]
            if token >= 0 and opened is None and self.fits(last, token):
                opened = (token, 0, (*pending, token))
            if self.inner[down]:
                alive.append((last, down, pending))
        if opened is None:
            raise ValueError("the ranks lack a token for a byte")
        alive.append(opened)
        low, high = min(x[2] for x in alive), max(x[2] for x in alive)
        same = 0
        while same < len(low) and same < len(high) and low[same] == high[same]:
            same += 1
        target = tuple((last, node, pending[same:]) for last, node, pending in alive)
        at = self.ids.get(target)
        if at is None:
            at = self.ids[target] = len(self.states)
            self.states.append(target)
        move = self.moves[state | byte] = (at << 8, array("I", opened[2][:same]).tobytes())
        return move

    def encode(self, word: bytes) -> bytes:
        """The packed ids of one pre-token. A state is its number times 256, so that a byte can be added."""
        whole = self.ranks.get(word)
        if whole is not None:
            return array("I", [whole]).tobytes()
        if len(self.moves) > TRANSITIONS:
            self._reset()
        if len(self.pairs) > TRANSITIONS:
            self.pairs.clear()
        state, out, known = 0, b"", self.moves.get
        for byte in word:
            move = known(state | byte) or self._move(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        return out + array("I", self.states[state >> 8][-1][2]).tobytes()


class _Memo(dict):
    """A bounded table from a string to packed ids."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        out = self.make(word)
        if len(word) < 200:
            self[word] = out
        return out


class ByteBpe:
    """Encode texts to packed little-endian unsigned 32-bit ids, and decode them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.find = regex.compile(pattern)
        self.words = _Memo(lambda word: self.transducer.encode(word.encode()))
        self.first, self.later = _Memo(self._matched), _Memo(self._chunk)
        self.vocabulary = self.transducer.by_id

    def _chunk(self, chunk: str) -> bytes:
        """A chunk with the single space before it. Letters, or letters and one sign, need no matching."""
        if chunk.isalpha():
            return self.words[" " + chunk]
        if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?*#$%&|)":
            return self.words[" " + chunk[:-1]] + self.words[chunk[-1]]
        return self._matched(" " + chunk)

    def _matched(self, text: str) -> bytes:
        if len(text) <= LONG_TEXT:
            return b"".join(map(self.words.__getitem__, self.find.findall(text)))
        found, parts = (m[0] for m in self.find.finditer(text)), []
        while some := list(islice(found, 65_536)):
            parts.append(b"".join(map(self.words.__getitem__, some)))
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        # No match of the pattern crosses into a single space from the left, so a text whose spaces all stand alone
        # falls into chunks that are matched separately.
        if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _OTHER_SPACE.search(text):
            return self._matched(text)
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.later.__getitem__, rest))

    def decode(self, packed: bytes, step: int = 1 << 16) -> Iterator[bytes]:
        """The bytes of whole characters, chunk by chunk; an unfinished tail comes last, as it is."""
        stream, ids = Utf8Stream(), np.frombuffer(packed, "<u4")
        for at in range(0, len(ids), step):
            yield stream.feed(b"".join(map(self.vocabulary.__getitem__, ids[at : at + step].tolist())))
        yield stream.pending


class Utf8Stream:
    """UTF-8 as a state machine over chunks: the state is the bytes of a character whose end has not come yet."""

    def __init__(self):
        self.pending = b""

    def feed(self, chunk: bytes) -> bytes:
        data = self.pending + chunk
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue  # a continuation byte: its lead stands before it
            needs = 2 if byte >> 5 == 0b110 else 3 if byte >> 4 == 0b1110 else 4 if byte >> 3 == 0b11110 else 1
            if needs > back:
                cut = len(data) - back
            break
        self.pending = data[cut:]
        return data[:cut]


_KEPT: dict[str, ByteBpe] = {}


def _codec(shared) -> ByteBpe:
    ranks, pattern, mark = shared.value
    if mark not in _KEPT:
        _KEPT.clear()
        _KEPT[mark] = ByteBpe(ranks, pattern)
    return _KEPT[mark]


def _shared(docs: DataFrame, ranks_path: str, pattern: str):
    ranks = read_ranks(ranks_path)
    mark = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    return docs.sparkSession.sparkContext.broadcast((ranks, pattern, mark))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every whole text."""
    shared = _shared(docs, ranks_path, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in pieces_of(batches):
            ids = [np.frombuffer(codec.encode(t), "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids are an empty list."""
    shared = _shared(tokens, ranks_path, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            packed = [np.array(ids or [], "<u4").tobytes() for ids in batch.column(1).to_pylist()]
            texts = ["".join(part.decode("utf-8", "replace") for part in codec.decode(p)) for p in packed]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def token_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids again: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    shared = _shared(docs, ranks_path, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in pieces_of(batches):
            count, ids, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                packed = codec.encode(text)
                count.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                digest = hashlib.sha256()
                for part in codec.decode(packed):
                    digest.update(part)
                decoded.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
