"""Line dedup with a deletion-neighbourhood join.

A line is the sequence of its words (A-Z in lower case, white space ignored). Two lines are near when one word
inserted, deleted or replaced turns one into the other and leaves a word in common (two lines of one word each are near
only when equal); equal lines are at distance 0. A line goes when an equal or near line stands earlier in the corpus, by
(doc_id, line number). Blank lines, and lines of fewer than ``least_words`` words, always stay; the registered queries
set it to 1, so there only blank lines do.

Distinct lines alone are joined. A pigeonhole filter first drops lines whose halves occur nowhere else: one edit leaves
one half of a line as it is. The others emit all variants within the edit bound as hashed keys: the line itself and the
line without each of its words. Equal keys with the same gap mean a replaced word, a whole line that equals a variant
means an inserted one. A line needs one earlier partner, so every key is matched with its earliest line alone, first
inside each map task: of a line, half or variant that a third of all lines share, each task passes on one. Each match is
verified by edit distance over the words.

Defined results: null text is empty, with one empty line that stays; a null id comes after all others; repeated rows
(same id and text) are the same occurrence and keep the same lines; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import id_text, mix64, pieces_of, slim, stage, utf8
from wayfold.llm.shingles import word_hashes

#: Bytes of ids and line numbers that may be broadcast to fetch texts; beyond it the fetch is a shuffled join.
SMALL = 8 << 20
#: A line with more occurrences than this, and than one in ``SHARE`` of all, is salted; at most ``SHARE`` lines are.
OFTEN, SHARE = 1_000, 200_000
_MUL = 0x9E3779B97F4A7C15
_LINES = "text_key long, doc_id long, line_no int, line long, halves array<long>"
_DISTINCT = "line long, n long, text_key long, doc_id long, line_no int, halves array<long>"
_VARIANTS = "key long, role int, doc_id long, line_no int, line long, other long"


def _lines_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word hashes, and for each line its text, its number there and its first word; a line without words has none."""
    last = np.zeros(len(data) + 1, bool)
    last[offs] = True
    stop = np.flatnonzero((data == 10) | last[1:])
    start = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
    cuts = np.concatenate([start, [len(data)]])
    words, line = word_hashes(data, cuts)
    row = np.searchsorted(offs, start, side="right") - 1
    number = np.arange(len(start)) - np.searchsorted(row, row, side="left")
    first = np.searchsorted(line, np.arange(len(start) + 1))
    return words, row, number, first


def _sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of words times powers, and the inverse powers: slices of words can be hashed by difference."""
    n = len(words)
    power, inverse = np.full(n + 1, _MUL, np.uint64), np.full(n + 1, pow(_MUL, -1, 1 << 64), np.uint64)
    power[0] = inverse[0] = 1
    power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * power[:n], out=sums[1:])
    return sums, inverse


def _keyed(kind: int, length: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix64(value + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(kind * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1))


def _lines(least_words: int):
    """Every line with enough words: its hash, and the keys of its halves, as itself and as the longer of two lines."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            words, row, number, first = _lines_of(*utf8(batch.column(2)))
            count = np.diff(first)
            own = np.flatnonzero(count >= max(least_words, 1))
            a, n = first[:-1][own], count[own]
            b = a + n
            sums, inverse = _sums(words)
            cut = lambda x, y: (sums[y] - sums[x]) * inverse[x]
            halves = []
            for size in (n, n - 1):
                left = size // 2
                halves += [_keyed(1, size, cut(a, a + left)), _keyed(2, size, cut(b - (size - left), b))]
            listed = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(halves, 1).ravel().view(np.int64)), 4).cast(pa.list_(pa.int64()))
            take = pa.array(row[own])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(number[own].astype(np.int32)), pa.array(_keyed(0, n, cut(a, b)).view(np.int64)), listed],
                names=["text_key", "doc_id", "line_no", "line", "halves"],
            )

    return run


def _distinct_lines(least_words: int):
    """The earliest occurrence of each line within a task. Both steps run in one worker. Columns as in ``_DISTINCT``."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _lines(least_words)(batches):
            text_key, doc_id, line_no, line, halves = batch.columns
            yield pa.RecordBatch.from_arrays([line, pa.array(np.ones(batch.num_rows, np.int64)), text_key, doc_id, line_no, halves], names=_names(_DISTINCT))

    return lambda batches: _first_lines(counted(batches))


def _chosen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the wanted lines. Columns: text_key, doc_id, text, wanted (line_no, line)."""
    for batch in pieces_of(batches, "text"):
        words, row, number, first = _lines_of(*utf8(batch.column(2)))
        start = np.searchsorted(row, np.arange(batch.num_rows))
        docs, rows = batch.column(1).to_pylist(), []
        for i, wanted in enumerate(batch.column(3).to_pylist()):
            for x in wanted:
                at = int(start[i]) + x["line_no"]
                rows.append((x["line"], docs[i], x["line_no"], words[first[at] : first[at + 1]].tobytes()))
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["line", "doc_id", "line_no", "tokens"])


def _key_of_order(batch: pa.RecordBatch, doc: int, line_no: int) -> tuple[np.ndarray, ...]:
    """Sort keys of the order of occurrences, least significant first: line number, id, null ids last."""
    none = batch.column(doc).is_null().to_numpy(zero_copy_only=False)
    return batch.column(line_no).to_numpy().astype(np.int64), batch.column(doc).fill_null(0).to_numpy(), none


def _first_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The earliest occurrence of each line within a task, and how many there are. Columns as in ``_DISTINCT``."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > 200_000:
            held = [_firsts(held)]
            size = held[0].num_rows
            if size > 100_000:  # little is folded here: pass it on
                yield held.pop()
                size = 0
    if held:
        yield _firsts(held)


def _firsts(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    own = pa.Table.from_batches(held).combine_chunks().to_batches()
    if not own:
        return held[0]
    own = own[0]
    line, n, key = (own.column(i).to_numpy() for i in (0, 1, 2))
    order = np.lexsort((key, *_key_of_order(own, 3, 4), line))
    first = np.flatnonzero(np.concatenate([[True], line[order][1:] != line[order][:-1]]))
    total = np.add.reduceat(n[order], first) if len(first) else n
    out = own.take(pa.array(order[first]))
    return pa.RecordBatch.from_arrays([out.column(0), pa.array(total), *out.columns[2:]], names=_names(_DISTINCT))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _half_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(spread, half, line, known): halves of distinct lines. Of those that a batch shares, one goes on and all are known."""
    for batch in batches:
        data = batch.column(1).flatten().to_numpy()
        line = np.repeat(batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy()))
        order = np.lexsort((line, data))
        half, line = data[order], line[order]
        new = np.ones(len(half), bool)
        new[1:] = (half[1:] != half[:-1]) | (line[1:] != line[:-1])
        half, line = half[new], line[new]
        later = np.zeros(len(half), bool)
        later[1:] = half[1:] == half[:-1]
        known = later.copy()
        known[:-1] |= later[1:]
        yield pa.RecordBatch.from_arrays([pa.array(np.where(later, line, half)), pa.array(half), pa.array(line), pa.array(known), pa.array(later)], names=["spread", "half", "line", "known", "later"])


def _shared_halves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines whose half occurs in another line as well."""
    held = [[b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4)] for b in batches if b.num_rows]
    if held:
        half, line, known, later = (np.concatenate(x) for x in zip(*held))
        out = [line[later]]
        half, line, known = half[~later], line[~later], known[~later]
        order = np.lexsort((line, half))
        half, line, known = half[order], line[order], known[order]
        group = np.cumsum(np.concatenate([[True], half[1:] != half[:-1]])) - 1 if len(half) else half
        new = np.ones(len(half), bool)
        new[1:] = (half[1:] != half[:-1]) | (line[1:] != line[:-1])
        if len(half):
            out.append(line[((np.bincount(group, weights=new) > 1) | (np.bincount(group, weights=known) > 0))[group]])
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)))], names=["line"])


def _variants(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All variants of each line. Roles: 0 one word left open, 1 the line itself, 2 one word deleted.

    Lines of a batch that leave the same word open are matched here: all but the earliest get it as ``other`` (role 3).
    """
    for batch in batches:
        data, offs = utf8(batch.column(3))
        words, bounds = np.frombuffer(data.tobytes(), np.uint64), offs // 8
        rank = np.empty(batch.num_rows, np.int64)
        lines = batch.column(0).to_numpy()
        rank[np.lexsort((lines, *_key_of_order(batch, 1, 2)))] = np.arange(batch.num_rows)
        for at in range(0, batch.num_rows, 5_000):
            to = min(at + 5_000, batch.num_rows)
            own = words[bounds[at] : bounds[to]]
            cuts = bounds[at : to + 1] - bounds[at]
            n = np.diff(cuts)
            sums, inverse = _sums(own)
            line = np.repeat(np.arange(to - at), n)
            i = np.arange(len(own))
            a, b = cuts[:-1][line], cuts[1:][line]
            # Without word i: what stands before it, and what stands after it moved one place down.
            less = (sums[i] - sums[a] + (sums[b] - sums[i + 1]) * np.uint64(pow(_MUL, -1, 1 << 64))) * inverse[a]
            whole = (sums[cuts[1:]] - sums[cuts[:-1]]) * inverse[cuts[:-1]]
            gap = _keyed(3, n[line], less + (i - a).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))
            keys = np.concatenate([gap, _keyed(4, n, whole), _keyed(4, n[line] - 1, less)]).view(np.int64)
            role = np.repeat([0, 1, 2], [len(own), len(n), len(own)])
            row = at + np.concatenate([line, np.arange(len(n)), line])
            some = (role == 1) | (n[row - at] > 1)  # without its one word a line has nothing in common with another
            keys, role, row = keys[some], role[some], row[some]
            order = np.lexsort((rank[row], role, keys))
            keys, role, row = keys[order], role[order], row[order]
            same = np.zeros(len(keys), bool)
            same[1:] = (keys[1:] == keys[:-1]) & (role[1:] == role[:-1])
            same[1:] &= (role[1:] == 0) | (row[1:] == row[:-1])  # a repeated word gives a variant twice
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(keys))))
            later = same & (row != row[head])
            met = np.unique(np.stack([row[later], row[head[later]]]), axis=1) if later.any() else np.zeros((2, 0), np.int64)
            passed = ~same
            take = pa.array(np.concatenate([row[passed], met[0]]))
            columns = [
                pa.array(np.concatenate([keys[passed], lines[met[0]]])),
                pa.array(np.concatenate([role[passed], np.full(met.shape[1], 3)]).astype(np.int32)),
                batch.column(1).take(take),
                batch.column(2).take(take),
                batch.column(0).take(take),
                pa.array(np.concatenate([lines[row[passed]], lines[met[1]]])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=_names(_VARIANTS))


def _matched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, other) for each line that a key matches with an earlier one; the earliest of its kind is ``other``."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    own = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    key, role, line, other = (own.column(i).to_numpy() for i in (0, 1, 4, 5))
    rank = np.empty(len(key), np.int64)
    rank[np.lexsort((line, *_key_of_order(own, 2, 3)))] = np.arange(len(key))
    met = [np.stack([line[role == 3], other[role == 3]])]
    for seek, find in ((0, 0), (1, 2), (2, 1)):
        found = np.flatnonzero(role == find)
        found = found[np.lexsort((rank[found], key[found]))]
        found = found[np.concatenate([[True], key[found][1:] != key[found][:-1]])] if len(found) else found
        asked = np.flatnonzero(role == seek)
        if len(found) and len(asked):
            at = np.minimum(np.searchsorted(key[found], key[asked]), len(found) - 1)
            hit = found[at]
            ok = (key[hit] == key[asked]) & (rank[hit] < rank[asked]) & (line[hit] != line[asked])
            met.append(np.stack([line[asked][ok], line[hit][ok]]))
    pairs = np.unique(np.concatenate(met, 1), axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["line", "other"])


def within_one_edit(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether one word inserted, deleted or replaced at most turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    differ = np.flatnonzero(a != b[: len(a)])
    if not len(differ):
        return True
    i = int(differ[0])
    return np.array_equal(a[i + 1 :], b[i + 1 :]) if len(a) == len(b) else np.array_equal(a[i:], b[i + 1 :])


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = [within_one_edit(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3))]
        yield batch.filter(pa.array(near, pa.bool_())).select(["line", "other"])


def near_lines(texts: DataFrame, distinct: DataFrame) -> DataFrame:
    """(line): the lines that a near line precedes. ``distinct`` has line, text_key, doc_id, line_no, halves."""
    halves = distinct.select("line", "halves").mapInArrow(slim(_half_keys), "spread long, half long, line long, known boolean, later boolean")
    maybe = halves.repartition("spread").mapInArrow(slim(_shared_halves), "line long").distinct()
    wanted = distinct.join(maybe, "line").groupBy("text_key", "doc_id").agg(F.collect_list(F.struct("line_no", "line")).alias("wanted"))
    wanted = stage(wanted, "lines-wanted")
    size = wanted.agg(F.sum(F.size("wanted") * 16 + 32)).first()[0] or 0
    few = size <= SMALL
    keyed = wanted.withColumnRenamed("text_key", "k").withColumnRenamed("doc_id", "d")
    asked = texts.join(F.broadcast(keyed) if few else keyed, (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("text_key", "doc_id", "text", "wanted")
    chosen = stage(asked.mapInArrow(slim(_chosen), "line long, doc_id long, line_no int, tokens binary").dropDuplicates(["line"]), "lines-chosen")
    pairs = chosen.mapInArrow(slim(_variants), _VARIANTS).repartition("key").mapInArrow(slim(_matched), "line long, other long").distinct()
    tokens = chosen.select("line", F.col("tokens").alias("a")), chosen.select(F.col("line").alias("other"), F.col("tokens").alias("b"))
    tried = pairs.join(tokens[0], "line").join(tokens[1], "other").select("line", "other", "a", "b")
    return tried.mapInArrow(_verify, "line long, other long").select("line").distinct()


def repeated_lines(texts: DataFrame, least_words: int) -> DataFrame:
    """(text_key, doc_id, gone): the numbers of the lines that go, for each document that loses some. ``texts``: text_key, doc_id, text."""
    whole = texts.select("text_key", "doc_id", "text")
    distinct = whole.mapInArrow(slim(_distinct_lines(least_words)), _DISTINCT).repartition("line").mapInArrow(slim(_first_lines_of_all), _DISTINCT)
    distinct = stage(distinct, "lines-distinct")
    near = near_lines(texts, distinct).withColumn("near", F.lit(True))
    facts = distinct.select("line", "n", F.struct(F.col("text_key").alias("k"), F.col("doc_id").alias("d"), F.col("line_no").alias("l")).alias("first"))
    facts = facts.join(near, "line", "left").where("n > 1 or near")
    # The first occurrence stays unless a near line precedes it; repeated rows are the same occurrence.
    own = F.col("text_key").eqNullSafe(F.col("first.k")) & F.col("doc_id").eqNullSafe(F.col("first.d")) & (F.col("line_no") == F.col("first.l"))
    # A line that stands everywhere goes to as many tasks as it needs.
    total = distinct.agg(F.sum("n")).first()[0] or 0
    often = max(OFTEN, total // SHARE)
    hot = stage(facts.where(F.col("n") > often).select("line", F.ceil(F.col("n") / often).alias("salts")), "lines-hot")
    lines = whole.mapInArrow(slim(_lines(least_words)), _LINES).select("line", "text_key", "doc_id", "line_no")
    salt = F.pmod(F.xxhash64("text_key", "line_no"), F.coalesce("salts", F.lit(1).cast("long")))
    dealt = lines.join(F.broadcast(hot), "line", "left").select("line", salt.alias("salt"), "text_key", "doc_id", "line_no")
    salts = F.sequence(F.lit(0).cast("long"), F.when(F.col("n") > often, F.ceil(F.col("n") / often) - 1).otherwise(F.lit(0).cast("long")))
    gone = dealt.join(facts.withColumn("salt", F.explode(salts)), ["line", "salt"]).where(F.coalesce("near", F.lit(False)) | ~own)
    return gone.groupBy("text_key", "doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("gone"))


def _first_lines_of_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        yield _firsts(held)


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return id_text(docs, id_col, text_col).select(F.xxhash64("text").alias("text_key"), "doc_id", "text")


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines of these numbers."""
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda line, i: ~F.array_contains(gone, i))
    return F.when(gone.isNull() | (F.size(gone) == 0), text).otherwise(F.array_join(kept, "\n"))


def line_dedup(docs: DataFrame, least_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_text."""
    texts = keyed_texts(docs, id_col, text_col)
    joined = texts.withColumnRenamed("doc_id", "d").join(
        repeated_lines(texts, least_words).withColumnRenamed("text_key", "k"), (F.col("text_key") == F.col("k")) & F.col("d").eqNullSafe(F.col("doc_id")), "left"
    )
    return joined.select(
        F.col("d").alias("doc_id"),
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        without_lines(F.col("text"), F.col("gone")).alias("kept_text"),
    )
