"""Removal of repeated byte strings with a sparse, distributed suffix array.

A byte goes when a string of ``span`` bytes (200) that covers it also starts anywhere else. Not every suffix need be
sorted: of the first ``span - LEAD + 1`` places of a string the one whose leading bytes have the least hash is its
anchor, and equal strings have equal anchors at equal distance. Only suffixes at anchors, about one in 85, are sorted.

1. Suffixes go to buckets by their leading ``LEAD`` bytes, between splitters sampled from the corpus. Leads that occur
   once drop out.
2. The suffixes left, with the bytes before them that their strings can reach, meet again in their buckets. Spark sorts
   a partition by bucket, and a task takes up one bucket at a time: it sorts the suffixes by multikey quicksort on
   8-byte words, rightwards and leftwards, and compares neighbours. Splitters fall between leads, so no comparison
   crosses a boundary. What neighbours leave open is settled by comparing the strings.
3. Leads with more than ``HOT`` suffixes are not sorted in one task: all their strings are counted by fingerprint, a
   128-bit hash, over all tasks instead. The result is the same.

Equal texts are found first by their hash and take part once. The covered ranges of a text are then cut from it.

Defined results: null text is empty and nothing is removed; null ids are kept; a repeated row is another occurrence of
its text, so texts of ``span`` bytes or more go completely; an empty table gives an empty result; other columns are
ignored. Strings are compared as bytes and never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import id_text, parallelism, pieces_of, slim, stage, utf8

#: Leading bytes that choose an anchor.
LEAD = 32
#: Bytes of one text, and of a batch of texts, that are looked at together.
BLOCK, PIECE = 1 << 18, 1 << 19
#: Texts whose leads are sampled for the splitters, about; buckets per partition.
SAMPLE, BUCKETS = 4_000, 8
#: Suffixes whose strings are fingerprinted together, and salts of a fingerprint that many texts share.
PRINTS, SALTS = 500, 8
#: Suffixes of one lead that one task sorts, beyond it strings are counted by fingerprint; leads that may be broadcast.
HOT, FEW = 20_000, 1_000_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_ANCHORS = "spread long, bucket int, lead long, known boolean, text_key long, place int, low int, high int"
_CONTEXTS = "bucket int, lead long, text_key long, place int, low int, high int, context binary"


def _anchored(data: np.ndarray, offs: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Anchors of a block of rows: lead hash, leading bytes, place in the block, and the least and greatest distance from the start of a string to its anchor."""
    n, width = len(data), span - LEAD + 1
    if n < span:
        return tuple(np.zeros(0, t) for t in (np.int64, f"S{LEAD}", np.int64, np.int64, np.int64))
    raw = data.tobytes()
    word = np.ndarray((n - 7,), "<u8", raw, strides=(1,))
    head = np.ndarray((n - LEAD + 1,), f"S{LEAD}", raw, strides=(1,))
    lead = word[: n - LEAD + 1] * _ODD[0]
    for k in (1, 2, 3):
        lead += word[8 * k : 8 * k + n - LEAD + 1] * _ODD[k]
    lead ^= lead >> np.uint64(32)
    lead *= _ODD[4]
    # The least of each window of ``width`` places; the place is in the low bits, so the leftmost wins a tie.
    keys = (lead & ~np.uint64((1 << 22) - 1)) | np.arange(len(lead), dtype=np.uint64)
    rows = -(-len(keys) // width)
    padded = np.full(rows * width, ~np.uint64(0))
    padded[: len(keys)] = keys
    padded = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - span + 1], ahead[width - 1 : width + n - span])
    inside = np.zeros(n + 2, np.int8)
    at, to = offs[:-1], np.maximum(offs[:-1], offs[1:] - span + 1)
    np.add.at(inside, at, 1)
    np.add.at(inside, to, -1)
    starts = np.flatnonzero(np.cumsum(inside[: n - span + 1]) > 0)
    if not len(starts):
        return _anchored(data[:0], offs[:1], span)
    places = (least[starts] & np.uint64((1 << 22) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    last = np.concatenate([first[1:], [len(places)]]) - 1
    place = places[first]
    return lead[place].view(np.int64), head[place], place, place - starts[last], place - starts[first]


def anchors(data: np.ndarray, offs: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """``_anchored`` for whole rows: lead, leading bytes, row, place in the row, low, high. A long text is taken in blocks of strings."""
    if len(data) <= 3 * BLOCK:
        lead, head, place, low, high = _anchored(data, offs, span)
        row = np.searchsorted(offs, place, side="right") - 1
        return lead, head, row, place - offs[row], low, high
    parts = []
    for row, (at, end) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        for start in range(at, max(at + 1, end - span + 1), BLOCK):
            own = data[start : min(end, start + BLOCK + span - 1)]
            lead, head, place, low, high = _anchored(own, np.array([0, len(own)]), span)
            parts.append((lead, head, np.full(len(lead), row), place + start - at, low, high))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _leads(span: int, splitters: np.ndarray):
    """The anchors of each text once per task. Of the suffixes that share a lead within a batch, one stands for all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces_of(batches, most_bytes=PIECE):
            keys = batch.column(0).to_numpy()
            fresh = np.zeros(len(keys), bool)
            for i, key in enumerate(keys.tolist()):
                if key not in seen:
                    fresh[i] = True
                    seen.add(key)
            if len(seen) > 100_000:
                seen.clear()
            batch = batch.filter(pa.array(fresh))
            keys = keys[fresh]
            lead, head, row, place, low, high = anchors(*utf8(batch.column(1)), span)
            bucket = np.searchsorted(splitters, head, side="right").astype(np.int32)
            order = np.argsort(lead, kind="stable")
            same = np.zeros(len(lead) + 1, bool)
            same[1:-1] = lead[order][1:] == lead[order][:-1]
            later, known = np.zeros(len(lead), bool), np.zeros(len(lead), bool)
            later[order] = same[:-1]
            known[order] = same[:-1] | same[1:]
            spread = np.where(later, -1 - (keys[row] >> 1 & (1 << 40) - 1), bucket)
            columns = (spread, bucket, lead, known, keys[row], place.astype(np.int32), low.astype(np.int32), high.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_names(_ANCHORS))

    return run


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors whose lead occurs again."""
    held = []
    for batch in batches:
        away = batch.column(0).to_numpy() < 0
        if away.any():
            yield batch.filter(pa.array(away)).drop_columns(["spread", "known"])
        if not away.all():
            held.append(batch.filter(pa.array(~away)))
    if held:
        own = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        lead, key, place = (own.column(i).to_numpy() for i in (2, 4, 5))
        known = own.column(3).to_numpy(zero_copy_only=False)
        low, high = (own.column(i).to_numpy() for i in (6, 7))
        order = np.lexsort((high, low, place, key, lead))
        lead, key, place, known, low, high = (x[order] for x in (lead, key, place, known, low, high))
        bound = np.concatenate([[True], lead[1:] != lead[:-1]])
        new = bound.copy()
        new[1:] |= (key[1:] != key[:-1]) | (place[1:] != place[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        group = np.cumsum(bound) - 1
        many = np.bincount(group, weights=new)
        some = np.bincount(group, weights=known)
        keep = new & ((many > 1) | (some > 0))[group]
        yield own.take(pa.array(order[keep])).drop_columns(["spread", "known"])


def _contexts(span: int):
    """Each anchor with the bytes that its strings reach. Columns: text_key, text, anchors (bucket, lead, place, low, high)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, most_bytes=PIECE):
            data, offs = utf8(batch.column(1))
            listed, raw = batch.column(2), data.tobytes()
            found, row = listed.flatten(), np.repeat(np.arange(batch.num_rows), np.diff(listed.offsets.to_numpy()))
            bucket, lead, place, low, high = (found.field(i) for i in range(5))
            at = offs[:-1][row] + place.to_numpy()
            begins, ends = (at - high.to_numpy()).tolist(), (at - low.to_numpy() + span).tolist()
            context = pa.array([raw[x:y] for x, y in zip(begins, ends)], pa.binary())
            yield pa.RecordBatch.from_arrays([bucket, lead, batch.column(0).take(pa.array(row)), place, low, high, context], names=_names(_CONTEXTS))

    return run


def multikey_order(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Sort rows within their groups by their words, as multikey quicksort does: ties alone go on to the next word."""
    order = np.argsort(group, kind="stable")
    part = np.cumsum(np.concatenate([[True], group[order][1:] != group[order][:-1]])) if len(order) else order
    for depth in range(words.shape[1]):
        tied = np.flatnonzero(np.bincount(part, minlength=1)[part] > 1)
        if not len(tied):
            break
        own = order[tied]
        word = words[own, depth]
        ranked = np.lexsort((word, part[tied]))
        order[tied], word, where = own[ranked], word[ranked], part[tied][ranked]
        split = np.concatenate([[False], (word[1:] != word[:-1]) & (where[1:] == where[:-1])])
        shift = np.zeros(len(order), np.int64)
        shift[tied] = split
        part = part + np.cumsum(shift)
    return order


def _padded(data: np.ndarray, at: np.ndarray, length: np.ndarray, width: int, step: int) -> np.ndarray:
    """A matrix of ``width`` bytes per row, read from ``at`` rightwards or leftwards; zero beyond ``length``."""
    out = np.zeros((len(at), width), np.uint8)
    reach = np.arange(width)
    for k in range(0, len(at), 8192):
        cut = slice(k, k + 8192)
        index = at[cut, None] + step * reach
        out[cut] = np.where(reach < length[cut, None], data[np.clip(index, 0, len(data) - 1)], 0)
    return out


def _shared(matrix: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How many bytes each row of an order shares with the row before it; 0 across groups."""
    out = np.zeros(len(order), np.int64)
    for k in range(1, len(order), 8192):
        a, b = order[k - 1 : min(len(order), k + 8192) - 1], order[k : k + 8192]
        differ = matrix[a] != matrix[b]
        same = np.where(differ.any(1), differ.argmax(1), matrix.shape[1])
        out[k : k + len(b)] = np.where(group[a] == group[b], same, 0)
    return out


def _settled(span: int):
    """Sort the suffixes of the buckets and give the covered ranges: text_key, start, stop. Rows come sorted by bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for at, to in zip(cuts, cuts[1:]):
                if held and to > at and held[-1].column(0)[0].as_py() != bucket[at]:
                    yield settle(held)
                    held = []
                if to > at:
                    held.append(batch.slice(at, to - at))
        if held:
            yield settle(held)

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        group, key, place, low, high = (own.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3, 4, 5))
        data, offs = utf8(own.column(6))
        # A text that several rows carry counts once; an anchor that two blocks of a long text share has strings in each.
        facts = (high, low, place, key, group)
        mark = np.lexsort(facts)
        fresh = np.ones(len(mark), bool)
        fresh[1:] = np.any([np.diff(x[mark]) != 0 for x in facts], axis=0)
        pick = np.sort(mark[fresh])
        group, key, place, low, high, start = (x[pick] for x in (group, key, place, low, high, offs[:-1]))
        right = _padded(data, start + high, span - low, -(-span // 8) * 8, 1)
        left = _padded(data, start + high - 1, high, -(-(span - LEAD) // 8) * 8, -1)
        size = len(pick)
        confirmed: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        most = []
        for matrix in (right, left):
            order = multikey_order(group, matrix.view(">u8"))
            shared = _shared(matrix, order, group)
            both = np.maximum(shared, np.concatenate([shared[1:], [0]])) if size else shared
            reach = np.zeros(size, np.int64)
            reach[order] = both
            most.append(reach)
            a, b = order[:-1], order[1:]
            ok = group[a] == group[b]
            a, b = a[ok], b[ok]
            for k in range(0, len(a), 8192):
                x, y = a[k : k + 8192], b[k : k + 8192]
                differ, before = right[x] != right[y], left[x] != left[y]
                ends = np.where(differ.any(1), differ.argmax(1), right.shape[1])
                begins = np.where(before.any(1), before.argmax(1), left.shape[1])
                for one in (x, y):
                    # Strings that start from ``first`` to ``last`` bytes before the anchor are equal in x and y.
                    first = np.maximum(span - np.minimum(ends, span - np.maximum(low[x], low[y])), low[one])
                    last = np.minimum(np.minimum(begins, np.minimum(high[x], high[y])), high[one])
                    good = np.flatnonzero(first <= last)
                    for i, f, t in zip(one[good].tolist(), first[good].tolist(), last[good].tolist()):
                        confirmed[i].append((f, t))
        least = np.maximum(span - most[0], low)
        greatest = np.minimum(most[1], high)
        out: list[tuple[int, int, int]] = []
        open_: dict[int, list[tuple[int, int]]] = {}
        for i in np.flatnonzero(least <= greatest).tolist():
            at, lo, hi = int(place[i]), int(least[i]), int(greatest[i])
            for f, t in confirmed[i]:
                out.append((int(key[i]), at - t, at - f + span))
            for distance in range(lo, hi + 1):
                if not any(f <= distance <= t for f, t in confirmed[i]):
                    open_.setdefault(int(group[i]), []).append((i, distance))
        if open_:
            raw = data.tobytes()
            members: dict[int, list[int]] = {g: [] for g in open_}
            for i in np.flatnonzero(np.isin(group, np.array(list(open_)))).tolist():
                members[int(group[i])].append(i)
            for g, asked in open_.items():
                for distance in {d for _, d in asked}:
                    count: dict[bytes, int] = {}
                    cut = {}
                    for i in members[g]:
                        if low[i] <= distance <= high[i]:
                            at = int(start[i] + high[i]) - distance
                            cut[i] = raw[at : at + span]
                            count[cut[i]] = count.get(cut[i], 0) + 1
                    out += [(int(key[i]), int(place[i]) - d, int(place[i]) - d + span) for i, d in asked if d == distance and count[cut[i]] > 1]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["text_key", "start", "stop"])

    return run


def _fingerprinted(span: int):
    """Every string of the given suffixes by fingerprint: print, text_key, start."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, PRINTS) for b in batches for k in range(0, b.num_rows, PRINTS)):
            prints, keys, starts = [], [], []
            key, place, low, high = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            for i, context in enumerate(batch.column(6).to_pylist()):
                for k in range(high[i] - low[i] + 1):
                    prints.append(hashlib.blake2b(context[k : k + span], digest_size=16).digest())
                    keys.append(key[i])
                    starts.append(place[i] - high[i] + k)
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64())], names=["print", "text_key", "start"])

    return run


_SUMMARY = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(span: int, keep_text: bool):
    """Columns: doc_id, text, copies, starts, stops. The kept bytes are sent back only if they are asked for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, most_bytes=PIECE):
            data, offs = utf8(batch.column(1))
            raw, cuts = data.tobytes(), offs.tolist()
            rows = []
            for i, (copies, starts, stops) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))):
                text = raw[cuts[i] : cuts[i + 1]]
                ranges = [(0, len(text))] if (copies or 1) > 1 and len(text) >= span else sorted(zip(starts or (), stops or ()))
                kept, removed, runs, at = [], 0, 0, 0
                end = -1
                for start, stop in ranges:
                    if start > end:
                        runs += 1
                        kept.append(text[at:start])
                    removed += max(0, stop - max(start, end))
                    end = max(end, stop)
                    at = end
                kept.append(text[at:])
                body = b"".join(kept)
                rows.append((len(text), removed, runs, hashlib.sha256(body).hexdigest(), *([body] if keep_text else [])))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[*_names(_SUMMARY), *(["kept"] if keep_text else [])])

    return run


def splitters(texts: DataFrame, span: int, docs: int) -> np.ndarray:
    """Leading bytes that cut the sampled suffixes into equal parts. The sample is bounded and only sets the balance."""

    def sample(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, most_bytes=PIECE):
            head = anchors(*utf8(batch.column(1)), span)[1]
            yield pa.RecordBatch.from_arrays([pa.array(head[::8].tolist(), pa.binary())], names=["head"])

    some = texts.sample(min(1.0, SAMPLE / max(1, docs)), seed=11).mapInArrow(sample, "head binary").limit(100_000)
    heads = np.sort(np.array(some.toPandas()["head"].tolist(), f"S{LEAD}"))
    parts = BUCKETS * parallelism(texts.sparkSession)
    return np.unique(heads[np.arange(1, parts) * len(heads) // parts]) if len(heads) else heads


def covered_ranges(texts: DataFrame, reps: DataFrame, span: int, docs: int, hot: int = HOT) -> DataFrame:
    """(text_key, start, stop) over ``texts`` (text_key, text, doc_id); ``reps`` names one document per text."""
    found = texts.select("text_key", "text").mapInArrow(slim(_leads(span, splitters(texts.select("text_key", "text"), span, docs))), _ANCHORS)
    kept = found.repartition("spread").mapInArrow(slim(_repeated), "bucket int, lead long, text_key long, place int, low int, high int")
    kept = stage(kept, "suffix-anchors")
    crowded = stage(kept.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("lead"), "suffix-hot")
    listed = kept.groupBy("text_key").agg(F.collect_list(F.struct("bucket", "lead", "place", "low", "high")).alias("anchors"))
    named = listed.join(reps, "text_key").select("text_key", F.col("rep").alias("doc_id"), "anchors")
    asked = texts.join(named.withColumnRenamed("text_key", "k").withColumnRenamed("doc_id", "d"), (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")))
    contexts = asked.select("text_key", "text", "anchors").mapInArrow(slim(_contexts(span)), _CONTEXTS)
    many = crowded.count()
    if not many:
        return _in_buckets(contexts, span)
    contexts = stage(contexts, "suffix-contexts")
    crowded = F.broadcast(crowded) if many <= FEW else crowded
    calm = _in_buckets(contexts.join(crowded, "lead", "left_anti").select(_names(_CONTEXTS)), span)
    prints = contexts.join(crowded, "lead", "left_semi").select(_names(_CONTEXTS)).mapInArrow(slim(_fingerprinted(span)), "print binary, text_key long, start long")
    prints = stage(prints.withColumn("salt", F.pmod(F.xxhash64("text_key", "start"), F.lit(SALTS))), "suffix-prints")
    # An anchor that two blocks share, or a text that two tasks took up, gives a string twice: places are counted once.
    once = prints.distinct()
    twice = once.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return calm.union(once.join(twice, ["print", "salt"]).select("text_key", "start", (F.col("start") + span).alias("stop")))


def _in_buckets(contexts: DataFrame, span: int) -> DataFrame:
    """Whole buckets to tasks, one after the other within a task; Spark's sort spills where a partition is large."""
    return contexts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(slim(_settled(span)), "text_key long, start long, stop long")


def suffix_dedup(docs: DataFrame, span: int = 200, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, keep_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_text``, kept (the remaining bytes)."""
    texts = id_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    reps = stage(texts.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep")), "suffix-texts")
    total = reps.agg(F.sum("copies")).first()[0] or 0
    ranges = covered_ranges(texts, reps.select("text_key", "rep"), span, total, hot)
    spans = ranges.groupBy("text_key").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    facts = reps.where("copies > 1").select("text_key", "copies").join(spans, "text_key", "full")
    joined = texts.join(facts, "text_key", "left").select("doc_id", "text", "copies", "starts", "stops")
    return joined.mapInArrow(slim(_cut(span, keep_text)), _SUMMARY + (", kept binary" if keep_text else ""))
