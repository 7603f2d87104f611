"""Phrase collocation mining with an FM-index per shard over word ids.

A task gathers the words of a language until they make a shard and builds a bidirectional FM-index over their ids: two
Burrows-Wheeler transforms, of the words and of the words read backwards, with rank tables. An interval of one and its
twin of the other stand for all occurrences of a phrase; ``extend_right`` and ``extend_left`` give the intervals of all
longer phrases and with them the counts. Rows are sorted by ``longest`` words only, which intervals of phrases of that
length need. Shards are added up by shuffles over phrases.

Two passes keep the shuffle small without losing a phrase. The first adds up the pairs of words by 64-bit hashes; those
that reach ``least`` set bits in a filter of ``FILTER_BITS`` bits, its size whatever the corpus. The second pass emits
the pairs that the filter lets through and the longer phrases all of whose pairs it lets through. No phrase that reaches
``least`` can be missing; a false positive of the filter only costs a row, as the exact counts decide in the end.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows count as often as they
occur; ids are not looked at; texts of any length are taken whole; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import mix64, parallelism, pieces_of, slim, stage, utf8, whole_text

#: Words of a shard; texts are not cut, so a longer one is a shard of its own.
SHARD = 1_200_000
#: Bits of the filter of frequent pairs (8 MB).
FILTER_BITS = 1 << 26
#: A part of phrases that makes 1/RARE of all words or more is frequent enough to be dealt over ``SALTS`` tasks.
RARE, SALTS = 512, 16
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[[ord(c) for c in ".,;:!?"]] = 2
_KIND[10:14] = 2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_COUNTED = "lang string, words int, phrase string, n long"


def split_words(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of a column of texts, and whether each opens a piece: a separator or the start of its text stands before it."""
    if len(data) == 0:
        return pa.array([], pa.large_binary()), np.zeros(0, bool)
    kind = _KIND[data]
    inside = kind == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    starts, stops = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(stops)
    breaks = np.cumsum((kind == 2) | edge[:-1])[first]
    opens = np.ones(len(first), bool)
    opens[1:] = breaks[1:] != breaks[:-1]
    ends = np.concatenate([[0], np.cumsum(last - first + 1)])
    bytes_ = _FOLD[data[inside]]
    return pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(bytes_)]), opens


@dataclass
class Phrases:
    """Phrases of one length: their symbols, the start of their intervals in both indexes, and their counts."""

    symbols: np.ndarray  # (phrases, words)
    forward: np.ndarray
    backward: np.ndarray
    count: np.ndarray

    def where(self, keep: np.ndarray) -> Phrases:
        return Phrases(self.symbols[keep], self.forward[keep], self.backward[keep], self.count[keep])


class _Transform:
    """A Burrows-Wheeler transform whose rows are sorted by ``depth`` symbols, with rank queries."""

    def __init__(self, text: np.ndarray, size: int, starts: np.ndarray, depth: int):
        n = len(text)
        rank, kinds = text.astype(np.int64), size
        for k in range(1, depth):
            key = rank * size + np.roll(text, -k)
            order = np.argsort(key)
            if k == depth - 1:
                break
            new = np.empty(n, np.int64)
            sorted_keys = key[order]
            new[order] = np.cumsum(np.concatenate([[0], sorted_keys[1:] != sorted_keys[:-1]]))
            rank, kinds = new, n
        self.before = np.roll(text, 1)[order]  # the symbol that stands before the one a row begins with
        self.starts = starts
        self.rows = n + 1
        places = np.argsort(self.before, kind="stable")
        self.places = self.before[places].astype(np.int64) * self.rows + places

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before the rows above ``row``."""
        return np.searchsorted(self.places, symbol * self.rows + row) - self.starts[symbol]

    def extended(self, start: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        """For each interval and each symbol before its rows: the interval, the symbol, how often, how often smaller ones, and the new start."""
        total = int(count.sum())
        of = np.repeat(np.arange(len(start)), count)
        row = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
        key, n = np.unique(of * size + self.before[row], return_counts=True)
        of, symbol = np.divmod(key, size)
        seen = np.cumsum(n) - n
        head = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool)
        smaller = seen - np.maximum.accumulate(np.where(head, seen, 0))
        keep = symbol > 0
        of, symbol, n, smaller = of[keep], symbol[keep], n[keep], smaller[keep]
        return of, symbol, n, smaller, self.starts[symbol] + self.rank(symbol, start[of])


class PhraseIndex:
    """A bidirectional FM-index of the words of a shard. Symbol 0 stands between pieces, word k is symbol k + 1."""

    def __init__(self, ids: np.ndarray, opens: np.ndarray, n_words: int, depth: int = 3):
        self.size = n_words + 1
        at = np.arange(len(ids)) + np.cumsum(opens)
        text = np.zeros(len(ids) + int(opens.sum()) + 1, np.int32)
        text[at] = ids + 1
        counts = np.bincount(text, minlength=self.size)
        self.counts = counts
        self.starts = np.cumsum(counts) - counts
        depth = max(depth, 2)
        self.forward = _Transform(text, self.size, self.starts, depth)
        self.backward = _Transform(text[::-1].copy(), self.size, self.starts, depth)

    def words(self) -> Phrases:
        symbols = np.arange(1, self.size)
        return Phrases(symbols[:, None], self.starts[1:], self.starts[1:], self.counts[1:])

    def extend_left(self, phrases: Phrases) -> Phrases:
        of, symbol, n, smaller, start = self.forward.extended(phrases.forward, phrases.count, self.size)
        return Phrases(np.column_stack([symbol, phrases.symbols[of]]), start, phrases.backward[of] + smaller, n)

    def extend_right(self, phrases: Phrases) -> Phrases:
        of, symbol, n, smaller, start = self.backward.extended(phrases.backward, phrases.count, self.size)
        return Phrases(np.column_stack([phrases.symbols[of], symbol]), phrases.forward[of] + smaller, start, n)


@dataclass
class _Shard:
    """The words of one language that a task has gathered."""

    lang: str
    words: list[pa.Array]
    opens: list[np.ndarray]
    n: int = 0

    def index(self, depth: int) -> tuple[PhraseIndex, pa.Array]:
        coded = pa.concat_arrays(self.words).dictionary_encode()
        return PhraseIndex(coded.indices.to_numpy(), np.concatenate(self.opens), len(coded.dictionary), depth), coded.dictionary


def _shards(batches: Iterable[pa.RecordBatch], shard: int) -> Iterator[_Shard]:
    open_: dict[str, _Shard] = {}
    for batch in pieces_of(batches, most_bytes=4 << 20):
        langs = batch.column(0).dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            own = batch.filter(pc.equal(langs.indices, k))
            words, opens = split_words(*utf8(own.column(1)))
            if len(words) == 0:
                continue
            held = open_.setdefault(lang, _Shard(lang, [], []))
            held.words.append(words)
            held.opens.append(opens)
            held.n += len(words)
        # All languages together stay within the bound, the largest goes first.
        while open_ and sum(x.n for x in open_.values()) >= shard:
            yield open_.pop(max(open_, key=lambda x: open_[x].n))
    yield from open_.values()


def _pair_keys(lang: str, hashes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """64-bit hashes of the first two words of each phrase within their language."""
    first, second = hashes[symbols[:, 0] - 1], hashes[symbols[:, 1] - 1]
    return mix64(first * np.uint64(0x9E3779B97F4A7C15) + second + np.uint64(xxhash.xxh3_64_intdigest(lang)))


def _hashes(words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()], np.uint64)


def _pairs(shard: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _shards(batches, shard):
            index, words = own.index(2)
            pairs = index.extend_right(index.words())
            yield pa.RecordBatch.from_arrays([pa.array(_pair_keys(own.lang, _hashes(words), pairs.symbols).view(np.int64)), pa.array(pairs.count)], names=["key", "n"])

    return run


def _spelt(lang: str, words: pa.Array, phrases: Phrases) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(phrases.count), 200_000):
        symbols = phrases.symbols[at : at + 200_000]
        parts = [words.take(pa.array(column - 1)) for column in symbols.T]
        joined = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", words.type))
        n = len(joined)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * n, pa.string()), pa.array(np.full(n, symbols.shape[1], np.int32)), joined.cast(pa.large_string()).cast(pa.string()), pa.array(phrases.count[at : at + 200_000])],
            names=["lang", "words", "phrase", "n"],
        )


def _phrases(shared, shard: int, longest: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for own in _shards(batches, shard):
            index, words = own.index(longest)
            hashes = _hashes(words)
            frequent = lambda found: found.where(_marked(bits, _pair_keys(own.lang, hashes, found.symbols)))  # noqa: E731, B023
            total = pa.RecordBatch.from_arrays([pa.array([own.lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([own.n])], names=["lang", "words", "phrase", "n"])
            yield total
            phrases = index.words()
            yield from _spelt(own.lang, words, phrases)
            for length in range(2, longest + 1):
                phrases = frequent(index.extend_right(phrases) if length == 2 else index.extend_left(phrases))
                yield from _spelt(own.lang, words, phrases)

    return run


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for place in _filter_places(keys, 64 * len(bits)):
        found &= (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0
    return found


def _filter_places(keys: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a filter for each key; ``n_bits`` is a power of two of at most 2**32."""
    mask = np.uint64(n_bits - 1)
    return keys & mask, (keys >> np.uint64(32)) & mask


def frequent_pairs(rows: DataFrame, least: int, shard: int, n_bits: int) -> np.ndarray:
    """The filter of the pairs that may reach ``least``. At most ``n_bits`` / 64 rows reach the driver."""
    spark = rows.sparkSession
    pairs = rows.mapInArrow(slim(_pairs(shard)), "key long, n long")
    counted = pairs.repartition(parallelism(spark), "key").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    mask = F.lit(n_bits - 1).cast("long")
    places = F.array(F.col("key").bitwiseAND(mask), F.shiftrightunsigned("key", 32).bitwiseAND(mask))
    words = counted.select(F.explode(places).alias("place")).select(F.shiftrightunsigned("place", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(n_bits // 64, np.uint64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, shard: int = SHARD, n_bits: int = FILTER_BITS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, words, phrase, n): every phrase of 1 to ``longest`` words that occurs ``least`` times; words 0 has the number of words of a language."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), whole_text(text_col).alias("text"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent_pairs(rows, least, shard, n_bits))
    found = rows.mapInArrow(slim(_phrases(shared, shard, longest)), _COUNTED)
    counted = found.repartition(parallelism(spark), "lang", "phrase").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return stage(counted.where((F.col("n") >= least) | (F.col("words") == 0)).select("lang", "words", "phrase", "n"), "collocations-counted")


def _looked_up(cuts: DataFrame, part: str, parts: DataFrame, hot: DataFrame, name: str) -> DataFrame:
    """Add the count of ``part``. What few parts many phrases share is dealt over tasks."""
    of = parts.join(F.broadcast(hot), ["lang", "phrase"], "left")
    of = of.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    of = of.select(F.col("lang").alias("__lang"), F.col("phrase").alias("__part"), F.col("salt").alias("__salt"), F.col("n").alias(name))
    marked = cuts.join(F.broadcast(hot.select(F.col("lang"), F.col("phrase").alias(part), "hot")), ["lang", part], "left")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).otherwise(0)
    joined = marked.withColumn("__s", salt).join(of, (F.col("lang") == F.col("__lang")) & (F.col(part) == F.col("__part")) & (F.col("__s") == F.col("__salt")))
    return joined.drop("__lang", "__part", "__salt", "__s", "hot")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (l r)), exactly: counts stay below 10**16, products below 10**38."""
    wide = lambda x: x.cast("decimal(16,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2_000, inside_percent: int = 50,
    shard: int = SHARD, n_bits: int = FILTER_BITS, text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts = phrase_counts(docs, longest, least, shard, n_bits, text_col, lang_col)
    totals = counts.where("words = 0").select("lang", F.col("n").alias("total"))
    parts = counts.where("words > 0").select("lang", "phrase", "n")
    corpus = totals.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("corpus"))
    # At most RARE words, and as many phrases of each length, are so frequent.
    hot = parts.crossJoin(F.broadcast(corpus)).where(F.col("n") * RARE >= F.col("corpus")).select("lang", "phrase", F.lit(True).alias("hot"))

    found = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    run = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", run(F.lit(1), F.col("k")).alias("head"), run(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    measured = _looked_up(_looked_up(cuts, "head", parts, hot, "l"), "tail", parts, hot, "r")
    scored = measured.select("lang", "phrase", "a", "l", "r", "k", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.score", "x.a", "x.l", "x.r")

    # What a longer candidate holds, with the greatest count of such a one.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda start: run(start, size))))
    held = found.where("words > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer"))
    held = held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = lowest.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside_percent))

    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = free.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).where(F.col("rank") <= top)
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")

