"""Exact Jaccard join of word n-gram sets with prefix trees.

1. Every document becomes its set of shingle hashes; documents with the same set share one mark and count as one.
2. One global order holds for all sets: shingles that are frequent in the corpus come last, the rest go by their hash.
   Two sets that link share a shingle among the first ``n - ceil(p n) + 1`` of each, so only those are posted.
3. Postings meet by shingle. First every set is tried against one pivot, then, in large groups, against the set that
   looks nearest; sets that link this way are joined to components. Then all pairs of different components are tried
   that share enough of their prefixes, and whose parity bitmaps do not differ in more bits than sets that link can
   differ in shingles; nothing that could join two components is left out.
4. Tried pairs are verified against a prefix tree: the partners of a set are stored in a compressed trie in order
   of their hashes, the traversal shares the overlap of common paths and leaves subtrees that cannot reach the threshold any more.

The frequency sketch covers all documents; it orders the sets and never decides a pair. Large posting groups are
split in blocks, so no task takes more than two blocks of one.

Defined results: null and blank texts have an empty set and link with nothing; a document with a null id links with
nothing and is its own (null) component; repeated rows have the same set; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import id_text, mix64, pieces_of, slim, stage, utf8
from wayfold.llm.graph import connected_components
from wayfold.llm.shingles import set_mark, shingles

#: Counters of the frequency sketch and of one slice of it; steps of its classes per doubling. Its size is fixed.
SKETCH, SLICE, STEPS = 1 << 24, 1 << 16, 12
#: Documents beyond which a shingle counts as frequent, at least.
FREQUENT = 16
#: Members from which a posting group is large; bits of a parity bitmap; rounds that link large groups first.
LARGE, BITS, ROUNDS = 32, 1024, 2
#: Ids that may be broadcast to fetch texts; beyond it the fetch is a shuffled join.
FEW = 1_000_000
#: Members of a posting group that one task pairs with each other, and partners that are tried in one trie.
BLOCK, PARTNERS = 1024, 256
_KEYED = "key long, kind int, doc_id long, mark long, n int, bits binary"
_GROUPED = "kind int, doc_id long, mark long, n int, bits binary, token long, members int, pivot long, pivot_n int"


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    data, offs = utf8(batch.column(1))
    hashes, bounds = shingles(data, offs, size)
    cuts = bounds.tolist()
    for at, to in zip(cuts, cuts[1:]):
        own = np.sort(hashes[at:to])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        yield own


def frequency_sketch(texts: DataFrame, size: int) -> np.ndarray:
    """How many documents hold a shingle, by the first bits of its hash: classes c of about 2**(c / STEPS) - 1 documents."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.uint16)
        for batch in pieces_of(batches):
            place = np.sort(np.concatenate([*_sets(batch, size), np.zeros(0, np.uint64)]) >> np.uint64(40)).astype(np.int64)
            bounds = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else place
            many = np.diff(np.concatenate([bounds, [len(place)]]))
            own = place[bounds]
            sketch[own] = np.minimum(sketch[own].astype(np.int64) + many, 65_535)
        yield _slices(sketch)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(zlib.decompress(packed), np.uint16).astype(np.int64)
                total[k] = total.get(k, 0) + own
        classes = [np.minimum(np.log2(1.0 + x) * STEPS, 255).astype(np.uint8) for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in classes], pa.binary())], names=["slice", "packed"])

    def _slices(sketch: np.ndarray) -> pa.RecordBatch:
        parts = [(k, sketch[at : at + SLICE]) for k, at in enumerate(range(0, SKETCH, SLICE))]
        some = [(k, zlib.compress(x.tobytes(), 1)) for k, x in parts if x.any()]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], names=["slice", "packed"])

    schema, out = "slice int, packed binary", np.zeros(SKETCH, np.uint8)
    for row in texts.mapInArrow(slim(count), schema).repartition("slice").mapInArrow(add, schema).toLocalIterator():  # SKETCH bytes in all
        out[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(zlib.decompress(row["packed"]), np.uint8)
    return out


class GlobalOrder:
    """Shingles in global order: by hash, but frequent ones after all others, by frequency and then hash."""

    def __init__(self, sketch: np.ndarray):
        self.sketch = sketch
        # What other shingles add to a counter.
        share = float((np.bincount(sketch, minlength=256) * (np.exp2(np.arange(256) / STEPS) - 1)).sum() / len(sketch))
        self.common = min(254, int(np.log2(1 + max(FREQUENT, share + 6 * share**0.5)) * STEPS))

    def prefix(self, tokens: np.ndarray, length: int) -> np.ndarray:
        """The first ``length`` of a set that is sorted by hash."""
        often = self.sketch[(tokens >> np.uint64(40)).astype(np.int64)]
        late = often > self.common
        if not late.any():
            return tokens[:length]
        rare = tokens[~late]
        if len(rare) >= length:
            return rare[:length]
        last = tokens[late]
        return np.concatenate([rare, last[np.argsort(often[late], kind="stable")]])[:length]


def parity(tokens: np.ndarray) -> bytes:
    """A bitmap with the parity of the tokens that fall on each bit: two differ in no more bits than their sets in tokens."""
    return np.packbits(np.bincount((tokens >> np.uint64(54)).astype(np.int64) % BITS, minlength=BITS) & 1).astype(np.uint8).tobytes()


def prefix_length(n, percent: int):
    """Shingles of a set of ``n`` among which one must be shared with every partner."""
    return n + 1 + (-percent * n) // 100


def needed(n_a, n_b, percent: int):
    """The least overlap at which sets of these sizes link: 100 i >= p (a + b - i)."""
    return -((-percent * (n_a + n_b)) // (100 + percent))


def _keyed(shared, size: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = GlobalOrder(shared.value), set()
        for batch in pieces_of(batches):
            ids = batch.column(0).to_pylist()
            marks, sizes, keys, posted, counts, bits = [], [], [], [], [], []
            for doc, own in zip(ids, _sets(batch, size)):
                mark, n = set_mark(own), len(own)
                marks.append(mark)
                sizes.append(n)
                fresh = n > 0 and doc is not None and mark not in seen
                if fresh:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(mark)
                    posted.append(order.prefix(own, prefix_length(n, percent)))
                counts.append(len(posted[-1]) if fresh else 0)
                keys.append(mark if doc is None else doc)
                bits.append(parity(own) if fresh else None)
            docs, marks, sizes, counts = (np.array(x, np.int64) for x in ([d or 0 for d in ids], marks, sizes, counts))
            spread = mix64(np.array(keys, np.int64).astype(np.uint64)).astype(np.int64)
            tokens = np.concatenate(posted).astype(np.int64) if posted else np.zeros(0, np.int64)
            rows = len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([spread, tokens])),
                    pa.array(np.repeat([0, 1], [rows, len(tokens)]).astype(np.int32)),
                    pa.array(np.concatenate([docs, np.zeros(len(tokens), np.int64)]), mask=np.concatenate([[d is None for d in ids], np.ones(len(tokens), bool)]).astype(bool)),
                    pa.array(np.concatenate([marks, np.repeat(marks, counts)])),
                    pa.array(np.concatenate([sizes, np.repeat(sizes, counts)]).astype(np.int32)),
                    pa.concat_arrays([pa.array(bits, pa.binary()), pa.nulls(len(tokens), pa.binary())]),
                ],
                names=_names(_KEYED),
            )

    return run


def _grouped(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            kind = batch.column(1).to_numpy()
            if (kind == 0).any():
                own = batch.filter(pa.array(kind == 0))
                rows = own.num_rows
                none = [pa.nulls(rows, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int32())]
                yield pa.RecordBatch.from_arrays([own.column(1), own.column(2), own.column(3), own.column(4), own.column(5), *none], names=_names(_GROUPED))
            post = kind == 1
            held.append(np.stack([batch.column(i).to_numpy()[post].astype(np.int64) for i in (0, 3, 4)]))
        if not held:
            return
        token, mark, n = np.concatenate(held, 1)
        order = np.lexsort((mark, token))
        token, mark, n = token[order], mark[order], n[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (mark[1:] != mark[:-1])
        token, mark, n = token[new], mark[new], n[new]
        bounds = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]])) if len(token) else np.zeros(1, int)
        members = np.diff(bounds)
        # The pivot of a group: its member whose mixed mark is least, which similar sets agree on from group to group.
        rank = mix64(mark.astype(np.uint64))
        lead = np.lexsort((rank, np.repeat(np.arange(len(members)), members)))[bounds[:-1]] if len(members) else np.zeros(0, int)
        pivot, pivot_n, many = (np.repeat(x, members) for x in (mark[lead], n[lead], members))
        keep = many > 1
        fits = (pivot != mark) & (100 * np.minimum(n, pivot_n) >= percent * np.maximum(n, pivot_n))
        rows = int(keep.sum())
        for at in range(0, rows, 100_000):
            cut = np.flatnonzero(keep)[at : at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ones(len(cut), np.int32)),
                    pa.nulls(len(cut), pa.int64()),
                    pa.array(mark[cut]),
                    pa.array(n[cut].astype(np.int32)),
                    pa.nulls(len(cut), pa.binary()),
                    pa.array(token[cut]),
                    pa.array(many[cut].astype(np.int32)),
                    pa.array(pivot[cut], mask=~fits[cut]),
                    pa.array(pivot_n[cut].astype(np.int32), mask=~fits[cut]),
                ],
                names=_names(_GROUPED),
            )

    return run


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _cross_pairs(percent: int, nearest: bool):
    """Pairs of different components in each posting group, counted over the groups of the task.

    Columns: token, unit, block, mark, n, comp, bits. ``nearest``: for each member only the one that looks most alike.
    """

    def flush(pairs: list[np.ndarray]) -> pa.RecordBatch:
        a, b, na, nb = np.concatenate(pairs, 1)
        order = np.lexsort((b, a))
        a, b, na, nb = a[order], b[order], na[order], nb[order]
        at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True]]))
        one = at[:-1]
        return pa.RecordBatch.from_arrays([pa.array(a[one]), pa.array(b[one]), pa.array(na[one].astype(np.int32)), pa.array(nb[one].astype(np.int32)), pa.array(np.diff(at))], names=["a", "b", "n_a", "n_b", "shared"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, maps = [], []
        for batch in batches:
            if batch.num_rows:
                data, offs = utf8(batch.column(6))
                held.append(np.stack([*(batch.column(i).to_numpy().astype(np.int64) for i in range(6)), np.diff(offs) > 0]))
                maps.append(data)
        if not held:
            return
        token, unit, block, mark, n, comp, mapped = np.concatenate(held, 1)
        bits = np.concatenate(maps).reshape(-1, BITS // 8).view(np.uint64)
        at_bits = np.cumsum(mapped) - 1
        order = np.lexsort((mark, unit, token))
        token, unit, block, mark, n, comp, mapped, at_bits = (x[order] for x in (token, unit, block, mark, n, comp, mapped, at_bits))
        bounds = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (unit[1:] != unit[:-1]), [True]]))
        members = np.diff(bounds)
        pairs, size = [], 0
        for many in np.unique(members[members > 1]).tolist():
            starts = bounds[:-1][members == many]
            i, j = np.triu_indices(many, 1)
            for k, (x, y) in ((k, cut) for k in range(0, len(starts), max(1, 200_000 // len(i))) for cut in _cuts(i, j)):
                own = starts[k : k + max(1, 200_000 // len(i)), None]
                left, right = (own + x).ravel(), (own + y).ravel()
                ok = (comp[left] != comp[right]) & (100 * np.minimum(n[left], n[right]) >= percent * np.maximum(n[left], n[right]))
                # In the unit of two blocks, the pairs within a block belong to that block's own unit.
                ok &= (unit[left] % 2 == 0) | (block[left] != block[right])
                left, right = left[ok], right[ok]
                both = (mapped[left] & mapped[right]) == 1
                differ = np.zeros(len(left), np.int64)
                differ[both] = np.bitwise_count(bits[at_bits[left[both]]] ^ bits[at_bits[right[both]]]).sum(1)
                total = n[left] + n[right]
                may = differ <= total - 2 * needed(n[left], n[right], percent)
                left, right, differ = left[may], right[may], differ[may]
                if nearest:
                    best = np.argsort(differ, kind="stable")
                    pick = np.unique(np.concatenate([best[np.unique(side[best], return_index=True)[1]] for side in (left, right)])) if len(best) else best
                    left, right = left[pick], right[pick]
                swap = mark[left] > mark[right]
                left, right = np.where(swap, right, left), np.where(swap, left, right)
                pairs.append(np.stack([mark[left], mark[right], n[left], n[right]]))
                size += len(left)
                if size > 2_000_000:
                    yield flush(pairs)
                    pairs, size = [], 0
        if size:
            yield flush(pairs)

    return run


def _cuts(i: np.ndarray, j: np.ndarray, most: int = 200_000) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(i[k : k + most], j[k : k + most]) for k in range(0, len(i), most)]


class PrefixTree:
    """A compressed trie of sets in order of their hashes. A node is [segment, children by first token, ids that end here, least size below, most size below, depth at its start]."""

    def __init__(self):
        self.root: list = [np.zeros(0, np.uint64), {}, [], 1 << 60, 0, 0]

    def insert(self, tokens: np.ndarray, name: int) -> None:
        node, at, n = self.root, 0, len(tokens)
        while True:
            node[3], node[4] = min(node[3], n), max(node[4], n)
            if at == n:
                node[2].append(name)
                return
            first = int(tokens[at])
            child = node[1].get(first)
            if child is None:
                node[1][first] = [tokens[at:], {}, [name], n, n, at]
                return
            segment = child[0]
            m = min(len(segment), n - at)
            differ = np.flatnonzero(segment[:m] != tokens[at : at + m])
            cut = int(differ[0]) if len(differ) else m
            if cut < len(segment):
                middle = [segment[:cut], {int(segment[cut]): child}, [], child[3], child[4], at]
                child[0], child[5] = segment[cut:], at + cut
                node[1][first] = child = middle
            node, at = child, at + cut

    def links(self, probe: np.ndarray, percent: int) -> Iterator[int]:
        """The sets that link with ``probe``. Subtrees are left when even all that remains could not reach the threshold."""
        n, stack = len(probe), [(self.root, 0)]
        while stack:
            (segment, children, names, least, most, depth), overlap = stack.pop()
            if len(segment):
                at = np.searchsorted(probe, segment)
                overlap += int(np.count_nonzero(probe[np.minimum(at, n - 1)] == segment))
                depth += len(segment)
                remaining = n - int(at[-1])
            else:
                remaining = n
            if overlap + min(remaining, most - depth) < needed(n, least, percent):
                continue
            if names and overlap >= needed(n, depth, percent):
                yield from names
            stack += [(child, overlap) for child in children.values()]


def _verify(percent: int):
    """Rows come sorted by (a, salt, role): the set of a, then those of its partners."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, probe, tree, out = None, None, None, []

        def done() -> None:
            if probe is not None and tree is not None:
                out.extend((group[0], b) for b in tree.links(probe, percent))

        for batch in batches:
            a, salt, role, b = (batch.column(i).to_pylist() for i in range(4))
            for k, own in enumerate(zip(a, salt)):
                if own != group:
                    done()
                    group, probe, tree = own, None, PrefixTree()
                tokens = np.frombuffer(batch.column(4)[k].as_buffer(), np.uint64)
                if role[k] == 0:
                    probe = tokens
                else:
                    tree.insert(tokens, b[k])
            if len(out) > 50_000:
                yield _edges(out)
                out = []
        done()
        yield _edges(out)

    def _edges(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return run


def _fetched(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(mark, tokens): the sets of the documents in ``wanted``. Their ids are broadcast only if they are few."""
    wanted = stage(wanted.distinct(), "ngrams-wanted")
    few = wanted.count() <= FEW

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            own = list(_sets(batch, size))
            marks = pa.array([set_mark(x) for x in own], pa.int64())
            yield pa.RecordBatch.from_arrays([marks, pa.array([x.tobytes() for x in own], pa.binary())], names=["mark", "tokens"])

    found = texts.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
    return stage(found.mapInArrow(slim(run), "mark long, tokens binary"), "ngrams-sets").dropDuplicates(["mark"])


def _verified(texts: DataFrame, owners: DataFrame, pairs: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) of marks that link."""
    pairs = stage(pairs.select("a", "b"), f"ngrams-pairs-{name}")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("mark")).distinct()
    sets = _fetched(texts, ends.join(owners, "mark").select("doc_id"), size)
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("salts"))
    salted = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), "b")
    partners = salted.join(sets.withColumnRenamed("mark", "b"), "b").select("a", "salt", F.lit(1).alias("role"), "b", "tokens")
    probes = salted.select("a", "salt").distinct().join(sets.withColumnRenamed("mark", "a"), "a").select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("b"), "tokens")
    rows = partners.unionByName(probes).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return stage(rows.mapInArrow(_verify(percent), "a long, b long"), f"ngrams-edges-{name}")


_PAIRS = "a long, b long, n_a int, n_b int, shared long"


def _dealt(posts: DataFrame, labels: DataFrame, maps: DataFrame) -> DataFrame:
    """Postings by shingle with the component of each set; large groups in blocks, with bitmaps."""
    labelled = posts.select("token", "mark", "n", "members").join(labels.withColumnRenamed("node", "mark"), "mark", "left")
    small = labelled.where(F.col("members") <= LARGE).withColumn("bits", F.lit(b""))
    both = small.unionByName(labelled.where(F.col("members") > LARGE).join(maps, "mark"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("long")
    dealt = both.select("token", "mark", F.col("n").cast("long").alias("n"), F.coalesce("component", "mark").alias("comp"), F.pmod(F.xxhash64("mark"), blocks).alias("block"), blocks.alias("blocks"), "bits")
    # Unit 2 (i B + j) + [i <> j] pairs blocks i and j: each row goes to the units of its block.
    low, high = F.least("block", "other"), F.greatest("block", "other")
    units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    units = units.select("token", (2 * (low * F.col("blocks") + high) + (low != high).cast("long")).alias("unit"), "block", "mark", "n", "comp", "bits")
    return units.repartition("token", "unit")


def ngram_join(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    texts = id_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(frequency_sketch(texts, size))
    keyed = texts.mapInArrow(slim(_keyed(shared, size, percent)), _KEYED)
    grouped = stage(keyed.repartition("key").mapInArrow(slim(_grouped(percent)), _GROUPED), "ngrams-grouped")
    marked = grouped.where("kind = 0").select("doc_id", "mark", "n", "bits")
    owners = marked.where("n > 0 and doc_id is not null").groupBy("mark").agg(F.min("doc_id").alias("doc_id"))
    posts = grouped.where("kind = 1")

    # Each set against one pivot: the one it shares most postings with, if that is a fair part of its prefix.
    met = posts.where("pivot is not null").groupBy("pivot", "mark").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n"))
    fair = met.where(F.col("shared") * 3 >= prefix_length_sql("n", percent))
    best = fair.groupBy("mark").agg(F.max(F.struct("shared", F.col("pivot").alias("a"))).alias("best"))
    starred = _verified(texts, owners, best.select("best.a", F.col("mark").alias("b")), size, percent, "star")
    links = starred

    # In large groups, each set against the one that looks nearest, among those not yet in its component.
    large = posts.where(F.col("members") > LARGE)
    maps = marked.where("bits is not null").groupBy("mark").agg(F.first("bits").alias("bits"))
    for k in range(0 if large.isEmpty() else ROUNDS):
        rows = _dealt(large, connected_components(links, f"ngrams-near{k}"), maps).mapInArrow(slim(_cross_pairs(percent, True)), _PAIRS)
        found = _verified(texts, owners, rows.select("a", "b").distinct(), size, percent, f"near{k}")
        links = links.union(found)

    # Then every pair of different components that can still reach the threshold.
    labels = connected_components(links, "ngrams-near")
    rows = _dealt(posts, labels, maps).mapInArrow(slim(_cross_pairs(percent, False)), _PAIRS)
    pairs = rows.groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))
    # What follows the prefixes adds at most the rest of the set whose prefix ends first.
    rest = F.greatest(*(F.col(n) - prefix_length_sql(n, percent) for n in ("n_a", "n_b")))
    least = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / F.lit(100.0 + percent) - 1e-9)
    crossed = _verified(texts, owners, pairs.where(F.col("shared") + rest >= least), size, percent, "cross")

    comps = connected_components(links.union(crossed), "ngrams-all").withColumnRenamed("node", "mark")
    lowest = owners.join(comps, "mark", "left").withColumn("component", F.coalesce("component", "mark"))
    roots = lowest.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = lowest.join(roots, "component").select("mark", "component_id")
    own = marked.where("n = 0 or doc_id is null").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    linked = marked.where("n > 0 and doc_id is not null").join(ids, "mark").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return linked.unionByName(own)


def prefix_length_sql(n: str, percent: int):
    """``prefix_length`` as a column."""
    return F.col(n) + 1 - F.expr(f"({percent} * {n} + 99) div 100")
