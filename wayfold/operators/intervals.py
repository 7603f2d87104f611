"""Interval algebra per key: merge, occupancy, episodes, painting, overlap joins. Intervals are half-open in microseconds."""

from __future__ import annotations

from bisect import insort
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.sequences import walked

DAY = 86_400_000_000
#: Intervals that one task sorts, about.
PART = 250_000


def parts(df: DataFrame) -> int:
    """Into how many parts a table of intervals is dealt. Counts its rows: for tables as they are read, not for long plans."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PART))


def merged(df: DataFrame, keys: list[str], start: str = "enter", end: str = "leave", tolerance_us: int = 0) -> DataFrame:
    """The union of the intervals of each key; touching ones join. Adds the number of intervals of each union."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(F.col(start) <= reach + tolerance_us, 0).otherwise(1))
    marked = marked.withColumn("__grp", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__grp").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("__grp")


def occupancy(df: DataFrame, keys: list[str], start: str = "enter", end: str = "leave", bucket_us: int = 30 * DAY) -> DataFrame:
    """Step function: how many intervals are open from ``us``, in the bucket of time ``bucket``, until ``until``. Empty intervals do not count.

    Levels are running sums in two steps, over the buckets of time of a key and within each bucket, so that the steps of
    one busy key spread over its buckets.
    """
    ends = F.explode(F.array(F.struct(F.col(start).alias("us"), F.lit(1).alias("d")), F.struct(F.col(end).alias("us"), F.lit(-1).alias("d"))))
    flat = df.where(F.col(start) < F.col(end)).select(*keys, ends.alias("__e")).select(*keys, "__e.us", "__e.d", F.floor(F.col("__e.us") / bucket_us).alias("bucket"))
    # No bucket is null; said here, both readings of the steps have the same filter and share one shuffle.
    flat = flat.where(F.col("bucket").isNotNull())
    # Dealt once by bucket: sums by time, sums by bucket and the windows within buckets all keep to that. As many parts as
    # the rows ask for, so that what a task sorts and sums does not grow with the table.
    steps = flat.repartition(parts(df), *keys, "bucket").groupBy(*keys, "bucket", "us").agg(F.sum("d").alias("d")).where("d <> 0")
    order = Window.partitionBy(*keys).orderBy("bucket")
    buckets = steps.groupBy(*keys, "bucket").agg(F.sum("d").alias("__d"), F.min("us").alias("__first"))
    before = F.coalesce(F.sum("__d").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.select(*keys, "bucket", before.alias("__before"), F.lead("__first").over(order).alias("__next"))
    within = Window.partitionBy(*keys, "bucket").orderBy("us")
    level = F.col("__before") + F.sum("d").over(within.rowsBetween(Window.unboundedPreceding, 0))
    until = F.coalesce(F.lead("us").over(within), F.col("__next"))
    return steps.join(buckets, [*keys, "bucket"]).select(*keys, "bucket", "us", level.alias("level"), until.alias("until"))


def level_time(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Time spent at each level above 0."""
    return steps.where("level > 0 and until is not null").groupBy(*keys, "level").agg(F.sum(F.col("until") - F.col("us")).alias("at_level_us"))


def weighted_percentile(df: DataFrame, keys: list[str], value: str, weight: str, share: float) -> DataFrame:
    """The least value at which the weight so far reaches ``share`` of all weight of the key."""
    order = Window.partitionBy(*keys).orderBy(value)
    so_far = F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(weight).over(Window.partitionBy(*keys))
    return df.withColumn("__so_far", so_far).withColumn("__total", total).where(F.col("__so_far") >= F.col("__total") * share).groupBy(*keys).agg(F.min(value).alias(value))


def runs_at_least(steps: DataFrame, keys: list[str], threshold: Column) -> DataFrame:
    """Maximal spans in which the level of ``occupancy`` stays at the threshold or above, with their peak.

    Runs are found within buckets, as the steps are dealt; those that touch are then one. Only runs meet by key.
    """
    within = Window.partitionBy(*keys, "bucket").orderBy("us")
    marked = steps.withColumn("__on", (F.col("level") >= threshold) & F.col("until").isNotNull())
    starts = F.col("__on") & ~F.coalesce(F.lag("__on").over(within), F.lit(False))
    numbered = marked.withColumn("__grp", F.sum(starts.cast("int")).over(within.rowsBetween(Window.unboundedPreceding, 0))).where("__on")
    pieces = numbered.groupBy(*keys, "bucket", "__grp").agg(F.min("us").alias("enter"), F.max("until").alias("leave"), F.max("level").alias("peak"))
    order = Window.partitionBy(*keys).orderBy("enter")
    begins = F.coalesce(F.lag("leave").over(order) < F.col("enter"), F.lit(True))
    joined = pieces.withColumn("__new", begins.cast("int")).withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy(*keys, "__run").agg(F.min("enter").alias("enter"), F.max("leave").alias("leave"), F.max("peak").alias("peak")).drop("__run")


def split_by_day(df: DataFrame, start: str = "enter", end: str = "leave") -> DataFrame:
    """One row per interval and day it touches, with the microseconds in that day."""
    last = F.greatest(F.col(start), F.col(end) - 1)
    days = F.sequence(F.floor(F.col(start) / DAY), F.floor(last / DAY))
    cut = df.withColumn("day", F.explode(days))
    inside = F.least(F.col(end), (F.col("day") + 1) * DAY) - F.greatest(F.col(start), F.col("day") * DAY)
    return cut.withColumn("in_day_us", inside)


def overlap_join(left: DataFrame, right: DataFrame, key: str, bucket_us: int, l_start: str, l_end: str, r_start: str, r_end: str) -> DataFrame:
    """Pairs of one key whose half-open spans overlap.

    Both sides are cut into buckets of time and joined on (key, bucket), so one busy key spreads over its buckets; each
    pair is kept in the bucket where its overlap begins. Column names of the two sides must differ but for the key.
    """
    buckets = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket_us), F.floor(F.greatest(F.col(a), F.col(b) - 1) / bucket_us)))
    a = left.withColumn("__bucket", buckets(l_start, l_end))
    b = right.withColumn("__bucket", buckets(r_start, r_end))
    hit = (F.col(l_start) < F.col(r_end)) & (F.col(r_start) < F.col(l_end))
    first = F.floor(F.greatest(F.col(l_start), F.col(r_start)) / bucket_us) == F.col("__bucket")
    return a.join(b, [key, "__bucket"]).where(hit & first).drop("__bucket")


class _Painter:
    """Paints the layers of one key in order of their starts; holds the layers that are open."""

    def __init__(self):
        self.open: list[tuple] = []  # (priority, kind, end), the highest last
        self.at: int | None = None
        self.stroke: list | None = None  # kind, from, to

    def _paint(self, kind, start: int, end: int) -> list[tuple]:
        if self.stroke and self.stroke[0] == kind and self.stroke[2] == start:
            self.stroke[2] = end
            return []
        done, self.stroke = self.stroke, [kind, start, end]
        return [tuple(done)] if done else []

    def _advance(self, to: int | None) -> list[tuple]:
        out: list[tuple] = []
        while self.open and (to is None or self.at < to):
            _, kind, end = self.open[-1]
            if end <= self.at:
                self.open.pop()
                continue
            until = end if to is None else min(end, to)
            out += self._paint(kind, self.at, until)
            self.at = until
        return out

    def step(self, start: int, end: int, priority, kind) -> list[tuple]:
        if end <= start:
            return []
        out = self._advance(start)
        self.at = start
        insort(self.open, (priority, kind, end))
        if len(self.open) > 64 and len(self.open) & (len(self.open) - 1) == 0:  # now and then those that ended below others go
            self.open = [x for x in self.open if x[2] > start]
        return out

    def end(self) -> list[tuple]:
        return self._advance(None) + ([tuple(self.stroke)] if self.stroke else [])


def painted(layers: DataFrame, key: str, start: str = "enter", end: str = "leave", priority: str = "priority", kind: str = "kind") -> DataFrame:
    """A timeline in which higher priorities (then greater kinds) cover lower ones: (key, kind, start, end). One sweep per key."""
    kinds = {f.name: f.dataType.simpleString() for f in layers.schema}
    schema = f"{key} {kinds[key]}, {kind} {kinds[kind]}, {start} long, {end} long"
    return walked(layers, key, [start, end, priority, kind], [start, end], _Painter, schema)


class Copies:
    """Copies of one event among the rows (start, end, trip, *name) of one key, in order of start and end.

    Rows of different trips that overlap are linked, touching ones too if ``touching`` is set; equal spans always are;
    rows of one trip are not linked to each other otherwise. Gives (*name, event) when an event is over; its number is
    that of its first row. Holds the rows that are open and the names of events that are not over, no more.
    """

    def __init__(self, touching: bool = False):
        self.touching = touching
        self.n = 0
        self.before: tuple | None = None  # the span before, and its row
        self.ends: list[tuple[int, int]] = []  # (end, row) of the open rows, a heap
        self.parent: dict[int, int] = {}
        self.names: dict[int, list[tuple]] = {}  # by root: row, name
        self.trips: dict[int, dict] = {}  # by root: trip -> open rows
        self.alone: dict = {}  # trip -> roots whose open rows are all of it
        self.mixed: set[int] = set()
        self.trip_of: dict[int, object] = {}

    def _root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _unfile(self, root: int) -> None:
        self.mixed.discard(root)
        for trip in self.trips[root] if len(self.trips[root]) == 1 else ():
            own = self.alone.get(trip)
            if own:
                own.discard(root)
                if not own:
                    del self.alone[trip]

    def _file(self, root: int) -> None:
        trips = self.trips[root]
        if len(trips) > 1:
            self.mixed.add(root)
        elif trips:
            self.alone.setdefault(next(iter(trips)), set()).add(root)

    def _union(self, a: int, b: int) -> int:
        a, b = self._root(a), self._root(b)
        if a == b:
            return a
        if len(self.names[a]) < len(self.names[b]):
            a, b = b, a
        self._unfile(a)
        self._unfile(b)
        self.parent[b] = a
        self.names[a] += self.names.pop(b)
        for trip, n in self.trips.pop(b).items():
            self.trips[a][trip] = self.trips[a].get(trip, 0) + n
        self._file(a)
        return a

    def _close(self, before: int | None) -> list[tuple]:
        """Rows that ended before ``before`` (null: all) are no longer open; events without an open row are over."""
        out: list[tuple] = []
        while self.ends and (before is None or self.ends[0][0] < before or self.ends[0][0] == before and not self.touching):
            _, row = heappop(self.ends)
            root, trip = self._root(row), self.trip_of.pop(row)
            self._unfile(root)
            self.trips[root][trip] -= 1
            if not self.trips[root][trip]:
                del self.trips[root][trip]
            self._file(root)
            if not self.trips[root]:
                del self.trips[root]
                own = self.names.pop(root)
                event = min(i for i, _ in own)
                out += [(*name, event) for _, name in own]
                for i, _ in own:
                    del self.parent[i]
        return out

    def step(self, start: int, end: int, trip, *name) -> list[tuple]:
        same = self.before is not None and self.before[:2] == (start, end)
        out = [] if same else self._close(start)
        row, self.n = self.n, self.n + 1
        self.parent[row], self.names[row], self.trips[row], self.trip_of[row] = row, [(row, name)], {trip: 1}, trip
        others = [root for t, roots in self.alone.items() if t != trip for root in roots] if len(self.alone) > (trip in self.alone) else []
        others += self.mixed
        self._file(row)
        for other in others:
            self._union(row, other)
        if same:
            self._union(row, self.before[2])
        heappush(self.ends, (end, row))
        self.before = (start, end, row)
        return out

    def end(self) -> list[tuple]:
        return self._close(None)


def copies(df: DataFrame, key: str, trip: str, names: list[str], start: str = "enter", end: str = "leave", touching: bool = False) -> DataFrame:
    """(key, *names, event): rows that are copies of one event have its number, that of its first row within the key."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in (key, *names)), "event long"])
    return walked(df, key, [start, end, trip, *names], [start, end, trip, *names], lambda: Copies(touching), schema)
