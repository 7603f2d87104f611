"""Components, copies of events, painted timelines and scenes against plain versions."""

import random
import time

import pytest
from pyspark.sql import functions as F

from wayfold.operators import intervals as I
from wayfold.operators.clusters import dbscan
from wayfold.operators.components import components
from wayfold.operators.scenes import centroids, same_places, scenes


def plain_components(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "odd"])
def test_components(spark, shape):
    rng = random.Random(4)
    order = rng.sample(range(300), 300)
    links = {
        "chain": list(zip(order, order[1:])),
        "star": [(7, i) for i in range(200)] + [(500, 501), (501, 502)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(250)],
        "odd": [(1, 1), (None, 2), (3, None), (4, 5), (4, 5), (5, 4)],
    }[shape]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == plain_components(links)
    if shape == "odd":
        assert components(spark.createDataFrame([], "a string, b string")).collect() == []


def plain_copies(rows, touching):
    """rows: (start, end, trip, name), in order; the event of each."""
    links = []
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            over = a[0] <= b[1] and b[0] <= a[1] if touching else a[0] < b[1] and b[0] < a[1]
            if a[:2] == b[:2] or a[2] != b[2] and over:
                links.append((i, j))
    found = plain_components(links)
    return {row[3]: found.get(i, i) for i, row in enumerate(rows)}


@pytest.mark.parametrize("touching", [False, True])
def test_copies_equal_all_pairs(touching):
    rng = random.Random(touching)
    for _ in range(600):
        n, wide = rng.randint(1, 30), rng.choice([8, 30, 200])
        rows = sorted((s := rng.randrange(wide), s + rng.choice([0, 0, 1, 2, 5, 20]), rng.randrange(3), k) for k in range(n))
        machine = I.Copies(touching)
        found = [x for r in rows for x in machine.step(*r)] + machine.end()
        assert dict(found) == plain_copies(rows, touching), rows
        assert len(found) == n and not machine.parent and not machine.names and not machine.trips and not machine.alone and not machine.mixed


def test_a_hundred_thousand_stays_of_one_vehicle():
    """Every stay overlaps many others; what is over is let go."""
    machine, most, out = I.Copies(), 0, 0
    begun = time.time()
    for k in range(100_000):
        start = k // 50 * 1_000 + k % 50
        out += len(machine.step(start, start + (400 if k % 50 < 49 else 600), k % 7, k))
        most = max(most, len(machine.parent))
    out += len(machine.end())
    assert out == 100_000 and most <= 100 and time.time() - begun < 30
    same = I.Copies()
    for k in range(20_000):
        same.step(k, 1_000_000 + k, 1, k)  # one trip: open together and never linked
    assert len({e for _, e in same.end()}) == 20_000


def test_painting_equals_atoms(spark):
    rng = random.Random(6)
    rows = [(v, s := rng.randrange(60), s + rng.choice([0, 1, 3, 20, 60]), rng.randrange(4), rng.choice("abc")) for v in range(40) for _ in range(rng.randint(1, 12))]
    want = []
    for v in range(40):
        own = [r for r in rows if r[0] == v]
        line = [max(((p, k) for _, a, b, p, k in own if a <= t < b), default=(0, None))[1] for t in range(130)]
        cuts = {x for r in own for x in r[1:3] if r[1] < r[2]}
        start = None
        for t in range(130):
            if line[t] != (line[t - 1] if t else None):
                if start is not None and line[t - 1] is not None:
                    want.append((v, line[t - 1], start, t))
                start = t
        assert cuts or not [w for w in want if w[0] == v]
    got = I.painted(spark.createDataFrame(rows, "v int, enter long, leave long, priority int, kind string"), "v")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def square(zone, lat, lon, half):
    return (zone, [lat - half, lat - half, lat + half, lat + half], [lon - half, lon + half, lon + half, lon - half], (2 * half) ** 2 * 2)


PLACES = [square(1, 0, 0, 1_000), square(2, 300, 0, 1_100), square(3, 0, 0, 10_000), square(4, 50_000, 0, 1_000), square(5, 500, 200, 1_400), (6, [0, 0, 0], [0, 10, 20], 0)]


def test_same_places(spark):
    places = spark.createDataFrame(PLACES, "zone long, lats array<long>, lons array<long>, area2 long")
    assert {(r.zone, r.lat6, r.lon6) for r in centroids(places).collect() if r.zone < 6} == {(1, 0, 0), (2, 300, 0), (3, 0, 0), (4, 50_000, 0), (5, 500, 200)}
    assert {tuple(r) for r in same_places(places, 4.0).collect()} == {(1, 2), (1, 5), (2, 5)}


def test_scenes(spark):
    places = spark.createDataFrame(PLACES, "zone long, lats array<long>, lons array<long>, area2 long")
    eps = [
        (10, 1, 1, 0, 100, "abc"), (11, 1, 2, 50, 150, "bcd"), (12, 1, 5, 140, 300, "cdef"),  # a chain: 10-11-12
        (13, 1, 2, 100, 120, "abc"),  # touches 10, which it does not overlap; its crowd is not that of the others
        (20, 1, 1, 500, 600, "xyz"), (21, 1, 2, 500, 600, "uvw"),  # same time and place, other vehicles
        (30, 1, 1, 700, 800, "abc"), (31, 2, 2, 700, 800, "abc"),  # another plant
        (40, 1, 3, 0, 900, "abcdef"),  # a much larger outline
    ]
    episodes = spark.createDataFrame([e[:5] for e in eps], "episode long, plant long, zone long, start_us long, end_us long")
    crowd = spark.createDataFrame([(e[0], v) for e in eps for v in e[5] * 2], "episode long, vehicle string")
    got = {r.episode: (r.scene, r.primary) for r in scenes(episodes, crowd, places, 4.0, 0.6, 64).collect()}
    assert got == {10: (10, True), 11: (10, False), 12: (10, False), 13: (13, True), **{k: (k, True) for k in (20, 21, 30, 31, 40)}}


@pytest.mark.parametrize(("reach", "least"), [(4, 5), (1, 3), (7, 12), (30, 4)])
def test_dbscan_equals_plain(spark, reach, least):
    rng = random.Random(reach)
    points = [(i, rng.choice([0, 40, 200]) + rng.randint(-6, 12), rng.choice([0, 60]) + rng.randint(-6, 12)) for i in range(220)]
    near = {i: [j for j, u, v in points if (u - x) ** 2 + (v - y) ** 2 <= reach * reach] for i, x, y in points}
    core = {i for i in near if len(near[i]) >= least}
    label = plain_components([(i, j) for i in core for j in near[i] if j in core])
    want = {i: label.get(i, i) if i in core else min((label.get(j, j) for j in near[i] if j in core), default=None) for i in near}
    assert {r.id: r.cluster for r in dbscan(spark.createDataFrame(points, "id long, x long, y long"), reach, least).collect()} == want
    assert core and len(core) < len(points) or reach == 30


def test_a_dense_place_makes_no_pairs(spark):
    """30,000 points on a spot ten wide and a few apart: all pairs would be 900 million."""
    points = spark.range(30_000).select("id", (F.col("id") % 10).alias("x"), (F.floor(F.col("id") / 10) % 10).alias("y")).union(spark.sql("SELECT 50000L, 40L, 0L UNION ALL SELECT 50001L, 22L, 0L"))
    got = {r.cluster: r.n for r in dbscan(points, 14, 10).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {0: 30_001, None: 1}
