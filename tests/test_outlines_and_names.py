"""Crossing edges, inscribed circles, passages in silences, inexact lookups."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import silences as Q
from wayfold.operators import zones as Z
from wayfold.operators.names import near_names, placed_by, prefixes
from wayfold.operators.rings import checked, first_crossing, inscribed_radius
from wayfold.sources.trails import zones

SF = "/root/testdata/sf0.001"


def plain_crossing(lats, lons):
    n = len(lats)
    p = list(zip(lons, lats))
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    for i, j in itertools.combinations(range(n), 2):
        if j - i < 2 or (i == 0 and j == n - 1):
            continue
        a, b, c, d = p[i], p[(i + 1) % n], p[j], p[(j + 1) % n]
        if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
            return i, j
    return None


def test_first_crossing_equals_all_pairs():
    rng = random.Random(1)
    seen = set()
    for _ in range(1_500):
        n = rng.choice([1, 3, 4, 5, 6, 9, 20])
        lats, lons = [rng.randint(0, 9) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        want = plain_crossing(lats, lons)
        assert first_crossing(np.array(lats), np.array(lons)) == want
        seen.add(want is None)
    assert seen == {True, False}
    turn = np.linspace(0, 2 * math.pi, 1_500, endpoint=False)
    assert first_crossing(np.round(1e7 * np.sin(turn)), np.round(1e7 * np.cos(turn))) is None


def test_inscribed_radius():
    side = round(400 / Z.METRE6)
    square = np.array([0, 0, side, side]), np.array([0, side, side, 0])
    assert abs(inscribed_radius(*square, cap=1_000) - 200) < 1 and inscribed_radius(*square, cap=50) == 50
    assert inscribed_radius(np.array([0, 10, 20]), np.array([0, 10, 20])) < 0.6 and inscribed_radius(np.zeros(4), np.zeros(4)) == 0


def test_rings_of_the_tables_against_a_fine_grid(spark):
    rows = {z.zone: z for z in zones(spark, SF).limit(25).collect()}
    got = {r.zone: r for r in checked(zones(spark, SF), 1e9, 1.0).collect() if r.zone in rows}
    for zone, z in rows.items():
        lats, lons = np.array(z.lats, float), np.array(z.lons, float)
        y, x = (a.ravel() for a in np.meshgrid(np.linspace(lats.min(), lats.max(), 120), np.linspace(lons.min(), lons.max(), 120)))
        best = -Z.signed_distances(y, x, [lats] * len(y), [lons] * len(y)).min()
        step = max(lats.max() - lats.min(), lons.max() - lons.min()) / 119 * Z.METRE6
        assert best - 1.01 <= got[zone].inradius_m <= best + step and got[zone].crossing_a is None


def test_densified_routes(spark):
    routes = spark.createDataFrame([(1, [0, 0, 5_000, 5_000], [0, 10_000, 10_000, 10_000]), (2, [7, 7], [7, 7]), (3, [1], [1]), (4, [0, 90], [0, 0])], "gap long, lats array<long>, lons array<long>")
    rows = {}
    for r in sorted(Q.densified(routes, 100.0).collect(), key=lambda r: (r.gap, r.i, r.j)):
        rows.setdefault(r.gap, []).append((r.lat6, r.lon6, r.at_mm))
    assert rows.keys() == {1, 2, 4} and rows[2] == [(7, 7, 0), (7, 7, 0)] and rows[4][0] == (0, 0, 0)
    path = rows[1]
    assert path[0][:2] == (0, 0) and path[-1][:2] == (5_000, 10_000) and (0, 10_000) in {p[:2] for p in path}
    steps = [Z.METRE6 * math.hypot(b[0] - a[0], b[1] - a[1]) for a, b in zip(path, path[1:])]
    assert max(steps) <= 100.5 and abs(path[-1][2] / 1_000 - 15_000 * Z.METRE6) < 1 and all(b[2] > a[2] for a, b in zip(path, path[1:]))


def test_passages_by_hand(spark):
    """A leg of 10 km north in ten minutes and in three hours: through a zone, past one, past one far off, and a zone seen at the start."""
    km = 1_000 / Z.METRE6
    ring = lambda lat, lon, half: ([round((lat + a * half) * km) for a in (-1, -1, 1, 1)], [round((lon + b * half) * km) for b in (-1, 1, 1, -1)])
    master = spark.createDataFrame([(1, *ring(5, 0, 0.5)), (2, *ring(7, 0.4, 0.2)), (3, *ring(8, 3, 0.5)), (4, *ring(0, 0, 0.3))], "zone long, lats array<long>, lons array<long>")
    master = master.withColumns({"band": F.lit(25.0), "speed_limit": F.lit(None).cast("long"), "category": F.lit("open")})
    s = 1_000_000
    gaps = [(10, 1, 0, 600 * s, 10_000.0, [0, round(10 * km)], [0, 0], 10_000.0, 500.0), (11, 1, 0, 10_800 * s, 10_000.0, [0, round(10 * km)], [0, 0], 10_000.0, 500.0), (12, 1, 0, 300 * s, 10_000.0, [0, round(10 * km)], [0, 0], 10_000.0, 500.0)]
    gaps = spark.createDataFrame(gaps, "gap long, vehicle long, from_us long, to_us long, straight_m double, lats array<long>, lons array<long>, route_m double, route_s double")
    visits = spark.createDataFrame([(1, 4, -5, 0, False), (1, 1, 50, 60, False), (2, 1, -9, 0, True)], "vehicle long, zone long, enter long, leave long, open boolean")
    got = {(r.gap, r.zone): r for r in Q.passages(gaps, master, visits).collect()}
    assert {k: (r.kind, r.confidence) for k, r in got.items()} == {(10, 1): ("through", "high"), (11, 1): ("through", "medium"), (11, 2): ("near_stop", "medium"), (12, 1): ("through", "low")}
    first = got[10, 1]
    assert abs(first.enter_us / s - 500 * 0.4525) < 2 and abs(first.leave_us / s - 500 * 0.5475) < 2 and abs(first.inside_m - 950) < 30 and abs(first.nearest_m + 500) < 15
    assert got[11, 1].enter_us is None and abs(got[11, 2].nearest_m - 200) < 5


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(7)
    words = ["NORTH", "MILL", "YARD", "PITHAMPUR", "(M.P.)", "GATE", "2", "STEEL", "ROAD", "É"]
    known = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(60)}

    def typed(name):
        out = list(name)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(out) + 1)
            out[k : k + rng.randint(0, 1)] = rng.choice(["", "x", " ", "L"])
        return rng.choice(["", "the "]) + "".join(out).lower()

    return sorted(known), [typed(rng.choice(sorted(known))) for _ in range(150)] + ["", None, "  ", "zzz", "Pithampur", "mill yard gate 2 north extension"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j, row=row, x=x: min(left + 1, row[j] + 1, row[j - 1] + (x != b[j - 1])), initial=i))
    return row[-1]


def test_near_names_equal_all_pairs(spark, vocabulary):
    known, asked = vocabulary
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.asked, r.known): (r.rank, r.how, r.distance) for r in near_names(frame(asked), frame([*known, None, ""])).collect()}
    want = {}
    for a in {" ".join(x.upper().split()) for x in asked if x and x.strip()} - set(known):
        found = []
        for k in known:
            d = distance(a, k)
            if f" {a} " in f" {k} " or f" {k} " in f" {a} ":
                found.append(("contained", abs(len(a) - len(k)), k, d))
            elif d <= 2 and min(len(a), len(k)) >= 4:
                found.append(("spelt", d, k, d))
        want.update({(a, k): (rank, how, d) for rank, (how, _, k, d) in enumerate(sorted(found)[:3], 1)})
    assert got == want and {how for _, how, _ in want.values()} == {"contained", "spelt"}


def test_places_by_name_and_code(spark):
    ranges = spark.createDataFrame([(200, 285, 5, "wide"), (246, 246, 1, "inner"), (248, 249, 1, "inner"), (300, 290, 0, "none"), (285, 290, 9, "late")], "low int, high int, rank int, place string")
    table = {r.prefix: r.place for r in prefixes(ranges, 3).collect()}
    assert table == {**{p: "wide" for p in range(200, 286)}, 246: "inner", 248: "inner", 249: "inner", **{p: "late" for p in range(286, 291)}}
    gazetteer = spark.createDataFrame([("New  Town", "here"), ("new town", "there"), (None, "x")], "name string, place string")
    rows = [(1, " NEW town", "246001"), (2, "other", "246001.0"), (3, None, "28500"), (4, "", None), (5, "x", "285999"), (6, "x", "999999"), (7, "x", "24600a")]
    got = {r.id: (r.place, r.found_by) for r in placed_by(spark.createDataFrame(rows, "id int, town string, code string"), "town", "code", gazetteer, ranges).collect()}
    assert got == {1: ("here", "name"), 2: ("inner", "code"), 3: (None, None), 4: (None, None), 5: ("wide", "code"), 6: (None, None), 7: (None, None)}
