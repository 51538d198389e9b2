"""Stations that share places: the work of neighbours grows with the places, the results do not change."""

import math

from pyspark.sql import functions as F

from skyledger.operators import chain
from skyledger.operators import features as ft


def metadata(spark, rows):
    return spark.createDataFrame(rows, "station_id long, lat double, long double, elev double, lcz int")


def crowded(spark, each, far=2):
    """Two places 1 km apart with ``each`` stations, and ``far`` stations at a place without others near."""
    rows = [(i, 47.0 + (i % 2) * 0.009, 8.0, 400.0 if i % 4 < 2 else 700.0, i % 2) for i in range(2 * each)]
    return metadata(spark, rows + [(1000 + i, 48.0, 8.0, 400.0, 0) for i in range(far)] + [(2000, None, 8.0, 400.0, 0)])


def by_hand(rows, km):
    """Pairs up to ``km`` on a sphere (the places here are far from the limit)."""
    def away(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    held = [r for r in rows if r[1] is not None]
    return {(a[0], b[0]) for a in held for b in held if a[0] != b[0] and away(a, b) <= km}


def test_buddies_and_radius_of_crowded_places(spark):
    m = crowded(spark, 20)
    rows = [tuple(r) for r in m.collect()]
    level = {r[0]: r[3] for r in rows}
    near = by_hand(rows, 2)
    want = {(a, b) for a, b in near if abs(level[a] - level[b]) <= 100}
    n = {a: sum(1 for x, _ in want if x == a) for a, _ in want}
    got = [tuple(r) for r in chain.buddy_pairs(m).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in want if n[a] >= 5} and got
    found = {r["station_id"]: r for r in ft.radius_counts(m, m, 2).collect()}
    assert set(found) == {r[0] for r in rows}
    for s, r in found.items():
        own = sorted(b for a, b in near if a == s)
        assert r["n_near"] == len(own) and (r["near_ids"] or []) == own
    assert found[2000]["near_ids"] is None


def test_distances_are_taken_of_places(spark):
    m = crowded(spark, 300)
    assert ft.near_places(ft.placed(m, ("lat", "long")), ft.placed(m, ("lat", "long")), 2).count() == 5


def test_a_station_of_two_places_and_one_without_height(spark):
    m = metadata(spark, [(1, 47.0, 8.0, None, 1), (1, 47.5, 8.0, 400.0, 1), (2, 47.0, 8.0, 400.0, 1), (3, 47.5, 8.0, 400.0, 1)])
    found = {r["station_id"]: sorted(r["near_ids"]) for r in ft.radius_counts(m, m, 2).collect()}
    assert found == {1: [2, 3], 2: [1], 3: [1]}
    assert {tuple(r) for r in chain.buddy_pairs(m, least=1).collect()} == {(1, 3), (3, 1)}


def test_nearest_of_crowded_places(spark):
    m = crowded(spark, 30)
    p = ft.neighbours(m, m, k=3, radius_km=0.5)
    got = {}
    for r in p.orderBy("station_id", "rank").collect():
        got.setdefault(r["station_id"], []).append(r["source_id"])
    assert got[0] == [2, 4, 6] and got[4] == [0, 2, 6] and got[59] == [1, 3, 5] and got[1000] == [1001]
    assert 2000 not in got and p.groupBy("station_id").agg(F.sum("weight").alias("w")).where("abs(w - 1) > 1e-5").isEmpty()
    # Nothing but itself at its place and within the radius: the nearest wherever they are.
    far = {r["source_id"] for r in ft.neighbours(m.where("station_id < 1001"), m.where("station_id < 1001"), k=3, radius_km=0.5).where("station_id = 1000").collect()}
    assert far == {1, 3, 5}
