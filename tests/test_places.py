"""Nearest targets against all pairs, routes against a plain search with a heap."""

import heapq
import math
import random

import pytest

from emberflow.operators import nearest, routes
from emberflow.sources import views


def metres(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(h))


@pytest.mark.parametrize("radius", [300.0, 60_000.0])
def test_nearest_equals_all_pairs(spark, radius):
    rng = random.Random(radius)
    centres = [(77.0, 28.0), (179.999, -10.0), (-179.999, -10.0), (10.0, 70.0), (0.0, 0.0), (-70.0, -50.0)]
    spread = [0.001, 0.02, 0.3, 2.0]
    draw = lambda: (lambda c, s: (c[0] + rng.uniform(-s, s), c[1] + rng.uniform(-s, s)))(rng.choice(centres), rng.choice(spread))
    turned = lambda p: ((p[0] + 180) % 360 - 180, p[1])
    points = [(i, *turned(draw())) for i in range(150)] + [(900, 77.0, 28.0), (901, 77.0, 28.0), (902, 120.0, 45.0)]
    targets = [(i, *turned(draw())) for i in range(200)] + [(500 + i, 77.0 + i % 30 * 1e-5, 28.0 + i // 30 * 1e-5) for i in range(900)]  # a dense town
    targets += [(2000, 77.5, 28.0), (1999, 77.5, 28.0), (2001, None, 1.0)]
    p = spark.createDataFrame(points, "key long, lon double, lat double")
    t = spark.createDataFrame(targets, "target_id long, t_lon double, t_lat double")
    found = nearest.nearest(p, t, radius)
    assert "Cartesian" not in found._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["key"]: (r["target_id"], r["distance_m"]) for r in found.collect()}
    for key, lon, lat in points:
        pairs = sorted((metres((lon, lat), (x, y)), i) for i, x, y in targets if x is not None)
        if pairs[0][0] <= radius:
            assert got[key][1] == pytest.approx(pairs[0][0], abs=1e-6) and got[key][0] in {i for d, i in pairs if d < pairs[0][0] + 1e-6}
        else:
            assert key not in got
    assert nearest.nearest(p, t.limit(0), radius).count() == 0


def test_nearest_at_any_latitude(spark):
    """Near and over the poles, and at latitudes that go on beyond 90 degrees."""
    rng = random.Random(11)
    lats = [74.9, 80.0, 85.5, 89.9, 90.0, 90.1, 120.0, 158.0, 270.0, 300.0, 1208.0, -89.95]
    draw = lambda y: (75.0 + rng.uniform(-0.3, 0.3), y + rng.uniform(-0.1, 0.1))
    points = [(i, *draw(y)) for i, y in enumerate(lats * 6)]
    targets = [(i, *draw(y)) for i, y in enumerate(lats * 12)]
    got = nearest.nearest(spark.createDataFrame(points, "key long, lon double, lat double"), spark.createDataFrame(targets, "target_id long, t_lon double, t_lat double"), 10_000.0)
    found = {r["key"]: (r["lon"], r["lat"], r["target_id"]) for r in got.collect()}
    want = {}
    for key, *at in points:
        m, i = min((metres(at, to), i) for i, *to in targets)
        if m <= 10_000.0:
            want[key] = (*at, i)
    assert found == want and len(want) > 60


def dijkstra(edges, source, radius):
    """Distance and least path of every node in reach."""
    out = {}
    heap = [(0, (source,))]
    while heap:
        d, path = heapq.heappop(heap)
        if path[-1] in out:
            continue
        out[path[-1]] = (d, path)
        for b, w in edges.get(path[-1], {}).items():
            if d + w <= radius and b not in out:
                heapq.heappush(heap, (d + w, (*path, b)))
    return out


@pytest.mark.parametrize("delta", [8, 1000])
def test_routes_equal_a_search_with_a_heap(spark, delta):
    rng = random.Random(delta)
    rows = [(rng.randrange(60), rng.randrange(60), rng.choice([1, 2, 2, 3, 9, 30])) for _ in range(170)] + [(1, 2, None), (1, 3, -4), (5, 5, 1), (70, 71, 1)]
    edges = {}
    for a, b, w in rows:
        if w is not None and w >= 0 and a != b:
            edges.setdefault(a, {})[b] = min(w, edges.get(a, {}).get(b, w))
    table = spark.createDataFrame(rows, "a long, b long, weight long")
    trips = [(f"t{i}", s, rng.randrange(62)) for i, s in enumerate([0, 1, 5, 5, 70, 99, None])] + [("own", 7, 7)]
    got = {r["trip"]: r for r in routes.shortest_routes(spark.createDataFrame(trips, "trip string, source long, target long"), table, 25, delta).collect()}
    for name, source, target in trips:
        want = dijkstra(edges, source, 25).get(target)
        assert (got[name]["distance"], tuple(got[name]["path"]) if got[name]["path"] else None) == (want or (None, None))
    if delta == 8:
        return
    every = routes.shortest_paths(spark.createDataFrame([(s,) for s in range(0, 60, 7)], "source long"), table, 25, delta).collect()
    want = {(s, n): v for s in range(0, 60, 7) for n, v in dijkstra(edges, s, 25).items()}
    assert {(r["source"], r["node"]): (r["distance"], tuple(r["path"])) for r in every} == want


def test_networks_are_not_broadcast(spark):
    """Copies around places are many more than the places, whose size is what Spark knows."""
    at = spark.createDataFrame([(75.0, 20.0), (75.5, 20.5)], "lon double, lat double")
    for df in (views.roads(at), nearest.nearest(at.selectExpr("1L key", "*"), views.road_nodes(at), 4000.0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
