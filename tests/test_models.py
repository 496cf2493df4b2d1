"""Contributions against the forest's own probabilities, splits without leaks, and the search against a serial one."""

import random

import pytest
from pyspark.sql import functions as F

from emberflow import constants as C
from emberflow.operators import explain, models, search

COLUMNS = list(C.FEATURES)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    out = []
    for i in range(240):
        x = [rng.choice([None, float("nan"), rng.gauss(0, 10)]) if rng.random() < 0.2 else rng.gauss(0, 10) for _ in COLUMNS]
        label = 0 if (x[0] or 0) > 3 else 3 if (x[7] or 0) > 0 else 2
        out.append((i, *x, label, float(rng.randrange(12)), float(rng.randrange(3)), f"g{i // 2}"))
    kinds = ", ".join(f"{c} double" for c in COLUMNS)
    return spark.createDataFrame(out, f"cluster_id long, {kinds}, label int, tile_x double, tile_y double, owner string").persist()


def test_contributions_add_up(spark, rows):
    data = models.weighted(models.prepared(rows, COLUMNS), "label")
    model = models.fit(data, COLUMNS, trees=7, depth=4)
    own = {r.cluster_id: list(r.probability) for r in model.transform(models.prepared(rows, COLUMNS)).select("cluster_id", "probability").collect()}
    told = models.classify(model, rows, COLUMNS).collect()
    assert len(told) == len(own)
    forest = explain.forest_of(model, len(C.CLASSES))
    assert max(len(t) for t in forest) <= 2**5
    seen = set()
    for r in told:
        of = C.CLASSES.index(r.predicted_class)
        assert r.probabilities[:4] == pytest.approx(own[r.cluster_id], abs=1e-12) and r.probabilities[4] == 0.0
        assert r.base + sum(r.contributions) == pytest.approx(r.probabilities[of], abs=1e-12)
        strong = sorted((abs(x), COLUMNS[i].replace("_", " ")) for i, x in enumerate(r.contributions) if abs(x) > 1e-9)[::-1][:5]
        assert [x.split(" is ")[0] for x in r.reasons] == [name for _, name in strong]
        seen.add(r.predicted_class)
    assert len(seen) == 3 and any("is unknown" in x for r in told for x in r.reasons)
    # by hand, for one row: the change of the share at each split goes to the split's feature
    row = rows.where("cluster_id = 11").first()
    told = next(r for r in told if r.cluster_id == 11)
    x = [models.MISSING if row[c] is None or row[c] != row[c] else row[c] for c in COLUMNS]
    by = [0.0] * len(COLUMNS)
    for tree in forest:
        at = 0
        while tree[at]["f"] >= 0:
            to = tree[at]["l"] if x[tree[at]["f"]] <= tree[at]["t"] else tree[at]["r"]
            by[tree[at]["f"]] += (tree[to]["p"][C.CLASSES.index(told.predicted_class)] - tree[at]["p"][C.CLASSES.index(told.predicted_class)]) / len(forest)
            at = to
    assert told.contributions == pytest.approx(by, abs=1e-12)


def test_parameters_are_cleaned():
    assert search.cleaned({"numTrees": "12", "maxDepth": 99, "subsamplingRate": 7, "colour": "red", "maxBins": None}) == {"numTrees": 12, "maxDepth": 30, "subsamplingRate": 1.0}


def test_splits_keep_tiles_and_groups_together(spark, rows):
    few = rows.where("tile_y = 0").withColumn("owner", F.when(F.col("cluster_id") % 5 != 0, F.col("owner")))
    keys = [F.struct("tile_x", "tile_y"), F.col("owner")]
    folds = search.folded(few, keys, 3)
    assert folds.count() == few.count()
    sets = [folds.where(F.col("fold") == i) for i in range(3)]
    for i in range(3):
        rest = folds.where(F.col("fold") != i)
        models.verify_no_leakage(sets[i].where("owner is not null"), rest, ["owner"])
        models.verify_no_leakage(sets[i], rest, ["tile_x", "tile_y"])
    lone = spark.createDataFrame([(i, None, None) for i in range(200)], "id long, a string, b string")
    held = search.split(lone, [F.col("a"), F.col("b")], 0.3).groupBy("held").count().collect()
    assert {r["held"] for r in held} == {True, False}


def test_search_equals_a_serial_one(spark, rows):
    data = search.folded(models.weighted(models.prepared(rows, COLUMNS), "label"), [F.col("cluster_id")], 2).persist()
    trials = [{"numTrees": 1, "maxDepth": 1}, {"numTrees": 5, "maxDepth": 4}]
    model, best, scores = search.search(data, COLUMNS, trials, k=2, parallelism=2)
    want = []
    for t in trials:
        own = [search.macro_f1(models.fit(data.where(F.col("fold") != i), COLUMNS, trees=t["numTrees"], depth=t["maxDepth"]).transform(data.where(F.col("fold") == i))) for i in range(2)]
        want.append(sum(own) / 2)
    assert [s for _, s in scores] == pytest.approx(want) and best == trials[1] and want[1] > want[0]
    assert model.stages[-1].getNumTrees == best["numTrees"]
