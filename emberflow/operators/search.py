"""Splits that keep places and groups together, and a search over a model's parameters on such folds."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import ingest, models

#: Parameters that a search may vary: kind, least and largest value that a forest takes.
LIMITS = {"numTrees": (int, 1, 1000), "maxDepth": (int, 1, 30), "minInstancesPerNode": (int, 1, 1_000_000), "subsamplingRate": (float, 1e-6, 1.0), "maxBins": (int, 2, 65536)}


def cleaned(params: dict[str, object]) -> dict[str, object]:
    """Known parameters with values of their kind, within what a forest takes; others and missing values go."""
    out = {}
    for name, (kind, least, most) in LIMITS.items():
        if params.get(name) is not None:
            out[name] = min(max(kind(params[name]), least), most)
    return out


def tile(lon: Column, lat: Column, degrees: float) -> Column:
    return F.struct(geo.cell(lon, degrees).alias("x"), geo.cell(lat, degrees).alias("y"))


def bound_together(data: DataFrame, keys: list[Column]) -> DataFrame:
    """``data`` with ``_block``: rows that share a value of any key, directly or by way of others, share a block.

    Values are nodes of a graph and every row links its own; a null value links nothing.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    node = lambda i, key: F.when(key.isNotNull(), F.xxhash64(F.lit(i), key))
    # a row without any value is a block of its own
    rows = data.withColumns({n: node(i, key) for i, (n, key) in enumerate(zip(names, keys, strict=True))}).withColumn("_first", F.coalesce(*names, F.xxhash64(F.lit("row"), F.struct(*data.columns))))
    links = rows.select("_first", F.explode(F.array(*names)).alias("_other")).where("_other IS NOT NULL AND _other <> _first").distinct()
    found = ingest.connected(links.select(F.col("_first").alias("a"), F.col("_other").alias("b"))).select(F.col("node").alias("_first"), "component")
    return rows.join(found, "_first", "left").withColumn("_block", F.coalesce("component", "_first")).drop("_first", "component", *names)


def folded(data: DataFrame, keys: list[Column], k: int, seed: int = 42) -> DataFrame:
    """``data`` with ``fold`` (0 .. k - 1), drawn for each block of rows that share a key."""
    return bound_together(data, keys).withColumn("fold", F.pmod(F.xxhash64("_block", F.lit(seed)), F.lit(k)).cast("int")).drop("_block")


def split(data: DataFrame, keys: list[Column], fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """``data`` with ``held``: a share of the blocks for a test that no key of the training rows reaches into."""
    draw = F.pmod(F.xxhash64("_block", F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000)
    return bound_together(data, keys).withColumn("held", draw).drop("_block")


class MacroF1(Evaluator):
    """Mean F1 of the classes that occur."""

    def _evaluate(self, dataset: DataFrame) -> float:
        return macro_f1(dataset)


def macro_f1(predicted: DataFrame, label: str = "label") -> float:
    """0 for no rows."""
    return models.f1(predicted, label).agg(F.coalesce(F.avg("f1"), F.lit(0.0))).first()[0]


def search(data: DataFrame, columns: list[str], trials: list[dict[str, object]], k: int = 3, parallelism: int = 2, seed: int = 42) -> tuple[PipelineModel, dict[str, object], list[tuple[dict[str, object], float]]]:
    """The best of some trials by macro-F1 over ``fold``s, refitted on all rows: (model, its parameters, all scores).

    ``data`` has label, weight and fold; at most ``parallelism`` forests are grown at once.  Of equal scores the first
    trial wins.
    """
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", seed=seed)
    plans = [cleaned(t) for t in trials]
    grids = [{getattr(forest, name): value for name, value in plan.items()} for plan in plans]
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), forest])
    fitted = CrossValidator(estimator=pipeline, estimatorParamMaps=grids or ParamGridBuilder().build(), evaluator=MacroF1(), numFolds=k, foldCol="fold", parallelism=parallelism).fit(data)
    scores = list(zip(plans, fitted.avgMetrics, strict=True))
    best = max(range(len(scores)), key=lambda i: (scores[i][1], -i))
    return fitted.bestModel, plans[best], scores
