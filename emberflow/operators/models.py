"""Training and applying the event classifier: features with missing values, held-out tiles, weighted classes."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scoring
from . import explain

#: Stands for a missing value, far from any real one, so that a split can set it apart.
MISSING = -9999.0


def prepared(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and NaN become the missing value."""
    value = lambda c: F.col(c).cast("double")
    return df.select(*[c for c in df.columns if c not in columns], *[F.when(value(c).isNull() | F.isnan(value(c)), MISSING).otherwise(value(c)).alias(c) for c in columns])


def weighted(df: DataFrame, label: str) -> DataFrame:
    """Inverse class frequencies with mean 1 as ``weight``; the classes' table is a few rows."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_total"), F.count("*").alias("_k"), F.avg(1 / F.col("_n")).alias("_mean"))
    return df.join(F.broadcast(n), label).crossJoin(F.broadcast(total)).withColumn("weight", 1 / F.col("_n") / F.col("_mean")).drop("_n", "_total", "_k", "_mean")


def fit(train: DataFrame, columns: list[str], label: str = "label", trees: int = 20, depth: int = 5, seed: int = 42) -> PipelineModel:
    forest = RandomForestClassifier(labelCol=label, featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), forest]).fit(train)


def f1(predicted: DataFrame, label: str = "label") -> DataFrame:
    """Precision, recall and F1 of each class from the confusion counts."""
    cells = predicted.groupBy(F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("p")).agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0))
    real = cells.groupBy(F.col("y").alias("class")).agg(hit.alias("tp"), F.sum("n").alias("actual"))
    said = cells.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("predicted"))
    both = real.join(said, "class", "left").fillna(0, ["predicted"])
    precision, recall = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0), F.col("tp") / F.col("actual")
    return both.select("class", "actual", precision.alias("precision"), recall.alias("recall"), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"))


def validate_order(model: PipelineModel, columns: list[str]) -> None:
    """A model must see its features in the order that it was trained with."""
    if list(model.stages[0].getInputCols()) != list(columns):
        raise ValueError("feature order differs from the model's")


def verify_no_leakage(train: DataFrame, held: DataFrame, *keys: list[str]) -> None:
    """Raises if a row, a tile or a group (each a list of columns) is on both sides."""
    for own in keys:
        if not train.select(own).join(held.select(own), own, "left_semi").isEmpty():
            raise ValueError(f"train and test share {', '.join(own)}")


def save(model: PipelineModel, folder: str, metadata: dict[str, object]) -> None:
    """Writes a model and its record under its version and as the latest."""
    spark = SparkSession.active()
    for version in (str(metadata["version"]), "latest"):
        model.write().overwrite().save(f"{folder}/{version}/model")
        spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{version}/metadata")


def load(folder: str, version: str = "latest") -> tuple[PipelineModel, dict[str, object]]:
    """A saved model with its record, whose feature order has to be the model's."""
    metadata = json.loads(SparkSession.active().read.text(f"{folder}/{version}/metadata").first()[0])  # one row
    model = PipelineModel.load(f"{folder}/{version}/model")
    validate_order(model, list(metadata["features"]))
    return model, metadata


def classify(model: PipelineModel, vectors: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """Class, probabilities in class order, confidence weighted by the evidence at hand, and reasons.

    ``base`` and ``contributions`` (by feature, in the order of ``columns``) add up to the probability of the class; the
    reasons name the ``top`` of them.  A null or NaN is an unknown value; a row without any gets the least confidence.
    """
    return explained(explain.forest_of(model, len(C.CLASSES)), vectors, columns, top)


def explained(forest: explain.Forest, vectors: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """:func:`classify` by the nodes of a forest."""
    found = {g: scoring.group_present([F.col(c) for c in columns if C.FEATURES[c] == g]) for g in C.GROUP_WEIGHTS}
    weight, multiplier = scoring.evidence_multiplier(found)
    x = F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(MISSING)), F.lit(MISSING)) for c in columns])
    told = vectors.select("cluster_id", weight.alias("evidence"), multiplier.alias("multiplier"), x.alias("x")).withColumn("probabilities", explain.shares(F.col("x"), forest))
    told = told.withColumn("predicted_class", scoring.top_class(F.col("probabilities")))
    of = F.array_position(F.array(*map(F.lit, C.CLASSES)), F.col("predicted_class")).cast("int") - 1
    told = told.withColumn("why", explain.contributions(F.col("x"), of, forest, len(columns)))
    parts = F.zip_with(F.array(*[F.lit(c.replace("_", " ")) for c in columns]), F.arrays_zip(F.col("x").alias("x"), F.col("why.contributions").alias("by")), lambda name, z: F.struct(F.abs(z["by"]).alias("size"), name.alias("name"), z["x"].alias("x"), z["by"].alias("by")))
    counted = F.filter(F.reverse(F.array_sort(parts)), lambda z: z["size"] > 1e-9)
    value = lambda z: F.when(z["x"] == MISSING, F.lit("is unknown")).otherwise(F.format_string("is %.2f", z["x"]))
    reason = lambda z: F.concat(z["name"], F.lit(" "), value(z), F.format_string(" (%+.3f)", z["by"]))
    return told.select("cluster_id", "predicted_class", "probabilities", scoring.confidence_score(F.col("probabilities"), F.col("multiplier")).alias("confidence"), "evidence", F.transform(F.slice(counted, 1, top), reason).alias("reasons"), F.col("why.base").alias("base"), F.col("why.contributions").alias("contributions"))


CLASS_INDEX = {c: i for i, c in enumerate(C.CLASSES)}
