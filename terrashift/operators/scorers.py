"""Learned scorers over tile features, guarded by the features' hash and the library's version."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 1


def feature_hash(names: list[str]) -> str:
    """The order counts: a model must see the columns it was fitted on."""
    return hashlib.sha256(json.dumps(names).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Card:
    kind: str
    features: tuple[str, ...]
    feature_hash: str
    version: int
    rows: int
    positives: int


@dataclass
class Scorer:
    model: PipelineModel
    card: Card

    def score(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """``rows`` with probability; refuses other features or another version."""
        if feature_hash(names) != self.card.feature_hash or self.card.version != VERSION:
            raise ValueError("the scorer was fitted on other features or by another version")
        out = self.model.transform(rows)
        p = vector_to_array("probability")[1]
        return out.withColumn("p_change", p).select(*rows.columns, "p_change")


def fit(rows: DataFrame, names: list[str], kind: str = "logistic", truth: str = "label", seed: int = 42, rounds: int = 200) -> Scorer:
    """A logistic regression on standardised features, or ``rounds`` boosted trees of depth 3; fitted by Spark on the executors."""
    assemble = VectorAssembler(inputCols=names, outputCol="_raw", handleInvalid="keep")
    if kind == "logistic":
        scale = StandardScaler(inputCol="_raw", outputCol="_features", withMean=True)
        stages = [assemble, scale, LogisticRegression(featuresCol="_features", labelCol=truth, maxIter=50, regParam=0.01)]
    elif kind == "boosted":
        stages = [assemble, GBTClassifier(featuresCol="_raw", labelCol=truth, maxDepth=3, maxIter=rounds, seed=seed)]
    else:
        raise ValueError(f"unknown scorer {kind!r}")
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth) == 1).alias("p")).first()
    if not 0 < totals.p < totals.n:
        raise ValueError("a scorer needs rows of both labels")
    card = Card(kind, tuple(names), feature_hash(names), VERSION, totals.n, totals.p)
    return Scorer(Pipeline(stages=stages).fit(rows), card)


def save(scorer: Scorer, rows: DataFrame, path: str) -> None:
    """The model and its card."""
    scorer.model.write().overwrite().save(f"{path}/model")
    card = rows.sparkSession.createDataFrame([(json.dumps(asdict(scorer.card)),)], "value string")
    card.coalesce(1).write.mode("overwrite").text(f"{path}/card")


def load(rows: DataFrame, path: str) -> Scorer:
    values = json.loads(rows.sparkSession.read.text(f"{path}/card").first().value)
    values["features"] = tuple(values["features"])
    return Scorer(PipelineModel.load(f"{path}/model"), Card(**values))
