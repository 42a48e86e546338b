"""Training pairs, gradient-boosted rerankers and score calibration on pyspark.ml."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hard_negatives(anchors: DataFrame, targets: DataFrame, truth: DataFrame, token_limit: int = 100, house_limit: int = 50, by_token: int = 4, most: int = 6, total: int | None = 120_000) -> DataFrame:
    """(s1_id, target_id): targets that share a token, then a house number, with an anchor but are no match.

    Postings are cut to the first records in order; a total beyond the limit is cut in the order of anchors, unless it is None.
    """
    def cut(rows: DataFrame, key: str, limit: int) -> DataFrame:
        return rows.withColumn("_r", F.row_number().over(Window.partitionBy("country", key).orderBy("ord", "id"))).where(F.col("_r") <= limit).select("country", key, F.col("id").alias("target_id"), F.col("ord").alias("t_ord"))

    tokens = cut(targets.select("country", "id", "ord", F.explode(F.array_distinct("tokens")).alias("token")), "token", token_limit)
    houses = cut(targets.where("house <> ''"), "house", house_limit)
    true = truth.select("s1_id", F.explode("matched_ids").alias("target_id"))
    own = F.col("id").alias("s1_id")
    one = anchors.select("country", own, F.posexplode(F.array_distinct("tokens")).alias("pos", "token")).join(tokens, ["country", "token"]).groupBy("s1_id", "target_id").agg(F.min(F.struct("pos", "t_ord")).alias("by"))
    one = one.join(true, ["s1_id", "target_id"], "left_anti").withColumn("_r", F.row_number().over(Window.partitionBy("s1_id").orderBy("by", "target_id"))).where(F.col("_r") <= by_token)
    two = anchors.where("house <> ''").select("country", own, "house").join(houses, ["country", "house"]).select("s1_id", "target_id", F.struct(F.lit(1 << 30).alias("pos"), "t_ord").alias("by"))
    two = two.join(true, ["s1_id", "target_id"], "left_anti").join(one, ["s1_id", "target_id"], "left_anti")
    both = one.select("s1_id", "target_id", "by").unionByName(two)
    both = both.withColumn("_r", F.row_number().over(Window.partitionBy("s1_id").orderBy("by", "target_id"))).where(F.col("_r") <= most)
    return (both if total is None else both.orderBy("s1_id", "_r").limit(total)).select("s1_id", "target_id")


def training_pairs(negatives: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1_id, target_id, label)."""
    true = truth.select("s1_id", F.explode("matched_ids").alias("target_id"), F.lit(1.0).alias("label"))
    return true.unionByName(negatives.select("s1_id", "target_id", F.lit(0.0).alias("label")))


@dataclass
class PairClassifier:
    """Boosted trees over named features; the probability of a match as a column."""

    features: list[str]
    trees: int = 20
    depth: int = 5
    step: float = 0.1
    subsample: float = 0.85
    seed: int = 42
    model: PipelineModel | None = field(default=None, repr=False)

    def fit(self, rows: DataFrame, label: str = "label") -> PairClassifier:
        trees = GBTClassifier(featuresCol="_features", labelCol=label, maxIter=self.trees, maxDepth=self.depth, stepSize=self.step, subsamplingRate=self.subsample, seed=self.seed)
        self.model = Pipeline(stages=[VectorAssembler(inputCols=self.features, outputCol="_features"), trees]).fit(rows)
        return self

    def predict(self, rows: DataFrame, name: str = "p") -> DataFrame:
        if self.model is None:
            raise ValueError("The classifier is not fitted")
        return self.model.transform(rows).withColumn(name, vector_to_array("probability")[1]).drop("_features", "probability", "prediction", "rawPrediction")

    def save(self, path: str) -> None:
        if self.model is None:
            raise ValueError("The classifier is not fitted")
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> PairClassifier:
        self.model = PipelineModel.load(path)
        return self


@dataclass
class ScoreCalibrator:
    """Scores to probabilities, by isotonic or logistic regression; scores as they are until fitted."""

    method: str = "isotonic"
    model: object | None = field(default=None, repr=False)

    def __post_init__(self):
        if self.method not in ("isotonic", "sigmoid"):
            raise ValueError(f"Unknown calibration method: {self.method}")

    def _rows(self, rows: DataFrame, score: str) -> DataFrame:
        return VectorAssembler(inputCols=[score], outputCol="_score").transform(rows)

    def fit(self, rows: DataFrame, score: str = "score", label: str = "label") -> ScoreCalibrator:
        rows = self._rows(rows.select(F.col(score).cast("double").alias(score), F.col(label).cast("double").alias(label)), score)
        if self.method == "isotonic":
            self.model = IsotonicRegression(featuresCol="_score", labelCol=label, predictionCol="_p").fit(rows)
        else:
            self.model = LogisticRegression(featuresCol="_score", labelCol=label, regParam=1.0 / max(1, rows.count()), probabilityCol="_v", predictionCol="_c", rawPredictionCol="_r").fit(rows)
        return self

    def transform(self, rows: DataFrame, score: str = "score", name: str = "calibrated") -> DataFrame:
        if self.model is None:
            return rows.withColumn(name, F.col(score).cast("double"))
        out = self.model.transform(self._rows(rows, score))
        p = F.col("_p") if self.method == "isotonic" else vector_to_array("_v")[1]
        return out.withColumn(name, F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))).drop("_score", "_p", "_v", "_c", "_r")
