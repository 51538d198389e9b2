"""Risk models: boosted trees and logistic regression over scored rows, learned on train rows only."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC, CATEGORIES = ["resid_size", "lenient_value"], ["strict_label"]


def features(df: DataFrame) -> DataFrame:
    """Numbers with a mark where they are missing; labels with "Missing" for null."""
    return df.withColumns({"resid_size": F.abs("resid"), "lenient_value": F.col("lenient").cast("double"), "lenient_missing": F.col("lenient").isNull().cast("double"), "strict_label": F.coalesce(F.col("strict").cast("string"), F.lit("Missing"))})


def balanced(train: DataFrame) -> DataFrame:
    """Weights that give both classes the same sum."""
    share = train.agg(F.avg(F.col("y").cast("double")).alias("_share"))  # one row
    return train.join(F.broadcast(share)).withColumn("weight", F.when(F.col("y") == 1, F.try_divide(F.lit(0.5), F.col("_share"))).otherwise(F.try_divide(F.lit(0.5), 1 - F.col("_share")))).drop("_share")


def risk_model(train: DataFrame, kind: str = "gbt", rounds: int = 10, depth: int = 4, seed: int = 42):
    """A fitted pipeline; boosted trees with early stopping left to ``rounds``."""
    steps = [
        Imputer(inputCols=NUMERIC, outputCols=[f"{c}_full" for c in NUMERIC], strategy="median"),
        StringIndexer(inputCols=CATEGORIES, outputCols=[f"{c}_index" for c in CATEGORIES], handleInvalid="keep"),
        VectorAssembler(inputCols=[*(f"{c}_full" for c in NUMERIC), "lenient_missing", *(f"{c}_index" for c in CATEGORIES)], outputCol="raw_vector"),
        StandardScaler(inputCol="raw_vector", outputCol="vector"),
    ]
    if kind == "gbt":
        last = GBTClassifier(featuresCol="vector", labelCol="y", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=seed)
    else:
        last = LogisticRegression(featuresCol="vector", labelCol="y", weightCol="weight", elasticNetParam=0.15, regParam=1e-4, maxIter=50)
    return Pipeline(stages=[*steps, last]).fit(balanced(features(train)))


def risk_scores(df: DataFrame, kind: str) -> DataFrame:
    """Every row's risk by a model of the train rows."""
    model = risk_model(df.where("split = 'train' AND y IS NOT NULL"), kind)
    return model.transform(features(df)).select("station_id", "row_key", "line", "split", "y", F.round(vector_to_array("probability")[1], 6).alias("risk"))
