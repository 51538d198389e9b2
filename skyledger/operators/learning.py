"""Learned reference temperature (stations held out in folds, and a final fit) and residual risk (by mode,
with early stopping), on boosted trees; targets, folds, importance.

Missing numbers are less than all others, missing texts are "Missing". Row samples are not taken: trees
read all rows, as counts per bin. What comes to the driver is the trees, the categories' names and a
row a group of a fold table (stations, not rows)."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rounds, their rate and depth; the gain in loss on held rows below which rounds end.
ROUNDS, RATE, DEPTH, TOLERANCE, FOLDS, SEED = 1200, 0.04, 8, 1e-4, 5, 42
#: Depth of Spark's trees at most, and bins of a number.
BINS = 64
LOWEST = -1e30
#: The bands that count as labels; rows from which a category stands for itself.
HIGH_BAND, LOW_BAND = "high_confidence_high_risk", "high_confidence_low_risk"
FREQUENT_ROWS = 50


def confident_target(band: Column) -> Column:
    """1 and 0 for the bands that are sure, null between them."""
    return F.when(band == HIGH_BAND, 1).when(band == LOW_BAND, 0)


def training_target(df: DataFrame, mode: str = "auto", band: str = "target_ref_risk_band_z", hard: str = "target_ref_risk") -> tuple[DataFrame, str]:
    """The rows with the target that a mode asks for and is_model_labeled, and the target's name."""
    if mode == "auto":
        mode = "high_confidence_bands" if band in df.columns else "hard"
    if mode == "high_confidence_bands":
        name = "target_ref_risk_hiconf"
        df = df.withColumn(name, confident_target(F.col(band)) if band in df.columns else F.lit(None).cast("int"))
    elif mode == "hard":
        name = hard
        if hard not in df.columns:
            raise KeyError(f"no column {hard!r}")
        df = df.withColumn(hard, F.expr(f"try_cast(`{hard}` AS DOUBLE)"))
    else:
        raise ValueError("mode is auto, hard or high_confidence_bands")
    return df.withColumn("is_model_labeled", F.coalesce(F.col(name).isin(0, 1), F.lit(False)).cast("int")), name


def group_folds(df: DataFrame, by: str, n: int | None = FOLDS) -> DataFrame:
    """``by``, n_rows, fold (from 1): whole groups, the largest first, each to the fold with the fewest
    rows so far (ties: the group that comes first by name, the first fold). n None: a fold a group.
    The rows are counted in the cluster; the table of groups is dealt out in one task."""
    sizes = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n_rows"))
    if n is None:
        return sizes.withColumn("fold", F.row_number().over(W.orderBy(by)))

    def deal(batches):
        heap = [(0, i) for i in range(1, n + 1)]
        for b in batches:
            folds = []
            for k in b["n_rows"]:
                held, i = heap[0]
                heapq.heapreplace(heap, (held + int(k), i))
                folds.append(i)
            yield b.assign(fold=folds)

    kind = sizes.schema[by].dataType.simpleString()
    return sizes.coalesce(1).sortWithinPartitions(F.desc("n_rows"), by).mapInPandas(deal, f"`{by}` {kind}, n_rows long, fold int")


def with_rare(df: DataFrame, column: str, least: int = FREQUENT_ROWS, other: str = "infrequent") -> DataFrame:
    """Categories of fewer than ``least`` rows become one; null is "Missing"."""
    value = F.coalesce(F.col(column).cast("string"), F.lit("Missing"))
    n = df.groupBy(value.alias("_category")).agg((F.count("*") >= least).alias("_often"))
    return df.withColumn("_category", value).join(n, "_category").withColumn(column, F.when(F.col("_often"), F.col("_category")).otherwise(F.lit(other))).drop("_category", "_often")


@dataclass(frozen=True)
class Fitted:
    """A fitted model, and how its columns are made ready."""

    model: PipelineModel
    features: list[str]
    categories: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(_ready(df, self.features, self.categories))

    def risk(self, df: DataFrame, name: str = "pred_ref_risk_prob") -> DataFrame:
        return self.transform(df).withColumn(name, vector_to_array("probability")[1]).select(*(F.col(f"`{c}`") for c in df.columns), name)

    def predict(self, df: DataFrame, name: str = "ref_mu_learned") -> DataFrame:
        return self.transform(df).withColumn(name, F.col("prediction")).select(*(F.col(f"`{c}`") for c in df.columns), name)

    def importance(self, spark) -> DataFrame:
        """feature, importance (they add up to 1); a row a feature."""
        values = self.model.stages[-1].featureImportances.toArray().tolist()
        return spark.createDataFrame(list(zip(self.features, values, strict=True)), "feature string, importance double")

    @property
    def rounds(self) -> int:
        return self.model.stages[-1].getNumTrees


def _ready(df: DataFrame, features: list[str], categories: list[str]) -> DataFrame:
    own = {}
    for i, c in enumerate(features):
        if c in categories:
            own[f"_f{i}"] = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("Missing"))
        else:
            x = F.col(f"`{c}`").cast("double")
            own[f"_f{i}"] = F.when(x.isNull() | F.isnan(x), LOWEST).otherwise(x)
    return df.withColumns(own)


def _fit(rows: DataFrame, features: list[str], categories: list[str], make, held: str | None, rounds: int, rate: float, depth: int, seed: int) -> Fitted:
    if not features:
        raise ValueError("no features")
    ready = _ready(rows, features, categories)
    text = [i for i, c in enumerate(features) if c in categories]
    # Names are those of the learned rows; others share one more place.
    learned = ready.where(~F.col(held)) if held else ready
    stages = []
    if text:
        stages.append(StringIndexer(inputCols=[f"_f{i}" for i in text], outputCols=[f"_i{i}" for i in text], handleInvalid="keep").fit(learned))
    widest = max((len(a) for a in stages[0].labelsArray), default=0) if text else 0
    stages.append(VectorAssembler(inputCols=[f"_i{i}" if i in text else f"_f{i}" for i in range(len(features))], outputCol="_vector"))
    for s in stages:
        ready = s.transform(ready)
    more = {"validationIndicatorCol": held, "validationTol": TOLERANCE} if held else {}
    last = make(featuresCol="_vector", maxIter=rounds, stepSize=rate, maxDepth=depth, maxBins=max(BINS, widest + 2), seed=seed, **more).fit(ready)
    return Fitted(PipelineModel([*stages, last]), features, categories)


def fit_risk(df: DataFrame, target: str, features: list[str], categories: list[str], split: str = "split", rounds: int = ROUNDS, rate: float = RATE, depth: int = DEPTH, seed: int = SEED) -> Fitted:
    """Boosted trees on the labelled train rows, both classes weighing the same; rounds end early when
    the labelled valid rows gain no more."""
    rows = df.where(F.col(target).isin(0, 1) & F.col(split).isin("train", "valid")).withColumns({"_held": F.col(split) == "valid", "_label": F.col(target).cast("double")})
    n = {(r["_held"], int(r["_label"])): r["n"] for r in rows.groupBy("_held", "_label").agg(F.count("*").alias("n")).collect()}
    if not any(held for held, _ in n) or not any(not held for held, _ in n):
        raise ValueError("labelled train rows and labelled valid rows are needed")
    if len(ones := {y: n[False, y] for y in (0, 1) if (False, y) in n}) < 2:
        raise ValueError("the train rows are of one class")
    total = sum(ones.values())
    rows = rows.withColumn("_weight", F.when(F.col("_label") == 1, total / (2 * ones[1])).otherwise(total / (2 * ones[0])))
    return _fit(rows, features, categories, lambda **k: GBTClassifier(labelCol="_label", weightCol="_weight", **k), "_held", rounds, rate, depth, seed)


def fit_reference(df: DataFrame, target: str, features: list[str], categories: list[str], rounds: int = ROUNDS, rate: float = RATE, depth: int = DEPTH, seed: int = SEED) -> Fitted:
    """The final regression, on all rows with a target."""
    rows = df.where(F.col(target).isNotNull()).withColumn("_label", F.col(target).cast("double"))
    return _fit(rows, features, categories, lambda **k: GBTRegressor(labelCol="_label", **k), None, rounds, rate, depth, seed)


def held_out_reference(df: DataFrame, target: str, features: list[str], categories: list[str], station: str = "station_id", n: int | None = FOLDS, rounds: int = ROUNDS, rate: float = RATE, depth: int = DEPTH, seed: int = SEED, stop: str = "held") -> tuple[DataFrame, list[Fitted]]:
    """All rows with fold, ref_mu_learned (by a model that saw no row of the station; null without a
    target), ref_resid_learned and abs_ref_resid_learned; and the folds' models. What
    ends a model's rounds is its own held rows (``stop`` "held"), which makes their residuals a little
    too good, or a tenth of the other folds' rows by their hash ("others"): then the held rows have no
    part in it at all."""
    if stop not in ("held", "others"):
        raise ValueError(f"stop {stop}: held or others")
    sizes = group_folds(df.where(F.col(target).isNotNull()), station, n)
    table = sizes.select(station, F.col("fold").alias("_fold")).collect()  # a row a station
    if len(table) < 2:
        raise ValueError("at least two stations with values are needed")
    folds = df.sparkSession.createDataFrame(table, sizes.select(station, F.col("fold").alias("_fold")).schema)
    rows = df.join(F.broadcast(folds) if len(table) <= 100_000 else folds, station, "left").withColumnRenamed("_fold", "fold")
    rows = rows.withColumn("fold", F.when(F.col(target).isNotNull(), F.col("fold")))
    models, mu = [], []
    stops = F.pmod(F.xxhash64(station, target, *(F.col(f"`{c}`") for c in features)), F.lit(10)) == 0
    for fold in sorted({r["_fold"] for r in table}):
        mine = F.col("fold") == fold
        own = rows.where(F.col(target).isNotNull() & (~mine if stop == "others" else F.lit(True))).withColumns({"_held": stops if stop == "others" else mine, "_label": F.col(target).cast("double")})
        models.append(_fit(own, features, categories, lambda **k: GBTRegressor(labelCol="_label", **k), "_held", rounds, rate, depth, seed + fold))
        mu.append(models[-1].predict(rows.where(F.col("fold") == fold)))
    mu.append(rows.where("fold IS NULL").withColumn("ref_mu_learned", F.lit(None).cast("double")))
    out = mu[0]
    for m in mu[1:]:
        out = out.unionByName(m)
    resid = F.col(target) - F.col("ref_mu_learned")
    return out.withColumns({"ref_resid_learned": resid, "abs_ref_resid_learned": F.abs(resid)}), models


def importance_stability(rows: DataFrame, by: list[str], seed: str = "seed", top: int = 50) -> DataFrame:
    """rows: by, feature, seed, importance. Mean, standard deviation (null for one run), least and
    most over the runs, and the dense rank by mean up to ``top``."""
    x = F.col("importance")
    g = rows.where(x.isNotNull()).groupBy(*by, "feature").agg(F.count_distinct(seed).alias("n_runs"), F.avg(x).alias("mean"), F.when(F.count(x) > 1, F.stddev_samp(x)).alias("std"), F.min(x).alias("least"), F.max(x).alias("most"))
    place = F.dense_rank().over((W.partitionBy(*by) if by else W).orderBy(F.desc(F.round("mean", 12))))
    return g.withColumn("place", place).where(F.col("place") <= top)
