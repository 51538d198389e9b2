"""The fast linear baseline: logistic regression by stochastic gradient steps on all rows.

Numbers are taken about their median, which fills them where they are missing, and scaled by their
deviation (the dense columns are few, so they can be centred, and steps converge sooner); every category's
value takes one of ``SLOTS`` columns by its hash, so the model's size is fixed and no list of values has
to be held anywhere. In each epoch every partition starts from the same weights and steps through its
rows in small batches (elastic net, classes of equal weight); the partitions' weights are then averaged
by their rows, by Spark, and a row a weight reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import quantiles

# Strength and mixture of the penalty, epochs, least gain of an epoch, epochs without it.
ALPHA, L1, EPOCHS, GAIN, PATIENCE = 1e-5, 0.05, 25, 1e-3, 5
SLOTS, BATCH, RATE = 1 << 14, 64, 0.5


@dataclass
class Linear:
    """A fitted model: what fills and scales the numbers, the weights (numbers, slots, constant)."""

    numeric: list[str]
    categories: list[str]
    fill: dict[str, float]
    scale: dict[str, float]
    weights: np.ndarray
    losses: list[float]

    def vectors(self, df: DataFrame) -> DataFrame:
        """Adds _x, the scaled numbers, and _s, the slots of the categories."""
        x = [F.coalesce((F.col(c).cast("double") - self.fill[c]) / self.scale[c], F.lit(0.0)) for c in self.numeric]
        s = [F.pmod(F.xxhash64(F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("Missing"))), F.lit(SLOTS)).cast("int") for c in self.categories]
        return df.withColumns({"_x": F.array(*x).cast("array<double>"), "_s": F.array(*s).cast("array<int>")})

    def risk(self, df: DataFrame, name: str = "risk") -> DataFrame:
        """Every row with its probability of class 1."""
        w, k = self.weights, len(self.numeric)

        @F.pandas_udf("double")
        def score(x, s):
            import pandas as pd

            z = w[-1] + np.stack([*x, np.zeros(k)])[:-1] @ w[:k]
            if self.categories:
                z = z + w[k + np.stack([*s, np.zeros(len(self.categories), int)])[:-1].astype(int)].sum(axis=1)
            return pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

        return self.vectors(df).withColumn(name, score("_x", "_s")).drop("_x", "_s")


def _prepare(train: DataFrame, numeric: list[str], categories: list[str]) -> Linear:
    """Medians and deviations of the numbers that are there: two aggregates, a row a column."""
    long = train.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in numeric))).alias("_p")).select("_p.*") if numeric else None
    fill, scale = dict.fromkeys(numeric, 0.0), dict.fromkeys(numeric, 1.0)
    if long is not None:
        fill |= {r["c"]: r["m"] for r in quantiles(long, ["c"], "v", {"m": 0.5}).collect()}
        scale |= {r["c"]: r["s"] for r in long.groupBy("c").agg(F.stddev_pop("v").alias("s")).collect() if r["s"]}
    return Linear(numeric, categories, fill, scale, np.zeros(len(numeric) + SLOTS + 1), [])


def _steps(x: np.ndarray, s: np.ndarray, y: np.ndarray, sw: np.ndarray, w: np.ndarray, rate: float, alpha: float, l1: float, rng) -> float:
    """Steps ``w`` through the rows in a random order; the sum of their losses before each step."""
    k, loss, order = x.shape[1], 0.0, rng.permutation(len(y))
    for at in range(0, len(y), BATCH):
        i = order[at : at + BATCH]
        slots = k + s[i]
        z = w[-1] + x[i] @ w[:k] + w[slots].sum(axis=1)
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        loss += float((sw[i] * np.logaddexp(0, np.where(y[i] == 1, -z, z))).sum())
        g = sw[i] * (p - y[i]) / len(i)
        w[:-1] *= 1 - rate * alpha * (1 - l1)
        w[:k] -= rate * (g @ x[i])
        np.subtract.at(w, slots.reshape(-1), rate * np.repeat(g, slots.shape[1]))
        w[-1] -= rate * g.sum()
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate * alpha * l1, 0)
    return loss


def fit_logistic(train: DataFrame, target: str, numeric: list[str], categories: list[str], epochs: int = EPOCHS, alpha: float = ALPHA, l1: float = L1, rate: float = RATE, seed: int = 42) -> Linear:
    """Learns from all rows with a target (0 or 1); both classes must be there. Ends early when
    ``PATIENCE`` epochs in a row gain less than ``GAIN`` of loss."""
    train = train.where(F.col(target).isNotNull())
    counts = {int(r[0]): r[1] for r in train.groupBy(F.col(target).cast("int")).count().collect()}
    if set(counts) != {0, 1}:
        raise ValueError(f"both classes are needed, found {counts}")
    total = sum(counts.values())
    model = _prepare(train, numeric, categories)
    sw = F.when(F.col(target) == 1, total / 2 / counts[1]).otherwise(total / 2 / counts[0])
    rows = model.vectors(train).select("_x", "_s", F.col(target).cast("double").alias("_y"), sw.alias("_w")).persist()
    k, m, best, stale = len(numeric), len(categories), np.inf, 0
    try:
        for epoch in range(epochs):
            start, step = model.weights, rate / np.sqrt(1 + epoch)

            def run(batches, start=start, step=step, epoch=epoch):
                w, n, loss = start.copy(), 0, 0.0
                for b in batches:
                    x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, k)
                    s = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, m)
                    loss += _steps(x, s, b.column(2).to_numpy(), b.column(3).to_numpy(), w, step, alpha, l1, np.random.default_rng([seed, epoch, n]))
                    n += b.num_rows
                if n:
                    some = np.flatnonzero((w != 0) | (start != 0))
                    at, value = [*some.tolist(), -1, -2], [*(w[some] * n).tolist(), loss, float(n)]
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(value)], names=["i", "v"])

            sums = {r["i"]: r["v"] for r in rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
            n, loss = sums.pop(-2), sums.pop(-1)
            model.weights = np.zeros_like(start)
            model.weights[list(sums)] = np.array(list(sums.values())) / n
            model.losses.append(loss / n)
            stale = 0 if model.losses[-1] < best - GAIN else stale + 1
            best = min(best, model.losses[-1])
            if stale >= PATIENCE:
                break
    finally:
        rows.unpersist()
    return model
