"""Supervised factor models on a train / embargo / test split of dates."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.operators import order_stats


def feature_frame(rows: DataFrame, payload: str, columns: Sequence[str]) -> DataFrame:
    """JSON payload to numeric columns; booleans become 0/1, anything unreadable NULL."""
    def num(c: str):
        text = F.get_json_object(F.col(payload), f"$.{c}")
        return (F.when(text == "true", 1.0).when(text == "false", 0.0)
                .otherwise(text.try_cast("double")).alias(c))
    return rows.select(*[c for c in rows.columns if c != payload], *[num(c) for c in columns])


def usable(train: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at least one known value in the training rows (one small aggregate row)."""
    seen = train.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in columns]).first()
    return [c for c in columns if seen[c]]


@dataclass(frozen=True)
class Ridge:
    """A fitted ridge: per column the fill, mean and scale it was fitted with, and its coefficient."""
    columns: tuple[str, ...]
    fills: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def prediction(self) -> Column:
        out = F.lit(self.intercept)
        for c, fill, mean, scale, b in zip(self.columns, self.fills, self.means, self.scales, self.coefficients):
            known = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(fill))
            out = out + F.lit(b) * (known - F.lit(fill + mean)) / F.lit(scale)
        return out


def ridge(train: DataFrame, columns: Sequence[str], label: str, alpha: float = 1.0) -> Ridge:
    """Median fill, standardise (population deviation; a constant column keeps scale 1), ridge with penalty ``alpha``
    on the summed loss.

    The rows are read for exact medians and once more for their moments; counts, sums and cross products combine
    before the shuffle, so p rows of p numbers come back and the normal equations are solved from them.
    """
    cols, p = list(columns), len(columns)
    known = [F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in cols]
    melted = train.select(F.posexplode(F.array(*known)).alias("i", "v"))
    fills = [0.0] * p
    for r in order_stats.quantiles(melted, ["i"], "v", {"mid": 0.5}).collect():
        fills[r["i"]] = r["mid"]
    shifted = F.array(*(F.coalesce(k, F.lit(f)) - F.lit(f) for k, f in zip(known, fills)))
    rows = train.select(shifted.alias("x"), F.col(label).cast("double").alias("y")).select("x", "y", F.posexplode("x").alias("i", "v"))
    sums = rows.groupBy("i").agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.sum("y").alias("y"), F.sum(F.col("v") * F.col("y")).alias("vy"),
                                 F.array(*(F.sum(F.col("v") * F.col("x")[j]) for j in range(p))).alias("vx")).orderBy("i").collect()
    n = float(sums[0]["n"])
    mean, my = np.array([r["v"] for r in sums]) / n, sums[0]["y"] / n
    cov = np.array([r["vx"] for r in sums]) / n - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov), 0.0, None))
    scale = np.where(sd > 0, sd, 1.0)
    gram = n * cov / np.outer(scale, scale) + alpha * np.eye(p)
    b = np.linalg.solve(gram, n * (np.array([r["vy"] for r in sums]) / n - mean * my) / scale)
    return Ridge(tuple(cols), *(tuple(map(float, v)) for v in (fills, mean, scale, b)), float(my))


def boosted(columns: Sequence[str], label: str, rounds: int = 300, seed: int = 42) -> Pipeline:
    """Shallow boosted trees for feature importance, not for scoring; rounds end early once the rows marked ``_held``
    gain nothing more."""
    filled = [f"_i_{c}" for c in columns]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=list(columns), outputCols=filled, relativeError=1e-4),
        VectorAssembler(inputCols=filled, outputCol="_x"),
        GBTRegressor(featuresCol="_x", labelCol=label, maxDepth=3, maxIter=rounds, stepSize=0.05,
                     subsamplingRate=0.8, seed=seed, validationIndicatorCol="_held", validationTol=1e-4),
    ])


def fit_and_score(rows: DataFrame, columns: Sequence[str], label: str, kind: str = "ridge",
                  min_rows: int = 50) -> tuple[Ridge | PipelineModel | None, DataFrame]:
    """Fit on ``segment = 'train'`` rows with a label; predict every train and test row."""
    labelled = rows.where((F.col("segment") == "train") & F.col(label).isNotNull())
    wanted = rows.where(F.col("segment").isin("train", "test"))
    n = labelled.count()
    cols = usable(labelled, columns)
    if n < min_rows or not cols:
        return None, rows.withColumn("prediction", F.lit(None).cast("double"))
    if kind == "ridge":
        fitted = ridge(labelled, cols, label)
        return fitted, wanted.withColumn("prediction", fitted.prediction())
    held = F.pmod(F.xxhash64(*cols, label), F.lit(7)) == 0
    model = boosted(cols, label).fit(labelled.withColumn("_held", held))
    return model, model.transform(wanted).drop("_x", *[f"_i_{c}" for c in cols])


def importances(model: PipelineModel, columns: Sequence[str], rows: DataFrame) -> DataFrame:
    """(factor, importance) of a boosted model."""
    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    return rows.sparkSession.createDataFrame(
        list(zip(columns, values)), "factor string, importance double")

