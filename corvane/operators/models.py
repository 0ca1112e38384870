"""Relevance classifier, principal-component index and small regressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.vectors import best_dots


def train_classifier(rows: DataFrame, vec: str = "vec", label: str = "label", positive: str = "RELEVANT", c: float = 1.5, iterations: int = 3000):
    """Centred principal components, then a balanced logistic regression; returns the fitted pipeline.

    rows: a bounded training set of labelled vectors. Components: a third of the rows, at most the
    dimension. Balanced weights sum to the number of rows, which turns C into regParam = 1 / (C n).
    """
    d = rows.select(array_to_vector(F.col(vec).cast("array<double>")).alias("raw"), (F.col(label) == positive).cast("double").alias("y"))
    n, n_pos = d.agg(F.count("*"), F.sum("y")).first()
    if not n or n_pos in (0, n):
        raise ValueError("both labels are needed")
    weight = F.when(F.col("y") == 1, n / (2 * n_pos)).otherwise(n / (2 * (n - n_pos)))
    dim = d.first()["raw"].size
    k = max(1, min(n // 3, dim))
    stages = [
        StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False),
        PCA(k=k, inputCol="centred", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", regParam=1.0 / (c * n), elasticNetParam=0.0, maxIter=iterations, standardization=False),
    ]
    return Pipeline(stages=stages).fit(d.withColumn("w", weight))


def relevant_probability(model, df: DataFrame, vec: str = "vec") -> DataFrame:
    """df with the probability of the positive label; null for a null vector. The three fitted stages come to one linear score, a product a batch."""
    scaler, pca, lr = model.stages
    weights = pca.pc.toArray() @ lr.coefficients.toArray()
    score = best_dots(F.col(vec), [weights[None, :]])[0] + float(lr.intercept - scaler.mean.toArray() @ weights)
    return df.withColumn("probability", 1 / (1 + F.exp(-score)))


def _moments(df: DataFrame, names: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and covariances of columns (null as 0). Tasks sum up products of centred rows; only k means and k by k sums reach the driver."""
    x = df.select(F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]).alias("x"))
    k = len(names)
    r = x.agg(F.count("*").alias("n"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(k)]).first()
    mean = np.array([r[f"m{i}"] or 0.0 for i in range(k)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            z = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k) - mean
            total += z.T @ z
        i, j = np.divmod(np.arange(k * k), k)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "s"])

    cov = np.zeros((k, k))
    for s in x.mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        cov[s["i"], s["j"]] = s["s"] / max(1, r["n"])
    return r["n"], mean, (cov + cov.T) / 2


def efi(profiles: DataFrame, key: str, dims: dict[str, int], least: int = 2) -> DataFrame:
    """key, score (first principal component), loading of each dimension, variance ratio.

    dims: name -> sign with which it should point along the component. The component comes from the correlations of the
    dimensions, scores are a column over the table, of any size. Fewer than `least` groups have no index.
    """
    names = list(dims)
    n, mean, cov = _moments(profiles, names)
    schema = f"{key} {dict(profiles.dtypes)[key]}, score double, variance_ratio double, " + ", ".join(f"load_{x} double" for x in names)
    if n < least:
        return profiles.sparkSession.createDataFrame([], schema)
    sd = np.sqrt(np.diag(cov))
    sd = np.where(sd == 0, 1, sd)
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    load, total = vectors[:, -1], values.sum()
    if float(load @ np.array(list(dims.values()), dtype=float)) < 0:
        load = -load
    ratio = float(values[-1] / total) if total > 0 else 0.0
    score = sum((F.coalesce(F.col(x).cast("double"), F.lit(0.0)) - float(m)) * float(a / d) for x, m, a, d in zip(names, mean, load, sd))
    return profiles.select(key, F.round(score, 3).alias("score"), F.lit(round(ratio, 4)).alias("variance_ratio"), *[F.lit(round(float(a), 4)).alias(f"load_{x}") for x, a in zip(names, load)])


def ols(profiles: DataFrame, target: str, predictors: list[str]) -> dict | None:
    """Least squares of a target on predictors (null as 0), from their covariances; None with too few groups."""
    n, mean, cov = _moments(profiles, [target, *predictors])
    if n < len(predictors) + 2:
        return None
    beta = np.linalg.lstsq(cov[1:, 1:], cov[1:, 0], rcond=None)[0]
    left = cov[0, 0] - 2 * beta @ cov[1:, 0] + beta @ cov[1:, 1:] @ beta
    r2 = 1 - float(left / cov[0, 0]) if cov[0, 0] > 0 else 0.0
    return {"n": n, "intercept": round(float(mean[0] - beta @ mean[1:]), 4), "r2": round(r2, 4), **{f"b_{p}": round(float(b), 4) for p, b in zip(predictors, beta)}}


def ols_single(df: DataFrame, target: str, predictor: str) -> DataFrame:
    """One-predictor case as aggregates, for tables of any size."""
    y, x = F.col(target).cast("double"), F.col(predictor).cast("double")
    return df.agg(F.count("*").alias("n"), F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 4).alias("r2"))
