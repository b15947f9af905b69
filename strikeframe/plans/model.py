"""Win and finish models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeframe.functions.domain import logit
from strikeframe.functions.parse import label01, payload

#: The features that two fighters are compared by.
RATES = ["sig_land", "sig_att", "td_att", "td_land", "ctrl_sec", "kd", "sub_att"]
SPANS = ["career", "last3", "last5"]
FEATURES = [f"pre_{span}_{rate}_pm" for rate in RATES for span in SPANS] + ["pre_fights_count", "pre_days_since_last_fight", "pre_age_years", "is_5_round"]


def training_rows(payloads: DataFrame, features: list[str], label: str = "win", column: str = "payload_json") -> DataFrame:
    """x (array of the features) and y of the payloads in which all features and a 0/1 label are present."""
    m = payload(F.col(column))
    x = F.array(*[F.get(F.array(F.element_at(m, f)), F.lit(0)).try_cast("double") for f in features])
    rows = payloads.select(x.alias("x"), label01(F.element_at(m, label)).alias("y"))
    return rows.where(F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))


def train_logit(rows: DataFrame, width: int, penalty: float = 1e-3, passes: int = 50, enough: float = 1e-10) -> tuple[list[float], float]:
    """The weights and bias of least mean log loss plus penalty / 2 times the squared weights, by Newton's method.

    Every pass adds up a gradient and a curvature of fixed size in each partition and in Spark; a few passes bring the
    step below ``enough``. Descent by some thousand steps from zero ends near the same weights, but short of them.
    """
    n = rows.count()
    theta = np.zeros(width + 1)
    if not n:
        return theta[:-1].tolist(), 0.0
    ridge = np.append(np.full(width, penalty), 0.0)
    size = (width + 1) * (width + 2)

    def one_pass(theta: np.ndarray) -> np.ndarray:
        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((width + 1, width + 2))
            for pdf in batches:
                if len(pdf):
                    x = np.column_stack([np.stack(pdf.x.to_numpy()), np.ones(len(pdf))])
                    p = 1 / (1 + np.exp(-np.clip(x @ theta, -50, 50)))
                    total += x.T @ np.column_stack([x * (p * (1 - p))[:, None], p - pdf.y.to_numpy()])
            yield pd.DataFrame({"i": np.arange(size), "s": total.ravel()})

        got = rows.select("x", "y").mapInPandas(sums, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
        out = np.zeros(size)
        for r in got:
            out[r.i] = r.s
        return out.reshape(width + 1, width + 2) / n

    for _ in range(passes):
        total = one_pass(theta)
        step = np.linalg.solve(total[:, :-1] + np.diag(ridge + 1e-12), total[:, -1] + ridge * theta)
        theta = theta - step
        if np.abs(step).max() < enough:
            break
    return theta[:-1].tolist(), float(theta[-1])


def descend(rows: DataFrame, width: int, steps: int = 2500, rate: float = 0.05, penalty: float = 1e-3) -> tuple[list[float], float]:
    """The weights and bias after so many steps of plain descent from zero, which stop short of ``train_logit``'s.

    Each step is one aggregation of built-in functions over the rows, which are kept in memory meanwhile; what comes
    back is one row of sums. ``rows`` holds x, of ``width`` numbers, and y.
    """
    weights, bias = np.zeros(width), 0.0
    held = rows.select("x", "y").persist()
    try:
        n = held.count()
        for _ in range(steps if n else 0):
            error = logit(F.col("x"), F.array(*[F.lit(float(w)) for w in weights]).cast("array<double>"), F.lit(bias)) - F.col("y")
            sums = held.withColumn("e", error).agg(F.sum("e"), *[F.sum(F.col("e") * F.col("x")[i]) for i in range(width)]).first()
            slope = np.array(sums[1:], float) / n + penalty * weights
            weights, bias = weights - rate * slope, bias - rate * float(sums[0]) / n
    finally:
        held.unpersist()
    return weights.tolist(), float(bias)


def scored(df: DataFrame, x: str, weights: list[float], bias: float, out: str = "p_win") -> DataFrame:
    return df.withColumn(out, logit(F.col(x), F.array(*map(F.lit, weights)), F.lit(bias)))


def differences(a: str, b: str) -> Column:
    """Element-wise differences of two feature arrays, nulls as 0."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))
