"""Queries over all customers, and the steps of the model."""

import numpy as np
from pyspark.sql import functions as F

from strikeframe.operators import windows
from strikeframe.plans import model
from strikeframe.sources import sinks

def test_model_as_numpy_fits_it(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.5, -0.7, 0.2] + 0.3)))).astype(float)
    rows = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y, strict=True)], "x array<double>, y double")
    w, b = model.train_logit(rows, 3, penalty=1e-2)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    gradient = np.append(x.T @ (p - y) / 400 + 1e-2 * np.array(w), (p - y).mean())
    assert np.abs(gradient).max() < 1e-8  # the loss is convex, so this is its least
    assert model.train_logit(rows.limit(0), 3) == ([0.0, 0.0, 0.0], 0.0)


def test_rows_that_were_lost(spark):
    rows = spark.createDataFrame([(None, 1), (None, 3), ("a", 5)], "k string, v long")
    assert sorted(r.share for r in windows.share(rows, ["k"], "v").collect()) == [0.25, 0.75, 1.0]
    old = spark.createDataFrame([(1, "a", "kept")], "k int, v string, other string")
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 1)], "k int, v string, seq int")
    got = {tuple(r) for r in sinks.upsert_columns(old, new, ["k"], {"v": "new"}, "seq").collect()}
    assert got == {(1, "y", "kept"), (2, "z", None)}
    assert [tuple(r) for r in sinks.upsert(old, old.limit(0).union(spark.createDataFrame([(1, "b", "p"), (1, "c", "o")], old.schema)), ["k"]).collect()] == [(1, "c", "o")]
