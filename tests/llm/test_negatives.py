"""Hard negatives against a full scan."""

import random

import pytest
from pyspark.sql import functions as F

from strikeframe.llm import negatives

SCHEMA = "vec_id long, label int, vector array<long>, norm double, block int"


def plain(rows, anchors, positives=5, k=10):
    rows = [r for r in rows if None not in r[:3]]
    out = []
    for a in sorted({r[0] for r in anchors}):
        _, label, v = min(((r[0], r[1], r[2]) for r in anchors if r[0] == a), key=lambda r: (r[1], r[2]))
        scored = sorted((-sum(x * y for x, y in zip(v, r[2])), r[0], r[1]) for r in rows)
        like = [(s, i) for s, i, g in scored if g == label and i != a][:positives]
        for s, i in like:
            within = [(t, j) for t, j, g in scored if g != label and 30 * -s <= 100 * -t <= 90 * -s][:k]
            out += [(a, i, n, j, -s, -t) for n, (t, j) in enumerate(within, 1)]
    return sorted(out)


def rows_of(kind, n=400):
    rng = random.Random(kind)
    size = {"small": 40, "wide": 40, "huge": 10**9, "hot": 3}[kind]
    out = []
    for i in range(n):
        scale = rng.choice([1, 1, 4, 9]) if kind == "wide" else 1
        v = [1, 2, 3, 4] if kind == "hot" and i % 3 else [scale * rng.randint(-size // 3, size) for _ in range(4)]
        out.append((i, rng.randint(0, 3), v, 0.0, 1))
    return out


@pytest.mark.parametrize("kind", ["small", "wide", "huge", "hot"])
def test_equals_a_full_scan(spark, kind, monkeypatch):
    for name, size in {"STRETCH": 60, "BUCKET": 16, "BLOCK": 7, "DENSE": 3}.items():
        monkeypatch.setattr(negatives, name, size)
    rows = rows_of(kind)
    rows += [rows[20], rows[20], rows[40][:1] + (3,) + rows[40][2:]]  # repeated rows, and an id with two labels
    frame = spark.createDataFrame(rows, SCHEMA)
    got = negatives.mine(frame, frame.where(F.col("vec_id") % 20 == 0)).collect()
    assert sorted(map(tuple, got)) == plain(rows, [r for r in rows if r[0] % 20 == 0])


def test_many_equal_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(negatives, "STRETCH", 500)
    rows = [(7, 1, [3, 4], 0.0, 1)] * 3000 + [(0, 0, [5, 5], 0.0, 1), (1, 0, [8, 8], 0.0, 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = negatives.mine(frame, frame.where("vec_id = 0")).collect()
    assert sorted(map(tuple, got)) == [(0, 1, n, 7, 80, 35) for n in range(1, 11)]


def test_nulls_and_empty(spark):
    rows = [(None, 1, [1], 0.0, 1), (0, None, [1], 0.0, 1), (1, 1, None, 0.0, 1), (100, 1, [2], 0.0, 1), (2, 1, [2, 3], 0.0, 1), (3, 2, [1], 0.0, 1), (4, 2, [], 0.0, 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = negatives.mine(frame, frame.where("vec_id % 100 = 0")).collect()
    assert [tuple(r) for r in got] == [(100, 2, 1, 3, 4, 2)]
    assert negatives.mine(frame.limit(0), frame.limit(0)).collect() == []
