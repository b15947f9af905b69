"""Lineups against a full enumeration and the greedy rule."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strikeframe.functions import domain as D
from strikeframe.plans import lineups, registry, slate

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def greedy(every, n, min_unique, most_each):
    taken, used = [], Counter()
    for r in every.orderBy(F.desc("score"), F.desc("salary"), "members").collect():
        if len(taken) < n and all(used[m] < most_each for m in r.members) and all(len({*r.members} & {*t}) <= 6 - min_unique for t in taken):
            taken.append(r.members)
            used.update(r.members)
    return taken


@pytest.mark.parametrize("mode, min_unique, exposure, at_once", [("gpp", 1, 0.65, 256), ("gpp", 2, 0.65, 7), ("cash", 3, 0.3, 256)])
def test_as_a_full_enumeration(spark, mode, min_unique, exposure, at_once):
    players = registry._slates(spark, DATA).where("slate_id < 3")
    got = lineups.optimized(players, "slate_id", mode, 20, min_unique=min_unique, max_exposure=exposure, at_once=at_once)
    found = {}
    for r in got.orderBy("slate", "rank").collect():
        found.setdefault(r.slate, []).append(r.members)
    for k in range(3):
        every = slate.feasible_lineups(players.where(F.col("slate_id") == k), D.player_score(mode))
        assert found.get(k, []) == greedy(every, 20, min_unique, max(1, round(20 * exposure)))


def test_one_slate_dealt_over_tasks_and_small_ones(spark):
    players = registry._players(spark, DATA)
    alone = lineups.optimized(players)
    every = slate.feasible_lineups(players, D.player_score("gpp"))
    assert [r.members for r in alone.orderBy("rank").collect()] == greedy(every, 20, 1, 13)
    assert lineups.optimized(players.limit(4)).collect() == [] and lineups.optimized(players.limit(0)).collect() == []


def test_descriptions_and_exposures(spark):
    players = registry._players(spark, DATA)
    got = lineups.optimized(players, n=5)
    by_id = {r.player_id: r for r in players.collect()}
    members = {r["rank"]: r.members for r in got.collect()}
    for r in lineups.described(got, players).collect():
        own = [by_id[m] for m in members[r["rank"]]]
        assert r.total_mean == sum(p.proj_mean for p in own) and abs(r.avg_risk - sum(p.risk for p in own) / 6) < 1e-9
        assert [p.player_id for p in r.players] == [p.player_id for p in sorted(own, key=lambda p: (-p.proj_mean, p.player_id))]
    counts = Counter(m for ms in members.values() for m in ms)
    assert {r.player_id: (r.n, r.exposure) for r in lineups.exposures(got).collect()} == {m: (n, n / 5) for m, n in counts.items()}


def test_few_slates_are_held_at_a_time():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["slate"])
    parts = list(lineups._few(iter([batch, batch.slice(0, 0), batch.slice(3, 5)])))
    assert max(p.num_rows for p in parts) <= lineups.SLATES_AT_ONCE
    assert [x for p in parts for x in p.column("slate").to_pylist()] == [*range(1000), 3, 4, 5, 6, 7]
