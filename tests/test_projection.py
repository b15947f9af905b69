"""Projections of a small slate: opponents, names, features, fallbacks and scale."""

import math

import pytest

from strikeframe.functions import text as X
from strikeframe.plans import projection as P

PLAYERS = "slate_id string, player_name string, opponent_name string, game_info string, salary double, avg_points double"


@pytest.fixture(scope="module")
def slate(spark):
    rows = [
        ("1", "José Aldo Jr.", None, "Aldo Jr.@Silva 03/07/2026 06:00PM ET", 8000.0, 50.0),
        ("1", "Anderson Silva", "aldo jr", None, 9000.0, 60.0),
        ("1", "Bruno Costa", "Costa", None, 7000.0, 0.0),  # a token that only others may answer: the other Costa
        ("1", "Paulo Costa", " ", "nobody here", 7000.0, 0.0),
        ("2", "Nick Diaz", "Silva", None, 0.0, 0.0),  # two of that name in the slate
        ("2", "Old Silva", "Diaz", None, 5000.0, 0.0),
        ("2", "New Silva", None, None, 5000.0, 0.0),
        ("2", None, None, None, None, None),
    ]
    fighters = spark.createDataFrame([("f1", "jose aldo"), ("f2", "anderson silva"), ("f3", "paulo costa"), ("f0", "paulo costa"), ("f5", "nick diaz"), ("f6", "olde silva"), ("f9", "")], "fighter_id string, name_norm string")
    aliases = spark.createDataFrame([("dk", "bruno costa", "f7"), ("web", "New Silva", "f8")], "source string, raw_name string, fighter_id string")
    features = spark.createDataFrame(
        [(1, "f1", '{"pre_last3_sig_land_pm": 1}'), (2, "f1", '{"pre_last3_sig_land_pm": 4.0, "is_5_round": true}'), (3, "f1", "no json"), (2, "f2", '{"pre_last3_sig_land_pm": "NaN", "pre_last3_kd_pm": 9}')],
        "fight_id int, fighter_id string, payload_json string",
    )
    fights = spark.createDataFrame([(1, "2020-01-01"), (2, "2021-01-01"), (3, None)], "fight_id int, fight_date string")
    return spark.createDataFrame(rows, PLAYERS), fighters, aliases, features, fights


WIN, FINISH = ({"diff_pre_last3_sig_land_pm": 0.25}, 0.0), ({}, 9.0)


def test_projection(slate):
    got = {r.player_name: r for r in P.projected(*slate, WIN, FINISH).collect()}
    assert len(got) == 8
    aldo, silva = got["José Aldo Jr."], got["Anderson Silva"]
    assert (aldo.opponent_name, aldo.fighter_id, aldo.opponent_id) == ("Anderson Silva", "f1", "f2")
    assert (silva.opponent_name, silva.opponent_id) == ("José Aldo Jr.", "f1")
    assert aldo.edge_note == "model_ok f=exact:0.98 o=exact:1.00"
    assert aldo.p_win == pytest.approx(1 / (1 + math.exp(-1))) and aldo.p_finish_given_win == 0.8 and aldo.is_5_round
    assert (aldo.pace_sig_land_pm, silva.pace_sig_land_pm, silva.pace_kd_pm) == (4.0, 0.5, 0.35)
    assert (got["Bruno Costa"].opponent_name, got["Bruno Costa"].fighter_id, got["Bruno Costa"].opponent_id) == ("Paulo Costa", "f7", "f0")
    assert got["Paulo Costa"].opponent_name is None and got["Paulo Costa"].p_win == 0.5
    assert got["Nick Diaz"].opponent_name == "Silva"
    old = got["Old Silva"]
    assert (old.fighter_id, old.opponent_id) == ("f6", "f5") and old.edge_note.startswith("model_ok f=fuzzy:0.95")
    assert got["New Silva"].fighter_id is None and got["New Silva"].edge_note == "missing_fighter_match f=none:0.00 o=none:0.00"
    assert got[None].finish_equity == 0.175


def test_without_a_model(slate):
    got = {r.player_name: r.edge_note for r in P.projected(*slate, None, FINISH).collect()}
    assert got["Anderson Silva"] == "model_missing" and got[None].startswith("missing_fighter_match")


def test_scaled(spark):
    schema = "edge_note string, p_win double, proj_points double, floor double, ceiling double, stdev double, salary double, avg_points double"
    df = spark.createDataFrame([("model_ok", 0.5, 100.0, 40.0, 160.0, 30.0, 8000.0, 5.0), ("model_missing", 0.5, 100.0, 40.0, 160.0, 30.0, 0.0, 5.0), ("model_ok", 0.5, None, None, None, None, 1000.0, 0.0)], schema)
    ok, bare, none = P.scaled(df).collect()
    assert (ok.proj_mean, ok.proj_floor, ok.proj_ceiling) == (48.6, 13.6, 96.72)
    assert ok.value == pytest.approx(48.6 / 8, abs=1e-4) and ok.risk == pytest.approx(0.78 * 25.5 / 48.6, abs=1e-4)
    assert (bare.proj_mean, bare.value_per_1k) == (72.0, 0.0)
    assert none.proj_mean is None and none.proj == 6.5


def test_folded_letters(spark):
    df = spark.createDataFrame([("Błachowicz  Jiří",), ("Ș. Nguyễn-é",)], "n string")
    # a stroke is no mark, so the letter parts words
    assert [r[0] for r in df.select(X.norm_name_folded(df.n)).collect()] == ["b achowicz jiri", "s nguyen-e"]


def test_log_and_marks(spark, tmp_path):
    from pyspark.sql import functions as F

    from strikeframe.functions import display
    from strikeframe.sources import sinks

    old = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, None), (3, "c")], "k int, v string")
    for _ in range(2):
        sinks.append_log(sinks.audit_entries(old, new, "k", ["v"], "me", F.lit("now")), str(tmp_path / "log"))
    kept = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "log")).collect())
    assert kept == sorted([("me", 1, "v", "a", "b", "now"), ("me", 3, "v", None, "c", "now")] * 2, key=lambda x: x[1])
    marks = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (0.5,)], "x double")
    shown = [r[0] for r in marks.select(F.concat_ws(" ", display.fixed(marks.x), display.percent_of(marks.x, 0), display.whole_units(marks.x, "in"))).collect()]
    assert shown == ["- - —"] * 3 + ["0.50 50% 1 in"]
