"""Canonical events: places, ids, defaults, derived flags and the choice of expected goals."""

import pytest

from pitchlake.sources.canonical import canonical_events

SCHEMA = """provider_event_id string, match_external_id string, team_external_id string, player_external_id string, type string, minute int, x double, y double, end_x double, end_y double,
pass struct<recipient_external_id:string,completed:boolean>, shot struct<xg:double,is_penalty:boolean,body_part:string>, duel struct<duel_type:string,won:boolean>"""


def row(i, kind, x=None, y=None, end_x=None, end_y=None, **detail):
    return (i, "m", "t1", "p1", kind, 3, x, y, end_x, end_y, detail.get("pass_"), detail.get("shot"), detail.get("duel"))


@pytest.fixture(scope="module")
def found(spark):
    rows = [
        row("pass", "PASS", 20.0, 34.0, 60.0, 34.0, pass_=("p2", True)), row("bare pass", "PASS"), row("half a place", "PASS", 20.0, None, 60.0, 34.0),
        row("shot", "SHOT", 93.0, 34.0, shot=(0.0, False, "Left")), row("header", "SHOT", 93.0, 34.0, shot=(None, False, "HEAD")), row("known", "SHOT", 93.0, 34.0, shot=(0.3, False, None)),
        row("penalty", "SHOT", 94.0, 34.0, shot=(None, True, None)), row("nowhere", "SHOT", shot=(None, True, None)), row("bare shot", "SHOT", 93.0, 34.0),
        row("carry", "CARRY", 60.0, 20.0, 90.0, 34.0), row("duel", "DUEL", duel=("Unheard of", True)), row("strange", "JUGGLE"), row("none", None), row("far", "TOUCH", 125.0, -3.0),
    ]
    mapping = spark.createDataFrame([("PLAYER", "p1", 11), ("TEAM", "t1", 1)], "entity_type string, external_id string, internal_id int")
    events = canonical_events(spark.createDataFrame(rows, SCHEMA), "CANONICAL_105_68", mapping)
    return {r.provider_event_id: r for r in events.collect()}


def test_ids_and_places(found):
    a = found["pass"]
    assert (a.player_id, a.team_id, a.match_id, a["pass"].recipient_id, a.possession_team_id) == (11, 1, None, None, None)
    assert (found["half a place"].x, found["half a place"].end_x, found["far"].x, found["far"].y) == (None, 60.0, 105.0, 0.0)
    assert (a.timestamp_ms, a.period, a.second, a.under_pressure) == (180_000, 1, 0, False)


def test_derived_details(found):
    a, b, c = found["pass"]["pass"], found["bare pass"]["pass"], found["carry"].carry
    assert a.is_progressive and not a.into_final_third and a.length_m == 40 and a.completed
    assert b.completed and not b.is_progressive and b.length_m == 0 and b.height == "UNKNOWN"
    assert c.into_box and c.into_final_third and c.is_progressive and c.distance_m == 33.11 and c.progressive_distance_m > 30
    assert not found["half a place"]["pass"].is_progressive and found["pass"].shot is None
    assert (found["duel"].duel.duel_type, found["duel"].duel.won) == ("GROUND", True)
    assert found["strange"].type == found["none"].type == "OTHER"


def test_expected_goals(found):
    xg = {k: r.shot.xg for k, r in found.items() if r.shot is not None}
    assert xg["known"] == 0.3 and xg["penalty"] == 0.76 and xg["nowhere"] == 0 and xg["shot"] == xg["bare shot"] == 0.267 and xg["header"] == 0.147
    assert found["shot"].shot.distance_m == 12 and found["nowhere"].shot.distance_m is None


def test_both_teams_shoot_at_the_same_goal(spark):
    rows = [(str(i), "m", f"t{i % 2}", "p", "SHOT", 1, 110.0, 40.0, None, None, None, None, None) for i in range(4)]
    events = canonical_events(spark.createDataFrame(rows, SCHEMA), "STATSBOMB_120_80")
    assert {(r.team_id, r.x, r.y) for r in events.collect()} == {("t0", 96.25, 34.0), ("t1", 96.25, 34.0)}
