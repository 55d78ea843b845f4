"""What a refresh rewrites, and that it equals the full run."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from pitchlake.plans import bridge, recompute

SF = "/root/testdata/sf0.001"


def files(path):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def rows(tables):
    text = lambda df: sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())
    return {name: text(df) for name, df in tables.items()}


@pytest.fixture(scope="module")
def football(spark):
    flat = bridge.events(spark, SF).cache()
    return bridge.details(flat), bridge.appearances(flat)


def test_a_match_touches_its_season_alone(spark, football, tmp_path):
    events, played = football
    one = played.where("season_id = 2").agg(F.max("match_id").alias("match_id"))
    part, full = f"{tmp_path}/part", f"{tmp_path}/full"
    match_id = one.first()["match_id"]
    recompute.recompute({"events": events.where((F.col("match_id") != match_id) | (F.col("event_id") % 2 == 0)), "appearances": played}, part, min_minutes=30)
    before = files(part)
    got = recompute.refresh({"events": events, "appearances": played}, part, one, min_minutes=30)
    want = recompute.recompute({"events": events, "appearances": played}, full, min_minutes=30)
    assert rows(got) == rows(want)
    after = files(part)
    kept = {f for f in before if "season_id=1" in f}
    assert kept and kept <= after and not {f for f in after - before if "season_id=2" not in f}
    assert {f.split("/")[0] for f in after - before} == set(want)


def test_a_match_that_is_gone_or_moves(spark, football, tmp_path):
    """The only match of a season is taken out: the season goes from all tables; then it is played in another season."""
    events, played = football
    third = played.where("season_id = 2").agg(F.max("match_id")).first()[0]
    moved = lambda df: df.withColumn("season_id", F.when(F.col("match_id") == third, 3).otherwise(F.col("season_id")))
    one = spark.createDataFrame([(third,)], "match_id bigint")
    path, full = f"{tmp_path}/part", f"{tmp_path}/full"
    recompute.recompute({"events": moved(events), "appearances": moved(played)}, path, min_minutes=30)
    got = recompute.refresh({"events": events.where(F.col("match_id") != third), "appearances": played.where(F.col("match_id") != third)}, path, one, min_minutes=30)
    assert all(df.where("season_id = 3").isEmpty() for df in got.values())
    assert not [f for f in files(path) if "season_id=3" in f]
    got = recompute.refresh({"events": events, "appearances": played}, path, one, min_minutes=30)
    assert rows(got) == rows(recompute.recompute({"events": events, "appearances": played}, full, min_minutes=30))


def test_weights_reach_what_is_made_with_them(spark, football, tmp_path):
    events, played = football
    tables, path = {"events": events, "appearances": played}, f"{tmp_path}/weights"
    recompute.recompute(tables, path, min_minutes=30)
    before = files(path)
    heavier = recompute.config.profile_weights(spark).withColumn("weight", F.when(F.col("metric_key") == "passes_p90", 9.0).otherwise(F.col("weight")))
    got = recompute.refresh(tables | {"profile_weights": heavier}, path, changed=["profile_weights"], min_minutes=30)
    assert {f.split("/")[0] for f in files(path) - before} == {"player_profiles", "club_fit"}
    assert rows(got) == rows(recompute.recompute(tables | {"profile_weights": heavier}, f"{tmp_path}/full", min_minutes=30))
    with pytest.raises(ValueError):
        recompute.refresh(tables, path, changed=["weather"])
    same = files(path)
    recompute.refresh(tables, path, spark.createDataFrame([], "match_id bigint"), min_minutes=30)
    recompute.refresh(tables, path, min_minutes=30)
    assert files(path) == same


def test_changed_matches_are_found_once(spark, football, tmp_path):
    events, played = football
    tables, found = {"events": events, "appearances": played}, spark.sparkContext.accumulator(0)
    seen = F.udf(lambda m: (found.add(1), m)[1], "bigint")
    last = played.where("season_id = 2").agg(F.max("match_id").alias("match_id")).first()["match_id"]
    one = spark.createDataFrame([(last,)], "match_id bigint").withColumn("match_id", seen("match_id"))
    recompute.recompute(tables, f"{tmp_path}/once", min_minutes=30)
    recompute.refresh(tables, f"{tmp_path}/once", one, min_minutes=30)
    assert found.value == 1
