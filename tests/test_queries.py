"""Registered queries against DuckDB, and what the driver asks of the entry module."""

import ast
import math
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from pitchlake import queries, queries_sources  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = "player_match_metrics player_season_metrics player_percentiles player_dna rank_roles team_match_metrics team_style heatmap_kde passing_network_edges player_physical zone_rollup new_events search_players global_search rating_consensus stream_events"
CHECKED = f"{CHECKED} club_fit heatmap_kde_covariance match_players name_similarity team_hulls read_events_120x80 read_match_index read_csv_inbox read_api_dump_data stream_provider_events".split()


def plain(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) and not math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(queries.ORACLES[name])
    assert sorted(d[0] for d in found.description) == columns
    order = [[d[0] for d in found.description].index(c) for c in columns]
    expected = sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())
    got = sorted(tuple(map(plain, r)) for r in df.select(columns).collect())
    assert got == expected and got


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.QUERIES) <= set(entry.queries())


def test_nothing_else_imports_the_text_operators():
    root = pathlib.Path(entry.__file__).parent / "pitchlake"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or "", *(a.name for a in node.names)] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n.split(".") or n == "corpus_pipeline" for n in names), path


def test_invariants(spark):
    from pyspark.sql import functions as F

    t = queries.Tables(spark, SF)
    assert t.pct().where(~F.col("percentile").between(0, 100)).count() == 0
    shares = t.team_match().groupBy("match_id").agg(F.sum("possession").alias("p"), F.sum("passes").alias("n")).where("n > 0")
    assert shares.where(F.abs(F.col("p") - 100) > 0.2).count() == 0
    assert queries.QUERIES["heatmap_grid"](spark, SF).groupBy("team_id").agg(F.max("value").alias("m")).where("m <> 1").count() == 0


def test_frames_are_made_where_their_list_is(spark, tmp_path, monkeypatch):
    """Only numbers of frames are moved, however long their text is; files are compressed where they are read whole, and small where they are not."""
    from pyspark.sql import functions as F

    from pitchlake.plans import bridge

    lists = bridge.frame_lists(spark, SF, (F.col("frame_index") % 5).alias("game"))
    found = lists.select(F.explode("frames").alias("f")).select("f.*").select("session_id", "frame_index", "ball_in_play", "possession_team_id", F.inline("players"))
    want = bridge.tracking(spark, SF).select(*found.columns)
    assert found.exceptAll(want).count() == 0 and found.count() == want.count()
    moved = lists._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[1]
    assert "players" not in moved and "frame_index" in moved
    monkeypatch.setattr(queries_sources, "_scratch", lambda spark, name: f"{tmp_path}/{name}")
    frames = bridge.read(spark, SF, "events").count()
    for name, most, ending in (("read_large_tracking_normalized", 1200, "txt"), ("read_tracking_normalized", 300, "txt.gz"), ("read_tracking_centered", 300, "txt.gz")):
        assert queries.QUERIES[name](spark, SF).count() == 22 * frames
        files = [p for p in tmp_path.rglob("part-*") if p.name.endswith(ending) and p.stat().st_size > 3000]
        assert files and sum(p.stat().st_size for p in files) < most * frames, name
        tmp_path = tmp_path / "next"


def test_a_long_match_is_several_files(spark, tmp_path, monkeypatch):
    """A file is made and parsed as a whole, so it mustn't grow with its match; the events stay what they are."""
    import json
    from collections import Counter

    from pitchlake.plans import bridge

    monkeypatch.setattr(queries_sources, "PIECE", 2, raising=False)
    queries_sources._events_120x80(spark, SF, str(tmp_path))
    files = {p: json.loads(p.read_text()) for p in tmp_path.rglob("part-*")}
    want = {str(r.event_id): str(r.match_id) for r in bridge.events(spark, SF).select("event_id", "match_id").collect()}
    assert {e["id"]: p.parent.name.removeprefix("match_id=") for p, es in files.items() for e in es} == want and sum(map(len, files.values())) == len(want)
    longest = max(Counter(want.values()).values())
    assert len(files) > 2 * len(set(want.values())) and max(map(len, files.values())) < longest
    assert queries.QUERIES["stream_provider_events"](spark, SF).distinct().count() == len(want)
