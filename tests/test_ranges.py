"""Records of JSON arrays in byte ranges."""

from __future__ import annotations

import json
import random

import pytest

from pitchlake.sources import ranges, readers

SCHEMA = "id bigint, note string, parts array<struct<x:double>>"


def records(n):
    r = random.Random(n)
    words = ['plain', 'a "quoted" {"id": 5} word', "ünï ☃", "}, {", "[{", "line\nbreak", ""]
    return [{"id": k, "note": r.choice(words) * r.randrange(4), "parts": [{"x": r.random()} for _ in range(r.randrange(5))]} for k in range(n)]


@pytest.mark.parametrize("size", [7, 100, 1000, 10**6])
@pytest.mark.parametrize("style", ["dense", "spaced", "enveloped"])
def test_every_record_once(spark, tmp_path, size, style):
    rows = records(60)
    text = {"dense": json.dumps(rows, separators=(",", ":")), "spaced": json.dumps(rows, indent=3), "enveloped": json.dumps({"rows": rows, "more": [{"y": 1}]})}[style]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text(text)
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "none.json").write_text("")
    (tmp_path / "other.txt").write_text(text)
    found, bad = ranges.read_records(spark, f"file://{tmp_path}", "*.json", ("id",), SCHEMA, size)
    got = sorted((r.id, r.note, [p.x for p in r.parts]) for r in found.collect())
    assert got == [(r["id"], r["note"], [p["x"] for p in r["parts"]]) for r in rows] and bad.count() == 0


def test_records_that_cannot_be_parsed(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"id": 1, "note": "a"}, {"id": 2, "note": oops}, {"id": 3, "note": "c"}, {"id": 4, "note": "cut off')
    found, bad = ranges.read_records(spark, str(tmp_path), "*.json", ("id",), SCHEMA)
    assert sorted(r.id for r in found.collect()) == [1, 3]
    assert sorted((r.start > 0, r.record[:8]) for r in bad.collect()) == [(True, '{"id": 2'), (True, '{"id": 4')]


def test_one_match_is_several_tasks(spark, tmp_path):
    player = lambda k: {"trackable_object": k, "x": k / 10, "y": -k / 10, "z": 0.0}
    frames = [{"possession": {"group": "home team"}, "data": [player(k) for k in (10, 11, 55)], "frame": f, "timestamp": "00:00:01.20", "period": 1} for f in range(500)]
    about = {"home_team": {"id": 1}, "away_team": {"id": 2}, "players": [{"id": 90 + k, "trackable_object": k, "team_id": k - 9} for k in (10, 11)]}
    folder = tmp_path / "matches" / "7"
    folder.mkdir(parents=True)
    (folder / "structured_data.json").write_text(json.dumps(frames))
    (folder / "match_data.json").write_text(json.dumps(about))
    whole = readers.read_tracking_centered(spark, f"file://{tmp_path}")
    parts, bad = readers.read_large_tracking_centered(spark, f"file://{tmp_path}", 10_000)
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect())) and whole.count() == 1000 and bad.count() == 0
    raw = spark.read.format("json_records").options(path=f"file://{tmp_path}/matches", files="structured_data.json", keys="possession", bytes="10000").load()
    assert raw.rdd.getNumPartitions() > 5 and raw.count() == 500


def test_a_task_takes_many_ranges(spark, tmp_path, monkeypatch):
    """Ranges beyond the number of tasks are dealt to these, each range once; few ranges are a task each."""
    for k in range(30):
        (tmp_path / f"{k}.json").write_text(json.dumps([{"id": 100 * k + i, "note": "n" * 30, "parts": []} for i in range(40)]))
    reader = ranges.JsonRecords({"path": str(tmp_path), "files": "*.json", "keys": "id", "bytes": "200"}).reader(None)
    each = reader.partitions()
    want = sorted((path, at) for p in each for path, a, b, _ in p.parts for at in range(a, b, 200))
    assert len(each) == len(want) > 300
    monkeypatch.setattr(ranges, "TASKS", 20)
    few = reader.partitions()
    assert 20 <= len(few) <= 30 and sorted((path, at) for p in few for path, a, b, _ in p.parts for at in range(a, b, 200)) == want
    got = [json.loads(t)["id"] for p in few for batch in reader.read(p) for t in batch.column("record").to_pylist()]
    assert sorted(got) == [100 * k + i for k in range(30) for i in range(40)]
