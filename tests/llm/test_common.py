from pitchlake.llm import common


def test_tables_of_a_run_can_be_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "RUN", "run-of-this-test")
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert common.stored(spark.range(3), "numbers").count() == 3 and common.shared_path(spark, "x") != common.shared_path(spark, "x")
    assert len(list((tmp_path / "run-of-this-test").iterdir())) == 1
    common.drop_tables(spark)
    assert not list(tmp_path.iterdir())
    common.drop_tables(spark)


def test_runs_that_share_a_driver_keep_their_tables_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    one, two = spark.newSession(), spark.newSession()
    for session, run in ((one, "run-one"), (two, "run-two")):
        session.conf.set(common.RUN_SETTING, run)
    kept, lost = common.stored(one.range(3), "numbers"), common.stored(two.range(4), "numbers")
    assert lost.count() == 4 and sorted(p.name for p in tmp_path.iterdir()) == ["run-one", "run-two"]
    common.drop_tables(two)
    assert kept.count() == 3 and [p.name for p in tmp_path.iterdir()] == ["run-one"]
    common.drop_tables(spark, "run-one")
    assert not list(tmp_path.iterdir())
