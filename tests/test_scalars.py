from pyspark.sql import functions as F

from pitchlake.functions import names, scalars as S


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def xy(x, y, system, **k):
    cx, cy = S.to_canonical(F.lit(float(x)), F.lit(float(y)), system, **k)
    return F.struct(cx.alias("x"), cy.alias("y"))


def test_canonical_metres(spark):
    r = one(spark, a=xy(60, 40, "STATSBOMB_120_80"), b=xy(0, 0, "STATSBOMB_120_80"), c=xy(125, -3, "STATSBOMB_120_80"), d=xy(0.5, 0.5, "METRICA_0_1"), e=xy(50, 50, "OPTA_100_100"), f=xy(105, 0, "CANONICAL_105_68", flip=True), g=xy(50, 25, "PROVIDER_SPECIFIC", length=100, width=50))
    assert [tuple(x) for x in r] == [(52.5, 34), (0, 68), (105, 68), (52.5, 34), (52.5, 34), (0, 68), (52.5, 34)]


def test_pitch_predicates(spark):
    v = lambda *c: [F.lit(float(x)) for x in c]
    r = one(spark, a=S.in_final_third(F.lit(70.0)), b=S.in_final_third(F.lit(69.0)), c=S.in_box(*v(95, 34)), d=S.in_box(*v(95, 5)), e=S.distance_to_goal(*v(93, 34)), f=S.is_progressive(*v(20, 34, 60, 34)), g=S.is_progressive(*v(60, 20, 60, 48)), h=S.is_progressive(*v(95, 34, 96, 34)), i=S.progressive_distance(*v(20, 34, 60, 34)))
    assert tuple(r) == (True, False, True, False, 12.0, True, False, False, 40.0)


def test_expected_goals(spark):
    v = lambda x, y, **k: S.estimate_xg(F.lit(float(x)), F.lit(float(y)), **k)
    r = one(spark, pen=v(94, 34, penalty=True), near=v(99, 34), far=v(70, 34), head=v(99, 34, header=True), given=S.resolve_xg(F.lit(0.3), F.lit(1.0), F.lit(1.0)), none=S.resolve_xg(F.lit(0.0), F.lit(None).cast("double"), F.lit(1.0)))
    assert r.pen == 0.76 and r.near > r.far and r.head < r.near and r.given == 0.3 and r.none == 0.0


def test_rates_rounding_and_confidence(spark):
    q = lambda m, n, c=1.0: S.assess_quality(F.lit(m), F.lit(n), c)["confidence"]
    r = one(spark, a=S.per90(F.lit(2), F.lit(180)), b=S.per90(F.lit(3), F.lit(0)), c=S.per_possession(F.lit(12), F.lit(240)), d=S.jsround(F.lit(-2.5)), e=S.jsround(F.lit(0.125), 2), f=q(2847, 31), g=q(214, 4), h=q(45, 1), i=q(2000, 25, 0.4))
    assert tuple(r) == (1.0, 0.0, 5.0, -2.0, 0.13, "HIGH", "LOW", "INSUFFICIENT", "LOW")


def test_positions_clocks_and_spells(spark):
    spells = lambda *s: F.array(*(F.struct(F.lit(a).alias("from"), F.lit(b).cast("string").alias("to")) for a, b in s))
    r = one(spark, a=S.position_group(F.lit("Right Wing Back")), b=S.position_group(F.lit(None).cast("string")), c=S.position_group(F.lit("ST2")), d=S.clock_ms(F.lit("00:01:02.5")), e=S.clock_ms(F.lit("0:01:02.5"), "seconds"), f=S.minutes_from_spells(spells(("00:00", "00:45"), ("00:45", None))), g=S.minutes_from_spells(spells(("05:30", "60:00")), "minutes"))
    assert tuple(r) == ("DF", "MF", "FW", 62_500, 62_500, 90, 55)


def test_zones(spark):
    z = lambda x, y, s="THIRDS_LANES": S.zone_of(F.lit(x), F.lit(y), s)["key"]
    r = one(spark, a=z(10.0, 5.0), b=z(52.5, 34.0), c=z(100.0, 64.0), d=z(5.0, 5.0, "GRID_5X4"), e=z(F.lit(None).cast("double"), 5.0))
    assert tuple(r) == ("Defensive/Left", "Middle/Centre", "Attacking/Right", "C1R1", None)
    assert S.all_zones(spark).count() == 15 and S.all_zones(spark, "GRID_5X4").count() == 20


def test_names(spark):
    pairs = [("N'Golo Kanté", "ngolo kante"), ("Jan de Vries", "JAN DE VRIES"), ("Jan de Vries", "J. de Vries"), ("Jan de Vries", "Jan de Boer"), ("Sem Bakker", "Luuk Jansen"), ("", "x")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(names.name_similarity(F.col("a"), F.col("b")).alias("s"), names.normalise_name(F.col("a")).alias("n")).collect()
    s = [r.s for r in rows]
    assert rows[0].n == "ngolo kante" and s[:2] == [1.0, 1.0] and s[2] > 0.86 > s[3] and s[4] < 0.4 and s[5] == 0.0


def test_keys():
    assert S.to_snake("xgP90") == "xg_p90" and S.to_camel("passes_into_box_p90") == "passesIntoBoxP90"
