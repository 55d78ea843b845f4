"""Aggregates of tracking frames: team shape and physical output."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import jsround

#: Fixed values, in metres a second: beyond human speed, high speed, sprint.
IMPOSSIBLE, HIGH_SPEED, SPRINT = 12.0, 5.5, 7.0


def hull_areas(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Areas of the convex hulls of many point sets at once: rows are sets, padded with points that they have.

    All sets are wrapped together: from its lowest point on, each takes the point that has no other on its right (of
    those in one line the farthest), until it is back.
    """
    sets, points = x.shape
    if not sets or points < 3:
        return np.zeros(sets)
    rows = np.arange(sets)
    start = np.lexsort((x, y), axis=1)[:, 0]
    now, open_, area = start.copy(), np.ones(sets, bool), np.zeros(sets)
    for _ in range(points):
        cx, cy = x[rows, now], y[rows, now]
        best = now.copy()
        bx, by, far = np.zeros(sets), np.zeros(sets), np.zeros(sets)
        for k in range(points):
            dx, dy = x[:, k] - cx, y[:, k] - cy
            cross, length = bx * dy - by * dx, dx * dx + dy * dy
            better = (length > 0) & ((far == 0) | (cross < -1e-9) | ((np.abs(cross) <= 1e-9) & (length > far)))
            best[better], bx[better], by[better], far[better] = k, dx[better], dy[better], length[better]
        area += np.where(open_, cx * y[rows, best] - x[rows, best] * cy, 0.0)
        open_ &= (x[rows, best] != x[rows, start]) | (y[rows, best] != y[rows, start])
        now = best
        if not open_.any():
            break
    return np.abs(area) / 2


def hull_area(x: np.ndarray, y: np.ndarray) -> float:
    """Area of the convex hull of one set of points."""
    return float(hull_areas(np.asarray(x, float)[None, :], np.asarray(y, float)[None, :])[0])


def _hulls(xs: pd.Series, ys: pd.Series) -> pd.Series:
    sizes = xs.map(lambda a: 0 if a is None else len(a)).to_numpy()
    out = np.zeros(len(sizes))
    for n in np.unique(sizes[sizes >= 3]):  # sets of one size are one array
        own = sizes == n
        area = hull_areas(np.stack(xs[own].to_numpy()), np.stack(ys[own].to_numpy()))
        out[own] = np.floor(area * 100 + 0.5) / 100
    return pd.Series(out)


def convex_hull_area(points: Column) -> Column:
    """Hull area of an array of (x, y), 2 decimals; 0 under three points."""
    return F.pandas_udf(_hulls, "double")(F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"]))


PHASES = ["ALL", "IN_POSSESSION", "OUT_OF_POSSESSION"]


def team_shape(positions: DataFrame) -> DataFrame:
    """Mean shape of each session, team and phase, over frames with the ball in play and three players at least.

    A frame counts for ALL, and for one of the other phases if possession is known.
    """
    w = lambda c: F.max(c) - F.min(c)
    frames = positions.where("ball_in_play and team_id is not null").groupBy("session_id", "frame_index", "team_id").agg(
        F.first("possession_team_id").alias("owner"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), w("y").alias("width"), w("x").alias("depth"), F.min("x").alias("defence"), F.max("x").alias("attack"),
        F.count("*").alias("n"), F.collect_list(F.struct("x", "y")).alias("points"),
    ).where("n >= 3")
    phase = F.when(F.col("owner") == F.col("team_id"), "IN_POSSESSION").when(F.col("owner").isNotNull(), "OUT_OF_POSSESSION")
    rows = frames.withColumn("hull", convex_hull_area(F.col("points"))).drop("points").withColumn("phase", F.explode(F.filter(F.array(F.lit("ALL"), phase), lambda p: p.isNotNull())))
    mean = lambda c, n=2: jsround(F.avg(c), n)
    out = rows.groupBy("session_id", "team_id", "phase").agg(
        F.count("*").alias("frames"), mean("cx").alias("centroid_x"), mean("cy").alias("centroid_y"), mean("width").alias("team_width_m"), mean("depth").alias("team_depth_m"),
        jsround(F.greatest(F.lit(0.0), 100 - F.avg("hull") / (105 * 68) * 100), 1).alias("compactness"), mean("hull").alias("convex_hull_area_m2"), mean("defence").alias("defensive_line_m"), mean("attack").alias("attacking_line_m"),
    )
    return out.withColumn("line_distance_m", jsround(F.col("attacking_line_m") - F.col("defensive_line_m"), 2))


#: Frames of a player that are followed at once.
STRETCH = 20_000


def player_physical(positions: DataFrame, frame_rate_hz: float = 10.0, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Distance, high-speed distance, sprints and top speed of each session and player.

    Steps faster than a human are dropped, but the next step starts where they ended, and a sprint survives them: it
    starts at a fast step whose last valid predecessor wasn't fast.

    A player is followed over stretches of frames, each by itself. A stretch's first step, and whether its first fast step
    starts a sprint, are told by the stretches before it, so windows hold a stretch's frames, or a player's stretches.
    """
    dt = 1 / max(1.0, frame_rate_hz)
    by = [*keys, "player_id"]
    known = positions.where("player_id is not null").select(*by, "team_id", "frame_index", "x", "y", "speed_ms", F.floor(F.col("frame_index") / STRETCH).alias("_s"))

    def moved(x: Column, y: Column) -> list[Column]:
        """step, speed and fast of a place with the place before it."""
        dx, dy = F.col("x") - x, F.col("y") - y
        step = F.sqrt(dx * dx + dy * dy)
        speed = F.when(step <= IMPOSSIBLE * dt, F.coalesce("speed_ms", step / dt))
        return [F.when(speed.isNotNull(), step).alias("step"), speed.alias("speed"), (speed >= SPRINT).alias("fast")]

    within = Window.partitionBy(*by, "_s").orderBy("frame_index")
    steps = known.select("*", *moved(F.lag("x").over(within), F.lag("y").over(within)))
    before = F.last("fast", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1))
    marked = steps.withColumn("start", F.col("fast") & ~before)  # null before a stretch's first valid step
    high = F.col("speed") >= HIGH_SPEED
    at = F.when(F.col("fast").isNotNull(), F.col("frame_index"))
    stretches = marked.groupBy(*by, "_s").agg(
        F.min("frame_index").alias("frame_index"), F.min_by(F.struct("team_id", "x", "y", "speed_ms"), "frame_index").alias("_first"), F.max_by(F.struct("x", "y"), "frame_index").alias("_last"), F.count("*").alias("frames"),
        *(a(c).alias(f"_{n}_{c}") for c in "xy" for n, a in (("sum", F.sum), ("n", F.count))), F.sum("step").alias("_way"), F.sum(F.when(high, F.col("step"))).alias("_high"), F.max("speed").alias("_most"),
        F.count_if("start").alias("_starts"), F.min_by("fast", at).alias("_fast_first"), F.max_by("fast", at).alias("_fast_last"),
    )
    order = Window.partitionBy(*by).orderBy("_s")
    last = F.lag("_last").over(order)
    joined = stretches.select("*", *(F.col("_first")[c].alias(c) for c in ("team_id", "x", "y", "speed_ms")), last["x"].alias("_px"), last["y"].alias("_py"))
    joined = joined.select("*", *moved(F.col("_px"), F.col("_py")))  # of the first place of each stretch
    before = F.last(F.coalesce("_fast_last", "fast"), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    no = F.lit(False)
    starts = F.col("_starts") + (F.coalesce("fast", no) & ~F.coalesce(before, no)).cast("int") + (F.coalesce("_fast_first", no) & ~F.coalesce("fast", before, no)).cast("int")
    joined = joined.withColumn("_starts", starts)
    total = lambda c, more: F.sum(F.coalesce(c, F.lit(0.0)) + F.coalesce(more, F.lit(0.0)))
    mean = lambda c: jsround(F.sum(f"_sum_{c}") / F.sum(f"_n_{c}"), 2).alias(f"avg_{c}")
    return joined.groupBy(*by).agg(
        F.min_by("team_id", "frame_index").alias("team_id"), F.sum("frames").alias("frames"), mean("x"), mean("y"), jsround(total(F.col("_way"), F.col("step")), 2).alias("distance_m"),
        jsround(total(F.col("_high"), F.when(high, F.col("step"))), 2).alias("high_speed_distance_m"), F.sum("_starts").alias("sprint_count"), jsround(F.coalesce(F.max(F.greatest("_most", "speed")), F.lit(0.0)), 2).alias("max_speed_ms"),
    )
