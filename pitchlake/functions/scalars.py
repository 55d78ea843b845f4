"""Column functions on pitch coordinates, event vocabularies, clocks, ages and rates. All run inside code generation."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH, WIDTH = 105.0, 68.0
#: Length, width and whether y grows downwards, by source space.
SPACES = {
    "CANONICAL_105_68": (105.0, 68.0, False), "NORMALIZED_0_1": (1.0, 1.0, False), "RANGE_0_100": (100.0, 100.0, False), "STATSBOMB_120_80": (120.0, 80.0, True),
    "OPTA_100_100": (100.0, 100.0, False), "METRICA_0_1": (1.0, 1.0, True), "PROVIDER_SPECIFIC": None,
}
#: Provider event types and what they become; others become OTHER.
EVENT_TYPES = {
    "120x80": {
        "Pass": "PASS", "Shot": "SHOT", "Carry": "CARRY", "Dribble": "DRIBBLE", "Duel": "DUEL", "Pressure": "PRESSURE", "Ball Recovery": "RECOVERY", "Interception": "INTERCEPTION",
        "Clearance": "CLEARANCE", "Block": "BLOCK", "Foul Committed": "FOUL", "Foul Won": "FOUL", "Substitution": "SUBSTITUTION", "Half Start": "HALF_START", "Half End": "HALF_END",
        "Goal Keeper": "GOALKEEPER", "Miscontrol": "MISCONTROL", "Dispossessed": "DISPOSSESSED", "Own Goal Against": "GOAL", "Own Goal For": "GOAL", "Offside": "OFFSIDE",
    },
    "normalized": {
        "PASS": "PASS", "SHOT": "SHOT", "CARRY": "CARRY", "DRIBBLE": "DRIBBLE", "CHALLENGE": "DUEL", "RECOVERY": "RECOVERY", "BALL_LOST": "DISPOSSESSED", "BALL_OUT": "OTHER",
        "SET_PIECE": "SET_PIECE", "FAULT_RECEIVED": "FOUL", "CARD": "CARD",
    },
}
#: Words and codes of position groups, in the order in which they are tried.
POSITIONS = (
    ("GK", r"\b(gk|goal\s*keeper|keeper|portero|doelman)\b", "^GK"),
    ("DF", r"\b(cb|lcb|rcb|lb|rb|lwb|rwb|wb|df|def|defender|back)\b", "^(CB|LB|RB|LWB|RWB|DF)"),
    ("MF", r"\b(cdm|dm|cm|lcm|rcm|cam|am|lm|rm|mf|mid|midfield)\b", "^(CDM|CM|CAM|DM|AM|LM|RM|MF)"),
    ("FW", r"\b(lw|rw|lf|rf|cf|st|ss|fw|forward|striker|winger|attacker)\b", "^(LW|RW|CF|ST|FW)"),
)
#: Minutes, matches and coverage that each confidence needs.
CONFIDENCE = (("HIGH", 1800, 20, 0.8), ("MEDIUM", 900, 10, 0.5), ("LOW", 180, 2, 0.0))
#: Zone schemes: columns, rows, and names of the first one's thirds and lanes.
SCHEMES = {"THIRDS_LANES": (3, 5), "GRID_5X4": (5, 4)}
THIRDS, LANES = ("Defensive", "Middle", "Attacking"), ("Left", "Left half-space", "Centre", "Right half-space", "Right")


def as_column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def jsround(c: Column, n: int = 0) -> Column:
    """Rounds half towards plus infinity on the binary product."""
    factor = float(10**n)
    return F.floor(c * factor + 0.5) / F.lit(factor)


def to_canonical(x: Column, y: Column, system: str, flip: bool = False, length: float | None = None, width: float | None = None, invert_y: bool | None = None) -> tuple[Column, Column]:
    """A point of a source space in canonical metres, clamped to the pitch, 2 decimals."""
    space = SPACES[system] or (length or LENGTH, width or WIDTH, False)
    if space[0] <= 0 or space[1] <= 0:
        raise ValueError(f"pitch dimensions of {system} must be positive")
    cx, cy = x / space[0] * LENGTH, y / space[1] * WIDTH
    cy = WIDTH - cy if (space[2] if invert_y is None else invert_y) else cy
    cx, cy = (LENGTH - cx, WIDTH - cy) if flip else (cx, cy)
    clamp = lambda c, most: F.when(c.isNotNull(), jsround(F.least(F.greatest(c, F.lit(0.0)), F.lit(most)), 2))
    return clamp(cx, LENGTH), clamp(cy, WIDTH)


def from_canonical(x: Column, y: Column, system: str) -> tuple[Column, Column]:
    """A canonical point in a source space, 4 decimals."""
    if SPACES[system] is None:
        raise ValueError(f"{system} has no dimensions of its own")
    length, width, inverted = SPACES[system]
    sy = y / WIDTH * width
    return jsround(x / LENGTH * length, 4), jsround(width - sy if inverted else sy, 4)


def distance(x1, y1, x2, y2) -> Column:
    dx, dy = as_column(x2) - as_column(x1), as_column(y2) - as_column(y1)
    return jsround(F.sqrt(dx * dx + dy * dy), 2)


def angle(x1, y1, x2, y2) -> Column:
    return jsround(F.atan2(as_column(y2) - as_column(y1), as_column(x2) - as_column(x1)), 4)


def distance_to_goal(x, y) -> Column:
    return distance(x, y, LENGTH, WIDTH / 2)


def goal_angle_deg(x, y) -> Column:
    """The angle in which the goal is seen, in degrees."""
    a, b = distance(x, y, LENGTH, WIDTH / 2 - 3.66), distance(x, y, LENGTH, WIDTH / 2 + 3.66)
    cosine = (a * a + b * b - 7.32 * 7.32) / (2 * a * b)
    return F.when((a == 0) | (b == 0), 0.0).otherwise(jsround(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))) * 180 / F.pi(), 2))


def in_final_third(x: Column) -> Column:
    return x >= 70.0


def in_box(x: Column, y: Column) -> Column:
    return (x >= 88.5) & y.between(13.84, WIDTH - 13.84)


def in_own_box(x: Column, y: Column) -> Column:
    return (x <= 16.5) & y.between(13.84, WIDTH - 13.84)


def is_progressive(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    before, after = distance_to_goal(x1, y1), distance_to_goal(x2, y2)
    gain = before - after
    return (gain > 0) & ((gain >= before * 0.25) | ((x2 > LENGTH / 2) & (gain >= 10)))


def progressive_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return jsround(F.greatest(F.lit(0.0), distance_to_goal(x1, y1) - distance_to_goal(x2, y2)), 2)


def estimate_xg(x: Column, y: Column, header=False, penalty=False) -> Column:
    """Expected goals from geometry alone."""
    base = F.exp(-0.11 * distance_to_goal(x, y))
    value = jsround(F.least(F.lit(0.95), F.greatest(F.lit(0.01), F.when(as_column(header), base * 0.55).otherwise(base))), 3)
    return F.when(as_column(penalty), 0.76).otherwise(value)


def resolve_xg(provider_xg: Column, x: Column, y: Column, header=False, penalty=False) -> Column:
    """The provider's value if it is positive, else the estimate, 0 without a place."""
    return F.when(provider_xg > 0, provider_xg).when(x.isNull() | y.isNull(), 0.0).otherwise(estimate_xg(x, y, header, penalty))


def map_event_type(c: Column, vocabulary: str) -> Column:
    return F.coalesce(F.create_map(*map(F.lit, chain(*EVENT_TYPES[vocabulary].items())))[c], F.lit("OTHER"))


def coerce_enum(c: Column, allowed: list[str], default: str) -> Column:
    return F.when(F.upper(c).isin(*allowed), F.upper(c)).otherwise(default)


def position_group(c: Column) -> Column:
    """GK, DF, MF or FW; MF if nothing tells."""
    text, out = F.trim(c), F.lit("MF")
    for name, _, prefix in reversed(POSITIONS):
        out = F.when(F.upper(text).rlike(prefix), name).otherwise(out)
    for name, pattern, _ in reversed(POSITIONS):
        out = F.when(F.lower(text).rlike(pattern), name).otherwise(out)
    return F.coalesce(F.when(c.isNull(), "MF"), out)


def clock_ms(c: Column, fraction: str = "millis") -> Column:
    """Milliseconds of H:M:S.f; the fraction is padded to three digits ("millis") or rounded with the seconds ("seconds")."""
    parts = F.split(c, ":")
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("double"), F.lit(0.0))
    if fraction == "seconds":
        return F.coalesce(F.floor((part(0) * 3600 + part(1) * 60 + part(2)) * 1000 + 0.5).cast("bigint"), F.lit(0))
    seconds = F.split(F.get(parts, F.lit(2)), "\\.")
    whole = lambda i: F.coalesce(F.get(seconds, F.lit(i)), F.lit("0"))
    padded = F.when(F.length(whole(1)) < 3, F.rpad(whole(1), 3, "0")).otherwise(whole(1))
    return (part(0) * 3_600_000 + part(1) * 60_000 + F.coalesce(whole(0).try_cast("double"), F.lit(0.0)) * 1000 + F.coalesce(padded.try_cast("double"), F.lit(0.0))).cast("bigint")


def parse_date(c: Column) -> Column:
    """An ISO date or time, or null."""
    return F.to_date(F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(F.substring(c, 1, 10))))


def minutes_from_spells(spells: Column, unit: str = "hours") -> Column:
    """Minutes from the first spell's start to the last one's end (90 if open). unit: what the first part of the clock counts."""
    scale = 60.0 if unit == "hours" else 1.0
    last = 1.0 if unit == "hours" else 1 / 60

    def minutes(c: Column) -> Column:
        p = F.split(c, ":")
        return F.coalesce(F.get(p, F.lit(0)).try_cast("double"), F.lit(0.0)) * scale + F.coalesce(F.get(p, F.lit(1)).try_cast("double"), F.lit(0.0)) * last

    end = F.element_at(spells, -1)["to"]
    found = F.greatest(F.lit(0.0), jsround(F.when(end.isNull(), 90.0).otherwise(minutes(end)) - minutes(F.element_at(spells, 1)["from"])))
    return F.when(F.size(spells) > 0, found.cast("int"))


def _bucket(c: Column, size: float, count: int) -> Column:
    return F.least(F.lit(count - 1), F.greatest(F.lit(0), F.floor(c / size * count))).cast("int")


def zone_of(x: Column, y: Column, scheme: str = "THIRDS_LANES") -> Column:
    """struct(key, row, col, label) of a point's zone; null without a place."""
    cols, rows = SCHEMES[scheme]
    col, row = _bucket(x, LENGTH, cols), _bucket(y, WIDTH, rows)
    if scheme == "THIRDS_LANES":
        third, lane = (F.get(F.array(*map(F.lit, names)), i) for names, i in ((THIRDS, col), (LANES, row)))
        key, label = F.concat(third, F.lit("/"), lane), F.concat(third, F.lit(" third, "), lane)
    else:
        key = F.concat(F.lit("C"), (col + 1).cast("string"), F.lit("R"), (row + 1).cast("string"))
        label = F.concat(F.lit("Column "), (col + 1).cast("string"), F.lit(", row "), (row + 1).cast("string"))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(key.alias("key"), row.alias("row"), col.alias("col"), label.alias("label")))


def all_zones(spark: SparkSession, scheme: str = "THIRDS_LANES") -> DataFrame:
    """Every zone of a scheme: fifteen or twenty rows."""
    cols, rows = SCHEMES[scheme]
    cells = spark.range(cols * rows).select((F.col("id") / rows).cast("int").alias("c"), (F.col("id") % rows).cast("int").alias("r"))
    centre = zone_of(F.lit(LENGTH / cols) * (F.col("c") + 0.5), F.lit(WIDTH / rows) * (F.col("r") + 0.5), scheme)
    return cells.select(F.lit(scheme).alias("scheme"), centre.alias("z")).select("scheme", "z.*")


def assess_quality(minutes: Column, matches: Column, coverage=1.0) -> Column:
    """struct(confidence, minutes, matches, coverage, summary)."""
    cover, band = as_column(coverage), F.lit("INSUFFICIENT")
    for name, least_minutes, least_matches, least_cover in reversed(CONFIDENCE):
        band = F.when((minutes >= least_minutes) & (matches >= least_matches) & (cover >= least_cover), name).otherwise(band)
    label = F.when(band == "INSUFFICIENT", "Insufficient data").otherwise(F.concat(F.lit("Confidence: "), F.initcap(F.lower(band))))
    summary = F.concat(label, F.lit(" - "), minutes.cast("string"), F.lit(" minutes across "), matches.cast("string"), F.when(matches == 1, " match").otherwise(" matches"))
    return F.struct(band.alias("confidence"), minutes.alias("minutes"), matches.alias("matches"), jsround(cover, 2).alias("coverage"), summary.alias("summary"))


def age_years(birth: Column, at: Column) -> Column:
    """Full calendar years."""
    return F.year(at) - F.year(birth) - (F.date_format(at, "MMdd") < F.date_format(birth, "MMdd")).cast("int")


def age_approx(birth: Column, at: Column) -> Column:
    """Days by 365.25, rounded down."""
    return F.floor(F.datediff(at, birth) / 365.25).cast("int")


def per90(total: Column, minutes: Column) -> Column:
    return F.when(minutes > 0, jsround(total / minutes * 90, 3)).otherwise(0.0)


def per_possession(total: Column, possessions: Column) -> Column:
    return F.when(possessions > 0, jsround(total / possessions * 100, 3)).otherwise(0.0)


def to_snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def to_camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x[:1].upper() + x[1:] for x in rest)


def humanise(key: Column) -> Column:
    """A label of a metric's key: words, per 90 spelt out."""
    words = F.regexp_replace(F.regexp_replace(key, "_?[pP]90$", " per 90"), "([a-z])([A-Z])", "$1 $2")
    return F.initcap(F.lower(F.translate(words, "_", " ")))
