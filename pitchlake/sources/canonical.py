"""Provider events to canonical ones: places in metres, internal ids, and details whose derived fields follow from the places.

Every event gets the details of its type, whatever its provider tells: fields that a provider lacks have the defaults
below. All is one projection, after a join for each kind of id that a mapping resolves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scalars as S
from ..operators.views import resolve_ids

#: What types and texts of details may be; others become the last one (duels: GROUND).
HEIGHTS = ("GROUND", "LOW", "HIGH", "UNKNOWN")
BODY_PARTS = ("RIGHT_FOOT", "LEFT_FOOT", "HEAD", "OTHER", "UNKNOWN")
KINDS = (
    "PASS", "SHOT", "CARRY", "DRIBBLE", "DUEL", "TACKLE", "INTERCEPTION", "PRESSURE", "RECOVERY", "CLEARANCE", "BLOCK", "FOUL", "CARD", "GOAL", "SET_PIECE", "TOUCH",
    "SUBSTITUTION", "OFFSIDE", "GOALKEEPER", "MISCONTROL", "DISPOSSESSED", "HALF_START", "HALF_END", "OTHER",
)
DUELS = ("AERIAL", "GROUND", "LOOSE_BALL", "FIFTY_FIFTY", "TACKLE")
IDS = {"team_external_id": "TEAM", "player_external_id": "PLAYER", "possession_team_external_id": "TEAM", "recipient_external_id": "PLAYER"}
_BASE = {
    "provider_event_id": "string", "match_external_id": "string", "sub_type": "string", "sequence": "bigint", "possession_id": "bigint",
    "play_pattern": "string", "outcome": "string", "duration_sec": "double",
}


def canonical_events(raw: DataFrame, system: str, mapping: DataFrame | None = None) -> DataFrame:
    """Events as a reader gives them, in canonical form. system: the source space of their places.

    mapping: entity_type (TEAM, PLAYER, MATCH), external_id, internal_id; ids that it doesn't know are null. Without a
    mapping the ids are the external ones. A place needs both coordinates. All teams attack to the right, as their
    providers tell it; no side is mirrored.
    """
    known = {f.name: f.dataType for f in raw.schema.fields}

    def top(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in known else F.lit(None).cast(kind)

    def detail(of: str, name: str, default: Column) -> Column:
        there = isinstance(known.get(of), StructType) and name in known[of].fieldNames()
        return F.coalesce(F.col(f"{of}.{name}"), default) if there else default

    true = lambda of, name, default=False: detail(of, name, F.lit(default))
    none = lambda kind: F.lit(None).cast(kind)
    one_of = lambda c, allowed, default: F.when(c.isin(*allowed), c).otherwise(default)

    places = {}
    for ends in (("x", "y"), ("end_x", "end_y")):
        x, y = (top(c, "double") for c in ends)
        both = x.isNotNull() & y.isNotNull()
        places |= {c: F.when(both, v) for c, v in zip(ends, S.to_canonical(x, y, system))}
    own = raw.withColumns({f"_{c}": v for c, v in places.items()} | {"recipient_external_id": detail("pass", "recipient_external_id", none("string"))})
    ids = {c: kind for c, kind in IDS.items() if c in own.columns}
    if mapping is not None:
        own = resolve_ids(own, mapping, ids)
        own = resolve_ids(own, mapping, {"match_external_id": "MATCH"}) if "match_external_id" in own.columns else own
    else:
        own = own.withColumns({c.replace("_external_id", "_id"): F.col(c) for c in [*ids, *(["match_external_id"] if "match_external_id" in own.columns else [])]})
    own_id = lambda c: F.col(c) if c in own.columns else none("string")

    x, y, end_x, end_y = (F.col(f"_{c}") for c in ("x", "y", "end_x", "end_y"))
    start, end = x.isNotNull(), end_x.isNotNull()
    way = start & end
    along = lambda c, default: F.when(way, c).otherwise(default)
    there = {
        "is_progressive": along(S.is_progressive(x, y, end_x, end_y), False), "into_final_third": F.when(end, S.in_final_third(end_x)).otherwise(False),
        "into_box": F.when(end, S.in_box(end_x, end_y)).otherwise(False),
    }
    length = along(S.distance(x, y, end_x, end_y), 0.0)
    header = true("shot", "is_header") | (one_of(detail("shot", "body_part", none("string")), BODY_PARTS, "UNKNOWN") == "HEAD")
    flags = lambda of, *names: {n: true(of, n) for n in names}
    body = lambda of: one_of(detail(of, "body_part", none("string")), BODY_PARTS, "UNKNOWN")
    fields = {
        "PASS": {
            "recipient_id": own_id("recipient_id"), "length_m": detail("pass", "length_m", length), "angle_rad": detail("pass", "angle_rad", along(S.angle(x, y, end_x, end_y), 0.0)),
            "height": one_of(detail("pass", "height", none("string")), HEIGHTS, "UNKNOWN"), "body_part": body("pass"), "technique": detail("pass", "technique", none("string")),
            "completed": true("pass", "completed", True), **flags("pass", "is_cross", "is_switch", "is_through_ball", "is_cutback"), **there,
            **flags("pass", "is_key_pass", "is_assist"), "xa": detail("pass", "xa", none("double")),
        },
        "SHOT": {
            "xg": S.resolve_xg(detail("shot", "xg", none("double")), x, y, header, true("shot", "is_penalty")), "provider_xg": detail("shot", "provider_xg", none("double")),
            "body_part": body("shot"), "technique": detail("shot", "technique", none("string")), "is_header": header,
            **flags("shot", "first_time", "is_penalty", "is_set_piece", "on_target", "blocked", "is_goal"),
            **{c: detail("shot", c, none("double")) for c in ("end_x", "end_y", "end_z")},
            "distance_m": F.when(start, S.distance_to_goal(x, y)), "angle_deg": F.when(start, S.goal_angle_deg(x, y)),
        },
        "CARRY": {"distance_m": length, "progressive_distance_m": along(S.progressive_distance(x, y, end_x, end_y), 0.0), **there},
        "DRIBBLE": flags("dribble", "completed", "nutmeg", "overrun"),
        "DUEL": {"duel_type": one_of(detail("duel", "duel_type", none("string")), DUELS, "GROUND"), "won": true("duel", "won")},
        "TACKLE": flags("tackle", "won", "dispossessed"),
        "PRESSURE": {"duration_sec": detail("pressure", "duration_sec", F.lit(0.0)), "counterpress": true("pressure", "counterpress")},
        "RECOVERY": flags("recovery", "failed", "offensive"),
        "CLEARANCE": {"body_part": body("clearance")},
        "FOUL": {"committed": true("foul", "committed", True), **flags("foul", "advantage", "penalty")},
    }
    kind = one_of(top("type", "string"), KINDS, "OTHER")
    details = [F.when(kind == k, F.struct(*(v.alias(n) for n, v in of.items()))).alias(k.lower()) for k, of in fields.items()]
    minute = F.coalesce(top("minute", "int"), F.lit(0))
    clock = {
        "minute": minute, "second": F.coalesce(top("second", "int"), F.lit(0)), "period": F.coalesce(top("period", "int"), F.lit(1)),
        "timestamp_ms": F.coalesce(top("timestamp_ms", "bigint"), minute.cast("bigint") * 60_000),
    }
    return own.select(
        *(top(c, t).alias(c) for c, t in _BASE.items()), own_id("match_id").alias("match_id"), *(own_id(c.replace("_external_id", "_id")).alias(c.replace("_external_id", "_id")) for c in IDS if c != "recipient_external_id"),
        kind.alias("type"), *(v.alias(c) for c, v in clock.items()), F.coalesce(top("under_pressure", "boolean"), F.lit(False)).alias("under_pressure"),
        x.alias("x"), y.alias("y"), end_x.alias("end_x"), end_y.alias("end_y"), *details,
    )
