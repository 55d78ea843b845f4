"""Frozen report payloads: a row for each subject with every section as an array, and its content-addressed id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_text(value: Column, kind: T.DataType) -> Column:
    """A value as text that any engine can build alike: fields of a struct in order of their names, numbers in millionths (half
    up), texts in double quotes with backslashes before quotes and backslashes, times as they are cast, and null for what is
    missing. Only the order of an array is its own."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        body = F.concat_ws(",", *(F.concat(F.lit(f'"{f.name}":'), canonical_text(value[f.name], f.dataType)) for f in fields))
        text = F.concat(F.lit("{"), body, F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda e: canonical_text(e, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(value))
        text = canonical_text(entries, T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
    elif isinstance(kind, T.IntegralType):
        text = F.concat(value.cast("string"), F.lit("000000"))
        text = F.when(value == 0, "0").otherwise(text)
    elif isinstance(kind, T.NumericType):
        text = F.floor(value.cast("double") * 1e6 + 0.5).cast("bigint").cast("string")
    elif isinstance(kind, T.BooleanType):
        text = value.cast("string")
    else:
        own = value.cast("string")
        text = F.concat(F.lit('"'), F.replace(F.replace(own, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(value.isNull(), "null").otherwise(text)


def snapshot_id(payload: Column, kind: T.DataType) -> Column:
    """The first 32 hexadecimal digits of the SHA-256 of a payload's canonical text. kind: the payload's type."""
    return F.substring(F.sha2(canonical_text(payload, kind), 256), 1, 32)


def section(rows: DataFrame, keys: list[str], name: str, fields: list[str], order: Column | None = None, most: int | None = None) -> DataFrame:
    """keys and an ordered array of the fields, cut to the first `most` by `order` before it is collected whole."""
    if most is not None:
        from pyspark.sql import Window

        n = F.row_number().over(Window.partitionBy(*keys).orderBy(order, *fields))
        rows = rows.withColumn("_o", n).where(F.col("_o") <= most)
    else:
        rows = rows.withColumn("_o", order if order is not None else F.lit(0))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", *fields))), lambda e: e.dropFields("_o")).alias(name))


def assembled(base: DataFrame, keys: list[str], sections: list[DataFrame]) -> DataFrame:
    """base with all sections and snapshot_id."""
    for s in sections:
        base = base.join(s, keys, "left")
    return base.withColumn("snapshot_id", snapshot_id(F.struct(*base.columns), base.schema))


def player_report_payloads(identity: DataFrame, percentiles: DataFrame, dna: DataFrame, roles: DataFrame, similar: DataFrame, fit: DataFrame, shots: DataFrame, heatmap: DataFrame | None = None, notes: DataFrame | None = None, ratings: DataFrame | None = None) -> DataFrame:
    """A payload for each player's season: metrics, percentiles, profile, six roles, eight similar players and fits, shots, and where given a heat grid, notes and ratings."""
    keys = ["season_id", "player_id"]
    parts = [
        section(percentiles, keys, "percentiles", ["metric_key", "value", "percentile", "population_size"], F.col("metric_key")), section(dna, keys, "profile", ["category", "score", "coverage"], F.col("category")),
        section(roles, keys, "roles", ["role_key", "score", "coverage", "is_primary"], F.col("rank"), 6), section(similar, keys, "similar", ["comparison_player_id", "similarity"], F.col("rank"), 8),
        section(fit, keys, "fits", ["team_id", "fit_score"], -F.col("fit_score"), 8), section(shots, keys, "shots", ["match_id", "minute", "x", "y", "xg", "is_goal"], F.struct("match_id", "minute", "event_id")),
    ]
    base = identity
    if heatmap is not None:
        parts.append(section(heatmap.where("value > 0"), keys, "heatmap", ["col", "row", "value"], F.struct("col", "row")))
    out = base
    for extra, name in ((notes, "notes"), (ratings, "ratings")):
        if extra is not None:
            own = section(extra, ["player_id"], name, [c for c in extra.columns if c != "player_id"])
            out = out.join(own, "player_id", "left")
    return assembled(out, keys, parts)


def club_report_payloads(identity: DataFrame, percentiles: DataFrame, style: DataFrame, log: DataFrame, squad: DataFrame) -> DataFrame:
    """A payload for each club's season: metrics, percentiles, style, match log and squad by minutes."""
    keys = ["season_id", "team_id"]
    return assembled(identity, keys, [
        section(percentiles, keys, "percentiles", ["metric_key", "value", "percentile"], F.col("metric_key")), section(style, keys, "style", ["dimension", "score", "measured"], F.col("dimension_order")),
        section(log, keys, "log", ["match_id", "opponent", "is_home", "goals_for", "goals_against", "xg", "possession"], F.struct("kickoff_at", "match_id")), section(squad, keys, "squad", ["player_id", "position_group", "minutes"], -F.col("minutes")),
    ])


def match_report_payloads(summary: DataFrame, player_match: DataFrame, shots: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A payload for each match: summary, player rows, shots and both passing networks."""
    keys = ["match_id"]
    return assembled(summary, keys, [
        section(player_match, keys, "players", ["team_id", "player_id", "minutes", "passes", "shots", "xg", "tackles"], F.struct("team_id", "player_id")), section(shots, keys, "shots", ["team_id", "player_id", "minute", "x", "y", "xg", "is_goal"], F.struct("minute", "event_id")),
        section(nodes, keys, "network_nodes", ["team_id", "player_id", "x", "y", "passes", "received"], F.struct("team_id", "player_id")), section(edges, keys, "network_edges", ["team_id", "from_id", "to_id", "passes"], F.struct("team_id", "from_id", "to_id")),
    ])
