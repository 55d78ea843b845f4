"""Model weights as rows. Each function returns a small DataFrame that can be replaced by one of the user's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The rates of a player's season, in the order of the season table.
METRICS = (
    "passes_p90 pass_accuracy progressive_passes_p90 passes_final_third_p90 passes_into_box_p90 key_passes_p90 crosses_p90 long_passes_p90 progressive_carries_p90 carries_final_third_p90 "
    "carries_into_box_p90 dribbles_p90 dribble_success_rate progressive_actions_p90 xa_p90 chances_created_p90 touches_p90 touches_final_third_p90 touches_box_p90 shots_p90 shots_on_target_p90 "
    "goals_p90 xg_p90 npxg_p90 xg_per_shot assists_p90 tackles_p90 tackle_success_rate interceptions_p90 pressures_p90 counterpressures_p90 recoveries_p90 blocks_p90 clearances_p90 "
    "defensive_duels_p90 defensive_duel_win_rate aerial_duels_p90 aerial_duel_win_rate"
).split()
PHYSICAL = ["distance_p90", "high_speed_distance_p90", "sprint_count_p90", "max_speed_ms"]

#: Profile categories and the weights of their metrics.
PROFILE = {
    "Passing": {"passes_p90": 0.2, "pass_accuracy": 0.35, "long_passes_p90": 0.15, "passes_final_third_p90": 0.3},
    "Progression": {"progressive_passes_p90": 0.4, "progressive_carries_p90": 0.3, "progressive_actions_p90": 0.2, "passes_final_third_p90": 0.1},
    "Ball Carrying": {"progressive_carries_p90": 0.4, "dribbles_p90": 0.25, "dribble_success_rate": 0.25, "carries_final_third_p90": 0.1},
    "Chance Creation": {"xa_p90": 0.35, "key_passes_p90": 0.3, "chances_created_p90": 0.2, "passes_into_box_p90": 0.15},
    "Finishing": {"xg_p90": 0.3, "goals_p90": 0.3, "shots_p90": 0.2, "xg_per_shot": 0.2},
    "Possession": {"touches_p90": 0.35, "pass_accuracy": 0.35, "passes_p90": 0.3},
    "Defending": {"tackles_p90": 0.25, "interceptions_p90": 0.25, "blocks_p90": 0.15, "clearances_p90": 0.15, "recoveries_p90": 0.2},
    "Pressing": {"pressures_p90": 0.5, "counterpressures_p90": 0.3, "recoveries_p90": 0.2},
    "Duels": {"defensive_duels_p90": 0.2, "defensive_duel_win_rate": 0.3, "aerial_duels_p90": 0.2, "aerial_duel_win_rate": 0.3},
    "Positioning": {"touches_final_third_p90": 0.4, "touches_box_p90": 0.4, "carries_into_box_p90": 0.2},
    "Physical": {"distance_p90": 0.3, "high_speed_distance_p90": 0.3, "sprint_count_p90": 0.2, "max_speed_ms": 0.2},
}
#: Categories that matter to each position group.
RELEVANCE = {
    "GK": ["Passing", "Possession", "Positioning"],
    "DF": ["Passing", "Progression", "Defending", "Duels", "Pressing", "Possession", "Physical"],
    "MF": ["Passing", "Progression", "Ball Carrying", "Chance Creation", "Possession", "Defending", "Pressing", "Duels", "Physical"],
    "FW": ["Finishing", "Chance Creation", "Ball Carrying", "Positioning", "Progression", "Pressing", "Duels", "Physical"],
}
#: Roles: key, name, position group, weights of their metrics. All ask for 450 minutes.
ROLES = (
    ("ball-winning-6", "Ball-Winning 6", "MF", {"tackles_p90": 0.2, "interceptions_p90": 0.2, "recoveries_p90": 0.15, "defensive_duel_win_rate": 0.2, "pressures_p90": 0.15, "pass_accuracy": 0.1}),
    ("deep-lying-playmaker", "Deep-Lying Playmaker", "MF", {"passes_p90": 0.25, "pass_accuracy": 0.2, "progressive_passes_p90": 0.25, "long_passes_p90": 0.15, "touches_p90": 0.15}),
    ("progressive-6", "Progressive 6", "MF", {"progressive_passes_p90": 0.3, "progressive_carries_p90": 0.2, "passes_final_third_p90": 0.2, "pass_accuracy": 0.15, "interceptions_p90": 0.15}),
    ("progressive-8", "Progressive 8", "MF", {"progressive_actions_p90": 0.3, "progressive_carries_p90": 0.25, "passes_final_third_p90": 0.2, "touches_final_third_p90": 0.15, "dribbles_p90": 0.1}),
    ("box-to-box-8", "Box-to-Box 8", "MF", {"progressive_actions_p90": 0.2, "touches_box_p90": 0.15, "tackles_p90": 0.15, "recoveries_p90": 0.15, "distance_p90": 0.2, "shots_p90": 0.15}),
    ("advanced-playmaker", "Advanced Playmaker", "MF", {"xa_p90": 0.3, "key_passes_p90": 0.25, "passes_into_box_p90": 0.2, "touches_final_third_p90": 0.15, "pass_accuracy": 0.1}),
    ("creative-10", "Creative 10", "MF", {"chances_created_p90": 0.3, "xa_p90": 0.3, "passes_into_box_p90": 0.2, "dribbles_p90": 0.1, "touches_box_p90": 0.1}),
    ("inverted-winger", "Inverted Winger", "FW", {"shots_p90": 0.25, "dribbles_p90": 0.2, "touches_box_p90": 0.2, "xg_p90": 0.2, "carries_into_box_p90": 0.15}),
    ("touchline-winger", "Touchline Winger", "FW", {"crosses_p90": 0.3, "dribbles_p90": 0.25, "dribble_success_rate": 0.2, "passes_into_box_p90": 0.15, "progressive_carries_p90": 0.1}),
    ("inside-forward", "Inside Forward", "FW", {"xg_p90": 0.3, "goals_p90": 0.25, "touches_box_p90": 0.2, "dribbles_p90": 0.15, "xa_p90": 0.1}),
    ("pressing-forward", "Pressing Forward", "FW", {"pressures_p90": 0.35, "counterpressures_p90": 0.25, "recoveries_p90": 0.2, "distance_p90": 0.1, "tackles_p90": 0.1}),
    ("target-striker", "Target Striker", "FW", {"aerial_duels_p90": 0.3, "aerial_duel_win_rate": 0.3, "touches_box_p90": 0.2, "goals_p90": 0.2}),
    ("deep-lying-forward", "Deep-Lying Forward", "FW", {"xa_p90": 0.25, "key_passes_p90": 0.25, "passes_p90": 0.2, "pass_accuracy": 0.15, "touches_p90": 0.15}),
    ("complete-forward", "Complete Forward", "FW", {"xg_p90": 0.25, "xa_p90": 0.2, "aerial_duel_win_rate": 0.15, "pressures_p90": 0.15, "touches_box_p90": 0.15, "dribbles_p90": 0.1}),
    ("ball-playing-centre-back", "Ball-Playing Centre Back", "DF", {"progressive_passes_p90": 0.3, "pass_accuracy": 0.25, "passes_p90": 0.15, "long_passes_p90": 0.15, "progressive_carries_p90": 0.15}),
    ("stopper-centre-back", "Stopper Centre Back", "DF", {"aerial_duel_win_rate": 0.25, "aerial_duels_p90": 0.15, "tackles_p90": 0.2, "interceptions_p90": 0.2, "clearances_p90": 0.1, "blocks_p90": 0.1}),
    ("defensive-full-back", "Defensive Full Back", "DF", {"tackles_p90": 0.25, "interceptions_p90": 0.25, "defensive_duel_win_rate": 0.25, "clearances_p90": 0.15, "pass_accuracy": 0.1}),
    ("overlapping-full-back", "Overlapping Full Back", "DF", {"crosses_p90": 0.3, "progressive_carries_p90": 0.2, "touches_final_third_p90": 0.2, "xa_p90": 0.15, "distance_p90": 0.15}),
    ("inverted-full-back", "Inverted Full Back", "DF", {"passes_p90": 0.25, "pass_accuracy": 0.25, "progressive_passes_p90": 0.25, "interceptions_p90": 0.15, "touches_p90": 0.1}),
)
ROLE_MINUTES = 450
#: Dimensions of a team's style, the weights of their metrics, and metrics whose percentile counts inverted.
STYLE = {
    "possession": {"possession": 0.6, "passes_p90": 0.4},
    "build_up": {"pass_accuracy": 0.5, "passes_p90": 0.3, "progression_p90": 0.2},
    "directness": {"directness": 1.0},
    "progression": {"progression_p90": 0.6, "final_third_entries_p90": 0.4},
    "width": {"crosses_p90": 0.6, "field_tilt": 0.4},
    "central_attack": {"box_entries_p90": 0.6, "xg_p90": 0.4},
    "crossing": {"crosses_p90": 1.0},
    "chance_creation": {"xg_p90": 0.5, "shots_p90": 0.3, "box_entries_p90": 0.2},
    "high_press": {"ppda": 0.6, "pressures_p90": 0.4},
    "counterpress": {"pressures_p90": 0.5, "recoveries_p90": 0.5},
    "low_block": {"ppda": 0.5, "possession": 0.5},
    "transition": {"directness": 0.5, "progression_p90": 0.5},
    "defensive_aggression": {"pressures_p90": 0.5, "recoveries_p90": 0.5},
    "defensive_compactness": {"xg_against_p90": 1.0},
}
INVERTED = {("high_press", "ppda"), ("low_block", "possession"), ("defensive_compactness", "xg_against_p90")}
#: What each style dimension asks of a player's profile, in the order of the model.
DEMAND = (
    ("possession", "Possession", {"Possession": 0.6, "Passing": 0.4}),
    ("build_up", "Build-up", {"Passing": 0.6, "Possession": 0.4}),
    ("progression", "Progression", {"Progression": 0.7, "Ball Carrying": 0.3}),
    ("directness", "Directness", {"Positioning": 0.4, "Physical": 0.3, "Duels": 0.3}),
    ("chance_creation", "Chance creation", {"Chance Creation": 0.7, "Finishing": 0.3}),
    ("crossing", "Crossing", {"Chance Creation": 0.5, "Ball Carrying": 0.5}),
    ("width", "Width", {"Ball Carrying": 0.6, "Physical": 0.4}),
    ("central_attack", "Central attack", {"Positioning": 0.5, "Finishing": 0.5}),
    ("high_press", "High press", {"Pressing": 0.7, "Physical": 0.3}),
    ("counterpress", "Counterpress", {"Pressing": 0.6, "Defending": 0.4}),
    ("defensive_aggression", "Defensive aggression", {"Defending": 0.5, "Duels": 0.5}),
    ("defensive_compactness", "Defensive compactness", {"Defending": 0.6, "Positioning": 0.4}),
    ("transition", "Transition", {"Ball Carrying": 0.4, "Progression": 0.3, "Physical": 0.3}),
    ("low_block", "Low block", {"Defending": 0.6, "Duels": 0.4}),
)
#: The season metrics of clubs that are compared.
CLUB_METRICS = "possession xg_p90 xg_against_p90 shots_p90 progression_p90 final_third_entries_p90 box_entries_p90 directness field_tilt passes_p90 pass_accuracy pressures_p90 recoveries_p90 ppda".split()
#: Event types of each heatmap, and whether it shows where events end.
HEATMAPS = {
    "TOUCH": (["PASS", "CARRY", "DRIBBLE", "SHOT", "TOUCH", "CLEARANCE"], False),
    "PASS_ORIGIN": (["PASS"], False),
    "PASS_DESTINATION": (["PASS"], True),
    "CARRY": (["CARRY"], False),
    "SHOT": (["SHOT"], False),
    "DEFENSIVE_ACTION": (["TACKLE", "INTERCEPTION", "BLOCK", "CLEARANCE", "RECOVERY"], False),
    "PRESSURE": (["PRESSURE"], False),
    "COMBINED_ACTIVITY": (["PASS", "CARRY", "DRIBBLE", "SHOT", "TACKLE", "INTERCEPTION", "PRESSURE", "RECOVERY", "CLEARANCE"], False),
}
#: Play patterns that aren't open play.
DEAD_BALL = ["From Corner", "From Free Kick", "From Throw In", "From Goal Kick", "From Kick Off", "From Keeper", "From Set Piece"]


def weights(spark: SparkSession, model: dict[str, dict[str, float]], name: str) -> DataFrame:
    return spark.createDataFrame([(k, m, float(w), i) for i, (k, ms) in enumerate(model.items()) for m, w in ms.items()], f"{name} string, metric_key string, weight double, {name}_order int")


def profile_weights(spark: SparkSession) -> DataFrame:
    return weights(spark, PROFILE, "category")


def profile_relevance(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g, c) for g, cs in RELEVANCE.items() for c in cs], "position_group string, category string")


def roles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, n, g, ROLE_MINUTES, i) for i, (k, n, g, _) in enumerate(ROLES)], "role_key string, role_name string, position_group string, min_minutes int, role_order int")


def role_requirements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, m, w, "HIGHER_BETTER", None) for k, _, _, ms in ROLES for m, w in ms.items()], "role_key string, metric_key string, weight double, direction string, min_percentile double")


def style_weights(spark: SparkSession) -> DataFrame:
    rows = [(d, m, float(w), (d, m) in INVERTED, i) for i, (d, ms) in enumerate(STYLE.items()) for m, w in ms.items()]
    return spark.createDataFrame(rows, "dimension string, metric_key string, weight double, inverted boolean, dimension_order int")


def demand_model(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, label, c, float(w), i) for i, (d, label, cs) in enumerate(DEMAND) for c, w in cs.items()], "dimension string, label string, category string, weight double, dimension_order int")
