"""Schemas of the engine's tables."""

MESSAGES = "conv_id string, idx int, message_json string"
JUDGEMENTS = "conv_id string, unit_id string, vote int, p_keep double, confidence double"
SIGNALS = "conv_id string, vote int, destructive double, exfiltration double, thrashing double, goal_drift double, progress double"
SIGNAL_KINDS = ("destructive", "exfiltration", "thrashing", "goal_drift")
#: Kinds that block a pending action.
GATED = ("destructive", "exfiltration")
