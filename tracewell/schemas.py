"""Schemas (as DDL text) and fixed values of the event, match, episode and alert tables."""

from __future__ import annotations

# ---- fixed values -------------------------------------------------------------------------
SCHEMA_VERSION = "1.0"

CASCADE = "ThermalVibrationCascade"
HEARTBEAT = "MissingHeartbeat"
ORDER_FLOW = "EDISequenceViolation"
ORDER_FLOW_MACHINE = "EDI-System"

PATTERN_FAMILY = {
    "ThermalVibrationCascade": "bearing_degradation",
    "MissingHeartbeat": "connectivity_failure",
    "EDISequenceViolation": "edi_compliance",
}
UNKNOWN_FAMILY = "unclassified"
DEFAULT_SEVERITY = {
    "ThermalVibrationCascade": "CRITICAL",
    "MissingHeartbeat": "CRITICAL",
    "EDISequenceViolation": "HIGH",
}

MISSING_READING = -1.0
CASCADE_WITHIN_MS = 600_000
OUT_OF_ORDER_MS = 5_000
HEARTBEAT_GAP_SECONDS = 63
ORDER_WINDOW_MS = 240 * 60_000

INTERVENTION_TYPES = [
    "bearing_replacement",
    "lubrication",
    "calibration",
    "belt_adjustment",
    "sensor_recalibration",
    "inspection_no_action",
    "preventive_maintenance",
]
EPISODE_TYPES = ["pattern_occurrence", "intervention", "agent_alert", "outcome"]
MAX_EPISODE_WORDS = 100
HYBRID_CANDIDATES = 30
BASELINE_FIELDS = [
    "baseline_temperature_c",
    "baseline_current_a",
    "cascade_temperature_offset_c",
    "cascade_vibration_threshold_mm_s",
    "cascade_current_deviation_pct",
]
# -------------------------------------------------------------------------------------------

RECORD = "topic string, key string, value string, offset long, timestamp timestamp"

TELEMETRY = (
    "machine_id string, machine_type string, event_time string, event_type string, "
    "sensors map<string,double>, meta struct<sim_seed:int,injected_fault:string>"
)
HEARTBEATS = (
    "machine_id string, event_time string, event_type string, sequence long"
)
ORDER_EVENTS = (
    "event_id string, event_type string, order_id string, event_time string, payload string"
)
BASELINES = (
    "machine_id string, " + ", ".join(f"{name} double" for name in BASELINE_FIELDS)
)

# One source event of any detector, as read back from a match.
SOURCE_EVENT = (
    "machine_id string, machine_type string, event_time string, event_type string, "
    "sensors map<string,double>, sequence long, event_id string, order_id string, payload string"
)
MATCH_FIELDS = [
    "schema_version",
    "pattern_name",
    "machine_id",
    "detected_at",
    "severity",
    "violation_type",
    "source_events",
]
MATCH = ", ".join(f"{name} string" for name in MATCH_FIELDS[:-1]) + (
    f", source_events array<struct<{SOURCE_EVENT}>>"
)

EPISODE = (
    "episode_id string, name string, body string, episode_type string, "
    "reference_time timestamp, group_id string"
)
INTERVENTION = (
    "intervention_id string, machine_id string, intervention_type string, performed_at timestamp, "
    "performed_by string, notes string, target_pattern_name string"
)
OUTCOME = (
    "outcome_id string, intervention_id string, machine_id string, outcome_status string, "
    "days_until_recurrence int, evaluation_window_days int, observed_at timestamp"
)
FAULT_WINDOW = (
    "machine_id string, fault string, sim_start timestamp, sim_end timestamp"
)
