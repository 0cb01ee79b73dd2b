"""Fixed values of the record contract: concepts, units, rank scales, record types."""

from __future__ import annotations

# Concept name -> canonical unit.
CONCEPT_UNITS = {
    "timestamp": "s",
    "lap_time": "s",
    "lap_valid": "boolean",
    "lap_distance": "m",
    "lap_fraction": "ratio",
    "track_position_x": "m",
    "track_position_y": "m",
    "track_position_z": "m",
    "speed": "m/s",
    "longitudinal_acceleration": "m/s^2",
    "lateral_acceleration": "m/s^2",
    "vertical_acceleration": "m/s^2",
    "yaw_rate": "rad/s",
    "steering_angle": "rad",
    "steering_input": "ratio",
    "throttle": "ratio",
    "brake": "ratio",
    "clutch": "ratio",
    "gear": "integer",
    "rpm": "1/min",
    "wheel_speed_front_left": "m/s",
    "wheel_speed_front_right": "m/s",
    "wheel_speed_rear_left": "m/s",
    "wheel_speed_rear_right": "m/s",
    "tire_pressure_front_left": "Pa",
    "tire_pressure_front_right": "Pa",
    "tire_pressure_rear_left": "Pa",
    "tire_pressure_rear_right": "Pa",
    "tire_temperature_front_left": "degC",
    "tire_temperature_front_right": "degC",
    "tire_temperature_rear_left": "degC",
    "tire_temperature_rear_right": "degC",
    "abs_active": "boolean",
    "traction_control_active": "boolean",
    "fuel_mass": "kg",
    "session_state": "state",
    "incident_state": "state",
    "off_track_state": "boolean",
    "air_temperature": "degC",
    "track_temperature": "degC",
    "track_wetness": "ratio",
}

# Concepts whose value is not a plain number.
BOOLEAN_CONCEPTS = ("lap_valid", "abs_active", "traction_control_active", "off_track_state")
INTEGER_CONCEPTS = ("gear",)
TEXT_CONCEPTS = ("session_state", "incident_state")

# Record types and value provenances.
RECORD_TYPES = ("session", "lap", "segment", "telemetry_sample", "distance_bin", "driver_input_event")
PROVENANCES = ("measured", "derived", "estimated", "unavailable")

# An ordinal scale, weakest first.
CEILINGS = ("descriptive", "associational", "intervention_associated", "causal_candidate")

# The fields of a comparability key, and those whose variation needs a plan.
COMPARABILITY_FIELDS = (
    "participant", "simulator", "car", "track", "layout", "protocol_version", "condition_semantics",
    "coaching_state", "configuration_identity", "segment_definition", "metric_definition",
    "normalization_contract", "product_build",
)
PROTECTED_IDENTITY_FIELDS = ("configuration_identity", "product_build")

NUMERIC_CONCEPTS = tuple(c for c in CONCEPT_UNITS if c not in BOOLEAN_CONCEPTS + TEXT_CONCEPTS)


def value_type(concept: str) -> str:
    """Spark type of a concept's value."""
    if concept in BOOLEAN_CONCEPTS:
        return "boolean"
    if concept in TEXT_CONCEPTS:
        return "string"
    return "double"
