"""Rules and lookups kept as data.

A new rule is a new row here (or in a list the caller passes), never new code.
Every list is written by hand and read on the driver, so the tables built from
them have a known, tiny size and may be broadcast.
"""

from __future__ import annotations

from typing import NamedTuple


class SpeedTier(NamedTuple):
    tier: int
    range_ms: int
    limit: float
    anomaly_type: str
    severity: str
    description: str


class SystemRule(NamedTuple):
    sig_name: str
    anomaly_type: str
    severity: str
    description: str
    additional_info: str


class ThresholdRule(NamedTuple):
    name: str
    signal_name: str
    threshold: float
    reason_code: int


# Limits, names and texts of the anomaly rules.
SPEED_SIGNAL = "speed"
SPEED_RETENTION_MS = 30_000
SPEED_TIERS = [
    SpeedTier(1, 1000, 18.0, "SPEED_CHANGE_1S", "HIGH", "Speed changed too rapidly within 1 second"),
    SpeedTier(2, 2000, 24.0, "SPEED_CHANGE_2S", "MEDIUM", "Speed changed too rapidly within 2 seconds"),
]
SPEED_DETAIL = "Previous speed: %.2f m/s, Current speed: %.2f m/s, Time diff: %d ms"
SYSTEM_RULES = [
    SystemRule("AEB", "AEB_TRIGGERED", "HIGH",
               "Autonomous Emergency Braking activated", "AEB system intervention detected"),
    SystemRule("NOA_EXIT", "NOA_EXIT", "MEDIUM",
               "Navigate on Autopilot exited", "NOA system disengaged"),
    SystemRule("ACC_EXIT", "ACC_EXIT", "MEDIUM",
               "Adaptive Cruise Control exited", "ACC system disengaged"),
    SystemRule("LKA_EXIT", "LKA_EXIT", "MEDIUM",
               "Lane Keeping Assist exited", "LKA system disengaged"),
]

# Queue (route) names, and the usage types with a route of their own.
DEFAULT_QUEUE = "default_triggers"
PRODUCTION_QUEUE = "production_car_triggers"
TEST_DRIVE_QUEUE = "test_drive_car_triggers"
MEDIA_QUEUE = "media_car_triggers"
INTERNAL_QUEUE = "internal_car_triggers"
FUSION_QUEUE = "fusion_car_triggers"
WRITE_DB_QUEUE = "write_db_triggers"
QUEUES = [
    DEFAULT_QUEUE, PRODUCTION_QUEUE, TEST_DRIVE_QUEUE, MEDIA_QUEUE,
    INTERNAL_QUEUE, FUSION_QUEUE, WRITE_DB_QUEUE,
]
USAGE_ROUTES = {
    "production": PRODUCTION_QUEUE,
    "test_drive": TEST_DRIVE_QUEUE,
    "media": MEDIA_QUEUE,
    "internal": INTERNAL_QUEUE,
}
NO_USAGE = "none"
BACKLOG_LIMIT = 1000
BACKLOG_TEXT = "Alert: Queue %s length %d exceeds or equals threshold %d"

# Trigger ids let through (123 is listed twice on purpose, it must not double rows).
ALLOWED_TRIGGER_IDS = [1, 2, 3, 4, 5, 123, 345, 62, 44, 123]

# Crash thresholds in list order, the text of a crossing, and the crash reasons.
# The collision flag is 0/1 and the comparison is strict, so its threshold is 0.5.
THRESHOLD_RULES = [
    ThresholdRule("LongitudinalAcceleration", "LongitudinalAcceleration", 1.5, 2),
    ThresholdRule("LateralAcceleration", "LateralAcceleration", 0.8, 1),
    ThresholdRule("CollisionSignal", "crash", 0.5, 3),
]
RULES_BY_ROUTE = {route: THRESHOLD_RULES for route in USAGE_ROUTES.values()}
CROSSING_TEXT = "信号 %s 超过阈值 %f,"
CRASH_REASONS = {
    0: "未发生碰撞",
    1: "横行加速度超限",
    2: "纵向加速度超限",
    3: "气囊弹出",
    4: "方向盘转角超限",
}

# Histogram bounds, seconds.
DURATION_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
