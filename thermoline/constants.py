"""Contract values of the telemetry domain."""

from __future__ import annotations

from decimal import Decimal

# ---------------------------------------------------------------------------
# Results are only right if these stay exactly as they are.
# ---------------------------------------------------------------------------
ALERT_TEMPERATURE = Decimal("70.0")
BREAKDOWN_TEMPERATURE = Decimal("68.0")
VIBRATION_LIMIT = 90.0
NORMAL_BAND = (Decimal("30.0"), Decimal("70.0"))

DEFAULT_TEMPERATURE = 45.0
DEFAULT_BRANCH = "Kigali"
BRANCHES = (
    "Kigali", "Musanze", "Huye", "Rubavu", "Rusizi", "Nyagatare", "Rwamagana",
    "Gicumbi", "Kamembe", "Karongi", "Nyanza", "Bugesera", "Kamonyi",
)

ALERT, NORMAL = "ALERT", "NORMAL"
NO_ERROR, OVERHEAT_ERROR = "NORMAL", "E01_OVERHEAT"
ERROR_CODES = (
    "DEMAGED ", "UNKNOWN", "NO WATER ", "LEAKAGE",
    "E01_OVERHEAT", "E02_VIBRATION", "E03_PRESSURE_DROP", "E04_POWER_SURGE",
)
HIGH_RISK_TEXT = "HIGH BREAKDOWN RISK (>70°C)"
LOW_RISK_TEXT = "NORMAL (<=70°C)"

REQUIRED_FIELDS = ("machine_id", "branch", "cycle_temperature", "timestamp", "status")
MISSING_FIELD = "Missing required field: "
INVALID_JSON = "Invalid JSON body"
NOT_AN_OBJECT = "Payload must be a JSON object"
UNREADABLE_TIME = "Unreadable time"

# estimate = base + (temperature * slope) mod span, rounded to `digits`
SENSOR_ESTIMATES = {
    "vibration_hz": {"base": "25.0", "slope": "0.7", "span": "65", "digits": 1},
    "power_kw": {"base": "2.0", "slope": "0.05", "span": "4.5", "digits": 2},
    "water_pressure_bar": {"base": "1.5", "slope": "0.03", "span": "2.5", "digits": 2},
}

MACHINE_PATTERN = "^WM_[0-9]{4}$"
MACHINE_RANGE = (1, 1000)

# (default, maximum) rows of each listing
READINGS_LIMIT = (50, 500)
LOG_LIMIT = (50, 200)
PREDICTIONS_LIMIT = (100, 3000)
INGRESS_BUFFER = 100
LIVE_BUFFER = 50
STREAM_TAIL = 25
TOP_MACHINES = 15

TOPIC = "machine-readings"
LEARNING_ITERATIONS = 20
SPLIT_SEED = 42
TRAIN_SHARE = 80
