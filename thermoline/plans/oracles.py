"""SQL text of the inputs that the registered queries share, for DuckDB."""

from __future__ import annotations

EVENTS_AS_TELEMETRY = """
b AS (
  SELECT event_id, user_id, ts, value,
         cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k
  FROM events),
t AS (
  SELECT event_id,
         md5(cast(event_id AS string)) AS reading_id,
         'WM_' || lpad(cast(user_id + 1 AS string), 4, '0') AS machine_id,
         split_part('Kigali,Musanze,Huye,Rubavu,Rusizi,Nyagatare,Rwamagana,Gicumbi,Kamembe,Karongi,Nyanza,Bugesera,Kamonyi',
                    ',', cast(user_id % 13 AS int) + 1) AS branch,
         cast(least(110.0, greatest(24.0, value)) AS decimal(5,2)) AS cycle_temperature,
         cast(120 + k * 11 AS double) / 10 AS vibration_hz,
         cast(150 + event_id % 701 AS double) / 100 AS power_kw,
         cast(120 + event_id % 381 AS double) / 100 AS water_pressure_bar,
         ts AS txn_timestamp
  FROM b),
telemetry AS (
  SELECT *,
         CASE WHEN cycle_temperature > 70 OR vibration_hz > 90
              THEN split_part('DEMAGED |UNKNOWN|NO WATER |LEAKAGE|E01_OVERHEAT|E02_VIBRATION|E03_PRESSURE_DROP|E04_POWER_SURGE',
                              '|', cast(event_id % 8 AS int) + 1)
              ELSE 'NORMAL' END AS error_code,
         CASE WHEN cycle_temperature > 70 OR vibration_hz > 90 THEN 'ALERT' ELSE 'NORMAL' END AS status,
         CASE WHEN cycle_temperature > 68 OR vibration_hz > 90 THEN 1 ELSE 0 END AS breakdown_soon
  FROM t)"""

# Latest reading per machine, and the tables that hang on it.
LATEST = """
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY machine_id
                                 ORDER BY txn_timestamp DESC, reading_id DESC) AS rn
    FROM telemetry) WHERE rn = 1),
machine_status AS (
  SELECT machine_id, reading_id, branch, cycle_temperature, status, breakdown_soon,
         txn_timestamp AS last_updated
  FROM latest),
predictions AS (
  SELECT machine_id, branch, breakdown_soon AS prediction,
         TIMESTAMP '2024-02-01 18:00:00' AS scored_at
  FROM latest)"""

RAW = """
raw AS (SELECT *, cast(txn_timestamp AS date) AS dt FROM telemetry)"""

# Every tenth reading is delivered a second time, with another temperature.
DELIVERIES = """
deliveries AS (
  SELECT *, event_id * 2 AS arrival FROM telemetry
  UNION ALL
  SELECT * REPLACE (cast(134 - cycle_temperature AS decimal(5,2)) AS cycle_temperature,
                    CASE WHEN 134 - cycle_temperature > 70 THEN 'ALERT' ELSE 'NORMAL' END AS status,
                    1 - breakdown_soon AS breakdown_soon),
         1000000000000 + event_id AS arrival
  FROM telemetry WHERE event_id % 10 = 0)"""

# Readings as text with gaps, bad numbers and five time formats.
MESSAGES = """
messages AS (
  SELECT event_id,
         CASE WHEN event_id % 13 <> 0 THEN reading_id END AS reading_id,
         CASE WHEN event_id % 23 <> 0 THEN machine_id END AS machine_id,
         CASE WHEN event_id % 17 <> 0 THEN branch END AS branch,
         CASE WHEN event_id % 29 = 0 THEN 'n/a'
              WHEN event_id % 19 <> 0 THEN cast(cycle_temperature AS string) END
           AS cycle_temperature,
         CASE WHEN event_id % 11 <> 0 THEN cast(vibration_hz AS string) END AS vibration_hz,
         CASE event_id % 5
              WHEN 0 THEN strftime(txn_timestamp, '%Y-%m-%dT%H:%M:%SZ')
              WHEN 1 THEN strftime(txn_timestamp, '%Y-%m-%dT%H:%M:%S.%f+00:00')
              WHEN 2 THEN strftime(txn_timestamp, '%Y-%m-%d %H:%M:%S+02:00')
              WHEN 3 THEN strftime(txn_timestamp, '%Y-%m-%d')
              ELSE 'junk' END AS timestamp,
         CASE WHEN event_id % 7 <> 0 THEN status END AS status,
         CASE event_id % 5
              WHEN 0 THEN date_trunc('second', txn_timestamp)
              WHEN 1 THEN txn_timestamp
              WHEN 2 THEN date_trunc('second', txn_timestamp) - INTERVAL 2 HOUR
              WHEN 3 THEN cast(cast(txn_timestamp AS date) AS timestamp)
              ELSE TIMESTAMP '2024-02-01 00:00:00' END AS true_time
  FROM telemetry)"""

# Machine ids out of range or malformed.
ODD_IDS = """
odd_ids AS (
  SELECT * REPLACE (CASE event_id % 31
                      WHEN 0 THEN 'WM_0000' WHEN 1 THEN 'WM_4885' WHEN 2 THEN 'XX_0001'
                      WHEN 3 THEN 'WM_12AB' WHEN 4 THEN 'wm_0007' WHEN 5 THEN 'WM_00012'
                      ELSE machine_id END AS machine_id)
  FROM telemetry)"""

# Readings that sit exactly on a threshold.
EDGES = """
edges AS (
  SELECT * REPLACE (
           cast(CASE event_id % 9 WHEN 0 THEN 70.00 WHEN 1 THEN 68.00 WHEN 2 THEN 30.00
                                  WHEN 3 THEN 70.01 WHEN 4 THEN 29.99
                                  ELSE cycle_temperature END AS decimal(5,2))
             AS cycle_temperature,
           CASE WHEN event_id % 10 = 0 THEN 90.0 ELSE vibration_hz END AS vibration_hz)
  FROM telemetry)"""


def sql(body: str, *parts: str) -> str:
    """A query over the telemetry view and the further inputs named."""
    return "WITH " + ",".join([EVENTS_AS_TELEMETRY, *parts]) + "\n" + body


def shown(name: str) -> str:
    """A time column as the text that `present` renders."""
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"
