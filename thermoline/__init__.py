"""Thermoline: Spark operators for keyed machine telemetry."""
