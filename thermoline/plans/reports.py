"""The record and summary queries an operations view asks, each a named set of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermoline import constants as C
from thermoline.operators import aggregates, cleaning, combine, filters, sequence
from thermoline.streaming import ingest


def readings_report(buffer: DataFrame, log: DataFrame, raw: DataFrame, limit: object = None,
                    **wanted: object) -> dict[str, DataFrame]:
    """Recent readings over all sources, with alert counts of what is returned."""
    rows = combine.recent_telemetry(buffer, log, raw, limit, **wanted)
    return {"readings": rows, "counts": aggregates.reading_counts(rows)}


def storage_report(raw: DataFrame) -> dict[str, DataFrame]:
    """Date partitions of the history and a few landed rows."""
    return {"partitions": aggregates.partition_catalog(raw),
            "total": aggregates.partition_count(raw),
            "sample": sequence.partition_sample(raw)}


def history_report(raw: DataFrame, dt: str | None = None, branch: str | None = None,
                   status: str | None = None, limit: object = None) -> dict[str, DataFrame]:
    """One date of the history: the newest matching rows, and how many match."""
    return {"records": filters.history(raw, dt, branch, status, limit),
            "total": filters.history_total(raw, dt, branch, status)}


def operations_report(status: DataFrame, log: DataFrame,
                      limit: object = None) -> dict[str, DataFrame]:
    """Fleet summary, states by last update, newest log rows."""
    return {"fleet": aggregates.fleet_summary(status),
            "by_status": aggregates.status_summary(status),
            "machines": cleaning.present(sequence.newest_states(status)),
            "readings": cleaning.present(
                sequence.newest(log, filters.clamp_limit(limit, *C.LOG_LIMIT)))}


def predictions_report(predictions: DataFrame, risk: object = None, branch: str | None = None,
                       limit: object = None) -> dict[str, DataFrame]:
    """Summary of all predictions, and the ones asked for by machine."""
    rows = cleaning.normalize_predictions(predictions)
    return {"summary": aggregates.prediction_summary(rows),
            "predictions": filters.filter_predictions(rows, risk, branch)
            .orderBy("machine_id", "branch", "scored_at")
            .limit(filters.clamp_limit(limit, *C.PREDICTIONS_LIMIT))}


def fleet_report(status: DataFrame, predictions: DataFrame) -> dict[str, DataFrame]:
    """Fleet figures, and each machine's state next to its prediction."""
    return {"kpis": aggregates.fleet_kpis(status, predictions),
            "machines": combine.status_with_predictions(status, predictions)}


def live_report(buffer: DataFrame, *fallbacks: DataFrame,
                shown: int = C.STREAM_TAIL) -> dict[str, DataFrame]:
    """Live buffer, or the first fallback that holds rows: counts, and the newest readings."""
    source = next((df for df in (buffer, *fallbacks) if not df.isEmpty()), buffer)
    return {"counts": ingest.live_counts(source), "readings": sequence.newest(source, shown)}


def insights_report(spark: SparkSession, out: str,
                    top_n: int = C.TOP_MACHINES) -> dict[str, DataFrame]:
    """The insights that a job wrote to `out`."""
    def ordered(name: str, *order: str) -> DataFrame:
        first, *rest = order
        return spark.read.parquet(f"{out}/{name}").orderBy(F.desc(first), *rest)

    return {"avg_temp_by_branch": ordered("avg_temp_by_branch", "avg_temperature", "branch"),
            "top_overheating_machines": ordered("time_in_alert", "alert_count", "machine_id",
                                                "branch").limit(top_n),
            "hourly_alert_distribution": ordered("busiest_alert_hour", "alert_count", "hour"),
            "fleet_health_summary": spark.read.parquet(f"{out}/fleet_health")}
