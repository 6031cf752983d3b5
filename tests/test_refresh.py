"""Insights from profiles that are kept by date."""

import os

import pytest

from thermoline.operators import cleaning
from thermoline.plans import insights
from thermoline.sources import history


def put(rows, path, mode="append"):
    cleaning.with_partition_date(rows).write.mode(mode).partitionBy("dt").parquet(path)


def results(profiled):
    return {n: sorted(map(tuple, df.collect()), key=str)
            for n, df in insights.insights(profiled).items()}


def files(path):
    return {d: sorted(n for n in os.listdir(f"{path}/{d}") if n.endswith(".parquet"))
            for d in os.listdir(path) if d.startswith("dt=")}


def test_only_changed_dates_are_counted_again(spark, readings, tmp_path):
    raw, kept = str(tmp_path / "raw"), str(tmp_path / "profiles")
    put(readings([("a", "M", 80, "2024-01-01 05:00:00"), ("b", "M", None, "2024-01-02 06:00:00"),
                  ("c", None, 71, None)]), raw)
    assert results(insights.refresh_profiles(spark, raw, kept)) == results(
        insights.profile(history.load_history(spark, raw)))
    before = files(kept)
    put(readings([("d", "N", 90, "2024-01-02 07:00:00"), ("e", "N", 60, "2024-01-03")]), raw)
    again = insights.refresh_profiles(spark, raw, kept)
    assert results(again) == results(insights.profile(history.load_history(spark, raw)))
    after = files(kept)
    assert {d for d in after if after[d] == before.get(d)} == {
        "dt=2024-01-01", "dt=__HIVE_DEFAULT_PARTITION__"}
    insights.refresh_profiles(spark, raw, kept)
    assert files(kept) == after


def test_a_date_left_without_rows_goes(spark, readings, tmp_path):
    raw, kept = str(tmp_path / "raw"), str(tmp_path / "profiles")
    rows = readings([("a", "M", 80, "2024-01-01"), ("b", "M", 75, "2024-01-02")])
    put(rows, raw)
    insights.refresh_profiles(spark, raw, kept)
    # The date's folder now holds a file without rows.
    rows.limit(0).write.mode("overwrite").parquet(f"{raw}/dt=2024-01-01")
    again = insights.refresh_profiles(spark, raw, kept)
    assert [str(r["dt"]) for r in again.select("dt").collect()] == ["2024-01-02"]
    history.drop_dates(spark, raw, ["2024-01-02"])
    assert insights.refresh_profiles(spark, raw, kept).count() == 0


def test_kept_profiles_do_not_remove_copies(spark):
    with pytest.raises(ValueError):
        insights.run_insights(spark, "raw", "out", dedupe=True, profiles="profiles")
