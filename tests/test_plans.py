"""What the physical plans must look like at scale."""

import re

import pytest
from pyspark.sql import functions as F

from thermoline import schemas
from thermoline.operators import aggregates, cleaning, combine, filters, sequence
from thermoline.plans import insights
from thermoline.sources import history


@pytest.fixture(scope="module")
def landed(spark, telemetry, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "raw")
    rows = cleaning.with_partition_date(telemetry).select(*schemas.READING.names, "dt")
    history.write_history(rows, path)
    return history.read_history(spark, path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text):
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<(.*?)>\n", text)]


def test_threshold_is_pushed_as_decimal(landed):
    text = plan(aggregates.count_alerts(landed))
    assert "GreaterThan(cycle_temperature,70.00)" in text
    assert read_columns(text) == [{"machine_id", "branch", "cycle_temperature"}]
    assert text.count("Exchange") == 1 and "partial_count" in text


def test_one_date_reads_one_partition(landed):
    text = plan(filters.history(landed, "2024-01-10", branch="Huye"))
    assert re.search(r"PartitionFilters: \[isnotnull\(dt#\d+\), \(dt#\d+ = 2024-01-10\)\]", text)
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_newest_date_is_found_before_the_scan(landed):
    text = plan(filters.history(landed))
    assert re.search(r"PartitionFilters: \[.*dt#\d+ = Subquery", text)


def test_newest_is_a_top_n(landed):
    for df in (sequence.newest(landed, 50), aggregates.top_overheating(landed)):
        text = plan(df)
        assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_top_row_per_key_is_cut_before_the_shuffle(landed):
    for df in (sequence.latest_per_key(landed), sequence.dedupe(landed, keep_keyless=False),
               sequence.partition_sample(landed)):
        text = plan(df)
        exchange = text.index("Exchange hashpartitioning")
        assert "Partial" in text[exchange:] and "WindowGroupLimit" in text[exchange:]


def test_fold_sends_one_row_per_key_and_task(landed):
    text = plan(combine.fold_by_key(combine.log_rows(landed)))
    assert "partial_min_by" in text and "partial_max_by" in text
    assert text.count("Exchange") == 1


def test_next_scans_and_shuffles_readings_once(spark, landed):
    jobs = spark.sparkContext.statusTracker()
    before = jobs.getJobIdsForGroup(None)
    df = sequence.with_next(landed)
    assert jobs.getJobIdsForGroup(None) == before       # building the plan starts no job
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    final = text[:text.index("Initial Plan")]
    assert "ReusedExchange" in final and final.count("FileScan") == 1


def test_recent_filters_every_scan_before_it_ranks(spark, landed):
    rows = combine.log_rows(landed)
    df = combine.recent_telemetry(landed, rows, landed, machine_id="WM_0003")
    text = plan(df)
    assert len(re.findall(r"DataFilters: \[[^\]]*machine_id", text)) >= 3
    assert "LeftSemi" in text


def test_insights_scan_history_once(landed):
    text = plan(insights.profile(landed))
    assert text.count("FileScan") == 1
    assert read_columns(text) == [{"machine_id", "branch", "txn_timestamp", "cycle_temperature",
                                   "breakdown_soon"}]


def test_no_plan_holds_a_cross_join(telemetry):
    states = combine.status_rows(sequence.latest_per_key(telemetry))
    scored = states.select("machine_id", "branch", F.col("breakdown_soon").alias("prediction"),
                           F.col("last_updated").alias("scored_at"))
    for df in (aggregates.fleet_kpis(states, scored),
               combine.status_with_predictions(states, scored),
               insights.snapshot(insights.insights(insights.profile(telemetry)))):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_no_python_in_the_plans(telemetry):
    for df in (cleaning.impute_reading(telemetry), sequence.with_next(telemetry),
               combine.fold_by_key(telemetry), insights.profile(telemetry)):
        assert "Python" not in plan(df) and "Pandas" not in plan(df)


def test_mixed_history_is_pruned_on_both_sides(spark, landed, tmp_path):
    path = str(tmp_path / "mixed")
    history.write_history(landed.filter("dt < '2024-01-10'"), path)
    history.write_history(landed.filter("dt >= '2024-01-10'"), path, file_format="json")
    hot = filters.over_threshold(history.load_history(spark, path).filter("dt >= '2024-01-05'"))
    text = plan(hot.select("machine_id"))
    assert len(re.findall(r"PartitionFilters: \[.*dt#\d+ >= 2024-01-05", text)) == 2
    assert "GreaterThan(cycle_temperature,70.00)" in text
    parquet, lines = read_columns(text)
    assert parquet == {"machine_id", "cycle_temperature"}
    # A line is a row if it can be read, which the mark and one field tell.
    assert lines == {"machine_id", "cycle_temperature", "reading_id", "_broken_line"}


def test_newest_landed_reads_newest_dates(landed):
    text = plan(sequence.newest_landed(landed, 50))
    assert re.search(r"PartitionFilters: \[.*dt#\d+ >= .*Subquery", text)
    assert "TakeOrderedAndProject" in text


@pytest.mark.parametrize("n", [1, 40, 5000])
def test_newest_landed_equals_newest(landed, n):
    assert sequence.newest_landed(landed, n).collect() == sequence.newest(landed, n).collect()


def test_newest_landed_of_nothing(landed):
    assert sequence.newest_landed(landed.filter("dt > '2030-01-01'"), 5).count() == 0


def test_writes_rebalance_by_date(landed):
    hinted = landed.hint("rebalance", F.col("dt"))
    assert "REBALANCE_PARTITIONS_BY_COL" in plan(hinted)
