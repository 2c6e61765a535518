"""Physical plans: no cross joins, narrow scans, filters at the source."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def plan_of(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["window_files", "window_coverage", "uptime_bins", "deployment_of_bin", "matched_by_distance", "hulls_by_fill", "detector_agreement",
                                  "box_evidence", "box_shore_distance", "label_shuffle_summary", "split_half_summary", "scene_wide_table", "sweep_counts",
                                  "stratified_batch", "passages_found", "band_split_counts", "band_cluster_counts", "asset_sweep_best", "corner_records", "aoi_coverage"])
def test_no_nested_loops(spark, name):
    text = plan_of(spark, name)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["aoi_coverage", "aoi_containment", "passages_found", "peak_prominences", "suppressed_boxes", "asset_sweep_counts", "label_shuffle_null", "box_corner_lonlat"])
def test_no_python_workers(spark, name, monkeypatch):
    """Neither in the final plan nor in that of a table written on the way."""
    import sys

    from tidelight import session

    plans, real = [], session.cut

    def cut(df, label="cut"):
        plans.append(df._jdf.queryExecution().toString())
        return real(df, label)

    for module in list(sys.modules.values()):
        if getattr(module, "__name__", "").startswith("tidelight.") and getattr(module, "cut", None) is real:
            monkeypatch.setattr(module, "cut", cut)
    plans.append(plan_of(spark, name))
    assert not [p for p in plans if re.search("EvalPython|InPandas|InArrow", p.split("== Physical Plan ==")[1])]


def test_scans_read_only_what_they_need(spark):
    assert "ReadSchema: struct<embedding:array<float>,label:int>" in plan_of(spark, "level_histogram")
    text = plan_of(spark, "stratified_batch")
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate" in text and "o_totalprice" not in text.split("== Physical Plan ==")[1]


def test_filters_reach_the_scan(spark):
    text = plan_of(spark, "scenes_after_drops")
    assert "EqualTo(l_quantity,50.0)" in text
    assert re.search(r"PushedFilters: \[.*EqualTo\(event_type,purchase\)", plan_of(spark, "window_files"))


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(spark, "stratified_batch")


def test_sweep_is_one_partial_aggregate(spark):
    from tidelight.plans import marks
    from tidelight.plans.base import Tables

    t = Tables(spark, SF)
    boxes = marks._flags(t)
    from tidelight.operators import detections as de

    grid = de.parameter_grid(conf=(0.9, 0.95), min_len=(0, 10))
    out = de.sweep_counts(boxes, "scene_id", grid, lambda c: de.passes(boxes.columns, c["conf"], min_len=c["min_len"]))
    physical = out._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert physical.count("Exchange hashpartitioning(l_suppkey") + physical.count("Exchange hashpartitioning(scene_id") <= 2


def test_no_outage_has_no_distance(spark, tmp_path):
    """Files in every hour, so there is no gap to be near to; with one gap the query and its SQL still agree."""
    import duckdb

    from tests.compare import differences

    hours = "SELECT range AS event_id, TIMESTAMP '2024-01-01' + to_hours(CAST(range // 2 AS INTEGER)) AS ts, 1 AS user_id, CASE range % 2 WHEN 0 THEN 'error' ELSE 'view' END AS event_type, 1.0 AS value, '{}' AS props FROM range(96)"
    for name, where, gaps in (("whole", "true", False), ("gap", "event_type = 'view' OR event_id NOT BETWEEN 40 AND 50", True)):
        folder = tmp_path / name
        folder.mkdir()
        con = duckdb.connect()
        con.execute(f"COPY (SELECT * FROM ({hours}) WHERE {where}) TO '{folder}/events.parquet'")
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
        df = QUERIES["hours_to_nearest_outage"](spark, str(folder))
        assert differences(df, con, entry.oracle_sql()["hours_to_nearest_outage"]) is None
        assert {r.gap_hours is None for r in df.collect()} == {not gaps}
