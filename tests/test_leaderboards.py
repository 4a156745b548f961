"""Leaderboard columns of metric rows: ties, missing values, other metrics and empty tables."""

import json

import pytest

from evalspark.operators.leaderboards import leaderboard_summary, with_leaderboard_columns

REFS = "dataset string, model string, leaderboard_metric_name string, metric_value string"
ROWS = "dataset string, row int, primary_metric string, primary_metric_value double"


def annotated(spark, rows, refs):
    out = with_leaderboard_columns(spark.createDataFrame(rows, ROWS), spark.createDataFrame(refs, REFS))
    assert sum(c.startswith("leaderboard_") for c in out.columns) == 16
    return {r["row"]: r.asDict() for r in out.collect()}


def test_rank_gap_and_cutoff_of_errors(spark):
    refs = [("d", f"m{i:02}", "RMSE", f"{0.1 * i:.1f} ± 0.1") for i in range(1, 13)]
    got = annotated(spark, [("d", 1, "rmse", 0.05), ("d", 2, "RMSE", 0.3), ("d", 3, "RMSE", 5.0), ("d", 4, "RMSE", None)], refs)
    assert [got[i]["leaderboard_estimated_rank_vs_top10"] for i in (1, 2, 3, 4)] == [1, 3, 11, None]
    assert [got[i]["leaderboard_estimated_in_top10"] for i in (1, 2, 3, 4)] == [True, True, False, None]
    assert got[2]["leaderboard_gap_to_top10_cutoff"] == pytest.approx(-0.7) and got[2]["leaderboard_top10_cutoff_value"] == 1.0
    assert got[3]["leaderboard_delta_primary"] == pytest.approx(4.9) and got[4]["leaderboard_delta_primary"] is None
    entries = json.loads(got[1]["leaderboard_top10_json"])
    assert [e["rank"] for e in entries] == list(range(1, 11)) and entries[0]["model"] == "m01"
    assert got[1]["leaderboard_top10_count"] == 10 and got[1]["leaderboard_lower_is_better"] is True


def test_scores_turn_the_direction_and_ties_do_not_count_as_better(spark):
    refs = [("d", "b", "AUROC", "0.9"), ("d", "a", "AUROC", "0.9"), ("d", "c", "AUROC", "0.7"), ("d", "none", "AUROC", "n/a")]
    got = annotated(spark, [("d", 1, "ROC-AUC", 0.9), ("d", 2, "ROC-AUC", 0.8), ("d", 2, "ROC-AUC", 0.8)], refs)
    assert got[1]["leaderboard_model"] == "a" and got[1]["leaderboard_estimated_rank_vs_top10"] == 1
    assert got[2]["leaderboard_estimated_rank_vs_top10"] == 3 and got[2]["leaderboard_top10_cutoff_value"] == 0.7
    assert got[2]["leaderboard_gap_to_top10_cutoff"] == pytest.approx(-0.1) and got[2]["leaderboard_top10_count"] == 4
    assert got[2]["leaderboard_lower_is_better"] is False


def test_other_metric_missing_board_and_unparsed_values(spark):
    refs = [("d", "a", "RMSE", "0.5"), ("text", "a", "RMSE", "best"), ("blank", "a", " ", "0.1"), ("odd", "a", "speed", "3"), (None, "n", "RMSE", "0.2")]
    rows = [("d", 1, "Spearman", 0.5), ("absent", 2, "RMSE", 0.5), ("text", 3, "RMSE", 0.5), ("blank", 4, "RMSE", 0.5), ("odd", 5, "speed", 4.0),
            (None, 6, "RMSE", 0.3), ("d", 7, None, 0.5), ("d", 8, "RMSE", float("nan"))]
    got = annotated(spark, rows, refs)
    for i in (1, 2, 3, 4, 5, 7, 8):
        assert got[i]["leaderboard_estimated_rank_vs_top10"] is None and got[i]["leaderboard_gap_to_top10_cutoff"] is None
    assert got[1]["leaderboard_model"] == "a" and got[1]["leaderboard_metric_reference"] is None
    assert (got[2]["leaderboard_top10_count"], got[2]["leaderboard_top10_json"]) == (0, "[]") == (got[4]["leaderboard_top10_count"], got[4]["leaderboard_top10_json"])
    assert got[3]["leaderboard_top10_count"] == 1 and got[5]["leaderboard_lower_is_better"] is None
    assert got[6]["leaderboard_model"] == "n" and got[6]["leaderboard_estimated_rank_vs_top10"] == 2


def test_one_metric_of_several_and_empty_tables(spark):
    refs = [("d", "a", "RMSE", "0.5"), ("d", "b", "MAE", "0.1"), ("d", "c", "MAE", "0.2")]
    s = leaderboard_summary(spark.createDataFrame(refs, REFS)).first()
    assert (s["metric"], s["kind"], [e["model"] for e in s["entries"]]) == ("MAE", "mae", ["b", "c"])
    got = annotated(spark, [("d", 1, "RMSE", 0.5)], [])
    assert got[1]["leaderboard_top10_count"] == 0 and got[1]["leaderboard_model"] is None
    assert annotated(spark, [], refs) == {}
