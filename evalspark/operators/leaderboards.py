"""Leaderboard columns for metric rows: the top ten of each dataset meet its rows once, the rest is row-wise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions import taxonomy as T
from evalspark.functions.cleaning import finite, parse_first_float
from evalspark.operators.ordering import key_join, top_rows

TOP = 10
EMPTY_COUNT, EMPTY_JSON = 0, "[]"


def _lower(kind: Column | str) -> Column:
    return F.coalesce(T.metric_lower_is_better(kind), F.lit(True))


def leaderboard_summary(refs: DataFrame) -> DataFrame:
    """One row per dataset: ``metric``, its normalised ``kind`` and ``entries``, the ten best references, best first.

    ``refs`` has dataset, model, leaderboard_metric_name and metric_value (text). Where a dataset has several metrics the
    first name by code point is the leaderboard's. Values without a number come last, ties go to the smaller model name;
    rows without a metric name take no part. A task sends ten rows of a dataset at most.
    """
    named = refs.where(F.trim("leaderboard_metric_name") != "").select("dataset", "model", F.col("leaderboard_metric_name").alias("metric"), "metric_value")
    own = named.groupBy("dataset").agg(F.min("metric").alias("own"))
    rows = key_join(named, own, ["dataset"]).where(F.col("metric") == F.col("own")).drop("own")
    rows = rows.withColumn("kind", T.leaderboard_metric_kind("metric")).withColumn(
        "score", T.comparison_score(finite(parse_first_float("metric_value")), _lower("kind")))
    best = top_rows(rows, ["dataset"], [F.col("score").asc_nulls_last(), F.col("model"), F.col("metric_value")], TOP)
    entry = F.struct(F.col("rank_in_group").alias("rank"), "model", F.col("metric").alias("metric_name"), "metric_value", "score")
    return best.groupBy("dataset").agg(F.min("metric").alias("metric"), F.min("kind").alias("kind"),
                                       F.array_sort(F.collect_list(entry)).alias("entries"))


def with_leaderboard_columns(metrics: DataFrame, refs: DataFrame) -> DataFrame:
    """``metrics`` rows (dataset, primary_metric, primary_metric_value and any others) with 16 ``leaderboard_`` columns.

    References, deltas, rank, cutoff and gap are null unless the leaderboard's metric is the row's primary one; a gap above
    zero is worse than the tenth (or last) entry. Rows of datasets without references keep a count of 0 and an empty list.
    """
    j = key_join(metrics, leaderboard_summary(refs).select("dataset", F.col("metric").alias("_metric"), F.col("kind").alias("_kind"), F.col("entries").alias("_e")), ["dataset"], "left")
    low, value = _lower("_kind"), finite("primary_metric_value")
    j = j.withColumns({
        "_same": F.coalesce(F.col("_kind") == T.leaderboard_metric_kind("primary_metric"), F.lit(False)),
        "_scores": F.transform(F.filter("_e", lambda e: e["score"].isNotNull()), lambda e: e["score"]),
        "_score": T.comparison_score(value, low)})
    back = lambda s: F.when(low, s).otherwise(-s)
    first = lambda name: F.try_element_at("_e", F.lit(1))[name]
    same = lambda c: F.when(F.col("_same"), c)
    best, cut = F.try_element_at("_scores", F.lit(1)), F.try_element_at("_scores", F.greatest(F.size("_scores"), F.lit(1)))
    ranked = F.col("_same") & F.col("_score").isNotNull() & (F.size("_scores") > 0) & T.metric_lower_is_better("_kind").isNotNull()
    place = F.size(F.filter("_scores", lambda s: s < F.col("_score"))) + 1
    shown = F.transform("_e", lambda e: F.struct(e["rank"].alias("rank"), e["model"].alias("model"), e["metric_name"].alias("metric_name"), e["metric_value"].alias("metric_value")))
    return j.select(
        *[F.col(f"`{c}`") for c in metrics.columns],
        first("model").alias("leaderboard_model"), F.col("_metric").alias("leaderboard_metric_name"),
        first("metric_value").alias("leaderboard_metric_value"), first("rank").cast("int").alias("leaderboard_rank"),
        F.when(F.col("_e").isNull(), EMPTY_COUNT).otherwise(F.size("_e")).cast("int").alias("leaderboard_top10_count"),
        F.coalesce(F.to_json(shown), F.lit(EMPTY_JSON)).alias("leaderboard_top10_json"),
        F.col("_kind").alias("leaderboard_metric_normalized"),
        T.metric_lower_is_better("_kind").alias("leaderboard_lower_is_better"),
        same(back(first("score"))).alias("leaderboard_metric_reference"),
        same(value - back(first("score"))).alias("leaderboard_delta_primary"),
        same(back(best)).alias("leaderboard_top10_best_reference"),
        same(value - back(best)).alias("leaderboard_delta_top10_best"),
        F.when(ranked, place).alias("leaderboard_estimated_rank_vs_top10"),
        F.when(ranked, place <= TOP).alias("leaderboard_estimated_in_top10"),
        F.when(ranked, F.col("_score") - cut).alias("leaderboard_gap_to_top10_cutoff"),
        F.when(ranked, back(cut)).alias("leaderboard_top10_cutoff_value"))
