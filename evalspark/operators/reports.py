"""Report tables over metric rows: deduplication, winners, comparisons, coverage, cost and value.

Metric rows are summaries (one per dataset, model, workflow, run and attempt). Windows below partition by dataset or
run over those summaries; best-row picks use mergeable aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions import columns as K
from evalspark.functions import taxonomy as T
from evalspark.functions.cleaning import ERROR_NULL_TOKENS, has_error, null_clean, safe_ratio, strip, to_number
from evalspark.operators import joins as J
from evalspark.operators.ordering import ROWS_PER_BUCKET, best_row, chained, checked_join, first_known, key_join
from evalspark.session import durable

EPS = 1e-12


# --- dataset level facts ---------------------------------------------------------------------------------------

def target_profile(df: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """Row count, 0/1 test, two-value test, task type and default metric per dataset, without a distinct count."""
    ends = df.groupBy(*keys).agg(F.min(target).alias("_lo"), F.max(target).alias("_hi"))
    j = checked_join(df.select(*keys, target), ends, keys)
    t = F.col(target)
    other = F.count_if((t != F.col("_lo")) & (t != F.col("_hi")))
    g = j.groupBy(*keys, "_lo", "_hi").agg(F.count(F.lit(1)).alias("n_rows"), other.alias("_other"))
    two = F.coalesce((F.col("_other") == 0) & (F.col("_lo") < F.col("_hi")), F.lit(False))
    zero_one = two & (F.abs("_lo") <= 1e-8) & (F.abs(F.col("_hi") - 1) <= 1e-5)
    return g.select(*keys, "n_rows", F.coalesce(zero_one, F.lit(False)).alias("strict_binary"), two.alias("two_valued"),
                    F.when(two, "classification").otherwise("regression").alias("task_type"),
                    F.when(two, "roc_auc").otherwise("rmse").alias("default_metric"))


def log10_target(df: DataFrame, keys: Sequence[str], target: str = "target") -> DataFrame:
    """log10 where every target of the dataset is positive, raw otherwise; one small aggregate joined back."""
    low = df.groupBy(*keys).agg((F.min(target) > 0).alias("_pos"))
    j = checked_join(df, low, keys)
    return (j.withColumn(target, F.when(F.col("_pos"), F.log10(target)).otherwise(F.col(target)))
            .withColumn("target_transform", F.when(F.col("_pos"), "log10").otherwise("raw")).drop("_pos"))


# Log-log cost model of the linear selector.
_SELECTOR_A, _SELECTOR_B = -0.658, 1.225


def selector_seconds(n_rows: Column | str) -> Column:
    n = F.col(n_rows) if isinstance(n_rows, str) else n_rows
    return F.pow(F.lit(10.0), F.lit(_SELECTOR_A) + F.lit(_SELECTOR_B) * F.log10(n))


def selector_rows_at(seconds: Column) -> Column:
    return F.pow(F.lit(10.0), (F.log10(seconds) - F.lit(_SELECTOR_A)) / F.lit(_SELECTOR_B))


# --- analysis columns ------------------------------------------------------------------------------------------

def with_analysis_metric(df: DataFrame) -> DataFrame:
    """Add task kind and the metric column, kind, value and direction each row is judged by.

    The column is chosen by its presence in the table, not by whether the row has a value in it.
    """
    cols = df.columns
    rmse_col = K.pick_column(cols, K.REGRESSION_COLUMNS["rmse"])
    rmse = to_number(rmse_col) if rmse_col else F.lit(None).cast("double")
    present = {k: K.pick_column(cols, c) for k, c in K.CLASSIFICATION_COLUMNS.items()}
    present = {k: c for k, c in present.items() if c}
    task = T.task_kind("primary_metric", rmse, *[to_number(c) for c in present.values()])
    kind = T.classification_metric_kind("dataset", "primary_metric")
    fallback = next(iter(present.items()), None)
    col_name, value, shown_kind = F.lit("classification_metric"), F.lit(None).cast("double"), F.lit("roc_auc")
    if fallback:
        col_name, value, shown_kind = F.lit(fallback[1]), to_number(fallback[1]), F.lit(fallback[0])
    for k, c in present.items():
        col_name = F.when(kind == k, c).otherwise(col_name)
        value = F.when(kind == k, to_number(c)).otherwise(value)
        shown_kind = F.when(kind == k, k).otherwise(shown_kind)
    is_class = F.col("task_kind") == "classification"
    return df.withColumn("task_kind", task).withColumns({
        "analysis_metric": F.when(is_class, col_name).otherwise(F.lit(rmse_col or "rmse")),
        "analysis_metric_kind": F.when(is_class, shown_kind).otherwise(F.lit("rmse")),
        "analysis_metric_value": F.when(is_class, value).otherwise(rmse),
        "analysis_metric_direction": F.when(is_class, "higher").otherwise("lower"),
    })


def with_delta_from_best(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distance to the best value of the dataset, never negative; the group's commonest direction decides.

    Equal counts of both directions go to ``higher`` (the alphabetically first label).
    """
    known = F.col("analysis_metric_value").isNotNull()
    up = F.col("analysis_metric_direction") == "higher"
    g = df.where(known).groupBy(*keys).agg(
        (F.count_if(up) >= F.count_if(~up)).alias("_up"), F.min("analysis_metric_value").alias("_lo"),
        F.max("analysis_metric_value").alias("_hi"))
    v = F.col("analysis_metric_value")
    return (key_join(df, g, keys, "left")
            .withColumn("analysis_delta_from_best",
                        F.when(F.col("_up"), F.col("_hi") - v).otherwise(v - F.col("_lo"))).drop("_up", "_lo", "_hi"))


def with_comparison(df: DataFrame) -> DataFrame:
    """Successful rows with a value, plus the smaller-is-better ``comparison_score``."""
    ok = df.where(~has_error("error") & F.col("analysis_metric_value").isNotNull())
    return ok.withColumn("comparison_score", T.comparison_score(
        "analysis_metric_value", F.col("analysis_metric_direction") != "higher"))


# --- deduplication and winners ---------------------------------------------------------------------------------

def _rank_columns(df: DataFrame, recency: Sequence[Column]) -> list[Column]:
    number = next((c for c in ("test_rmse", "rmse", "primary_metric_value", "cv_rmse", "train_rmse") if c in df.columns),
                  None)
    score = F.coalesce(to_number(number), F.lit(float("inf"))) if number else F.lit(float("inf"))
    status = F.lower(null_clean("status", ("",))) if "status" in df.columns else F.lit(None).cast("string")
    bad = F.coalesce(status.startswith("skipped") | status.contains("error"), F.lit(False))
    err = has_error("error") if "error" in df.columns else F.lit(False)
    return [err.cast("int"), bad.cast("int"), score, *recency]


def dedupe_metric_rows(df: DataFrame, recency: Sequence[Column], keys: Sequence[str] = ("dataset", "model", "workflow"),
                       composite: bool = True) -> DataFrame:
    """One row per key: rows without error first, then good status, then low RMSE, then ``recency`` (ascending).

    ``composite`` takes the first non-null value of every column separately, so a result row can mix source rows;
    otherwise the first whole row is taken.
    """
    work = df.withColumns({k: F.coalesce(strip(k), F.lit(""))
                           for k in ("dataset", "model", "workflow")})
    work = work.where((F.col("dataset") != "") & (F.col("model") != ""))
    order = _rank_columns(work, recency)
    if composite:
        return first_known(work, keys, order).select(*work.columns)
    return best_row(work, keys, order)


def best_rows(df: DataFrame, keys: Sequence[str], seq: Sequence[Column]) -> DataFrame:
    """Best successful row per dataset by ``primary_metric_value``; the first metric name gives the direction.

    Ties go to the row first in ``seq``.
    """
    work = df.where(~has_error("error")).withColumn("primary_metric_value", to_number("primary_metric_value"))
    work = work.where(F.col("primary_metric_value").isNotNull())
    first = first_known(work.select(*keys, "primary_metric", *[s.alias(f"_s{i}") for i, s in enumerate(seq)]), keys,
                        [F.col(f"_s{i}") for i in range(len(seq))], ["primary_metric"])
    lower = F.coalesce(T.metric_lower_is_better(F.coalesce("primary_metric", F.lit("rmse"))), F.lit(True))
    way = first.select(*keys, lower.alias("_lower"))
    scored = key_join(work, way, keys)
    score = T.comparison_score("primary_metric_value", F.col("_lower"))
    return best_row(scored, keys, [score, *seq]).drop("_lower")


def best_by_score(df: DataFrame, keys: Sequence[str], score: str = "comparison_score",
                  tie: Sequence[str] = ("model",)) -> DataFrame:
    return best_row(df, keys, [F.col(score), *[F.col(t) for t in tie]])


# --- summaries -------------------------------------------------------------------------------------------------

def median(c: str | Column) -> Column:
    """Exact median; groups here are report rows, one per dataset."""
    return F.percentile(c, F.lit(0.5))


def model_summary(df: DataFrame, keys: Sequence[str] = ("workflow", "model")) -> DataFrame:
    task = F.col("task_kind")
    return df.groupBy(*keys).agg(
        F.count_distinct("dataset").alias("datasets"),
        F.count_distinct(F.when(task == "regression", F.col("dataset"))).alias("regression_datasets"),
        F.count_distinct(F.when(task == "classification", F.col("dataset"))).alias("classification_datasets"),
        F.avg("analysis_delta_from_best").alias("mean_delta"), median("analysis_delta_from_best").alias("median_delta"),
        F.avg("test_rmse").alias("mean_rmse"),
        F.avg(F.when(task == "classification", F.col("analysis_metric_value"))).alias("mean_classification_metric"))


def winner_counts(winners: DataFrame, by: Sequence[str]) -> DataFrame:
    task = F.col("task_kind")
    g = winners.groupBy(*by).agg(F.count_distinct("dataset").alias("winning_datasets"),
                                 F.count_if(task == "regression").alias("regression_wins"),
                                 F.count_if(task == "classification").alias("classification_wins"))
    total = F.greatest(F.sum("winning_datasets").over(Window.partitionBy(F.lit(0))), F.lit(1))
    return g.withColumn("win_fraction", F.col("winning_datasets") / total)


def family_coverage(df: DataFrame, family: str) -> DataFrame:
    return df.groupBy(family).agg(
        F.count_distinct("dataset").alias("datasets"), F.count_distinct("model").alias("models"),
        F.count(F.lit(1)).alias("n_rows"), F.avg("analysis_delta_from_best").alias("mean_delta"),
        F.avg("test_rmse").alias("mean_rmse"))


def presence(df: DataFrame, dataset: str, family: str) -> DataFrame:
    """Every (dataset, family) with a 0/1 flag; both name lists are report dimensions."""
    names = df.select(family).distinct()
    grid = df.select(dataset).distinct().join(F.broadcast(names))
    seen = df.select(dataset, family).distinct().withColumn("_hit", F.lit(1))
    return grid.join(seen, [dataset, family], "left").select(dataset, family, F.coalesce("_hit", F.lit(0)).alias("present"))


def first_non_empty(df: DataFrame, keys: Sequence[str], columns: Sequence[str], seq: Sequence[Column]) -> DataFrame:
    work = df.select(*keys, *[null_clean(c, ERROR_NULL_TOKENS).alias(c) for c in columns],
                     *[s.alias(f"_s{i}") for i, s in enumerate(seq)])
    return first_known(work, keys, [F.col(f"_s{i}") for i in range(len(seq))], columns)


def most_common(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Commonest value per group; equal counts go to the smallest value."""
    c = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    return c.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias(column),
                                F.max("_n").alias("n_rows"))


# --- references ------------------------------------------------------------------------------------------------

def reference_scores(ref: DataFrame) -> DataFrame:
    """Reference rows with a parsed value and the smaller-is-better ``score`` of their metric kind."""
    low = T.leaderboard_direction("kind") == "lower"
    known = ref.where(F.col("kind").isNotNull() & F.col("value").isNotNull())
    return known.withColumn("score", T.comparison_score("value", low))


def reference_sources(ref: DataFrame) -> DataFrame:
    return ref.where(F.col("kind").isNotNull()).groupBy("dataset", "kind").agg(
        F.array_join(F.array_sort(F.collect_set("reference_source")), "; ").alias("reference_sources"))


def reference_coverage(ref: DataFrame) -> DataFrame:
    """Per dataset and kind: row count, best value, tenth-best (or worst) value, sources."""
    s = reference_scores(ref)
    src = reference_sources(ref)
    cut = J.reference_cutoffs(s, ["dataset", "kind"], "score", "model")
    low = T.leaderboard_direction("kind") == "lower"
    back = lambda c: F.when(low, F.col(c)).otherwise(-F.col(c))
    return cut.join(src, ["dataset", "kind"]).select(
        "dataset", "kind", "n_references", back("best_score").alias("best"), back("tenth_score").alias("tenth_or_worst"),
        "reference_sources")


def compare_with_reference(best: DataFrame, ref: DataFrame) -> DataFrame:
    """Rank, gaps and cutoffs of our best value among the references of the same dataset and metric kind."""
    low = T.leaderboard_direction("kind") == "lower"
    mine = durable(best.withColumn("score", T.comparison_score("best_value", low)))  # one row per dataset, read thrice
    j = J.rank_against(mine, reference_scores(ref), ["dataset", "kind"], "score", "model")
    src = reference_sources(ref)
    back = lambda c: F.when(low, F.col(c)).otherwise(-F.col(c))
    return j.join(src, ["dataset", "kind"]).select(
        *best.columns, F.when(low, "lower").otherwise("higher").alias("direction"),
        back("best_score").alias("leaderboard_top1"), back("tenth_score").alias("leaderboard_top10_cutoff"),
        F.col("n_references").alias("known_reference_count"), "reference_sources",
        F.least("estimated_rank", F.lit(11)).alias("estimated_rank_vs_top10"), F.col("in_top10").alias("in_top10_estimate"),
        F.col("gap_to_best").alias("gap_to_top1"), F.col("gap_to_tenth").alias("gap_to_top10_cutoff"))


def leaderboard_comparison(df: DataFrame, seq: Sequence[str]) -> DataFrame:
    """Best row per dataset on the leaderboard's metric, preferring rows with a rank or gap estimate.

    Target metric = first named leaderboard metric, else the first primary metric. If any row has that metric only such
    rows stay; if any of those has an estimate only such rows stay.
    """
    work = df.withColumn("primary_metric_value", to_number("primary_metric_value")).where(
        F.col("primary_metric_value").isNotNull())
    work = work.withColumns({"_pm": T.normalize_metric("primary_metric"),
                             "_lm": F.nullif(T.normalize_metric("leaderboard_metric_name", ""), F.lit(""))})
    order = [F.col(s) for s in seq]
    first = first_known(work.select("dataset", "_lm", "_pm", *seq), ["dataset"], order, ["_lm", "_pm"])
    target = first.select("dataset", F.coalesce("_lm", "_pm").alias("target_metric"))
    est = F.col("leaderboard_estimated_rank").isNotNull() | F.col("leaderboard_gap").isNotNull()
    j = work.join(target, "dataset").withColumns({"_m": (F.col("_pm") == F.col("target_metric")).cast("int")})
    flags = j.groupBy("dataset").agg(F.max("_m").alias("_any"))
    j = j.join(flags, "dataset").where(F.col("_m") == F.col("_any")).withColumn("_e", est.cast("int"))
    flags = j.groupBy("dataset").agg(F.max("_e").alias("_anye"))
    j = j.join(flags, "dataset").where(F.col("_e") == F.col("_anye"))
    lower = F.coalesce(T.metric_lower_is_better("target_metric"), F.lit(True))
    score = T.comparison_score("primary_metric_value", lower)
    fill = first_known(j.select("dataset", "leaderboard_reference", *seq), ["dataset"], order, ["leaderboard_reference"])
    best = best_row(j, ["dataset"], [score, *order])
    return best.drop("leaderboard_reference").join(fill, "dataset").drop("_pm", "_lm", "_m", "_e", "_any", "_anye")


# --- ensembles and ablation ------------------------------------------------------------------------------------

def ensemble_vs_base(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Best value of each ensemble method against the best base model of the dataset (smaller is better)."""
    e = df.where(F.col("method").isNotNull()).groupBy(*keys, "method").agg(F.min(value).alias("ensemble_value"))
    b = df.where(F.col("method").isNull()).groupBy(*keys).agg(F.min(value).alias("base_value"))
    j = key_join(e, b, keys)
    delta = F.col("ensemble_value") - F.col("base_value")
    return j.withColumn("delta", delta).withColumn(
        "relative_delta", F.when(F.abs("base_value") > EPS, F.try_divide(F.col("delta"), F.col("base_value"))))


def delta_summary(cmp: DataFrame, by: Sequence[str]) -> DataFrame:
    x = F.col("delta")
    n = F.count(F.lit(1))
    return cmp.groupBy(*by).agg(
        n.alias("datasets_compared"), F.count_if(x < -EPS).alias("beats"), F.count_if(F.abs(x) <= EPS).alias("ties"),
        F.count_if(x > EPS).alias("losses"), (F.count_if(x < -EPS) / n).alias("beats_fraction"),
        F.avg("delta").alias("mean_delta"), median("delta").alias("median_delta"), F.stddev_samp("delta").alias("std_delta"),
        F.min("delta").alias("min_delta"), F.max("delta").alias("max_delta"),
        F.avg("relative_delta").alias("mean_relative_delta"), median("relative_delta").alias("median_relative_delta"))


def head_to_head(methods: DataFrame, keys: Sequence[str], value: str, name: str = "method") -> DataFrame:
    """Wins, ties and losses for every ordered pair of methods on shared datasets (a handful of methods)."""
    a = methods.select(*keys, F.col(name).alias("method_a"), F.col(value).alias("_a"))
    b = methods.select(*keys, F.col(name).alias("method_b"), F.col(value).alias("_b"))
    x = F.col("_a") - F.col("_b")
    return (key_join(a, b, keys).where("method_a < method_b").groupBy("method_a", "method_b").agg(
        F.count(F.lit(1)).alias("datasets_compared"), F.count_if(x < -EPS).alias("method_a_wins"),
        F.count_if(x > EPS).alias("method_b_wins"), F.count_if(F.abs(x) <= EPS).alias("ties"),
        F.avg(x).alias("mean_delta"), median(x).alias("median_delta")))


def overall_superiority(pairs: DataFrame) -> DataFrame:
    side = lambda me, w, l: pairs.select(F.col(me).alias("method"), F.col(w).alias("w"), F.col(l).alias("l"), "ties",
                                         "datasets_compared")
    both = side("method_a", "method_a_wins", "method_b_wins").unionByName(side("method_b", "method_b_wins", "method_a_wins"))
    return both.groupBy("method").agg(
        F.sum("w").alias("pairwise_wins"), F.sum("l").alias("pairwise_losses"), F.sum("ties").alias("pairwise_ties"),
        F.sum("datasets_compared").alias("pairwise_compared"),
        safe_ratio(F.sum("w").cast("double"), F.sum("datasets_compared")).alias("pairwise_win_fraction"))


def fractional_wins(values: DataFrame, keys: Sequence[str], name: str, value: str) -> DataFrame:
    """Each dataset hands out one win, shared equally by all entries within the tolerance of its best value."""
    best = values.groupBy(*keys).agg(F.min(value).alias("_best"))
    tied = key_join(values, best, keys).where(F.abs(F.col(value) - F.col("_best")) <= EPS)
    share = tied.withColumn("_share", 1 / F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    wins = share.groupBy(name).agg(F.sum("_share").alias("weighted_wins"))
    n = best.agg(F.count(F.lit(1)).alias("datasets_considered"))
    all_names = values.select(name).distinct()
    return (all_names.join(wins, name, "left").crossJoin(F.broadcast(n))  # one-row side
            .withColumn("weighted_wins", F.coalesce("weighted_wins", F.lit(0.0)))
            .withColumn("weighted_win_fraction", safe_ratio("weighted_wins", "datasets_considered")))


# Ablation stages and the component added by each.
STAGES = [
    (1, "Conventional ML only", "conventional_ml"),
    (2, "+ MapLight classic features", "maplight_classic"),
    (3, "+ neural/deep backends", "deep_backend"),
    (4, "+ CFA fusion", "cfa"),
    (5, "Full pipeline incl. ensembles", "ensemble"),
]


def staged_ablation(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best row per cumulative stage and dataset with the gain over the stage before.

    A component joins at its stage and stays: rows are reduced to the best per (dataset, first stage) before they are
    repeated for later stages, so the repetition touches at most five rows per dataset.
    """
    start = reduce(lambda acc, s: acc.when(F.col("component") == s[2], s[0]), STAGES[1:],
                   F.when(F.col("component") == STAGES[0][2], STAGES[0][0]))
    names = F.create_map(*[x for s in STAGES for x in (F.lit(s[0]), F.lit(s[1]))])
    cols = [*keys, "task_kind", "model", "workflow", "component", "analysis_metric_value", "analysis_metric_direction",
            "comparison_score"]
    first = best_row(df.select(*cols, start.alias("_from")), [*keys, "_from"],
                     [F.col("comparison_score"), F.col("model")])
    spread = first.withColumn("stage_order", F.explode(F.sequence(F.col("_from"), F.lit(len(STAGES))))).drop("_from")
    best = best_row(spread, [*keys, "stage_order"], [F.col("comparison_score"), F.col("model")])
    w = Window.partitionBy(*keys).orderBy("stage_order")
    prev = F.lag("comparison_score").over(w)
    out = best.withColumns({
        "stage": F.element_at(names, F.col("stage_order")), "previous_stage_score": prev,
        "marginal_gain": prev - F.col("comparison_score"),
        "marginal_relative_gain": T.relative_improvement(
            F.lag("analysis_metric_value").over(w), "analysis_metric_value", F.col("analysis_metric_direction") != "higher"),
        "winner_changed": F.coalesce(F.lag("model").over(w) != F.col("model"), F.lit(False))})
    return out.withColumn("improved", F.coalesce(F.col("marginal_gain") > EPS, F.lit(False)))


def ablation_summary(staged: DataFrame) -> DataFrame:
    n = F.count_distinct("dataset")
    return staged.groupBy("stage_order", "stage").agg(
        n.alias("datasets_evaluated"), F.count_if("improved").alias("datasets_improved"),
        F.count_if("winner_changed").alias("datasets_changed_winner"), median("marginal_gain").alias("median_gain"),
        F.avg("marginal_gain").alias("mean_gain"), median("marginal_relative_gain").alias("median_relative_gain"),
        (F.count_if("improved") / n).alias("improvement_fraction"))


# --- search (tuned variant) value ------------------------------------------------------------------------------

def tuned_vs_baseline(df: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Pair ``X GA`` with its baseline ``X`` or ``Tuned X`` of the same dataset (first baseline row in ``seq`` order)."""
    tuned = df.where(F.col("model").endswith(" GA")).withColumn("_base", F.regexp_replace("model", " GA$", ""))
    names = tuned.select(*keys, "_base", "model", "primary_metric", "primary_metric_value", "test_rmse", *seq).withColumn(
        "baseline_model", F.explode(F.array(F.col("_base"), F.concat(F.lit("Tuned "), F.col("_base")))))
    base = df.where(~F.col("model").endswith(" GA")).select(
        *keys, F.col("model").alias("baseline_model"), F.col("primary_metric").alias("b_metric"),
        F.col("primary_metric_value").alias("b_value"), F.col("test_rmse").alias("b_rmse"),
        F.struct(*seq).alias("_bseq"))
    j = key_join(names, base, [*keys, "baseline_model"])
    one = best_row(j, [*keys, "model", *seq], [F.col("_bseq"), F.col("baseline_model")])
    same = F.lower(F.trim("primary_metric")) == F.lower(F.trim("b_metric"))
    use = same & F.col("primary_metric_value").isNotNull() & F.col("b_value").isNotNull()
    metric = F.when(use, F.lower(F.trim("primary_metric"))).otherwise("rmse")
    gv = F.when(use, F.col("primary_metric_value")).otherwise(F.col("test_rmse"))
    bv = F.when(use, F.col("b_value")).otherwise(F.col("b_rmse"))
    out = one.select(*keys, "model", *seq, "baseline_model", metric.alias("metric"), gv.alias("tuned_value"),
                     bv.alias("baseline_value")).where("tuned_value IS NOT NULL AND baseline_value IS NOT NULL")
    lower = T.metric_lower_by_text("metric")
    delta = F.when(lower, F.col("baseline_value") - F.col("tuned_value")).otherwise(
        F.col("tuned_value") - F.col("baseline_value"))
    return out.withColumns({"lower_is_better": lower, "delta": delta}).withColumns({
        "relative_delta": F.when(F.abs("baseline_value") > EPS, F.col("delta") / F.abs("baseline_value")),
        "tuned_better": F.col("delta") > 0})


def useful_tuned_models(df: DataFrame, keys: Sequence[str], seq: Sequence[Column], min_relative: float = 0.005,
                        min_wins: int = 1, min_improving: int = 1) -> DataFrame:
    """Base models whose tuned variant wins datasets or improves on the base by ``min_relative`` or more."""
    ok = df.where(~has_error("error") & F.col("primary_metric_value").isNotNull())
    name = F.trim("model")
    base_name = F.trim(F.regexp_replace(name, " GA$", ""))
    is_tuned = (F.lower(F.trim("workflow")) == "ga_tuned") & name.endswith(" GA")
    wins = best_rows(df, keys, seq).where(is_tuned).groupBy(base_name.alias("base_model")).agg(
        F.count(F.lit(1)).alias("dataset_wins"))
    lower = F.coalesce(T.metric_lower_is_better(F.coalesce("primary_metric", F.lit("rmse"))), F.lit(True))
    scored = ok.withColumn("_s", T.comparison_score("primary_metric_value", lower))
    base = scored.groupBy(*keys, name.alias("base_model")).agg(F.min("_s").alias("_b"))
    tuned = scored.where(is_tuned).select(*keys, base_name.alias("base_model"), "_s")
    j = key_join(tuned, base, [*keys, "base_model"])
    gain = F.col("_b") - F.col("_s")
    rel = gain / F.when(F.abs("_b") > EPS, F.abs("_b")).otherwise(1.0)
    better = j.where((gain > 0) & (rel >= min_relative)).select(*keys, "base_model").distinct().groupBy(
        "base_model").agg(F.count(F.lit(1)).alias("improving_datasets"))
    both = wins.join(better, "base_model", "full_outer").fillna(0)
    return both.where((F.col("dataset_wins") >= min_wins) | (F.col("improving_datasets") >= min_improving))


# --- cost and value --------------------------------------------------------------------------------------------

def percent_rank_avg(value: str, keys: Sequence[str]) -> Column:
    """Tie-averaged rank over count (not Spark's ``percent_rank``); for report rows."""
    p = Window.partitionBy(*keys)
    ties = F.count(value).over(Window.partitionBy(*keys, value))
    return (F.rank().over(p.orderBy(value)) + (ties - 1) / 2) / F.count(value).over(p)


def cost_performance(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    work = df.where((F.col("elapsed_seconds") > 0) & F.col("analysis_delta_from_best").isNotNull())
    work = work.withColumn("log_elapsed", F.log10(F.greatest("elapsed_seconds", F.lit(1e-9))))
    work = work.withColumns({"performance_percentile": percent_rank_avg("analysis_delta_from_best", keys),
                             "runtime_percentile": percent_rank_avg("log_elapsed", keys)})
    return work.withColumn("cost_performance_score",
                           0.75 * F.col("performance_percentile") + 0.25 * F.col("runtime_percentile"))


def sum_or_null(c: str) -> Column:
    """Null when every value is null (Spark's ``sum`` already is)."""
    return F.sum(c)


def combine_references(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of reference tables with unequal columns; the first table to name an entry wins, blank flags mean true."""
    out = None
    for i, f in enumerate(frames):
        part = f.withColumns({k: strip(k) for k in keys}).withColumn("_frame", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    one = best_row(out, keys, [F.col("_frame")]).drop("_frame")
    return one.withColumn("is_top10_entry", F.coalesce("is_top10_entry", F.lit(True)))


def complete_cases(df: DataFrame, keys: Sequence[str], model: str = "model") -> DataFrame:
    """Datasets on which every model has a row."""
    pairs = df.select(*keys, model).distinct()
    n = pairs.select(model).distinct().agg(F.count(F.lit(1)).alias("_all"))
    g = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("models"))
    return g.crossJoin(F.broadcast(n)).where(F.col("models") == F.col("_all")).drop("_all")  # one-row side


# --- progress and budgets --------------------------------------------------------------------------------------

def stage_durations(df: DataFrame, keys: Sequence[str], order: Sequence[str], started: str, stage: str,
                    rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """A row per stage of each run: how long it took, and how long the stages after it may take.

    A stage ends where the next one of its run starts; the last one is still running and has no duration. ``finished``
    counts the ended stages up to the row, ``remaining`` those that the run has after them, and the estimate is the mean
    duration of the finished ones times the remaining ones. ``started`` is in microseconds, so durations are exact; means are whole microseconds, rounded down. Null
    starts sort first and give null durations.
    """
    c = chained(df.select(*keys, *dict.fromkeys([*order, started, stage])), keys, order, started, rows_per_bucket)
    running = F.col("pos") == F.col("n_rows") - 1
    finished = F.when(running, F.col("pos")).otherwise(F.col("pos") + 1)
    span = F.coalesce("next_value", F.when(running, F.col(started))) - F.col("first_value")
    mean = F.floor(F.try_divide(span, finished))
    remaining = F.col("n_rows") - finished
    return c.select(*keys, *[o for o in order if o != started], F.col(stage).alias("stage"),
                    F.when(running, "running").otherwise("completed").alias("status"),
                    ((F.col("next_value") - F.col(started)) / 1e6).alias("duration_seconds"), finished.alias("finished"),
                    remaining.alias("remaining"), (mean / 1e6).alias("mean_seconds"), (mean * remaining / 1e6).alias("eta_seconds"))


def token_estimate(sizes: DataFrame, n_rows: str, daily_budget: int, folds: int = 5, test_fraction: float = 0.2,
                   max_features: int = 0) -> DataFrame:
    """Cells that a remote model reads per dataset, and whether one day's budget holds them.

    Rows are those of the train side, columns the feature cap or a tenth of the rows (32 at least), and every fold is
    fitted twice, plus one final fit. Halves round to even.
    """
    train = F.greatest(F.rint(F.col(n_rows) * (1.0 - test_fraction)), F.lit(1.0)).cast("long")
    columns = F.lit(max_features).cast("long") if max_features > 0 else F.greatest(
        F.rint(0.1 * F.col("estimated_train_rows")).cast("long"), F.lit(32))
    out = sizes.withColumn("estimated_train_rows", train).withColumn("estimated_columns", columns)
    out = out.withColumn("estimated_fits", F.lit(max(1, 2 * folds + 1)).cast("long"))
    out = out.withColumn("estimated_tokens", F.col("estimated_train_rows") * F.col("estimated_columns") * F.col("estimated_fits"))
    return out.withColumn("fits_daily_budget", F.col("estimated_tokens") <= daily_budget)


def reference_run(metrics: DataFrame, newest: Sequence[Column], min_datasets: int = 5) -> DataFrame:
    """One row: the newest run with enough datasets and tuned rows, else the newest run at all.

    ``newest`` are aggregates over a run's rows, largest first; ties go to the larger run name.
    """
    dataset = F.trim(F.col("dataset").cast("string"))
    tuned = F.coalesce(F.lower(F.trim("workflow")) == "ga_tuned", F.lit(False))
    runs = metrics.groupBy("run_name").agg(
        F.count_distinct(dataset).alias("reference_dataset_count"), F.count_if(tuned).alias("reference_tuned_row_count"),
        F.count(F.lit(1)).alias("reference_rows"), F.struct(*newest).alias("_newest"))
    fit = (F.col("reference_dataset_count") >= min_datasets) & (F.col("reference_tuned_row_count") > 0)
    return runs.orderBy(F.desc(fit), F.desc("_newest"), F.desc("run_name")).limit(1).drop("_newest")


def resolve_tuned_models(requested: str | None, metrics: DataFrame, keys: Sequence[str], seq: Sequence[Column],
                         newest: Sequence[Column], min_datasets: int = 5, **limits) -> DataFrame:
    """Models to tune and why: none if nothing is requested, a stated list, or on ``auto`` what was worth it in an earlier run."""
    spark = metrics.sparkSession
    text = (requested or "").strip()
    schema = "model string, mode string, reference_run string"
    if text.lower() != "auto":
        names = dict.fromkeys(n.strip() for n in text.split(",") if n.strip())
        return spark.createDataFrame([(n, "manual", None) for n in names], schema)
    run = reference_run(metrics, newest, min_datasets).select("run_name")
    rows = metrics.join(F.broadcast(run), "run_name")  # one-row side
    useful = useful_tuned_models(rows, keys, seq, **limits).select(F.col("base_model").alias("model"), F.lit("auto").alias("mode"))
    return useful.crossJoin(F.broadcast(run.withColumnRenamed("run_name", "reference_run")))  # one-row side
