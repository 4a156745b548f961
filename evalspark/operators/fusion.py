"""Combinatorial fusion: every subset of models, three weightings, score and rank space.

Fused values are linear in the members' predictions (or ranks) and weights sum to one, so squared-error losses of all
subsets follow from one table of error products per dataset: a single pass over the rows, whatever the number of
subsets. Absolute and threshold losses spread each row over the candidates and aggregate map-side; losses on ranks sort
the scores of all candidates in one stream.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators import metrics as M
from evalspark.operators.ensemble import member_vectors
from evalspark.operators.joins import model_pairs
from evalspark.operators.ordering import ROWS_PER_BUCKET, best_row, key_join, ranks, row_numbers
from evalspark.session import durable

EPS = 1e-12
VARIANTS = ("ac", "wcp", "wcds")
ERRORS = ("rmse", "mse", "mae")
RANKED = ("roc_auc", "auprc")
THRESHOLDED = ("accuracy", "balanced_accuracy", "mcc")


def subset_count(n_models: int, min_models: int = 2, max_models: int | None = None) -> int:
    if n_models <= 0:
        return 0
    low = max(1, min_models)
    high = n_models if max_models is None else max(low, min(max_models, n_models))
    return sum(math.comb(n_models, k) for k in range(low, high + 1))


def subset_total(n_models: str) -> Column:
    """Number of subsets of two models or more, exact; null where it does not fit a long (from 63 models on)."""
    n = F.col(n_models)
    return F.when(n < 63, F.expr(f"shiftleft(1L, CAST(`{n_models}` AS INT))") - 1 - n)


def max_models_for_budget(n_models: int, min_models: int = 2, requested: int | None = None,
                          budget: int | None = None) -> tuple[int, int]:
    """Largest subset size whose subset count stays within ``budget`` (never below ``min_models``)."""
    if n_models <= 0:
        return 0, 0
    low = max(1, min_models)
    high = max(low, min(requested or n_models, n_models))
    while budget and high > low and subset_count(n_models, low, high) > budget:
        high -= 1
    return high, subset_count(n_models, low, high)


def fusion_table(pred: DataFrame, keys: Sequence[str], row: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Aligned long table with the model's index, prediction and descending average rank per split."""
    x = member_vectors(pred, keys, row)
    zipped = F.posexplode(F.arrays_zip("models", "features")).alias("idx", "_e")
    long = x.select(*keys, "split", *row, "observed", zipped).select(
        *keys, "split", *row, "observed", "idx", F.col("_e.models").alias("model"), F.col("_e.features").alias("predicted"))
    r = ranks(long, [*keys, "split", "model"], "predicted", rows_per_bucket).select(
        *keys, "split", "model", "predicted", (F.col("n_rows") + 1 - F.col("rank_avg")).alias("rank_down"))
    return key_join(long, r, [*keys, "split", "model", "predicted"])


def aligned_rows(table: DataFrame, keys: Sequence[str], row: Sequence[str]) -> DataFrame:
    """One row per split and row of a fusion table: ``observed`` and the members ``_e`` by model index."""
    entry = F.array_sort(F.collect_list(F.struct("idx", "predicted", "rank_down")))  # one entry per model
    return table.groupBy(*keys, "split", *row).agg(F.min("observed").alias("observed"), entry.alias("_e"))


def profile_diversity(train: DataFrame, keys: Sequence[str], row: Sequence[str],
                      rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Mean squared distance of the sorted, min-max scaled predictions of every model pair (both directions)."""
    ends = train.groupBy(*keys, "model").agg(F.min("predicted").alias("_lo"), (F.max("predicted") - F.min("predicted")).alias("_span"))
    pos = row_numbers(train.select(*keys, "model", "predicted", *row), [*keys, "model"], ["predicted", *row], "_i", rows_per_bucket)
    scaled = key_join(pos, ends, [*keys, "model"]).withColumn(
        "z", F.when(F.col("_span") > EPS, (F.col("predicted") - F.col("_lo")) / F.col("_span")).otherwise(0.0))
    p = model_pairs(scaled, keys, ["_i"], "model", "z").groupBy(*keys, "model_a", "model_b").agg(
        F.avg((F.col("value_a") - F.col("value_b")) * (F.col("value_a") - F.col("value_b"))).alias("cd"))
    flip = p.select(*keys, F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"), "cd")
    return p.unionByName(flip)


def base_strengths(train: DataFrame, keys: Sequence[str], diversity: DataFrame, metric: str = "rmse") -> DataFrame:
    """Loss, 1 / loss and mean diversity per model; diversity counts as 1 where all of it vanishes."""
    e = M.regression_errors(train, [*keys, "model", "idx"])
    if metric in ERRORS:
        loss = M.as_loss(F.lit(metric), F.col(metric), F.col("mae"))
    else:
        of = M.ranking_metrics if metric in RANKED else M.confusion_metrics
        e = key_join(e, of(train, [*keys, "model", "idx"]).select(*keys, "model", "idx", metric), [*keys, "model", "idx"])
        loss = M.as_loss(F.lit(metric), F.col(metric), F.col("mae"))
    d = diversity.groupBy(*keys, F.col("model_a").alias("model")).agg(F.avg("cd").alias("_d"))
    top = d.groupBy(*keys).agg(F.max("_d").alias("_top"))
    j = key_join(key_join(e, d, [*keys, "model"], "left"), top, keys, "left")
    return j.select(*keys, "model", "idx", loss.alias("train_metric"), (1 / F.greatest(loss, F.lit(EPS))).alias("performance_strength"),
                    F.when(F.coalesce("_top", F.lit(0.0)) > EPS, F.coalesce("_d", F.lit(0.0))).otherwise(1.0)
                    .alias("diversity_strength"))


def subset_weights(strengths: DataFrame, keys: Sequence[str], min_models: int = 2, max_models: int | None = None) -> DataFrame:
    """(keys, mask, variant) with the weight array by model index: one row per candidate, none of them on the driver.

    Subsets grow one model at a time (each takes a model after its last one), up to ``max_models``: only subsets of the
    wanted sizes are ever made, spread over rows. A mask has 63 bits; more models in one dataset raise.
    """
    entry = F.struct("idx", "model", "performance_strength", "diversity_strength")
    m = durable(strengths.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_m")).withColumn("_n", F.size("_m")))
    most = m.agg(F.max("_n")).first()[0] or 0
    if most > 63:
        raise ValueError(f"{most} models in one dataset: a subset mask holds 63")
    low = max(1, min_models)
    high = max(low, most if max_models is None else min(max_models, most))
    grown = m.withColumns({"mask": F.lit(0).cast("long"), "_next": F.lit(0)})
    levels = []
    for size in range(1, high + 1):
        last = F.explode(F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: i >= F.col("_next")))
        grown = grown.withColumn("_i", last).withColumns({
            "mask": F.col("mask").bitwiseOR(F.expr("shiftleft(1L, _i)")), "_next": F.col("_i") + 1}).drop("_i")
        if size >= low:
            levels.append(grown.drop("_next").withColumn("n_models", F.lit(size)))
    masks = levels[0]
    for level in levels[1:]:
        masks = masks.unionByName(level)
    inside = lambda e: F.getbit(F.col("mask"), e["idx"]) == 1
    raw = {"ac": lambda e: F.lit(1.0), "wcp": lambda e: e["performance_strength"], "wcds": lambda e: e["diversity_strength"]}
    masked = lambda f: F.transform("_m", lambda e: F.when(inside(e), f(e)).otherwise(0.0))
    options = F.array(*[F.struct(F.lit(v).alias("variant"), masked(f).alias("w")) for v, f in raw.items()])
    out = masks.withColumn("_v", F.explode(options))
    w = F.col("_v.w")
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    out = out.withColumn("_t", total)
    even = F.transform("_m", lambda e: F.when(inside(e), 1.0).otherwise(0.0) / F.col("n_models"))
    names = F.array_join(F.transform(F.filter("_m", inside), lambda e: e["model"]), "|")
    return out.select(*keys, "mask", "n_models", names.alias("models"), F.col("_v.variant").alias("variant"),
                      F.when(F.abs("_t") > EPS, F.transform(w, lambda x: x / F.col("_t"))).otherwise(even).alias("weights"))


def subset_diversity(diversity: DataFrame, strengths: DataFrame, masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean pair distance inside each subset."""
    idx = strengths.select(*keys, "model", "idx")
    a = key_join(diversity.where("model_a < model_b"), idx.withColumnsRenamed({"model": "model_a", "idx": "ia"}), [*keys, "model_a"])
    b = key_join(a, idx.withColumnsRenamed({"model": "model_b", "idx": "ib"}), [*keys, "model_b"])
    pairs = b.groupBy(*keys).agg(F.collect_list(F.struct("ia", "ib", "cd")).alias("_p"))  # one entry per model pair
    j = key_join(masks.select(*keys, "mask").distinct(), pairs, keys, "left")
    hit = F.filter("_p", lambda p: (F.getbit(F.col("mask"), p["ia"]) == 1) & (F.getbit(F.col("mask"), p["ib"]) == 1))
    total = F.aggregate(hit, F.lit(0.0), lambda acc, p: acc + p["cd"])
    return j.select(*keys, "mask", F.coalesce(F.try_divide(total, F.size(hit)), F.lit(0.0)).alias("subset_diversity"))


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _short_dot(a: Column, b: Column, width: int) -> Column:
    """The same sum for arrays of at most ``width`` entries, written out: it is compiled, a lambda is not."""
    term = lambda i: F.when(F.size(a) > i, F.get(a, F.lit(i)) * F.get(b, F.lit(i))).otherwise(0.0)
    return reduce(lambda acc, i: acc + term(i), range(width), F.lit(0.0))


def _quadratic(w, matrix):
    return _dot(w, F.transform(matrix, lambda row: _dot(row, w)))


def _matrix_rows(pairs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    rows = pairs.groupBy(*keys, "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", value))), lambda s: s[value]).alias("r"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda s: s["r"]).alias(value))


def squared_losses(train: DataFrame, candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RMSE of every candidate in both spaces from error products and rank covariances, plus the rank calibration.

    ``train`` holds aligned rows.
    """
    both = train.select(*keys, "observed", F.explode("_e").alias("a"), "_e").select(
        *keys, "observed", "a", F.explode("_e").alias("b"))
    y = F.col("observed")
    mom = durable(both.groupBy(*keys, F.col("a.idx").alias("i"), F.col("b.idx").alias("j")).agg(
        F.avg((F.col("a.predicted") - y) * (F.col("b.predicted") - y)).alias("err"),
        F.covar_pop("a.rank_down", "b.rank_down").alias("rcov"), F.covar_pop("a.rank_down", "observed").alias("ry"),
        F.avg("a.rank_down").alias("rmean"), F.var_pop("observed").alias("yvar"), F.avg("observed").alias("ymean")))
    diag = mom.where("i = j").groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "ry"))), lambda s: s["ry"]).alias("ry"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "rmean"))), lambda s: s["rmean"]).alias("rmean"),
        F.max("yvar").alias("yvar"), F.max("ymean").alias("ymean"))
    facts = key_join(key_join(_matrix_rows(mom, keys, "err"), _matrix_rows(mom, keys, "rcov"), keys), diag, keys)
    j = key_join(candidates, facts, keys)
    w = F.col("weights")
    score = F.sqrt(F.greatest(_quadratic(w, F.col("err")), F.lit(0.0)))
    svar, sy, smean = _quadratic(w, F.col("rcov")), -_dot(w, F.col("ry")), -_dot(w, F.col("rmean"))
    slope = F.when(F.abs("_sv") > EPS, F.col("_sy") / F.col("_sv")).otherwise(0.0)
    left = F.when(F.abs("_sv") > EPS, F.col("yvar") - F.col("_sy") * F.col("_sy") / F.col("_sv")).otherwise(F.col("yvar"))
    j = j.withColumns({"_sv": svar, "_sy": sy, "_sm": smean, "_score": score})
    return j.select(*candidates.columns, F.col("_score").alias("score"), F.sqrt(F.greatest(left, F.lit(0.0))).alias("rank"),
                    slope.alias("slope"), (F.col("ymean") - slope * F.col("_sm")).alias("intercept"))


def absolute_losses(train: DataFrame, calibrated: DataFrame, keys: Sequence[str], n_models: int) -> DataFrame:
    """MAE of every candidate of at most ``n_models`` models: aligned rows meet the candidate list and are averaged
    map-side (no row leaves its task)."""
    g = train.select(
        *keys, "observed", F.transform("_e", lambda e: e["predicted"]).alias("p"), F.transform("_e", lambda e: e["rank_down"]).alias("r"))
    j = key_join(g, calibrated.select(*keys, "mask", "variant", "weights", "slope", "intercept"), keys)
    fused = _short_dot(F.col("weights"), F.col("p"), n_models)
    ranked = F.col("intercept") - F.col("slope") * _short_dot(F.col("weights"), F.col("r"), n_models)
    out = j.groupBy(*keys, "mask", "variant").agg(F.avg(F.abs(F.col("observed") - fused)).alias("score"),
                                                  F.avg(F.abs(F.col("observed") - ranked)).alias("rank"))
    return key_join(calibrated.drop("score", "rank"), out, [*keys, "mask", "variant"])


def class_losses(train: DataFrame, calibrated: DataFrame, keys: Sequence[str], metric: str, digits: int = 9) -> DataFrame:
    """1 - score of every candidate and space for a metric on two classes (MCC mapped to [0, 1] first); 1 where it has none.

    Aligned rows meet the candidates of their dataset and become (candidate, score) counts in their task. Scores are rounded to
    ``digits``, so that sums of equal parts in another order still tie.
    """
    ends = train.groupBy(*keys).agg(F.min("observed").alias("_y0"), F.max("observed").alias("_y1"), F.count_if(F.col("observed").isNull()).alias("_none"))
    j = key_join(train, ends, keys)
    label = F.when((F.col("_y0") < F.col("_y1")) & (F.col("_none") == 0), F.when(F.col("observed") == F.col("_y1"), 1).when(F.col("observed") == F.col("_y0"), 0))
    data = j.select(*keys, label.alias("label"), F.transform("_e", lambda e: e["predicted"]).alias("p"), F.transform("_e", lambda e: e["rank_down"]).alias("r"))
    spaces = F.array(F.struct(F.lit("score").alias("space"), F.lit(0.0).alias("a"), F.lit(1.0).alias("b")), F.struct(F.lit("rank").alias("space"), F.col("intercept").alias("a"), (-F.col("slope")).alias("b")))
    entered = calibrated.select(*keys, "mask", "variant", "weights", F.explode(spaces).alias("s")).select(*keys, "mask", "variant", "weights", "s.*")
    one = [*keys, "mask", "variant", "space"]
    value = lambda: F.round(F.col("a") + F.col("b") * _dot(F.col("weights"), F.when(F.col("space") == "rank", F.col("r")).otherwise(F.col("p"))), digits)
    raw = key_join(data, entered, keys).select(*one, "label", value().alias("score"))
    # Scores outside [0, 1] pass the sigmoid, by candidate: its range decides, one row per candidate.
    span = durable(raw.groupBy(*one).agg(F.min("score").alias("_p0"), F.max("score").alias("_p1"), F.count_if(F.col("label").isNull()).alias("_bad")))
    ranged = key_join(data, key_join(entered, span, one), keys).withColumn("v", value())
    clipped = F.greatest(F.least(F.col("v"), F.lit(30.0)), F.lit(-30.0))
    scored = ranged.where("_bad = 0").select(*one, "label", F.when((F.col("_p0") >= 0) & (F.col("_p1") <= 1), F.col("v")).otherwise(1 / (1 + F.exp(-clipped))).alias("score"))
    if metric in RANKED:
        found = M.streamed_ranking(scored, one).select(*one, metric)
    else:
        hit, pos = F.col("score") >= 0.5, F.col("label") == 1
        counts = scored.groupBy(*one).agg(F.count_if(pos & hit).alias("tp"), F.count_if(~pos & ~hit).alias("tn"), F.count_if(~pos & hit).alias("fp"), F.count_if(pos & ~hit).alias("fn"))
        found = counts.select(*one, *M.confusion_ratios(F.lit(True))).select(*one, metric)
    loss = M.as_loss(F.lit(metric), F.col(metric), F.lit(1.0))
    sides = found.groupBy(*keys, "mask", "variant").agg(F.max(F.when(F.col("space") == "score", loss)).alias("score"), F.max(F.when(F.col("space") == "rank", loss)).alias("rank"))
    out = key_join(calibrated.drop("score", "rank"), sides, [*keys, "mask", "variant"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(1.0)) for c in ("score", "rank")})


def candidate_table(pred: DataFrame, keys: Sequence[str], row: Sequence[str], metric: str = "rmse", min_models: int = 2,
                    max_models: int | None = None, rank_space: bool = True, diverse_from: float = 0.15,
                    discount: float = 0.98, table: DataFrame | None = None,
                    rows_per_bucket: int = ROWS_PER_BUCKET, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates with train and adjusted loss, base strengths). ``rows`` may be the stored aligned rows of ``table``.

    ``metric``: rmse, mse, mae, or for two classes roc_auc, auprc, accuracy, balanced_accuracy, mcc; any other name raises.
    """
    if metric not in (*ERRORS, *RANKED, *THRESHOLDED):
        raise ValueError(f"fusion has no losses for metric {metric!r}")
    t = table if table is not None else durable(fusion_table(pred, keys, row, rows_per_bucket))
    train = t.where("split = 'train'")
    # One row per model (pair), read by several later steps: stored once instead of recomputed from the rows.
    div = durable(profile_diversity(train, keys, row, rows_per_bucket))
    base = durable(base_strengths(train, keys, div, metric))
    cand = subset_weights(base, keys, min_models, max_models)
    if rows is None:
        rows = aligned_rows(train, keys, row)
        rows = rows if metric in ("rmse", "mse") else durable(rows)  # read once, else several times
    train_rows = rows.where("split = 'train'").select(*keys, *row, "observed", "_e")
    losses = squared_losses(train_rows, cand, keys)
    if metric == "mae":
        losses = absolute_losses(train_rows, losses, keys, (base.agg(F.max("idx")).first()[0] or 0) + 1)
    elif metric not in ERRORS:
        losses = class_losses(train_rows, durable(losses), keys, metric)
    elif metric == "mse":
        losses = losses.withColumns({"score": F.col("score") * F.col("score"), "rank": F.col("rank") * F.col("rank")})
    j = key_join(losses, subset_diversity(div, base, cand, keys), [*keys, "mask"])
    spaces = [F.struct(F.lit("score").alias("space"), F.col("score").alias("loss"), F.col("score").alias("adj"))]
    if rank_space:
        adj = F.when(F.col("subset_diversity") >= diverse_from, F.col("rank") * discount).otherwise(F.col("rank"))
        spaces.append(F.struct(F.lit("rank").alias("space"), F.col("rank").alias("loss"), adj.alias("adj")))
    long = j.withColumn("_s", F.explode(F.array(*spaces)))
    is_rank = F.col("_s.space") == "rank"
    return long.select(*keys, "mask", "n_models", "models", F.col("_s.space").alias("combination_space"),
                       F.concat_ws("_", "_s.space", "variant").alias("variant"), F.col("_s.loss").alias("train_metric"),
                       F.col("_s.adj").alias("adjusted_metric"), "subset_diversity", "weights",
                       F.when(is_rank, F.col("slope")).alias("slope"), F.when(is_rank, F.col("intercept")).alias("intercept")), base


def choose(candidates: DataFrame, keys: Sequence[str], digits: int | None = None) -> DataFrame:
    """One candidate per dataset: adjusted loss, train loss, fewer models, space, variant, model names."""
    loss = lambda c: F.round(c, digits) if digits else F.col(c)
    return best_row(candidates, keys, [loss("adjusted_metric"), loss("train_metric"), F.col("n_models"), F.col("combination_space"),
                                       F.col("variant"), F.col("models")])


def fuse(table: DataFrame, chosen: DataFrame, keys: Sequence[str], row: Sequence[str], rows: DataFrame | None = None) -> DataFrame:
    """Predictions of the chosen candidate for train and test rows. ``rows`` may be the stored aligned rows of ``table``."""
    g = rows if rows is not None else aligned_rows(table, keys, row)
    j = key_join(g, chosen.select(*keys, "combination_space", "weights", "slope", "intercept"), keys)
    p, r = F.transform("_e", lambda e: e["predicted"]), F.transform("_e", lambda e: e["rank_down"])
    value = F.when(F.col("combination_space") == "rank", F.col("intercept") - F.col("slope") * _dot(F.col("weights"), r)).otherwise(
        _dot(F.col("weights"), p))
    return j.select(*keys, "split", *row, "observed", value.alias("predicted"))
