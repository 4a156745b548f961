"""Quality metrics per group from long prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.cleaning import finite
from evalspark.operators.ordering import ROWS_PER_BUCKET, checked_join, key_join, prefix_sums, ranks
from evalspark.session import durable


def rmse(y: str, p: str) -> Column:
    return F.sqrt(F.avg((F.col(y) - F.col(p)) * (F.col(y) - F.col(p))))


def mae(y: str, p: str) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def r2(y: str, p: str) -> Column:
    """1 - SSres/SStot; constant targets give 1 for a perfect fit and 0 otherwise."""
    res = F.sum((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))
    tot = F.var_pop(y) * F.count(y)
    return F.when(tot > 0, 1 - F.try_divide(res, tot)).when(res == 0, 1.0).otherwise(0.0)


def pearson(y: str, p: str) -> Column:
    """Null below two rows or when either side is constant; mergeable moments, never ``corr`` (ANSI division)."""
    varied = (F.count(F.lit(1)) >= 2) & (F.min(y) < F.max(y)) & (F.min(p) < F.max(p))
    return F.when(varied, F.try_divide(F.covar_pop(y, p), F.sqrt(F.var_pop(y)) * F.sqrt(F.var_pop(p))))


def complete(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.withColumns({y: finite(y), p: finite(p)}).where(F.col(y).isNotNull() & F.col(p).isNotNull())


def regression_errors(df: DataFrame, keys: Sequence[str], y: str = "observed", p: str = "predicted") -> DataFrame:
    sq = (F.col(y) - F.col(p)) * (F.col(y) - F.col(p))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(sq).alias("mse"), rmse(y, p).alias("rmse"),
                                 mae(y, p).alias("mae"), r2(y, p).alias("r2"), pearson(y, p).alias("pearson"))


def spearman(df: DataFrame, keys: Sequence[str], y: str = "observed", p: str = "predicted",
             rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Pearson correlation of tie-averaged ranks.

    Identical (observed, predicted) pairs merge first; the two rank tables are joined back by value.
    """
    pairs = df.groupBy(*keys, y, p).agg(F.count(F.lit(1)).alias("_w"))
    out = pairs
    for side, name in ((y, "_ry"), (p, "_rp")):
        r = ranks(df, keys, side, rows_per_bucket)
        centred = (F.col("rank_avg") - (F.col("n_rows") + 1) / 2).alias(name)
        out = key_join(out, r.select(*keys, side, centred), [*keys, side])
    w = F.col("_w")
    sxy, sxx, syy = (F.sum(w * F.col(a) * F.col(b)) for a, b in (("_ry", "_rp"), ("_ry", "_ry"), ("_rp", "_rp")))
    ok = (F.sum(w) >= 2) & (sxx > 0) & (syy > 0)
    return out.groupBy(*keys).agg(F.sum(w).alias("n_rows"),
                                  F.when(ok, F.try_divide(sxy, F.sqrt(sxx) * F.sqrt(syy))).alias("spearman"))


def binary_frame(df: DataFrame, keys: Sequence[str], y: str = "observed", p: str = "predicted") -> DataFrame:
    """Add ``label`` (smaller value 0, larger 1; null unless exactly two values) and ``score`` in [0, 1].

    Scores already inside [0, 1] are used as they are; otherwise all of the group's scores pass a clipped sigmoid.
    """
    stats = df.groupBy(*keys).agg(F.min(y).alias("_y0"), F.max(y).alias("_y1"),
                                  F.min(p).alias("_p0"), F.max(p).alias("_p1"))
    j = checked_join(df, stats, keys)
    unit = (F.col("_p0") >= 0) & (F.col("_p1") <= 1)
    clipped = F.greatest(F.least(F.col(p), F.lit(30.0)), F.lit(-30.0))
    score = F.when(unit, F.col(p)).otherwise(1 / (1 + F.exp(-clipped)))
    label = (F.when(F.col("_y0") == F.col("_y1"), F.lit(None).cast("int"))
             .when(F.col(y) == F.col("_y1"), 1).when(F.col(y) == F.col("_y0"), 0))
    return j.withColumns({"label": label, "score": score}).drop("_y0", "_y1", "_p0", "_p1")


def ranking_metrics(df: DataFrame, keys: Sequence[str], y: str = "observed", p: str = "predicted",
                    rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """ROC-AUC (rank form) and average precision (step form) from cumulative counts over distinct scores."""
    scored = binary_frame(df, keys, y, p)
    c = prefix_sums(scored, keys, "score",
                    {"pos": F.coalesce(F.col("label"), F.lit(0)), "neg": F.coalesce(1 - F.col("label"), F.lit(0)),
                     "bad": F.col("label").isNull().cast("int")}, rows_per_bucket)
    pos, neg = F.col("pos_total"), F.col("neg_total")
    tp, fp = pos - F.col("pos_before"), neg - F.col("neg_before")
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    ap = F.sum(F.col("pos") * F.try_divide(tp, tp + fp))
    g = c.groupBy(*keys).agg(F.max("pos_total").alias("n_pos"), F.max("neg_total").alias("n_neg"),
                             F.max("bad_total").alias("_bad"), wins.alias("_wins"), ap.alias("_ap"))
    ok = (F.col("_bad") == 0) & (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return g.select(*keys, "n_pos", "n_neg",
                    F.when(ok, F.try_divide(F.col("_wins"), (F.col("n_pos") * F.col("n_neg")).cast("double")))
                    .alias("roc_auc"),
                    F.when(ok, F.try_divide(F.col("_ap"), F.col("n_pos").cast("double"))).alias("auprc"))


def _running_counts(keys: Sequence[str]):
    """Rows sorted by keys and score: within the partition and key, the counts before each row."""
    def run(batches):
        last, pos, neg = None, 0, 0
        for pdf in batches:
            if not len(pdf):
                continue
            ids = list(zip(*(pdf[k] for k in keys)))
            new = np.array([True] + [a != b for a, b in zip(ids[1:], ids[:-1])])
            new[0] = ids[0] != last
            start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))  # -1: the key of the batch before goes on
            for name, held in (("pos", pos), ("neg", neg)):
                before = np.concatenate([[0], np.cumsum(pdf[name].to_numpy())])
                pdf[f"{name}_before"] = before[:-1] - np.where(start < 0, -held, before[start])
            last, pos, neg = ids[-1], int(pdf["pos_before"].iloc[-1] + pdf["pos"].iloc[-1]), int(pdf["neg_before"].iloc[-1] + pdf["neg"].iloc[-1])
            yield pdf
    return run


def streamed_ranking(df: DataFrame, keys: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """ROC-AUC and average precision of very many key groups (such as fusion candidates) from one sorted stream.

    ``label`` is 0 or 1. Equal scores merge before the shuffle; one range partitioning by keys and score serves all groups
    at any number and size of them, for a group may span partitions: counts run within each partition, and what the
    partitions before hold of a group (one row per partition and group) is added. Keys must not be null.
    """
    merged = df.groupBy(*keys, score).agg(F.sum(label).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg"))
    by_score = merged.repartitionByRange(*keys, score).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*keys, score)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in by_score.schema.fields)
    stream = durable(by_score.mapInPandas(_running_counts(keys), f"{fields}, pos_before long, neg_before long"))
    held = stream.groupBy(*keys, "_part").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    w = Window.partitionBy(*keys)
    earlier = w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select(*keys, "_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_off") for c in ("_p", "_n")],
                          *[F.sum(c).over(w).alias(f"{c}_all") for c in ("_p", "_n")])
    j = key_join(stream, carried, [*keys, "_part"])
    tp, fp = F.col("_p_all") - F.col("pos_before") - F.col("_p_off"), F.col("_n_all") - F.col("neg_before") - F.col("_n_off")
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("_n_off") + F.col("neg") / 2))
    g = j.groupBy(*keys).agg(F.max("_p_all").alias("n_pos"), F.max("_n_all").alias("n_neg"), wins.alias("_wins"),
                             F.sum(F.col("pos") * F.try_divide(tp, tp + fp)).alias("_ap"))
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return g.select(*keys, "n_pos", "n_neg", F.when(ok, F.try_divide(F.col("_wins"), (F.col("n_pos") * F.col("n_neg")).cast("double"))).alias("roc_auc"),
                    F.when(ok, F.try_divide(F.col("_ap"), F.col("n_pos").cast("double"))).alias("auprc"))


def confusion_metrics(df: DataFrame, keys: Sequence[str], y: str = "observed", p: str = "predicted",
                      threshold: float = 0.5) -> DataFrame:
    """Accuracy, balanced accuracy and Matthews correlation at a score threshold."""
    s = binary_frame(df, keys, y, p)
    hit = F.col("score") >= threshold
    one, zero = F.col("label") == 1, F.col("label") == 0
    g = s.groupBy(*keys).agg(
        F.count_if(one & hit).alias("tp"), F.count_if(zero & ~hit).alias("tn"),
        F.count_if(zero & hit).alias("fp"), F.count_if(one & ~hit).alias("fn"),
        F.count_if(F.col("label").isNull()).alias("_bad"))
    return g.select(*keys, "tp", "tn", "fp", "fn", *confusion_ratios(F.col("_bad") == 0))


def confusion_ratios(ok: Column) -> list[Column]:
    """Accuracy, balanced accuracy and Matthews correlation from the columns tp, tn, fp and fn; null where not ``ok``."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    sens, spec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    both = (F.coalesce(sens, F.lit(0.0)) + F.coalesce(spec, F.lit(0.0)))
    present = sens.isNotNull().cast("int") + spec.isNotNull().cast("int")
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return [F.when(ok, F.try_divide(tp + tn, tp + tn + fp + fn)).alias("accuracy"), F.when(ok, F.try_divide(both, present)).alias("balanced_accuracy"),
            F.when(ok, F.coalesce(F.try_divide(tp * tn - fp * fn, den), F.lit(0.0))).alias("mcc")]


def as_loss(metric: Column, value: Column, mae_value: Column) -> Column:
    """Loss form used by fusion: errors as they are, 1 - score otherwise (MCC mapped to [0, 1] first); failures 1."""
    score = F.when(metric == "mcc", 0.5 * (value + 1)).otherwise(value)
    loss = (F.when(metric.isin("rmse", "mae", "mse"), value)
            .when(metric.isin("r2", "pearson", "spearman", "roc_auc", "auprc", "accuracy", "balanced_accuracy", "mcc"),
                  1 - score).otherwise(mae_value))
    return F.coalesce(finite(loss), F.lit(1.0))


def out_of_fold(df: DataFrame, keys: Sequence[str], y: str = "observed", p: str = "predicted") -> DataFrame:
    """RMSE, MAE and R2 over finite pairs; null below two pairs."""
    g = regression_errors(complete(df, y, p), keys, y, p)
    enough = F.col("n_rows") >= 2
    return g.select(*keys, "n_rows", *[F.when(enough, F.col(c)).alias(c) for c in ("rmse", "mae", "r2")])


def mean_fold_scores(df: DataFrame, keys: Sequence[str], fold: str = "fold", y: str = "observed",
                     p: str = "predicted") -> DataFrame:
    """Mean and spread of per-fold metrics (not pooled over folds)."""
    per = regression_errors(df, [*keys, fold], y, p)
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_folds"), F.avg("rmse").alias("cv_rmse"),
                                  F.avg("mae").alias("cv_mae"), F.avg("r2").alias("cv_r2"),
                                  F.stddev_pop("rmse").alias("cv_rmse_std"))
