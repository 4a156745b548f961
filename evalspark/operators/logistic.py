"""Many small logistic regressions at once, and stacking of class scores with them.

All fits of all datasets (one per fold left out, one on everything) take their Newton steps together: a pass over the
stored rows sums, per dataset and fit, gradient and Hessian in each task and sends one small matrix per fit on. A fit
leaves the passes once it has settled, so later passes read only the datasets that still move.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.operators.ensemble import member_vectors
from evalspark.operators.linear import linear_prediction, summed_rows
from evalspark.operators.ordering import ROWS_PER_BUCKET, key_join, row_numbers
from evalspark.operators.splits import seeded_order
from evalspark.session import durable

MAX_STEPS = 100


def class_plan(df: DataFrame, keys: Sequence[str], target: str, folds: int = 5) -> DataFrame:
    """Per dataset the two class values, their counts, the fold count and how stacking can be done.

    ``method``: ``out_of_fold`` with at least two rows of each of two classes, ``no_folds`` with two classes of which one
    has a single row, ``average`` otherwise. Folds are at most the rows of the smaller class.
    """
    values = df.groupBy(*keys, target).agg(F.count(F.lit(1)).alias("_n"))
    low, high = F.min(F.struct(target, "_n")).alias("_low"), F.max(F.struct(target, "_n")).alias("_high")
    g = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("classes"), F.sum("_n").alias("n_rows"), low, high)
    fewest = F.least("_low._n", "_high._n")
    method = F.when(F.col("classes") != 2, "average").when(fewest < 2, "no_folds").otherwise("out_of_fold")
    return g.select(*keys, "classes", "n_rows", F.col(f"_low.{target}").alias("low"), F.col(f"_high.{target}").alias("high"), method.alias("method"),
                    F.when(method == "out_of_fold", F.least(F.lit(max(2, folds)), fewest)).otherwise(0).cast("long").alias("folds"))


def class_folds(df: DataFrame, keys: Sequence[str], row_id: str, label: str, folds: str = "folds", seed: int = 42,
                rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Stratified ``fold``: rows are counted through class by class in seeded hash order, modulo the dataset's fold count.

    Every class and every fold as a whole is so dealt evenly, to one row.
    """
    slim = df.select(*keys, row_id, label, folds).withColumn("_h", seeded_order(row_id, seed))
    pos = row_numbers(slim, keys, [label, "_h", row_id], "_i", rows_per_bucket)
    return key_join(df, pos.select(*keys, row_id, F.pmod(F.col("_i"), F.col(folds)).alias("fold")), [*keys, row_id])


def _plain(value):
    return None if pd.isna(value) else value


def _sums(keys: Sequence[str]):
    """One pass: per dataset and active fit the rows of (Hessian, gradient, loss) of this task's rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf.groupby(list(keys), sort=False, dropna=False):
                x, y, fold = np.array(part["_x"].to_list(), np.float64), part["_y"].to_numpy(np.float64), part["fold"].to_numpy()
                for fit in part["_fits"].iloc[0]:
                    use = fold != fit["fit"]
                    xf, yf = x[use], y[use]
                    z = xf @ np.asarray(fit["coef"])
                    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                    loss = float((np.logaddexp(0, z) - yf * z).sum())
                    m = np.column_stack([xf.T @ (xf * (p * (1 - p))[:, None]), xf.T @ (p - yf), np.full(x.shape[1], loss)])
                    at = (*key, int(fit["fit"]))
                    sums[at] = sums.get(at, 0.0) + m
        for at, m in sums.items():
            yield pd.DataFrame({**{k: pd.Series([_plain(v)] * len(m), dtype=object) for k, v in zip([*keys, "fit"], at)}, "i": np.arange(len(m)), "row": list(m)})
    return run


def _newton(names: Sequence[str], penalty: float, tolerance: float):
    """The next coefficients of one fit; a step that did not lower the objective is halved."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.vstack(pdf.sort_values("i")["row"].to_list())
        d = len(m)
        first = pdf.iloc[0]
        w, best = np.asarray(first["coef"], np.float64), np.asarray(first["best"], np.float64)
        loss = m[0, d + 1] + 0.5 * penalty * w @ w
        if loss > first["best_loss"] + 1e-9 * (1 + abs(first["best_loss"])):
            new = (w + best) / 2
            loss, step = first["best_loss"], np.abs(new - best).max()
        else:
            new = w - np.linalg.solve(m[:, :d] + penalty * np.eye(d), m[:, d] + penalty * w)
            best, step = w, np.abs(new - w).max()
        settled = bool(step <= tolerance * (1 + np.abs(new).max()))
        out = {n: _plain(first[n]) for n in names if n not in ("coef", "best")}
        out |= {"coef": new.tolist(), "best": best.tolist(), "best_loss": float(loss), "steps": int(first["steps"]) + 1, "settled": settled}
        return pd.DataFrame([{n: out[n] for n in names}]).astype({n: object for n in names if out[n] is None or isinstance(out[n], str)})
    return run


def logistic_fits(df: DataFrame, keys: Sequence[str], features: str, label: str, penalty: float = 1.0, tolerance: float = 1e-9,
                  max_steps: int = MAX_STEPS) -> DataFrame:
    """Per dataset and fit (``fit``: the fold left out, or -1): ``coef`` (intercept first), ``steps``.

    ``df`` has a 0/1 label, a number ``fold`` (negative where there are none: then only fit -1 is made) and an array of
    equally many features per dataset. The sum of log losses plus ``penalty`` / 2 times the squared coefficients, intercept
    included, is lowest at the result. Raises if a fit has not settled after ``max_steps``.
    """
    x = durable(df.select(*keys, F.col("fold").cast("long").alias("fold"), F.col(label).cast("double").alias("_y"),
                          F.concat(F.array(F.lit(1.0)), F.col(features).cast("array<double>")).alias("_x")))
    zero = F.array_repeat(F.lit(0.0), F.col("_d"))
    plan = x.groupBy(*keys).agg(F.max(F.size("_x")).alias("_d"), F.max("fold").alias("_top"))
    fits = F.explode(F.concat(F.array(F.lit(-1).cast("long")), F.when(F.col("_top") >= 0, F.sequence(F.lit(0).cast("long"), "_top")).otherwise(F.array().cast("array<bigint>"))))
    state = durable(plan.select(*keys, fits.alias("fit"), zero.alias("coef"), zero.alias("best"), F.lit(float("inf")).alias("best_loss"), F.lit(0).cast("long").alias("steps"),
                                F.lit(False).alias("settled")))
    key_fields = [f for f in df.schema.fields if f.name in keys]
    part = T.StructType([*key_fields, T.StructField("fit", T.LongType()), T.StructField("i", T.LongType()), T.StructField("row", T.ArrayType(T.DoubleType()))])
    done = None
    for _ in range(max_steps):
        moving = state.where("not settled")
        asked = moving.groupBy(*keys).agg(F.collect_list(F.struct("fit", "coef")).alias("_fits"))  # one entry per fold
        sums = summed_rows(key_join(x, asked, keys).mapInPandas(_sums(keys), part), [*keys, "fit"])
        state = durable(key_join(sums, moving, [*keys, "fit"]).groupBy(*keys, "fit").applyInPandas(_newton(state.columns, penalty, tolerance), state.schema))
        settled = state.where("settled").select(*keys, "fit", "coef", "steps")
        done = settled if done is None else done.unionByName(settled)
        if not state.where("not settled").limit(1).count():
            return done
    raise RuntimeError(f"logistic fits did not settle in {max_steps} steps")


def class_stack(pred: DataFrame, keys: Sequence[str], row_id: str, folds: int = 5, penalty: float = 1.0, seed: int = 42,
                rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, DataFrame]:
    """Stacking of class scores: (predictions, weights), both with the ``method`` that the dataset allowed.

    Train rows get the probability of the larger class from the fit that left their fold out, test rows from the fit on
    all train rows; with ``no_folds`` train rows too take the latter, with ``average`` all rows take the members' mean.
    """
    x = member_vectors(pred, keys, [row_id])
    train = x.where("split = 'train'")
    plan = durable(class_plan(train, keys, "observed", folds))
    planned = key_join(train, plan, keys).withColumn("_label", (F.col("observed") == F.col("high")).cast("int"))
    dealt = class_folds(planned.where("method = 'out_of_fold'"), keys, row_id, "_label", seed=seed, rows_per_bucket=rows_per_bucket)
    whole = planned.where("method = 'no_folds'").withColumn("fold", F.lit(-2).cast("long"))
    fitted = durable(dealt.unionByName(whole))
    coef = durable(logistic_fits(fitted, keys, "features", "_label", penalty))
    probability = 1 / (1 + F.exp(-linear_prediction()))
    cols = [*keys, "split", row_id, "observed", "predicted", "method"]
    own_fit = F.when(F.col("fold") >= 0, F.col("fold")).otherwise(-1)
    known = fitted.withColumn("fit", own_fit)
    tr = key_join(known, coef, [*keys, "fit"]).withColumn("predicted", probability).select(*cols)
    last = coef.where("fit = -1").select(*keys, "coef")
    te = key_join(key_join(x.where("split = 'test'"), last, keys), plan.select(*keys, "method"), keys).withColumn("predicted", probability).select(*cols)
    mean = F.aggregate("features", F.lit(0.0), lambda a, v: a + v) / F.size("features")
    plain = key_join(x, plan.where("method = 'average'").select(*keys, "method"), keys).withColumn("predicted", mean).select(*cols)
    models = x.groupBy(*keys).agg(F.max("models").alias("models"))
    w = F.when(F.col("method") == "average", F.transform("models", lambda m: 1.0 / F.size("models"))).otherwise(F.slice("coef", F.lit(2), F.size("models")))
    named = key_join(key_join(plan, models, keys), last, keys, "left").withColumn("_w", w)
    total = F.aggregate(F.transform("_w", lambda c: F.abs(c)), F.lit(0.0), lambda a, c: a + c)
    long = named.select(*keys, "method", "folds", total.alias("_t"), F.explode(F.arrays_zip("models", "_w")).alias("_e"))
    weights = long.select(*keys, "method", "folds", F.col("_e.models").alias("model"), F.col("_e._w").alias("weight"),
                          F.coalesce(F.try_divide(F.abs("_e._w"), F.col("_t")), F.lit(0.0)).alias("abs_normalized_contribution"))
    return tr.unionByName(te).unionByName(plain), weights
