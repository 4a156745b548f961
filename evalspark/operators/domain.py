"""Applicability domain: distance to training neighbours, Mahalanobis distance, consensus labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.taxonomy import classify
from evalspark.operators.features import align_to_training, to_long, training_medians
from evalspark.operators.neighbours import nearest_neighbours
from evalspark.operators.ordering import quantiles
from evalspark.session import durable


@dataclass
class DomainReference:
    """Fitted reference: a medians row, a scaling row, the scaled training table and three thresholds."""
    medians: DataFrame
    scaling: DataFrame
    train: DataFrame
    row_id: str
    k: int
    knn_threshold: float | None
    inverse_covariance: np.ndarray | None
    mahalanobis_threshold: float | None
    shrinkage: float | None


def scaling_row(df: DataFrame, features: str) -> DataFrame:
    """One row: per position mean and population deviation (0 becomes 1)."""
    long = to_long(df.select(features), features)
    s = long.groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    entry = F.struct("pos", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s"))
    return s.agg(F.array_sort(F.collect_list(entry)).alias("scaling"))  # one entry per feature


def standardise(df: DataFrame, scaling: DataFrame, features: str) -> DataFrame:
    z = F.zip_with(features, "scaling", lambda x, s: F.coalesce((x - s["m"]) / s["s"], F.lit(0.0)))
    return df.crossJoin(F.broadcast(scaling)).withColumn(features, z).drop("scaling")  # one-row side


def gram_matrix(df: DataFrame, features: str) -> tuple[np.ndarray, int, float]:
    """(sum of x xT, rows, sum of |x|^4): d * d numbers reach the driver; rows are summed inside the tasks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n, quart = None, 0, 0.0
        for pdf in batches:
            if len(pdf):
                x = np.asarray(pdf[features].to_list(), dtype=np.float64)
                g = x.T @ x
                total = g if total is None else total + g
                n += len(x)
                quart += float((np.square(x).sum(axis=1) ** 2).sum())
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total), "n": n, "quart": quart})

    parts = df.select(features).mapInPandas(run, "i long, row array<double>, n long, quart double")
    cells = parts.select("i", "n", "quart", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(
        F.sum("v").alias("v"), F.sum("n").alias("n"), F.sum("quart").alias("quart")).collect()
    d = max(c["i"] for c in cells) + 1
    out = np.zeros((d, d))
    for c in cells:
        out[c["i"], c["j"]] = c["v"]
    return out, int(cells[0]["n"]), float(cells[0]["quart"])


def shrunk_covariance(gram: np.ndarray, n: int, quart: float) -> tuple[np.ndarray, float]:
    """Ledoit-Wolf shrinkage of the covariance of centred rows towards a multiple of the identity."""
    d = len(gram)
    s = gram / n
    mu = np.trace(s) / d
    delta = ((s - mu * np.eye(d)) ** 2).sum() / d
    beta = min((quart / n - (s ** 2).sum()) / (n * d), delta)
    w = 0.0 if delta == 0 or beta <= 0 else beta / delta
    return (1 - w) * s + w * mu * np.eye(d), float(w)


def mahalanobis(df: DataFrame, features: str, inverse: np.ndarray, name: str) -> DataFrame:
    """Squared Mahalanobis distance of centred vectors."""
    @F.pandas_udf("double")
    def dist(col: pd.Series) -> pd.Series:
        x = np.asarray(col.to_list(), dtype=np.float64)
        return pd.Series(np.einsum("ij,jk,ik->i", x, inverse, x) if len(x) else [], dtype="float64")
    return df.withColumn(name, dist(F.col(features)))


def neighbour_means(nn: DataFrame, key: str, skip: int, k: int) -> DataFrame:
    """Mean distance of neighbours ``skip + 1 .. skip + k``."""
    used = (F.col("neighbour_rank") > skip) & (F.col("neighbour_rank") <= skip + k)
    return nn.where(used).groupBy(key).agg(F.avg("distance").alias("mean_distance"))


def _threshold(df: DataFrame, value: str, q: float) -> float:
    one = df.select(F.lit(0).alias("_all"), value)
    return float(quantiles(one, ["_all"], value, [q], ["t"]).first()["t"])


def fit_domain(train: DataFrame, row_id: str, features: str = "features", k: int = 5, knn_quantile: float = 0.95,
               mahalanobis_quantile: float = 0.975, methods: Sequence[str] = ("knn", "mahalanobis")) -> DomainReference:
    """Thresholds are quantiles of the training rows' own distances (nearest neighbour = the row itself, skipped)."""
    medians = durable(training_medians(to_long(train.select(features), features), "pos", "x"))
    filled = align_to_training(train.select(row_id, features), medians, features)
    scaling = durable(scaling_row(filled, features))
    scaled = durable(standardise(filled, scaling, features))
    n = scaled.count()
    if n < 3:
        raise ValueError("a domain needs at least three training rows")
    k = max(1, min(k, n - 1))
    knn_t = inv = m_t = w = None
    if "knn" in methods:
        nn = nearest_neighbours(scaled, scaled, row_id, row_id, features, k + 1)
        knn_t = _threshold(neighbour_means(nn, row_id, 1, k), "mean_distance", knn_quantile)
    if "mahalanobis" in methods:
        cov, w = shrunk_covariance(*gram_matrix(scaled, features))
        inv = np.linalg.pinv(cov)
        m_t = _threshold(mahalanobis(scaled, features, inv, "m"), "m", mahalanobis_quantile)
    return DomainReference(medians, scaling, scaled, row_id, k, knn_t, inv, m_t, w)


def assess_domain(queries: DataFrame, ref: DomainReference, row_id: str, features: str = "features") -> DataFrame:
    """The fitted diagnostics for every query row; rows without a vector keep null scores."""
    valid = queries.where(F.col(features).isNotNull())
    scaled = durable(standardise(align_to_training(valid.select(row_id, features), ref.medians, features), ref.scaling, features))
    out = queries.select(row_id, F.col(features).isNotNull().alias("valid"))
    if ref.knn_threshold is not None:
        nn = nearest_neighbours(scaled, ref.train, row_id, ref.row_id, features, ref.k)
        knn = neighbour_means(nn, row_id, 0, ref.k).withColumnRenamed("mean_distance", "ad_knn_mean_distance")
        out = out.join(knn, row_id, "left").withColumn("ad_knn_in_domain", F.col("ad_knn_mean_distance") <= ref.knn_threshold)
    if ref.inverse_covariance is not None:
        mah = mahalanobis(scaled, features, ref.inverse_covariance, "ad_mahalanobis_distance").drop(features)
        out = out.join(mah, row_id, "left").withColumn(
            "ad_mahalanobis_in_domain", F.col("ad_mahalanobis_distance") <= ref.mahalanobis_threshold)
    return out


# Lowest support ratios of the labels and their wording.
MODERATE_FLOOR = 0.34


def with_consensus(df: DataFrame, flags: Sequence[str], low_ratio: float = 0.75) -> DataFrame:
    """Support count, ratio and concern label over the available domain flags (a missing flag value is no support)."""
    if not flags:
        return df.withColumns({
            "ad_method_support_count": F.lit(0), "ad_method_available_count": F.lit(0),
            "ad_consensus_support_ratio": F.lit(None).cast("double"), "ad_consensus_concern": F.lit("Not assessed"),
            "ad_consensus_interpretation": F.lit("No AD methods were available.")})
    floor = max(MODERATE_FLOOR, min(1.0, low_ratio))
    support = sum((F.coalesce(F.col(f), F.lit(False)).cast("int") for f in flags[1:]),
                  F.coalesce(F.col(flags[0]), F.lit(False)).cast("int"))
    out = df.withColumns({"ad_method_support_count": support, "ad_method_available_count": F.lit(len(flags))})
    ratio = F.col("ad_method_support_count") / F.lit(float(len(flags)))
    label = F.when(ratio >= floor, "Low concern").when(ratio >= MODERATE_FLOOR, "Moderate concern").otherwise("High concern")
    out = out.withColumns({"ad_consensus_support_ratio": ratio, "ad_consensus_concern": label})
    head = F.format_string(f"%d/{len(flags)} AD methods marked this molecule in-domain.", F.col("ad_method_support_count"))
    # Advice per label.
    advice = classify([
        (F.col("ad_consensus_concern") == "Low concern", ""),
        (F.col("ad_consensus_concern") == "Moderate concern", " Use caution and inspect nearest-neighbor chemistry."),
    ], " Treat this as likely out-of-domain and prioritize experimental confirmation.")
    return out.withColumn("ad_consensus_interpretation", F.concat(head, advice))


def interpret_rules(df: DataFrame, rules: dict[str, str], others: Sequence[str] = ()) -> DataFrame:
    """Summary of external rule columns whose text ``ID`` means in-domain.

    ``rules`` maps the roles ``residual``, ``rmse`` and ``calibration`` to columns; ``others`` lists further columns.
    """
    hit = lambda c: F.coalesce(F.col(c).cast("string") == "ID", F.lit(False))
    any_rule = F.lit(False)
    for c in [*rules.values(), *others]:
        any_rule = any_rule | hit(c)
    out = df.withColumn("in_domain_by_any_rule", any_rule)
    if not rules:
        concern = F.when(F.col("in_domain_by_any_rule"), "Low concern").otherwise("High concern")
        return out.withColumn("overall_concern", concern)
    h = {role: hit(c) for role, c in rules.items()}
    count: Column = F.lit(0)
    for x in h.values():
        count = count + x.cast("int")
    out = out.withColumn("id_rule_count", count)
    n = F.col("id_rule_count")
    off = F.lit(False)
    label = F.when(n == 3, "Low concern").when(n == 2, "Moderate concern").otherwise("High concern")
    text = classify([
        (n == 3, "All three rules marked this row in-domain."),
        (h.get("residual", off) & h.get("rmse", off) & ~h.get("calibration", off),
         "Supported by similarity and error rules, but the uncertainty calibration rule flagged caution."),
        (n > 0, "Only partial support was found; use this prediction cautiously."),
    ], "All rules flagged this row as out-of-domain.")
    return out.withColumns({"overall_concern": label, "interpretation": text})


def domain_metadata(train: DataFrame, features: str = "features", k: int = 5, knn_quantile: float = 0.95,
                    mahalanobis_quantile: float = 0.975, low_ratio: float = 0.75, **settings: object) -> DataFrame:
    """One row: the reference's size and settings, and the same as a JSON text ``metadata``.

    Width is that of the widest vector (0 without rows); further settings follow in the JSON in the order given.
    """
    size = train.agg(F.count(F.lit(1)).alias("n_training_chemicals"), F.coalesce(F.max(F.size(features)), F.lit(0)).cast("long").alias("n_features"))
    fixed = {"knn_neighbors": k, "knn_quantile": knn_quantile, "mahalanobis_quantile": mahalanobis_quantile,
             "low_concern_support_ratio": low_ratio, **settings}
    out = size.select("*", *[F.lit(v).alias(n) for n, v in fixed.items()])
    return out.withColumn("metadata", F.to_json(F.struct(*out.columns)))
