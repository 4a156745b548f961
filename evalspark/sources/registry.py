"""Benchmark registry as a small table of suites, ids, column roles and split/metric hints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Public single-prediction benchmarks (suite, id, task, split, metric).
ENTRIES = [
    ("tdc", "caco2_wang", "regression", "scaffold", "mae"),
    ("tdc", "lipophilicity_astrazeneca", "regression", "scaffold", "mae"),
    ("tdc", "solubility_aqsoldb", "regression", "scaffold", "mae"),
    ("tdc", "ppbr_az", "regression", "scaffold", "mae"),
    ("tdc", "vdss_lombardo", "regression", "scaffold", "spearman"),
    ("tdc", "half_life_obach", "regression", "scaffold", "spearman"),
    ("tdc", "clearance_hepatocyte_az", "regression", "scaffold", "spearman"),
    ("tdc", "clearance_microsome_az", "regression", "scaffold", "spearman"),
    ("tdc", "ames", "classification", "scaffold", "roc_auc"),
    ("tdc", "herg", "classification", "scaffold", "roc_auc"),
    ("moleculenet", "esol_delaney", "regression", "scaffold", "rmse"),
    ("moleculenet", "freesolv_sampl", "regression", "random", "rmse"),
]
COLUMNS = "benchmark_suite string, benchmark_id string, task_type string, recommended_split string, recommended_metric string"


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTRIES, COLUMNS)


def with_catalog_defaults(df: DataFrame, catalog: DataFrame, columns: list[str]) -> DataFrame:
    """Fill empty fields from the catalog row ``tdc_<name>``, else from the row ``<name>``."""
    name = F.lower(F.trim("dataset"))
    a = catalog.select(F.lower("dataset").alias("_ka"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = catalog.select(F.lower("dataset").alias("_kb"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    j = (df.withColumn("_n", name).join(a, F.concat(F.lit("tdc_"), "_n") == F.col("_ka"), "left")
         .join(b, F.col("_n") == F.col("_kb"), "left"))
    filled = {c: F.coalesce(F.nullif(F.trim(c), F.lit("")), f"_a_{c}", f"_b_{c}") for c in columns}
    return j.withColumns(filled).select(*df.columns)
