"""Run outputs: summaries, predictions, reference snapshots, stage checkpoints and keyed upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators.ordering import dedupe


def write_run(base: str, summary: DataFrame, predictions: DataFrame) -> None:
    """Predictions partitioned by dataset, the summary as parquet and CSV."""
    predictions.write.mode("overwrite").partitionBy("dataset").parquet(f"{base}/predictions")
    summary.write.mode("overwrite").parquet(f"{base}/summary")
    summary.write.mode("overwrite").option("header", True).csv(f"{base}/summary_csv")


def write_reference_snapshot(base: str, ref: DataFrame, stamp: str) -> None:
    """Run copy first; ``latest``, the dated snapshot and the JSON form are copied from it, so all four agree."""
    ref.write.mode("overwrite").parquet(f"{base}/run")
    stored = ref.sparkSession.read.parquet(f"{base}/run")
    stored.write.mode("overwrite").parquet(f"{base}/latest")
    stored.write.mode("overwrite").parquet(f"{base}/snapshot={stamp}")
    stored.write.mode("overwrite").json(f"{base}/json")


def append_stage(path: str, rows: DataFrame, stage: int) -> None:
    """Stage results are appended; readers take the latest stage per key."""
    rows.withColumn("stage", F.lit(stage)).write.mode("append").parquet(path)


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    return dedupe(spark.read.parquet(path), keys, ["stage"], "last")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` whose key is derived again are replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def bootstrap_reference(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep the last captured copy of every reference entry of all old runs."""
    return dedupe(history, keys, ["captured_at"], "last")


def prediction_rows(scored: DataFrame, dataset: str, model: str, workflow: str, split: str, key: str, observed: str,
                    predicted: str, row_id: str) -> DataFrame:
    """Standard prediction table; the row index is carried from the input, never generated."""
    return scored.select(F.lit(dataset).alias("dataset") if dataset not in scored.columns else F.col(dataset).alias("dataset"),
                         F.lit(model).alias("model"), F.lit(workflow).alias("workflow"), F.lit(split).alias("split"),
                         F.col(row_id).alias("row_index"), F.col(key).alias("entity_key"),
                         F.col(observed).cast("double").alias("observed"), F.col(predicted).cast("double").alias("predicted"))


def resumable_predictions(stored: DataFrame, key: str = "entity_key") -> DataFrame:
    """Clean stored predictions: numeric, keyed, first copy per row; models lacking either split are left out."""
    from evalspark.functions.cleaning import null_clean, to_number

    ok = stored.withColumns({key: null_clean(key), "observed": to_number("observed"), "predicted": to_number("predicted")})
    ok = ok.where(F.col(key).isNotNull() & F.col("observed").isNotNull() & F.col("predicted").isNotNull())
    one = dedupe(ok, ["dataset", "model", "split", "row_index"], [key, "predicted"])
    both = one.groupBy("dataset", "model").agg((F.count_if(F.col("split") == "train") > 0).alias("_a"),
                                               (F.count_if(F.col("split") == "test") > 0).alias("_b"))
    return one.join(both.where("_a AND _b").select("dataset", "model"), ["dataset", "model"])
