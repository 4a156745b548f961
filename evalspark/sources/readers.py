"""File scans: delimited tables, per-dataset metric files, JSON statuses, catalogs and artifact audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.cleaning import null_clean, parse_first_float, parse_first_int, strip, to_number
from evalspark.functions.columns import infer_column

# Header spellings of the key and target roles, best first.
KEY_COLUMNS = ("smiles", "SMILES", "Smiles", "canonical_smiles", "Drug", "X")
TARGET_COLUMNS = ("target", "Target", "y", "Y", "label", "value")


def file_path() -> Column:
    """Path of the file a row came from, with URL escapes undone."""
    raw = F.col("_metadata.file_path")
    return F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))


def folder_name(level: int = 1) -> Column:
    """Name of the folder ``level`` steps above the file a row came from."""
    return F.element_at(F.split(file_path(), "/"), -1 - level)


def read_text_table(spark: SparkSession, path: str | Sequence[str], sep: str = ",") -> DataFrame:
    """All columns as text (types are applied by the caller, row by row, without a failing cast)."""
    return spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True)


def read_keyed_table(spark: SparkSession, path: str, dataset: str, sep: str = "\t", key_columns=KEY_COLUMNS,
                     target_columns=TARGET_COLUMNS, extra: Sequence[str] = ()) -> DataFrame | None:
    """Key and target by role; ``None`` when a role cannot be inferred from the header."""
    raw = read_text_table(spark, path, sep)
    key, target = infer_column(raw.columns, key_columns), infer_column(raw.columns, target_columns)
    if key is None or target is None:
        return None
    keep = [c for c in extra if c in raw.columns]
    return raw.select(F.lit(dataset).alias("dataset"), strip(key).alias("entity_key"), to_number(target).alias("target"),
                      *keep)


def read_by_header(spark: SparkSession, paths: Sequence[str], sep: str = ",") -> DataFrame:
    """Union of files whose headers differ: files are grouped by header line first, one scan per header."""
    heads = (spark.read.text(list(paths), wholetext=False).select(file_path().alias("p"),
                                                                  F.col("_metadata.file_block_start").alias("b"), "value")
             .where("b = 0").groupBy("p").agg(F.first("value").alias("h")))
    groups: dict[str, list[str]] = {}
    for row in heads.collect():  # one short line per file
        groups.setdefault(row["h"], []).append(row["p"])
    out = None
    for files in groups.values():
        part = read_text_table(spark, files, sep).withColumn("_folder", folder_name())
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_metric_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Per-dataset metric files; a blank dataset name is filled from the folder."""
    df = read_by_header(spark, paths)
    name = null_clean("dataset") if "dataset" in df.columns else F.lit(None).cast("string")
    return df.withColumn("dataset", F.coalesce(name, F.col("_folder"))).drop("_folder")


STATUS_SCHEMA = T.StructType([
    T.StructField("status", T.StringType()), T.StructField("dataset", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("reason", T.StringType()), T.StructField("completed_at", T.StringType()),
    T.StructField("elapsed_seconds", T.DoubleType()), T.StructField("n_metrics_rows", T.LongType()),
    T.StructField("n_stage_records", T.LongType()), T.StructField("_corrupt_record", T.StringType())])


def read_run_status(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One JSON object per file; files holding anything else are skipped, absent fields get defaults."""
    raw = (spark.read.schema(STATUS_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt_record")
           .json(path, multiLine=True, mode="PERMISSIVE").withColumn("_folder", folder_name()))
    ok = raw.where(F.col("_corrupt_record").isNull() & F.col("status").isNotNull())
    return ok.select(F.coalesce(null_clean("dataset"), F.col("_folder")).alias("dataset"), "status",
                     F.coalesce("source", F.lit("")).alias("source"), "elapsed_seconds",
                     F.coalesce("n_metrics_rows", F.lit(0)).alias("n_metrics_rows"),
                     F.coalesce("n_stage_records", F.lit(0)).alias("n_stage_records"))


TOP_ENTRY = "array<struct<rank:string,model:string,metric_name:string,metric_value:string>>"


def catalog_frame(raw: DataFrame) -> DataFrame:
    """Catalog rows: cleaned text, embedded top-10 list (parsed only when it is one), default rank and metric."""
    text = raw.select(*[null_clean(c).alias(c) for c in raw.columns])
    top = F.from_json(F.when(F.ltrim("top10_json").startswith("["), F.col("top10_json")), TOP_ENTRY)
    placeholder = F.lower("recommended_metric").isin("tbd", "unknown", "n/a")
    return text.withColumns({"top10": top, "leaderboard_rank": F.coalesce("leaderboard_rank", F.lit("1"))}).withColumn(
        "recommended_metric", F.coalesce(F.when(~placeholder, F.col("recommended_metric")), F.col("leaderboard_metric")))


def explode_reference(df: DataFrame, keys: Sequence[str], json_column: str, limit: int = 10) -> DataFrame:
    """One row per listed entry (at most ``limit``, the size of a top-10 list); rows without a list give one summary row."""
    entries = F.filter(F.from_json(json_column, TOP_ENTRY), lambda e: e.isNotNull() & e["model"].isNotNull())
    listed = F.coalesce(F.size(entries) > 0, F.lit(False))
    out = df.withColumn("_l", listed).select(*keys, "_l", F.posexplode_outer(F.slice(entries, 1, limit)).alias("_p", "_e"))
    return out.select(*keys, F.col("_e.rank").alias("rank"), parse_first_int("_e.rank").alias("rank_numeric"),
                      F.col("_e.model").alias("model"), F.col("_e.metric_name").alias("leaderboard_metric_name"),
                      F.col("_e.metric_value").alias("metric_value"),
                      parse_first_float("_e.metric_value").alias("metric_value_numeric"), F.col("_l").alias("is_top10_entry"),
                      F.col("_p").alias("entry_position"))


def presplit_source(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Train and test tables with one schema, tagged and stacked."""
    missing = [c for c in columns if c not in train.columns or c not in test.columns]
    if missing or train.select(*columns).schema != test.select(*columns).schema:
        raise ValueError(f"train and test differ in columns: {missing or 'types'}")
    return (train.select(*columns).withColumn("split", F.lit("train"))
            .unionByName(test.select(*columns).withColumn("split", F.lit("test"))))


def audit_expected(found: DataFrame, datasets: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected artifacts per dataset with presence, size, checksum and the dataset's completeness share.

    ``expected`` is the fixed list of artifact kinds.
    """
    grid = datasets.join(F.broadcast(expected))
    j = grid.join(found, ["dataset", *expected.columns], "left").withColumn("is_present", F.col("n_bytes").isNotNull())
    share = j.groupBy("dataset").agg(F.avg(F.col("is_present").cast("double")).alias("completeness"))
    return j.join(share, "dataset")


def artifact_table(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` with size and sha256."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    return raw.select(F.element_at(parts, -2).alias("dataset"), F.element_at(parts, -1).alias("kind"),
                      F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("checksum"), "modificationTime")


def discover_runs(config: DataFrame, summary: DataFrame, metrics: DataFrame) -> DataFrame:
    """Runs newest first: time of the config file, else the summary, else the newest metrics file.

    Each input has ``run_name`` and ``modified``.
    """
    def newest(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("run_name").agg(F.max("modified").alias(name))

    j = (newest(config, "c").join(newest(summary, "s"), "run_name", "full_outer")
         .join(newest(metrics, "m"), "run_name", "full_outer"))
    return j.select("run_name", F.coalesce("c", "s", "m").alias("modified"),
                    F.when(F.col("c").isNotNull(), "config").when(F.col("s").isNotNull(), "summary").otherwise("metrics")
                    .alias("found_by")).orderBy(F.desc("modified"), "run_name")
