"""Feature statistics, filters and encodings on array or long feature tables (never thousands of columns)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.cleaning import finite_feature
from evalspark.operators.ordering import BROADCAST_ROWS, ROWS_PER_BUCKET, checked_join, key_join, quantiles, row_numbers, top_rows
from evalspark.session import durable

_BATCH_CELLS = 1_000_000


def to_long(df: DataFrame, features: str, position: str = "pos", value: str = "x") -> DataFrame:
    rest = [c for c in df.columns if c != features]
    return df.select(*rest, F.posexplode(features).alias(position, value)).withColumn(value, F.col(value).cast("double"))


def fill_with_medians(long: DataFrame, keys: Sequence[str], value: str,
                      rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Out-of-range values become missing, then the exact column median, then 0.

    The median table has one row per feature; it is broadcast after its size was checked, so cells do not move.
    """
    clean = long.withColumn(value, finite_feature(value))
    med = quantiles(clean, keys, value, [0.5], ["_med"], rows_per_bucket).select(*keys, "_med")
    return (checked_join(clean, med, keys, "left")
            .withColumn(value, F.coalesce(F.col(value), F.col("_med"), F.lit(0.0))).drop("_med"))


def training_medians(long: DataFrame, position: str, value: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row holding the array of medians by feature position (as wide as one feature vector)."""
    med = quantiles(long.withColumn(value, finite_feature(value)), [position], value, [0.5], ["m"], rows_per_bucket)
    pairs = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col("m").alias("m"))))
    return med.agg(F.transform(pairs, lambda s: s["m"]).alias("medians"))


def align_to_training(df: DataFrame, medians: DataFrame, features: str = "features") -> DataFrame:
    """Cut or pad each vector to the training width; missing entries take the training median."""
    wide = df.crossJoin(F.broadcast(medians))  # one row, one vector wide
    filled = F.transform("medians", lambda m, i: F.coalesce(finite_feature(F.get(F.col(features), i)), m, F.lit(0.0)))
    return wide.withColumn(features, filled).drop("medians")


def pad_vectors(df: DataFrame, vector: str, width: int, train: Column, position: str = "pos") -> DataFrame:
    """Ragged vectors to a fixed width: missing entries take the training mean of the position, else 0."""
    cut = df.withColumn(vector, F.slice(vector, 1, width))
    long = to_long(cut.where(train).select(vector), vector, position).where(finite_feature("x").isNotNull())
    means = long.groupBy(position).agg(F.avg("x").alias("m"))
    row = means.agg(F.map_from_entries(F.collect_list(F.struct(position, "m"))).alias("_means"))
    filled = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.coalesce(finite_feature(F.get(F.col(vector), i).cast("double")),
                             F.try_element_at(F.col("_means"), i), F.lit(0.0)))
    return cut.crossJoin(F.broadcast(row)).withColumn(vector, filled).drop("_means")  # one row, ``width`` entries


# --- column filters --------------------------------------------------------------------------------------------

def feature_profile(long: DataFrame, features: Sequence[str], value: str = "x", row_id: str = "row_id",
                    tolerance: float = 1e-6) -> DataFrame:
    """Per feature: population variance, 0/1 test, prevalence and an order-free content signature, in one pass."""
    v = finite_feature(value)
    one, zero = F.abs(v - 1) <= tolerance, F.abs(v) <= tolerance
    cell = F.xxhash64(row_id, value)
    return long.groupBy(*features).agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.var_pop(v), F.lit(0.0)).alias("variance"),
        F.min(F.coalesce(one | zero, F.lit(False))).alias("is_binary"),
        F.avg(F.coalesce(one, F.lit(False)).cast("double")).alias("prevalence"),
        F.bit_xor(cell).alias("sig_xor"), F.sum(F.shiftright(cell, 20)).alias("sig_sum"))


def filter_report(long: DataFrame, position: str = "pos", value: str = "x", row_id: str = "row_id",
                  min_variance: float = 1e-8, prevalence: tuple[float, float] = (0.005, 0.995)) -> DataFrame:
    """One row per feature with the reason it is dropped, or null: low variance, then binary prevalence, then copy.

    Copies are found by signature and confirmed cell by cell against the first feature of the bucket, so only
    (feature, first feature) pairs are compared, never all pairs of a bucket.
    """
    p = feature_profile(long, [position], value, row_id)
    first_reason = (F.when(F.col("variance") <= min_variance, "low_variance")
                    .when(F.col("is_binary") & ((F.col("prevalence") < prevalence[0])
                                                | (F.col("prevalence") > prevalence[1])), "binary_prevalence"))
    p = p.withColumn("reason", first_reason)
    kept = p.where(F.col("reason").isNull())
    sig = ["n_rows", "sig_xor", "sig_sum"]
    heads = kept.groupBy(*sig).agg(F.min(position).alias("head"), F.count(F.lit(1)).alias("_c")).where("_c > 1")
    pairs = kept.join(heads, sig).where(F.col(position) != F.col("head")).select(position, "head")
    mine = long.join(pairs, position).select(position, "head", row_id, F.col(value).alias("_v"))
    other = long.select(F.col(position).alias("head"), row_id, F.col(value).alias("_w"))
    equal = (mine.join(other, ["head", row_id], "left").groupBy(position, "head")
             .agg(F.min(F.col("_v").eqNullSafe(F.col("_w"))).alias("_same")).where("_same"))
    out = p.join(equal.select(position, F.col("head").alias("duplicate_of")), position, "left")
    reason = F.coalesce("reason", F.when(F.col("duplicate_of").isNotNull(), "exact_duplicate"))
    return out.select(position, "n_rows", "variance", "prevalence", reason.alias("reason"), "duplicate_of")


def drop_summary(report: DataFrame, position: str = "pos", examples: int = 20) -> DataFrame:
    """Counts per reason with a few example features (the example list is a display limit, counts are complete)."""
    dropped = report.where(F.col("reason").isNotNull())
    totals = dropped.groupBy("reason").agg(F.count(F.lit(1)).alias("n_features"))
    shown = top_rows(dropped, ["reason"], [F.col(position)], examples)
    lists = shown.groupBy("reason").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(position)), lambda x: x.cast("string")), ",")
        .alias("examples"))
    return totals.join(lists, "reason")


def cap_selection(coefs: DataFrame, keys: Sequence[str], train_rows: str, feature: str = "feature",
                  magnitude: str = "magnitude", fraction: float = 0.1, threshold: float = 1e-10) -> DataFrame:
    """Keep the largest max(1, ceil(fraction * train rows)) non-zero coefficients; at least one is always kept."""
    ordered = coefs.withColumn("_neg", -F.abs(magnitude))
    pos = row_numbers(ordered, keys, ["_neg", feature], "_pos")
    limit = F.greatest(F.lit(1), F.ceil(F.col(train_rows) * fraction))
    keep = (F.col("_pos") < limit) & ((F.abs(magnitude) > threshold) | (F.col("_pos") == 0))
    return pos.where(keep).withColumn("selection_rank", F.col("_pos") + 1).drop("_neg", "_pos")


# --- hashed text features --------------------------------------------------------------------------------------

def token_ngrams(text: Column | str, n: int, pattern: str = r"\s+") -> Column:
    """Word n-grams. Built by zipping shifted copies of the token list, so the text is split once per copy, not per
    gram (an outer expression inside a lambda would be evaluated for every element)."""
    tokens = F.filter(F.split(F.lower(text), pattern), lambda t: t != "")
    grams = tokens
    for shift in range(1, n):
        shifted = F.slice(tokens, F.lit(shift + 1), F.greatest(F.size(tokens), F.lit(0)))
        grams = F.zip_with(grams, shifted, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(grams, lambda g: g.isNotNull()) if n > 1 else grams


def hashed_presence(grams: Column, n_bits: int) -> Column:
    """Sorted distinct bit numbers."""
    bit = lambda g: F.pmod(F.conv(F.substring(F.sha1(g), 1, 12), 16, 10).cast("long"), F.lit(n_bits)).cast("int")
    return F.array_sort(F.array_distinct(F.transform(F.array_distinct(grams), bit)))


def _bit_counts(df: DataFrame, keys: Sequence[str], n_bits: int) -> DataFrame:
    """(keys, bit, n) of every single row of ``df`` (keys, _bits), in its task."""
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("bit", T.IntegerType()), T.StructField("n", T.LongType())])
    step = max(1, _BATCH_CELLS // n_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                rows = batch.slice(i, step)
                bits = rows.column("_bits")
                sizes = bits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                n = np.bincount(np.repeat(np.arange(len(sizes)) * n_bits, sizes) + bits.flatten().to_numpy(zero_copy_only=False))
                cell = np.flatnonzero(n)
                at = pa.array(cell // n_bits)
                yield pa.RecordBatch.from_arrays([*[rows.column(k).take(at) for k in keys], pa.array((cell % n_bits).astype("int32")),
                                                  pa.array(n[cell].astype("int64"))], names=[*keys, "bit", "n"])
    return df.mapInArrow(run, schema)


def hashed_counts(df: DataFrame, keys: Sequence[str], grams: Column, n_bits: int) -> DataFrame:
    """Long counts (keys, bit, n). A row is counted in its task; only keys held by several rows meet in a shuffle."""
    bit = lambda g: F.pmod(F.conv(F.substring(F.sha1(g), 1, 12), 16, 10).cast("long"), F.lit(n_bits)).cast("int")
    repeated = durable(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys))
    several = repeated.count()
    counted = lambda rows: _bit_counts(rows.select(*keys, F.transform(grams, bit).alias("_bits")), keys, n_bits)
    if not several:
        return counted(df)
    meet = lambda how: key_join(df, repeated, keys, how, bounded=several <= BROADCAST_ROWS)
    summed = counted(meet("left_semi")).groupBy(*keys, "bit").agg(F.sum("n").alias("n"))
    return counted(meet("left_anti")).unionByName(summed)


def one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}{v}": (F.col(column).eqNullSafe(F.lit(v))).cast("int") for v in values})


def auxiliary_columns(df: DataFrame, identifiers: Sequence[str]) -> list[str]:
    """Columns outside ``identifiers`` holding at least one number: one aggregate over all columns, one row back."""
    cand = [c for c in df.columns if c not in identifiers]
    if not cand:
        return []
    row = df.agg(*[F.count(F.col(c).cast("string").try_cast("double")).alias(c) for c in cand]).first()
    return [c for c in cand if row[c] > 0]


