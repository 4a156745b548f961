"""Alignment, comparison and lookup joins. Strategies are left to AQE, which broadcasts by measured size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.cleaning import ERROR_NULL_TOKENS, null_clean
from evalspark.functions.taxonomy import error_transition
from evalspark.operators.ordering import ROWS_PER_BUCKET, dedupe, key_join, prefix_sums, row_numbers, top_rows


def occurrence_align(expected: DataFrame, actual: DataFrame, keys: Sequence[str], entity: str, order: str, value: str,
                     rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The n-th copy of an entity in ``expected`` meets its n-th copy in ``actual``.

    ``aligned`` is false for a whole dataset when any of its expected rows found no partner. Copies are numbered per
    (dataset, entity) in the explicit ``order``; the join key includes the number, so hot entities spread out.
    """
    a = row_numbers(expected, [*keys, entity], [order], "_occ", rows_per_bucket)
    b = row_numbers(actual.select(*keys, entity, order, value), [*keys, entity], [order], "_occ", rows_per_bucket)
    b = b.drop(order).withColumn("_hit", F.lit(True))
    j = key_join(a, b, [*keys, entity, "_occ"], "left")
    full = j.groupBy(*keys).agg((F.count_if(F.col("_hit").isNull()) == 0).alias("aligned"))
    return key_join(j.drop("_hit"), full, keys).withColumnRenamed("_occ", "occurrence")


def alignment_mode(expected: DataFrame, actual: DataFrame, keys: Sequence[str], entity: str, order: str,
                   rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Per dataset how two ordered lists of entities can be aligned.

    ``exact``: same length and entity at every position; ``occurrence``: same copies in another order; ``prefix``: one
    list starts with the other; ``clip``: only lengths can be cut to match.
    """
    a = row_numbers(expected.select(*keys, entity, order), keys, [order], "_i", rows_per_bucket)
    b = row_numbers(actual.select(*keys, entity, order), keys, [order], "_i", rows_per_bucket)
    b = b.select(*keys, "_i", F.col(entity).alias("_other"), F.lit(1).alias("_rb"))
    j = key_join(a.withColumn("_ra", F.lit(1)), b, [*keys, "_i"], "left")
    both = F.col("_rb").isNotNull()
    pos = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_expected"), F.count("_rb").alias("_shared"),
                               F.count_if(both & ~F.col(entity).eqNullSafe(F.col("_other"))).alias("_wrong"))
    nb = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_actual"))
    ca = expected.groupBy(*keys, entity).agg(F.count(F.lit(1)).alias("_na"))
    cb = actual.groupBy(*keys, entity).agg(F.count(F.lit(1)).alias("_nb"))
    cover = key_join(ca, cb, [*keys, entity], "left").groupBy(*keys).agg(
        F.count_if(F.coalesce("_nb", F.lit(0)) < F.col("_na")).alias("_short"))
    all_ = key_join(key_join(pos, nb, keys, "left"), cover, keys).fillna(0, ["n_actual"])
    same = F.col("_wrong") == 0
    mode = (F.when(same & (F.col("n_expected") == F.col("n_actual")), "exact")
            .when(F.col("_short") == 0, "occurrence").when(same & (F.col("_shared") > 0), "prefix").otherwise("clip"))
    return all_.select(*keys, "n_expected", "n_actual", mode.alias("mode"))


def aligned_predictions(pred: DataFrame, keys: Sequence[str], row: Sequence[str], seq: str, model: str = "model",
                        observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """Rows every model of the dataset predicted, with a model -> prediction map; observed comes from the first model.

    Relational division by counting: no chain of joins, one shuffle by row key.
    """
    one = dedupe(pred.select(*keys, *row, F.col(seq).alias("_seq"), model, observed, predicted), [*keys, *row, model], ["_seq"])
    n = pred.select(*keys, model).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_models"))
    g = one.groupBy(*keys, *row).agg(
        F.count(F.lit(1)).alias("_have"), F.min_by(observed, model).alias(observed),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(model, predicted)))).alias("predictions"))
    return key_join(g, n, keys).where(F.col("_have") == F.col("_models")).drop("_have", "_models")


def full_outer_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Both sides' fields side by side with a match flag each; missing equals missing."""
    left = a.select(*keys, *[F.col(f).alias(f"{f}_current") for f in fields])
    right = b.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(f).alias(f"{f}_reference") for f in fields])
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    j = left.join(right, cond, "full_outer")
    j = j.select(*[F.coalesce(F.col(k), F.col(f"_k{i}")).alias(k) for i, k in enumerate(keys)],
                 *[c for f in fields for c in (f"{f}_current", f"{f}_reference")])
    flags = {f"{f}_match": F.col(f"{f}_current").eqNullSafe(F.col(f"{f}_reference")) for f in fields}
    return j.withColumns(flags).withColumn("all_match", reduce(lambda x, y: x & y, [F.col(c) for c in flags]))


def error_diff(current: DataFrame, reference: DataFrame, keys: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """Full outer pairing on (dataset, model), so rows of several workflows multiply; labelled by transition."""
    a = current.select(*keys, F.col("workflow").alias("current_workflow"), F.coalesce("error", F.lit("")).alias("current_error"))
    b = reference.select(*keys, F.col("workflow").alias("reference_workflow"),
                         F.coalesce("error", F.lit("")).alias("reference_error"))
    j = a.join(b, list(keys), "full_outer").fillna("", ["current_error", "reference_error"])
    return j.withColumn("transition", error_transition("reference_error", "current_error",
                                                       lambda c: null_clean(c, ERROR_NULL_TOKENS)))


def config_diff(current: DataFrame, reference: DataFrame) -> DataFrame:
    """Union of keys; values compared as text, absent values as empty text."""
    a = current.select("config_key", F.col("value").alias("current_value"))
    b = reference.select("config_key", F.col("value").alias("reference_value"))
    j = a.join(b, "config_key", "full_outer").fillna("", ["current_value", "reference_value"])
    return j.withColumn("different", F.col("current_value") != F.col("reference_value"))


def lookup_by_rounded_key(df: DataFrame, lookup: DataFrame, key: str, number: str, seq: str, digits: int = 6) -> DataFrame:
    """Left join on ``key|round(number)`` against the first lookup row per key; rows without a match are dropped."""
    text = lambda: F.concat_ws("|", F.col(key), F.round(number, digits).cast("string"))
    one = dedupe(lookup.withColumn("_key", text()).drop(key, number), ["_key"], [seq])
    return df.withColumn("_key", text()).join(one, "_key").drop("_key")


def lookup_with_fallback(df: DataFrame, ref: DataFrame, first: tuple[str, str], second: tuple[str, str],
                         columns: Sequence[str]) -> DataFrame:
    """Match by the first key pair, and only where that finds nothing by the second (case-insensitive, trimmed)."""
    norm = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    a = ref.select(norm(first[1]).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in columns]).where(F.col("_a") != "")
    b = ref.select(norm(second[1]).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    j = df.withColumns({"_ka": norm(first[0]), "_kb": norm(second[0])})
    hit = j.join(a, F.col("_ka") == F.col("_a"))
    miss = j.join(a.select("_a").distinct(), F.col("_ka") == F.col("_a"), "left_anti").join(
        b, F.col("_kb") == F.col("_b"), "left")
    one = hit.select(*df.columns, *[F.col(f"_a_{c}").alias(c) for c in columns], F.lit("first").alias("matched_by"))
    two = miss.select(*df.columns, *[F.col(f"_b_{c}").alias(c) for c in columns],
                      F.when(F.col("_b").isNotNull(), "second").alias("matched_by"))
    return one.unionByName(two)


def model_pairs(pred: DataFrame, keys: Sequence[str], row: Sequence[str], model: str = "model",
                value: str = "predicted") -> DataFrame:
    """Rows of every model pair a < b. The rows of one key meet in one array of models, so nothing is joined to itself."""
    entry = F.struct(F.col(model).alias("m"), F.col(value).alias("v"))
    g = pred.groupBy(*keys, *row).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    pairs = g.withColumn("_a", F.explode("_e")).withColumn("_b", F.explode("_e")).where(F.col("_a.m") < F.col("_b.m"))
    return pairs.select(*keys, *row, F.col("_a.m").alias("model_a"), F.col("_b.m").alias("model_b"),
                        F.col("_a.v").alias("value_a"), F.col("_b.v").alias("value_b"))


def better_counts(df: DataFrame, refs: DataFrame, keys: Sequence[str], score: str,
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``n_better``: reference scores strictly below the row's (smaller is better).

    A counting theta join as running sums: rows and references are stacked by score, so nothing is paired up and a
    long reference list needs no array.
    """
    both = (df.select(*keys, score).withColumn("_ref", F.lit(0))
            .unionByName(refs.select(*keys, score).withColumn("_ref", F.lit(1))))
    c = prefix_sums(both, keys, score, {"_r": F.col("_ref")}, rows_per_bucket)
    return key_join(df, c.select(*keys, score, F.col("_r_before").alias("n_better")), [*keys, score])


def reference_cutoffs(refs: DataFrame, keys: Sequence[str], score: str, tie: str) -> DataFrame:
    """Best and tenth (or worst) reference score per key; each task sends at most ten rows per key."""
    n = refs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_references"))
    best = top_rows(refs.select(*keys, score, tie), keys, [F.col(score), F.col(tie)], 10)
    ends = best.groupBy(*keys).agg(F.min(score).alias("best_score"), F.max(score).alias("tenth_score"))
    return key_join(ends, n, keys)


def rank_against(df: DataFrame, refs: DataFrame, keys: Sequence[str], score: str, tie: str,
                 rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Rank = 1 + number of better references, membership in the top ten, gaps to the best and to the tenth."""
    j = key_join(better_counts(df, refs, keys, score, rows_per_bucket), reference_cutoffs(refs, keys, score, tie), keys)
    return j.withColumns({"estimated_rank": F.col("n_better") + 1, "in_top10": F.col("n_better") < 10,
                          "gap_to_best": F.col(score) - F.col("best_score"),
                          "gap_to_tenth": F.col(score) - F.col("tenth_score")}).drop("n_better")


def missing_models(datasets: DataFrame, expected: DataFrame, done: DataFrame) -> DataFrame:
    """Expected (dataset, model) pairs not done yet; ``expected`` is the fixed list of requested models."""
    return datasets.crossJoin(expected).join(done, ["dataset", "model"], "left_anti")


def validated_join(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, other: str,
                   tolerance: float = 1e-12) -> DataFrame:
    """Inner join that must cover every right row with equal values; raises otherwise (two aggregates, one row back)."""
    j = key_join(left, right, keys)
    n_right = right.count()
    row = j.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col(value) - F.col(other))).alias("d")).first()
    if row["n"] != n_right or (row["d"] is not None and row["d"] > tolerance):
        raise ValueError(f"join check failed: {row['n']} of {n_right} rows, largest difference {row['d']}")
    return j
