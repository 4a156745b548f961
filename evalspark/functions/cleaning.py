"""Missing-value, numeric and text cleaning rules as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of "missing" that every rule recognises.
NULL_TOKENS = ("", "nan", "none", "null")
KEY_NULL_TOKENS = ("", "nan", "none", "na")
ERROR_NULL_TOKENS = ("", "nan", "none")
TRUE_TOKENS = ("true", "1", "yes", "y", "t")
FLOAT32_MAX = 3.4028235e38
FIRST_FLOAT = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
FIRST_INT = r"[-+]?\d+"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


BLANKS = " \t\n\r\f\v"


def strip(c: Column | str) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.btrim(as_col(c).cast("string"), F.lit(BLANKS))


def null_clean(c: Column | str, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """Trimmed text, or null when it spells a missing value."""
    text = strip(c)
    return F.when(~F.lower(text).isin(*tokens), text)


def has_error(c: Column | str) -> Column:
    """True when an error text is really present."""
    return null_clean(c, ERROR_NULL_TOKENS).isNotNull()


def finite(c: Column | str) -> Column:
    """NaN and infinities to null."""
    x = as_col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def to_number(c: Column | str) -> Column:
    """Text to double; unparsable text, NaN and infinities become null."""
    return finite(strip(c).try_cast("double"))


def finite_feature(c: Column | str) -> Column:
    """Feature values outside the float32 range count as missing."""
    x = as_col(c)
    return F.when(~F.isnan(x) & (F.abs(x) <= F.lit(FLOAT32_MAX)), x)


def bool_like(c: Column | str) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(*TRUE_TOKENS), F.lit(False))


def parse_first_float(c: Column | str) -> Column:
    return F.regexp_extract(as_col(c), FIRST_FLOAT, 0).try_cast("double")


def parse_first_int(c: Column | str) -> Column:
    return F.regexp_extract(as_col(c), FIRST_INT, 0).try_cast("int")


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """num / den with a zero denominator giving null."""
    return F.try_divide(as_col(num), F.nullif(as_col(den), F.lit(0)))


def stable_float_text(c: Column | str, digits: int = 12) -> Column:
    """Shortest text with ``digits`` significant digits (``%.12g``); anything not finite becomes ``nan``."""
    pattern = f"%.{digits}g"

    @F.arrow_udf("string")
    def text(x: pa.Array) -> pa.Array:
        return pa.array([pattern % (v + 0.0) if v is not None and math.isfinite(v) else "nan" for v in x.to_pylist()], pa.string())

    return text(as_col(c).cast("double"))


def format_value(mean: Column | str, std: Column | str) -> Column:
    """``mean +/- std``, or the mean alone when no spread is known."""
    m, s = strip(mean), strip(std)
    return F.when(F.coalesce(s, F.lit("")) != "", F.concat(m, F.lit(" +/- "), s)).otherwise(m)


def format_seconds(c: Column | str) -> Column:
    """Seconds as ``1h 02m 03s`` / ``2m 03s`` / ``3s``."""
    total = F.greatest(F.round(as_col(c)).cast("long"), F.lit(0).cast("long"))
    h, m, s = F.floor(total / 3600), F.floor((total % 3600) / 60), total % 60
    return (F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, s))
            .when(m > 0, F.format_string("%dm %02ds", m, s))
            .otherwise(F.format_string("%ds", s)))


def one_hot_label(columns: Sequence[str], prefix: str) -> Column:
    """Names of the active indicator columns joined by ``+``; ``unknown`` when none is active."""
    names = F.array(*[F.when(F.col(c) > 0, F.lit(c.removeprefix(prefix))) for c in sorted(columns)])
    return F.coalesce(F.nullif(F.array_join(F.array_sort(F.array_compact(names)), "+"), F.lit("")), F.lit("unknown"))


def canonical_frame(df: DataFrame, key: str, target: str, split: str | None = None, aux: Iterable[str] = (),
                    key_normalizer=None) -> DataFrame:
    """Trimmed key, numeric target and auxiliary columns; rows lacking a key, target or split are dropped.

    ``key_normalizer`` takes and returns a Column (for example a pandas UDF wrapping a chemistry library).
    """
    keep = [c for c in df.columns if c not in {key, target, split, *aux}]
    norm = key_normalizer or (lambda c: c)
    text = strip(key)
    out = df.select(
        *keep,
        text.alias("entity_key"),
        norm(text).alias("canonical_key"),
        to_number(target).alias("target"),
        *([F.col(split).cast("string").alias("split")] if split else []),
        *[to_number(c).alias(c) for c in aux],
    )
    ok = F.col("entity_key").isNotNull() & ~F.lower("entity_key").isin(*KEY_NULL_TOKENS)
    ok = ok & F.col("target").isNotNull() & F.col("canonical_key").isNotNull()
    if split:
        ok = ok & F.col("split").isNotNull()
    return out.where(ok)


# --- missing-value strategies over a wide table -----------------------------------------------------------------

def _nulled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_number(c) for c in columns})


def drop_missing_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _nulled(df, columns).dropna(subset=list(columns))


def fill_missing_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _nulled(df, columns).fillna(0.0, subset=list(columns))


def drop_missing_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop every listed column holding at least one missing value (one counting pass, one row to the driver)."""
    work = _nulled(df, columns)
    counts = work.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return work.drop(*[c for c in columns if counts[c] > 0])


def interpolate_linear(df: DataFrame, keys: Sequence[str], order: str, column: str) -> DataFrame:
    """Linear interpolation along ``order`` within ``keys``; leading gaps stay null, trailing gaps carry forward.

    Only the gaps travel: known points are summarised per block of the order axis, so that one long series is
    handled by many tasks (see ``ordering.neighbours_known``).
    """
    from evalspark.operators.ordering import neighbours_known

    work = neighbours_known(df.withColumn(column, to_number(column)), keys, order, column)
    pos, lo, hi = F.col("_pos"), F.col("_prev_pos"), F.col("_next_pos")
    filled = (F.when(F.col(column).isNotNull(), F.col(column))
              .when(F.col("_prev").isNotNull() & F.col("_next").isNotNull(),
                    F.col("_prev") + (F.col("_next") - F.col("_prev")) * (pos - lo) / (hi - lo))
              .otherwise(F.col("_prev")))
    return work.withColumn(column, filled).drop("_pos", "_prev", "_next", "_prev_pos", "_next_pos")

