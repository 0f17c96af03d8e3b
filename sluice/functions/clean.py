"""Cleaning, casting and labelling of sensor rows; all plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import schema as S

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def safe_float(text: Column) -> Column:
    """A double, or null when the text is not a number (blank text and NaN included)."""
    plain = F.trim(text.cast("string"))
    # Java also reads a trailing d or f as a type suffix; that is text here.
    return present(F.when(~plain.rlike("[0-9.][dDfF]$"), plain.try_cast("double")))


def present(value: Column) -> Column:
    """The value; NaN is a missing reading and becomes null."""
    return F.nanvl(value, F.lit(None).cast("double"))


def clean_numeric(df: DataFrame, columns: Sequence[str] = S.SENSOR_TAGS) -> DataFrame:
    """Trimmed text to doubles in one projection; blank and unparseable become null."""
    wanted = set(columns)
    return df.select(*[safe_float(F.col(c)).alias(c) if c in wanted else F.col(c) for c in df.columns])


def trim_text(df: DataFrame, columns: Sequence[str] = (S.TIME_COLUMN, S.LABEL_COLUMN)) -> DataFrame:
    wanted = set(columns)
    return df.select(*[F.trim(c).alias(c) if c in wanted else F.col(c) for c in df.columns])


def parse_timestamp(text: Column, fallback: Column | None = None) -> Column:
    """Time from text in any accepted format; unreadable text gives ``fallback`` (null by
    default). The shape picks the format, so no row pays for formats that cannot fit."""
    parsed = F.when(F.lit(False), F.lit(None).cast("timestamp"))
    for shape, fmt in S.TIME_FORMATS.items():
        parsed = parsed.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(fmt)))
    parsed = parsed.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))
    return parsed if fallback is None else F.coalesce(parsed, fallback)


def numeric_frame(df: DataFrame) -> DataFrame:
    """Drop a non-numeric first and last column, cast the rest, nulls to 0."""
    types, columns = dict(df.dtypes), list(df.columns)
    if columns and types[columns[0]] not in NUMERIC:
        columns = columns[1:]
    if columns and types[columns[-1]] not in NUMERIC:
        columns = columns[:-1]
    return df.select(*[
        F.coalesce((F.col(c) if types[c] in NUMERIC else safe_float(F.col(c))).cast("double"), F.lit(0.0)).alias(c)
        for c in columns
    ])


def align_schema(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly ``columns`` in order; absent ones and nulls are 0."""
    have = set(df.columns)
    return df.select(*keep, *[
        (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c) for c in columns
    ])


def first_label(df: DataFrame) -> Column:
    """First non-empty of the label columns that exist; empty text when none."""
    present = [F.when(F.col(c) != "", F.col(c)) for c in S.LABEL_COLUMNS if c in df.columns]
    return F.coalesce(*present, F.lit(""))


def normal_sign(label: Column) -> Column:
    """1 for normal rows, -1 for all others."""
    return F.when(label == S.NORMAL, 1).otherwise(-1)


def attack_flag(label: Column) -> Column:
    """1 for attack rows, 0 for all others (exact spelling)."""
    return F.when(label == S.ATTACK, 1).otherwise(0)


def is_attack(label: Column) -> Column:
    """Attack in any case and padding."""
    return F.coalesce(F.lower(F.trim(label)) == "attack", F.lit(False))


def is_normal(label: Column) -> Column:
    """Normal by any of the accepted spellings; a missing label counts as normal."""
    return F.coalesce(F.lower(F.trim(label)).isin(S.NORMAL_LABELS), F.lit(True))


def stage_of(tag: Column) -> Column:
    """Plant stage of a tag: the first digit of its three-digit number."""
    digit = F.regexp_extract(tag, r"(\d)\d{2}$", 1)
    return F.when(digit != "", F.concat(F.lit("P"), digit))


def binary_status(value: Column) -> Column:
    """0/1 state of a pump or valve, null when unreadable."""
    return safe_float(value).try_cast("int")


def outside(value: Column, low: float, high: float) -> Column:
    """Out-of-range flag; a missing or unreadable reading is none."""
    v = present(value)
    return F.coalesce((v < low) | (v > high), F.lit(False))


def spike(value: Column, limit: float) -> Column:
    return F.coalesce(value, F.lit(0.0)) > limit


def finite_or_zero(value: Column) -> Column:
    """Nulls, NaN and infinities become 0."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, 0.0).otherwise(value)


def fit_moments(df: DataFrame, columns: Sequence[str], sample: bool = False) -> dict[str, tuple[float, float]]:
    """(mean, standard deviation) per column over its readings (NaN is none): one aggregate."""
    spread = F.stddev_samp if sample else F.stddev_pop
    row = df.agg(*[
        e for i, c in enumerate(columns) for e in (F.avg(present(F.col(c))).alias(f"m{i}"), spread(present(F.col(c))).alias(f"s{i}"))
    ]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def zscore_normalise(df: DataFrame, columns: Sequence[str], moments=None) -> DataFrame:
    """(x - mean) / (sample deviation + 1e-8); anything undefined becomes 0."""
    moments = moments or fit_moments(df, columns, sample=True)

    def scaled(c: str) -> Column:
        mean, std = moments[c]
        if mean is None or std is None:
            return F.lit(0.0)
        return finite_or_zero((F.col(c) - mean) / (std + 1e-8))

    return df.select(*[scaled(c).alias(c) if c in moments else F.col(c) for c in df.columns])


def standard_scale(df: DataFrame, columns: Sequence[str], moments) -> DataFrame:
    """(x - mean) / population deviation with moments fitted elsewhere; deviation 0 acts as 1."""

    def scaled(c: str) -> Column:
        mean, std = moments[c]
        return (F.col(c) - F.lit(mean)) / F.lit(std or 1.0)

    return df.select(*[scaled(c).alias(c) if c in moments else F.col(c) for c in df.columns])


def select_features(df: DataFrame, selected: Sequence[str], always: Sequence[str] = (S.TIME_COLUMN, S.LABEL_COLUMN)):
    """(frame with the selected columns that exist, list of missing names)."""
    present = [c for c in selected if c in df.columns]
    extra = [c for c in always if c in df.columns and c not in present]
    return df.select(*present, *extra), [c for c in selected if c not in df.columns]
