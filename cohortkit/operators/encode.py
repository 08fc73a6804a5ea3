"""Categorical codes, id offsets, missing tokens and continuous scaling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.operators import dictionary

# Spellings treated as a missing categorical value.
MISSING_TOKENS = ("na", "missing", "nan", "n/a")


def codes(df: DataFrame, cols: Mapping[str, object], suffix: str = "",
          level_source: DataFrame | None = None) -> DataFrame:
    """``{column: reference}`` -> ordinal codes (null or unseen: -1, pandas' code for
    NaN). Levels come from ``level_source`` (e.g. the train split) or ``df``, as a table of
    any size (``dictionary.py``)."""
    known = dictionary.build(level_source if level_source is not None else df, cols)
    return dictionary.encode(df, known, {c: c + suffix for c in cols})


def cardinalities(df: DataFrame, cols: Sequence[str]) -> dict:
    """G1 per column in one pass: exact distinct counts (nulls not counted)."""
    row = df.agg(*[F.countDistinct(c).alias(c) for c in cols]).first()
    return {c: int(row[c]) for c in cols}


def offsets(card: Mapping[str, int], special: int = 1) -> dict:
    """E5: place every categorical column in one id space: ``special`` reserved ids
    first, then each column's block after the previous ones (pad + cumsum)."""
    out, acc = {}, special
    for c, n in card.items():
        out[c] = acc
        acc += n
    return out


def offset_ids(df: DataFrame, code_cols: Mapping[str, int], suffix: str = "_id") -> DataFrame:
    """E5 applied: id = code + column offset."""
    return df.withColumns({c + suffix: F.col(c) + F.lit(off) for c, off in code_cols.items()})


def normalise_missing(col: str, tokens: Sequence[str] = MISSING_TOKENS) -> Column:
    """Missing spellings (case-insensitive, trimmed) and null -> null, so the
    offset step maps them to id 0."""
    c = F.col(col)
    return F.when(c.isNull() | F.lower(F.trim(c)).isin(*tokens), F.lit(None)).otherwise(c)


def train_stats(df: DataFrame, cols: Sequence[str], split_col: str | None = "split",
                split: str = "train") -> DataFrame:
    """Mean and sample std (ddof=1) per continuous column on the train rows, as one
    row with ``<c>_mean``/``<c>_std``."""
    src = df.filter(F.col(split_col) == split) if split_col else df
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return src.agg(*aggs)


def zscore(df: DataFrame, stats_row, cols: Sequence[str], suffix: str = "_z") -> DataFrame:
    """(x - mean) / std with train statistics (a collected one-row aggregate). A
    constant column has no scale: its z-score is null."""
    return df.withColumns({c + suffix: F.try_divide(F.col(c) - F.lit(stats_row[f"{c}_mean"]),
                                                    F.lit(stats_row[f"{c}_std"])) for c in cols})


def row_norm(cols: Sequence[str], eps: float = 1e-5) -> list[Column]:
    """layer norm across the continuous columns of one row. Needs >= 2 columns:
    with one column x - mean is always 0 and the value is lost."""
    if len(cols) < 2:
        raise ValueError("row normalisation needs at least two columns")
    n = float(len(cols))
    mean = sum(F.col(c) for c in cols) / n
    var = sum((F.col(c) - mean) * (F.col(c) - mean) for c in cols) / n
    return [((F.col(c) - mean) / F.sqrt(var + F.lit(eps))).alias(c) for c in cols]
