"""Labels and the row filters that go with them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The gendered AUDIT-C thresholds and the survey skip sentinel.
MAN, WOMAN = "Man", "Woman"
MAN_THRESHOLD, WOMAN_THRESHOLD = 4, 3
PMI_SKIP = "PMI: Skip"

# Ordinal severity answers of the two survey items.
SEVERITY_MAPPINGS = {
    "fatigue": {
        "Average Fatigue 7 Days: None": 0,
        "Average Fatigue 7 Days: Mild": 1,
        "Average Fatigue 7 Days: Moderate": 2,
        "Average Fatigue 7 Days: Severe": 3,
        "Average Fatigue 7 Days: Very Severe": 4,
    },
    "anxiety": {
        "Emotional Problem 7 Days: Never": 0,
        "Emotional Problem 7 Days: Rarely": 1,
        "Emotional Problem 7 Days: Sometimes": 2,
        "Emotional Problem 7 Days: Often": 3,
        "Emotional Problem 7 Days: Always": 4,
    },
}


def binary_label(gender: str = "gender", score: str = "audit_c_score") -> Column:
    """L1: man >= 4 or woman >= 3 -> 1, else 0 (by level name; other genders -> 0)."""
    g, s = F.col(gender), F.col(score)
    return F.when(((g == MAN) & (s >= MAN_THRESHOLD)) | ((g == WOMAN) & (s >= WOMAN_THRESHOLD)), 1) \
        .otherwise(0).cast("int")


def with_binary_label(df: DataFrame, out: str = "label", **kw) -> DataFrame:
    return df.withColumn(out, binary_label(**kw))


def parts_label(cols=("q1_score", "q2_score", "q3_score")) -> Column:
    """L2: the three-part target as one array column."""
    return F.array(*[F.col(c).cast("int") for c in cols])


def drop_zero_scores(df: DataFrame, score: str = "audit_c_score") -> DataFrame:
    """Keep score > 0 (null scores are dropped, as in the source)."""
    return df.filter(F.col(score) > 0)


def drop_sentinel(df: DataFrame, col: str, sentinel: str = PMI_SKIP) -> DataFrame:
    """Drop the skip answer but keep nulls (``!=`` in pandas keeps NaN)."""
    return df.filter(~F.col(col).eqNullSafe(F.lit(sentinel)))


def severity(col: str, mapping: Mapping[str, int]) -> Column:
    """L3: ordinal code from a literal map; unmapped answers -> null."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(int(v))]
    return F.create_map(*pairs)[F.col(col)]


def encode_severity(df: DataFrame, col: str, mapping: Mapping[str, int],
                    sentinel: str | None = PMI_SKIP, out: str | None = None) -> DataFrame:
    """P2 + L3 as the source does it: drop the sentinel, then map in place."""
    if sentinel is not None:
        df = drop_sentinel(df, col, sentinel)
    return df.withColumn(out or col, severity(col, mapping))


def insurance_type(df: DataFrame, empl: str = "empl_merge", non_empl: str = "non_empl_merge",
                   out: str = "empl_insurance_or_not") -> DataFrame:
    """P3 + L4: keep people with either insurance flag; type = non-employer flag as int
    (both flags -> 1)."""
    return (df.filter((F.col(empl) == 1) | (F.col(non_empl) == 1))
              .withColumn(out, F.col(non_empl).cast("int")))


def int_score(col: str = "audit_c_score") -> Column:
    """Integer cast (null stays null)."""
    return F.col(col).cast("int")
