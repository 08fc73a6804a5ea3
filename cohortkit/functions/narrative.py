"""Narrative text and prompt columns (T1-T8, T10). All are Column expressions: they
run inside whole-stage codegen, no Python per row.

Null rendering follows the source's f-strings: a missing value prints ``None``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt template, separators and prefixes.
HEAD = ("### Score the user's Alcohol Use Disorders Identification Test (AUDIT-C) "
        "from 0 to 12 based on the provided demographics and comorbidity data:\n")
TAIL = "\n### AUDIT-C Score:"
DRUG_PREFIX = "Recent drug: "
PIPE = " | "
COMMA = ", "
NO_DRUG = "no_drug"
DEMOGRAPHICS = ("gender", "race", "ethnicity", "age")
# columns the comma narrative never prints
COMMA_SKIP = ("q1_score", "q2_score", "q3_score", "audit_c_score", "person_id", "split")


def text(c: str | Column) -> Column:
    """A value as the source prints it: string cast, null -> 'None'."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit("None"))


def unpipe(col: str = "standard_concept_name") -> Column:
    """Literal ' | ' -> ', ' (not a regex)."""
    return F.replace(F.col(col), F.lit(PIPE), F.lit(COMMA))


def drug_phrase(col: str = "standard_concept_name", prefix: str = DRUG_PREFIX) -> Column:
    """Prefix + unpiped names; no drugs -> 'None'."""
    return F.concat(F.lit(prefix), F.coalesce(unpipe(col), F.lit("None")))


def format_drug(col: str = "standard_concept_name", prefix: str = DRUG_PREFIX,
                suffix: str = ".") -> Column:
    """Prefix + unpiped names + suffix; null stays null."""
    return F.concat(F.lit(prefix), unpipe(col), F.lit(suffix))


def flags_to_text(flag_cols: Sequence[str]) -> Column:
    """T4 part: names of the flags set to 1 (``_`` -> space), ', '-joined; 'None' if none."""
    names = F.array(*[F.when(F.col(c) == 1, F.lit(c.replace("_", " "))) for c in flag_cols])
    joined = F.array_join(names, COMMA)  # nulls are skipped
    return F.when(joined == "", F.lit("None")).otherwise(joined)


def semicolon_narrative(comorbidity: Column | str = "comorbidity",
                        drug: Column | str | None = "standard_concept_name",
                        demographics: Sequence[str] = DEMOGRAPHICS) -> Column:
    """T4: ``k: v; ...; Comorbidity: c; Recent drug: d.`` -- demographics, comorbidity,
    drugs, in that order. ``drug=None`` leaves the drug block out."""
    parts = [F.concat(F.lit(f"{k}: "), text(k)) for k in demographics]
    parts.append(F.concat(F.lit("Comorbidity: "), text(comorbidity)))
    if drug is not None:
        parts.append(F.concat(F.lit(DRUG_PREFIX), text(drug), F.lit(".")))
    return F.concat_ws("; ", *parts)


def comma_narrative(columns: Sequence[str], n_drugs: int = 3, with_date: bool = True,
                    name: str = "concept_name", date: str = "drug_exposure_start_date") -> Column:
    """T5: ``k: v, ...`` over the row's columns (in the given order, skipping ids, scores
    and split) with the numbered drug/date pairs moved to the end."""
    pair_cols = {f"{name}_{i}" for i in range(1, n_drugs + 1)} | {f"{date}_{i}" for i in range(1, n_drugs + 1)}
    parts = [F.concat(F.lit(f"{k}: "), text(k)) for k in columns
             if k not in COMMA_SKIP and k not in pair_cols]
    for i in range(1, n_drugs + 1):
        if with_date:
            parts.append(F.concat(F.lit("Concept Name: "), text(f"{name}_{i}"),
                                  F.lit(" (Exposure Start Date: "), text(f"{date}_{i}"), F.lit(")")))
        else:
            parts.append(F.concat(F.lit("Concept Name: "), text(f"{name}_{i}")))
    return F.concat_ws(COMMA, *parts)


def spaced_narrative(columns: Sequence[str], target: str = "audit_c_score") -> Column:
    """``k: v`` for every column but the target, space-joined."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{k}: "), text(k)) for k in columns if k != target])


def prompt(with_target: bool = True, score: str = "audit_c_score") -> Column:
    """Instruction head + ``Gender=..,\\nRace=..`` body + tail (+ ' ' + score)."""
    body = F.concat(F.lit("Gender="), text("gender"), F.lit(",\nRace="), text("race"),
                    F.lit(",\nEthnicity="), text("ethnicity"), F.lit(",\nAge="), text("age"),
                    F.lit(",\nComorbidity="), text("comorbidity"), F.lit("\n"))
    parts = [F.lit(HEAD), body, F.lit(TAIL)]
    if with_target:
        parts += [F.lit(" "), text(score)]
    return F.concat(*parts)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse_score(col: str, marker: str = TAIL.strip(), lo: int = 0, hi: int = 12) -> tuple[Column, Column]:
    """The integer after the last marker. Returns (score, ok): score is null and
    ok false when the tail is not an integer or is outside [lo, hi] (the source
    aborts; here such rows are counted as rejects)."""
    tail = _strip(F.element_at(F.split(F.col(col), re.escape(marker)), -1))
    is_int = tail.rlike(r"^[+-]?[0-9]+$")
    val = F.when(is_int, tail.try_cast("bigint"))
    ok = is_int & val.between(lo, hi)
    return F.when(ok, val.cast("int")), F.coalesce(ok, F.lit(False))


def text_or_placeholder(col: str, placeholder: str = NO_DRUG) -> Column:
    """Text cast, null -> placeholder."""
    return F.coalesce(F.col(col).cast("string"), F.lit(placeholder))
