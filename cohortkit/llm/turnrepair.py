"""Conversation structure repair: target alignment after Wagner and Fischer.

A conversation's turns are aligned to the strings of the grammar ``(s?(ua)+)?`` (s system,
u user, a assistant). Edits: Keep 0 (the role's initial is the target's letter), Rerole to
user or assistant 2, Delete 3, Insert an empty user or assistant turn 2; a blank turn and a
repeated one must be deleted; a truncated turn that is not deleted adds 1.

All targets of even length end alike (``...uaua``) and those of odd length are one ``s``
before them, so one table over (turns left, letters left) holds the alignment to every
length: its first row has a cell for each. Its width is Ukkonen's band: a cell whose counts
differ by so much that the deletions or insertions alone pass the incumbent cost (the best
of four plain repairs) is left out, and with it every length that is not feasible. Every
length of the least cost is backtraced and the audits (the edits' initials in order) are
compared: the ASCII-least wins. Of the table's rows every sqrt(n)-th is kept and the rest
made again, block by block, during backtracing.

The alignment sees one letter a turn; equal conversations of letters are aligned once per
worker. Faults, counts and the repaired turns are column expressions.

Defined cases: a null role or text is one space (a blank turn); a turn without a number
comes first; turns of one number go by role, then text; an empty or other role can only be
reroled; no turn at all gives zeros and an empty audit; repeated rows are duplicates. A null
id is a conversation like any other; other columns are left out, whatever their names. The
audit and the repaired text are one value per conversation, so a conversation's turns meet
in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortkit.llm.common import ship_by_value

REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
FORCED = "x"                   # letter of a turn that must go; capitals are truncated turns
FAR = 1 << 40
ALIGNED = "cost long, audit string, source array<int>, role array<string>"
MEMO, SHORT = 1 << 14, 64      # alignments a task keeps, of conversations of so many turns
ship_by_value(__name__)


# ---------------------------------------------------------------- alignment
def _incumbent(letters: str) -> int:
    """Cost of the best of four plain repairs, each linear."""
    plain = [c for c in letters if c != FORCED]
    base = DELETE * (len(letters) - len(plain))
    cut = sum(c.isupper() for c in plain)
    kept = [c.lower() for c in plain]

    def alternate(rest, inserting):
        cost, want = 0, 0
        for c in rest:
            if c != "ua"[want]:
                cost += INSERT if inserting and c in "ua" else REROLE
                want ^= inserting and c in "ua"
            want ^= 1
        return cost + INSERT * want

    tries = [DELETE * len(plain)]
    if kept:
        tries += [cut + alternate(kept, False), cut + alternate(kept, True)]
    if kept[:1] == ["s"]:
        tries.append(cut + (alternate(kept[1:], False) if kept[1:] else 2 * INSERT))
    return base + min(tries)


class _Table:
    """Least costs by turns left (rows) and letters left (cells ``m - below ...``, with m the
    turns left that need not go): ``cost`` without and ``lead`` with an s still to come."""

    def __init__(self, letters: str):
        self.letters, self.n = letters, len(letters)
        free = np.array([c != FORCED for c in letters], dtype=np.int64)
        self.left = np.append(free[::-1].cumsum()[::-1], 0)
        slack = _incumbent(letters) - DELETE * (self.n - int(free.sum()))
        self.below, width = slack // DELETE + 1, slack // DELETE + slack // INSERT + 3
        self.steps = np.arange(width, dtype=np.int64)
        r = self.steps - self.below
        row = np.where(r >= 0, INSERT * r, FAR), np.full(width, FAR, dtype=np.int64)
        self.block = max(1, isqrt(self.n))
        self.kept = {self.n: row}
        for i in range(self.n - 1, -1, -1):
            row = self._before(i, row)
            if i % self.block == 0:
                self.kept[i] = row
        self.rows = dict(self.kept)

    def _before(self, i, row):
        """Row i from row i + 1."""
        cost, lead = row
        c = self.letters[i]
        if c == FORCED:
            return np.minimum(cost + DELETE, FAR), np.minimum(lead + DELETE, FAR)
        r = self.left[i] - self.below + self.steps
        cut, base = CUT_OFF * c.isupper(), c.lower()
        letter_u, letter_a = (0 if base == x else REROLE for x in "ua")
        same = np.where(r >= 1, cost + np.where(r % 2 == 1, letter_a, letter_u) + cut, FAR)
        gone = np.append(cost[1:], FAR) + DELETE
        best = np.where(r >= 0, np.minimum(same, gone), FAR)
        best = np.minimum.accumulate(best - INSERT * self.steps) + INSERT * self.steps
        first = np.append(lead[1:], FAR) + DELETE
        if base == "s":
            first = np.minimum(first, np.append(cost[1:], FAR) + cut)
        return np.where(r >= 0, np.minimum(best, FAR), FAR), np.where(r >= 2, np.minimum(first, FAR), FAR)

    def at(self, i: int, r: int, lead: bool) -> int:
        if i not in self.rows:
            end = min(self.n, (i // self.block + 1) * self.block)
            self.rows = dict(self.kept)
            row = self.kept[end]
            for k in range(end - 1, end - self.block - 1, -1):
                row = self.rows[k] = self._before(k, row)
        t = r - int(self.left[i]) + self.below
        return int(self.rows[i][lead][t]) if 0 <= t < len(self.steps) else FAR

    def lengths(self):
        """(cost, letters after an s, with s) of every feasible target."""
        for r in range(max(0, int(self.left[0]) - self.below), int(self.left[0]) - self.below + len(self.steps)):
            if r % 2 == 0:
                for lead in (False, True):
                    if (cost := self.at(0, r, lead)) < FAR:
                        yield cost, r, lead

    def _edit(self, i: int, r: int, lead: bool):
        """The ASCII-least edit of least cost from a cell, and the letters left after it."""
        value, c = self.at(i, r, lead), self.letters[i] if i < self.n else FORCED
        cut, base, want = CUT_OFF * c.isupper(), c.lower(), "s" if lead else "ua"[r % 2]
        rest = r if lead else r - 1
        if i < self.n and value == DELETE + self.at(i + 1, r, lead):
            return "D", r, lead
        if not lead and r and value == INSERT + self.at(i, r - 1, False):
            return "I", r - 1, False
        if c != FORCED and base == want and value == cut + self.at(i + 1, rest, False):
            return "K", rest, False
        return "R", rest, False

    def backtrace(self, targets) -> str:
        """The ASCII-least audit of the given targets (letters left, s to come), all of least
        cost. They are traced side by side, and where their edits differ the least goes on."""
        out, i = [], 0
        while i < self.n or any(r or lead for r, lead in targets):
            edits = [self._edit(i, r, lead) for r, lead in targets]
            out.append(min(e[0] for e in edits))
            targets = [e[1:] for e in edits if e[0] == out[-1]]
            i += out[-1] != "I"
        return "".join(out)


def align(letters: str) -> tuple[int, str, list[int], list[str | None]]:
    """Least cost, audit, and of each turn of the repaired conversation the number of the
    turn it comes from (-1: inserted) and its new role (None: as it was)."""
    table = _Table(letters)
    ends = list(table.lengths())
    cost = min(e[0] for e in ends)
    audit = table.backtrace([e[1:] for e in ends if e[0] == cost])
    odd = (len(audit) - audit.count("D")) % 2
    source, role, i = [], [], 0
    for edit in audit:
        if edit != "D":
            role.append(None if edit == "K" else ("user", "assistant")[(len(role) + odd) % 2])
            source.append(-1 if edit == "I" else i)
        i += edit != "I"
    return cost, audit, source, role


def _aligned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    again = lru_cache(MEMO)(align)
    for letters in batches:
        found = [(again if len(x) <= SHORT else align)(x) for x in letters]
        yield pd.DataFrame(found, columns=["cost", "audit", "source", "role"])


# ---------------------------------------------------------------- Spark side
def _letter() -> Column:
    role = F.substring("role", 1, 1)
    plain = F.when(role.isin("s", "u", "a"), role).otherwise("o")
    return (F.when(F.col("fault").isin("blank", "duplicate"), FORCED)
            .when(F.col("fault") == "truncated", F.upper(plain)).otherwise(plain))


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", absent: Column | None = None) -> DataFrame:
    """One row per id: gaps, blank, duplicate, truncated, illegal, cost (long), audit and
    ``repaired`` (role, text of each turn). Rows for which ``absent`` holds are no turns but
    name a conversation that is to be returned."""
    gone = F.lit(False) if absent is None else F.coalesce(absent, F.lit(False))
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), gone.alias("gone"))
    body = F.rtrim("text", F.lit(SPACES))
    seen = W.partitionBy("id", "gone", "role", "text").orderBy("turn")
    fault = (F.when(body == "", "blank").when(F.row_number().over(seen) > 1, "duplicate")
             .when(~F.substring(body, -1, 1).isin(*ENDS), "truncated"))
    # one exchange serves the window and the groups
    rows = rows.repartition(F.col("id")).withColumn("fault", fault)
    turn = F.struct("turn", "role", "text", _letter().alias("letter"))
    counted = lambda f: F.count_if((F.col("fault") == f) & ~F.col("gone")).alias(f)
    there = F.when(~F.col("gone"), F.col("turn"))
    span = F.max(there) - F.min(there) + 1 - F.count_distinct(there)
    grouped = rows.groupBy("id").agg(
        F.coalesce(span, F.lit(0)).alias("gaps"), *[counted(f) for f in ("blank", "duplicate", "truncated")],
        F.array_sort(F.collect_list(F.when(~F.col("gone"), turn))).alias("turns"))
    letters = F.array_join(F.transform("turns", lambda t: t["letter"]), "")
    initials = F.array_join(F.transform("turns", lambda t: F.rpad(F.substring(t["role"], 1, 1), 1, "-")), "")
    legal = F.regexp_count(initials, F.lit("(?=su|ua|au)"))
    found = grouped.select(
        "*", (F.greatest(F.size("turns") - 1, F.lit(0)) - legal).cast("long").alias("illegal"),
        F.pandas_udf(_aligned, ALIGNED)(letters).alias("a"))
    made = F.transform(
        F.arrays_zip(F.col("a.source"), F.col("a.role")),
        lambda e: F.struct(F.coalesce(e["role"], F.col("turns")[e["source"]]["role"]).alias("role"),
                           F.when(e["source"] < 0, "").otherwise(F.try_element_at("turns", e["source"] + 1)["text"])
                           .alias("text")))
    return found.select(F.col("id").alias(id_col), "gaps", "blank", "duplicate", "truncated", "illegal",
                        F.col("a.cost").alias("cost"), F.col("a.audit").alias("audit"), made.alias("repaired"))
