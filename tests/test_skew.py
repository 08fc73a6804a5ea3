"""One key holding a third of all rows: results stay exact and whole."""
import random

import pytest
from pyspark.sql import functions as F

from cohortkit.operators import cohort as CO
from cohortkit.operators import screen as SC
from cohortkit.operators import tokens as TK


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(3000):
        person = 0 if i % 3 == 0 else rnd.randint(1, 400)   # person 0 holds a third
        rows.append((person, f"drug{rnd.randint(0, 30)}", 20000 + rnd.randint(0, 900), i))
    return rows, spark.createDataFrame(rows, "person_id long, concept_name string, day int, k long") \
        .withColumn("drug_exposure_start_date", F.expr("date_add(date'1970-01-01', day)"))


def test_sequence_skew_safe_equals_window(spark, skewed):
    rows, df = skewed
    order = [F.col("drug_exposure_start_date").desc(), F.col("concept_name"), F.col("k")]
    a = {r["k"]: r["n"] for r in CO.sequence(df, "person_id", order, partitions=7).collect()}
    b = {r["k"]: r["n"] for r in CO.sequence(df, "person_id", order, skew_safe=False).collect()}
    assert a == b and len(a) == len(rows)
    assert max(v for k, v in a.items()) == 1000  # the hot person numbered 1..1000


def test_top_n_has_partial_group_limit(spark, skewed):
    _, df = skewed
    top = CO.top_n(df, "person_id", [F.col("drug_exposure_start_date").desc(), F.col("k")], 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert top.where("person_id = 0").count() == 3


def test_token_summary_with_hot_token(spark, skewed):
    rows, df = skewed
    packed = df.groupBy("person_id").agg(F.array_join(F.array_sort(F.collect_set("concept_name")), " | ").alias("d"))
    lab = packed.withColumn("group", (F.col("person_id") % 2).cast("int"))
    long = TK.to_long(lab, "person_id", "d", " | ", keep=["group"])
    got = {r["feature"]: (r["a"], r["b"]) for r in SC.token_summary(long).collect()}
    held = {}
    for p, d, _, _ in rows:
        held.setdefault(d, set()).add(p)
    for d, ps in held.items():
        assert got[d] == (sum(1 for p in ps if p % 2 == 1), sum(1 for p in ps if p % 2 == 0))


def test_rollup_and_dedupe_with_hot_person(spark, skewed):
    import datetime as dt
    rows, df = skewed
    got = {r["person_id"]: r["standard_concept_name"] for r in CO.recent_tokens(df, months=6).collect()}
    base = dt.date(1970, 1, 1)
    by_person = {}
    for p, name, day, _ in rows:
        by_person.setdefault(p, []).append((base + dt.timedelta(days=day), name))
    for p, ex in by_person.items():
        idx = max(d for d, _ in ex)
        m, y = idx.month - 6, idx.year
        if m <= 0:
            m, y = m + 12, y - 1
        import calendar
        lo = dt.date(y, m, min(idx.day, calendar.monthrange(y, m)[1]))
        assert got[p] == " | ".join(sorted({n for d, n in ex if d >= lo}))
    first = {r["person_id"]: r["k"] for r in CO.keep_first(df, "person_id", [F.col("k")]).collect()}
    assert first[0] == 0 and len(first) == len(by_person)
