"""Cohort assembly on hand-made fixtures (FIXTURES.md C)."""
import pytest
from pyspark.sql import functions as F

from cohortkit.operators import cohort as CO
from cohortkit.operators import encode as EN
from cohortkit.operators import labels as LB
from cohortkit.operators import split as SP
from cohortkit.operators import tokens as TK


def test_pivot_drops_person_without_drugs(spark):
    persons = spark.createDataFrame([(1, "Man"), (2, "Woman"), (3, "Man")], "person_id long, gender string")
    expo = spark.createDataFrame([(1, "b", "2020-01-02"), (1, "a", "2020-01-01"), (3, "c", "2020-05-01")],
                                 "person_id long, concept_name string, d string") \
        .withColumn("d", F.col("d").cast("date"))
    wide = CO.top_n_wide(expo, "person_id", [F.col("d").desc(), F.col("concept_name")],
                         ["concept_name", "d"], n=3)
    out = {r["person_id"]: r for r in persons.join(wide, "person_id").collect()}
    assert set(out) == {1, 3}
    assert (out[1]["concept_name_1"], out[1]["concept_name_2"], out[1]["concept_name_3"]) == ("b", "a", "")
    assert out[1]["d_1"] == "2020-01-02" and out[3]["d_2"] == ""


def test_sentinel_filter_keeps_null(spark):
    df = spark.createDataFrame([("x",), (None,), ("PMI: Skip",)], "fatigue string")
    assert sorted(r[0] or "" for r in LB.drop_sentinel(df, "fatigue").collect()) == ["", "x"]


def test_severity_map_unmapped_is_null(spark):
    df = spark.createDataFrame([("Average Fatigue 7 Days: Mild",), ("odd",)], "fatigue string")
    out = LB.encode_severity(df, "fatigue", LB.SEVERITY_MAPPINGS["fatigue"]).collect()
    assert [r[0] for r in out] == [1, None]


def test_match_and_merge_fans_out(spark):
    persons = spark.createDataFrame([(1, "Man")], "person_id long, gender string")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "PERSON_ID long, STANDARD_CONCEPT_NAME string")
    out = CO.match_and_merge(persons, right, right_key="PERSON_ID", right_cols=["STANDARD_CONCEPT_NAME"],
                             keep=["person_id", "gender"])
    assert out.count() == 2 and "standard_concept_name" in out.columns


def test_codes_reference_and_null(spark):
    df = spark.createDataFrame([("b",), ("c",), (None,), ("b",)], "race string")
    out = [r[0] for r in EN.codes(df, {"race": "White"}, suffix="_c").select("race_c").collect()]
    assert out == [1, 2, -1, 1]  # absent reference keeps 0 unused


def test_substring_vs_token_indicators(spark):
    df = spark.createDataFrame([(1, "aspirin 81 MG | x"), (2, "aspirin")], "person_id long, drugs string")
    long = TK.to_long(df, "person_id", "drugs", " | ")
    tok = {(r[0], r[1]) for r in long.collect()}
    sub = {(r[0], r[1]) for r in TK.substring_long(long, "person_id", out="m").collect()}
    assert (1, "aspirin") not in tok
    assert (1, "aspirin") in sub and (1, "aspirin 81 MG") in sub and (2, "aspirin 81 MG") not in sub


def test_wide_indicators_agree_with_long(spark):
    df = spark.createDataFrame([(1, "A,B"), (2, None), (3, "B_x")], "person_id long, como string")
    wide = TK.indicators_wide(df, "person_id", "como", ",", ["A", "B", "B_x"]).collect()
    assert [tuple(r) for r in wide] == [(1, 1, 1, 0), (2, 0, 0, 0), (3, 0, 0, 1)]
    assert wide[0].__fields__ == ["person_id", "A", "B", "B x"]


def test_exact_split_sizes_and_disjoint(spark):
    df = spark.range(1000).withColumnRenamed("id", "person_id")
    out = SP.exact_split(df, "person_id", {"validation": 20, "test": 50})
    counts = {r["split"]: r["n_rows"] for r in SP.split_counts(out).collect()}
    assert counts == {"validation": 20, "test": 50, "train": 930}
    assert out.select("person_id").distinct().count() == 1000
    again = {r["person_id"] for r in SP.exact_split(df, "person_id", {"validation": 20, "test": 50})
             .where("split = 'test'").collect()}
    assert again == {r["person_id"] for r in out.where("split = 'test'").collect()}


def test_recent_tokens_window(spark):
    rows = [(1, "a", "2024-08-31"), (1, "b", "2024-02-29"), (1, "c", "2024-02-28"), (2, "d", "2020-01-01")]
    df = spark.createDataFrame(rows, "person_id long, concept_name string, d string") \
        .withColumn("drug_exposure_start_date", F.col("d").cast("date"))
    out = {r["person_id"]: r["standard_concept_name"] for r in CO.recent_tokens(df).collect()}
    assert out == {1: "a | b", 2: "d"}


def test_keep_first_and_profile(spark):
    df = spark.createDataFrame([(1, 3, None), (1, 1, "x"), (2, 5, "y")], "k long, o long, v string")
    kept = {r["k"]: r["o"] for r in CO.keep_first(df, "k", [F.col("o")]).collect()}
    assert kept == {1: 1, 2: 5}
    prof = CO.profile(df).collect()[0]
    assert prof["n_rows"] == 3 and prof["null_v"] == 1


def test_insurance_type(spark):
    df = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0)], "person_id long, empl_merge int, non_empl_merge int")
    out = {r["person_id"]: r["empl_insurance_or_not"] for r in LB.insurance_type(df).collect()}
    assert out == {1: 0, 2: 1}


def test_substring_rejects_separator_in_names(spark):
    df = spark.createDataFrame([(1, "a|b | c")], "person_id long, drugs string")
    long = TK.to_long(df, "person_id", "drugs", " | ")
    with pytest.raises(ValueError):
        TK.substring_long(long, "person_id", out="m")


def test_ranked_split_equals_topk_split(spark):
    df = spark.range(3000).withColumnRenamed("id", "person_id")
    sizes = {"validation": 200, "test": 500}
    a = {r["person_id"]: r["split"] for r in SP.exact_split(df, "person_id", sizes).collect()}
    b = {r["person_id"]: r["split"] for r in SP.exact_split(df, "person_id", sizes, max_topk=10).collect()}
    assert a == b


def test_null_semantics_table(spark):
    """SURVEY §1.3: the pandas null rules the operators keep."""
    df = spark.createDataFrame([(1, 5, None), (2, None, "a | b"), (3, 0, "c")],
                               "person_id long, audit_c_score int, drugs string")
    assert [r[0] for r in LB.drop_zero_scores(df).select("person_id").collect()] == [1]   # null score dropped
    long = TK.to_long(df, "person_id", "drugs", " | ")
    assert sorted(r[0] for r in long.select("person_id").distinct().collect()) == [2, 3]   # null list: no tokens
    wide = {r[0]: r[1] for r in TK.indicators_wide(df, "person_id", "drugs", " | ", ["a"]).collect()}
    assert wide == {1: 0, 2: 1, 3: 0}                                                     # null list -> 0
    from cohortkit.functions import narrative as N
    assert df.select(N.format_drug("drugs")).first()[0] is None                            # prefix + null
    assert df.select(N.text("audit_c_score")).collect()[1][0] == "None"                   # f-string on null


def test_codes_on_numeric_column(spark):
    df = spark.createDataFrame([(3,), (1,), (None,), (3,)], "grade int")
    out = [r[0] for r in EN.codes(df, {"grade": 3}, suffix="_c").select("grade_c").collect()]
    assert out == [0, 1, -1, 0]


def test_vocabulary_exact_and_sketch(spark):
    rows = [(p, f"t{p % 7}") for p in range(700)] + [(p, "hot") for p in range(700)]
    long = spark.createDataFrame(rows, "person_id long, token string")
    exact = {r["token"]: r["n_keys"] for r in TK.vocabulary(long).collect()}
    assert exact["hot"] == 700 and exact["t3"] == 100
    approx = {r["token"]: r["n_keys"] for r in TK.vocabulary(long, approx_rsd=0.02).collect()}
    assert abs(approx["hot"] - 700) <= 700 * 0.08


def _tokens(spark, packed, **kw):
    df = spark.createDataFrame([(1, packed)], "person_id long, drugs string")
    return sorted(r["token"] for r in TK.to_long(df, "person_id", "drugs", " | ", **kw).collect())


@pytest.mark.parametrize("unique_key", [False, True])
def test_tokens_keep_digits_at_both_ends(spark, unique_key):
    packed = "0.9% saline | 1-2-3 mix | drug9 | vitamin B1 | 3-in-1 oil 4 | 5"
    assert _tokens(spark, packed, unique_key=unique_key) == sorted(packed.split(" | "))


def test_tokens_lose_outer_blanks_only(spark):
    assert _tokens(spark, "  a b  |  c | d  ") == ["a b", "c", "d"]


def test_token_that_equals_its_index_stays(spark):
    assert _tokens(spark, "0 | 1 | 2 | x") == ["0", "1", "2", "x"]


@pytest.mark.parametrize("shard", [200_000, 7])
def test_substring_equals_plain_search(spark, monkeypatch, shard):
    import random
    monkeypatch.setattr(TK, "SHARD_NAMES", shard)
    rnd = random.Random(shard)
    names = ["".join(rnd.choice("ab é1") for _ in range(rnd.randint(1, 6))).strip() or "z" for _ in range(60)]
    rows = [(p, " | ".join(rnd.sample(names, 4))) for p in range(40)] + [(99, None), (98, "")]
    long = TK.to_long(spark.createDataFrame(rows, "person_id long, drugs string"), "person_id", "drugs", " | ")
    got = {(r["person_id"], r["match"]) for r in TK.substring_long(long).collect()}
    known = {t for _, d in rows if d for t in d.split(" | ")}
    assert got == {(p, n) for p, d in rows if d for n in known if any(n in t for t in d.split(" | "))}
    other = spark.createDataFrame([("a",), ("é1",), ("",), ("a",)], "token string")
    sub = {(r["person_id"], r["match"]) for r in TK.substring_long(long, vocab=other).collect()}
    assert sub == {(p, n) for p, d in rows if d for n in ("a", "é1") if n in d}
    assert TK.substring_long(long.limit(0)).count() == 0


def test_substring_pairs_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(TK, "PAIR_ROWS", 50)
    rows = [(p, "a | ab | abc") for p in range(100)]  # 600 (person, name) rows with repeats
    long = TK.to_long(spark.createDataFrame(rows, "person_id long, drugs string"), "person_id", "drugs", " | ")
    got = TK.substring_long(long.coalesce(1))
    assert got.rdd.getNumPartitions() == 12
    assert sorted(map(tuple, got.collect())) == sorted((p, n) for p in range(100) for n in ("a", "ab", "abc"))
