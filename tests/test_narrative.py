"""Golden strings written by hand from the source formatters."""
from cohortkit.functions import narrative as N


def test_semicolon_narrative(spark):
    df = spark.createDataFrame([("Man", "White", "Non-Hispanic", 45.0, 1, 0, "a | b"),
                                ("Woman", None, "X", 30.0, 0, 0, None)],
                               "gender string, race string, ethnicity string, age double, "
                               "Renal_Disease int, HIV int, standard_concept_name string")
    out = [r[0] for r in df.select(N.semicolon_narrative(N.flags_to_text(["Renal_Disease", "HIV"]),
                                                         N.unpipe())).collect()]
    assert out == ["gender: Man; race: White; ethnicity: Non-Hispanic; age: 45.0; Comorbidity: Renal Disease; "
                   "Recent drug: a, b.",
                   "gender: Woman; race: None; ethnicity: X; age: 30.0; Comorbidity: None; Recent drug: None."]


def test_comma_narrative_moves_drugs_last(spark):
    cols = ["person_id", "gender", "concept_name_1", "drug_exposure_start_date_1", "age", "split"]
    df = spark.createDataFrame([(7, "Man", "x", "2020-01-01", 50.0, "train")],
                               "person_id long, gender string, concept_name_1 string, "
                               "drug_exposure_start_date_1 string, age double, split string")
    got = df.select(N.comma_narrative(cols, n_drugs=1)).first()[0]
    assert got == "gender: Man, age: 50.0, Concept Name: x (Exposure Start Date: 2020-01-01)"
    got2 = df.select(N.comma_narrative(cols, n_drugs=1, with_date=False)).first()[0]
    assert got2 == "gender: Man, age: 50.0, Concept Name: x"


def test_prompt_and_spaced(spark):
    df = spark.createDataFrame([("Man", "W", "E", 20.0, None, 5)],
                               "gender string, race string, ethnicity string, age double, "
                               "comorbidity string, audit_c_score int")
    p = df.select(N.prompt()).first()[0]
    assert p == (N.HEAD + "Gender=Man,\nRace=W,\nEthnicity=E,\nAge=20.0,\nComorbidity=None\n"
                 + "\n### AUDIT-C Score: 5")
    s = df.select(N.spaced_narrative(df.columns)).first()[0]
    assert s == "gender: Man race: W ethnicity: E age: 20.0 comorbidity: None"


def test_drug_phrases(spark):
    df = spark.createDataFrame([("a | b",), (None,)], "standard_concept_name string")
    rows = df.select(N.drug_phrase(), N.format_drug(), N.text_or_placeholder("standard_concept_name")).collect()
    assert tuple(rows[0]) == ("Recent drug: a, b", "Recent drug: a, b.", "a | b")
    assert tuple(rows[1]) == ("Recent drug: None", None, "no_drug")


def test_parse_score_rejects(spark):
    df = spark.createDataFrame([(t,) for t in ["x", "", "### AUDIT-C Score: 13", "### AUDIT-C Score: -1",
                                                "blah ### AUDIT-C Score:  7\n"]], "c string")
    score, ok = N.parse_score("c")
    rows = df.select(score.alias("s"), ok.alias("ok")).collect()
    assert [r["s"] for r in rows] == [None, None, None, None, 7]
    assert sum(r["ok"] for r in rows) == 1
