"""Driver contract and plan shape checks."""
import pytest

import __spark_entry__ as E
from tests.conftest import SF0001

# queries whose construction fits models (slow); plan checks skip them
HEAVY = {"baseline_rf", "baseline_linear", "baseline_linear_1f", "baseline_ridge", "baseline_elastic", "elastic_small", "scaled_features",
         "baseline_svr", "ridge_grid"}


def test_entry_returns_volcano(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"feature_group", "feature", "log2fc", "p_value",
                                        "p_value_corrected", "neg_log10_q"}
    groups = {r["feature_group"] for r in rows}
    assert groups == {"demo", "drug", "comorbidity"}
    for r in rows:
        if r["p_value"] is not None:
            assert 0.0 <= r["p_value"] <= 1.0 and r["p_value_corrected"] >= r["p_value"] - 1e-12


def test_oracle_keys_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.oracle_sql()) >= 40


@pytest.mark.parametrize("name", sorted(set(E.queries()) - HEAVY))
def test_plan_has_no_cartesian_or_row_udf(spark, name):
    df = E.queries()[name](spark, SF0001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, f"{name}: {bad} in plan"


PERSON_LEVEL = ["top3_exposures", "three_drug_pivot", "exposure_sequence", "drug_rollup_6m", "token_vocab",
                "matched_inner", "left_exposures", "narrative_comma", "indicator_substring", "accumulated_effect",
                "dedupe_texts", "vocab_setops"]


@pytest.mark.parametrize("name", PERSON_LEVEL)
def test_person_level_plans_never_single_partition(spark, name):
    """No window or exchange funnels person-sized data into one partition."""
    plan = E.queries()[name](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan, name
