from conftest import values

from perilake.operators.chunks import chunk


def test_each_group_has_its_own_id(spark):
    keys = [("a/b", "c"), ("a", "b/c"), (None, "c"), ("unknown", "c"), ("%", "c"), ("%2F", "c")]
    figures = (1, 2.0, 1.0, 3.0, 4.0, 5.0, 6.0)
    names = "total_policies int, avg_premium double, min_premium double, max_premium double, " \
            "avg_insured_value double, avg_claim_paid double, claim_rate_pct double"
    df = spark.createDataFrame([(*k, *figures) for k in keys], f"TYPE_VEHICLE string, USAGE string, {names}")
    ids = [r[0] for r in values(chunk(df, "motor"), "chunk_id")]
    assert len(set(ids)) == len(keys) and "motor/a%2Fb/c" in ids
    tiers = spark.createDataFrame([(None, "High", 1, 1.0, 1.0), (2, "High", 1, 1.0, 1.0), (120, "High", 1, 1.0, 1.0)],
                                  "risk_tier int, risk_level string, total_drivers int, claim_rate_pct double, avg_risk_score double")
    assert sorted(values(chunk(tiers, "claims_risk"), "chunk_id")) == [("claims_risk/%",), ("claims_risk/120",), ("claims_risk/2",)]
