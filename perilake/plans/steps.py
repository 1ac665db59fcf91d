"""Single operators of the load, each run over a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from perilake.functions import numeric, parsing, risk
from perilake.functions.ordering import top, up
from perilake.operators import cleaning, encoding, features
from perilake.plans.catalog import plan
from perilake.plans.checksql import TYPED, over_both, over_claims, over_motor
from perilake.sources import files, tables, testbed
from perilake.sources.schemas import CATEGORIES, CLAIMS, FEATURES, MOTOR

# --- sources and sinks -------------------------------------------------------


@plan("a01_csv_source", over_motor("SELECT * FROM bronze_motor"))
def a01(lake):
    path = lake.store.fresh_path("export", "motor_csv")
    files.write_csv(lake.bronze("motor"), path)
    return files.read_csv(lake.spark, path, MOTOR)


@plan("a02_missing_tokens", over_motor("SELECT * FROM bronze_motor"))
def a02(lake):
    return parsing.normalize_missing(testbed.motor_raw(lake.spark, lake.sf_dir))


@plan("a03_read_silver_motor", over_motor("SELECT * FROM silver_motor"))
def a03(lake):
    return lake.silver("motor")


@plan("a03_read_silver_claims", over_claims("SELECT * FROM silver_claims"))
def a03_claims(lake):
    return lake.silver("claims")


@plan("a04_write_gold_motor", over_motor("SELECT * FROM gold_motor"))
def a04(lake):
    name = f"motor-{uuid.uuid4().hex}"
    lake.store.write(features.gold_motor(lake.silver("motor")), "copy", name, partition_by=["USAGE"])
    return lake.store.read("copy", name)


@plan("a04_write_gold_claims", over_claims("SELECT * FROM gold_claims"))
def a04_claims(lake):
    return lake.gold("claims")


_LAYERS = [(layer, name) for name in ("claims", "motor") for layer in ("bronze", "silver", "gold")]


@plan(
    "a05_audit_counts",
    over_both(
        " UNION ALL ".join(
            f"SELECT '{layer}_{name}' AS table_name, count(*) AS row_count FROM {layer}_{name}"
            for layer, name in _LAYERS
        )
    ),
)
def a05(lake):
    return tables.audit_counts({f"{layer}_{name}": getattr(lake, layer)(name) for layer, name in _LAYERS})


@plan("a06_csv_sink", over_claims("SELECT * FROM gold_claims"))
def a06(lake):
    gold, path = lake.gold("claims"), lake.store.fresh_path("export", "claims_csv")
    files.write_csv(gold, path)
    return files.read_csv(lake.spark, path, gold.schema)


_ARRIVALS = "SELECT * REPLACE (ID + 100000 AS ID) FROM bronze_claims"


def _arrivals(lake):
    return lake.bronze("claims").withColumn("ID", F.col("ID") + 100000)


@plan("a09_append_batch", over_claims(f"SELECT * FROM bronze_claims UNION ALL {_ARRIVALS}"))
def a09(lake):
    return tables.append_batch(lake.bronze("claims"), _arrivals(lake))


@plan("u01_union_frames", over_claims(f"SELECT * FROM silver_claims UNION ALL {_ARRIVALS}"))
def u01(lake):
    return lake.silver("claims").unionByName(_arrivals(lake))


# --- projections, filters, missing data, duplicates --------------------------


@plan("b01_select_features", over_claims("SELECT " + ", ".join(FEATURES) + " FROM gold_claims"))
def b01(lake):
    return features.select_features(lake.gold("claims"), FEATURES)


@plan("b02_equality_filter", over_motor("SELECT MAKE, USAGE, CLAIM_PAID FROM gold_motor WHERE had_claim = 1"))
def b02(lake):
    return lake.gold("motor").where(F.col("had_claim") == 1).select("MAKE", "USAGE", "CLAIM_PAID")


@plan("b03_range_filter", over_motor("SELECT TYPE_VEHICLE, CLAIM_PAID FROM silver_motor WHERE CLAIM_PAID > 0"))
def b03(lake):
    return lake.silver("motor").where(F.col("CLAIM_PAID") > 0).select("TYPE_VEHICLE", "CLAIM_PAID")


@plan("b04_not_null_filter", over_motor("SELECT MAKE, PREMIUM FROM silver_motor WHERE MAKE IS NOT NULL"))
def b04(lake):
    return lake.silver("motor").where(F.col("MAKE").isNotNull()).select("MAKE", "PREMIUM")


@plan(
    "b05_drop_missing_any",
    over_claims("SELECT * FROM bronze_claims WHERE " + " AND ".join(f"{f.name} IS NOT NULL" for f in CLAIMS.fields)),
)
def b05(lake):
    return cleaning.drop_missing(lake.bronze("claims"))


@plan(
    "b06_drop_missing_subset",
    over_motor(
        f"SELECT * FROM ({TYPED} FROM bronze_motor) WHERE INSURED_VALUE IS NOT NULL AND PREMIUM IS NOT NULL"
    ),
)
def b06(lake):
    return cleaning.drop_missing(cleaning.type_motor(lake.bronze("motor")), ["INSURED_VALUE", "PREMIUM"])


@plan("b07_dedup_claims", over_claims("SELECT DISTINCT * FROM bronze_claims"))
def b07(lake):
    return cleaning.dedup(lake.bronze("claims"))


@plan("b07_dedup_motor", over_motor("SELECT DISTINCT * FROM bronze_motor"))
def b07_motor(lake):
    return cleaning.dedup(lake.bronze("motor"))


@plan(
    "b08_fill_missing",
    over_motor(
        """SELECT TYPE_VEHICLE, coalesce(TRY_CAST(CLAIM_PAID AS DOUBLE), 0) AS paid_filled,
        TRY_CAST(PROD_YEAR AS DOUBLE) AS PROD_YEAR, coalesce(TRY_CAST(PROD_YEAR AS DOUBLE), 2010) AS year_filled
        FROM bronze_motor"""
    ),
)
def b08(lake):
    year = parsing.to_number(F.col("PROD_YEAR"))
    return lake.bronze("motor").select(
        "TYPE_VEHICLE",
        F.coalesce(parsing.to_number(F.col("CLAIM_PAID")), F.lit(0.0)).alias("paid_filled"),
        year.alias("PROD_YEAR"),
        F.coalesce(year, F.lit(float(risk.DEFAULT_YEAR))).alias("year_filled"),
    )


@plan("b09_head", over_claims("SELECT * FROM silver_claims ORDER BY ID LIMIT 5"))
def b09(lake):
    return lake.silver("claims").orderBy(up("ID")).limit(5)


@plan(
    "b10_map_labels",
    over_claims(
        """SELECT ID, risk_tier, CASE risk_tier WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' END
        AS risk_label FROM gold_claims"""
    ),
)
def b10(lake):
    label = risk.map_values(F.col("risk_tier"), risk.TIER_BY_CODE)
    return lake.gold("claims").select("ID", "risk_tier", label.alias("risk_label"))


# --- scalar functions --------------------------------------------------------


@plan(
    "c01_parse_numbers",
    over_motor(
        """SELECT INSURED_VALUE AS insured_text, TRY_CAST(INSURED_VALUE AS DOUBLE) AS insured_number,
        TRY_CAST(PREMIUM AS DOUBLE) AS premium_number, TRY_CAST(PROD_YEAR AS DOUBLE) AS year_number,
        TRY_CAST(USAGE AS DOUBLE) AS usage_number FROM motor_raw"""
    ),
)
def c01(lake):
    return testbed.motor_raw(lake.spark, lake.sf_dir).select(
        F.col("INSURED_VALUE").alias("insured_text"),
        parsing.to_number(F.col("INSURED_VALUE")).alias("insured_number"),
        parsing.to_number(F.col("PREMIUM")).alias("premium_number"),
        parsing.to_number(F.col("PROD_YEAR")).alias("year_number"),
        parsing.to_number(F.col("USAGE")).alias("usage_number"),
    )


@plan(
    "c02_parse_dates",
    over_motor(
        """SELECT INSR_BEGIN AS begin_text, CAST(TRY_STRPTIME(INSR_BEGIN, '%d-%b-%y') AS DATE) AS begin_date,
        CAST(TRY_STRPTIME(INSR_END, '%d-%b-%y') AS DATE) AS end_date,
        CAST(TRY_STRPTIME(INSURED_VALUE, '%d-%b-%y') AS DATE) AS bad_date FROM bronze_motor"""
    ),
)
def c02(lake):
    return lake.bronze("motor").select(
        F.col("INSR_BEGIN").alias("begin_text"),
        parsing.to_date_coerce(F.col("INSR_BEGIN")).alias("begin_date"),
        parsing.to_date_coerce(F.col("INSR_END")).alias("end_date"),
        parsing.to_date_coerce(F.col("INSURED_VALUE")).alias("bad_date"),
    )


@plan(
    "c03_claim_flag",
    over_motor("SELECT CLAIM_PAID, CAST(CLAIM_PAID > 0 AS INTEGER) AS had_claim FROM silver_motor"),
)
def c03(lake):
    return lake.silver("motor").select("CLAIM_PAID", risk.had_claim(F.col("CLAIM_PAID")).alias("had_claim"))


@plan(
    "c03_mileage_flag",
    over_claims(
        """SELECT ID, ANNUAL_MILEAGE, CAST(coalesce(ANNUAL_MILEAGE > 15000, false) AS INTEGER) AS high_mileage_flag
        FROM bronze_claims"""
    ),
)
def c03_mileage(lake):
    flag = risk.high_mileage(F.col("ANNUAL_MILEAGE"))
    return lake.bronze("claims").select("ID", "ANNUAL_MILEAGE", flag.alias("high_mileage_flag"))


@plan(
    "c04_casts",
    over_both(
        """SELECT 'year' AS field, CAST(PROD_YEAR AS INTEGER) AS whole FROM silver_motor
        UNION ALL SELECT 'outcome', CAST(OUTCOME AS INTEGER) FROM silver_claims
        UNION ALL SELECT 'premium', CAST(PREMIUM AS INTEGER) FROM silver_motor"""
    ),
)
def c04(lake):
    def whole(df, field, name):
        return df.select(F.lit(field).alias("field"), numeric.to_whole(F.col(name)).alias("whole"))

    motor, claims = lake.silver("motor"), lake.silver("claims")
    parts = whole(motor, "year", "PROD_YEAR"), whole(claims, "outcome", "OUTCOME"), whole(motor, "premium", "PREMIUM")
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@plan(
    "c05_fit_encoder",
    over_claims(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, {c} AS value,
            CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS code
            FROM (SELECT DISTINCT {c} FROM silver_claims)"""
            for c in CATEGORIES
        )
    ),
)
def c05(lake):
    return encoding.fit_encoder(lake.silver("claims"), CATEGORIES)


@plan("j03_apply_encoder", over_claims("SELECT * FROM encoded"))
def j03(lake):
    return encoding.apply_encoder(lake.silver("claims"), lake.encoder(), CATEGORIES)


@plan(
    "c06_risk_score",
    over_claims(
        """SELECT ID, CAST(2 * PAST_ACCIDENTS + SPEEDING_VIOLATIONS + 3 * DUIS AS BIGINT) AS risk_score
        FROM bronze_claims"""
    ),
)
def c06(lake):
    score = risk.risk_score(F.col("PAST_ACCIDENTS"), F.col("SPEEDING_VIOLATIONS"), F.col("DUIS"))
    return lake.bronze("claims").select("ID", score.alias("risk_score"))


@plan(
    "c07_bucketize",
    over_claims(
        """SELECT ID, risk_score, risk_tier,
        CASE risk_tier WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' END AS tier_text FROM gold_claims"""
    ),
)
def c07(lake):
    score = F.col("risk_score")
    return lake.gold("claims").select(
        "ID",
        "risk_score",
        risk.risk_tier(score).alias("risk_tier"),
        risk.bucketize(score, risk.TIER_EDGES, risk.TIER_NAMES).alias("tier_text"),
    )


@plan(
    "c08_tier_label",
    over_claims(
        """SELECT ID, CASE WHEN risk_score >= 6 THEN 'High' WHEN risk_score >= 3 THEN 'Medium' ELSE 'Low' END
        AS tier_label FROM gold_claims"""
    ),
)
def c08(lake):
    return lake.gold("claims").select("ID", risk.risk_tier_label(F.col("risk_score")).alias("tier_label"))


@plan(
    "c09_safe_ratio",
    over_motor(
        """SELECT PREMIUM, INSURED_VALUE, PREMIUM / nullif(INSURED_VALUE, 0) AS premium_rate,
        round(PREMIUM / nullif(INSURED_VALUE, 0) * 100, 4) AS premium_rate_pct FROM silver_motor"""
    ),
)
def c09(lake):
    premium, value = F.col("PREMIUM"), F.col("INSURED_VALUE")
    return lake.silver("motor").select(
        premium,
        value,
        numeric.safe_ratio(premium, value).alias("premium_rate"),
        numeric.safe_ratio(premium, value, 100.0, 4).alias("premium_rate_pct"),
    )


@plan(
    "c10_policy_days",
    over_motor(
        """SELECT INSR_BEGIN, INSR_END, CAST(date_diff('day', INSR_BEGIN, INSR_END) AS INTEGER) AS days
        FROM silver_motor"""
    ),
)
def c10(lake):
    days = risk.policy_days(F.col("INSR_BEGIN"), F.col("INSR_END"))
    return lake.silver("motor").select("INSR_BEGIN", "INSR_END", days.alias("days"))


@plan(
    "c11_vehicle_age",
    over_motor("SELECT PROD_YEAR, 2024::DOUBLE - coalesce(PROD_YEAR, 2010) AS vehicle_age FROM silver_motor"),
)
def c11(lake):
    return lake.silver("motor").select("PROD_YEAR", risk.vehicle_age(F.col("PROD_YEAR")).alias("vehicle_age"))


@plan(
    "c12_tier_name",
    over_claims(
        """SELECT ID, CASE risk_tier WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END AS risk_level
        FROM gold_claims"""
    ),
)
def c12(lake):
    return lake.gold("claims").select("ID", risk.tier_name(F.col("risk_tier")).alias("risk_level"))


@plan(
    "c13_rounding",
    over_both(
        """SELECT 'credit' AS field, round(CREDIT_SCORE, 0) AS r0, round(CREDIT_SCORE, 1) AS r1,
        round(CREDIT_SCORE, 2) AS r2, round(CREDIT_SCORE, 3) AS r3 FROM silver_claims
        UNION ALL SELECT 'premium', round(PREMIUM, 0), round(PREMIUM, 1), round(PREMIUM, 2), round(PREMIUM, 3)
        FROM silver_motor"""
    ),
)
def c13(lake):
    def rounded(df, field, name):
        digits = [numeric.round_to(F.col(name), n).alias(f"r{n}") for n in range(4)]
        return df.select(F.lit(field).alias("field"), *digits)

    return rounded(lake.silver("claims"), "credit", "CREDIT_SCORE").unionByName(
        rounded(lake.silver("motor"), "premium", "PREMIUM")
    )


@plan(
    "c14_suggested_premium",
    over_claims("SELECT ID, 400 + 100 * risk_score + 150 * PAST_ACCIDENTS AS suggested FROM gold_claims"),
)
def c14(lake):
    amount = risk.suggested_premium(F.col("risk_score"), F.col("PAST_ACCIDENTS"))
    return lake.gold("claims").select("ID", amount.alias("suggested"))


@plan(
    "c15_threshold",
    over_claims(
        """SELECT ID, (risk_score * 7 + ID % 13) / 200.0::DOUBLE AS probability,
        CAST((risk_score * 7 + ID % 13) / 200.0::DOUBLE >= 0.5 AS INTEGER) AS claim_prediction FROM gold_claims"""
    ),
)
def c15(lake):
    probability = (F.col("risk_score") * 7 + F.col("ID") % 13) / F.lit(200.0)
    return lake.gold("claims").select(
        "ID", probability.alias("probability"), risk.threshold(probability).alias("claim_prediction")
    )


# --- sort, limit -------------------------------------------------------------


@plan(
    "t01_top_policies",
    over_motor(
        """SELECT MAKE, TYPE_VEHICLE, USAGE, count(*) AS policies FROM gold_motor GROUP BY ALL
        ORDER BY policies DESC, MAKE NULLS LAST, TYPE_VEHICLE NULLS LAST, USAGE NULLS LAST LIMIT 20"""
    ),
)
def t01(lake):
    keys = ["MAKE", "TYPE_VEHICLE", "USAGE"]
    counts = lake.gold("motor").groupBy(*keys).agg(F.count(F.lit(1)).alias("policies"))
    return top(counts, "policies", keys, 20)


@plan(
    "t02_order_by",
    over_motor(
        """SELECT PROD_YEAR, count(*) AS policies FROM gold_motor GROUP BY PROD_YEAR
        ORDER BY PROD_YEAR ASC NULLS LAST"""
    ),
)
def t02(lake):
    return lake.gold("motor").groupBy("PROD_YEAR").agg(F.count(F.lit(1)).alias("policies")).orderBy(up("PROD_YEAR"))
