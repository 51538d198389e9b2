"""Fusion of flags, model risk and context into scores, one category a row, actions and corrections.

All of it is row expressions: one projection over the scored rows, no shuffle. Inputs, null where a
row has none: temp, p_model, p_resid, p_qc, explained, micro, env, env_dir, rad, unc, abs_z, qc_any,
qc_strong.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The thresholds of the decision table.
LOW_RISK, MODERATE_RISK, HIGH_RISK = 0.15, 0.30, 0.70
MODEL_HIGH, UNCERTAIN, RADIATION_HIGH, RADIATION_SOME = 0.50, 0.80, 0.60, 0.40
EXPLAINED_HIGH, EXPLAINED_SOME, MICRO_HIGH, MICRO_SOME, DIRECTION_HIGH = 0.55, 0.35, 0.55, 0.35, 0.50
QC_HIGH, QC_LOW, SMALL_Z = 0.60, 0.20, 2.05
# The categories.
MISSING = "missing_or_unscored"
RESCUE = "qc_flagged_low_reference_risk_rescue_candidate"
CONSISTENT = "high_confidence_reference_consistent"
LIMITED = "reference_limited_or_ows_support_review"
RADIATION = "radiation_or_siting_bias_candidate"
ENVIRONMENT = "environmental_difference_candidate_preserve"
SYSTEMIC = "systemic_station_bias_correction_candidate"
CONFIRMED = "qc_confirmed_probable_transient_or_sensor_error"
MISSED = "qc_missed_probable_high_risk_observation"
CAUTION = "possible_bias_or_microclimate_preserve_with_caution"
VALID = "likely_valid_low_unexplained_error"
REVIEW = "ambiguous_review"


def zero(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def unit(c: Column) -> Column:
    """Clipped to 0..1; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def any_of(*parts: Column) -> Column:
    """Noisy or."""
    return unit(1 - reduce(lambda a, b: a * b, [1 - p for p in parts]))


def scores(df: DataFrame) -> DataFrame:
    model, resid, qc = zero("p_model"), zero("p_resid"), zero("p_qc")
    explained, micro, rad, unc = zero("explained"), zero("micro"), zero("rad"), zero("unc")
    left_resid, left_model = unit(resid * (1 - explained)), unit(model * (1 - 0.65 * explained))
    df = df.withColumns({"p_issue_no_qc": any_of(model, resid), "p_any": any_of(model, qc, resid), "p_unexplained": any_of(left_model, qc, left_resid), "p_preserve": any_of(explained, micro, unc, rad)})
    keep = (1 - 0.45 * unc) * (1 - 0.35 * micro) * (1 - 0.25 * rad)
    return df.withColumn("p_reject", unit(qc * 0.25 + 0.75 * F.col("p_unexplained") * keep))


def category() -> Column:
    """The first rule that holds decides; what is null does not hold."""
    p_any, reject, issue = F.col("p_any"), F.col("p_reject"), F.coalesce("p_issue_no_qc", F.lit(1.0))
    qc, explained, micro, env, rad, unc = map(zero, ("p_qc", "explained", "micro", "env", "rad", "unc"))
    flagged, strong = (F.coalesce(F.col(c), F.lit(False)) for c in ("qc_any", "qc_strong"))
    small = (issue <= LOW_RISK) & (F.col("abs_z").isNull() | (F.col("abs_z") <= SMALL_Z))
    sure = unc < UNCERTAIN
    error = (reject >= HIGH_RISK) & (explained < EXPLAINED_SOME) & (rad < RADIATION_SOME) & (env < MICRO_HIGH) & sure
    rules = [
        (MISSING, F.col("p_model").isNull() | F.col("temp").isNull()),
        (RESCUE, small & flagged),
        (CONSISTENT, small),
        (LIMITED, (p_any >= MODEL_HIGH) & ~sure & ~strong),
        (RADIATION, (p_any >= MODERATE_RISK) & (rad >= RADIATION_HIGH) & (qc < QC_HIGH) & sure),
        (ENVIRONMENT, (p_any >= MODERATE_RISK) & ((zero("env_dir") >= DIRECTION_HIGH) | (env >= MICRO_HIGH)) & (qc < QC_HIGH) & (reject < HIGH_RISK) & sure),
        (SYSTEMIC, (p_any >= MODERATE_RISK) & (explained >= EXPLAINED_HIGH) & (rad < RADIATION_HIGH) & (env < MICRO_HIGH)),
        (CONFIRMED, error & flagged),
        (MISSED, error),
        (CAUTION, (p_any >= LOW_RISK) & ((explained >= EXPLAINED_SOME) | (micro >= MICRO_SOME) | (rad >= RADIATION_SOME)) & (reject < HIGH_RISK)),
        (VALID, (reject <= MODERATE_RISK) & (issue <= MODERATE_RISK) & (qc < QC_LOW)),
        (LIMITED, ~sure & (p_any >= MODERATE_RISK)),
    ]
    return reduce(lambda chain, rule: chain.when(rule[1], rule[0]), rules[1:], F.when(rules[0][1], rules[0][0])).otherwise(REVIEW)


def explained_share(resid: Column, bias: Column) -> Column:
    """Share of a residual that the station's expected bias explains: of the same sign and 0.5 at least."""
    same = (F.signum(resid) == F.signum(bias)) & (F.abs(bias) >= 0.5)
    return F.when(F.coalesce(same, F.lit(False)), unit(1 - F.try_divide(F.abs(resid - bias), F.abs(resid)))).otherwise(0.0)


def radiation(resid: Column, high_solar: Column, day: Column, low_wind: Column, trained: Column) -> Column:
    weather = 0.45 * high_solar + 0.25 * day + 0.30 * low_wind
    warm = F.when(resid > 0, 1 / (1 + F.exp(-1.25 * (resid - 0.75)))).otherwise(0.0)
    return unit(weather * warm * (0.45 + 0.55 * trained))


def corrected(df: DataFrame) -> DataFrame:
    """temp and resid less the expected bias where the category calls for it, and everywhere."""
    bias = zero("bias")
    policy = F.when(F.col("category").isin(SYSTEMIC, RADIATION), bias).otherwise(0.0)
    return df.withColumns({"temp_policy": F.col("temp") - policy, "resid_policy": F.col("resid") - policy, "temp_all": F.col("temp") - bias, "resid_all": F.col("resid") - bias})


def guardrail(df: DataFrame, far_km: float) -> DataFrame:
    """Rows with a far reference (km) and a disagreement go to review, unless they are clean or
    independent evidence speaks of an error; ``rerouted`` tells which."""
    poor = F.coalesce(F.col("km") > far_km, F.lit(False))
    clean = F.col("category").isin(CONSISTENT, VALID, RESCUE)
    differs = (zero("p_any") >= 0.3) | F.coalesce(F.abs("resid") >= 2, F.lit(False)) | F.coalesce(F.col("abs_z") >= 3, F.lit(False))
    error = F.coalesce(F.col("qc_any"), F.lit(False)) & (zero("p_reject") >= 0.8) & (zero("explained") < 0.35) & (zero("env") < 0.35) & (zero("rad") < 0.4)
    moved = poor & differs & ~clean & ~error
    return df.withColumns({"original": F.col("category"), "rerouted": moved, "category": F.when(moved, LIMITED).otherwise(F.col("category"))})
