"""What is known of a row's surroundings: how well references support it, how it differs from them,
what its station's history explains, and how flags and models are weighed.

Row expressions over the context columns; only cutoffs, tables of bins and station summaries are
aggregated, and these have a row a bin or a station.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fusion import explained_share, radiation, unit
from .ranks import attach, quantiles

# Edges of the bins, closed on the right; scales of the support components.
BIN_EDGES = {
    "elev_gap": (25.0, 50.0, 100.0, 200.0),
    "building_gap": (2.0, 5.0, 10.0, 20.0),
    "n_refs": (0.0, 2.0, 4.0, 6.0),
    "km": (0.5, 1.0, 2.0, 5.0),
    "spread": (0.5, 1.0, 2.0, 4.0),
    "lcz_differs": (0.1, 0.4, 0.7),
}
MOST_REFS, FAR_KM, WIDE_SPREAD, HIGH_ELEV, HIGH_BUILDING = 6, 5.0, 4.0, 150.0, 20.0
CLASS_EDGES, CLASSES = (0.25, 0.5, 0.75), ("easy", "moderate", "hard", "very_hard")
# Weights of the QC levels.
LEVEL_WEIGHTS = {"lenient": 0.95, "strict": 0.70, "ultra_strict": 0.25}


def cut_bins(value: Column, edges: tuple[float, ...]) -> Column:
    """Number of the bin between edges, closed on the right, with open ends; null stays null."""
    return F.when(value.isNotNull(), reduce(lambda n, e: n + (value > e).cast("int"), edges, F.lit(0)))


def mean_of(*parts: Column) -> Column:
    """Mean of the parts that are not null."""
    some = F.filter(F.array(*(p.cast("double") for p in parts)), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(some, F.lit(0.0), lambda a, b: a + b), F.size(some).cast("double"))


def max_of(*parts: Column) -> Column:
    """Greatest of the parts that are not null."""
    return F.greatest(*(p.cast("double") for p in parts))


def support(df: DataFrame) -> DataFrame:
    """Components of a row's reference support (0 easy, 1 hard), their mean and its class."""
    refs = F.least(F.greatest(F.col("n_refs").cast("double"), F.lit(0.0)), F.lit(float(MOST_REFS)))
    parts = {
        "s_density": F.when(F.col("n_refs").isNotNull(), (MOST_REFS - refs) / MOST_REFS),
        "s_km": unit(F.col("km") / FAR_KM),
        "s_spread": unit(F.col("spread") / WIDE_SPREAD),
        "s_lcz": unit(F.col("lcz_differs")),
        "s_cover": unit(F.col("cover_differs")),
        "s_elev": unit(F.abs("elev_gap") / HIGH_ELEV),
        "s_building": unit(F.abs("building_gap") / HIGH_BUILDING),
    }
    df = df.withColumns(parts).withColumn("support", mean_of(*map(F.col, parts)))
    names = F.array(*map(F.lit, CLASSES))
    at = cut_bins(F.col("support"), CLASS_EDGES)
    return df.withColumn("support_class", F.when(at.isNull(), "Missing").otherwise(F.get(names, at)))


def reference_class(df: DataFrame) -> DataFrame:
    """How well references are placed: outside, low, high or moderate support; unknown if distance,
    number and spread all are. What is null speaks for nothing."""
    km, n, spread = F.col("km"), F.col("n_refs"), F.col("spread")
    holds = lambda c: F.coalesce(c, F.lit(False))
    known = F.coalesce(km.cast("double"), n.cast("double"), spread.cast("double")).isNotNull()
    rules = F.when(~known, "unknown").when(holds(km > 10) | holds(n <= 0), "outside").when(holds(km > 5) | holds(n <= 1) | holds(spread > 4), "low")
    return df.withColumn("reference_class", rules.when(holds(km <= 2) & holds(n >= 4) & (spread.isNull() | (spread <= 2)), "high").otherwise("moderate"))


def qc_evidence(df: DataFrame, weights: dict[str, float] = LEVEL_WEIGHTS) -> DataFrame:
    """Weighted share of the levels that flag a row, over the levels that are there as columns; a
    missing flag is no evidence. Also the number of flags and whether any, or a strong one, is set."""
    there = {c: w for c, w in weights.items() if c in df.columns}
    flag = {c: F.coalesce(F.col(c), F.lit(0)) for c in there}
    share = sum((flag[c] * w for c, w in there.items()), F.lit(0.0)) / sum(there.values()) if there else F.lit(0.0)
    strong = reduce(lambda a, b: a | b, [flag[c] == 1 for c, w in there.items() if w >= 0.70], F.lit(False))
    total = sum(flag.values(), F.lit(0))
    return df.withColumns({"p_qc": share, "n_flags": total.cast("int"), "qc_any": total > 0, "qc_strong": strong})


def bin_calibration(df: DataFrame, bins: int = 15) -> DataFrame:
    """A score as the event rate of its bin among the valid rows; the score itself where the bin has
    none. Bins are closed on the left, the last on both sides."""
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    df = df.withColumn("bin", at)
    rates = df.where("split = 'valid' AND y IS NOT NULL").groupBy("bin").agg(F.avg("y").alias("rate"))
    return attach(df, rates, ["bin"], "left").withColumn("p_calibrated", F.coalesce("rate", "p"))


def conditional_bias(df: DataFrame, least: int = 24) -> DataFrame:
    """Per station, from train rows: the median residual, by day and night and by high and low sun.
    High sun: from the upper quartile of all train rows on; an unknown sun counts as low."""
    train = df.where("split = 'train' AND resid IS NOT NULL")
    high = quantiles(train, [], "solar", {"_high": 0.75}).select("_high")
    train = train.join(F.broadcast(high))  # one row
    sun = F.coalesce(F.col("solar") >= F.col("_high"), F.lit(False))
    mid = lambda ok: F.percentile(F.when(ok, F.col("resid")), F.lit(0.5))
    g = train.groupBy("station_id").agg(
        F.count("*").alias("n_train"), mid(F.lit(True)).alias("bias_all"), mid(F.col("is_day") == 1).alias("bias_day"), mid(F.col("is_day") == 0).alias("bias_night"), mid(sun).alias("bias_sun"), mid(~sun).alias("bias_shade"), F.first("_high").alias("high_sun")
    )
    cols = ["bias_all", "bias_day", "bias_night", "bias_sun", "bias_shade"]
    return g.withColumns({c: F.when(F.col("n_train") >= least, F.col(c)) for c in cols})


def expected_bias(df: DataFrame, stations: DataFrame) -> DataFrame:
    """The bias that a row's station leads one to expect: its median, or that of day or night, or, last,
    that of high or low sun; and the share of the residual that it explains."""
    rows = df.join(stations, "station_id", "left")
    day = F.when(F.col("is_day") == 1, F.col("bias_day")).when(F.col("is_day") == 0, F.col("bias_night"))
    sun = F.when(F.coalesce(F.col("solar") >= F.col("high_sun"), F.lit(False)), F.col("bias_sun")).otherwise(F.col("bias_shade"))
    bias = F.coalesce(sun, day, "bias_all")
    return rows.withColumn("bias", bias).withColumn("explained", explained_share(F.col("resid"), F.col("bias"))).drop(*[c for c in stations.columns if c != "station_id"])


def logistic(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def radiation_score(df: DataFrame, stations: DataFrame) -> DataFrame:
    """How much a warm residual looks like sun on a badly aired sensor: high sun (the train rows' upper
    quartile), daylight and low wind (how far under their lower quartile), and how much warmer the
    station is by sun on train rows. stations: of ``conditional_bias``."""
    train = df.where("split = 'train'")
    cuts = quantiles(train, [], "solar", {"_sun": 0.75}).select("_sun").join(quantiles(train, [], "wind", {"_calm": 0.25}).select("_calm"))
    df = df.join(F.broadcast(cuts)).join(stations.select("station_id", "bias_all", "bias_sun", "bias_shade"), "station_id", "left")  # cuts: one row
    sun = F.coalesce((F.col("solar") >= F.col("_sun")).cast("double"), F.lit(0.0))
    calm = F.coalesce(logistic((F.col("_calm") - F.col("wind")) / F.greatest(F.lit(0.35), F.abs("_calm") * 0.35)), F.lit(0.5))
    day = F.coalesce(F.col("is_day").cast("double"), F.lit(0.0))
    excess = F.coalesce(F.col("bias_sun") - F.col("bias_shade"), F.col("bias_sun") - F.col("bias_all"))
    trained = F.coalesce(max_of(logistic((excess - 0.5) * 2), logistic((F.col("bias_sun") - 0.5) * 2)), F.lit(0.25))
    df = df.withColumn("trained", trained)
    rad = F.coalesce(radiation(F.col("resid"), sun, day, calm, F.col("trained")), F.lit(0.0))
    return df.withColumn("rad", rad).drop("_sun", "_calm", "bias_all", "bias_sun", "bias_shade")


def reference_uncertainty(df: DataFrame) -> DataFrame:
    """With a support score: that score against the upper end of the train rows' (its .95 quantile; the
    greatest score where that is 0; null stays null). Without one: the mean of distance, spread and
    lack of references."""
    if "support" not in df.columns:
        lack = F.when(F.col("n_refs").isNotNull(), 1 - unit(F.col("n_refs") / 8))
        return df.withColumn("unc", unit(mean_of(unit(F.col("km") / 8), unit(F.col("spread") / 3), lack)))
    top = quantiles(df.where("split = 'train'"), [], "support", {"_top": 0.95}).select("_top")
    most = df.agg(F.max("support").alias("_most"))
    df = df.join(F.broadcast(most.join(top, F.lit(True), "left")))  # one row
    base = F.when(F.col("_top") > 0, F.col("_top")).when(F.col("_most") > 0, F.col("_most")).otherwise(1.0)
    return df.withColumn("unc", unit(F.col("support") / base)).drop("_top", "_most")


def microclimate(df: DataFrame) -> DataFrame:
    """Whether a residual goes the way that the surroundings' differences would push it. mismatch: how
    different land cover is; direction: of surface temperature, height (sign turned) and vegetation
    (sign turned, more by day); signal of both."""
    same = lambda diff, scale, sign: F.when(F.col("resid") * diff * sign > 0, unit(F.abs(diff) / scale)).otherwise(F.when(diff.isNotNull(), F.lit(0.0)))
    day = 0.5 + 0.5 * F.coalesce(F.col("is_day").cast("double"), F.lit(0.0))
    ways = [same(F.col("lst_diff"), 8.0, 1), same(F.col("elev_diff"), 150.0, -1), same(F.col("ndvi_diff"), 0.35, -1) * day]
    differs = [unit(F.col("lcz_differs")), unit(F.col("cover_differs"))]
    zero = F.lit(0.0)
    mismatch = unit(0.55 * F.coalesce(max_of(*differs), zero) + 0.45 * F.coalesce(mean_of(*differs), zero))
    direction = unit(0.65 * F.coalesce(max_of(*ways), zero) + 0.35 * F.coalesce(mean_of(*ways), zero))
    df = df.withColumns({"mismatch": mismatch, "env_dir": direction})
    mixed = 1 - (1 - F.col("env_dir")) * (1 - 0.45 * F.col("mismatch"))
    return df.withColumn("env", unit(F.when(F.col("env_dir") > 0, mixed).otherwise(0.75 * F.col("mismatch"))))


def station_profile(df: DataFrame, least: int = 24) -> DataFrame:
    """Residuals of each station on train rows, in full: level, spread, tails, conditions, slopes and
    the stability of its months. With fewer than ``least`` rows the count only."""
    train = df.where("split = 'train' AND resid IS NOT NULL")
    cuts = quantiles(train, [], "solar", {"_sun": 0.75}).select("_sun").join(quantiles(train, [], "wind", {"_calm": 0.25}).select("_calm"))
    train = train.join(F.broadcast(cuts))  # one row
    r, a = F.col("resid"), F.abs("resid")
    sun, calm = F.coalesce(F.col("solar") >= F.col("_sun"), F.lit(False)), F.coalesce(F.col("wind") <= F.col("_calm"), F.lit(False))
    mid = lambda ok, x=r: F.percentile(F.when(ok, x), F.lit(0.5))
    every = F.lit(True)
    share = lambda ok: F.avg(ok.cast("double"))
    slope = lambda x: F.when((F.regr_count(r, x) >= 20) & (F.regr_sxx(r, x) > 0), F.regr_slope(r, x))
    out = {
        "mean": F.avg(r), "median": mid(every), "std": F.stddev_samp(r), "mae": F.avg(a), "median_abs": mid(every, a), "rmse": F.sqrt(F.avg(r * r)),
        "q25": F.percentile(r, F.lit(0.25)), "q75": F.percentile(r, F.lit(0.75)), "p95_abs": F.percentile(a, F.lit(0.95)), "p99_abs": F.percentile(a, F.lit(0.99)),
        "over_1": share(a > 1), "over_2": share(a > 2), "over_3": share(a > 3), "positive": share(r > 0),
        "day": mid(F.col("is_day") == 1), "night": mid(F.col("is_day") == 0), "sun": mid(sun), "shade": mid(~sun), "calm": mid(calm), "windy": mid(~calm), "sun_calm": mid(sun & calm),
        "summer": mid(F.col("month").isin(6, 7, 8)), "winter": mid(F.col("month").isin(12, 1, 2)), "share_day": share(F.col("is_day") == 1), "share_sun": share(sun),
        "slope_solar": slope(F.col("solar")), "slope_wind": slope(F.col("wind")), "slope_elev": slope(F.col("elev_diff")), "corr_solar": F.corr(r, F.col("solar")),
    }
    g = train.groupBy("station_id").agg(F.count("*").alias("n"), *(c.alias(n) for n, c in out.items()))
    g = g.withColumns({"iqr": F.col("q75") - F.col("q25"), "day_night": F.col("day") - F.col("night"), "sun_shade": F.col("sun") - F.col("shade"), "consistency": F.try_divide(F.abs("median"), F.col("median_abs"))})
    g = g.withColumns({c: F.when(F.col("n") >= least, F.round(c, 7)) for c in g.columns if c not in ("station_id", "n")})
    return g.join(month_stability(train), "station_id", "left")


def month_stability(df: DataFrame, least: int = 3) -> DataFrame:
    """Two levels: a median a station and month, then over the months their number, median, spread and
    the share that has the sign of their median."""
    months = df.where("resid IS NOT NULL").groupBy("station_id", "month").agg(F.percentile("resid", F.lit(0.5)).alias("_m"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    g = months.groupBy("station_id").agg(F.count("*").alias("months"), F.percentile("_m", F.lit(0.5)).alias("_mid"), (F.percentile("_m", F.lit(0.75)) - F.percentile("_m", F.lit(0.25))).alias("_iqr"), F.count_if(F.col("_m") > 0).alias("_up"), F.count_if(F.col("_m") < 0).alias("_down"))
    agree = F.when(F.col("_mid") > 0, F.col("_up")).when(F.col("_mid") < 0, F.col("_down")).otherwise(0) / F.col("months")
    return g.select("station_id", "months", F.round("_mid", 5).alias("month_median"), F.round("_iqr", 5).alias("month_iqr"), F.round(agree, 5).alias("month_agree"))
