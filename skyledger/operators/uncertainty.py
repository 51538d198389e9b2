"""How far a residual may stray: sigma by month, hour and difficulty, thresholds and bands.

A row belongs to one group of each of twelve tables (all rows, month, hour, month and hour, eight kinds
of difficulty). Groups have small whole numbers as codes, 0 where what they tell is missing, so a table
is an array by code. All tables are fitted from one exchange of the calibration rows' counts and go to
the rows in one row that is broadcast; its size is fixed by the codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import robust_sigma_of_few
from .ranks import quantiles_of_few
from .support import BIN_EDGES, CLASS_EDGES, cut_bins, support

# Least number of rows of a group, floor of sigma, quantiles of the thresholds, bands.
LEAST, FLOOR, HIGH, LOW = 200, 0.2, 0.995, 0.95
BANDS = ("high_confidence_low_risk", "ambiguous", "high_confidence_high_risk")
#: Difficulties: the column and the edges of its bins.
DIFFICULTY = BIN_EDGES | {"cover_differs": BIN_EDGES["lcz_differs"]}
#: Codes of each table, from 0.
SIZES = {"all": 1, "month": 13, "hour": 25, "month_hour": 13 * 25} | {c: len(e) + 2 for c, e in DIFFICULTY.items()} | {"support": len(CLASS_EDGES) + 2}
#: More than any code.
APART = 1000
TIMES = ("all", "month", "hour", "month_hour")


def codes(df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The rows (month, hour, the columns of the difficulties) with their support, and the code of each
    table."""
    if "support" not in df.columns:
        df = support(df)
    month, hour = F.coalesce(F.col("month"), F.lit(0)).cast("int"), F.coalesce(F.col("hour") + 1, F.lit(0)).cast("int")
    found = {"all": F.lit(0), "month": month, "hour": hour, "month_hour": month * 25 + hour}
    bins = {c: (F.abs(F.col(c)) if c.endswith("_gap") else F.col(c), e) for c, e in DIFFICULTY.items()} | {"support": (F.col("support"), CLASS_EDGES)}
    return df, found | {c: F.coalesce(cut_bins(v, e) + 1, F.lit(0)) for c, (v, e) in bins.items()}


def sigma_tables(calibration: DataFrame, resid: str = "resid", least: int = LEAST, floor: float = FLOOR) -> DataFrame:
    """name, code, n, sigma: a row a group that has residuals. Groups of under ``least`` have none,
    but for all rows together."""
    rows, code = codes(calibration.where(F.col(resid).isNotNull()))
    # A table and its code are one whole number while the rows are counted.
    first = F.create_map(*(F.lit(x) for i, t in enumerate(SIZES) for x in (i, t)))
    each = F.array(*(F.lit(i * APART) + code[t] for i, t in enumerate(SIZES)))
    rows = rows.select(F.col(resid).alias("_r"), F.explode(each).alias("_group"))
    fitted = robust_sigma_of_few(rows, ["_group"], "_r", floor).select(first[(F.col("_group") / APART).cast("int")].alias("name"), (F.col("_group") % APART).alias("code"), "n", "sigma")
    return fitted.withColumn("sigma", F.when((F.col("n") >= least) | (F.col("name") == "all"), F.col("sigma")))


def apply_sigma(df: DataFrame, tables: DataFrame, resid: str = "resid", floor: float = FLOOR) -> DataFrame:
    """sigma and z. Of the times the closest one counts that is there (month and hour, hour, month, all);
    of it and all difficulties the greatest sigma counts, and at least the floor."""
    rows, code = codes(df)
    held = lambda t: F.map_from_entries(F.collect_list(F.when(F.col("name") == t, F.struct("code", "sigma"))))
    one = tables.agg(*(held(t).alias(t) for t in SIZES))
    by_code = lambda t, n: F.array(*(F.try_element_at(t, F.lit(i)) for i in range(n)))
    one = one.select(*(by_code(t, n).alias(f"_t_{t}") for t, n in SIZES.items()))
    rows = rows.join(F.broadcast(one))
    at = {t: F.get(f"_t_{t}", c) for t, c in code.items()}
    time = F.coalesce(*(at[t] for t in reversed(TIMES)))
    rows = rows.withColumn("sigma", F.greatest(time, *(c for t, c in at.items() if t not in TIMES), F.lit(float(floor))))
    return rows.withColumn("z", F.col(resid) / F.col("sigma")).select(*df.columns, "sigma", "z")


def thresholds(scored: DataFrame, resid: str = "resid", high: float = HIGH, low: float = LOW) -> DataFrame:
    """One row: the high and low quantile of |residual| and of |z|."""
    at = lambda c, n: quantiles_of_few(scored.select(F.abs(c).alias("_a")), [], "_a", {f"{n}_high": high, f"{n}_low": low}).drop("n")
    return at(resid, "resid").join(F.broadcast(at("z", "z")))


def band(value: Column, low: Column, high: Column) -> Column:
    """Up to ``low``, up to ``high``, above; null for null."""
    return F.when(value <= low, BANDS[0]).when(value <= high, BANDS[1]).when(value > high, BANDS[2])


def with_bands(scored: DataFrame, limits: DataFrame, resid: str = "resid") -> DataFrame:
    """risk_abs, risk_z (1 above the high threshold; 0 for null) and the bands of both. Without any
    threshold there are no bands."""
    rows = scored.join(F.broadcast(limits), F.lit(True), "left")  # one row, or none
    out = {}
    for name, value in (("abs", F.abs(resid)), ("z", F.abs("z"))):
        low, high = (F.col(f"{'resid' if name == 'abs' else 'z'}_{k}") for k in ("low", "high"))
        out |= {f"risk_{name}": F.coalesce(value > high, F.lit(False)).cast("int"), f"band_{name}": band(value, low, high)}
    return rows.withColumns(out).select(*scored.columns, *out)
