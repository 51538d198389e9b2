"""Sigma by time and difficulty on hand-made rows."""

import pytest

from skyledger.operators import uncertainty as un

SCHEMA = "month int, hour int, n_refs int, km double, spread double, lcz_differs double, cover_differs double, elev_gap double, building_gap double, resid double"


def rows(spark, *groups):
    """groups: number of rows, a residual's size, what differs from a quiet row."""
    quiet = {"month": 1, "hour": 5, "n_refs": 6, "km": 0.4, "spread": 0.4, "lcz_differs": 0.0, "cover_differs": 0.0, "elev_gap": 1.0, "building_gap": 1.0}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple((quiet | own | {"resid": size * (-1) ** i})[n] for n in names) for n, size, own in groups for i in range(n)], SCHEMA)


def test_closest_time_and_hardest_difficulty_count(spark):
    df = rows(spark, (200, 1.0, {}), (200, 2.0, {"hour": 6}), (200, 4.0, {"month": 2, "km": 3.0}), (199, 9.0, {"month": 3}), (200, 0.001, {"month": None, "hour": 7, "km": None}))
    tables = un.sigma_tables(df)
    found = {(r["name"], r["code"]): r["sigma"] for r in tables.collect()}
    assert found["month_hour", 1 * 25 + 6] == pytest.approx(1.4826) and found["month_hour", 2 * 25 + 6] == pytest.approx(4 * 1.4826)
    assert found["month_hour", 3 * 25 + 6] is None and found["month", 3] is None and found["month_hour", 8] == 0.2 and found["km", 0] == 0.2
    assert found["all", 0] is not None and {n for n, _ in found} == set(un.SIZES)
    got = {(r["month"], r["hour"]): r["sigma"] for r in un.apply_sigma(df, tables).collect()}
    easy = max(found[n, 4 if n == "n_refs" else 1] for n in ("n_refs", "spread", "lcz_differs", "cover_differs", "elev_gap", "building_gap", "support"))
    assert got[2, 5] == pytest.approx(max(4 * 1.4826, found["km", 4], easy))
    easy = max(easy, found["km", 1])
    assert got[1, 5] == pytest.approx(max(1.4826, easy))
    # Too few rows of its month: the hour's table is next.
    assert got[3, 5] == pytest.approx(max(found["hour", 6], easy))


def test_bands_and_null_residuals(spark):
    df = spark.createDataFrame([(float(v), float(v) / 2) for v in range(1, 101)] + [(None, None)], "resid double, z double")
    limits = un.thresholds(df)
    assert [round(v, 6) for v in limits.first()] == [99.505, 95.05, 49.7525, 47.525]
    got = {r["resid"]: (r["risk_abs"], r["risk_z"], r["band_abs"], r["band_z"]) for r in un.with_bands(df, limits).collect()}
    assert got[95.0] == (0, 0, un.BANDS[0], un.BANDS[0]) and got[99.0][2] == un.BANDS[1] and got[100.0] == (1, 1, un.BANDS[2], un.BANDS[2])
    assert got[None] == (0, 0, None, None)
    none = un.with_bands(df, un.thresholds(df.limit(0)))
    assert none.count() == 101 and none.where("risk_abs = 1 OR band_z IS NOT NULL").count() == 0


def test_no_calibration_rows_give_the_floor(spark):
    df = rows(spark, (3, 5.0, {}))
    out = un.apply_sigma(df, un.sigma_tables(df.limit(0)))
    assert {r["sigma"] for r in out.collect()} == {0.2} and out.columns == [*df.columns, "sigma", "z"]
