"""Time lookup, reducers, runs and illumination against known results."""

from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrella.functions import sky
from terrella.grid import Grid, Stereographic
from terrella.operators import disk, horizon, local, products, runs, temporal

T0 = datetime(2024, 1, 1, tzinfo=UTC)
G = Grid(3, 2, nodata=-99)
LAYERS = np.array([[[1, 2, -99], [4, 5, 6]], [[3, 4, -99], [6, 7, 8]], [[5, 6, -99], [8, 9, 10]]], np.int16)


@pytest.fixture(scope="module")
def series(spark):
    return temporal.from_temporal_cube(spark, [T0 + timedelta(hours=i) for i in range(3)], LAYERS, G)


def test_reducers(series):
    v, m = temporal.temporal_mean(series).collect()
    assert v[m].tolist() == [3, 4, 6, 7, 8] and not m[0, 2]
    assert temporal.temporal_count(series).collect()[0].tolist() == [[3, 3, 0], [3, 3, 3]]
    s, sm = temporal.temporal_std(series, ddof=1).collect()
    np.testing.assert_allclose(s[sm], 2)
    assert temporal.temporal_sum(series).dtype == "int64"


def test_lookup(series):
    at = T0 + timedelta(hours=1, minutes=30)
    assert [series.layer_for_time(at, method=m) for m in ("nearest", "before", "after")] == [1, 1, 2]
    with pytest.raises(Exception):
        series.layer_for_time(T0 + timedelta(hours=3), method="nearest")
    assert series.layer_for_time(T0 + timedelta(hours=2)) == 2


def test_lifted(series):
    out = (series * 2 + series).layer(1).collect()
    assert out[0][out[1]].tolist() == [9, 12, 18, 21, 24]
    assert temporal.lifted(local.greater, series, 5).dtype == "bool"


def samples(spark, conditions, hours):
    return spark.createDataFrame([(T0 + timedelta(hours=h), 0, 0, c) for h, c in zip(hours, conditions, strict=True)], "ts timestamp, row int, col int, cond boolean")


def test_mission_days(spark):
    hours = [24 * i for i in range(6)]
    s = samples(spark, [True] * 6, hours)
    iv = spark.createDataFrame([(0, T0 + timedelta(days=1), T0 + timedelta(days=3)), (1, T0 + timedelta(days=3), T0 + timedelta(days=5))], "iv int, start_ts timestamp, stop_ts timestamp")
    got = {r["iv"]: r["duration"] for r in runs.mission_duration(s, s.select("ts"), iv, stop=T0 + timedelta(days=5), output_unit="days").collect()}
    assert got == {0: 4, 1: 2}


def test_mission_uneven(spark):
    s = samples(spark, [True, True, False, True], [0, 6, 15, 24])
    iv = runs.fixed_candidate_intervals(spark, T0, T0 + timedelta(days=1), duration=timedelta(days=1))
    assert runs.mission_duration(s, s.select("ts"), iv, stop=T0 + timedelta(days=1)).first()["duration"] == 15


def test_intervals(spark):
    m = runs.monthly_candidate_intervals(spark, "2027-01-15T00:00:00+00:00", "2027-03-10T00:00:00+00:00")
    assert m.count() == 3
    w = runs.weekly_candidate_intervals(spark, "2027-01-03T12:00:00+00:00", "2027-01-20T12:00:00+00:00").orderBy("iv").collect()
    assert [(r["stop_ts"] - r["start_ts"]).days for r in w] == [7, 7, 3]


def brute_haven(fraction, earth, month):
    out = {}
    for m in sorted(set(month)):
        outage = [e < 2 for e, x in zip(earth, month, strict=True) if x == m]
        best, i = 0, 0
        while i < len(fraction):
            j = i
            while j < len(fraction) and fraction[j] < 0.2:
                j += 1
            if any(earth[k] < 2 and month[k] == m for k in range(i, j)):
                best = max(best, j - i)
            i = max(j, i + 1)
        out[m] = float("nan") if not any(outage) or all(outage) else best * 6.0
    return out


@pytest.mark.parametrize("seed", range(4))
def test_safe_haven(spark, seed):
    rng = np.random.default_rng(seed)
    n = 60
    times = [datetime(2024, 1, 25, tzinfo=UTC) + timedelta(hours=6 * i) for i in range(n)]
    fraction, earth = (rng.random(n) < 0.4).astype(float), np.where(rng.random(n) < 0.3, 1.0, 3.0)
    rows = [(t, 0, 0, float(f), float(e)) for t, f, e in zip(times, fraction, earth, strict=True)]
    got = runs.safe_haven(spark.createDataFrame(rows, "ts timestamp, row int, col int, fraction double, earth double"), step_hours=6.0)
    want = brute_haven(fraction, earth, [t.month for t in times])
    for r in got.select(F.month("month").alias("m"), "hours").collect():
        np.testing.assert_equal(r["hours"], want[r["m"]])


def test_flat_disk():
    got = disk.fractions(np.zeros(1440, np.float32), np.array([0, 0, 0, 0.02, 359.98, 10.12, 123.456]), np.array([1, 0, -1, 0.18, 0.18, 0.45, 0.61]))
    assert np.floor(got * 255 + 1e-9).tolist() == [255, 127, 0, 227, 227, 255, 255]


def test_disk_expression_agrees_with_batches(spark):
    rng = np.random.default_rng(5)
    ring = (rng.random(64) * 2 - 1).round(3)
    az, el = rng.random(200) * 360, rng.random(200) * 3 - 1.5
    want = disk.fractions(ring.astype(float), az, el)
    table = spark.createDataFrame([(float(a), float(e)) for a, e in zip(az, el, strict=True)], "a double, e double")
    h = F.array(*(F.lit(float(v)) for v in ring))
    got = [r[0] for r in table.select(sky.visible_fraction(h, F.col("a"), F.col("e"), 64)).collect()]
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_horizon_lookup(spark):
    ring = [float(i) for i in range(8)]
    h = F.array(*(F.lit(v) for v in ring))
    got = [spark.range(1).select(sky.horizon_at(h, F.lit(a), 8)).first()[0] for a in (0.0, 22.5, 337.5, 360.0)]
    assert got == [0, 0.5, 3.5, 0]


def test_shadow(spark):
    g = Grid(1, 1, (1000.0, 1.0, 0.0, -1000.0, 0.0, -1.0), Stereographic())
    cells = spark.createDataFrame([(0, 0, 0.0, [0.3] * 64)], "row int, col int, elevation double, horizon array<double>")
    look = products.looks(cells, spark.createDataFrame([(T0, 1e11, 0.0, 0.0)], "ts timestamp, x double, y double, z double"), g).first()
    for z, want in ((look["body_elevation"] - 0.2, 0), (look["body_elevation"] + 0.3, 255)):
        c = spark.createDataFrame([(0, 0, 0.0, [z] * 64)], "row int, col int, elevation double, horizon array<double>")
        v = spark.createDataFrame([(T0, 1e11, 0.0, 0.0)], "ts timestamp, x double, y double, z double")
        assert products.psr(c, v, g, bins=64).first()["value"] == want


def test_march_sees_a_wall(spark):
    g = Grid(21, 21, (0.0, 20.0, 0.0, 0.0, 0.0, -20.0), Stereographic())
    z = np.zeros((21, 21))
    z[:, 15] = 100.0
    got = horizon.march(g, z, 0, 0, np.array([10]), np.array([10]), azimuths=8, maximum_m=180.0, step_m=5.0)[0]
    assert got.max() > 40 and got.min() < 1
    # Tiles do not change the result.
    from terrella.raster import Raster

    cells = Raster.from_array(spark, z, g).cells()
    one = {(r["row"], r["col"]): r["horizon"] for r in horizon.generate_horizons(cells, g, maximum_m=100.0, azimuths=8, tile=32).collect()}
    many = {(r["row"], r["col"]): r["horizon"] for r in horizon.generate_horizons(cells, g, maximum_m=100.0, azimuths=8, tile=7).collect()}
    assert one == many and len(one) == 441


def test_projection_round_trip(spark):
    p = Stereographic(latitude_0=-1.2, longitude_0=0.4)
    x, y = p.forward(F.lit(-1.1), F.lit(0.7))
    lat, lon = p.inverse(x, y)
    r = spark.range(1).select(lat.alias("a"), lon.alias("o")).first()
    np.testing.assert_allclose([r["a"], r["o"]], [-1.1, 0.7], rtol=1e-9)


def test_series_reduced_in_place_agree_with_tables(spark, monkeypatch):
    """Products whose series never leave a task against the same products by joins and windows."""
    rng = np.random.default_rng(12)
    g = Grid(3, 2, (1000.0, 20.0, 0.0, 2000.0, 0.0, -20.0), Stereographic())
    cells = spark.createDataFrame([(r, c, 0.0, [float(x) for x in rng.random(64).round(2) * 2 - 1]) for r in range(2) for c in range(3)], "row int, col int, elevation double, horizon array<double>")
    a = np.arange(60) * 0.4
    vectors = [spark.createDataFrame([(T0 + timedelta(hours=i), *(float(v) for v in (np.cos(t) * 1.5e11, np.sin(t) * 1.5e11, np.sin(3 * t + k) * 3e9))) for i, t in enumerate(a)], "ts timestamp, x double, y double, z double") for k in (0, 1)]
    axis = vectors[0].select("ts")
    iv = runs.fixed_candidate_intervals(spark, T0, T0 + timedelta(hours=60), duration=timedelta(hours=20))

    def made():
        common = {"stop": T0 + timedelta(hours=60), "sun_vectors": vectors[0], "earth_vectors": vectors[1], "bins": 64}
        return (
            sorted(map(tuple, products.psr(cells, vectors[0], g, bins=64).collect())),
            sorted(map(tuple, products.mission_duration_from(cells, g, axis, iv, sunlight_fraction_threshold=0.5, earth_elevation_threshold_deg=-0.5, **common).collect())),
            sorted(map(tuple, products.mission_duration_from(cells, g, axis, iv, sun_elevation_threshold_deg=0.0, output_unit="days", **common).collect())),
            sorted((r["ts"], r["row"], r["col"], r["value"]) for r in products.lightmap(cells, vectors[0], g, bins=64).collect()),
            sorted((r["row"], r["col"], r["month"], str(r["hours"])) for f in (0.2, 0.9) for r in products.safe_havens(cells, vectors[0], vectors[1].filter(F.col("ts") > F.lit(T0 + timedelta(hours=3))), g, step=timedelta(hours=1), sunlight_fraction_threshold=f, earth_elevation_threshold_deg=-0.5, bins=64).collect()),
        )

    fast = made()
    bands = {(r["row"], r["col"]): list(r["bands"]) for r in products.lightmap_bands(cells, vectors[0], g).collect()}
    monkeypatch.setattr(products, "bounded", lambda v: False)
    slow = made()
    assert fast[0] == slow[0]
    for i in (1, 2):
        assert [x[:3] for x in fast[i]] == [x[:3] for x in slow[i]]
        np.testing.assert_allclose([x[3] for x in fast[i]], [x[3] for x in slow[i]], rtol=1e-6)
    assert max(abs(x[3] - y[3]) for x, y in zip(fast[3], slow[3], strict=True)) <= 1
    for row, col in bands:
        assert bands[row, col] == [x[3] for x in fast[3] if x[1:3] == (row, col)]


@pytest.mark.parametrize("seed", range(3))
def test_leaving_out_low_ground_changes_nothing(seed):
    rng = np.random.default_rng(seed)
    g = Grid(90, 80, (3000.0, 20.0, 0.0, 5000.0, 0.0, -20.0), Stereographic())
    z = np.cumsum(np.cumsum(rng.normal(0, 1, (80, 90)), 0), 1) * (0.5 if seed else 0.01)
    z[rng.random((80, 90)) < 0.02] = np.nan
    rows, cols = (x[~np.isnan(z[rows_cols])] for rows_cols in [(np.array([5, 40, 60, 79]), np.array([7, 44, 80, 0]))] for x in rows_cols)
    common = {"azimuths": 72, "maximum_m": 1500.0, "step_m": 20.0}
    every = horizon.march(g, z, 0, 0, rows, cols, chunk=0, **common)
    for chunk in (4, 16):
        np.testing.assert_array_equal(horizon.march(g, z, 0, 0, rows, cols, chunk=chunk, **common), every)


def test_vectors_between_samples(spark):
    from terrella.sources import ephemeris

    rows = [("Sun", T0 + timedelta(hours=2 * i), float(i), float(-i), 5.0) for i in range(4)] + [("Earth", T0, 0.0, 0.0, 0.0)]
    table = spark.createDataFrame(rows, "body string, ts timestamp, x double, y double, z double")
    axis = temporal.times(spark, T0, T0 + timedelta(hours=6), step_hours=0.5)
    got = ephemeris.resolve_vectors("sun", axis, ephemeris=table).orderBy("ts").collect()
    np.testing.assert_allclose([r["x"] for r in got], np.arange(13) / 4)
    exact = ephemeris.resolve_vectors("sun", axis.filter("layer = 0"), explicit=table.filter("body = 'Sun'"), ephemeris=table)
    assert exact.count() == 1
    with pytest.raises(Exception):
        ephemeris.resolve_vectors("sun", axis, explicit=table)
    with pytest.raises(Exception):
        ephemeris.vectors_of(table, "Mars")


def test_run_lengths():
    assert disk.run_lengths(np.array([1, 1, 0, 1, 0, 0, 1, 1, 1], bool)).tolist() == [2, 2, 0, 1, 0, 0, 3, 3, 3]
    assert disk.run_lengths(np.array([], bool)).tolist() == []


def test_cube_there_and_back(series):
    moments, values, valid = temporal.to_temporal_cube(series)
    assert moments == [T0 + timedelta(hours=i) for i in range(3)]
    assert valid.tolist() == (LAYERS != -99).tolist()
    np.testing.assert_array_equal(values[valid], LAYERS[valid])
