"""Focal, terrain, region, distance and zonal operators against brute force and known results."""

import numpy as np
import pytest

from terrella.grid import Grid
from terrella.operators import distance, focal, reductions, regions, resample, terrain, zonal
from terrella.raster import Raster

RNG = np.random.default_rng(42)
G = Grid(9, 7, (1000.0, 20.0, 0.0, 2000.0, 0.0, -10.0))
X = RNG.integers(0, 100, (7, 9)).astype(np.int32)
OK = RNG.random((7, 9)) > 0.15


@pytest.fixture(scope="module")
def x(spark):
    return Raster.from_array(spark, X, G, valid=OK)


def brute(f, edge, fp):
    hh, hw = fp.shape[0] // 2, fp.shape[1] // 2
    mode = {"nearest": "edge", "reflect": "reflect", "wrap": "wrap"}.get(edge)
    pad = ((hh, hh), (hw, hw))
    v = np.pad(X, pad, mode=mode) if mode else np.pad(X, pad)
    m = np.pad(OK, pad, mode=mode) if mode else np.pad(OK, pad)
    out, n = np.zeros(X.shape), np.zeros(X.shape, int)
    for i in range(7):
        for j in range(9):
            k = m[i : i + fp.shape[0], j : j + fp.shape[1]] & fp
            cells = v[i : i + fp.shape[0], j : j + fp.shape[1]][k]
            n[i, j] = len(cells)
            out[i, j] = f(cells) if len(cells) else 0
    return out, n


@pytest.mark.parametrize("edge", ["invalid", "nearest", "reflect", "wrap"])
@pytest.mark.parametrize("shape", ["square", "cross"])
def test_focal(x, edge, shape):
    fp = np.ones((3, 5), bool) if shape == "square" else np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]], bool)
    for name, op, f in (("sum", focal.focal_sum, np.sum), ("mean", focal.focal_mean, np.mean), ("max", focal.focal_max, np.max), ("std", focal.focal_std, np.std), ("median", focal.focal_median, np.median)):
        want, n = brute(f, edge, fp)
        ok = n >= 2
        if edge == "invalid":
            hh, hw = fp.shape[0] // 2, fp.shape[1] // 2
            ok[:hh] = ok[-hh:] = False
            ok[:, :hw] = ok[:, -hw:] = False
        got, m = op(x, footprint=fp, edge=edge, valid_neighbor="ignore_invalid", min_valid_count=2).collect()
        assert (m == ok).all(), name
        np.testing.assert_allclose(got[ok].astype(float), want[ok], rtol=1e-5, err_msg=name)


def test_known_focal(spark):
    ones = Raster.from_array(spark, np.full((3, 3), 255, np.uint8), Grid(3, 3))
    s = focal.focal_sum(ones, size=3)
    assert s.dtype == "uint64" and s.collect()[0][1, 1] == 2295


def test_plane(spark):
    z = np.tile(np.arange(7, dtype=np.float32), (7, 1))
    r = Raster.from_array(spark, z, Grid(7, 7))
    s, m = terrain.slope(r).collect()
    assert m[1:-1, 1:-1].all() and m.sum() == 25
    np.testing.assert_allclose(s[m], 45, rtol=1e-6)
    a, am = terrain.aspect(r).collect()
    np.testing.assert_allclose(a[am], 270)
    assert set(terrain.hillshade(r).collect()[0][m].tolist()) == {218}
    assert not terrain.aspect(Raster.from_array(spark, np.ones((5, 5)), Grid(5, 5))).collect()[1].any()


def test_quadratic_surface_uses_central_differences(spark):
    r, c = np.indices((6, 6), dtype=float)
    z = c * c + 3 * r * c
    got = terrain.slope(Raster.from_array(spark, z, Grid(6, 6)), compute_edges=True, units="percent").collect()[0]
    dy, dx = np.gradient(z)
    np.testing.assert_allclose(got, 100 * np.hypot(dx, dy), rtol=1e-5)


def labels(mask, eight):
    out, n = np.zeros(mask.shape, int), 0
    for i, j in np.argwhere(mask):
        if out[i, j]:
            continue
        n += 1
        stack = [(i, j)]
        while stack:
            a, b = stack.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                out[a, b] = n
                stack += [(a + u, b + v) for u in (-1, 0, 1) for v in (-1, 0, 1) if eight or u == 0 or v == 0]
    return out


@pytest.mark.parametrize("connectivity", [4, 8])
def test_regions(spark, connectivity):
    mask = np.random.default_rng(7).random((13, 17)) > 0.5
    want = labels(mask, connectivity == 8)
    r = Raster.from_array(spark, mask, Grid(17, 13))
    assert (regions.label_regions(r, connectivity=connectivity, tile=4).collect()[0] == want).all()
    sizes = np.where(want > 0, np.bincount(want.ravel())[want], 0)
    assert (regions.region_sizes(r, connectivity=connectivity, tile=4).collect()[0] == sizes).all()
    assert (regions.filter_regions_by_size(r, threshold=5, connectivity=connectivity, tile=4).collect()[0] == (sizes >= 5)).all()


def test_spur_survives_with_its_seed(spark):
    m = np.zeros((5, 6), bool)
    m[1:4, 1:4] = True
    m[2, 4] = True
    kept = regions.filter_regions_by_size(Raster.from_array(spark, m, Grid(6, 5)), threshold=9, cleanup="opening", iterations=1)
    assert (kept.collect()[0] == m).all()


@pytest.mark.parametrize("metric", ["euclidean", "taxicab", "chessboard"])
def test_distance(spark, metric):
    m = np.random.default_rng(3).random((12, 15)) > 0.93
    rows, cols = np.argwhere(m).T
    i, j = np.indices(m.shape)
    dr, dc = abs(i[..., None] - rows), abs(j[..., None] - cols)
    want = {"euclidean": np.hypot(dr, dc), "taxicab": dr + dc, "chessboard": np.maximum(dr, dc)}[metric].min(-1)
    d = distance.distance_to(Raster.from_array(spark, m, Grid(15, 12)), metric=metric)
    assert d.dtype == "float32"
    np.testing.assert_allclose(d.collect()[0], want, rtol=1e-6)


def test_physical_distance(spark):
    m = np.zeros((5, 5), bool)
    m[2, 2] = True
    flat = distance.distance_to(Raster.from_array(spark, m, Grid(5, 5, (0, 20, 0, 0, 0, -10))), units="physical").collect()[0]
    assert flat[2, 1] == 20 and flat[1, 2] == 10
    skew = distance.distance_to(Raster.from_array(spark, m, Grid(5, 5, (0, 20, 2, 0, 0, -10))), units="physical").collect()[0]
    np.testing.assert_allclose(skew[1, 2], np.hypot(2, 10))


def test_zonal(spark):
    v = Raster.from_array(spark, np.array([[1, 2], [99, 4]], np.float32), Grid(2, 2), valid=np.array([[1, 1], [0, 1]], bool))
    z = Raster.from_array(spark, np.array([[1, 1], [2, 2]]), Grid(2, 2))
    rows = {r["zone"]: r for r in zonal.to_records(zonal.zonal_stats(v, z, include_zone_ids=[1, 2, 7]))}
    assert rows[2]["count"] == 2 and rows[2]["valid_count"] == 1 and rows[2]["mean"] == 4 and rows[1]["sum"] == 3
    assert rows[7]["count"] == 0 and rows[7]["mean"] is None


def test_global(spark):
    r = Raster.from_array(spark, np.array([[1, 2], [3, 4]], np.float32), Grid(2, 2))
    s = reductions.statistics_record(r)
    assert (s["count"], s["sum"], s["mean"], s["range"]) == (4, 10, 2.5, 3)
    h = [x["count"] for x in reductions.histogram(r, bins=3).orderBy("bin").collect()]
    assert h == np.histogram([1, 2, 3, 4], 3)[0].tolist()


def test_resample(spark, x):
    same = resample.resample_to(x, G)
    assert same.array_equal(x)
    half = Grid(9, 7, (1000.0, 20.0, 0.0, 2000.0, 0.0, -10.0))
    up = resample.resample_to(x, Grid(18, 14, (1000.0, 10.0, 0.0, 2000.0, 0.0, -5.0)))
    v, m = up.collect()
    assert (m == np.repeat(np.repeat(OK, 2, 0), 2, 1)).all() and (v[m] == np.repeat(np.repeat(X, 2, 0), 2, 1)[m]).all()
    with pytest.raises(Exception):
        resample.resample_to(x, half, resampling="bilinear")


def test_components_by_rounds_and_in_one_task(spark):
    from terrella.operators.graph import components, numbered

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)], "a long, b long")
    want = {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}
    for limit in (0, 10_000):
        assert {r["node"]: r["root"] for r in components(edges, in_one_task=limit).collect()} == want
    assert [r["n"] for r in numbered(spark.range(5, 50, 5).select("id"), "id", "n").orderBy("id").collect()] == list(range(1, 10))


def test_quantiles_by_narrowing(spark):
    from terrella.operators.quantiles import grouped_quantiles

    rng = np.random.default_rng(9)
    groups = {0: rng.normal(0, 1, 3000), 1: np.round(rng.random(500), 1), 2: np.array([7.0]), 3: rng.random(40) * 1e-300, 4: np.array([-1e308, 1.0, 1e308])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [(0, None), (5, None), (0, float("nan"))]
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = grouped_quantiles(spark.createDataFrame(rows, "zone int, v double"), "zone", "v", shares, parts=8, sorted_values=5).collect()
    assert len(got) == 5 * len(shares)
    for r in got:
        if r["zone"] != 4:
            np.testing.assert_allclose(r["quantile"], np.quantile(groups[r["zone"]], r["share"]), rtol=1e-12)


def test_large_zones_have_the_same_percentiles(spark, x):
    z = Raster.from_array(spark, (np.indices((7, 9)).sum(0) // 6).astype(np.int32), G)
    names = ["count", "mean", "median", "p25", "p90"]
    a, b = (zonal.to_records(zonal.zonal_stats(x, z, statistics=names, held_values=n)) for n in (10**9, 3))
    assert a == b
