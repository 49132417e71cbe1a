"""Cell operators against numpy, with invalid cells, NaN, zero and negative divisors."""

import numpy as np
import pytest

from terrella.errors import DTypeError, GridError, UnitError
from terrella.grid import Grid
from terrella.operators import local
from terrella.raster import Raster

G = Grid(4, 3)
A = np.array([[-7, 7, 0, 3], [-8, 8, 5, -1], [2, 9, -9, 4]], np.int32)
B = np.array([[3, -3, 0, 2], [-3, 3, -5, 7], [2, 4, -4, 0]], np.int32)
OK = np.array([[1, 1, 1, 0], [1, 1, 1, 1], [1, 1, 1, 1]], bool)
FL = np.array([[np.nan, 1.5, -2.5, 0], [0.5, 2.5, np.inf, -1], [1, 2, 3, 4]], np.float32)


def same(raster, values, valid):
    v, m = raster.collect()
    assert (m == valid).all(), (m, valid)
    np.testing.assert_allclose(v[valid].astype(float), np.asarray(values)[valid].astype(float), rtol=1e-6)


@pytest.fixture(scope="module")
def rasters(spark):
    return tuple(Raster.from_array(spark, x, G, valid=OK) for x in (A, B, FL))


def test_arithmetic(rasters):
    a, b, _ = rasters
    same(a + b, A + B, OK)
    same(a - 2, A - 2, OK)
    same(2 * a, 2 * A, OK)
    nz = OK & (B != 0)
    with np.errstate(all="ignore"):
        same(a // b, A // np.where(B == 0, 1, B), nz)
        same(a % b, A % np.where(B == 0, 1, B), nz)
        same(a / b, A / np.where(B == 0, 1, B), nz)
    same(-a, -A, OK)
    same(abs(a), abs(A), OK)
    same(a**3, A**3, OK)
    assert (a / b).dtype == "float64" and (a + b).dtype == "int32"


def test_keep_gives_ieee(rasters):
    a, b, _ = rasters
    v, m = local.divide(a, b, numeric_errors="keep").collect()
    assert (m == OK).all() and np.isnan(v[0, 2]) and v[2, 3] == np.inf


def test_raise_policy(rasters):
    a, b, _ = rasters
    with pytest.raises(Exception, match="numeric error"):
        local.divide(a, b, numeric_errors="raise").collect()


@pytest.mark.parametrize("dtype", ["int8", "uint8", "int16", "uint16", "int32", "uint32", "int64", "uint64"])
def test_overflow(spark, dtype):
    i = np.iinfo(dtype)
    x = np.array([[i.max, 1]], dtype)
    r = Raster.from_array(spark, x, Grid(2, 1))
    with np.errstate(over="ignore"):
        assert local.add(r, r, overflow="wrap").collect()[0].tolist() == (x + x).tolist()
    with pytest.raises(Exception, match="overflow"):
        local.add(r, r).collect()
    hidden = Raster.from_array(spark, x, Grid(2, 1), valid=np.array([[False, True]]))
    assert local.add(hidden, hidden).collect()[0][0, 1] == 2


def test_promote(spark):
    r = Raster.from_array(spark, np.array([[255, 0]], np.uint8), Grid(2, 1))
    s = local.add(r, r, overflow="promote")
    assert s.dtype == "uint16" and s.collect()[0].tolist() == [[510, 0]]


def test_floats(rasters):
    _, _, f = rasters
    ok = OK & np.isfinite(FL)
    same(f + 1, FL + 1, ok)
    assert (f + 1).dtype == "float32"
    same(round(f), np.rint(FL), ok)
    same(local.floor(f), np.floor(FL), ok)
    same(local.sqrt(f), np.sqrt(np.abs(FL)), ok & (FL >= 0))
    same(local.log(f), np.log(np.maximum(np.abs(FL), 1e-9)), ok & (FL > 0))


def test_nan_compares_false_and_valid(rasters):
    _, _, f = rasters
    with np.errstate(all="ignore"):
        for got, want in ((f < 1, FL < 1), (f >= 1, FL >= 1), (f == 1.5, FL == 1.5), (f != 1.5, FL != 1.5)):
            same(got, want, OK)


def test_strict_boolean(spark):
    a = Raster.from_array(spark, np.array([[False, True]]), Grid(2, 1))
    b = Raster.from_array(spark, np.array([[True, True]]), Grid(2, 1), valid=np.array([[False, True]]))
    assert (a & b).collect()[1].tolist() == [[False, True]]
    assert (a | b).collect()[1].tolist() == [[False, True]]


def test_where_needs_a_valid_condition(spark):
    c = Raster.from_array(spark, np.array([[True, False, True]]), Grid(3, 1), valid=np.array([[True, True, False]]))
    x = Raster.from_array(spark, np.array([[1, 2, 3]]), Grid(3, 1))
    v, m = local.where(c, x, local.invalid).collect()
    assert m.tolist() == [[True, False, False]] and v[0, 0] == 1


def test_later_entries_win(spark):
    r = Raster.from_array(spark, np.array([[1.0, 2.0, 5.0]]), Grid(3, 1))
    assert local.reclassify_ranges(r, [(0, 3, 10), (2, 6, 20)]).collect()[0].tolist() == [[10, 20, 20]]
    assert local.digitize(Raster.from_array(spark, np.array([[np.nan, 0.0, 9.0]]), Grid(3, 1)), [1, 2]).collect()[0].tolist() == [[2, 0, 2]]


def test_units_and_grids(spark, rasters):
    a, b, _ = rasters
    with pytest.raises(UnitError):
        a.with_units("m") + b.with_units("km")
    with pytest.raises(UnitError):
        a.with_units("m") * b.with_units("s")
    with pytest.raises(UnitError):
        local.sin(a)
    with pytest.raises(GridError):
        a + Raster.from_array(spark, np.zeros((3, 3), np.int32), Grid(3, 3))
    with pytest.raises(DTypeError):
        local.cast(a, "int8")
    with pytest.raises(Exception):
        bool(a)


def test_constant_normalises_to_nothing(spark):
    r = Raster.from_array(spark, np.full((1, 3), 5), Grid(3, 1))
    assert not local.normalize_minmax(r).collect()[1].any() and not local.standardize(r).collect()[1].any()


def test_equality(rasters):
    a, b, _ = rasters
    assert a.array_equal(a + 0) and not a.array_equal(b) and a.allclose(a * 1)


def test_one_table_means_no_join(rasters):
    a, _, _ = rasters
    plan = ((a + 1) * (a - 2)).df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_power_wraps_exactly_for_every_exponent(spark):
    base = np.array([[3, 5, -3, 7], [2, -1, 0, 10], [-(2**31), 2**31 - 1, 1, 6]], np.int32)
    for dtype, bits in ((np.int32, 32), (np.int64, 64)):
        a = Raster.from_array(spark, base.astype(dtype), G)
        for n in (0, 1, 63, 70_000, 70_001, 2**31 - 1):
            want = [[(pow(int(x), n, 2**bits) + 2 ** (bits - 1)) % 2**bits - 2 ** (bits - 1) for x in row] for row in base]
            got, _ = local.power(a, n, overflow="wrap").collect()
            assert got.tolist() == want, (dtype, n)
