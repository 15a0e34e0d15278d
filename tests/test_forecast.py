"""Forecasts: exact likelihoods, the best of them, many products at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelattice.operators import forecast as fc
from pricelattice.plans.queries import QUERIES
from pricelattice.sources import views

DATA = "/root/testdata/sf0.001"


def one_by_one(x, phi, theta):
    """The recursion a value at a time, as the definition has it: sum of squares, sum of logarithms, last error, its weight."""
    r, guess, squares, logs, error, weight = 1 + (phi + theta) ** 2 / max(1e-12, 1 - phi**2), 0.0, 0.0, 0.0, 0.0, 0.0
    for value in x:
        error = value - guess
        squares += error**2 / r
        logs += np.log(r)
        weight = theta / r
        guess = phi * value + weight * error
        r = 1 + theta**2 - theta**2 / r
    return squares, logs, error, weight


def likelihood(x, phi, theta):
    squares, logs, _, _ = one_by_one(x, phi, theta)
    return -0.5 * (len(x) * np.log(2 * np.pi * max(squares, 1e-300) / len(x)) + len(x) + logs)


def closing_grid(x):
    """The best likelihood of four grids of 25 x 25 points, each a tenth as wide."""
    centre, width, n = np.zeros(2), 0.98, np.array([len(x)])
    for _ in range(4):
        side = np.linspace(-width, width, 25)
        phi, theta = (g.ravel() for g in np.meshgrid(np.clip(centre[0] + side, -0.98, 0.98), np.clip(centre[1] + side, -0.98, 0.98)))
        found = fc.log_likelihoods(x[None, :], n, phi[None, :], theta[None, :])[0]
        best = int(np.argmax(found))
        centre, width = np.array([phi[best], theta[best]]), width / 10
    return found[best]


def test_likelihood_equals_that_of_the_whole_covariance():
    x = np.random.default_rng(1).normal(size=40).cumsum() * 0.3
    for phi, theta in ((0.5, 0.3), (-0.7, 0.2), (0.9, -0.4), (0.0, 0.6), (0.4, 0.0)):
        psi = np.concatenate(([1.0], (phi + theta) * phi ** np.arange(400)))
        cov = np.array([[(psi[: 401 - abs(i - j)] * psi[abs(i - j) :]).sum() for j in range(40)] for i in range(40)])
        var = x @ np.linalg.solve(cov, x) / 40
        want = -0.5 * (40 * np.log(2 * np.pi * var) + np.linalg.slogdet(cov)[1] + 40)
        assert abs(likelihood(x, phi, theta) - want) < 1e-6


@pytest.mark.parametrize("lengths", [(1, 2, 7), (70, 70, 3), (1024, 1025, 1026), (3000, 40, 1100)])
def test_series_together_equal_one_by_one(lengths):
    rng = np.random.default_rng(2)
    series = sorted((rng.normal(size=k) for k in lengths), key=len, reverse=True)
    x, n = fc._matrix(series)
    phi, theta = rng.uniform(-0.98, 0.98, (len(n), 4)), rng.uniform(-0.98, 0.98, (len(n), 4))
    phi[0, 0], theta[0, 0], theta[0, 1] = 0.98, -0.98, 0.98
    got = fc.innovations(x, n, phi, theta)
    for i, s in enumerate(series):
        for c in range(4):
            want = one_by_one(s, phi[i, c], theta[i, c])
            assert np.allclose([g[i, c] for g in got], want, rtol=1e-9, atol=1e-9)


def test_fits_are_as_good_as_closing_grids():
    rng = np.random.default_rng(3)
    series = []
    for k in range(25):
        e, x = rng.normal(size=30 + 5 * k), np.zeros(30 + 5 * k)
        phi, theta = rng.uniform(-0.95, 0.95, 2)
        for t in range(1, len(x)):
            x[t] = phi * x[t - 1] + e[t] + theta * e[t - 1]
        series.append(x * rng.uniform(0.1, 100))
    series.sort(key=len, reverse=True)
    x, n = fc._matrix(series)
    phi, theta, var = fc.fit_arma_all(x, n)
    for i, s in enumerate(series):
        assert likelihood(s, phi[i], theta[i]) >= closing_grid(s) - 1e-6
        assert abs(var[i] - one_by_one(s, phi[i], theta[i])[0] / len(s)) < 1e-9 * max(1, var[i])


def test_parameters_of_a_long_process_are_found():
    rng = np.random.default_rng(0)
    x = np.zeros(20_000)
    e = rng.normal(size=len(x))
    for t in range(1, len(x)):
        x[t] = 0.6 * x[t - 1] + e[t] - 0.3 * e[t - 1]
    phi, theta, var = fc.fit_arma_all(x[None, :], np.array([len(x)]))
    assert abs(phi[0] - 0.6) < 0.05 and abs(theta[0] + 0.3) < 0.05 and abs(var[0] - 1) < 0.05


def test_flat_and_missing_prices():
    (mean, se), none, (mean_1, _) = fc.arima_forecasts([np.full(10, 5.0), np.array([1.0, np.nan, 3.0]), np.array([7.0])], 3)
    assert (mean == 5).all() and (se == 0).all() and none is None and (mean_1 == 7).all()
    x = np.random.default_rng(1).normal(size=40).cumsum()
    mean, se = fc.ar_forecast(10 + x, 5)
    assert (np.diff(np.abs(mean - (10 + x.mean()))) <= 0).all() and (np.diff(se) >= 0).all()
    with pytest.raises(ValueError):
        fc.ar_forecast(np.array([np.nan]), 2)


def test_all_forecasts_follow_from_their_fits(spark):
    """Against NumPy alone, a product at a time: means and bounds from the recursion at the fitted parameters, over a whole table."""
    t = views.events_view(spark, DATA)
    pdf = t.history.join(t.product.where("is_active").select("product_id"), "product_id").toPandas().sort_values(["product_id", "ts", "tie"])
    got = {k: g.sort_values("forecast_date") for k, g in QUERIES["forecasts"](spark, DATA).toPandas().groupby("product_id")}
    want = {k: g for k, g in pdf.groupby("product_id") if len(g) >= 7}
    assert set(got) == set(want) and len(got) > 5
    for k, g in want.items():
        p = g["price"].astype(float).to_numpy()
        d = np.diff(p)
        phi, theta, var = (v[0] for v in fc.fit_arma_all(d[None, :], np.array([len(d)])))
        squares, _, error, weight = one_by_one(d, phi, theta)
        level, step, total = p[-1], phi * d[-1] + weight * error, 0.0
        for h, row in enumerate(got[k].itertuples()):
            level += step
            step *= phi
            total += (1 + sum((phi + theta) * phi**j for j in range(h))) ** 2
            half = fc.Z90 * np.sqrt(squares / len(d) * total)
            assert row.forecast_date == g["ts"].iloc[-1].date() + np.timedelta64(h + 1, "D").astype(object)
            assert np.allclose([row.predicted_price, row.lower_bound, row.upper_bound], np.maximum([level, level - half, level + half], 0), atol=0.0051)


def test_products_do_not_disturb_each_other(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(p, float(rng.integers(1, 90)), t) for p in range(30) for t in range(int(rng.integers(1, 30)))] + [(99, float("nan") if t == 4 else 5.0, t) for t in range(9)] + [(98, 3.0, t) for t in range(8)]
    h = spark.createDataFrame(rows, "product_id long, price double, tie long").withColumn("ts", F.timestamp_seconds(F.col("tie") * 86400).cast("timestamp_ntz"))
    items = spark.createDataFrame([(p, p != 7) for p in [*range(30), 98, 99]], "product_id long, is_active boolean")
    whole = sorted(map(tuple, fc.forecast_products(h, items).collect()))
    ids = {r[0] for r in whole}
    assert 98 in ids and 99 not in ids and 7 not in ids and ids == {p for p, n in h.groupBy("product_id").count().collect() if n >= 7} - {7, 99}
    monkeypatch.setattr(fc, "CHUNK_PRODUCTS", 2)
    assert sorted(map(tuple, fc.forecast_products(h.repartition(5), items).collect())) == whole
    assert fc.forecast_products(h.limit(0), items).isEmpty()
