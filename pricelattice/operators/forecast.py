"""Short-horizon price forecasts: ARIMA by exact likelihood, for many products at once."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import last_n

#: Fixed value: the normal quantile of a two-sided 90 % interval.
Z90 = 1.6448536269514722
SCHEMA = "product_id long, forecast_date date, predicted_price decimal(12,2), lower_bound decimal(12,2), upper_bound decimal(12,2), method string"


#: Steps with exact variances, beyond which these are those of the noise to the last digit; cells of a matrix and candidates x products that are worked on together.
EXACT, CELLS, WIDE = 1024, 1 << 21, 1 << 18


def innovations(x: np.ndarray, n: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For many series x[t] = phi x[t-1] + e[t] + theta e[t-1], started in their stationary state, and for each of their parameter pairs: the sum of squared one-step
    errors by their relative variances, the sum of the logarithms of these, the last error, and its weight in the next step.

    ``x`` has a series a row, the longest first, of ``n`` values each; ``phi`` and ``theta`` a row of candidates for each. All series take a step together; a long one is
    worked on in blocks (:func:`_tail`).
    """
    r = 1 + (phi + theta) ** 2 / np.maximum(1e-12, 1 - phi**2)  # variance of the first value, that of e being 1
    guess, squares, logs, error, weight = (np.zeros_like(phi) for _ in range(5))
    product, square = np.ones_like(phi), theta**2
    live = np.searchsorted(-n, -np.arange(x.shape[1]), "left")
    for t in range(min(x.shape[1], EXACT)):
        k = int(live[t])
        value, rk = x[:k, t, None], r[:k]
        e = value - guess[:k]
        squares[:k] += e * e / rk
        product[:k] *= rk
        if t % 64 == 63:  # a variance is below 100
            logs += np.log(product)
            product[:] = 1
        w = theta[:k] / rk
        error[:k], weight[:k] = e, w
        guess[:k] = phi[:k] * value + w * e
        r[:k] = 1 + square[:k] - square[:k] / rk
    logs += np.log(product)
    for i in np.flatnonzero(n > EXACT).tolist():
        more, error[i] = _tail(x[i, EXACT - 1 : n[i]], phi[i], theta[i], error[i])
        squares[i] += more
        weight[i] = theta[i]
    return squares, logs, error, weight


def _tail(x: np.ndarray, phi: np.ndarray, theta: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared errors e[t] = x[t] - phi x[t-1] - theta e[t-1] from ``x[1]`` on, and the last one.

    Errors depend linearly on the one before, so equal blocks start from 0 together, in as many steps as a block is long, and are then put right by the error that
    each began with.
    """
    size = max(1, int(np.sqrt(len(x) - 1)))
    rest = (len(x) - 1) % size
    squares = np.zeros_like(phi)
    for t in range(1, rest + 1):
        error = x[t] - phi * x[t - 1] - theta * error
        squares += error**2
    now, before = x[1 + rest :].reshape(-1, size), x[rest:-1].reshape(-1, size)
    e, own, cross = (np.zeros((len(now), len(phi))) for _ in range(3))
    power, powers = np.ones_like(theta), np.zeros_like(theta)
    for k in range(size):
        e = now[:, k, None] - phi * before[:, k, None] - theta * e
        power = power * -theta
        own += e * e
        cross += e * power
        powers += power * power
    for b in range(len(now)):
        squares += own[b] + 2 * error * cross[b] + error * error * powers
        error = e[b] + power * error
    return squares, error


def log_likelihoods(x: np.ndarray, n: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Exact Gaussian log likelihoods at the best variance for each series and candidate."""
    squares, logs, _, _ = innovations(x, n, phi, theta)
    count = n[:, None]
    return -0.5 * (count * np.log(2 * np.pi * np.maximum(squares, 1e-300) / count) + count + logs)


def fit_arma_all(x: np.ndarray, n: np.ndarray, moving: bool = True, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phi, theta, variance) of the largest exact likelihood of each series: the best of a grid inside the unit square, then the best of 5 x 5 points around it, over
    and over, at half the distance each time. A better point is never left."""
    phi, theta = np.zeros(len(n)), np.zeros(len(n))
    offsets = np.linspace(-1, 1, 25), np.linspace(-1, 1, 5)
    width = 0.98
    for k in range(rounds + 1):
        side = offsets[min(k, 1)] * width
        p, q = (g.ravel() for g in np.meshgrid(side, side if moving else np.zeros(1)))
        step = max(1, WIDE // len(p))
        for lo in range(0, len(n), step):
            part = slice(lo, lo + step)
            a, b = np.clip(phi[part, None] + p, -0.98, 0.98), np.clip(theta[part, None] + q, -0.98, 0.98)
            best = np.argmax(log_likelihoods(x[part], n[part], a, b), axis=1)[:, None]
            phi[part], theta[part] = np.take_along_axis(a, best, 1)[:, 0], np.take_along_axis(b, best, 1)[:, 0]
        width = 0.98 / 12 if k == 0 else width / 2
    squares = innovations(x, n, phi[:, None], theta[:, None])[0][:, 0]
    return phi, theta, squares / np.maximum(1, n)


def _matrix(series: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Series as rows of one matrix, and their lengths."""
    n = np.array([len(s) for s in series])
    x = np.zeros((len(series), int(n.max(initial=0))))
    for row, s in zip(x, series):
        row[: len(s)] = s
    return x, n


def _together(series: list[np.ndarray]) -> Iterator[list[int]]:
    """Numbers of series, the longest first, in groups whose matrix has few enough cells."""
    order = sorted(range(len(series)), key=lambda i: -len(series[i]))
    lo = 0
    while lo < len(order):
        rows = max(1, CELLS // max(1, len(series[order[lo]])))
        yield order[lo : lo + rows]
        lo += rows


def arima_forecasts(prices: list[np.ndarray], horizon: int) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Means and standard errors of ARIMA(1,1,1) for each series; where it has no likelihood (no changes) ARIMA(1,0,0) with a constant; None where a price is
    missing or not finite."""
    out: list = [None] * len(prices)
    moves, flat = [], []
    for i, x in enumerate(prices):
        if len(x) and np.isfinite(x).all():
            d = np.diff(x)
            (moves if len(d) and not np.allclose(d, 0) else flat).append(i)
    for group in _together([np.diff(prices[i]) for i in moves]):
        ids = [moves[i] for i in group]
        x, n = _matrix([np.diff(prices[i]) for i in ids])
        phi, theta, var = fit_arma_all(x, n)
        _, _, error, weight = innovations(x, n, phi[:, None], theta[:, None])
        steps = np.empty((len(ids), horizon))
        steps[:, 0] = phi * x[np.arange(len(n)), n - 1] + weight[:, 0] * error[:, 0]
        for h in range(1, horizon):
            steps[:, h] = phi * steps[:, h - 1]
        psi = np.column_stack([np.ones(len(n)), (phi + theta)[:, None] * phi[:, None] ** np.arange(horizon - 1)])  # of the differences
        mean = np.array([prices[i][-1] for i in ids])[:, None] + np.cumsum(steps, axis=1)
        se = np.sqrt(var[:, None] * np.cumsum(np.cumsum(psi, axis=1) ** 2, axis=1))
        for k, i in enumerate(ids):
            out[i] = (mean[k], se[k])
    for i in flat:
        out[i] = ar_forecast(prices[i], horizon)
    return out


def ar_forecast(prices: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard errors of ARIMA(1,0,0) with a constant; raises where there is no finite price."""
    x = np.asarray(prices, float)
    if not len(x) or not np.isfinite(x).all():
        raise ValueError("no finite prices")
    mean = x.mean()
    if np.allclose(x, mean):
        return np.full(horizon, mean), np.zeros(horizon)
    phi, _, var = (float(v[0]) for v in fit_arma_all((x - mean)[None, :], np.array([len(x)]), moving=False))
    powers = phi ** np.arange(1, horizon + 1)
    return mean + powers * (x[-1] - mean), np.sqrt(var * np.cumsum(np.concatenate(([1.0], powers[:-1])) ** 2))


#: Products and values that are fitted together; a longer series stands alone.
CHUNK_PRODUCTS, CHUNK_VALUES = 2_000, 1 << 20


def _series(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, np.ndarray, int]]]:
    """Chunks of (product, prices in order, last day) from rows in the order of product and time."""
    chunk: list[tuple[int, np.ndarray, int]] = []
    held: list[np.ndarray] = []
    own, day, values = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, prices, days = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if held and ids[lo] != own:
                chunk.append((own, np.concatenate(held), day))
                values += len(chunk[-1][1])
                held = []
                if len(chunk) >= CHUNK_PRODUCTS or values >= CHUNK_VALUES:
                    yield chunk
                    chunk, values = [], 0
            own, day = int(ids[lo]), int(days[hi - 1])
            held.append(prices[lo:hi].astype(float))
    if held:
        chunk.append((own, np.concatenate(held), day))
    if chunk:
        yield chunk


def _forecaster(horizon: int, least_rows: int):
    money = pa.decimal128(12, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _series(batches):
            chunk = [c for c in chunk if len(c[1]) >= least_rows]
            found = arima_forecasts([p for _, p, _ in chunk], horizon)
            rows = [(i, day, *f) for (i, _, day), f in zip(chunk, found) if f is not None and np.isfinite(f[0]).all() and (np.abs(f[0]) + 2 * f[1] < 1e10).all()]
            if not rows:
                continue
            mean, se = np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows])
            two = lambda v: pa.array([Decimal(f"{x:.2f}") for x in np.maximum(v, 0).tolist()], money)
            days = np.repeat([r[1] for r in rows], horizon) + np.tile(np.arange(1, horizon + 1), len(rows))
            yield pa.RecordBatch.from_pydict({
                "product_id": pa.array(np.repeat([r[0] for r in rows], horizon), pa.int64()), "forecast_date": pa.array(days.astype(np.int32), pa.int32()).cast(pa.date32()),
                "predicted_price": two(mean), "lower_bound": two(mean - Z90 * se), "upper_bound": two(mean + Z90 * se), "method": pa.array(["ARIMA"] * len(mean)),
            })

    return run


def forecast_products(history: DataFrame, product: DataFrame, horizon: int = 7, least_rows: int = 7, recent: int | None = None) -> DataFrame:
    """The next ``horizon`` days after each active product's last row, 90 % bounds, all clamped at 0.

    Rows count as equally spaced. Rows are dealt by product and come in order, so a task holds a chunk of products at a time, and fits them together; ``recent`` may
    bound a product to its newest rows. A product that cannot be fitted has no rows, and the others theirs.
    """
    rows = history.join(product.where("is_active").select("product_id"), "product_id", "left_semi")
    rows = last_n(rows, recent) if recent else rows
    dealt = rows.repartition("product_id").sortWithinPartitions("product_id", "ts", "tie")
    return dealt.select(F.col("product_id").cast("long").alias("product_id"), F.col("price").cast("double").alias("p"), F.unix_date(F.to_date("ts")).alias("day")).mapInArrow(_forecaster(horizon, least_rows), SCHEMA)


def forecast_for_ids(history: DataFrame, product: DataFrame, ids: list[int], horizon: int = 7) -> DataFrame:
    """Forecasts of the products asked for; ids that repeat, are unknown or not active change nothing."""
    wanted = sorted(set(ids))
    return forecast_products(history.where(F.col("product_id").isin(wanted)), product.where(F.col("product_id").isin(wanted)), horizon)


def forecast_counts(history: DataFrame, product: DataFrame, forecasts: DataFrame, least_rows: int = 7) -> dict[str, int]:
    """How many forecast days were made, and for how many active products with enough rows there are none."""
    enough = history.groupBy("product_id").count().where(F.col("count") >= least_rows).join(product.where("is_active").select("product_id"), "product_id", "left_semi")
    return {"forecasts_created": forecasts.count(), "errors": enough.join(forecasts.select("product_id"), "product_id", "left_anti").count()}
