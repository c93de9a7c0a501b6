"""Small bar and signal frames for the tests."""

import datetime as dt

import numpy as np

BAR = "symbol string, tf string, ts timestamp, open double, high double, low double, close double, volume double"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def walk(n, seed, symbol="A", minutes=5, scale=0.3):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, scale, n))
    open_ = np.r_[100, close[:-1]]
    high = np.maximum(open_, close) + rng.uniform(0.1, 0.5, n)
    low = np.minimum(open_, close) - rng.uniform(0.1, 0.5, n)
    vol = rng.uniform(80, 200, n)
    return [
        (symbol, f"{minutes}m", START + dt.timedelta(minutes=minutes * i), *map(float, (open_[i], high[i], low[i], close[i], vol[i])))
        for i in range(n)
    ]


def bar_frame(spark, rows):
    return spark.createDataFrame(rows, BAR)


def path_frame(spark, highs, lows, closes=None, symbol="A"):
    closes = closes or [(h + l) / 2 for h, l in zip(highs, lows)]
    return spark.createDataFrame(
        [(symbol, i, float(h), float(l), float(c)) for i, (h, l, c) in enumerate(zip(highs, lows, closes))],
        "symbol string, seq bigint, high double, low double, close double",
    )
