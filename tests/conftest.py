import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from barflow.session import build_session

    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="6g", spark__ui__enabled="false"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_bars(spark):
    """Indexed daily bars of a random walk per symbol; ``sizes`` maps symbol to length."""
    import numpy as np
    import pandas as pd

    def build(sizes, seed=7, gap=1):
        rng = np.random.default_rng(seed)
        frames = []
        for symbol, n in sizes.items():
            close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
            open_ = np.concatenate([[100.0], close[:-1]])
            high = np.maximum(open_, close) * (1 + rng.uniform(0, 0.005, n))
            low = np.minimum(open_, close) * (1 - rng.uniform(0, 0.005, n))
            days = np.cumsum(rng.integers(1, gap + 1, n))
            ts = pd.Timestamp("2020-01-01") + pd.to_timedelta(days, unit="D")
            frames.append(
                pd.DataFrame(
                    {"symbol": symbol, "ts": ts, "open": open_, "high": high, "low": low, "close": close, "volume": rng.uniform(100, 10_000, n), "bar_idx": np.arange(n)}
                )
            )
        local = pd.concat(frames, ignore_index=True)
        return local, spark.createDataFrame(local)

    return build
