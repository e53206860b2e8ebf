from __future__ import annotations

import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from encephalake.dims import CHANNEL_NAMES  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from encephalake.session import get_session

    session = get_session("tests", cores=8)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


def long_frame(matrix: np.ndarray, session: str = "T0") -> pd.DataFrame:
    c, n = matrix.shape
    return pd.DataFrame(
        {
            "session_id": session,
            "channel": np.repeat([CHANNEL_NAMES[i] for i in range(c)], n),
            "channel_idx": np.repeat(np.arange(c, dtype=np.int32), n),
            "sample_idx": np.tile(np.arange(n, dtype=np.int64), c),
            "uv": matrix.ravel().astype(float),
        }
    )


@pytest.fixture(scope="session")
def to_samples(spark):
    return lambda m, session="T0": spark.createDataFrame(long_frame(np.asarray(m), session))


@pytest.fixture(scope="session")
def synthetic():
    """16 x 1250: smoothed noise plus a 10 Hz sine of about 15 uV."""
    rng = np.random.default_rng(42)
    t = np.arange(1250) / 125
    white = np.fft.rfft(rng.standard_normal((16, 1250)), axis=1)
    pink = np.fft.irfft(white / np.sqrt(np.arange(1, white.shape[1] + 1)), 1250, axis=1)
    pink *= 10 / pink.std(axis=1, keepdims=True)
    amp = 15 + 3 * rng.standard_normal((16, 1))
    return pink + amp * np.sin(2 * np.pi * 10 * t + rng.uniform(0, 2 * np.pi, (16, 1)))


def matrix_of(df, value="uv", channels=None) -> np.ndarray:
    pdf = df.toPandas().sort_values(["channel_idx", "sample_idx"])
    return np.stack([g[value].to_numpy() for _, g in pdf.groupby("channel_idx")])
