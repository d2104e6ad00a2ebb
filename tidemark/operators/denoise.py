"""Causal denoising by wavelet shrinkage, one series per group.

At every ``stride``-th row the last ``window`` values are decomposed with the
Daubechies filter of order 4, details are softened by the universal threshold, and
the last value of the reconstruction is taken; in between the value before holds.
A prefix of a series thus never depends on what follows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Scaling coefficients of the Daubechies wavelet with four vanishing moments.
DB4 = np.array([
    0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385,
    -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278,
])


def _step(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    n = len(x)
    at = (2 * np.arange(n // 2)[:, None] + np.arange(len(h))) % n
    return x[at] @ h


def _back(a: np.ndarray, d: np.ndarray, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    n = 2 * len(a)
    out = np.zeros(n)
    at = (2 * np.arange(len(a))[:, None] + np.arange(len(h))) % n
    np.add.at(out, at, a[:, None] * h + d[:, None] * g)
    return out


def shrink(x: np.ndarray, levels: int = 3) -> np.ndarray:
    """Soft-threshold denoising of a series, mirrored to a length that can be halved."""
    g = DB4[::-1] * (-1) ** np.arange(len(DB4))
    n = len(x)
    size = max(16, 1 << int(np.ceil(np.log2(max(n, 2)))))
    y = np.pad(x, (size - n, 0), mode="symmetric") if n < size else x
    details = []
    for _ in range(levels):
        details.append(_step(y, g))
        y = _step(y, DB4)
    sigma = np.median(np.abs(details[0])) / 0.6745
    cut = sigma * np.sqrt(2 * np.log(max(n, 2)))
    for d in reversed(details):
        y = _back(y, np.sign(d) * np.maximum(np.abs(d) - cut, 0), DB4, g)
    return y[-n:]


def causal_denoise(df: DataFrame, keys: list[str], order: str, value: str, window: int = 160, stride: int = 5, least: int = 64) -> DataFrame:
    """``keys``, ``order`` and ``value``_denoised; a series shorter than ``least`` rows stays as it is.

    Nulls take the value before. A group is one entity's series.
    """
    kinds = dict(df.dtypes)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable")
        x = p[value].ffill().fillna(0.0).to_numpy(dtype=float)
        out = x.copy()
        if len(x) >= least:
            for i in range(least - 1, len(x), stride):
                out[i : i + stride] = shrink(x[max(0, i + 1 - window) : i + 1])[-1]
        return p[[*keys, order]].assign(**{f"{value}_denoised": out})

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, order]) + f", `{value}_denoised` double"
    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(run, schema)
