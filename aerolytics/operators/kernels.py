"""NumPy kernels over equal-length rows; Spark does segmentation, grouping and averaging."""

from __future__ import annotations

import numpy as np


def window(name: str, n: int) -> np.ndarray:
    """Periodic windows."""
    turn = 2 * np.pi * np.arange(n) / n
    if name == "hann":
        return 0.5 - 0.5 * np.cos(turn)
    if name == "hamming":
        return 0.54 - 0.46 * np.cos(turn)
    if name == "blackman":
        return 0.42 - 0.5 * np.cos(turn) + 0.08 * np.cos(2 * turn)
    if name == "boxcar":
        return np.ones(n)
    raise ValueError(f"unknown window {name}")


def periodogram(rows: np.ndarray, rate: np.ndarray, name: str = "hann", scaling: str = "density") -> np.ndarray:
    """One-sided power of each row, its mean removed; by Hz for ``density``, else as ``spectrum``."""
    n = rows.shape[1]
    w = window(name, n)
    power = np.abs(np.fft.rfft((rows - rows.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2
    power = power / (rate[:, None] * (w**2).sum()) if scaling == "density" else power / w.sum() ** 2
    power[:, 1 : None if n % 2 else -1] *= 2
    return power


def stft_power(rows: np.ndarray, name: str = "hann") -> np.ndarray:
    """Squared magnitudes of each row's transform under the window, scaled by the window's sum."""
    w = window(name, rows.shape[1])
    return np.abs(np.fft.rfft(rows * w, axis=1) / w.sum()) ** 2


def wiener_steps(setpoint: np.ndarray, gyro: np.ndarray, size: np.ndarray, floor: float = 1e-3) -> np.ndarray:
    """Step response of each row's pair by regularised deconvolution, scaled to end at one; rows of NaN without input.

    ``size`` is the length of each row's response; beyond it a row goes on unscaled by its own tail.
    """
    x, y = np.fft.rfft(setpoint, axis=1), np.fft.rfft(gyro, axis=1)
    power = np.abs(x) ** 2
    top = power.max(axis=1, keepdims=True, initial=0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        impulse = np.fft.irfft(y * np.conj(x) / (power + floor * top), n=setpoint.shape[1], axis=1)
    steps = np.cumsum(impulse, axis=1)
    size = size.reshape(-1).astype(np.int64)
    for n in np.unique(size):
        of = np.flatnonzero(size == n)
        level = np.abs(steps[of, n + (-n // 4) : n].mean(axis=1))
        steps[of] /= np.where(level > 1e-6, level, 1.0)[:, None]
    steps[top[:, 0] == 0] = np.nan
    return steps
