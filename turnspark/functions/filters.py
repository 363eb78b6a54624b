"""Zero-phase band-pass and notch filters (textbook designs) for blocks of signals."""

from __future__ import annotations

import numpy as np


def butter_bandpass(order: int, low: float, high: float, fs: float):
    """Butterworth band-pass coefficients (b, a) by the bilinear transform."""
    steps = np.arange(-order + 1, order, 2)
    prototype = -np.exp(1j * np.pi * steps / (2 * order))
    edges = 4.0 * np.tan(np.pi * np.array([low, high]) / fs)
    width, centre = edges[1] - edges[0], np.sqrt(edges[0] * edges[1])
    half = prototype * width / 2
    root = np.sqrt(half**2 - centre**2)
    poles = np.concatenate([half + root, half - root])
    gain = (width**order) * np.real(4.0**order / np.prod(4.0 - poles))
    digital_poles = (4.0 + poles) / (4.0 - poles)
    zeros = np.concatenate([np.ones(order), -np.ones(order)])
    return gain * np.poly(zeros), np.real(np.poly(digital_poles))


def notch(freq: float, fs: float, q: float = 30.0):
    """Second-order notch coefficients (b, a)."""
    angle = 2 * np.pi * freq / fs
    gain = 1.0 / (1.0 + np.tan(angle / q / 2))
    middle = -2.0 * np.cos(angle)
    return gain * np.array([1.0, middle, 1.0]), np.array([1.0, gain * middle, 2 * gain - 1.0])


def band_without_hum(low: float, high: float, fs: float, hum: tuple[float, ...] = (50.0, 60.0)) -> list[tuple]:
    """Notches at the mains frequencies below half the rate, then a band that ends 1 Hz below it at most."""
    notches = [notch(freq, fs) for freq in hum if 2 * freq < fs]
    return [*notches, butter_bandpass(4, low, min(high, fs / 2 - 1.0), fs)]


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Filter state that makes a unit step come out flat from the first sample."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[:, 0] = -a[1:]
    companion[:-1, 1:] = np.eye(n - 1)
    return np.linalg.solve(np.eye(n) - companion, b[1:] - a[1:] * b[0])


def run_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Transposed direct form along the last axis, all rows of the block at once."""
    out = np.empty_like(x)
    for t in range(x.shape[1]):
        sample = x[:, t]
        y = b[0] * sample + state[:, 0]
        out[:, t] = y
        state[:, :-1] = state[:, 1:] + sample[:, None] * b[1:-1] - y[:, None] * a[1:-1]
        state[:, -1] = b[-1] * sample - a[-1] * y
    return out


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward over an odd extension of 3 filter lengths at both ends."""
    pad = 3 * max(len(a), len(b))
    if x.shape[1] <= pad:
        raise ValueError(f"signals need more than {pad} samples, got {x.shape[1]}")
    left = 2 * x[:, :1] - x[:, pad:0:-1]
    right = 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]
    wide = np.concatenate([left, x, right], axis=1)
    start = steady_state(b, a)
    for _ in range(2):
        wide = run_filter(b, a, wide, wide[:, :1] * start)[:, ::-1]
    return wide[:, pad:-pad]
