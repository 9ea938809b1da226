"""Front-end images of signals: the scalogram of a real Morlet wavelet, and the log-mel picture of the dashboard."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# The wavelet's range, its frequency in radians, and its resolution (a power of two).
REACH, OMEGA, PRECISION = 8.0, 5.0, 10


def wavelet(precision: int = PRECISION) -> tuple[np.ndarray, np.ndarray]:
    """Places, and the wavelet's integral up to each."""
    x = np.linspace(-REACH, REACH, 1 << precision)
    return x, np.cumsum(np.exp(-(x**2) / 2) * np.cos(OMEGA * x)) * (x[1] - x[0])


def central_frequency(precision: int = PRECISION) -> float:
    """Cycles a unit: the strongest bin of the wavelet's spectrum."""
    x = np.linspace(-REACH, REACH, 1 << precision)
    size = np.abs(np.fft.rfft(np.exp(-(x**2) / 2) * np.cos(OMEGA * x)))
    return (1 + int(size[1:].argmax())) / (2 * REACH)


@dataclass(frozen=True)
class Scale:
    """One scale as a finite filter: value ``t`` is the sum of ``taps[m] * x[t + ahead - m]``."""

    taps: np.ndarray
    ahead: int

    @property
    def behind(self) -> int:
        return len(self.taps) - 1 - self.ahead


@dataclass(frozen=True)
class Bank:
    """Filters for frequencies spaced evenly by ratio. The transform at a scale is the difference from sample to sample of the convolution with the wavelet's integral at that
    scale, so its filter is the difference of the integral's values."""

    sr: float
    low: float
    high: float
    count: int
    precision: int = PRECISION
    scales: tuple[Scale, ...] = field(init=False)

    def __post_init__(self) -> None:
        x, integral = wavelet(self.precision)
        step = x[1] - x[0]
        out = []
        for s in central_frequency(self.precision) * self.sr / self.frequencies:
            at = np.floor(np.arange(int(np.ceil(s * (x[-1] - x[0]) + 1))) / (s * step)).astype(int)
            h = integral[at[at < len(integral)]][::-1]
            out.append(Scale(-np.sqrt(s) * np.diff(np.concatenate([[0.0], h, [0.0]])), (len(h) - 2) // 2 + 1))
        object.__setattr__(self, "scales", tuple(out))

    @property
    def frequencies(self) -> np.ndarray:
        return np.geomspace(max(1.0, self.low), min(self.high, self.sr / 2 - 1), self.count) if self.sr > 4 else np.geomspace(self.low, min(self.high, self.sr / 2), self.count)

    def groups(self) -> list[list[int]]:
        """Scales whose filters are about as long, within a factor of two."""
        out: dict[int, list[int]] = {}
        for k, s in enumerate(self.scales):
            out.setdefault(int(np.ceil(np.log2(len(s.taps)))), []).append(k)
        return [out[k] for k in sorted(out)]


def convolved(y: np.ndarray, scales: list[Scale], left: int, n: int) -> np.ndarray:
    """Scales x n: the transform at the ``n`` samples that begin ``left`` samples into ``y``. What lies outside ``y`` counts as zero."""
    size = 1 << int(np.ceil(np.log2(len(y) + max(len(s.taps) for s in scales) - 1)))
    spectrum = np.fft.rfft(y, size)
    return np.stack([np.fft.irfft(spectrum * np.fft.rfft(s.taps, size), size)[left + s.ahead : left + s.ahead + n] for s in scales])


def decibels(w: np.ndarray) -> np.ndarray:
    return 20 * np.log10(np.maximum(np.abs(w), 1e-6))


def scalogram_image(y: np.ndarray, bank: Bank) -> np.ndarray:
    """Scales x samples in dB, to mean 0 and sample deviation 1."""
    db = decibels(convolved(y, list(bank.scales), 0, len(y)))
    return (db - db.mean()) / max(db.std(ddof=1), 1e-6)


def mel_triangles(f: np.ndarray, bands: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Bands x bins of triangles evenly spaced on the logarithmic mel scale, each weighted by two over its width; and their centres."""
    mel = np.linspace(*(2595 * np.log10(1 + np.array([max(0.0, low), high]) / 700)), bands + 2)
    edge = 700 * (10 ** (mel / 2595) - 1)
    rise, fall = (f - edge[:-2, None]) / np.diff(edge)[:-1, None], (edge[2:, None] - f) / np.diff(edge)[1:, None]
    return np.clip(np.minimum(rise, fall), 0, None) * (2 / np.maximum(edge[2:] - edge[:-2], 1e-12))[:, None], edge[1:-1]


@dataclass(frozen=True)
class Picture:
    """How the dashboard shows a signal."""

    window: int
    overlap: int
    bands: int
    low: float = 150.0
    high: float = 20_000.0
    top_db: float = 80.0


# The dashboard's pictures of airborne and of structure-borne sound.
PICTURES = {"airborne": Picture(4096, 4000, 128), "structure": Picture(16_384, 12_000, 100)}


def mel_picture(y: np.ndarray, sr: float, p: Picture) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres of the bands, times of the frames, and bands x frames in dB, cut off ``top_db`` below the maximum."""
    length = min(p.window, max(256, len(y)), len(y))
    hop = length - min(p.overlap, max(128, len(y) // 2), length - 1)
    w = np.hanning(length + 1)[:-1]
    f = np.fft.rfftfreq(length, 1 / sr)
    high = min(p.high, sr / 2)
    there = (f >= p.low) & (f <= high)
    if there.sum() < 4:
        raise ValueError("fewer than four bins lie between the frequencies asked for")
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(y, float), length)[::hop]
    power = np.concatenate([np.abs(np.fft.rfft((part := frames[s : s + 256]) * w - part.mean(1, keepdims=True) * w, axis=1)[:, there] / w.sum()) ** 2 for s in range(0, len(frames), 256)])
    triangles, centres = mel_triangles(f[there], max(4, min(p.bands, int(there.sum()) // 2)), p.low, high)
    db = 10 * np.log10(np.maximum(triangles @ power.T, 1e-12))
    return centres, (np.arange(len(frames)) * hop + length / 2) / sr, np.clip(db, db.max() - p.top_db, db.max())
