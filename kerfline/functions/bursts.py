"""Finding bursts in one recording: band envelope, drifting baseline, two-threshold detection with a search for the threshold that gives
the count expected, and edges. Intervals are arrays of frame pairs, both ends inside."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from kerfline.functions import dsp

Spans = np.ndarray  # n x 2


def band_envelope(x: np.ndarray, sr: float, low: float, high: float, win_ms: float = 21.0, hop_ms: float = 5.0, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Times of frame centres and the power within ``low..high`` in dB; a recording shorter than a frame has none. ``first`` is the number of the first sample."""
    length = max(256, int(sr * win_ms / 1000))
    hop = max(1, int(sr * hop_ms / 1000))
    if len(x) < length:
        return np.zeros(0), np.zeros(0)
    w = np.hanning(length + 1)[:-1]
    f = np.fft.rfftfreq(length, 1 / sr)
    band = (f >= low) & (f <= high)
    fr = dsp.frames(np.asarray(x, float)[None], length, hop)[0]
    power = np.concatenate([(np.abs(np.fft.rfft(fr[s : s + 512] * w, axis=1)[:, band]) ** 2).sum(1) for s in range(0, len(fr), 512)]) / w.sum() ** 2
    return (first + np.arange(len(fr)) * hop + length / 2) / sr, 10 * np.log10(power + 1e-18)


def running_median(x: np.ndarray, width: int) -> np.ndarray:
    width += 1 - width % 2
    return x if width <= 1 else np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, width // 2, mode="edge"), width), axis=1)


def quantiles(rows: np.ndarray, q: float) -> np.ndarray:
    """``np.nanquantile`` of each row, for all rows at once; that goes through them one by one."""
    v, n = np.sort(rows, axis=1), (~np.isnan(rows)).sum(1)
    at = q * (n - 1)
    low = np.maximum(np.floor(at).astype(int), 0)
    a, b = (np.take_along_axis(v, k[:, None], 1)[:, 0] for k in (low, np.minimum(low + 1, np.maximum(n - 1, 0))))
    part, step = at - low, b - a
    return np.where(n == 0, np.nan, np.where(part >= 0.5, b - step * (1 - part), a + step * part))


def running_quantile(x: np.ndarray, q: float, width: int) -> np.ndarray:
    """Centred; frames with too few samples, which lie at the ends only, take the nearest value."""
    back, ahead = width // 2, (width - 1) // 2
    wide = np.concatenate([np.full(back, np.nan), x, np.full(ahead, np.nan)])
    seen = np.lib.stride_tricks.sliding_window_view(wide, width)
    out = np.concatenate([quantiles(seen[s : s + 1024], q) for s in range(0, len(x), 1024)])
    enough = np.flatnonzero((~np.isnan(seen)).sum(1) >= max(3, width // 5))
    return np.interp(np.arange(len(x)), enough, out[enough]) if len(enough) else np.full(len(x), np.nanquantile(x, q))


def baseline(x: np.ndarray, width: int) -> np.ndarray:
    """Follows falls four times as fast as rises, so that a long burst does not lift it."""
    out, level = np.empty(len(x)), x[0]
    up, down = 1 / (4 * width), 1 / width
    for i, v in enumerate(x.tolist()):
        level += (up if v > level else down) * (v - level)
        out[i] = level
    return out


def _after(marks: np.ndarray, at: int) -> int | None:
    k = np.searchsorted(marks, at)
    return int(marks[k]) if k < len(marks) else None


def hysteresis(d: np.ndarray, on: float, off: float, on_frames: int, off_frames: int) -> Spans:
    """As ``operators.segmentation.hysteresis``, on one array: switches are ends of runs, taken in turn."""

    def ends(ok: np.ndarray, n: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(ok)])
        return np.flatnonzero(total[n:] - total[:-n] == n) + n - 1 if len(ok) >= n else np.zeros(0, int)

    up, down, out, at = ends(d > on, on_frames), ends(d < off, off_frames), [], 0
    while (start := _after(up, at)) is not None:
        stop = _after(down, start + off_frames)
        last = len(d) - 1 if stop is None else stop - off_frames
        if last >= start - on_frames + 1:
            out.append((start - on_frames + 1, last))
        if stop is None:
            break
        at = stop + on_frames
    return np.array(out, int).reshape(-1, 2)


def peaks(d: np.ndarray) -> np.ndarray:
    """Middles of the level tops that are higher than what is on either side."""
    first = np.flatnonzero(np.concatenate([[True], np.diff(d) != 0]))
    last = np.append(first[1:] - 1, len(d) - 1)
    v = d[first]
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    return (first[top] + last[top]) // 2


def halved(d: np.ndarray, span: tuple[int, int], floor: float, apart: int) -> list[tuple[int, int]]:
    """A span in two at the deepest point between its two highest peaks, if these lie ``apart`` and that point below ``floor``."""
    a, b = int(span[0]), int(span[1])
    top = peaks(d[a : b + 1]) if b - a >= 10 else np.zeros(0, int)
    if len(top):
        height = d[a + top]
        one = top[len(top) - 1 - int(height[::-1].argmax())]
        far = top[np.abs(top - one) >= apart]
        if len(far):
            height = d[a + far]
            two = far[len(far) - 1 - int(height[::-1].argmax())]
            left, right = sorted((int(one), int(two)))
            low = left + int(d[a + left : a + right + 1].argmin())
            parts = [(a, a + low), (min(b, a + low + 1), b)]
            if d[a + low] < floor and all(q - p >= 3 for p, q in parts):
                return parts
    return [(a, b)]


def joined(spans: Spans, t: np.ndarray, gap: float) -> Spans:
    """Spans in order, those at most ``gap`` seconds after the reach of the ones before put together."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], t[spans[1:, 0]] - t[reach[:-1]] > gap])
    return np.stack([spans[new, 0], np.maximum.reduceat(spans[:, 1], np.flatnonzero(new))], 1)


def to_count(spans: Spans, d: np.ndarray, t: np.ndarray, n: int) -> Spans:
    """Towards ``n`` spans: of too many the least (by duration and a little by height) go, of too few some are halved, round by round.

    In a round spans are taken by length, the longest first. One that can be halved is, as long as its place plus the number of those halved before it is at most what is missing; places count from 0."""
    size = lambda s: t[s[:, 1]] - t[s[:, 0]]
    if len(spans) > n:
        height = np.array([d[a : b + 1].max() for a, b in spans])
        return spans[np.sort(np.argsort(size(spans) + 0.15 * (height - np.median(height)))[len(spans) - n :])]
    if len(spans) in (0, n):
        return spans
    typical = float(np.median(size(spans))) or 0.5
    apart = max(1, round(max(0.10, 0.25 * max(typical, 0.0)) / float(np.median(np.diff(t)))))
    floor, moved = float(np.percentile(d, 35)), True
    while moved and len(spans) < n:
        cuts = [halved(d, s, floor, apart) for s in spans[np.argsort(-size(spans), kind="stable")]]
        able = np.flatnonzero([len(c) == 2 for c in cuts])
        chosen = set(able[able + np.arange(len(able)) <= n - len(spans)].tolist())
        whole = [(c[0][0], c[-1][1]) for c in cuts]
        spans, moved = np.array(sorted(p for k, c in enumerate(cuts) for p in (c if k in chosen else whole[k : k + 1])), int), bool(chosen)
    return spans


@dataclass
class Found:
    times: np.ndarray
    smooth: np.ndarray
    base: np.ndarray
    spans: Spans
    on: float
    off: float

    def seconds(self) -> np.ndarray:
        return self.times[self.spans] if len(self.spans) else np.zeros((0, 2))


def detect(t: np.ndarray, db: np.ndarray, count: int) -> Found:
    """Bursts of an envelope, at the threshold whose number of bursts is nearest to ``count``; thresholds are tried by bisection."""
    if len(t) < 2:
        return Found(t, db, db, np.zeros((0, 2), int), 0.0, 0.0)
    whole = float(t[-1])
    typical = whole / count if count else 0.5
    dt = float(np.median(np.diff(t)))
    frames = lambda s, least=1: max(least, round(s / dt))
    smooth = running_median(db, frames(max(0.03, 0.08 * typical)))
    width = frames(max(0.5, 0.8 * typical), 5)
    base = baseline(running_quantile(smooth, 0.10, width), width)
    d = smooth - base
    edge = min(0.25, 0.05 * whole)
    inner = d[(t >= edge) & (t <= whole - edge)]
    inner = inner if len(inner) >= 10 else d
    q = np.percentile(inner, [2, 25, 75, 99.7])
    gap = max(0.8, 0.20 * (q[2] - q[1] + 1e-6))
    lo, hi, best = q[0], q[3], None
    for _ in range(32):
        on = (lo + hi) / 2
        spans = hysteresis(d, on, on - gap, frames(max(0.03, 0.08 * typical)), frames(max(0.03, 0.08 * typical)))
        apart = frames(max(0.08, 0.20 * typical))
        spans = np.array([p for s in spans for p in halved(d, s, on - gap, apart)], int).reshape(-1, 2)
        spans = joined(spans, t, max(0.02, 0.05 * typical))
        spans = spans[t[spans[:, 1]] - t[spans[:, 0]] >= max(0.08, 0.10 * typical)] if len(spans) else spans
        spans = to_count(spans, d, t, count) if len(spans) < count else spans
        if best is None or abs(len(spans) - count) < abs(len(best[0]) - count):
            best = (spans, on, on - gap)
        if len(spans) == count:
            break
        lo, hi = (on, hi) if len(spans) > count else (lo, on)
    return Found(t, smooth, base, *best)


def edges(found: Found, spans: np.ndarray, back: float = 3.0, ahead: float = 0.25, near: float = 0.08) -> np.ndarray:
    """Starts moved back and stops moved on while the envelope stays above a relaxed threshold, starts to the lowest point next to them; no span reaches into the one before."""
    t, n = found.times, len(found.times)
    dt = float(np.median(np.diff(t))) if n > 1 else 1.0
    quiet_before = np.flatnonzero(found.smooth <= found.base + max(0.2, found.on * 0.5))
    quiet_after = np.flatnonzero(found.smooth <= found.base + max(0.2, found.off))
    reach, snap, out, before = round(back / dt), round(near / dt), [], 0
    for a, b in np.clip(np.searchsorted(t, spans), 0, n - 1):
        k = np.searchsorted(quiet_before, a, "right") - 1
        start = max(before, a - reach, quiet_before[k] if k >= 0 else 0) if a > max(before, a - reach) else a
        low, high = max(before, start - snap), min(a, start + snap)
        start = low + int(found.smooth[low:high].argmin()) if high > low else start
        k = np.searchsorted(quiet_after, b)
        stop = max(b, min(n - 1, b + round(ahead / dt), quiet_after[k] if k < len(quiet_after) else n - 1))
        out.append((t[min(start, stop - 1)], t[stop]))
        before = stop
    return np.array(out).reshape(-1, 2)
