"""Small numpy helpers for filters and spectra; called on chunks or epochs that Spark lays out."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=64)
def butter(order: int, cut: tuple[float, ...], fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Butterworth (b, a): low-pass for one cutoff, band-pass for two (pre-warped bilinear transform)."""
    k = np.arange(order)
    poles = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    warp = 4.0 * np.tan(np.pi * np.asarray(cut) / fs)
    if len(cut) == 1:
        p, z, gain = poles * warp[0], np.array([]), warp[0] ** order
    else:
        bw, w0 = warp[1] - warp[0], np.sqrt(warp[0] * warp[1])
        half = poles * bw / 2
        root = np.sqrt(half ** 2 - w0 ** 2)
        p, z, gain = np.concatenate([half + root, half - root]), np.zeros(order), bw ** order
    zd = np.concatenate([(4 + z) / (4 - z), -np.ones(len(p) - len(z))])
    pd_ = (4 + p) / (4 - p)
    gain = gain * np.real(np.prod(4 - z) / np.prod(4 - p))
    return gain * np.real(np.poly(zd)), np.real(np.poly(pd_))


@lru_cache(maxsize=64)
def impulse(order: int, cut: tuple[float, ...], fs: float, tol: float = 1e-10) -> np.ndarray:
    """Impulse response, cut where the slowest pole has decayed to ``tol``."""
    b, a = butter(order, cut, fs)
    radius = np.max(np.abs(np.roots(a)))
    n = int(np.ceil(np.log(tol) / np.log(radius))) + len(b)
    h = np.zeros(n)
    for i in range(n):
        acc = b[i] if i < len(b) else 0.0
        m = min(i, len(a) - 1)
        if m:
            acc -= np.dot(a[1:m + 1], h[i - 1::-1][:m] if i - m - 1 < 0 else h[i - 1:i - m - 1:-1])
        h[i] = acc
    return h


def convolve(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Causal convolution by FFT, same length as ``x``; an output that a missing input reaches is missing, no other."""
    n = 1 << int(np.ceil(np.log2(len(x) + len(h))))
    gone = np.isnan(x)
    y = np.fft.irfft(np.fft.rfft(np.where(gone, 0.0, x), n) * np.fft.rfft(h, n), n)[: len(x)]
    if gone.any():
        last = np.maximum.accumulate(np.where(gone, np.arange(len(x)), -len(h)))
        y[np.arange(len(x)) - last < len(h)] = np.nan
    return y


def zero_phase(x: np.ndarray, order: int, cut: tuple[float, ...], fs: float, at_start: bool, at_end: bool) -> np.ndarray:
    """Forward-backward Butterworth filtering of a chunk.

    At a recording's ends the signal is extended oddly and held constant before that, which is the usual
    edge treatment; inside, the halo takes the place of the extension.
    """
    h = impulse(order, cut, fs)
    b, a = butter(order, cut, fs)
    pad = min(3 * max(len(a), len(b)), len(x) - 1)
    head = tail = 0
    y = x
    if at_start:
        ext = 2 * x[0] - x[pad:0:-1]
        y = np.concatenate([np.full(len(h), ext[0] if pad else x[0]), ext, y])
        head = len(h) + pad
    if at_end:
        y = np.concatenate([y, 2 * x[-1] - x[-2:-2 - pad:-1]])
        tail = pad
    y = convolve(y, h)
    if at_end:
        y = np.concatenate([y, np.full(len(h), y[-1])])
        tail += len(h)
    y = convolve(y[::-1], h)[::-1]
    return y[head: len(y) - tail]


def zero_phase_between_nulls(x: np.ndarray, order: int, cut: tuple[float, ...], fs: float, at_start: bool, at_end: bool) -> np.ndarray:
    """``zero_phase`` of each stretch without missing values, which ends like a recording where a value is missing, so that
    the result doesn't depend on how the recording was cut into chunks."""
    gone = np.isnan(x)
    if not gone.any():
        return zero_phase(x, order, cut, fs, at_start, at_end)
    y = np.full(len(x), np.nan)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
    for a, b in zip(edge[::2], edge[1::2]):
        y[a:b] = zero_phase(x[a:b], order, cut, fs, at_start or a > 0, at_end or b < len(x))
    return y


def reach(order: int, cut: tuple[float, ...], fs: float) -> int:
    return len(impulse(order, cut, fs))


def fir_lowpass(n_taps: int, cutoff: float) -> np.ndarray:
    """Hamming-windowed sinc, cutoff as a fraction of Nyquist, unit gain at zero frequency."""
    m = np.arange(n_taps) - (n_taps - 1) / 2
    h = cutoff * np.sinc(cutoff * m) * np.hamming(n_taps)
    return h / h.sum()


def fir_highpass(n_taps: int, cutoff: float) -> np.ndarray:
    """Hamming-windowed high-pass with unit gain at Nyquist; the tap count is made odd."""
    n_taps += 1 - n_taps % 2
    m = np.arange(n_taps) - (n_taps - 1) / 2
    h = (np.sinc(m) - cutoff * np.sinc(cutoff * m)) * np.hamming(n_taps)
    return h / np.sum(h * np.cos(np.pi * m))


def fir_centred(x: np.ndarray, h: np.ndarray, centre: int) -> np.ndarray:
    """``y[i] = sum_k h[k] x[i + centre - k]`` with zeros outside."""
    full = np.concatenate([x, np.zeros(centre)])
    return convolve(full, h)[centre: centre + len(x)]


# --- epochs: arrays of shape (epochs, samples) -----------------------------------------------------------

def welch(x: np.ndarray, fs: float, nper: int) -> tuple[np.ndarray, np.ndarray]:
    """Median-averaged one-sided power density with Hann windows, half overlap and mean removal."""
    nper = min(nper, x.shape[1])
    step = nper - nper // 2
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nper) / nper)
    starts = range(0, x.shape[1] - nper + 1, step)
    seg = np.stack([x[:, s:s + nper] for s in starts], axis=1)
    seg = (seg - seg.mean(axis=2, keepdims=True)) * win
    p = np.abs(np.fft.rfft(seg, axis=2)) ** 2 / (fs * np.sum(win ** 2))
    p[:, :, 1:(-1 if nper % 2 == 0 else None)] *= 2
    k = seg.shape[1]
    odd = np.arange(1, (k - 1) // 2 + 1)
    bias = 1 + np.sum(1 / (2 * odd + 1) - 1 / (2 * odd))
    return np.fft.rfftfreq(nper, 1 / fs), np.median(p, axis=1) / bias


def simpson(y: np.ndarray, dx: float) -> np.ndarray:
    """Simpson's rule along the last axis; an odd interval left over is integrated by its parabola."""
    n = y.shape[-1]
    if n < 2:
        return np.zeros(y.shape[:-1])
    if n == 2:
        return dx * (y[..., 0] + y[..., 1]) / 2
    m = n if n % 2 else n - 1
    total = dx / 3 * (y[..., 0] + y[..., m - 1] + 4 * y[..., 1:m - 1:2].sum(-1) + 2 * y[..., 2:m - 2:2].sum(-1))
    if m < n:
        total = total + dx * (5 * y[..., -1] + 8 * y[..., -2] - y[..., -3]) / 12
    return total


def band_power(freqs: np.ndarray, psd: np.ndarray, lo: float, hi: float) -> np.ndarray:
    keep = (freqs >= lo) & (freqs <= hi)
    return simpson(psd[:, keep], freqs[1] - freqs[0])


def hjorth(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mobility and complexity from the variances of a signal and its first two differences."""
    d1, d2 = np.diff(x, axis=1), np.diff(x, n=2, axis=1)
    v0, v1, v2 = x.var(1), d1.var(1), d2.var(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        mob = np.sqrt(v1 / v0)
        return mob, np.sqrt(v2 / v1) / mob


def zero_crossings(x: np.ndarray) -> np.ndarray:
    return np.sum(np.signbit(x[:, 1:]) != np.signbit(x[:, :-1]), axis=1)


def permutation_entropy(x: np.ndarray, order: int = 3) -> np.ndarray:
    """Normalised entropy of ordinal patterns."""
    idx = np.arange(order)[None, :] + np.arange(x.shape[1] - order + 1)[:, None]
    ranks = np.argsort(x[:, idx], axis=2, kind="stable")
    code = (ranks * order ** np.arange(order)).sum(2)
    fact = int(np.prod(np.arange(1, order + 1)))
    out = np.empty(len(x))
    for i, row in enumerate(code):
        p = np.unique(row, return_counts=True)[1] / len(row)
        out[i] = -(p * np.log2(p)).sum() / np.log2(fact)
    return out


def petrosian(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    nd = zero_crossings(np.diff(x, axis=1))
    return np.log10(n) / (np.log10(n) + np.log10(n / (n + 0.4 * nd)))


def higuchi(x: np.ndarray, kmax: int = 10) -> np.ndarray:
    """Higuchi fractal dimension: slope of log curve length against log(1/k)."""
    n = x.shape[1]
    ks = [k for k in range(1, kmax + 1) if n > k]
    lengths = []
    for k in ks:
        per = []
        for m in range(k):
            pts = x[:, m::k]
            cnt = pts.shape[1] - 1
            if cnt > 0:
                per.append(np.abs(np.diff(pts, axis=1)).sum(1) * (n - 1) / (cnt * k) / k)
        lengths.append(np.mean(per, axis=0))
    lx = np.log(1.0 / np.array(ks))
    with np.errstate(divide="ignore"):
        ly = np.log(np.array(lengths)).T
    lx = lx - lx.mean()
    return (ly - ly.mean(1, keepdims=True)) @ lx / (lx @ lx)


# Centre frequency of the complex Morlet wavelet (bandwidth 1.5, centre 1.0) in cycles per unit scale.
MORLET_BANDWIDTH = 1.5
MORLET_CENTRE = 1.0


def morlet_power(x: np.ndarray, scale: float) -> np.ndarray:
    """Squared modulus of the complex Morlet transform at one scale (in samples), zeros outside."""
    half = int(np.ceil(8 * scale * np.sqrt(MORLET_BANDWIDTH / 2)))
    t = np.arange(-half, half + 1) / scale
    psi = np.exp(-t ** 2 / MORLET_BANDWIDTH) * np.exp(2j * np.pi * MORLET_CENTRE * t) / np.sqrt(np.pi * MORLET_BANDWIDTH) / np.sqrt(scale)
    n = 1 << int(np.ceil(np.log2(len(x) + len(psi))))
    w = np.fft.ifft(np.fft.fft(x, n) * np.fft.fft(psi, n))[half: half + len(x)]
    return np.abs(w) ** 2


def morlet_reach(scale: float) -> int:
    return int(np.ceil(8 * scale * np.sqrt(MORLET_BANDWIDTH / 2)))


# Chebyshev nodes of a cell one time constant wide: interpolation between them holds a Gaussian to about 1e-14.
NODES = np.cos(np.pi * (2 * np.arange(14) + 1) / 28)
_BARY = np.sin(np.pi * (2 * np.arange(14) + 1) / 28) * (-1.0) ** np.arange(14)


def _basis(u: np.ndarray) -> np.ndarray:
    """Lagrange polynomials of the nodes at places ``u`` in [-1, 1], a row per place."""
    apart = u[:, None] - NODES
    hit = apart == 0
    w = _BARY / np.where(hit, 1.0, apart)
    out = w / w.sum(1, keepdims=True)
    return np.where(hit.any(1)[:, None], hit.astype(float), out)


def gauss_sums(t: np.ndarray, weights: np.ndarray, reach: float) -> np.ndarray:
    """``sum_j weights[m, j] exp(-(t[j] - t[i])^2 / 2)`` for every m and i, over at least ``reach`` either way; ``t`` ascends.

    Cells of width 1 gather their weights on nodes, cells within reach exchange node values, and rows read theirs off the nodes: linear in the rows
    however dense they are. The error is about 1e-14 of the weights within reach.
    """
    m, n = weights.shape
    if not n:
        return np.zeros((m, 0))
    cell = np.floor(t)
    cells, first, of = np.unique(cell, return_index=True, return_inverse=True)
    basis = _basis(2 * (t - cell) - 1)
    held = np.stack([np.add.reduceat(basis * w[:, None], first, axis=0) for w in weights])
    nodes = np.zeros_like(held)
    far = int(np.ceil(reach)) + 1
    for d in range(-far, far + 1):
        at = np.minimum(np.searchsorted(cells, cells + d), len(cells) - 1)
        ok = cells[at] == cells + d
        kernel = np.exp(-0.5 * (d + (NODES[None, :] - NODES[:, None]) / 2) ** 2)  # target node, source node
        nodes[:, ok] += held[:, at[ok]] @ kernel.T
    return np.stack([(basis * v[of]).sum(1) for v in nodes])
