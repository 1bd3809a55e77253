"""Batch waveform kernels: every function takes N windows at once and returns one row per window.

They run inside Arrow batches of Spark tasks; nothing here knows about Spark.
"""

from __future__ import annotations

import numpy as np

# four power bands and eight relative bands of the 800 Hz profile, lower bound inclusive (fixed values, Hz)
POWER_BANDS = ((0, 50), (50, 100), (100, 200), (200, 350))
RATIO_BANDS = ((0, 25), (25, 50), (50, 75), (75, 100), (100, 150), (150, 200), (200, 275), (275, 350))
SUPPORT_HZ = 350.0


def hann(n: int) -> np.ndarray:
    """Periodic Hann taper."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def one_sided(x: np.ndarray, rate: float, taper: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Squared spectrum magnitudes along the last axis and their frequencies."""
    y = x if taper is None else x * taper
    return np.fft.rfftfreq(x.shape[-1], 1 / rate), np.abs(np.fft.rfft(y, axis=-1)) ** 2


def peak_hz(x: np.ndarray, rate: float) -> np.ndarray:
    """Frequency of the first largest bin, DC left out."""
    freq, power = one_sided(x, rate)
    return freq[1:][np.argmax(power[..., 1:], axis=-1)] if power.shape[-1] > 1 else np.zeros(x.shape[:-1])


def frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """(N, frames, size) view; a signal shorter than a frame is one frame."""
    if x.shape[-1] < size:
        return x[:, None, :]
    return np.lib.stride_tricks.sliding_window_view(x, size, axis=-1)[:, ::hop]


def frame_stats(x: np.ndarray, size: int, hop: int) -> dict[str, np.ndarray]:
    """Mean and deviation of frame RMS and excess kurtosis, mean zero-crossing rate."""
    f = frames(x, size, hop)
    rms = np.sqrt((f ** 2).mean(-1))
    crossings = np.abs(np.diff(np.sign(f), axis=-1)).mean(-1) / 2
    dev = f - f.mean(-1, keepdims=True)
    var = (dev ** 2).mean(-1)
    flat = np.sqrt(var) <= 1e-12
    kurt = np.where(flat, 0.0, (dev ** 4).mean(-1) / np.where(flat, 1.0, var) ** 2 - 3.0)
    return {"rms_mean": rms.mean(-1), "rms_std": rms.std(-1), "zcr_mean": crossings.mean(-1),
            "kurtosis_mean": kurt.mean(-1), "kurtosis_std": kurt.std(-1)}


def band_energy(x: np.ndarray, rate: float, edges: tuple) -> dict[str, np.ndarray]:
    freq, power = one_sided(x, rate)
    total = power.sum(-1) + 1e-12
    return {f"band_{lo}_{hi}Hz": power[:, (freq >= lo) & (freq < hi)].sum(-1) / total for lo, hi in zip(edges, edges[1:])}


def spectral_shape(x: np.ndarray, rate: float, share: float = 0.85) -> dict[str, np.ndarray]:
    """Power centroid, bandwidth and the frequency below which ``share`` of the power lies."""
    freq, power = one_sided(x, rate)
    total = power.sum(-1, keepdims=True) + 1e-12
    centre = (freq * power).sum(-1, keepdims=True) / total
    width = np.sqrt(((freq - centre) ** 2 * power).sum(-1) / total[:, 0])
    reached = np.cumsum(power, -1) >= share * total
    at = np.where(reached.any(-1), reached.argmax(-1), len(freq) - 1)
    return {"spectral_centroid": centre[:, 0], "spectral_bandwidth": width, "spectral_rolloff": freq[at]}


def mel_bank(rate: float, n_fft: int, n_mels: int) -> np.ndarray:
    """Area-normalised triangular filters, linear below 1 kHz and logarithmic above (Slaney scale)."""
    step, knee, log_step = 200.0 / 3, 1000.0, np.log(6.4) / 27
    to_mel = lambda f: np.where(f < knee, f / step, knee / step + np.log(np.maximum(f, 1e-9) / knee) / log_step)
    to_hz = lambda m: np.where(m < knee / step, m * step, knee * np.exp(log_step * (m - knee / step)))
    edge = to_hz(np.linspace(to_mel(np.float64(0)), to_mel(np.float64(rate / 2)), n_mels + 2))
    freq = np.fft.rfftfreq(n_fft, 1 / rate)
    rise = (freq - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None]
    fall = (edge[2:, None] - freq) / (edge[2:] - edge[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edge[2:] - edge[:-2]))[:, None]


def mfcc_mean(x: np.ndarray, rate: float, n: int, size: int, hop: int, n_mels: int = 128) -> np.ndarray:
    """Frame-averaged cepstral coefficients: centred frames, dB with an 80 dB floor, orthonormal DCT-II."""
    padded = np.pad(x, ((0, 0), (size // 2, size // 2)))
    _, power = one_sided(frames(padded, size, hop), rate, hann(size))
    db = 10 * np.log10(np.maximum(power @ mel_bank(rate, size, n_mels).T, 1e-10))
    db = np.maximum(db, db.max(axis=(1, 2), keepdims=True) - 80.0)
    k, m = np.arange(n)[:, None], np.arange(n_mels)[None, :]
    basis = np.cos(np.pi * k * (2 * m + 1) / (2 * n_mels)) * np.sqrt(2 / n_mels)
    basis[0] /= np.sqrt(2)
    return (db @ basis.T).mean(1)


def features26(x: np.ndarray, rate: float, size: int, hop: int, n_mfcc: int, edges: tuple, n_mels: int = 128) -> dict[str, np.ndarray]:
    out = {**frame_stats(x, size, hop), **spectral_shape(x, rate), **band_energy(x, rate, edges)}
    if n_mfcc:
        c = mfcc_mean(x, rate, n_mfcc, size, hop, n_mels)
        out.update({f"mfcc_{i + 1}": c[:, i] for i in range(n_mfcc)})
    return out


def vibration_summary(x: np.ndarray, rate: float) -> np.ndarray:
    """RMS, deviation, Pearson kurtosis, peak, crest (8 decimals) and peak frequency (4 decimals)."""
    c = x - x.mean(-1, keepdims=True)
    rms, std, peak = np.sqrt((c ** 2).mean(-1)), c.std(-1), np.abs(c).max(-1)
    kurt = (c ** 4).mean(-1) / (std ** 4 + 1e-12)
    five = np.round(np.stack([rms, std, kurt, peak, peak / (rms + 1e-12)], -1), 8)
    return np.concatenate([five, np.round(peak_hz(c, rate), 4)[:, None]], -1)


def _xyz_problem(w: np.ndarray) -> np.ndarray:
    """First reason each (N, 3, n) window cannot be used, '' when it can."""
    bad = np.full(len(w), "", dtype=object)
    dev = w - w.mean(-1, keepdims=True)
    with np.errstate(invalid="ignore"):
        bad[((dev ** 2).mean(-1) <= 1e-16).any(-1)] = "constant_or_near_constant_axis"
        bad[(np.abs(w) >= 16).any((1, 2))] = "outside_adxl16g_range"
    bad[~np.isfinite(w).all((1, 2))] = "nonfinite_samples"
    return bad


def base21(w: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Per axis: RMS, peak, Pearson kurtosis and four Hann band powers of (N, 3, n) windows in g."""
    problem = _xyz_problem(w)
    dev = w - w.mean(-1, keepdims=True)
    var = (dev ** 2).mean(-1)
    taper = hann(w.shape[-1])
    freq, power = one_sided(dev, rate, taper)
    power = power / (w.shape[-1] * (taper ** 2).sum())
    power[..., 1:-1] *= 2
    power[..., 0] = 0
    with np.errstate(invalid="ignore", divide="ignore"):
        parts = [np.sqrt(var), np.abs(dev).max(-1), (dev ** 4).mean(-1) / var ** 2]
    parts += [power[..., (freq >= lo) & (freq < hi)].sum(-1) for lo, hi in POWER_BANDS]
    return np.stack(parts, -1).reshape(len(w), -1), problem


def spectral66(w: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """base21, then per axis band ratios, entropy, centroid, bandwidth, peak, its share, roll-off; then axis correlations."""
    base, problem = base21(w, rate)
    dev = w - w.mean(-1, keepdims=True)
    freq, power = one_sided(dev, rate, hann(w.shape[-1]))
    keep = (freq > 0) & (freq < SUPPORT_HZ)
    freq, power = freq[keep], power[..., keep]
    total = power.sum(-1, keepdims=True)
    weak = (total[..., 0] <= 1e-16).any(-1) & (problem == "")
    problem[weak] = "insufficient_spectral_energy"
    with np.errstate(invalid="ignore", divide="ignore"):
        p = power / total
        logs = np.where(p > 0, p * np.log(np.where(p > 0, p, 1.0)), 0.0)
    centre = p @ freq
    spread = np.sqrt((p * (freq - centre[..., None]) ** 2).sum(-1))
    top = p.argmax(-1)
    reached = np.cumsum(p, -1) >= 0.85
    roll = np.where(reached.any(-1), reached.argmax(-1), len(freq) - 1)
    shape = [p[..., (freq >= lo) & (freq < hi)].sum(-1) for lo, hi in RATIO_BANDS]
    shape += [-logs.sum(-1) / np.log(len(freq)), centre, spread, freq[top], p.max(-1), freq[roll]]
    norm = np.sqrt((dev ** 2).sum(-1))
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = [np.clip((dev[:, a] * dev[:, b]).sum(-1) / (norm[:, a] * norm[:, b]), -1, 1) for a, b in ((0, 1), (0, 2), (1, 2))]
    return np.concatenate([base, np.stack(shape, -1).reshape(len(w), -1), np.stack(corr, -1)], -1), problem


def edge_statistics(x: np.ndarray, block: int) -> np.ndarray:
    """Uncentred RMS, absolute peak, Pearson kurtosis (NaN when constant) and three block-averaged band energies."""
    dev = x - x.mean(-1, keepdims=True)
    var = (dev ** 2).mean(-1)
    with np.errstate(invalid="ignore", divide="ignore"):
        kurt = np.where(var > 0, (dev ** 4).mean(-1) / var ** 2, np.nan)
    parts = x.reshape(len(x), -1, block)
    parts = parts - parts.mean(-1, keepdims=True)
    power = np.abs(np.fft.rfft(parts, axis=-1)) ** 2 / block ** 2
    power[..., 1:-1] *= 2
    k = np.arange(power.shape[-1])
    low, mid = (k >= 1) & (k < block // 16), (k >= block // 16) & (k < block // 8)
    bands = [power[..., m].sum(-1).mean(-1) for m in (low & (k > 0), mid & (k > 0), k >= max(1, block // 8))]
    return np.stack([np.sqrt((x ** 2).mean(-1)), np.abs(x).max(-1), kurt, *bands], -1)


def lowpass(taps: int = 1025, cutoff: float = 350.0, rate: float = 12800.0, beta: float = 8.6) -> np.ndarray:
    """Kaiser-windowed sinc with unit gain at DC."""
    n = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(2 * cutoff / rate * n) * np.kaiser(taps, beta)
    return h / h.sum()


def dense_forward(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Fully connected stack, ReLU between layers, in single precision."""
    for i, (w, b) in enumerate(layers):
        x = x @ np.asarray(w, np.float32).T + np.asarray(b, np.float32)
        if i < len(layers) - 1:
            x = np.maximum(x, 0)
    return x


def lstm(x: np.ndarray, w_in: np.ndarray, w_rec: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Hidden states (N, T, H) of one LSTM layer; gate order input, forget, cell, output."""
    h = np.zeros((len(x), w_rec.shape[1]), np.float32)
    c, out = h.copy(), []
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for t in range(x.shape[1]):
        i, f, g, o = np.split(x[:, t] @ w_in.T + h @ w_rec.T + bias, 4, axis=-1)
        c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
        h = sigmoid(o) * np.tanh(c)
        out.append(h)
    return np.stack(out, 1)
