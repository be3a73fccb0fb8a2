"""Log mel features of 16 kHz speech, and reading raw samples."""

from __future__ import annotations

import numpy as np

# Fixed values of the feature extractor.
RATE, FFT, WINDOW, HOP, MELS, EMPHASIS = 16_000, 512, 400, 160, 128, 0.97
LOG_FLOOR, STD_FLOOR = 2.0**-24, 1e-5
LONGEST_S = 600


def read_samples(raw: bytes) -> np.ndarray:
    """Little-endian float32 samples, ten minutes at most; ValueError for broken lengths and numbers that are not finite."""
    if len(raw) % 4:
        raise ValueError("audio is no whole number of samples")
    x = np.frombuffer(raw, "<f4")
    if len(x) > LONGEST_S * RATE:
        raise ValueError("audio is longer than ten minutes")
    if not np.isfinite(x).all():
        raise ValueError("audio holds samples that are not finite")
    return x


def hz_to_mel(hz: np.ndarray | float):
    """Linear to 1 kHz, logarithmic above."""
    hz = np.asarray(hz, float)
    return np.where(hz < 1000, hz * 3 / 200, 15 + 27 * np.log(np.maximum(hz, 1e-9) / 1000) / np.log(6.4))


def mel_to_hz(mel: np.ndarray | float):
    mel = np.asarray(mel, float)
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp(np.log(6.4) * (mel - 15) / 27))


def mel_filters(bins: int = FFT // 2 + 1, mels: int = MELS, low: float = 0.0, high: float = RATE / 2) -> np.ndarray:
    """Triangles of equal area on the mel scale, ``mels`` x ``bins``."""
    centres = mel_to_hz(np.linspace(hz_to_mel(low), hz_to_mel(high), mels + 2))
    hz = np.linspace(0, RATE / 2, bins)
    rise = (hz[None] - centres[:-2, None]) / np.diff(centres)[:-1, None]
    fall = (centres[2:, None] - hz[None]) / np.diff(centres)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (centres[2:] - centres[:-2]))[:, None]


def features(samples: np.ndarray) -> np.ndarray:
    """``MELS`` x frames: emphasized, windowed, log mel energies, each bin with mean 0 and deviation 1 over the frames."""
    x = np.asarray(samples, float)
    if not len(x):
        return np.zeros((MELS, 0))
    x = np.concatenate([x[:1], x[1:] - EMPHASIS * x[:-1]])
    padded = np.pad(x, FFT // 2)
    window = np.zeros(FFT)
    side = (FFT - WINDOW) // 2
    window[side : side + WINDOW] = np.hanning(WINDOW)
    frames = np.lib.stride_tricks.sliding_window_view(padded, FFT)[::HOP]
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    mel = np.log(power @ mel_filters().T + LOG_FLOOR).T
    valid = max(1, len(samples) // HOP)
    part = mel[:, :valid]
    deviation = part.std(axis=1, ddof=1, keepdims=True) if valid > 1 else np.zeros((MELS, 1))
    out = (mel - part.mean(axis=1, keepdims=True)) / (deviation + STD_FLOOR)
    out[:, valid:] = 0
    return out


def greedy_decode(logits: np.ndarray, blank: int) -> list[int]:
    """The best token of each frame, repeats and blanks gone."""
    best, out, last = logits.argmax(axis=1), [], -1
    for t in best:
        if t != last and t != blank:
            out.append(int(t))
        last = t
    return out


def join_tokens(tokens: list[str]) -> str:
    """Pieces to text: '▁' opens a word."""
    return "".join(tokens).replace("▁", " ").strip()
