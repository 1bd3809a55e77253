"""Batch linear algebra of the history models; one row per snapshot."""

from __future__ import annotations

import numpy as np


def novelty(current: np.ndarray, rows: np.ndarray, model: dict) -> np.ndarray:
    """(N, 9) current and (N, 24, 9) history to (N, 3): robust deviation, PCA residual, reference ratio."""
    mean, std = rows.mean(1), rows.std(1)
    vector = np.concatenate([current, mean, std, current - rows[:, -1], current - mean], 1)
    active = np.asarray(model["active"], int)
    z = (vector[:, active] - np.asarray(model["center"])[active]) / np.asarray(model["scale"])[active]
    centred = np.clip(z, -20, 20) - np.asarray(model["pca_mean"])
    axes = np.asarray(model["pca_axes"]).reshape(-1, len(active))
    residual = centred - (centred @ axes.T) @ axes
    robust, pca = np.abs(z).max(1), (residual ** 2).mean(1)
    return np.stack([robust, pca, np.maximum(robust / model["thresholds"][0], pca / model["thresholds"][1])], 1)


def ridge(rows: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(N, 13, 9) rows to the 36-wide input and the nine-feature forecast."""
    vector = np.concatenate([rows[:, -1], rows.mean(1), rows.std(1), rows[:, -1] - rows[:, 0]], 1)
    scaled = (vector - np.asarray(model["input_mean"])) / np.asarray(model["input_std"])
    return vector, scaled @ np.asarray(model["weights"]) * np.asarray(model["target_std"]) + np.asarray(model["target_mean"])
