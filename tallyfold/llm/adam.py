"""One optimiser for the models of this folder."""

from __future__ import annotations

import numpy as np


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float) -> None:
        self.weights, self.rate, self.step = weights, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def move(self, gradients: dict[str, np.ndarray]) -> None:
        self.step += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in gradients.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in gradients.items():
            g = g * scale
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.01 * (g * g - self.square[k])
            self.weights[k] -= self.rate * (self.mean[k] / (1 - 0.9**self.step)) / (np.sqrt(self.square[k] / (1 - 0.99**self.step)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)
