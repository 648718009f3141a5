"""A Gaussian hidden Markov model on plain arrays. No Spark in here."""

from __future__ import annotations

import dataclasses

import numpy as np


@dataclasses.dataclass
class Model:
    """States in order of their mean second feature; features are scaled by ``centre`` and ``scale`` first."""

    centre: np.ndarray
    scale: np.ndarray
    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    cov: np.ndarray

    def flat(self) -> list[float]:
        return np.concatenate([x.ravel() for x in (self.centre, self.scale, self.start, self.move, self.mean, self.cov)]).tolist()

    @classmethod
    def of(cls, values: list[float], states: int, d: int) -> Model:
        shapes = [(d,), (d,), (states,), (states, states), (states, d), (states, d, d)]
        out, at = [], 0
        for shape in shapes:
            n = int(np.prod(shape))
            out.append(np.array(values[at : at + n]).reshape(shape))
            at += n
        return cls(*out)

    def _likelihood(self, x: np.ndarray) -> np.ndarray:
        like = np.empty((len(x), len(self.start)))
        for k in range(len(self.start)):
            diff = x - self.mean[k]
            like[:, k] = -0.5 * (np.einsum("ij,jk,ik->i", diff, np.linalg.inv(self.cov[k]), diff) + np.linalg.slogdet(self.cov[k])[1])
        return np.exp(like - like.max(axis=1, keepdims=True)) + 1e-12

    def passes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward figures, their scales and the likelihoods, of scaled rows."""
        like = self._likelihood(x)
        n, states = like.shape
        ahead, scale = np.empty((n, states)), np.empty(n)
        now = self.start * like[0]
        for t in range(n):
            if t:
                now = (ahead[t - 1] @ self.move) * like[t]
            scale[t] = now.sum()
            ahead[t] = now / scale[t]
        back = np.ones((n, states))
        for t in range(n - 2, -1, -1):
            back[t] = self.move @ (like[t + 1] * back[t + 1]) / scale[t + 1]
        return ahead, back, scale, like

    def posterior(self, rows: np.ndarray) -> np.ndarray:
        """The probability of each state at each row, given all rows."""
        ahead, back, *_ = self.passes((rows - self.centre) / self.scale)
        out = ahead * back
        return out / out.sum(axis=1, keepdims=True)


def fit_hmm(rows: np.ndarray, states: int = 3, rounds: int = 25) -> Model:
    """Baum-Welch for full-covariance Gaussian states, begun from terciles of the second column."""
    n, d = rows.shape
    centre, scale = rows.mean(axis=0), np.maximum(rows.std(axis=0), 1e-12)
    x = (rows - centre) / scale
    order = np.argsort(np.argsort(x[:, 1 % d], kind="stable"), kind="stable") * states // n
    mean = np.array([x[order == k].mean(axis=0) for k in range(states)])
    cov = np.array([np.cov(x[order == k].T).reshape(d, d) + 1e-6 * np.eye(d) for k in range(states)])
    move = np.full((states, states), 0.1 / (states - 1)) + np.eye(states) * (0.9 - 0.1 / (states - 1))
    m = Model(centre, scale, np.full(states, 1 / states), move, mean, cov)
    for _ in range(rounds):
        ahead, back, unit, like = m.passes(x)
        gamma = ahead * back
        gamma /= gamma.sum(axis=1, keepdims=True)
        pair = (ahead[:-1].T @ (like[1:] * back[1:] / unit[1:, None])) * m.move
        weight = gamma.sum(axis=0) + 1e-9
        m.move, m.start = pair / pair.sum(axis=1, keepdims=True), gamma[0]
        m.mean = (gamma.T @ x) / weight[:, None]
        for k in range(states):
            diff = x - m.mean[k]
            m.cov[k] = (gamma[:, k, None] * diff).T @ diff / weight[k] + 1e-6 * np.eye(d)
    by = np.argsort(m.mean[:, 1 % d])  # the calmest first
    return Model(centre, scale, m.start[by], m.move[np.ix_(by, by)], m.mean[by], m.cov[by])
