"""A linear-chain conditional random field over short sequences, trained and decoded with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


#: Clauses, padding included, that are decoded together.
_CELLS = 100_000


@dataclass(frozen=True)
class Field:
    """weights: features x labels. moves: label x next label. first: label of the first clause."""

    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray


def _sum_log(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _placed(lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rows of all sequences one behind the other, as sequences x longest x columns with zeros behind the ends."""
    longest = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), longest, values.shape[1]))
    out[np.arange(longest)[None, :] < lengths[:, None]] = values
    return out


def fit(sequences: list[np.ndarray], labels: list[np.ndarray], n_labels: int, steps: int = 150, rate: float = 0.1, penalty: float = 1e-3) -> Field:
    """Maximum likelihood with a small squared penalty, by Adam on the whole sample."""
    lengths = np.array([len(s) for s in sequences])
    x, n, longest = np.concatenate(sequences).astype(np.float32), len(sequences), int(lengths.max())
    here = np.arange(longest)[None, :] < lengths[:, None]
    hot = _placed(lengths, np.eye(n_labels)[np.concatenate(labels)])
    pairs = (hot[:, :-1, :, None] * hot[:, 1:, None, :]).sum(axis=(0, 1))
    parts = [np.zeros((x.shape[1], n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)]
    mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, steps + 1):
        weights, moves, first = parts
        scores = _placed(lengths, x @ weights.astype(np.float32))
        forward = np.zeros((n, longest, n_labels))
        backward = np.zeros((n, longest, n_labels))
        forward[:, 0] = scores[:, 0] + first
        for t in range(1, longest):
            new = _sum_log(forward[:, t - 1, :, None] + moves, 1) + scores[:, t]
            forward[:, t] = np.where(here[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _sum_log(moves + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(here[:, t + 1, None], new, 0)
        total = _sum_log(forward[:, -1], 1)
        chance = np.exp(forward + backward - total[:, None, None]) * here[:, :, None]
        moved = np.exp(forward[:, :-1, :, None] + moves + (scores + backward)[:, 1:, None, :] - total[:, None, None, None]) * here[:, 1:, None, None]
        slopes = [
            x.T @ (hot - chance)[here].astype(np.float32) / n - penalty * weights,
            (pairs - moved.sum(axis=(0, 1))) / n - penalty * moves,
            (hot[:, 0] - chance[:, 0]).sum(axis=0) / n - penalty * first,
        ]
        for k, slope in enumerate(slopes):
            mean[k] = 0.9 * mean[k] + 0.1 * slope
            square[k] = 0.99 * square[k] + 0.01 * slope**2
            parts[k] = parts[k] + rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return Field(*parts)


def decode(field: Field, scored: list[np.ndarray]) -> list[np.ndarray]:
    """The most probable labels of each sequence of scores (clauses x labels); those of like length are decoded together, about _CELLS clauses at a time."""
    out: list[np.ndarray] = [np.empty(0, dtype=int)] * len(scored)
    order = sorted((k for k in range(len(scored)) if len(scored[k])), key=lambda k: len(scored[k]))
    while order:
        n = next((n for n in range(1, len(order)) if (n + 1) * len(scored[order[n]]) > _CELLS), len(order))
        some, order = order[:n], order[n:]
        lengths = np.array([len(scored[k]) for k in some])
        scores = _placed(lengths, np.concatenate([scored[k] for k in some]))
        best = scores[:, 0] + field.first
        came = np.zeros((len(some), scores.shape[1], len(field.first)), dtype=int)
        for t in range(1, scores.shape[1]):
            ways = best[:, :, None] + field.moves
            came[:, t] = ways.argmax(axis=1)
            best = np.where((t < lengths)[:, None], ways.max(axis=1) + scores[:, t], best)
        for row, k in enumerate(some):
            label = int(best[row].argmax())
            labels = [label]
            for t in range(lengths[row] - 1, 0, -1):
                label = int(came[row, t, label])
                labels.append(label)
            out[k] = np.array(labels[::-1])
    return out
