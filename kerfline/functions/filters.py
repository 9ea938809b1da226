"""Recursive filters as linear systems: a stretch is filtered by matrix products, from a state to a state."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def chebyshev(order: int, ripple_db: float, cut: float) -> np.ndarray:
    """Low-pass second-order sections ``b0 b1 b2 1 a1 a2`` of a Chebyshev filter of the first kind; ``cut`` is a share of half the rate."""
    if order % 2 or not 0 < cut < 1:
        raise ValueError("an even order and a cut between 0 and 1 are needed")
    eps = np.sqrt(10 ** (ripple_db / 10) - 1)
    mu = np.arcsinh(1 / eps) / order
    theta = np.pi * np.arange(1, order, 2) / (2 * order)  # one pole of each pair
    pole = -np.sinh(mu + 1j * theta)
    warped = 4 * np.tan(np.pi * cut / 2)
    gain = np.prod(np.abs(pole) ** 2) / np.sqrt(1 + eps**2) * warped**order
    pole = pole * warped
    gain = gain / np.prod(np.abs(4 - pole) ** 2)
    digital = (4 + pole) / (4 - pole)
    one = gain ** (2 / order)
    return np.array([(one, 2 * one, one, 1, -2 * z.real, abs(z) ** 2) for z in digital])


@dataclass(frozen=True)
class System:
    """``z' = a z + b u``, ``y = c z + d u``; ``block`` samples at a time by products with precomputed matrices."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float
    block: int = 64

    @staticmethod
    def of(sections: np.ndarray) -> System:
        """A cascade of second-order sections."""
        a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
        for b0, b1, b2, _, a1, a2 in sections:
            one = np.array([[-a1, 1.0], [-a2, 0.0]])
            into = np.array([b1 - a1 * b0, b2 - a2 * b0])
            n = len(b)
            wide = np.zeros((n + 2, n + 2))
            wide[:n, :n], wide[n:, n:], wide[n:, :n] = a, one, np.outer(into, c)
            a, b, c, d = wide, np.concatenate([b, into * d]), np.concatenate([b0 * c, [1.0, 0.0]]), b0 * d
        return System(a, b, c, d)

    @property
    def steady(self) -> np.ndarray:
        """The state in which a constant 1 stays."""
        return np.linalg.solve(np.eye(len(self.b)) - self.a, self.b)

    def power(self, n: int) -> np.ndarray:
        """What ``n`` samples make of a state."""
        return np.linalg.matrix_power(self.a, n)

    def _matrices(self, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        seen, reach = np.empty((m, len(self.b))), np.empty((m, len(self.b)))
        row, column = self.c.copy(), self.b.copy()
        for k in range(m):
            seen[k], reach[m - 1 - k] = row, column
            row, column = row @ self.a, self.a @ column
        pulse = np.concatenate([[self.d], seen[: m - 1] @ self.b])
        answer = np.zeros((m, m))
        for k in range(m):
            answer[k, : k + 1] = pulse[k::-1]
        return seen, reach, answer

    def run(self, u: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output for ``u`` from state ``z``, and the state after it."""
        m = self.block
        seen, reach, answer = self._matrices(m)
        whole = len(u) // m * m
        rows = u[:whole].reshape(-1, m)
        driven, own = rows @ reach, self.power(m)
        states = np.empty((len(rows), len(z)))
        for k in range(len(rows)):
            states[k] = z
            z = own @ z + driven[k]
        y = np.empty(len(u))
        y[:whole] = (rows @ answer.T + states @ seen.T).ravel()
        for k in range(whole, len(u)):
            y[k] = self.c @ z + self.d * u[k]
            z = self.a @ z + self.b * u[k]
        return y, z

    def end(self, u: np.ndarray) -> np.ndarray:
        """The state after ``u`` from rest."""
        m = self.block
        _, reach, _ = self._matrices(m)
        z, own = np.zeros(len(self.b)), self.power(m)
        whole = len(u) // m * m
        for driven in u[:whole].reshape(-1, m) @ reach:
            z = own @ z + driven
        for v in u[whole:]:
            z = self.a @ z + self.b * v
        return z


#: Order and ripple in dB of the low-pass before samples are left out, and its cut as a share of the new half rate.
ORDER, RIPPLE, SHARE = 8, 0.05, 0.8
EDGE = 27  # samples mirrored at either end


def antialias(q: int) -> System:
    return System.of(chebyshev(ORDER, RIPPLE, SHARE / q))


def mirrored(y: np.ndarray, edge: int = EDGE) -> np.ndarray:
    """Continued at both ends by what is there, turned about the end points."""
    return np.concatenate([2 * y[0] - y[edge:0:-1], y, 2 * y[-1] - y[-2 : -edge - 2 : -1]])


def zero_phase(y: np.ndarray, system: System, edge: int = EDGE) -> np.ndarray:
    """Filtered forwards and backwards, in one array."""
    if len(y) <= edge:
        raise ValueError(f"{len(y)} samples are too few, more than {edge} are needed")
    x = mirrored(y, edge)
    for _ in range(2):
        x = system.run(x, system.steady * x[0])[0][::-1]
    return x[edge:-edge]
