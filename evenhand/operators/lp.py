"""A dense primal-dual interior-point solver (Mehrotra predictor and corrector) for small linear programs."""

from __future__ import annotations

import numpy as np


def solve(c: np.ndarray, a_eq: np.ndarray, b_eq: np.ndarray, a_ub: np.ndarray, b_ub: np.ndarray, steps: int = 200, tol: float = 1e-9) -> np.ndarray:
    """argmin c x with a_eq x = b_eq, a_ub x <= b_ub, x >= 0; raises RuntimeError where none is found."""
    n, m_ub = len(c), len(b_ub)
    a = np.block([[a_eq, np.zeros((len(b_eq), m_ub))], [a_ub, np.eye(m_ub)]])
    b, cost = np.concatenate([b_eq, b_ub]), np.concatenate([c, np.zeros(m_ub)])
    m, k = a.shape

    def normal(d: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.linalg.solve((a * d) @ a.T + 1e-12 * np.eye(m), r)

    one = np.ones(k)
    x, y = a.T @ normal(one, b), normal(one, a @ cost)
    s = cost - a.T @ y
    x += max(-1.5 * x.min(), 0) + 1e-2
    s += max(-1.5 * s.min(), 0) + 1e-2
    dot = x @ s
    x, s = x + 0.5 * dot / s.sum(), s + 0.5 * dot / x.sum()
    for _ in range(steps):
        rp, rd, mu = b - a @ x, cost - a.T @ y - s, x @ s / k
        if np.abs(rp).max() < 1e-8 * (1 + np.abs(b).max()) and np.abs(rd).max() < 1e-8 * (1 + np.abs(cost).max()) and mu < tol:
            return x[:n]

        def direction(rxs: np.ndarray, rp=rp, rd=rd) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            d = x / s
            dy = normal(d, rp + a @ (d * rd - rxs / s))
            ds = rd - a.T @ dy
            return (rxs - x * ds) / s, dy, ds

        def reach(v: np.ndarray, dv: np.ndarray) -> float:
            neg = dv < 0
            return min(1.0, float((-v[neg] / dv[neg]).min())) if neg.any() else 1.0

        try:
            dx, dy, ds = direction(-x * s)
            sigma = (((x + reach(x, dx) * dx) @ (s + reach(s, ds) * ds)) / k / mu) ** 3
            dx, dy, ds = direction(sigma * mu - x * s - dx * ds)
        except np.linalg.LinAlgError:
            break
        p, q = 0.995 * reach(x, dx), 0.995 * reach(s, ds)
        x, y, s = x + p * dx, y + q * dy, s + q * ds
        if not np.isfinite(x).all() or np.abs(x).max() > 1e12:
            break
    raise RuntimeError("the program has no solution within its limits")
