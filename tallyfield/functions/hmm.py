"""Gaussian hidden Markov models and related kernels, in numpy."""

from __future__ import annotations


import numpy as np


def logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def regularised(cov: np.ndarray, kind: str, load: float, shrink: float = 0.1) -> np.ndarray:
    """diag: variances only; shrunk: pulled towards them; full: as it is. All get a small load."""
    d = np.diag(np.diag(cov))
    cov = d if kind == "diag" else (1 - shrink) * cov + shrink * d if kind == "shrunk" else cov
    return (cov + cov.T) / 2 + load * np.eye(len(cov))


def n_parameters(d: int, k: int, kind: str) -> int:
    """Means, covariances, transitions and start probabilities."""
    return k * d + k * (d if kind == "diag" else d * (d + 1) // 2) + k * (k - 1) + k - 1


def log_density(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    chol = np.linalg.cholesky(cov)
    z = np.linalg.solve(chol, (x - mean).T)
    return -0.5 * ((z**2).sum(axis=0) + x.shape[1] * np.log(2 * np.pi)) - np.log(np.diag(chol)).sum()


def spread_starts(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres chosen far apart: each next with a chance in proportion to the squared distance."""
    centres = [x[rng.integers(len(x))]]
    while len(centres) < k:
        d = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        p = d / d.sum() if d.sum() > 0 else np.full(len(x), 1 / len(x))
        centres.append(x[rng.choice(len(x), p=p)])
    return np.array(centres)


class GaussianHmm:
    """means, covs, trans, start after ``fit``."""

    def __init__(self, k: int, kind: str = "diag", seed: int = 0, iterations: int = 60, tolerance: float = 1e-4):
        self.k, self.kind, self.seed, self.iterations, self.tolerance = k, kind, seed, iterations, tolerance

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.stack([log_density(x, m, c) for m, c in zip(self.means, self.covs, strict=True)], axis=1)

    def forward(self, log_b: np.ndarray) -> np.ndarray:
        out = np.empty_like(log_b)
        out[0] = np.log(self.start + 1e-300) + log_b[0]
        log_a = np.log(self.trans + 1e-300)
        for t in range(1, len(log_b)):
            out[t] = logsumexp(out[t - 1][:, None] + log_a, 0) + log_b[t]
        return out

    def backward(self, log_b: np.ndarray) -> np.ndarray:
        out = np.zeros_like(log_b)
        log_a = np.log(self.trans + 1e-300)
        for t in range(len(log_b) - 2, -1, -1):
            out[t] = logsumexp(log_a + log_b[t + 1] + out[t + 1], 1)
        return out

    def fit(self, x: np.ndarray) -> float:
        """Baum-Welch from one start; the log likelihood reached."""
        rng, load = np.random.default_rng(self.seed), 1e-6 + 1e-3 * float(x.var(axis=0).mean())
        self.means = spread_starts(x, self.k, rng)
        near = ((x[:, None] - self.means) ** 2).sum(axis=2).argmin(axis=1)
        base = np.cov(x.T).reshape(x.shape[1], x.shape[1])
        self.covs = np.stack([regularised(np.cov(x[near == j].T).reshape(base.shape) if (near == j).sum() > x.shape[1] + 1 else base, self.kind, load) for j in range(self.k)])
        self.trans = np.full((self.k, self.k), 0.1 / max(1, self.k - 1))
        np.fill_diagonal(self.trans, 0.9 if self.k > 1 else 1.0)
        self.start, last = np.full(self.k, 1 / self.k), -np.inf
        for _ in range(self.iterations):
            log_b = self.emissions(x)
            a, b = self.forward(log_b), self.backward(log_b)
            like = float(logsumexp(a[-1], 0))
            g = np.exp(a + b - logsumexp(a + b, 1)[:, None])
            xi = a[:-1, :, None] + np.log(self.trans + 1e-300) + (log_b[1:] + b[1:])[:, None, :]
            xi = np.exp(xi - like).sum(axis=0)
            self.start = g[0] / g[0].sum()
            self.trans = (xi + 1e-9) / (xi + 1e-9).sum(axis=1, keepdims=True)
            for j in range(self.k):
                w = g[:, j] / max(g[:, j].sum(), 1e-12)
                self.means[j] = w @ x
                d = x - self.means[j]
                self.covs[j] = regularised((w[:, None] * d).T @ d, self.kind, load)
            if like - last < self.tolerance * abs(like):
                break
            last = like
        return like

    def filtered(self, x: np.ndarray) -> np.ndarray:
        a = self.forward(self.emissions(x))
        return np.exp(a - logsumexp(a, 1)[:, None])

    def one_step_ahead(self, past: np.ndarray, ahead: np.ndarray) -> float:
        """Log likelihood of ``ahead`` given ``past``."""
        a = self.forward(self.emissions(np.concatenate([past, ahead])))
        return float(logsumexp(a[-1], 0) - logsumexp(a[len(past) - 1], 0))


def fit_best(x: np.ndarray, k: int, kind: str = "diag", restarts: int = 3, seed: int = 0) -> tuple[float, GaussianHmm]:
    tries = []
    for r in range(restarts):
        m = GaussianHmm(k, kind, seed + 101 * r)
        tries.append((m.fit(x), m))
    return max(tries, key=lambda t: t[0])


def root_psd(a: np.ndarray) -> np.ndarray:
    v, u = np.linalg.eigh((a + a.T) / 2)
    return (u * np.sqrt(np.maximum(v, 0))) @ u.T


def wasserstein2(m1, c1, m2, c2) -> float:
    """2-Wasserstein distance of two normal distributions."""
    r = root_psd(c2)
    cross = root_psd(r @ c1 @ r)
    return float(np.sqrt(max(((m1 - m2) ** 2).sum() + np.trace(c1 + c2 - 2 * cross), 0.0)))


def assign(cost: np.ndarray) -> list[int]:
    """For each row a column of its own at least cost, by shortest augmenting paths over reduced costs."""
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    owner = np.full(m, -1)  # row of a column
    row_price, column_price = np.zeros(n), np.zeros(m)
    for row in range(n):
        far, before, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, last, base = row, -1, 0.0
        while True:
            through = base + cost[at] - row_price[at] - column_price
            nearer = ~done & (through < far)
            far[nearer], before[nearer] = through[nearer], last
            last = int(np.where(done, np.inf, far).argmin())
            base = far[last]
            done[last] = True
            if owner[last] < 0:
                break
            at = owner[last]
        row_price[row] += base
        held = done & (owner >= 0)
        row_price[owner[held]] += base - far[held]
        column_price[done] -= base - far[done]
        while last >= 0:  # the columns of the path move on by one
            owner[last] = owner[before[last]] if before[last] >= 0 else row
            last = before[last]
    out = [0] * n
    for j, i in enumerate(owner.tolist()):
        if i >= 0:
            out[i] = j
    return out


class TemplateBook:
    """Persistent regime ids across refits: each new state goes to the nearest template, which moves
    towards it; states beyond ``threshold`` found a template of their own, however many there are."""

    def __init__(self, threshold: float = 2.0, rate: float = 0.3):
        self.threshold, self.rate, self.means, self.covs = threshold, rate, [], []

    def match(self, means: np.ndarray, covs: np.ndarray) -> list[int]:
        k, known = len(means), len(self.means)
        out = [-1] * k
        if known:
            d = np.array([[wasserstein2(means[i], covs[i], self.means[j], self.covs[j]) for j in range(known)] for i in range(k)])
            wide = np.hstack([d, np.full((k, max(0, k)), self.threshold)])
            for i, j in enumerate(assign(wide)):
                if j < known:
                    out[i] = j
        for i in range(k):
            if out[i] >= 0:
                j = out[i]
                self.means[j] = (1 - self.rate) * self.means[j] + self.rate * means[i]
                self.covs[j] = (1 - self.rate) * self.covs[j] + self.rate * covs[i]
            else:
                out[i] = len(self.means)
                self.means.append(means[i].copy())
                self.covs.append(covs[i].copy())
        return out


def nearest_traded(v: np.ndarray, before: np.ndarray, cap: float, cost: float) -> np.ndarray:
    """The w with 0 <= w <= cap and sum 1 that has the least |w - v|^2 / 2 + cost sum|w - before|.

    For a multiplier m of the sum every weight has a closed form, which falls as m grows: bisection finds m.
    """

    def at(m):
        d = v - m - before
        return np.clip(before + np.sign(d) * np.maximum(np.abs(d) - cost, 0), 0, cap)

    lo, hi = min(v.min(), before.min()) - cap - cost - 1, max(v.max(), before.max()) + cost + 1
    for _ in range(100):
        mid = (lo + hi) / 2
        if at(mid).sum() > 1:
            lo = mid
        else:
            hi = mid
    a, b = at(lo), at(hi)  # sums on either side of 1
    gap = a.sum() - b.sum()
    return b if gap <= 0 else b + (a - b) * (1 - b.sum()) / gap


def construct_weights(mu: np.ndarray, cov: np.ndarray, before: np.ndarray, cap: float, cost: float, aversion: float, horizon: float, steps: int = 20_000, tolerance: float = 1e-12) -> np.ndarray:
    """max w'mu h - aversion / 2 h w'Cw - cost sum|w - before|, with sum 1 and 0 <= w <= cap.

    Accelerated proximal gradient with restarts, up to a fixed point, where the conditions of an optimum
    hold. Raises ValueError if no such weights are.
    """
    n = len(mu)
    if n == 0 or n * cap < 1 - 1e-12:
        raise ValueError("infeasible: the largest weights don't add up to 1")
    h = max(1.0, horizon)
    curve = max(aversion * h * np.linalg.eigvalsh(cov)[-1], 1e-3 * np.abs(mu).max() * h, 1e-9)
    slope = lambda w: aversion * h * (cov @ w) - mu * h
    w = y = nearest_traded(np.full(n, 1 / n), before, cap, 0.0)
    t = 1.0
    for _ in range(steps):
        new = nearest_traded(y - slope(y) / curve, before, cap, cost / curve)
        if np.abs(new - y).max() < tolerance:
            return new
        if (y - new) @ (new - w) > 0:  # the momentum points back
            t, y = 1.0, new
        else:
            u = (1 + np.sqrt(1 + 4 * t * t)) / 2
            t, y = u, new + (t - 1) / u * (new - w)
        w = new
    return w
