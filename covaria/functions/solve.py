"""Solvers on small dense operators; NumPy only, nothing here grows with the number of cells."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np

Operators = dict[tuple[str, str], np.ndarray]
Weights = dict[str, np.ndarray]


def _unit(v: np.ndarray, metric: np.ndarray | None = None) -> np.ndarray:
    norm = np.sqrt(v @ v if metric is None else v @ (metric * v))
    if norm < 1e-12:
        warnings.warn("a weight vector vanished", stacklevel=2)
        return np.zeros_like(v)
    return v / norm


def _get(y: Operators, a: str, b: str) -> np.ndarray:
    return y[a, b] if (a, b) in y else y[b, a].T


class Problem:
    """Axes w of unit length (in ``metrics``, if given) that maximise the sum over pairs of w_a' Y_ab w_b."""

    def __init__(self, y: Operators, types: list[str], metrics: dict[str, np.ndarray] | None = None):
        # in coordinates in which every metric is the identity
        self.types = list(types)
        self.root = {t: np.ones(_width(y, t)) if metrics is None else np.sqrt(np.asarray(metrics[t], float)) for t in types}
        self.y = {(a, b): m / self.root[a][:, None] / self.root[b][None, :] for (a, b), m in y.items()}

    def _leave(self, w: Weights) -> Weights:
        return {t: w[t] / self.root[t][:, None] for t in self.types}

    def solve(self, n_cc: int, max_iter: int = 500, tol: float = 1e-5, step: float = 1.0, start: Weights | None = None, first: Weights | None = None) -> Weights:
        """``n_cc`` axes for each type.  ``start`` begins the iteration for the first axis; ``first`` fixes leading axes."""
        if not 0 < step <= 1:
            raise ValueError("step must be in (0, 1]")
        sizes = [_width(self.y, t) for t in self.types]
        if not 1 <= n_cc <= min(sizes):
            raise ValueError(f"n_cc must be between 1 and {min(sizes)}")
        if len(self.types) == 2:
            a, b = self.types
            u, _, vt = np.linalg.svd(_get(self.y, a, b), full_matrices=False)
            exact = {a: u[:, :n_cc], b: vt.T[:, :n_cc]}
            if first is None or self._leads({t: self._enter(first[t], t) for t in self.types}, exact):
                return self._leave(exact)
        y = {pair: m.copy() for pair, m in self.y.items()}
        if first is not None:
            axes = {t: self._enter(first[t], t) for t in self.types}
        elif len(self.types) == 1:
            axes = {self.types[0]: self._leading(y)[self.types[0]][:, None]}
        else:
            begin = {t: _unit(np.asarray(start[t], float).ravel() * self.root[t]) for t in self.types} if start else self._leading(y)
            axes = {t: v[:, None] for t, v in self._iterate(y, begin, max_iter, tol, step).items()}
        done = 0
        while axes[self.types[0]].shape[1] < n_cc:
            for k in range(done, axes[self.types[0]].shape[1]):
                self._deflate(y, {t: axes[t][:, k] for t in self.types})
            done = axes[self.types[0]].shape[1]
            new = self._iterate(y, self._leading(y), max_iter, tol, step)
            axes = {t: np.column_stack([axes[t], new[t]]) for t in self.types}
        return self._leave({t: axes[t][:, :n_cc] for t in self.types})

    def _enter(self, w: np.ndarray, t: str) -> np.ndarray:
        w = np.asarray(w, float)
        return (w[:, None] if w.ndim == 1 else w) * self.root[t][:, None]

    def _leads(self, first: Weights, exact: Weights) -> bool:
        cosines = [float(first[t][:, 0] @ exact[t][:, 0] / max(np.linalg.norm(first[t][:, 0]), 1e-300)) for t in self.types]
        return all(abs(abs(c) - 1) <= 1e-4 for c in cosines) and np.prod(np.sign(cosines)) > 0 and first[self.types[0]].shape[1] == 1

    def _leading(self, y: Operators) -> Weights:
        if len(self.types) == 1:
            m = y[self.types[0], self.types[0]]
            return {self.types[0]: np.linalg.eigh((m + m.T) / 2)[1][:, -1]}
        head, out = self.types[0], {}
        for t in self.types[1:]:
            u, _, vt = np.linalg.svd(_get(y, head, t), full_matrices=False)
            out.setdefault(head, u[:, 0])
            out[t] = vt[0]
        return out

    def _iterate(self, y: Operators, w: Weights, max_iter: int, tol: float, step: float) -> Weights:
        """Each type's axis in turn follows the gradient of the others, until nothing changes but signs."""
        w = dict(w)
        for _ in range(max_iter):
            before = dict(w)
            for t in self.types:
                others = [t] if len(self.types) == 1 else [o for o in self.types if o != t]
                pull = sum(((y[t, t] + y[t, t].T) / 2 if o == t else _get(y, t, o)) @ w[o] for o in others)
                new = _unit(pull)
                w[t] = new if step == 1 else _unit((1 - step) * before[t] + step * new)
            if max(min(np.abs(w[t] - before[t]).max(), np.abs(w[t] + before[t]).max()) for t in self.types) <= tol:
                return w
        warnings.warn("the iteration did not converge", stacklevel=2)
        return w

    def _deflate(self, y: Operators, w: Weights) -> None:
        """Take an axis out: by rank one for one or two types, by projecting both sides for more."""
        for (a, b), m in y.items():
            u, v = w[a], w[b]
            if len(self.types) <= 2:
                y[a, b] = m - (u @ m @ v) * np.outer(u, v)
            else:
                m = m - np.outer(u, u @ m) / (u @ u)
                y[a, b] = m - np.outer(m @ v, v) / (v @ v)


def _width(y: Operators, t: str) -> int:
    return next(m.shape[0] if a == t else m.shape[1] for (a, b), m in y.items() if t in (a, b))


# ---- gene space -------------------------------------------------------------------------------------------------------


def slide_deviations(w: Weights, own: dict, slides: list[str], types: list[str]) -> dict[tuple[str, str], float]:
    return {(s, t): max(float(np.sqrt(max(np.ravel(w[t]) @ own[s][t] @ np.ravel(w[t]), 0.0))), 1e-12) for s in slides for t in types}


def genespace_objective(w: Weights, own: dict, cross: dict, slides: list[str], types: list[str]) -> float:
    """Mean over slides of the sum over pairs of w_a' C_ab w_b / (s_a s_b)."""
    if not slides:
        raise ValueError("at least one slide is needed")
    s = slide_deviations(w, own, slides, types)
    pairs = [(a, b) for k, a in enumerate(types) for b in types[k + 1 :]]
    return float(np.mean([sum(np.ravel(w[a]) @ _get(cross[q], a, b) @ np.ravel(w[b]) / (s[q, a] * s[q, b]) for a, b in pairs) for q in slides]))


Step = Callable[[Weights], tuple[dict[tuple[str, str], float], Weights]]


def step_of_matrices(own: dict, cross: dict, slides: list[str], types: list[str]) -> Step:
    """For given axes the deviations by slide and type, and each type's pull by the others, from covariances in memory."""

    def step(now: Weights) -> tuple[dict[tuple[str, str], float], Weights]:
        dev = slide_deviations(now, own, slides, types)
        return dev, {a: sum(_get(cross[s], a, b) @ now[b] / (dev[s, a] * dev[s, b]) for s in slides for b in types if b != a) / len(slides) for a in types}

    return step


def optimize_genespace(own: dict, cross: dict, slides: list[str], types: list[str], n_cc: int = 1, weights: Weights | None = None, max_iter: int = 3000, tol: float = 1e-6, seed=0) -> Weights:
    """Axes that maximise the mean correlation over slides, from covariances in memory."""
    if not slides:
        raise ValueError("at least one slide is needed")
    return genespace_axes(step_of_matrices(own, cross, slides, types), own[slides[0]][types[0]].shape[0], types, n_cc, weights, max_iter, tol, seed)[0]


def genespace_axes(step: Step, genes: int, types: list[str], n_cc: int, weights: Weights | None, max_iter: int, tol: float, seed) -> tuple[Weights, list[float]]:
    """Axes that maximise the mean correlation over slides, and what each new one reaches; later ones are kept orthogonal to earlier ones, type by type.

    All types move at once, with the deviations of the round before.  ``weights`` gives axes that are there already.
    """
    rng = seed if isinstance(seed, np.random.Generator) else np.random.default_rng(seed)
    axes = {t: np.zeros((genes, 0)) if weights is None else np.asarray(weights[t], float).reshape(genes, -1) for t in types}
    if max_iter < 1 or tol <= 0 or n_cc <= (0 if weights is None else axes[types[0]].shape[1]):
        raise ValueError("max_iter and tol must be positive and n_cc larger than the number of given axes")
    reached = []
    while axes[types[0]].shape[1] < n_cc:
        now = {t: _unit(rng.normal(size=(genes, 1)).ravel()) for t in types}
        for _ in range(max_iter):
            _, pulls = step(now)
            new = {}
            for a in types:
                pull = pulls[a]
                for prior in axes[a].T:
                    pull = pull - (pull @ prior) * prior
                norm = np.linalg.norm(pull)
                new[a] = pull / norm if norm > 0 else np.zeros(genes) if axes[a].shape[1] else now[a]
            change = max(min(np.abs(new[t] - now[t]).max(), np.abs(new[t] + now[t]).max()) for t in types)
            now = new
            if change <= tol:
                break
        else:
            warnings.warn("the iteration did not converge", stacklevel=2)
        # every pair pulls at both of its types
        value = sum(float(now[t] @ v) for t, v in step(now)[1].items()) / 2
        if len(types) == 2 and value < 0:
            now[types[0]], value = -now[types[0]], -value
        reached.append(value)
        axes = {t: np.column_stack([axes[t], now[t]]) for t in types}
    return axes, reached
