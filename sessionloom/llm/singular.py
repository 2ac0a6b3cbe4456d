"""Singular values and right vectors of a small matrix: bidiagonal form, dqds, twisted factorisations."""

import numpy as np

_EPS = np.finfo(float).eps
_SWEEPS = 100  # a value; more than convergence ever takes
_NEAR = 1e-3  # relative gap below which vectors are made orthogonal to each other


def bidiagonalised(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(a, b, v)``: diagonal and upper diagonal of U^T r V by Householder reflections, and V, of a square ``r``."""
    r, n = np.array(r, float), len(r)
    v = np.eye(n)
    for k in range(n):
        for x, left in ((r[k:, k], True), (r[k, k + 1 :], False)):
            if len(x) < 2 or not np.any(x[1:]):
                continue
            u = x / np.abs(x).max()
            u[0] += np.copysign(np.sqrt(u @ u), u[0])
            u /= np.sqrt(u @ u)
            if left:
                r[k:, k:] -= 2 * np.outer(u, u @ r[k:, k:])
            else:
                r[k:, k + 1 :] -= 2 * np.outer(r[k:, k + 1 :] @ u, u)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ u, u)
    return np.diag(r).copy(), np.diag(r, 1).copy(), v


def _dqds_sweep(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """One transform with a shift; None if the shift was above the smallest value."""
    new_q, new_e, d = np.empty_like(q), np.empty_like(e), q[0] - shift
    least = d
    for k in range(len(e)):
        if d < 0:
            return None
        new_q[k] = d + e[k]
        if new_q[k] == 0:
            ratio = 0.0
        else:
            ratio = q[k + 1] / new_q[k]
        new_e[k] = e[k] * ratio
        d = d * ratio - shift
        least = min(least, d)
    if d < 0 or not np.isfinite(d):
        return None
    new_q[-1] = d
    return new_q, new_e, least


def singular_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal (a, b), falling.

    The dqds algorithm: with shifts below the smallest value the last entry converges to it,
    each to high relative accuracy; shifts that prove too large are tried again smaller.
    """
    out, work = [], [(np.square(a), np.square(b), 0.0)]
    while work:
        q, e, moved = work.pop()
        guess = 0.0
        for _ in range(_SWEEPS * max(len(q), 1)):
            if not len(q):
                break
            unit = _EPS * (np.minimum(q[:-1], q[1:]) + moved)
            small = np.flatnonzero((e <= _EPS * unit) | (e <= unit) & (q[:-1] * e <= unit**2))  # too small to count
            if len(q) == 1:
                out.append(q[0] + moved)
                break
            if len(small):  # parts do not touch each other
                cuts = [0, *(small + 1).tolist(), len(q)]
                work += [(q[i:j], e[i : j - 1], moved) for i, j in zip(cuts, cuts[1:], strict=False)]
                break
            if q[0] < q[-1] / 2:  # the small end last
                q, e = q[::-1].copy(), e[::-1].copy()
            shift, done = guess, None
            while done is None:
                done = _dqds_sweep(q, e, shift)
                if done is None:
                    if shift == 0:
                        raise ArithmeticError("dqds met a value that is not finite")
                    shift = shift / 4 if shift > _EPS * moved else 0.0
            q, e, least = done
            moved += shift
            # the smallest value is at most the least d; its last two entries tell how near
            tail = e[-1] * (q[-1] / (q[-2] + e[-1]) if q[-2] + e[-1] else 0.0)
            guess = max(0.0, min(least, q[-1]) - tail) * (1 - 1e-6) if tail < q[-1] / 4 else least / 4
        else:
            raise ArithmeticError("dqds does not converge")
    return np.sort(np.maximum(out, 0.0))[::-1]


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """Unit vector z with B^T B z = value z from the twisted factorisation with the smallest middle."""
    n = len(a)
    d, low = a * a, b / a[:-1]
    s, down = np.empty(n), np.empty(max(n - 1, 0))
    s[0] = -value
    for k in range(n - 1):  # stationary: from above
        plus = d[k] + s[k]
        plus = plus if plus else _EPS * (d[k] + abs(value))
        down[k] = d[k] * low[k] / plus
        s[k + 1] = down[k] * low[k] * s[k] - value
    p, up = np.empty(n), np.empty(max(n - 1, 0))
    p[-1] = d[-1] - value
    for k in range(n - 2, -1, -1):  # progressive: from below
        minus = d[k] * low[k] ** 2 + p[k + 1]
        minus = minus if minus else _EPS * (d[k] * low[k] ** 2 + abs(value))
        t = d[k] / minus
        up[k] = low[k] * t
        p[k] = p[k + 1] * t - value
    twist = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(twist, n - 1):
        z[k + 1] = -up[k] * z[k]
    return z / np.sqrt(z @ z)


def right_vectors(a: np.ndarray, b: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Columns: unit right singular vectors of the bidiagonal for the given squares (falling), orthogonal to each other."""
    n = len(a)
    scale = np.sqrt(np.abs(a).max(initial=0.0) ** 2 + np.abs(b).max(initial=0.0) ** 2)
    a = np.where(np.abs(a) < _EPS * scale, _EPS * scale, a)
    cut = np.flatnonzero(np.abs(b) <= _EPS * scale) + 1
    ends = [0, *cut.tolist(), n]
    parts = [(i, j, singular_squares(a[i:j], b[i : j - 1])) for i, j in zip(ends, ends[1:], strict=False)]
    # of each value the part that it belongs to; equal values of several parts go to one part each
    owners = sorted(((v, k) for k, (_, _, values) in enumerate(parts) for v in values), key=lambda x: -x[0])[: len(squares)]
    out = np.zeros((n, len(squares)))
    for c, (value, k) in enumerate(owners):
        i, j, _ = parts[k]
        z = np.zeros(n)
        z[i:j] = _twisted(a[i:j], b[i : j - 1], value)
        near = [x for x in range(c) if owners[x][0] - value <= _NEAR * owners[0][0]]
        for _ in range(2):
            z -= out[:, near] @ (out[:, near].T @ z)
        if np.sqrt(z @ z) < 0.5:  # a cluster whose twisted vectors fall together: inverse iteration beside those found
            t = np.diag(a * a) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
            t[np.arange(1, n), np.arange(1, n)] += b * b
            z = np.cos(np.arange(n) * (c + 1.0))
            for _ in range(4):
                z = np.linalg.solve(t - (value + 4 * _EPS * scale**2) * np.eye(n), z / np.sqrt(z @ z))
                for _ in range(2):
                    z -= out[:, near] @ (out[:, near].T @ z)
                    z /= np.sqrt(z @ z)
        out[:, c] = z / np.sqrt(z @ z)
    return out


def right_singular(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All squares of the singular values of a square ``r``, falling, and the unit right vectors (columns) of the first ``most``."""
    scale = np.abs(r).max(initial=0.0)
    if not scale:
        return np.zeros(len(r)), np.eye(len(r))[:, :most]
    a, b, v = bidiagonalised(r / scale)
    squares = singular_squares(a, b)
    vectors = v @ right_vectors(a, b, squares[:most])
    return squares * scale**2, vectors
