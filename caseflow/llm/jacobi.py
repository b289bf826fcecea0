"""Leading eigenpairs of a symmetric operator that is known by its products alone: block Jacobi-Davidson.

The operator is applied to blocks of vectors, so one distributed product serves every open pair at once. Each outer step takes
the Ritz pairs of a search space, locks the leading ones whose residuals are down to rounding, and widens the space by the
solutions of the projected correction equations (I - XX')(A - theta I)(I - XX') t = -r, which MINRES solves roughly, all open
pairs in lockstep.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

EPS = np.finfo(float).eps
INNER_STEPS = 12
INNER_SHARE = 0.05
GUARDS = 4
SEED = 11


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to ``bases``; what adds nothing beyond rounding is left out."""
    sizes = np.linalg.norm(new, axis=0)
    out = new[:, sizes > 0] / sizes[sizes > 0]
    for _ in range(2):  # the second pass takes away what rounding left
        for basis in bases:
            out = out - basis @ (basis.T @ out)
        left, weights, _ = np.linalg.svd(out, full_matrices=False)
        out = left[:, weights > 1e-10]
    return out


def corrections(apply: Callable, known: np.ndarray, theta: np.ndarray, residual: np.ndarray, steps: int = INNER_STEPS, share: float = INNER_SHARE) -> np.ndarray:
    """Rough solutions t, orthogonal to ``known``, of (I - XX')(A - theta I)(I - XX') t = -residual, by MINRES.

    A column stops when its residual is down to ``share``, or when its Krylov space is used up.
    """

    def away(x: np.ndarray) -> np.ndarray:
        return x - known @ (known.T @ x)

    v = away(-residual)
    beta = np.linalg.norm(v, axis=0)
    start = np.where(beta > 0, beta, 1.0)
    open_, v = beta > 0, v / start
    before, solution = np.zeros_like(v), np.zeros_like(v)
    d, d_before = np.zeros_like(v), np.zeros_like(v)
    eta, beta = beta.copy(), np.zeros_like(beta)
    c = c_before = np.ones_like(beta)
    s = s_before = np.zeros_like(beta)
    for _ in range(steps):
        if not open_.any():
            break
        p = np.zeros_like(v)
        p[:, open_] = away(apply(v[:, open_]) - theta[open_] * v[:, open_])
        alpha = (v * p).sum(axis=0)
        p = away(p - alpha * v - beta * before)
        p -= v * (v * p).sum(axis=0)
        beta_next = np.linalg.norm(p, axis=0)
        # The new column of the tridiagonal matrix under the last two rotations, then the rotation that ends it.
        delta = c * alpha - c_before * s * beta
        first, second, third = np.hypot(delta, beta_next), s * alpha + c_before * c * beta, s_before * beta
        usable = open_ & (first > 0)
        size = np.where(usable, first, 1.0)
        c_before, s_before = c, s
        c, s = np.where(usable, delta / size, 1.0), np.where(usable, beta_next / size, 0.0)
        d_next = np.where(usable, (v - third * d_before - second * d) / size, 0.0)
        solution += np.where(usable, c * eta, 0.0) * d_next
        eta = np.where(usable, -s * eta, eta)
        d_before, d = d, d_next
        left = beta_next > 1e-12 * np.maximum(np.abs(alpha), beta_next)
        open_ = usable & left & (np.abs(eta) > share * start)
        before, v = v, np.where(left, p / np.where(left, beta_next, 1.0), 0.0)
        beta = beta_next
    return solution


def leading(apply: Callable[[np.ndarray], np.ndarray], dim: int, want: int, most_steps: int = 100, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues by falling size, unit eigenvectors as columns) of the ``want`` largest of a positive semidefinite operator."""
    want = min(want, dim)
    widest = min(dim, 10 * want + GUARDS)
    space = _orthonormal(np.random.default_rng(seed).standard_normal((dim, min(dim, want + GUARDS))))
    image = apply(space)
    locked, size, last, stalls, done_before = np.empty((dim, 0)), 0.0, np.inf, 0, False
    for _ in range(most_steps):
        need = want - locked.shape[1]
        if not need:
            break
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        size = max(size, float(np.abs(theta).max(initial=0.0)))
        residual = image - space * theta
        residual -= locked @ (locked.T @ residual)
        sizes = np.linalg.norm(residual, axis=0)
        bound = 4 * EPS * np.sqrt(dim) * size
        whole = locked.shape[1] + space.shape[1] == dim  # nothing is left to add: the pairs are as exact as the products
        # Within a digit or two of rounding, the error of the products may keep a residual from falling any further.
        stalls = stalls + 1 if not done_before and sizes[0] > last / 2 and sizes[0] <= 50 * bound else 0
        last = sizes[0]
        done = need if whole else max(int((sizes[:need] <= bound).cumprod().sum()), int(stalls == 2))
        done_before = done > 0
        if stalls == 1 and not done:
            image = apply(space)
            continue
        if done:
            locked, space, image = np.hstack([locked, space[:, :done]]), space[:, done:], image[:, done:]
            if locked.shape[1] < want and not space.shape[1]:
                space = _orthonormal(np.random.default_rng(seed + locked.shape[1]).standard_normal((dim, GUARDS)), locked)
                image = apply(space)
            continue
        wanted = slice(0, need)
        known = np.hstack([locked, space[:, wanted]])
        new = _orthonormal(corrections(apply, known, theta[wanted], residual[:, wanted]), locked, space)
        if not new.shape[1]:
            new = _orthonormal(np.random.default_rng(seed + space.shape[1]).standard_normal((dim, GUARDS)), locked, space)
        if space.shape[1] + new.shape[1] > widest:
            space, image = space[:, : need + GUARDS + want], image[:, : need + GUARDS + want]
        image, space = np.hstack([image, apply(new)]), np.hstack([space, new])
    else:
        raise ArithmeticError(f"{want - locked.shape[1]} pairs have not converged in {most_steps} steps")
    # One fresh product settles what rounding left among the locked vectors.
    locked = _orthonormal(locked)
    small = locked.T @ apply(locked)
    theta, turn = np.linalg.eigh((small + small.T) / 2)
    return theta[::-1], locked @ turn[:, ::-1]
