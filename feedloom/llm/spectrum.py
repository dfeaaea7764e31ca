"""Leading eigenpairs of a symmetric matrix by slicing its spectrum.

For a shift s, the factors L D Lᵀ of A - s I have as many positive entries in D as A has
eigenvalues above s (Sylvester's law of inertia). Bisection on that count brackets each leading
eigenvalue; within the bracket, Rayleigh quotient iteration finds it with cubic convergence.
Counts just below and above each value certify that it is the one of its number: none was
missed, and none was taken twice.

Diagonal blocks of one or two rows are chosen by the pivoting of Bunch and Kaufman, so that the
factors stay small and the counts can be trusted however close a shift is to an eigenvalue.
"""

from __future__ import annotations

import numpy as np

_ALPHA = (1 + 17 ** 0.5) / 8  # fixed value: the bound of growth is least


def count_above(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of ``a`` greater than ``shift``: positive ones of D in P (a - shift I) Pᵀ = L D Lᵀ."""
    m = a - shift * np.eye(len(a))
    above = 0
    while len(m):
        column = np.abs(m[1:, 0])
        r = int(column.argmax()) + 1 if len(column) else 0
        most = column[r - 1] if r else 0.0
        size, pivot = 1, 0
        if most and abs(m[0, 0]) < _ALPHA * most:
            side = np.abs(m[r])
            side[r] = 0
            far = side.max()
            if abs(m[0, 0]) * far >= _ALPHA * most * most:
                pass
            elif abs(m[r, r]) >= _ALPHA * far:
                pivot = r
            else:
                size, pivot = 2, r
        if pivot:
            at = size - 1
            m[[at, pivot]] = m[[pivot, at]]
            m[:, [at, pivot]] = m[:, [pivot, at]]
        if size == 1:
            above += m[0, 0] > 0
            rest = m[1:, 1:]
            m = rest - np.outer(m[1:, 0] / m[0, 0], m[0, 1:]) if m[0, 0] else rest
        else:  # chosen where the block has one value of either sign
            above += 1
            m = m[2:, 2:] - m[2:, :2] @ np.linalg.solve(m[:2, :2], m[:2, 2:])
    return int(above)


def _away(v: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """Unit vector along the part of ``v`` at right angles to those found."""
    for _ in range(2):
        for u in found:
            v = v - (u @ v) * u
    return v / np.linalg.norm(v)


def _rayleigh(a: np.ndarray, low: float, high: float, found: list[np.ndarray], number: int) -> tuple[float, np.ndarray]:
    """An eigenpair with its value in the bracket, at right angles to those found.

    Inverse iteration at the middle leads into the bracket; from there on the Rayleigh quotient
    is the shift, as long as it stays in the bracket.
    """
    scale = np.abs(a).sum(axis=1).max()
    v = _away(np.random.default_rng(number).standard_normal(len(a)), found)
    best, least = (0.5 * (low + high), v), np.inf
    for step in range(60):
        quotient = v @ a @ v
        left = np.linalg.norm(a @ v - quotient * v)
        if low <= quotient <= high and left < least:
            best, least = (quotient, v), left
        elif step > 5 and low <= quotient <= high and left <= 64 * np.finfo(float).eps * scale:
            break
        shift = quotient if step > 2 and low <= quotient <= high else 0.5 * (low + high)
        try:
            w = np.linalg.solve(a - shift * np.eye(len(a)), v)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            w = np.linalg.solve(a - (shift + 4 * np.finfo(float).eps * scale) * np.eye(len(a)), v)
        if not np.isfinite(w).all():
            break
        v = _away(w, found)
    return best


def leading(a: np.ndarray, most: int, least_share: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and their unit vectors as columns: the first ``most`` of a
    matrix without negative eigenvalues, without those below ``least_share`` of the first.

    Values closer together than the arithmetic can tell apart stay in one bracket; their vectors
    are kept at right angles to one another. Raises if the counts do not certify the numbering.
    """
    d = len(a)
    a = (a + a.T) / 2
    top = np.abs(a).sum(axis=1).max() if d else 0.0  # no eigenvalue is beyond the greatest row sum
    if top == 0:
        return np.zeros(0), np.zeros((d, 0))
    near = 1e-13 * top
    counts: dict[float, int] = {-top - near: d, top + near: 0}

    def count(s: float) -> int:
        if s not in counts:
            counts[s] = count_above(a, s)
        return counts[s]

    values: list[float] = []
    vectors: list[np.ndarray] = []
    for i in range(1, min(most, d) + 1):
        # The narrowest bracket that counts have shown so far: at least i above low, fewer above high.
        low = max(s for s, c in counts.items() if c >= i)
        high = min(s for s, c in counts.items() if c < i)
        for attempt in range(80):
            while high - low > near and (count(low) != i or count(high) != i - 1 or high - low > 0.5 * max(abs(low), abs(high))):
                middle = 0.5 * (low + high)
                if count(middle) >= i:
                    low = middle
                else:
                    high = middle
            close = [u for e, u in zip(values, vectors) if e <= high + near] if high - low <= near else []
            value, vector = _rayleigh(a, low, high, close, i)
            slack = 4 * near
            if np.linalg.norm(a @ vector - value * vector) <= slack and count(value - slack) >= i > count(value + slack):
                break
            if high - low <= near:
                raise ArithmeticError(f"eigenvalue {i} is not certified")
            middle = 0.5 * (low + high)
            if count(middle) >= i:
                low = middle
            else:
                high = middle
        if value <= least_share * (values[0] if values else top):
            break
        values.append(float(value))
        vectors.append(_away(vector, vectors))
    return np.array(values), np.array(vectors).T.reshape(d, len(values))
