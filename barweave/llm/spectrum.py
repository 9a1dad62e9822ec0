"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The inertia of V - s I, read off an LDL^T factorisation with pivots of one or two rows, is the number of
eigenvalues above s. Bisection with these counts puts every leading eigenvalue into an interval of its own;
Rayleigh quotient iteration, which reuses the same factorisation to solve, converges there cubically; counts
on both sides of the result certify its number. The matrix is as wide as a vector, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
PIVOT = (1 + 17**0.5) / 8  #: below this part of its column a pivot is taken with a second row


class Factors:
    """P A P^T = L D L^T of a symmetric matrix, with blocks of one or two rows in D."""

    def __init__(self, matrix: np.ndarray):
        a = np.array(matrix, np.float64)
        size = len(a)
        self.order, self.blocks, self.low = np.arange(size), [], a
        k = 0
        while k < size:
            width = self._pivot(k)
            block, below = a[k : k + width, k : k + width].copy(), a[k + width :, k : k + width]
            self.blocks.append((k, block))
            if block.any():
                scaled = below / block[0, 0] if width == 1 else np.linalg.solve(block, below.T).T
                a[k + width :, k + width :] -= scaled @ below.T
                a[k + width :, k : k + width] = scaled
            k += width

    def _pivot(self, k: int) -> int:
        """Bring a pivot to row k; its number of rows."""
        a = self.low
        own, column = abs(a[k, k]), np.abs(a[k + 1 :, k])
        if not len(column) or own >= PIVOT * column.max():
            return 1
        r = k + 1 + int(column.argmax())
        most = column.max()
        row = np.abs(a[k:, r])
        row[r - k] = 0
        if own * row.max() >= PIVOT * most * most:
            return 1
        if abs(a[r, r]) >= PIVOT * row.max():
            self._swap(k, r)
            return 1
        self._swap(k + 1, r)
        return 2

    def _swap(self, i: int, j: int) -> None:
        a, x = self.low, [j, i]
        a[[i, j]] = a[x]
        a[:, [i, j]] = a[:, x]
        self.order[[i, j]] = self.order[x]

    def above(self) -> int:
        """Number of positive eigenvalues of the matrix (Sylvester's law of inertia)."""
        return sum(int((np.linalg.eigvalsh(b) > 0).sum()) if len(b) == 2 else int(b[0, 0] > 0) for _, b in self.blocks)

    def solve(self, right: np.ndarray, least: float) -> np.ndarray:
        """x of A x = right; a block nearer to singular than ``least`` is moved to it, as inverse iteration wants."""
        x, a = right[self.order].astype(np.float64), self.low
        for k, b in self.blocks:
            x[k + len(b) :] -= a[k + len(b) :, k : k + len(b)] @ x[k : k + len(b)]
        for k, b in reversed(self.blocks):
            if len(b) == 1:
                pivot = b[0, 0] if abs(b[0, 0]) > least else least
                x[k] /= pivot
            else:
                x[k : k + 2] = np.linalg.solve(b, x[k : k + 2])
            x[k : k + len(b)] -= a[k + len(b) :, k : k + len(b)].T @ x[k + len(b) :]
        out = np.empty_like(x)
        out[self.order] = x
        return out


class Slicer:
    """Counts of eigenvalues above a shift, each made once."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = (matrix + matrix.T) / 2
        self.size = len(matrix)
        self.norm = float(np.abs(self.matrix).sum(axis=1).max()) if self.size else 0.0
        self.least = max(self.size * EPS * self.norm, np.finfo(np.float64).tiny)
        self.tiny = max(EPS * EPS * self.norm, np.finfo(np.float64).tiny)  #: stands for a pivot of zero when solving
        self.counts: dict[float, int] = {-2 * self.norm - 1: self.size, 2 * self.norm + 1: 0}

    def factors(self, shift: float) -> Factors:
        f = Factors(self.matrix - shift * np.eye(self.size))
        self.counts.setdefault(shift, f.above())
        return f

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.factors(shift)
        return self.counts[shift]

    def interval(self, number: int) -> tuple[float, float]:
        """The narrowest known (low, high) that holds the eigenvalue of this number, counted from 1 by falling value."""
        return max(s for s, c in self.counts.items() if c >= number), min(s for s, c in self.counts.items() if c < number)

    def halve(self, number: int) -> tuple[float, float]:
        low, high = self.interval(number)
        self.above((low + high) / 2)
        return self.interval(number)

    def polish(self, vector: np.ndarray, low: float, high: float) -> tuple[float, np.ndarray] | None:
        """Rayleigh quotient iteration inside an interval; None where it leaves it or does not settle."""
        middle = self.factors((low + high) / 2)
        for _ in range(3):
            vector = middle.solve(vector, self.tiny)
            vector /= np.linalg.norm(vector)
        best = None
        for _ in range(12):
            product = self.matrix @ vector
            value = float(vector @ product)
            left = float(np.linalg.norm(product - value * vector))
            if not low <= value <= high:
                return None
            if best and left >= best[0] / 2:  # no further gain: rounding is reached
                break
            best = min(best or (left, value, vector), (left, value, vector), key=lambda b: b[0])
            vector = self.factors(value).solve(vector, self.tiny)
            vector /= np.linalg.norm(vector)
        return best[1:] if best[0] <= 4 * self.least else None


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors in columns) of up to ``most`` largest eigenvalues, falling.

    Eigenvalues that rounding cannot tell from zero or below are left out, so a matrix of low rank, or an
    empty one, gives fewer. Eigenvalues that agree within rounding give an orthonormal basis of their space.
    Raises where a count does not confirm the number of a result.
    """
    s = Slicer(matrix)
    wanted = min(most, s.above(4 * s.least)) if s.norm > 0 else 0
    values, vectors = np.zeros(wanted), np.zeros((s.size, wanted))
    rng = np.random.default_rng(1)
    number = 1
    while number <= wanted:
        low, high = s.interval(number)
        # alone in its interval, and the interval small against the distance to the others
        while high - low > 4 * s.least and s.above(low) - s.above(high) > 1:
            low, high = s.halve(number)
        found = None
        while s.above(low) - s.above(high) == 1 and high - low > 4 * s.least:
            found = s.polish(rng.standard_normal(s.size), low, high)
            if found:
                break
            low, high = s.halve(number)
        if found:
            value, vector = found
            if not s.above(value + 4 * s.least) < number <= s.above(value - 4 * s.least):
                raise ArithmeticError(f"counts do not confirm eigenvalue {number}")
            values[number - 1], vectors[:, number - 1] = value, vector
            number += 1
            continue
        # values that agree within rounding: a basis of their space by inverse iteration on a block
        together = s.above(low) - s.above(high)
        block, f = rng.standard_normal((s.size, together)), s.factors((low + high) / 2)
        for _ in range(4):
            block = np.linalg.qr(np.column_stack([f.solve(c, s.tiny) for c in block.T]))[0]
        first = s.above(high)
        for k in range(number - first - 1, together):
            if number <= wanted:
                values[number - 1], vectors[:, number - 1] = block[:, k] @ s.matrix @ block[:, k], block[:, k]
                number += 1
    for k in range(wanted):  # near values leave a little of each other's direction
        near = np.flatnonzero(np.abs(values[:k] - values[k]) < 1e-6 * s.norm)
        vectors[:, k] -= vectors[:, near] @ (vectors[:, near].T @ vectors[:, k])
        vectors[:, k] /= np.linalg.norm(vectors[:, k])
    return values, vectors
