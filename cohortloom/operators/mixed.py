"""Linear mixed models for visit series, fitted by restricted likelihood.

Each subject is reduced once to its cross-products.  The profiled likelihood
of any covariance parameter is a sum over subjects of closed-form column
expressions, so one Spark aggregate evaluates a whole batch of parameters.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cohortloom.storage import materialize

INTERCEPT = "intercept"
_ONE = "_one"


@dataclass
class MixedFit:
    """Fitted model: fixed effects (on the original scale) and variances."""

    terms: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    theta: tuple[float, ...]
    sigma2: float
    deviance: float
    n_rows: int
    means: dict[str, float]
    beta_centered: np.ndarray
    converged: bool = True

    def table(self, spark) -> DataFrame:
        """Fixed effects as rows (term, estimate, std_error, statistic)."""
        se = np.sqrt(np.diag(self.covariance))
        rows = [(t, float(b), float(s), float(b / s) if s > 0 else None)
                for t, b, s in zip(self.terms, self.beta, se)]
        return spark.createDataFrame(rows, "term string, estimate double, std_error double, statistic double")

    def variance_components(self) -> dict[str, float]:
        lam = _factor(self.theta)
        cov = self.sigma2 * lam @ lam.T
        out = {"residual": self.sigma2, "intercept": float(cov[0, 0])}
        if len(self.theta) == 3:
            out.update(slope=float(cov[1, 1]), covariance=float(cov[0, 1]))
        return out


def _factor(theta: Sequence[float]) -> np.ndarray:
    if len(theta) == 1:
        return np.array([[theta[0]]])
    return np.array([[theta[0], 0.0], [theta[1], theta[2]]])


def _name(a: str, b: str) -> str:
    return f"x_{a}|{b}"


def _number(value: float) -> str:
    return f"({float(value)!r}D)"


class SubjectTable:
    """Per-subject cross-products of response and regressors, kept in shared storage.

    Columns are centred by their overall means first; only the fixed intercept
    changes by that and it is put back in the result.  The random part keeps
    the slope column on its original scale.
    """

    def __init__(self, df: DataFrame, subject: str, y: str, xs: Sequence[str], slope: str | None):
        self.subject, self.y, self.xs, self.slope = subject, y, list(xs), slope
        used = df.dropna(subset=[subject, y, *xs])
        means = used.agg(*[F.avg(c).alias(c) for c in (y, *xs)], F.count(F.lit(1)).alias("_rows")).first()
        self.n_rows = int(means["_rows"])
        self.means = {c: float(means[c]) for c in (y, *xs)}
        shifted = {c: F.col(c).cast("double") - F.lit(m) for c, m in self.means.items()}
        shifted[_ONE] = F.lit(1.0)
        self.fixed = [_ONE, *self.xs]
        pairs = itertools.combinations_with_replacement([y, *self.fixed], 2)
        sums = [F.sum(shifted[a] * shifted[b]).alias(_name(a, b)) for a, b in pairs]
        self.table = materialize(used.groupBy(subject).agg(*sums), "subjects")

    def cross(self, a: str, b: str) -> str:
        """Cross-product of two centred columns within a subject, as SQL text."""
        order = [self.y, *self.fixed]
        a, b = sorted((a, b), key=order.index)
        return f"`{_name(a, b)}`"

    def random_cross(self, column: str) -> list[str]:
        """Z'c of one subject, Z = [1, slope on its original scale]."""
        first = self.cross(_ONE, column)
        if not self.slope:
            return [first]
        return [first, f"({self.cross(self.slope, column)} + {_number(self.means[self.slope])} * {first})"]

    def gram(self) -> list[str]:
        """n, and with a random slope also sum t and sum t^2 of one subject."""
        n = self.cross(_ONE, _ONE)
        if not self.slope:
            return [n]
        m, t = _number(self.means[self.slope]), self.cross(_ONE, self.slope)
        tt = self.cross(self.slope, self.slope)
        return [n, f"({t} + {m} * {n})", f"({tt} + 2 * {m} * {t} + {m} * {m} * {n})"]

    def with_solution(self, rows: DataFrame, theta: Sequence[str]) -> DataFrame:
        """Add log det of M = I + L'Z'ZL and the cells of K = L M^-1 L' for the factor L."""
        if not self.slope:
            inner = f"(1 + {theta[0]} * {theta[0]} * {self.gram()[0]})"
            return rows.selectExpr("*", f"ln{inner} AS _logdet", f"{theta[0]} * {theta[0]} / {inner} AS _k00")
        a, b, c = theta
        n, s1, s2 = self.gram()
        rows = rows.selectExpr(
            "*", f"1 + {a} * {a} * {n} + 2 * {a} * {b} * {s1} + {b} * {b} * {s2} AS _m00",
            f"{c} * ({a} * {s1} + {b} * {s2}) AS _m01", f"1 + {c} * {c} * {s2} AS _m11",
        ).selectExpr("*", "_m00 * _m11 - _m01 * _m01 AS _det")
        return rows.selectExpr(
            "*", "ln(_det) AS _logdet", f"{a} * {a} * _m11 / _det AS _k00",
            f"{a} * ({b} * _m11 - {c} * _m01) / _det AS _k01",
            f"({b} * {b} * _m11 - 2 * {b} * {c} * _m01 + {c} * {c} * _m00) / _det AS _k11",
        )

    def sums(self, thetas: Sequence[Sequence[float]]) -> dict[int, dict[str, float]]:
        """Likelihood sums for a batch of parameters: one aggregate, one row each."""
        q = len(thetas[0])
        cells = [", ".join([f"'i', {i}", *[f"'t{j}', {_number(v)}" for j, v in enumerate(t)]])
                 for i, t in enumerate(thetas)]
        grid = "array(" + ", ".join(f"named_struct({c})" for c in cells) + ")"
        names = [self.y, *self.fixed]
        rows = self.table.selectExpr("*", f"explode({grid}) AS _g")
        rows = self.with_solution(rows, [f"_g.t{j}" for j in range(q)])
        size = 2 if self.slope else 1
        randoms = {c: self.random_cross(c) for c in names}
        aggregates = [F.expr("sum(_logdet)").alias("logdet")]
        for a, b in itertools.combinations_with_replacement(names, 2):
            within = " + ".join(
                f"{randoms[a][i]} * _k{min(i, j)}{max(i, j)} * {randoms[b][j]}"
                for i in range(size) for j in range(size)
            )
            aggregates.append(F.expr(f"sum({self.cross(a, b)} - ({within}))").alias(_name(a, b)))
        out = rows.groupBy(F.expr("_g.i").alias("i")).agg(*aggregates).collect()  # one row per parameter
        return {r["i"]: r.asDict() for r in out}

    def profile(self, sums: dict[str, float]):
        """Deviance, coefficients and covariance from the sums of one parameter."""
        p = len(self.fixed)
        a = np.empty((p, p))
        for (i, u), (j, v) in itertools.combinations_with_replacement(list(enumerate(self.fixed)), 2):
            a[i, j] = a[j, i] = sums[_name(u, v)]
        b = np.array([sums[_name(self.y, u)] for u in self.fixed])
        try:
            beta, inverse = np.linalg.solve(a, b), np.linalg.inv(a)
        except np.linalg.LinAlgError:  # so far out that the intercept's share is lost to rounding
            return math.inf, np.full(p, np.nan), np.full((p, p), np.nan), math.nan
        dof = self.n_rows - p
        rss = max(sums[_name(self.y, self.y)] - float(b @ beta), 1e-300)
        logdet_a = float(np.linalg.slogdet(a)[1])
        deviance = sums["logdet"] + logdet_a + dof * (1 + math.log(2 * math.pi * rss / dof))
        return deviance, beta, inverse * rss / dof, rss / dof

    def evaluate(self, thetas: Sequence[Sequence[float]]):
        found = self.sums(thetas)
        return [self.profile(found[i]) for i in range(len(thetas))]

    def finish(self, theta: Sequence[float], converged: bool = True) -> MixedFit:
        deviance, beta, cov, sigma2 = self.evaluate([theta])[0]
        back = np.eye(len(beta))
        back[0, 1:] = [-self.means[x] for x in self.xs]
        original = back @ beta
        original[0] += self.means[self.y]
        return MixedFit([INTERCEPT, *self.xs], original, back @ cov @ back.T, tuple(map(float, theta)),
                        sigma2, deviance, self.n_rows, self.means, beta, converged)


def reml_deviance(df: DataFrame, subject: str, y: str, xs: Sequence[str],
                  thetas: Sequence[float]) -> list[tuple[float, float]]:
    """Restricted deviance of the random-intercept model at given parameters."""
    table = SubjectTable(df, subject, y, xs, None)
    return [(t, r[0]) for t, r in zip(thetas, table.evaluate([[t] for t in thetas]))]


def fit_random_intercept(df: DataFrame, subject: str, y: str, xs: Sequence[str],
                         tol: float = 1e-6) -> tuple[MixedFit, SubjectTable]:
    """Random-intercept model: grids of the single parameter, narrowed around the best.

    While the last point is the best, the grid goes on beyond it.  A deviance that
    still falls at 1e12 has no minimum that numbers can show: ``converged`` is false.
    """
    table = SubjectTable(df, subject, y, xs, None)
    grid = [0.0, *np.geomspace(1e-3, 1e3, 24)]
    while True:
        dev = [r[0] for r in table.evaluate([[t] for t in grid])]
        if int(np.argmin(dev)) < len(grid) - 1:
            break
        if grid[-1] >= 1e12:
            return table.finish([grid[int(np.argmin(dev))]], False), table
        grid = [grid[-2], *np.geomspace(grid[-1], grid[-1] * 1e3, 24)]
    while True:
        dev = [r[0] for r in table.evaluate([[t] for t in grid])]
        best = int(np.argmin(dev))
        low, high = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
        if high - low <= tol * max(1.0, grid[best]):
            break
        grid = list(np.linspace(low, high, 25))
    return table.finish([grid[best]]), table


def fit_random_slope(df: DataFrame, subject: str, y: str, xs: Sequence[str], slope: str,
                     rounds: int = 200, tol: float = 1e-7) -> tuple[MixedFit, SubjectTable]:
    """Random intercept and slope.

    Every round evaluates, in one aggregate, finite-difference stencils around
    several step lengths of the last Newton step, keeps the best and steps on until
    neither step nor gain is above its tolerance; ``converged`` tells whether that
    was reached within ``rounds``.
    """
    table = SubjectTable(df, subject, y, xs, slope)
    # start: best of a coarse grid of standard-deviation ratios
    coarse = [(a, b * math.sqrt(a * c), c) for a in (0.1, 0.4, 1.0, 3.0, 10.0)
              for c in (0.03, 0.1, 0.4, 1.0, 3.0) for b in (0.0,)]
    dev = [r[0] for r in table.evaluate(coarse)]
    center, value = np.array(coarse[int(np.argmin(dev))]), min(dev)
    steps = [np.zeros(3)]
    axes = np.eye(3)
    cross = list(itertools.combinations(range(3), 2))
    radius, converged = 0.3, False
    for _ in range(rounds):
        h = np.maximum(np.abs(center), 0.02) * min(1e-2, max(radius * 0.05, 1e-4))
        points, owners = [], []
        for c, step in enumerate(steps):
            at = center + step
            stencil = [at] + [at + s * h * axes[i] for i in range(3) for s in (1, -1)]
            stencil += [at + h * (axes[i] + axes[j]) for i, j in cross]
            points += stencil
            owners += [c] * len(stencil)
        dev = np.array([r[0] for r in table.evaluate([tuple(p) for p in points])])
        width = 7 + len(cross)
        heads = dev[::width]
        best = int(np.argmin(heads))
        gained = value - heads[best]
        center, value = center + steps[best], float(heads[best])
        block = dev[best * width:(best + 1) * width]
        f0, plus, minus, both = block[0], block[1:7:2], block[2:7:2], block[7:]
        grad = (plus - minus) / (2 * h)
        hess = np.diag((plus - 2 * f0 + minus) / h**2)
        for (i, j), f in zip(cross, both):
            hess[i, j] = hess[j, i] = (f - plus[i] - plus[j] + f0) / (h[i] * h[j])
        vals, vecs = np.linalg.eigh(hess)
        newton = -vecs @ ((vecs.T @ grad) / np.maximum(np.abs(vals), 1e-8 * max(1.0, np.abs(vals).max())))
        size = float(np.abs(newton).max())
        if len(steps) > 1 and size < 1e-4 * max(1.0, np.abs(center).max()) and abs(gained) < tol:
            converged = True
            break
        limit = min(1.0, 2.0 * max(np.abs(center).max(), 0.1) / max(size, 1e-300))
        newton = newton * limit
        radius = max(min(0.3, size), 1e-3)
        downhill = -grad * (np.abs(newton).max() / max(np.abs(grad).max(), 1e-300))
        steps = [np.zeros(3), newton, 0.5 * newton, 0.1 * newton, 0.3 * downhill]
    theta = center.copy()
    theta[0], theta[1] = (theta[0], theta[1]) if theta[0] >= 0 else (-theta[0], -theta[1])
    theta[2] = abs(theta[2])
    return table.finish(tuple(theta), converged), table


def predicted_deviations(fit: MixedFit, table: SubjectTable) -> DataFrame:
    """Each subject's predicted deviation from the fixed effects (best linear prediction).

    Columns: subject, intercept_dev and, with a random slope, slope_dev and the
    subject's total slope.
    """
    rows = table.with_solution(table.table, [_number(t) for t in fit.theta])
    fixed = {c: table.random_cross(c) for c in table.fixed}
    residual = [
        f"({zy} - (" + " + ".join(f"{_number(b)} * {fixed[c][i]}" for c, b in zip(table.fixed, fit.beta_centered)) + "))"
        for i, zy in enumerate(table.random_cross(table.y))
    ]
    if not table.slope:
        return rows.selectExpr(table.subject, f"_k00 * {residual[0]} AS intercept_dev")
    total = _number(fit.beta[fit.terms.index(table.slope)])
    return rows.selectExpr(
        table.subject, f"_k00 * {residual[0]} + _k01 * {residual[1]} AS intercept_dev",
        f"_k01 * {residual[0]} + _k11 * {residual[1]} AS slope_dev",
    ).selectExpr("*", f"slope_dev + {total} AS slope_total")
