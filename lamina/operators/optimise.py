"""Bounded derivative-free minimisation on the driver: a projected simplex with restarts, then a quadratic polish."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class Minimum:
    x: np.ndarray
    value: float
    converged: bool
    evaluations: int


def golden(fun: Callable[[float], float], low: float, high: float, tol: float = 1e-10) -> tuple[float, float]:
    """Golden-section search of a unimodal function."""
    ratio = (5**0.5 - 1) / 2
    a, b = low, high
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = fun(c), fun(d)
    while b - a > tol * (abs(a) + abs(b) + 1e-6):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = fun(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = fun(d)
    return (a + b) / 2, min(fc, fd)


def _simplex(fun, x0, step, low, high, tol, limit):
    n = len(x0)
    points = [x0] + [np.clip(x0 + step[i] * np.eye(n)[i], low, high) for i in range(n)]
    for i in range(n):
        if points[i + 1][i] == x0[i]:
            points[i + 1] = np.clip(x0 - step[i] * np.eye(n)[i], low, high)
    values = [fun(x) for x in points]
    used = n + 1
    while used < limit:
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        spread = max(np.abs(p - points[0]).max() for p in points)
        if spread <= 1e-9 or spread <= 1e-5 and values[-1] - values[0] <= tol * (abs(values[0]) + 1):
            break
        centre = np.mean(points[:-1], 0)

        def at(scale):
            x = np.clip(centre + scale * (centre - points[-1]), low, high)  # noqa: B023
            return x, fun(x)

        x, f = at(1.0)
        used += 1
        if f < values[0]:
            x2, f2 = at(2.0)
            used += 1
            points[-1], values[-1] = (x2, f2) if f2 < f else (x, f)
        elif f < values[-2]:
            points[-1], values[-1] = x, f
        else:
            x2, f2 = at(0.5 if f < values[-1] else -0.5)
            used += 1
            if f2 < min(f, values[-1]):
                points[-1], values[-1] = x2, f2
            else:
                points = [points[0]] + [(points[0] + p) / 2 for p in points[1:]]
                values = [values[0]] + [fun(p) for p in points[1:]]
                used += n
    best = int(np.argmin(values))
    return points[best], values[best], used


def minimise(fun: Callable[[np.ndarray], float], start: np.ndarray, bounds: list[tuple[float, float]], tol: float = 1e-13, limit: int = 5000) -> Minimum:
    """The simplex from ``start``, restarted around its own result until that no longer improves; bounds by projection."""
    low, high = np.array([b[0] for b in bounds]), np.array([b[1] for b in bounds])
    x = np.clip(np.asarray(start, float), low, high)
    value, used, step = fun(x), 1, np.full(len(x), 0.3)
    for _ in range(12):
        found, f, more = _simplex(fun, x, step, low, high, tol, limit - used)
        used += more
        gain, moved = value - f, np.abs(found - x).max()
        if f <= value:
            x, value = found, f
        if gain <= 1e-10 * (abs(value) + 1) and moved <= 1e-6:
            break
        step = np.maximum(0.05, step / 3)
    # parameters that may sit on a bound are tried there
    for i in range(len(x)):
        if np.isfinite(low[i]) and 0 < x[i] - low[i] < 1e-4:
            edge = x.copy()
            edge[i] = low[i]
            if (f := fun(edge)) <= value + 1e-12 * abs(value):
                x, value = edge, f
    return Minimum(x, value, used < limit, used)


def quasi_newton(fun: Callable[[np.ndarray], float], start: np.ndarray, bounds: list[tuple[float, float]], tol: float = 1e-10, limit: int = 5000) -> Minimum:
    """Projected BFGS with central differences: steps are cut back to the bounds and shortened until they gain."""
    low, high = np.array([b[0] for b in bounds]), np.array([b[1] for b in bounds])
    x = np.clip(np.asarray(start, float), low, high)
    value, used, inverse = fun(x), 1, np.eye(len(x))

    def slope(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for i in range(len(x)):
            h = 1e-6 * max(1.0, abs(x[i]))
            up, down = x.copy(), x.copy()
            up[i], down[i] = min(high[i], x[i] + h), max(low[i], x[i] - h)
            out[i] = (fun(up) - fun(down)) / (up[i] - down[i])
        return out

    grad, converged = slope(x), False
    used += 2 * len(x)
    while used < limit:
        free = ~(((x <= low) & (grad > 0)) | ((x >= high) & (grad < 0)))
        if not free.any() or np.abs(grad[free]).max() <= 1e-6 * (abs(value) + 1) * 1e-2:
            converged = True
            break
        move = np.where(free, -(inverse @ np.where(free, grad, 0)), 0)
        if move @ grad >= 0:
            inverse, move = np.eye(len(x)), np.where(free, -grad, 0)
        step = 1.0
        while step > 1e-12:
            new = np.clip(x + step * move, low, high)
            after = fun(new)
            used += 1
            if after <= value + 1e-4 * (grad @ (new - x)):
                break
            step /= 2
        else:
            converged = True  # no gain along the best direction
            break
        new_grad = slope(new)
        used += 2 * len(x)
        s, y = new - x, new_grad - grad
        gain, x, value, grad = value - after, new, after, new_grad
        if s @ y > 1e-12:
            rho, eye = 1 / (s @ y), np.eye(len(x))
            inverse = (eye - rho * np.outer(s, y)) @ inverse @ (eye - rho * np.outer(y, s)) + rho * np.outer(s, s)
        if gain <= tol * (abs(value) + 1):
            converged = True
            break
    return Minimum(x, value, converged, used)


def coordinates(fun: Callable[[np.ndarray], float], start: np.ndarray, bounds: list[tuple[float, float]], tol: float = 1e-10, limit: int = 5000) -> Minimum:
    """One parameter after the other by golden section in a bracket that shrinks from round to round."""
    low, high = np.array([b[0] for b in bounds]), np.array([b[1] for b in bounds])
    x = np.clip(np.asarray(start, float), low, high)
    calls = [0]

    def counted(at: np.ndarray) -> float:
        calls[0] += 1
        return fun(at)

    value, reach, converged = counted(x), np.full(len(x), 1.0), False
    while calls[0] < limit:
        before, moved = value, 0.0
        for i in range(len(x)):
            def along(v: float, i: int = i) -> float:
                at = x.copy()
                at[i] = v
                return counted(at)

            v, f = golden(along, max(low[i], x[i] - reach[i]), min(high[i], x[i] + reach[i]), 1e-9)
            if f < value:
                moved = max(moved, abs(v - x[i]))
                reach[i] = max(4 * abs(v - x[i]), 1e-4)
                x, value = np.where(np.arange(len(x)) == i, v, x), f
            else:
                reach[i] = max(reach[i] / 2, 1e-4)
        if before - value <= tol * (abs(value) + 1) and moved <= 1e-5:
            converged = True
            break
    return Minimum(x, value, converged, calls[0])


#: Optimisers by name; each takes a function, a start, bounds, a tolerance and a limit of evaluations.
OPTIMISERS: dict[str, Callable[..., Minimum]] = {"simplex": minimise, "quasi_newton": quasi_newton, "coordinates": coordinates}


def available() -> list[str]:
    return sorted(OPTIMISERS)


def run(fun: Callable[[np.ndarray], float], start: np.ndarray, bounds: list[tuple[float, float]], method: str = "simplex", **options) -> Minimum:
    if method not in OPTIMISERS:
        raise ValueError(f"unknown optimiser {method!r}; known: {', '.join(available())}")
    return OPTIMISERS[method](fun, start, bounds, **options)
