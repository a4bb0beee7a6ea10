"""Optimisers without SciPy: Brent, Nelder-Mead, projected L-BFGS, SQUAREM."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np

GOLD = (3 - math.sqrt(5)) / 2


def brent(f: Callable[[float], float], low: float, high: float, tol: float = 1e-6, steps: int = 100, start: float | None = None) -> tuple[float, float]:
    """Place and value of a minimum in [low, high]: parabolas where they help, else golden sections."""
    x = w = v = start if start is not None and low < start < high else low + GOLD * (high - low)
    fx = fw = fv = f(x)
    d = e = 0.0
    for _ in range(steps):
        mid, t = (low + high) / 2, tol * abs(x) + 1e-12
        if abs(x - mid) <= 2 * t - (high - low) / 2:
            break
        parabola = False
        if abs(e) > t:
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p, q = (x - v) * q - (x - w) * r, 2 * (q - r)
            p, q = (-p, q) if q > 0 else (p, -q)
            if abs(p) < abs(q * e / 2) and q * (low - x) < p < q * (high - x):
                e, d, parabola = d, p / q, True
        if not parabola:
            e = (high if x < mid else low) - x
            d = GOLD * e
        u = x + (d if abs(d) >= t else math.copysign(t, d))
        fu = f(u)
        if fu <= fx:
            low, high = (x, high) if u >= x else (low, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            low, high = (u, high) if u < x else (low, u)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x, fx


def nelder_mead(f: Callable[[np.ndarray], float], start: Sequence[float], low: Sequence[float], high: Sequence[float], tol: float = 1e-4, steps: int = 100) -> tuple[np.ndarray, float]:
    """Minimum within a box; points outside are moved to its border."""
    low, high = np.asarray(low, float), np.asarray(high, float)
    box = lambda x: np.minimum(np.maximum(x, low), high)
    points = [box(np.asarray(start, float))]
    for k in range(len(points[0])):
        p = points[0].copy()
        p[k] = p[k] * 1.25 + 0.05 if p[k] * 1.25 + 0.05 <= high[k] else p[k] * 0.75
        points.append(box(p))
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        points, values = [points[k] for k in order], [values[k] for k in order]
        if abs(values[-1] - values[0]) < tol * 1e-2 and max(np.abs(p - points[0]).max() for p in points[1:]) < tol * (1 + np.abs(points[0]).max()):
            break
        centre = np.mean(points[:-1], axis=0)
        at = lambda s: box(centre + s * (centre - points[-1]))
        x = at(1.0)
        fx = f(x)
        if fx < values[0]:
            y = at(2.0)
            fy = f(y)
            x, fx = (y, fy) if fy < fx else (x, fx)
        elif fx >= values[-2]:
            y = at(0.5 if fx < values[-1] else -0.5)
            fy = f(y)
            if fy < min(fx, values[-1]):
                x, fx = y, fy
            else:
                points = [points[0], *(box(points[0] + 0.5 * (p - points[0])) for p in points[1:])]
                values = [values[0], *(f(p) for p in points[1:])]
                continue
        points[-1], values[-1] = x, fx
    k = int(np.argmin(values))
    return points[k], values[k]


def gradient(f: Callable[[np.ndarray], float], x: np.ndarray, fx: float, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.empty(len(x))
    for k in range(len(x)):
        step = 1e-6 * max(1.0, abs(x[k]))
        step = -step if x[k] + step > high[k] else step
        y = x.copy()
        y[k] += step
        out[k] = (f(y) - fx) / step
    return out


def lbfgs(f: Callable[[np.ndarray], float], start: Sequence[float], low: Sequence[float], high: Sequence[float], *, grad: Callable[[np.ndarray], np.ndarray] | None = None, steps: int = 200, tol: float = 1e-7, memory: int = 12) -> tuple[np.ndarray, float]:
    """Projected L-BFGS: a quasi-Newton direction among the variables off their bounds, backtracking along the projected line."""
    low, high = np.asarray(low, float), np.asarray(high, float)
    x = np.clip(np.asarray(start, float), low, high)
    fx = f(x)
    slope = grad or (lambda y: gradient(f, y, f(y), low, high))
    g = slope(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        free = ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)))
        if not free.any() or np.abs(g[free]).max() < 1e-8 * max(1.0, abs(fx)):
            break
        d = np.where(free, g, 0.0)
        stack = []
        for s, y, rho in reversed(pairs):
            a = rho * (s @ d)
            d = d - a * y
            stack.append(a)
        if pairs:
            s, y, _ = pairs[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y, rho), a in zip(pairs, reversed(stack), strict=True):
            d = d + s * (a - rho * (y @ d))
        d = -np.where(free, d, 0.0)
        if d @ g >= 0:
            d, pairs = -np.where(free, g, 0.0), []
        rate = 1.0 if pairs else min(1.0, 1 / max(1e-12, np.abs(d).sum()))
        for _ in range(40):
            z = np.clip(x + rate * d, low, high)
            fz = f(z)
            if fz <= fx + 1e-4 * (g @ (z - x)):
                break
            rate /= 2
        else:
            if not pairs:
                break
            pairs = []
            continue
        gz = slope(z)
        s, y = z - x, gz - g
        if s @ y > 1e-12:
            pairs = [*pairs[-memory + 1 :], (s, y, 1 / (s @ y))]
        done = fx - fz < tol * max(1.0, abs(fz)) * 1e-2
        x, fx, g = z, fz, gz
        if done:
            break
    return x, fx


def squarem(update: Callable[[np.ndarray], np.ndarray], start: np.ndarray, value: Callable[[np.ndarray], float], steps: int = 500, tol: float = 1e-8) -> np.ndarray:
    """Squared extrapolation of a fixed-point map whose fixed point maximises `value`."""
    x = start
    for _ in range(steps):
        one = update(x)
        two = update(one)
        r, v = one - x, two - one - (one - x)
        if np.abs(r).sum() < tol:
            return two
        size = np.linalg.norm(v)
        a = min(-1.0, -np.linalg.norm(r) / size) if size > 0 else -1.0
        y = x - 2 * a * r + a * a * v
        if (y < 0).any() or value(y := y / y.sum() if abs(x.sum() - 1) < 1e-9 else y) < value(two):
            y = two
        x = update(y)
    return x
