"""Small numeric pieces: matrix exponential, seeded draws, automatic differentiation, options, parameters with bounds, property distance."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from clademill.model.codes import GeneticCode


def expm(a: np.ndarray, order: int = 8) -> np.ndarray:
    """exp of a square matrix: scaled until its norm is below a half, a diagonal Padé quotient, squared back."""
    norm = float(np.abs(a).sum(axis=1).max()) if a.size else 0.0
    halvings = max(0, math.ceil(math.log2(norm)) + 1) if norm > 0 else 0
    x = a / 2.0**halvings
    c, power = 1.0, np.eye(len(a))
    top, bottom = power.copy(), power.copy()
    for k in range(1, order + 1):
        c *= (order - k + 1) / (k * (2 * order - k + 1))
        power = power @ x
        top += c * power
        bottom += (-1) ** k * c * power
    out = np.linalg.solve(bottom, top)
    for _ in range(halvings):
        out = out @ out
    return out


@dataclass
class Draws:
    """Draws of one replicate: the same on any machine and in any order of replicates."""

    seed: int
    replicate: int = 0
    rng: np.random.Generator = field(init=False)

    def __post_init__(self) -> None:
        self.rng = np.random.default_rng([self.seed, self.replicate])

    def uniform(self) -> float:
        return float(self.rng.random())

    def integer(self, n: int) -> int:
        """0 .. n - 1."""
        return int(self.rng.integers(n))

    def normal(self, mean: float = 0.0, sd: float = 1.0) -> float:
        return float(self.rng.normal(mean, sd))

    def gamma(self, shape: float, scale: float = 1.0) -> float:
        return float(self.rng.gamma(shape, scale))


# Polarity, volume, charge and hydropathy of the amino acids.
PHYSICAL = {
    "A": (8.1, 31.0, 0.0, 1.8), "R": (10.5, 124.0, 1.0, -4.5), "N": (11.6, 56.0, 0.0, -3.5), "D": (13.0, 54.0, -1.0, -3.5), "C": (5.5, 55.0, 0.0, 2.5), "Q": (10.5, 85.0, 0.0, -3.5), "E": (12.3, 83.0, -1.0, -3.5),
    "G": (9.0, 3.0, 0.0, -0.4), "H": (10.4, 96.0, 0.5, -3.2), "I": (5.2, 111.0, 0.0, 4.5), "L": (4.9, 111.0, 0.0, 3.8), "K": (11.3, 119.0, 1.0, -3.9), "M": (5.7, 105.0, 0.0, 1.9), "F": (5.2, 132.0, 0.0, 2.8),
    "P": (8.0, 32.5, 0.0, -1.6), "S": (9.2, 32.0, 0.0, -0.8), "T": (8.6, 61.0, 0.0, -0.7), "W": (5.4, 170.0, 0.0, -0.9), "Y": (6.2, 136.0, 0.0, -1.3), "V": (5.9, 84.0, 0.0, 4.2),
}
#: The ranges by which their differences are scaled.
PHYSICAL_RANGES = (8.1, 167.0, 2.0, 9.0)


def physical_rows() -> list[tuple[str, str, float]]:
    """(a, b, distance) for all pairs: root mean square of scaled differences, at most 1; a dimension of 400 rows for a join."""
    return [(a, b, physical_distance(a, b)) for a in PHYSICAL for b in PHYSICAL]


def physical_distance(a: str, b: str) -> float:
    """0 for the same letter, 0.5 where one isn't an amino acid."""
    if a == b:
        return 0.0
    if a not in PHYSICAL or b not in PHYSICAL:
        return 0.5
    return min(1.0, math.sqrt(sum(((x - y) / r) ** 2 for x, y, r in zip(PHYSICAL[a], PHYSICAL[b], PHYSICAL_RANGES, strict=True)) / 4))


def parse_integer(option: str, text: str, low: int | None = None, high: int | None = None) -> int:
    """A whole number and nothing else, within bounds."""
    try:
        value = int(text.strip()) if text and not set(text) & {"_"} else None
    except ValueError:
        value = None
    if value is None or low is not None and value < low or high is not None and value > high:
        raise ValueError(f"invalid {option} value {text!r}: an integer{'' if low is None else f' in {low} .. {high}'} is expected")
    return value


def parse_number(option: str, text: str, low: float = -math.inf, high: float = math.inf) -> float:
    """A finite number and nothing else, within bounds."""
    try:
        value = float(text) if text and "_" not in text else math.nan
    except ValueError:
        value = math.nan
    if not math.isfinite(value) or not low <= value <= high:
        raise ValueError(f"invalid {option} value {text!r}: a finite number{'' if low == -math.inf else f' in {low} .. {high}'} is expected")
    return value


def parse_probability(option: str, text: str) -> float:
    return parse_number(option, text, 0.0, 1.0)


@dataclass
class Parameters:
    """Named parameters with bounds, some fixed and some tied to a function of others; free ones are a vector."""

    names: list[str] = field(default_factory=list)
    value: dict[str, float] = field(default_factory=dict)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    tied: dict[str, Callable[[dict[str, float]], float]] = field(default_factory=dict)
    fixed: set[str] = field(default_factory=set)

    def add(self, name: str, value: float, low: float = -math.inf, high: float = math.inf) -> Parameters:
        if name in self.value or not low <= value <= high:
            raise ValueError(f"parameter {name}")
        self.names.append(name)
        self.value[name], self.bounds[name] = value, (low, high)
        return self

    def tie(self, name: str, to: Callable[[dict[str, float]], float]) -> Parameters:
        self.tied[name] = to
        return self

    @property
    def free(self) -> list[str]:
        return [n for n in self.names if n not in self.fixed and n not in self.tied]

    def vector(self) -> np.ndarray:
        return np.array([self.value[n] for n in self.free])

    def put(self, x: np.ndarray) -> dict[str, float]:
        """All values for a vector of the free ones, kept within their bounds."""
        for n, v in zip(self.free, x, strict=True):
            self.value[n] = min(max(float(v), self.bounds[n][0]), self.bounds[n][1])
        for n, f in self.tied.items():
            self.value[n] = f(self.value)
        return dict(self.value)


class Var:
    """A number that remembers how it came about, for gradients by one pass backwards."""

    __slots__ = ("value", "grad", "parents")

    def __init__(self, value: float, parents: tuple[tuple[Var, float], ...] = ()) -> None:
        self.value, self.grad, self.parents = float(value), 0.0, parents

    @staticmethod
    def of(x: Var | float) -> Var:
        return x if isinstance(x, Var) else Var(x)

    def __add__(self, o):
        o = Var.of(o)
        return Var(self.value + o.value, ((self, 1.0), (o, 1.0)))

    def __neg__(self):
        return Var(-self.value, ((self, -1.0),))

    def __sub__(self, o):
        return self + -Var.of(o)

    def __rsub__(self, o):
        return Var.of(o) - self

    def __mul__(self, o):
        o = Var.of(o)
        return Var(self.value * o.value, ((self, o.value), (o, self.value)))

    def __truediv__(self, o):
        o = Var.of(o)
        return Var(self.value / o.value, ((self, 1 / o.value), (o, -self.value / o.value**2)))

    def __rtruediv__(self, o):
        return Var.of(o) / self

    def __pow__(self, o):
        o = Var.of(o)
        value = self.value**o.value
        own = o.value * self.value ** (o.value - 1) if o.value else 0.0
        return Var(value, ((self, own), *(((o, value * math.log(self.value)),) if self.value > 0 else ())))

    __radd__, __rmul__ = __add__, __mul__

    def exp(self):
        return Var(math.exp(self.value), ((self, math.exp(self.value)),))

    def log(self):
        return Var(math.log(self.value), ((self, 1 / self.value),))

    def sqrt(self):
        return Var(math.sqrt(self.value), ((self, 0.5 / math.sqrt(self.value)),))

    def backward(self) -> None:
        """Sets grad of all that this number depends on."""
        order: list[Var] = []
        seen: set[int] = set()
        stack = [(self, False)]
        while stack:
            v, done = stack.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                stack.append((v, True))
                stack.extend((p, False) for p, _ in v.parents)
        for v in order:
            v.grad = 0.0
        self.grad = 1.0
        for v in reversed(order):
            for parent, slope in v.parents:
                parent.grad += slope * v.grad


def adam(slope: Callable[[np.ndarray], np.ndarray], x: np.ndarray, steps: int = 500, rate: float = 0.05, decay: tuple[float, float] = (0.9, 0.999)) -> np.ndarray:
    """Descends along gradients whose means and squares are followed."""
    x, m, v = x.astype(float).copy(), np.zeros(len(x)), np.zeros(len(x))
    for k in range(1, steps + 1):
        g = slope(x)
        m, v = decay[0] * m + (1 - decay[0]) * g, decay[1] * v + (1 - decay[1]) * g * g
        x -= rate * (m / (1 - decay[0] ** k)) / (np.sqrt(v / (1 - decay[1] ** k)) + 1e-8)
    return x


def flux_shares(q: np.ndarray, pi: np.ndarray, genetic: GeneticCode) -> dict[str, float]:
    """Substitutions at equilibrium by how many places they change: rates of single, double and triple ones, and the shares of the last two."""
    sense = genetic.sense
    changes = np.array([[sum(x != y for x, y in zip(a, b, strict=True)) for b in sense] for a in sense])
    flux = pi[:, None] * q
    rates = [float(flux[changes == k].sum()) for k in (1, 2, 3)]
    total = sum(rates)
    return {"single": rates[0], "double": rates[1], "triple": rates[2], "total": total, "share_double": rates[1] / total if total > 1e-12 else 0.0, "share_triple": rates[2] / total if total > 1e-12 else 0.0}


def expcm(preferences: dict[str, float], phi: np.ndarray, kappa: float, omega: float, beta: float, genetic: GeneticCode) -> tuple[np.ndarray, np.ndarray]:
    """(Q, stationary shares) of the experimentally informed codon model of one site: a mutation from x to y fixes by ln(r) r / (r - 1)-like odds with r the ratio of preferences to the power beta, times omega
    if the amino acid changes. phi: mutation's base shares; kappa: transitions over transversions."""
    sense, amino = genetic.sense, genetic.aa
    base = {b: k for k, b in enumerate("ACGT")}
    n = len(sense)
    fit = np.array([max(preferences[a], 1e-12) ** beta for a in amino])
    stationary = fit * np.array([np.prod([phi[base[b]] for b in c]) for c in sense])
    q = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            places = [(a, b) for a, b in zip(sense[i], sense[j], strict=True) if a != b]
            if len(places) != 1:
                continue
            a, b = places[0]
            rate = phi[base[b]] * (kappa if {a, b} in ({"A", "G"}, {"C", "T"}) else 1.0)
            if amino[i] != amino[j]:
                r = math.log(fit[j] / fit[i])
                rate *= omega * (r / -math.expm1(-r) if abs(r) > 1e-9 else 1.0)
            q[i, j] = rate
    q[np.arange(n), np.arange(n)] = -q.sum(axis=1)
    return q, stationary / stationary.sum()
