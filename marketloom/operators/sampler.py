"""Search over parameters by a tree-structured Parzen estimator.

Past trials are split into the best ones and the rest. Each parameter gets two densities, mixtures of normal kernels around the
values of either part (cut off at the range's ends, on a logarithmic scale where the range asks for it) and a wide one in the middle.
Of some draws from the density of the good trials the one with the greatest ratio of the two is tried next.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from statistics import NormalDist

#: name -> (low, high, logarithmic); whole-number bounds give whole numbers.
Space = Mapping[str, tuple[float, float, bool]]
_UNIT = NormalDist()


class _Mixture:
    """Equal parts of normal kernels cut off at [0, 1]."""

    def __init__(self, points: Sequence[float]) -> None:
        marks = sorted([*points, 0.5])
        least = 1 / min(100, 1 + len(marks))
        self.kernels = []
        prior = False
        for i, m in enumerate(marks):
            if m == 0.5 and not prior:
                prior, width = True, 1.0
            else:
                gaps = [m - (marks[i - 1] if i else 0.0), (marks[i + 1] if i + 1 < len(marks) else 1.0) - m]
                width = min(1.0, max(least, *gaps))
            inside = _UNIT.cdf((1 - m) / width) - _UNIT.cdf(-m / width)
            self.kernels.append((m, width, inside))

    def density(self, x: float) -> float:
        return sum(_UNIT.pdf((x - m) / w) / (w * inside) for m, w, inside in self.kernels) / len(self.kernels)

    def draw(self, rng: random.Random) -> float:
        m, w, inside = rng.choice(self.kernels)
        u = _UNIT.cdf(-m / w) + rng.random() * inside
        return min(1.0, max(0.0, m + w * _UNIT.inv_cdf(min(max(u, 1e-12), 1 - 1e-12))))


def _unit(value: float, bounds: tuple[float, float, bool]) -> float:
    lo, hi, log = bounds
    return math.log(value / lo) / math.log(hi / lo) if log else (value - lo) / (hi - lo)


def _value(u: float, bounds: tuple[float, float, bool]) -> float:
    lo, hi, log = bounds
    v = lo * (hi / lo) ** u if log else lo + (hi - lo) * u
    return int(min(hi, max(lo, round(v)))) if isinstance(lo, int) and isinstance(hi, int) else v


def suggest(space: Space, trials: Sequence[tuple[Mapping[str, float], float]], seed: int = 42, startup: int = 10, draws: int = 24) -> dict[str, float]:
    """The parameters to try after `trials` (parameters, loss to be lowered); the same trials and seed give the same answer. The
    first `startup` ones are drawn evenly; trials with an undefined loss count as the worst."""
    rng = random.Random(f"{seed}-{len(trials)}")
    if len(trials) < startup:
        return {k: _value(rng.random(), b) for k, b in space.items()}
    ranked = sorted(trials, key=lambda t: math.inf if t[1] is None or math.isnan(t[1]) else t[1])
    good = min(25, math.ceil(len(ranked) / 10))
    out = {}
    for k, b in space.items():
        low, high = (_Mixture([_unit(t[0][k], b) for t in part]) for part in (ranked[:good], ranked[good:]))
        tried = [low.draw(rng) for _ in range(draws)]
        out[k] = _value(max(tried, key=lambda u: math.log(low.density(u)) - math.log(high.density(u))), b)
    return out


def minimise(space: Space, loss: Callable[[dict[str, float]], float], trials: int, seed: int = 42, startup: int = 10) -> list[tuple[dict[str, float], float]]:
    """All trials in their order."""
    done: list[tuple[dict[str, float], float]] = []
    for _ in range(trials):
        p = suggest(space, done, seed, startup)
        done.append((p, loss(p)))
    return done
