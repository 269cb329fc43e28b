"""State-space models as immutable settings that emit Column expressions, and their values as arrays for the numpy engine.

A law of one's own for distances is a subclass with both forms of its prior: `distance_prior` and what goes with it for
plans, `prior_values` for matching, replays and streams, and `prior_slopes` for learning.
"""

from __future__ import annotations

import abc
import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distances up to ZERO count as no movement; weights below FLOOR count as none.
ZERO, FLOOR = 1e-5, 1e-100
#: The clamp on the probability of not moving.
MIN_ZERO_PROB, MAX_ZERO_PROB = 0.01, 0.5


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


@dataclass(frozen=True)
class MapMatchingModel(abc.ABC):
    """What every model has: Gaussian observation noise, a deviation prior and a greatest speed."""

    gps_sd: float | None = None
    deviation_beta: float | None = None
    likelihood_d_truncate: float = math.inf
    max_speed: float = 35.0

    def d_max(self, dt) -> Column:
        """The farthest a vehicle gets in an interval."""
        return F.lit(float(self.max_speed)) * _c(dt)

    def deviation_prior(self, px: Column, py: Column, x: Column, y: Column, d: Column) -> Column:
        """exp(-beta * |straight line - route|), one for beta 0."""
        if not self.deviation_beta:
            return F.lit(1.0)
        return F.exp(-F.lit(float(self.deviation_beta)) * F.abs(F.hypot(x - px, y - py) - d))

    def likelihood(self, x: Column, y: Column, ox: Column, oy: Column) -> Column:
        """The unnormalised Gaussian density of an observation, cut off if the model says so."""
        square = (x - ox) * (x - ox) + (y - oy) * (y - oy)
        value = F.exp(F.lit(-0.5 / self.gps_sd**2) * square)
        if math.isinf(self.likelihood_d_truncate):
            return value
        return F.when(square < F.lit(float(self.likelihood_d_truncate) ** 2), value).otherwise(F.lit(0.0))

    def deviation_values(self, px, py, x: np.ndarray, y: np.ndarray, d: np.ndarray) -> np.ndarray:
        """`deviation_prior` of arrays."""
        return np.exp(-(self.deviation_beta or 0.0) * np.abs(np.hypot(x - px, y - py) - d))

    def likelihood_values(self, x: np.ndarray, y: np.ndarray, ox, oy) -> np.ndarray:
        """`likelihood` of arrays."""
        square = (x - ox) ** 2 + (y - oy) ** 2
        out = np.exp(-0.5 * square / self.gps_sd**2)
        return out if math.isinf(self.likelihood_d_truncate) else out * (square < self.likelihood_d_truncate**2)

    def with_parameters(self, **values) -> MapMatchingModel:
        return replace(self, **values)

    @abc.abstractmethod
    def distance_prior(self, d: Column, dt) -> Column: ...

    @abc.abstractmethod
    def prior_values(self, d: np.ndarray, dt: float) -> np.ndarray:
        """`distance_prior` of an array of distances."""

    def prior_slopes(self, d: np.ndarray, dt: float) -> np.ndarray:
        """Two rows, the prior's gradients by the two parameters that learning fits; only learning asks for them."""
        raise NotImplementedError(f"{type(self).__name__} has no prior_slopes, so it can't be learned")

    @abc.abstractmethod
    def distance_prior_gradient(self, d: Column, dt) -> dict[str, Column]: ...

    @abc.abstractmethod
    def pos_distance_prior_bound(self, dt) -> Column: ...

    @abc.abstractmethod
    def distance_prior_bound(self, dt) -> Column: ...


@dataclass(frozen=True)
class ExponentialMapMatchingModel(MapMatchingModel):
    """No movement with probability exp(-r0 * dt), else exponential distances over the interval."""

    gps_sd: float = 5.23
    deviation_beta: float = 0.052
    zero_dist_prob_neg_exponent: float = 0.133
    lambda_speed: float = 0.068

    @staticmethod
    def bounds(dt: float = 15.0) -> dict[str, tuple[float, float]]:
        """Where each parameter may lie: r0 so that the clamp holds at 15 s."""
        return {
            "zero_dist_prob_neg_exponent": (-math.log(MAX_ZERO_PROB) / dt, -math.log(MIN_ZERO_PROB) / dt),
            "lambda_speed": (1e-20, math.inf),
            "deviation_beta": (0.0, math.inf),
            "gps_sd": (0.0, math.inf),
        }

    def zero_dist_prob(self, dt) -> Column:
        return F.least(F.lit(MAX_ZERO_PROB), F.greatest(F.lit(MIN_ZERO_PROB), F.exp(-F.lit(float(self.zero_dist_prob_neg_exponent)) * _c(dt))))

    def _zero_prob(self, dt: float) -> float:
        return min(max(math.exp(-self.zero_dist_prob_neg_exponent * dt), MIN_ZERO_PROB), MAX_ZERO_PROB)

    def prior_values(self, d: np.ndarray, dt: float) -> np.ndarray:
        p = self._zero_prob(dt)
        return np.where(d > ZERO, (1 - p) * self.lambda_speed * np.exp(-self.lambda_speed * d / dt) / dt, p)

    def prior_slopes(self, d: np.ndarray, dt: float) -> np.ndarray:
        """By the exponent of not moving, and by the speed's rate."""
        p = self._zero_prob(dt)
        fade = np.exp(-self.lambda_speed * d / dt)
        moved = d > ZERO
        return np.stack([p * np.where(moved, self.lambda_speed * fade, -dt), np.where(moved, (1 - p) * fade / dt * (1 - self.lambda_speed * d / dt), 0.0)])

    def distance_prior(self, d: Column, dt) -> Column:
        rate = F.lit(float(self.lambda_speed))
        moved = (1 - self.zero_dist_prob(dt)) * rate * F.exp(-rate * d / _c(dt)) / _c(dt)
        wrong = F.raise_error(F.lit("negative route distance")).cast("double")
        return F.when(d < -ZERO, wrong).when(d > ZERO, moved).otherwise(self.zero_dist_prob(dt))

    def distance_prior_gradient(self, d: Column, dt) -> dict[str, Column]:
        rate, p = F.lit(float(self.lambda_speed)), self.zero_dist_prob(dt)
        fade = F.exp(-rate * d / _c(dt))
        return {
            "zero_dist_prob_neg_exponent": F.when(d > ZERO, p * rate * fade).otherwise(-p * _c(dt)),
            "lambda_speed": F.when(d > ZERO, (1 - p) * fade / _c(dt) * (1 - rate * d / _c(dt))).otherwise(F.lit(0.0)),
        }

    def pos_distance_prior_bound(self, dt) -> Column:
        return (1 - self.zero_dist_prob(dt)) * F.lit(float(self.lambda_speed)) / _c(dt)

    def distance_prior_bound(self, dt) -> Column:
        return F.greatest(self.zero_dist_prob(dt), self.pos_distance_prior_bound(dt))
