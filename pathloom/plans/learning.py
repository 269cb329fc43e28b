"""Parameter learning by expectation maximisation.

Each iteration matches all trajectories at once and brings one row of sums to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.model import ExponentialMapMatchingModel
from pathloom.plans import engine
from pathloom.plans.matching import per_trajectory, smooth

SUMS = "traj_id long, status string, n double, g_r0 double, g_lambda double, g_beta double, sq double, n_sq double, d array<double>, dt array<double>"
NAMES = ("zero_dist_prob_neg_exponent", "lambda_speed", "deviation_beta", "gps_sd")


def statistics(obs: DataFrame, table: DataFrame, model: ExponentialMapMatchingModel, particles: int, seed, refine: float, reach=None, distances: bool = False) -> DataFrame:
    """The E-step: for each trajectory its gradient sums and squared residuals; status names failures, which are left out later."""

    def work(net, pdf):
        traj = pdf["traj_id"].iloc[0]
        none = {"traj_id": traj, "n": 0.0, "g_r0": 0.0, "g_lambda": 0.0, "g_beta": 0.0, "sq": 0.0, "n_sq": 0.0, "d": [], "dt": []}
        try:
            drawn, steps, _ = smooth(net, model, pdf, particles, seed, 1.0, reach, gradients=True)
        except engine.MatchFailed as why:
            return pd.DataFrame([none | {"status": str(why)}])
        sums, all_d, all_dt = np.zeros(3), [], []
        for before, now in zip(drawn[:-1], drawn[1:]):
            g = model.prior_values(now.d, now.dt)
            dev = np.abs(np.hypot(now.x - before.x, now.y - before.y) - now.d)
            slope = model.prior_slopes(now.d, now.dt) / g
            mean = before.slopes / np.maximum(before.z, engine.FLOOR)[:, None]
            sums += [(slope[0] - mean[:, 0]).sum(), (slope[1] - mean[:, 1]).sum(), (-dev - mean[:, 2]).sum()]
            if distances:
                all_d += now.d.tolist()
                all_dt += [now.dt] * len(now.d)
        square = sum(((s.x - ox) ** 2 + (s.y - oy) ** 2).sum() for s, ox, oy in zip(drawn, pdf["x"], pdf["y"]))
        many = float(sum(len(s.x) for s in drawn))
        return pd.DataFrame([none | {"status": "OK", "n": float(particles), "g_r0": sums[0], "g_lambda": sums[1], "g_beta": sums[2], "sq": float(square), "n_sq": many, "d": all_d, "dt": all_dt}])

    return per_trajectory(obs, table, work, SUMS, refine, model)


def totals_of(stats: DataFrame, particles: int) -> dict[str, float]:
    """One row of sums over the matched trajectories."""
    row = stats.where("status = 'OK'").agg(
        F.count("*").alias("matched"), *[(F.sum(c) / particles).alias(c) for c in ("g_r0", "g_lambda", "g_beta")], (F.sum("sq") / F.sum("n_sq")).alias("mean_sq")
    )
    return {k: v or 0.0 for k, v in row.first().asDict().items()}


def _clamped(name: str, value: float) -> float:
    low, high = ExponentialMapMatchingModel.bounds()[name]
    return min(max(value, low), high)


def gradient_step(model: ExponentialMapMatchingModel, totals: dict[str, float], step: float) -> ExponentialMapMatchingModel:
    """The M-step by one gradient step, and the closed form of the noise."""
    moved = dict(zip(NAMES[:3], (model.zero_dist_prob_neg_exponent + step * totals["g_r0"], model.lambda_speed + step * totals["g_lambda"], model.deviation_beta + step * totals["g_beta"])))
    moved["gps_sd"] = math.sqrt(totals["mean_sq"] / 2)
    return model.with_parameters(**{k: _clamped(k, v) for k, v in moved.items()})


def distance_likelihood(stats: DataFrame, pairs: list[tuple[float, float]]) -> list[float]:
    """The log-likelihood of all drawn distances for each (exponent, rate), in one aggregation."""
    each = stats.where("status = 'OK'").select(F.explode(F.arrays_zip("d", "dt")).alias("z")).select("z.d", "z.dt")
    out = each.agg(*[F.sum(F.log(ExponentialMapMatchingModel(zero_dist_prob_neg_exponent=r, lambda_speed=s).distance_prior(F.col("d"), F.col("dt")))).alias(f"l{i}") for i, (r, s) in enumerate(pairs)])
    return [v if v is not None else -math.inf for v in out.first()]


def optimised(model: ExponentialMapMatchingModel, stats: DataFrame, totals: dict[str, float], rounds: int = 6) -> ExponentialMapMatchingModel:
    """The M-step without a deviation prior: bounded maximisation of the distances' likelihood, by a grid
    around the best parameters that shrinks each round."""
    low, high = ExponentialMapMatchingModel.bounds()["zero_dist_prob_neg_exponent"]
    best, wide = (model.zero_dist_prob_neg_exponent, model.lambda_speed), 2.0
    for _ in range(rounds):
        factors = [wide**p for p in (-1, -0.5, 0, 0.5, 1)]
        pairs = [(min(max(best[0] * f, low), high), max(best[1] * g, 1e-20)) for f in factors for g in factors]
        values = distance_likelihood(stats, pairs)
        best, wide = pairs[int(np.argmax(values))], wide**0.6
    return model.with_parameters(zero_dist_prob_neg_exponent=best[0], lambda_speed=best[1], gps_sd=max(1e-9, math.sqrt(totals["mean_sq"] / 2)))


def offline_em(obs: DataFrame, table: DataFrame, model: ExponentialMapMatchingModel, iterations: int = 10, particles: int = 100, scale: float = 1e-3, exponent: float = 0.5, seed: int = 0, refine: float = 1.0, reach=None, use_deviation: bool = True, save_path: str | None = None) -> tuple[ExponentialMapMatchingModel, list[dict]]:
    """The learned model and the trace of its parameters, one dict for each iteration from 0 on. With
    `save_path` the trace is written there, as JSON, in each iteration."""
    spark = obs.sparkSession
    model = model if use_deviation else model.with_parameters(deviation_beta=0.0)
    trace = [{"iteration": 0} | {n: float(getattr(model, n)) for n in NAMES}]
    for i in range(iterations):
        stats = statistics(obs, table, model, particles, f"{seed}-{i}", refine, reach, not use_deviation).persist()
        totals = totals_of(stats, particles)
        if totals["matched"]:
            model = gradient_step(model, totals, scale / (i + 1) ** exponent) if use_deviation else optimised(model, stats, totals)
        stats.unpersist()
        trace.append({"iteration": i + 1} | {n: float(getattr(model, n)) for n in NAMES})
        if save_path:
            spark.createDataFrame(trace).coalesce(1).write.mode("overwrite").json(save_path)
    return model, trace
