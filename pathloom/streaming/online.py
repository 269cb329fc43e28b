"""Online matching as a stream: one keyed state for each trajectory.

State holds the filter's last steps and the trajectories of the last lag + 1 observations;
older rows are final and leave with the micro-batch. Within a micro-batch observations are
taken in order; those not later than the last one taken are dropped and counted.
"""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame

from pathloom.functions.model import MapMatchingModel
from pathloom.plans import engine
from pathloom.plans.matching import UPDATES, network, shipped
from pathloom.sources.network import EDGE

OUT = "traj_id long, particle_id int, obs_idx int, t double, u long, v long, k int, alpha double, x double, y double, d double, ess double, final boolean, late long, status string"
STATE = "state binary, seen long, last_t double, late long"


def match_stream(obs: DataFrame, table: DataFrame, model: MapMatchingModel, particles: int = 100, update: str = "BSi", lag: int = 3, seed: int = 0, refine: float = 1.0, reach=None, idle_ms: int | None = None, proposal=engine.propose) -> DataFrame:
    """From a stream (traj_id, obs_idx, t, x, y): after each micro-batch the particles of the trajectories
    that got observations, with `final` for rows older than the lag, each of which is told once.

    With `idle_ms` a trajectory without observations for so long ends: its last rows become final.
    """
    if update not in UPDATES:
        raise ValueError(f"update must be one of {UPDATES}, not {update}")
    edges, key_of = shipped(table)

    def told(net, traj, state, times, lo, hi, final, late):
        parts = []
        for i in range(lo, hi):
            s = state.track[i - (state.seen - len(state.track))]
            e = [net.edges[j] for j in s.edge]
            parts.append(pd.DataFrame({
                "traj_id": traj, "particle_id": range(len(e)), "obs_idx": i, "t": times[i], "u": [x[0] for x in e], "v": [x[1] for x in e], "k": [x[2] for x in e],
                "alpha": s.alpha, "x": s.x, "y": s.y, "d": s.d, "ess": state.last_ess, "final": final, "late": late, "status": "OK",
            }))
        return parts

    def step(key, batches, held):
        traj = key[0]
        net = network(edges.value, refine, key_of)
        state, times, seen, last, late = None, {}, 0, None, 0
        if held.exists:
            blob, seen, last, late = held.get
            state, times = pickle.loads(blob)
        if held.hasTimedOut:
            held.remove()
            if state is not None:
                yield pd.concat(told(net, traj, state, times, state.seen - len(state.track), state.seen, True, late), ignore_index=True)
            return
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["t", "obs_idx"])
        out = []
        for x, y, t in zip(pdf["x"], pdf["y"], pdf["t"]):
            if last is not None and t <= last:
                late += 1
                continue
            rng = engine.generator(seed, traj, "online", seen)
            try:
                if state is None:
                    state = engine.start_online(net, model, x, y, particles, rng, reach)
                else:
                    state = engine.update(net, model, state, x, y, t - last, rng, update, lag, keep=False, proposal=proposal)
            except engine.MatchFailed as why:
                out.append(pd.DataFrame([dict.fromkeys([c.split()[0] for c in OUT.split(", ")]) | {"traj_id": traj, "obs_idx": seen, "t": t, "final": True, "late": late, "status": str(why)}]))
                state = None
            if state is not None:
                times[seen] = t
                done = seen - lag - 1
                if done in times:
                    times.pop(done)
                state.seen = seen + 1
                first = seen + 1 - len(state.track)
                if seen >= lag and first <= seen - lag:
                    out += told(net, traj, state, times, seen - lag, seen - lag + 1, True, late)
            seen, last = seen + 1, t
        if state is not None:
            out += told(net, traj, state, times, max(state.seen - len(state.track), state.seen - lag), state.seen, False, late)
        held.update((pickle.dumps((state, times)), seen, last, late))
        if idle_ms:
            held.setTimeoutDuration(idle_ms)
        if out:
            yield pd.concat(out, ignore_index=True)

    from pyspark.sql.streaming.state import GroupStateTimeout

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return obs.groupBy("traj_id").applyInPandasWithState(step, OUT, STATE, "append", timeout)
