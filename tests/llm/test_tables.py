"""How many tables the components take, and that workers give memory back."""

import os
import subprocess
import sys

import pytest

from pathloom.llm import shared


def chain_and_star(spark):
    """A chain of 41 nodes in mixed order, a star around 1000, a loop and a pair."""
    mixed = [(7 * i) % 41 for i in range(41)]
    edges = list(zip(mixed, mixed[1:])) + [(1000, 1000 + i) for i in range(1, 30)] + [(50, 50), (-5, 60)]
    want = {n: 0 for n in range(41)} | {n: 1000 for n in range(1000, 1030)} | {50: 50, -5: -5, 60: -5}
    return spark.createDataFrame(edges, "a long, b long"), want


@pytest.mark.parametrize("at_once", [0, 20, 200_000])
def test_components_by_rounds_and_at_once(spark, at_once):
    edges, want = chain_and_star(spark)
    got = {r["node"]: r["component"] for r in shared.components(edges, at_once=at_once).collect()}
    assert got == want


def test_components_of_few_edges_take_six_tables(spark, monkeypatch):
    edges, want = chain_and_star(spark)
    made, cut = [], shared.cut
    monkeypatch.setattr(shared, "cut", lambda df: made.append(df) or cut(df))
    assert shared.components(edges).count() == len(want)
    assert len(made) <= 6


def test_workers_give_memory_back():
    """What a task has freed doesn't stay with its worker."""
    code = """
import numpy as np, re
from pathloom.llm import arrowtext as at
rss = lambda: int(re.search(r'VmRSS:\\s+(\\d+)', open('/proc/self/status').read())[1]) // 1024
held = [np.ones(12_000) for _ in range(2_000)]
last, most = held[-1], rss()
del held
at.release()
print(most - rss())
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env={**os.environ, "MALLOC_MMAP_THRESHOLD_": "33554432"})
    assert int(out.stdout) > 150
