"""Digests of spans that the detectors of personal data and secrets share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

Span = tuple[int, int, str]


def ordered(spans: Iterable[Span], kinds: tuple[str, ...]) -> list[Span]:
    """Spans (start, end, kind) by start, then kind as listed, then end."""
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[0], rank[s[2]], s[1]))


def joined(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered(spans, kinds))


def digest(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()
