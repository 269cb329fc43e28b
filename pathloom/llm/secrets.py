"""Secrets: patterns, and sliding-window Shannon entropy over candidate strings (operator 10).

The patterns find assignments of passwords and keys, access key ids and long hexadecimal
strings. The entropy scan reads every maximal run of a character class, hexadecimal or
base64 with its URL variant, that is at least a window long. The counts of a window's
characters, and with them its entropy, are updated as one character leaves and one
comes. Stretches of windows above the class's threshold are added as spans of kind
`entropy`, unless they overlap a pattern's span, hold no digit or no letter, or fall
under the allow-list.

Defined results
---------------
Null and empty texts: no spans. Offsets count code points, ends are exclusive. Where both
classes find the same stretch it counts once. Repeated rows are judged each; texts are
read whole. Columns of the documents named as a result give way to it.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import arrowtext as at
from .spans import Span, digest, joined

KINDS = ("assign", "access", "hex", "entropy")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINT = r"(?i)password|passwd|secret|token|api_?key"
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

WINDOW = 20
#: Character classes of candidate strings, with the entropy in bits a character that a window needs.
CLASSES = ((re.compile(r"[0-9a-fA-F]{20,}"), 3.0), (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.7))
#: A candidate that one of these matches whole is no secret.
ALLOW = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
    r"sha(1|256|384|512)[-=].*",  # integrity digests
    r"[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-].*",  # time stamps
    r"[a-z]+([_/-][a-z]+)*([_/-]?[0-9]{1,4})?",  # words joined by signs, with a number
    r"[A-Z]+([_/-][A-Z]+)*([_/-]?[0-9]{1,4})?",
    # Names, words and numbers joined by signs: paths, versions, settings
    r"[/_=+-]*+([A-Za-z]++[0-9]{0,6}+|[0-9]++)([/_=+-]++([A-Za-z]++[0-9]{0,6}+|[0-9]++))++[/_=+-]*+",
    r".*(EXAMPLE|example|xxxx|XXXX|0000000000|1234567890|01234567|abcdefgh|ABCDEFGH).*",
    r"[0-9]+([-_/=+][0-9]+)*",  # numbers
)

_PART = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def hot_stretches(text: str, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Stretches covered by windows whose entropy reaches the threshold, by incremental counts."""
    part = _PART if window == WINDOW else [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    most = window * (math.log2(window) - threshold) + 1e-9  # the sum of c * log2(c) may be so large
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += part[n + 1] - part[n] if n < window else 0.0
        if i >= window:
            gone = text[i - window]
            n = counts[gone]
            counts[gone] = n - 1
            total -= part[min(n, window)] - part[n - 1]
        if i >= window - 1 and total <= most:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def base_spans(text: str, assigned: bool = True) -> list[Span]:
    """The patterns' spans: leftmost and non-overlapping within a kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if assigned else []
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16] if "AKIA" in text else []
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def entropy_spans(text: str, base: list[Span], allow: list[re.Pattern]) -> list[Span]:
    out: set[tuple[int, int]] = set()
    for run, threshold in CLASSES:
        for m in run.finditer(text):
            own = m.group()
            if not any(c.isdigit() for c in own) or not any(c.isalpha() for c in own) or any(a.fullmatch(own) for a in allow):
                continue
            for lo, hi in hot_stretches(own, threshold):
                part = own[lo:hi]
                start, end = m.start() + lo, m.start() + hi
                if not any(c.isdigit() for c in part) or not any(c.isalpha() for c in part) or any(a.fullmatch(part) for a in allow):
                    continue
                if not any(s < end and start < t for s, t, _ in base):
                    out.add((start, end))
    # What both classes find is told once: a stretch within another goes.
    kept: list[tuple[int, int]] = []
    for s, e in sorted(out, key=lambda x: (x[0], -x[1])):
        if not kept or e > kept[-1][1]:
            kept.append((s, e))
    return [(s, e, "entropy") for s, e in kept]


_CANDIDATE = at.word_table(lambda b: b < 128 and (chr(b).isalnum() or chr(b) in "+/_=-"))


def all_spans(texts: at.Texts, allow: tuple[str, ...] = ALLOW) -> list[tuple[list[Span], list[Span]]]:
    """For each text the patterns' spans, and those together with the entropy scan's.

    Only rows with a keyword or a candidate run of 16 bytes can have any; others aren't decoded.
    """
    rules = [re.compile(a) for a in allow]
    starts, ends, _ = at.word_spans(texts, _CANDIDATE)
    long = np.zeros(len(texts), bool)
    long[np.searchsorted(texts.offsets, starts[ends - starts >= 16], "right") - 1] = True
    hinted = pc.fill_null(pc.match_substring_regex(texts.column, ASSIGN_HINT), False).to_numpy(zero_copy_only=False)
    out: list[tuple[list[Span], list[Span]]] = [([], [])] * len(texts)
    for i in np.flatnonzero(long | hinted).tolist():
        text = texts.column[i].as_py()
        base = base_spans(text, bool(hinted[i]))
        out[i] = base, base + entropy_spans(text, base, rules)
    return out


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def found(docs: DataFrame, text: str = "text", carry: list[str] | None = None, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """The carried columns with counts of the patterns' spans by kind, their digest, and all spans."""

    def setup():
        def work(texts):
            got = all_spans(texts, allow)
            out = {f"n_{k}": [sum(s[2] == k for s in base) for base, _ in got] for k in KINDS[:3]}
            return out | {"base_sha256": [digest(base, KINDS) for base, _ in got], "spans": [joined(every, KINDS) for _, every in got]}

        return work

    return at.map_text(docs, setup, SCHEMA, text, carry)
