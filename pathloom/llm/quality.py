"""Quality by naive Bayes support vectors (operator 5).

Features are indicators of n-grams: byte trigrams, hashed to 2**16 places, and runs of
one to four word shapes, a shape saying how a word is written and whether it repeats the
word before, hashed to 2**12 places, once for being present and once for standing at a
tenth or more of the words. Each indicator is scaled by its log-count ratio between the
classes, rows are brought to length one, and dual coordinate descent fits a linear model
of the hinge loss. A logistic curve fitted to margins of rows left aside gives the score.

Learned from a sample of at most about PER_CLASS labelled documents a class, drawn by a
seeded hash of the id; scores read whole texts and nothing else.

Defined results
---------------
Null and empty texts have no features: their score is the curve at the bias. Labels of
null id or quality aren't learned from, nor are the held-out fold's. Of repeated rows each
is scored; repeated labels are each a row of the sample. With no or one class to learn
from, the score is 0.5, or 0.99 for that class and 0.01 against it. held_out of a null id
is null. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .shared import held_out

PER_CLASS, SEED, CUTOFF = 1_500, 5, 0.3
GRAM_BITS, SHAPE_BITS = 16, 12
WIDTH = (1 << GRAM_BITS) + 2 * (1 << SHAPE_BITS)
RUNS, DENSE = (1, 2, 3, 4), 10
C, EPOCHS, SMOOTH = 1.0, 12, 1.0

_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 4 digit, 8 stop or comma, 16 other sign, 32 beyond ASCII
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 32 if _b >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 4 if _c.isdigit() else 8 if _c in ".,;:?'" else 16


def features(texts: at.Texts) -> list[np.ndarray]:
    """Each row's sorted feature numbers."""
    data, first_byte = texts.data, texts.offsets
    low = at.LOWER[data].astype(np.uint32)
    grams = (low[:-2] * np.uint32(0x9E3779B1) ^ low[1:-1] * np.uint32(0x85EBCA77) ^ low[2:] * np.uint32(0xC2B2AE3D)) if len(low) > 2 else np.zeros(0, np.uint32)
    grams = (grams * np.uint32(0x27D4EB2F)) >> np.uint32(32 - GRAM_BITS)
    starts, ends, first = at.word_spans(texts, at.NOT_SPACE)
    words = at.span_hashes(data, starts, ends)
    shape = np.bitwise_or.reduceat(_KIND[data], starts).astype(np.uint64) if len(starts) else np.zeros(0, np.uint64)
    # reduceat also takes the blanks after a word in, which are of the other signs: ends say what belongs to it.
    if len(starts):
        last = _KIND[data[ends - 1]].astype(np.uint64)
        inner = np.add.reduceat(_KIND[data] == 16, starts) - np.append(starts[1:], len(data)) + ends
        shape = (shape & np.uint64(47)) | (last << np.uint64(8)) | np.where(inner > 0, np.uint64(16), np.uint64(0))
        again = np.zeros(len(words), np.uint64)
        again[1:] = words[1:] == words[:-1]
        begins = first[:-1][np.diff(first) > 0]
        again[begins] = 0
        shape = shape | again << np.uint64(20)
    runs = [at.gram_hashes(at.mix(shape), k) >> np.uint64(64 - SHAPE_BITS) for k in RUNS]
    out, seen = [], np.zeros(1 << GRAM_BITS, bool)
    base = 1 << GRAM_BITS
    for i in range(len(texts)):
        lo, hi = int(first_byte[i]), int(first_byte[i + 1])
        own = grams[lo : max(lo, hi - 2)]
        seen[own] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        lo, hi = int(first[i]), int(first[i + 1])
        count = np.zeros(1 << SHAPE_BITS, np.int64)
        for k, run in zip(RUNS, runs):
            if hi - lo >= k:
                count += np.bincount(run[lo : hi - k + 1].astype(np.int64), minlength=1 << SHAPE_BITS)
        out.append(np.concatenate([found, base + np.flatnonzero(count), base + (1 << SHAPE_BITS) + np.flatnonzero(count * DENSE > hi - lo)]))
    return out


class Model:
    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, prior: float):
        """prior: the part of label 1 among all labels learned from."""
        self.weights, self.squares, self.bias, self.curve = np.zeros(WIDTH), np.zeros(WIDTH), 0.0, (0.0, 0.0)
        ones, zeros = int((labels == 1).sum()), int((labels == 0).sum())
        if not ones or not zeros:
            self.curve = (0.0, (4.6 if ones else -4.6) if ones or zeros else 0.0)
            return
        aside = np.arange(len(rows)) % 4 == 3
        if min(np.bincount(labels[aside], minlength=2)) < 5 or min(np.bincount(labels[~aside], minlength=2)) < 5:
            aside = np.zeros(len(rows), bool)
        learn = np.flatnonzero(~aside)
        counts = [np.full(WIDTH, SMOOTH), np.full(WIDTH, SMOOTH)]
        for i in learn:
            counts[labels[i]][rows[i]] += 1
        ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        self.squares = ratio**2
        sign = np.where(labels == 1, 1.0, -1.0)
        scale = [ratio[r] / max(1e-9, np.sqrt(self.squares[r].sum())) for r in rows]
        w, b, alpha = np.zeros(WIDTH), 0.0, np.zeros(len(rows))
        draw = np.random.default_rng(SEED)
        for _ in range(EPOCHS):
            for i in draw.permutation(learn):
                r, x = rows[i], scale[i]
                gap = sign[i] * (w[r] @ x + b) - 1
                new = min(max(alpha[i] - gap / 2.0, 0.0), C)  # each row and its bias have length one
                w[r] += (new - alpha[i]) * sign[i] * x
                b += (new - alpha[i]) * sign[i]
                alpha[i] = new
        self.weights, self.bias = w * ratio, b
        judged = np.flatnonzero(aside) if aside.any() else learn
        margin = np.array([w[rows[i]] @ scale[i] + b for i in judged])
        y = labels[judged]
        mass = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum()))
        self.curve = _logistic(margin, y, mass)

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        margin = np.array([self.weights[r].sum() / max(1e-9, np.sqrt(self.squares[r].sum())) for r in rows]) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * margin + self.curve[1], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, mass: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic fit, by Newton's steps with a little shrinkage."""
    design, at_ = np.stack([x, np.ones(len(x))], 1), np.array([1.0, 0.0])
    goal = np.where(y == 1, 0.995, 0.005)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at_, -30, 30)))
        slope = design.T @ (mass * (goal - p)) - 1e-4 * at_
        bend = (design * (mass * p * (1 - p))[:, None]).T @ design + 1e-4 * np.eye(2)
        at_ = at_ + np.clip(np.linalg.solve(bend, slope), -2, 2)
    return max(0.0, float(at_[0])), float(at_[1])


def learned(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, per_class: int = PER_CLASS) -> Model:
    known = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where(~held_out("i") & F.col("y").isin(0, 1))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not counts:
        return Model([], np.zeros(0, int), 0.5)
    share = F.create_map(*[F.lit(v) for y, n in counts.items() for v in (y, min(1.0, per_class / n))])
    draw = F.pmod(F.xxhash64(F.lit(SEED), "i"), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.where(draw < share[F.col("y")])  # about per_class rows a class: small enough to broadcast
    texts = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("x")).join(F.broadcast(drawn), "i")
    rows = at.map_text(texts, _featuring, "f binary", "x", ["i", "y"])
    return fitted(rows, counts.get(1, 0) / sum(counts.values()))


def fitted(rows: DataFrame, prior: float) -> Model:
    """The model of rows (i, y, f), fitted in one task; only its weights come to the driver."""

    def run(batches):
        found = sorted(r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("i", "y", "f"))))
        order = np.random.default_rng(SEED).permutation(len(found))
        model = Model([np.frombuffer(found[k][2], "<i4").astype(np.int64) for k in order], np.array([found[k][1] for k in order], int), prior)
        columns = [[model.weights.tobytes()], [model.squares.tobytes()], [float(model.bias)], [float(model.curve[0])], [float(model.curve[1])]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["weights", "squares", "bias", "slope", "shift"])

    told = rows.repartition(1).mapInArrow(run, "weights binary, squares binary, bias double, slope double, shift double").collect()
    model = Model([], np.zeros(0, int), prior)
    if told:
        model.weights, model.squares = (np.frombuffer(told[0][c], float) for c in ("weights", "squares"))
        model.bias, model.curve = told[0]["bias"], (told[0]["slope"], told[0]["shift"])
    return model


def _featuring():
    def work(texts):
        return {"f": pa.array([r.astype("<i4").tobytes() for r in features(texts)], pa.binary())}

    return work


def scored(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns with score and predicted."""

    def setup():
        def work(texts):
            score = model.score(features(texts))
            return {"score": score, "predicted": (score >= CUTOFF).astype(np.int32)}

        return work

    return at.map_text(docs, setup, "score double, predicted int", text, carry)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = learned(docs, labels, doc_id, text, label)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return scored(rows, model, carry=["doc_id", "held_out"])
