"""Benchmark decontamination by winnowing (operator 9).

Both sides keep the smallest of every nine consecutive hashes of five words, so each
shared span of 13 words has a kept hash in common; the kept hashes meet in a join with
the benchmark's, and each meeting is extended word by word to both sides, up to where a
window of 13 words around it ends. Runs of 13 or more shared words are hits. An item of
fewer words is one window and is looked up whole, since no window of 13 fits into it.

The benchmark is the stated query set, of any size. Its distinct items are read in blocks
of at most about BLOCK bytes of text, or one item, whose index (about six times that) goes
to every task, and PASS blocks are looked up in one pass over the documents. Between passes
the documents and their hits so far are written as a table, so that the driver and the
executors hold the blocks of one pass only (the driver those of the next one beside them).

Defined results
---------------
Null, empty or wordless text: n_words 0, no hits, not contaminated. Wordless or null
items have no window. Repeated items, or items of one id, count once in n_items and in
the list of ids; items of a null id make hits but aren't counted. Repeated documents are
judged each. An empty benchmark contaminates nothing. Columns of the documents named as
a result give way to it.
"""

from __future__ import annotations

from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from . import shared

WINDOW, GRAM = 13, 5
#: Bytes of benchmark text in one block.
BLOCK = 8 << 20
#: Blocks that are looked up in one pass over the documents.
PASS = 4
NO_GRAM = np.uint64(0xFFFFFFFFFFFFFFFF)


def row_words(texts: at.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, ASCII letters as lower case, and each row's first word."""
    starts, ends, first = at.word_spans(texts, at.ALNUM)
    return at.span_hashes(at.LOWER[texts.data], starts, ends), first


def inner_grams(words: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """For each word the hash of the k words from it on, or NO_GRAM where they leave the row."""
    out = np.full(len(words), NO_GRAM)
    g = at.gram_hashes(words, k)
    out[: len(g)] = np.minimum(g, NO_GRAM - np.uint64(1))
    for back in range(1, k):
        at_end = first[1:] - back
        out[at_end[at_end >= first[:-1]]] = NO_GRAM
    return out


def sliding(take, x: np.ndarray, width: int) -> np.ndarray:
    """take over each `width` consecutive entries."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = take(x[: len(x) - step], x[step:])
        done += step
    return x


def winnowed(grams: np.ndarray, width: int = WINDOW - GRAM + 1) -> np.ndarray:
    """Positions whose hash is the smallest of some `width` consecutive ones."""
    if len(grams) < width:
        padded = np.concatenate([grams, np.full(width - len(grams), NO_GRAM)])
        return np.flatnonzero((grams == padded.min()) & (grams != NO_GRAM)) if len(grams) else np.zeros(0, np.int64)
    least = sliding(np.minimum, grams, width)
    edge = np.zeros(width - 1, np.uint64)
    best = sliding(np.maximum, np.concatenate([edge, least, edge]), width)
    return np.flatnonzero((best == grams) & (grams != NO_GRAM))


class Index:
    """The windows of a block of items."""

    def __init__(self, ids: list[str | None], items: list[str | None]):
        texts = at.Texts(pa.array(items, pa.string()))
        words, first = row_words(texts)
        self.ids, self.words, self.first = ids, words, first
        length = np.diff(first)
        self.item_of = np.repeat(np.arange(len(length)), length)
        spots = winnowed(inner_grams(words, first, GRAM))
        spots = spots[length[self.item_of[spots]] >= WINDOW]
        grams = inner_grams(words, first, GRAM)[spots]
        order = np.argsort(grams, kind="stable")
        self.spots = spots[order]
        self.values, self.begin = np.unique(grams[order], return_index=True)
        self.end = np.append(self.begin[1:], len(order))
        self.short = {}
        for m in range(1, WINDOW):
            own = np.flatnonzero(length == m)
            if len(own):
                whole = inner_grams(words, first, m)[first[own]]
                order = np.argsort(whole, kind="stable")
                values, begin = np.unique(whole[order], return_index=True)
                self.short[m] = (own[order], values, begin, np.append(begin[1:], len(order)))

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of hit words (start, stop) and the item of each."""
        found = [(np.zeros(0, np.int64),) * 3]
        grams = inner_grams(words, first, GRAM)
        spots = winnowed(grams)
        for p, q in self._meet(spots, grams[spots], self.values, self.begin, self.end, self.spots):
            found.append(self._extend(words, first, p, q))
        for m, (own, values, begin, end) in self.short.items():
            whole = inner_grams(words, first, m)
            spots = np.flatnonzero(whole != NO_GRAM)
            found += [(p, p + m, item) for p, item in self._meet(spots, whole[spots], values, begin, end, own)]
        return tuple(np.concatenate(x) for x in zip(*found))

    @staticmethod
    def _meet(spots, grams, values, begin, end, others, most: int = 1 << 18):
        """Pairs of a spot and another one under the same hash, `most` spots' at a time or fewer."""
        if not len(values):
            return
        at_value = np.searchsorted(values, grams)
        at_value[at_value == len(values)] = 0
        same = values[at_value] == grams
        spots, at_value = spots[same], at_value[same]
        many = end[at_value] - begin[at_value]
        start, total = 0, np.cumsum(many)
        while start < len(spots):
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + most, "right")))
            n = many[start:stop]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(spots[start:stop], n), others[np.repeat(begin[at_value[start:stop]], n) + inside]
            start = stop

    def _extend(self, words, first, p, q):
        row = np.searchsorted(first, p, "right") - 1
        item = self.item_of[q]
        ok = np.ones(len(p), bool)
        for j in range(GRAM):
            ok &= words[p + j] == self.words[q + j]
        p, q, row, item = p[ok], q[ok], row[ok], item[ok]
        left, right = np.zeros(len(p), np.int64), np.full(len(p), GRAM, np.int64)
        going = np.arange(len(p))
        for j in range(1, WINDOW - GRAM + 1):
            going = going[(p[going] - j >= first[row[going]]) & (q[going] - j >= self.first[item[going]])]
            going = going[words[p[going] - j] == self.words[q[going] - j]]
            left[going] = j
        going = np.arange(len(p))
        for j in range(GRAM, WINDOW):
            going = going[(p[going] + j < first[row[going] + 1]) & (q[going] + j < self.first[item[going] + 1])]
            going = going[words[p[going] + j] == self.words[q[going] + j]]
            right[going] = j + 1
        long = left + right >= WINDOW
        return (p - left)[long], (p + right)[long], item[long]


def blocks(benchmark: DataFrame, item_id: str, text: str, most: int):
    """The benchmark's distinct ids, as text, and texts, in blocks of about `most` bytes or one row, one after another.

    Blocks are ranges of a hash, by which the rows lie in the table, so that reading one reads little else.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("x")).where("x is not null")
    size = items.agg(F.sum(F.octet_length("x")).alias("s")).first()["s"] or 0
    if size <= most:
        rows = items.collect()
        yield [r["i"] for r in rows], [r["x"] for r in rows]
        return
    n = -(-2 * size // most)
    spread = items.distinct().withColumn("b", F.pmod(F.xxhash64("i", "x"), F.lit(n)))
    table = shared.cut(spread.repartitionByRange("b").sortWithinPartitions("b"))
    for b in range(n):
        rows = table.where(F.col("b") == b).collect()
        yield [r["i"] for r in rows], [r["x"] for r in rows]
    shared.drop(table)


def _finder(ids, items):
    def setup():
        index = Index(ids, items)

        def work(texts):
            words, first = row_words(texts)
            start, stop, item = index.hits(words, first)
            row = np.searchsorted(first, start, "right") - 1
            order = np.argsort(row, kind="stable")
            row, start, stop, item = row[order], start[order], stop[order], item[order]
            n = len(texts)
            runs = (start - first[row]) << 32 | (stop - first[row])
            pairs = np.unique(row * len(index.ids) + item) if len(row) else row
            named = [(r, index.ids[i]) for r, i in zip((pairs // max(1, len(index.ids))).tolist(), (pairs % max(1, len(index.ids))).tolist()) if index.ids[i] is not None]
            ends = np.zeros(n + 1, np.int32)
            np.cumsum(np.bincount([r for r, _ in named], minlength=n) if named else np.zeros(n, np.int64), out=ends[1:])
            names = pa.ListArray.from_arrays(pa.array(ends), pa.array([i for _, i in named], pa.string()))
            return {"runs": at.lists(runs, np.bincount(row, minlength=n)), "items": names, "words": np.diff(first)}

        return work

    return setup


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", carry: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """The carried columns with n_words, n_hit, n_items, items_sha256 and contaminated."""
    made = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in made]
    df = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry)], F.col(f"`{text}`").cast("string").alias("__t"))
    found = df.withColumns({"__w": F.lit(0).cast("long"), "__runs": F.expr("cast(array() as array<long>)"), "__names": F.expr("cast(array() as array<string>)")})
    read = []
    for number, part in enumerate(batched(blocks(benchmark, item_id, item_text, block), PASS)):
        if number:
            found = shared.cut(found)
            if read:
                shared.drop(read.pop())
            read.append(found)
        for ids, items in part:
            found = at.map_text(found, _finder(ids, items), "runs array<long>, items array<string>, words long", "__t")
            runs, names = F.concat("__runs", "runs"), F.array_distinct(F.concat("__names", "items"))
            found = found.withColumns({"__w": F.col("words"), "__runs": runs, "__names": names}).drop("runs", "items", "words")
    df = found.withColumns({"__runs": F.array_sort("__runs"), "__names": F.array_sort("__names")})
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def cover(done, run):
        start, stop = F.shiftright(run, 32), run.bitwiseAND(F.lit((1 << 32) - 1))
        return F.struct(F.greatest(done["end"], stop).alias("end"), (done["n"] + F.greatest(F.lit(0).cast("long"), stop - F.greatest(start, done["end"]))).alias("n"))

    df = df.withColumn("__hit", F.aggregate("__runs", zero, cover)["n"])
    contaminated = (F.col("__hit") > 0) & (F.col("__hit") * 20 >= F.col("__w"))
    return df.select(
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)],
        F.col("__w").alias("n_words"), F.col("__hit").alias("n_hit"), F.size("__names").cast("long").alias("n_items"),
        F.sha2(F.array_join("__names", ","), 256).alias("items_sha256"), contaminated.alias("contaminated"),
    )


def without_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    at_end = [f"__d{i}" for i in range(len(docs.columns))]
    judged = contamination(docs.toDF(*at_end), benchmark, at_end[docs.columns.index(text)])
    return judged.where("not contaminated").select(*at_end).toDF(*docs.columns)
