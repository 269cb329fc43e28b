"""Language identification by cross-parsing entropy (operator 7).

A suffix automaton of each language's labelled text gives the longest match at any place.
A text is cut greedily into the longest phrases that the language's text contains; c
phrases over n bytes against a training text of N bytes cost c * log2(N) / n bits a byte,
and the language of the fewest bits wins. Texts are read in lower case, bytes that are no
letters as one blank a run. Texts are walked through in blocks of BLOCK bytes, thousands of them
in step through all automata, one numpy gather a byte; a second walk carries the state at the end of each
block into the next one until both walks agree, so that phrases go on across blocks.

The labelled text is a sample of whole rows: for each language its rows of at most ROW
characters in the order of a seeded hash, until they have SAMPLE bytes; a language without such
rows has its shortest one. Everything else reads all rows. A language's automaton takes about 12 MB.

Defined results
---------------
Null or empty text, or one without a letter: `und`, score 0. The score is
1 - bits of the best / bits of the second best (1 with one language only, 0 for a tie);
ties go to the first language by name. Null languages, texts and ids aren't learned from;
held_out of a null id is null. With nothing to learn from all is `und`. Repeated rows are
judged each; repeated texts are learned once. Other columns clashing with results give way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .shared import held_out

SAMPLE, ROW, BLOCK, SEED = 24_000, 2_000, 1024, 7
UNDETERMINED = "und"
BLANK, UNSEEN = 0, 1
_CACHE: dict[int, "Models"] = {}


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of a sequence; state 0 is the start."""
    step, link, size, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(step[q].copy())
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


def is_letter(byte: int) -> bool:
    return byte >= 0x80 or chr(byte).isalpha()


_LETTERS = at.word_table(is_letter)


def cleaned(texts: at.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in lower case with each run of others than letters as one 0, and row offsets."""
    low = at.Texts(pc.utf8_lower(texts.column.cast(pa.string())))
    data = np.where(_LETTERS[low.data], low.data, 0).astype(np.uint8)
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 0) | (data[:-1] != 0)
    begins = low.offsets[:-1][np.diff(low.offsets) > 0]
    keep[begins] = True
    where = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=where[1:])
    return data[keep], where[low.offsets]


class Models:
    """All languages' automata in one table: entry `place + code` holds four times the place
    of the next state, plus the phrases that ended."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.names = [name for name, _ in samples]
        byte_rows = [cleaned(at.Texts(pa.array([text], pa.string())))[0] for _, text in samples]
        seen = sorted(set(np.concatenate(byte_rows).tolist()) - {0})
        self.code = np.full(256, UNSEEN, np.uint8 if len(seen) < 253 else np.uint16)
        self.code[0] = BLANK
        self.code[seen] = np.arange(2, 2 + len(seen))
        self.width = width = 2 + len(seen)
        tables, base, self.start = [], 0, []
        for row in byte_rows:
            states = suffix_automaton(self.code[row].tolist())
            place = np.full((len(states), width), -1, np.int64)
            for s, out in enumerate(states):
                for c, to in out.items():
                    place[s, c] = to
            first = place[0].copy()
            ended = np.where(place >= 0, 0, (np.arange(len(states)) > 0).astype(np.int64)[:, None] + (first < 0)[None, :])
            follow = np.where(place >= 0, place, np.maximum(first, 0)[None, :])
            tables.append(((base + follow * width) * 4 + ended).astype(np.int32).ravel())
            self.start.append(base)
            base += len(states) * width
        self.table = np.concatenate(tables)
        self.bits = np.log2(np.array([max(2, len(r)) for r in byte_rows], float))

    def phrases(self, data: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """Phrases of each row (first axis) under each language."""
        n, length = len(offsets) - 1, np.diff(offsets)
        out = np.zeros((n, len(self.names)), np.int64)
        many = -(-length // block)
        row = np.repeat(np.arange(n), many)
        if not len(row):
            return out
        nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        begin = offsets[row] + nth * block
        size = np.minimum(block, offsets[row + 1] - begin)
        order = np.argsort(-size, kind="stable")
        row, begin, size = row[order], begin[order], size[order]
        active = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), "right")
        codes = self.code[data]
        padded = np.concatenate([codes, np.zeros(block, codes.dtype)])
        place = np.repeat(np.array(self.start, np.int32)[:, None], len(row), 1)
        ended = np.zeros((len(self.names), len(row)), np.int32)
        for i, k in enumerate(active.tolist()):
            got = self.table.take(place[:, :k] + padded[begin[:k] + i])
            place[:, :k] = got >> 2
            ended[:, :k] += got & 3
        # The blocks were entered between phrases; now each is entered in the state that the one before ended in.
        starts = np.array(self.start, np.int32)
        spot = np.empty(len(order), np.int64)
        spot[order] = np.arange(len(order))
        before = np.where(nth[order] > 0, spot[order - 1], -1)
        after = np.full(len(order), -1)
        after[before[before >= 0]] = np.flatnonzero(before >= 0)
        fresh, final = place.copy(), place
        more = np.zeros_like(ended)
        lang, block = np.nonzero((before >= 0) & (fresh[:, before] != starts[:, None]))
        while len(lang):
            a, b = final[lang, before[block]], starts[lang]
            gained, end = np.zeros(len(lang), np.int32), fresh[lang, block]
            alive = np.arange(len(lang))
            for i in range(int(size[block].max())):
                alive = alive[(a[alive] != b[alive]) & (i < size[block[alive]])]
                if not len(alive):
                    break
                code = padded[begin[block[alive]] + i]
                one, two = self.table.take(a[alive] + code), self.table.take(b[alive] + code)
                a[alive], b[alive] = one >> 2, two >> 2
                gained[alive] += (one & 3) - (two & 3)
            end = np.where(a != b, a, end)
            more[lang, block] = gained
            changed = (end != final[lang, block]) & (after[block] >= 0)
            final[lang, block] = end
            lang, block = lang[changed], after[block[changed]]
        ended += more
        ended += (final != starts[:, None]) & (after < 0)
        for j in range(len(self.names)):
            out[:, j] = np.bincount(row, ended[j], n)
        return out

    def judge(self, texts: at.Texts) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        letter = pc.fill_null(pc.match_substring_regex(texts.column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        data, offsets = cleaned(texts)
        bits = self.phrases(data, offsets) * self.bits / np.maximum(1, np.diff(offsets))[:, None]
        best = np.argmin(bits, axis=1)
        if len(self.names) > 1:
            two = np.partition(bits, 1, axis=1)[:, :2]
            score = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-12)
        else:
            score = np.ones(n)
        names = [self.names[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letter.tolist())]
        return names, np.where(letter, np.clip(score, 0, 1), 0.0)


def samples(docs: DataFrame, doc_id: str, text: str, lang: str, size: int = SAMPLE, row: int = ROW) -> list[tuple[str, str]]:
    """(language, text) learned from, by language name."""
    known = docs.select(F.col(doc_id).alias("i"), F.col(lang).cast("string").alias("l"), F.col(text).alias("x"))
    known = known.where(~held_out("i") & F.col("l").isNotNull())
    counts = {r["l"]: r["count"] for r in known.groupBy("l").count().collect()}
    if not counts:
        return []
    # Rows of 200 characters on average would do; four times as many are drawn.
    wanted = 4 * -(-size // 200)
    rows = known.withColumn("n", F.length("x")).where("x is not null")
    short = rows.where((F.col("n") <= row) & F.col("x").rlike(r"\p{L}"))
    few = {r["l"]: r["count"] for r in short.groupBy("l").count().collect()}
    share = F.create_map(*[F.lit(v) for name in counts for v in (name, min(1.0, wanted / max(1, few.get(name, 0))))])
    draw = F.pmod(F.xxhash64(F.lit(SEED), "i"), F.lit(1 << 30)) / float(1 << 30)
    drawn = short.where(draw < share[F.col("l")]).select("l", F.xxhash64(F.lit(SEED), "i").alias("h"), "x").collect()
    if len(few) < len(counts):
        lone = rows.where(~F.col("l").isin(list(few)) & F.col("x").rlike(r"\p{L}"))
        drawn += lone.groupBy("l").agg(F.min(F.struct("n", F.xxhash64(F.lit(SEED), "i").alias("h"), "x")).alias("r")).select("l", "r.h", "r.x").collect()
    out: dict[str, dict[str, None]] = {}
    left = dict.fromkeys(counts, size)
    for r in sorted(drawn, key=lambda r: (r["l"], r["h"], r["x"])):
        own = out.setdefault(r["l"], {})
        if left[r["l"]] > 0 and r["x"] not in own:
            own[r["x"]] = r["x"]
            left[r["l"]] -= len(r["x"].encode()) + 1
    return [(name, "\n".join(own.values())) for name, own in sorted(out.items()) if own]


def languages(docs: DataFrame, learned: list[tuple[str, str]], text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns with lang_pred and score."""

    def setup():
        key = hash(tuple(learned))
        if key not in _CACHE:
            _CACHE.clear()
            if learned:
                _CACHE[key] = Models(learned)
        models = _CACHE.get(key)

        def work(texts):
            if models is None:
                return {"lang_pred": [UNDETERMINED] * len(texts), "score": np.zeros(len(texts))}
            names, score = models.judge(texts)
            return {"lang_pred": names, "score": score}

        return work

    return at.map_text(docs, setup, "lang_pred string, score double", text, carry)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from the rest of the folds."""
    learned = samples(docs, doc_id, text, lang)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return languages(rows, learned, carry=["doc_id", "held_out"])


def with_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents in a learned language, with all their columns; those of none go."""
    at_end = [f"__d{i}" for i in range(len(docs.columns))]
    judged = languages(docs.toDF(*at_end), samples(docs, doc_id, text, lang), at_end[docs.columns.index(text)])
    return judged.where(F.col("lang_pred") != UNDETERMINED).select(*at_end).toDF(*docs.columns)
