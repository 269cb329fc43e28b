"""Arrow batches of texts: bounded chunks of UTF-8 bytes, word spans and word hashes in numpy.

Every operator of this package that leaves the JVM goes through `map_text`, which
hands a function one bounded chunk of rows at a time, whatever the size of Spark's
Arrow batches, and puts the function's columns beside the carried ones.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xBF58476D1CE4E5B9)
M3 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on a copy."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class Texts:
    """A chunk of rows' texts: `data` holds their UTF-8 bytes back to back, row i's from
    `offsets[i]` to `offsets[i + 1]`; `valid` is False for nulls, which have no bytes."""

    def __init__(self, column: pa.Array):
        if pa.types.is_large_string(column.type):
            kind = np.int64
        else:
            column, kind = column.cast(pa.string()), np.int32
        self.column = column
        n = len(column)
        self.valid = np.ones(n, bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
        if column.null_count:
            column = column.fill_null("")
        _, where, data = column.buffers()
        if n:
            ends = np.frombuffer(where, kind)[column.offset : column.offset + n + 1].astype(np.int64)
        else:
            ends = np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = raw[ends[0] : ends[-1]]
        self.offsets = ends - ends[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def strings(self) -> list[str]:
        """The texts; a null gives the empty string."""
        return [x or "" for x in self.column.to_pylist()]


def chunks(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with at most `most` bytes of text each, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start, n = 0, batch.num_rows
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def release() -> None:
    """Gives what numpy and Arrow have freed back to the system. Workers live on after a task, beside those of other
    stages and the JVM, and would keep the most that they ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def map_text(
    df: DataFrame,
    setup: Callable[[], Callable[[Texts], dict[str, object]]],
    schema: str,
    text: str = "text",
    carry: list[str] | None = None,
    most: int = CHUNK_BYTES,
) -> DataFrame:
    """Adds the columns of `schema`, made by `setup()(texts)` as lists or arrays, to the carried columns.

    `carry` names the columns kept (all by default). A carried column whose name clashes
    with a made one gives way to it, in any letter case. `setup` runs once in each task.
    """
    made = T.StructType.fromDDL(schema)
    names = {f.name.lower() for f in made}
    kept = [c for c in (df.columns if carry is None else carry) if c.lower() not in names]
    carried = text in kept and df.schema[text].dataType == T.StringType()
    name = text if carried else "__text"
    given = df.select(*[F.col(f"`{c}`") for c in kept], *([] if carried else [F.col(f"`{text}`").cast("string").alias(name)]))
    out = T.StructType([given.schema[c] for c in kept] + list(made))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(made)
        work = setup()
        for batch in batches:
            for part in chunks(batch, name, most):
                if not part.num_rows:
                    continue
                got = work(Texts(part.column(name)))
                columns = [part.column(i) for i in range(len(kept))]
                columns += [_array(got[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *[f.name for f in made]])
            columns = got = part = None
        batch = None
        release()

    return given.mapInArrow(run, out)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow list column: row i takes the next `counts[i]` values."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, type=kind))


def word_table(words: Callable[[int], bool]) -> np.ndarray:
    return np.array([words(b) for b in range(256)], bool)


#: Bytes of words in the near-duplicate contract: all but blank and 0x09 to 0x0D.
NOT_SPACE = word_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of words in the contamination contract: ASCII letters and digits, and all of other scripts.
ALNUM = word_table(lambda b: b >= 0x80 or chr(b).isalnum())


def word_spans(texts: Texts, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in `table`, never across rows, and for each
    row the index of its first word (with one more entry at the end)."""
    n = len(texts.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts.offsets), np.int64)
    inside = table[texts.data]
    cuts = texts.offsets[1:-1]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[cuts[cuts < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    cuts = cuts[cuts > 0]
    after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, texts.offsets)


_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, eight bytes a step."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    out = size.astype(np.uint64) * M1
    todo, at = np.arange(len(starts)), starts
    while len(todo):
        left = ends[todo] - at
        step = eight[at] & _MASKS[np.minimum(left, 8)]
        x = (out[todo] ^ step) * M2
        out[todo] = (x ^ (x >> np.uint64(32))) * M3
        more = left > 8
        todo, at = todo[more], at[more] + 8
    return mix(out)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of consecutive word hashes: entry i covers words i to i + k - 1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, factor = np.zeros(n, np.uint64), int(M1)
    for j in range(k):
        total += words[j : j + n] * np.uint64(factor)
        factor = (factor * int(M2) | 1) & (1 << 64) - 1
    return mix(total)
