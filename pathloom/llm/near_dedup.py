"""Near-duplicate documents from bottom-k sketches of one hash function (operator 8).

Each document's set of word shingles is kept as its k smallest hashes. Inverted lists of
the retained values generate pairs, the sketch of the union estimates their Jaccard
similarity, and the full sets decide, first for each class's likeliest pair and then for
the pairs that are still in different components. Links give components.

Sizes
-----
Equal sets meet first, so that a class of copies is one row from then on. A pair as
similar as asked shares at least a part ALPHA of the retained values (but for a chance
of 3e-7 at k = 48, as it has for the estimate; together below one in a million), so it also shares one of the rarest values of each
side, a prefix of its values in the order of list length; only these are looked up. Lists
of up to `LIST` classes give their pairs. Longer lists give one pair for each class, with
the list's most central class, whose own values are in the longest lists. Classes that this left in another component than most of
such a list are then joined with the list's others by an exact prefix join of the full
sets: nothing is capped, dropped or sampled.

Defined results
---------------
Null, empty or blank text: an empty set (n_shingles 0), linked with nothing, kept.
Fewer words than a shingle has: the whole sequence is the one shingle. Repeated rows are
copies; of rows that share a doc_id but not a text, each has the component of its own text. Null doc_id: its set is counted,
component_id is null, it is linked with nothing and kept. Ties between pivots go to the
larger digest. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .shared import beside, components, cut, drop

SHINGLE, SKETCH, LIST, ALPHA = 5, 48, 16, 0.4
#: Similarity asked for, as a fraction: NUM * size of the intersection >= DEN * size of the union.
NUM, DEN = 100, 75
#: Estimates from sketches must come this near the similarity asked for: 20 of 48 values, below which a pair at the threshold
#: comes with a chance of P(Bin(48, 0.75) <= 19) = 3e-7.
ESTIMATE = 0.40


def shingle_sets(texts: at.Texts, k: int = SHINGLE, table: np.ndarray = at.NOT_SPACE) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes; ASCII letters count as lower case."""
    data = at.LOWER[texts.data]
    starts, ends, first = at.word_spans(texts, table)
    words = at.span_hashes(data, starts, ends)
    grams = at.gram_hashes(words, k)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= k:
            g = np.sort(grams[lo : hi - k + 1])
            fresh = np.empty(len(g), bool)
            fresh[0] = True
            np.not_equal(g[1:], g[:-1], out=fresh[1:])
            out.append(g[fresh])
        elif hi > lo:
            out.append(at.gram_hashes(words[lo:hi], hi - lo))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart, as two columns."""
    one = np.array([at.mix(s ^ at.M1).sum(dtype=np.uint64) for s in sets], np.uint64)
    two = np.array([at.mix(s ^ at.M3).sum(dtype=np.uint64) for s in sets], np.uint64)
    return at.mix(one).view(np.int64), at.mix(two).view(np.int64)


def sketches(df: DataFrame, text: str = "text", carry: list[str] | None = None, k: int = SKETCH) -> DataFrame:
    """n_shingles, the set's digest (d1, d2) and its k smallest hashes, as `sketch`."""

    def setup():
        def work(texts):
            sets = shingle_sets(texts)
            one, two = digests(sets)
            least = [s[:k] for s in sets]
            flat = np.concatenate(least).view(np.int64) if least else np.zeros(0, np.int64)
            return {"n_shingles": np.array([len(s) for s in sets], np.int64), "d1": one, "d2": two, "sketch": at.lists(flat, np.array([len(s) for s in least]))}

        return work

    return at.map_text(df, setup, "n_shingles long, d1 long, d2 long, sketch array<long>", text, carry)


def full_sets(df: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """The carried columns, the first half of the set's digest as `id`, and the whole set as `shingles`."""

    def setup():
        def work(texts):
            sets = shingle_sets(texts)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            return {"id": digests(sets)[0], "shingles": at.lists(flat, np.array([len(s) for s in sets]))}

        return work

    return at.map_text(df, setup, "id long, shingles array<long>", text, carry)


def candidates(classes: DataFrame, most: int = LIST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From classes (id, n, sketch): the pairs (a, b) of short lists and of pivots, and the
    entries (v, id, n) of long lists, of whose classes `remaining` makes the other pairs."""
    entries = classes.select("id", F.explode("sketch").alias("v"))
    often = cut(entries.groupBy("v").agg(F.count("*").alias("lists")).where("lists > 1"))
    many = cut(entries.join(often, "v"))
    shared = many.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("lists", "v"))).alias("x"))
    kept = F.least(F.col("n"), F.lit(SKETCH))
    # Values of one list only fill the rarest places of a class's prefix but lead nowhere.
    room = F.greatest(F.lit(0), F.size("x") - F.ceil(kept * ALPHA) + 1).cast("int")
    prefix = classes.select("id", "n").join(shared, "id")
    prefix = cut(prefix.select("id", "n", F.aggregate("x", F.lit(0).cast("long"), lambda s, x: s + x["lists"]).alias("central"), F.explode(F.slice("x", 1, room).v).alias("v")))
    drop(often, many)
    sizes = cut(prefix.groupBy("v").agg(F.count("*").alias("members")).where("members > 1"))
    sized = cut(prefix.join(sizes, "v"))
    drop(prefix, sizes)

    short = sized.where(F.col("members") <= most).groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("m"))
    first = short.select(F.posexplode("m").alias("i", "x"), "m")
    pairs = first.select(F.col("x.id").alias("a"), F.col("x.n").alias("na"), F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y"))
    pairs = pairs.select("a", F.col("y.id").alias("b"), "na", F.col("y.n").alias("nb"))

    long = sized.where(F.col("members") > most).select("v", "id", "n", "central")
    pivot = cut(long.groupBy("v").agg(F.max_by(F.struct("id", "n"), F.struct("central", "id")).alias("p")))
    stars = long.join(pivot, "v").where("id <> p.id")
    stars = stars.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"), F.col("n").alias("na"), F.col("p.n").alias("nb"))
    return pairs.where(_near_in_size()).select("a", "b"), stars.where(_near_in_size()).select("a", "b"), long


def _near_in_size():
    """Sets of these sizes could be similar enough."""
    return (F.least("na", "nb") * NUM >= F.greatest("na", "nb") * DEN)


def residual(long: DataFrame, found: DataFrame) -> DataFrame | None:
    """The classes (id, c) of long lists with their components c by now, and in `rest` whether c isn't
    the component of most of some list; None if it is for all."""
    placed = cut(long.join(found, long.id == found.node, "left").select("v", "id", F.coalesce("component", "id").alias("c")))
    main = cut(placed.groupBy("v", "c").agg(F.count("*").alias("x")).groupBy("v").agg(F.max_by("c", F.struct("x", "c")).alias("main")))
    rest = cut(placed.join(main, "v").groupBy("id", "c").agg(F.max(F.col("c") != F.col("main")).alias("rest")))
    return rest if rest.where("rest").take(1) else None


def remaining(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes in different components, at least one of the rest, whose full sets
    (id, shingles) may be similar enough: an exact prefix join.

    A set's shingles are put in order of the number of these sets that hold them. A similar pair
    shares one among the first quarter of both, at places that leave enough behind them. The
    sizes that such a place allows are part of the key, so that a long list isn't met whole.
    """
    own = sets.join(rest, "id")
    each = own.select("id", "c", "rest", F.size("shingles").alias("n"), F.explode("shingles").alias("v"))
    often = cut(each.groupBy("v").agg(F.count("*").alias("lists")).where("lists > 1"))
    known = each.join(often, "v").groupBy("id", "c", "rest", "n").agg(F.sort_array(F.collect_list(F.struct("lists", "v"))).alias("x"))
    # What no other set holds comes first: `alone` places that lead nowhere.
    known = known.withColumn("alone", F.col("n") - F.size("x"))
    room = F.greatest(F.lit(0), F.floor((F.lit(NUM - DEN) * F.col("n")) / NUM) + 1 - F.col("alone")).cast("int")
    spots = known.select("id", "c", "rest", "n", "alone", F.posexplode(F.slice("x", 1, room)).alias("i", "x"))
    spots = cut(spots.select("id", "c", "rest", "n", (F.col("n") - F.col("alone") - F.col("i")).alias("left"), F.col("x.v").alias("v")))

    def step(n):
        return F.floor(F.log(n.cast("double")) / float(np.log(1.05))).cast("int")

    # Overlaps of a similar pair are at least part * (na + nb), and no more than what is left.
    part = DEN / (NUM + DEN)
    smallest, largest = F.col("n") * (DEN / NUM), F.least(F.col("n") * (NUM / DEN), F.col("left") / part - F.col("n"))
    asks = spots.where("rest").withColumn("most", largest).where(F.col("most") >= smallest - 1e-6)
    asks = asks.select("v", F.col("id").alias("ra"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("left").alias("la"), F.explode(F.sequence(step(F.greatest(F.lit(1.0), smallest - 0.5)), step(F.col("most") + 0.5))).alias("step"))
    gives = spots.select("v", F.col("id").alias("rb"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("left").alias("lb"), step(F.col("n")).alias("step"))
    enough = F.least("la", "lb") * (NUM + DEN) >= (F.col("na") + F.col("nb")) * DEN
    met = asks.join(gives, ["v", "step"]).where("ca <> cb").where(enough)
    return met.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()


def estimated(pairs: DataFrame, classes: DataFrame, k: int = SKETCH) -> DataFrame:
    """The pairs whose union's sketch, the k smallest values of both, has a large enough part in both;
    that part is `e`."""
    own = classes.select("id", "sketch")
    one = beside(pairs, own.withColumnsRenamed({"id": "a", "sketch": "sa"}), "a", "b")
    both = beside(one, own.withColumnsRenamed({"id": "b", "sketch": "sb"}), "b", "a", pairs)
    union = F.slice(F.sort_array(F.transform(F.array_union("sa", "sb"), _unsigned)), 1, k)
    common = F.size(F.array_intersect(union, F.transform(F.array_intersect("sa", "sb"), _unsigned)))
    return both.select("a", "b", (common / F.size(union)).alias("e")).where(F.col("e") >= ESTIMATE)


def most_likely(near: DataFrame) -> DataFrame:
    """Of the estimated pairs the likeliest of each class."""
    ends = near.select(F.col("a").alias("id"), "a", "b", "e").union(near.select(F.col("b").alias("id"), "a", "b", "e"))
    best = ends.groupBy("id").agg(F.max(F.struct("e", "a", "b")).alias("x"))
    return best.select("x.a", "x.b").distinct()


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components."""
    ca, cb = found.toDF("a", "ca"), found.toDF("b", "cb")
    placed = pairs.join(ca, "a", "left").join(cb, "b", "left")
    return placed.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _unsigned(x):
    """Longs in the order of the hashes, which have no sign."""
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of which the full sets (id, shingles) are similar enough."""
    one = beside(pairs, sets.withColumnsRenamed({"id": "a", "shingles": "sa"}), "a", "b")
    both = beside(one, sets.withColumnsRenamed({"id": "b", "shingles": "sb"}), "b", "a", pairs)
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common * NUM >= (F.size("sa") + F.size("sb") - common) * DEN).select("a", "b")


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components once more links (a, b) are known: of the links only those between components count."""
    ca, cb = found.toDF("a", "ca"), found.toDF("b", "cb")
    ends = links.join(ca, "a", "left").join(cb, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    over = components(ends.where("a <> b").distinct())
    old = found.join(over.toDF("component", "next"), "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return cut(old.union(over.join(found.select("node"), "node", "left_anti")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by
    links, itself included), kept (doc_id = component_id)."""
    return _placed(docs, doc_id, text).drop("same_text")


def _placed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The result with a hash of each row's text, `same_text`."""
    thin = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = cut(sketches(thin.withColumn("same_text", F.xxhash64("text")), carry=["doc_id", "same_text"]))
    full = rows.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy(F.col("n_shingles").alias("n"), F.col("d1").alias("id"), "d2").agg(F.min("doc_id").alias("first"), F.first("sketch").alias("sketch"))
    classes = cut(classes)

    pairs, stars, long = candidates(classes)
    met = cut(pairs.union(stars).distinct())
    near = cut(estimated(met, classes))
    drop(met)
    ends = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct()
    sets = _sets_of(thin, ends, classes)
    likely = cut(most_likely(near))
    links = cut(verified(likely, sets))
    found = components(links)
    drop(likely, links)
    # A link within a component changes nothing: only the other pairs are left to verify.
    others = cut(apart(near, found))
    more = cut(verified(others, sets))
    drop(near, sets, others)
    if more.take(1):
        found = merged(found, more)
    rest = residual(long, found)
    if rest is not None:
        sets = _sets_of(thin, rest, classes)
        others = cut(remaining(rest, sets))
        more = cut(verified(others, sets))
        if more.take(1):
            found = merged(found, more)
        drop(rest, sets, others)
    placed = cut(classes.join(found, classes.id == found.node, "left").select("n", "id", "d2", "first", F.coalesce("component", "id").alias("c")))
    least = cut(placed.groupBy("c").agg(F.min("first").alias("component_id")))
    named = cut(placed.join(least, "c").select(F.col("n").alias("n_shingles"), F.col("id").alias("d1"), "d2", "component_id"))
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = rows.select("doc_id", "same_text", "n_shingles", "d1", "d2").join(named, ["n_shingles", "d1", "d2"], "left")
    out = out.select("doc_id", "same_text", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _sets_of(thin: DataFrame, ids: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, shingles) of the classes named by id, read again from the text of each one's first document."""
    firsts = classes.select("id", "first").join(ids, "id").select("first").distinct()
    wanted = thin.join(firsts, thin.doc_id == firsts["first"]).select("text")
    return cut(full_sets(wanted, "text", []).dropDuplicates(["id"]))


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns; of rows with one doc_id and equal text, all. Of rows
    that share a doc_id but not a text each is judged by its own text."""
    gone = _placed(docs, doc_id, text).where("not kept").select(F.col("doc_id").alias("__gone"), F.col("same_text").alias("__text")).distinct()
    return docs.join(gone, (docs[doc_id].cast("long") == F.col("__gone")) & (F.xxhash64(docs[text].cast("string")) == F.col("__text")), "left_anti")
