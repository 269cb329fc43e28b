"""What the operators of this package share on Spark's side: cut lineage, and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as at

#: Scratch tables that weren't dropped; they go when the application ends.
_KEPT: dict[str, SparkSession] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, shared by the driver and all executors.

    Where the setting is absent, a local session, as in tests, gets a temporary folder; a cluster is refused, as its
    machines share no such folder.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows, written as a table in the scratch folder and read again: a plan without history,
    which a lost executor can't take away, and whose size the planner knows."""
    path = f"{scratch_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _KEPT[path] = df.sparkSession
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by `cut` of which nothing will be read any more. As Spark deletes the shuffles
    behind them when the driver's collector finds their plans gone, that is called as well."""
    for table in tables:
        _delete(table.__dict__["_scratch"], table.sparkSession)
    tables[0].sparkSession._jvm.System.gc()


def _delete(path: str, spark: SparkSession) -> None:
    _KEPT.pop(path, None)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for path, spark in list(_KEPT.items()):
        if spark.sparkContext._jsc is not None:
            try:
                _delete(path, spark)
            except Exception:  # the JVM may have ended before
                return


#: Pairs that one copy of a row is joined with; a row in more pairs is dealt in copies.
TOGETHER, SALTS = 256, 64


def beside(pairs: DataFrame, rows: DataFrame, key: str, other: str, counted: DataFrame | None = None) -> DataFrame:
    """`pairs` joined with `rows` on `key`. A key in many pairs is split by the hash of `other`, and its row copied to each part, so
    that no task gets all pairs of one key. Such keys, at most one for TOGETHER pairs, are counted and told to all tasks, so that pairs and
    rows are each shuffled once; where they are too many for that, parts are looked up by salted keys. Rows hold texts, so none are
    broadcast at any size. `counted`, the pairs by default, tells how many there are."""
    many = (pairs if counted is None else counted).groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > TOGETHER)
    many = cut(many.select(key, F.ceil(F.col("__n") / TOGETHER).alias("__parts")))
    if many.count() <= FEW:
        many = F.broadcast(many)
        one = pairs.join(many, key, "left")
    else:
        salted = many.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        one = pairs.withColumn("__salt", F.pmod(F.hash(other), F.lit(SALTS))).join(salted, [key, "__salt"], "left").drop("__salt")
    one = one.withColumn("__part", F.coalesce(F.pmod(F.xxhash64(other), F.col("__parts")), F.lit(0).cast("long"))).drop("__parts")
    last = F.coalesce(F.col("__parts") - 1, F.lit(0).cast("long"))
    two = rows.join(many, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("__parts")
    return one.join(two.hint("merge"), [key, "__part"]).drop("__part")


#: Rows of a table made by `cut` that a broadcast may hold; they are counted, and more are joined by shuffles.
FEW = 2_000_000


def few(table: DataFrame, most: int = FEW) -> DataFrame:
    """The table, to be broadcast if it has so few rows. Only for tables of some longs a row."""
    return F.broadcast(table) if table.count() <= most else table


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """True where crc32 of the id's text leaves no remainder; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0


#: Edges whose components one task finds, each in both directions: some 50 MB in Python at most.
AT_ONCE = 200_000


def _hooked(left: DataFrame) -> DataFrame:
    """(u, to) of every node on an edge (u, v); `to` is one node for all that reach each other. In one task."""

    def run(batches):
        up = {}

        def top(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            for u, v in zip(*(batch.column(c).to_pylist() for c in ("u", "v"))):
                u, v = top(u), top(v)
                up[max(u, v)] = min(u, v)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["u", "to"])
        up.clear()
        at.release()

    return left.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(run, "u long, to long")


def components(edges: DataFrame, a: str = "a", b: str = "b", at_once: int = AT_ONCE) -> DataFrame:
    """(node, component) of every node on an edge; component is the smallest node reachable.

    Once no more than `at_once` edges are left, one task finds what they join: rounds on
    few rows cost tables and jobs, not time in tasks. Before that, each round hooks every node on its neighbour of the smallest hash, follows two more
    hooks, and draws the edges between what is left, about a third of the nodes; a chain
    of any length takes a logarithmic number of rounds. A round is made of joins and sums
    with partial aggregation, so a node with very many links isn't gathered in one task.
    """
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    left = cut(one.union(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    roots = cut(edges.select(F.explode(F.array(a, b)).alias("node")).distinct().select("node", F.col("node").alias("root")))
    while (many := left.count()) > at_once:
        least = F.min(F.struct(F.xxhash64("v").alias("h"), "v"))
        hooks = left.groupBy("u").agg(F.least(least, F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("v")))["v"].alias("to"))
        hooks = cut(hooks)
        for _ in range(2):
            further = cut(hooks.join(hooks.select(F.col("u").alias("to"), F.col("to").alias("next")), "to").select("u", F.col("next").alias("to")))
            drop(hooks)
            hooks = further
        new_roots = cut(roots.join(hooks, roots.root == hooks.u, "left").select("node", F.coalesce("to", "root").alias("root")))
        ends = left.join(hooks.withColumnRenamed("to", "tu"), "u").join(hooks.select(F.col("u").alias("v"), F.col("to").alias("tv")), "v")
        rest = cut(ends.where("tu <> tv").select(F.col("tu").alias("u"), F.col("tv").alias("v")).distinct())
        drop(left, roots, hooks)
        left, roots = rest, new_roots
    if many:
        hooks = cut(_hooked(left))
        new_roots = cut(roots.join(hooks, roots.root == hooks.u, "left").select("node", F.coalesce("to", "root").alias("root")))
        drop(roots, hooks)
        roots = new_roots
    least = cut(roots.groupBy("root").agg(F.min("node").alias("component")))
    out = cut(roots.join(least, "root").select("node", "component"))
    drop(left, roots, least)
    return out
