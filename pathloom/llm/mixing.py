"""Mixing sources to target weights by hierarchical budgeting (operator 3), in DataFrame operations only.

A budget of tokens goes down a tree of domains, languages and sources. A node's capacity
is what its documents hold, times the epochs allowed, summed from the leaves. At each
node the children get shares in proportion to their weights, but none more than its
capacity: what a child can't take goes to its siblings, again by weight. As capacities
are summed from below, a shortage leaves a node only when all its descendants are full,
so siblings come before ancestors. Shares are found at one go: children in the order of
capacity by weight, prefix sums of capacity, suffix sums of weight.

A leaf then takes whole epochs, and of one more epoch a prefix of tokens in the order of
a seeded hash; the last document of a prefix may be cut. The prefix is found by sums over
hash buckets, so that only one bucket of a leaf is ever put in order, however large the
leaf is.

Defined results
---------------
Null domains, languages and sources are called ''. Null and blank texts hold no tokens
and are never taken; neither are documents of weightless nodes. Repeated rows are each a
document; ties of the hash go by doc_id, null first, then by the carried columns. A budget above all capacity takes
every document for all epochs. An empty table gives an empty result. Carried columns that
clash with results give way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut

LEAF = ("domain", "lang", "source")
#: Leaves that are broadcast to the documents; more are joined by key.
FEW_LEAVES = 50_000
ROWS_OF_BUCKET, LEAST_BITS = 65_536, 8
#: Types of carried columns that break ties.
ORDERED = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType)
WORD = r"[^ \t\n\x0B\f\r]+"


def weight_of(weights: dict[str, float], name: Column, other: float) -> Column:
    """The weight by name, `other` for names without one."""
    if not weights:
        return F.lit(float(other))
    table = F.create_map(*[F.lit(v) for k, w in sorted(weights.items()) for v in (k, float(w))])
    return F.coalesce(F.try_element_at(table, name), F.lit(float(other)))


def filled(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `share`: the node's `budget` among its children by `weight`, none above its `cap`."""
    family = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    able = (F.col("weight") > 0) & (F.col("cap") > 0)
    ratio = F.when(able, F.col("cap") / F.col("weight"))
    rows = children.withColumn("__r", ratio)
    order = family.orderBy(F.asc_nulls_last("__r"), name)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    usable = F.when(F.col("__r").isNotNull(), F.col("weight"))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum(usable).over(after)
    rows = rows.withColumn("__level", F.when(F.col("__r").isNotNull(), level))
    rows = rows.withColumn("__first", F.min(F.when(F.col("__level") <= F.col("__r"), F.struct("__r", name, "__level"))).over(family))
    share = F.when(F.col("__r").isNull(), F.lit(0.0)).when(F.col("__first").isNull(), F.col("cap"))
    share = share.otherwise(F.least("cap", F.greatest(F.lit(0.0), F.col("weight") * F.col("__first.__level"))))
    return rows.withColumn("share", share).drop("__r", "__level", "__first")


def budgets(leaves: DataFrame, budget: float | None, part: float, epochs: int, weights: dict[str, dict[str, float]], other: dict[str, float]) -> DataFrame:
    """From leaves (domain, lang, source, available) their `budget`, whole epochs `full` and rest `rest`, in tokens."""
    caps = leaves.withColumn("cap", (F.col("available") * epochs).cast("double"))
    total = float(budget) if budget is not None else (leaves.agg(F.sum("available")).first()[0] or 0) * part
    domains = caps.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("budget", F.lit(total))
    domains = filled(domains.withColumn("weight", weight_of(weights.get("domain", {}), F.col("domain"), other["domain"])), [], "domain")
    langs = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(domains.select("domain", F.col("share").alias("budget")), "domain")
    langs = filled(langs.withColumn("weight", weight_of(weights.get("lang", {}), F.col("lang"), other["lang"])), ["domain"], "lang")
    last = caps.join(langs.select("domain", "lang", F.col("share").alias("budget")), ["domain", "lang"])
    last = filled(last.withColumn("weight", weight_of(weights.get("source", {}), F.col("source"), other["source"])), ["domain", "lang"], "source")
    whole = F.floor(F.col("share") + 1e-6)
    last = last.select(*LEAF, "available", "docs", whole.alias("budget"), F.when(F.col("available") > 0, F.floor(whole / F.col("available"))).otherwise(F.lit(0)).alias("full"))
    return last.withColumn("rest", F.col("budget") - F.col("full") * F.col("available"))


def with_leaf(docs: DataFrame, domain: Column, text: str = "text", lang: str = "lang", source: str = "source", doc_id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """The carried columns with doc_id, domain, lang, source and n_tokens, the count of words."""
    made = {"doc_id", "n_tokens", *LEAF}
    keep = [F.col(f"`{c}`") for c in (carry or []) if c.lower() not in made]
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(*keep, F.col(doc_id).alias("doc_id"), name(domain).alias("domain"), name(F.col(lang)).alias("lang"), name(F.col(source)).alias("source"), words.alias("n_tokens"))


def mixed(
    base: DataFrame,
    weights: dict[str, dict[str, float]],
    budget: float | None = None,
    part: float = 0.5,
    epochs: int = 4,
    seed: int = 3,
    other: dict[str, float] | None = None,
) -> DataFrame:
    """Of rows made by `with_leaf` those taken, with `full_epochs` (times taken whole), `prefix_tokens`
    (what the last epoch's prefix takes) and `taken_tokens` (both together).

    `weights` has weights by name for each level, `other` those of names without one (1 by
    default). The budget is `budget` tokens, or `part` of all tokens.
    """
    other = {"domain": 1.0, "lang": 1.0, "source": 1.0} | (other or {})
    leaves = cut(base.groupBy(*LEAF).agg(F.sum("n_tokens").alias("available"), F.count("*").alias("docs")))
    plan = cut(budgets(leaves, budget, part, epochs, weights, other))
    facts = plan.agg(F.count("*").alias("n"), F.max("docs").alias("docs")).first()
    small = (lambda df: F.broadcast(df)) if facts["n"] <= FEW_LEAVES else (lambda df: df)
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, (facts["docs"] or 1) / ROWS_OF_BUCKET))))

    spot = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    rows = base.where("n_tokens > 0").join(small(plan.select(*LEAF, F.col("full").alias("__full"), F.col("rest").alias("__rest"))), list(LEAF)).withColumn("__h", spot).withColumn("__b", F.shiftright("__h", 60 - bits))
    sums = rows.groupBy(*LEAF, "__rest", "__b").agg(F.sum("n_tokens").alias("__t"))
    upto = W.partitionBy(*LEAF).orderBy("__b").rowsBetween(W.unboundedPreceding, 0)
    sums = sums.withColumn("__upto", F.sum("__t").over(upto))
    # The first bucket that reaches the rest holds the prefix's end; the buckets before it are taken whole.
    edge = sums.where(F.col("__upto") >= F.col("__rest")).groupBy(*LEAF).agg(F.min(F.struct("__b", (F.col("__upto") - F.col("__t")).alias("before"))).alias("__e"))
    edge = cut(edge.select(*LEAF, F.col("__e.__b").alias("__edge"), F.col("__e.before").alias("__before")))
    rows = rows.join(small(edge), list(LEAF))
    made = ("full_epochs", "prefix_tokens", "taken_tokens")
    out = [F.col(f"`{c}`") for c in base.columns if c.lower() not in made]
    # Rows of one id and size are told apart by what else can be put in order.
    ties = [F.col(f"`{c.name}`") for c in base.schema if c.name.lower() not in ("doc_id", "n_tokens", *LEAF) and isinstance(c.dataType, ORDERED)]
    whole = rows.where(F.col("__b") != F.col("__edge")).withColumn("prefix_tokens", F.when(F.col("__b") < F.col("__edge"), F.col("n_tokens")).otherwise(F.lit(0).cast("long")))
    order = W.partitionBy(*LEAF).orderBy("__h", "doc_id", "n_tokens", *ties).rowsBetween(W.unboundedPreceding, -1)
    partly = rows.where(F.col("__b") == F.col("__edge")).withColumn("__start", F.col("__before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    partly = partly.withColumn("prefix_tokens", F.least(F.col("n_tokens"), F.greatest(F.lit(0).cast("long"), F.col("__rest") - F.col("__start"))))
    taken = whole.select(*out, F.col("__full").alias("full_epochs"), "prefix_tokens").union(partly.select(*out, F.col("__full").alias("full_epochs"), "prefix_tokens"))
    taken = taken.withColumn("taken_tokens", F.col("full_epochs") * F.col("n_tokens") + F.col("prefix_tokens"))
    return taken.where("taken_tokens > 0")
