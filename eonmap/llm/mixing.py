"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket. A source's budget falls into one bucket of its
histogram; only the rows of that boundary bucket are counted again by the next bits of the hash,
level by level. What is left is one threshold per source, and the mix is a plain filter on
``hash < threshold``: no row is ever sorted or ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eonmap.llm.common import materialise

#: Bits of the hash taken at each level; levels times bits are 48, which a double or long holds.
BITS, LEVELS = 12, 4
#: White space that parts words: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"


def size_of(text: Column) -> Column:
    """Number of words; null has none."""
    inner = F.size(F.split(text, SPACE + "+")) - F.rlike(text, F.lit("^" + SPACE)).cast("int") - F.rlike(text, F.lit(SPACE + r"\z")).cast("int")
    return F.when(F.length(text) > 0, inner).otherwise(0).cast("long")


def hash48(doc_id: Column, text: Column) -> Column:
    """48 bits of the MD5 of id and text, as a long from 0. It does not depend on the partition."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, 12), 16, 10).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> target: ``share`` of all sizes by weight, none above ``most`` times its source.

    Sources in order of code points, null last, weigh ``weights`` in turn. Sharing the excess anew
    until none is above has a closed form: sources fill up in the order of cap over weight, and the
    rest share what is left by weight. One row a source stands in one window, never a document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), nth.cast("int") + 1)
    out = totals.withColumn("w", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.withColumn("all_size", F.sum("source_size").over(everything))
    rate = (F.lit(share) * F.col("all_size") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    out = out.withColumn("rate", rate)
    # the first source, in filling order, that its share does not fill: its rate is the final one
    out = out.withColumn("final", F.min(F.when(F.col("rate") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("k"), F.col("rate").alias("r")))).over(everything))
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final.r") * F.col("w")))
    return out.select("source", "source_size", target.cast("double").alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def thresholds(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """(source, hash, size) rows and (source, target, source_size) -> whole, below.

    Every row is taken ``whole`` times, and once more if its hash is under ``below``. Rows of one
    hash value are taken together. At the last level the boundary bucket is taken if that comes
    nearer to the budget than leaving it.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = goal.withColumn("whole", whole).select(
        "source", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = rows.join(state.withColumnRenamed("source", "s"), _same(F.col("source"), F.col("s")))
        if level:
            inside = inside.where(F.shiftright("hash", shift + BITS) == F.col("prefix"))
        hist = inside.groupBy("s", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        hist = hist.join(state.withColumnRenamed("source", "z").withColumnRenamed("budget", "b0").select("z", "b0"), _same(F.col("s"), F.col("z")))
        # the boundary bucket: the last whose rows before it fit into the budget
        at = F.max(F.when(F.col("before") <= F.col("b0"), F.struct("bucket", "before", "n")))
        found = hist.groupBy("s").agg(at.alias("at")).withColumnRenamed("s", "y")
        state = state.join(found, _same(F.col("source"), F.col("y")), "left").select(
            "source", "whole", (F.col("budget") - F.coalesce(F.col("at.before"), F.lit(0))).alias("budget"),
            F.coalesce(F.col("at.bucket"), F.lit(0)).alias("prefix"), F.coalesce(F.col("at.n"), F.lit(0)).alias("n"))
        state = materialise(state if level == LEVELS - 1 else state.drop("n"))
    near = F.when((F.col("n") - F.col("budget")) < F.col("budget"), 1).otherwise(0)
    return state.select("source", "whole", (F.col("prefix") + near).alias("below"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per document: id, source, hash, size, source_size, target, copies, taken.

    Nulls: a null text has size 0, a null source is a source of its own and comes last, a null id
    hashes as the empty string. Repeated rows and rows of equal id and text have one hash and are
    taken alike. An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    rows = materialise(docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
        hash48(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("hash"), size_of(F.col(f"`{text_col}`")).alias("size")))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = materialise(targets(totals, weights, share, most))
    rule = thresholds(rows.select("source", "hash", "size"), goal)
    per = goal.join(rule.withColumnRenamed("source", "r"), _same(F.col("source"), F.col("r"))).drop("r").withColumnRenamed("source", "g")
    out = rows.join(per, _same(F.col("source"), F.col("g")))
    copies = F.col("whole") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0)
    return out.select("doc_id", "source", "hash", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
