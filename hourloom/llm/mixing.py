"""Mix sources to target weights by hash thresholds, without sorting documents.

Each row has a 60-bit hash of doc_id and text. Per source, sizes are summed by hash bucket; the bucket in which the running
sum crosses the source's budget is split again, and only its rows are read for that, until one hash is left. Rows below
the threshold are taken once more than the others.

A null text has size 0; rows of size 0 are taken as often as their hash says, at most the whole passes and one. Rows with a null source form a source of their own, the last. Rows that share a hash (repeated rows)
are taken or left together. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from hourloom.llm.store import materialise

#: Bits of the hash, and bits by which a level refines the one before.
HASH_BITS, LEVEL_BITS = 60, 10

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and hash of each row; written once, so that texts are read once."""
    return materialise(
        docs.select(
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - HASH_BITS).alias("h"),
        ),
        "sized",
    )


def targets(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size, target: one row a source.

    Shares by weight are cut at most * source_size and the excess goes to the others: the level at which the cut shares
    add up is found by walking the sources in the order in which they are cut.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    before = W.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    return (
        sums.withColumn("weight", weight)
        .withColumn("level", level)
        .withColumn("target", F.least(cap, F.max("level").over(every) * F.col("weight")))
        .select("source", "source_size", "target")
    )


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """For each source: whole passes (base), and the hash up to which rows are taken once more.

    plan: source, source_size, target.
    """
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("base", base.cast("long"))
    plan = plan.withColumn("budget", F.col("target") - F.col("base") * F.col("source_size"))
    state = materialise(
        plan.select("source", "source_size", "target", "base", "budget", F.lit(0).cast("long").alias("acc"), F.lit(None).cast("long").alias("cut"), F.lit(0).cast("long").alias("group")),
        "mix-plan",
    )
    inside = rows
    for done in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        bucket = F.shiftrightunsigned("h", HASH_BITS - done)
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(
            F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high")
        )
        upto = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        run = sums.withColumn("upto", F.sum("size").over(upto))
        over = (
            run.join(state.select("source", "budget", "acc"), run["source"].eqNullSafe(state["source"]))
            .where(F.col("acc") + F.col("upto") > F.col("budget"))
            .groupBy(run["source"])
            .agg(F.min(F.struct("bucket", "size", "upto", "low", "high")).alias("at"))
            .select(F.col("source").alias("s"), "at.*")
        )
        state = materialise(
            state.drop("bucket", "low", "high").join(over, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source", "source_size", "target", "base", "budget",
                (F.col("acc") + F.coalesce(F.col("upto") - F.col("size"), F.lit(0))).alias("acc"),
                F.coalesce("low", "cut").alias("cut"),
                F.coalesce("size", "group").alias("group"),
                "bucket", "low", "high",
            ),
            "mix-level",
        )
        open_ = state.where(F.col("low") < F.col("high")).select(F.col("source").alias("s"), F.col("bucket").alias("b"))
        if done == HASH_BITS or open_.isEmpty():
            break
        # Sources that are settled leave; the others are read in their boundary bucket only.
        inside = materialise(
            inside.join(open_, F.col("source").eqNullSafe(F.col("s")) & (bucket == F.col("b")), "left_semi"), "mix-bucket"
        )
    with_group = F.col("acc") + F.col("group") - F.col("budget") < F.col("budget") - F.col("acc")
    return state.select("source", "source_size", "target", "base", "cut", with_group.alias("with_cut"), (F.col("budget") > 0).alias("partial"))


def _times(h: Column, cuts: DataFrame) -> Column:
    """How often a row of hash h is taken, given its source's thresholds."""
    once_more = (h < cuts["cut"]) | ((h == cuts["cut"]) & cuts["with_cut"])
    # A source whose whole passes meet its target takes nothing more, not even documents of size 0.
    return cuts["base"] + (F.coalesce(once_more, F.lit(False)) & cuts["partial"]).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target and times: how often the mix takes the row, 0, 1 or 2 for most = 2.

    Sources in code-point order, null last, weigh as in weights, repeating. They share share * all sizes; a source gets
    most * its own size at most. What a source gets differs from its target by less than the size of one document
    (or of one group of repeated rows).
    """
    rows = sized(docs)
    cuts = thresholds(rows, targets(rows, weights, share, most))
    return rows.join(cuts, _same(rows, cuts)).select(
        "doc_id", rows["source"], "size", "source_size", "target", _times(rows["h"], cuts).alias("times")
    )


def take(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: docs' rows with all their columns, each as often as the mix takes it. The texts aren't shuffled."""
    rows = sized(docs)
    cuts = thresholds(rows, targets(rows, weights, share, most))
    h = F.shiftrightunsigned(F.xxhash64(docs["doc_id"], docs["text"]), 64 - HASH_BITS)
    copies = F.explode(F.array_repeat(F.lit(0), _times(h, cuts).cast("int")))
    return docs.join(cuts, _same(docs, cuts)).select(*[docs[c] for c in docs.columns], copies.alias("__copy")).drop("__copy")
