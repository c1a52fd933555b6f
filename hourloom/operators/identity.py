"""Results under one name that belong to different people: conflicts and the greedy split.

days: ident, file_seq, d, total (one row a day of a result).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.sources.staged import staged

#: Dates on which totals must differ, and by how much, for two results to conflict.
LEAST_DATES, SLACK = 2, 0.5
#: About how many results of a class, and how many classes of a total, stand in one row where all are paired with all.
MEMBERS, BLOCK = 1024, 256


def day_maps(entries: DataFrame) -> DataFrame:
    """The last entry's total of each result and date."""
    return entries.groupBy("ident", "file_seq", "d").agg(F.max_by("total", "entry_seq").alias("total")).where("total is not null")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many tasks as shuffles have: few bytes that become many rows aren't put into one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def result_classes(days: DataFrame) -> DataFrame:
    """ident, file_seq, class, size, days: results of an ident with the same days and totals are one class of that size, named by the first,
    which alone has days (array of d, total)."""
    listed = F.sort_array(F.collect_list(F.struct("d", "total")))
    # A total that isn't finite differs from itself: such a result is a class of its own.
    odd = F.exists("days", lambda x: ~(F.abs(x["total"]) < float("inf")))
    maps = spread(days, "ident", "file_seq").groupBy("ident", "file_seq").agg(listed.alias("days"))
    maps = staged(maps.withColumn("alone", F.when(odd, F.col("file_seq").cast("string")).otherwise(F.lit(""))), "result-maps")
    same = maps.groupBy("ident", "days", "alone").agg(F.min("file_seq").alias("class"), F.count("*").alias("size"))
    first = F.when(F.col("file_seq") == F.col("class"), F.col("days")).alias("days")
    return staged(maps.join(same, ["ident", "days", "alone"]).select("ident", "file_seq", "class", "size", first), "result-classes")


def dealt(key: str, count: str, most: int) -> Column:
    """Which of as many parts, of some most rows each, a row of count rows falls into."""
    return F.pmod(F.xxhash64(key), F.ceil(F.col(count) / most))


def differences(maps: DataFrame) -> DataFrame:
    """ident, x, y, dates: classes of one ident that differ on two or more shared dates, x < y.

    Classes that have the same total on a date stand in one row, in blocks of some BLOCK, and only rows whose totals differ are brought
    together. All dates of two blocks are counted in one place, so that what is sent is lists of classes and not their pairs.
    """
    own = maps.where("days is not null").select("ident", "class", "days")
    own = own.join(own.where("ident is not null").groupBy("ident").agg(F.count("*").alias("classes")), "ident").withColumn("block", dealt("class", "classes", BLOCK))
    lists = own.select("ident", "class", "block", F.inline("days")).groupBy("ident", "d", "total", "block").agg(F.collect_list("class").alias("all"))
    side = lambda total, block, name: lists.select("ident", "d", F.col("total").alias(total), F.col("block").alias(block), F.col("all").alias(name))
    apart = (F.col("low") <= F.col("high")) & (F.abs(F.col("low") - F.col("high")) > SLACK)
    met = side("low", "i", "xs").join(side("high", "j", "ys"), ["ident", "d"]).where(apart)
    met = met.select("ident", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), (F.col("low") < F.col("high")).alias("apart"), "xs", "ys")
    met = spread(met, "ident", "i", "j").withColumn("p", F.explode("xs")).withColumn("q", F.explode("ys")).where("apart or p < q")
    pair = [F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")]
    return met.groupBy("ident", "i", "j", *pair).agg(F.count("*").alias("dates")).where(F.col("dates") >= LEAST_DATES).select("ident", "x", "y", "dates")


def conflict_pairs(days: DataFrame) -> DataFrame:
    """ident, a, b, dates: pairs of results of one ident that differ on two or more shared dates.

    Results of one class differ from others alike, so one of each is compared, and the pairs of classes are told to their members at
    the end, some MEMBERS of one class with as many of another in a row that any task may expand: work follows the differences of classes
    and the pairs returned, which are quadratic where all results contradict one another, in time and not in memory.
    """
    maps = result_classes(days)
    parts = maps.withColumn("part", dealt("file_seq", "size", MEMBERS)).groupBy("ident", "class", "part").agg(F.collect_list("file_seq").alias("files"))
    member = lambda of, part, name: parts.select("ident", F.col("class").alias(of), F.col("part").alias(part), F.col("files").alias(name))
    found = differences(maps).join(member("x", "i", "ps"), ["ident", "x"]).join(member("y", "j", "qs"), ["ident", "y"])
    found = spread(found, "ident", "x", "y", "i", "j").select("ident", "dates", "qs", F.explode("ps").alias("p")).select("ident", "dates", "p", F.explode("qs").alias("q"))
    return found.select("ident", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "dates")


def first_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First fit of rows sorted by ident, part, file_seq and d: a result joins the first cluster of its part whose merged days (the first
    value counts) it doesn't contradict. Held are one result's days and the clusters' merged days, not the rows of a part."""
    key, mine = None, {}
    clusters: list[dict] = []

    def fit() -> int:
        k = next((k for k, seen in enumerate(clusters) if sum(abs(seen[d] - t) > SLACK for d, t in mine.items() if d in seen) < LEAST_DATES), len(clusters))
        if k == len(clusters):
            clusters.append({})
        clusters[k] = mine | clusters[k]
        return k

    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c) for c in (zip(*rows, strict=True))], ["ident", "file_seq", "cluster"])
    for batch in batches:
        out = []
        for ident, part, file_seq, d, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (ident, part, file_seq) != key:
                if key is not None:
                    out.append((key[0], key[2], fit()))
                    if key[:2] != (ident, part):
                        clusters.clear()
                key, mine = (ident, part, file_seq), {}
            mine[d] = total
        if out:
            yield table(out)
    if key is not None:
        yield table([(key[0], key[2], fit())])


def parts_of(days: DataFrame) -> DataFrame:
    """ident, file_seq, part of results that are tied by dates with unequal totals: part is the smallest file_seq reachable.

    On a date with several totals each result is tied to one with another total, so all of that date are one part: a star around the
    date's first result says as much as all pairs. Labels go along the ties and then to their label's label, until none changes;
    each round is a staged table.
    """
    by_date = days.groupBy("ident", "d").agg(F.min("file_seq").alias("first"), F.min("total").alias("low"), F.max("total").alias("high")).where("low <> high")
    star = days.join(by_date.select("ident", "d", "first"), ["ident", "d"]).select("ident", F.col("file_seq").alias("a"), F.col("first").alias("b")).distinct()
    ties = staged(star.unionByName(star.select("ident", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ties")
    now = staged(ties.groupBy("ident", F.col("a").alias("file_seq")).agg(F.min("b").alias("part")).withColumn("part", F.least("part", "file_seq")), "parts")
    while True:
        near = ties.join(now.select("ident", F.col("file_seq").alias("a"), "part"), ["ident", "a"]).groupBy("ident", F.col("b").alias("file_seq")).agg(F.min("part").alias("near"))
        heard = now.join(near, ["ident", "file_seq"]).select("ident", "file_seq", F.col("part").alias("old"), F.least("part", "near").alias("part"))
        heads = heard.select("ident", F.col("file_seq").alias("part"), F.col("part").alias("further"))
        new = staged(heard.join(heads, ["ident", "part"]).select("ident", "file_seq", "old", F.least("part", "further").alias("part")), "parts")
        if new.where("part < old").isEmpty():
            return new.drop("old")
        now = new.drop("old")


def split_conflicting(days: DataFrame) -> DataFrame:
    """ident, file_seq, cluster: an ident's results in order, each in the first cluster that it doesn't contradict.

    Only dates with unequal totals can tell results apart, so an ident falls into parts that share no such date, and first fit within
    each gives every result the number that first fit over the whole ident gives it: other parts' days are equal to its own or absent.
    Results that contradict nobody on two dates are cluster 0 without Python; a part's results stream in order through one task.
    """
    spread = days.groupBy("ident", "d").agg((F.max("total") - F.min("total")).alias("s")).groupBy("ident").agg(F.count_if(F.col("s") > SLACK).alias("dates"))
    days = staged(days.select("ident", "file_seq", "d", "total"), "result-days")
    hard = days.join(spread.where(F.col("dates") >= LEAST_DATES).select("ident"), "ident", "left_semi")
    parts = parts_of(hard)
    rows = hard.join(parts, ["ident", "file_seq"]).select("ident", "part", "file_seq", "d", "total")
    kinds = dict(days.dtypes)
    fitted = rows.repartition("ident", "part").sortWithinPartitions("ident", "part", "file_seq", "d").mapInArrow(
        first_fit, f"ident {kinds['ident']}, file_seq {kinds['file_seq']}, cluster long",
    )
    alone = days.select("ident", "file_seq").distinct().join(parts, ["ident", "file_seq"], "left_anti")
    return fitted.unionByName(alone.withColumn("cluster", F.lit(0).cast("long")))
