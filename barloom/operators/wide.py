"""Statistics of very wide dates, without a date's rows in one task.

A window by date puts a whole date into one task.  Here quantiles come from histograms that are
narrowed pass by pass, and ranks from a range partitioning by value with the counts of partitions
added up in order.  What is known of a cell (a date, or a factor and a date) then meets its rows:
as a broadcast while it is of a checked size, else by a join in which a cell's rows are dealt to
several tasks and what is known of it is copied to each.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.tables import discard, stored

#: Rows of a table of cells that are broadcast at most, and parts of a cell beyond that.
MOST_BROADCAST, SALTS = 200_000, 64
#: Bins of a histogram.
BINS = 256
#: Rows of one value that meet in a task, at most.
TIED = 10_000


def meet(rows: DataFrame, known: DataFrame, cell: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows joined with what is known of their cell; ``known`` is stored, so that it can be counted."""
    if known.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(known), list(cell), how)
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    # merged, as Spark would size the copies by the table that they are made of, and broadcast them
    copies = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return rows.withColumn("_salt", salt).join(copies, [*cell, "_salt"], how).drop("_salt")


def order_statistics(long: DataFrame, ranks: DataFrame, bins: int = BINS) -> DataFrame:
    """date, column, rank, value: the value with each rank (from 0) of ``ranks`` (date, column, rank)
    among the values of ``long`` (date, column, value).

    Each pass counts the values of a range in equal bins, by task first, so no task or shuffle holds
    more than the bins of each rank; the range then shrinks to the values of the bin with the rank.
    A range of one value, or a rank at either end of its range, is found.  The result is stored.
    """
    ends = long.groupBy("date", "column").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count("*").alias("_size"))
    found = F.when((F.col("_lo") == F.col("_hi")) | (F.col("rank") == F.col("_below")), F.col("_lo")).when(F.col("rank") == F.col("_below") + F.col("_size") - 1, F.col("_hi"))
    left = stored(ranks.join(ends, ["date", "column"]).withColumn("_below", F.lit(0).cast("long")).withColumn("value", found), "ranks")
    passes = [left]
    # halves, as the span of two doubles may not be a double; where it is none or 0 all but the ends share a bin
    part = F.try_divide(F.col("value") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2)
    part = F.when(F.col("value") == F.col("_lo"), 0.0).when(F.col("value") == F.col("_hi"), 1.0).otherwise(F.nanvl(F.coalesce(part, F.lit(0.5)), F.lit(0.5)))
    while not (left := left.filter("value is null").drop("value")).isEmpty():
        inside = meet(long, left, ("date", "column")).filter(F.col("value").between(F.col("_lo"), F.col("_hi")))
        binned = inside.withColumn("_bin", F.least(F.floor(part * bins), F.lit(bins - 1)))
        counted = binned.groupBy("date", "column", "rank", "_below", "_bin").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count("*").alias("_size"))
        w = Window.partitionBy("date", "column", "rank").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        added = counted.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_size").over(w), F.lit(0))).drop("_bin")
        hit = added.filter((F.col("_below") <= F.col("rank")) & (F.col("rank") < F.col("_below") + F.col("_size")))
        left = stored(hit.withColumn("value", found), "ranks")
        passes.append(left)
    each = [p.filter("value is not null").select("date", "column", "rank", "value") for p in passes]
    done = stored(reduce(DataFrame.unionByName, each), "order_statistics")
    discard(*passes)
    return done


def quantiles_by_date(data: DataFrame, columns: Sequence[str], quantiles: Sequence[float], bins: int = BINS) -> DataFrame:
    """date and, for each column, ``_q_<column>``: an array of its exact quantiles, interpolated
    between two ranks like ``percentile``. Nulls and NaN don't count."""
    long = data.unpivot(["date"], list(columns), "column", "value").filter("value is not null and not isnan(value)")
    sizes = long.groupBy("date", "column").agg(F.count("*").alias("n"))
    at = lambda q: (F.col("n") - 1) * F.lit(float(q))
    wanted = stored(sizes.select("date", "column", "n", F.array_distinct(F.array(*(f(at(q)) for q in quantiles for f in (F.floor, F.ceil)))).alias("ranks")), "wanted")
    values = order_statistics(long, wanted.select("date", "column", F.explode("ranks").alias("rank")), bins)
    by_rank = values.groupBy("date", "column").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("by_rank"))  # two ranks a quantile

    def interpolated(q: float) -> Column:
        low, high = F.floor(at(q)), F.ceil(at(q))
        a, b = F.element_at("by_rank", low), F.element_at("by_rank", high)
        return F.when((low == high) | (a == b), a).otherwise((high - at(q)) * a + (at(q) - low) * b)

    rows = wanted.join(by_rank, ["date", "column"]).select("date", "column", F.array(*map(interpolated, quantiles)).alias("q"))
    return rows.groupBy("date").agg(*(F.max(F.when(F.col("column") == c, F.col("q"))).alias(f"_q_{c}") for c in columns))


def positions(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows in the order of the columns with their place ``_at`` in it: a range partitioning, a sort
    within partitions, and the counts of the partitions, one row each, added up."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    kept = stored(ordered, "ordered").withColumns({"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND((1 << 33) - 1)})
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))  # one row a partition
    return kept.join(F.broadcast(starts), "_part").withColumn("_at", F.col("_start") + F.col("_row")).drop("_part", "_row", "_start", "_id")


def row_numbers(rows: DataFrame, cell: Sequence[str], order: Sequence[str], number: str, size: str | None = None) -> DataFrame:
    """Rows with their number in their cell, from 1, and the cell's size."""
    placed = positions(rows, [*cell, *order])
    cells = stored(placed.groupBy(*cell).agg(F.min("_at").alias("_first"), F.count("*").alias(size or "_size")), "cells")
    numbered = meet(placed, cells, cell).withColumn(number, F.col("_at") - F.col("_first") + 1)
    return numbered.drop("_at", "_first", *([] if size else ["_size"]))


def average_ranks(rows: DataFrame, cell: Sequence[str], value: str, tie: Sequence[str], name: str) -> DataFrame:
    """Rows with the rank of ``value`` in their cell; equal values share the mean of their ranks.

    ``tie`` only spreads equal values over partitions.  Equal values have numbers in a row: they are
    counted by task first, cut by their numbers into parts of TIED, and rows meet the part that they
    are in, by a shuffle.  So there are never more of these than rows, and none is broadcast.
    """
    numbered = stored(row_numbers(rows, cell, [value, *tie], "_row"), "numbered")  # read twice
    key = [*cell, value]
    equal = numbered.groupBy(*key).agg(F.min("_row").alias("_low"), F.max("_row").alias("_high")).filter("_low < _high")
    part = lambda c: F.floor(F.col(c) / TIED)
    parts = equal.withColumn("_tied", F.explode(F.sequence(part("_low"), part("_high")))).hint("merge")
    ranked = numbered.withColumn("_tied", part("_row")).join(parts, [*key, "_tied"], "left")
    return ranked.withColumn(name, F.coalesce((F.col("_low") + F.col("_high")) / 2, F.col("_row").cast("double"))).drop("_tied", "_row", "_low", "_high")
