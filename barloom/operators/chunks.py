"""Windows over long histories, without a symbol's whole history in one task.

A history is cut twice.  By time, into chunks of so many days: what a chunk must know of all before
it, its first row's number and the last known price, comes from one small row a chunk, added up in
order.  Then by row number, into blocks of so many rows, each with a halo of the rows that its
windows reach on both sides.  Windows go by (symbol, chunk) and (symbol, block), so a task holds one
chunk or block; a symbol's chunk rows meet in one task, its bars don't.

Bars have a symbol and a date, unique together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Chunks:
    """Days of a chunk and rows of a block."""

    days: int = 366
    rows: int = 2048

    def __post_init__(self) -> None:
        if self.days < 1 or self.rows < 1:
            raise ValueError("a chunk needs a day, and a block a row")


def time_chunk(days: int) -> Column:
    return F.floor(F.unix_date("date") / days)


def by_chunk() -> WindowSpec:
    return Window.partitionBy("symbol", "_chunk").orderBy("date")


def before_chunk() -> WindowSpec:
    """A symbol's earlier chunks, of which there is one small row each."""
    return Window.partitionBy("symbol").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def numbered(bars: DataFrame, days: int) -> DataFrame:
    """Bars with ``_chunk`` and their number ``_n`` in the symbol, from 0; with a close also with
    ``_p`` (last known close) and ``_r`` (its return)."""
    rows = bars.withColumn("_chunk", time_chunk(days))
    has_close = "close" in bars.columns
    last = [F.max_by("close", F.when(F.col("close").isNotNull(), F.col("date"))).alias("_last")] if has_close else []
    facts = rows.groupBy("symbol", "_chunk").agg(F.count("*").alias("_rows"), *last)
    carry = [F.last("_last", ignorenulls=True).over(before_chunk()).alias("_carry")] if has_close else []
    starts = facts.select("symbol", "_chunk", F.coalesce(F.sum("_rows").over(before_chunk()), F.lit(0)).alias("_start"), *carry)
    w = by_chunk()
    out = rows.join(starts, ["symbol", "_chunk"]).withColumn("_n", F.col("_start") + F.row_number().over(w) - 1).drop("_start")
    if has_close:
        known = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("_p", F.coalesce(known, F.col("_carry")))
        out = out.withColumn("_r", F.try_divide("_p", F.coalesce(F.lag("_p").over(w), F.col("_carry"))) - 1).drop("_carry")
    return out


def by_block() -> WindowSpec:
    return Window.partitionBy("symbol", "_block").orderBy("_n")


def with_halo(rows: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """``numbered`` rows dealt to their block and to the blocks whose halo they are in; ``_own``
    tells which.  A block smaller than the halo takes rows of several others."""
    first = F.greatest(F.floor((F.col("_n") - after) / size), F.lit(0))
    dealt = rows.withColumn("_block", F.explode(F.sequence(first, F.floor((F.col("_n") + before) / size))))
    return dealt.withColumn("_own", F.floor(F.col("_n") / size) == F.col("_block"))


def windowed(bars: DataFrame, chunks: Chunks, before: int, after: int, columns: dict[str, Column]) -> DataFrame:
    """date, symbol and the columns, which are windows over ``by_block()`` that reach so many rows
    back and ahead."""
    dealt = with_halo(numbered(bars, chunks.days), chunks.rows, before, after)
    return dealt.select("date", "symbol", "_own", *(c.alias(n) for n, c in columns.items())).filter("_own").drop("_own")


def last_before(rows: DataFrame, days: int, value: str, order: Column) -> DataFrame:
    """``rows`` (symbol, date, ``value``, null where a row has none) with ``_chunk`` and ``_carry``:
    the last value of all earlier chunks.  ``order`` tells which of a chunk's values is the last."""
    chunked = rows.withColumn("_chunk", time_chunk(days))
    ends = chunked.groupBy("symbol", "_chunk").agg(F.max_by(value, F.when(F.col(value).isNotNull(), order)).alias("_end"))
    carried = ends.select("symbol", "_chunk", F.last("_end", ignorenulls=True).over(before_chunk()).alias("_carry"))
    return chunked.join(carried, ["symbol", "_chunk"])
