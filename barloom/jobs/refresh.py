"""Keeping the table of clean bars up to date: batches of quotes go into one partitioned dataset.

One dataset, partitioned by year, takes the place of a file for each symbol.  A batch rewrites the
years that it has quotes of and leaves the others alone, so the work grows with the batch and its
years, not with the history.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from barloom.operators import ingest, returns
from barloom.sources.tables import delete, discard, read_optional, replace_partitions, stored, write_csv

YEAR = "year"


@dataclass(frozen=True)
class Refreshed:
    """What a batch changed: year, bars_before, bars_in_batch and bars_after, a row for each year."""

    years: DataFrame


def standard_batch(quotes: DataFrame, order_col: str, sources: Sequence[str] | None = ingest.SOURCES) -> DataFrame:
    """Vendor quotes in standard columns, of one source a symbol (``sources`` None: as they come)."""
    keep = tuple(c for c in ("source", order_col) if c in quotes.columns)
    standard = ingest.normalize_columns(quotes, keep=keep)
    return ingest.select_source_by_priority(standard, tuple(sources)) if sources else standard


def refresh_bars(quotes: DataFrame, path: str, order_col: str, sources: Sequence[str] | None = ingest.SOURCES) -> Refreshed:
    """Put a batch of vendor quotes into the table of clean bars at ``path``, which may not exist yet.

    The batch is standardised and cleaned.  Its keys (symbol, date) replace those of the table, also
    where their last quote is no valid bar: the key is then gone.  Columns that the batch or the
    table lacks are null.  An empty batch changes nothing, and without any bar no table is made.

    The batch is stored as one row a key, its last quote; all else follows from that.  Only the years of
    the batch are read and rewritten.  The new partitions are written beside the old ones and take their
    place when the job is done, so the table is read and overwritten at once, and what a year has left
    is counted while it is written.  A batch that is put in again after a failure gives the same table.
    """
    spark = quotes.sparkSession
    last = ingest.last_quotes(standard_batch(quotes, order_col, sources), order_col).drop(order_col)
    batch = stored(last.withColumn(YEAR, F.year("date")), "batch")
    per_year = lambda df, n: {r[YEAR]: r["n"] for r in df.groupBy(YEAR).agg(n.alias("n")).collect()}  # noqa: E731  # as many as the calendar has
    new = per_year(batch, F.count_if(ingest.is_bar()))
    table = read_optional(spark, path) if new else None
    merged, before = batch.filter(ingest.is_bar()), {}
    if table is not None:
        old = table.filter(F.col(YEAR).isin(*new))
        before = per_year(old, F.count("*"))
        # rows that stay of the years in question; a left anti join keeps rows of no matching key
        merged = old.join(batch.select("date", "symbol"), ["date", "symbol"], "left_anti").unionByName(merged, allowMissingColumns=True)
    after = {}
    if before or any(new.values()):
        seen = Observation()
        replace_partitions(merged.observe(seen, *(F.count_if(F.col(YEAR) == y).alias(str(y)) for y in new)), path, (YEAR,))
        after = seen.get
    for year in before:
        if not after[str(year)]:  # no rows could replace its partition
            delete(spark, f"{path}/{YEAR}={year}")
    discard(batch)
    told = [(y, before.get(y, 0), new[y], after.get(str(y), 0)) for y in sorted(new)]
    return Refreshed(spark.createDataFrame([t for t in told if any(t[1:])], f"{YEAR} int, bars_before long, bars_in_batch long, bars_after long"))


def read_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of the table, from start to end where given; other years' partitions are not read."""
    bars = spark.read.parquet(path)
    if start:
        bars = bars.filter((F.col(YEAR) >= F.year(F.lit(start).cast("date"))) & (F.col("date") >= F.lit(start).cast("date")))
    if end:
        bars = bars.filter((F.col(YEAR) <= F.year(F.lit(end).cast("date"))) & (F.col("date") <= F.lit(end).cast("date")))
    return bars.drop(YEAR)


def index_bars(quotes: DataFrame, names: DataFrame | Mapping[str, str], order_col: str) -> DataFrame:
    """Clean bars of the named indices with ``index_name``."""
    named = ingest.tag_index_name(standard_batch(quotes, order_col, None), names if isinstance(names, DataFrame) else dict(names))
    return ingest.clean_ohlcv(named, order_col).drop(order_col)


def write_risk_summaries(stocks: DataFrame, indices: DataFrame, folder: str, chunk_days: int | None = None) -> None:
    """The risk metrics of stocks and of indices as two CSV tables."""
    for name, bars in (("stock_risk_summary", stocks), ("index_risk_summary", indices)):
        write_csv(returns.risk_summary(bars, chunk_days=chunk_days), f"{folder}/{name}")
