"""Forward returns, and the factor dataset for evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.columns import as_date, as_double, by_symbol, pad_symbol, require
from barloom.operators.chunks import Chunks, by_block, windowed
from barloom.operators.wide import meet, quantiles_by_date
from barloom.sources.tables import stored

#: Names of the label timings.
TIMINGS = ("next_open_to_horizon_open", "next_open_to_horizon_close", "close_to_close")


def label_prices(horizon: int, timing: str, w: WindowSpec | None = None) -> tuple[Column, Column]:
    """Entry and exit price, looked up ahead without filling."""
    ahead = lambda c, n: F.lead(c, n).over(by_symbol() if w is None else w)
    if timing == TIMINGS[0]:
        return ahead("open", 1), ahead("open", horizon + 1)
    if timing == TIMINGS[1]:
        return ahead("open", 1), ahead("close", horizon)
    if timing == TIMINGS[2]:
        return F.col("close"), ahead("close", horizon)
    raise ValueError(f"timing must be one of {TIMINGS}")


def add_forward_return(prices: DataFrame, horizon: int, timing: str = TIMINGS[0], chunks: Chunks | None = None) -> DataFrame:
    """date, symbol, entry_price, exit_price, forward_return, label_timing; rows without a full
    horizon ahead have null.  ``chunks`` cuts histories as in ``build_price_factors``."""
    entry, exit_ = label_prices(horizon, timing, by_block() if chunks else None)
    wanted = ("close",) if timing == TIMINGS[2] else ("open",) if timing == TIMINGS[0] else ("open", "close")
    require(prices, "date", "symbol", *wanted)
    bars = prices.select(as_date("date").alias("date"), pad_symbol(F.col("symbol")).alias("symbol"), *(as_double(c).alias(c) for c in wanted))
    wanted_prices = {"entry_price": entry, "exit_price": exit_}
    priced = windowed(bars, chunks, 0, horizon + 1, wanted_prices) if chunks else bars.select("date", "symbol", *(c.alias(n) for n, c in wanted_prices.items()))
    return priced.withColumns({"forward_return": F.try_divide("exit_price", "entry_price") - 1, "label_timing": F.lit(timing)})


def winsorize_by_date(data: DataFrame, columns: Sequence[str], quantile: float = 0.01, wide: bool = False) -> DataFrame:
    """Each column clipped to the date's [q, 1 - q] quantiles, linearly interpolated; q <= 0 does
    nothing. The quantiles come from a window by date, like the counts and moments beside it, so the
    rows are made and sorted once.

    ``percentile`` holds all distinct values of a date, one date at a time, in one task.  ``wide`` is for dates beyond
    that: the same quantiles from narrowed histograms, and no task has a whole date.
    """
    if quantile <= 0:
        return data
    if wide:
        joined = meet(data, stored(quantiles_by_date(data, columns, (quantile, 1 - quantile)), "limits"), ("date",))
    else:
        w = Window.partitionBy("date")
        joined = data.filter("date is not null").withColumns({f"_q_{c}": F.percentile(c, F.array(F.lit(quantile), F.lit(1 - quantile))).over(w) for c in columns})
    clip = lambda c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"_q_{c}")[0]), F.col(f"_q_{c}")[1]))
    return joined.withColumns({c: clip(c) for c in columns}).select(*data.columns)


def zscore_by_date(data: DataFrame, columns: Sequence[str], wide: bool = False) -> DataFrame:
    """(x - mean) / deviation within the date; null where the deviation is 0 or unknown.  ``wide``
    adds the moments up by task first, for dates that no task should hold."""
    if wide:
        moments = data.groupBy("date").agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_samp))))
        joined = meet(data, stored(moments, "moments"), ("date",))
        return joined.withColumns({c: F.try_divide(F.col(c) - F.col(f"_mean_{c}"), F.col(f"_sd_{c}")) for c in columns}).select(*data.columns)
    w = Window.partitionBy("date")
    return data.withColumns({c: F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w)) for c in columns})


def prepare_factor_dataset(
    factors: DataFrame, labels: DataFrame, factor_columns: Sequence[str], winsorize_quantile: float = 0.01, zscore: bool = True, min_symbols_per_date: int = 3, digits: int | None = None
) -> DataFrame:
    """Complete rows of factors and forward returns, winsorized and standardised by date.

    Dates with fewer than ``min_symbols_per_date`` complete symbols go.  A date on which one
    factor is constant has no z-scores of it and loses all its rows.  ``digits`` rounds the factors,
    so that values which differ by the order of their sums alone are ties.
    """
    joined = factors.join(labels.select("date", "symbol", "forward_return"), ["date", "symbol"])
    return finish_dataset(joined, factor_columns, winsorize_quantile, zscore, min_symbols_per_date, digits)


def finish_dataset(
    joined: DataFrame, factor_columns: Sequence[str], winsorize_quantile: float = 0.01, zscore: bool = True, min_symbols_per_date: int = 3, digits: int | None = None, wide: bool = False
) -> DataFrame:
    """``prepare_factor_dataset`` for rows that already have their forward returns.  ``wide`` is for
    dates that no task should hold; the rows are then stored between the steps."""
    complete = joined.dropna(subset=[*factor_columns, "forward_return"])
    if wide:
        complete = stored(complete, "complete")
        sizes = stored(complete.groupBy("date").agg(F.count("symbol").alias("_n")).filter(F.col("_n") >= min_symbols_per_date), "sizes")
        broad = stored(meet(complete, sizes, ("date",)).drop("_n"), "broad")
    else:
        broad = complete.withColumn("_n", F.count("symbol").over(Window.partitionBy("date"))).filter(F.col("_n") >= min_symbols_per_date).drop("_n")
    out = winsorize_by_date(broad, factor_columns, winsorize_quantile, wide)
    if zscore:
        out = zscore_by_date(stored(out, "winsorized") if wide else out, factor_columns, wide)
    if digits is not None:
        out = out.withColumns({c: F.round(c, digits) for c in factor_columns})
    return out.dropna(subset=list(factor_columns))

