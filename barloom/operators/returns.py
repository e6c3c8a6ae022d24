"""Returns and risk metrics of each symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import TRADING_DAYS, by_symbol, filled_close
from barloom.operators.chunks import before_chunk, by_chunk, numbered


def simple_return(bars: DataFrame, name: str = "return") -> DataFrame:
    """Adds ``p / previous p - 1``, where a null price counts as the last known one."""
    filled = bars.withColumn("_p", filled_close(by_symbol()))
    return filled.withColumn(name, F.try_divide("_p", F.lag("_p").over(by_symbol())) - 1).drop("_p")


def log_return(bars: DataFrame, name: str = "log_return") -> DataFrame:
    """Adds ``ln(p / previous p)``; null next to a null price."""
    return bars.withColumn(name, F.ln(F.try_divide("close", F.lag("close").over(by_symbol()))))


def _annual_return(r: str) -> Column:
    n = F.count(r)
    return F.when(n > 0, F.pow(F.product(1 + F.col(r)), F.try_divide(F.lit(float(TRADING_DAYS)), n)) - 1)


def _annual_volatility(r: str) -> Column:
    return F.stddev_samp(r) * F.sqrt(F.lit(float(TRADING_DAYS)))


def _sharpe(r: str, risk_free: float) -> Column:
    return F.try_divide(F.avg(r) - risk_free / TRADING_DAYS, F.stddev_samp(r)) * F.sqrt(F.lit(float(TRADING_DAYS)))


def annual_return(returns: DataFrame, r: str = "return") -> DataFrame:
    return returns.groupBy("symbol").agg(_annual_return(r).alias("annual_return"))


def annual_volatility(returns: DataFrame, r: str = "return") -> DataFrame:
    return returns.groupBy("symbol").agg(_annual_volatility(r).alias("annual_volatility"))


def sharpe(returns: DataFrame, r: str = "return", risk_free: float = 0.0) -> DataFrame:
    return returns.groupBy("symbol").agg(_sharpe(r, risk_free).alias("sharpe"))


def _with_drawdown(bars: DataFrame) -> DataFrame:
    peak = F.max("close").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumn("_drawdown", F.try_divide("close", peak) - 1)


def chunk_states(bars: DataFrame, chunk_days: int) -> DataFrame:
    """One row for each symbol and chunk of time, from which all risk metrics can be added up.

    ``_top`` and ``_low`` are the highest and lowest price, ``_worst`` the worst fall within the
    chunk; ``_k``, ``_growth``, ``_mean`` and ``_spread`` are count, product of 1 + r, mean and sum
    of squares about the mean of the returns.  A chunk's first return is on the price before it.
    """
    rows = numbered(bars, chunk_days)
    peak = F.max("close").over(by_chunk().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_fall", F.try_divide("close", peak) - 1).groupBy("symbol", "_chunk").agg(
        F.min("date").alias("_from"), F.max("date").alias("_to"), F.count("*").alias("_rows"),
        F.max("close").alias("_top"), F.min("close").alias("_low"), F.min("_fall").alias("_worst"),
        F.count("_r").alias("_k"), F.product(1 + F.col("_r")).alias("_growth"), F.avg("_r").alias("_mean"), (F.var_pop("_r") * F.count("_r")).alias("_spread"),
    )


def merged_drawdown(states: DataFrame) -> DataFrame:
    """``chunk_states`` with ``_drawdown``, the worst fall that ends in the chunk: its own worst, or
    from the highest price of all chunks before to its lowest.  Prices are positive."""
    peak = F.max("_top").over(before_chunk())
    return states.withColumn("_drawdown", F.least("_worst", F.try_divide("_low", peak) - 1))


def max_drawdown(bars: DataFrame, chunk_days: int | None = None) -> DataFrame:
    """Lowest ``p / highest p so far - 1``; null prices don't count.

    With ``chunk_days`` a history is cut into chunks of time, whose states are merged in order: no
    task sorts a symbol's whole history.  Prices are then positive, and bars have a symbol and a date.
    """
    if chunk_days:
        return merged_drawdown(chunk_states(bars, chunk_days)).groupBy("symbol").agg(F.min("_drawdown").alias("max_drawdown"))
    return _with_drawdown(bars).groupBy("symbol").agg(F.min("_drawdown").alias("max_drawdown"))


def risk_summary(bars: DataFrame, risk_free: float = 0.0, chunk_days: int | None = None) -> DataFrame:
    """symbol, start_date, end_date, n_days and the four metrics, from one shuffle by symbol; with
    ``chunk_days`` from the merged states of chunks, as in ``max_drawdown``."""
    if chunk_days:
        return _merged_summary(chunk_states(bars, chunk_days), risk_free)
    both = _with_drawdown(simple_return(bars, "_r"))
    return both.groupBy("symbol").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("n_days"),
        _annual_return("_r").alias("annual_return"), _annual_volatility("_r").alias("annual_volatility"),
        _sharpe("_r", risk_free).alias("sharpe"), F.min("_drawdown").alias("max_drawdown"),
    )


def _merged_summary(states: DataFrame, risk_free: float) -> DataFrame:
    squares = F.sum("_spread") + F.sum(F.col("_k") * F.col("_mean") * F.col("_mean"))
    merged = merged_drawdown(states).groupBy("symbol").agg(
        F.min("_from").alias("start_date"), F.max("_to").alias("end_date"), F.sum("_rows").alias("n_days"),
        F.sum("_k").alias("_n"), F.product("_growth").alias("_total"), F.sum(F.col("_k") * F.col("_mean")).alias("_sum"), squares.alias("_squares"), F.min("_drawdown").alias("max_drawdown"),
    )
    mean = F.try_divide("_sum", "_n")
    sd = F.when(F.col("_n") > 1, F.sqrt(F.greatest(F.col("_squares") - F.col("_sum") * mean, F.lit(0.0)) / (F.col("_n") - 1)))
    year = F.lit(float(TRADING_DAYS))
    return merged.select(
        "symbol", "start_date", "end_date", "n_days", F.when(F.col("_n") > 0, F.pow("_total", F.try_divide(year, F.col("_n"))) - 1).alias("annual_return"),
        (sd * F.sqrt(year)).alias("annual_volatility"), (F.try_divide(mean - risk_free / TRADING_DAYS, sd) * F.sqrt(year)).alias("sharpe"), "max_drawdown",
    )
