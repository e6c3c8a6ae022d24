"""Cross-sectional factors from prices, and valuation joined as of each date."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.columns import as_date, as_double, by_symbol, filled_close, pad_symbol, require
from barloom.operators.chunks import Chunks, by_block, last_before, windowed

#: Valuation columns in the order in which they are chosen, and the source they are called.
VALUE_SOURCES = (("pb", "book_to_price"), ("pe", "earnings_yield"), ("ps", "sales_yield"), ("dividend_yield", "dividend_yield"))


def _rolling(w, n: int) -> object:
    return w.rowsBetween(1 - n, 0)


def _gated(value: Column, seen: str, w, least: int) -> Column:
    """The window's value, if it has enough observations."""
    return F.when(F.count(seen).over(w) >= least, value)


def price_factor_columns(momentum_window: int, volatility_window: int, turnover_window: int, value_window: int, has_turnover: bool, w: WindowSpec | None = None) -> dict[str, Column]:
    """The factors over ``_p`` (filled close), ``_r`` (return) and ``turnover``, by one window."""
    if min(volatility_window, turnover_window) < 5 or value_window < 20:
        raise ValueError("volatility and turnover windows need 5 rows, the value window 20")
    w = by_symbol() if w is None else w
    vol, turn, value = (_rolling(w, n) for n in (volatility_window, turnover_window, value_window))
    turnover = _gated(F.avg("turnover").over(turn), "turnover", turn, max(5, turnover_window // 2)) if has_turnover else F.lit(None).cast("double")
    return {
        f"momentum_{momentum_window}d": F.try_divide("_p", F.lag("_p", momentum_window).over(w)) - 1,
        f"low_volatility_{volatility_window}d": -_gated(F.stddev_samp("_r").over(vol), "_r", vol, max(5, volatility_window // 2)),
        f"turnover_{turnover_window}d": turnover,
        f"value_proxy_{value_window}d": F.try_divide(_gated(F.avg("close").over(value), "close", value, max(20, value_window // 3)), F.col("close")) - 1,
        "daily_return": F.col("_r"),
    }


def with_returns(bars: DataFrame) -> DataFrame:
    """Adds ``_p`` (last known close) and ``_r`` (its return)."""
    w = by_symbol()
    return bars.withColumn("_p", filled_close(w)).withColumn("_r", F.try_divide("_p", F.lag("_p").over(w)) - 1)


def build_price_factors(prices: DataFrame, momentum_window: int = 20, volatility_window: int = 20, turnover_window: int = 20, value_window: int = 120, chunks: Chunks | None = None) -> DataFrame:
    """date, symbol, the four factors and daily_return; all windows share one shuffle and sort.

    Windows count a symbol's rows.  Without a turnover column its factor is null.  With ``chunks`` a
    history is cut, and no task holds a symbol's bars whole; bars then need a symbol and a date.
    """
    require(prices, "date", "symbol", "close")
    numbers = [c for c in ("close", "turnover") if c in prices.columns]
    bars = prices.select(as_date("date").alias("date"), pad_symbol(F.col("symbol")).alias("symbol"), *(as_double(c).alias(c) for c in numbers))
    windows = (momentum_window, volatility_window, turnover_window, value_window)
    if chunks:
        return windowed(bars, chunks, max(windows), 0, price_factor_columns(*windows, "turnover" in numbers, by_block()))
    factors = price_factor_columns(*windows, "turnover" in numbers)
    return with_returns(bars).select("date", "symbol", *(c.alias(n) for n, c in factors.items()))


def value_factor(valuation: DataFrame) -> tuple[Column, str]:
    """The value factor and its source, by the columns there are: the inverse of a positive
    multiple, or the dividend yield as it is."""
    for column, source in VALUE_SOURCES:
        if column in valuation.columns:
            x = as_double(column)
            return (x if column == "dividend_yield" else F.when(x > 0, F.try_divide(F.lit(1.0), x))), source
    return F.lit(None).cast("double"), "unavailable"


def merge_valuation_factor(factors: DataFrame, valuation: DataFrame | None, order_col: str | None = None, chunk_days: int | None = None) -> DataFrame:
    """Adds value_factor and value_factor_source: each symbol's latest valuation up to the date.

    The latest row counts even if its value is null; of equal dates the last by ``order_col``, of any
    type that has an order.  A table without rows counts as none.  Both sides go through one window
    by symbol, so the join is linear and makes no pairs.  ``chunk_days`` cuts the histories: the
    window goes by (symbol, chunk), and the last valuation of all chunks before comes from one row
    a chunk; factors then need a symbol and a date.
    """
    missing = {"value_factor": F.lit(None).cast("double"), "value_factor_source": F.lit("unavailable")}
    if valuation is None or valuation.isEmpty():
        return factors.withColumns(missing)
    require(valuation, "symbol", "date")
    value, source = value_factor(valuation)
    if source == "unavailable":
        return factors.withColumns(missing)
    order = F.col(order_col) if order_col else F.lit(0)
    rows = valuation.select(
        pad_symbol(F.col("symbol")).alias("symbol"), as_date("date").alias("date"), F.struct(value.alias("v")).alias("_value"), F.lit(0).alias("_side"), order.alias("_order")
    ).filter("symbol is not null and date is not null")
    both = factors.withColumns({"_side": F.lit(1), "_order": F.lit(None).cast(rows.schema["_order"].dataType)}).unionByName(rows, allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("date", "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last("_value", ignorenulls=True)
    if chunk_days:
        both = last_before(both, chunk_days, "_value", F.struct("date", "_order"))
        w = Window.partitionBy("symbol", "_chunk").orderBy("date", "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
        joined = both.withColumn("_latest", F.coalesce(latest.over(w), F.col("_carry"))).filter("_side = 1")
    else:
        joined = both.withColumn("_latest", latest.over(w)).filter("_side = 1")
    return joined.select(*factors.columns, F.col("_latest.v").alias("value_factor"), F.lit(source).alias("value_factor_source"))


def factor_columns_from_config(windows: Mapping[str, int], value: bool = True) -> list[str]:
    """Names of the configured factors; a window that isn't given is 20 rows."""
    window = lambda name: windows.get(f"{name}_window", 20)
    names = [f"momentum_{window('momentum')}d", f"low_volatility_{window('volatility')}d", f"turnover_{window('turnover')}d"]
    return [*names, "value_factor"] if value else names


def available_factor_columns(factors: DataFrame, configured: Sequence[str]) -> list[str]:
    """The configured factors that are there and not entirely null, by one aggregate."""
    there = [c for c in configured if c in factors.columns]
    if not there:
        return []
    found = factors.agg(*(F.count(c).alias(c) for c in there)).first()
    return [c for c in there if found[c]]


def unpivot_factors(data: DataFrame, factor_columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """date, symbol, the kept columns, factor, value.  Rows stay in their tasks: if they are dealt by
    date, what follows by factor and date needs no shuffle (after ``unpivot`` it would)."""
    pairs = F.array(*(F.struct(F.lit(c).alias("factor"), F.col(c).alias("value")) for c in factor_columns))
    return data.select("date", "symbol", *keep, F.inline(pairs))
