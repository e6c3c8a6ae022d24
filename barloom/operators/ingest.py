"""Standardising and cleaning vendor quotes, all symbols at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import as_date, as_double, last_row, pad_symbol, require

PRICES = ("open", "high", "low", "close")
#: The standard numeric columns of a bar, in order.
NUMBERS = (*PRICES, "volume", "amount", "turnover", "pct_change", "change", "amplitude", "pre_close")

#: vendors' names of the standard columns, in the order in which they count.
VENDOR_NAMES = {
    "symbol": ("股票代码", "symbol"),
    "date": ("日期", "date"),
    "open": ("开盘", "开盘价", "open"),
    "high": ("最高", "最高价", "high"),
    "low": ("最低", "最低价", "low"),
    "close": ("收盘", "收盘价", "close"),
    "volume": ("成交量", "volume"),
    "amount": ("成交额", "amount"),
    "turnover": ("换手率", "turnover"),
    "pct_change": ("涨跌幅", "pct_change"),
    "change": ("涨跌额", "change"),
    "amplitude": ("振幅", "amplitude"),
    "pre_close": ("前收盘", "pre_close"),
}
#: Sources of stock quotes, the preferred one first.
SOURCES = ("tencent", "sina", "netease_163_unadjusted")


def normalize_columns(raw: DataFrame, symbol: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw quotes with any vendor's column names -> the standard columns that they have.

    Numbers that don't parse become null.  ``symbol`` overrides a symbol column of the quotes;
    without it they must have one.  ``keep`` names further columns to carry.
    """
    quoted = {target: [n for n in names if n in raw.columns] for target, names in VENDOR_NAMES.items()}
    if not quoted["date"]:
        raise ValueError(f"no date column; there are {raw.columns}")
    codes = [F.col(n).cast("string") for n in quoted.pop("symbol")] if symbol is None else [F.lit(symbol)]
    if not codes:
        raise ValueError(f"no symbol column; there are {raw.columns}")
    columns = [F.coalesce(*map(as_date, quoted.pop("date"))).alias("date"), pad_symbol(F.coalesce(*codes)).alias("symbol")]
    columns += [F.coalesce(*map(as_double, names)).alias(target) for target, names in quoted.items() if names]
    return raw.select(*columns, *keep)


def select_source_by_priority(quotes: DataFrame, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """For each symbol all rows of the first source that has any. Other sources never count."""
    rank = reduce(lambda c, s: c.when(F.col("source") == s, sources.index(s)), sources[1:], F.when(F.col("source") == sources[0], 0))
    ranked = quotes.withColumn("_rank", rank).filter("_rank is not null")
    best = ranked.withColumn("_best", F.min("_rank").over(Window.partitionBy("symbol")))
    return best.filter("_rank = _best").drop("_rank", "_best")


def filter_date_range(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows from start to end, both included; the filter reaches the scan."""
    return df.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def last_quotes(df: DataFrame, order_col: str) -> DataFrame:
    """The last row by ``order_col`` of each symbol and date, valid or not; rows without a key are
    dropped, further columns stay.  The last row is an aggregate, so that rows of one key meet in each
    task first; nothing but the last row of a task is shuffled."""
    require(df, "symbol", "date", *PRICES, order_col)
    typed = df.withColumns({"date": as_date("date"), **{c: as_double(c) for c in NUMBERS if c in df.columns}})
    return last_row(typed.filter("symbol is not null and date is not null"), ("symbol", "date"), order_col)


def is_bar() -> Column:
    """Whether a quote is a valid bar: no price is null, 0 or less."""
    return F.coalesce(reduce(lambda a, b: a & b, (F.col(c) > 0 for c in PRICES)), F.lit(False))


def clean_ohlcv(df: DataFrame, order_col: str) -> DataFrame:
    """One valid bar for each symbol and date.

    Of rows with one key the last by ``order_col`` counts, and only then is it checked: with a
    null or non-positive price the key is gone.
    """
    return last_quotes(df, order_col).filter(is_bar())


def union_panels(*panels: DataFrame) -> DataFrame:
    """All rows of all panels; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), panels)


def tag_index_name(bars: DataFrame, names: DataFrame | dict[str, str]) -> DataFrame:
    """Bars of the named index codes with ``index_name``; ``names`` is a table (symbol, index_name)
    or, for a few, a dictionary."""
    if isinstance(names, dict):
        names = bars.sparkSession.createDataFrame(list(names.items()), "symbol string, index_name string")
    return bars.join(names.select("symbol", "index_name"), "symbol")
