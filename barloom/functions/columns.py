"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

TRADING_DAYS = 252

#: Index codes beginning with 0 or 3 that belong to the Shanghai market.
SHANGHAI_INDICES = ("000300", "000905", "000016")


def require(df: DataFrame, *names: str) -> None:
    """Raise if a required column is missing; checked when the plan is made."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def last_row(df: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """The last row of each key by ``order_col``, a null order being the first; of equal orders any."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(order_col)).alias("_row")
    return df.groupBy(*keys).agg(last).select(*keys, "_row.*").select(*df.columns)


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def as_double(name: str) -> Column:
    """The column as a double; null where it is no number, or NaN."""
    number = F.col(name).try_cast("double")
    return F.when(~F.isnan(number), number)


def as_date(name: str) -> Column:
    return F.col(name).try_cast("date")


def pad_symbol(symbol: Column) -> Column:
    """Zeros in front up to six characters; longer codes stay whole."""
    text = symbol.cast("string")
    return F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)


def to_market_symbol(symbol: Column) -> Column:
    """The padded code with its market in front: sh for codes that begin with 5, 6 or 9, else sz."""
    code = pad_symbol(symbol)
    return F.concat(F.when(F.substring(code, 1, 1).isin("5", "6", "9"), "sh").otherwise("sz"), code)


def index_market_symbol(code: Column) -> Column:
    """Like ``to_market_symbol``, but three index codes that begin with 0 belong to sh."""
    padded = pad_symbol(code)
    return F.when(padded.isin(*SHANGHAI_INDICES), F.concat(F.lit("sh"), padded)).otherwise(to_market_symbol(padded))


def filled_close(w: WindowSpec, name: str = "close") -> Column:
    """The last value that isn't null."""
    return F.last(name, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation of the rows that have both; null for a constant side.

    The built-in ``corr`` raises on constants in ANSI mode.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    sd = lambda c: F.stddev_samp(F.when(both, F.col(c)))
    return F.try_divide(F.covar_samp(x, y), sd(x) * sd(y))
