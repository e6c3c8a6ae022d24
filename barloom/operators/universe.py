"""The tradable universe: row filters and an audit of what each removes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import as_date, as_double, by_symbol, filled_close, last_row, pad_symbol, require
from barloom.sources.tables import stored

LIMIT_PERCENT = 9.8

#: Messages of the audit.
INFERRED_SUSPENSION = "trade_status missing; inferred suspended rows from zero volume/amount when available"
INFERRED_LIMIT = "trade_status missing; inferred limit rows from pct_change or close returns"
NO_MASTER = "security_master missing; permissive mode kept rows"
MASTER_FILTERS = ("exclude_st", "exclude_new_stock_days", "industry_include", "industry_exclude", "min_float_market_cap", "max_float_market_cap")

#: The numeric columns of a price frame.
_PRICE_NUMBERS = ("open", "high", "low", "close", "volume", "amount", "turnover", "pct_change")


def normalize_price_frame(bars: DataFrame) -> DataFrame:
    require(bars, "date", "symbol")
    numbers = {c: as_double(c) for c in _PRICE_NUMBERS if c in bars.columns}
    return bars.withColumns({"date": as_date("date"), "symbol": pad_symbol(F.col("symbol")), **numbers}).filter("symbol is not null and date is not null")


def _last_per(df: DataFrame, keys: Sequence[str], order_col: str | None) -> DataFrame:
    if order_col is None:
        return df.dropDuplicates(list(keys))
    return last_row(df, keys, order_col).drop(order_col)


def normalize_security_master(master: DataFrame, order_col: str | None = None) -> DataFrame:
    """One row a symbol, the last by ``order_col``; a null is_st is false."""
    known = {"list_date": as_date, "float_market_cap": as_double, "is_st": lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))}
    typed = master.withColumns({"symbol": pad_symbol(F.col("symbol")), **{c: f(c) for c, f in known.items() if c in master.columns}})
    return _last_per(typed, ["symbol"], order_col)


def normalize_trade_status(status: DataFrame, order_col: str | None = None) -> DataFrame:
    """One row a date and symbol, the last by ``order_col``; null flags are false."""
    flags = {c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in ("is_suspended", "is_limit_up", "is_limit_down") if c in status.columns}
    return _last_per(status.withColumns({"date": as_date("date"), "symbol": pad_symbol(F.col("symbol")), **flags}), ["date", "symbol"], order_col)


def filter_whitelist(bars: DataFrame, symbols: Sequence[str] | None) -> DataFrame:
    """Bars of the listed symbols; an empty list keeps all."""
    return bars.filter(F.col("symbol").isin(*_padded(symbols))) if symbols else bars


def _padded(symbols: Sequence[str]) -> list[str]:
    return [str(s).zfill(6) for s in symbols]


def filter_min_history(bars: DataFrame, min_history_days: int = 80) -> DataFrame:
    """Bars of symbols with that many dates in the whole sample."""
    counted = bars.withColumn("_days", F.count("date").over(Window.partitionBy("symbol")))
    return counted.filter(F.col("_days") >= min_history_days).drop("_days")


def _flagged(bars: DataFrame, status: DataFrame, *flags: str) -> DataFrame:
    """Bars that have none of the flags; those without a status row stay."""
    marked = bars.join(status.select("date", "symbol", *(F.col(f).alias(f"_{f}") for f in flags)), ["date", "symbol"], "left")
    for f in flags:
        marked = marked.filter(~F.coalesce(f"_{f}", F.lit(False)))
    return marked.select(*bars.columns)


def filter_suspended(bars: DataFrame, status: DataFrame) -> DataFrame:
    return _flagged(bars, status, "is_suspended")


def _no_trade(columns: Sequence[str]) -> Column:
    for c in ("volume", "amount"):
        if c in columns:
            return F.coalesce(c, F.lit(0.0)) <= 0
    return F.lit(False)


def filter_suspended_inferred(bars: DataFrame) -> DataFrame:
    """Without a status table: no volume (or, without such a column, no amount) is a suspension."""
    return bars.filter(~_no_trade(bars.columns))


def filter_limit(bars: DataFrame, status: DataFrame) -> DataFrame:
    return _flagged(bars, status, "is_limit_up", "is_limit_down")


def filter_limit_inferred(bars: DataFrame) -> DataFrame:
    """Without a status table: bars that moved by the limit or more, by pct_change where there is
    such a column, else by the return on the previous bar. An unknown move is kept."""
    if "pct_change" in bars.columns:
        return bars.filter(F.coalesce(F.abs("pct_change") < LIMIT_PERCENT, F.lit(True)))
    w = by_symbol()
    moved = bars.withColumn("_p", filled_close(w)).withColumn("_r", F.try_divide("_p", F.lag("_p").over(w)) - 1)
    return moved.filter(F.coalesce(F.abs("_r") < LIMIT_PERCENT / 100, F.lit(True))).drop("_p", "_r")


def _with_master(bars: DataFrame, master: DataFrame, column: str) -> DataFrame:
    return bars.join(master.select("symbol", F.col(column).alias("_m")), "symbol", "left")


def filter_st(bars: DataFrame, master: DataFrame) -> DataFrame:
    return _with_master(bars, master, "is_st").filter(~F.coalesce("_m", F.lit(False))).select(*bars.columns)


def filter_new_stock(bars: DataFrame, master: DataFrame, days: int | None) -> DataFrame:
    """Bars at least ``days`` calendar days after the listing; without a list date none."""
    return _with_master(bars, master, "list_date").filter(F.datediff("date", "_m") >= days).select(*bars.columns) if days else bars


def filter_industry_include(bars: DataFrame, master: DataFrame, industries: Sequence[str]) -> DataFrame:
    return _with_master(bars, master, "industry").filter(F.col("_m").isin(*industries)).select(*bars.columns) if industries else bars


def filter_industry_exclude(bars: DataFrame, master: DataFrame, industries: Sequence[str]) -> DataFrame:
    """Bars of other industries; an unknown industry is kept."""
    return _with_master(bars, master, "industry").filter(F.coalesce(~F.col("_m").isin(*industries), F.lit(True))).select(*bars.columns) if industries else bars


def filter_float_cap(bars: DataFrame, master: DataFrame, least: float | None = None, most: float | None = None) -> DataFrame:
    """Bars of symbols within both bounds, where given; an unknown size is out."""
    out = bars
    if least is not None:
        out = _with_master(out, master, "float_market_cap").filter(F.col("_m") >= least).select(*bars.columns)
    if most is not None:
        out = _with_master(out, master, "float_market_cap").filter(F.col("_m") <= most).select(*bars.columns)
    return out


def filter_min_symbols_per_date(bars: DataFrame, least: int = 3) -> DataFrame:
    enough = bars.groupBy("date").agg(F.count_distinct("symbol").alias("_n")).filter(F.col("_n") >= least)
    return bars.join(enough.select("date"), "date", "left_semi")


def filter_universe(bars: DataFrame, symbols: Sequence[str] | None = None, min_history_days: int = 80) -> DataFrame:
    """Whitelist and minimum history alone."""
    return filter_min_history(filter_whitelist(normalize_price_frame(bars), symbols), min_history_days)


def _plan(columns: Sequence[str], master: DataFrame | None, status: DataFrame | None, symbols, min_history_days: int, min_symbols: int, filters: Mapping) -> list[tuple[str, Column | str | None, str]]:
    """The filters in order: name, condition that keeps a row (None: skipped), message.

    The two conditions that depend on the rows left by earlier filters are only named here.
    """
    steps: list[tuple[str, Column | str | None, str]] = []
    if symbols:
        steps.append(("symbol_whitelist", F.col("symbol").isin(*_padded(symbols)), ""))
    steps.append(("min_history_days", "history", f"min_history_days={min_history_days}"))
    flag = lambda c: ~F.coalesce(f"_s_{c}", F.lit(False))
    if filters.get("exclude_suspended", True):
        if status is not None and "is_suspended" in status.columns:
            steps.append(("exclude_suspended", flag("is_suspended"), ""))
        else:
            steps.append(("exclude_suspended", ~_no_trade(columns), INFERRED_SUSPENSION))
    if filters.get("exclude_limit_up_down", True):
        if status is not None and {"is_limit_up", "is_limit_down"} <= set(status.columns):
            steps.append(("exclude_limit_up_down", flag("is_limit_up") & flag("is_limit_down"), ""))
        elif "pct_change" in columns:
            steps.append(("exclude_limit_up_down", F.coalesce(F.abs("pct_change") < LIMIT_PERCENT, F.lit(True)), INFERRED_LIMIT))
        else:
            steps.append(("exclude_limit_up_down", "limit", INFERRED_LIMIT))
    if master is None:
        steps.extend((name, None, NO_MASTER) for name in MASTER_FILTERS)
    else:
        days, include, exclude = filters.get("exclude_new_stock_days"), filters.get("industry_include") or [], filters.get("industry_exclude") or []
        least, most = filters.get("min_float_market_cap"), filters.get("max_float_market_cap")
        m = lambda c: F.col(f"_m_{c}")
        for name, wanted, column, keep in (
            ("exclude_st", filters.get("exclude_st", True), "is_st", lambda: ~F.coalesce(m("is_st"), F.lit(False))),
            ("exclude_new_stock_days", bool(days), "list_date", lambda: F.datediff("date", m("list_date")) >= int(days)),
            ("industry_include", bool(include), "industry", lambda: m("industry").isin(*include)),
            ("industry_exclude", bool(exclude), "industry", lambda: F.coalesce(~m("industry").isin(*exclude), F.lit(True))),
            ("min_float_market_cap", least is not None, "float_market_cap", lambda: m("float_market_cap") >= float(least)),
            ("max_float_market_cap", most is not None, "float_market_cap", lambda: m("float_market_cap") <= float(most)),
        ):
            if wanted:
                there = column in master.columns
                steps.append((name, keep() if there else None, "" if there else f"{column} column missing; permissive mode kept rows"))
    steps.append(("min_symbols_per_date", "breadth", f"min_symbols_per_date={min_symbols}"))
    return steps


def _unless_empty(table: DataFrame | None) -> DataFrame | None:
    return None if table is None or table.isEmpty() else table


def apply_universe_filters(
    prices: DataFrame,
    symbols: Sequence[str] | None = None,
    min_history_days: int = 80,
    min_symbols_per_date: int = 3,
    filters: Mapping | None = None,
    security_master: DataFrame | None = None,
    trade_status: DataFrame | None = None,
    master_order: str | None = None,
    status_order: str | None = None,
    store: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """All filters in order; the rows that pass, and the audit with one row a filter.

    Every row gets one flag for each filter, whether it passed that and all before, so rows and
    audit come from the same pass; the audit first adds up each symbol's flags and then one row a
    symbol.  Bars are unique by symbol and date.  An empty metadata table counts as a missing one.
    Of several metadata rows with one key the last by ``master_order`` or ``status_order`` counts;
    without an order any of them may.  ``store`` writes the flagged rows to the shared folder, so
    that the filters run once for rows and audit.
    """
    filters = filters or {}
    if filters.get("missing_metadata_policy", "permissive") != "permissive":
        raise ValueError("only the permissive policy for missing metadata is supported")
    security_master, trade_status = _unless_empty(security_master), _unless_empty(trade_status)
    bars = normalize_price_frame(prices)
    columns = bars.columns
    marked = bars
    if trade_status is not None:
        known = [c for c in ("is_suspended", "is_limit_up", "is_limit_down") if c in trade_status.columns]
        marked = marked.join(normalize_trade_status(trade_status, status_order).select("date", "symbol", *(F.col(c).alias(f"_s_{c}") for c in known)), ["date", "symbol"], "left")
    if security_master is not None:
        known = [c for c in ("list_date", "is_st", "industry", "float_market_cap") if c in security_master.columns]
        marked = marked.join(normalize_security_master(security_master, master_order).select("symbol", *(F.col(c).alias(f"_m_{c}") for c in known)), "symbol", "left")
    steps = _plan(columns, security_master, trade_status, symbols, min_history_days, min_symbols_per_date, filters)

    passed = F.lit(True)
    for i, (_, keep, _) in enumerate(steps):
        so_far = F.col(f"_f{i - 1}") if i else F.lit(True)
        if keep is None:
            passed = so_far
        elif not isinstance(keep, str):
            passed = so_far & F.coalesce(keep, F.lit(False))
        elif keep == "history":
            passed = so_far & (F.count(F.when(so_far, F.col("date"))).over(Window.partitionBy("symbol")) >= min_history_days)
        elif keep == "limit":  # returns between the rows that are left so far
            left = F.when(so_far, F.col("close"))
            earlier = by_symbol().rowsBetween(Window.unboundedPreceding, -1)
            now = F.coalesce(left, F.last(left, ignorenulls=True).over(earlier))
            moved = F.abs(F.try_divide(now, F.last(left, ignorenulls=True).over(earlier)) - 1)
            passed = so_far & F.coalesce(moved < LIMIT_PERCENT / 100, F.lit(True))
        else:
            passed = so_far & (F.count(F.when(so_far, F.col("symbol"))).over(Window.partitionBy("date")) >= min_symbols_per_date)
        marked = marked.withColumn(f"_f{i}", passed)

    if store:
        marked = stored(marked.select(*columns, *(f"_f{i}" for i in range(len(steps)))), "universe")
    rows = marked.filter(F.col(f"_f{len(steps) - 1}")).select(*columns)
    flags = range(len(steps))
    by_name = marked.groupBy("symbol").agg(F.count("*").alias("n"), *(F.count_if(f"_f{i}").alias(f"n{i}") for i in flags))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    totals = by_name.agg(total("n"), F.count("*").alias("s"), *(total(f"n{i}") for i in flags), *(F.count_if(F.col(f"n{i}") > 0).alias(f"s{i}") for i in flags))
    entries = []
    for i, (name, keep, message) in enumerate(steps):
        n, s = (F.col(f"n{i - 1}"), F.col(f"s{i - 1}")) if i else (F.col("n"), F.col("s"))
        entries.append(F.struct(
            F.lit(i + 1).alias("step"), F.lit(name).alias("filter_name"), n.alias("input_rows"), F.col(f"n{i}").alias("output_rows"), (n - F.col(f"n{i}")).alias("removed_rows"),
            s.alias("input_symbols"), F.col(f"s{i}").alias("output_symbols"), (s - F.col(f"s{i}")).alias("removed_symbols"),
            F.lit("skipped" if keep is None else "applied").alias("status"), F.lit(message).alias("message"),
        ))
    audit = totals.select(F.inline(F.array(*entries)))
    return rows, audit
