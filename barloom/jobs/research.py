"""The three workflows, end to end."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import backtest, evaluation, factors, ingest, labels, returns, stats, universe
from barloom.operators.chunks import Chunks, by_block, windowed
from barloom.sources.tables import stored, write_csv, write_parquet


@dataclass(frozen=True)
class ResearchConfig:
    """Parameters of the factor workflow with their defaults."""

    symbols: Sequence[str] = ()
    min_history_days: int = 80
    min_symbols_per_date: int = 3
    filters: Mapping | None = None
    horizon: int = 5
    timing: str = labels.TIMINGS[0]
    non_overlapping_ic: bool = True
    momentum_window: int = 20
    volatility_window: int = 20
    turnover_window: int = 20
    value_window: int = 120
    winsorize_quantile: float = 0.01
    zscore: bool = True
    digits: int | None = None
    quantiles: int = 5
    transaction_cost_bps: Sequence[int] = (0, 5, 10, 20)
    #: For long histories: cut them, so that no task holds a symbol's bars whole.
    chunks: Chunks | None = None
    #: For wide dates: no task holds a date's rows whole.
    wide: bool = False

    @property
    def windows(self) -> dict[str, int]:
        return {n: getattr(self, n) for n in ("momentum_window", "volatility_window", "turnover_window", "value_window")}


DEFAULT_FILTERS = {"exclude_st": True, "exclude_suspended": True, "exclude_new_stock_days": 60, "exclude_limit_up_down": True}


def risk_profile(quotes: DataFrame, order_col: str) -> DataFrame:
    """Raw quotes -> standard columns -> one source a symbol -> clean bars -> risk metrics."""
    standard = ingest.normalize_columns(quotes, keep=("source", order_col))
    return returns.risk_summary(ingest.clean_ohlcv(ingest.select_source_by_priority(standard), order_col))


def distribution_tests(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Test summary of each symbol, and the one-row conclusion."""
    summary = stats.distribution_test_summary(returns.simple_return(bars))
    return summary, stats.distribution_conclusion(summary)


#: Names of the result tables.
RESULT_TABLES = (
    "universe_filter_audit", "factor_dataset", "factor_ic_timeseries", "factor_ic_summary", "factor_layer_returns",
    "factor_long_short_returns", "factor_long_only_returns", "factor_turnover", "factor_cost_sensitivity",
)


@dataclass(frozen=True)
class FactorResearch:
    audit: DataFrame
    dataset: DataFrame
    factor_columns: list[str]
    ic: DataFrame
    ic_summary: DataFrame
    layers: DataFrame
    long_short: DataFrame
    long_only: DataFrame
    turnover: DataFrame
    costs: DataFrame
    value_source: str

    def tables(self) -> dict[str, DataFrame]:
        """The result tables by the names under which ``save`` writes them."""
        return dict(zip(RESULT_TABLES, (self.audit, self.dataset, self.ic, self.ic_summary, self.layers, self.long_short, self.long_only, self.turnover, self.costs)))

    def save(self, folder: str) -> None:
        """Write all tables: the dataset as Parquet, the others, which are small, as CSV."""
        for name, table in self.tables().items():
            (write_parquet if name == "factor_dataset" else write_csv)(table, f"{folder}/{name}")


def price_features(bars: DataFrame, config: ResearchConfig) -> DataFrame:
    """Factors and forward returns in one pass over each symbol's bars: one shuffle, one sort, and
    no join of factors with labels."""
    w = by_block() if config.chunks else None
    entry, exit_ = labels.label_prices(config.horizon, config.timing, w)
    columns = factors.price_factor_columns(**config.windows, has_turnover="turnover" in bars.columns, w=w) | {"_in": entry, "_out": exit_}
    if config.chunks:
        priced = windowed(bars, config.chunks, max(config.windows.values()), config.horizon + 1, columns)
    else:
        priced = factors.with_returns(bars).select("date", "symbol", *(c.alias(n) for n, c in columns.items()))
    return priced.withColumn("forward_return", F.try_divide("_out", "_in") - 1).drop("_in", "_out")


def factor_research(
    bars: DataFrame, security_master: DataFrame | None = None, trade_status: DataFrame | None = None, valuation: DataFrame | None = None, config: ResearchConfig = ResearchConfig(),
    master_order: str | None = None, status_order: str | None = None, valuation_order: str | None = None,
) -> FactorResearch:
    """Universe -> factors and labels -> dataset -> coefficients, layers, turnover and costs.

    Of rows of metadata or valuation with one key the last by their order column counts; without
    one any may.  A universe of fewer symbols than a date needs is an error, and so is a dataset
    without rows.  The flagged bars, the frame, the dataset and its buckets are written to the shared
    folder once each, as several results start from them.
    """
    rows, audit = universe.apply_universe_filters(
        bars, config.symbols, config.min_history_days, config.min_symbols_per_date, DEFAULT_FILTERS if config.filters is None else config.filters, security_master, trade_status,
        master_order, status_order, store=True,
    )
    if rows.select("symbol").distinct().limit(config.min_symbols_per_date).count() < config.min_symbols_per_date:
        raise ValueError(f"a cross-section needs {config.min_symbols_per_date} symbols")
    frame = stored(factors.merge_valuation_factor(price_features(rows, config), valuation, valuation_order, config.chunks and config.chunks.days), "frame")
    chosen = factors.available_factor_columns(frame, factors.factor_columns_from_config(config.windows))
    if not chosen:
        raise ValueError("no configured factor is available")
    dataset = stored(labels.finish_dataset(frame, chosen, config.winsorize_quantile, config.zscore, config.min_symbols_per_date, config.digits, config.wide), "dataset")
    if dataset.isEmpty():
        raise ValueError("no rows are left after preprocessing")
    dealt = dataset if config.wide else dataset.repartition("date")  # before there is a row for each factor
    long = factors.unpivot_factors(dealt, chosen, ["forward_return"])  # complete in factors and returns
    bucketed = stored(backtest.assign_quantiles(long, config.quantiles, config.wide, ends=True).drop("value"), "buckets")
    ic = evaluation.ic_timeseries(dataset, chosen, config.wide)
    layers = backtest.layer_means(bucketed)
    long_short = backtest.long_short_returns(layers)
    turnover = backtest.leg_turnover(bucketed)
    return FactorResearch(
        audit, dataset, chosen, ic, evaluation.ic_summary(ic, config.horizon, config.non_overlapping_ic), layers, long_short,
        backtest.long_only_returns(long_short), turnover, backtest.cost_sensitivity(long_short, turnover, config.transaction_cost_bps),
        frame.select("value_factor_source").first()[0],
    )
