"""Information coefficients of factors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import TRADING_DAYS, correlation
from barloom.functions.distributions import t_test
from barloom.operators.factors import unpivot_factors
from barloom.operators.wide import average_ranks


def _average_rank(column: str) -> Column:
    """Rank among the date's complete pairs; equal values share the mean of their ranks.

    One window has both ends of a run of equal values: ``rank`` is its first place, and the rows up to
    the current one with its equals (a window's usual frame) are its last.
    """
    cell = Window.partitionBy("factor", "date", "_pair").orderBy(column)
    return (F.rank().over(cell) + F.count("*").over(cell)) / 2


def _rank_correlation(x: str, y: str) -> Column:
    """Correlation of ranks from their sums, which are exact: without a relation it is 0, not almost 0."""
    n = F.count(x).cast("double")
    both = lambda a, b: n * F.sum(F.col(a) * F.col(b)) - F.sum(a) * F.sum(b)
    return F.try_divide(both(x, y), F.sqrt(both(x, x) * both(y, y)))


def ic_timeseries(data: DataFrame, factor_columns: Sequence[str], wide: bool = False) -> DataFrame:
    """date, factor, ic, rank_ic, n_symbols: Pearson's and Spearman's correlation of each factor
    with the forward return, across the date's symbols.

    Below three complete pairs, or with one side constant, both are null and the row stays.
    ``n_symbols`` counts all of the date's symbols.  ``wide`` ranks by a range partitioning, for
    dates that no task should hold.
    """
    n_symbols = F.count_distinct("symbol")
    if not wide:
        # numbered by one sort of the rows before they are unpivoted: a distinct count would first group the
        # long rows by symbol, each with a buffer for every aggregate below
        number = F.dense_rank().over(Window.partitionBy("date").orderBy(F.col("symbol").asc_nulls_last()))
        data = data.withColumn("_symbols", F.when(F.col("symbol").isNotNull(), number))
        n_symbols = F.coalesce(F.max("_symbols"), F.lit(0)).cast("long")
    long = unpivot_factors(data, factor_columns, ["forward_return", *([] if wide else ["_symbols"])])
    pair = F.col("value").isNotNull() & F.col("forward_return").isNotNull()
    paired = long.withColumn("_pair", pair)
    if wide:
        cell = ("factor", "date", "_pair")
        ranked = average_ranks(average_ranks(paired, cell, "value", ("symbol",), "_x"), cell, "forward_return", ("symbol",), "_y")
        ranked = ranked.withColumns({c: F.when(F.col("_pair"), F.col(c)) for c in ("_x", "_y")})
    else:
        ranked = paired.withColumns({"_x": F.when(F.col("_pair"), _average_rank("value")), "_y": F.when(F.col("_pair"), _average_rank("forward_return"))})
    varies = lambda c: F.min(F.when(F.col("_pair"), F.col(c))) < F.max(F.when(F.col("_pair"), F.col(c)))
    enough = (F.count_if("_pair") >= 3) & varies("value") & varies("forward_return")
    return ranked.groupBy("date", "factor").agg(
        F.when(enough, correlation("value", "forward_return")).alias("ic"), F.when(enough, _rank_correlation("_x", "_y")).alias("rank_ic"), n_symbols.alias("n_symbols")
    )


def ic_pearson(data: DataFrame, factor_columns: Sequence[str]) -> DataFrame:
    return ic_timeseries(data, factor_columns).select("date", "factor", "ic", "n_symbols")


def ic_spearman(data: DataFrame, factor_columns: Sequence[str], wide: bool = False) -> DataFrame:
    return ic_timeseries(data, factor_columns, wide).select("date", "factor", "rank_ic", "n_symbols")


def _numbered(ic_ts: DataFrame) -> DataFrame:
    """With the number of each of a factor's dates, of which there is one row each."""
    return ic_ts.withColumn("_k", F.row_number().over(Window.partitionBy("factor").orderBy("date")))


def ic_non_overlapping_sample(ic_ts: DataFrame, horizon: int) -> DataFrame:
    """Every ``horizon``-th of each factor's dates, from the first; null coefficients count."""
    if horizon <= 1:
        return ic_ts
    return _numbered(ic_ts).filter((F.col("_k") - 1) % horizon == 0).drop("_k")


def ic_summary(ic_ts: DataFrame, horizon: int = 1, non_overlapping: bool = True, periods_per_year: int = TRADING_DAYS) -> DataFrame:
    """One row a factor: mean, deviation, information ratio, share of positive values and t test
    of both coefficients over the sampled dates."""
    sampled = non_overlapping and horizon > 1
    numbered = _numbered(ic_ts).withColumn("_in", (F.col("_k") - 1) % (horizon if sampled else 1) == 0)
    stats = {"n_dates": F.count("*"), "effective_n_dates": F.count_if("_in")}
    for name in ("ic", "rank_ic"):
        x = F.when(F.col("_in"), F.col(name))
        stats |= {f"_n_{name}": F.count(x), f"mean_{name}": F.avg(x), f"std_{name}": F.stddev_samp(x), f"{name}_positive_ratio": F.avg((x > 0).cast("double"))}
    rows = numbered.groupBy("factor").agg(*(c.alias(n) for n, c in stats.items())).withColumn("sample_mode", F.lit("non_overlapping" if sampled else "daily"))
    for name, adjusted in (("ic", "overlap_adjusted"), ("rank_ic", "rank_ic_overlap_adjusted")):
        mean, sd, n = F.col(f"mean_{name}"), F.col(f"std_{name}"), F.col(f"_n_{name}")
        t, p = t_test(mean, sd, n)
        rows = rows.withColumn(f"{name}_ir", F.when(n >= 2, F.try_divide(mean, sd) * F.sqrt(F.lit(float(periods_per_year)))))
        rows = rows.withColumn(f"{name}_t_stat", t).withColumn(f"{name}_p_value", p)
        rows = rows.withColumns({f"{adjusted}_t_stat": F.col(f"{name}_t_stat"), f"{adjusted}_p_value": F.col(f"{name}_p_value")})
    return rows.select(*IC_SUMMARY).orderBy(F.col("mean_rank_ic").desc_nulls_last())


#: The columns of a summary, in order.
IC_SUMMARY = (
    "factor", "n_dates", "sample_mode", "effective_n_dates",
    "mean_ic", "std_ic", "ic_ir", "ic_positive_ratio", "ic_t_stat", "ic_p_value", "overlap_adjusted_t_stat", "overlap_adjusted_p_value",
    "mean_rank_ic", "std_rank_ic", "rank_ic_ir", "rank_ic_positive_ratio", "rank_ic_t_stat", "rank_ic_p_value", "rank_ic_overlap_adjusted_t_stat", "rank_ic_overlap_adjusted_p_value",
)


def ic_summary_daily(ic_ts: DataFrame, periods_per_year: int = TRADING_DAYS) -> DataFrame:
    return ic_summary(ic_ts, 1, False, periods_per_year)
