"""Layered and long-short portfolios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.factors import unpivot_factors
from barloom.operators.wide import row_numbers

BASIS_POINTS = 10_000


def assign_quantiles(long: DataFrame, quantiles: int = 5, wide: bool = False, ends: bool = False) -> DataFrame:
    """``long`` (factor, date, symbol, value) with ``quantile``: buckets of equal rank distance,
    1 for the lowest values; equal values in symbol order; null below two names.  ``wide`` ranks
    by a range partitioning, for dates that no task should hold.  ``ends`` adds ``_hi`` and ``_lo``, the
    date's highest and lowest bucket: the first row is always in 1, the last in the number of buckets."""
    if wide:
        ranked = row_numbers(long, ("factor", "date"), ("value", "symbol"), "_r", "_n")
    else:
        w = Window.partitionBy("factor", "date").orderBy("value", "symbol")  # one window for both
        ranked = long.withColumns({"_r": F.row_number().over(w), "_n": F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    buckets = F.least(F.lit(quantiles), F.col("_n"))
    # ceil((r - 1) b / (n - 1)) in whole numbers
    bucket = F.greatest(F.lit(1), F.floor(((F.col("_r") - 1) * buckets + F.col("_n") - 2) / (F.col("_n") - 1)))
    known = lambda c: F.when(F.col("_n") >= 2, c.cast("int"))
    columns = {"quantile": known(bucket)} | ({"_hi": known(buckets), "_lo": known(F.lit(1))} if ends else {})
    return ranked.withColumns(columns).drop("_r", "_n")


def layer_returns(data: DataFrame, factor_columns: Sequence[str], quantiles: int = 5) -> DataFrame:
    """date, factor, quantile, mean_forward_return over rows with factor and return."""
    long = unpivot_factors(data, factor_columns, ["forward_return"]).filter("value is not null and forward_return is not null")
    return layer_means(assign_quantiles(long, quantiles))


def layer_means(bucketed: DataFrame) -> DataFrame:
    """``layer_returns`` of rows that have their ``quantile``."""
    return bucketed.filter("quantile is not null").groupBy("date", "factor", "quantile").agg(F.avg("forward_return").alias("mean_forward_return"))


def long_short_returns(layers: DataFrame) -> DataFrame:
    """date, factor, long_return, short_return, long_short_return.

    The factor's highest and lowest bucket of all dates count; a date without one of them has a
    null leg."""
    ends = layers.groupBy("factor").agg(F.max("quantile").alias("_hi"), F.min("quantile").alias("_lo"))
    leg = lambda end: F.max(F.when(F.col("quantile") == F.col(end), F.col("mean_forward_return")))
    legs = layers.join(ends, "factor").groupBy("date", "factor").agg(leg("_hi").alias("long_return"), leg("_lo").alias("short_return"))
    return legs.withColumn("long_short_return", F.col("long_return") - F.col("short_return"))


def long_only_returns(long_short: DataFrame) -> DataFrame:
    return long_short.select("date", "factor", "long_return")


def long_short_turnover(data: DataFrame, factor_columns: Sequence[str], quantiles: int = 5) -> DataFrame:
    """date, factor, long_turnover, short_turnover, gross_turnover: half the sum of weight changes
    of equally weighted legs, the date's highest and lowest bucket."""
    return leg_turnover(assign_quantiles(unpivot_factors(data, factor_columns).filter("value is not null"), quantiles, ends=True))


def leg_turnover(bucketed: DataFrame) -> DataFrame:
    """``long_short_turnover`` of rows that have their ``quantile`` and, to spare a window, the ends of
    their date (see ``assign_quantiles``).

    Dates with fewer than two names are skipped and keep the book.  Each name knows the date on which
    it was last in the leg; a date's names are counted by it, and those count as staying whose date is
    the factor's date before.  So no date is joined with another, and the rows are read once: with
    n names now, m of them also before, and k names before, the turnover is
    (m |1/n - 1/k| + (n - m)/n + (k - m)/k) / 2.
    """
    bucketed = bucketed.filter("quantile is not null")
    cell = Window.partitionBy("factor", "date")
    ends = bucketed if "_hi" in bucketed.columns else bucketed.withColumns({"_hi": F.max("quantile").over(cell), "_lo": F.min("quantile").over(cell)})
    in_leg = lambda leg, end: F.when(F.col("quantile") == F.col(end), F.lit(leg))
    names = ends.select("factor", "date", "symbol", F.explode(F.array_compact(F.array(in_leg("long", "_hi"), in_leg("short", "_lo")))).alias("leg"))
    seen = names.withColumn("_seen", F.lag("date").over(Window.partitionBy("factor", "leg", "symbol").orderBy("date")))
    counted = seen.groupBy("factor", "leg", "date", "_seen").agg(F.count("*").alias("_c"))
    counted = counted.repartition("factor")  # a few rows a date, for everything below
    by_date = F.map_from_entries(F.collect_list(F.when(F.col("_seen").isNotNull(), F.struct("_seen", "_c"))))  # a count for each earlier date at most
    sizes = counted.groupBy("factor", "leg", "date").agg(F.sum("_c").cast("double").alias("_n"), by_date.alias("_by_date"))
    w = Window.partitionBy("factor", "leg").orderBy("date")  # one row a date
    stayed = F.coalesce(F.element_at("_by_date", F.coalesce(F.lag("date").over(w), F.col("date"))), F.lit(0)).cast("double")
    before = sizes.select("factor", "leg", "date", "_n", F.lag("_n").over(w).alias("_k"), stayed.alias("_m"))
    changed = F.expr("0.5 * (_m * abs(1 / _n - 1 / _k) + (_n - _m) / _n + (_k - _m) / _k)")
    moved = before.withColumn("_t", F.coalesce(changed, F.lit(0.5)))
    leg_of = lambda leg: F.max(F.when(F.col("leg") == leg, F.col("_t")))
    legs = moved.groupBy("date", "factor").agg(leg_of("long").alias("long_turnover"), leg_of("short").alias("short_turnover"))
    return legs.withColumn("gross_turnover", F.col("long_turnover") + F.col("short_turnover"))


def top_quantile_turnover(data: DataFrame, factor_columns: Sequence[str], quantiles: int = 5) -> DataFrame:
    return long_short_turnover(data, factor_columns, quantiles).select("date", "factor", F.col("long_turnover").alias("top_quantile_turnover"))


def compounded(r: str) -> Column:
    return F.product(1 + F.col(r)) - 1


def cost_sensitivity(long_short: DataFrame, turnover: DataFrame, transaction_cost_bps: Sequence[int] = (0, 5, 10, 20)) -> DataFrame:
    """factor, transaction_cost_bps, the mean and compounded net returns of the long leg alone and of
    both legs, the deviation of the latter, and the average turnovers.

    The long leg pays for its own turnover, both legs for theirs together.  A date without turnover
    costs nothing; a null return still counts its turnover."""
    joined = long_short.join(turnover, ["date", "factor"], "left")
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("long_turnover", "short_turnover", "gross_turnover")})
    priced = filled.withColumn("transaction_cost_bps", F.explode(F.array(*map(F.lit, transaction_cost_bps))))
    after_cost = lambda r, moved: F.col(r) - F.col(moved) * F.col("transaction_cost_bps") / BASIS_POINTS
    net = priced.withColumns({"_net_long": after_cost("long_return", "long_turnover"), "_net": after_cost("long_short_return", "gross_turnover")})
    return net.groupBy("factor", "transaction_cost_bps").agg(
        F.avg("_net_long").alias("mean_net_long_return"), F.avg("_net").alias("mean_net_return"),
        compounded("_net_long").alias("cumulative_net_long_return"), compounded("_net").alias("cumulative_net_return"), F.stddev_samp("_net").alias("net_return_std"),
        F.avg("long_turnover").alias("average_long_turnover"), F.avg("short_turnover").alias("average_short_turnover"), F.avg("gross_turnover").alias("average_turnover"),
    )


def layered_cumulative_return(layers: DataFrame) -> DataFrame:
    """date, factor, quantile, cumulative_return, where an absent layer earns nothing that date."""
    dates = layers.select("factor", "date").distinct()
    grid = dates.join(layers.select("factor", "quantile").distinct(), "factor")
    full = grid.join(layers, ["factor", "date", "quantile"], "left")
    growth = 1 + F.coalesce("mean_forward_return", F.lit(0.0))
    w = Window.partitionBy("factor", "quantile").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return full.select("date", "factor", "quantile", (F.product(growth).over(w) - 1).alias("cumulative_return"))
