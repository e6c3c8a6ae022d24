"""Distribution tests of each symbol's returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import TRADING_DAYS
from barloom.functions.distributions import t_test


def three_sigma_outliers(returns: DataFrame, sigma: float = 3.0) -> DataFrame:
    """symbol, date, return, mean, std, z_score of returns more than ``sigma`` deviations off.

    A symbol whose deviation is null or 0 has none.  The moments are one row a symbol.
    """
    moments = returns.groupBy("symbol").agg(F.avg("return").alias("mean"), F.stddev_samp("return").alias("std"))
    scored = returns.select("symbol", "date", "return").join(moments, "symbol").withColumn("z_score", F.try_divide(F.col("return") - F.col("mean"), F.col("std")))
    return scored.filter(F.abs("z_score") > sigma)


def t_test_mean_return(returns: DataFrame, popmean: float = 0.0) -> DataFrame:
    """symbol, mean_daily_return, t_stat, t_p_value, is_mean_significant (p < 0.05)."""
    moments = returns.groupBy("symbol").agg(F.avg("return").alias("mean_daily_return"), F.stddev_samp("return").alias("_sd"), F.count("return").alias("_n"))
    t, p = t_test(F.col("mean_daily_return"), F.col("_sd"), F.col("_n"), popmean)
    tested = moments.withColumns({"t_stat": t, "t_p_value": p})
    return tested.select("symbol", "mean_daily_return", "t_stat", "t_p_value", F.coalesce(F.col("t_p_value") < 0.05, F.lit(False)).alias("is_mean_significant"))


def _jb_stat() -> Column:
    n, s, k = F.count("return"), F.skewness("return"), F.kurtosis("return")
    return F.when((n >= 2) & (F.var_pop("return") > 0), n / 6 * (s * s + k * k / 4)).alias("jb_stat")


def _with_jb_test(rows: DataFrame) -> DataFrame:
    tested = rows.withColumn("jb_p_value", F.exp(-F.col("jb_stat") / 2))
    return tested.withColumn("is_normal", F.coalesce(F.col("jb_p_value") > 0.05, F.lit(False)))


def jarque_bera(returns: DataFrame) -> DataFrame:
    """symbol, jb_stat, jb_p_value, is_normal (p > 0.05); null and false below two values or
    without variance."""
    return _with_jb_test(returns.groupBy("symbol").agg(_jb_stat()))


def normality_test(returns: DataFrame) -> DataFrame:
    """``jarque_bera`` as symbol, jb_stat, p_value, is_normal."""
    return jarque_bera(returns).withColumnRenamed("jb_p_value", "p_value")


def distribution_test_summary(returns: DataFrame, sigma: float = 3.0) -> DataFrame:
    """One row a symbol: dates, observations, volatility, outliers, t test and Jarque-Bera test.

    All moments come from one aggregate; returns then meet their symbol's, to count the outliers.
    """
    seen = returns.filter("return is not null").select("symbol", "date", "return")
    moments = seen.groupBy("symbol").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("n_return_days"),
        F.avg("return").alias("mean_daily_return"), F.stddev_samp("return").alias("_sd"), _jb_stat(),
    )
    off = F.abs(F.try_divide(F.col("return") - F.col("mean_daily_return"), F.col("_sd"))) > sigma
    outliers = seen.join(moments.select("symbol", "mean_daily_return", "_sd"), "symbol").groupBy("symbol").agg(F.count_if(off).alias("three_sigma_outlier_count"))
    t, p = t_test(F.col("mean_daily_return"), F.col("_sd"), F.col("n_return_days"))
    tested = _with_jb_test(moments.join(outliers, "symbol").withColumns({"t_stat": t, "t_p_value": p}))
    return tested.select(
        "symbol", "start_date", "end_date", "n_return_days", (F.col("_sd") * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("annual_volatility"), "mean_daily_return", "t_stat", "t_p_value",
        F.coalesce(F.col("t_p_value") < 0.05, F.lit(False)).alias("is_mean_significant"), "jb_stat", "jb_p_value", "is_normal", "three_sigma_outlier_count",
        F.try_divide("three_sigma_outlier_count", "n_return_days").alias("three_sigma_outlier_ratio"),
    )


def distribution_conclusion(summary: DataFrame) -> DataFrame:
    """One row: how many series fail each test, and the symbols with the highest volatility and
    the most outliers (of equals the first symbol)."""
    # the smallest symbol of equals comes out on top when symbols are ordered downwards
    top = lambda c: F.min_by("symbol", F.struct(-F.col(c), F.col("symbol")))
    return summary.agg(
        F.count_if(~F.col("is_normal")).alias("non_normal_count"),
        F.count_if("is_mean_significant").alias("significant_count"),
        F.count("*").alias("n_symbols"),
        top("annual_volatility").alias("highest_volatility_symbol"),
        top("three_sigma_outlier_count").alias("most_outliers_symbol"),
    )
