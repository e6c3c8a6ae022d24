"""Hand-made edge cases of the bar operators."""

import math
from datetime import date, timedelta
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.columns import correlation, index_market_symbol, pad_symbol, to_market_symbol
from barloom.functions.distributions import student_t_p, with_inverse_normal
from barloom.jobs import queries, research
from barloom.jobs.fixtures import table
from barloom.operators import backtest, evaluation, facts, factors, ingest, labels, matrix, returns, stats, universe
from barloom.sources import tables

DAY = date(2024, 1, 1)


def days(n):
    return [DAY + timedelta(i) for i in range(n)]


def panel(spark, closes, symbol="000001", **more):
    rows = [(symbol, d, c, *(more[k][i] for k in more)) for i, (d, c) in enumerate(zip(days(len(closes)), closes))]
    return spark.createDataFrame(rows, "symbol string, date date, close double" + "".join(f", {k} double" for k in more))


def values(df, column, by="date"):
    return [r[column] for r in df.orderBy(by).collect()]


def approx(xs):
    return [None if x is None else pytest.approx(x, abs=1e-4) for x in xs]


def quotes(spark, rows):
    return spark.createDataFrame(rows, "symbol string, date string, open string, high string, low string, close string, k int")


def test_bad_last_duplicate_removes_the_key(spark):
    rows = [("A", "2024-01-01", "10", "10", "10", "10", 1), ("A", "2024-01-01", "10", "10", "10", "-1", 2), ("A", "2024-01-02", "n/a", "1", "1", "1", 3), ("A", "2024-01-03", "1", "1", "1", "2", 4)]
    kept = ingest.clean_ohlcv(quotes(spark, rows), "k").collect()
    assert [(str(r["date"]), r["close"]) for r in kept] == [("2024-01-03", 2.0)]


def test_normalize_columns_prefers_the_first_vendor_name(spark):
    raw = spark.createDataFrame([("2024-01-01", "1", None, "x"), ("2024-01-02", None, "7", "3")], "`日期` string, `开盘` string, `开盘价` string, close string")
    got = ingest.normalize_columns(raw, symbol="42").orderBy("date").collect()
    assert [(r["symbol"], r["open"], r["close"]) for r in got] == [("000042", 1.0, None), ("000042", 7.0, 3.0)]
    with pytest.raises(ValueError):
        ingest.normalize_columns(raw.drop("日期"), symbol="42")


def test_codes(spark):
    df = spark.createDataFrame([("1",), ("600519",), ("1234567",), ("000300",), ("399001",)], "s string")
    got = [tuple(r) for r in df.select(pad_symbol(F.col("s")), to_market_symbol(F.col("s")), index_market_symbol(F.col("s"))).collect()]
    assert got == [("000001", "sz000001", "sz000001"), ("600519", "sh600519", "sh600519"), ("1234567", "sz1234567", "sz1234567"), ("000300", "sz000300", "sh000300"), ("399001", "sz399001", "sz399001")]


def test_source_is_chosen_for_the_whole_symbol(spark):
    df = spark.createDataFrame([("A", "sina"), ("A", "tencent"), ("B", "sina"), ("C", "other")], "symbol string, source string")
    assert sorted(tuple(r) for r in ingest.select_source_by_priority(df).collect()) == [("A", "tencent"), ("B", "sina")]


def test_returns_fill_nulls_and_logs_do_not(spark):
    bars = panel(spark, [10.0, None, 12.0, 11.0])
    assert values(returns.simple_return(bars), "return") == approx([None, 0.0, 0.2, -0.0833])
    assert values(returns.log_return(bars), "log_return") == approx([None, None, None, math.log(11 / 12)])


def test_risk_of_a_flat_series_is_null(spark):
    r = returns.risk_summary(panel(spark, [5.0] * 4)).first()
    assert (r["n_days"], r["sharpe"], r["max_drawdown"], r["annual_return"]) == (4, None, 0.0, 0.0)


def test_pairwise_covariance(spark):
    a, b = [None, 1.0, 2.0, 3.0, 5.0], [None, None, 1.0, 5.0, 4.0]
    rows = [(s, d, x) for s, xs in (("a", a), ("b", b)) for d, x in zip(days(5), xs)]
    df = spark.createDataFrame(rows, "symbol string, date date, return double")
    want = {("a", "a"): 2.9167, ("b", "b"): 4.3333, ("a", "b"): 1.8333, ("b", "a"): 1.8333}
    assert {(r[0], r[1]): pytest.approx(r[2], abs=1e-4) for r in matrix.cov_matrix(df).collect()} == want
    gram = {(r["symbol_i"], r["symbol_j"]): (r["cov"], r["corr"]) for r in matrix.gram_matrices(df, 1).collect()}
    assert {k: pytest.approx(v[0], abs=1e-4) for k, v in gram.items()} == want
    pair = pd.DataFrame({"a": a, "b": b}).corr()
    assert gram["a", "b"][1] == pytest.approx(pair.loc["a", "b"])
    one = df.filter("date = '2024-01-03'")
    assert {r["cov"] for r in matrix.cov_matrix(one).collect()} == {None}


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(correlation("x", "y")).first()[0] is None


def test_two_bars_on_one_date_are_an_error(spark):
    bars = panel(spark, [1.0, 2.0])
    with pytest.raises(Exception, match="two bars on one date: 000001 2024-01-0[12]"):
        matrix.return_matrix(bars.union(bars)).collect()


def test_p_values(spark):
    assert student_t_p(np.array([0.0, 2.0, np.inf, 12.706]), np.array([5.0, 10.0, 3.0, 1.0])) == pytest.approx([1.0, 0.07339, 0.0, 0.05], abs=1e-4)
    p = [1e-300, 1e-12, 1e-9, 0.01, 0.3, 0.5, 0.97, 0.999999]
    got = with_inverse_normal(spark.createDataFrame([(x,) for x in p], "p double"), "p", "z").collect()
    assert {r["p"]: r["z"] for r in got} == {x: pytest.approx(NormalDist().inv_cdf(x), rel=1e-12) for x in p}


def test_tests_of_tiny_series(spark):
    df = spark.createDataFrame([("a", DAY, 0.1), ("b", DAY, None), ("c", DAY, 0.2), ("c", DAY + timedelta(1), 0.2)], "symbol string, date date, return double")
    got = {r["symbol"]: r for r in stats.t_test_mean_return(df).collect()}
    assert (got["a"]["t_stat"], got["a"]["t_p_value"], got["a"]["is_mean_significant"]) == (None, None, False)
    assert (got["c"]["t_stat"], got["c"]["t_p_value"]) == (math.inf, 0.0)
    assert all(r["jb_stat"] is None and not r["is_normal"] for r in stats.jarque_bera(df).collect())
    assert stats.three_sigma_outliers(df).count() == 0


def test_rolling_gate_and_window_bounds(spark):
    rng = np.random.default_rng(1)
    closes = [float(x) if i % 6 else None for i, x in enumerate(50 + rng.normal(size=60).cumsum())]
    got = [r["low_volatility_20d"] for r in factors.build_price_factors(panel(spark, closes, turnover=closes)).orderBy("date").collect()]
    want = -pd.Series(closes, dtype=float).ffill().pct_change().rolling(20, min_periods=10).std()
    assert got == [None if np.isnan(x) else pytest.approx(x) for x in want]
    with pytest.raises(ValueError):
        factors.build_price_factors(panel(spark, closes), volatility_window=4)


def test_as_of_join_takes_a_null_latest_row(spark):
    f = spark.createDataFrame([("000001", DAY + timedelta(i)) for i in (1, 3, 5)], "symbol string, date date")
    v = spark.createDataFrame([("1", DAY + timedelta(2), 1.0, 1), ("1", DAY + timedelta(3), 5.0, 2), ("1", DAY + timedelta(3), None, 3)], "symbol string, date date, pb double, k int")
    assert values(factors.merge_valuation_factor(f, v, "k"), "value_factor") == [None, None, None]
    assert values(factors.merge_valuation_factor(f, v.filter("k < 3"), "k"), "value_factor") == [None, 0.2, 0.2]
    assert factors.merge_valuation_factor(f, v.drop("pb")).first()["value_factor_source"] == "unavailable"


def test_labels_at_the_horizon(spark):
    bars = panel(spark, [1.0] * 5, open=[1.0, 2.0, 3.0, 4.0, 5.0])
    assert values(labels.add_forward_return(bars, 2), "forward_return") == approx([1.0, 2 / 3, None, None, None])
    with pytest.raises(ValueError):
        labels.add_forward_return(bars, 2, "later")


def cross_section(spark, xs, ys=None, d=DAY):
    ys = ys or [float(i) for i in range(len(xs))]
    return spark.createDataFrame([(f"{i:06d}", d, x, y) for i, (x, y) in enumerate(zip(xs, ys))], "symbol string, date date, f double, forward_return double")


def test_winsorize_and_constant_factor(spark):
    df = cross_section(spark, [1.0, 2.0, 3.0, 10.0, None])
    assert values(labels.winsorize_by_date(df, ["f"], 0.01), "f", "symbol") == approx([1.03, 2.0, 3.0, 9.79, None])
    flat = cross_section(spark, [2.0, 2.0, 2.0])
    assert {r["f"] for r in labels.zscore_by_date(flat, ["f"]).collect()} == {None}
    frame = flat.withColumn("g", F.col("forward_return"))
    assert labels.finish_dataset(frame, ["f", "g"]).count() == 0


def test_bucket_sizes_and_ties(spark):
    seven = cross_section(spark, [float(i) for i in range(7)])
    sizes = backtest.assign_quantiles(factors.unpivot_factors(seven, ["f"])).groupBy("quantile").count().orderBy("quantile").collect()
    assert [r["count"] for r in sizes] == [2, 1, 1, 1, 2]
    tied = cross_section(spark, [3.0, 1.0, 3.0, 1.0])
    assert values(backtest.assign_quantiles(factors.unpivot_factors(tied, ["f"]), 4), "quantile", "symbol") == [3, 1, 4, 2]
    assert backtest.assign_quantiles(factors.unpivot_factors(cross_section(spark, [1.0]), ["f"])).first()["quantile"] is None


def test_rank_coefficient_of_ties_and_few_pairs(spark):
    xs, ys = [1.0, 1.0, 2.0, 3.0, 5.0], [2.0, 1.0, 3.0, 3.0, 9.0]
    got = evaluation.ic_timeseries(cross_section(spark, xs, ys), ["f"]).first()
    assert got["rank_ic"] == pytest.approx(pd.Series(xs).rank().corr(pd.Series(ys).rank()))
    few = evaluation.ic_timeseries(cross_section(spark, [1.0, 2.0, None], [1.0, 2.0, 3.0]), ["f"]).first()
    assert (few["ic"], few["rank_ic"], few["n_symbols"]) == (None, None, 3)


def test_every_hth_date_counts_null_coefficients(spark):
    ts = spark.createDataFrame([("f", d, None if i == 2 else float(i), None, 3) for i, d in enumerate(days(6))], "factor string, date date, ic double, rank_ic double, n_symbols long")
    assert values(evaluation.ic_non_overlapping_sample(ts, 2), "ic") == [0.0, None, 4.0]
    row = evaluation.ic_summary(ts, 2).first()
    assert (row["n_dates"], row["effective_n_dates"], row["mean_ic"], row["mean_rank_ic"]) == (6, 3, 2.0, None)


def test_missing_top_layer_gives_a_null_leg(spark):
    layers = spark.createDataFrame([(DAY, "f", 1, 0.1), (DAY, "f", 3, 0.4), (DAY + timedelta(1), "f", 1, 0.2)], "date date, factor string, quantile int, mean_forward_return double")
    got = backtest.long_short_returns(layers).orderBy("date").collect()
    assert [r["long_short_return"] for r in got] == [pytest.approx(0.3), None]
    grown = backtest.layered_cumulative_return(layers).filter("quantile = 3").orderBy("date").collect()
    assert [r["cumulative_return"] for r in grown] == approx([0.4, 0.4])


def test_turnover_skips_small_dates(spark):
    names = {0: "abcd", 1: "a", 2: "abce"}
    rows = [(s, DAY + timedelta(i), float(ord(s)), 0.0) for i, symbols in names.items() for s in symbols]
    df = spark.createDataFrame(rows, "symbol string, date date, f double, forward_return double")
    got = backtest.long_short_turnover(df, ["f"], 2).orderBy("date").collect()
    assert [str(r["date"]) for r in got] == ["2024-01-01", "2024-01-03"]
    # the top half is c, d and then c, e: half of each weight moves once out and once in
    assert [r["long_turnover"] for r in got] == [0.5, pytest.approx(0.5)]


def test_unknown_metadata(spark):
    bars = panel(spark, [1.0, 2.0])
    master = spark.createDataFrame([("1", None, None, None, None)], "symbol string, list_date date, is_st boolean, industry string, float_market_cap double")
    m = universe.normalize_security_master(master)
    assert universe.filter_new_stock(bars, m, 1).count() == 0
    assert universe.filter_industry_exclude(bars, m, ["X"]).count() == 2
    assert universe.filter_industry_include(bars, m, ["X"]).count() == 0
    assert universe.filter_float_cap(bars, m, least=1.0).count() == 0
    assert universe.filter_st(bars, m).count() == 2
    with pytest.raises(ValueError):
        universe.apply_universe_filters(bars, filters={"missing_metadata_policy": "strict"})


def test_audit_adds_up(spark):
    bars = panel(spark, [1.0, 1.2, 1.2, 1.21], volume=[1.0, 1.0, 0.0, 1.0])
    rows, audit = universe.apply_universe_filters(bars, ["1"], 2, 1)
    steps = audit.orderBy("step").collect()
    assert all(r["input_rows"] - r["removed_rows"] == r["output_rows"] for r in steps)
    assert all(a["output_rows"] == b["input_rows"] for a, b in zip(steps, steps[1:]))
    assert steps[-1]["output_rows"] == rows.count() == 2
    assert [r["status"] for r in steps].count("skipped") == 6


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([("a", DAY, 1.0), ("a", DAY + timedelta(1), 1.0)], "symbol string, date date, return double")
    got = facts.return_histogram(df, 10).collect()
    assert [(r["bin"], r["count"], r["density"]) for r in got] == [(5, 2, pytest.approx(10.0))]


def test_qq_line_of_normal_quantiles(spark):
    n = 50
    m = [NormalDist().inv_cdf((i - 0.3175) / (n + 0.365)) for i in range(1, n + 1)]
    df = spark.createDataFrame([("a", DAY + timedelta(i), 2 * x + 1) for i, x in enumerate(m)], "symbol string, date date, return double")
    fit = facts.qq_fit(facts.qq_points(df)).first()
    assert (fit["slope"], fit["intercept"], fit["r"]) == (pytest.approx(2, abs=0.05), pytest.approx(1, abs=1e-6), pytest.approx(1, abs=1e-3))


def test_tables(spark, tmp_path):
    tables.write_parquet(panel(spark, [1.0]), f"{tmp_path}/t")
    tables.write_csv(panel(spark, [1.0]), f"{tmp_path}/c")
    assert tables.read_parquet(spark, f"{tmp_path}/t").count() == 1
    assert tables.read_optional(spark, f"{tmp_path}/none") is None


def test_no_available_factor_is_an_error(spark):
    with pytest.raises(ValueError):
        research.factor_research(panel(spark, [1.0] * 3, open=[1.0] * 3), config=research.ResearchConfig(min_history_days=1, min_symbols_per_date=1))


def test_every_query_has_its_sql():
    assert not [n for n in queries.QUERIES if n not in queries.ORACLES]


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n.startswith("filter_") and n != "filter_date_range"))
def test_filters_remove_some_rows_and_keep_some(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    kept, every = queries.QUERIES[name](spark, sf_dir).count(), table(spark, sf_dir, "bars").count()
    assert 0 < kept < every


def test_every_step_of_the_audit_bites(spark):
    steps = queries.QUERIES["universe_filter_audit"](spark, "/root/testdata/sf0.01").collect()
    assert all(r["output_rows"] for r in steps)
    assert {r["filter_name"] for r in steps if r["removed_rows"]} >= {r["filter_name"] for r in steps} - {"min_history_days", "min_symbols_per_date"}


def test_empty_metadata_is_absent(spark):
    bars = panel(spark, [1.0, 1.2, 1.2, 1.21], volume=[1.0, 1.0, 0.0, 1.0])
    master = spark.createDataFrame([], "symbol string, list_date date, float_market_cap double")
    status = spark.createDataFrame([], "symbol string, date date, is_suspended boolean, is_limit_up boolean, is_limit_down boolean")
    filters = {"exclude_new_stock_days": 60, "min_float_market_cap": 1.0}
    got = universe.apply_universe_filters(bars, ["1"], 2, 1, filters, master, status)
    want = universe.apply_universe_filters(bars, ["1"], 2, 1, filters)
    assert got[0].collect() == want[0].collect() and len(got[0].collect()) == 2
    assert got[1].collect() == want[1].collect()


def test_last_metadata_row_counts(spark):
    bars = panel(spark, [1.0, 1.0])
    master = spark.createDataFrame([("1", True, 2), ("1", False, 1), ("1", False, 3)], "symbol string, is_st boolean, k int")
    status = spark.createDataFrame([("1", DAY, False, 1), ("1", DAY, True, 2)], "symbol string, date date, is_suspended boolean, k int")
    run = lambda m, s: universe.apply_universe_filters(bars, None, 1, 1, {}, m, s, "k", "k")[0].count()
    assert run(master, None) == 2 and run(master.filter("k < 3"), None) == 0
    assert run(None, status) == 1 and run(None, status.filter("k < 2")) == 2


def test_vendor_symbol_column(spark):
    raw = spark.createDataFrame([("42", "2024-01-01", "3")], "`股票代码` string, date string, close string")
    assert ingest.normalize_columns(raw).first()["symbol"] == "000042"
    with pytest.raises(ValueError):
        ingest.normalize_columns(raw.drop("股票代码"))
