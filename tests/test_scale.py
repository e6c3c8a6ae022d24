"""Long histories, wide dates and other forms that scale, against the plain ones and pandas."""

import math
import re
from datetime import date, timedelta

import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.jobs import queries, refresh, research
from barloom.jobs.fixtures import table, with_tables
from barloom.operators import backtest, chunks, evaluation, facts, factors, ingest, labels, matrix, returns, universe, wide
from barloom.operators.chunks import Chunks
from barloom.sources import tables

DAY = date(2024, 1, 1)
SF = "/root/testdata/sf0.001"


def random_panel(spark, seed=0, symbols=4, n=150):
    """Gappy dates, null prices, a symbol of one row and one that starts with nulls."""
    rng, rows = np.random.default_rng(seed), []
    for s in range(symbols):
        at = np.sort(rng.choice(2 * n, n, replace=False))
        for k, (i, p) in enumerate(zip(at, np.exp(rng.normal(0, 0.05, n).cumsum()) * 50)):
            rows.append((f"{s:06d}", DAY + timedelta(int(i)), float(p) if rng.random() > 0.15 and not (s == 1 and k < 40) else None, float(p * 1.01), float(rng.random())))
    rows.append(("000099", DAY, 5.0, 5.0, 0.1))
    return spark.createDataFrame(rows, "symbol string, date date, close double, open double, turnover double").repartition(3)


def same(a, b, keys=("symbol", "date")):
    a, b = (df.toPandas().sort_values(list(keys)).reset_index(drop=True) for df in (a, b))
    pd.testing.assert_frame_equal(a[sorted(a)], b[sorted(a)], rtol=1e-9, atol=1e-12)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def windows_of(df):
    """What each window of the plan is partitioned and ordered by."""
    return [line.split("], [", 1)[1] for line in plan_of(df).splitlines() if " Window [" in line]


# --- long histories


@pytest.mark.parametrize("cut", [Chunks(7, 3), Chunks(40, 16), Chunks(366, 2048)])
def test_chunked_factors_equal_plain_ones(spark, cut):
    """Also where chunks and blocks are smaller than the windows."""
    bars = random_panel(spark)
    same(factors.build_price_factors(bars, 10, 8, 6, 25, chunks=cut), factors.build_price_factors(bars, 10, 8, 6, 25))
    for timing in labels.TIMINGS:
        same(labels.add_forward_return(bars, 5, timing, cut), labels.add_forward_return(bars, 5, timing))
    same(returns.max_drawdown(bars, cut.days), returns.max_drawdown(bars), ["symbol"])
    same(returns.risk_summary(bars, 0.02, cut.days), returns.risk_summary(bars, 0.02), ["symbol"])


def test_no_chunked_window_has_a_whole_symbol(spark):
    """Bars are windowed by (symbol, chunk) or (symbol, block); by symbol alone only chunks, in their order."""
    bars = random_panel(spark)
    for df in (factors.build_price_factors(bars, chunks=Chunks(40, 30)), labels.add_forward_return(bars, 5, chunks=Chunks(40, 30)), returns.risk_summary(bars, chunk_days=40)):
        for by in windows_of(df):
            assert "_chunk" in by or "_block" in by
    dealt = chunks.with_halo(chunks.numbered(bars, 40), 30, 20, 6)
    assert dealt.groupBy("symbol", "_block").count().agg(F.max("count")).first()[0] <= 30 + 20 + 6
    assert dealt.filter("_own").count() == bars.count()


def test_chunks_need_a_size():
    with pytest.raises(ValueError):
        Chunks(0, 5)


@pytest.mark.parametrize("days", [3, 50, 5000])
def test_chunked_valuation_equals_plain_one(spark, days):
    rng, bars = np.random.default_rng(3), random_panel(spark)
    rows = [(f"{rng.integers(0, 6)}", DAY + timedelta(int(rng.integers(-200, 300))), None if rng.random() < 0.3 else float(rng.normal(1, 1)), f"{i:04d}") for i in range(60)]
    rows += [(s, d, 7.0, k + "x") for s, d, _, k in rows[::4]]  # equal dates, of which the later counts
    v = spark.createDataFrame(rows, "symbol string, date date, pb double, k string")
    frame = bars.select("date", "symbol")
    same(factors.merge_valuation_factor(frame, v, "k", days), factors.merge_valuation_factor(frame, v, "k"))


def test_orders_of_any_type(spark):
    f = spark.createDataFrame([("000001", DAY)], "symbol string, date date")
    v = spark.createDataFrame([("1", DAY, 1.0, "b", "2024-01-01 00:00:00.5"), ("1", DAY, 2.0, "a", "2024-01-01 00:00:00.75")], "symbol string, date date, pb double, t string, s string")
    v = v.withColumn("s", F.col("s").cast("timestamp"))
    assert factors.merge_valuation_factor(f, v, "t").first()["value_factor"] == 1.0
    assert factors.merge_valuation_factor(f, v, "s").first()["value_factor"] == 0.5
    none = factors.merge_valuation_factor(f, v.limit(0))
    assert (none.first()["value_factor"], none.first()["value_factor_source"]) == (None, "unavailable")


def test_default_windows():
    assert factors.factor_columns_from_config({"momentum_window": 10}) == ["momentum_10d", "low_volatility_20d", "turnover_20d", "value_factor"]


# --- wide dates


def wide_dates(spark, ties=False, n=700):
    rng, rows = np.random.default_rng(9), []
    for d in range(3):
        for i in range(n if d else 1):
            x = rng.normal() * 10.0 ** rng.integers(-8, 8)
            rows.append((f"{i:06d}", DAY + timedelta(d), float(np.round(x, 1) if ties else x) if rng.random() > 0.1 else None, float(rng.integers(0, 9) if ties else rng.normal())))
    return spark.createDataFrame(rows, "symbol string, date date, f double, forward_return double").repartition(4)


@pytest.fixture
def small_bounds(monkeypatch):
    """Every table of cells counts as too large for a broadcast."""
    monkeypatch.setattr(wide, "MOST_BROADCAST", 0)


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("q", [0.01, 0.25, 0.5])
def test_narrowed_quantiles_equal_percentile_to_the_last_bit(spark, ties, q):
    df = wide_dates(spark, ties)
    got = {r["date"]: (list(r["_q_f"]), list(r["_q_forward_return"])) for r in wide.quantiles_by_date(df, ["f", "forward_return"], (q, 1 - q), bins=8).collect() if r["_q_f"]}
    p = lambda c: F.percentile(c, F.array(F.lit(q), F.lit(1 - q)))
    want = {r[0]: (r[1], r[2]) for r in df.groupBy("date").agg(p("f"), p("forward_return")).collect() if r[1]}
    assert got == want != {}


def test_quantiles_of_extreme_values(spark):
    xs = [-1.7e308, -1e300, -5e-324, 0.0, 5e-324, 1e-300, 1.0, 1.7e308]
    df = spark.createDataFrame([(DAY, x) for x in xs], "date date, f double")
    got = wide.quantiles_by_date(df, ["f"], (0.3, 0.5, 1.0), bins=2).first()["_q_f"]
    assert got == df.agg(F.percentile("f", F.array(*map(F.lit, (0.3, 0.5, 1.0))))).first()[0]
    endless = spark.createDataFrame([(DAY, x) for x in (*xs, np.inf, np.inf, -np.inf, np.nan)], "date date, f double")
    assert wide.quantiles_by_date(endless, ["f"], (0.0, 0.5, 1.0), bins=2).first()["_q_f"] == [-np.inf, 5e-324, np.inf]


@pytest.mark.parametrize("ties", [False, True])
def test_wide_statistics_equal_plain_ones(spark, ties):
    df = wide_dates(spark, ties)
    same(labels.winsorize_by_date(df, ["f", "forward_return"], 0.05, wide=True), labels.winsorize_by_date(df, ["f", "forward_return"], 0.05))
    same(labels.zscore_by_date(df, ["f"], wide=True), labels.zscore_by_date(df, ["f"]))
    same(evaluation.ic_timeseries(df, ["f"], wide=True), evaluation.ic_timeseries(df, ["f"]), ["date"])
    long = factors.unpivot_factors(df.filter("f is not null"), ["f", "forward_return"])
    same(backtest.assign_quantiles(long, 7, wide=True), backtest.assign_quantiles(long, 7), ["factor", "date", "symbol"])


def test_wide_statistics_beyond_the_broadcast(spark, small_bounds):
    test_wide_statistics_equal_plain_ones(spark, True)


def test_ties_and_copies_of_cells_are_not_broadcast(spark, monkeypatch):
    """However small the tables they are made of look: the driver would hold the copies."""
    df = wide_dates(spark, True)
    rows = factors.unpivot_factors(df, ["f"], ["forward_return"])
    monkeypatch.setattr(wide, "TIED", 7)
    ranked = wide.average_ranks(rows, ("factor", "date"), "forward_return", ("symbol",), "x")
    plain = rows.withColumn("n", F.row_number().over(Window.partitionBy("date").orderBy("forward_return", "symbol"))).withColumn("x", F.avg("n").over(Window.partitionBy("date", "forward_return"))).drop("n")
    assert ranked.count() == rows.count() and not ranked.exceptAll(plain.select(ranked.columns)).count()
    known = df.groupBy("date").count()
    monkeypatch.setattr(wide, "MOST_BROADCAST", 0)
    assert "Broadcast" not in plan_of(ranked) and "Broadcast" not in plan_of(wide.meet(df, known, ["date"]))


def test_no_wide_window_has_a_whole_date(spark):
    df = wide_dates(spark)
    long = factors.unpivot_factors(df, ["f"])
    for out in (labels.winsorize_by_date(df, ["f"], 0.05, wide=True), labels.zscore_by_date(df, ["f"], wide=True), backtest.assign_quantiles(long, wide=True), evaluation.ic_spearman(df, ["f"], wide=True)):
        assert not [by for by in windows_of(out) if "date" in by]


# --- turnover and costs


def test_turnover_of_random_books(spark):
    rng, rows = np.random.default_rng(2), []
    for d in range(12):
        for s in rng.choice(15, int(rng.integers(0, 12)), replace=False):
            rows.append((f"{s:06d}", DAY + timedelta(d), float(rng.normal()), 0.0))
    df = spark.createDataFrame(rows, "symbol string, date date, f double, forward_return double")
    want, before = {}, {"long": {}, "short": {}}
    book = backtest.assign_quantiles(factors.unpivot_factors(df, ["f"]), 3).filter("quantile is not null").toPandas()
    for day, g in book.groupby("date"):
        now = {}
        for leg, end in (("long", g["quantile"].max()), ("short", g["quantile"].min())):
            names = g[g["quantile"] == end]["symbol"]
            new = dict.fromkeys(names, 1 / len(names))
            now[leg] = sum(abs(new.get(s, 0) - before[leg].get(s, 0)) for s in {*new, *before[leg]}) / 2
            before[leg] = new
        want[day] = (now["long"], now["short"])
    got = {r["date"]: (r["long_turnover"], r["short_turnover"]) for r in backtest.long_short_turnover(df, ["f"], 3).collect()}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d]) for d in want)


def test_turnover_reads_its_rows_once(spark):
    df = wide_dates(spark)
    plan = plan_of(backtest.long_short_turnover(df, ["f", "forward_return"]))
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("Exchange hashpartitioning") <= 6


def test_net_long_only_returns(spark):
    spread = spark.createDataFrame([(DAY, "f", 0.10, 0.02, 0.08), (DAY + timedelta(1), "f", -0.05, 0.01, -0.06), (DAY + timedelta(2), "f", None, 0.01, None)], "date date, factor string, long_return double, short_return double, long_short_return double")
    turnover = spark.createDataFrame([(DAY, "f", 0.5, 0.5, 1.0)], "date date, factor string, long_turnover double, short_turnover double, gross_turnover double")
    got = backtest.cost_sensitivity(spread, turnover, (100,)).first()
    assert got["mean_net_long_return"] == pytest.approx((0.095 - 0.05) / 2)
    assert got["cumulative_net_long_return"] == pytest.approx(1.095 * 0.95 - 1)
    assert got["mean_net_return"] == pytest.approx((0.07 - 0.06) / 2) and got["cumulative_net_return"] == pytest.approx(1.07 * 0.94 - 1)
    assert got["net_return_std"] == pytest.approx(np.std([0.07, -0.06], ddof=1))
    assert (got["average_long_turnover"], got["average_turnover"]) == (pytest.approx(0.5 / 3), pytest.approx(1 / 3))


# --- matrices, keep-last, density, audit


def test_block_sums_run_once(spark):
    plan = plan_of(matrix.gram_matrices(matrix.return_matrix(random_panel(spark)), 2))
    assert plan.count("FlatMapGroupsInArrow") == 1
    checked = plan_of(matrix.return_matrix(random_panel(spark)))
    assert checked.count("Exchange hashpartitioning") == 1 and checked.count("Scan ExistingRDD") == 1


def test_sums_of_block_pairs_are_not_shuffled(spark):
    """Only packed returns are dealt to the pairs of blocks; what the pairs make stays in its task."""
    plan = plan_of(matrix.gram_matrices(matrix.return_matrix(random_panel(spark)), 2))
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_spans_of_different_dates_add_up(spark, monkeypatch):
    monkeypatch.setattr(matrix, "SPAN", 7)
    rng = np.random.default_rng(5)
    x = np.where(rng.random((40, 7)) < 0.4, np.nan, rng.normal(size=(40, 7)))
    x[:14, 0], x[:, 6] = np.nan, 0.5
    df = spark.createDataFrame([(f"s{j}", DAY + timedelta(d), float(x[d, j])) for d in range(40) for j in range(7) if x[d, j] == x[d, j]], "symbol string, date date, return double")
    got = {(r[0], r[1]): tuple(r)[2:] for r in matrix.gram_matrices(df, 3).collect()}
    assert len(got) == 49
    for (a, b), (n, cov, corr) in got.items():
        pair = x[:, [int(a[1]), int(b[1])]]
        pair = pair[~np.isnan(pair).any(axis=1)]
        assert n == len(pair) and cov == pytest.approx(np.cov(pair.T)[0, 1])
        assert corr is None if "s6" in (a, b) else corr == pytest.approx(np.corrcoef(pair.T)[0, 1])


def test_packed_returns_are_dealt_to_strips_of_blocks(spark, monkeypatch):
    """The copies of the packed returns don't grow with the blocks, and a task holds no more than its bytes."""
    assert [matrix._strip(n, 435_000 * n) for n in (1, 14, 40, 235)] == [1, 1, 3, 16]
    assert matrix._strip(235, 20_000_000 * 235) == 1 and matrix._strip(1, 0) == 1
    monkeypatch.setattr(matrix, "SPAN", 40)
    returns = tables.stored(matrix.return_matrix(random_panel(spark, symbols=7)))
    want = matrix.gram_matrices(returns, 8)
    for strips in (2, 3, 14):
        monkeypatch.setattr(matrix, "STRIPS", strips)
        same(matrix.gram_matrices(returns, 1), want, ("symbol_i", "symbol_j"))
        same(matrix.gram_matrices(returns, 2), want, ("symbol_i", "symbol_j"))


def test_matrix_rows_take_little_room_in_a_file(spark, tmp_path):
    """Columns of symbols take well below a byte a row, and a value costs little when it comes again with its symbols swapped."""
    rng, n = np.random.default_rng(8), 300
    panel = pd.DataFrame({"date": np.repeat(pd.date_range("2024-01-01", periods=20).date, n), "symbol": np.tile([f"{s:06d}" for s in range(n)], 20), "return": rng.normal(size=20 * n)})
    matrix.corr_matrix(spark.createDataFrame(panel, "date date, symbol string, return double")).coalesce(1).write.parquet(f"{tmp_path}/corr")
    (file,) = (tmp_path / "corr").glob("*.parquet")
    meta, size = pq.ParquetFile(file).metadata, {}
    for g in range(meta.num_row_groups):
        for c in range(3):
            column = meta.row_group(g).column(c)
            size[column.path_in_schema] = size.get(column.path_in_schema, 0) + column.total_compressed_size / n**2
    assert meta.num_rows == n**2
    assert size["symbol_i"] + size["symbol_j"] < 0.8 and size["corr"] < 6


def test_wide_matrix_has_every_cell(spark):
    rows = [("a", DAY, 0.1), ("b", DAY, None), ("b", DAY + timedelta(1), 0.2)]
    long = spark.createDataFrame(rows, "symbol string, date date, return double")
    got = {(r["symbol"], (r["date"] - DAY).days): r["return"] for r in matrix.long_return_matrix(matrix.wide_return_matrix(long, ["a", "b"])).collect()}
    assert got == {("a", 0): 0.1, ("b", 0): None, ("a", 1): None, ("b", 1): 0.2}
    with pytest.raises(ValueError):
        matrix.wide_return_matrix(long, ["x"] * (matrix.MOST_COLUMNS + 1))


def test_wide_matrix_of_any_width_is_cut_into_blocks(spark, monkeypatch):
    rows = [(f"s{k}", DAY + timedelta(d), k + d / 10) for k in range(5) for d in range(3) if (k + d) % 3]
    long = spark.createDataFrame([*rows, ("s9", DAY, None)], "symbol string, date date, return double")
    wide_rows, names = matrix.wide_return_blocks(long, 2)
    assert len(wide_rows.columns) == 4 and wide_rows.count() == 9
    got = [(r["symbol"], (r["date"] - DAY).days, r["return"]) for r in matrix.long_return_blocks(wide_rows, names).collect()]
    assert sorted(got, key=str) == sorted([(f"s{k}", d, k + d / 10 if (k + d) % 3 and k != 9 else None) for k in (*range(5), 9) for d in range(3)], key=str)


def test_wide_return_matrix_query_takes_more_symbols_than_columns(spark, monkeypatch):
    monkeypatch.setattr(matrix, "MOST_COLUMNS", 3)
    assert queries.QUERIES["wide_return_matrix"](spark, SF).count() > 0


def test_last_rows_are_an_aggregate(spark):
    rows = [("A", DAY, float(k), 1.0, 1.0, 1.0, k % 5 if k else None) for k in range(200)]
    df = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, k int").coalesce(2)
    cleaned = ingest.clean_ohlcv(df, "k")
    assert cleaned.first()["k"] == 4 and "Window" not in plan_of(cleaned)
    only_null = ingest.clean_ohlcv(df.filter("k is null").withColumn("open", F.lit(2.0)), "k")
    assert only_null.count() == 1
    partial = df.groupBy("symbol", "date").agg(F.max_by("close", "k"))
    for out in (universe.normalize_security_master(df, "k"), universe.normalize_trade_status(df, "k"), partial):
        assert "Window" not in plan_of(out)


def test_binned_density_is_within_its_bound(spark):
    rng = np.random.default_rng(4)
    rows = [(s, DAY + timedelta(i), float(x)) for s, scale in (("a", 0.02), ("b", 3.0)) for i, x in enumerate(rng.standard_t(4, 800) * scale)]
    rows += [("c", DAY, 1.0), ("c", DAY + timedelta(1), 1.0)]
    df = spark.createDataFrame(rows, "symbol string, date date, return double")
    exact = {(r["symbol"], r["point"]): r["density"] for r in facts.return_kde(df).collect()}
    for nodes in (32, 512):
        got = facts.return_kde(df, nodes=nodes).collect()
        assert {(r["symbol"], r["point"]) for r in got} == exact.keys()
        assert all(abs(r["density"] - exact[r["symbol"], r["point"]]) <= r["error_bound"] for r in got)
    peak = max(d for (s, _), d in exact.items() if s == "a")
    assert max(abs(r["density"] - exact[r["symbol"], r["point"]]) for r in got if r["symbol"] == "a") < 0.001 * peak
    with pytest.raises(ValueError):
        facts.return_kde(df, nodes=1)


def test_stored_flags_leave_the_audit_as_it_is(spark):
    bars = random_panel(spark).withColumn("volume", F.when(F.col("turnover") > 0.2, 1.0))
    plain, once = (universe.apply_universe_filters(bars, None, 5, 1, store=store) for store in (False, True))
    same(plain[0], once[0])
    assert plain[1].orderBy("step").collect() == once[1].orderBy("step").collect()
    assert "Window" not in plan_of(once[0]) + plan_of(once[1])


# --- tables


def test_windows_over_a_bucketed_table_need_no_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.sources.useV1SourceList", "parquet")
    bars = random_panel(spark)
    stored = tables.write_bucketed(bars, "bars_by_symbol", f"{tmp_path}/bars", 4)
    try:
        built = factors.build_price_factors(stored)
        assert "Exchange" not in plan_of(stored.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("date"))))
        same(built, factors.build_price_factors(bars))
        summary = returns.risk_summary(stored)
        assert "Exchange" not in plan_of(summary)
    finally:
        spark.sql("drop table bars_by_symbol")


def test_one_year_is_replaced(spark, tmp_path):
    path = f"{tmp_path}/years"
    rows = spark.createDataFrame([(2023, 1), (2024, 2), (2024, 3)], "year int, x int")
    tables.replace_partitions(rows, path, ("year",))
    tables.replace_partitions(spark.createDataFrame([(2024, 9)], "year int, x int"), path, ("year",))
    assert sorted((r["year"], r["x"]) for r in tables.read_parquet(spark, path).collect()) == [(2023, 1), (2024, 9)]


# --- SQL


def test_every_oracle_can_be_a_view():
    with duckdb.connect() as db:
        for name in ("lineitem", "part", "supplier", "nation"):
            db.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
        for name, sql in queries.ORACLES.items():
            db.sql(f"create or replace view one as {sql}")
            assert db.sql("describe one").fetchall(), name


@pytest.mark.parametrize("name", ["cost_sensitivity", "wide_return_matrix", "long_short_turnover", "merge_valuation_factor_chunked", "winsorize_by_date_wide"])
def test_queries_equal_their_sql(spark, name):
    with duckdb.connect() as db:
        for t in ("lineitem", "part", "supplier", "nation"):
            db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = db.sql(queries.ORACLES[name])
        columns = sorted(want.columns)
        want = {tuple(str(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()}
    got = {tuple(str(r[c]) for c in columns) for r in queries.QUERIES[name](spark, SF).collect()}
    assert got == want
    assert table(spark, SF, "bars").count() > 0


def test_valuation_does_not_depend_on_the_cut_of_the_file(spark, tmp_path):
    """Means are summed in the order of the rows, to the last bit, however many tasks read them."""
    with duckdb.connect() as db:
        db.execute("set threads = 1")
        db.execute(f"copy (from '{SF}/lineitem.parquet' order by hash(l_orderkey, l_linenumber)) to '{tmp_path}/lineitem.parquet' (row_group_size 2048)")
        db.execute(f"copy (from '{SF}/part.parquet') to '{tmp_path}/part.parquet'")
        for t in ("lineitem", "part"):
            db.execute(f"create view {t} as from '{tmp_path}/{t}.parquet'")
        want = {tuple(r) for r in db.execute(with_tables("select symbol, date, pb, pe from {valuation}")).fetchall()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        assert {tuple(r) for r in table(spark, str(tmp_path), "valuation").collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_queries_on_layers_make_the_dataset_once(spark):
    """Layers are stored before anything reads them twice."""
    for name in ("layered_cumulative_return", "long_short_returns"):
        plan = plan_of(queries.QUERIES[name](spark, SF))
        assert "Window [row_number" not in plan and "percentile" not in plan


def test_windows_over_the_bars_table_need_no_shuffle_of_their_own(spark):
    plan = plan_of(research.price_features(table(spark, SF, "bars"), research.ResearchConfig()))
    assert plan.count("Exchange hashpartitioning(symbol") == 1 and plan.count("Sort [symbol") == 1


def test_dated_rows_are_unpivoted_and_ranked_in_their_tasks(spark):
    """Rows are dealt by date once, before there is one for each factor, and their quantiles come from a window."""
    plan = plan_of(queries.QUERIES["long_short_turnover"](spark, SF))
    assert "Exchange hashpartitioning(factor#" in plan  # of the legs, by symbol
    assert not re.search(r"Exchange hashpartitioning\(factor#\d+, date#\d+, \d+\)", plan)
    assert "Window [percentile" in plan and "partial_percentile" not in plan and "Window [max(quantile" not in plan


def test_ends_of_buckets(spark):
    rows = [(d, f"{s:06d}", f, float(s % 4)) for d, n in enumerate((1, 2, 3, 5, 9, 30)) for f in ("a", "b") for s in range(n)]
    long = spark.createDataFrame(rows, "date int, symbol string, factor string, value double")
    for wide_dates in (False, True):
        cell = Window.partitionBy("factor", "date")
        found = backtest.assign_quantiles(long, 5, wide_dates, ends=True).withColumns({"hi": F.max("quantile").over(cell), "lo": F.min("quantile").over(cell)})
        assert found.filter("not (hi <=> _hi) or not (lo <=> _lo)").count() == 0 and found.filter("_hi = 5").count() > 0


def test_coefficients_take_one_window_a_side(spark):
    """A run of equal values has both its ends from the window that ranks it, and no aggregate has a group a symbol."""
    rows = [("2024-01-01", s, v, r) for s, v, r in (("a", 1.0, 2.0), ("a", 1.0, 1.0), ("b", 2.0, 3.0), ("c", None, 1.0), (None, 2.0, 2.0), ("d", 5.0, None))]
    data = spark.createDataFrame(rows, "date string, symbol string, x double, forward_return double")
    found = evaluation.ic_timeseries(data, ["x"])
    plan = plan_of(found)
    assert plan.count("Window [") == 3 and "keys=[date#" in plan and not re.search(r"keys=\[[^]]*symbol#", plan)
    row, other = found.first(), evaluation.ic_timeseries(data, ["x"], wide=True).first()
    assert row["n_symbols"] == other["n_symbols"] == 4 and row["rank_ic"] == other["rank_ic"]
    # ranks 1.5, 1.5, 3.5, 3.5 and 2.5, 1, 4, 2.5
    assert row["rank_ic"] == pytest.approx(3 / math.sqrt(4 * 4.5))


def test_binned_density_makes_no_pairs(spark):
    df = spark.createDataFrame([(s, float(i * i % 17) / 100) for s in ("a", "b") for i in range(40)] + [("c", 1.0)], "symbol string, return double")
    found = facts.return_kde(df, points=50, nodes=16)
    plan = plan_of(found)
    assert "Join" not in plan and "MapInArrow" in plan and plan.count("Exchange hashpartitioning") == 1
    got = found.collect()
    assert len(got) == 100 and {r["symbol"] for r in got} == {"a", "b"}
    for s in ("a", "b"):
        mass = [r["density"] for r in sorted((r for r in got if r["symbol"] == s), key=lambda r: r["point"])]
        x = [r["x"] for r in sorted((r for r in got if r["symbol"] == s), key=lambda r: r["point"])]
        assert sum(mass) * (x[1] - x[0]) == pytest.approx(1, abs=0.01)


# --- workflows


def test_a_batch_is_stored_once(spark, tmp_path, monkeypatch):
    """A batch is kept as one row a key, and the table's partitions are written once, straight from the join."""
    kept = []
    monkeypatch.setattr(refresh, "stored", lambda df, name="table": kept.append(tables.stored(df, name)) or kept[-1])
    monkeypatch.setattr(refresh, "discard", lambda *dfs: None)
    rows = [("1", "2024-01-02", "1", "1", "1", str(c), c, "x") for c in range(1, 6)]
    for _ in range(2):
        told = refresh.refresh_bars(vendor(spark, rows), f"{tmp_path}/bars", "k", None).years.collect()
    assert [df.count() for df in kept] == [1, 1] and [tuple(r) for r in told] == [(2024, 1, 1, 1)]
    assert refresh.read_bars(spark, f"{tmp_path}/bars").first()["close"] == 5.0


def vendor(spark, rows):
    return spark.createDataFrame(rows, "symbol string, `日期` string, open string, high string, low string, close string, k int, source string")


def test_batches_replace_their_keys_and_years(spark, tmp_path):
    path = f"{tmp_path}/bars"
    row = lambda s, d, c, k, source="tencent": (s, d, "1", "1", "1", c, k, source)
    first = vendor(spark, [row("1", "2022-05-02", "1", 1), row("1", "2023-05-02", "2", 1), row("1", "2023-05-03", "3", 1), row("2", "2023-05-02", "4", 1, "sina"), row("3", "2024-01-02", "5", 1)])
    told = {r["year"]: tuple(r)[1:] for r in refresh.refresh_bars(first, path, "k").years.collect()}
    assert told == {2022: (0, 1, 1), 2023: (0, 3, 3), 2024: (0, 1, 1)}
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "bars" / "year=2022").glob("*.parquet")}
    # a correction, a bad last quote, a new key, and the only bar of a year made invalid
    second = [row("1", "2023-05-02", "9", 1), row("1", "2023-05-02", "8", 2), row("2", "2023-05-02", "7", 1), row("2", "2023-05-02", "-1", 2), row("2", "2023-05-04", "6", 1), row("3", "2024-01-02", "0", 1)]
    for _ in range(2):
        told = {r["year"]: tuple(r)[1:] for r in refresh.refresh_bars(vendor(spark, second), path, "k").years.collect()}
    assert told == {2023: (3, 2, 3)}
    got = {(r["symbol"], str(r["date"])): r["close"] for r in refresh.read_bars(spark, path).collect()}
    assert got == {("000001", "2022-05-02"): 1.0, ("000001", "2023-05-02"): 8.0, ("000001", "2023-05-03"): 3.0, ("000002", "2023-05-04"): 6.0}
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "bars" / "year=2022").glob("*.parquet")} == kept
    assert not list((tmp_path / "bars").glob("year=2024"))
    part = refresh.read_bars(spark, path, "2023-05-03", "2023-12-31")
    assert part.count() == 2 and "PartitionFilters: [isnotnull(year" in plan_of(part)
    assert refresh.refresh_bars(vendor(spark, second).limit(0), path, "k").years.count() == 0 and refresh.read_bars(spark, path).count() == 4
    bad = [row("1", "2024-01-01", "-1", 1)]
    assert refresh.refresh_bars(vendor(spark, bad), f"{tmp_path}/none", "k").years.count() == 0
    assert tables.read_optional(spark, f"{tmp_path}/none") is None
    refresh.refresh_bars(vendor(spark, [row("1", "2024-01-01", "5", 1)]), f"{tmp_path}/one", "k")
    refresh.refresh_bars(vendor(spark, bad), f"{tmp_path}/one", "k")  # the table loses its only bar
    assert tables.read_optional(spark, f"{tmp_path}/one") is None
    refresh.refresh_bars(vendor(spark, [row("1", "2024-01-01", "7", 1)]), f"{tmp_path}/one", "k")
    assert refresh.read_bars(spark, f"{tmp_path}/one").first()["close"] == 7.0


def test_index_bars_and_risk_tables(spark, tmp_path):
    quotes = vendor(spark, [("300", "2024-01-01", "1", "1", "1", "2", 1, "x"), ("300", "2024-01-02", "1", "1", "1", "3", 1, "x"), ("5", "2024-01-01", "1", "1", "1", "2", 1, "x")])
    bars = refresh.index_bars(quotes, {"000300": "large"}, "k")
    assert sorted((r["symbol"], r["index_name"], r["close"]) for r in bars.collect()) == [("000300", "large", 2.0), ("000300", "large", 3.0)]
    refresh.write_risk_summaries(bars, bars, f"{tmp_path}/risk")
    assert spark.read.option("header", True).csv(f"{tmp_path}/risk/index_risk_summary").first()["n_days"] == "2"


def test_research_tables_are_saved(spark, tmp_path):
    bars = random_panel(spark, 1, 5, 120).withColumn("close", F.coalesce("close", "open"))
    valuation = bars.select("symbol", "date", (F.col("close") / 10).alias("pb"))
    config = research.ResearchConfig(min_history_days=50, filters={}, momentum_window=5, volatility_window=5, turnover_window=5, value_window=20, quantiles=2)
    found = research.factor_research(bars, valuation=valuation, config=config)
    found.save(f"{tmp_path}/out")
    assert found.value_source == "book_to_price" and {p.name for p in (tmp_path / "out").iterdir()} == set(research.RESULT_TABLES)
    assert spark.read.parquet(f"{tmp_path}/out/factor_dataset").count() == found.dataset.count() > 0
    costs = spark.read.option("header", True).csv(f"{tmp_path}/out/factor_cost_sensitivity")
    assert costs.count() == 16 and "mean_net_long_return" in costs.columns


def test_research_needs_a_cross_section(spark):
    bars = random_panel(spark, 1, 2, 60)
    with pytest.raises(ValueError, match="needs 9 symbols"):
        research.factor_research(bars, config=research.ResearchConfig(min_history_days=10, min_symbols_per_date=9, filters={}))
