"""Registered queries of the bar operators, and the DuckDB SQL that they are held against.

Doubles are rounded to six places on both sides, as sums differ in their last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.columns import index_market_symbol, pad_symbol, to_market_symbol
from barloom.functions.distributions import AS241
from barloom.jobs import refresh, research
from barloom.jobs.fixtures import table, with_tables
from barloom.operators import backtest, evaluation, facts, factors, ingest, labels, matrix, returns, stats, universe
from barloom.operators.chunks import Chunks
from barloom.sources.tables import shared_folder, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PLACES = 6
#: Factors are rounded to so many places before they are ranked: means of equal numbers summed in
#: another order are then ties in both engines.
TIE_PLACES = 9
#: For the queries that cut long histories: chunks and blocks of which every symbol has several.
CHUNKS = Chunks(days=300, rows=96)

#: Tables that several oracles share.
SHARED = {
    "ret": "SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM {bars}",
    "standard": """SELECT symbol, date, ingest_order, source, TRY_CAST(open AS DOUBLE) AS open, TRY_CAST(high AS DOUBLE) AS high,
      TRY_CAST(low AS DOUBLE) AS low, TRY_CAST(close AS DOUBLE) AS close, TRY_CAST(volume AS DOUBLE) AS volume FROM {raw_quotes}""",
    "moments": "SELECT symbol, avg(r) AS mean, stddev_samp(r) AS sd, count(r) AS n FROM {ret} GROUP BY symbol",
    "outliers": "SELECT x.symbol, date, r, mean, sd, (r - mean) / sd AS z FROM {ret} x JOIN {moments} m ON x.symbol = m.symbol WHERE sd > 0 AND abs((r - mean) / sd) > 3",
    # two-sided p of Student's t by its finite series in cos(theta), theta = atan(|t| / sqrt(v))
    "coefficients": """SELECT k, exp(coalesce(sum(CASE WHEN k > 0 THEN ln((2 * k - 1) / (2.0 * k)) END) OVER (ORDER BY k), 0)) AS even,
      exp(coalesce(sum(CASE WHEN k > 0 THEN ln(2.0 * k / (2 * k + 1)) END) OVER (ORDER BY k), 0)) AS odd FROM range(0, 2000) t(k)""",
    "jb": """SELECT symbol, CASE WHEN n >= 2 AND m2 > 0 THEN n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) END AS stat
      FROM (SELECT x.symbol, count(r) AS n, avg(pow(r - mean, 2)) AS m2, avg(pow(r - mean, 3)) AS m3, avg(pow(r - mean, 4)) AS m4
            FROM {ret} x JOIN {moments} m ON x.symbol = m.symbol GROUP BY x.symbol)""",
    "t_mean": "SELECT symbol AS id, mean / (sd / sqrt(n)) AS t, n - 1 AS v FROM {moments}",
    "summary": """SELECT b.symbol, b.start_date, b.end_date, b.n_return_days, b.vol, coalesce(o.k, 0) AS outliers, m.mean, p.t, p.p, j.stat
      FROM (SELECT symbol, min(date) AS start_date, max(date) AS end_date, count(*) AS n_return_days, stddev_samp(r) * sqrt(252) AS vol FROM {ret} WHERE r IS NOT NULL GROUP BY symbol) b
      LEFT JOIN (SELECT symbol, count(*) AS k FROM {outliers} GROUP BY symbol) o ON b.symbol = o.symbol
      JOIN {moments} m ON b.symbol = m.symbol JOIN {p_mean} p ON b.symbol = p.id JOIN {jb} j ON b.symbol = j.symbol""",
}


def p_values(source: str) -> str:
    """SQL for id, t, v, p from a table with id, t, v."""
    return f"""SELECT id, any_value(t) AS t, any_value(v) AS v, CASE WHEN any_value(v) % 2 = 0
      THEN 1 - sin(any_value(th)) * sum(even * pow(cos(th), 2 * k)) FILTER (k <= v / 2.0 - 1)
      ELSE 1 - 2 / pi() * (any_value(th) + sin(any_value(th)) * cos(any_value(th)) * coalesce(sum(odd * pow(cos(th), 2 * k)) FILTER (k <= (v - 3) / 2.0), 0)) END AS p
      FROM (SELECT *, atan(abs(t) / sqrt(v)) AS th FROM {{{source}}} WHERE v >= 1) JOIN {{coefficients}} ON k <= v / 2 GROUP BY id"""


SHARED["p_mean"] = p_values("t_mean")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, PLACES).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def no_negative_zero(sql: str) -> str:
    """Adds 0 to everything that is rounded: DuckDB keeps the sign of a rounded zero, Spark doesn't."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 1, start + len("round(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += f"{sql[at:start]}(round({no_negative_zero(sql[start + 6 : end - 1])}) + 0)"
        at = end
    return out + sql[at:]


def register(name: str, sql: str | None, shared: dict[str, str] | None = None):
    """Register a function of a table loader as a query, with its oracle."""

    def wrap(fn: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(lambda t: table(spark, sf_dir, t)))
        if sql:
            ORACLES[name] = with_tables(no_negative_zero(sql), SHARED | (shared or {}))
        return fn

    return wrap


# --- sources, standardising, cleaning


@register("normalize_columns", "SELECT date, symbol, ingest_order, source, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM {standard}")
def _(t):
    vendor = t("raw_quotes").withColumnsRenamed({"open": "开盘", "close": "收盘价", "date": "日期"})
    return ingest.normalize_columns(vendor, keep=("ingest_order", "source"))


@register("pad_symbol", "SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS symbol, CASE WHEN length(CAST(s_suppkey * 1234567 AS VARCHAR)) < 6 THEN lpad(CAST(s_suppkey * 1234567 AS VARCHAR), 6, '0') ELSE CAST(s_suppkey * 1234567 AS VARCHAR) END AS long_symbol FROM {supplier}")
def _(t):
    return t("supplier").select("s_suppkey", pad_symbol(F.col("s_suppkey")).alias("symbol"), pad_symbol(F.col("s_suppkey") * 1234567).alias("long_symbol"))


_CODES = "SELECT p_partkey, CASE WHEN length(CAST((p_partkey * 7919) % 1000000 AS VARCHAR)) < 6 THEN lpad(CAST((p_partkey * 7919) % 1000000 AS VARCHAR), 6, '0') ELSE CAST((p_partkey * 7919) % 1000000 AS VARCHAR) END AS code FROM {part}"


@register("to_market_symbol", "SELECT p_partkey, CASE WHEN code[1] IN ('5', '6', '9') THEN 'sh' ELSE 'sz' END || code AS market_symbol FROM {codes}", {"codes": _CODES})
def _(t):
    return t("part").select("p_partkey", to_market_symbol((F.col("p_partkey") * 7919) % 1000000).alias("market_symbol"))


_INDEX = "CASE WHEN p_partkey % 4 = 0 THEN '000300' WHEN p_partkey % 4 = 1 THEN '905' ELSE code END"


@register(
    "index_market_symbol",
    f"SELECT p_partkey, CASE WHEN c IN ('000300', '000905', '000016') OR c[1] IN ('5', '6', '9') THEN 'sh' ELSE 'sz' END || c AS market_symbol FROM (SELECT p_partkey, lpad({_INDEX}, 6, '0') AS c FROM {{codes}})",
    {"codes": _CODES},
)
def _(t):
    code = F.when(F.col("p_partkey") % 4 == 0, "000300").when(F.col("p_partkey") % 4 == 1, "905").otherwise(((F.col("p_partkey") * 7919) % 1000000).cast("string"))
    return t("part").select("p_partkey", index_market_symbol(code).alias("market_symbol"))


SHARED["ranked_source"] = "SELECT *, CASE source WHEN 'tencent' THEN 0 WHEN 'sina' THEN 1 ELSE 2 END AS k FROM {standard}"
SHARED["one_source"] = "SELECT * EXCLUDE (k) FROM (SELECT *, min(k) OVER (PARTITION BY symbol) AS best FROM {ranked_source}) WHERE k = best"


@register("select_source_by_priority", "SELECT symbol, date, ingest_order, source, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM {one_source}")
def _(t):
    return ingest.select_source_by_priority(ingest.normalize_columns(t("raw_quotes"), keep=("ingest_order", "source")))


@register("filter_date_range", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate AS date FROM {lineitem} WHERE l_shipdate BETWEEN DATE '1995-03-01' AND DATE '1996-02-28'")
def _(t):
    return ingest.filter_date_range(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").alias("date")), "1995-03-01", "1996-02-28")


SHARED["clean"] = """SELECT symbol, date, source, open, high, low, close, volume FROM
  (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY ingest_order DESC) AS k FROM {standard}) WHERE k = 1 AND open > 0 AND high > 0 AND low > 0 AND close > 0"""


@register("clean_ohlcv", "SELECT symbol, date, source, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM {clean}")
def _(t):
    return ingest.clean_ohlcv(t("raw_quotes"), "ingest_order").drop("ingest_order")


_CLEAN = "SELECT symbol, date, source, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM {clean}"


@register("refresh_bars", _CLEAN)
def _(t):
    """The table of clean bars after a batch of first quotes, one of later ones, and that again."""
    quotes = stored(t("raw_quotes"), "quotes")
    path = f"{shared_folder(quotes.sparkSession)}/bars"
    for batch in (quotes.filter("ingest_order = 1"), quotes.filter("ingest_order > 1"), quotes.filter("ingest_order > 1")):
        refresh.refresh_bars(batch, path, "ingest_order", sources=None)
    return refresh.read_bars(quotes.sparkSession, path)


@register(
    "union_panels",
    "SELECT symbol, date, round(close, 6) AS close, round(volume, 6) AS volume, NULL AS pb FROM {bars} UNION ALL SELECT symbol, date, NULL, NULL, round(pb, 6) FROM {valuation}",
)
def _(t):
    return ingest.union_panels(t("bars").select("symbol", "date", "close", "volume"), t("valuation").select("pb", "date", "symbol"))


@register("tag_index_name", "SELECT b.symbol, date, round(close, 6) AS close, industry AS index_name FROM {bars} b JOIN {security_master} m ON b.symbol = m.symbol")
def _(t):
    names = t("security_master").select("symbol", F.col("industry").alias("index_name"))
    return ingest.tag_index_name(t("bars").select("symbol", "date", "close"), names)


# --- universe


def _keys(df: DataFrame) -> DataFrame:
    return df.select("symbol", "date", "close")


_KEYS = "SELECT b.symbol, b.date, round(b.close, 6) AS close FROM {bars} b"
_MASTER = _KEYS + " LEFT JOIN {security_master} m ON b.symbol = m.symbol"
_STATUS = _KEYS + " LEFT JOIN {trade_status} s ON b.symbol = s.symbol AND b.date = s.date"
INDUSTRIES = ("NATION_1", "NATION_4", "NATION_7", "NATION_12", "NATION_18", "NATION_23")
_LIST = ", ".join(f"'{i}'" for i in INDUSTRIES)


@register("normalize_price_frame", "SELECT symbol, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM {standard}")
def _(t):
    return universe.normalize_price_frame(t("raw_quotes")).drop("ingest_order", "source")


@register("normalize_security_master", "SELECT symbol, list_date, is_st, industry, round(float_market_cap, 6) AS float_market_cap FROM {security_master}")
def _(t):
    m = t("security_master")
    twice = m.withColumn("k", F.lit(2)).unionByName(m.withColumns({"k": F.lit(1), "industry": F.lit("old")}))
    return universe.normalize_security_master(twice, "k")


@register("normalize_trade_status", "SELECT symbol, date, is_suspended, is_limit_up, is_limit_down FROM {trade_status}")
def _(t):
    s = t("trade_status")
    unknown = s.withColumns({"is_suspended": F.when(F.col("is_suspended"), True), "k": F.lit(2)})
    return universe.normalize_trade_status(unknown.unionByName(s.withColumns({"is_suspended": F.lit(True), "k": F.lit(1)})), "k").select("symbol", "date", "is_suspended", "is_limit_up", "is_limit_down")


@register("filter_whitelist", _KEYS + " WHERE b.symbol IN ('000001', '000004', '000007')")
def _(t):
    return _keys(universe.filter_whitelist(t("bars"), ["1", "4", "000007"]))


@register("filter_min_history", "SELECT symbol, date, round(close, 6) AS close FROM {bars} QUALIFY count(date) OVER (PARTITION BY symbol) >= 290")
def _(t):
    return _keys(universe.filter_min_history(t("bars"), 290))


@register("filter_suspended", _STATUS + " WHERE NOT coalesce(s.is_suspended, false)")
def _(t):
    return _keys(universe.filter_suspended(t("bars"), universe.normalize_trade_status(t("trade_status"))))


@register("filter_suspended_inferred", _KEYS + " WHERE coalesce(b.volume, 0) > 0")
def _(t):
    return _keys(universe.filter_suspended_inferred(t("bars")))


@register("filter_limit", _STATUS + " WHERE NOT coalesce(s.is_limit_up, false) AND NOT coalesce(s.is_limit_down, false)")
def _(t):
    return _keys(universe.filter_limit(t("bars"), universe.normalize_trade_status(t("trade_status"))))


@register("filter_limit_inferred", "SELECT symbol, date, round(close, 6) AS close FROM {bars_pct} WHERE pct_change IS NULL OR (pct_change < 9.8 AND pct_change > -9.8)")
def _(t):
    return _keys(universe.filter_limit_inferred(t("bars_pct")))


@register("filter_limit_inferred_from_close", "SELECT symbol, date, round(close, 6) AS close FROM {ret} WHERE r IS NULL OR (r < 0.098 AND r > -0.098)")
def _(t):
    return _keys(universe.filter_limit_inferred(t("bars")))


@register("filter_st", _MASTER + " WHERE NOT coalesce(m.is_st, false)")
def _(t):
    return _keys(universe.filter_st(t("bars"), t("security_master")))


@register("filter_new_stock", _MASTER + " WHERE b.date - m.list_date >= 60")
def _(t):
    return _keys(universe.filter_new_stock(t("bars"), t("security_master"), 60))


@register("filter_industry_include", _MASTER + f" WHERE m.industry IN ({_LIST})")
def _(t):
    return _keys(universe.filter_industry_include(t("bars"), t("security_master"), INDUSTRIES))


@register("filter_industry_exclude", _MASTER + f" WHERE coalesce(m.industry NOT IN ({_LIST}), true)")
def _(t):
    return _keys(universe.filter_industry_exclude(t("bars"), t("security_master"), INDUSTRIES))


@register("filter_float_cap_min", _MASTER + " WHERE m.float_market_cap >= 1000")
def _(t):
    return _keys(universe.filter_float_cap(t("bars"), t("security_master"), least=1000))


@register("filter_float_cap_max", _MASTER + " WHERE m.float_market_cap <= 5000")
def _(t):
    return _keys(universe.filter_float_cap(t("bars"), t("security_master"), most=5000))


@register("filter_min_symbols_per_date", "SELECT symbol, date, round(close, 6) AS close FROM {bars} QUALIFY count(symbol) OVER (PARTITION BY date) >= 75")
def _(t):
    return _keys(universe.filter_min_symbols_per_date(t("bars"), 75))


@register("filter_universe", "SELECT symbol, date, round(close, 6) AS close FROM {bars} WHERE symbol IN ('000001', '000002', '000003', '000004', '000005', '000006') QUALIFY count(date) OVER (PARTITION BY symbol) >= 285")
def _(t):
    return _keys(universe.filter_universe(t("bars"), ["1", "2", "3", "4", "5", "6"], 285))


FILTERS = {"exclude_new_stock_days": 60, "industry_exclude": ["NATION_3", "NATION_9"], "min_float_market_cap": 500, "max_float_market_cap": 9500}
_STEPS = (
    ("min_history_days", "QUALIFY count(date) OVER (PARTITION BY symbol) >= 80", "applied", "min_history_days=80"),
    ("exclude_suspended", "WHERE NOT coalesce(is_suspended, false)", "applied", ""),
    ("exclude_limit_up_down", "WHERE NOT coalesce(is_limit_up, false) AND NOT coalesce(is_limit_down, false)", "applied", ""),
    ("exclude_st", "WHERE NOT coalesce(is_st, false)", "applied", ""),
    ("exclude_new_stock_days", "WHERE date - list_date >= 60", "applied", ""),
    ("industry_exclude", "WHERE coalesce(industry NOT IN ('NATION_3', 'NATION_9'), true)", "applied", ""),
    ("min_float_market_cap", "WHERE float_market_cap >= 500", "applied", ""),
    ("max_float_market_cap", "WHERE float_market_cap <= 9500", "applied", ""),
    ("min_symbols_per_date", "QUALIFY count(symbol) OVER (PARTITION BY date) >= 3", "applied", "min_symbols_per_date=3"),
)
_BARE_STEPS = (
    ("min_history_days", "QUALIFY count(date) OVER (PARTITION BY symbol) >= 80", "applied", "min_history_days=80"),
    ("exclude_suspended", "WHERE coalesce(volume, 0) > 0", "applied", universe.INFERRED_SUSPENSION),
    ("exclude_limit_up_down", "QUALIFY coalesce(abs(close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1) < 0.098, true)", "applied", universe.INFERRED_LIMIT),
    *((name, "", "skipped", universe.NO_MASTER) for name in universe.MASTER_FILTERS),
    ("min_symbols_per_date", "QUALIFY count(symbol) OVER (PARTITION BY date) >= 3", "applied", "min_symbols_per_date=3"),
)


def _chain(prefix: str, base: str, steps) -> dict[str, str]:
    out = {f"{prefix}0": base}
    for i, (_, condition, _, _) in enumerate(steps):
        out[f"{prefix}{i + 1}"] = f"SELECT * FROM {{{prefix}{i}}} {condition}"
    return out


def _audit(prefix: str, steps) -> str:
    count = lambda i: f"(SELECT count(*) FROM {{{prefix}{i}}})"
    names = lambda i: f"(SELECT count(DISTINCT symbol) FROM {{{prefix}{i}}})"
    return " UNION ALL ".join(
        f"SELECT {i + 1} AS step, '{name}' AS filter_name, {count(i)} AS input_rows, {count(i + 1)} AS output_rows, {count(i)} - {count(i + 1)} AS removed_rows, "
        f"{names(i)} AS input_symbols, {names(i + 1)} AS output_symbols, {names(i)} - {names(i + 1)} AS removed_symbols, '{status}' AS status, '{message}' AS message"
        for i, (name, _, status, message) in enumerate(steps)
    )


_CHAIN = _chain(
    "u",
    """SELECT b.*, s.is_suspended, s.is_limit_up, s.is_limit_down, m.list_date, m.is_st, m.industry, m.float_market_cap FROM {bars} b
       LEFT JOIN {trade_status} s ON b.symbol = s.symbol AND b.date = s.date LEFT JOIN {security_master} m ON b.symbol = m.symbol""",
    _STEPS,
)
_BARE = _chain("v", "SELECT * FROM {bars}", _BARE_STEPS)


def _metadata(t) -> tuple[DataFrame, DataFrame]:
    """Security master and trade status with two rows for each key, of which the later counts."""
    master = t("security_master").withColumn("k", F.lit(2))
    old = t("security_master").withColumns({"k": F.lit(1), "is_st": ~F.col("is_st"), "industry": F.lit("NATION_3"), "list_date": F.lit(None).cast("date")})
    status = t("trade_status").withColumn("k", F.lit(2))
    open_ = t("trade_status").withColumns({"k": F.lit(1), **{c: ~F.col(c) for c in ("is_suspended", "is_limit_up", "is_limit_down")}})
    return old.unionByName(master), open_.unionByName(status)


def _universe(t):
    master, status = _metadata(t)
    return universe.apply_universe_filters(t("bars"), filters=FILTERS, security_master=master, trade_status=status, master_order="k", status_order="k")


@register("apply_universe_filters", f"SELECT symbol, date, round(close, 6) AS close FROM {{u{len(_STEPS)}}}", _CHAIN)
def _(t):
    return _keys(_universe(t)[0])


@register("universe_filter_audit", _audit("u", _STEPS), _CHAIN)
def _(t):
    return _universe(t)[1]


@register("apply_universe_filters_bare", f"SELECT symbol, date, round(close, 6) AS close FROM {{v{len(_BARE_STEPS)}}}", _BARE)
def _(t):
    return _keys(universe.apply_universe_filters(t("bars"))[0])


@register("universe_filter_audit_bare", _audit("v", _BARE_STEPS), _BARE)
def _(t):
    return universe.apply_universe_filters(t("bars"))[1]


# --- returns and risk


def _gappy(t) -> DataFrame:
    """Bars in which every seventh close is unknown."""
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("date"))
    return t("bars").withColumn("close", F.when(place % 7 != 3, F.col("close")))


_GAPPY = {
    "gappy": "SELECT symbol, date, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY date) % 7 <> 3 THEN close END AS close FROM {bars}",
    "filled": "SELECT symbol, date, close, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS p FROM {gappy}",
}


@register("simple_return", 'SELECT symbol, date, round(p / lag(p) OVER (PARTITION BY symbol ORDER BY date) - 1, 6) AS "return" FROM {filled}', _GAPPY)
def _(t):
    return returns.simple_return(_gappy(t)).select("symbol", "date", "return")


@register("log_return", "SELECT symbol, date, round(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)), 6) AS log_return FROM {gappy}", _GAPPY)
def _(t):
    return returns.log_return(_gappy(t)).select("symbol", "date", "log_return")


_DRAW = {"drawn": "SELECT symbol, close / max(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS d FROM {bars}"}


@register("annual_return", "SELECT symbol, round(pow(product(1 + r), 252.0 / count(r)) - 1, 6) AS annual_return FROM {ret} GROUP BY symbol")
def _(t):
    return returns.annual_return(returns.simple_return(t("bars")))


@register("annual_volatility", "SELECT symbol, round(stddev_samp(r) * sqrt(252), 6) AS annual_volatility FROM {ret} GROUP BY symbol")
def _(t):
    return returns.annual_volatility(returns.simple_return(t("bars")))


@register("sharpe", "SELECT symbol, round((avg(r) - 0.02 / 252) / stddev_samp(r) * sqrt(252), 6) AS sharpe FROM {ret} GROUP BY symbol")
def _(t):
    return returns.sharpe(returns.simple_return(t("bars")), risk_free=0.02)


@register("max_drawdown", "SELECT symbol, round(min(d), 6) AS max_drawdown FROM {drawn} GROUP BY symbol", _DRAW)
def _(t):
    return returns.max_drawdown(t("bars"))


@register("max_drawdown_chunked", "SELECT symbol, round(min(d), 6) AS max_drawdown FROM {drawn} GROUP BY symbol", _DRAW)
def _(t):
    return returns.max_drawdown(t("bars"), chunk_days=CHUNKS.days)


_RISK = """SELECT r.symbol, r.start_date, r.end_date, r.n_days, r.annual_return, r.annual_volatility, r.sharpe, d.max_drawdown FROM
       (SELECT symbol, min(date) AS start_date, max(date) AS end_date, count(*) AS n_days, round(pow(product(1 + r), 252.0 / count(r)) - 1, 6) AS annual_return,
               round(stddev_samp(r) * sqrt(252), 6) AS annual_volatility, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe FROM {ret} GROUP BY symbol) r
       JOIN (SELECT symbol, round(min(d), 6) AS max_drawdown FROM {drawn} GROUP BY symbol) d ON r.symbol = d.symbol"""


@register("risk_summary", _RISK, _DRAW)
def _(t):
    return returns.risk_summary(t("bars"))


@register("risk_summary_chunked", _RISK, _DRAW)
def _(t):
    return returns.risk_summary(t("bars"), chunk_days=CHUNKS.days)


SHARED["clean_one"] = """SELECT symbol, date, close FROM
  (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY ingest_order DESC) AS k FROM {one_source}) WHERE k = 1 AND open > 0 AND high > 0 AND low > 0 AND close > 0"""


@register(
    "risk_profile_from_quotes",
    """SELECT symbol, min(date) AS start_date, max(date) AS end_date, count(*) AS n_days, round(pow(product(1 + r), 252.0 / count(r)) - 1, 6) AS annual_return,
       round(stddev_samp(r) * sqrt(252), 6) AS annual_volatility, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe, round(min(d), 6) AS max_drawdown
       FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r,
                    close / max(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS d FROM {clean_one}) GROUP BY symbol""",
)
def _(t):
    return research.risk_profile(t("raw_quotes"), "ingest_order")


# --- matrices

_PAIRS = {"pairs": "SELECT a.symbol AS symbol_i, b.symbol AS symbol_j, a.r AS x, b.r AS y FROM {ret} a JOIN {ret} b ON a.date = b.date WHERE a.r IS NOT NULL AND b.r IS NOT NULL"}


@register("return_matrix", 'SELECT date, symbol, round(r, 6) AS "return" FROM {ret}')
def _(t):
    return matrix.return_matrix(t("bars"))


@register(
    "wide_return_matrix",
    """SELECT d.date, s.symbol, round(x.r, 6) AS "return" FROM (SELECT DISTINCT date FROM {ret}) d CROSS JOIN (SELECT DISTINCT symbol FROM {ret}) s
       LEFT JOIN {ret} x ON x.date = d.date AND x.symbol = s.symbol""",
)
def _(t):
    """Every cell of the matrix, the empty ones included, as the names of a wide table's columns depend on the data."""
    return matrix.long_return_blocks(*matrix.wide_return_blocks(stored(matrix.return_matrix(t("bars")), "returns")))


@register("cov_matrix", "SELECT symbol_i, symbol_j, round(covar_samp(x, y), 6) AS cov FROM {pairs} GROUP BY symbol_i, symbol_j", _PAIRS)
def _(t):
    return matrix.cov_matrix(matrix.return_matrix(t("bars")))


@register("corr_matrix", "SELECT symbol_i, symbol_j, round(covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)), 6) AS corr FROM {pairs} GROUP BY symbol_i, symbol_j", _PAIRS)
def _(t):
    return matrix.corr_matrix(matrix.return_matrix(t("bars")))


@register("gram_matrices", "SELECT symbol_i, symbol_j, count(*) AS n, round(covar_samp(x, y), 6) AS cov, round(covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)), 6) AS corr FROM {pairs} GROUP BY symbol_i, symbol_j", _PAIRS)
def _(t):
    return matrix.gram_matrices(matrix.return_matrix(t("bars")))


# --- distribution tests


@register("three_sigma_outliers", 'SELECT symbol, date, round(r, 6) AS "return", round(mean, 6) AS mean, round(sd, 6) AS std, round(z, 6) AS z_score FROM {outliers}')
def _(t):
    return stats.three_sigma_outliers(returns.simple_return(t("bars")))


@register("t_test_mean_return", "SELECT m.symbol, round(mean, 6) AS mean_daily_return, round(t, 6) AS t_stat, round(p, 6) AS t_p_value, coalesce(p < 0.05, false) AS is_mean_significant FROM {moments} m JOIN {p_mean} p ON m.symbol = p.id")
def _(t):
    return stats.t_test_mean_return(returns.simple_return(t("bars")))


@register("jarque_bera", "SELECT symbol, round(stat, 6) AS jb_stat, round(exp(-stat / 2), 6) AS jb_p_value, coalesce(exp(-stat / 2) > 0.05, false) AS is_normal FROM {jb}")
def _(t):
    return stats.jarque_bera(returns.simple_return(t("bars")))


@register("normality_test", "SELECT symbol, round(stat, 6) AS jb_stat, round(exp(-stat / 2), 6) AS p_value, coalesce(exp(-stat / 2) > 0.05, false) AS is_normal FROM {jb}")
def _(t):
    return stats.normality_test(matrix.return_matrix(t("bars")))


@register(
    "distribution_test_summary",
    """SELECT symbol, start_date, end_date, n_return_days, round(vol, 6) AS annual_volatility, outliers AS three_sigma_outlier_count, round(outliers / n_return_days, 6) AS three_sigma_outlier_ratio,
       round(mean, 6) AS mean_daily_return, round(t, 6) AS t_stat, round(p, 6) AS t_p_value, coalesce(p < 0.05, false) AS is_mean_significant,
       round(stat, 6) AS jb_stat, round(exp(-stat / 2), 6) AS jb_p_value, coalesce(exp(-stat / 2) > 0.05, false) AS is_normal FROM {summary}""",
)
def _(t):
    return research.distribution_tests(t("bars"))[0]


@register(
    "distribution_conclusion",
    """SELECT count(*) FILTER (NOT coalesce(exp(-stat / 2) > 0.05, false)) AS non_normal_count, count(*) FILTER (p < 0.05) AS significant_count, count(*) AS n_symbols,
       (SELECT symbol FROM {summary} ORDER BY vol DESC, symbol LIMIT 1) AS highest_volatility_symbol,
       (SELECT symbol FROM {summary} ORDER BY outliers DESC, symbol LIMIT 1) AS most_outliers_symbol FROM {summary}""",
)
def _(t):
    return research.distribution_tests(t("bars"))[1]


# --- factors and labels


def dataset_tables(base: str, suffix: str = "") -> dict[str, str]:
    """SQL of the factor dataset over the bars in ``base``."""
    n = lambda name: "{" + name + suffix + "}"
    factor_names = ("momentum_20d", "low_volatility_20d", "turnover_20d", "value_factor")
    clip = lambda c: f"least(greatest({c}, quantile_cont({c}, 0.01) OVER d), quantile_cont({c}, 0.99) OVER d) AS {c}"
    z = lambda c: f"({c} - avg({c}) OVER d) / nullif(stddev_samp({c}) OVER d, 0) AS {c}"
    pick = lambda c: f"SELECT date, symbol, forward_return, '{c}' AS factor, {c} AS value FROM {n('dataset')}"
    tables = {
        "rets": f"SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM {{{base}}}",
        "factors": f"""SELECT date, symbol, close / lag(close, 20) OVER w - 1 AS momentum_20d, CASE WHEN count(r) OVER w20 >= 10 THEN -stddev_samp(r) OVER w20 END AS low_volatility_20d,
          CASE WHEN count(turnover) OVER w20 >= 10 THEN avg(turnover) OVER w20 END AS turnover_20d, CASE WHEN count(close) OVER w120 >= 40 THEN avg(close) OVER w120 END / close - 1 AS value_proxy_120d,
          r AS daily_return FROM {n('rets')} WINDOW w AS (PARTITION BY symbol ORDER BY date), w20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), w120 AS (PARTITION BY symbol ORDER BY date ROWS 119 PRECEDING)""",
        "labels": f"SELECT date, symbol, lead(open, 1) OVER w AS entry_price, lead(open, 6) OVER w AS exit_price FROM {{{base}}} WINDOW w AS (PARTITION BY symbol ORDER BY date)",
        "valued": f"SELECT f.*, CASE WHEN v.pb > 0 THEN 1 / v.pb END AS value_factor FROM {n('factors')} f ASOF LEFT JOIN {{valuation}} v ON f.symbol = v.symbol AND f.date >= v.date",
        "complete": f"""SELECT f.date, f.symbol, {', '.join(factor_names)}, exit_price / entry_price - 1 AS forward_return FROM {n('valued')} f JOIN {n('labels')} l ON f.symbol = l.symbol AND f.date = l.date
          WHERE momentum_20d IS NOT NULL AND low_volatility_20d IS NOT NULL AND turnover_20d IS NOT NULL AND value_factor IS NOT NULL AND exit_price IS NOT NULL QUALIFY count(*) OVER (PARTITION BY f.date) >= 3""",
        "clipped": f"SELECT date, symbol, forward_return, {', '.join(map(clip, factor_names))} FROM {n('complete')} WINDOW d AS (PARTITION BY date)",
        "scored": f"SELECT date, symbol, forward_return, {', '.join(map(z, factor_names))} FROM {n('clipped')} WINDOW d AS (PARTITION BY date)",
        "dataset": f"SELECT date, symbol, forward_return, {', '.join(f'round({c}, {TIE_PLACES}) AS {c}' for c in factor_names)} FROM {n('scored')} WHERE momentum_20d IS NOT NULL AND low_volatility_20d IS NOT NULL AND turnover_20d IS NOT NULL AND value_factor IS NOT NULL",
        "long": " UNION ALL ".join(map(pick, factor_names)),
        "ranks": f"""SELECT *, rank() OVER (PARTITION BY factor, date ORDER BY value) + (count(*) OVER (PARTITION BY factor, date, value) - 1) / 2.0 AS rx,
          rank() OVER (PARTITION BY factor, date ORDER BY forward_return) + (count(*) OVER (PARTITION BY factor, date, forward_return) - 1) / 2.0 AS ry FROM {n('long')}""",
        "ic": f"""SELECT date, factor, CASE WHEN ok THEN ic END AS ic, CASE WHEN ok THEN rank_ic END AS rank_ic, n_symbols FROM
          (SELECT date, factor, corr(value, forward_return) AS ic, (count(*) * sum(rx * ry) - sum(rx) * sum(ry)) / nullif(sqrt((count(*) * sum(rx * rx) - sum(rx) * sum(rx)) * (count(*) * sum(ry * ry) - sum(ry) * sum(ry))), 0) AS rank_ic, count(*) AS n_symbols, count(*) >= 3 AND count(DISTINCT value) >= 2 AND count(DISTINCT forward_return) >= 2 AS ok FROM {n('ranks')} GROUP BY date, factor)""",
        "sampled": f"SELECT * FROM {n('ic')} QUALIFY (row_number() OVER (PARTITION BY factor ORDER BY date) - 1) % 5 = 0",
        "buckets": f"""SELECT date, symbol, forward_return, factor, value, CASE WHEN n >= 2 THEN greatest(1, ((r - 1) * least(5, n) + n - 2) // (n - 1)) END AS quantile FROM
          (SELECT *, row_number() OVER (PARTITION BY factor, date ORDER BY value, symbol) AS r, count(*) OVER (PARTITION BY factor, date) AS n FROM {n('long')})""",
        "layers": f"SELECT date, factor, CAST(quantile AS INT) AS quantile, avg(forward_return) AS mean_forward_return FROM {n('buckets')} WHERE quantile IS NOT NULL GROUP BY date, factor, quantile",
        "ends": f"SELECT factor, max(quantile) AS hi, min(quantile) AS lo FROM {n('layers')} GROUP BY factor",
        "spread": f"""SELECT l.date, l.factor, max(mean_forward_return) FILTER (quantile = hi) AS long_return, max(mean_forward_return) FILTER (quantile = lo) AS short_return
          FROM {n('layers')} l JOIN {n('ends')} e ON l.factor = e.factor GROUP BY l.date, l.factor""",
        "books": f"""SELECT factor, date, symbol, leg, 1.0 / count(*) OVER (PARTITION BY factor, date, leg) AS w, dense_rank() OVER (PARTITION BY factor ORDER BY date) AS i FROM
          (SELECT factor, date, symbol, unnest(CASE WHEN quantile = max(quantile) OVER c AND quantile = min(quantile) OVER c THEN ['long', 'short'] WHEN quantile = max(quantile) OVER c THEN ['long']
             WHEN quantile = min(quantile) OVER c THEN ['short'] ELSE [] END) AS leg FROM {n('buckets')} WHERE quantile IS NOT NULL WINDOW c AS (PARTITION BY factor, date))""",
        "moves": f"SELECT factor, leg, i, symbol, w FROM {n('books')} UNION ALL SELECT factor, leg, i + 1, symbol, -w FROM {n('books')}",
        "turned": f"SELECT factor, leg, i, sum(abs(c)) / 2 AS t FROM (SELECT factor, leg, i, symbol, sum(w) AS c FROM {n('moves')} GROUP BY factor, leg, i, symbol) GROUP BY factor, leg, i",
        "turnover": f"""SELECT d.date, d.factor, max(t) FILTER (leg = 'long') AS long_turnover, max(t) FILTER (leg = 'short') AS short_turnover
          FROM {n('turned')} t JOIN (SELECT DISTINCT factor, date, i FROM {n('books')}) d ON t.factor = d.factor AND t.i = d.i GROUP BY d.date, d.factor""",
        "costs": f"""SELECT factor, CAST(bps AS INT) AS bps, avg(net_long) AS mean_net_long, product(1 + net_long) - 1 AS cumulative_long, avg(net) AS mean_net, product(1 + net) - 1 AS cumulative, stddev_samp(net) AS sd, avg(lt) AS lt, avg(st) AS st, avg(lt + st) AS gt FROM
          (SELECT s.factor, bps, coalesce(long_turnover, 0) AS lt, coalesce(short_turnover, 0) AS st, long_return - coalesce(long_turnover, 0) * bps / 10000.0 AS net_long, long_return - short_return - (coalesce(long_turnover, 0) + coalesce(short_turnover, 0)) * bps / 10000.0 AS net
           FROM {n('spread')} s LEFT JOIN {n('turnover')} t ON s.date = t.date AND s.factor = t.factor CROSS JOIN (VALUES (0), (5), (10), (20)) b(bps)) GROUP BY factor, bps""",
    }
    return {name + suffix: sql for name, sql in tables.items()}


SHARED |= dataset_tables("bars")
FACTORS = ["momentum_20d", "low_volatility_20d", "turnover_20d", "value_factor"]


def _factors(t):
    return factors.build_price_factors(t("bars"))


for _name, _column in (("factor_momentum", "momentum_20d"), ("factor_low_volatility", "low_volatility_20d"), ("factor_turnover", "turnover_20d"), ("factor_value_proxy", "value_proxy_120d"), ("daily_return", "daily_return")):
    register(_name, f"SELECT date, symbol, round({_column}, 6) AS {_column} FROM {{factors}}")(lambda t, c=_column: _factors(t).select("date", "symbol", c))


_PRICE_FACTORS = "SELECT date, symbol, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("momentum_20d", "low_volatility_20d", "turnover_20d", "value_proxy_120d", "daily_return")) + " FROM {factors}"


@register("build_price_factors", _PRICE_FACTORS)
def _(t):
    return _factors(t)


@register("build_price_factors_chunked", _PRICE_FACTORS)
def _(t):
    return factors.build_price_factors(t("bars"), chunks=CHUNKS)


@register("value_factor_source", "SELECT symbol, date, round(CASE WHEN pb > 0 THEN 1 / pb END, 6) AS by_pb, round(CASE WHEN pe > 0 THEN 1 / pe END, 6) AS by_pe, 'book_to_price' AS source_pb, 'earnings_yield' AS source_pe FROM {valuation}")
def _(t):
    v = t("valuation")
    (pb, source_pb), (pe, source_pe) = factors.value_factor(v), factors.value_factor(v.drop("pb"))
    return v.select("symbol", "date", pb.alias("by_pb"), pe.alias("by_pe"), F.lit(source_pb).alias("source_pb"), F.lit(source_pe).alias("source_pe"))


_VALUED = "SELECT date, symbol, round(momentum_20d, 6) AS momentum_20d, round(value_factor, 6) AS value_factor, 'book_to_price' AS value_factor_source FROM {valued}"


@register("merge_valuation_factor", _VALUED)
def _(t):
    return factors.merge_valuation_factor(_factors(t).select("date", "symbol", "momentum_20d"), t("valuation"))


@register("merge_valuation_factor_chunked", _VALUED)
def _(t):
    """With two rows for each valuation, of which the later counts."""
    v = t("valuation")
    both = v.withColumn("k", F.lit("new")).unionByName(v.withColumns({"k": F.lit("additional"), "pb": F.lit(99.0)}))
    return factors.merge_valuation_factor(_factors(t).select("date", "symbol", "momentum_20d"), both, "k", chunk_days=CHUNKS.days)


@register("available_factor_columns", " UNION ALL ".join(f"SELECT '{c}' AS factor, count(*) AS n_rows FROM {{with_no_value}} HAVING count({c}) > 0" for c in ("momentum_20d", "low_volatility_20d", "turnover_20d", "value_factor")), {"with_no_value": "SELECT *, CAST(NULL AS DOUBLE) AS value_factor FROM {factors}"})
def _(t):
    frame = _factors(t).withColumn("value_factor", F.lit(None).cast("double"))
    chosen = factors.available_factor_columns(frame, factors.factor_columns_from_config(research.ResearchConfig().windows))
    return frame.agg(F.count("*").alias("n_rows")).select(F.explode(F.array(*map(F.lit, chosen))).alias("factor"), "n_rows")


def _label_sql(entry: str, exit_: str, timing: str) -> str:
    return f"SELECT date, symbol, round(a, 6) AS entry_price, round(b, 6) AS exit_price, round(b / a - 1, 6) AS forward_return, '{timing}' AS label_timing FROM (SELECT date, symbol, {entry} AS a, {exit_} AS b FROM {{bars}} WINDOW w AS (PARTITION BY symbol ORDER BY date))"


for _timing, _entry, _exit in zip(labels.TIMINGS, ("lead(open, 1) OVER w", "lead(open, 1) OVER w", "close"), ("lead(open, 6) OVER w", "lead(close, 5) OVER w", "lead(close, 5) OVER w")):
    register(f"forward_return_{_timing}", _label_sql(_entry, _exit, _timing))(lambda t, x=_timing: labels.add_forward_return(t("bars"), 5, x))
    register(f"forward_return_{_timing}_chunked", _label_sql(_entry, _exit, _timing))(lambda t, x=_timing: labels.add_forward_return(t("bars"), 5, x, CHUNKS))


_WINSORIZED = (
    "SELECT date, symbol, round(least(greatest(r, quantile_cont(r, 0.05) OVER d), quantile_cont(r, 0.95) OVER d), 6) AS r FROM {ret} WHERE r IS NOT NULL WINDOW d AS (PARTITION BY date)"
)
_ZSCORED = "SELECT date, symbol, round((r - avg(r) OVER d) / nullif(stddev_samp(r) OVER d, 0), 6) AS r FROM {ret} WINDOW d AS (PARTITION BY date)"


def _r(t) -> DataFrame:
    return returns.simple_return(t("bars"), "r").select("date", "symbol", "r")


@register("winsorize_by_date", _WINSORIZED)
def _(t):
    return labels.winsorize_by_date(_r(t).filter("r is not null"), ["r"], 0.05)


@register("winsorize_by_date_wide", _WINSORIZED)
def _(t):
    return labels.winsorize_by_date(stored(_r(t).filter("r is not null"), "r"), ["r"], 0.05, wide=True)


@register("zscore_by_date", _ZSCORED)
def _(t):
    return labels.zscore_by_date(_r(t), ["r"])


@register("zscore_by_date_wide", _ZSCORED)
def _(t):
    return labels.zscore_by_date(stored(_r(t), "r"), ["r"], wide=True)


def _dataset(t, digits=TIE_PLACES):
    """Factors and labels share one pass over the bars, whose columns have their types and names already."""
    frame = factors.merge_valuation_factor(research.price_features(t("bars"), research.ResearchConfig()), t("valuation")).drop("value_factor_source")
    return labels.finish_dataset(frame, FACTORS, digits=digits)


@register("prepare_factor_dataset", "SELECT date, symbol, round(forward_return, 6) AS forward_return, " + ", ".join(f"round({c}, 6) AS {c}" for c in FACTORS) + " FROM {scored} WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in FACTORS))
def _(t):
    return _dataset(t, None).select("date", "symbol", "forward_return", *FACTORS)


# --- evaluation


@register("ic_timeseries", "SELECT date, factor, round(ic, 6) AS ic, round(rank_ic, 6) AS rank_ic, n_symbols FROM {ic}")
def _(t):
    return evaluation.ic_timeseries(_dataset(t), FACTORS)


@register("ic_pearson", "SELECT date, factor, round(ic, 6) AS ic, n_symbols FROM {ic}")
def _(t):
    return evaluation.ic_pearson(_dataset(t), FACTORS)


@register("ic_spearman", "SELECT date, factor, round(rank_ic, 6) AS rank_ic, n_symbols FROM {ic}")
def _(t):
    return evaluation.ic_spearman(_dataset(t), FACTORS)


@register("ic_spearman_wide", "SELECT date, factor, round(rank_ic, 6) AS rank_ic, n_symbols FROM {ic}")
def _(t):
    return evaluation.ic_spearman(_dataset(t), FACTORS, wide=True)


@register("ic_non_overlapping_sample", "SELECT date, factor, round(ic, 6) AS ic, round(rank_ic, 6) AS rank_ic, n_symbols FROM {sampled}")
def _(t):
    return evaluation.ic_non_overlapping_sample(evaluation.ic_timeseries(_dataset(t), FACTORS), 5)


def _summary_tables(source: str, suffix: str, ic: str = "ic") -> dict[str, str]:
    means = ", ".join(f"count({c}) AS n_{c}, avg({c}) AS mean_{c}, stddev_samp({c}) AS std_{c}, avg(CAST({c} > 0 AS DOUBLE)) FILTER ({c} IS NOT NULL) AS pos_{c}" for c in ("ic", "rank_ic"))
    return {
        f"sums{suffix}": f"SELECT factor, count(*) AS k, {means} FROM {{{source}}} GROUP BY factor",
        f"ts{suffix}": " UNION ALL ".join(f"SELECT factor || '/{c}' AS id, mean_{c} / (std_{c} / sqrt(n_{c})) AS t, n_{c} - 1 AS v FROM {{sums{suffix}}}" for c in ("ic", "rank_ic")),
        f"ps{suffix}": p_values(f"ts{suffix}"),
        f"icsum{suffix}": f"""SELECT s.factor, d.n AS n_dates, s.k AS effective_n_dates, mean_ic, std_ic, pos_ic, mean_rank_ic, std_rank_ic, pos_rank_ic, a.t AS ta, a.p AS pa, b.t AS tb, b.p AS pb
          FROM {{sums{suffix}}} s JOIN (SELECT factor, count(*) AS n FROM {{{ic}}} GROUP BY factor) d ON s.factor = d.factor JOIN {{ps{suffix}}} a ON a.id = s.factor || '/ic' JOIN {{ps{suffix}}} b ON b.id = s.factor || '/rank_ic'""",
    }


def _summary_sql(suffix: str, mode: str) -> str:
    part = lambda c, t, p, prefix: (
        f"round(mean_{c}, 6) AS mean_{c}, round(std_{c}, 6) AS std_{c}, round(mean_{c} / std_{c} * sqrt(252), 6) AS {c}_ir, round(pos_{c}, 6) AS {c}_positive_ratio, round({t}, 6) AS {c}_t_stat, "
        f"round({p}, 6) AS {c}_p_value, round({t}, 6) AS {prefix}overlap_adjusted_t_stat, round({p}, 6) AS {prefix}overlap_adjusted_p_value"
    )
    return f"SELECT factor, n_dates, '{mode}' AS sample_mode, effective_n_dates, {part('ic', 'ta', 'pa', '')}, {part('rank_ic', 'tb', 'pb', 'rank_ic_')} FROM {{icsum{suffix}}}"


@register("ic_summary", _summary_sql("", "non_overlapping"), _summary_tables("sampled", ""))
def _(t):
    return evaluation.ic_summary(evaluation.ic_timeseries(_dataset(t), FACTORS), 5)


@register("ic_summary_daily", _summary_sql("_daily", "daily"), _summary_tables("ic", "_daily"))
def _(t):
    return evaluation.ic_summary_daily(evaluation.ic_timeseries(_dataset(t), FACTORS))


# --- back-test


@register("assign_quantiles", "SELECT date, symbol, factor, CAST(quantile AS INT) AS quantile FROM {buckets}")
def _(t):
    return backtest.assign_quantiles(factors.unpivot_factors(_dataset(t), FACTORS)).select("date", "symbol", "factor", "quantile")


@register("assign_quantiles_wide", "SELECT date, symbol, factor, CAST(quantile AS INT) AS quantile FROM {buckets}")
def _(t):
    return backtest.assign_quantiles(factors.unpivot_factors(_dataset(t), FACTORS), wide=True).select("date", "symbol", "factor", "quantile")


def _layers(t):
    """Stored, as what follows reads these few rows several times."""
    return stored(backtest.layer_returns(_dataset(t), FACTORS), "layers")


@register("layer_returns", "SELECT date, factor, quantile, round(mean_forward_return, 6) AS mean_forward_return FROM {layers}")
def _(t):
    return _layers(t)


@register("long_short_returns", "SELECT date, factor, round(long_return, 6) AS long_return, round(short_return, 6) AS short_return, round(long_return - short_return, 6) AS long_short_return FROM {spread}")
def _(t):
    return backtest.long_short_returns(_layers(t))


@register("long_only_returns", "SELECT date, factor, round(long_return, 6) AS long_return FROM {spread}")
def _(t):
    return backtest.long_only_returns(backtest.long_short_returns(_layers(t)))


@register("long_short_turnover", "SELECT date, factor, round(long_turnover, 6) AS long_turnover, round(short_turnover, 6) AS short_turnover, round(long_turnover + short_turnover, 6) AS gross_turnover FROM {turnover}")
def _(t):
    return backtest.long_short_turnover(_dataset(t), FACTORS)


@register("top_quantile_turnover", "SELECT date, factor, round(long_turnover, 6) AS top_quantile_turnover FROM {turnover}")
def _(t):
    return backtest.top_quantile_turnover(_dataset(t), FACTORS)


_COSTS = """SELECT factor, bps AS transaction_cost_bps, round(mean_net_long, 6) AS mean_net_long_return, round(mean_net, 6) AS mean_net_return, round(cumulative_long, 6) AS cumulative_net_long_return,
  round(cumulative, 6) AS cumulative_net_return, round(sd, 6) AS net_return_std, round(lt, 6) AS average_long_turnover, round(st, 6) AS average_short_turnover, round(gt, 6) AS average_turnover FROM """


@register("cost_sensitivity", _COSTS + "{costs}")
def _(t):
    bucketed = stored(backtest.assign_quantiles(factors.unpivot_factors(_dataset(t), FACTORS, ["forward_return"]), ends=True).drop("value"), "buckets")  # read several times
    return backtest.cost_sensitivity(backtest.long_short_returns(backtest.layer_means(bucketed)), backtest.leg_turnover(bucketed))


@register(
    "layered_cumulative_return",
    """SELECT g.date, g.factor, g.quantile, round(product(1 + coalesce(mean_forward_return, 0)) OVER (PARTITION BY g.factor, g.quantile ORDER BY g.date ROWS UNBOUNDED PRECEDING) - 1, 6) AS cumulative_return
       FROM (SELECT * FROM (SELECT DISTINCT factor, date FROM {layers}) JOIN (SELECT DISTINCT factor, quantile FROM {layers}) USING (factor)) g
       LEFT JOIN {layers} l ON g.factor = l.factor AND g.date = l.date AND g.quantile = l.quantile""",
)
def _(t):
    return backtest.layered_cumulative_return(_layers(t))


# --- the whole factor workflow

_FLOW = _CHAIN | dataset_tables(f"u{len(_STEPS)}", "_w") | _summary_tables("sampled_w", "_w", "ic_w")


def _research(t, **more):
    """The workflow over metadata and valuations with two rows for each key, of which the later counts."""
    master, status = _metadata(t)
    v = t("valuation")
    valuation = v.withColumn("k", F.lit(2)).unionByName(v.withColumns({"k": F.lit(1), "pb": F.lit(99.0)}))
    return research.factor_research(t("bars"), master, status, valuation, research.ResearchConfig(filters=FILTERS, digits=TIE_PLACES, **more), "k", "k", "k")


@register("factor_research_costs", _COSTS + "{costs_w}", _FLOW)
def _(t):
    return _research(t).costs


@register("factor_research_costs_chunked_wide", _COSTS + "{costs_w}", _FLOW)
def _(t):
    """The same with histories cut by time and without a date's rows in one task."""
    return _research(t, chunks=CHUNKS, wide=True).costs


@register("factor_research_ic_summary", _summary_sql("_w", "non_overlapping"), _FLOW)
def _(t):
    return _research(t).ic_summary


@register(
    "factor_report_facts",
    """SELECT s.start_date, s.end_date, s.n_dates, s.n_symbols, b.factor AS best_factor, round(b.mean_rank_ic, 6) AS best_mean_rank_ic, b.effective_n_dates AS best_effective_n_dates,
       c.factor AS best_cost_factor, c.bps AS best_cost_bps, round(c.cumulative, 6) AS best_cumulative_net_return, '' AS skipped_filters
       FROM (SELECT min(date) AS start_date, max(date) AS end_date, count(DISTINCT date) AS n_dates, count(DISTINCT symbol) AS n_symbols FROM {dataset_w}) s,
            (SELECT * FROM {icsum_w} ORDER BY mean_rank_ic DESC, factor LIMIT 1) b, (SELECT * FROM {costs_w} ORDER BY cumulative DESC, factor, bps LIMIT 1) c""",
    _FLOW,
)
def _(t):
    r = _research(t)
    return facts.factor_report_facts(r.dataset, r.ic_summary, r.costs, r.audit)


# --- chart data

_BINS = {
    "hist": """SELECT symbol, least(CAST(floor((r - lo) / ((hi - lo) / 80)) AS INT), 79) AS bin, n, (hi - lo) / 80 AS width FROM
      (SELECT symbol, r, min(r) OVER s AS lo, max(r) OVER s AS hi, count(r) OVER s AS n FROM {ret} WHERE r IS NOT NULL WINDOW s AS (PARTITION BY symbol))"""
}


@register("return_histogram", "SELECT symbol, bin, count(*) AS count, round(count(*) / (n * width), 6) AS density FROM {hist} GROUP BY symbol, bin, n, width", _BINS)
def _(t):
    return facts.return_histogram(returns.simple_return(t("bars")))


_KDE = {
    "shape": "SELECT symbol, min(r) AS lo, max(r) AS hi, count(r) AS n, stddev_samp(r) * pow(count(r), -0.2) AS h FROM {ret} GROUP BY symbol",
    "grid": "SELECT symbol, n, h, p, lo - 3 * h + p * (hi - lo + 6 * h) / 199 AS x FROM {shape} CROSS JOIN range(0, 200) t(p)",
}


@register(
    "return_kde",
    "SELECT g.symbol, CAST(p AS INT) AS point, round(x, 6) AS x, round(sum(exp(-0.5 * pow((x - r) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density FROM {grid} g JOIN {ret} v ON g.symbol = v.symbol WHERE r IS NOT NULL GROUP BY g.symbol, p, x",
    _KDE,
)
def _(t):
    return facts.return_kde(returns.simple_return(t("bars")))


NODES = 512
_BINNED = _KDE | {
    "spaced": f"SELECT *, (hi - lo) / {NODES - 1} AS step FROM {{shape}}",
    "dealt": f"""SELECT v.symbol, least((r - lo) / step, {NODES - 1}) AS place, least(floor(least((r - lo) / step, {NODES - 1})), {NODES - 2}) AS node
      FROM {{ret}} v JOIN {{spaced}} s ON v.symbol = s.symbol WHERE r IS NOT NULL""",
    "weights": "SELECT symbol, node, sum(w) AS w FROM (SELECT symbol, node, 1 - (place - node) AS w FROM {dealt} UNION ALL SELECT symbol, node + 1, place - node FROM {dealt}) GROUP BY symbol, node",
}


@register(
    "return_kde_binned",
    """SELECT g.symbol, CAST(p AS INT) AS point, round(x, 6) AS x, round(sum(w * exp(-0.5 * pow((x - (lo + node * step)) / s.h, 2))) / (any_value(s.n) * any_value(s.h) * sqrt(2 * pi())), 6) AS density,
       round(any_value(step * step / (8 * s.h * s.h * s.h * sqrt(2 * pi()))), 6) AS error_bound
       FROM {grid} g JOIN {spaced} s ON g.symbol = s.symbol JOIN {weights} b ON g.symbol = b.symbol GROUP BY g.symbol, p, x""",
    _BINNED,
)
def _(t):
    return facts.return_kde(returns.simple_return(t("bars")), nodes=NODES)


def _horner(coefficients, x: str) -> str:
    sql = repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        sql = f"({sql} * {x} + {c!r})"
    return sql


def _ratio(k: int, x: str) -> str:
    return f"{_horner(AS241[k][0], x)} / {_horner(AS241[k][1], x)}"


_QQ = {
    "placed": """SELECT symbol, rank, r AS ordered, CASE WHEN rank = n THEN pow(0.5, 1.0 / n) WHEN rank = 1 THEN 1 - pow(0.5, 1.0 / n) ELSE (rank - 0.3175) / (n + 0.365) END AS p FROM
      (SELECT symbol, CAST(r AS DOUBLE) AS r, row_number() OVER (PARTITION BY symbol ORDER BY r) AS rank, count(*) OVER (PARTITION BY symbol) AS n FROM {ret} WHERE r IS NOT NULL)""",
    "tails": "SELECT *, CAST(p AS DOUBLE) - 0.5 AS q, 0.180625 - (CAST(p AS DOUBLE) - 0.5) * (CAST(p AS DOUBLE) - 0.5) AS c, sqrt(-ln(least(p, 1 - p))) AS t FROM {placed}",
    "quantiles": f"SELECT symbol, rank, ordered, CASE WHEN abs(q) <= 0.425 THEN q * {_ratio(0, 'c')} WHEN t <= 5 THEN sign(q) * {_ratio(1, '(t - 1.6)')} ELSE sign(q) * {_ratio(2, '(t - 5)')} END AS theoretical FROM {{tails}}",
}


@register("qq_points", "SELECT symbol, CAST(rank AS INT) AS rank, round(theoretical, 6) AS theoretical, round(ordered, 6) AS ordered FROM {quantiles}", _QQ)
def _(t):
    return facts.qq_points(returns.simple_return(t("bars")))


@register("qq_fit", "SELECT symbol, round(regr_slope(ordered, theoretical), 6) AS slope, round(regr_intercept(ordered, theoretical), 6) AS intercept, round(corr(ordered, theoretical), 6) AS r FROM {quantiles} GROUP BY symbol", _QQ)
def _(t):
    return facts.qq_fit(facts.qq_points(returns.simple_return(t("bars"))))
