"""Input tables of the jobs, derived from the driver's tables by SQL that Spark and DuckDB share.

symbol = supplier, trading day = week of the ship date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Name -> SQL; names in braces are other tables, of this list or of the input.
TABLES = {
    "ticks": """
SELECT lpad(CAST(l_suppkey AS STRING), 6, '0') AS symbol,
       CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
       l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag, l_discount,
       p_retailprice * (1 - l_discount) * (1 + l_tax) AS price
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "bars": """
SELECT symbol, date,
       max(CASE WHEN rn_a = 1 THEN price END) AS open,
       max(price) AS high, min(price) AS low,
       max(CASE WHEN rn_d = 1 THEN price END) AS close,
       sum(CASE WHEN l_returnflag = 'R' THEN CAST(0 AS DOUBLE) ELSE l_quantity END) AS volume,
       sum(price * l_quantity) AS amount,
       sum(l_quantity) / 100 AS turnover
FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, price, l_quantity) AS rn_a,
             row_number() OVER (PARTITION BY symbol, date ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, price DESC, l_quantity DESC) AS rn_d
      FROM {ticks}) t
GROUP BY symbol, date""",
    "valuation": """
SELECT symbol, date, 50 * (avg(l_discount) - 0.02) AS pb, 100 * avg(l_discount) AS pe
FROM (SELECT symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_discount FROM {ticks}) t
GROUP BY symbol, date""",
    "security_master": """
SELECT lpad(CAST(s_suppkey AS STRING), 6, '0') AS symbol,
       CAST(CAST('1994-12-01' AS DATE) + CAST((s_suppkey * 37) % 400 AS INT) AS DATE) AS list_date,
       s_acctbal < 0 AS is_st, n_name AS industry, s_acctbal AS float_market_cap
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "trade_status": """
SELECT symbol, date, min(l_returnflag) = 'R' AS is_suspended,
       max(l_discount) >= 0.1 AND min(l_discount) >= 0.07 AS is_limit_up,
       max(l_discount) <= 0.01 AS is_limit_down
FROM {ticks} GROUP BY symbol, date""",
    "raw_quotes": """
SELECT symbol, date,
       row_number() OVER (PARTITION BY symbol, date ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, price, l_quantity) AS ingest_order,
       CASE WHEN CAST(symbol AS INT) % 5 = 0 THEN 'sina'
            WHEN CAST(symbol AS INT) % 7 = 0 THEN 'netease_163_unadjusted'
            WHEN l_linenumber % 2 = 0 THEN 'sina' ELSE 'tencent' END AS source,
       CASE WHEN l_partkey % 17 = 0 THEN 'n/a' ELSE CAST(price AS STRING) END AS open,
       CAST(price * 1.01 AS STRING) AS high, CAST(price * 0.99 AS STRING) AS low,
       CASE WHEN l_partkey % 23 = 0 THEN '-1' WHEN l_partkey % 29 = 0 THEN NULL ELSE CAST(price AS STRING) END AS close,
       CAST(l_quantity AS STRING) AS volume
FROM {ticks}""",
    "bars_pct": """
SELECT *, 100 * (close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1) AS pct_change FROM {bars}""",
}

INPUTS = ("lineitem", "part", "supplier", "nation")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``bars`` from one sort: the first and last price of a bar are aggregates by the order of its ticks.

    Ticks are dealt by symbol, so that windows over a symbol's bars need no shuffle and no sort of their own.
    """
    place = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "price", "l_quantity")
    ticks = table(spark, sf_dir, "ticks").drop("l_discount")
    dealt = ticks.repartition("symbol")  # a bar has so few ticks that sums by task would save nothing
    return dealt.groupBy("symbol", "date").agg(
        F.min(place)["price"].alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(place)["price"].alias("close"),
        F.expr("sum(CASE WHEN l_returnflag = 'R' THEN CAST(0 AS DOUBLE) ELSE l_quantity END)").alias("volume"),
        F.expr("sum(price * l_quantity)").alias("amount"), F.expr("sum(l_quantity) / 100").alias("turnover"),
    )


def valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``valuation``, with each mean summed up in the order of the input's rows.

    A mean discount of 0.02 makes a multiple of 0, or of almost 0 on either side by the order of the
    sum, and so a factor that is null or huge.  Partial sums of tasks would leave that to the cut of
    the file; in the order of the rows it is what one pass over them gives.
    """
    place = ("_file", "_row")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_suppkey", "l_partkey", "l_shipdate", "l_discount", "_metadata.file_name AS _file", "_metadata.row_index AS _row")
    ticks = lines.join(table(spark, sf_dir, "part").selectExpr("p_partkey AS l_partkey"), "l_partkey")
    rows = ticks.selectExpr("lpad(CAST(l_suppkey AS STRING), 6, '0') AS symbol", "CAST(date_trunc('month', l_shipdate) AS DATE) AS date", "l_discount", *place)
    w = Window.partitionBy("symbol", "date").orderBy(*place)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    mean = F.try_divide(F.sum("l_discount").over(so_far), F.count("l_discount").over(so_far))
    last = rows.select("symbol", "date", mean.alias("_mean"), F.lead("_row").over(w).isNull().alias("_last")).filter("_last")
    return last.selectExpr("symbol", "date", "50 * (_mean - 0.02) AS pb", "100 * _mean AS pe")


#: Tables whose Spark form is another than their SQL.
BUILT = {"bars": bars, "valuation": valuation}


def needs(sql: str) -> list[str]:
    return [n for n in (*INPUTS, *TABLES) if "{" + n + "}" in sql]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table or one derived from them."""
    if name in INPUTS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in BUILT:
        return BUILT[name](spark, sf_dir)
    return spark.sql(TABLES[name], **{n: table(spark, sf_dir, n) for n in needs(TABLES[name])})


def with_tables(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` for DuckDB, with each table in braces, of this list or ``extra``, put in front."""
    known, order = TABLES | (extra or {}), []

    def visit(text: str) -> None:
        for name in known:
            if "{" + name + "}" in text and name not in order:
                visit(known[name])
                order.append(name)

    visit(sql)
    plain = lambda text: text.replace("{", "").replace("}", "")
    head = ", ".join(f"{n} AS ({plain(known[n])})" for n in order)
    return f"WITH {head} {plain(sql)}" if order else plain(sql)
