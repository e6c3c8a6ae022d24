"""Facts for reports, and the data of distribution charts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import correlation
from barloom.functions.distributions import with_inverse_normal


def factor_report_facts(data: DataFrame, ic_summary: DataFrame, costs: DataFrame, audit: DataFrame) -> DataFrame:
    """One row: sample range and size, the best factor by mean rank coefficient, the best factor
    and cost by compounded net return, and the skipped filters. Of equals the first name counts."""
    sample = data.agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count_distinct("date").alias("n_dates"), F.count_distinct("symbol").alias("n_symbols"))
    best = ic_summary.filter("mean_rank_ic is not null").agg(F.min_by(F.struct("factor", "mean_rank_ic", "effective_n_dates"), F.struct(-F.col("mean_rank_ic"), F.col("factor"))).alias("b"))
    cost = costs.filter("cumulative_net_return is not null").agg(
        F.min_by(F.struct("factor", "transaction_cost_bps", "cumulative_net_return"), F.struct(-F.col("cumulative_net_return"), F.col("factor"), F.col("transaction_cost_bps"))).alias("c")
    )
    skipped = audit.filter("status = 'skipped'").agg(F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(F.struct("step", "filter_name", "message"))), lambda x: F.concat(x["filter_name"], F.lit(": "), x["message"]))).alias("skipped_filters"))
    one = sample.crossJoin(best).crossJoin(cost).crossJoin(skipped)  # each side is a single row
    return one.select(
        *sample.columns, F.col("b.factor").alias("best_factor"), F.col("b.mean_rank_ic").alias("best_mean_rank_ic"), F.col("b.effective_n_dates").alias("best_effective_n_dates"),
        F.col("c.factor").alias("best_cost_factor"), F.col("c.transaction_cost_bps").alias("best_cost_bps"), F.col("c.cumulative_net_return").alias("best_cumulative_net_return"), "skipped_filters",
    )


def return_histogram(returns: DataFrame, bins: int = 80) -> DataFrame:
    """symbol, bin (from 0), count, density: equal bins from the least to the largest return, the
    last one closed. A constant series gets a range of one around it. Empty bins have no row."""
    seen = returns.filter("return is not null").select("symbol", "return")
    ends = seen.groupBy("symbol").agg(F.min("return").alias("lo"), F.max("return").alias("hi"), F.count("*").alias("n"))
    wide = ends.select("symbol", "n", F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col("return") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    binned = seen.join(wide, "symbol").select("symbol", at.alias("bin"), "n", width.alias("width"))
    return binned.groupBy("symbol", "bin", "n", "width").agg(F.count("*").alias("count")).select("symbol", "bin", "count", (F.col("count") / (F.col("n") * F.col("width"))).alias("density"))


def kde_error_bound(step: str, h: str) -> Column:
    """How far the density from linear binning can be off, with nodes ``step`` apart: a kernel
    interpolated between two nodes is off by step^2 / 8 times its largest second derivative."""
    return F.expr(f"{step} * {step} / (8 * {h} * {h} * {h} * sqrt(2 * pi()))")


def return_kde(returns: DataFrame, points: int = 200, nodes: int | None = None) -> DataFrame:
    """symbol, point (from 0), x, density: a Gaussian kernel estimate with Scott's bandwidth on a
    grid that ends three bandwidths beyond the data. Series without variance have none.

    Each return meets the grid's points, a fixed number, and adds to their sums before the shuffle,
    which moves one row for each point and symbol of a task.

    With ``nodes`` each return is first dealt to the two next of so many nodes between the least and
    the largest one, in parts by their distance (linear binning); the kernel then stands at the nodes
    with their weights.  Returns meet their symbol's range by a window, as they are made by one, and a
    symbol's sums come from one row with the weights of its nodes: no pair of node and point is a row.
    A column error_bound has the bound of the difference (see ``kde_error_bound``).
    """
    seen = returns.filter("return is not null").select("symbol", "return")
    if nodes:
        return _binned_kde(seen, points, nodes)
    shape = seen.groupBy("symbol").agg(F.min("return").alias("lo"), F.max("return").alias("hi"), F.count("*").alias("n"), F.stddev_samp("return").alias("sd")).filter("sd > 0")
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    grid = shape.select("symbol", "n", h.alias("h"), (F.col("lo") - 3 * h).alias("lo"), ((F.col("hi") - F.col("lo") + 6 * h) / (points - 1)).alias("step"))
    met = seen.join(grid, "symbol").select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")).withColumn("x", F.col("lo") + F.col("point") * F.col("step"))
    kernel = F.exp(F.expr("-0.5 * pow((x - return) / h, 2)"))
    summed = met.groupBy("symbol", "point", "n", "h", "x").agg(F.sum(kernel).alias("k"))
    return summed.select("symbol", "point", "x", F.expr("k / (n * h * sqrt(2 * pi()))").alias("density"))


#: What the density of a symbol needs, and the symbols that are worked on at a time.
SHAPE, SYMBOLS = ("n", "lo", "hi", "h", "step"), 64


def _binned_kde(seen: DataFrame, points: int, nodes: int) -> DataFrame:
    if nodes < 2:
        raise ValueError("linear binning needs two nodes")
    w = Window.partitionBy("symbol")
    shape = {"lo": F.min("return").over(w), "hi": F.max("return").over(w), "n": F.count("*").over(w), "sd": F.stddev_samp("return").over(w)}
    shaped = seen.withColumns(shape).filter("sd > 0")
    spaced = shaped.withColumns({"h": F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)), "step": (F.col("hi") - F.col("lo")) / (nodes - 1)})
    place = F.least((F.col("return") - F.col("lo")) / F.col("step"), F.lit(float(nodes - 1)))
    low = F.least(F.floor("_place"), F.lit(nodes - 2))
    part = F.col("_place") - low
    ends = F.array(F.struct(low.alias("node"), (1 - part).alias("weight")), F.struct((low + 1).alias("node"), part.alias("weight")))
    dealt = spaced.withColumn("_place", place).select("symbol", *SHAPE, F.inline(ends))
    weights = dealt.groupBy("symbol", *SHAPE, "node").agg(F.sum("weight").alias("weight")).filter("weight > 0")
    packed = weights.groupBy("symbol", *SHAPE).agg(F.collect_list(F.struct("node", "weight")).alias("at"))  # a pair for each node at most
    rows = packed.withColumn("error_bound", kde_error_bound("step", "h"))
    symbol = seen.schema["symbol"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _densities(batches, points), f"symbol {symbol}, point int, x double, density double, error_bound double")


def _densities(batches: Iterable[pa.RecordBatch], points: int) -> Iterator[pa.RecordBatch]:
    """The density of each symbol at its points, from the weights of its nodes."""
    point = np.arange(points, dtype=np.int32)
    for batch in batches:
        for first in range(0, batch.num_rows, SYMBOLS):
            some = batch.slice(first, SYMBOLS)
            n, lo, hi, h, step = (some.column(c).to_numpy()[:, None] for c in SHAPE)
            x = lo - 3 * h + point * (hi - lo + 6 * h) / (points - 1)
            at = some.column("at").flatten()
            cuts = np.cumsum(some.column("at").value_lengths().to_numpy())[:-1]
            node, weight = (np.split(at.field(c).to_numpy(), cuts) for c in ("node", "weight"))
            kernel = [np.exp(-0.5 * ((x[i][:, None] - (lo[i] + node[i] * step[i])) / h[i]) ** 2) * weight[i] for i in range(len(x))]
            density = np.array([k.sum(axis=1) for k in kernel]) / (n * h * np.sqrt(2 * np.pi))
            owner = np.repeat(np.arange(len(x)), points)
            columns = [some.column("symbol").take(pa.array(owner)), pa.array(np.tile(point, len(x))), pa.array(x.ravel()), pa.array(density.ravel()), some.column("error_bound").take(pa.array(owner))]
            yield pa.RecordBatch.from_arrays(columns, ["symbol", "point", "x", "density", "error_bound"])


def qq_points(returns: DataFrame) -> DataFrame:
    """symbol, rank, theoretical, ordered: returns in order beside normal quantiles at Filliben's
    plotting positions."""
    w = Window.partitionBy("symbol")
    ranked = returns.filter("return is not null").select("symbol", "return", F.row_number().over(w.orderBy("return")).alias("rank"), F.count("*").over(w).alias("n"))
    end = F.pow(F.lit(0.5), 1 / F.col("n"))
    place = F.when(F.col("rank") == F.col("n"), end).when(F.col("rank") == 1, 1 - end).otherwise((F.col("rank") - 0.3175) / (F.col("n") + 0.365))
    placed = with_inverse_normal(ranked.withColumn("_place", place), "_place", "theoretical")
    return placed.select("symbol", "rank", "theoretical", F.col("return").alias("ordered"))


def qq_fit(points: DataFrame) -> DataFrame:
    """symbol, slope, intercept, r of the line through the points."""
    return points.groupBy("symbol").agg(F.regr_slope("ordered", "theoretical").alias("slope"), F.regr_intercept("ordered", "theoretical").alias("intercept"), correlation("ordered", "theoretical").alias("r"))
