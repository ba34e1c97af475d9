"""How far methods diverge: spreads, gaps, summaries, correlations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import exact_sum, half_even

COLUMNS = ["djma_m1", "djma_m2", "djma_m3", "djma_m4"]


def row_mean(columns: list[str]) -> Column:
    """Mean of the known values of a row."""
    some = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(some, F.lit(0.0), lambda s, v: s + v), F.size(some).cast("double"))


def spread(columns: list[str] = COLUMNS) -> Column:
    """(largest - smallest) / mean * 100 over a row's known values."""
    return F.try_divide((F.greatest(*columns) - F.least(*columns)).cast("double"), row_mean(columns)) * 100


def with_spread(arcs: DataFrame, columns: list[str] = COLUMNS) -> DataFrame:
    return arcs.withColumn("ecart_pct", half_even(spread(columns), 1))


def divergent(arcs: DataFrame, threshold: float = 30.0, key: str = "ID_ARC") -> DataFrame:
    """Arcs whose rounded spread exceeds the threshold, widest first."""
    return with_spread(arcs).where(F.col("ecart_pct") > threshold).orderBy(F.desc("ecart_pct"), key)


def gap(of: str, to: str = "djma_m4") -> Column:
    """Gap of ``to`` over ``of`` in percent."""
    return F.try_divide((F.col(to) - F.col(of)).cast("double"), F.col(of).cast("double")) * 100


def percentiles(long: DataFrame, by: str, value: str, probs: dict[str, float], parts: int = 256) -> DataFrame:
    """(by, a column for each of ``probs``): exact percentiles of each group's known values, interpolated between neighbours.

    Values are counted, parted at approximate quantiles, and ranked within the
    parts beside the parts' totals, so that no task sorts a whole group.  The
    joins with quantiles and totals are broadcast by Spark where their size allows it.
    """
    known = long.where(F.col(value).isNotNull())
    counts = known.groupBy(by, value).agg(F.count("*").alias("_n"))
    cuts = known.groupBy(by).agg(F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)]), 100 * parts).alias("_cuts"), F.count("*").alias("_all"))
    placed = counts.join(cuts, by).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    order = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy(by, "_part").agg(F.sum("_n").alias("_n")).select(by, "_part", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(bases, [by, "_part"]).withColumn("_end", F.col("_base") + F.sum("_n").over(inside))
    at = lambda rank: F.max(F.when((rank >= F.col("_end") - F.col("_n")) & (rank < F.col("_end")), F.col(value).cast("double")))
    found = []
    for name, p in probs.items():
        rank = F.lit(p) * (F.col("_all") - 1)
        found += [at(F.floor(rank)).alias(f"_lo_{name}"), at(F.ceil(rank)).alias(f"_hi_{name}"), F.first(rank - F.floor(rank)).alias(f"_w_{name}")]
    picked = ranked.groupBy(by).agg(*found)
    value_of = lambda n: F.col(f"_lo_{n}") * (1 - F.col(f"_w_{n}")) + F.col(f"_hi_{n}") * F.col(f"_w_{n}")
    return picked.select(by, *[F.when(F.col(f"_w_{n}") == 0, F.col(f"_lo_{n}")).otherwise(value_of(n)).alias(n) for n in probs])


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the exact median of each column's known values; null where none is known."""
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "_of", "_value")
    got = percentiles(long, "_of", "_value", {"median": 0.5})
    return got.agg(*[F.max(F.when(F.col("_of") == c, F.col("median"))).alias(c) for c in columns])


def box_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column quartiles, 1.5 IQR whisker ends and n."""
    long = df.unpivot([], columns, "method", "value").where("value is not null")
    q = percentiles(long, "method", "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}).join(long.groupBy("method").agg(F.count("*").alias("n")), "method")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    ends = long.join(F.broadcast(q), "method").where((F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)).groupBy("method").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return q.join(ends, "method")


def describe(df: DataFrame, columns: list[str] = COLUMNS) -> DataFrame:
    """Per column n, mean, median, min, max and sample standard deviation."""
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "method", "value")
    stats = long.groupBy("method").agg(
        F.count("value").alias("n"), F.try_divide(exact_sum(F.col("value")), F.count("value").cast("double")).alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.stddev_samp("value").alias("std"), F.count_if(F.col("value").isNull()).alias("n_null"),
    )
    return stats.join(percentiles(long, "method", "value", {"median": 0.5}), "method", "left")


def pearson(df: DataFrame, columns: list[str] = COLUMNS) -> DataFrame:
    """Long correlation matrix (a, b, r), each over the rows where both are known; all in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    value = lambda c: F.col(c).cast("double")
    one = df.agg(*[F.corr(value(a), value(b)).alias(f"{a}~{b}") for a, b in pairs])
    cells = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"{a}~{b}").alias("r")) for a, b in pairs for x, y in {(a, b), (b, a)}]
    return one.select(F.inline(F.array(*cells)))


def status_counts(df: DataFrame, column: str = "statut", without: str | None = "ok") -> DataFrame:
    rows = df.where(F.col(column) != without) if without else df
    return rows.groupBy(column).count()


def shares(df: DataFrame, name: Column, alias: str) -> DataFrame:
    """Count and percentage of each value; the total comes from the few counts."""
    counts = df.groupBy(name.alias(alias)).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(alias, "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))


def class_table(df: DataFrame, columns: list[str], classes: list[str], name: str, of: str) -> DataFrame:
    """(name, of, n, pct): how many rows of each column are of each class; classes without rows count 0."""
    counts = df.agg(F.count("*").alias("_all"), *[F.count_if(F.col(c) == k).alias(f"_{i}_{j}") for i, c in enumerate(columns) for j, k in enumerate(classes)])
    cells = [F.struct(F.lit(c).alias(name), F.lit(k).alias(of), F.col(f"_{i}_{j}").alias("n"), F.try_divide(F.lit(100.0) * F.col(f"_{i}_{j}"), F.col("_all").cast("double")).alias("pct")) for i, c in enumerate(columns) for j, k in enumerate(classes)]
    return counts.select(F.inline(F.array(*cells)))


def scores(df: DataFrame, truth: str, guess: str, by: str | None = None) -> DataFrame:
    """n, R2 and RMSE of guesses, overall or per ``by``, from sums that combine before the shuffle."""
    t, e = F.col(truth), F.col(truth) - F.col(guess)
    g = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    g = g.groupBy(by) if by else g.groupBy()
    return g.agg(F.count("*").alias("n"), (1 - F.try_divide(F.sum(e * e), F.count("*") * F.var_pop(t))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"))


def any_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def thousands(value: Column) -> Column:
    """A number as text without decimals, thousands parted by commas; NA if null."""
    return F.coalesce(F.format_number(value, 0), F.lit("NA"))


def report(arcs: DataFrame, columns: list[str] = COLUMNS, key: str = "ID_ARC") -> DataFrame:
    """The whole table of methods and spreads as text, by id."""
    spread_text = F.coalesce(F.format_string("%.1f %%", F.col("ecart_pct")), F.lit("NA"))
    shown = with_spread(arcs, columns).select(key, *[thousands(F.col(c)).alias(c) for c in columns], F.when(F.col("ecart_pct").isNotNull(), spread_text).otherwise("NA").alias("ecart_pct"))
    return shown.orderBy(key)


def coverage(arcs: DataFrame, value: str = "djma_m4") -> DataFrame:
    """One row: arcs, those with a value, their percentage, the least and the largest value."""
    known = F.count(value)
    return arcs.agg(F.count("*").alias("n"), known.alias("n_ok"), half_even(F.try_divide(100.0 * known, F.count("*").cast("double")), 1).alias("pct"), F.min(value).alias("least"), F.max(value).alias("most"))


def routing_summary(arcs: DataFrame) -> DataFrame:
    """One row on routed arcs (longueur_trace_km, longueur_qc_km, statut_djma_pct, n_segs_djma): medians, the share of the mean trace that lies outside, arcs wholly and under half covered."""
    mean = lambda c: F.try_divide(exact_sum(F.col(c).cast("double")), F.count(c).cast("double"))
    totals = arcs.agg(
        half_even((1 - F.try_divide(mean("longueur_qc_km"), mean("longueur_trace_km"))) * 100, 1).alias("excluded_pct"),
        F.count_if(F.col("statut_djma_pct") == 100).alias("n_full"), F.count_if(F.col("statut_djma_pct") < 50).alias("n_under_half"),
    )
    return medians(arcs, ["longueur_trace_km", "longueur_qc_km", "statut_djma_pct", "n_segs_djma"]).crossJoin(F.broadcast(totals))


def donor_summary(arcs: DataFrame) -> DataFrame:
    """One row: how many arcs borrowed, and the median and largest distance of their donors in km."""
    lent = arcs.where("djma_complete")
    counts = lent.agg(F.count("*").alias("n"), F.max("djma_distance_source_km").alias("most_km"))
    return counts.crossJoin(F.broadcast(medians(lent, ["djma_distance_source_km"]).withColumnRenamed("djma_distance_source_km", "median_km")))
