"""Imputation: inverse-distance weighting of neighbours, and chained random forests."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec, geometry as geo
from ..functions.rounding import half_even
from . import compare, series
from .scratch import cut
from .nearest import nearest_points

K = 5


def weighted_neighbours(targets: DataFrame, sources: DataFrame, k: int = K) -> DataFrame:
    """(target, source, distance, weight): ``k`` of each target's 4k nearest sources, those of its own kind first.

    Both are (id, x, y, kind).  Kinds compare null-safe.  Weights are inverse
    squared distances, a distance of 0 counting as 1, and sum to one.
    """
    near = nearest_points(targets, sources, 4 * k)
    kinds = lambda t, key: t.select(F.col("id").alias(key), F.col("kind").alias(f"{key}_kind"))
    near = near.join(kinds(targets, "target"), "target").join(kinds(sources, "source"), "source")
    own = F.col("target_kind").eqNullSafe(F.col("source_kind"))
    order = Window.partitionBy("target").orderBy(own.desc(), "rank")
    chosen = near.withColumn("choice", F.row_number().over(order)).where(F.col("choice") <= k)
    d = F.when(F.col("distance") == 0, 1.0).otherwise(F.col("distance"))
    chosen = chosen.withColumns({"distance": d, "raw": 1 / (d * d)})
    total = F.sum("raw").over(Window.partitionBy("target"))
    return chosen.select("target", "source", "distance", (F.col("raw") / total).alias("weight"), "choice")


def idw(targets: DataFrame, sources: DataFrame, digits: dict[str, int], k: int = K) -> DataFrame:
    """(target, columns): each column of ``digits`` as the weighted sum of neighbours, rounded so; null if any neighbour's is."""
    w = weighted_neighbours(targets, sources, k)
    values = sources.select(F.col("id").alias("source"), *digits)
    sums = [F.when(F.count(c) == F.count("*"), half_even(F.sum(F.col("weight") * F.col(c)), d)).alias(c) for c, d in digits.items()]
    return w.join(values, "source").groupBy("target").agg(*sums)


def complete_by_neighbours(df: DataFrame, digits: dict[str, int], missing: str = "methode_djma = 'geo_knn'", k: int = K) -> DataFrame:
    """Rows that lack counts take all of ``digits``' columns, known or not, from their neighbours among the others; both labels become geo_knn.

    ``df``: id, x, y, kind, methode_djma, methode_cam and the columns.
    """
    lacking, rest = df.where(missing), df.where(f"not ({missing})")
    found = idw(lacking, rest, digits, k).withColumnRenamed("target", "id")
    filled = lacking.drop(*digits).join(found, "id", "left").withColumns({"methode_djma": F.lit("geo_knn"), "methode_cam": F.lit("geo_knn")})
    return rest.unionByName(filled.select(*df.columns))


def features(df: DataFrame, families: dict[str, list[str]], single: str, kind: str, kinds: list[str], line: str) -> DataFrame:
    """``df`` with the forests' predictors: known flows filled, the road class one-hot, the centroid.

    A missing value of a family becomes the mean of the row's known ones, else
    the median of all known values of the family; that of ``single`` its
    median.  ``kinds`` ends with the class that stands for all others.
    Columns route_K, x_centroide and y_centroide are added.
    """
    long = None
    for name, columns in (families | {single: [single]}).items():
        values = df.select(F.lit(name).alias("_of"), F.explode(F.array(*[F.col(c).cast("double") for c in columns])).alias("_value"))
        long = values if long is None else long.unionByName(values)
    middle = compare.percentiles(long, "_of", "_value", {"median": 0.5})
    middle = middle.agg(*[F.max(F.when(F.col("_of") == n, F.col("median"))).alias(f"_median_{n}") for n in [*families, single]])
    rows = df.crossJoin(F.broadcast(middle))
    filled = {c: series.row_fallback(F.col(c), F.array(*[F.col(x) for x in columns]), F.col(f"_median_{n}")) for n, columns in families.items() for c in columns}
    filled |= {single: F.coalesce(single, f"_median_{single}")} | {k: v for k, v in codec.one_hot(F.col(kind), kinds).items()}
    rows = rows.withColumn("_c", geo.centroid(F.col(line))).withColumns(filled | {"x_centroide": F.col("_c.x"), "y_centroide": F.col("_c.y")})
    return rows.drop("_c", *[f"_median_{n}" for n in [*families, single]])


def _forest(features: list[str], target: str, trees: int, seed: int) -> tuple[VectorAssembler, RandomForestRegressor]:
    return VectorAssembler(inputCols=features, outputCol="_f"), RandomForestRegressor(featuresCol="_f", labelCol=target, predictionCol="_p", numTrees=trees, seed=seed, maxDepth=10)


def chained_forests(df: DataFrame, features: list[str], targets: list[str], trees: int = 50, seed: int = 42, rounds: int = 10, least: int = 50, tolerance: float = 1e-3) -> DataFrame:
    """Rows with missing ``targets`` imputed by random forests, target after target, round after round.

    Rows whose targets are all known train, and start the others at their
    means.  Each forest sees the features and the other targets.  Stops when a
    round changes values by less than ``tolerance`` of their mean, or after
    ``rounds``.  Imputed values are not below 0 and have one decimal.  With
    under ``least`` training rows nothing is changed.  Each round is
    checkpointed; forests are fitted and applied by Spark.
    """
    lacking = F.greatest(*[F.col(c).isNull().cast("int") for c in targets]) == 1
    train = cut(df.where(~lacking))
    if train.count() < least or df.where(lacking).isEmpty():
        return df
    means = train.agg(*[F.avg(c).alias(c) for c in targets]).first()
    holes = cut(df.where(lacking).withColumns({c: F.coalesce(c, F.lit(means[c])) for c in targets} | {f"_known_{c}": F.col(c).isNotNull() for c in targets}))
    scale = sum(abs(means[c]) for c in targets) or 1.0
    for _ in range(rounds):
        before = holes
        for c in targets:
            assembler, forest = _forest(features + [t for t in targets if t != c], c, trees, seed)
            model = forest.fit(assembler.transform(train))
            holes = model.transform(assembler.transform(holes)).withColumn(c, F.when(F.col(f"_known_{c}"), F.col(c)).otherwise(F.greatest(F.col("_p"), F.lit(0.0)))).drop("_f", "_p")
        holes = cut(holes)
        change = holes.agg(*[F.avg(c).alias(c) for c in targets]).first(), before.agg(*[F.avg(c).alias(c) for c in targets]).first()
        if sum(abs(change[0][c] - change[1][c]) for c in targets) < tolerance * scale:
            break
    filled = holes.withColumns({c: F.when(F.col(f"_known_{c}"), F.col(c)).otherwise(half_even(F.col(c), 1)) for c in targets})
    return train.unionByName(filled.select(*df.columns))


def cross_validated(df: DataFrame, id_: str, features: list[str], targets: list[str], folds: int = 5, trees: int = 50, seed: int = 42, carry: list[str] | None = None, parallelism: int = 8) -> DataFrame:
    """(id, carried columns, target, truth, guess) of every row with a target, out of its fold; folds by hash of the id.

    Folds and targets are fitted side by side, ``parallelism`` at once, as each
    by itself keeps few cores busy; each fold's model gives the guesses of the
    rows that it has not seen, and no model of all rows is fitted.  A fold
    without rows, or whose other folds have none, gives no guesses.
    """
    carry = carry or []
    df = cut(df.withColumn("_fold", F.pmod(F.xxhash64(F.col(id_), F.lit(seed)), F.lit(folds)).cast("int")))
    some = df.groupBy("_fold").agg(*[F.count(c).alias(c) for c in targets]).collect()  # a row for each fold
    held = {(r["_fold"], c): r[c] for r in some for c in targets}
    asked = [(c, k) for c in targets for k in range(folds) if held.get((k, c)) and sum(n for (j, t), n in held.items() if t == c and j != k)]

    def guesses(one: tuple[str, int]) -> DataFrame:
        c, k = one
        assembler, forest = _forest(features, c, trees, seed)
        rows = assembler.transform(df.where(F.col(c).isNotNull())).select(id_, *carry, "_fold", "_f", F.col(c).cast("double").alias(c))
        model = forest.fit(rows.where(F.col("_fold") != k))
        return model.transform(rows.where(F.col("_fold") == k)).select(id_, *carry, F.lit(c).alias("target"), F.col(c).alias("truth"), F.col("_p").alias("guess"))

    with ThreadPool(min(parallelism, max(1, len(asked)))) as pool:
        found = pool.map(inheritable_thread_target(df.sparkSession)(guesses), asked)
    none = df.limit(0).select(id_, *carry, F.lit("").alias("target"), F.lit(0.0).alias("truth"), F.lit(0.0).alias("guess"))
    return reduce(DataFrame.unionByName, found, none)


def sample(df: DataFrame, id_: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same in every run: those of smallest hash."""
    return df.orderBy(F.xxhash64(F.col(id_), F.lit(seed)), id_).limit(n)
