"""The four ways to aggregate measured segments per arc, from segment rows or from text lists, and borrowing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.rounding import exact, half_even, whole

SHARE = 0.8
METHODS = (1, 2, 3, 4)


def truck_flow(count: Column, percent: Column) -> Column:
    """Trucks a day: count times percent, rounded half to even; null if either is."""
    return whole(count * percent / 100)


def nearest_rank(n: Column, share: float = SHARE) -> Column:
    """1-based rank of the nearest-rank percentile among ``n``."""
    return F.least(F.greatest(F.rint(F.lit(share) * n).cast("int"), F.lit(1)), n.cast("int"))


def _ratio(total: Column, weight: Column) -> Column:
    return F.try_divide(total.cast("double"), weight.cast("double"))


def aggregate_methods(segs: DataFrame, key: str = "ID_ARC", order: str = "ord", weights: dict = codec.CLASS_WEIGHTS, which: tuple = METHODS) -> DataFrame:
    """Per arc djma_mK, pct_cam_mK, djma_cam_mK, n_segs_mK for the methods in ``which``, in one shuffle on the arc.

    ``segs``: key, djma_val, cam_val, longueur_m, des_clasf, and ``order``,
    by which ranks among equal values go, then by the truck share: rows equal
    in all three give the same result, whichever is taken.  m1 plain mean, m2 mean
    by length, m3 by class weight (plain, if the weights add up to 0), m4 the segment at the 80th
    percentile by nearest rank.  m1, m3 and m4 take counts cut to integers, m2
    as they are.  Truck shares: m1 and m3 over all known ones, m2 over those of
    segments with a count, m4 that of the ranked segment.  Arcs without counts
    get nulls and n 0.  Sums are fixed-point: the partitioning cannot change them.
    """
    v = F.col("djma_val").cast("bigint")
    rows = segs.withColumns({"v": v, "w": codec.lookup(F.col("des_clasf"), weights, 1)})
    if 4 in which:
        by = Window.partitionBy(key)
        rows = rows.withColumn("rank", F.row_number().over(by.orderBy(F.col("v").isNull(), "v", order, "cam_val"))).withColumn("known", F.count("v").over(by))
    has, truck = F.col("v").isNotNull(), F.col("cam_val")
    out = []
    total = lambda x, c=None: F.sum(exact(x) if c is None else F.when(c, exact(x)))

    def columns(k: int, count: Column, percent: Column, n: Column) -> list[Column]:
        percent = F.when(count.isNotNull(), half_even(percent, 1))
        return [count.alias(f"djma_m{k}"), percent.alias(f"pct_cam_m{k}"), truck_flow(count, percent).alias(f"djma_cam_m{k}"), n.cast("int").alias(f"n_segs_m{k}")]

    if 1 in which:
        out += columns(1, whole(_ratio(F.sum("v"), F.count("v"))), _ratio(total(truck), F.count(truck)), F.count("v"))
    if 2 in which:
        weight = total(F.col("longueur_m"), F.col("djma_val").isNotNull())
        both = F.col("djma_val").isNotNull() & truck.isNotNull()
        count = whole(_ratio(total(F.col("djma_val") * F.col("longueur_m")), F.nullif(weight, F.lit(0).cast("decimal(18,6)"))))
        out += columns(2, count, _ratio(total(truck * F.col("longueur_m"), both), F.nullif(total(F.col("longueur_m"), both), F.lit(0).cast("decimal(18,6)"))), F.when(weight != 0, F.count("djma_val")).otherwise(0))
    if 3 in which:
        count = whole(F.coalesce(_ratio(F.sum(F.col("v") * F.col("w")), F.nullif(F.sum(F.when(has, F.col("w"))), F.lit(0))), _ratio(F.sum("v"), F.count("v"))))
        percent = _ratio(total(truck * F.col("w")), F.nullif(F.sum(F.when(truck.isNotNull(), F.col("w"))), F.lit(0)))
        out += columns(3, count, F.coalesce(percent, _ratio(total(truck), F.count(truck))), F.count("v"))
    if 4 in which:
        at = has & (F.col("rank") == nearest_rank(F.col("known")))
        out += columns(4, F.max(F.when(at, F.col("v"))), F.max(F.when(at, truck)), F.count("v"))
    return rows.groupBy(key).agg(*out)


def arc_methods(arcs: DataFrame, segs: DataFrame, key: str = "ID_ARC", **settings) -> DataFrame:
    """``arcs`` left-joined with :func:`aggregate_methods`; arcs without segments get n 0."""
    found = aggregate_methods(segs, key, **settings)
    joined = arcs.join(found, key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in found.columns if c.startswith("n_segs_m")})


def list_methods(arcs: DataFrame, values: str = "ids_segs_djma_val", trucks: str = "ids_segs_djma_val_cam", classes: str = "ids_segs_rtss_type", weights: dict = codec.CLASS_WEIGHTS) -> DataFrame:
    """``arcs`` plus m1, m3 and m4 read from the text lists, as written there.

    m3 zips the value list with the class list of the arc by position, to the
    shorter; so its n may be less than that of m1.  An arc's list is one cell, so this is row by row work.
    """
    plain, shares = codec.parse_values(F.col(values)), codec.parse_values(F.col(trucks))
    pairs = codec.parse_pairs(F.col(values), F.col(trucks))
    by_class, shares_by_class = codec.parse_weighted(F.col(values), F.col(classes), weights), codec.parse_weighted(F.col(trucks), F.col(classes), weights)
    rows = arcs.withColumns({"_v": plain, "_c": shares, "_p": pairs, "_w": by_class, "_x": shares_by_class})
    total = lambda a, f=lambda x: x: F.aggregate(a, F.lit(0).cast("decimal(38,6)"), lambda s, x: (s + f(x).cast("decimal(18,6)")).cast("decimal(38,6)"))
    mean = lambda a: _ratio(total(F.col(a)), F.nullif(F.size(a), F.lit(0)))
    by_weight = lambda a: _ratio(total(F.col(a), lambda r: r["value"] * r["weight"]), F.nullif(total(F.col(a), lambda r: r["weight"].cast("double")), F.lit(0).cast("decimal(38,6)")))
    weighted = lambda a: F.coalesce(by_weight(a), _ratio(total(F.col(a), lambda r: r["value"]), F.nullif(F.size(a), F.lit(0))))
    ranked = F.sort_array(F.transform("_p", lambda r: F.struct(r["value"].alias("value"), r["pos"].alias("pos"), r["paired"].alias("paired"))))
    at = F.try_element_at(ranked, nearest_rank(F.size("_p")))

    def columns(k: int, count: Column, percent: Column, n: Column) -> dict[str, Column]:
        percent = F.when(count.isNotNull(), half_even(percent, 1))
        return {f"djma_m{k}": count, f"pct_cam_m{k}": percent, f"djma_cam_m{k}": truck_flow(count, percent), f"n_segs_m{k}": n.cast("int")}

    rows = rows.withColumns({"_at": F.when(F.size("_p") > 0, at), "_m1": whole(mean("_v")), "_m3": whole(weighted("_w")), "_t1": mean("_c"), "_t3": weighted("_x")})  # each once
    out = columns(1, F.col("_m1"), F.col("_t1"), F.size("_v")) | columns(3, F.col("_m3"), F.col("_t3"), F.size("_w"))
    out |= columns(4, whole(F.col("_at")["value"]), F.col("_at")["paired"], F.size("_p"))
    return rows.withColumns(out).drop("_v", "_c", "_p", "_w", "_x", "_at", "_m1", "_m3", "_t1", "_t3")


def borrowed_columns() -> list[str]:
    return [f"{c}_m{k}" for k in METHODS for c in ("djma", "pct_cam", "djma_cam")]


def borrow(arcs: DataFrame, nearest: DataFrame, key: str = "ID_ARC") -> DataFrame:
    """Arcs without counts take the method columns of their donor.

    ``nearest``: key, donor, distance in metres (see spatial.nearest).  Adds
    djma_complete, djma_arc_source, djma_distance_source_km; n_segs stay.
    """
    cols = [c for c in borrowed_columns() if c in arcs.columns]
    donors = arcs.select(F.col(key).alias("donor"), *[F.col(c).alias("_" + c) for c in cols])
    given = nearest.select(key, "donor", "distance").join(donors, "donor")
    out = arcs.join(given, key, "left").withColumns({c: F.when(F.col("donor").isNotNull(), F.col("_" + c)).otherwise(F.col(c)) for c in cols})
    out = out.withColumns({"djma_complete": F.col("donor").isNotNull(), "djma_arc_source": F.col("donor"), "djma_distance_source_km": half_even(F.col("distance") / 1000, 1)})
    return out.drop("donor", "distance", *["_" + c for c in cols])
