"""Queries on yearly series: a user's purchases in ten slots of three days are a station's ten years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.rounding import half_even
from ..operators import compare, impute, series
from . import pipelines
from .registry import query, table

SLOTS = 10
#: Purchases under this value are left out, so that some users' series are empty.
FLOORS = {"djma": 20.0, "cam": 60.0}


def _stations(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, djma and cam: ARRAY<DOUBLE> of mean values by slot, oldest first, of purchases and of dearer ones."""
    e = table(spark, sf, "events").select("user_id", F.floor(F.datediff("ts", F.lit("2024-01-01")) / 3).cast("int").alias("slot"), F.rint(F.col("value") * 100).cast("bigint").alias("cents"), ((F.col("event_type") == "purchase") & (F.col("value") > 0)).alias("buys"))
    here = {name: F.col("buys") & (F.col("cents") > int(floor * 100)) for name, floor in FLOORS.items()}
    sums = e.groupBy("user_id", "slot").agg(*[v.alias(f"{k}_{name}") for name, h in here.items() for k, v in (("sum", F.sum(F.when(h, F.col("cents")))), ("n", F.count_if(h)))])
    mean = {name: F.try_divide(F.col(f"sum_{name}").cast("double"), F.col(f"n_{name}").cast("double")) / 100 for name in FLOORS}
    slots = sums.select("user_id", *[F.when(F.col("slot").between(0, SLOTS - 1) & m.isNotNull(), F.struct("slot", m.alias("v"))).alias(name) for name, m in mean.items()])
    maps = slots.groupBy("user_id").agg(*[F.map_from_entries(F.collect_list(name)).alias(name) for name in FLOORS])  # SLOTS entries at most
    return maps.select("user_id", *[F.array(*[F.try_element_at(name, F.lit(k)) for k in range(SLOTS)]).alias(name) for name in FLOORS])


def _long(df: DataFrame, column: str, value: str = "value") -> DataFrame:
    """A row for each slot.  The outer form, as the other one filters by the array's size first, and that filter would sink below and compute the series once more."""
    return df.select("user_id", F.posexplode_outer(column).alias("slot", value)).withColumn(value, half_even(F.col(value), 4))


def _series_sql(name: str = "djma", tag: str = "") -> str:
    return f"""u{tag} as (select distinct user_id, s.slot from events, (select unnest(range(0, {SLOTS}))::int as slot) s),
m{tag} as (select user_id, date_diff('day', timestamp '2024-01-01', ts) // 3 as slot, sum(round_even(value * 100, 0)::bigint)::double / count(*) / 100 as v
      from events where event_type = 'purchase' and round_even(value * 100, 0)::bigint > {int(FLOORS[name] * 100)} group by all),
b{tag} as (select u.user_id, u.slot, m.v, count(m.v) over w as n, min(case when m.v is not null then u.slot end) over w as lo, max(case when m.v is not null then u.slot end) over w as hi,
      last_value(case when m.v is not null then u.slot end ignore nulls) over (o rows between unbounded preceding and current row) as p, last_value(m.v ignore nulls) over (o rows between unbounded preceding and current row) as pv,
      first_value(case when m.v is not null then u.slot end ignore nulls) over (o rows between current row and unbounded following) as q, first_value(m.v ignore nulls) over (o rows between current row and unbounded following) as qv
      from u{tag} u left join m{tag} m on u.user_id = m.user_id and u.slot = m.slot window w as (partition by u.user_id), o as (partition by u.user_id order by u.slot)),
i{tag} as (select *, case when v is not null then v when pv is not null and qv is not null then pv + (qv - pv) * ((slot - p)::double / (q - p)) end as iv, least(3, hi - lo + 1) as w from b{tag}),
f{tag} as (select user_id, sum(iv) filter (where slot < lo + w) as fs, max(iv) filter (where slot = lo) as f0, max(iv) filter (where slot = lo + w - 1) as f1,
      sum(iv) filter (where slot > hi - w) as ls, max(iv) filter (where slot = hi - w + 1) as l0, max(iv) filter (where slot = hi) as l1 from i{tag} group by user_id),
x{tag} as (select i.user_id, i.slot, i.n, i.v, i.iv, case when n = 0 then null when slot between lo and hi then iv when w = 1 then f0
      when slot < lo then greatest(fs / w + (f1 - f0) / (w - 1) * (slot - (lo + (w - 1) / 2.0::double)), 0)
      else greatest(ls / w + (l1 - l0) / (w - 1) * (slot - (hi - w + 1 + (w - 1) / 2.0::double)), 0) end as xv,
      case when n = {SLOTS} then 'complet' when n = 0 then 'geo_knn' when lo = 0 and hi = {SLOTS - 1} then 'interpolation' else 'extrapolation' end as label from i{tag} i join f{tag} f using (user_id))"""


@query(f"with {_series_sql()} select user_id, slot::int as slot, round_even(iv * 1e4, 0) / 1e4 as value from x")
def series_interpolate(spark: SparkSession, sf: str) -> DataFrame:
    return _long(series.with_interpolated(_stations(spark, sf).select("user_id", "djma"), "djma", "s"), "s")


@query(f"with {_series_sql()} select user_id, slot::int as slot, round_even(xv * 1e4, 0) / 1e4 as value from x")
def series_extrapolate(spark: SparkSession, sf: str) -> DataFrame:
    return _long(series.complete(_stations(spark, sf).select("user_id", "djma"), "djma"), "djma")


@query(f"with {_series_sql()}, {_series_sql('cam', 'c')} select x.user_id, x.n::int as n_djma_original, c.n::int as n_cam_original, x.label as methode_djma, case when c.n = 0 and x.n > 0 then 'mice' else c.label end as methode_cam from x join xc c using (user_id) where x.slot = 0 and c.slot = 0")
def series_label(spark: SparkSession, sf: str) -> DataFrame:
    return series.complete_counts(_stations(spark, sf)).select("user_id", "n_djma_original", "n_cam_original", "methode_djma", "methode_cam")


_CLASS = "case when {n} = 0 then 'Vide' when {n} >= 10 then 'Complet' else 'Partiel' end"


@query(f"with {_series_sql()}, {_series_sql('cam', 'c')}, h as (select 'djma' as metric, {_CLASS.format(n='n')} as classe from x where slot = 0 union all select 'cam', {_CLASS.format(n='n')} from xc where slot = 0), z as (select unnest(['djma', 'cam']) as metric), y as (select unnest(['Vide', 'Partiel', 'Complet']) as classe) select z.metric, y.classe, count(h.metric) as n, round_even(100.0::double * count(h.metric) / (select count(distinct user_id) from events) * 1e4, 0) / 1e4 as pct from z cross join y left join h on h.metric = z.metric and h.classe = y.classe group by z.metric, y.classe")
def completeness_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stations(spark, sf).select(*[codec.completeness(series.known(F.col(c))).alias(c) for c in FLOORS])
    got = compare.class_table(rows, list(FLOORS), ["Vide", "Partiel", "Complet"], "metric", "classe")
    return got.withColumn("pct", half_even(F.col("pct"), 4))


@query(f"with {_series_sql()}, {_series_sql('cam', 'c')}, j as (select x.n as d, c.n as c from x join xc c using (user_id) where x.slot = 0 and c.slot = 0) select count(*) as n, count(*) filter (where d = 10 and c = 10) as both_full, count(*) filter (where d > 0 and c > 0) as both_some, round_even(1e6::double * count(*) filter (where d > 0 and c > 0) / nullif(count(*) filter (where d > 0), 0), 0) / 1e4 as cam_given_djma from j")
def completeness_joint(spark: SparkSession, sf: str) -> DataFrame:
    r = _stations(spark, sf).select(series.known(F.col("djma")).alias("d"), series.known(F.col("cam")).alias("c"))
    both = F.count_if((F.col("d") > 0) & (F.col("c") > 0))
    return r.agg(F.count("*").alias("n"), F.count_if((F.col("d") == 10) & (F.col("c") == 10)).alias("both_full"), both.alias("both_some"), half_even(F.try_divide(F.lit(100.0) * both, F.count_if(F.col("d") > 0).cast("double")), 4).alias("cam_given_djma"))


@query(
    f"with {_series_sql()}, {_series_sql('cam', 'c')}, full_d as (select user_id, count(v) = 10 as d0, count(xv) = 10 as d1 from x group by user_id), full_c as (select user_id, count(v) = 10 as c0, count(xv) = 10 as c1 from xc group by user_id) "
    "select 'mesures' as stage, round_even(avg(case when d0 then 100.0::double else 0 end) * 10, 0) / 10 as djma, round_even(avg(case when c0 then 100.0::double else 0 end) * 10, 0) / 10 as cam from full_d join full_c using (user_id) "
    "union all select 'series', round_even(avg(case when d1 then 100.0::double else 0 end) * 10, 0) / 10, round_even(avg(case when c1 then 100.0::double else 0 end) * 10, 0) / 10 from full_d join full_c using (user_id)"
)
def cascade_evolution(spark: SparkSession, sf: str) -> DataFrame:
    raw = _stations(spark, sf)
    widen = lambda df: df.select(*[v.alias(k) for m in FLOORS for k, v in series.wide(F.col(m), f"{m}_", SLOTS).items()])
    families = {m: [f"{m}_{k}" for k in range(1, SLOTS + 1)] for m in FLOORS}
    return pipelines.cascade({"mesures": widen(raw), "series": widen(series.complete_counts(raw))}, families)


_PCT = "round_even(avg(case when {} then 100.0::double else 0 end) * 10, 0) / 10"


@query(
    f"with {_series_sql()}, {_series_sql('cam', 'c')}, full_d as (select user_id, count(v) = 10 as d0, count(xv) = 10 as d1, max(n) as n from x group by user_id), full_c as (select user_id, count(v) = 10 as c0, count(xv) = 10 as c1, max(n) as m from xc group by user_id), both_full as (select * from full_d join full_c using (user_id)) "
    + " union all ".join(f"select '{stage}' as stage, {_PCT.format(d)} as djma, {_PCT.format(c)} as cam from both_full" for stage, d, c in (("mesures", "d0", "c0"), ("series", "d1", "c1"), ("forets", "d1", "c1 or (m = 0 and n > 0)"), ("voisins", "true", "true")))
)
def cascade_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Completeness at all four checkpoints of the completion stage, forests and neighbours among them, watched in one run of it."""
    place = {"x": (F.col("user_id") * 37 % 101).cast("double"), "y": (F.col("user_id") * 61 % 97).cast("double"), "kind": (F.col("user_id") % 3).cast("string")}
    raw = _stations(spark, sf).select(F.col("user_id").alias("id"), *[v.alias(k) for k, v in place.items()], *[v.alias(k) for m in FLOORS for k, v in series.wide(F.col(m), f"val_{m}_annee_", SLOTS).items()])
    watched: list = []
    done = pipelines.complete_series(raw, ["x", "y"], watched, trees=3, rounds=1, least=2)
    done.write.format("noop").mode("overwrite").save()
    return pipelines.cascade_of(watched, spark)


@query(f"with {_series_sql()}, o as (select median(v) as med from m), r as (select user_id, avg(v) as mean from x group by user_id) select user_id, slot::int as slot, round_even(coalesce(v, mean, med) * 1e4, 0) / 1e4 as value from x join r using (user_id), o")
def row_mean_fallback(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stations(spark, sf).select("user_id", "djma")
    overall = compare.percentiles(rows.select(F.lit(1).alias("of"), F.explode("djma").alias("v")), "of", "v", {"med": 0.5}).select("med")
    filled = F.transform("djma", lambda v: series.row_fallback(v, F.col("djma"), F.col("med")))
    return _long(rows.crossJoin(F.broadcast(overall)).select("user_id", filled.alias("s")), "s")


@query(f"with {_series_sql()} select user_id, round_even(regr_slope(v, slot) * 1e4, 0) / 1e4 as slope, round_even(regr_intercept(v, slot) * 1e4, 0) / 1e4 as intercept from x where v is not null group by user_id having count(v) >= 3")
def series_trend(spark: SparkSession, sf: str) -> DataFrame:
    """The line through all known years of a station, beside which local extrapolation is shown."""
    known = _stations(spark, sf).select("user_id", F.posexplode("djma").alias("slot", "v")).where("v is not null")
    lines = known.groupBy("user_id").agg(F.regr_slope("v", "slot").alias("slope"), F.regr_intercept("v", "slot").alias("intercept"), F.count("*").alias("n")).where("n >= 3")
    return lines.select("user_id", half_even(F.col("slope"), 4).alias("slope"), half_even(F.col("intercept"), 4).alias("intercept"))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    """id, f1..f12, the one-hot kind, and two targets that a third of the rows lack."""
    e = table(spark, sf, "embeddings")
    kinds = codec.one_hot(F.col("label").cast("string"), ["0", "1", "2", "3", "4"])
    targets = {f"t{k}": F.when(F.col("vec_id") % 3 != 0, F.abs(F.col("embedding")[k].cast("double")) * 100 + F.abs(F.col("embedding")[0].cast("double")) * 50) for k in (1, 2)}
    return e.select(F.col("vec_id").alias("id"), *[F.col("embedding")[k].cast("double").alias(f"f{k}") for k in range(12)], *[v.alias(k) for k, v in kinds.items()], *[v.alias(k) for k, v in targets.items()])


FEATURES = [f"f{k}" for k in range(12)] + [f"route_{k}" for k in range(5)]


@query("select vec_id as id, " + ", ".join(f"embedding[{k + 1}]::double as f{k}" for k in range(12)) + ", " + ", ".join(f"(case when label in (0, 1, 2, 3) then label else 4 end = {k})::int::double as route_{k}" for k in range(5)) + ", " + ", ".join(f"case when vec_id % 3 <> 0 then abs(embedding[{k + 1}]::double) * 100 + abs(embedding[1]::double) * 50 end as t{k}" for k in (1, 2)) + " from embeddings")
def rf_features(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf)


@query()
def rf_chained_impute(spark: SparkSession, sf: str) -> DataFrame:
    return impute.chained_forests(_features(spark, sf), FEATURES, ["t1", "t2"])


@query()
def rf_cv_scores(spark: SparkSession, sf: str) -> DataFrame:
    got = impute.cross_validated(_features(spark, sf).where("t1 is not null"), "id", FEATURES, ["t1", "t2"])
    return compare.scores(got, "truth", "guess", "target")


TARGETS = [f"t{k}" for k in range(1, 11)]


def _validated(spark: SparkSession, sf: str) -> DataFrame:
    """Guesses out of fold of ten targets for every vector, with its class: all 64 numbers and the one-hot class are predictors.

    Target k is made of numbers 0 and k, so that there is something to find.
    """
    e = table(spark, sf, "embeddings")
    at = lambda k: F.abs(F.get("embedding", F.lit(k)).cast("double"))
    kinds = codec.one_hot(F.col("label").cast("string"), ["0", "1", "2", "3", "4"])
    rows = e.select(F.col("vec_id").alias("id"), "label", *[F.get("embedding", F.lit(k)).cast("double").alias(f"f{k}") for k in range(64)], *[v.alias(k) for k, v in kinds.items()], *[(at(k) * 100 + at(0) * 50).alias(f"t{k}") for k in range(1, 11)])
    return impute.cross_validated(rows, "id", [f"f{k}" for k in range(64)] + list(kinds), TARGETS, trees=10, carry=["label"])


@query()
def cv_scores(spark: SparkSession, sf: str) -> DataFrame:
    """R2 and RMSE of five-fold validation over rows times targets, overall (class null) and by class."""
    got = impute.cut(_validated(spark, sf))
    overall = compare.scores(got, "truth", "guess").select(F.lit(None).cast("int").alias("label"), "n", "r2", "rmse")
    return overall.unionByName(compare.scores(got.where("label is not null"), "truth", "guess", "label"))


@query()
def cv_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Truth and guess of 3000 of the guesses, the same in every run: what a scatter plot shows."""
    got = _validated(spark, sf).withColumn("key", F.concat_ws("/", "id", "target"))
    return impute.sample(got, "key", 3000).select("id", "target", "label", "truth", "guess")
