"""Queries behind the reports: summaries of methods, routing, donors and model quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import half_even
from ..operators import compare, impute, methods, spatial
from . import method_queries as mq
from . import network_queries, spatial_queries as sq
from .registry import query, table

_TEXT = ", ".join(f"coalesce(format('{{:,}}', djma_m{k}), 'NA') as djma_m{k}" for k in (1, 2, 3, 4))


@query(mq._methods_sql((1, 2, 3, 4), mq._SPREAD) + f"select ID_ARC, {_TEXT}, coalesce(printf('%.1f %%', ecart_pct), 'NA') as ecart_pct from b order by ID_ARC")
def methods_report(spark: SparkSession, sf: str) -> DataFrame:
    """All arcs by id, as the report shows them."""
    return compare.report(mq._methods(spark, sf))


@query(mq._methods_sql((4,)) + "select count(*) as n, count(djma_m4) as n_ok, round_even(1000.0::double * count(djma_m4) / count(*), 0) / 10 as pct, min(djma_m4) as least, max(djma_m4) as most from a")
def network_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return compare.coverage(mq._methods(spark, sf, (4,)))


@query(
    "with g as (select l_orderkey, sum(l_quantity) as t, coalesce(sum(l_quantity) filter (where l_returnflag <> 'R'), 0) as q, round_even(1000.0::double * count(*) filter (where l_partkey % 11 <> 0) / count(*), 0) / 10 as p, count(*) as n from lineitem group by l_orderkey) "
    "select median(t)::double as longueur_trace_km, median(q)::double as longueur_qc_km, median(p)::double as statut_djma_pct, median(n)::double as n_segs_djma, round_even((1 - avg(q) / avg(t)) * 1000, 0) / 10 as excluded_pct, count(*) filter (where p = 100) as n_full, count(*) filter (where p < 50) as n_under_half from g"
)
def routing_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as routed arcs: their quantities are kilometres, those not returned lie inside."""
    inside = F.coalesce(F.sum(F.when(F.col("des_clasf") != "R", F.col("longueur_m"))), F.lit(0.0))
    pct = half_even(100.0 * F.count("djma_val") / F.count("*"), 1)
    arcs = mq.segments(spark, sf).groupBy("ID_ARC").agg(F.sum("longueur_m").alias("longueur_trace_km"), inside.alias("longueur_qc_km"), pct.alias("statut_djma_pct"), F.count("*").alias("n_segs_djma"))
    return compare.routing_summary(arcs)


@query(f"with {sq._nearest_sql('em.embedding[60] < 0', 'eo.embedding[60] >= 0')}, n as (select l, round_even(min(distance) * 1000 * 10, 0) / 10 as km from near group by l) select count(*) as n, max(km) as most_km, median(km) as median_km from n")
def donor_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Distances at which lines without a value borrow, as thousandfold kilometres."""
    value = F.get("embedding", F.lit(59)).cast("double")
    arcs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ID_ARC"), F.when(value >= 0, value).alias("djma_m1"))
    nearest = spatial.nearest_lines(sq._lines(spark, sf, "embedding[59] < 0"), sq._lines(spark, sf, "embedding[59] >= 0"), 4 * sq.CELL)
    nearest = nearest.select(F.col("target").alias("ID_ARC"), "donor", (F.col("distance") * 1e6).alias("distance"))
    return compare.donor_summary(methods.borrow(arcs, nearest))


@query(f"select (select count(*) from pages where {' or '.join(f'starts_with(url, {chr(39)}{p}{chr(39)})' for p in network_queries.PREFIXES)}) as sources, (select count(*) from documents where lang in ('en', 'fr')) as labels")
def change_counters(spark: SparkSession, sf: str) -> DataFrame:
    """How many elements the migrations change."""
    moved = network_queries.prefix_migrate(spark, sf).agg(F.count_if("migrated").alias("sources"))
    return moved.crossJoin(network_queries.label_rename(spark, sf).agg(F.count_if("renamed").alias("labels")))


_SCORES = "count(*) as n, round_even((1 - sum((t - g) * (t - g)) / (count(*) * var_pop(t))) * 1e6, 0) / 1e6 as r2, round_even(sqrt(avg((t - g) * (t - g))) * 1e3, 0) / 1e3 as rmse"


@query(f"with s as (select l_returnflag as classe, l_extendedprice as t, l_quantity * 1500 as g from lineitem) select classe, {_SCORES} from s group by classe union all select 'tous', {_SCORES} from s")
def scores_by_class(spark: SparkSession, sf: str) -> DataFrame:
    """Fit of a guess of prices from quantities, of each class and of all."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("classe"), F.col("l_extendedprice").alias("truth"), (F.col("l_quantity") * 1500).alias("guess"))
    both = compare.scores(rows, "truth", "guess", "classe").unionByName(compare.scores(rows, "truth", "guess").withColumn("classe", F.lit("tous")))
    return both.select("classe", "n", half_even(F.col("r2"), 6).alias("r2"), half_even(F.col("rmse"), 3).alias("rmse"))


FAMILIES = {name: [f"val_{name}_annee_{k}" for k in range(1, 11)] for name in ("djme", "djmh")}
_CLASSES = ["0", "1", "2", "3", "Autre"]


def _families_sql() -> str:
    known = lambda i: f"case when embedding[{i}] >= 0 then embedding[{i}]::double end"
    lists = {name: f"[{', '.join(known(10 * f + k + 1) for k in range(10))}]" for f, name in enumerate(FAMILIES)}
    out = f"v as (select vec_id, {', '.join(f'{x} as {n}' for n, x in lists.items())}, {known(21)} as h, label from embeddings),\n"
    out += "m as (select " + ", ".join(f"(select median(z) from (select unnest({n}) as z from v)) as {n}_m" for n in FAMILIES) + ", (select median(h) from v) as h_m)"
    return out


def _filled_sql(name: str, k: int) -> str:
    some = f"list_filter({name}, lambda z: z is not null)"
    return f"round_even(coalesce({name}[{k}], list_sum({some}) / nullif(len({some}), 0), {name}_m) * 1e6, 0) / 1e6 as val_{name}_annee_{k}"


@query(
    f"with {_families_sql()}, {sq._edges_sql('e', 'a', 'q')}, c as (select aid, sum({sq._S} * (ax + qx) / 2) / sum({sq._S}) as cx, sum({sq._S} * (ay + qy) / 2) / sum({sq._S}) as cy from e group by aid) "
    + f"select vec_id as id, {', '.join(_filled_sql(n, k) for n in FAMILIES for k in range(1, 11))}, round_even(coalesce(h, h_m) * 1e6, 0) / 1e6 as val_30e_heure, "
    + ", ".join(f"(case when label in (0, 1, 2, 3) then label::varchar else 'Autre' end = '{k}')::int::double as route_{k}" for k in _CLASSES)
    + ", round_even(cx * 1e6, 0) / 1e6 as x_centroide, round_even(cy * 1e6, 0) / 1e6 as y_centroide from v join c on c.aid = v.vec_id, m"
)
def model_features(spark: SparkSession, sf: str) -> DataFrame:
    """The 28 predictors beside the counts: two families of ten flows, the 30th hour, the road class and the centroid."""
    known = lambda i: F.when(F.get("embedding", F.lit(i)) >= 0, F.get("embedding", F.lit(i)).cast("double"))
    flows = [known(10 * f + k).alias(c) for f, columns in enumerate(FAMILIES.values()) for k, c in enumerate(columns)]
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), *flows, known(20).alias("val_30e_heure"), F.col("label").cast("string").alias("classe"), sq._line().alias("line"))
    got = impute.features(rows, FAMILIES, "val_30e_heure", "classe", _CLASSES, "line").drop("classe", "line")
    return got.select("id", *[half_even(F.col(c), 6).alias(c) if not c.startswith("route_") else c for c in got.columns if c != "id"])
