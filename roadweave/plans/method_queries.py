"""Queries on measured segments per arc: orders are arcs, their lines measured segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.rounding import half_even, whole
from ..operators import compare, methods
from .registry import query, table

WEIGHTS = {"A": 4, "N": 3}
LIST = ["ids_segs_djma_val", "ids_segs_djma_val_cam", "ids_segs_rtss_type"]


def arcs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("ID_ARC"))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of every eleventh part are unknown, and so are truck shares where tax is low and the line open."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("ID_ARC"), F.when(F.col("l_partkey") % 11 != 0, F.col("l_extendedprice")).alias("djma_val"),
        F.when((F.col("l_linestatus") != "O") | (F.col("l_tax") >= 0.02), F.col("l_discount") * 100).alias("cam_val"),
        F.col("l_quantity").alias("longueur_m"), F.col("l_returnflag").alias("des_clasf"), F.col("l_extendedprice").alias("ord"), F.year("l_shipdate").alias("year"), "l_tax",
    )


_SEGS = """s as (select l_orderkey as id, case when l_partkey % 11 <> 0 then l_extendedprice end as d, case when l_linestatus <> 'O' or l_tax >= 0.02 then l_discount * 100 end as c,
    l_quantity as m, l_returnflag as f, case l_returnflag when 'A' then 4 when 'N' then 3 else 1 end as w, l_extendedprice as ord, year(l_shipdate) as y, l_tax from lineitem),
t as (select *, trunc(d)::bigint as v from s),
k as (select *, row_number() over (partition by id order by v is null, v, ord) as r, count(v) over (partition by id) as n from t)"""
_DEC = "decimal(18,6)"


def _ratio(a: str, b: str) -> str:
    return f"({a})::double / nullif(({b})::double, 0)"


_COUNT = {
    1: f"round_even({_ratio('sum(v)', 'count(v)')}, 0)",
    2: f"round_even({_ratio(f'sum((d * m)::{_DEC})', f'sum(m::{_DEC}) filter (where d is not null)')}, 0)",
    3: f"round_even({_ratio('sum(v * w)', 'sum(w) filter (where v is not null)')}, 0)",
    4: "max(v) filter (where v is not null and r = greatest(least(round_even(0.8::double * n, 0)::int, n), 1))",
}
_BOTH = "d is not null and c is not null"
_SHARE = {
    1: _ratio(f"sum(c::{_DEC})", "count(c)"),
    2: _ratio(f"sum((c * m)::{_DEC}) filter (where {_BOTH})", f"sum(m::{_DEC}) filter (where {_BOTH})"),
    3: _ratio(f"sum((c * w)::{_DEC})", "sum(w) filter (where c is not null)"),
    4: "max(c) filter (where v is not null and r = greatest(least(round_even(0.8::double * n, 0)::int, n), 1))",
}


def _methods_sql(which: tuple, more: str = "") -> str:
    """The methods of every arc as table ``a``."""
    inner = ", ".join(f"({_COUNT[k]})::bigint as djma_m{k}, round_even(({_SHARE[k]}) * 10, 0) / 10 as p{k}, count({'d' if k == 2 else 'v'}) as n{k}" for k in which)
    outer = ", ".join(f"djma_m{k}, case when djma_m{k} is not null then p{k} end as pct_cam_m{k}, case when djma_m{k} is not null then round_even(djma_m{k} * p{k} / 100, 0)::bigint end as djma_cam_m{k}, coalesce(n{k}, 0)::int as n_segs_m{k}" for k in which)
    return f"with {_SEGS},\ng as (select id, {inner} from k group by id),\na as (select o_orderkey as ID_ARC, {outer} from orders left join g on o_orderkey = id){more}\n"


def _methods(spark: SparkSession, sf: str, which: tuple = methods.METHODS) -> DataFrame:
    return methods.arc_methods(arcs(spark, sf), segments(spark, sf), weights=WEIGHTS, which=which)


@query(_methods_sql((1, 2, 3, 4)) + "select * from a")
def methods_all(spark: SparkSession, sf: str) -> DataFrame:
    return _methods(spark, sf)


@query(_methods_sql((1,)) + "select * from a")
def m1_simple_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _methods(spark, sf, (1,))


@query(_methods_sql((2,)) + "select * from a")
def m2_length_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return _methods(spark, sf, (2,))


@query(_methods_sql((3,)) + "select * from a")
def m3_class_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return _methods(spark, sf, (3,))


@query(_methods_sql((4,)) + "select * from a")
def m4_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _methods(spark, sf, (4,))


@query("select l_orderkey as ID_ARC, l_linenumber, l_extendedprice, round_even(l_extendedprice * (l_discount * 100) / 100, 0)::bigint as djma_cam from lineitem")
def truck_flow(spark: SparkSession, sf: str) -> DataFrame:
    flow = methods.truck_flow(F.col("l_extendedprice"), F.col("l_discount") * 100)
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ID_ARC"), "l_linenumber", "l_extendedprice", flow.alias("djma_cam"))


_SPREAD = """,
e as (select *, list_filter([djma_m1::double, djma_m2::double, djma_m3::double, djma_m4::double], lambda x: x is not null) as known from a),
b as (select * exclude (known), round_even(case when list_sum(known) <> 0 then (list_max(known) - list_min(known)) / (list_sum(known) / len(known)) * 100 end * 10, 0) / 10 as ecart_pct from e)"""


@query(_methods_sql((1, 2, 3, 4), _SPREAD) + "select ID_ARC, ecart_pct from b")
def spread_pct(spark: SparkSession, sf: str) -> DataFrame:
    return compare.with_spread(_methods(spark, sf)).select("ID_ARC", "ecart_pct")


@query(_methods_sql((1, 2, 3, 4), _SPREAD) + "select ID_ARC, djma_m1, djma_m2, djma_m3, djma_m4, ecart_pct from b where ecart_pct > 30 order by ecart_pct desc, ID_ARC limit 50")
def divergent_top(spark: SparkSession, sf: str) -> DataFrame:
    """The report of the 50 widest arcs."""
    return compare.divergent(_methods(spark, sf)).select("ID_ARC", *compare.COLUMNS, "ecart_pct").limit(50)


@query(
    _methods_sql((1, 2, 3, 4), ",\nl as (select unnest(['gap_m1', 'gap_m2', 'gap_m3']) as method, unnest([(djma_m4 - djma_m1)::double / nullif(djma_m1, 0) * 100, (djma_m4 - djma_m2)::double / nullif(djma_m2, 0) * 100, (djma_m4 - djma_m3)::double / nullif(djma_m3, 0) * 100]) as value from a),\nq as (select method, count(value) as n, quantile_cont(value, [0.25, 0.5, 0.75]) as q from l where value is not null group by method),\nw as (select q.method, min(value) as low, max(value) as high from q join l using (method) where value between q[1] - 1.5 * (q[3] - q[1]) and q[3] + 1.5 * (q[3] - q[1]) group by q.method)")
    + "select method, n, round_even(q[1] * 1e4, 0) / 1e4 as q1, round_even(q[2] * 1e4, 0) / 1e4 as median, round_even(q[3] * 1e4, 0) / 1e4 as q3, round_even(low * 1e4, 0) / 1e4 as low, round_even(high * 1e4, 0) / 1e4 as high from q join w using (method)"
)
def gap_to_m4_box(spark: SparkSession, sf: str) -> DataFrame:
    gaps = _methods(spark, sf).select(*[compare.gap(f"djma_m{k}").alias(f"gap_m{k}") for k in (1, 2, 3)])
    box = compare.box_stats(gaps, ["gap_m1", "gap_m2", "gap_m3"])
    return box.select("method", "n", *[half_even(F.col(c), 4).alias(c) for c in ("q1", "median", "q3", "low", "high")])


_LONG = ",\nl as (select unnest(['djma_m1', 'djma_m2', 'djma_m3', 'djma_m4']) as method, unnest([djma_m1, djma_m2, djma_m3, djma_m4])::double as value from a)"


@query(
    _methods_sql((1, 2, 3, 4), _LONG)
    + f"select method, count(value) as n, round_even(sum(value::{_DEC})::double / count(value) * 1e4, 0) / 1e4 as mean, median(value) as median, min(value) as min, max(value) as max, round_even(stddev_samp(value) * 1e3, 0) / 1e3 as std, count(*) - count(value) as n_null from l group by method"
)
def describe_methods(spark: SparkSession, sf: str) -> DataFrame:
    found = compare.describe(_methods(spark, sf))
    return found.withColumns({"mean": half_even(F.col("mean"), 4), "std": half_even(F.col("std"), 3)})


@query(
    _methods_sql((1, 2, 3, 4), ",\nc as (select x.i as i, y.i as j, corr(x.v, y.v) as r from (select ID_ARC, unnest([1, 2, 3, 4]) as i, unnest([djma_m1, djma_m2, djma_m3, djma_m4])::double as v from a) x join (select ID_ARC, unnest([1, 2, 3, 4]) as i, unnest([djma_m1, djma_m2, djma_m3, djma_m4])::double as v from a) y using (ID_ARC) group by all)")
    + "select 'djma_m' || i as a, 'djma_m' || j as b, round_even(r * 1e6, 0) / 1e6 as r from c"
)
def pearson_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return compare.pearson(_methods(spark, sf)).withColumn("r", half_even(F.col("r"), 6))


@query(_methods_sql((1, 2, 3, 4), _LONG) + "select method, median(value) as median, min(value) as min, max(value) as max, count(*) - count(value) as n_null from l group by method")
def method_summary(spark: SparkSession, sf: str) -> DataFrame:
    return compare.describe(_methods(spark, sf)).select("method", "median", "min", "max", "n_null")


_STATUS = "case when n_segs_m1 > 0 then 'ok' when ID_ARC % 10 = 0 then 'hors_quebec' else 'aucun_djma' end"


def _with_status(df: DataFrame) -> DataFrame:
    return df.withColumn("statut", F.expr(_STATUS))


@query(_methods_sql((1,)) + f"select {_STATUS} as statut, count(*) as count from a where {_STATUS} <> 'ok' group by 1")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return compare.status_counts(_with_status(_methods(spark, sf, (1,))))


@query("select case when p_type in ('ECONOMY', 'SMALL', 'LARGE') then p_type else 'Autre' end as classe, count(*) as n, round_even(100.0::double * count(*) / (select count(*) from part) * 1e4, 0) / 1e4 as pct from part group by 1")
def class_share(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("p_type").isin("ECONOMY", "SMALL", "LARGE"), F.col("p_type")).otherwise("Autre")
    return compare.shares(table(spark, sf, "part"), name, "classe").withColumn("pct", half_even(F.col("pct"), 4))


_BINS = "case when n_segs_m1 <= 0 then null when n_segs_m1 <= 3 then '1–3' when n_segs_m1 <= 6 then '4–6' when n_segs_m1 <= 10 then '7–10' when n_segs_m1 <= 18 then '11–18' else '19+' end"


@query(_methods_sql((1,)) + f"select {_BINS} as classe, count(*) as n from a group by 1")
def segment_bins(spark: SparkSession, sf: str) -> DataFrame:
    return _methods(spark, sf, (1,)).groupBy(codec.segment_class(F.col("n_segs_m1")).alias("classe")).agg(F.count("*").alias("n"))


@query(_methods_sql((4,)) + "select ID_ARC, djma_m4 from a where djma_m4 is not null order by djma_m4 desc, ID_ARC limit 3")
def top_k(spark: SparkSession, sf: str) -> DataFrame:
    return _methods(spark, sf, (4,)).where("djma_m4 is not null").orderBy(F.desc("djma_m4"), "ID_ARC").select("ID_ARC", "djma_m4").limit(3)


@query("with a as (select 'ids' as how, o_orderkey as id from orders where o_orderkey in (1, 5, 7, 32) union all select 'one', o_orderkey from orders where o_orderkey = 3 union all (select 'first', o_orderkey from orders order by o_orderkey limit 20)) select how, id from a")
def sample_ids(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources import layers

    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    parts = {"ids": layers.subset(o, "id", some=[1, 5, 7, 32]), "one": layers.subset(o, "id", one=3), "first": layers.subset(o, "id", first=20)}
    a, b, c = (df.select(F.lit(how).alias("how"), "id") for how, df in parts.items())
    return a.unionByName(b).unionByName(c)


# Text lists: counts with their year, truck shares alike, and the classes of other segments (the longer ones).
_LISTS = f"""{_SEGS},
lists as (select id as ID_ARC, string_agg(coalesce(trunc(d)::bigint || '@' || coalesce(case when l_tax > 0 then y end::varchar, '?'), 'NA'), '|' order by ord) as ids_segs_djma_val,
    string_agg(coalesce(trunc(c)::bigint || '@' || coalesce(case when l_tax > 0 then y end::varchar, '?'), 'NA'), '|' order by ord) as ids_segs_djma_val_cam,
    string_agg(case when f = 'R' then 'None' else f end, '|' order by ord) filter (where m > 15) as ids_segs_rtss_type from s group by id)"""


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    year = F.when(F.col("l_tax") > 0, F.col("year"))
    texts = F.struct("ord", codec.encode_value_year(F.col("djma_val"), year).alias("v"), codec.encode_value_year(F.col("cam_val"), year).alias("t"))
    classes = F.when(F.col("longueur_m") > 15, F.struct("ord", F.when(F.col("des_clasf") != "R", F.col("des_clasf")).alias("f")))
    g = segments(spark, sf).groupBy("ID_ARC").agg(F.sort_array(F.collect_list(texts)).alias("s"), F.sort_array(F.collect_list(classes)).alias("r"))
    pick = lambda a, f: codec.encode_list(F.transform(a, lambda x: x[f]))
    return g.select("ID_ARC", pick("s", "v").alias(LIST[0]), pick("s", "t").alias(LIST[1]), pick("r", "f").alias(LIST[2]))


@query(f"with {_LISTS} select * from lists")
def value_list_encode(spark: SparkSession, sf: str) -> DataFrame:
    return _lists(spark, sf)


_TOKENS = f"""with {_LISTS},
v as (select ID_ARC, pos, try_cast(nullif(split_part(list_extract(string_split(ids_segs_djma_val, '|'), pos), '@', 1), 'NA') as double) as value,
    try_cast(nullif(split_part(list_extract(string_split(ids_segs_djma_val_cam, '|'), pos), '@', 1), 'NA') as double) as truck, list_extract(string_split(ids_segs_rtss_type, '|'), pos) as cls, ids_segs_rtss_type is null as bare
    from (select *, unnest(range(1, len(string_split(ids_segs_djma_val, '|')) + 1)) as pos from lists))"""


@query(_TOKENS + "select ID_ARC, count(*)::int as n, sum(value) as total from v where value is not null group by ID_ARC")
def value_list_parse(spark: SparkSession, sf: str) -> DataFrame:
    values = _lists(spark, sf).select("ID_ARC", codec.parse_values(F.col(LIST[0])).alias("v"))
    return values.where(F.size("v") > 0).select("ID_ARC", F.size("v").alias("n"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query(_TOKENS + "select ID_ARC, pos::int as pos, value, truck as paired from v where value is not null")
def pair_list_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _lists(spark, sf).select("ID_ARC", F.inline(codec.parse_pairs(F.col(LIST[0]), F.col(LIST[1]))))


@query(
    _TOKENS
    + """, w as (select *, case cls when 'A' then 4 when 'N' then 3 else 1 end as w from v where bare or cls is not null),
g as (select ID_ARC, sum(value * w) / nullif(sum(w) filter (where value is not null), 0) as m, sum(truck * w) / nullif(sum(w) filter (where truck is not null), 0) as p, count(value)::int as n from w group by ID_ARC),
h as (select ID_ARC, round_even(m, 0)::bigint as djma_m3, case when m is not null then round_even(p * 10, 0) / 10 end as pct_cam_m3, coalesce(n, 0)::int as n_segs_m3 from lists left join g using (ID_ARC))
select ID_ARC, djma_m3, pct_cam_m3, round_even(djma_m3 * pct_cam_m3 / 100, 0)::bigint as djma_cam_m3, n_segs_m3 from h"""
)
def m3_positional_text(spark: SparkSession, sf: str) -> DataFrame:
    return methods.list_methods(_lists(spark, sf), weights=WEIGHTS).select("ID_ARC", "djma_m3", "pct_cam_m3", "djma_cam_m3", "n_segs_m3")


@query(
    _TOKENS
    + """, r as (select *, row_number() over (partition by ID_ARC order by value, pos) as r, count(*) over (partition by ID_ARC) as n from v where value is not null),
g as (select ID_ARC, sum(value) / count(*) as m1, count(*)::int as n, max(value) filter (where r = greatest(least(round_even(0.8::double * n, 0)::int, n), 1)) as m4, max(truck) filter (where r = greatest(least(round_even(0.8::double * n, 0)::int, n), 1)) as t4 from r group by ID_ARC),
p as (select ID_ARC, round_even(avg(truck) * 10, 0) / 10 as p from v group by ID_ARC)
select ID_ARC, round_even(m1, 0)::bigint as djma_m1, case when m1 is not null then p end as pct_cam_m1, coalesce(n, 0)::int as n_segs_m1, m4::bigint as djma_m4, round_even(t4 * 10, 0) / 10 as pct_cam_m4 from lists left join g using (ID_ARC) left join p using (ID_ARC)"""
)
def list_methods(spark: SparkSession, sf: str) -> DataFrame:
    return methods.list_methods(_lists(spark, sf), weights=WEIGHTS).select("ID_ARC", "djma_m1", "pct_cam_m1", "n_segs_m1", "djma_m4", "pct_cam_m4")


_TEXT = "(2015 + event_id % 10) || ' DJMA:' || value || ' / DJME:' || (event_id % 97) || ' / DJMH: ' || user_id || ' / %cam: / 30e h:7'"


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat((2015 + F.col("event_id") % 10).cast("string"), F.lit(" DJMA:"), F.col("value").cast("string"), F.lit(" / DJME:"), (F.col("event_id") % 97).cast("string"), F.lit(" / DJMH: "), F.col("user_id").cast("string"), F.lit(" / %cam: / 30e h:7"))
    return table(spark, sf, "events").select("event_id", "value", "user_id", text.alias("text"))


@query("select event_id, (2015 + event_id % 10)::varchar as annee, (event_id % 97)::varchar as djme, user_id::varchar as djmh, '' as cam, '7' as h30, '' as absent from events")
def year_text_extract(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda key, name: codec.component(F.col("text"), key).alias(name)
    return _texts(spark, sf).select("event_id", codec.leading_year(F.col("text")).alias("annee"), part("DJME", "djme"), part("DJMH", "djmh"), part("%cam", "cam"), part("30e h", "h30"), part("XYZ", "absent"))


@query("select event_id, (2015 + event_id % 10) || ' DJMA:' || case when event_id % 5 = 0 then '' else round_even(value * 10, 0)::bigint::varchar end || ' / DJME:' || (event_id % 97) || ' / DJMH:' || user_id || ' / %cam:' || case when event_id % 7 = 0 then '' else printf('%.1f', round_even((user_id % 40 + 0.125::double) * 10, 0) / 10) end || ' / 30e h:7' as annee_en_cours from events")
def year_text_build(spark: SparkSession, sf: str) -> DataFrame:
    djma, cam = F.when(F.col("event_id") % 5 != 0, F.col("value") * 10), F.when(F.col("event_id") % 7 != 0, F.col("user_id") % 40 + 0.125)
    return _texts(spark, sf).select("event_id", codec.year_record(F.col("text"), djma, cam, True).alias("annee_en_cours"))


_K = "json_extract_string(props, '$.k')::int"


@query(f"select event_id, case when event_id % 13 <> 0 and {_K} % 10 <> 0 then {_K}::double end as distance_m, case when event_id % 13 = 0 then 'erreur_api' when {_K} % 10 = 0 then 'echec_osrm' else 'ok' end as statut from events")
def route_json_parse(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources import layers

    k = F.get_json_object("props", "$.k")
    code = F.when(k.cast("int") % 10 == 0, "NoRoute").otherwise("Ok")
    text = F.concat(F.lit('{"code":"'), code, F.lit('","routes":[{"distance":'), k, F.lit(',"geometry":{"coordinates":[[-71.2,46.8],[-71.3,46.9]]}}]}'))
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 13 != 0, text).alias("response"))
    return layers.routes(rows).select("event_id", "distance_m", "statut")
