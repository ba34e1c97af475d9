"""Queries on links, nodes, classes and project layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import project, trees
from .registry import query, table

PREFIXES = {"https://m.": "mobile://", "https://": "secure://", "http://": "plain://"}
LABELS = {"en": "anglais", "fr": "français"}
CLASSES = ["ECONOMY", "SMALL", "LARGE", "Autre"]


@query("select p_partkey, " + ", ".join(f"(case when p_type in ('ECONOMY', 'SMALL', 'LARGE') then p_type else 'Autre' end = '{c}')::int::double as route_{c}" for c in CLASSES) + " from part")
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", *[v.alias(k) for k, v in codec.one_hot(F.col("p_type"), CLASSES).items()])


@query("select p_partkey, case when p_type in ('ECONOMY', 'SMALL', 'LARGE') then p_type else 'Autre' end as classe from part")
def one_hot_decode(spark: SparkSession, sf: str) -> DataFrame:
    hot = one_hot(spark, sf)
    return hot.select("p_partkey", codec.one_hot_decode([f"route_{c}" for c in CLASSES]).alias("classe"))


@query("select c_nationkey as id from customer union select s_nationkey from supplier")
def endpoints_union(spark: SparkSession, sf: str) -> DataFrame:
    a, b = table(spark, sf, "customer").select(F.col("c_nationkey").alias("id")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("id"))
    return a.union(b).distinct()


@query("select n_nationkey, n_name from nation where n_nationkey in (select c_nationkey from customer union select s_nationkey from supplier)")
def nodes_semi(spark: SparkSession, sf: str) -> DataFrame:
    a, b = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, sf, "nation").join(a.union(b), "n_nationkey", "left_semi").select("n_nationkey", "n_name")


@query("select count(distinct o_orderkey) as arcs, (select count(*) from (select c_nationkey from customer union select s_nationkey from supplier)) as nodes from orders")
def graph_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = endpoints_union(spark, sf).agg(F.count("*").alias("nodes"))
    return table(spark, sf, "orders").agg(F.count_distinct("o_orderkey").alias("arcs")).crossJoin(F.broadcast(n))


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def sources_anti(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_anti")


@query("select o_orderkey as ID_ARC, a.n_name as ville_a, b.n_name as ville_b, case when a.n_nationkey is null or b.n_nationkey is null then 'noeud_manquant' else 'ok' end as statut from orders left join nation a on a.n_nationkey = o_orderkey % 30 left join nation b on b.n_nationkey = o_custkey % 30")
def role_join_status(spark: SparkSession, sf: str) -> DataFrame:
    """Both ends of every link looked up in the small table of nodes; a link whose end is missing fails."""
    nodes = table(spark, sf, "nation")
    end = lambda x: nodes.select(F.col("n_nationkey").cast("long").alias(f"id_{x}"), F.col("n_name").alias(f"ville_{x}"), F.lit(True).alias(f"has_{x}"))
    links = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ID_ARC"), (F.col("o_orderkey") % 30).alias("id_a"), (F.col("o_custkey") % 30).alias("id_b"))
    both = links.join(end("a"), "id_a", "left").join(end("b"), "id_b", "left")
    return both.select("ID_ARC", "ville_a", "ville_b", F.when(F.col("has_a").isNull() | F.col("has_b").isNull(), "noeud_manquant").otherwise("ok").alias("statut"))


@query("select page_id, case " + " ".join(f"when starts_with(url, '{a}') then '{b}' || substr(url, {len(a) + 1})" for a, b in PREFIXES.items()) + " else url end as datasource, " + " or ".join(f"starts_with(url, '{a}')" for a in PREFIXES) + " as migrated from pages")
def prefix_migrate(spark: SparkSession, sf: str) -> DataFrame:
    layers = table(spark, sf, "pages").select("page_id", F.col("url").alias("datasource"))
    return project.migrate_sources(layers, PREFIXES).select("page_id", "datasource", "migrated")


@query("select doc_id, " + f"case lang {' '.join(f'when {chr(39)}{a}{chr(39)} then {chr(39)}{b}{chr(39)}' for a, b in LABELS.items())} else lang end as layer_name, coalesce(lang in ('en', 'fr'), false) as renamed from documents")
def label_rename(spark: SparkSession, sf: str) -> DataFrame:
    layers = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("layer_name"))
    return project.rename_labels(layers, LABELS).select("doc_id", "layer_name", "renamed")


@query("select coalesce(case lang when 'en' then 'anglais' when 'fr' then 'français' end, lang) as group_name, count(*) as n from documents group by 1")
def group_rename(spark: SparkSession, sf: str) -> DataFrame:
    layers = table(spark, sf, "documents").select(F.col("lang").alias("group_name"))
    return project.rename_groups(layers, LABELS).groupBy("group_name").agg(F.count("*").alias("n"))


@query("select doc_id, source from documents where doc_id not in (select doc_id from documents where lang = 'de')")
def removed_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Layers of a legacy group purged from the map."""
    layers = table(spark, sf, "documents").select(F.col("doc_id").alias("layer_id"), F.col("lang").alias("group_name"), "source")
    gone = project.removed_ids(layers, "de")
    return project.purge(layers.select("layer_id", "source"), gone).withColumnRenamed("layer_id", "doc_id")


@query("select n_nationkey, n_name from nation where regexp_matches(n_name, '_[1-3].?$')")
def regex_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").where(F.col("n_name").rlike("_[1-3].?$")).select("n_nationkey", "n_name")


_PARENT = "case when doc_id > 0 then (doc_id - 1) // 3 end"


def _elements(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a tree: each but the first under the one of a third of its number."""
    parent = F.when(F.col("doc_id") > 0, F.floor((F.col("doc_id") - 1) / 3).cast("long"))
    return table(spark, sf, "documents").select("doc_id", "lang", parent.alias("parent"))


@query(f"with recursive e as (select doc_id, lang, {_PARENT} as parent from documents), b as (select doc_id, 0 as levels from e where lang = 'de' union select e.doc_id, b.levels + 1 from e join b on e.parent = b.doc_id) select doc_id, min(levels) as levels from b where levels > 0 group by doc_id")
def tree_ids(spark: SparkSession, sf: str) -> DataFrame:
    """All layers under the groups of one name, however deep."""
    return trees.below(_elements(spark, sf), F.col("lang") == "de", "doc_id").withColumnRenamed("id", "doc_id")


@query(f"with recursive e as (select doc_id, {_PARENT} as parent from documents), w as (select doc_id, 0 as depth, lpad(doc_id::varchar, 12, '0') as path from e where parent is null union all select e.doc_id, w.depth + 1, w.path || '/' || lpad(e.doc_id::varchar, 12, '0') from e join w on e.parent = w.doc_id) select * from w")
def tree_order(spark: SparkSession, sf: str) -> DataFrame:
    """The elements with the path that lists them depth first."""
    return trees.depth_first(_elements(spark, sf), "doc_id", "doc_id").withColumnRenamed("id", "doc_id")
