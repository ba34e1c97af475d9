"""Trees kept as rows (element, parent), walked by recursive queries."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import cut

#: Levels a tree may have.
LEVELS = 1000


@contextmanager
def _deep(spark: SparkSession, levels: int):
    """Recursion as deep as ``levels`` and of any number of rows, for the query that runs inside."""
    limits = {"spark.sql.cteRecursionLevelLimit": str(levels), "spark.sql.cteRecursionRowLimit": "-1"}
    before = {k: spark.conf.get(k, None) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def below(elements: DataFrame, top: Column, id_: str = "id", parent: str = "parent", levels: int = LEVELS) -> DataFrame:
    """(id, levels): the elements under any of those that ``top`` holds for, at whatever depth, and how far below the nearest of them.

    Elements whose parent is null or not in the table are roots.  A group
    within another group's tree counts under that one.  Each level is a join
    on the parent; a tree deeper than ``levels``, or one with a ring, is an error.
    """
    spark = elements.sparkSession
    rows = cut(elements.select(F.col(id_).alias("id"), F.col(parent).alias("parent"), F.coalesce(top, F.lit(False)).alias("top")))
    walk = """
        with recursive found(id, levels) as (
            select id, 0 from {rows} where top
            union all select e.id, f.levels + 1 from {rows} e join found f on e.parent = f.id)
        select id, levels from found where levels > 0"""
    with _deep(spark, levels):
        return cut(spark.sql(walk, rows=rows).groupBy("id").agg(F.min("levels").alias("levels")))


def depth_first(elements: DataFrame, order: str, id_: str = "id", parent: str = "parent", width: int = 12, levels: int = LEVELS) -> DataFrame:
    """(id, depth, path): sorted by path, elements come depth first, those of one parent by ``order`` (a LONG, 0 or more).

    path: the order numbers from the root down, ``width`` digits each.  Rows
    that no root leads to are left out.
    """
    spark = elements.sparkSession
    rows = cut(elements.select(F.col(id_).alias("id"), F.col(parent).alias("parent"), F.lpad(F.col(order).cast("string"), width, "0").alias("step")))
    walk = """
        with recursive walked(id, depth, path) as (
            select id, 0, step from {rows} where parent is null
            union all select e.id, w.depth + 1, concat(w.path, '/', e.step) from {rows} e join walked w on e.parent = w.id)
        select id, depth, path from walked"""
    with _deep(spark, levels):
        return cut(spark.sql(walk, rows=rows))
