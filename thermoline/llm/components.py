"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermoline.session import materialize


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for each id in `links` (columns a, b): the smallest id it is linked with.

    Alternates two steps until every link leads from an id to its component: every id hands its
    smallest neighbour to its larger neighbours, then to its smaller ones. The number of rounds
    grows with the logarithm of the longest chain; links that are stars already take none. Each
    round is written to the shared folder; links of an id with very many neighbours are dealt by
    AQE's skewed joins, as each id has one row on the other side. Links with a null end and links
    of an id with itself say nothing.
    """
    links = links.where("a != b").select(
        F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    links = materialize(links, "links")
    for _ in range(rounds):
        if _settled(links):
            break
        links = materialize(_small_star(_large_star(links)), "links")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # All links now lead from an id to its component.
    return links.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionAll(
        links.select("lo", "lo").distinct())


def _settled(links: DataFrame) -> bool:
    """Whether no id is linked with two smaller ones, or with a smaller and a larger one."""
    ends = links.select(F.col("hi").alias("id"), F.lit(1).alias("up"), F.lit(0).alias(
        "down")).unionAll(links.select("lo", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where(
        "up > 1 or up = 1 and down = 1").count() == 0


def _large_star(links: DataFrame) -> DataFrame:
    """Each id's larger neighbours are linked with its smallest neighbour or with itself."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
        links.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(
        "u", F.least("u", "m").alias("m"))
    return links.join(least, links["lo"] == least["u"]).select("hi", F.col("m").alias("lo"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each id and its smaller neighbours are linked with the smallest of them."""
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = links.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col(
        "m").alias("lo"))
    return moved.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()
