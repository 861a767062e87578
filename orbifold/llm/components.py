"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Stored


def components(links: DataFrame) -> DataFrame:
    """(id, component), stored, for every id that occurs in ``links`` (a, b); component is the smallest id reachable.

    Each round points every node at its neighbour of least hash (or itself) and replaces links by
    links between the pointed-at nodes; as hashes are drawn anew in each round, long chains shrink by
    a constant factor a round as well. Minima are aggregated before the shuffle, and the links of a hub
    join a table with one row per node, which adaptive execution splits. The tables of a round go as soon
    as the next one has been made. Links with a null end and self links are ignored; an empty table gives
    an empty result."""

    def ordered(a: Column, b: Column) -> tuple[Column, Column]:
        return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")

    links = links.where(F.col("a") != F.col("b"))
    edges = Stored(links.select(*ordered(F.col("a"), F.col("b"))).distinct(), "edges")
    maps: list[Stored] = []
    while not maps or not edges.df.isEmpty():
        seed = F.lit(len(maps))

        def drawn(c: str, seed: Column = seed) -> Column:
            return F.struct(F.xxhash64(seed, F.col(c)).alias("h"), F.col(c).alias("id"))

        both = edges.df.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.df.select("b", "a"))
        least = both.groupBy("u").agg(F.min(drawn("v")).alias("m"))
        parent = Stored(least.select("u", F.least(F.col("m"), drawn("u"))["id"].alias("p")), "parents")
        maps.append(parent)
        moved = edges.df.join(parent.df.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a").join(parent.df.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
        moved = Stored(moved.where(F.col("pa") != F.col("pb")).select(*ordered(F.col("pa"), F.col("pb"))).distinct(), "edges")
        edges.discard()
        edges = moved
    edges.discard()
    roots = maps[-1].df.select("u", F.col("p").alias("root"))
    for m in reversed(maps[:-1]):
        later = roots.select(F.col("u").alias("p"), "root")
        roots = m.df.join(later, "p", "left").select("u", F.coalesce("root", "p").alias("root"))
    told = Stored(roots, "roots")
    first = Stored(told.df.groupBy("root").agg(F.min("u").alias("component")), "roots")  # stored, so that a large component's join can be split
    out = Stored(told.df.join(first.df, "root").select(F.col("u").alias("id"), "component"), "components")
    for table in (told, first, *maps):
        table.discard()
    return out.df
