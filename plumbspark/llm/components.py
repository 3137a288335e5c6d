"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbspark.llm.storage import cut


def component_roots(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that every node of ``edges`` (``a``, ``b``; bigint) reaches.

    Alternates the two star operations: every node hands its larger neighbours, then itself
    and its smaller ones, to its smallest neighbour, until each component is one star.
    Rounds grow with the logarithm of the nodes; edges that are stars of their smallest nodes
    need none.  Every round is two aggregations and two joins on rows, of which a hub's rows can
    be split, and its edges are written to the checkpoint folder.  Each of its exchanges deals out
    every edge once, as the files of an exchange stay until the driver collects its garbage.
    Nodes without an edge are not returned.
    """

    def both(pairs: DataFrame, a: tuple[str, ...], b: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
        """Two rows for each pair: the columns ``a``, and ``b``."""
        row = lambda values: F.struct(*[F.expr(x).alias(name) for x, name in zip(values, names, strict=True)])
        return pairs.select(F.inline(F.array(row(a), row(b))))

    def stars(pairs: DataFrame) -> bool:
        """Whether no node with a smaller neighbour has another one."""
        ends = both(pairs, ("a", "1"), ("b", "0"), ("node", "up"))
        return ends.groupBy("node").agg(F.max("up").alias("up"), F.count("*").alias("n")).where("up = 1 and n > 1").isEmpty()

    def large_star(pairs: DataFrame) -> DataFrame:
        least = both(pairs, ("a", "b"), ("b", "b"), ("u", "v")).groupBy("u").agg(F.min("v").alias("m"))
        return pairs.join(least, pairs.b == least.u).select("a", F.col("m").alias("b"))

    def small_star(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        joined = pairs.join(least, pairs.a == least.u)
        return both(joined, ("a", "m"), ("b", "m"), ("a", "b")).where("a <> b").distinct()

    pairs = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not stars(pairs):
        pairs = cut(small_star(large_star(pairs)))
    return both(pairs, ("a", "b"), ("b", "b"), ("node", "root")).groupBy("node").agg(F.min("root").alias("root"))
