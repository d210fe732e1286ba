"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopygrid.llm.tables import stored


def _state(edges: DataFrame) -> tuple:
    """Tells two sets of edges apart."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor("b")).first())


def _star(pairs: DataFrame, spread: DataFrame) -> DataFrame:
    """Join each row of ``spread`` (a, b) with the least neighbour ``low`` that ``pairs`` gives its a.

    The minima are written first: both sides of the join are then plain tables,
    whose heavy keys Spark splits.
    """
    low = stored(pairs.groupBy("a").agg(F.min("b").alias("low")), "components-low")
    return spread.join(low, "a")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long) that is not itself a root.

    A root is its component's smallest node. Alternates large and small stars:
    neighbours above a node, then those below it, are hung on the least node
    near it, until nothing changes; the number of rounds grows as the square of
    the logarithm of the longest path at most. Loops and repeated edges do no
    harm, null ends are dropped, and no edge gives no row.
    """
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    down = stored(edges.sparkSession.createDataFrame([], "a long, b long").union(
        down.filter("a IS NOT NULL AND b IS NOT NULL AND a > b").distinct()
    ), "components")
    state = _state(down)
    while state[0]:
        both = down.union(down.select("b", "a"))
        large = (
            _star(both, both)
            .filter("b > a")
            .select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
            .filter("a > b")
            .distinct()
        )
        large = stored(large, "components")
        hung = _star(large, large)
        rows = F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))
        down = stored(hung.select(F.inline(rows)).filter("a > b").distinct(), "components")
        before, state = state, _state(down)
        if before == state:
            break
    return down.select(F.col("a").alias("node"), F.col("b").alias("root"))
