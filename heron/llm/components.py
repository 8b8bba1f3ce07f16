"""Connected components of a graph of any size by contraction rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, written

#: A node of more edges than these is a hub.
HUB = 20_000


def _carried(edges: DataFrame, to: DataFrame, end: str, name: str, hubs: int) -> DataFrame:
    """The edges with what one end went to. A hub's edges are no task's group: hubs, of which there are few, are broadcast."""
    names = to.select(F.col("node").alias(end), F.col("to").alias(name), "n")
    if not 0 < hubs <= BROADCAST_ROWS:
        return edges.join(names.drop("n"), end)
    hub, rest = F.broadcast(names.where(F.col("n") > HUB).drop("n")), names.where(F.col("n") <= HUB).drop("n")
    return edges.join(hub, end).unionByName(edges.join(hub.select(end), end, "left_anti").join(rest, end))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> node, label: equal for the nodes of a component. Nodes without an edge to another are
    left out; direction, repeats and loops don't matter.

    Each round every node joins the one of least hash among itself and its neighbours, and the edges are carried over
    to what was joined. Hashes change by the round, so a constant share of the nodes goes each time whatever the shape,
    and a hub costs no more than its edges: least hashes are aggregated before the shuffle. Each round is written to the
    shared folder.
    """
    spark = edges.sparkSession
    left = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    joined: list[DataFrame] = []
    for k in range(rounds):
        if left.isEmpty():
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c, k=k: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("x"))
        to = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(rank("b")), F.min(rank("a"))).getField("x").alias("to"), F.count("*").alias("n"))
        to = written(to, "joined")
        joined.append(to)
        hubs = to.where(F.col("n") > HUB).count()
        moved = _carried(_carried(left, to, "a", "na", hubs), to, "b", "nb", hubs).where("na <> nb")
        moved = moved.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct()
        left = written(moved, "edges")
    else:
        if not left.isEmpty():
            raise RuntimeError(f"components are not closed after {rounds} rounds")
    if not joined:
        return spark.createDataFrame([], "node long, label long")
    # From the last round back: where a node went, and where that went.
    out = joined[-1].select("node", F.col("to").alias("label"))
    for to in reversed(joined[:-1]):
        later = out.select(F.col("node").alias("to"), F.col("label").alias("_later"))
        out = to.drop("n").join(later, "to", "left").select("node", F.coalesce("_later", "to").alias("label"))
    return out
