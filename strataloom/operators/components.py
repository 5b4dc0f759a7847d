"""Connected components on edge tables, without gathering any component.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014).  A node's smallest neighbour comes
from a grouped minimum, which is combined on the map side, so a hub with many
neighbours costs no more than its share; the join back is one Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, stored

#: Edges up to which Spark may broadcast a round's table of nodes (about 90 bytes each).
#: It goes by the size of files, where many ids take few bytes.
BROADCAST_EDGES = 100_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(src, dst) longs to (node, label): label is the smallest node of the component.

    Direction, repeats and self-loops do not matter; rows with a null end are
    ignored.  Nodes without an edge are not in the result, and no edges give no
    rows.  ``rows`` is about how many edges there are at most, if that is known.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    e = stored(e, "edges", rows)
    before = _state(e)
    while before[0]:
        merge = before[0] > BROADCAST_EDGES
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("src", "m"))
        large = both.join(least.hint("merge") if merge else least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        # Every edge now points from the larger to the smaller node.
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low.hint("merge") if merge else low, "src")
        small = small.select(F.col("src"), F.col("m").alias("dst")).unionByName(
            small.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        )
        new = stored(small.distinct(), "edges", 2 * before[0])
        after = _state(new)
        discard(e)
        e = new
        if after == before:
            break
        before = after
    return e.select(F.col("src").alias("node"), F.col("dst").alias("label")).unionByName(
        e.select(F.col("dst").alias("node"), F.col("dst").alias("label")).distinct()
    )
