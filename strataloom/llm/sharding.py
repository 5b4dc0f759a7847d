"""Sharding by a hierarchical weighted hash tree (region, rack, shard).

At each level every child draws ``-ln(u) / weight`` with ``u`` hashed from the
row's key and the child's name, and the smallest draw wins.  A child is chosen
in proportion to its weight, and its draw depends on nothing but itself; when a
weight grows, rows move only towards the child that grew.  An inner node weighs
what its shards weigh, so a change moves rows only into or out of the subtrees
on the path to it.

``grow`` adds a shard in a region of its own, whatever tree it is given.  The new
region is then the only child whose weight changes, and all its rows are the new
shard's, so growth by one moves rows only into the new shard, again and again.
(A shard added inside an existing region would also pull rows to its neighbours
there; ``tree`` with another count does that.)
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import stored, table

#: Sub-lists per shard, so that slots are numbered by many tasks.
SLOT_LISTS = 1024
#: Copies of one row (same id and text) beyond which they are numbered apart.
COPIES = 50_000
#: Rows of the table of list starts that may be broadcast (about 60 bytes each).
BROADCAST_STARTS = 1 << 19


def tree(shards: int, per_rack: int = 2, racks: int = 2, weights: dict[int, float] | None = None) -> dict:
    """{region: {rack: {shard: weight}}}, filled in order of shard number."""
    out: dict = {}
    for s in range(shards):
        rack, region = s // per_rack, s // per_rack // racks
        out.setdefault(f"region{region}", {}).setdefault(f"rack{rack}", {})[s] = (weights or {}).get(s, 1.0)
    return out


def shards_of(node: dict) -> list[int]:
    return [s for child in node.values() for s in shards_of(child)] if isinstance(next(iter(node.values()), 0.0), dict) else list(map(int, node))


def grow(node: dict, share: float = 1.0) -> dict:
    """The tree with one more shard, the next number, in a region of its own."""
    new = max(shards_of(node), default=-1) + 1
    return {**node, f"region of {new}": {f"rack of {new}": {new: share}}}


def weight(node) -> float:
    return sum(map(weight, node.values())) if isinstance(node, dict) else float(node)


def _draw(key: Column, name: Column, w: Column) -> Column:
    # 53 bits, never zero.
    u = (F.shiftrightunsigned(F.xxhash64(key, name), 11).cast("double") + 1.0) / float(2**53 + 1)
    return -F.log(u) / w


def levels(node: dict) -> list[list[list[dict]]]:
    """Per level and node of the level above: its children with a weight.

    A child has its path, its weight and its place in the level (a shard: its
    number).  All shards lie at one depth.
    """
    out, nodes = [], [("", node)]
    while nodes and isinstance(nodes[0][1], dict):
        level, below = [], []
        for path, n in nodes:
            live = [(f"{path}/{name}", name, child) for name, child in n.items() if weight(child) > 0]
            if not live:
                raise ValueError(f"no weight under {path or 'the root'}")
            level.append([{"path": p, "w": weight(c), "i": len(below) + k if isinstance(c, dict) else int(name)} for k, (p, name, c) in enumerate(live)])
            below += [(p, c) for p, _, c in live]
        out.append(level)
        nodes = below
    return out


def choose(key: Column, node: dict) -> Column:
    """The shard number that ``key`` descends to; children of weight 0 get nothing.

    Each level is one constant array and one minimum over the children of the
    node that was reached, so the expression does not grow with the tree.
    """
    at = F.lit(0)
    for level in levels(node):
        children = F.get(F.from_json(F.lit(json.dumps(level)), "array<array<struct<path:string,w:double,i:int>>>"), at)
        at = F.array_min(F.transform(children, lambda c: F.struct(_draw(key, c.path, c.w).alias("d"), c.i.alias("i")))).i
    return at


def assign(
    docs: DataFrame, now: dict, grown: dict | None = None, doc_id: str = "doc_id", text: str = "text", lists: int = SLOT_LISTS, copies: int = COPIES
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard) per row.

    The shard depends on the id and the tree alone; a null id hashes as a value
    of its own.  size is the text's UTF-8 bytes plus 1, a null text has none.
    Slots number the rows of a shard from 0 without gaps, in an order fixed by
    id and text alone, however the rows are split over files; rows that repeat id
    and text take neighbouring slots in either order.  Other columns are ignored;
    no rows give no rows.

    The text is read once.  Slots come from ``lists`` sub-lists per shard, whose
    offsets are a table of at most shards x lists rows, whatever the input.  A
    row with more than ``copies`` copies stands in its list as one row of that
    many slots; its copies are numbered by input partition.
    """
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("\x00null"))
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        size.alias("size"),
        crc.alias("text_crc32"),
        choose(key, now).alias("shard"),
        (choose(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.pmod(F.xxhash64(key, crc, size), F.lit(lists)).cast("int").alias("part"),
        F.spark_partition_id().alias("split"),
    )
    rows = stored(rows, "shards")
    content = ["shard", "part", "doc_id", "text_crc32", "size"]
    counts = stored(rows.groupBy("shard", "part").agg(F.count("*").alias("n")), "lists")
    # Only a list of more than ``copies`` rows can hold that many copies of one row.
    large = counts.where(F.col("n") > copies).select("shard", "part")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in content]
    few = len(shards_of(now)) * lists <= BROADCAST_STARTS

    def small(df):
        return F.broadcast(df) if few else df

    hot = rows.join(small(large), ["shard", "part"]).groupBy(*content, "split").agg(F.count("*").alias("n"))
    hot = stored(hot.withColumn("total", F.sum("n").over(Window.partitionBy(*content))).where(F.col("total") > copies), "copies")
    starts = counts.select(
        "shard",
        "part",
        (F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("first"),
    )
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    one = rows.withColumn("n", F.lit(1).cast("long")).withColumn("hot", F.lit(False))
    is_hot = not hot.isEmpty()
    if is_hot:
        # There are at most rows / copies such contents, each with a row per input partition.
        kinds = hot.groupBy(*content).agg(F.first("total").alias("n"))
        one = one.alias("l").join(kinds.alias("r"), same, "left_anti").select("doc_id", "size", "text_crc32", "shard", "grown_shard", "part", "n", "hot")
        one = one.unionByName(kinds.select("doc_id", "size", "text_crc32", "shard", F.lit(None).cast("int").alias("grown_shard"), "part", "n", F.lit(True).alias("hot")))
    placed = one.withColumn("place", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    placed = placed.join(small(starts), ["shard", "part"]).withColumn("slot", F.col("first") + F.col("place"))
    out = ["doc_id", "size", "text_crc32", "shard", "slot", "grown_shard"]
    if not is_hot:
        return placed.select(*out)
    before = hot.withColumn("before", F.sum("n").over(Window.partitionBy(*content).orderBy("split").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    begin = placed.where("hot").select(*content, "slot").alias("l").join(before.alias("r"), same).select(*[f"l.{c}" for c in content], "r.split", (F.col("slot") + F.col("before")).alias("begin"))
    kinds_rows = rows.alias("l").join(begin.alias("r"), [*same, F.col("l.split") == F.col("r.split")]).select("l.*", "r.begin")
    numbered = kinds_rows.withColumn("slot", F.col("begin") + F.row_number().over(Window.partitionBy(*content, "split").orderBy("split")) - 1)
    return placed.where(~F.col("hot")).select(*out).unionByName(numbered.select(*out))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by the law ``key``, and with one shard more.

    Null texts have no bytes; a null id is a key of its own; repeated rows take
    neighbouring slots; an empty table gives no rows; other columns are ignored;
    a text of any length is one size and one checksum.
    """
    now = tree(16)
    placed = assign(table(spark, sf_dir, "documents"), now, grow(now))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
