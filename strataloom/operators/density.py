"""Density clustering of vectors: hierarchical, exact, without a bound on the rows.

Distances are those of unit vectors.  Two rows are as far apart as the largest of
their distance and their core distances (to the ``samples``-th nearest row).  A
minimum spanning tree of these distances comes from Borůvka rounds over blocked
products; its edges, in order, are swept into the condensed tree in ranges of
bounded length; and the clusters are those with the most excess of mass
(Campello, Moulavi, Sander, 2013).  Many dimensions are reduced first, by the
eigenvectors of a Gram matrix that tasks add up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..storage import discard, stored
from . import joins as jo
from .components import components
from .ranking import positions

#: Smaller distances count as this one: copies are not infinitely dense.
FLOOR = 1e-7
#: Edges that one task sweeps, and bytes of projections that are broadcast at a time.
EDGES = 500_000
BROADCAST_BYTES = 64 << 20


def _group(group: str | None) -> Column:
    return (F.col(group) if group else F.lit("")).cast("string")


def reduce_dimensions(df: DataFrame, key: str, vector: str, dims: int = 64, above: int = 5000, group: str | None = None) -> DataFrame:
    """(id, g, v): vectors on the ``dims`` directions that keep most of their square sum, unit length.

    That is a truncated singular value decomposition without centring.  Only
    groups of more than ``above`` rows and more than ``dims`` dimensions are
    projected; vectors of the others are as they are, at unit length.  Rows with
    a null id, group or vector are left out; a zero vector stays zero.
    """
    own = df.select(F.col(key).cast("long").alias("id"), _group(group).alias("g"), vx.normalize(F.col(vector)).alias("v")).where("id is not null and g is not null and v is not null")
    sizes = own.groupBy("g").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).where((F.col("n") > above) & (F.col("d") > dims))
    wide = stored(sizes, "wide-groups")
    if wide.isEmpty():
        return own

    def gram(batches):
        sums: dict[str, np.ndarray] = {}

        def send():
            for g, m in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(m)), pa.array(range(len(m)), pa.int32()), pa.array([r.tobytes() for r in m], pa.binary())], names=["g", "i", "row"])
            sums.clear()

        for b in batches:
            rows = pd.DataFrame({"g": b.column(0).to_pylist(), "v": b.column(1).to_pylist()})
            for g, part in rows.groupby("g"):
                x = np.array(part["v"].tolist(), dtype=np.float64)
                sums[g] = sums[g] + x.T @ x if g in sums else x.T @ x
            if sum(m.nbytes for m in sums.values()) > BROADCAST_BYTES:
                yield from send()
        yield from send()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(r) for r in pdf["row"]], axis=0)
        return pd.DataFrame({"g": pdf["g"][:1], "i": pdf["i"][:1], "row": [total.tobytes()]})

    def directions(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.array([np.frombuffer(r) for r in pdf.sort_values("i")["row"]])
        _, vectors = np.linalg.eigh((m + m.T) / 2)
        return pd.DataFrame({"g": pdf["g"][:1], "d": [len(m)], "basis": [np.ascontiguousarray(vectors[:, ::-1][:, :dims]).tobytes()]})

    # A task sends a matrix of d x d, whatever its rows; d rows of sums meet per group.
    parts = own.join(wide.select("g"), "g", "left_semi").select("g", "v").mapInArrow(gram, "g string, i int, row binary")
    summed = parts.groupBy("g", "i").applyInPandas(add, "g string, i int, row binary")
    bases = stored(summed.groupBy("g").applyInPandas(directions, "g string, d int, basis binary"), "bases").withColumn("bytes", F.length("basis"))
    out = own.join(wide.select("g"), "g", "left_anti").select("id", "g", "v")
    # Bases are broadcast so many at a time that they stay below the bound.
    numbered = positions(bases, [F.col("g")], "at").withColumn("turn", F.floor(F.col("at") / F.greatest(F.lit(1), F.floor(F.lit(BROADCAST_BYTES) / F.lit(bases.agg(F.max("bytes")).first()[0])))))
    for turn in range(int(numbered.agg(F.max("turn")).first()[0]) + 1):
        some = {r.g: np.frombuffer(r.basis).reshape(r.d, -1) for r in numbered.where(F.col("turn") == turn).collect()}
        shipped = df.sparkSession.sparkContext.broadcast(some)

        def project(batches, shipped=shipped):
            for b in batches:
                g = b.column(1).to_pylist()
                vs = []
                for name, v in zip(g, b.column(2).to_pylist()):
                    x = np.array(v) @ shipped.value[name]
                    n = np.linalg.norm(x)
                    vs.append((x / n if n > 0 else x).tolist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(vs, pa.list_(pa.float64()))], names=["id", "g", "v"])

        mine = own.join(F.broadcast(numbered.where(F.col("turn") == turn).select("g")), "g", "left_semi").select("id", "g", "v")
        out = out.unionByName(mine.mapInArrow(project, "id long, g string, v array<double>"))
    return out


def distance(sim):
    """Of unit vectors with this dot product; rounded first, so that copies have distance 0."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.round(sim, 12)))


def core_distances(rows: DataFrame, samples: int) -> DataFrame:
    """(id, core): distance to the ``samples``-th nearest other row of the group, or to the farthest of fewer."""
    near = jo.knn(rows, rows, samples, "id", "v", group="g")
    sim = F.round(F.min("sim"), 12)
    return near.groupBy("id").agg(F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * sim)).alias("core"))


def spanning_tree(rows: DataFrame, samples: int) -> DataFrame:
    """(a, b, w): the minimum spanning trees of the groups of (id, g, v), a < b.

    Edges are ordered by (w, a, b), so the tree is unique.  In each round every
    component takes its lowest edge to another one: at least half of them merge,
    so there are at most log2(rows) rounds.
    """
    rows = rows.join(core_distances(rows, samples), "id", "left").withColumn("core", F.coalesce("core", F.lit(0.0)))
    rows = stored(rows.select("id", "g", F.lit("").alias("a"), "v", "core"), "density-rows")
    comps = rows.select("id", F.col("id").alias("comp"))
    names = ["comp", "w", "lo", "hi", "other"]

    def search(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        same = p["i"].iloc[0] == p["j"].iloc[0]
        p, q = (t.sort_values("id", kind="stable") for t in (p, q))
        sides = [{c: t[c].to_numpy() for c in ("id", "core", "comp")} for t in (p, q)]
        best = [np.full(len(t), np.inf) for t in (p, q)]
        to = [np.zeros(len(t), dtype=np.int64) for t in (p, q)]  # place of the partner
        x, y = sides
        for r, c, sim in jo._tiles(p, q):
            w = np.maximum(np.maximum(distance(sim), x["core"][r, None]), y["core"][None, c])
            w[x["comp"][r, None] == y["comp"][None, c]] = np.inf
            if same:
                w[x["id"][r, None] >= y["id"][None, c]] = np.inf
            for side, here, axis, first in ((0, r, 1, c.start), (1, c, 0, r.start)):
                at = w.argmin(axis=axis)
                low = np.take_along_axis(w, np.expand_dims(at, axis), axis).squeeze(axis)
                # Partners come in the order of ids, so the first of equal ones stays.
                new = low < best[side][here]
                best[side][here] = np.where(new, low, best[side][here])
                to[side][here] = np.where(new, at + first, to[side][here])
        out = []
        for side in (0, 1):
            mine, theirs = sides[side], sides[1 - side]
            k = np.flatnonzero(np.isfinite(best[side]))
            a, b = mine["id"][k], theirs["id"][to[side][k]]
            out.append(pd.DataFrame(dict(zip(names, (mine["comp"][k], best[side][k], np.minimum(a, b), np.maximum(a, b), theirs["comp"][to[side][k]])))))
        both = pd.concat(out, ignore_index=True).sort_values(["comp", "w", "lo", "hi"], kind="stable")
        return both.drop_duplicates("comp")

    tree: list[DataFrame] = []
    while True:
        side = rows.join(comps, "id").select("id", "g", "a", "v", "core", "comp")
        found = jo._blocked(side, side, search, "comp long, w double, lo long, hi long, other long", jo.BLOCK, half=True)
        low = stored(found.groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("e")).select("comp", "e.*"), "lowest-edges")
        if low.isEmpty():
            break
        tree.append(low.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "w").distinct())
        joined = components(low.select(F.col("comp").alias("src"), F.col("other").alias("dst")))
        old, comps = comps, stored(comps.join(joined.select(F.col("node").alias("comp"), "label"), "comp", "left").select("id", F.coalesce("label", "comp").alias("comp")), "components")
        if len(tree) > 1:
            discard(old)
    out = rows.sparkSession.createDataFrame([], "a long, b long, w double")
    for t in tree:
        out = out.unionByName(t)
    return out


class Sweep:
    """Merges components along sorted edges and keeps what the condensed tree needs.

    A component has ``size`` rows.  From ``least`` rows on it is a branch
    (``chain``) of the condensed tree, with ``mass``, the sum over the rows that
    have left it so far of 1 / distance at which they left, and ``below``, the
    best that the branches under it reach (None for a leaf).
    """

    def __init__(self, least: int):
        self.least = least
        self.parent: dict[int, int] = {}
        self.state: dict[int, tuple] = {}
        #: (row or component, component it is part of from then on), while both are small.
        self.links: list[tuple[int, int]] = []
        #: (component, chain it leaves to noise or grows into).
        self.falls: list[tuple[int, int]] = []
        #: (chain, chain above, whether it beats what is below it).
        self.chains: list[tuple[int, int, bool]] = []

    def know(self, rep: int, size, chain, mass, below) -> None:
        if rep not in self.parent:
            self.parent[rep] = rep
            self.state[rep] = (1, None, 0.0, None) if size is None else (size, chain, mass, below)

    def find(self, rep: int) -> int:
        while self.parent[rep] != rep:
            self.parent[rep] = self.parent[self.parent[rep]]
            rep = self.parent[rep]
        return rep

    def merge(self, a: int, b: int, w: float, edge: int) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        (na, ca, ma, ba), (nb, cb, mb, bb) = self.state[a], self.state.pop(b)
        self.parent[b] = a
        lam, n = 1.0 / max(w, FLOOR), na + nb
        if ca is not None and cb is not None:
            total = 0.0
            for size, chain, mass, below in ((na, ca, ma, ba), (nb, cb, mb, bb)):
                own = mass - lam * size
                wins = below is None or own >= below
                self.chains.append((chain, edge, wins))
                total += own if wins else below
            self.state[a] = (n, edge, lam * n, total)
        elif ca is not None or cb is not None:
            chain, mass, below, small, rep = (ca, ma, ba, nb, b) if ca is not None else (cb, mb, bb, na, a)
            self.falls.append((rep, chain))
            self.state[a] = (n, chain, mass + lam * small, below)
        elif n >= self.least:
            self.falls += [(a, edge), (b, edge)]
            self.state[a] = (n, edge, lam * n, None)
        else:
            self.links.append((b, a))
            self.state[a] = (n, None, 0.0, None)


EVENT = "kind string, node long, target long, wins boolean, size long, chain long, mass double, below double"


def condensed(tree: DataFrame, least: int, edges: int = EDGES) -> DataFrame:
    """Events of the condensed tree of (a, b, w), stored: links, falls and chains (see ``Sweep``).

    Edges are swept in their order, ``edges`` at a time: a task has so many rows
    and no more.  Between two ranges the ends of the later edges are replaced by
    the components that they lie in by then.
    """
    ordered = positions(tree, [F.col("w"), F.col("a"), F.col("b")], "at")
    rest = ordered.select("at", "w", F.col("a").alias("ra"), F.col("b").alias("rb"))
    n = rest.count()
    state = tree.sparkSession.createDataFrame([], "rep long, size long, chain long, mass double, below double")
    out: DataFrame | None = None

    def run(batches):
        swept = Sweep(least)
        reps = set()
        for b in batches:
            for at, w, ra, rb, *known in zip(*(c.to_pylist() for c in b.columns)):
                swept.know(ra, *known[:4])
                swept.know(rb, *known[4:])
                reps |= {ra, rb}
                swept.merge(ra, rb, w, at)
        rows = [("link", b, a, None, None, None, None, None) for b, a in swept.links]
        rows += [("fall", r, c, None, None, None, None, None) for r, c in swept.falls]
        rows += [("chain", c, p, wins, None, None, None, None) for c, p, wins in swept.chains]
        rows += [("now", r, top := swept.find(r), None, *swept.state[top]) for r in reps]
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in EVENT.split(", ")])

    for first in range(0, n, edges):
        some = rest.where((F.col("at") >= first) & (F.col("at") < first + edges))
        for end in ("ra", "rb"):
            own = state.select(F.col("rep").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("size", "chain", "mass", "below")])
            some = some.join(own, end, "left")
        fields = [f"{c}_{end}" for end in ("ra", "rb") for c in ("size", "chain", "mass", "below")]
        some = some.select("at", "w", "ra", "rb", *fields).repartition(1).sortWithinPartitions("at")
        events = stored(some.mapInArrow(run, EVENT), "condensed")
        out = events if out is None else out.unionByName(events)
        if first + edges < n:
            now = events.where("kind = 'now'")
            # What the components were before gives way to what they are.
            state = stored(state.join(now.select(F.col("node").alias("rep")), "rep", "left_anti").unionByName(now.select(F.col("target").alias("rep"), "size", "chain", "mass", "below").distinct()), "sweep-state")
            later = rest.where(F.col("at") >= first + edges)
            for end in ("ra", "rb"):
                moved = now.select(F.col("node").alias(end), F.col("target").alias("_to"))
                later = later.join(moved, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
            rest = stored(later.select("at", "w", "ra", "rb"), "sweep-edges")
    return out if out is not None else tree.sparkSession.createDataFrame([], EVENT)


def ends(links: DataFrame) -> DataFrame:
    """(node, target): the last target of the chain of links that starts at each node; links have no rings.

    Links are merged, not broadcast: there may be one a row.
    """
    links = stored(links.select("node", "target"), "links")
    while True:
        ahead = links.select(F.col("node").alias("target"), F.col("target").alias("further"))
        moved = stored(links.join(ahead.hint("merge"), "target", "left").select("node", F.coalesce("further", "target").alias("target"), F.col("further").isNotNull().alias("moved")), "links")
        done = moved.where("moved").isEmpty()
        discard(links)
        links = moved.select("node", "target")
        if done:
            return links


def chosen(chains: DataFrame) -> DataFrame:
    """(chain, top): for each chain of (chain, above, wins) the highest that wins on its way up, if any.

    Every round looks twice as far up.
    """
    way = stored(chains.select("chain", "above", F.when(F.col("wins"), F.col("chain")).alias("top")), "chains")
    while True:
        ahead = way.select(F.col("chain").alias("above"), F.col("above").alias("further"), F.col("top").alias("higher"))
        new = stored(way.join(ahead, "above", "left").select("chain", F.col("further").alias("above"), F.coalesce("higher", "top").alias("top")), "chains")
        discard(way)
        way = new
        if way.where("above is not null").isEmpty():
            return way.select("chain", "top").where("top is not null")


def density_clusters(
    df: DataFrame, key: str, vector: str, least: int = 5, samples: int | None = None, group: str | None = None, dims: int = 64, above: int = 5000, edges: int = EDGES,
) -> DataFrame:
    """(id, cluster, noise): density clusters of at least ``least`` rows, named by their smallest id.

    ``samples`` (default ``least``) sets the core distance.  The root is never a
    cluster.  A row of no cluster is noise and a cluster of its own.  Groups
    never meet; groups of more than ``above`` rows are first reduced to ``dims``
    dimensions.  Ids are unique; rows with a null id, group or vector have no
    row in the result; equal distances are ordered by ids.  The cost is every
    pair of rows of a group, once per round of the spanning tree.
    """
    if least < 2:
        raise ValueError("a cluster has at least 2 rows")
    rows = stored(reduce_dimensions(df, key, vector, dims, above, group), "density-input")
    events = condensed(stored(spanning_tree(rows, samples or least), "spanning-tree"), least, edges)
    falls = events.where("kind = 'fall'").select("node", F.col("target").alias("chain"))
    chains = events.where("kind = 'chain'").select(F.col("node").alias("chain"), F.col("target").alias("above"), "wins")
    tops = chosen(chains)
    last = ends(events.where("kind = 'link'"))
    # A row is its own component until a link or a fall says more.
    at = rows.select("id").join(last.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("target", "id").alias("node"))
    found = at.join(falls, "node").join(tops, "chain").select("id", "top")
    found = stored(found, "density-found")
    named = found.groupBy("top").agg(F.min("id").alias("cluster"))
    labels = found.join(named, "top").select("id", "cluster")
    return rows.select("id").join(labels, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"), F.col("cluster").isNull().alias("noise"))
