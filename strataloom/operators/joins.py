"""Joins by similarity and by place, and checked lookups.

Vector joins are exact.  Both sides of a group are cut into blocks by a hash of
the id, as many as the group's own sizes ask for; a task walks every pair of
blocks in tiles, each a small matrix product, and only the best or the sufficient
pairs leave it.  No pair table is built.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..storage import stored
from .ranking import positions

#: Vectors per block side, which a task holds, their bytes as doubles, and vectors
#: per side of a tile: a product takes 16 MB in single precision, 32 MB in double.
BLOCK = 16_384
BLOCK_BYTES = 16 << 20
TILE = 2048
#: Pairs whose product is taken in double at a time.
CHECKED = 1 << 15
#: Numbers of centroids that are written into an expression.
LITERALS = 1 << 16
#: Groups whose sizes may be broadcast (about 50 bytes each).
BROADCAST_GROUPS = 200_000


def lookup_one(df: DataFrame, key: str, value) -> DataFrame:
    """The rows with this key; an error when the query runs and there is none."""
    hit = df.where(F.col(key) == F.lit(value)).withColumn("_ok", F.lit(1))
    n = hit.agg(F.count("*").alias("_n")).select(F.when(F.col("_n") > 0, 1).otherwise(F.raise_error(F.lit(f"no row with {key} = {value}"))).alias("_ok"))
    return n.join(hit, "_ok", "left").drop("_ok")


def _unit(rows) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in rows])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _side(df: DataFrame, key: Column, vector: Column, group: Column | None, attribute: Column | None) -> DataFrame:
    return df.select(
        key.cast("long").alias("id"),
        (group if group is not None else F.lit("")).cast("string").alias("g"),
        (attribute if attribute is not None else F.lit("")).cast("string").alias("a"),
        vx.as_double(vector).alias("v"),
    ).where("v is not null")


def _blocked(left: DataFrame, right: DataFrame, search, schema: str, block: int, half: bool = False) -> DataFrame:
    """``search(left block, right block)`` over all block pairs of equal groups.

    A group of few rows is one pair of blocks, whatever the table's size; a block
    has at most ``block`` rows and ``BLOCK_BYTES``.  With ``half`` both sides are
    the same table, and of two mirrored pairs of blocks one is searched.  The
    sides have columns g, id, a, v and any others that the search reads.
    """
    if half:  # columns of their own, for one table on both sides
        right = right.select(*[F.col(c).alias(c) for c in right.columns])
    most = F.least(F.lit(block), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES // 8) / F.greatest(F.lit(1), F.max(F.size("v"))))))
    sizes = [x.groupBy("g").agg(F.ceil(F.count("*") / most).cast("int").alias(n)) for x, n in ((left, "nl"), (right, "nr"))]
    grid = stored(sizes[0].join(sizes[1], "g"), "grid")
    if grid.count() <= BROADCAST_GROUPS:
        grid = F.broadcast(grid)
    a, b = (x.join(grid, "g") for x in (left, right))
    own = F.pmod(F.xxhash64("id"), F.col("nl")).cast("int")
    a = a.select(*left.columns, own.alias("i"), F.explode(F.sequence(own if half else F.lit(0), F.col("nr") - 1)).alias("j"))
    other = F.pmod(F.xxhash64("id"), F.col("nr")).cast("int")
    b = b.select(*right.columns, F.explode(F.sequence(F.lit(0), other if half else F.col("nl") - 1)).alias("i"), other.alias("j"))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        return search(x, y)

    return a.groupBy("g", "i", "j").cogroup(b.groupBy("g", "i", "j")).applyInPandas(run, schema)


def _tiles(x: pd.DataFrame, y: pd.DataFrame):
    """(rows of x, rows of y, similarities), tile after tile; y in order within x.

    A tile is a strip of few rows: who walks them makes several arrays of its size.
    """
    p, q = _unit(x["v"]), _unit(y["v"])
    strip = max(1, TILE // 8)
    for i in range(0, len(p), strip):
        for j in range(0, len(q), TILE):
            yield slice(i, i + strip), slice(j, j + TILE), p[i : i + strip] @ q[j : j + TILE].T


def _slack(width: int, digits: int | None = None) -> float:
    """How far a product of unit vectors in single precision may be from the one in double, rounded to ``digits``."""
    return (width + 4) * 2.0**-23 + (0.5001 * 10.0**-digits if digits is not None else 0.0)


def _products(p: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the rows i of p and j of q; equal rows have equal products wherever they lie."""
    out = np.empty(len(i))
    for at in range(0, len(i), CHECKED):
        part = slice(at, at + CHECKED)
        out[part] = np.einsum("ij,ij->i", p[i[part]], q[j[part]])
    return out


def _best(k: int, sim: np.ndarray, first: int, best: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """(similarities, places) of the k best per row of the tiles so far, -inf where there are fewer.

    Tiles come in the order of places, the last one with places from ``first``
    on, and equal similarities go to the smaller place.  Only what reaches the
    k-th best so far is ordered; no row of a tile is sorted.
    """
    n, width = sim.shape
    ok = None
    if best is not None:
        ok = sim > best[0][:, -1:]  # a later one of equal similarity loses
    if (ok is None or np.count_nonzero(ok) > 4 * k * n) and width > k:
        least = np.partition(sim, width - k, axis=1)[:, width - k, None]
        ok = sim >= least if ok is None else ok & (sim >= least)
    row, at = np.nonzero(np.ones_like(sim, dtype=bool) if ok is None else ok)
    return _kept(k, n, row, at + first, sim[row, at], best)


def _kept(k: int, n: int, row: np.ndarray, at: np.ndarray, value: np.ndarray, best: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """The k best per row of (row, place, similarity) and of the best so far."""
    if best is not None:
        row, value, at = np.concatenate((row, np.repeat(np.arange(n), k))), np.concatenate((value, best[0].ravel())), np.concatenate((at, best[1].ravel()))
    finite = np.isfinite(value)
    row, value, at = row[finite], value[finite], at[finite]
    order = np.lexsort((at, -value, row))
    row, value, at = row[order], value[order], at[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = place < k
    out = np.full((n, k), -np.inf), np.zeros((n, k), dtype=np.int64)
    out[0][row[kept], place[kept]], out[1][row[kept], place[kept]] = value[kept], at[kept]
    return out


def knn(
    left: DataFrame, right: DataFrame, k: int, key: str, vector: str, right_key: str | None = None, right_vector: str | None = None,
    group: str | None = None, differ: str | None = None, include_self: bool = False, block: int = BLOCK, digits: int | None = None,
) -> DataFrame:
    """(id, neighbour, sim, rank): the k most similar rows of ``right`` per row of ``left``.

    Cosine similarity in double, rounded to ``digits`` before it is compared;
    ties go to the smaller neighbour id.  Products in single precision tell which
    pairs may be among the best by more than their error; only these are taken
    in double.  With
    ``group`` only rows of the same group meet; with ``differ`` only rows that
    differ in that column.  Rows with a null vector or group take no part; a
    zero vector has similarity 0 to all.
    """
    a = _side(left, F.col(key), F.col(vector), F.col(group) if group else None, F.col(differ) if differ else None)
    b = _side(right, F.col(right_key or key), F.col(right_vector or vector), F.col(group) if group else None, F.col(differ) if differ else None)

    def search(x, y):
        y = y.sort_values("id", kind="stable")
        ids, others = x["id"].to_numpy(), y["id"].to_numpy()
        codes = pd.factorize(np.concatenate((x["a"].to_numpy(), y["a"].to_numpy())))[0].astype(np.int32)
        mine, theirs = codes[: len(ids)], codes[len(ids) :]
        p, q = _unit(x["v"]), _unit(y["v"])
        p4, q4 = p.astype(np.float32), q.astype(np.float32)
        slack = np.float32(_slack(p.shape[1], digits))

        def rounded(sim):
            return sim if digits is None else np.copysign(np.floor(np.abs(sim) * 10.0**digits + 0.5) / 10.0**digits, sim)

        def hide(sim, r, c):
            if not include_self:
                sim[ids[r, None] == others[None, c]] = -np.inf
            if differ:
                sim[mine[r, None] == theirs[None, c]] = -np.inf

        out = []
        for i in range(0, len(p), TILE):
            r, best = slice(i, i + TILE), None
            for j in range(0, len(q), TILE):
                c = slice(j, j + TILE)
                rough = p4[r] @ q4[c].T
                n, width = rough.shape
                least = np.full(n, -np.inf, dtype=np.float32) if best is None else best[0][:, -1].astype(np.float32) - slack
                near = rough >= least[:, None]
                if np.count_nonzero(near) > 8 * k * n:  # the tile says itself what cannot be among the best
                    hide(rough, r, c)
                    if width > k:
                        least = np.maximum(least, np.partition(rough, width - k, axis=1)[:, width - k] - 2 * slack)
                    near = (rough >= least[:, None]) & (rough > -np.inf)
                row, at = np.divmod(np.flatnonzero(near), width)
                if len(row) > 64 * k * n:  # very many equal ones
                    sim = rounded(p[r] @ q[c].T)
                    hide(sim, r, c)
                    best = _best(k, sim, j, best)
                    continue
                if not include_self or differ:
                    other = np.ones(len(row), dtype=bool)
                    if not include_self:
                        other &= ids[r][row] != others[c][at]
                    if differ:
                        other &= mine[r][row] != theirs[c][at]
                    row, at = row[other], at[other]
                best = _kept(k, n, row, at + j, rounded(_products(p[r], q[c], row, at)), best)
            s = best[0].ravel()
            part = pd.DataFrame({"id": np.repeat(ids[r], k), "neighbour": others[best[1]].ravel(), "sim": s})
            out.append(part[np.isfinite(s)])
        return pd.concat(out)

    local = _blocked(a, b, search, "id long, neighbour long, sim double", block)
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "neighbour")
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def threshold_pairs(
    left: DataFrame, right: DataFrame, least: float, key: str, vector: str, group: str | None = None, differ: str | None = None,
    unordered: bool = False, right_key: str | None = None, right_vector: str | None = None, block: int = BLOCK,
) -> DataFrame:
    """(a, b, sim) for all pairs with cosine similarity of at least ``least``.

    ``unordered`` is for a self-join (both sides the same table): each pair once,
    a < b, none with itself.  The result is all pairs; where only their
    components matter, ``threshold_stars`` has no more rows than the tables.
    """
    x = _side(left, F.col(key), F.col(vector), F.col(group) if group else None, F.col(differ) if differ else None)
    y = _side(right, F.col(right_key or key), F.col(right_vector or vector), F.col(group) if group else None, F.col(differ) if differ else None)

    def search(p, q):
        ids, others, mine, theirs = p["id"].to_numpy(), q["id"].to_numpy(), p["a"].to_numpy(), q["a"].to_numpy()
        within = unordered and p["i"].iloc[0] == p["j"].iloc[0]
        out = []
        for r, c, sim in _tiles(p, q):
            ok = sim >= least
            if within:
                ok &= ids[r, None] < others[None, c]
            elif unordered:
                ok &= ids[r, None] != others[None, c]
            if differ:
                ok &= mine[r, None] != theirs[None, c]
            i, j = np.nonzero(ok)
            a, b = ids[r][i], others[c][j]
            out.append(pd.DataFrame({"a": np.minimum(a, b) if unordered else a, "b": np.maximum(a, b) if unordered else b, "sim": sim[i, j]}))
        return pd.concat(out)

    return _blocked(x, y, search, "a long, b long, sim double", block, half=unordered)


def _linked(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The root of each node after the links (a, b); a root is the smallest node and its own root."""
    while len(a):
        x, y = root[a], root[b]
        above = np.arange(len(root))
        np.minimum.at(above, np.maximum(x, y), np.minimum(x, y))
        while (above[above] != above).any():
            above = above[above]
        root = above[root]
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return root


def threshold_stars(df: DataFrame, least: float, key: str, vector: str, group: str | None = None, block: int = BLOCK) -> DataFrame:
    """(src, dst) edges with the connected components of all pairs of at least ``least``.

    In every pair of blocks each row points to the smallest id that it is linked
    with there, over any number of steps; pairs are never written.  Products are
    taken in double where single precision does not tell on which side they are.
    """
    left, right = (_side(df, F.col(key), F.col(vector), F.col(group) if group else None, None) for _ in range(2))

    def search(p, q):
        same = p["i"].iloc[0] == p["j"].iloc[0]
        ids = p["id"].to_numpy() if same else np.concatenate((p["id"].to_numpy(), q["id"].to_numpy()))
        x, first = _unit(p["v"]), 0 if same else len(p)
        y = x if same else _unit(q["v"])
        if same:  # one block on both sides
            q = p
        x4, y4 = x.astype(np.float32), y.astype(np.float32)
        slack = _slack(x.shape[1])
        root = np.arange(len(ids))  # of the rows of both sides
        strip = max(1, TILE // 8)  # what is linked early is skipped later
        for i in range(0, len(x), strip):
            for j in range(i if same else 0, len(y), TILE):
                r, c = slice(i, min(i + strip, len(x))), slice(j, min(j + TILE, len(y)))
                a, b = root[r], root[first + c.start : first + c.stop]
                if (a == a[0]).all() and (b == a[0]).all():
                    continue  # nothing left to link
                rough = x4[r] @ y4[c].T
                row, at = np.divmod(np.flatnonzero(rough >= np.float32(least - slack)), len(b))
                new = a[row] != b[at]
                row, at = row[new], at[new]
                unsure = np.flatnonzero(rough[row, at] <= np.float32(least + slack))
                wrong = unsure[_products(x[r], y[c], row[unsure], at[unsure]) < least]
                root = _linked(root, np.delete(row, wrong) + i, np.delete(at, wrong) + first + j)
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, root, ids)
        low = low[root]
        far = ids != low
        return pd.DataFrame({"src": ids[far], "dst": low[far]})

    return _blocked(left, right, search, "src long, dst long", block, half=True)


#: Bins of similarities from -1 to 1.
BINS = 1 << 16


def _bins(sim: np.ndarray) -> np.ndarray:
    return np.clip(((sim + 1) * (BINS / 2)).astype(np.int64), 0, BINS - 1)


def _each_pair(df: DataFrame, key: str, vector: str, group: str, found, schema: str, block: int = BLOCK) -> DataFrame:
    """``found(group, similarities)`` frames over the tiles of all unordered pairs of each group."""
    left, right = (_side(df, F.col(key), F.col(vector), F.col(group), None) for _ in range(2))

    def search(p, q):
        same, g = p["i"].iloc[0] == p["j"].iloc[0], p["g"].iloc[0]
        ids, others = p["id"].to_numpy(), q["id"].to_numpy()
        out = pd.concat([found(g, sim[ids[r, None] < others[None, c]] if same else sim.ravel()) for r, c, sim in _tiles(p, q)], ignore_index=True)
        return out.assign(g=pd.Series([g] * len(out), dtype=object))

    return _blocked(left, right, search, schema, block, half=True)


def similarity_counts(df: DataFrame, key: str, vector: str, group: str) -> DataFrame:
    """(g, bin, n): how many pairs of a group have a similarity in the bin; ids are unique."""

    def found(g, sim):
        bins, n = np.unique(_bins(sim), return_counts=True)
        return pd.DataFrame({"bin": bins, "n": n})

    return _each_pair(df, key, vector, group, found, "g string, bin long, n long")


def similarity_values(df: DataFrame, key: str, vector: str, group: str, wanted: dict[str, list[int]]) -> DataFrame:
    """(g, sim) of the pairs whose similarity is in a wanted bin of their group."""

    def found(g, sim):
        sim = sim[np.isin(_bins(sim), wanted.get(g, []))]
        return pd.DataFrame({"sim": sim})

    return _each_pair(df, key, vector, group, found, "g string, sim double")


def knn_agreement(df: DataFrame, k: int, key: str, vector: str, label: str) -> DataFrame:
    """(id, agreement): share of the k nearest neighbours with the own label."""
    labels = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"))
    near = knn(df, df, k, key, vector)
    other = labels.select(F.col("id").alias("neighbour"), F.col("label").alias("other"))
    return near.join(labels, "id").join(other, "neighbour").groupBy("id").agg(F.avg((F.col("label") == F.col("other")).cast("double")).alias("agreement"))


def vote(near: DataFrame, labels: DataFrame, id_: str = "id") -> DataFrame:
    """(id, winner, votes): the most frequent label among neighbours.

    ``labels`` has neighbour and label.  Ties go to the smallest label.
    """
    counts = near.join(labels, "neighbour").groupBy(id_, "label").agg(F.count("*").alias("n"))
    return counts.groupBy(id_).agg(F.min_by(F.struct("label", "n"), F.struct(-F.col("n"), "label")).alias("w")).select(id_, F.col("w.label").alias("winner"), F.col("w.n").alias("votes"))


def max_similarity(df: DataFrame, named: DataFrame, vector: str, digits: int | None = None, literals: int = LITERALS) -> DataFrame:
    """Adds name and sim of the most similar of named centroids.

    Similarities are rounded to ``digits`` before they are compared; ties go to
    the smallest name.  A null vector, or no centroid, gives nulls.  Centroids of
    up to ``literals`` numbers in all are written into the expression; more are a
    table that ``knn`` meets in blocks, by the same rules.
    """
    n, d = named.where("centroid is not null").agg(F.count("*"), F.max(F.size("centroid"))).first()
    if n * (d or 0) > literals:
        own = stored(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
        table = positions(named.select("name", "centroid"), [F.col("name")], "_place")  # in the order of names
        near = knn(own, table, 1, "_row", vector, "_place", "centroid", include_self=True, digits=digits)
        best = near.join(table.select(F.col("_place").alias("neighbour"), "name"), "neighbour").select(F.col("id").alias("_row"), "name", "sim")
        return own.join(best, "_row", "left").drop("_row")
    rows = sorted((r.name, [float(x) for x in r.centroid]) for r in named.where("centroid is not null").select("name", "centroid").collect())
    v = F.col(vector)

    def sim(c):
        s = vx.cosine(v, F.array(*map(F.lit, c)))
        return F.round(s, digits) if digits is not None else s

    if not rows:
        kind = named.schema["name"].dataType
        return df.withColumns({"name": F.lit(None).cast(kind), "sim": F.lit(None).cast("double")})
    best = F.array_min(F.array(*[F.struct((-sim(c)).alias("m"), F.lit(n).alias("name")) for n, c in rows]))
    out = df.withColumn("_best", F.when(v.isNotNull(), best))
    return out.withColumn("name", F.col("_best.name")).withColumn("sim", -F.col("_best.m")).drop("_best")


#: Points of a block of cells, were they spread evenly, and pairs of points that a task holds at a time.
POINTS = 20_000
MET = 1 << 20


def _met(q: pd.DataFrame, p: pd.DataFrame, k: int, side: float) -> pd.DataFrame:
    """(row, at, d2, rank): the k nearest of ``p`` in the 3 x 3 cells around each row of ``q``."""
    cells = [np.floor(t[c].to_numpy() / side).astype(np.int64) for t in (q, p) for c in ("x", "y")]
    height = max(cells[1].max(), cells[3].max()) - min(cells[1].min(), cells[3].min()) + 3
    here, there = (x * height + y for x, y in (cells[:2], cells[2:]))
    order = np.argsort(there, kind="stable")
    there = there[order]
    around = here[:, None] + np.array([-height, 0, height])
    first, stop = np.searchsorted(there, around - 1), np.searchsorted(there, around + 1, side="right")
    ends = np.cumsum((stop - first).sum(axis=1))
    px, py, code = (p[c].to_numpy()[order] for c in ("x", "y", "code"))
    out, a = [], 0
    while a < len(q):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MET, side="right")))
        size = (stop[a:b] - first[a:b]).ravel()
        row = np.repeat(np.repeat(np.arange(a, b), 3), size)
        at = np.arange(len(row)) + np.repeat(first[a:b].ravel() - (np.cumsum(size) - size), size)
        other = code[at] != q["code"].to_numpy()[row]
        row, at = row[other], at[other]
        d2 = (q["x"].to_numpy()[row] - px[at]) ** 2 + (q["y"].to_numpy()[row] - py[at]) ** 2
        best = np.lexsort((code[at], d2, row))
        row, at, d2 = row[best], at[best], d2[best]
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        kept = rank <= k
        out.append(pd.DataFrame({"row": row[kept], "at": order[at[kept]], "d2": d2[kept], "rank": rank[kept]}))
        a = b
    return pd.concat(out, ignore_index=True)


def _nearest_points(q: pd.DataFrame, p: pd.DataFrame, k: int, side: float) -> pd.DataFrame:
    """``_met`` with cells of ``side``; rows whose neighbours are nearer meet fewer points in finer cells first."""
    codes = np.unique(np.concatenate((q["id"].to_numpy(), p["id"].to_numpy())), return_inverse=True)[1]
    q, p = (t.assign(code=c) for t, c in ((q, codes[: len(q)]), (p, codes[len(q) :])))
    halves = 0
    while halves < 20 and p.groupby([np.floor(p["x"] / (side / 2**halves)), np.floor(p["y"] / (side / 2**halves))]).size().max() > 8 * k:
        halves += 1
    out, rest = [], np.arange(len(q))
    for n in range(halves, -1, -1):
        fine = side / 2**n
        met = _met(q.iloc[rest], p, k, fine)
        sure = np.ones(len(rest), dtype=bool)
        if n:
            full = met[(met["rank"] == k) & (met["d2"] <= fine * fine)]
            sure = np.isin(np.arange(len(rest)), full["row"])
        met = met[sure[met["row"]]]
        out.append(met.assign(row=rest[met["row"]]))
        rest = rest[~sure]
        if not len(rest):
            break
    return pd.concat(out, ignore_index=True)


def spatial_knn(points: DataFrame, k: int, cell: float | None, key: str, group: str, x: str = "x", y: str = "y") -> DataFrame:
    """(group, id, neighbour, d2, rank): the k nearest points of the group, self left out.

    Points lie in cells of side ``cell``.  A block of cells and the points within
    one side around it, which may be neighbours of its own, meet in a task, and
    only the k nearest leave it.  Points whose k-th neighbour is farther than one
    side go on with twice the side, so the result is exact wherever the points
    lie, and a few far ones cost a few rounds.  Of the points at one place only
    the k + 1 with the smallest ids can be neighbours.  Ties go to the smaller
    id.  With ``cell`` None a cell holds about k points of the largest group were
    they spread evenly.  Ids are unique in a group; rows with a null have no row.
    """
    own = points.select(F.col(group).alias("group"), F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    sizes = own.groupBy("group").agg((F.count("*") - 1).alias("others"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"))
    sizes = stored(sizes.withColumn("g", F.monotonically_increasing_id()), "sizes")
    widest, most = sizes.agg(F.max("span"), F.max("others")).first()
    widest = widest or 0.0
    if cell is None:
        cell = widest * (k / max(most or 0, k)) ** 0.5 or 1.0
    own = own.join(sizes.select("group", "g", "others"), "group").drop("group")
    place = Window.partitionBy("g", "x", "y").orderBy("id")
    others = stored(own.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k + 1).drop("_n"), "places")
    kind = own.schema["id"].dataType.simpleString()
    schema = f"g long, id {kind}, neighbour {kind}, d2 double, rank int, x double, y double, others long"
    columns = [c.split()[0] for c in schema.split(", ")]
    open_, done, side = own, None, float(cell)
    while True:
        last, width = side > widest, side * max(1, int((POINTS / k) ** 0.5))
        block = [F.floor(F.col(c) / width).alias(f"b{c}") for c in ("x", "y")]
        reach = [F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + d) / width) for d in (-side, 0.0, side)]))).alias(f"b{c}") for c in ("x", "y")]

        def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:  # pickled in its round
            if not len(q):
                return pd.DataFrame({c: [] for c in columns})
            met = _nearest_points(q, p, k, side)
            far, n = np.zeros(len(q)), np.bincount(met["row"], minlength=len(q))
            np.maximum.at(far, met["row"], met["d2"])
            # Whatever was not met is farther than one side.
            sure = (n == k) & (far <= side * side) | (n == q["others"].to_numpy()) | last
            met, rest = met[sure[met["row"]]], np.flatnonzero(~sure)
            # The neighbours of the sure rows, then the rows that stay open, with rank 0.
            ids, none = q["id"].to_numpy(), np.zeros(len(rest), dtype=np.int64)
            row, zero = np.concatenate((met["row"], rest)), np.zeros(len(met))
            values = (
                np.full(len(row), q["g"].iloc[0]), ids[row], np.concatenate((p["id"].to_numpy()[met["at"]], ids[rest])), np.concatenate((met["d2"], none)), np.concatenate((met["rank"], none)),
                *(np.concatenate((zero, q[c].to_numpy()[rest])) for c in ("x", "y")), np.concatenate((zero.astype(np.int64), q["others"].to_numpy()[rest])),
            )
            return pd.DataFrame({c: pd.Series(v, dtype=v.dtype) for c, v in zip(columns, values)})  # strings stay objects

        blocks = ["g", "bx", "by"]
        asked = open_.select("*", *block)
        offered = others.drop("others").select("*", reach[0]).select("*", reach[1])
        if done is not None:  # few blocks have points that are still open
            offered = offered.join(asked.select(*blocks).distinct(), blocks, "left_semi")
        found = stored(asked.groupBy(*blocks).cogroup(offered.groupBy(*blocks)).applyInPandas(run, schema), "spatial")
        ranked = found.where("rank > 0").select("g", "id", "neighbour", "d2", "rank")
        open_ = found.where("rank = 0").select("g", "id", "x", "y", "others")
        done = ranked if done is None else done.unionByName(ranked)
        if last or open_.isEmpty():
            return done.join(sizes.select("group", "g"), "g").select("group", "id", "neighbour", "d2", "rank")
        side *= 2


def grid_mean(cells: DataFrame, group: str, row: str, col: str, value: str) -> DataFrame:
    """(group, row, col, mean): mean over the 3 x 3 cells around each cell that exist."""
    around = cells.select(F.col(group).alias(group), F.explode(F.sequence(F.col(row) - 1, F.col(row) + 1)).alias(row), F.col(col).alias("_c"), F.col(value).alias("_v"))
    around = around.select(group, row, F.explode(F.sequence(F.col("_c") - 1, F.col("_c") + 1)).alias(col), "_v")
    keys = cells.select(group, row, col).distinct()
    return around.groupBy(group, row, col).agg(F.avg("_v").alias("mean")).join(keys, [group, row, col], "left_semi")


def dense(rows: DataFrame, items: DataFrame, values: DataFrame, row: str, item: str, value: str, fill: float | None = 0.0) -> DataFrame:
    """Every row with every item: value and mask (1 where it was measured).

    ``fill`` None leaves unmeasured cells null.  The item list is a fixed,
    small dimension; it is attached as an array, not by a join.
    """
    wanted = items.agg(F.sort_array(F.collect_set(item)).alias("_items"))
    full = rows.select(row).distinct().join(wanted).select(row, F.explode("_items").alias(item))
    out = full.join(values.select(row, item, F.col(value).alias("_v")), [row, item], "left")
    v = F.col("_v") if fill is None else F.coalesce("_v", F.lit(fill))
    return out.select(row, item, v.alias("value"), F.col("_v").isNotNull().cast("int").alias("mask"))


def ordered_pairs(df: DataFrame, group: list[str], key: str, keep: list[str]) -> DataFrame:
    """Unordered pairs (a < b) of rows of a group; ``keep`` columns get _a and _b."""
    a = df.select(*group, F.col(key).alias("a"), *[F.col(c).alias(f"{c}_a") for c in keep])
    b = df.select(*group, F.col(key).alias("b"), *[F.col(c).alias(f"{c}_b") for c in keep])
    return a.join(b, group).where("a < b")


def leaks(df: DataFrame, key: str, split: str, attributes: list[str]) -> DataFrame:
    """(key, split, class, n_links): rows that are equal in all attributes to rows of another split.

    class is the smallest key of the equal rows, n_links the number of equal rows
    in other splits; pairs are not written, so a content that a third of all
    rows share costs no more than others.  Nulls never match; rows without a
    link have no row.
    """
    known = df.where(" and ".join(f"`{a}` is not null" for a in [*attributes, split]))
    per = known.groupBy(*attributes, split).agg(F.count("*").alias("_own"), F.min(key).alias("_least"))
    whole = per.groupBy(*attributes).agg(F.sum("_own").alias("_all"), F.min("_least").alias("class"), F.count("*").alias("_splits")).where("_splits > 1")
    shared = per.join(whole, attributes).select(*attributes, split, "class", (F.col("_all") - F.col("_own")).alias("n_links"))
    return known.join(shared, [*attributes, split]).select(key, split, "class", "n_links")


def same_order(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Places at which two ordered tables differ or one has no row."""
    x, y = a.select(*key, F.col(value).alias("left")), b.select(*key, F.col(value).alias("right"))
    return x.join(y, key, "full").where(~F.col("left").eqNullSafe(F.col("right")))
