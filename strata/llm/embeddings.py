"""Operator 8: exact cosine range join of embeddings over pivot cells.

Unit vectors are compared by Euclidean distance: cosine >= c is distance <= sqrt(2 - 2c).
Pivots (the vectors with the least id hashes; their number grows with the table up to
``PIVOTS``) partition the space: a vector's home is the cell of its nearest pivot. A vector
is replicated to another cell unless the triangle inequality rules out a partner there: its
distance to the cell's pivot exceeds the cell's radius by more than the range, or its
distance to the plane between the two pivots does. Of each two cells one takes the
replicas, so every pair within the range meets exactly once. Cells join independently; a
cell's homes and replicas are salted into blocks of about ``BLOCK`` vectors, and each pair
of blocks is one task's work, so a cell that holds most vectors is split.

Equal vectors are collapsed first and counted with their number. A block pair returns link
counts per vector and a spanning star of its linked groups, never its pairs.

Cases: vectors that are NULL, empty, zero, or hold a NULL or non-finite component link with
nothing; vectors of different lengths never link; a row with a NULL vec_id links with
nothing and has a NULL class; rows that share a vec_id are one vertex of the classes; an
empty table gives no rows; labels and further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strata.llm._graph import components
from strata.session import materialize

PIVOTS, PER_PIVOT, BLOCK = 256, 2048, 4096


def _units(batches):
    """Rows (vec_id, vector) to (vec_id, the unit vector's doubles or NULL)."""
    for batch in batches:
        column = batch.column(1)
        sizes = np.asarray(column.value_lengths().fill_null(0))
        flat = column.flatten()
        values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        out = []
        for a, b in zip(ends - sizes, ends):
            x = values[a:b]
            top = np.abs(x).max() if b > a else 0.0
            if not (np.isfinite(top) and top > 0):
                out.append(None)
                continue
            x = x / top                           # so that no square overflows or vanishes
            out.append((x / math.sqrt(float(x @ x))).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "u"])


def _rows(column) -> np.ndarray:
    """A column of unit vectors of one length as a matrix."""
    return np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in column])


def _by_length(batch, at: int):
    """The batch's rows split by their vectors' length."""
    import pyarrow.compute as pc
    length = pc.binary_length(batch.column(at))
    for n in pc.unique(length).to_pylist():
        yield n // 8, batch.filter(pc.equal(length, n))


def _distances(matrix, pivots) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * matrix @ pivots.T))


def _tile(x, y, least: float, upper: bool):
    """Linked places (i, j) of two blocks: single precision finds them, and what is near the
    threshold is computed again in double precision."""
    for a in range(0, len(x), 1024):
        dots = x[a:a + 1024].astype(np.float32) @ y.astype(np.float32).T
        i, j = np.nonzero(dots >= least - 1e-4)
        close = dots[i, j] < least + 1e-4
        i += a
        if upper:
            ok = i < j
            i, j, close = i[ok], j[ok], close[ok]
        if close.any():
            exact = np.einsum("ij,ij->i", x[i[close]], y[j[close]])
            ok = np.ones(len(i), bool)
            ok[np.flatnonzero(close)[exact < least]] = False
            i, j = i[ok], j[ok]
        yield i, j


def _join(least: float):
    def run(table: pa.Table) -> pa.Table:
        left = table.filter(pa.compute.field("side") == 0)
        right = table.filter(pa.compute.field("side") == 1)
        same = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        right = left if same else right
        out = {"v": [], "h": [], "links": []}
        stars = {"v": [], "c": []}
        if left.num_rows and right.num_rows:
            x, y = _rows(left.column("u").combine_chunks()), _rows(right.column("u").combine_chunks())
            vx, vy = left.column("v").to_numpy(), right.column("v").to_numpy()
            mx, my = left.column("m").to_numpy(), right.column("m").to_numpy()
            nx, ny = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
            for i, j in _tile(x, y, least, same):
                np.add.at(nx, i, my[j])
                np.add.at(ny, j, mx[i])
                for v, c in _stars(i, j, vx, vy):
                    stars["v"].append(v)
                    stars["c"].append(c)
            for t, n, v in ((left, nx, vx), (right, ny, vy)):
                some = np.flatnonzero(n)
                out["v"].append(v[some])
                out["h"].append(t.column("h").to_numpy()[some])
                out["links"].append(n[some])
        cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        v, c = cat(stars["v"]), cat(stars["c"])
        n = len(cat(out["v"]))
        return pa.table({"v": pa.array(np.concatenate((cat(out["v"]), v))),
                         "h": pa.array(np.concatenate((cat(out["h"]), np.zeros(len(v), np.int64)))),
                         "links": pa.array(np.concatenate((cat(out["links"]), np.zeros(len(v), np.int64)))),
                         "c": pa.array(np.concatenate((np.full(n, -1), c)), mask=np.arange(n + len(v)) < n)})
    return run


def _stars(i, j, vx, vy):
    """Links (v, c) that join each linked group of a tile to its least vertex."""
    if not len(i):
        return
    rows, cols = np.unique(i), np.unique(j)
    p, q = np.searchsorted(rows, i), np.searchsorted(cols, j)
    a, b = vx[rows].copy(), vy[cols].copy()
    while True:
        before = a.sum(), b.sum()
        np.minimum.at(a, p, b[q])
        np.minimum.at(b, q, a[p])
        if (a.sum(), b.sum()) == before:
            break
    for v, c in ((vx[rows], a), (vy[cols], b)):
        yield v[v != c], c[v != c]


def cosine_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 least: float = 0.95) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors of cosine >= ``least``),
    component_id (the smallest vec_id reachable by links) and kept (vec_id = component_id)."""
    spark = vectors.sparkSession
    reach = math.sqrt(2 - 2 * least) + 1e-6
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x"))
    rows = rows.mapInArrow(_units, "vec_id long, u binary").withColumns(
        {"h": F.xxhash64("u"), "h2": F.xxhash64("u", F.lit(1))})
    usable = "vec_id is not null and u is not null"
    reps = materialize(rows.filter(usable).groupBy("u", "h", "h2").agg(
        F.min("vec_id").alias("v"), F.count("*").alias("m")))
    count = reps.count()
    chosen = reps.orderBy(F.xxhash64("v"), "h").limit(min(PIVOTS, max(1, count // PER_PIVOT))).select("u").collect()
    pivots: dict[int, np.ndarray] = {}
    for r in chosen:
        x = np.frombuffer(r.u, np.float64)
        pivots.setdefault(len(x), []).append(x)
    pivots = {n: np.stack(p) for n, p in pivots.items()}

    def homes(batches):
        for batch in batches:
            for n, part in _by_length(batch, 0):
                d = _distances(_rows(part.column(0)), pivots.get(n, np.zeros((1, n))))
                home = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), part.column(3),
                     pa.array(np.full(len(home), n, np.int32)), pa.array(home.astype(np.int32)),
                     pa.array(d[np.arange(len(home)), home])], names=["u", "h", "v", "m", "n", "home", "d"])

    placed = materialize(reps.select("u", "h", "v", "m")
                         .mapInArrow(homes, "u binary, h long, v long, m long, n int, home int, d double"))
    # one row per pivot at most
    cells = {(r.n, r.home): (r.size, r.radius) for r in placed.groupBy("n", "home").agg(
        F.count("*").alias("size"), F.max("d").alias("radius")).collect()}

    def takers(matrix, n, home):
        """For each vector which cells take a replica of it."""
        p = pivots.get(n, np.zeros((1, n)))
        d = _distances(matrix, p)
        gap = _distances(p, p)
        radius = np.array([cells.get((n, k), (0, -math.inf))[1] for k in range(len(p))])
        own = d[np.arange(len(home)), home]
        plane = (d ** 2 - (own ** 2)[:, None]) <= 2 * reach * gap[home] + 1e-6
        index = np.arange(len(p))
        turn = (index[None, :] < home[:, None]) ^ ((index[None, :] + home[:, None]) % 2 == 1)
        return plane & turn & (d <= radius[None, :] + reach) & (index[None, :] != home[:, None])

    def counted(batches):
        total: dict = {}
        for batch in batches:
            for n, part in _by_length(batch, 0):
                t = takers(_rows(part.column(0)), n, part.column(1).to_numpy()).sum(axis=0)
                total[n] = total.get(n, 0) + t
        flat = [(n, k, int(c)) for n, t in total.items() for k, c in enumerate(t)]
        yield pa.RecordBatch.from_pydict({"n": pa.array([x[0] for x in flat], pa.int32()),
                                          "cell": pa.array([x[1] for x in flat], pa.int32()),
                                          "size": pa.array([x[2] for x in flat], pa.int64())})

    guests = {(r.n, r.cell): r.size for r in placed.select("u", "home").mapInArrow(
        counted, "n int, cell int, size long").groupBy("n", "cell").agg(F.sum("size").alias("size")).collect()}
    salts = {k: (max(1, math.ceil(size / BLOCK)), math.ceil(guests.get(k, 0) / BLOCK))
             for k, (size, _) in cells.items()}

    def dealt(batches):
        """Each vector to the block pairs (cell, a, b) it takes part in; side 0 holds homes of
        block a, side 1 block b (homes, or replicas numbered after the homes' blocks)."""
        for batch in batches:
            for n, part in _by_length(batch, 0):
                home = part.column(5).to_numpy()
                h = part.column(1).to_numpy().view(np.uint64)
                take = takers(_rows(part.column(0)), n, home)
                at, cell, a, b, side = [], [], [], [], []

                def put(rows, cells_, a_, b_, side_):
                    at.append(rows)
                    cell.append(np.broadcast_to(cells_, rows.shape))
                    a.append(np.broadcast_to(a_, rows.shape))
                    b.append(np.broadcast_to(b_, rows.shape))
                    side.append(np.full(rows.shape, side_))

                for k in range(take.shape[1]):
                    own, extra = salts.get((n, k), (0, 0))
                    mine = np.flatnonzero(home == k)
                    if len(mine):
                        s = (h[mine] % np.uint64(own)).astype(np.int64)
                        for t in range(own):
                            put(mine[s <= t], k, s[s <= t], t, 0)
                            put(mine[s > t], k, t, s[s > t], 1)
                        for t in range(extra):
                            put(mine, k, s, own + t, 0)
                    more = np.flatnonzero(take[:, k])
                    if len(more):
                        s = own + (h[more] % np.uint64(extra)).astype(np.int64)
                        for t in range(own):
                            put(more, k, t, s, 1)
                at = np.concatenate(at)
                for x in range(0, len(at), 5000):
                    o = slice(x, x + 5000)
                    rows_ = part.take(pa.array(at[o]))
                    yield pa.RecordBatch.from_arrays(
                        [rows_.column(4)] + [pa.array(np.concatenate(z)[o].astype(np.int32)) for z in (cell, a, b, side)]
                        + [rows_.column(i) for i in range(4)],
                        names=["n", "cell", "a", "b", "side", "u", "h", "v", "m"])

    found = materialize(
        placed.mapInArrow(dealt, "n int, cell int, a int, b int, side int, u binary, h long, v long, m long")
        .groupBy("n", "cell", "a", "b").applyInArrow(_join(least), "v long, h long, links long, c long"))
    links = found.filter("c is null").groupBy("v", "h").agg(F.sum("links").alias("links"))
    classes = components(found.filter("c is not null").select(F.col("v").alias("a"), F.col("c").alias("b")))
    # A vec_id that stands on several vectors joins their groups too.
    named = (reps.select("h", "h2", "v", "m").join(links, ["v", "h"], "left").join(classes, "v", "left")
             .select("h", "h2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"),
                     F.coalesce("c", "v").alias("class")))
    key = F.when(F.expr(usable), F.col("h"))
    out = rows.select("vec_id", key.alias("h"), "h2").join(named, ["h", "h2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("class", "vec_id").alias("component_id"),
                      F.col("vec_id").eqNullSafe(F.coalesce("class", "vec_id")).alias("kept"))
