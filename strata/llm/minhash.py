"""Operator 1: near-duplicate documents by a chosen-path set similarity join.

A document is its set of word shingles. Each set gets ``COORDINATES`` minwise tokens. A tree
branches the documents: a node picks one or two coordinates (1 / lambda of them on average)
by a hash of its path, and a document goes to the child named by its minwise token at each.
Similar documents agree on most tokens and stay together; others part. Nodes of one document
end; nodes of up to ``NODE`` documents are compared exhaustively; larger ones are compared
with one document of theirs (a pivot) and branched again. After ``LEVELS`` levels the classes
found so far are computed: a large node whose documents are all in one class ends, the
others branch on. Independent trees are run until the target recall: a pair at the threshold s
shares a first-level node in one tree with probability of at least s, so ``TREES`` trees
miss it with (1 - s) ** TREES (6e-9 for 0.85 and ten trees).

Comparison uses the tokens to estimate similarity with a slack of five standard deviations;
every link is then confirmed on the full sets. Equal sets are collapsed before the trees, so
a group of copies of any size is one vertex. In an exhaustive node the surest links come
first (a spanning forest); once confirmed, pairs inside a class need no comparison. Likely
links that still would join classes are borderline pairs; they are counted exactly, all
pairs of a node at once, in the nodes of all trees: ``BORDER`` trees at a time, with the
classes computed anew in between, so that later trees find few. Classes are what is
returned; no group's pairs leave a task.

Cases: NULL or blank text gives an empty set, linked with nothing and kept; fewer words than
a shingle count as one shingle; an empty table gives no rows; rows that share a doc_id are
one vertex; a NULL doc_id links only through an equal set and its class may be NULL; extra
columns are ignored. Sets hold 64-bit fingerprints of shingles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strata.llm._graph import components, forget_shuffles
from strata.llm._text import BYTE_UNITS, LOWER, Rolling, U, mix, release, slices, word_bounds
from strata.session import materialize

COORDINATES = 128          # minwise tokens that estimate similarity, by one byte each
BRANCHING = 64             # the first of them, whole, branch the trees
TREES = 10
NODE = 2048
BORDER = 5                 # trees at a time in which likely links between classes are counted exactly
LEVELS = 6                 # levels of a tree before classes are computed and nodes of one class end
FACTORS = (mix(np.arange(1, COORDINATES + 1, dtype=U)) >> U(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(column: pa.Array, size: int, rolling: Rolling):
    """Per row the sorted distinct 64-bit fingerprints of its ``size``-word shingles."""
    for _, _, data, offsets in slices(column):
        start, end, row = word_bounds(data, offsets)
        words = rolling.spans(rolling.sums(BYTE_UNITS[LOWER[data]]), start, end)
        at = np.searchsorted(row, np.arange(len(offsets)))
        sums = rolling.sums(words)
        windows = rolling.windows(sums, size)
        for i in range(len(offsets) - 1):
            a, b = at[i], at[i + 1]
            if b - a >= size:
                yield np.unique(windows[a:b - size + 1])
            elif b > a:
                yield rolling.spans(sums, np.array([a]), np.array([b]))
            else:
                yield words[:0]


def _sketches(size: int):
    def run(batches):
        rolling = Rolling()
        for batch in batches:
            n, k1, k2, tokens, marks = [], [], [], [], []
            for part in _groups(shingle_sets(batch.column(1), size, rolling)):
                sizes = np.array([len(s) for s in part])
                full = np.flatnonzero(sizes)
                flat = np.concatenate(part)
                cut = np.concatenate(([0], np.cumsum(sizes[full])[:-1])).astype(np.int64)
                out = np.zeros((len(part), COORDINATES), np.uint32)
                keys = np.zeros((2, len(part)), U)
                if len(full):
                    low = (flat >> U(32)).astype(np.uint32)
                    for c in range(COORDINATES):
                        out[full, c] = np.minimum.reduceat(low * FACTORS[c], cut)
                    keys[0, full] = np.add.reduceat(mix(flat), cut)
                    keys[1, full] = np.add.reduceat(mix(flat ^ U(0xA5A5A5A5A5A5A5A5)), cut)
                n.append(sizes)
                k1.append(keys[0].view(np.int64))
                k2.append(keys[1].view(np.int64))
                tokens += [x.tobytes() for x in out[:, :BRANCHING]]
                marks += [x.tobytes() for x in out.astype(np.uint8)]
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(cat(n), pa.int64()),
                 pa.array(cat(k1)), pa.array(cat(k2)), pa.array(tokens, pa.binary()), pa.array(marks, pa.binary())],
                names=["doc_id", "print_a", "print_b", "n", "k1", "k2", "tokens", "marks"])
        release()
    return run


def _groups(sets, items: int = 200_000):
    """Lists of sets with about ``items`` elements together."""
    part, held = [], 0
    for s in sets:
        part.append(s)
        held += len(s)
        if held >= items:
            yield part
            part, held = [], 0
    if part:
        yield part


def _matrix(column, kind=np.uint8) -> np.ndarray:
    """A binary column of equally long arrays as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    width = COORDINATES if kind == np.uint8 else BRANCHING
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros((0, width), kind)
    first = np.frombuffer(column.buffers()[1], np.int64)[column.offset]
    return np.frombuffer(column.buffers()[2], kind, len(column) * width, first).reshape(-1, width)


def _children(spread: float):
    """Rows (v, node, tokens, tree) to the rows (v, node, tree) of their child nodes."""
    def run(batches):
        for batch in batches:
            tokens = _matrix(batch.column(2), np.uint32)
            node = batch.column(1).to_numpy().view(U)
            v, tree = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            h = mix(node ^ U(0x51ED270B1F3A9C4D))
            first = (h >> U(8)).astype(np.int64) % BRANCHING
            step = 1 + (h >> U(24)).astype(np.int64) % (BRANCHING - 1)
            twice = (h >> U(40)).astype(np.float64) / (1 << 24) < spread - 1
            outs = []
            for pick, rows in ((first, np.arange(len(v))), ((first + step) % BRANCHING, np.flatnonzero(twice))):
                c = pick[rows]
                child = mix(node[rows] + mix(tokens[rows, c].astype(U) | (c.astype(U) << U(32))))
                outs.append((v[rows], child, tree[rows]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([o[0] for o in outs])),
                 pa.array(np.concatenate([o[1] for o in outs]).view(np.int64)),
                 pa.array(np.concatenate([o[2] for o in outs]))], names=["v", "node", "tree"])
    return run


def _by_node(batches, emit):
    """Feeds batches sorted by node to ``emit`` as tables of whole nodes."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        node = table.column("node").to_numpy()
        if not len(node):
            continue
        last = int(np.searchsorted(node, node[-1], "left"))
        rest = table.slice(last)
        if last:
            yield from emit(table.slice(0, last).combine_chunks())
    if rest is not None:
        yield from emit(rest.combine_chunks())
    release()


def _cuts(node: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, node[1:] != node[:-1], True])


def _likely(least: float, c, marks, cut):
    """Pairs of one node and of different classes that are likely links: (i, j, the node's
    first row, how many marks agree)."""
    size = np.diff(cut)

    def pairs():
        for m in range(2, 17):                    # all nodes of one size together
            at = cut[:-1][size == m]
            if len(at):
                x, y = np.triu_indices(m, 1)
                yield (at[:, None] + x).ravel(), (at[:, None] + y).ravel(), np.repeat(at, len(x))
        for k in np.flatnonzero(size > 16):
            for x in range(cut[k], cut[k + 1] - 1):
                y = np.arange(x + 1, cut[k + 1])
                yield np.full(len(y), x), y, np.full(len(y), cut[k])

    found = [[np.zeros(0, np.int64)] * 4]
    for x, y, node in pairs():
        for s in range(0, len(x), 20_000):
            p, q, r = x[s:s + 20_000], y[s:s + 20_000], node[s:s + 20_000]
            ok = c[p] != c[q]
            p, q, r = p[ok], q[ok], r[ok]
            agree = (marks[p] == marks[q]).sum(axis=1)
            ok = agree >= least * COORDINATES
            found.append((p[ok], q[ok], r[ok], agree[ok]))
    return [np.concatenate(f) for f in zip(*found)]


def _surest(least: float):
    """Rows (node, v, c, marks) sorted by node to the pairs (a, b) of a spanning forest of each
    node's likely links, the surest first."""
    def emit(table):
        v, c = table.column("v").to_numpy(), table.column("c").to_numpy()
        p, q, node, agree = _likely(least, c, _matrix(table.column("marks")), _cuts(table.column("node").to_numpy()))
        keep = _forest(p, q, node, agree, c, v)
        pairs = np.unique(np.sort(np.stack((v[p[keep]], v[q[keep]])), axis=0), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return lambda batches: _by_node(batches, emit)


def _open(least: float):
    """Rows (node, v, c, marks) to the rows (node, v, c) that still have a likely link to
    another class of their node."""
    def emit(table):
        p, q, _, _ = _likely(least, table.column("c").to_numpy(), _matrix(table.column("marks")),
                             _cuts(table.column("node").to_numpy()))
        yield from table.select(["node", "v", "c"]).take(pa.array(np.unique(np.concatenate((p, q))))).to_batches()

    return lambda batches: _by_node(batches, emit)


def _exact(percent: int, columns: int = 4096):
    """Rows (node, v, c, s) with full sets, sorted by node, to links (a, b): all pairs of a node
    are counted by products of its incidence matrix, and links that join classes go out."""
    def emit(table):
        v, c = table.column("v").to_numpy(), table.column("c").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), U) for x in table.column("s")]
        cut = _cuts(table.column("node").to_numpy())
        a, b = [], []
        for x, y in zip(cut[:-1], cut[1:]):
            here = sets[x:y]
            size = np.array([len(s) for s in here])
            row = np.repeat(np.arange(y - x), size)
            _, column, often = np.unique(np.concatenate(here), return_inverse=True, return_counts=True)
            shared = often > 1                    # only these count for an intersection
            rank = np.cumsum(shared) - 1
            ok = shared[column]
            row, column = row[ok], rank[column[ok]]
            both = np.zeros((y - x, y - x), np.float32)
            for start in range(0, int(shared.sum()), columns):
                inside = (column >= start) & (column < start + columns)
                matrix = np.zeros((y - x, columns), np.float32)
                matrix[row[inside], column[inside] - start] = 1
                both += matrix @ matrix.T
            both = both.astype(np.int64)
            linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
            linked |= c[x:y, None] == c[None, x:y]
            for i, j in _tree(linked):
                if c[x + i] != c[x + j]:
                    a.append(min(v[x + i], v[x + j]))
                    b.append(max(v[x + i], v[x + j]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return lambda batches: _by_node(batches, emit)


def _tree(linked: np.ndarray):
    """Edges of breadth-first trees of a symmetric link matrix."""
    todo = np.ones(len(linked), bool)
    for start in range(len(linked)):
        if not todo[start]:
            continue
        todo[start] = False
        frontier = np.array([start])
        while len(frontier):
            fresh = np.flatnonzero(linked[frontier].any(axis=0) & todo)
            if len(fresh):
                yield from zip(frontier[linked[np.ix_(frontier, fresh)].argmax(axis=0)].tolist(), fresh.tolist())
            todo[fresh] = False
            frontier = fresh


def _forest(p, q, node, agree, c, v) -> list:
    """Indices of the pairs that a maximum spanning forest of each node takes."""
    order = np.lexsort((v[q], v[p], -agree, node))
    parent: dict = {}

    def top(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    keep, here = [], None
    for k in order.tolist():
        if node[k] != here:
            here = node[k]
            parent.clear()
        a, b = top(c[p[k]]), top(c[q[k]])
        if a != b:
            parent[a] = b
            keep.append(k)
    return keep


def _with_pivot(least: float):
    """Rows (v, marks, pivot, pivot's marks) to the pairs that are likely links."""
    def run(batches):
        for batch in batches:
            v, pivot = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            agree = (_matrix(batch.column(1)) == _matrix(batch.column(3))).sum(axis=1)
            ok = (agree >= least * COORDINATES) & (v != pivot)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(v, pivot)[ok]), pa.array(np.maximum(v, pivot)[ok])], names=["a", "b"])
    return run


def _confirm(percent: int):
    """Pairs with both full sets to those with 100 * intersection >= percent * union."""
    def run(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            ok = []
            for i in range(batch.num_rows):
                s = np.frombuffer(x[i].as_buffer(), U)
                t = np.frombuffer(y[i].as_buffer(), U)
                both = len(s) + len(t) - len(np.unique(np.concatenate((s, t))))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def row_prints(id_col: str, text_col: str) -> list:
    """Two fingerprints of a row's id and text; rows that agree in both have the same."""
    i, text = F.col(id_col).cast("long"), F.col(text_col)
    return [F.xxhash64(i, F.lit("i"), text).alias("print_a"), F.xxhash64(text, F.lit("t"), i).alias("print_b")]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    percent: int = 85, trees: int = TREES, node_size: int = NODE,
                    keep_prints: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable
    by links of similarity >= percent / 100) and kept (doc_id = component_id); with
    ``keep_prints`` also print_a and print_b, which name the row (``row_prints``)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"),
                       *row_prints(id_col, text_col))
    spark = docs.sparkSession
    s = percent / 100
    spread = 1 / max(0.5, s - 0.05)               # children of a node, on average
    least = s - 5.2 * math.sqrt(s * (1 - s) / COORDINATES)
    rows = materialize(docs.mapInArrow(
        _sketches(shingle), "doc_id long, print_a long, print_b long, n long, k1 long, k2 long, tokens binary, marks binary"))
    reps = materialize(rows.filter("n > 0").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("v"), F.first("tokens").alias("tokens"), F.first("marks").alias("marks")))
    usable = reps.filter("v is not null")
    vertices, marked = usable.select("v", "tokens"), usable.select("v", "marks")

    def sets(pairs: DataFrame) -> DataFrame:
        """(v, set) of the pairs' ends, from their whole texts."""
        def run(batches):
            rolling = Rolling()
            for batch in batches:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([x.tobytes() for x in shingle_sets(batch.column(1), shingle, rolling)],
                                               pa.binary())], names=["v", "s"])
        ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        return materialize(docs.select("doc_id", "t").join(ends, "doc_id", "left_semi")
                           .mapInArrow(run, "v long, s binary"))

    def confirmed(pairs: DataFrame, full: DataFrame) -> DataFrame:
        with_a = pairs.join(full.toDF("a", "x"), "a")
        return materialize(with_a.join(full.toDF("b", "y"), "b").select("a", "b", "x", "y")
                           .mapInArrow(_confirm(percent), "a long, b long").distinct())

    def branched(nodes: DataFrame) -> DataFrame:
        """Child nodes of two documents and more: (node, v, size)."""
        level = nodes.select("v", "node", "tokens", "tree").mapInArrow(_children(spread), "v long, node long, tree int")
        sizes = level.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        return materialize(level.join(sizes, "node").select("node", "v", "tree", "size"))

    def mixed(nodes: DataFrame, classes: DataFrame) -> DataFrame:
        """The rows (node, v, c) of the nodes that hold more than one class."""
        named = nodes.select("node", "v", "tree").join(classes, "v", "left").select(
            "node", "v", "tree", F.coalesce("c", "v").alias("c"))
        many = named.groupBy("node").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi")
        return materialize(named.join(many.select("node"), "node", "left_semi"))

    def by_node(nodes: DataFrame, column: DataFrame) -> DataFrame:
        return nodes.join(column, "v").repartition("node").sortWithinPartitions("node", "v")

    def compared(nodes: DataFrame, what) -> DataFrame:
        return by_node(nodes.select("node", "v", "c"), marked).select("node", "v", "c", "marks").mapInArrow(
            what(least), "a long, b long" if what is _surest else "node long, v long, c long")

    def with_pivots(big: DataFrame) -> DataFrame:
        rows_ = big.join(marked, "v").select("node", "v", "marks")
        pivot = rows_.groupBy("node").agg(
            F.min(F.struct(F.xxhash64("node", "v").alias("h"), F.col("v").alias("pivot"),
                           F.col("marks").alias("its"))).alias("p")).select("node", "p.pivot", "p.its")
        return (rows_.join(pivot, "node").select("v", "marks", "pivot", "its")
                .mapInArrow(_with_pivot(least), "a long, b long"))

    def grown(nodes: DataFrame, levels: int):
        """Branches ``nodes`` up to ``levels`` times: small nodes, the large ones left over (or
        None), and the likely links of a spanning forest of each small node and of pivots."""
        leaves, pairs = None, None
        for _ in range(levels):
            level = branched(nodes)
            small, big = level.filter(F.col("size") <= node_size), level.filter(F.col("size") > node_size)
            leaves = small if leaves is None else leaves.unionByName(small)
            if big.isEmpty():
                big = None
                break
            found = with_pivots(big)
            pairs = found if pairs is None else pairs.unionByName(found)
            nodes = big.join(vertices, "v").select("v", "node", "tokens", "tree")
        found = compared(leaves.withColumn("c", F.col("v")), _surest)
        pairs = found if pairs is None else pairs.unionByName(found)
        return leaves, big, materialize(pairs.distinct())

    roots = F.posexplode(F.array(*[F.lit(int(x)) for x in mix(np.arange(7, 7 + trees, dtype=U)).view(np.int64)]))
    nodes = vertices.select("v", "tokens", roots.alias("tree", "node")).select("v", "node", "tokens", "tree")
    links, classes = None, None
    while nodes is not None:
        leaves, big, pairs = grown(nodes, LEVELS)
        full = sets(pairs)
        forget_shuffles(spark)
        found = confirmed(pairs, full)
        links = found if links is None else links.unionByName(found)
        # Labels of a few rounds will do here: a class that is still in pieces costs only
        # comparisons that were not needed.
        classes = components(links, rounds=2)
        forget_shuffles(spark)
        # What the forests leave open: likely links between classes, in all trees. Their ends
        # are ends of a forest too, so their sets are at hand.
        for first in range(0, trees, BORDER):
            here = leaves.filter(F.col("tree").between(first, first + BORDER - 1))
            rest = materialize(compared(mixed(here, classes), _open))
            if not rest.isEmpty():
                found = by_node(rest, full.toDF("v", "s").dropDuplicates(["v", "s"])).select("node", "v", "c", "s")
                links = links.unionByName(materialize(found.mapInArrow(_exact(percent), "a long, b long").distinct()))
                if first + BORDER < trees:
                    classes = components(links, rounds=2)
            forget_shuffles(spark)
        classes = components(links)
        nodes = None
        if big is not None:
            left = mixed(big, classes)
            if not left.isEmpty():
                nodes = left.join(vertices, "v").select("v", "node", "tokens", "tree")
    forget_shuffles(spark)
    named = (reps.select("k1", "k2", F.col("v")).join(classes, "v", "left")
             .select("k1", "k2", F.coalesce("c", "v").alias("class")))
    prints = ["print_a", "print_b"] if keep_prints else []
    out = rows.select("doc_id", *prints, "n", F.when(F.col("n") > 0, F.col("k1")).alias("k1"), "k2")
    out = out.join(named, ["k1", "k2"], "left").withColumn("component_id", F.coalesce("class", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *prints)
