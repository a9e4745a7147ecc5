"""Exact threshold pairs of embeddings by dual traversal of cover trees.

Vectors of one label are dealt into blocks of bounded size: by the nearest of
a few pivots, so that a block is compact, and by hash where a pivot draws too
many.  Each block becomes a cover tree: nested levels of nodes whose covering
radii halve from level to level.  On the unit sphere a cosine bound is a
distance bound, so for two nodes with centre distance d and radii r, s

* no pair links if d - r - s exceeds the bound,
* every pair links if d + r + s is within it, and is counted without visiting,
* otherwise their children are compared.

Pairs of blocks are pruned the same way by their roots.  Pairs of points near
the bound are decided by their cosine in double precision.  A traversal
returns link counts and a spanning forest of the links, never all pairs.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import longs, map_arrow, sorted_runs, written
from .components import connected_components

COSINE = 0.98
BLOCK = 2048  # vectors of a block, about
PIVOTS = 64  # pivots at most, the vectors with the smallest hashes of vec_id
LEAF = 24  # points of a node that is not divided any more
SLACK = 1e-6  # rounding of distances; closer decisions go to the points


@dataclass
class Tree:
    """Points in tree order and nodes as arrays; children are contiguous."""

    ids: np.ndarray
    weight: np.ndarray  # copies that each point stands for
    raw: np.ndarray
    unit: np.ndarray
    centre: np.ndarray  # point of each node
    radius: np.ndarray
    lo: np.ndarray  # points of each node
    hi: np.ndarray
    first: np.ndarray  # children of each node; none for a leaf
    last: np.ndarray


def unit_rows(raw: np.ndarray) -> np.ndarray:
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def build(ids: np.ndarray, weight: np.ndarray, raw: np.ndarray) -> Tree:
    """Cover tree of a block of non-zero vectors."""
    unit = unit_rows(raw)
    dist = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (unit @ unit.T)))
    order = np.arange(len(ids))
    centre, radius, lo, hi, first, last = [0], [float(dist[0].max())], [0], [len(ids)], [0], [0]
    node = 0
    while node < len(centre):
        members = order[lo[node] : hi[node]].copy()
        if len(members) > LEAF and radius[node] > SLACK:
            half, rest, at, c = radius[node] / 2, members, lo[node], centre[node]
            first[node] = len(centre)
            while len(rest):
                d = dist[c, rest]
                near = d <= half
                near[rest == c] = True
                taken = rest[near]
                order[at : at + len(taken)] = taken
                centre.append(int(c))
                radius.append(float(d[near].max()))
                lo.append(at)
                hi.append(at + len(taken))
                first.append(0)
                last.append(0)
                at += len(taken)
                rest = rest[~near]
                c = rest[0] if len(rest) else c
            last[node] = len(centre)
        node += 1
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Tree(
        ids[order], weight[order], raw[order], unit[order], place[np.array(centre)], np.array(radius),
        np.array(lo), np.array(hi), np.array(first), np.array(last),
    )


class _Parts:
    """What a node is compared by: its children, or its points if it is a leaf.
    Point k alone has the node number -1 - k."""

    def __init__(self, tree: Tree, node: int):
        a, b = (tree.first[node], tree.last[node]) if node >= 0 else (0, 0)
        if b > a:
            self.node = np.arange(a, b)
            self.lo, self.hi, self.radius = tree.lo[a:b], tree.hi[a:b], tree.radius[a:b]
            self.unit = tree.unit[tree.centre[a:b]]
        else:
            self.lo = np.arange(tree.lo[node], tree.hi[node]) if node >= 0 else np.array([-1 - node])
            self.hi, self.radius = self.lo + 1, np.zeros(len(self.lo))
            self.node = -1 - self.lo
            self.unit = tree.unit[self.lo]


def traverse(x: Tree, y: Tree, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Dual traversal of two trees (or of one with itself: ``x is y``).

    Returns the weight linked to each point of x and of y, and pairs of
    points (indices into x and y) that connect all points that links connect."""
    reach = np.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    count_x = np.zeros(len(x.ids), np.int64)
    count_y = count_x if x is y else np.zeros(len(y.ids), np.int64)
    sum_x, sum_y = np.r_[0, np.cumsum(x.weight)], np.r_[0, np.cumsum(y.weight)]
    norm_x, norm_y = np.linalg.norm(x.raw, axis=1), np.linalg.norm(y.raw, axis=1)
    pairs_x, pairs_y = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def all_link(a, b, c, d):
        """Points a..b of x and c..d of y, all linked with each other."""
        if x is y and a == c:
            count_x[a:b] += sum_x[b] - sum_x[a] - x.weight[a:b]
            pairs_x.append(np.full(b - a, a))
            pairs_y.append(np.arange(a, b))
            return
        count_x[a:b] += sum_y[d] - sum_y[c]
        count_y[c:d] += sum_x[b] - sum_x[a]
        pairs_x.extend((np.full(d - c, a), np.arange(a, b)))
        pairs_y.extend((np.arange(c, d), np.full(b - a, c)))

    stack = [(0, 0)]
    while stack:
        i, j = stack.pop()
        same = x is y and i == j
        p = _Parts(x, i)
        q = p if same else _Parts(y, j)
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (p.unit @ q.unit.T)))
        radii = p.radius[:, None] + q.radius[None, :]
        open_ = d - radii <= reach + SLACK
        if same:
            open_ &= np.triu(np.ones(open_.shape, bool))
        a, b = np.nonzero(open_)
        both = (p.hi[a] - p.lo[a] == 1) & (q.hi[b] - q.lo[b] == 1)
        u, v = p.lo[a[both]], q.lo[b[both]]
        if same:
            u, v = u[u != v], v[u != v]
        linked = np.einsum("ij,ij->i", x.raw[u], y.raw[v]) / (norm_x[u] * norm_y[v]) >= cosine
        u, v = u[linked], v[linked]
        np.add.at(count_x, u, y.weight[v])
        np.add.at(count_y, v, x.weight[u])
        pairs_x.append(u)
        pairs_y.append(v)
        a, b = a[~both], b[~both]
        sure = d[a, b] + radii[a, b] <= reach - SLACK
        if same:  # a part with itself: any two of its points are within twice its radius
            sure = np.where(a == b, 2 * p.radius[a] <= reach - SLACK, sure)
        for s, t in zip(a[sure], b[sure]):
            all_link(int(p.lo[s]), int(p.hi[s]), int(q.lo[t]), int(q.hi[t]))
        for s, t in zip(a[~sure], b[~sure]):
            stack.append((int(p.node[s]), int(q.node[t])))
    return count_x, count_y, np.concatenate(pairs_x), np.concatenate(pairs_y)


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest connected index of each of n points under pairs (u, v)."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


# --- on Spark -----------------------------------------------------------------

_ROWS = "vec_id long, label long, size int, h1 long, h2 long, vec binary"


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors that can link, as doubles, with a 128-bit hash of label and vector."""
    for batch in batches:
        out = []
        for vec_id, label, vec in zip(
            batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        ):
            if vec_id is None or label is None or not vec or None in vec:
                continue
            x = np.asarray(vec, np.float64) + 0.0  # -0.0 is 0.0
            norm = np.linalg.norm(x)
            if not (np.isfinite(x).all() and 0 < norm < np.inf):
                continue
            data = x.tobytes()
            h = xxhash.xxh3_128_intdigest(data, seed=label & 0xFFFFFFFF)
            out.append((vec_id, label, len(x), _signed(h >> 64), _signed(h & ((1 << 64) - 1)), data))
        cols = list(zip(*out)) if out else [[]] * 6
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, types)], names=["vec_id", "label", "size", "h1", "h2", "vec"]
        )


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _cells(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Nearest of the first ``pivots`` pivots of the same size."""
    pivots: dict[int, np.ndarray] = shared.value
    for batch in batches:
        vecs, use = batch.column("vec").to_pylist(), batch.column("pivots").to_pylist()
        cell = np.zeros(len(vecs), np.int64)
        for i, data in enumerate(vecs):
            x = np.frombuffer(data)
            some = pivots.get(len(x), np.empty((0, len(x))))[: use[i]]
            if len(some) > 1:
                cell[i] = int((some @ x).argmax())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("label", "size", "rep", "copies", "vec")), pa.array(cell)],
            names=["label", "size", "rep", "copies", "vec", "cell"],
        )


_TREES = (
    "label long, size int, cell long, chunk long, centre binary, radius double, ids binary, weights binary, "
    "vecs binary, nodes binary"
)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in sorted_runs(batches, ["label", "size", "cell", "chunk"]):
        raw = np.frombuffer(b"".join(group.column("vec").to_pylist())).reshape(group.num_rows, -1)
        tree = build(longs(group.column("rep")), longs(group.column("copies")), raw)
        nodes = np.stack([tree.centre, tree.radius, tree.lo, tree.hi, tree.first, tree.last]).astype(np.float64)
        key = [group.column(k).slice(0, 1).combine_chunks() for k in ("label", "size", "cell", "chunk")]
        values = [tree.unit[tree.centre[0]].tobytes(), float(tree.radius[0]), tree.ids.tobytes(), tree.weight.tobytes(),
                  tree.raw.tobytes(), nodes.tobytes()]
        types = [pa.binary(), pa.float64(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays(
            [*key, *(pa.array([v], t) for v, t in zip(values, types))],
            names=["label", "size", "cell", "chunk", "centre", "radius", "ids", "weights", "vecs", "nodes"],
        )


def _loaded(ids: bytes, weights: bytes, vecs: bytes, nodes: bytes) -> Tree:
    ids = np.frombuffer(ids, np.int64)
    raw = np.frombuffer(vecs).reshape(len(ids), -1)
    table = np.frombuffer(nodes).reshape(6, -1)
    centre, lo, hi, first, last = (table[i].astype(np.int64) for i in (0, 2, 3, 4, 5))
    return Tree(ids, np.frombuffer(weights, np.int64), raw, unit_rows(raw), centre, table[1], lo, hi, first, last)


def _near_roots(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    reach = np.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    for batch in batches:
        keep = []
        for a, b, r, s in zip(*(batch.column(c).to_pylist() for c in ("centre", "centre2", "radius", "radius2"))):
            keep.append(np.linalg.norm(np.frombuffer(a) - np.frombuffer(b)) - r - s <= reach + SLACK)
        yield batch.select(["label", "size", "cell", "chunk", "cell2", "chunk2"]).filter(pa.array(keep, pa.bool_()))


def _links(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Link weights (a vector, weight) and forest links (a vector, another)."""
    names = ("ids", "weights", "vecs", "nodes")
    for batch in batches:
        for i in range(batch.num_rows):
            x = _loaded(*(batch.column(c)[i].as_py() for c in names))
            own = batch.column("cell")[i] == batch.column("cell2")[i] and batch.column("chunk")[i] == batch.column("chunk2")[i]
            y = x if own else _loaded(*(batch.column(c + "2")[i].as_py() for c in names))
            count_x, count_y, u, v = traverse(x, y, cosine)
            if own:
                ids, counts = x.ids, count_x
            else:
                ids, counts, v = np.r_[x.ids, y.ids], np.r_[count_x, count_y], v + len(x.ids)
            root = forest(len(ids), u, v)
            some, more = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[ids[some], ids[more]]), pa.array(np.r_[counts[some], ids[root[more]]]),
                 pa.array(np.r_[np.zeros(len(some), bool), np.ones(len(more), bool)])],
                names=["a", "b", "link"],
            )


def embedding_links(embeddings: DataFrame, cosine: float = COSINE, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """Vectors of equal label whose cosine reaches ``cosine``.

    ``embeddings`` needs vec_id (long), embedding (array of numbers) and label
    (integer); other columns are ignored.  Returns one row per input row:
    vec_id, n_links (other vectors linked directly), component_id (smallest
    vec_id reachable by links, itself included) and kept (vec_id is the
    component).  Vectors that are null, empty, zero or hold null or non-finite
    components, and those with a null label, link with nothing, nor do vectors
    of different lengths.  Equal vectors link like any others; rows that
    repeat a vec_id count as vectors of their own in n_links.  A null vec_id
    has no links and a null component.  Pivots only shape the blocks: any
    choice gives the same links.
    """
    spark = embeddings.sparkSession
    given = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )
    rows = written(map_arrow(given, _valid, _ROWS), "vectors")
    # one point for equal vectors
    key = ["label", "size", "h1", "h2"]
    points = rows.groupBy(*key).agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")
    )
    points = written(points, "points")
    groups = points.groupBy("label", "size").agg(
        F.least(F.ceil(F.count("*") / block), F.lit(pivots)).cast("int").alias("pivots")
    )
    chosen: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect():
        chosen.setdefault(r["size"], []).append(np.frombuffer(bytes(r["vec"])))
    shared = spark.sparkContext.broadcast({n: unit_rows(np.stack(v)) for n, v in chosen.items()})
    celled = map_arrow(
        points.join(groups, ["label", "size"]).select("label", "size", "rep", "copies", "vec", "pivots"),
        lambda it: _cells(it, shared),
        "label long, size int, rep long, copies long, vec binary, cell long",
    )
    celled = written(celled, "cells")
    chunks = celled.groupBy("label", "size", "cell").agg(F.ceil(F.count("*") / block).alias("chunks"))
    blocked = celled.join(chunks, ["label", "size", "cell"]).withColumn("chunk", F.expr("pmod(xxhash64(rep), chunks)"))
    order = ["label", "size", "cell", "chunk"]
    blocked = blocked.select(*order, "rep", "copies", "vec")
    trees = written(
        map_arrow(blocked.repartition(*order).sortWithinPartitions(*order), _trees, _TREES), "trees"
    )
    roots = trees.select(*order, "centre", "radius")
    other = roots.select("label", "size", *[F.col(c).alias(c + "2") for c in ("cell", "chunk", "centre", "radius")])
    near = map_arrow(
        roots.join(other, ["label", "size"]).where("struct(cell, chunk) <= struct(cell2, chunk2)"),
        lambda it: _near_roots(it, cosine),
        "label long, size int, cell long, chunk long, cell2 long, chunk2 long",
    )
    body = ["ids", "weights", "vecs", "nodes"]
    second = trees.select(
        "label", "size", F.col("cell").alias("cell2"), F.col("chunk").alias("chunk2"), *[F.col(c).alias(c + "2") for c in body]
    )
    pairs = near.join(trees.select(*order, *body), order).join(second, ["label", "size", "cell2", "chunk2"])
    found = written(
        map_arrow(pairs.repartition("label", "size", "cell", "chunk", "cell2", "chunk2"), lambda it: _links(it, cosine), "a long, b long, link boolean"),
        "links",
    )
    counts = found.where("not link").groupBy("a").agg(F.sum("b").alias("others"))
    linked = connected_components(found.where("link").select("a", "b"), "vector-components")
    named = (
        rows.select("vec_id", *key)
        .join(points.select(*key, "rep", "copies"), key)
        .join(counts, F.col("rep") == F.col("a"), "left")
        .join(linked, F.col("rep") == F.col("node"), "left")
        .groupBy(F.col("vec_id").alias("id"))
        .agg(
            F.max(F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.min(F.coalesce("component", "rep")).alias("component_id"),
        )
    )
    return (
        given.select("vec_id")
        .join(named, F.col("vec_id") == F.col("id"), "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
            (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"),
        )
    )
