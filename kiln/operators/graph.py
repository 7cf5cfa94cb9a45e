"""Knowledge graphs as tables: vertices (name, type, lang), edges (src < dst, weight). Loops over joins; lineage is cut into the shared folder each round.

Defined results: null names are no vertices; reversed and repeated relations make one edge; self-loops are kept by build() and left out by the
algorithms; ties go to the smaller name; an empty graph gives empty results.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.session import cut, release

#: Edges of one component that the per-component operators (cycle basis, articulation points, depth-first search) take; larger ones are refused.
MAX_COMPONENT = 500_000
#: Rounds after which the tables of a loop are folded into one.
FOLD = 32
#: Edges up to which searches from many vertices hold the graph as numbers in every task; larger ones are searched by joins.
NUMBERED = 2_000_000
#: Vertices from which a task searches at once, a bit each.
ROOTS = 1024


def build(relations: DataFrame) -> DataFrame:
    """(src, dst, weight, merged, description): one undirected edge for the relations (source, target, weight, description) between two names, in either direction."""
    r = relations.filter("source is not null and target is not null")
    ends = r.select(F.least("source", "target").alias("src"), F.greatest("source", "target").alias("dst"), "weight", "description")
    return ends.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.count("*").alias("merged"), F.array_join(F.array_sort(F.collect_set("description")), "\n").alias("description"))


def complete(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertices with the ends of edges that are none of them, with nulls beside the name."""
    ends = both(edges).select(F.col("src").alias("name")).distinct().join(vertices.select("name"), "name", "left_anti")
    return vertices.unionByName(ends, allowMissingColumns=True)


def both(edges: DataFrame) -> DataFrame:
    """Edges without loops in both directions."""
    e = edges.filter("src <> dst")
    return e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, degree) of every vertex; isolated ones have 0."""
    d = both(edges).groupBy(F.col("src").alias("name")).agg(F.count("*").alias("degree"))
    return vertices.select("name").distinct().join(d, "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, component): the smallest name of the component. Each round takes the least label about a vertex and then the label of that label, so that rounds grow with the logarithm of the diameter; they end when no label falls.

    The join on labels has one row a name on its right side, so the rows of a giant component on the left are split by the skew join of adaptive execution."""
    pairs = cut(both(edges))
    labels = before = cut(vertices.select("name").distinct().withColumn("component", F.col("name")))
    while True:
        near = pairs.join(labels.select(F.col("name").alias("dst"), F.col("component").alias("other")), "dst").groupBy(F.col("src").alias("name")).agg(F.min("other").alias("other"))
        step = labels.join(near, "name", "left").select("name", F.col("component").alias("old"), F.least("component", F.coalesce("other", "component")).alias("mid"))
        jump = step.select(F.col("name").alias("mid"), F.col("mid").alias("far"))
        new = cut(step.join(jump, "mid", "left").select("name", "old", F.least("mid", F.coalesce("far", "mid")).alias("component")))
        release(before)
        before, labels = new, new.select("name", "component")
        if new.filter("old <> component").isEmpty():
            return labels


def bfs(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(seed, name, distance): shortest distances from each seed (column seed) up to depth, or to all that it reaches. A frontier meets its neighbours; what is reached is left out."""
    pairs = cut(both(edges))
    reached = cut(seeds.select("seed").distinct().select("seed", F.col("seed").alias("name"), F.lit(0).alias("distance")))
    frontier = reached
    for d in itertools.count(1) if depth is None else range(1, depth + 1):
        step = frontier.select("seed", F.col("name").alias("src")).join(pairs, "src").select("seed", F.col("dst").alias("name")).distinct()
        frontier = cut(step.join(reached.select("seed", "name"), ["seed", "name"], "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        if d % FOLD == 0:
            reached = cut(reached)
    return reached


class _Numbered:
    """A graph as numbers: vertices (name, id) in the shared folder, ids from 0; of those with edges, all in one place for the tasks: ids, rows of neighbours, where each row begins."""

    def __init__(self, names: DataFrame, edges: DataFrame):
        # One task numbers them without gaps; there are at most twice NUMBERED.
        self.names = cut(names.select("name").distinct().repartition(1).withColumn("id", F.monotonically_increasing_id()))
        end = lambda c: self.names.select(F.col("name").alias(c), F.col("id").alias(c + "_id"))
        e = both(edges).join(end("src"), "src").join(end("dst"), "dst").select("src_id", "dst_id").toArrow()
        src, dst = e["src_id"].to_numpy(), e["dst_id"].to_numpy()
        order = np.lexsort((dst, src))
        self.ids, first = np.unique(src[order], return_index=True)
        self.shared = names.sparkSession.sparkContext.broadcast((self.ids, np.searchsorted(self.ids, dst[order]).astype(np.int32), first))

    def search(self, roots: np.ndarray, found: Callable[[int, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str, depth: int | None = None) -> DataFrame:
        """What found(distance, ids, ids of the roots of a block, bits of vertices by roots first reached at that distance) gives, for blocks of roots (ids with edges)."""
        spark, shared = self.names.sparkSession, self.shared
        tasks = 2 * spark.sparkContext.defaultParallelism
        size = int(min(ROOTS, max(64, -(-len(roots) // tasks // 64) * 64)))
        at = spark.sparkContext.broadcast(np.searchsorted(self.ids, roots))
        blocks = -(-len(roots) // size)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, near, first = shared.value
            for block in (k for b in batches for k in b.column(0).to_pylist()):
                mine = at.value[block * size : (block + 1) * size]
                seen = np.zeros((len(ids), -(-len(mine) // 64)), np.uint64)
                k = np.arange(len(mine))
                seen[mine, k // 64] = np.uint64(1) << (k % 64).astype(np.uint64)
                new = seen.copy()
                for d in itertools.count(1) if depth is None else range(1, depth + 1):
                    new = np.bitwise_or.reduceat(new[near], first, axis=0) & ~seen
                    if not new.any():
                        break
                    seen |= new
                    yield from found(d, ids, ids[mine], new)

        return spark.range(0, blocks, 1, max(1, blocks)).mapInArrow(run, schema)


def _pairs(d: int, ids: np.ndarray, roots: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, distance, seeds): the vertices with their roots, some thousand at once."""
    for i in range(0, len(ids), 2048):
        v, k = np.nonzero(np.unpackbits(bits[i : i + 2048].view(np.uint8), axis=1, bitorder="little"))
        if len(v):
            there, n = np.unique(v, return_counts=True)
            seeds = pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), pa.array(roots[k]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i + there]), pa.array(np.full(len(n), d, np.int32)), seeds], ["id", "distance", "seeds"])


def bfs_many(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """bfs() up to depth from many seeds: a bit a seed in tasks that hold the whole graph, so that no pair of seed and name is shuffled or kept; by joins where the graph is above NUMBERED edges."""
    edges, seeds = cut(edges.select("src", "dst")), cut(seeds.select("seed").distinct())
    if edges.count() > NUMBERED:
        return bfs(edges, seeds, depth)
    g = _Numbered(both(edges).select(F.col("src").alias("name")), edges)
    roots = np.sort(seeds.select(F.col("seed").alias("name")).join(g.names, "name").select("id").toArrow()["id"].to_numpy())
    names = F.broadcast(g.names)
    far = g.search(roots, _pairs, "id long, distance int, seeds array<long>", depth).join(names, "id").select("name", "distance", F.explode("seeds").alias("id"))
    far = far.join(names.withColumnRenamed("name", "seed"), "id").select("seed", "name", "distance")
    return seeds.select("seed", F.col("seed").alias("name"), F.lit(0).alias("distance")).unionByName(far)


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) of each triangle. Edges point from the end of lower degree, which bounds the paths that are joined for any hub."""
    e = both(edges)
    d = e.groupBy("src").agg(F.count("*").alias("n"))
    ranked = e.join(d, "src").join(d.select(F.col("src").alias("dst"), F.col("n").alias("m")), "dst").filter((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("src") < F.col("dst")))).select("src", "dst", "m")
    ranked = cut(ranked)
    x = ranked.select("src", F.col("dst").alias("p"), F.col("m").alias("pm"))
    y = ranked.select("src", F.col("dst").alias("q"), F.col("m").alias("qm"))
    paths = x.join(y, "src").filter((F.col("pm") < F.col("qm")) | ((F.col("pm") == F.col("qm")) & (F.col("p") < F.col("q"))))
    closed = paths.join(ranked.select(F.col("src").alias("p"), F.col("dst").alias("q")), ["p", "q"])
    s = F.array_sort(F.array("src", "p", "q"))
    return closed.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


def clustering(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, degree, triangles, clustering) of every vertex; below degree 2 clustering is 0."""
    t = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("name")).groupBy("name").agg(F.count("*").alias("triangles"))
    d = degrees(vertices, edges).join(t, "name", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    return d.withColumn("clustering", F.when(F.col("degree") > 1, 2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0))


def forest(vertices: DataFrame, edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(name, parent, level): a breadth-first tree of each component, rooted at its smallest name; of several parents the smallest name counts. A round a level, until no vertex is reached; levels are folded into one table every FOLD rounds."""
    pairs = cut(both(edges))
    labels = labels if labels is not None else components(vertices, edges)
    tree = cut(labels.filter("name = component").select("name", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level")))
    frontier = tree
    for level in itertools.count(1):
        step = frontier.select(F.col("name").alias("src")).join(pairs, "src").groupBy(F.col("dst").alias("name")).agg(F.min("src").alias("parent"))
        frontier = cut(step.join(tree.select("name"), "name", "left_anti").select("name", "parent", F.lit(level).alias("level")))
        if frontier.isEmpty():
            return tree
        tree = tree.unionByName(frontier)
        if level % FOLD == 0:
            tree = cut(tree)


def bridges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst): edges in no cycle. Each edge beside the tree draws a 64-bit label; a tree edge is covered if the labels at the ends below it do not cancel out. Rounds grow with the logarithm of the depth."""
    tree = cut(forest(vertices, edges))
    used = tree.filter("parent is not null").select(F.least("name", "parent").alias("src"), F.greatest("name", "parent").alias("dst"))
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    rest = e.join(used, ["src", "dst"], "left_anti").withColumn("label", F.xxhash64("src", "dst"))
    at = rest.select(F.col("src").alias("name"), "label").unionByName(rest.select(F.col("dst").alias("name"), "label")).groupBy("name").agg(F.bit_xor("label").alias("own"))
    # Sums over all below a vertex by doubling: sum holds those at less than a power of two below it, up is the vertex that power above it.
    state = before = cut(tree.join(at, "name", "left").select("name", F.col("parent").alias("up"), F.coalesce("own", F.lit(0).cast("long")).alias("sum")))
    while not state.filter("up is not null").isEmpty():
        below = state.filter("up is not null").groupBy(F.col("up").alias("name")).agg(F.bit_xor("sum").alias("more"))
        higher = state.select(F.col("name").alias("up"), F.col("up").alias("next"))
        new = cut(state.join(higher, "up", "left").join(below, "name", "left").select("name", F.col("next").alias("up"), F.col("sum").bitwiseXOR(F.coalesce("more", F.lit(0).cast("long"))).alias("sum")))
        release(before)
        state = before = new
    return tree.filter("parent is not null").join(state.filter("sum = 0").select("name"), "name").select(F.least("name", "parent").alias("src"), F.greatest("name", "parent").alias("dst"))


def per_component(vertices: DataFrame, edges: DataFrame, solve: Callable[[list[str], list[tuple[str, str]]], list[tuple]], schema: str, labels: DataFrame | None = None) -> DataFrame:
    """solve(names, edges) of each component, one task a component; components above MAX_COMPONENT edges are refused. schema: columns after component."""
    labels = labels if labels is not None else components(vertices, edges)
    e = both(edges).filter("src < dst").join(labels.select(F.col("name").alias("src"), "component"), "src")
    top = e.groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if top and top > MAX_COMPONENT:
        raise ValueError(f"a component of {top} edges is above {MAX_COMPONENT}")
    rows = labels.select("component", F.col("name").alias("src"), F.lit(None).cast("string").alias("dst")).unionByName(e.select("component", "src", "dst"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf.src[pdf.dst.isna()])
        pairs = sorted(zip(pdf.src[pdf.dst.notna()], pdf.dst[pdf.dst.notna()]))
        return pd.DataFrame([(pdf.component.iloc[0], *r) for r in solve(names, pairs)], columns=["component", *[c.split()[0] for c in schema.split(", ")]])

    return rows.groupBy("component").applyInPandas(run, "component string, " + schema)


def _near(pairs: list[tuple[str, str]]) -> dict[str, list[str]]:
    near: dict[str, list[str]] = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    return {k: sorted(v) for k, v in near.items()}


def _low(names: list[str], pairs: list[tuple[str, str]]) -> list[tuple]:
    """Articulation points by low numbers of a depth-first walk with its own stack."""
    near, order, low, parent, out = _near(pairs), {}, {}, {}, set()
    for root in names:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack, kids = [(root, iter(near.get(root, ())))], 0
        while stack:
            v, it = stack[-1]
            w = next(it, None)
            if w is None:
                stack.pop()
                if stack:
                    u = stack[-1][0]
                    low[u] = min(low[u], low[v])
                    if u != root and low[v] >= order[u]:
                        out.add(u)
            elif w not in order:
                parent[w], order[w] = v, len(order)
                low[w] = order[w]
                kids += v == root
                stack.append((w, iter(near[w])))
            elif w != parent.get(v):
                low[v] = min(low[v], order[w])
        if kids > 1:
            out.add(root)
    return [(n,) for n in sorted(out)]


def articulation(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, name): vertices whose loss parts their component."""
    return per_component(vertices, edges, _low, "name string")


def _depths(names: list[str], pairs: list[tuple[str, str]]) -> list[tuple]:
    near, root = _near(pairs), names[0]
    seen, deepest, stack = {root}, 0, [(iter(near.get(root, ())), 0)]
    while stack:
        it, d = stack[-1]
        w = next(it, None)
        if w is None:
            stack.pop()
        elif w not in seen:
            seen.add(w)
            deepest = max(deepest, d + 1)
            stack.append((iter(near[w]), d + 1))
    return [(len(seen), deepest)]


def depth_first(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, size, depth) of the depth-first tree from the smallest name, neighbours by name."""
    return per_component(vertices, edges, _depths, "size int, depth int")


class _Rows:
    """Arrows of an undirected graph of n vertices in rows by their start, sorted within a row. pairs: ends of the edges, by number."""

    def __init__(self, n: int, pairs: np.ndarray):
        src, dst = np.concatenate((pairs[:, 0], pairs[:, 1])), np.concatenate((pairs[:, 1], pairs[:, 0]))
        order = np.lexsort((dst, src))
        self.dst, self.edge = dst[order], np.concatenate((np.arange(len(pairs)),) * 2)[order]
        self.first = np.searchsorted(src[order], np.arange(n + 1))

    def arrows(self, front: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, edge) of the arrows from front, in its order."""
        n = self.first[front + 1] - self.first[front]
        at = np.arange(n.sum()) + np.repeat(self.first[front] - np.cumsum(n) + n, n)
        return np.repeat(front, n), self.dst[at], self.edge[at]


def _core(near: dict[int, set[int]]) -> list[int]:
    """Vertices that are left once those with a single neighbour are taken off again and again; no other lies on a cycle."""
    left = {v: len(w) for v, w in near.items()}
    ends = [v for v, n in left.items() if n == 1]
    for v in ends:
        left[v] = 0
        for w in near[v]:
            if left[w]:
                left[w] -= 1
                if left[w] == 1:
                    ends.append(w)
    return sorted(v for v, n in left.items() if n)


def _open_cycles(rows: _Rows, roots: list[int], least: int, most: int, label: np.ndarray) -> set[tuple[int, ...]]:
    """Edges, the last first, of the cycles of least to most edges that are two shortest paths from one root and an edge, where the labels of the edges do not cancel out."""
    n, found = len(rows.first) - 1, set()
    level, up, parent, by = np.full(n, -1), np.zeros(n, np.uint64), np.zeros(n, int), np.zeros(n, int)
    for root in roots:
        front, touched = np.array([root]), [np.array([root])]
        level[root], up[root], by[root] = 0, 0, -1
        for d in range((most + 1) // 2):
            a, b, e = rows.arrows(front)
            new = level[b] < 0
            # The order of a queue: of several parents the first counts.
            first = np.flatnonzero(new)[np.sort(np.unique(b[new], return_index=True)[1])]
            front = b[first]
            level[front], parent[front], by[front], up[front] = d + 1, a[first], e[first], up[a[first]] ^ label[e[first]]
            touched.append(front)
            odd, even = (level[b] == d) & (a < b) & (by[b] != e) & (by[a] != e), (level[b] == d + 1) & (by[b] != e)
            closing = odd & (least <= 2 * d + 1 <= most) | even & (least <= 2 * d + 2 <= most)
            closing[closing] = (up[a[closing]] ^ up[b[closing]] ^ label[e[closing]]) != 0
            for k in np.flatnonzero(closing).tolist():
                cycle = [int(e[k])]
                for v in (a[k], b[k]):
                    while v != root:
                        cycle.append(int(by[v]))
                        v = parent[v]
                if len(set(cycle)) == len(cycle):
                    found.add(tuple(sorted(cycle, reverse=True)))
            if not len(front):
                break
        level[np.concatenate(touched)] = -1
    return found


def _labels(basis: dict[int, int], n: int) -> np.ndarray:
    """64 bits an edge that cancel out over each cycle of the basis, and over no other cycle but those it spans: chance has it otherwise once in 2^64."""
    label = np.random.default_rng(7).integers(0, 1 << 64, n, dtype=np.uint64).tolist()
    for h in sorted(basis):
        rest, x = 0, basis[h] ^ 1 << h - 1
        while x:
            g = x.bit_length() - 1
            rest ^= label[g]
            x ^= 1 << g
        label[h - 1] = rest
    return np.array(label, np.uint64)


def _cycles(names: list[str], pairs: list[tuple[str, str]]) -> list[tuple]:
    """A minimum cycle basis: shortest cycles through each vertex and edge, taken by length while independent over GF(2). Triangles, which are most of it in a dense graph, are listed; of longer cycles only those meet the basis that it does not span by their labels."""
    need = len(pairs) - len(names) + 1
    if need <= 0:
        return []
    number = {v: i for i, v in enumerate(names)}
    ends = [(number[a], number[b]) for a, b in pairs]
    at = {p: i for i, p in enumerate(ends)}
    near: dict[int, set[int]] = {}
    for a, b in ends:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    before = {v: {w for w in ws if w < v} for v, ws in near.items()}
    basis: dict[int, int] = {}
    out: list[tuple] = []

    def take(cycles: Iterable[tuple[int, ...]]) -> None:
        """The independent ones of cycles, in their order."""
        for cycle in cycles:
            x = 0
            for i in cycle:
                x |= 1 << i
            while x and (h := x.bit_length()) in basis:
                x ^= basis[h]
            if x:
                basis[x.bit_length()] = x
                out.append((len(cycle), [names[v] for v in sorted({v for i in cycle for v in ends[i]})]))
                if len(out) == need:
                    return

    take((i, at[a, c], at[a, b]) for i, (b, c) in enumerate(ends) for a in sorted(before[b] & before[c]))
    core = _core(near)
    rows = _Rows(len(names), np.array(ends)) if len(out) < need else None
    least, most = 4, 4
    while len(out) < need:
        take(sorted(_open_cycles(rows, core, least, most, _labels(basis, len(pairs))), key=lambda c: (len(c), c)))
        # Few cycles are left by then; a search for twice the lengths keeps the number of searches low.
        least, most = most + 1, 5 if most == 4 else 2 * most - 3 if most == 5 else 2 * most + 1
    return out


def cycle_basis(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, length, members): a minimum cycle basis."""
    return per_component(vertices, edges, _cycles, "length int, members array<string>")


def _sums(component: np.ndarray, d: int, ids: np.ndarray, roots: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(component, distance, n): pairs of a block that are that far from each other, by the number of their component."""
    n = np.bincount(component, weights=np.bitwise_count(bits).sum(axis=1, dtype=np.int64)).astype(np.int64)
    there = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(np.full(len(there), d, np.int32)), pa.array(n[there])], ["component_id", "distance", "n"])


def path_lengths(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, size, diameter, mean_path) from searches from all vertices: a bit a vertex in tasks that hold the whole graph; over joins, which give the same, where it is above NUMBERED edges."""
    labels = cut(components(vertices, edges))
    ends = cut(edges.filter("src <> dst").select("src", "dst"))
    if ends.count() > NUMBERED:
        d = bfs(ends, labels.select(F.col("name").alias("seed"))).filter("distance > 0").join(labels.withColumnRenamed("name", "seed"), "seed")
        far = d.groupBy("component", "distance").agg(F.count("*").alias("n"))
    else:
        g = _Numbered(labels, ends)
        of = labels.join(g.names, "name").join(g.names.select(F.col("name").alias("component"), F.col("id").alias("component_id")), "component").select("id", "component_id").toArrow()
        number = np.zeros(of.num_rows, np.int64)
        number[of["id"].to_numpy()] = of["component_id"].to_numpy()
        component = labels.sparkSession.sparkContext.broadcast(number[g.ids])
        d = g.search(g.ids, lambda *x: _sums(component.value, *x), "component_id long, distance int, n long")
        far = d.join(g.names.select(F.col("id").alias("component_id"), F.col("name").alias("component")), "component_id")
    far = far.groupBy("component").agg(F.max("distance").alias("diameter"), F.sum(F.col("distance") * F.col("n")).alias("total"), F.sum("n").alias("n"))
    size = labels.groupBy("component").agg(F.count("*").cast("int").alias("size"))
    return size.join(far, "component", "left").select("component", "size", F.coalesce(F.col("diameter").cast("int"), F.lit(0)).alias("diameter"), F.coalesce(F.col("total") / F.col("n"), F.lit(0.0)).alias("mean_path"))


def shortest(edges: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """(a, b, distance): distance of each pair (a, b) up to depth; null beyond."""
    seeds = pairs.select(F.col("a").alias("seed")).distinct()
    d = bfs(edges, seeds, depth).select(F.col("seed").alias("a"), F.col("name").alias("b"), "distance")
    return pairs.select("a", "b").distinct().join(d, ["a", "b"], "left")


def best_window(edges: DataFrame, seeds: DataFrame, depth: int = 2, breadth: int = 3) -> DataFrame:
    """(seed, name, distance): from each seed the breadth heaviest edges of each vertex reached, depth times; what a seed has reached is not taken again."""
    w = cut(edges.filter("src <> dst").select("src", "dst", "weight").unionByName(edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
    reached = cut(seeds.select("seed").distinct().select("seed", F.col("seed").alias("name"), F.lit(0).alias("distance")))
    frontier = reached
    for d in range(1, depth + 1):
        step = frontier.select("seed", F.col("name").alias("src")).join(w, "src").join(reached.select("seed", F.col("name").alias("dst")), ["seed", "dst"], "left_anti")
        picked = step.withColumn("k", F.row_number().over(Window.partitionBy("seed", "src").orderBy(F.desc("weight"), "dst"))).filter(F.col("k") <= breadth)
        frontier = cut(picked.select("seed", F.col("dst").alias("name")).distinct().withColumn("distance", F.lit(d)))
        reached = reached.unionByName(frontier)
    return reached


def lift(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges after the vertices in names (column name) are taken out: the other neighbours of each are tied to its neighbour of the highest degree. Neighbours that are taken out themselves are left aside."""
    pairs = both(edges)
    d = pairs.groupBy("src").agg(F.count("*").alias("n"))
    out = names.select(F.col("name").alias("src")).distinct()
    around = pairs.join(out, "src").join(out.select(F.col("src").alias("dst")), "dst", "left_anti").join(d.select(F.col("src").alias("dst"), "n"), "dst")
    hub = around.groupBy("src").agg(F.min_by("dst", F.struct((-F.col("n")).alias("m"), "dst")).alias("hub"))
    tied = around.join(hub, "src").filter("dst <> hub").select(F.least("dst", "hub").alias("src"), F.greatest("dst", "hub").alias("dst"))
    kept = edges.select("src", "dst").join(out, "src", "left_anti").join(out.select(F.col("src").alias("dst")), "dst", "left_anti").select("src", "dst")
    return kept.unionByName(tied).distinct()


def communities(vertices: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(name, community) by label propagation: each round a vertex takes the label that weighs most about it, its own counting as half an edge; ties go to the smaller label. A fixed number of rounds."""
    w = cut(edges.filter("src <> dst").select("src", "dst", "weight").unionByName(edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
    labels = cut(vertices.select("name").distinct().withColumn("community", F.col("name")))
    for _ in range(rounds):
        votes = w.join(labels.select(F.col("name").alias("dst"), "community"), "dst").select(F.col("src").alias("name"), "community", "weight").unionByName(labels.withColumn("weight", F.lit(0.5)))
        sums = votes.groupBy("name", "community").agg(F.sum("weight").alias("s"))
        labels = cut(sums.groupBy("name").agg(F.min_by("community", F.struct((-F.col("s")).alias("m"), "community")).alias("community")))
    return labels
