"""Approximate nearest neighbours by a forest of random-projection trees.

Equal vectors are one class, kept with its k + 1 smallest ids: with ties going to smaller
ids, no other member can be among the k nearest of any query. A bounded sample of classes
(``SAMPLE``) gives the trees' splits: the plane between two sample points, down to small
sample leaves. Where more than ``LEAF_ROWS`` classes of the whole table fall into a sample
leaf, it goes on splitting by random planes through its centre, as deep as its count asks
for. The model stays bounded while the number of leaves grows with the table. Every class
is indexed in every tree.

A query walks all trees with one priority queue: the open branch most likely to hold a
near neighbour, of any tree, comes next. How likely follows from the margins: a neighbour's
margin is a share (``slope``) of the query's own plus noise (``spread``). Both are the
query's own, from its nearest sample points, as one table may hold rows with very near
neighbours and rows without any. A tree's leaves share out the whole probability; the walk
ends when, over all trees, the modelled chance that a neighbour lies in none of the leaves
read is below a limit, and at least ``LEAVES`` are read. The limit is measured, not trusted:
one scan of the whole table gives the true neighbours of ``PROBES`` queries, and the limit
is the one at which their walks come to ``FOUND`` of them (where none does, the noise is
doubled, up to where all leaves are read). Queries meet the rows of their leaves in cells
of bounded size (leaf x chunk of rows x chunk of queries), where exact cosines in double
precision rank the candidates and only the best go on, ties by id. Index and probes are
ids; vectors are joined to them once.

Results: one row per query and rank. Rows whose vector is null, zero, holds null or
non-finite components, or is not of the most common dimension take no part, nor do rows
with a null id. A row with the query's id is its own. Repeated rows count once.
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evlens.llm.common import arrow_map, stored

TREES = 16
SAMPLE = 16_384          # classes the trees are fitted on
PROBES = 256             # queries whose true neighbours are looked for in the whole table
SAMPLE_LEAF = 48         # sample points at which a tree stops
LEAF_ROWS = 96           # classes of the whole table in a leaf, about
LEAVES = 64              # leaves one query reads over all trees, at least
MISS = 0.05              # modelled chance of missing a neighbour at which a query stops, where it is not measured
FOUND = 0.97             # share of the probes' true neighbours that the stop is chosen for
LOWEST = 1e-12           # least modelled chance of a miss that a stop may be set to
DEEPER = 30              # most random splits below a sample leaf
CELL = 2048              # rows, and queries, of one comparison cell, about


@dataclass
class Tree:
    normal: np.ndarray       # plane of each inner node
    child: np.ndarray        # two children each; a leaf l is -1 - l
    centre: np.ndarray       # of each sample leaf
    planes: np.ndarray       # random planes for the splits below leaves
    depth: np.ndarray        # how many of them each leaf uses


def grow(points: np.ndarray, seed: int, leaf: int = SAMPLE_LEAF) -> Tree:
    """One tree over unit vectors."""
    rng = np.random.default_rng(seed)
    normal, child, centre = [], [], []

    def leaf_of(rows):
        centre.append(points[rows].mean(axis=0) if len(rows) else np.zeros(points.shape[1]))
        return -len(centre)

    def split(rows):
        if len(rows) <= leaf:
            return leaf_of(rows)
        for _ in range(4):
            a, b = points[rng.choice(rows, 2, replace=False)]
            n = a - b
            side = points[rows] @ n > 0
            if 0.05 < side.mean() < 0.95:
                break
        else:
            n = rng.normal(size=points.shape[1])
            side = points[rows] @ n > np.median(points[rows] @ n)
            if side.all() or not side.any():
                return leaf_of(rows)
            side = points[rows] @ n > 0
            if side.all() or not side.any():
                return leaf_of(rows)
        at = len(normal)
        normal.append(n / max(np.linalg.norm(n), 1e-12))
        child.append([0, 0])
        child[at] = [split(rows[~side]), split(rows[side])]
        return at

    split(np.arange(len(points)))
    d = points.shape[1]
    planes = rng.normal(size=(DEEPER, d))
    planes /= np.linalg.norm(planes, axis=1, keepdims=True)
    return Tree(np.array(normal).reshape(-1, d), np.array(child, np.int64).reshape(-1, 2), np.array(centre), planes,
                np.zeros(len(centre), np.int64))


def sample_leaves(tree: Tree, unit: np.ndarray) -> np.ndarray:
    """The sample leaf of every vector."""
    node = np.zeros(len(unit), np.int64) if len(tree.normal) else np.full(len(unit), -1)
    while True:
        open_ = np.flatnonzero(node >= 0)
        if not len(open_):
            return -1 - node
        n = node[open_]
        side = np.einsum("ij,ij->i", unit[open_], tree.normal[n]) > 0
        node[open_] = tree.child[n, side.astype(np.int64)]


def leaves(tree: Tree, unit: np.ndarray) -> np.ndarray:
    """The leaf of every vector: sample leaf, and a leading one with the sides of the planes below it."""
    leaf = sample_leaves(tree, unit)
    code = np.ones(len(unit), np.int64)
    for k in range(int(tree.depth.max(initial=0))):
        deep = tree.depth[leaf] > k
        side = (unit[deep] - tree.centre[leaf[deep]]) @ tree.planes[k] > 0
        code[deep] = code[deep] << 1 | side
    return leaf << 32 | code


@dataclass
class Margins:
    """How the margin of a near neighbour follows from a query's own: slope * margin + noise of this spread."""
    slope: float
    spread: float

    def below(self, own, offset=0.0):
        """Log-probability that a neighbour lies on the negative side of planes with these own margins."""
        return np.interp((offset - self.slope * own) / self.spread, _GRID, _LOG_NORMAL)

    def above(self, own, offset=0.0):
        return np.interp((self.slope * own - offset) / self.spread, _GRID, _LOG_NORMAL)


_GRID = np.linspace(-8, 8, 8193)
_LOG_NORMAL = np.log([0.5 * math.erfc(-x / math.sqrt(2)) for x in _GRID])


@dataclass
class Nearness:
    """What is expected of a query's neighbours, from its own nearest sample points."""
    points: np.ndarray       # the sample
    inner: np.ndarray        # planes of the trees
    deeper: np.ndarray       # planes below their sample leaves
    k: int
    wide: float = 1.0        # factor of the noise

    def of(self, unit: np.ndarray) -> Iterator[tuple[Margins, Margins]]:
        """Of every query, for the planes of the trees and for those below."""
        for i in range(0, len(unit), 64):
            for q, near in zip(unit[i:i + 64], unit[i:i + 64] @ self.points.T):
                near[near >= 1 - 1e-12] = -2                       # the query itself
                n = min(self.k, int((near > -2).sum()))
                if not n:
                    yield Margins(0.0, 1.0), Margins(0.0, 1.0)
                    continue
                some = np.argpartition(-near, n - 1)[:n]
                slope = max(float(near[some].mean()), 0.0)
                off = [self.points[some] @ planes.T - slope * (planes @ q) for planes in (self.inner, self.deeper)]
                spread = [self.wide * float(np.sqrt(np.mean(x * x))) if x.size else 0.0 for x in off]
                yield tuple(Margins(slope, max(x, 1e-9)) for x in spread)


def nearness(points: np.ndarray, trees: list[Tree], k: int, wide: float = 1.0) -> Nearness:
    return Nearness(points, *(np.concatenate([getattr(t, part) for t in trees]) for part in ("normal", "planes")), k, wide)


def walk(trees: list[Tree], near: tuple[Margins, Margins], unit: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(tree, leaf, modelled chance of a miss after it) of the leaves of all trees, most promising first, by a shared queue."""
    inner, below = near
    sides = [(inner.below(m), inner.above(m)) for m in (t.normal @ unit for t in trees)]
    deeper: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    heap = [(0.0, t, 0 if len(tree.normal) else -1, 1) for t, tree in enumerate(trees)]
    left = [1.0] * len(trees)              # probability of the leaves not read yet, by tree
    while heap:
        cost, t, node, code = heapq.heappop(heap)         # cost: minus the log-probability of the branch
        tree = trees[t]
        if node >= 0:
            for side in (0, 1):
                heapq.heappush(heap, (cost - sides[t][side][node], t, int(tree.child[node, side]), 1))
            continue
        leaf, k = -1 - node, code.bit_length() - 1
        if k >= tree.depth[leaf]:
            left[t] = max(left[t] - math.exp(-cost), 0.0)
            yield t, leaf << 32 | code, math.prod(left)
            continue
        if (t, leaf) not in deeper:
            planes = tree.planes[:tree.depth[leaf]]
            at = planes @ unit, planes @ tree.centre[leaf]
            deeper[t, leaf] = below.below(*at), below.above(*at)
        for side in (0, 1):
            heapq.heappush(heap, (cost - deeper[t, leaf][side][k], t, node, code << 1 | side))


def search(trees: list[Tree], near: Nearness, unit: np.ndarray, miss: float = MISS, least: int = LEAVES) -> list[tuple[int, int]]:
    """(tree, leaf) of the leaves one query reads."""
    found = []
    for t, leaf, left in walk(trees, next(near.of(unit[None])), unit):
        found.append((t, leaf))
        if len(found) >= least and left < miss:
            break
    return found


def needed(trees: list[Tree], near: Nearness, unit: np.ndarray, others: np.ndarray, least: int = LEAVES) -> np.ndarray:
    """For each of a query's true neighbours the chance of a miss at which its walk has come to it (zero: not above ``LOWEST``)."""
    homes: dict[tuple[int, int], list[int]] = {}
    for t, tree in enumerate(trees):
        for i, leaf in enumerate(leaves(tree, others).tolist()):
            homes.setdefault((t, leaf), []).append(i)
    at = np.full(len(others), -1.0)
    for n, (t, leaf, left) in enumerate(walk(trees, next(near.of(unit[None])), unit)):
        for i in homes.get((t, leaf), ()):
            if at[i] < 0:
                at[i] = 1.0 if n < least else left
        if (at >= 0).all() or (n >= least and left < LOWEST):
            break
    return np.maximum(at, 0.0)


def _matrix(column) -> np.ndarray:
    v = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    o = column.offsets.to_numpy()
    return v[o[0]:o[-1]].reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(m: np.ndarray) -> np.ndarray:
    # Components are scaled first, so that very large and very small vectors keep a finite norm.
    m = np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, in double precision."""
    # By powers of two, which changes no digit, so that no square leaves the range of doubles.
    q, c = (np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1]) for m in (q, c))
    dot, qq, cc = (q * c).sum(axis=1), (q * q).sum(axis=1), (c * c).sum(axis=1)
    return dot / (np.sqrt(qq) * np.sqrt(cc))


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, v)`` of the rows that take part."""
    given = table.select(F.col(f"`{vector_col}`").alias("v"))
    kind = "array<float>" if given.schema["v"].dataType.simpleString() == "array<float>" else "array<double>"   # half to shuffle
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                        F.col(f"`{vector_col}`").cast(kind).alias("v")).where("vec_id is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0.0))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("v") == (common["d"] if common else -1))


def _index(classes: DataFrame, trees: list[Tree]) -> DataFrame:
    """(class, tree, leaf) of every class in every tree."""

    def run(batches):
        for b in batches:
            unit = _unit(_matrix(b.column("v")))
            for t, tree in enumerate(trees):
                yield pa.RecordBatch.from_arrays(
                    [b.column("class"), pa.array(np.full(b.num_rows, t, np.int32)), pa.array(leaves(tree, unit))],
                    names=["class", "tree", "leaf"])

    return arrow_map(classes.select("class", "v"), run, "class long, tree int, leaf long")


def _true_neighbours(classes: DataFrame, few: list, k: int) -> dict[int, np.ndarray]:
    """The k nearest other classes of a few classes (rows of class and v), by one scan of the whole table: their unit vectors."""
    of, asked = np.array([r["class"] for r in few]), _unit(np.array([r["v"] for r in few], float))

    def run(batches):
        best = [[] for _ in of]
        for b in batches:
            cls, first = b.column("class").to_numpy(), b.column("first").to_numpy()
            near = asked @ _unit(_matrix(b.column("v"))).T
            near[of[:, None] == cls] = -2
            for i in range(len(of)):
                n = min(k, b.num_rows)
                some = np.flatnonzero(near[i] >= max(np.partition(near[i], -n)[-n], -1.5)) if n else []
                best[i] = sorted(best[i] + list(zip((-near[i, some]).tolist(), first[some].tolist(), cls[some].tolist())))[:k]
        flat = [(int(q), c, -s, f) for q, found in zip(of, best) for s, f, c in found]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*flat)) or [()] * 4, (
            pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["q", "c", "score", "first"])

    each = arrow_map(classes.select("class", F.element_at("ids", 1).alias("first"), "v"), run, "q long, c long, score double, first long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "first")
    best = each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    out: dict[int, list] = {}
    for r in best.join(classes.select(F.col("class").alias("c"), "v"), "c").select("q", "v").collect():    # k rows a probe
        out.setdefault(r["q"], []).append(r["v"])
    return {q: _unit(np.array(v, float)) for q, v in out.items()}


def calibrate(ask: DataFrame, classes: DataFrame, near: Nearness, trees: list[Tree], k: int, least: int) -> tuple[float, Nearness]:
    """The chance of a miss at which a query stops, and ``near`` with noise so wide, that find ``FOUND`` of the true neighbours of ``PROBES`` queries."""
    few = ask.select("class", "v").orderBy(F.xxhash64("class", F.lit(1)), "class").limit(PROBES).collect()
    truth = _true_neighbours(classes, few, k)
    few = [r for r in few if r["class"] in truth]
    if not few:
        return 1.0, near
    spark = classes.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = [(r["class"], [float(x) for x in r["v"]], [v.tolist() for v in truth[r["class"]]]) for r in few]
    table = spark.createDataFrame(rows, "class long, v array<double>, others array<array<double>>").repartition(tasks)
    while True:
        def run(batches, near=near):
            for b in batches:
                at = [needed(trees, near, u, np.array(o), least).tolist()
                      for u, o in zip(_unit(_matrix(b.column("v"))), b.column("others").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.float64()))], names=["at"])

        at = np.sort([x for r in arrow_map(table, run, "at array<double>").collect() for x in r["at"]])
        miss = float(at[int((1 - FOUND) * len(at))])
        if miss > 0 or near.wide > 1e6:     # wider noise goes on to read all leaves alike
            return miss, near
        near = replace(near, wide=2 * near.wide)


def _probes(queries: DataFrame, trees: list[Tree], near: Nearness, miss: float, least: int) -> DataFrame:
    def run(batches):
        for b in batches:
            found = [search(trees, near, u, miss, least) for u in _unit(_matrix(b.column("v")))]
            row = np.repeat(np.arange(b.num_rows), [len(f) for f in found])
            t = [x for f in found for x in f]
            yield pa.RecordBatch.from_arrays(
                [b.column("class").take(pa.array(row)), pa.array([x[0] for x in t], pa.int32()),
                 pa.array([x[1] for x in t], pa.int64())], names=["class", "tree", "leaf"])

    return arrow_map(queries.select("class", "v"), run, "class long, tree int, leaf long")


def _rank_cells(rows: DataFrame, keep: int) -> DataFrame:
    """Per cell and query, the ``keep`` best classes, equal ones by their smallest id; rows: tree, leaf, a, b, side (0 query, 1 row), class, first, v."""
    ordered = rows.repartition("tree", "leaf", "a", "b").sortWithinPartitions("tree", "leaf", "a", "b", "side")

    def best(side, cls, first, m):
        q, c = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(q) or not len(c):
            return None
        near = _unit(m[q]) @ _unit(m[c]).T
        k = min(len(c), keep + 4)           # a few more than asked for: the product only selects
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        i, j = np.repeat(q, k), c[top.ravel()]
        if k > keep:
            # Where the last of them is as near as the last one asked for, others may be too: of these all are looked at.
            have = -np.sort(-np.take_along_axis(near, top, axis=1), axis=1)
            level = have[:, keep - 1] - 1e-12
            tied = np.flatnonzero(have[:, -1] >= level)
            if len(tied):
                rest = ~np.isin(i, q[tied])
                i, j = [i[rest]], [j[rest]]
                for r in tied:
                    some = c[near[r] >= level[r]]
                    s = cosines(np.broadcast_to(m[q[r]], m[some].shape), m[some])
                    j.append(some[np.lexsort((first[some], -s))[:keep]])
                    i.append(np.full(len(j[-1]), q[r]))
                i, j = np.concatenate(i), np.concatenate(j)
        s = cosines(m[i], m[j])
        return pa.RecordBatch.from_arrays([pa.array(cls[i]), pa.array(cls[j]), pa.array(s)], names=["q", "c", "score"])

    def run(batches):
        held = None                         # rows of the last cell, which may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(k).to_numpy(zero_copy_only=False) for k in ("tree", "leaf", "a", "b", "side", "class", "first")]
            now.append(_matrix(b.column("v")))
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            key = np.stack(held[:4], 1)
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1])
            for i, j in zip(cuts[:-1], cuts[1:]):
                out = best(*(x[i:j] for x in held[4:]))
                if out is not None:
                    yield out
            held = [x[cuts[-1]:] for x in held]
        if held is not None:
            out = best(*held[4:])
            if out is not None:
                yield out

    return arrow_map(ordered, run, "q long, c long, score double")


def nearest(table: DataFrame, is_query, k: int = 5, trees: int = TREES, sample: int = SAMPLE, least: int = LEAVES,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of every row for which ``is_query`` (of vec_id) holds."""
    rows = usable(table, id_col, vector_col).distinct()
    member = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(member)).where(F.col("n") <= k + 1)
    # Numbered once, when written: a name for the class, whatever its ids and vector.
    classes = stored(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
                     .withColumn("class", F.monotonically_increasing_id()), "classes")
    asking = stored(rows.where(is_query("vec_id")).join(classes.select("v", "class"), "v").select("vec_id", "class"), "asking")

    points = [r["v"] for r in classes.orderBy(F.xxhash64("v"), "ids").limit(sample).select("v").collect()]
    if not points:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id",
                           F.lit(0.0).alias("score")).where("false")
    unit = _unit(np.array(points))
    forest = [grow(unit, seed) for seed in range(trees)]
    # Rows of each sample leaf: bounded by the sample.
    for r in _index(classes, forest).groupBy("tree", F.shiftright("leaf", 32).alias("leaf")).count().collect():
        if r["count"] > LEAF_ROWS:
            forest[r["tree"]].depth[r["leaf"]] = min(DEEPER, int(np.ceil(np.log2(r["count"] / LEAF_ROWS))))

    index = stored(_index(classes, forest), "index")
    ask = classes.join(asking.select("class").distinct(), "class", "left_semi")
    # A number of partitions is given, as queries are few rows but much work: they are not to be merged into one task.
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    miss, near = calibrate(ask, classes, nearness(unit, forest, k), forest, k, least)
    probes = stored(_probes(ask.repartition(tasks, "class"), forest, near, miss, least), "probes")
    vectors = classes.select("class", F.element_at("ids", 1).alias("first"), "v")

    def parts(df, name):
        return df.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias(name))

    cells = parts(index, "na").join(parts(probes, "nb"), ["tree", "leaf"])
    of = F.xxhash64("class")
    left = (index.join(cells, ["tree", "leaf"]).withColumn("a", F.pmod(of, F.col("na")).cast("int"))
            .withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("side", F.lit(1)))
    right = (probes.join(cells, ["tree", "leaf"]).withColumn("b", F.pmod(of, F.col("nb")).cast("int"))
             .withColumn("a", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("side", F.lit(0)))
    cols = ["tree", "leaf", "a", "b", "side", "class", "first", "v"]
    scored = _rank_cells(left.join(vectors, "class").select(cols).unionByName(right.join(vectors, "class").select(cols)), k + 1)

    pairs = scored.groupBy("q", "c").agg(F.max("score").alias("score"))
    named = pairs.join(classes.select(F.col("class").alias("c"), "ids"), "c")
    first = Window.partitionBy("q").orderBy(F.desc("score"), F.element_at("ids", 1))
    best = (named.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
            .select("q", "score", F.explode("ids").alias("vec_id"))
            .groupBy("q").agg(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("list")))
    mine = asking.join(best, asking["class"] == best["q"]).select(
        F.col("vec_id").alias("query_id"), F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("vec_id")), 1, k).alias("list"))
    return (mine.select("query_id", F.posexplode("list").alias("p", "x"))
            .select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score")))
