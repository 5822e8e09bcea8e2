"""Approximate nearest neighbours by a forest of random-projection trees.

A node splits its points at the median of their projections on the difference of two of them, after a few rounds that move
the two to the middle of their sides. The upper levels of each tree are fitted on a bounded sample of the vectors; where
the table needs more leaves than one fit gives, each leaf's own rows (a bounded sample of them again) are fitted further, as
often as it takes, so leaves stay small at any size of the table. Every row is then indexed, by the leaf it reaches in each
tree. A query walks all trees through one priority queue, ordered by the largest margin that it is on the wrong side of,
until it has opened enough leaves; below the upper levels the order goes on by the same margins. The candidates in the
opened leaves are ranked by their exact cosine in double precision.

How many leaves are enough is measured, not fixed: some of the queries are compared with all rows first, and the least number
of leaves that holds the wanted share of their true neighbours is opened for all.

Equal vectors are one class that carries its smallest ids, so a vector that fills a third of the table is one candidate;
leaves with many rows are cut into blocks, and so are the queries that open one leaf, so no task holds a whole leaf that has
outgrown memory.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part, neither do rows with a null id; rows that repeat an id with another vector are candidates each; fewer than k
candidates give fewer rows; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import draw, ship, table, written

#: Trees, rows in a leaf, leaves that one fit gives at most, sampled rows for each of them, and rows or queries in a block.
TREES, LEAF, SPLIT, PER_LEAF, BLOCK = 16, 64, 1_024, 20, 2_048
#: Queries that are compared with all rows, and the share of their true neighbours that the opened leaves must hold.
PILOTS, RECALL = 100, 0.96


@dataclass
class Tree:
    """normals and cuts of the inner nodes; children are node numbers, or ``~leaf``."""

    normals: np.ndarray
    cuts: np.ndarray
    children: np.ndarray


def fit_tree(points: np.ndarray, leaves: int, rng: np.random.Generator) -> Tree:
    normals, cuts, children, leaf = [], [], [], 0

    def split(at: np.ndarray, want: int) -> int:
        nonlocal leaf
        if want < 2 or len(at) < 4:
            leaf += 1
            return ~(leaf - 1)
        some = points[rng.choice(at, min(len(at), 256), replace=False)]
        a, b = some[0], some[1]
        for _ in range(4):
            near = some @ (a - b) > 0
            if near.all() or not near.any():
                break
            a, b = some[near].mean(0), some[~near].mean(0)
            a, b = a / max(np.linalg.norm(a), 1e-9), b / max(np.linalg.norm(b), 1e-9)
        normal = a - b
        size = np.linalg.norm(normal)
        normal = normal / size if size > 1e-9 else rng.standard_normal(points.shape[1])
        side = points[at] @ normal
        cut = float(np.median(side))
        low, high = at[side < cut], at[side >= cut]
        if not len(low) or not len(high):
            leaf += 1
            return ~(leaf - 1)
        node = len(cuts)
        normals.append(normal)
        cuts.append(cut)
        children.append([0, 0])
        children[node][0] = split(low, want // 2)
        children[node][1] = split(high, want - want // 2)
        return node

    split(np.arange(len(points)), leaves)
    return Tree(np.array(normals, np.float64).reshape(-1, points.shape[1]), np.array(cuts), np.array(children, int).reshape(-1, 2))


def one_leaf(length: int) -> Tree:
    return Tree(np.zeros((0, length)), np.zeros(0), np.zeros((0, 2), int))


def leaf_of(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf of each point: level by level, all points at once."""
    at = np.full(len(points), 0 if len(tree.cuts) else ~0)
    inner = at >= 0
    while inner.any():
        node = at[inner]
        side = (points[inner] * tree.normals[node]).sum(1) >= tree.cuts[node]
        at[inner] = tree.children[node, side.astype(int)]
        inner = at >= 0
    return ~at


def open_leaves(forest: list[Tree], point: np.ndarray, most: int, loss: float = 0.0, until: float = np.inf) -> list[tuple[int, int, float]]:
    """(tree, leaf, loss) of the ``most`` leaves that the shared queue gives first, as far as their loss is not over ``until``."""
    queue = [(loss, t, 0 if len(tree.cuts) else ~0) for t, tree in enumerate(forest)]
    sides = [tree.normals @ point - tree.cuts for tree in forest]
    heapq.heapify(queue)
    out: list[tuple[int, int, float]] = []
    while queue and len(out) < most:
        loss, t, node = heapq.heappop(queue)
        if loss > until:
            break
        if node < 0:
            out.append((t, ~node, loss))
            continue
        margin = sides[t][node]
        near, far = (1, 0) if margin >= 0 else (0, 1)
        heapq.heappush(queue, (loss, t, forest[t].children[node, near]))
        heapq.heappush(queue, (max(loss, abs(margin)), t, forest[t].children[node, far]))
    return out


def scaled(v: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component to 1/2 or more and below 1: squares neither overflow nor
    vanish then, and as such products are exact a cosine stays what it was."""
    if not v.size:
        return v
    return np.ldexp(v, -np.frexp(np.abs(v).max(-1, keepdims=True))[1])


def unit(vectors) -> np.ndarray:
    v = scaled(np.array(list(vectors), dtype=np.float64))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cosines(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Row by row (``queries`` one for each row, or one for all), so a pair's value doesn't depend on its block."""
    rows, queries = scaled(rows), scaled(queries)
    return (rows * queries).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((queries * queries).sum(-1)))


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part; floats stay floats, as they are half as wide, all else becomes doubles."""
    kind = vectors.schema[vec_col].dataType
    v = F.col(vec_col) if kind.elementType == T.FloatType() else F.col(vec_col).cast("array<double>")
    df = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = df.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    length = df.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").head()
    return df.where(F.size("v") == (length["d"] if length else 0))


class Forest:
    """The trees, level by level, and the leaf that each row reaches in each of them.

    ``upper`` is the first level (a list of trees); ``lower`` holds a table (tree, leaf, grown) for each further level, with
    the tree that goes on from each leaf. ``index`` has a row for each tree and row of the table: (v, ids, tree, leaf).
    """

    def __init__(self, classes: DataFrame, trees: int, leaf: int, split: int, block: int, seed: int = 5):
        self.spark, self.block = classes.sparkSession, block
        self.kind = classes.schema["v"].dataType.simpleString()
        n = classes.count()
        levels = max(1, math.ceil(math.log(max(n / leaf, 1), split) - 1e-9))
        share, want = PER_LEAF * split / max(n, 1), max(1, min(split, n // leaf))
        rows = classes.where(draw("ids", seed=seed) <= share).select("ids", "v").collect()
        points = unit([r[1] for r in sorted(rows)]) if rows else np.zeros((0, 1))
        self.upper = self.spark.sparkContext.broadcast([fit_tree(points, want, np.random.default_rng(seed + t)) for t in range(trees)])
        self.lower: list[DataFrame] = []
        upper = self.upper

        def place(parts):
            for p in parts:
                if len(p):
                    points = unit(p["v"])
                    for t, tree in enumerate(upper.value):
                        yield p.assign(tree=np.int32(t), leaf=leaf_of(tree, points))

        self.index = written(classes.select("v", "ids").mapInPandas(place, f"v {self.kind}, ids array<long>, tree int, leaf long"))
        for level in range(1, levels):
            self._grow(leaf, split, seed + 1000 * level)

    def _grow(self, leaf: int, split: int, seed: int) -> None:
        """One more level: a tree for each leaf, from its own rows."""
        kind = self.kind
        sizes = self.index.groupBy("tree", "leaf").agg(F.count("*").alias("n"))
        sized = self.index.join(sizes, ["tree", "leaf"])
        want = F.least(F.lit(split), F.greatest(F.lit(1), F.floor(F.col("n") / leaf)))
        some = sized.withColumn("want", want.cast("int")).where(draw("ids", "tree", seed=seed) * F.col("n") <= F.col("want") * PER_LEAF)

        def fit(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
            points = unit(x for _, x in sorted(zip(map(list, p["ids"]), map(list, p["v"]))))
            tree = fit_tree(points, int(p["want"].iloc[0]), np.random.default_rng([seed, *key]))
            return pd.DataFrame({"tree": [key[0]], "leaf": [key[1]], "grown": [pickle.dumps(tree)]})

        grown = written(some.groupBy("tree", "leaf").applyInPandas(fit, "tree int, leaf long, grown binary"))

        def place(c: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
            # a leaf whose rows weren't drawn stays one leaf
            sub = leaf_of(pickle.loads(g["grown"].iloc[0]), unit(c["v"])) if len(g) and len(c) else 0
            return c[["v", "ids", "tree"]].assign(leaf=c["leaf"] * split + sub)

        blocks = sizes.select("tree", "leaf", F.ceil(F.col("n") / self.block).cast("int").alias("blocks"))
        cut = self.index.join(blocks, ["tree", "leaf"]).withColumn("b", F.pmod(F.xxhash64("ids"), F.col("blocks")).cast("int")).drop("blocks")
        each = grown.join(blocks, ["tree", "leaf"]).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        key = ["tree", "leaf", "b"]
        placed = cut.groupBy(*key).cogroup(each.groupBy(*key)).applyInPandas(place, f"v {kind}, ids array<long>, tree int, leaf long")
        self.index, self.split = written(placed), split
        self.lower.append(grown)

    def search(self, asked: DataFrame, most: int) -> DataFrame:
        """The ``most`` leaves that the queue gives each query (qid, v) first: (qid, tree, leaf, place), place from 1."""
        upper, kind = self.upper, self.kind
        shape = f"qid long, v {kind}, tree int, leaf long, loss double"

        def first(parts):
            for p in parts:
                if len(p):
                    found = [open_leaves(upper.value, x, most) for x in unit(p["v"])]
                    t, leaf, loss = zip(*[x for f in found for x in f])
                    at = np.repeat(np.arange(len(p)), [len(f) for f in found])
                    yield p.iloc[at].assign(tree=np.array(t, np.int32), leaf=np.array(leaf, np.int64), loss=np.array(loss, float))

        # more tasks than one file of few queries would give: a query costs thousands of steps in the queue
        spread = asked.select("qid", "v").repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        hunts = spread.mapInPandas(first, shape)
        order = Window.partitionBy("qid").orderBy("loss", "tree", "leaf")
        for grown in self.lower:
            # leaves below have no smaller loss, so what the queue gives next lies below those that it gave up to now
            hunts = written(hunts.withColumn("until", F.max("loss").over(Window.partitionBy("qid"))))
            split = self.split

            def go_on(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
                if not len(q):
                    return pd.DataFrame({c: [] for c in ("qid", "v", "tree", "leaf", "loss")})
                points = unit(q["v"])
                tree = pickle.loads(g["grown"].iloc[0]) if len(g) else one_leaf(points.shape[1])
                found = [open_leaves([tree], *x) for x in zip(points, [most] * len(q), q["loss"], q["until"])]
                at = np.repeat(np.arange(len(q)), [len(f) for f in found])
                _, leaf, loss = zip(*[x for f in found for x in f])
                return q.iloc[at][["qid", "v", "tree"]].assign(leaf=q["leaf"].to_numpy()[at] * split + np.array(leaf, np.int64), loss=loss)

            asks = hunts.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / self.block).cast("int").alias("asks"))
            cut = hunts.join(asks, ["tree", "leaf"]).withColumn("b", F.pmod(F.xxhash64("qid"), F.col("asks")).cast("int")).drop("asks")
            each = grown.join(asks, ["tree", "leaf"]).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))).drop("asks")
            key = ["tree", "leaf", "b"]
            further = cut.groupBy(*key).cogroup(each.groupBy(*key)).applyInPandas(go_on, shape)
            hunts = further.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")
        return hunts.withColumn("place", F.row_number().over(order)).select("qid", "tree", "leaf", "place")

    def enough(self, classes: DataFrame, asked: DataFrame, k: int, pilots: int, recall: float) -> int:
        """The least number of leaves that holds ``recall`` of the k true neighbours of some queries, found by comparing these with
        all rows. Only they (``pilots``) and their neighbours reach the driver."""
        some = asked.orderBy(draw("qid", seed=13), "qid").limit(pilots)
        rows = some.collect()
        if not rows:
            return 1
        x, qids = unit([r["v"] for r in rows]), np.array([r["qid"] for r in rows])
        kind = self.kind

        def best(parts):
            for p in parts:
                if len(p):
                    s = unit(p["v"]) @ x.T
                    at = np.argsort(-s, axis=0)[: k + 1].T
                    q = np.repeat(np.arange(len(qids)), at.shape[1])
                    yield pd.DataFrame({"qid": qids[q], "ids": p["ids"].to_numpy()[at.ravel()], "score": s[at.ravel(), q]})

        found = classes.select("v", "ids").mapInPandas(best, "qid long, ids array<long>, score double")
        # a query's own class is where it is itself: its leaf is the first that is opened
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "ids")
        near = found.where(~F.array_contains("ids", F.col("qid"))).withColumn("i", F.row_number().over(order)).where(F.col("i") <= k)
        near = written(near.select("qid", "ids"))
        pairs = near.count()
        at = written(self.index.join(F.broadcast(near), "ids").select("qid", "ids", "tree", "leaf"))
        most = 256
        while True:
            hunts = self.search(some, most)
            places = at.join(hunts, ["qid", "tree", "leaf"]).groupBy("qid", "ids").agg(F.min("place").alias("place"))
            got = sorted(r[0] for r in places.select("place").collect())
            need = math.ceil(recall * pairs)
            if len(got) >= need:
                return max([1, *got[need - 1 : need]])
            most *= 2


def rerank(index: DataFrame, hunts: DataFrame, asked: DataFrame, k: int, block: int, leaf: int) -> DataFrame:
    """The exact cosine (qid, vec_id, score) of the rows in the leaves that each query opened: of each group of leaves that lie
    side by side, the k + 1 best rows (and what ties with them) as far as they reach the query's ``floor``.

    A group of leaves with more than ``block`` rows is cut, and so are the queries that meet in one.
    """
    index = index.withColumn("g", F.floor(F.col("leaf") / max(1, block // leaf)))
    hunts = hunts.groupBy("qid", "tree", "g").agg(F.collect_set("leaf").alias("leaves"))

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("tree", "g").agg(F.ceil(F.count("*") / block).cast("int").alias(name))

    def every(name: str):
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    meet = written(count(index, "blocks").join(count(hunts, "asks"), ["tree", "g"]))
    rows = index.join(meet, ["tree", "g"]).withColumn("b", F.pmod(F.xxhash64("ids"), F.col("blocks")).cast("int")).withColumn("c", every("asks"))
    searches = hunts.join(meet, ["tree", "g"]).withColumn("c", F.pmod(F.xxhash64("qid"), F.col("asks")).cast("int")).withColumn("b", every("blocks"))
    searches = searches.drop("blocks", "asks").join(asked.select("qid", "v", "floor"), "qid")

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"qid": [], "vec_id": [], "score": []})
        if not len(q) or not len(c):
            return nothing
        v, x = (np.array(list(f["v"]), dtype=np.float64) for f in (c, q))
        uv, ux, floor = unit(v), unit(x), q["floor"].to_numpy()
        asks, opened = np.repeat(np.arange(len(q)), q["leaves"].map(len)), np.concatenate(list(q["leaves"]))
        leaves, found = c["leaf"].to_numpy(), []
        # all pairs of a leaf roughly, then those that can be among the k + 1 first exactly
        for at_leaf in np.unique(opened):
            rows, who = np.flatnonzero(leaves == at_leaf), asks[opened == at_leaf]
            if len(rows):
                rough = ux[who] @ uv[rows].T
                least = np.partition(rough, max(len(rows) - k - 1, 0), axis=1)[:, max(len(rows) - k - 1, 0)]
                at, row = np.nonzero(rough >= np.maximum(least, floor[who])[:, None] - 1e-9)
                found.append((who[at], rows[row], rough[at, row]))
        if not sum(len(f[0]) for f in found):
            return nothing
        at, row, near = (np.concatenate(f) for f in zip(*found))
        order = np.lexsort((-near, at))
        at, row, near = at[order], row[order], near[order]
        first, end = np.searchsorted(at, at), np.searchsorted(at, at, side="right")
        keep = near >= near[np.minimum(first + k, end - 1)] - 1e-9
        at, row = at[keep], row[keep]
        exact, times = cosines(v[row], x[at]), c["ids"].map(len).to_numpy()[row]
        ids = np.concatenate([np.asarray(i) for i in c["ids"].to_numpy()[row]])
        return pd.DataFrame({"qid": np.repeat(q["qid"].to_numpy()[at], times), "vec_id": ids, "score": np.repeat(exact, times)})

    key = ["tree", "g", "b", "c"]
    return searches.groupBy(*key).cogroup(rows.drop("blocks", "asks").groupBy(*key)).applyInPandas(score, "qid long, vec_id long, score double")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES,
    leaf: int = LEAF, split: int = SPLIT, block: int = BLOCK, pilots: int = PILOTS, recall: float = RECALL, opened: int | None = None,
) -> DataFrame:
    """For each row of ``queries`` (same columns) the k nearest of ``vectors`` but its own id: query_id, rank, vec_id, score.

    ``opened`` leaves are searched for each query; where it isn't given, as many as ``recall`` needs.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = valid(vectors, id_col, vec_col).distinct()
    # the k + 1 smallest ids of equal vectors are all that can come into a result; the limit applies before the shuffle
    first = rows.withColumn("i", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("i") <= k + 1)
    classes = written(first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    # equal query vectors are searched once, under their smallest id
    askers = written(valid(queries, id_col, vec_col).withColumn("v", F.col("v").cast(classes.schema["v"].dataType)).distinct())
    asked = written(askers.groupBy("v").agg(F.min("vec_id").alias("qid")))
    forest = Forest(classes, trees, leaf, split, block)
    most = opened or forest.enough(classes, asked, k, pilots, recall)
    hunts = written(forest.search(asked, most).withColumn("g", F.floor(F.col("leaf") / max(1, block // leaf))))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")

    def top(found: DataFrame) -> DataFrame:
        return written(found.distinct().withColumn("i", F.row_number().over(order)).where(F.col("i") <= k + 1).drop("i"))

    # the nearest leaf or two of each tree first: what is further than the k + 1 best of these need not leave its leaf
    asked = asked.withColumn("floor", F.lit(-2.0))
    head = top(rerank(forest.index, hunts.where(F.col("place") <= trees), asked, k, block, leaf))
    least = head.groupBy("qid").agg(F.when(F.count("*") > k, F.min("score")).otherwise(-2.0).alias("floor"))
    floored = asked.drop("floor").join(least, "qid", "left").fillna(-2.0, ["floor"])
    others = rerank(forest.index, hunts.where(F.col("place") > trees), floored, k, block, leaf)
    best = top(head.unionByName(others))
    own = askers.join(asked, "v").select(F.col("vec_id").alias("query_id"), "qid")
    rest = own.join(best, "qid").where("vec_id <> query_id")
    order = Window.partitionBy("query_id", "qid").orderBy(F.desc("score"), "vec_id")
    return rest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9(spark, sf_dir: str) -> DataFrame:
    """The query: every vec_id divisible by 50 against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0))
