"""Exact top-k by inner product with M-trees.

Vectors are integers. With one more coordinate that brings all of them to the same length, the largest inner products with
a query are the smallest distances to it, so a metric tree finds them. The root page is a bounded number of pivots with
the radius that covers each cell; below it, every cell is cut into trees of bounded size. Inner nodes of a tree hold
pivots, covering radii and distances to the parent's pivot; leaves hold vectors and their distances to the parent's
pivot. A search takes the nodes in the order of their best possible score and leaves out, by the triangle inequality on
stored distances, nodes and vectors whose distance to the query need not be computed at all. Queries are searched in
blocks: a page is read once for all queries that it may still hold a hit for, as one matrix product.

Scores are exact: in floating point where no sum can pass 2**53, else in 64-bit integers, which hold every score that the
result's type can hold.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinfold.llm.common import pick, stored

SCALE = 1024
MOST_PIVOTS = 256
ROWS_PER_PIVOT = 2000
ROWS_PER_TREE = 20_000
TREE_BYTES = 64 << 20
QUERIES_PER_TASK = 4096
QUERIES_PER_BLOCK = 512
PAGE = 256
FANOUT = 12
SLACK = 1e-6
HIT_SCHEMA = "qkey string, score bigint, vec_id bigint"


def scaled(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: components as floor(1024 x). Null ids, null vectors and vectors that hold a null or a number that is
    not finite are left out."""
    rows = pick(df, vec_id=id_col, x=vector_col).withColumn("x", F.col("x").cast("array<double>"))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    whole = rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~bad)
    return whole.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("x", lambda e: F.floor(e * SCALE)).alias("v"))


def alike(rows: DataFrame, keep: int) -> DataFrame:
    """``v, ids, qkey``: one row per different vector with its ``keep`` smallest ids. Every map task cuts to those before
    the shuffle, so a vector that a third of the rows share stays small."""
    order = Window.partitionBy("v").orderBy("vec_id")
    first = rows.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= keep)
    made = first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return made.withColumn("qkey", vector_key())


def vector_key():
    """Name of a vector: its digest."""
    return F.md5(F.concat_ws(",", F.transform("v", lambda e: e.cast("string"))).cast("binary"))


class Space:
    """Rows brought to one dimension and one length; queries get 0 there."""

    def __init__(self, dim: int, top: float, largest: float = 0.0):
        self.dim, self.top = dim, top
        self.exact = max(1, dim) * max(largest, math.sqrt(top)) ** 2 < 2**53  # no sum of products can pass it

    def whole(self, vectors) -> np.ndarray:
        out = np.zeros((len(vectors), self.dim), dtype=np.int64)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    def matrix(self, vectors) -> np.ndarray:
        return self.whole(vectors).astype(np.float64)

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        return np.hstack([rows, np.sqrt(np.maximum(self.top - (rows**2).sum(axis=1, keepdims=True), 0))])

    def blur(self, norms: np.ndarray) -> np.ndarray:
        """More than the error of a distance that is computed from lengths and a product."""
        return 1e-6 * np.sqrt(norms + self.top) + SLACK

    def reach(self, norms: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distance within which rows of at least these scores are."""
        return np.sqrt(np.maximum(norms + self.top - 2 * scores, 0)) * (1 + SLACK) + 2 * self.blur(norms)

    def best_score(self, norms: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Highest score of a row at this distance or further."""
        near = np.maximum(distance * (1 - SLACK) - 2 * self.blur(norms), 0)
        return (norms + self.top - near * near) / 2 + SLACK * (1 + self.top)

    def away(self, points: np.ndarray, norms: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """Distances of lifted queries to lifted pivots, one row per query."""
        of_pivots = (pivots**2).sum(axis=1)
        return np.sqrt(np.maximum(norms[:, None] + of_pivots[None, :] - 2 * (points @ pivots.T), 0))


def distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - point) ** 2).sum(axis=1))


def build(points: np.ndarray, members: np.ndarray, pivot: np.ndarray) -> dict:
    """Page for ``members`` under ``pivot``: a leaf, or entries with pivot, covering radius and distance to ``pivot``."""
    near = distances(points[members], pivot)
    if len(members) <= PAGE:
        return {"leaf": members, "to_parent": near}
    spread = members[np.argsort(near, kind="stable")]
    chosen = spread[np.linspace(0, len(spread) - 1, FANOUT).astype(int)]
    far = np.stack([distances(points[members], points[c]) for c in chosen])
    owner = far.argmin(axis=0)
    if (owner == owner[0]).all():  # pivots too close to tell apart: cut in the order of distance
        owner = np.argsort(np.argsort(near, kind="stable")) * FANOUT // len(members)
    entries = []
    for k, c in enumerate(chosen):
        mine = owner == k
        if mine.any():
            child = build(points, members[mine], points[c])
            entries.append((c, far[k][mine].max(), distances(points[c : c + 1], pivot)[0], child))
    pivots, radii, to_parent, children = zip(*entries)
    return {"pivots": np.array(pivots), "radii": np.array(radii), "to_parent": np.array(to_parent), "children": children}


class Tree:
    """One tree over different vectors, each with its ids in rising order."""

    def __init__(self, space: Space, vectors, ids: list[list[int]], pivot: np.ndarray):
        self.space, self.pivot = space, pivot
        self.whole = None if space.exact else space.whole(vectors)
        self.points = space.lifted(space.matrix(vectors))
        self.starts = np.cumsum([0, *map(len, ids)])
        self.ids = np.array([i for some in ids for i in some], dtype=np.int64)
        self.root = build(self.points, np.arange(len(self.points)), pivot)
        self.computed = 0

    def scores(self, queries: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Inner products of whole-number queries with members, one row per query."""
        if self.whole is None:
            return (queries.astype(np.float64) @ self.points[members, :-1].T).astype(np.int64)
        return queries @ self.whole[members].T

    def search(self, query: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        """The best ``k`` (score, id) of one query."""
        return self.search_all(np.asarray(query, dtype=np.int64)[None], k, np.array([floor]))[0]

    def search_all(self, queries: np.ndarray, k: int, floors: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each query the best ``k`` (score, id) by falling score, then rising id, of scores from its floor on."""
        found: list[list[tuple[int, int]]] = []
        for at in range(0, len(queries), QUERIES_PER_BLOCK):
            found += self._search_block(queries[at : at + QUERIES_PER_BLOCK], k, floors[at : at + QUERIES_PER_BLOCK])
        return found

    def _search_block(self, queries: np.ndarray, k: int, floors: np.ndarray) -> list[list[tuple[int, int]]]:
        space, m = self.space, len(queries)
        points = np.hstack([queries.astype(np.float64), np.zeros((m, 1))])
        norms = (points**2).sum(axis=1)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * m
        limits = floors.astype(np.float64).copy()
        reach = np.where(np.isfinite(limits), space.reach(norms, np.where(np.isfinite(limits), limits, 0)), math.inf)
        to_root = space.away(points, norms, self.pivot[None])[:, 0]
        # (best score of any query, number, page, queries that may find something there, their distances and bounds)
        queue = [(-math.inf, 0, self.root, np.arange(m), to_root, np.full(m, math.inf))]
        count = 0
        while queue:
            _, _, page, live, to_pivot, bounds = heapq.heappop(queue)
            open_ = bounds >= limits[live]
            live, to_pivot = live[open_], to_pivot[open_]
            if not len(live):
                continue
            gap = np.abs(to_pivot[:, None] - page["to_parent"][None, :])
            if "leaf" in page:
                near = (gap <= reach[live][:, None]).any(axis=0)
                members = page["leaf"][near]
                if len(members):
                    self.computed += len(members) * len(live)
                    self._take(queries, live, members, k, best, limits, norms, reach)
                continue
            near = gap - page["radii"][None, :] <= reach[live][:, None]
            for e in np.flatnonzero(near.any(axis=0)).tolist():
                some = live[near[:, e]]
                away = space.away(points[some], norms[some], self.points[page["pivots"][e]][None])[:, 0]
                self.computed += len(some)
                reachable = space.best_score(norms[some], away - page["radii"][e])
                worth = reachable >= limits[some]
                if worth.any():
                    count += 1
                    item = (-float(reachable[worth].max()), count, page["children"][e], some[worth], away[worth], reachable[worth])
                    heapq.heappush(queue, item)
        return [[(int(s), int(i)) for s, i in zip(*row)] for row in best]

    def _take(self, queries, live, members, k, best, limits, norms, reach) -> None:
        """Merge the members' scores into what the live queries have."""
        scores = self.scores(queries[live], members)
        passing = scores >= limits[live][:, None]
        for at in np.flatnonzero(passing.any(axis=1)).tolist():
            q, cols = live[at], np.flatnonzero(passing[at])
            rows = members[cols]
            sizes = self.starts[rows + 1] - self.starts[rows]
            spots = np.repeat(self.starts[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            all_scores = np.concatenate([best[q][0], np.repeat(scores[at][cols], sizes)])
            all_ids = np.concatenate([best[q][1], self.ids[spots]])
            order = np.lexsort((all_ids, -all_scores))[:k]
            best[q] = all_scores[order], all_ids[order]
            if len(order) == k and all_scores[order[-1]] > limits[q]:
                limits[q] = all_scores[order[-1]]
                reach[q] = self.space.reach(norms[q], limits[q])


def top_k(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every``, the ``k`` other rows with the
    largest inner product, ties to the smaller id; fewer if there are fewer.

    Components are whole numbers of 64 bits after scaling, and scores must fit into 64 bits, as the result's type does.
    Shorter vectors count as filled up with zeros. A row that repeats its id and vector is one row; a row is never its own
    neighbour, nor is another row with its id. An empty table gives no rows.
    """
    rows = scaled(df, id_col, vector_col).distinct()
    classes = stored(alike(rows, k + 1), "vectors")
    asked = stored(rows.filter(F.col("vec_id") % every == 0).select("vec_id", "v").withColumn("qkey", vector_key()), "asked")
    norm = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    n, dim, top = classes.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm)).first()
    space = Space(dim or 0, top or 0.0)
    per_tree = max(1, min(ROWS_PER_TREE, TREE_BYTES // (8 * (space.dim + 1))))

    # the root page: different vectors with the smallest digests, at most MOST_PIVOTS
    pivots = min(MOST_PIVOTS, max(1, math.ceil(n / ROWS_PER_PIVOT)))
    chosen = [r["v"] for r in classes.orderBy("qkey").limit(pivots).collect()]
    points = space.lifted(space.matrix(chosen)) if chosen else np.zeros((0, space.dim + 1))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                own = space.lifted(space.matrix(frame["v"]))
                far = np.stack([distances(own, p) for p in points])
                yield frame.assign(cell=far.argmin(axis=0).astype("int32"), away=far.min(axis=0))

    cells = stored(classes.mapInPandas(assign, "v array<bigint>, ids array<bigint>, qkey string, cell int, away double"), "cells")
    sizes = {r["cell"]: (r["n"], r["radius"]) for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()}
    trees_of = {c: math.ceil(n / per_tree) for c, (n, _) in sizes.items()}
    if not sizes:
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    salts = F.create_map(*[F.lit(x) for pair in trees_of.items() for x in pair])
    part = F.pmod(F.xxhash64("qkey"), salts[F.col("cell")]).cast("int")

    def grow(key, frame: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(space, frame["v"], [list(i) for i in frame["ids"]], points[key[0]])
        return pd.DataFrame({"cell": [key[0]], "part": [key[1]], "tree": [pickle.dumps(tree)]})

    grown = cells.withColumn("part", part).groupBy("cell", "part").applyInPandas(grow, "cell int, part int, tree binary")
    trees = stored(grown, "trees")
    wanted = asked.select("qkey", "v").distinct()
    radii = np.array([sizes.get(c, (0, -1.0))[1] for c in range(len(points))])

    used = np.flatnonzero(radii >= 0)

    def seen(vectors) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of queries and their distances to the cells' pivots."""
        queries = np.hstack([space.matrix(vectors), np.zeros((len(vectors), 1))])
        norms = (queries**2).sum(axis=1)
        return norms, space.away(queries, norms, points[used])

    def route_first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                _, away = seen(frame["v"])
                yield frame.assign(cell=used[(away - radii[used]).argmin(axis=1)].astype("int32"), floor=-math.inf)

    def route_rest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                norms, away = seen(frame["v"])
                bounds = space.best_score(norms[:, None], away - radii[used][None, :])
                open_ = bounds >= frame["floor"].to_numpy()[:, None]
                open_[np.arange(len(frame)), (away - radii[used]).argmin(axis=1)] = False
                rows, cells_ = np.nonzero(open_)
                yield frame.iloc[rows].assign(cell=used[cells_].astype("int32"))[["qkey", "v", "cell", "floor"]]

    routed_schema = "qkey string, v array<bigint>, cell int, floor double"
    first = searched(wanted.mapInPandas(route_first, routed_schema), trees, trees_of, space, k + 1)
    first = stored(best_hits(first, k + 1), "hits")
    floors = first.groupBy("qkey").agg(F.when(F.count(F.lit(1)) > k, F.min("score").cast("double")).alias("floor"))
    waiting = wanted.join(floors, "qkey", "left").select("qkey", "v", F.coalesce("floor", F.lit(-math.inf)).alias("floor"))
    rest = searched(waiting.mapInPandas(route_rest, routed_schema), trees, trees_of, space, k + 1)
    hits = best_hits(first.unionByName(rest), k + 1)

    own = asked.select(F.col("vec_id").alias("query_id"), "qkey").distinct()
    found = own.join(hits, "qkey").filter("vec_id <> query_id").select("query_id", "vec_id", "score").distinct()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_hits(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k).drop("at")


def searched(routed: DataFrame, trees: DataFrame, trees_of: dict[int, int], space: Space, k: int) -> DataFrame:
    """Hits of each routed query in all trees of its cell. Queries of one cell come in blocks of bounded size, and the
    cell's trees meet every block."""
    routed = stored(routed, "routed")
    blocks_of = {r["cell"]: math.ceil(r["count"] / QUERIES_PER_TASK) for r in routed.groupBy("cell").count().collect()}
    if not blocks_of:
        return routed.sparkSession.createDataFrame([], HIT_SCHEMA)
    blocks = F.create_map(*[F.lit(x) for pair in blocks_of.items() for x in pair])
    parts = F.create_map(*[F.lit(x) for pair in trees_of.items() for x in pair])
    queries = routed.withColumn("block", F.pmod(F.xxhash64("qkey"), blocks[F.col("cell")]).cast("int"))
    queries = queries.withColumn("part", F.explode(F.sequence(F.lit(0), parts[F.col("cell")] - 1)))
    met = trees.filter(F.col("cell").isin(*blocks_of)).withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("cell")] - 1)))

    def search(asked: pd.DataFrame, grown: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(grown):
            tree: Tree = pickle.loads(grown["tree"].iloc[0])
            found = tree.search_all(space.whole(asked["v"]), k, asked["floor"].to_numpy())
            out = [(qkey, *hit) for qkey, hits in zip(asked["qkey"], found) for hit in hits]
        return pd.DataFrame(out, columns=["qkey", "score", "vec_id"])

    keys = ("cell", "part", "block")
    return queries.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInPandas(search, HIT_SCHEMA)
