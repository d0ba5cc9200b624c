r"""Hard-negative mining: exact windows of inner products, found in cover trees of blocks of candidates.

Candidates are dealt in ranges of their labels into blocks of some 4,096 rows. Each block's vectors are
augmented by one component that gives them all the block's largest norm, so the largest inner product
is the least distance, and a cover tree is built over them: farthest-first insertion gives nested nets
whose levels halve the covering radius, every point of a level is at least that radius from the others,
and a node keeps the true largest distance to what lies below it. For a query q, a node with centre c
and radius r holds inner products from q.c - |q| r to q.c + |q| r only.

The queries are a stated set (every hundredth row, in chunks of some 2,048), against all rows in
blocks. Positives come first: a best-first descent takes the node with the largest bound, verifies leaves
exactly, and ends where no bound reaches the fifth best. Then each positive's score gives a window, and
one descent for all of an anchor's windows skips nodes that lie above or below them. Blocks give at most five rows a query; the first
five of all blocks are taken by a window function.

Defined results: rows with a null label or vector, or with a null or non-finite component, take no part;
vectors of unequal length are compared as if zeros followed the shorter; equal scores come by vec_id (null
last), then by a number stored with the rows, so repeated rows are rows of their own (also as an
anchor's positives); a positive whose score is negative has no negatives, as its window is empty; scores
are exact, and beyond 64 bits they are given as the least or greatest long; further columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brackwater.llm.common import stored, table, tidy

BLOCK = 4096
CHUNK = 2048
LEAF = 64
FIRST = 5
LONG = (-(1 << 63), (1 << 63) - 1)
EXACT = float(1 << 53)
NO_ID = np.iinfo(np.int64).max


def prepared(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, label, vector of whole numbers) of the rows that take part."""
    x = F.col("embedding")
    whole = F.col("label").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform(x, lambda c: floor_double(c.cast("double") * 256))
    return embeddings.filter(whole).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.alias("vector"))


def floor_double(x):
    """The floor as a double: Spark's gives a long, and numbers of 2^52 and more are whole already."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


class Tree:
    """A cover tree over one block: nodes with centre, radius, children and, in leaves, a run of rows."""

    def __init__(self, row: np.ndarray, vec_id: np.ndarray, label: np.ndarray, x: np.ndarray):
        norm = (x**2).sum(axis=1)
        lifted = np.concatenate([x, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], axis=1)
        centres, level = self._nets(lifted)
        self._link(lifted, centres, level)
        self.row, self.vec_id, self.label, self.x = row[self.order], vec_id[self.order], label[self.order], x[self.order]
        self.centre = lifted[self.centre_at][:, :-1]

    def _nets(self, points: np.ndarray) -> tuple[list[int], list[int]]:
        """Centres in farthest-first order and the level at which each enters: its distance to those
        before it lies between the level's radius and twice that."""
        near = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
        centres, level, top = [0], [0], float(near.max())
        while len(centres) * LEAF < len(points) and near.max() > 0:
            p = int(near.argmax())
            level.append(int(np.floor(np.log2(top / near[p]))) + 1)
            centres.append(p)
            near = np.minimum(near, np.sqrt(((points - points[p]) ** 2).sum(axis=1)))
        return centres, level

    def _link(self, points: np.ndarray, centres: list[int], level: list[int]) -> None:
        """Each centre becomes a node at its level and below; its parent is the nearest centre one level up."""
        n, at = len(points), points[centres]
        levels = sorted(set(level))
        nodes: list[int] = [0]  # the centre of each node
        parent, live = [-1], {0: 0}  # the node that a centre has at the present level
        for l in levels[1:]:
            entering = [i for i, x in enumerate(level) if x == l]
            old = np.array(sorted(live))
            gap = ((at[entering][:, None, :] - at[old][None, :, :]) ** 2).sum(axis=2) if len(entering) * len(old) * at.shape[1] < 1 << 24 else np.stack([((at[old] - at[i]) ** 2).sum(axis=1) for i in entering])
            above = old[gap.argmin(axis=1)]
            now = dict(live)
            for c in {*above.tolist()}:  # nested nets: the parent is a centre of this level as well
                parent.append(live[c])
                now[c] = len(nodes)
                nodes.append(c)
            for i, c in zip(entering, above.tolist(), strict=True):
                parent.append(live[c])
                now[i] = len(nodes)
                nodes.append(i)
            live = now
        # leaves: every point goes to the nearest centre
        best, of = np.full(n, np.inf), np.zeros(n, np.int64)
        for i in range(len(centres)):
            d = ((points - at[i]) ** 2).sum(axis=1)
            of[d < best] = i
            best = np.minimum(best, d)
        self.order = np.argsort(of, kind="stable")
        stops = np.cumsum(np.bincount(of, minlength=len(centres)))
        self.centre_at = np.array([centres[c] for c in nodes])
        self.parent = np.array(parent)
        self.run = np.zeros((len(nodes), 2), np.int64)
        for c, node in live.items():
            self.run[node] = stops[c - 1] if c else 0, stops[c]
        # the true radius: over all points of all leaves below
        radius = np.zeros(len(nodes))
        for c, node in live.items():
            own = points[self.order[slice(*self.run[node])]]
            while node >= 0 and len(own):
                radius[node] = max(radius[node], float(np.sqrt(((own - at[nodes[node]]) ** 2).sum(axis=1).max())))
                node = parent[node]
        self.radius = radius

    def children(self) -> list[list[int]]:
        below: list[list[int]] = [[] for _ in self.parent]
        for node, up in enumerate(self.parent.tolist()):
            if up >= 0:
                below[up].append(node)
        return below

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, row=self.row, vec_id=self.vec_id, label=self.label, x=self.x, centre=self.centre, parent=self.parent, run=self.run, radius=self.radius)
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.__dict__.update(np.load(io.BytesIO(blob)))
        return tree


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where all partial sums are below 2^53, else in whole numbers of any size."""
    most = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1]
    if most < EXACT:
        return x @ q
    return np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape) @ np.array([int(v) for v in q], dtype=object)


class Search:
    """Best-first descents of one block for a chunk of queries."""

    def __init__(self, tree: Tree, queries: np.ndarray):
        width = max(tree.x.shape[1], queries.shape[1])
        pad = lambda a: np.pad(a, ((0, 0), (0, width - a.shape[1])))
        self.tree, self.below = tree, tree.children()
        self.x, self.queries, centre = pad(tree.x), pad(queries), pad(tree.centre)
        norm = np.sqrt((self.queries**2).sum(axis=1))[:, None]
        middle, reach = self.queries @ centre.T, norm * tree.radius[None, :]
        slack = 1e-9 * (np.abs(middle) + norm * np.sqrt((centre**2).sum(axis=1))[None, :] + reach) + 1e-3
        self.high, self.low = middle + reach + slack, middle - reach - slack

    def descend(self, i: int, allowed, windows: list[tuple[float, float]]) -> list[list[tuple]]:
        """The first rows of each window (least and greatest score), of those that ``allowed`` gives for a leaf's rows.

        One descent serves all windows of a query: it ends where no bound reaches what any of them lacks.
        """
        bound, least, top = self.high[i], self.low[i], max(high for _, high in windows)
        best: list[list[tuple]] = [[] for _ in windows]  # heaps of (score, -id, -row), the worst first
        lacks = lambda: min(heap[0][0] if len(heap) == FIRST else low for heap, (low, _) in zip(best, windows, strict=True))
        queue, need = [(-bound[0], 0)], lacks()
        self.verified = 0
        while queue and -queue[0][0] >= need:
            _, node = heapq.heappop(queue)
            a, z = self.tree.run[node]
            if z > a:
                self.verified += 1
                score = products(self.x[a:z], self.queries[i])
                for k in np.flatnonzero((score >= need) & (score <= top) & allowed(a, z)):
                    item = (score[k], -int(self.tree.vec_id[a + k]), -int(self.tree.row[a + k]))
                    for heap, (low, high) in zip(best, windows, strict=True):
                        if low <= item[0] <= high:
                            if len(heap) < FIRST:
                                heapq.heappush(heap, item)
                            elif item > heap[0]:
                                heapq.heapreplace(heap, item)
                need = lacks()
            for child in self.below[node]:
                if bound[child] >= need and least[child] <= top:
                    heapq.heappush(queue, (-bound[child], child))
        return best


def matrix(vectors) -> np.ndarray:
    """Vectors as rows, zeros after the shorter ones."""
    sizes = [len(v) for v in vectors]
    out = np.zeros((len(sizes), max(sizes, default=0)))
    for r, v in zip(out, vectors, strict=True):
        r[: len(v)] = v
    return out


def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One tree for a partition, with its least and largest label."""
    rows = list(batches)
    if sum(b.num_rows for b in rows):
        rows = pa.Table.from_batches(rows)
        row, vec_id, label = (pc.fill_null(rows[c], NO_ID).to_numpy() for c in ("row", "vec_id", "label"))
        tree = Tree(row, vec_id, label, matrix(rows["vector"].to_pylist()))
        block = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"block": [block], "low": [int(tree.label.min())], "high": [int(tree.label.max())], "tree": [tree.dump()]})


def forest(rows: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """(block, low, high, tree): ranges of (label, hash of the row) of some ``block`` rows, a hot label in many."""
    dealt = rows.withColumn("salt", F.xxhash64("row")).repartitionByRange(max(1, -(-n // block)), "label", "salt")
    return stored(dealt.select("row", "vec_id", "label", "vector").mapInArrow(grow, "block long, low long, high long, tree binary"), "negatives-forest")


def clipped(score) -> int:
    return min(max(int(score), LONG[0]), LONG[1])


def positives_of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The first rows of each anchor's own label in a block."""
    found = []
    if len(left) and len(right):
        tree = Tree.load(right["tree"].iloc[0])
        search = Search(tree, matrix(left["vector"].tolist()))
        for i, (row, label) in enumerate(zip(left["row"], left["label"], strict=True)):
            own = lambda a, z, label=label, row=row: (tree.label[a:z] == label) & (tree.row[a:z] != row)
            found += [(row, clipped(s), -v, -r) for s, v, r in search.descend(i, own, [(-np.inf, np.inf)])[0]]
    return pd.DataFrame(found, columns=["row", "score", "other_id", "other"])


def negatives_of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The first rows of other labels in a block, for each window of each anchor."""
    found = []
    if len(left) and len(right):
        tree = Tree.load(right["tree"].iloc[0])
        search = Search(tree, matrix(left["vector"].tolist()))
        for i, (row, label, scores) in enumerate(zip(left["row"], left["label"], left["scores"], strict=True)):
            other = lambda a, z, label=label: tree.label[a:z] != label
            scores = sorted({int(s) for s in scores if s >= 0})
            if scores:
                for score, best in zip(scores, search.descend(i, other, [(-(-80 * s // 100), s) for s in scores]), strict=True):
                    found += [(row, score, clipped(s), -v, -r) for s, v, r in best]
    return pd.DataFrame(found, columns=["row", "window", "score", "other_id", "other"])


def first_of(found: DataFrame, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id", "other")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= FIRST)


def mine(embeddings: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    rows = stored(prepared(embeddings), "negatives-rows")
    n, n_anchors = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % 100 == 0)).first()
    trees = forest(rows, n, block)
    chunks = max(1, -(-n_anchors // chunk))
    anchors = rows.filter(F.col("vec_id") % 100 == 0).withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
    blocks = trees.select("block", "low", "high")
    last = blocks.agg(F.max("block")).first()[0]
    if last is None:
        return embeddings.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    # every chunk of the stated queries against every block, but for blocks whose labels rule them out
    to_blocks = lambda df, keep: df.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last)))).join(blocks, "block").filter(keep).drop("low", "high").groupBy("block", "chunk")
    cells = trees.select("block", "tree").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))).groupBy("block", "chunk")
    near = to_blocks(anchors.select("row", "label", "vector", "chunk"), "label between low and high").cogroup(cells).applyInPandas(lambda left, right: positives_of(left, right), "row long, score long, other_id long, other long")
    positives = stored(first_of(near, "row"), "negatives-positives")
    windows = positives.groupBy("row").agg(F.collect_set("score").alias("scores"))  # five at most
    asked = anchors.join(windows, "row").select("row", "label", "vector", "chunk", "scores")
    far = to_blocks(asked, "low < high or label <> low").cogroup(cells).applyInPandas(lambda left, right: negatives_of(left, right), "row long, window long, score long, other_id long, other long")
    negatives = first_of(far, "row", "window").select("row", "window", F.col("place").alias("rank"), given("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = positives.select("row", F.col("score").alias("window"), given("other_id").alias("positive_id"))
    named = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    return pairs.join(negatives, ["row", "window"]).join(named, "row").select("anchor_id", "positive_id", "rank", "negative_id", F.col("window").alias("positive_score"), "negative_score")


def given(column: str):
    """A vec_id that was null is null again."""
    return F.when(F.col(column) != F.lit(NO_ID), F.col(column))


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    return tidy(lambda: mine(table(spark, sf_dir, "embeddings")), spark, "negatives")


OP13_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.rid <> b.rid),
p AS (SELECT arid, anchor_id, rid AS prid, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id, rid) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (arid, anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY arid, prid ORDER BY score DESC, vec_id, rid) QUALIFY row_number() OVER w <= 5
"""
