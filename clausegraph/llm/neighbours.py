"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

1. Equal vectors collapse to one (its TOP + 1 smallest ids are enough for every answer), so copies cost one entry.
2. Vectors get one more component sqrt(M^2 - |x|^2), queries 0, so that the largest inner product is the nearest
   point. TREES trees are fitted on four fifths of a sample of at most about FIT_ROWS distinct vectors (documented bound);
   a node splits at the median of the projection on the line between two centres grown from random rows.
3. Every distinct vector is placed in one leaf of each tree. A query walks all trees through one priority queue,
   ordered by the largest margin on the wrong side along the path, until it has taken ``visits`` leaves. ``visits`` is
   measured on the fifth that the trees have not seen: the fewest at which those queries find AIM of their true
   neighbours in the sample.
4. Queries meet the rows of their leaves in a shuffle by leaf; leaves of more than CELL rows are cut into cells. Each
   task keeps the TOP + 1 best per query: products of blocks choose them with all that their rounding could hide, and
   products summed in the order of the components, as in the answer, decide.

Defined results: vectors that are null, zero, hold null or non-finite components, or differ in length from the longest
common length take no part. A query's own row is no candidate; equal vectors of other rows are. Ties go to the smaller
vec_id. Fewer candidates than TOP give fewer rows, an empty table none. Extra columns are ignored. Rows whose vec_id is null or
no whole number take no part; vec_id is taken as unique.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausegraph.llm.runtime import cut, small, table

TOP, EVERY = 20, 20
TREES, FIT_ROWS, LEAF = 6, 20_000, 512
PROBES, AIM = 200, 0.95
CELL = 4096
HELD, PAIRS = 300_000, 50_000


class Forest:
    """Fitted trees as flat arrays: normals, offsets and children of inner nodes; leaves are numbered over all trees."""

    def __init__(self, sample: np.ndarray, norm: float, leaf_rows: int, seed: int = 7):
        self.norm, self.rng = norm, np.random.default_rng(seed)
        points = self.lift(sample)
        self.normals: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[list[int]] = []  # >= 0: inner node; < 0: leaf ~x
        self.leaves = 0
        self.roots = [self._grow(points, np.arange(len(points)), leaf_rows) for _ in range(TREES)]
        self.normals = np.array(self.normals).reshape(-1, points.shape[1])
        self.offsets, self.children = np.array(self.offsets), np.array(self.children, np.int64).reshape(-1, 2)
        self.visits = self.leaves
        del self.rng

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.norm**2 - (x * x).sum(1)))
        return np.column_stack([x, more])

    def _grow(self, points: np.ndarray, rows: np.ndarray, leaf_rows: int) -> int:
        split = self._split(points, rows) if len(rows) > leaf_rows else None
        if split is None:
            self.leaves += 1
            return ~(self.leaves - 1)
        normal, offset, low = split
        at = len(self.normals)
        self.normals.append(normal)
        self.offsets.append(offset)
        self.children.append([0, 0])
        self.children[at] = [self._grow(points, rows[low], leaf_rows), self._grow(points, rows[~low], leaf_rows)]
        return at

    def _split(self, points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, float, np.ndarray] | None:
        for _ in range(5):
            some = points[self.rng.choice(rows, min(len(rows), 64), replace=False)]
            a, b = some[0], some[1]
            for _ in range(4):
                near_a = (some - (a + b) / 2) @ (a - b) > 0
                if near_a.all() or not near_a.any():
                    break
                a, b = some[near_a].mean(0), some[~near_a].mean(0)
            size = np.linalg.norm(a - b)
            if not size > 1e-12:
                continue
            normal = (a - b) / size
            along = points[rows] @ normal
            offset = float(np.median(along))
            low = along <= offset
            if low.any() and not low.all():
                return normal, offset, low
        return None

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree (rows x TREES)."""
        points = self.lift(x)
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            while (inner := np.flatnonzero(node >= 0)).size:
                n = node[inner]
                high = (points[inner] * self.normals[n]).sum(1) > self.offsets[n]
                node[inner] = self.children[n, high.astype(np.int64)]
            out[:, t] = ~node
        return out

    def walk(self, x: np.ndarray, visits: int | None = None) -> Iterator[list[int]]:
        """For each query its leaves in the order in which the shared queue gives them out."""
        visits = self.visits if visits is None else visits
        for at in range(0, len(x), 64):
            margins = self.lift(x[at : at + 64], query=True) @ self.normals.T - self.offsets
            for margin in margins.tolist():
                queue = [(-1e300, root) for root in self.roots]
                heapq.heapify(queue)
                taken: list[int] = []
                while queue and len(taken) < visits:
                    worst, node = heapq.heappop(queue)
                    while node >= 0:  # go down the near side, queue the far side
                        m = margin[node]
                        near, far = self.children_of[node] if m <= 0 else self.children_of[node][::-1]
                        heapq.heappush(queue, (max(worst, abs(m)), far))
                        node = near
                    taken.append(~node)
                yield taken

    @property
    def children_of(self) -> list[list[int]]:
        if not hasattr(self, "_children_of"):
            self._children_of = self.children.tolist()
        return self._children_of

    def calibrate(self, sample: np.ndarray, fitted: int, seed: int = 11) -> None:
        """Fewest visits that reach AIM, against all of the sample, on queries from its rows past the first ``fitted``
        (from all rows if there are none)."""
        unseen = np.arange(fitted if fitted < len(sample) else 0, len(sample))
        picked = np.random.default_rng(seed).choice(unseen, min(PROBES, len(unseen)), replace=False)
        leaf = self.place(sample)
        needed: list[int] = []
        for row, order in zip(picked, self.walk(sample[picked], self.leaves), strict=True):
            scores = sample @ sample[row]
            scores[row] = -np.inf
            best = np.argpartition(-scores, min(TOP, len(scores) - 1))[:TOP]
            rank = np.empty(self.leaves, np.int64)
            rank[order] = np.arange(len(order))
            needed += rank[leaf[best[best != row]]].min(1).tolist()
        if needed:
            self.visits = int(np.quantile(needed, AIM, method="higher")) + 1


def usable(embedding: str = "embedding") -> Column:
    """True for vectors that take part."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed component by component from the first: the very doubles of ``search``'s scores."""
    total = np.zeros(len(q))
    for at in range(q.shape[1]):
        total += q[:, at] * c[:, at]
    return total


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def search(embeddings: DataFrame, top: int = TOP, every: int = EVERY) -> DataFrame:
    """``embeddings(vec_id, embedding, ...)`` -> query_id, rank, vec_id, score for queries with vec_id % every = 0."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.expr("try_cast(vec_id AS bigint)").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v")).where(F.col("vec_id").isNotNull() & usable("v"))
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    answer = "query_id long, rank int, vec_id long, score double"
    if widths is None:
        return spark.createDataFrame([], answer)
    width = widths.w
    rows = rows.where(F.size("v") == width)
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    first = rows.withColumn("place", place).where(F.col("place") <= top + 1)  # limited before the shuffle, too
    distinct = cut(first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("key", F.col("ids")[0]))
    n = distinct.count()
    norm = float(distinct.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0]) ** 0.5
    share = min(1.0, FIT_ROWS / n)
    sampled = distinct.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(share * 1_000_000) + 1) if share < 1 else distinct
    sample = np.array(sampled.select("key", "v").orderBy("key").toArrow().column("v").to_pylist(), np.float64).reshape(-1, width)
    sample = np.random.default_rng(5).permutation(sample)
    fitted = len(sample) - len(sample) // 5
    forest = Forest(sample[:fitted], norm, max(8, int(LEAF * fitted / n)))
    forest.calibrate(sample, fitted)
    doubt = 4 * width * np.finfo(np.float64).eps * norm * norm  # over twice what the order of a sum can change
    shared = spark.sparkContext.broadcast(forest)

    def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                x = np.array(batch.column("v").to_pylist(), np.float64).reshape(-1, width)
                leaf = shared.value.place(x)
                keys = np.repeat(batch.column("key").to_numpy(), leaf.shape[1])
                data = [r.tobytes() for r in x]
                yield pa.RecordBatch.from_arrays([pa.array(leaf.ravel()), pa.array(keys), pa.array([d for d in data for _ in range(leaf.shape[1])], pa.binary())], names=["leaf", "key", "data"])

    placed = distinct.select("key", "v").mapInArrow(place_rows, "leaf long, key long, data binary")
    # The number of leaves is bounded by the fitted sample; so is this collected table of their sizes.
    sizes = np.ones(forest.leaves, np.int64)
    for r in placed.groupBy("leaf").count().where(F.col("count") > CELL).collect():
        sizes[r.leaf] = -(-r["count"] // CELL)
    cells = spark.sparkContext.broadcast(sizes)
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v")
    asked = cut(asked.join(distinct.select("v", "key"), "v").select(F.col("vec_id").alias("query_id"), "key"))
    wanted = distinct.join(asked.select("key").distinct(), "key").select("key", "v")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = cells.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                x = np.array(batch.column("v").to_pylist(), np.float64).reshape(-1, width)
                leaf, salt, key, data = [], [], [], []
                for k, v, leaves in zip(batch.column("key").to_pylist(), x, shared.value.walk(x), strict=True):
                    for one in leaves:
                        for s in range(counts[one]):
                            leaf.append(one)
                            salt.append(s)
                            key.append(k)
                            data.append(v.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(salt, pa.int32()), pa.array(key, pa.int64()), pa.array(data, pa.binary())], names=["leaf", "salt", "key", "data"])

    asking = wanted.mapInArrow(route, "leaf long, salt int, key long, data binary").withColumn("kind", F.lit(0))
    # At most one row a leaf of the fitted sample, like the array above.
    cut_leaves = spark.createDataFrame([(int(i), int(sizes[i])) for i in np.flatnonzero(sizes > 1)], "leaf long, cells int")
    offered = placed.join(small(cut_leaves, len(sizes)), "leaf", "left")
    offered = offered.withColumn("salt", F.pmod(F.xxhash64("key"), F.coalesce("cells", F.lit(1))).cast("int")).withColumn("kind", F.lit(1))
    columns = ["leaf", "salt", "kind", "key", "data"]
    met = asking.select(columns).unionByName(offered.select(columns)).repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", "kind")

    def keep(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        q, c, s = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        fresh = np.r_[True, (q[1:] != q[:-1]) | (c[1:] != c[:-1])]
        q, c, s = q[fresh], c[fresh], s[fresh]
        begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        spot = np.arange(len(q)) - np.repeat(begin, np.diff(np.r_[begin, len(q)]))
        take = spot <= top
        return q[take], c[take], s[take]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, cell = [], 0, None
        q_keys = np.zeros(0, np.int64)
        q_data = np.zeros((0, width))

        def emit(columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "cand", "score"])

        for batch in batches:
            leaf, salt, kind = (batch.column(c).to_numpy() for c in ("leaf", "salt", "kind"))
            keys, data = batch.column("key").to_numpy(), _matrix(batch.column("data"), width)
            edges = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1])]) if len(leaf) else []
            for a, b in zip(edges, [*edges[1:], len(leaf)], strict=True):
                if (now := (leaf[a], salt[a])) != cell:
                    cell, q_keys, q_data = now, np.zeros(0, np.int64), np.zeros((0, width))
                if kind[a] == 0:
                    q_keys, q_data = np.r_[q_keys, keys[a:b]], np.r_[q_data, data[a:b]]
                    continue
                for lo in range(0, len(q_keys), 512):
                    qk, scores = q_keys[lo : lo + 512], q_data[lo : lo + 512] @ data[a:b].T
                    wide = min(top + 1, b - a)
                    least = np.partition(scores, b - a - wide, axis=1)[:, b - a - wide]
                    q_at, c_at = np.nonzero(scores >= least[:, None] - doubt)
                    for p in range(0, len(q_at), PAIRS):  # many equal scores are many pairs
                        qs, cs = q_at[p : p + PAIRS], c_at[p : p + PAIRS]
                        found.append((qk[qs], keys[a:b][cs], product(q_data[lo : lo + 512][qs], data[a:b][cs])))
                        held += len(qs)
                if held > HELD:
                    found = [keep(found)]
                    held = len(found[0][0])
                    if held > HELD // 2:
                        yield emit(found[0])
                        found, held = [], 0
        if found:
            yield emit(keep(found))

    pairs = met.mapInArrow(compare, "query long, cand long, score double")
    pairs = pairs.groupBy("query", "cand").agg(F.max("score").alias("score"))
    ranked = pairs.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cand"))).where(F.col("place") <= top + 1)
    vectors = distinct.select("key", "v", "ids")
    ranked = ranked.join(vectors.select(F.col("key").alias("cand"), F.col("v").alias("cand_v"), "ids"), "cand").join(vectors.select(F.col("key").alias("query"), F.col("v").alias("query_v")), "query")
    exact = F.aggregate(F.zip_with("query_v", "cand_v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    lists = ranked.select("query", exact.alias("score"), F.explode("ids").alias("vec_id"))
    near = lists.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= top + 1)
    near = cut(near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), "vec_id"))).alias("near")))
    out = asked.join(near, asked["key"] == near["query"])
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    out = out.select("query_id", F.posexplode(others).alias("pos", "one"))
    return out.select(F.col("query_id").cast("long"), (F.col("pos") + 1).cast("int").alias("rank"), F.col("one.vec_id").cast("long").alias("vec_id"), (-F.col("one.neg")).alias("score"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


QUERIES = {"op10_neighbours": op10_neighbours}
SQL: dict[str, str] = {}
