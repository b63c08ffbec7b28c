"""Exact top-k inner products by best-first search in M-trees.

With one further component sqrt(M^2 - |x|^2), M the largest norm, the squared distance of a query (further component
0) to x is |q|^2 + M^2 - 2 q.x: nearest is largest inner product, and distances obey the triangle inequality. The
vectors are dealt to shards around routing vectors; each shard is an M-tree of paged nodes with covering radii and
distances to the parent. A query first searches the shards of its nearest route, then those that its bound cannot rule out.
"""

from __future__ import annotations

import heapq
import io
from math import ceil, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm.common import need, ragged, table, written
from attesta.llm.lloyd import whole

#: A page of vectors is scored in one product, so it is as large as a core's cache takes.
PAGE, FANOUT = 256, 32
SHARD_ROWS, QUERY_ROWS = 4096, 8192
#: Routing vectors: at least so many if there are shards enough, about the root of the rows, and so many bytes at most.
ROUTES, ROUTE_BYTES = 256, 8 << 20
#: Vectors, for each routing vector, among which those that lie farthest apart are chosen.
DRAWN = 4
#: Bounds give way by so much, relatively and absolutely; distances are square roots of exact integers.
SLACK = 1e-7
#: Squared norms below this make float products exact; up to ``WHOLE_NORM`` scores are summed as 64-bit integers.
FLOAT_NORM, WHOLE_NORM = 1 << 51, 1 << 62
#: A score below any.
NONE = -(1 << 62)


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, v array<long>, n2 long, x array<double>) of the rows whose id and components are all there and finite: v is
    floor(scale * x) and n2 its squared norm; both are null, and x isn't, where that is 2^62 or more."""
    good = F.forall(f"`{vec_col}`", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = F.transform(f"`{vec_col}`", lambda x: F.floor(x.cast("double") * scale))
    kept = df.filter(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{vec_col}`").isNotNull() & good)
    kept = kept.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("x"), v.alias("w"))
    about = F.aggregate("w", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    small = about < float(WHOLE_NORM)
    exact = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long"))
    return kept.select("id", F.when(small, F.transform("w", lambda x: x.cast("long"))).alias("v"), F.when(small, exact).alias("n2"), F.when(~small, F.col("x")).alias("x"))


def matrix(vectors, width: int = 0) -> np.ndarray:
    """Vectors as rows of whole numbers; shorter ones end in zeros."""
    width = max([width, *map(len, vectors)])
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _widen(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def far_apart(points: np.ndarray, extra: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` of the points, with their further components: each next one is the farthest from those before."""
    points, chosen = points.astype(np.float64), [0]
    near = np.full(len(points), np.inf)
    while len(chosen) < min(n, len(points)):
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(axis=1) + (extra - extra[chosen[-1]]) ** 2)
        chosen.append(int(np.argmax(near)))
    return points[chosen], extra[chosen]


class Tree:
    """A bulk-loaded M-tree. Node i covers children first[i] .. first[i] + count[i]: nodes, or points in a leaf."""

    FIELDS = ("whole", "extra", "ids", "point_parent", "center", "radius", "parent", "first", "count", "leaf")

    def __init__(self, ids: np.ndarray, whole: np.ndarray, extra: np.ndarray):
        """``whole``: the points, integers; ``extra``: the further component of each."""
        self.points, self.extra, self.ids = whole.astype(np.float64), extra, ids
        order: list[np.ndarray] = []
        nodes: list[list] = []  # center, radius, parent distance, first, count, leaf
        rows = np.arange(len(ids))
        root = self._pick(rows)
        queue = [(self._node(nodes, root, rows, 0.0), rows)]
        placed = 0
        while queue:  # breadth first, so that the children of a node lie together
            at, rows = queue.pop(0)
            if len(rows) <= PAGE:
                nodes[at][3:] = [placed, len(rows), True]
                order.append(rows)
                placed += len(rows)
                continue
            groups = self._split(rows)
            nodes[at][3:] = [len(nodes), len(groups), False]
            for center, part in groups:
                gap = float(self._apart(np.array([center]), nodes[at][0])[0])
                queue.append((self._node(nodes, center, part, gap), part))
        perm = np.concatenate(order) if order else rows
        back = np.empty(len(perm), np.int64)
        back[perm] = np.arange(len(perm))
        columns = list(zip(*nodes, strict=True))
        self.center = back[np.array(columns[0])] if len(ids) else np.array([0])
        self.radius, self.parent = np.array(columns[1]), np.array(columns[2])
        self.first, self.count, self.leaf = np.array(columns[3]), np.array(columns[4]), np.array(columns[5])
        self.whole, self.points, self.extra, self.ids = whole[perm], self.points[perm], extra[perm], ids[perm]
        self.point_parent = np.zeros(len(perm))
        for i in np.flatnonzero(self.leaf):
            own = np.arange(self.first[i], self.first[i] + self.count[i])
            if len(own):
                self.point_parent[own] = self._apart(own, self.center[i])

    def _apart(self, rows: np.ndarray, center: int) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[center]) ** 2).sum(axis=1) + (self.extra[rows] - self.extra[center]) ** 2)

    def _node(self, nodes: list, center: int, rows: np.ndarray, parent: float) -> int:
        nodes.append([center, float(self._apart(rows, center).max()) if len(rows) else 0.0, parent, 0, 0, True])
        return len(nodes) - 1

    def _pick(self, rows: np.ndarray) -> int:
        """The point nearest to the mean."""
        if not len(rows):
            return 0
        off = ((self.points[rows] - self.points[rows].mean(axis=0)) ** 2).sum(axis=1)
        return int(rows[np.argmin(off)])

    def _split(self, rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Groups around spread-out centers; points that all coincide are cut evenly."""
        n = min(FANOUT, ceil(len(rows) / PAGE) * 2)
        centers = [int(rows[0])]
        near = self._apart(rows, centers[0])
        owner = np.zeros(len(rows), np.int64)
        while len(centers) < n:
            far = int(np.argmax(near))
            if near[far] == 0:
                break
            centers.append(int(rows[far]))
            gap = self._apart(rows, centers[-1])
            closer = gap < near
            owner[closer], near = len(centers) - 1, np.minimum(gap, near)
        if len(centers) == 1:
            return [(int(part[0]), part) for part in np.array_split(rows, min(FANOUT, ceil(len(rows) / PAGE)))]
        return [(c, rows[owner == k]) for k, c in enumerate(centers)]

    def dump(self) -> bytes:
        out = io.BytesIO()
        low, high = int(self.whole.min(initial=0)), int(self.whole.max(initial=0))
        kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
        np.savez(out, **{k: getattr(self, k) for k in self.FIELDS} | {"whole": self.whole.astype(kind)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> "Tree":
        out = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as z:
            for k in cls.FIELDS:
                setattr(out, k, z[k])
        out.whole = out.whole.astype(np.int64)
        out.points = out.whole.astype(np.float64)
        return out

    def widen(self, width: int) -> None:
        self.whole, self.points = _widen(self.whole, width), _widen(self.points, width)

    def search(self, q: np.ndarray, own: int, base: int, k: int, least: int = NONE) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id) but for ``own``, best first, ties to the smaller id, and the distances computed.

        q: integers; base: |q|^2 + M^2. least: a score that k candidates elsewhere already reach.
        """
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        if not len(self.ids):
            return [], 0
        # sums past 2^53 round: scores are then summed as integers, and bounds give way by the error
        exact = base < 2 * FLOAT_NORM
        points, asked = (self.points, q.astype(np.float64)) if exact else (self.whole, q)
        loose = SLACK if exact else SLACK + float(base) ** 0.5 * 2.0**-22
        q = q.astype(np.float64)
        bound = float(max(base - 2 * least, 0)) ** 0.5 if least > NONE else np.inf
        apart = lambda rows: np.sqrt(np.maximum(base - 2 * (self.points[rows] @ q), 0))
        start = float(apart(self.center[:1])[0])
        heap, work = [(max(0.0, start - self.radius[0]), 0, start)], 1
        while heap:
            low, node, gap = heapq.heappop(heap)
            limit = bound * (1 + SLACK) + loose
            if low > limit:
                break
            begin, end = int(self.first[node]), int(self.first[node] + self.count[node])
            if self.leaf[node]:
                near = np.abs(gap - self.point_parent[begin:end]) <= limit
                hits = int(np.count_nonzero(near))
                if not hits:
                    continue
                rows = None if hits > (end - begin) // 2 else np.flatnonzero(near) + begin
                scores = (points[begin:end] if rows is None else points[rows]) @ asked
                work += len(scores)
                floor = max(best[0][0] if len(best) == k else NONE, least)
                for i in np.flatnonzero(scores >= floor).tolist():
                    entry = (int(scores[i]), -int(self.ids[begin + i if rows is None else rows[i]]))
                    if -entry[1] == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                if len(best) == k:
                    bound = min(bound, float(max(base - 2 * best[0][0], 0)) ** 0.5)
                continue
            rows = np.flatnonzero(np.abs(gap - self.parent[begin:end]) - self.radius[begin:end] <= limit) + begin
            gaps = apart(self.center[rows])
            work += len(rows)
            for i, g in zip(rows.tolist(), gaps.tolist(), strict=True):
                low = max(0.0, g - self.radius[i])
                if low <= limit:
                    heapq.heappush(heap, (low, i, g))
        return [(int(s), -i) for s, i in sorted(best, key=lambda x: (-x[0], -x[1]))], work


def _build(top: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n2 = pdf["n2"].to_numpy(np.int64)
        tree = Tree(pdf["id"].to_numpy(np.int64), matrix(list(pdf["v"])), np.sqrt((top - n2).astype(np.float64)))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "tree": [tree.dump()]})

    return run


def _search(top: int, k: int):
    def run(trees: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        for data in trees["tree"]:
            tree = Tree.load(data)
            if not len(queries):
                break
            q = matrix(list(queries["v"]), tree.points.shape[1])
            tree.widen(q.shape[1])
            for i, (name, n2, least) in enumerate(zip(queries["id"], queries["n2"], queries["least"], strict=True)):
                found, _ = tree.search(q[i], int(name), int(n2) + top, k, int(least))
                out += [(name, i, s) for s, i in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_inner_products(df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` (a condition on ``id``), the k rows with the
    largest inner products of the vectors floor(scale * x), rows with its own id left out, ties to the smaller id.

    Defined cases: rows with a null id, a null vector or a null or non-finite component take no part; of vectors of unequal
    length the shorter end in zeros; repeated candidates are each a candidate; of query rows that repeat an id the smallest
    vector asks; with fewer than k candidates all are returned; an empty table gives no rows; other columns are ignored.
    Equal vectors, however many, are parted over shards by their ids. Vectors with a squared norm of 2^62 or more, whose
    products need not fit a long, meet all others in blocks (:func:`_large_pairs`); ranks are by the exact product, and a
    score that a long can't hold is null.

    A tree goes to the blocks of queries that its shard's bound cannot rule out, and to no others. Vectors without any
    structure rule nothing out: every query then meets every shard, and the work is queries times rows.
    """
    need(df, id_col, vec_col)
    vecs = written(whole_vectors(df, id_col, vec_col, scale), "vectors")
    rows, top, width, n_large = vecs.agg(F.count("n2"), F.max("n2"), F.max(F.size("v")), F.count("x")).first()
    small = vecs.filter("n2 is not null").select("id", "v", "n2")
    if not n_large:
        return _tree_products(small, rows, top, width, is_query, k, shard_rows)
    # of query rows that repeat an id one asks, whatever its size
    first = vecs.filter(is_query(F.col("id"))).groupBy("id").agg(F.min(F.struct(F.col("x").isNotNull().alias("large"), "v", "x")).alias("q"))
    asking = written(first.select("id", "q.v", "q.x"), "asking")
    of_tree = _tree_products(small, rows, top, width, is_query, k, shard_rows)
    large = vecs.filter("x is not null").select("id", "v", "x")
    found = of_tree.select("query_id", "vec_id", F.col("score").cast("string").alias("score"))
    found = found.unionByName(_large_pairs(asking, large, scale, k)).unionByName(_large_pairs(asking.filter("x is not null"), small.select("id", "v", F.lit(None).cast("array<double>").alias("x")), scale, k))
    return found.groupBy("query_id").applyInPandas(_ranked(k), "query_id long, rank int, vec_id long, score long")


def _ranked(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted((-int(s), i) for s, i in zip(pdf["score"], pdf["vec_id"], strict=True))[:k]
        scores = pd.array([-s if -(1 << 63) <= -s < 1 << 63 else None for s, _ in rows], "Int64")
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "rank": range(1, len(rows) + 1), "vec_id": [i for _, i in rows], "score": scores})

    return run


#: Queries and candidates that meet at a time outside the trees.
LARGE_ROWS = 1024


def exact_best(queries: list[list[int]], query_ids: list[int], points: list[list[int]], ids: list[int], k: int) -> list[tuple[int, int, int]]:
    """(query id, id, product) of the k largest products of each query with points of other ids, whole numbers of any size.

    Products of the leading 53 bits rule out most points: what they can be off by is known. The rest is multiplied exactly.
    """
    width = max([1, *map(len, queries), *map(len, points)])

    def leading(vectors):
        shift = [max([0, *(abs(x).bit_length() for x in v)]) for v in vectors]
        out = np.zeros((len(vectors), width))
        for i, (v, s) in enumerate(zip(vectors, shift, strict=True)):
            out[i, : len(v)] = [x / (1 << s) for x in v]  # true division of whole numbers is right to the last bit
        return out, np.array(shift)

    (a, _), (b, shift) = leading(queries), leading(points)
    scale = np.exp2(np.maximum(shift - shift.max(initial=0), -1000).astype(np.float64)) if len(points) else np.zeros(0)
    off = 2.0**-50 * width * width * scale + width * 2.0**-990
    ids_, out = np.array(ids), []
    for v, row, own in zip(queries, a, query_ids, strict=True):
        others = np.flatnonzero(ids_ != own)
        about = (b[others] @ row) * scale[others]
        if len(others) > k:
            sure = np.partition(about - off[others], len(others) - k)[len(others) - k]
            others = others[about + off[others] >= sure]
        best = sorted((-sum(x * y for x, y in zip(v, points[i], strict=False)), ids[i]) for i in others.tolist())[:k]
        out += [(own, i, -s) for s, i in best]
    return out


def _large_pairs(queries: DataFrame, points: DataFrame, scale: int, k: int) -> DataFrame:
    """(query_id, vec_id, score as decimal text): the k best of each block of points for each query, by exact products.

    Blocks of ``LARGE_ROWS`` on both sides, each pair of blocks a task's work: queries times points in all, without bounds.
    """
    nq, np_ = (max(1, ceil(d.count() / LARGE_ROWS)) for d in (queries, points))
    place = F.xxhash64("id", F.monotonically_increasing_id())
    q = queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(nq))).withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(np_ - 1))))
    p = points.withColumn("pb", F.pmod(place, F.lit(np_)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))))

    def numbers(pdf: pd.DataFrame) -> list[list[int]]:
        return [[int(n) for n in (whole(np.asarray(x, np.float64), scale) if x is not None else v)] for v, x in zip(pdf["v"], pdf["x"], strict=True)]

    def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        found = exact_best(numbers(q), q["id"].tolist(), numbers(p), p["id"].tolist(), k)
        return pd.DataFrame([(a, b, str(s)) for a, b, s in found], columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64"})

    return q.groupBy("qb", "pb").cogroup(p.groupBy("qb", "pb")).applyInPandas(run, "query_id long, vec_id long, score string")


def _tree_products(vecs: DataFrame, rows: int, top: int, width: int, is_query, k: int, shard_rows: int) -> DataFrame:
    """:func:`top_inner_products` of vectors (id, v, n2), all with a squared norm below 2^62."""
    spark = vecs.sparkSession
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_routes = max(1, min(ceil(rows / shard_rows), max(ROUTES, isqrt(rows)), ROUTE_BYTES // (8 * max(width, 1))))
    some = vecs.orderBy(F.xxhash64("id"), "id").limit(DRAWN * n_routes).toArrow()  # DRAWN * ROUTE_BYTES at most
    center, extra = far_apart(matrix(some.column("v").to_pylist(), width), np.sqrt((top - some.column("n2").to_numpy()).astype(np.float64)), n_routes)
    centers = spark.sparkContext.broadcast((center, extra, (center**2).sum(axis=1)))
    loose = SLACK if top < FLOAT_NORM else SLACK + float(top) ** 0.5 * 2.0**-22

    def route(batches):
        center, extra, norm = centers.value
        for batch in batches:
            v = matrix(batch.column(1).to_pylist(), width).astype(np.float64)
            n2 = batch.column(2).to_numpy()
            further = np.sqrt((top - n2).astype(np.float64))
            near = np.argmin(norm[None, :] - 2 * v @ center.T + (further[:, None] - extra[None, :]) ** 2, axis=1)
            gap = np.sqrt(((v - center[near]) ** 2).sum(axis=1) + (further - extra[near]) ** 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(gap)], ["id", "v", "n2", "route", "gap"])

    routed = written(vecs.mapInArrow(route, "id long, v array<long>, n2 long, route int, gap double"), "routed")
    sizes = routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).orderBy("route").collect()  # a row for each route
    begin, parts, radius = (np.full(len(center), x) for x in (0, 0, -1.0))
    for r in sizes:  # a route with too many rows is parted by id
        parts[r.route], radius[r.route] = ceil(r.n / shard_rows), r.radius
    begin[1:] = np.cumsum(parts)[:-1]
    of_route = F.broadcast(spark.createDataFrame([(i, int(begin[i]), int(parts[i])) for i in range(len(parts))], "route int, first long, parts long"))
    dealt = routed.join(of_route, "route").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int"))
    trees = written(dealt.groupBy("shard").applyInPandas(_build(top), "shard int, tree binary"), "trees")

    held = np.zeros(len(center), np.int64)
    for r in sizes:
        held[r.route] = r.n
    open_to = spark.sparkContext.broadcast(np.flatnonzero(held > k) if (held > k).any() else np.flatnonzero(held))

    def first_route(batches):
        # the route of the nearest center that can give k rows: its k-th best is a bound for all others
        own = open_to.value
        center = centers.value[0][own]
        for batch in batches:
            v = matrix(batch.column(1).to_pylist(), width).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own[np.argmax(v @ center.T, axis=1)].astype(np.int32))], ["id", "v", "n2", "route"])

    asked = vecs.filter(is_query(F.col("id"))).groupBy("id").agg(F.min(F.struct("v", "n2")).alias("q")).select("id", "q.v", "q.n2")
    asked = written(asked.mapInArrow(first_route, "id long, v array<long>, n2 long, route int"), "asked")
    n_blocks = max(1, ceil(asked.count() / QUERY_ROWS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))

    def search(queries: DataFrame) -> DataFrame:
        # a tree meets one block of queries at a time: neither side of a group grows with the data
        queries = written(queries.select("id", "v", "n2", "block", "least", "shard"), "queries")
        pairs = trees.join(queries.select("shard", "block").distinct(), "shard").select("shard", "block", "tree").toDF("shard", "block", "tree")
        met = pairs.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block"))
        return written(met.applyInPandas(_search(top, k), "query_id long, vec_id long, score long"), "found")

    # a first route for each query: its parts share the k best of its rows
    near = asked.join(of_route, "route").withColumn("least", F.lit(NONE)).withColumn("shard", F.explode(F.sequence(F.col("first").cast("int"), (F.col("first") + F.col("parts") - 1).cast("int"))))
    found = search(near)
    if len(sizes) == 1:
        return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    kth = _best(found, k).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    spread = spark.sparkContext.broadcast((begin, parts, radius))

    def others(batches):
        center = centers.value[0]
        begin, parts, radius = spread.value
        for batch in batches:
            v = matrix(batch.column(1).to_pylist(), width).astype(np.float64)
            base = batch.column(2).to_numpy() + float(top)
            least = batch.column(5).to_numpy()
            gap = np.sqrt(np.maximum(base[:, None] - 2 * v @ center.T, 0))
            limit = np.where(least > NONE, np.sqrt(np.maximum(base - 2.0 * least, 0)), np.inf)
            open_ = (gap - radius[None, :] <= limit[:, None] * (1 + SLACK) + 2 * loose) & (parts > 0)[None, :]
            open_[np.arange(len(v)), batch.column(3).to_numpy()] = False
            row, r = np.nonzero(open_)
            shard = ragged(begin[r], parts[r])
            at = pa.array(np.repeat(row, parts[r]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in (0, 1, 2, 4, 5)), pa.array(shard.astype(np.int32))], ["id", "v", "n2", "block", "least", "shard"])

    waiting = asked.join(kth, "id", "left").select("id", "v", "n2", "route", "block", F.coalesce("least", F.lit(NONE)).alias("least"))
    more = search(waiting.mapInArrow(others, "id long, v array<long>, n2 long, block int, least long, shard int"))
    return _best(found.unionByName(more), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


OP7_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
           where embedding is not null and vec_id is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
      from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""
