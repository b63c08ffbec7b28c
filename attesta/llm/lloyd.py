"""Centroid clustering by Lloyd's rounds, sharded by dimension, in exact integers.

Vectors are cut into chunks of rows and blocks of columns. The task of a column block has that block's slice of the
centroids only and gives the exact partial squared distances of a chunk; those of all blocks are added by chunk and the
nearest centroid taken; then each column block sums its own columns by cluster and makes its own slice anew. Nothing but
numbers of partial distances and assignments moves between blocks, and no task or driver needs a whole model. Tables of a
round are written to the shared folder, so a lost executor costs its tasks only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import need, scratch_path, table, written

#: Columns of a block, rows of a chunk, and the bytes of the partial distances of a chunk over all blocks.
WIDTH, ROWS, SUM_BYTES = 16, 1024, 8 << 20
#: A slice is joined by block and lane, so that one key meets so many chunks at most.
LANE_CHUNKS = 256
#: A task hands on its sums by cluster when they take so many numbers.
HELD = 1 << 20

KINDS = (np.int8, np.int16, np.int32, np.int64)


def pack(a: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them; those beyond 64 bits as decimal text."""
    low, high = (int(a.min()), int(a.max())) if a.size else (0, 0)
    for i, kind in enumerate(KINDS):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return bytes([i]) + a.astype(kind).tobytes()
    return b"\xff" + " ".join(map(str, a.ravel())).encode()


def unpack(data: bytes, width: int) -> np.ndarray:
    if data[0] == 0xFF:
        out = np.array([int(x) for x in data[1:].split()], object)
    else:
        out = np.frombuffer(data, KINDS[data[0]], offset=1).astype(np.int64)
    return out.reshape(-1, width)


def largest(a: np.ndarray) -> int:
    return max(abs(int(a.max())), abs(int(a.min()))) if a.size else 0


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles, exactly: in 64 bits where they suffice, else in Python's integers."""
    if not x.size or np.abs(x).max() * scale < 1 << 52:
        return np.floor(x * scale).astype(np.int64)

    def one(v: float) -> int:
        above, below = v.as_integer_ratio()
        return above * scale // below

    out = np.empty(x.shape, object)
    out.ravel()[:] = [one(v) for v in x.ravel().tolist()]
    return out


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to those of ``c``."""
    top = (largest(x) + largest(c)) ** 2 * max(x.shape[1], 1) * 2
    kind = np.float64 if top < 1 << 53 else np.int64 if top < 1 << 63 else object
    a, b = x.astype(kind), c.astype(kind)
    out = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return out if kind is object else out.astype(np.int64)


def added(parts: list[np.ndarray]) -> np.ndarray:
    total = parts[0]
    for p in parts[1:]:
        if total.dtype != object and (p.dtype == object or largest(total) + largest(p) >= 1 << 63):
            total = total.astype(object)
        total = total + p
    return total


def by_cluster(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Sums of the rows of ``x`` by cluster."""
    if x.dtype != object and largest(x) * max(len(x), 1) < 1 << 53:
        return np.column_stack([np.bincount(cluster, x[:, j], minlength=k) for j in range(x.shape[1])]).astype(np.int64)
    out = np.zeros((k, x.shape[1]), object)
    np.add.at(out, cluster, x.astype(object))
    return out


def _cut(rows: int, width: int, scale: int):
    def run(batches):
        base = (TaskContext.get().partitionId()) << 32
        for batch in batches:
            for i in range(0, len(batch), rows):
                part = batch.slice(i, rows)
                flat = part.column(1).flatten()
                x = whole(flat.to_numpy(zero_copy_only=False).reshape(len(part), -1), scale)
                data = [None] + [pack(x[:, j : j + width]) for j in range(0, x.shape[1], width)]
                ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(0))
                ids = pa.concat_arrays([ids, pa.array([None] * (len(data) - 1), ids.type)])
                yield pa.RecordBatch.from_arrays([pa.array([base] * len(data)), pa.array(range(-1, len(data) - 1), pa.int32()), ids, pa.array(data, pa.binary())], ["chunk", "block", "ids", "data"])
                base += 1

    return run


def _first(width: int, scale: int):
    """Slices of the first centroids, numbered as they come, from one task of ``k`` rows."""

    def run(batches):
        number = 0
        for batch in batches:
            for v in batch.column(0).to_pylist():
                x = whole(np.array([v], np.float64), scale)
                data = [pack(x[:, j : j + width]) for j in range(0, x.shape[1], width)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(data)), pa.int32()), pa.array([number] * len(data), pa.int32()), pa.array(data, pa.binary())], ["block", "number", "data"])
                number += 1

    return run


def _stacked(width_of):
    def run(batches):
        for batch in batches:
            blocks = batch.column(0).to_pylist()
            data = [pack(np.concatenate([unpack(r["data"], width_of(b)) for r in rows])) for b, rows in zip(blocks, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["block", "slice"])

    return run


def _partial(width_of):
    def run(batches):
        known: tuple = (None, None)
        for batch in batches:
            out = []
            for b, data, packed in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if known[0] != (b, packed):
                    known = ((b, packed), unpack(packed, width_of(b)))
                out.append(pack(squared(unpack(data, width_of(b)), known[1])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["chunk", "partial"])

    return run


def _nearest(k: int):
    def run(batches):
        for batch in batches:
            near, gap = [], []
            for parts in batch.column(1).to_pylist():
                total = added([unpack(p, k) for p in parts])
                at = np.argmin(total, axis=1)
                near.append(pack(at))
                gap.append(pack(total[np.arange(len(at)), at]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.binary()), pa.array(gap, pa.binary())], ["chunk", "near", "gap"])

    return run


def _sums(k: int, width_of):
    """Sums and counts by (block, cluster) of a task's chunks, handed on before they take more than ``HELD`` numbers."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}

        def close():
            rows = [(b, c, int(counts[b][c]), pack(sums[b][c])) for b in sums for c in np.flatnonzero(counts[b]).tolist()]
            sums.clear()
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["block", "number", "n", "data"])

        for batch in batches:
            for b, data, near in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                cluster = unpack(near, 1)[:, 0]
                new = by_cluster(unpack(data, width_of(b)), cluster, k).astype(object)
                sums[b] = sums[b] + new if b in sums else new
                counts[b] = counts.get(b, 0) + np.bincount(cluster, minlength=k)
                if len(sums) * k * width_of(b) > HELD:
                    yield close()
        if sums:
            yield close()

    return run


def _moved(width_of):
    """The new slice of a cluster, floor(sum / count), or its old one where it is empty."""

    def run(batches):
        for batch in batches:
            out = []
            for b, old, parts in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if parts:
                    n = sum(p["n"] for p in parts)
                    total = added([unpack(p["data"], width_of(b)) for p in parts])
                    old = pack(np.array([int(x) // n for x in total[0]], object))
                out.append(old)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["block", "number", "data"])

    return run


def _rows(batches):
    for batch in batches:
        near = np.concatenate([unpack(x, 1)[:, 0] for x in batch.column(1).to_pylist()] or [np.zeros(0, np.int64)])
        gap = [x if x < 1 << 63 else None for data in batch.column(2).to_pylist() for x in unpack(data, 1)[:, 0].tolist()]
        yield pa.RecordBatch.from_arrays([batch.column(0).flatten(), pa.array(near, pa.int32()), pa.array(gap, pa.int64())], ["vec_id", "cluster", "distance"])


class Clusters:
    """What :func:`lloyd` leaves: ``assigned`` (chunk, near, gap), ``members`` (chunk, ids) and ``centroids`` (block, number, data)."""

    def __init__(self, assigned: DataFrame, members: DataFrame, centroids: DataFrame, dims: int, width: int):
        self.assigned, self.members, self.centroids, self.dims, self.width = assigned, members, centroids, dims, width

    def rows(self) -> DataFrame:
        """(vec_id, cluster, distance); a distance that a long can't hold is null."""
        kind = self.members.schema["ids"].dataType.elementType.simpleString()
        both = self.members.join(self.assigned, "chunk").select("ids", "near", "gap")
        return both.mapInArrow(_rows, f"vec_id {kind}, cluster int, distance long")

    def vectors(self) -> DataFrame:
        """(cluster, components): each centroid as decimal text joined by commas, by its blocks' order."""
        dims, width = self.dims, self.width

        def run(batches):
            for batch in batches:
                text = [",".join(str(v) for r in parts for v in unpack(r["data"], min(width, dims - r["block"] * width))[0].tolist()) for parts in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["cluster", "components"])

        grouped = self.centroids.groupBy(F.col("number").alias("cluster")).agg(F.sort_array(F.collect_list(F.struct("block", "data"))).alias("parts"))
        return grouped.mapInArrow(run, "cluster int, components string")


def lloyd(df: DataFrame, k: int, rounds: int, dims: int, scale: int = 64, seed: str = "1:", id_col: str = "vec_id", vec_col: str = "embedding", width: int = WIDTH) -> Clusters:
    """Clusters of the vectors with exactly ``dims`` components, none null or non-finite, as floor(``scale`` * x).

    The first centroids are the ``k`` vectors of smallest sha256 of ``seed`` and id (null ids last, equal ids by their
    components), all vectors where there are fewer. ``rounds`` rounds assign each vector to the nearest centroid, ties to
    the smaller number, and move each centroid that has vectors to the floor of their mean; then all are assigned again.
    Sums and distances are exact for every finite component.

    Defined cases: vectors null, of other length, or with null or non-finite components take no part; repeated rows count
    each; rows with a null id take part; other columns are ignored, whatever their names; an empty table has no clusters.
    """
    need(df, id_col, vec_col)
    spark = df.sparkSession
    v = F.col(f"`{vec_col}`")
    good = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = df.select(F.col(f"`{id_col}`").alias("id"), F.when(v.isNotNull() & good, v.cast("array<double>")).alias("v")).filter("v is not null")

    blocks = -(-dims // width)
    rows = max(1, min(ROWS, SUM_BYTES // (8 * k * blocks)))
    key = kept.schema["id"].dataType.simpleString()
    path = scratch_path(spark, "slices")
    kept.mapInArrow(_cut(rows, width, scale), f"chunk long, block int, ids array<{key}>, data binary").write.partitionBy("block").parquet(path)
    cut = spark.read.schema(f"chunk long, ids array<{key}>, data binary, block int").parquet(path)
    members = cut.filter("block = -1").select("chunk", "ids")
    lanes = -(-members.count() // LANE_CHUNKS) or 1
    parts = cut.filter("block >= 0").select("chunk", "block", "data", F.pmod(F.xxhash64("chunk"), F.lit(lanes)).alias("lane"))

    def width_of(block: int) -> int:
        return min(width, dims - block * width)

    start = kept.select(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k)
    centroids = written(start.select("v").mapInArrow(_first(width, scale), "block int, number int, data binary"), "centroids")
    k = centroids.filter("block = 0").count()

    def assign() -> DataFrame:
        slices = centroids.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("number", "data"))).alias("rows"))
        slices = written(slices.mapInArrow(_stacked(width_of), "block int, slice binary"), "stacked")
        slices = slices.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
        met = parts.join(slices, ["block", "lane"]).select("chunk", "block", "data", "slice")
        partial = met.mapInArrow(_partial(width_of), "chunk long, partial binary")
        summed = partial.groupBy("chunk").agg(F.collect_list("partial").alias("parts"))
        return written(summed.mapInArrow(_nearest(k), "chunk long, near binary, gap binary"), "assigned")

    assigned = assign()
    for _ in range(rounds):
        own = parts.join(assigned.select("chunk", "near"), "chunk").select("block", "data", "near")
        sums = own.mapInArrow(_sums(k, width_of), "block int, number int, n long, data binary")
        sums = sums.groupBy("block", "number").agg(F.collect_list(F.struct("n", "data")).alias("parts"))
        moved = centroids.join(sums, ["block", "number"], "left").select("block", "number", "data", "parts")
        centroids = written(moved.mapInArrow(_moved(width_of), "block int, number int, data binary"), "centroids")
        assigned = assign()
    return Clusters(assigned, members, centroids, dims, width)


def clustered(df: DataFrame, k: int, rounds: int, dims: int, **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of :func:`lloyd`; a sum with a part that a
    long can't hold is null, as is one that a long can't hold itself."""
    found = lloyd(df, k, rounds, dims, **options)
    rows = written(found.rows(), "clustered")
    of = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count_if(F.col("distance").isNull()).alias("lost"))
    whole_sum = of.agg(F.sum("total").alias("total"), F.sum("lost").alias("lost")).first()
    top = (1 << 63) - 1
    inertia = int(whole_sum.total) if whole_sum.lost == 0 and whole_sum.total <= top else None

    def digest(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in batch.column(1).to_pylist()], pa.string())], ["cluster", "centroid_sha256"])

    marks = found.vectors().mapInArrow(digest, "cluster int, centroid_sha256 string")
    sums = of.select("cluster", F.when(F.col("lost") == 0, F.expr("try_cast(total as bigint)")).alias("cluster_inertia"))
    totals = written(marks.join(sums, "cluster"), "totals")  # a row for each cluster
    return rows.join(totals, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(inertia).cast("long").alias("inertia"), "centroid_sha256")


def op12_lloyd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64)


def _sql(k: int, rounds: int, dims: int) -> str:
    steps = [
        f"""with e as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
            where embedding is not null and len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        c0 as (select row_number() over (order by sha256('1:' || vec_id), v) - 1 as c, v from e qualify c < {k})"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""d{r} as (select vec_id, e.v, c, list_sum(list_transform(list_zip(e.v, c{r}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from e cross join c{r}),
        a{r} as (select vec_id, v, c, d from d{r} qualify row_number() over (partition by vec_id order by d, c) = 1)""")
        if r < rounds:
            steps.append(f"""u{r} as (select c, i, sum(x)::bigint as s, count(*) as n from (select c, unnest(v) as x, unnest(range({dims})) as i from a{r}) group by c, i),
        c{r + 1} as (select c{r}.c, coalesce(m.v, c{r}.v) as v from c{r} left join
            (select c, list((s - ((s % n) + n) % n) // n order by i) as v from u{r} group by c) m on m.c = c{r}.c)""")
    return (
        ",\n".join(steps)
        + f"""
    select vec_id, a.c::int as cluster, d as distance, (sum(d) over (partition by a.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
           sha256(array_to_string(f.v, ',')) as centroid_sha256
    from a{rounds} a join c{rounds} f on f.c = a.c"""
    )


OP12_SQL = _sql(16, 3, 64)
