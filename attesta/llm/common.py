"""Helpers shared by the corpus operators: shared scratch tables, column checks, Arrow text access."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.sources.scratch import drop_scratch, scratch_dir, scratch_path, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of whole texts, or of sets as large as these, that a Python worker takes at a time.
BATCH_ROWS = 1024
#: Bytes that pass through a task before it gives free memory back.
RELEASE_BYTES = 64 << 20
#: What workers keep from task to task, by the name of its module.
KEPT: dict[str, dict] = {}


def release() -> None:
    """Gives what Python, Arrow and the C library hold free back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run, *keeps: str):
    """``run`` for ``mapInArrow``, in batches of at most ``BATCH_ROWS`` rows.

    A worker waits for its next task with all the memory that it has taken, and the JVM beside it needs room. So free
    memory goes back to the system on the way and at the end, and what other operators than ``keeps`` left is dropped.
    """

    def task(batches):
        for name, cache in KEPT.items():
            if name not in keeps:
                cache.clear()

        def pieces():
            passed = 0
            for batch in batches:
                for i in range(0, batch.num_rows, BATCH_ROWS):
                    yield batch.slice(i, BATCH_ROWS)
                passed += batch.nbytes
                if passed > RELEASE_BYTES:
                    passed = 0
                    release()

        try:
            yield from run(pieces())
        finally:
            release()

    return task


#: Bytes of a row group that a writer of scratch tables holds.
GROUP_BYTES = 32 << 20


def written(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Cuts lineage: writes ``df`` as a table in the shared folder and reads it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.option("parquet.block.size", GROUP_BYTES)
    writer = writer if compression is None else writer.option("compression", compression)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def as_struct(df: DataFrame):
    """All columns as one struct, so that none of their names can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def numbered_rows(df: DataFrame) -> DataFrame:
    """(row, doc) written once: a number for each row, which no later plan changes, and the row as a struct."""
    return written(df.select(F.monotonically_increasing_id().alias("row"), as_struct(df).alias("doc")), "rows")


#: Words of marks that are broadcast: about 50 MB of them, for 67 million rows.
MARK_WORDS = 1 << 20


def marked(rows: DataFrame) -> DataFrame:
    """(word, bits) of the numbers ``row``, written: a bit for each of 64 neighbouring numbers."""
    bit = F.expr("shiftleft(1L, cast(row & 63 as int))")
    return written(rows.groupBy(F.shiftright("row", 6).alias("word")).agg(F.bit_or(bit).alias("bits")), "marks")


def of_marked(df: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``df`` whose number ``row`` is marked. Up to ``MARK_WORDS`` words of marks go to every task, so that rows
    with whole texts stay where they are; more are joined."""
    few = marks.count() <= MARK_WORDS
    met = df.join(F.broadcast(marks) if few else marks, F.shiftright("row", 6) == F.col("word"))
    return met.filter("shiftright(bits, cast(row & 63 as int)) & 1L = 1L").select(df.columns)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add: its own take the place of any of that name."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def whole_text(column: str = "text"):
    """Null texts count as empty ones."""
    return F.coalesce(F.col(column), F.lit(""))


def texts_of(array: pa.Array) -> list[str]:
    return [x or "" for x in array.to_pylist()]


def chunks(sizes, limit: int):
    """Ranges (i, j) of consecutive items of at most ``limit`` in all; an item above the limit is alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


#: A hash below a share of 2^63 draws that share of the rows, however small it is.
WHOLE = 1 << 63


def drawn(share, *columns):
    """Whether a row belongs to a ``share`` (a number, or a column of numbers) of all, by a hash of its ``columns``."""
    place = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), *columns), 1)
    if isinstance(share, float):
        return F.lit(True) if share >= 1 else place < int(share * WHOLE)
    return (share >= 1) | (place.cast("double") < share * float(WHOLE))


def fair_parts(sizes: list[int], limit: int) -> list[float]:
    """How much of ``limit`` each of several groups may take: equal parts, and what small groups leave over to the others."""
    parts, left = [0.0] * len(sizes), float(limit)
    for k, i in enumerate(sorted(range(len(sizes)), key=lambda i: sizes[i])):
        parts[i] = min(float(sizes[i]), left / (len(sizes) - k))
        left -= parts[i]
    return parts


def bounded_sample(df: DataFrame, key: str, text: str, max_rows: int, max_bytes: int, label: str | None = None) -> DataFrame:
    """Rows drawn by a hash of ``key`` and ``text``: about ``max_rows`` rows and ``max_bytes`` of text, at most a quarter
    more rows. With ``label`` each of its values is drawn by itself, so that a rare one keeps its rows.

    A row of more than a sixteenth of ``max_bytes`` isn't drawn. Only counts by label reach the driver.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    fitting = df.filter(size <= max_bytes // 16)
    found = fitting.groupBy(*([label] if label else [])).agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_b")).collect()
    rows, octets = fair_parts([r["_n"] for r in found], max_rows), fair_parts([r["_b"] or 0 for r in found], max_bytes)
    shares = [min(a / max(r["_n"], 1), b / max(r["_b"] or 0, 1) if r["_b"] else 1.0, 1.0) for r, a, b in zip(found, rows, octets, strict=True)]
    if all(x >= 1 for x in shares):
        return fitting
    if label is None:
        picked = fitting.filter(drawn(shares[0], key, text))
    else:
        of = F.lit(0.0)
        for r, x in zip(found, shares, strict=True):
            of = F.when(F.col(label).eqNullSafe(F.lit(r[label])), F.lit(x)).otherwise(of)
        picked = fitting.filter(drawn(of, key, text))
    # equal rows are drawn together: a hot one must not pass the bound
    return picked.orderBy(F.xxhash64(F.lit("order"), key, text), key).limit(max_rows + max_rows // 4)


MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
LONG_SPAN = 512


def finish(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * STEP
    return h ^ (h >> np.uint64(29))


def padded(data: bytes, kind=np.uint8) -> np.ndarray:
    """The data as an array with eight further zero bytes, so that any position can be read as one 64-bit value."""
    return np.frombuffer(data + b"\0" * 8, kind)


def span_hash(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of a ``padded`` array of 8- or 16-bit units, eight bytes a step."""
    width = units.itemsize
    per = 8 // width
    words = np.ndarray((len(units) - per + 1,), "<u8", units, strides=(width,))
    length = ends - starts
    h = (length.astype(np.uint64) + np.uint64(1)) * MIX
    active, at, k = None, starts, 0
    left = length
    while True:
        if k * per >= LONG_SPAN or not len(left):
            break
        value = words[at]
        short = left < per
        if short.any():
            keep = np.where(short, left, per).astype(np.uint64) * np.uint64(8 * width)
            mask = np.where(short, (np.uint64(1) << np.minimum(keep, np.uint64(63))) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
            value = value & mask
        if active is None:
            h = (h ^ value) * STEP
            h ^= h >> np.uint64(31)
        else:
            part = (h[active] ^ value) * STEP
            h[active] = part ^ (part >> np.uint64(31))
        k += 1
        more = np.flatnonzero(left > per)
        if not len(more):
            break
        active = more if active is None else active[more]
        at = starts[active] + k * per
        left = length[active] - k * per
    else:
        pass
    if k * per >= LONG_SPAN and active is not None and len(active):
        import xxhash

        raw = units.view(np.uint8)
        for i in active:
            h[i] = np.uint64(xxhash.xxh64_intdigest(raw[starts[i] * width : ends[i] * width].tobytes(), 7))
    return finish(h)


def same_spans(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether spans of equal length of two ``padded`` arrays hold the same units, eight bytes a step."""
    width = a.itemsize
    per = 8 // width
    of_a, of_b = (np.ndarray((len(x) - per + 1,), "<u8", x, strides=(width,)) for x in (a, b))
    same, open_, k = np.ones(len(length), bool), np.flatnonzero(length > 0), 0
    while len(open_):
        if k * per >= LONG_SPAN:
            for i in open_:
                same[i] = bool((a[a_at[i] + k * per : a_at[i] + length[i]] == b[b_at[i] + k * per : b_at[i] + length[i]]).all())
            break
        left = length[open_] - k * per
        gap = of_a[a_at[open_] + k * per] ^ of_b[b_at[open_] + k * per]
        drop = (np.maximum(per - left, 0) * 8 * width).astype(np.uint64)
        off = (gap << drop) != 0
        same[open_[off]] = False
        k += 1
        open_ = open_[~off & (left > per)]
    return same


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
