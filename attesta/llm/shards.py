"""Sharding by extendible hashing: a directory over prefixes of a key's hash, split only where a bucket is too large."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import need, numbered_rows, table, written

#: Bits of the key's hash, then bits of a hash of the row's place, which part rows of one key.
KEY_BITS, ROW_BITS = 60, 40
#: Bits looked at in one round beyond what equal buckets would need, and the most in a round.
SPARE_BITS, ROUND_BITS = 3, 20
LIMIT = 16 << 20


def key_hash(column):
    """60 bits of the md5 of the key as text (null: the empty text), which any engine can compute."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _sized(docs: DataFrame, key: str, text_col: str, place=None) -> DataFrame:
    """(key, h, r, size) and, if given, place: the row's number, which also parts rows of one key."""
    size = F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)).cast("long")
    row = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id() if place is None else place), 64 - ROW_BITS)
    kept = [] if place is None else [place.alias("place")]
    return docs.select(F.col(f"`{key}`").alias("key"), key_hash(f"`{key}`").alias("h"), row.alias("r"), size.alias("size"), *kept)


def _prefix(bits: int):
    """The first ``bits`` of the key's hash and then the row's, as a text of 0 and 1."""
    key = F.lpad(F.bin("h"), KEY_BITS, "0")
    if bits <= KEY_BITS:
        return F.substring(key, 1, bits)
    return F.concat(key, F.substring(F.lpad(F.bin("r"), ROW_BITS, "0"), 1, bits - KEY_BITS))


def deal(sized: DataFrame, limit: int, shards: int = 1) -> DataFrame:
    """``sized`` with the bucket of each row: shard (its prefix), depth, shard_rows, shard_bytes, fits.

    In a round, sizes are summed by the next bits of all rows in buckets that are still too large (a cell each), rolled
    up to every shorter prefix, and a bucket is closed at the shortest prefix that fits or holds one row. Each row then
    meets its own cell once. Sums are partial before the shuffle, so a hot key is one row for each task. A bucket that is
    too large after all 100 bits is kept whole with fits = false.
    """
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    limit = max(1, min(limit, total // shards))
    start = max(1, min(ROUND_BITS, ceil(log2(total / limit)) + SPARE_BITS)) if total > limit else 1
    all_bits = KEY_BITS + ROW_BITS
    open_, depth, parts = sized, 0, []
    while True:
        deep = depth + min(ROUND_BITS // 2 if depth else start, all_bits - depth, KEY_BITS - depth if depth < KEY_BITS else all_bits)
        keyed = open_.withColumn("cell", _prefix(deep))
        cells = written(keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")), "cells")
        each = cells.select("*", F.explode(F.sequence(F.lit(depth), F.lit(deep))).alias("depth")).withColumn("prefix", F.expr("substring(cell, 1, depth)"))
        rolled = each.groupBy("prefix", "depth").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
        rolled = rolled.withColumn("fits", F.col("bytes") <= limit).withColumn("closed", F.col("fits") | (F.col("rows") == 1) | (F.col("depth") == all_bits))
        # a bucket is there if the one above it had to be split
        above = rolled.filter("not closed").select(F.col("prefix").alias("up"), (F.col("depth") + 1).alias("depth"))
        below = rolled.filter("depth > 0").withColumn("up", F.expr("substring(prefix, 1, depth - 1)")).join(above, ["up", "depth"], "left_semi").drop("up")
        buckets = written(rolled.filter("depth = 0").unionByName(below), "buckets")
        of_cell = each.select("cell", "prefix", "depth").join(buckets.filter("closed").drop("closed"), ["prefix", "depth"])
        parts.append(keyed.join(written(of_cell, "directory"), "cell").drop("cell"))
        over = buckets.filter(f"not closed and depth = {deep}").select(F.col("prefix").alias("cell"))
        if over.isEmpty():
            break
        open_, depth = keyed.join(over, "cell", "left_semi").drop("cell"), deep
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*sized.columns, F.col("prefix").alias("shard"), "depth", F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), "fits")


_SHARD = ["shard", "depth", "shard_rows", "shard_bytes", "fits"]


def assign_shards(docs: DataFrame, key: str = "doc_id", text_col: str = "text", limit: int = LIMIT, shards: int = 1) -> DataFrame:
    """(key, shard, depth, shard_rows, shard_bytes, fits) for each row; the shard is named by its prefix of hash bits.
    ``limit``: bytes of text of a shard; it is lowered until there are room and work for about ``shards``.

    Defined cases: null texts have no bytes, null keys hash as the empty text; rows of one key stay together
    until the key alone is too large, and are then parted by a hash of their place; a bucket of one row isn't split, and
    above the limit has fits = false; very long texts count whole; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    need(docs, key, text_col)
    return deal(written(_sized(docs, key, text_col), "sized"), limit, shards).select(F.col("key").alias(key), *_SHARD)


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text_col: str = "text", limit: int = LIMIT, shards: int = 1) -> DataFrame:
    """Writes each row of ``docs`` once, with a folder ``shard=b<prefix>`` for each shard; returns the assignment.

    Rows meet their shards by their place, which is written once, so null and repeated keys are rows as any other. A
    column named shard is not written: the folder's name takes its place.
    """
    need(docs, key, text_col)
    rows = numbered_rows(docs)
    flat = rows.select("row", F.col(f"doc.`{key}`").alias("key"), F.col(f"doc.`{text_col}`").alias("text"))
    of = written(deal(written(_sized(flat, "key", "text", F.col("row")), "sized"), limit, shards).select("place", "key", *_SHARD), "assigned")
    named = of.select(F.col("place").alias("row"), F.concat(F.lit("b"), "shard").alias("shard"))
    kept = [F.col(f"doc.`{c}`") for c in docs.columns if c.lower() != "shard"]
    rows.join(named, "row").select(*kept, "shard").write.partitionBy("shard").parquet(path)
    return of.select(F.col("key").alias(key), *_SHARD)


#: Shards that a query has at least, as far as single documents allow: a small corpus is to feed many tasks too.
SHARDS = 64


def op1_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), shards=SHARDS)


def op1_sql(limit: int = LIMIT, shards: int = SHARDS) -> str:
    """DuckDB: the shortest prefix of the 60 bits whose bucket is within the limit or holds one row."""
    return f"""
with h as (select doc_id, strlen(coalesce(text, '')) as size,
                  lpad(bin(('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint), {KEY_BITS}, '0') as bits from documents),
m as (select greatest(1, least({limit}, sum(size) // {shards})) as most from h),
d as (select unnest(range(0, {KEY_BITS} + 1)) as depth),
b as (select depth, substr(bits, 1, depth) as prefix, count(*) as n, sum(size) as bytes from h, d group by 1, 2),
c as (select b.*, bytes <= most as fits, bytes <= most or n = 1 as closed from b, m),
leaf as (select * from c where closed and (depth = 0 or exists (
           select 1 from c u where u.depth = c.depth - 1 and u.prefix = substr(c.prefix, 1, c.depth - 1) and not u.closed)))
select h.doc_id, leaf.prefix as shard, leaf.depth::int as depth, leaf.n::bigint as shard_rows, leaf.bytes::bigint as shard_bytes, leaf.fits
from h join leaf on leaf.prefix = substr(h.bits, 1, leaf.depth)
"""


OP1_SQL = op1_sql()
