"""Near copies by the exact Jaccard similarity of five-word shingles, among the groups of their SimHash fingerprints.

The generalised pigeonhole search of ``simhash`` links fingerprints of the shingle sets at ``RADIUS`` bits or less; texts
whose fingerprints hang together are candidates. Pairs at 0.8 can lie further apart than any radius that it can search,
so texts that share a band of minima are candidates too: a pair at 0.8 misses all bands with a chance of 7e-5. Each group
and band compares its texts by their whole shingle sets and gives only links at 0.8 or more, so a link is never a guess.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import simhash
from attesta.llm.common import MIX, STEP, finish, lean, marked, need, numbered_rows, of_marked, texts_of, written
from attesta.llm.components import components

SEED = 42
SHINGLE = 5
#: Bits by which linked fingerprints differ at most; 64 keys of each then do for 12 million texts, 11 bits take 480.
RADIUS = 7
BANDS, ROWS = 24, 5
#: Texts and bytes of shingle sets that are compared in one go; larger keys are cut into pairs of blocks.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
MIN_ROWS = 1 << 12

_draws = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64, endpoint=False)
TIMES, PLUS = _draws[0] | np.uint64(1), _draws[1]


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 values of the word shingles; a shorter text is one shingle, none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    parts = zip(*(words[i:] for i in range(shingle)), strict=False)
    values = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, parts), repeat(SEED)), np.uint64, len(words) - shingle + 1)
    return np.unique(values)


def bands(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of minima of a set that is not empty."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(values), MIN_ROWS):
        low = np.minimum(low, finish(values[i : i + MIN_ROWS, None] * TIMES + PLUS).min(axis=0))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for column in low.reshape(BANDS, ROWS).T:
        keys = finish((keys ^ column) * STEP)
    return keys.view(np.int64)


def near(common, size, other):
    """Whether two sets have a Jaccard similarity of 0.8 or more, in integers."""
    return 9 * common >= 4 * (size + other)


def local_links(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that span the groups which the sets (none empty) form."""
    if len(nodes) == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        return [(nodes[0], nodes[1])] if near(common, len(sets[0]), len(sets[1])) else []
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    starts = ends - size
    place = np.unique(np.concatenate(sets), return_inverse=True)[1]
    marked = np.zeros(int(place.max(initial=-1)) + 1, bool)
    out, open_ = [], np.ones(len(nodes), bool)
    for start in range(len(nodes)):
        if not open_[start]:
            continue
        open_[start] = False
        front = [start]
        while front and open_.any():
            at = front.pop()
            own = place[starts[at] : ends[at]]
            marked[own] = True
            common = np.add.reduceat(marked[place], starts, dtype=np.int64)
            marked[own] = False
            hit = np.flatnonzero(open_ & near(common, size, size[at]))
            open_[hit] = False
            front += hit.tolist()
            out += [(nodes[at], nodes[i]) for i in hit]
    return out


def _signatures(shingle: int):
    def run(batches):
        for batch in batches:
            hashes, sizes, prints, keys = [], [], [], []
            for text in texts_of(batch.column(2)):
                values = shingles(text, shingle)
                hashes.append(xxhash.xxh128_digest(values.astype("<u8").tobytes()))
                sizes.append(len(values))
                prints.append(simhash.majority(values))
                keys.append(bands(values) if len(values) else [])
            cols = [pa.array(hashes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["row", "id", "hash", "size", "fp", "keys"])

    return run


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            found = [shingles(t, shingle).astype("<u8").tobytes() for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "set"])

    return run


def _compare(batches):
    """Over rows sorted by (key, p, q): links among the texts of each."""
    at, nodes, sets = None, [], []

    def emit(found):
        a, b = np.array(found, np.int64).reshape(-1, 2).T.copy()
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        heads = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
        found = []
        for head, node, data in zip(heads, batch.column(3).to_pylist(), batch.column(4), strict=True):
            if head != at:
                found += local_links(nodes, sets) if len(nodes) > 1 else []
                at, nodes, sets = head, [], []
            nodes.append(node)
            sets.append(np.frombuffer(data.as_py(), "<u8"))
        yield emit(found)
    yield emit(local_links(nodes, sets) if len(nodes) > 1 else [])


def alike(signed: DataFrame, bits: int = RADIUS) -> DataFrame:
    """(node, size, key) of the rows of ``signed`` with words: a key for each group of fingerprints linked at ``bits`` or less."""
    of = signed.filter("size > 0").select(F.col("row").alias("node"), "size", "fp")
    prints = written(of.select("fp").distinct(), "prints")
    groups = written(components(simhash.links(prints, bits)), "alike").toDF("fp", "root")
    return of.join(groups, "fp", "left").select("node", "size", F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("key"))


def links(rows: DataFrame, signed: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(a, b): links at 0.8 or more among the rows of ``signed``, whose texts are in ``rows`` (row, text)."""
    keyed = written(alike(signed), "candidates").union(signed.select(F.col("row").alias("node"), "size", F.explode("keys").alias("key")))
    mark = F.xxhash64("node")
    keys = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(mark, 24)).alias("s"))
    # near copies share their group and many bands: of keys with the same texts one is enough. Two keys of different texts are taken for
    # one another where count, total, xor and sum of 64-bit hashes all agree, a chance of about 2^-100 for a pair of keys
    keys = written(keys.filter("n > 1").groupBy("n", "total", "x", "s").agg(F.min("key").alias("key")), "keys")
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") * 8 / BLOCK_BYTES), F.lit(1)).cast("int")
    members = written(keyed.join(keys.select("key", parts.alias("parts")), "key").select("key", "parts", "node"), "members")
    texts = of_marked(rows.select("row", "text"), marked(members.select(F.col("node").alias("row"))))
    sets = written(texts.mapInArrow(lean(_sets(shingle)), "node long, set binary"), "sets")
    block = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pairs = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.filter("parts = 1 or other <> block").select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "node")
    pairs = pairs.join(sets, "node").select("key", "p", "q", "node", "set")
    dealt = pairs.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return dealt.mapInArrow(lean(_compare), "a long, b long")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for each group of near copies: the one of smallest id, nulls last, then of its place.

    Groups are the components of pairs with a Jaccard similarity of 0.8 or more. Words are those of the text in
    lower case (ASCII). Defined cases: null and empty texts and those of blanks are copies of one another; repeated
    and null ids don't matter to the groups; very long texts are compared whole; other columns pass through, whatever
    their names; an empty table gives no rows.

    Texts of the same shingles are one node. A group or band with more than ``BLOCK`` nodes or ``BLOCK_BYTES`` of shingles is
    compared in pairs of blocks, a task each: n nodes that share a band take about n^2 / 2 comparisons in all.
    """
    need(docs, id_col, text_col)
    rows = numbered_rows(docs)
    named = rows.select("row", F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{text_col}`").alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    signed = written(named.mapInArrow(lean(_signatures(shingle)), f"row long, id {kind}, hash binary, size long, fp long, keys array<long>"), "signatures")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    nodes = written(signed.groupBy("hash").agg(F.min(rank).alias("first")).select("first.*"), "nodes")
    found = written(components(links(named, of_marked(signed, marked(nodes)), shingle)), "groups")
    of = nodes.join(found.select(F.col("node").alias("row"), "root"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    firsts = written(of.groupBy("root").agg(F.min(rank).alias("first")).select("first.row"), "firsts")
    return of_marked(rows, marked(firsts)).select("doc.*")
