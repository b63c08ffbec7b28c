"""SimHash near-duplicate groups with a generalised pigeonhole search over 64-bit fingerprints.

Correlated bits go to the same partition. A pair at distance tau or less lies, in at least one partition i,
within T_i, whenever the sum of T_i + 1 over the partitions is tau + 1; a dynamic program over the estimated
number of candidates chooses the T_i, which may be unequal. A partition with threshold T is probed by keys
that blank out T of its bits: two values within T bits share one of these keys.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import need, numbered_rows, table, texts_of, written
from attesta.llm.components import components

SEED = 42
SHINGLE = 3
BITS = 3
#: Members of a key that are compared in one go; larger keys are cut into pairs of blocks.
BLOCK = 2048
#: Fingerprints from which the layout of the search is chosen; any layout gives the same links.
LAYOUT_SAMPLE = 2048
COUNT_ROWS = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 majority bits of the XXH64 values of all word shingles; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        values = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        parts = zip(*(words[i:] for i in range(shingle)), strict=False)
        n = len(words) - shingle + 1
        values = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, parts), repeat(SEED)), np.uint64, n)
    return majority(values)


def majority(values: np.ndarray) -> int:
    """The bits set in more than half of the 64-bit values; 0 without any."""
    counts = np.zeros(64, np.int64)
    octets = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(octets), COUNT_ROWS):
        counts += np.unpackbits(octets[i : i + COUNT_ROWS], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(values)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long) per row; a null text has no words, so its fingerprint is 0. Other columns are ignored."""
    need(docs, id_col, text_col)
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(x, shingle) for x in texts_of(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["id", "fp"])

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, fp long")


def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in ``m`` groups of near-equal size; each group grows by the bit most correlated with it."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    spread = bits - bits.mean(axis=0)
    norm = np.sqrt((spread**2).sum(axis=0)) + 1e-9
    tie = np.abs(spread.T @ spread) / np.outer(norm, norm)
    np.fill_diagonal(tie, 0)
    left, groups = set(range(64)), []
    for i in range(m):
        want = len(left) // (m - i)
        rest = sorted(left)
        group = [rest[int(np.argmax(tie[np.ix_(rest, rest)].sum(axis=1)))]]
        left.discard(group[0])
        while len(group) < want:
            rest = sorted(left)
            group.append(rest[int(np.argmax(tie[np.ix_(rest, group)].sum(axis=1)))])
            left.discard(group[-1])
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds T_i (-1: not probed) with the sum of T_i + 1 equal to ``total`` at the least cost.

    costs[i][s] is what partition i costs with T_i = s - 1.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for s, c in enumerate(row[: total - spent + 1]):
                if spent + s not in after or cost + c < after[spent + s][0]:
                    after[spent + s] = (cost + c, [*chosen, s - 1])
        best = after
    return best[total]


#: Seconds per key written and per pair compared, as measured; they weigh the layouts and change no result.
KEY_COST, PAIR_COST = 2e-6, 2e-8


def layout(sample: np.ndarray, rows: int, bits: int = BITS) -> list[int]:
    """Masks of the probe keys: fp & mask is a key. Chosen among 1 to bits + 1 partitions."""
    pairs = np.triu_indices(len(sample), 1)
    apart = sample[pairs[0]] ^ sample[pairs[1]]
    chosen = (float("inf"), [], [])
    for m in range(1, bits + 2):
        groups = group_bits(sample, m) if len(sample) > 1 else [list(range(i, 64, m)) for i in range(m)]
        costs = []
        for group in groups:
            mask = np.uint64(sum(1 << b for b in group))
            near = np.bincount(np.bitwise_count(apart & mask), minlength=65)[: bits + 1] if len(apart) else np.zeros(bits + 1)
            row = [0.0]
            for t in range(bits + 1):
                if t >= len(group):
                    row.append(float("inf"))
                    continue
                chance = max(near[: t + 1].sum() / max(len(apart), 1), sum(comb(len(group), k) for k in range(t + 1)) / 2.0 ** len(group))
                row.append(rows * comb(len(group), t) * KEY_COST + rows * rows / 2 * chance * PAIR_COST)
            costs.append(row)
        cost, thresholds = allocate(costs, bits + 1)
        if cost < chosen[0]:
            chosen = (cost, groups, thresholds)
    masks = []
    for group, t in zip(chosen[1], chosen[2], strict=True):
        for blank in combinations(group, t) if t >= 0 else ():
            masks.append(sum(1 << b for b in group if b not in blank))
    return masks


def local_groups(values: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Links (smallest member, member) that span the groups which ``values`` (distinct) form at ``bits`` or less."""
    n = len(values)
    if n == 2:
        near = int(np.bitwise_count(values[0] ^ values[1])) <= bits
        return [(int(values.min()), int(values.max()))] if near else []
    out, open_ = [], np.ones(n, bool)
    order = np.argsort(values)
    for start in order:
        if not open_[start]:
            continue
        open_[start] = False
        front, root = [start], int(values[start])
        while front:
            rest = np.flatnonzero(open_)
            if not len(rest):
                break
            hit = np.zeros(len(rest), bool)
            for i in range(0, len(front), 256):
                hit |= (np.bitwise_count(values[front[i : i + 256], None] ^ values[None, rest]) <= bits).any(axis=0)
            front = rest[hit].tolist()
            open_[front] = False
            out += [(root, int(values[j])) for j in front]
    return out


LINK_SCHEMA = "part int, key long, a long, b long, block int"


def _link(bits: int, block: int):
    """Over rows sorted by (part, key, fp): links of each key with block = -1; keys above ``block`` pass through, numbered."""

    def emit(rows):
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "key", "a", "b", "block"])

    def signed(x):
        return x - (1 << 64) if x >= 1 << 63 else x

    def run(batches):
        held: list[np.ndarray] = []  # of the key still open
        at, size, passed = None, 0, 0

        def close():
            if at is None or size < 2:
                return []
            values = np.concatenate(held).view(np.uint64)
            if passed:
                return [(*at, int(v), 0, passed + i // block) for i, v in enumerate(values.view(np.int64))] if len(values) else []
            return [(*at, *map(signed, x), -1) for x in local_groups(values, bits)]

        for batch in batches:
            part, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(fp):
                continue
            cut = np.flatnonzero((np.diff(part) != 0) | (np.diff(key) != 0)) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(fp)]))
            same = at == (int(part[0]), int(key[0]))
            rows = []
            # keys that lie wholly inside this batch and have two or more members
            inner = np.ones(len(starts), bool)
            inner[-1] = False
            if same:
                inner[0] = False
            for i in np.flatnonzero(~inner | (ends - starts > 1)):
                s, e = starts[i], ends[i]
                if inner[i] and e - s <= block:
                    rows += [(int(part[s]), int(key[s]), *map(signed, x), -1) for x in local_groups(fp[s:e].view(np.uint64), bits)]
                    continue
                if not (i == 0 and same):
                    rows += close()
                    held, size, passed, at = [], 0, 0, (int(part[s]), int(key[s]))
                held.append(fp[s:e])
                size += e - s
                while sum(map(len, held)) > block:  # too many for one go: hand them on in numbered blocks
                    values = np.concatenate(held)
                    rows += [(*at, int(v), 0, passed) for v in values[:block]]
                    held, passed = [values[block:]], passed + 1
                if inner[i]:
                    rows += close()
                    held, size, passed, at = [], 0, 0, None
            if rows:
                yield emit(rows)
        if rows := close():
            yield emit(rows)

    return run


def _link_blocks(bits: int):
    """Over rows sorted by (part, key, p, q): links among the members of a pair of blocks."""

    def run(batches):
        held, at = [], None

        def close():
            return local_groups(np.unique(np.concatenate(held)).view(np.uint64), bits) if held else []

        def emit(found):
            a, b = np.array(found, np.uint64).reshape(-1, 2).T.view(np.int64).copy()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            ids = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], 1)
            fp = batch.column(4).to_numpy(zero_copy_only=False)
            if not len(fp):
                continue
            cut = np.flatnonzero((np.diff(ids, axis=0) != 0).any(axis=1)) + 1
            for s, e in zip([0, *cut], [*cut, len(fp)], strict=True):
                if at != tuple(ids[s]):
                    if found := close():
                        yield emit(found)
                    held, at = [], tuple(ids[s])
                held.append(fp[s:e])
        if found := close():
            yield emit(found)

    return run


def links(prints: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links whose components are those of all pairs of the distinct ``fp`` values at ``bits`` or less.

    Inside a key only spanning links are given, never all pairs. A key with more than ``block`` members is cut
    into blocks, and each pair of blocks is a task of its own, so nothing is dropped and no task is unbounded.
    """
    rows = prints.count()
    sample = np.array([r.fp for r in prints.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(LAYOUT_SAMPLE).collect()], np.int64).view(np.uint64)
    masks = [int(np.array(m, np.uint64).view(np.int64)) for m in layout(sample, max(rows, 1), bits)]  # without rows any number of keys is free
    keyed = prints.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("part", "mask"))
    keyed = keyed.select("part", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    dealt = keyed.repartition("part", "key").sortWithinPartitions("part", "key", "fp")
    found = written(dealt.mapInArrow(_link(bits, block), LINK_SCHEMA), "keys")
    out = found.filter("block = -1").select("a", "b")
    heavy = found.filter("block >= 0")
    if not heavy.isEmpty():
        blocks = heavy.groupBy("part", "key").agg(F.max("block").alias("last"))
        pairs = heavy.join(blocks, ["part", "key"]).select("part", "key", F.col("a").alias("fp"), "block", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
        pairs = pairs.select("part", "key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "fp")
        pairs = pairs.repartition("part", "key", "p", "q").sortWithinPartitions("part", "key", "p", "q")
        out = out.union(pairs.mapInArrow(_link_blocks(bits), "a long, b long"))
    return out


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, component_id) per row: component_id is the smallest id reachable over links of ``bits`` or less.

    Defined cases: null and empty texts have fingerprint 0 and link as any other; repeated rows are repeated in
    the result; rows with a null id keep it and never name a component (null if all its ids are); an empty
    table gives no rows; other columns are ignored, whatever their names; very long texts are read whole. Copies share
    a fingerprint and are one node, so a group of copies costs one row. Of n different fingerprints that share a key
    all pairs are compared, in blocks of ``BLOCK`` and a task for each pair of blocks: n^2 / 2 comparisons and n / BLOCK
    copies of each are the bound, and nothing is left out to lower it.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    found = written(components(links(nodes.select("fp"), bits)), "groups")
    named = nodes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = written(named, "named")
    roots = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(roots, "root").select("fp", "component_id")
    return prints.join(written(of, "component"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row of ``docs`` for each group: the one of smallest id, nulls last, then of its place.

    Groups are of rows, so repeated and null ids neither lose a text of its own nor keep a copy.
    """
    need(docs, id_col, text_col)
    rows = numbered_rows(docs)
    flat = rows.select("row", F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{text_col}`").alias("text"))
    groups = near_groups(flat, "row", "text", bits).select("row", "component_id")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    kept = flat.select("row", "id").join(groups, "row").groupBy("component_id").agg(first).select("first.row")
    return rows.join(kept, "row", "left_semi").select("doc.*")


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
