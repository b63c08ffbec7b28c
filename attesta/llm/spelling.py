"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

One replaced letter changes the letter counts of a word by 2 in L1 distance, one inserted or deleted letter by 1. For each
pair of lengths (L, L) and (L, L + 1) a word is a range search of that radius; boxes too far away are pruned, and the
order of the letters of what is left is verified. The words of a length are dealt to shards by an upper k-d tree, and a
word is sent to the shards whose region its radius reaches, so that a task holds one shard and its searches.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import drawn, need, table, texts_of, written

LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: A worker hands on its counts at so many distinct words, or bytes of words longer than ``LONG``.
HELD_WORDS, HELD_BYTES, LONG = 200_000, 32 << 20, 64
#: Words of a shard, and bytes of their letters; a length above that is dealt by an upper tree.
SHARD, SHARD_BYTES = 8192, 16 << 20
#: Words, over all lengths, on whose letters the upper trees are grown; each of their leaves has so many of them at least.
SAMPLE, SAMPLE_LEAF = 1 << 16, 32
#: Words of a leaf of a shard's own tree, and searches that meet a node at a time.
LEAF, SEARCHES = 128, 4096
#: Letters: a to z, and the 64 code points from U+00C0.
LETTERS = 90


def _counts(least: int, typo: int | None):
    run_of = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)  # bytes.lower() leaves all but A to Z as they are

    def run(batches):
        held: Counter = Counter()
        size = 0

        def close():
            nonlocal held, size
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], ["word", "n"])
            held, size = Counter(), 0
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                found = Counter(run_of.findall(text.encode("latin-1", "replace").lower()))
                if typo:
                    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for w in list(found):
                        h = zlib.crc32(w.decode("latin-1").encode(), start)
                        if h % typo == 0:
                            n, i = found.pop(w), h % len(w)
                            if len(w) > least:
                                held[w[:i] + w[i + 1 :]] += n
                held.update(found)
                size += sum(len(w) for w in found if len(w) > LONG)
                if len(held) >= HELD_WORDS or size >= HELD_BYTES:
                    yield close()
        if held:
            yield close()

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, typo: int | None = None) -> DataFrame:
    """(word, n): occurrences of the words of ``least`` letters or more, runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z
    lower-cased. With ``typo`` a run loses a letter in a document where that number divides the crc32 of ``id:run``.
    """
    need(docs, id_col, text_col)
    kept = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("text is not null")
    return kept.mapInArrow(_counts(least, typo), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_counts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letter counts of each word, and the words' lengths."""
    length = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8).astype(np.int64)
    column = np.where(codes < 0xC0, codes - 97, codes - 0xC0 + 26)
    at = np.repeat(np.arange(len(words)), length) * LETTERS + column
    return np.bincount(at, minlength=len(words) * LETTERS).reshape(len(words), LETTERS).astype(np.int32), length


def widest(x: np.ndarray) -> tuple[int, int] | None:
    """The column of most variance and the bound that halves it best: (column, b) parts x <= b from x > b."""
    spread = x.var(axis=0)
    if not len(x) or spread.max() == 0:
        return None
    d = int(np.argmax(spread))
    values, n = np.unique(x[:, d], return_counts=True)
    under = np.cumsum(n)[:-1]
    return d, int(values[np.argmin(np.abs(2 * under - len(x)))])


class Router:
    """An upper k-d tree of one length: its leaves are the shards."""

    def __init__(self, x: np.ndarray, leaves: int):
        self.nodes: list[tuple] = []  # (column, bound, low, high) or (None, leaf)
        self.leaves = 0
        self._grow(x, leaves)

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        split = widest(x) if leaves > 1 and len(x) >= 2 * SAMPLE_LEAF else None
        if split is None:
            self.nodes[at] = (None, self.leaves)
            self.leaves += 1
        else:
            under = x[:, split[0]] <= split[1]
            self.nodes[at] = (*split, self._grow(x[under], leaves // 2), self._grow(x[~under], leaves - leaves // 2))
        return at

    def reach(self, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves whose region is within ``radius`` of a row, in L1 distance."""
        rows, leaves = [], []
        stack = [(0, np.arange(len(x)), np.zeros(len(x), np.int64), {})]
        while stack:
            at, own, gap, region = stack.pop()
            if not len(own):
                continue
            node = self.nodes[at]
            if node[0] is None:
                rows.append(own)
                leaves.append(np.full(len(own), node[1]))
                continue
            d, bound, low, high = node
            lo, hi = region.get(d, (None, None))
            v = x[own, d]
            old = (0 if lo is None else np.maximum(lo - v, 0)) + (0 if hi is None else np.maximum(v - hi, 0))
            for child, side in ((low, (lo, bound)), (high, (bound + 1, hi))):
                new = (0 if side[0] is None else np.maximum(side[0] - v, 0)) + (0 if side[1] is None else np.maximum(v - side[1], 0))
                far = gap - old + new
                stay = far <= radius
                stack.append((child, own[stay], far[stay], {**region, d: side}))
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Box:
    """A k-d tree of a shard's letter counts, with the tight box of each node."""

    def __init__(self, x: np.ndarray):
        self.order: list[np.ndarray] = []
        self.nodes: list[tuple] = []  # low corner, high corner, children or rows
        self.x = x
        if len(x):
            self._grow(np.arange(len(x)))

    def _grow(self, rows: np.ndarray) -> int:
        at, x = len(self.nodes), self.x[rows]
        self.nodes.append(())
        split = widest(x) if len(rows) > LEAF else None
        below = rows
        if split is not None:
            under = x[:, split[0]] <= split[1]
            below = (self._grow(rows[under]), self._grow(rows[~under]))
        self.nodes[at] = (x.min(axis=0), x.max(axis=0), below)
        return at

    def near(self, q: np.ndarray, radius: int):
        """Blocks of pairs (row of ``q``, row of the tree) at exactly L1 distance ``radius``, 1 or 2, where the lengths of
        the words differ by 2 - radius: then it is also the squared distance, one product for a leaf."""
        if not self.nodes:
            return
        top = max(int(self.x.max()), int(q.max()) if q.size else 0)
        kind = np.float32 if top * top * self.x.shape[1] < 1 << 22 else np.float64
        for start in range(0, len(q), SEARCHES):
            stack = [(0, np.arange(start, min(start + SEARCHES, len(q))))]
            while stack:
                at, own = stack.pop()
                low, high, below = self.nodes[at]
                part = q[own]
                own = own[(np.maximum(low - part, 0) + np.maximum(part - high, 0)).sum(axis=1) <= radius]
                if not len(own):
                    continue
                if isinstance(below, tuple):
                    stack += [(child, own) for child in below]
                    continue
                a, b = q[own].astype(kind), self.x[below].astype(kind)
                i, j = np.nonzero((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T) == radius)
                if len(i):
                    yield own[i], below[j]


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether a letter put into ``short`` gives ``long``: their common start and end cover the shorter one."""
    n = short.shape[1]
    start = np.cumprod(short == long[:, :n], axis=1, dtype=np.int64).sum(axis=1)
    end = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1, dtype=np.int64).sum(axis=1)
    return start + end >= n


class Best:
    """For each of a shard's words how many near ones it met, and the most frequent of them, ties to the first in order."""

    def __init__(self, n: int):
        self.near, self.n, self.place = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)

    def meet(self, own: np.ndarray, n: np.ndarray, place: np.ndarray) -> None:
        self.near += np.bincount(own, minlength=len(self.near))
        order = np.lexsort((place, -n, own))
        own, n, place = own[order], n[order], place[order]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        own, n, place = own[first], n[first], place[first]
        better = (n > self.n[own]) | ((n == self.n[own]) & (place < self.place[own]))
        self.n[own[better]], self.place[own[better]] = n[better], place[better]


OWN, SAME, SHORTER = 0, 1, 2
SCHEMA = "word string, near long, form_n long, form string"


def search(shard: pa.Table) -> pa.Table:
    """What the words of a shard and the searches sent to it met: (word, near, form_n, form) of all that met any.

    Role 0: words of the shard, which also search it; 1: words of their length from other shards; 2: words a letter
    shorter, whose pairs are told to both sides.
    """
    words, role = np.array(shard.column("word").to_pylist(), object), shard.column("role").to_numpy()
    n = shard.column("n").to_numpy()
    order = np.argsort(words, kind="stable")  # places among the words are their order
    words, role, n = words[order], role[order], n[order]
    x, _ = letter_counts(words.tolist())
    x = x[:, x.any(axis=0)]
    point, same, short = (np.flatnonzero(k) for k in (role == OWN, role != SHORTER, role == SHORTER))
    best = Best(len(words))

    def letters(rows):
        return np.frombuffer("".join(words[rows]).encode("latin-1"), np.uint8).reshape(len(rows), -1)

    tree = Box(x[point])
    for a, b in tree.near(x[same], 2):
        p, q = same[a], point[b]
        met = one_replaced(letters(p), letters(q))
        best.meet(p[met], n[q[met]], q[met])
    for a, b in tree.near(x[short], 1):
        p, q = short[a], point[b]
        met = one_inserted(letters(p), letters(q))
        best.meet(p[met], n[q[met]], q[met])
        best.meet(q[met], n[p[met]], p[met])
    some = np.flatnonzero(best.near)
    return pa.table([pa.array(words[some], pa.string()), pa.array(best.near[some]), pa.array(best.n[some]), pa.array(words[best.place[some]], pa.string())], ["word", "near", "form_n", "form"])


def _routed(routers: dict[int, Router]):
    """(length, leaf, role, word, n): each word at its own shard and at the shards of its length and the next that it reaches."""

    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            x, length = letter_counts(words)
            out = []
            for size in np.unique(length).tolist():
                own = np.flatnonzero(length == size)
                for to, radius in ((size, 2), (size + 1, 1)):
                    router = routers.get(to)
                    row, leaf = router.reach(x[own], radius) if router else (np.arange(len(own)), np.zeros(len(own), np.int64))
                    role = np.full(len(row), SAME if to == size else SHORTER)
                    if to == size:
                        home_row, home = router.reach(x[own], 0) if router else (row, leaf)
                        at = np.empty(len(own), np.int64)
                        at[home_row] = home
                        role[leaf == at[row]] = OWN
                    out.append((np.full(len(row), to), leaf, role, own[row]))
            to, leaf, role, row = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(leaf), pa.array(role), *(batch.column(i).take(pa.array(row)) for i in range(2))], ["length", "leaf", "role", "word", "n"])

    return run


def _routers(words: DataFrame) -> dict[int, Router]:
    """An upper tree for each length of more words than a shard takes, grown on ``SAMPLE`` words of these lengths at most."""
    sizes = words.groupBy(F.length("word").alias("length")).count()
    limit = F.greatest(F.lit(LEAF), F.least(F.lit(SHARD), F.floor(F.lit(SHARD_BYTES) / F.col("length"))))
    large = {r.length: (r["count"], r.limit) for r in sizes.withColumn("limit", limit).filter("count > limit").collect()}
    if not large:
        return {}
    share = min(1.0, SAMPLE / sum(n for n, _ in large.values()))
    picked = words.filter(F.length("word").isin(list(large)) & drawn(share, F.col("word"))).select("word").limit(2 * SAMPLE)
    groups: dict[int, list[str]] = {}
    for (w,) in picked.toLocalIterator():
        groups.setdefault(len(w), []).append(w)
    return {size: Router(letter_counts(sorted(groups[size]))[0], -(-n // limit)) for size, (n, limit) in large.items() if size in groups}


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, form_n, form) of the distinct ``words`` (word, n) that have a word one edit away: how many, and the most
    frequent of them with its n, ties to the first in code-point order. Words consist of a-z and U+00C0 to U+00FF."""
    routed = words.select("word", "n").mapInArrow(_routed(_routers(words)), "length long, leaf long, role long, word string, n long")
    met = routed.groupBy("length", "leaf").applyInArrow(lambda shard: search(shard), SCHEMA)
    best = met.groupBy("word").agg(F.sum("near").alias("near"), F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("best"))
    return best.select("word", "near", (-F.col("best.m")).alias("form_n"), "best.form")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms, by doubling its steps; n grows at each, so there are few."""
    roots = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return roots


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, times: int = TIMES, least_count: int = LEAST_COUNT, typo: int | None = None) -> DataFrame:
    """Per word of at least ``least`` letters and ``least_count`` occurrences: word, form, root, n, n_near, form_n.

    ``form`` is the most frequent word one edit away, where it occurs ``times`` as often at least, and ``root`` the end of
    the chain of forms. Counts cover all documents.

    Defined cases: null texts have no words; a null id is the empty text in ``id:run``; repeated rows count each; very long
    texts and words are read whole; letters beyond U+00FF end a run; ties go to the first word in code-point order; other
    columns are ignored, whatever their names; an empty table has no words.
    """
    words = written(word_counts(docs, id_col, text_col, least, typo).filter(F.col("n") >= least_count), "words")
    found = words.join(near_words(words), "word", "left")
    is_form = F.col("form_n") >= times * F.col("n")
    found = written(found.select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")), "found")
    roots = _roots(found.filter("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), typo=199)


OP13_SQL = r"""
with recursive t as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
r as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
      from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents)),
g as (select doc_id, run, count(*) as n, concat(doc_id, ':', run) as s from r group by doc_id, run),
b as (select *, list_concat([4294967295], flatten(list_transform(string_split(s, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195, (128 | (unicode(x) & 63))::bigint] end))) as bytes from g),
h as (select run, n, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as h from b cross join t),
f as (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from h),
w as (select word, sum(n)::bigint as n from f where length(word) >= 6 group by word having sum(n) >= 5),
x as (select word, n, unnest(range(1, length(word) + 1)) as i from w),
p as (select word, n, substr(word, 1, i::int - 1) || '_' || substr(word, i::int + 1) as k from x),
d as (select distinct word, n, substr(word, 1, i::int - 1) || substr(word, i::int + 1) as k from x),
near as (select a.word, b.word as other, b.n as m from p a join p b on a.k = b.k and a.word <> b.word
         union all select d.word, w.word, w.n from d join w on w.word = d.k
         union all select w.word, d.word, d.n from d join w on w.word = d.k),
best as (select word, count(*) as near, arg_min(other, (-m, other)) as form, max(m) as m from near group by word),
o as (select w.word, w.n, coalesce(near, 0) as n_near, case when m >= 5 * w.n then form end as form, case when m >= 5 * w.n then m end as form_n from w left join best on best.word = w.word),
c as (select word, word as here, 0 as steps from o union all select c.word, o.form, steps + 1 from c join o on o.word = c.here where o.form is not null),
z as (select word, arg_max(here, steps) as root from c group by word)
select o.word, form, root, n, n_near::bigint as n_near, form_n from o join z on z.word = o.word
"""
