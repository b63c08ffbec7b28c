"""Benchmark decontamination with suffix arrays over shards of the training texts.

A shard is a few megabytes of documents. Its words are numbered by the vocabulary of the test items (0: any other
word), and a suffix array is built over the positions from which a match can start at all, in the order of the whole
suffixes up to the next unknown word. Every test window is looked up in it by binary search, which gives all verbatim
occurrences and their locations; the longest match from each comes from the test items' own suffix array.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import KEPT, chunks, lean, need, padded, ragged, same_spans, span_hash, spans, table, written

WINDOW = 10
#: Text of a shard that is held as arrays at once, and of the test items in one pass over the documents.
SHARD_BYTES = 4 << 20
PASS_BYTES = 8 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class Words:
    """The words of a list of texts: lower-cased bytes, spans, 64-bit hashes and the text each belongs to."""

    def __init__(self, texts: list[bytes]):
        data = b"\n".join(texts)
        self.units = _LOWER[padded(data)]
        self.starts, self.ends = spans(_WORD[self.units[: len(data)]])
        self.hash = span_hash(self.units, self.starts, self.ends)
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, at)  # first word of each text, and the end
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.end = self.first[self.text + 1]  # the end of each word's text

    def same(self, mine: np.ndarray, other: "Words", theirs: np.ndarray) -> np.ndarray:
        """Whether words of mine are those of ``other``, byte for byte."""
        size = self.ends[mine] - self.starts[mine]
        out = size == other.ends[theirs] - other.starts[theirs]
        out[out] = same_spans(self.units, self.starts[mine[out]], other.units, other.starts[theirs[out]], size[out])
        return out


class Suffixes:
    """Word numbers of texts, with ``run``, the words from each place up to the end of its suffix, and ``key``, the
    next ``per`` of them packed into one number, zeros after the end: keys compare as suffixes do."""

    def __init__(self, numbers: np.ndarray, run: np.ndarray, bits: int):
        self.numbers, self.run, self.bits, self.per = numbers, run, bits, 63 // bits
        n = len(numbers)
        self.key = np.zeros(n, np.uint64)
        cut = np.append(numbers, np.zeros(self.per, np.int64)).astype(np.uint64)
        for k in range(self.per):
            self.key = (self.key << np.uint64(bits)) | np.where(run > k, cut[k : k + n], np.uint64(0))

    def _ahead(self, values: np.ndarray, at: np.ndarray, skip) -> np.ndarray:
        return np.where(skip < self.run[at], values[np.minimum(at + skip, len(values) - 1)], 0).astype(values.dtype)

    def keys(self, at: np.ndarray, skip) -> np.ndarray:
        """The packed words from ``skip`` words after ``at``; 0 past the end."""
        return self._ahead(self.key, at, skip)

    def word(self, at: np.ndarray, skip) -> np.ndarray:
        return self._ahead(self.numbers, at, skip)

    def head(self, at: np.ndarray, words: int) -> np.ndarray:
        """The first ``words`` words, at most ``per``."""
        return self.key[at] >> np.uint64(self.bits * (self.per - words))

    def order(self, at: np.ndarray, most: int) -> np.ndarray:
        """``at`` in the order of the suffixes, as far as their first ``most`` words part them."""
        at, rank = at.copy(), np.zeros(len(at), np.int64)  # rank: the place where a group of equal suffixes begins
        open_, skip = np.arange(len(at)), 0
        while len(open_) and skip < most:
            value = self.keys(at[open_], skip)
            by = np.lexsort((value, rank[open_]))
            at[open_], value = at[open_[by]], value[by]
            new = np.ones(len(open_), bool)
            new[1:] = (np.diff(rank[open_]) != 0) | (value[1:] != value[:-1])
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(open_)))
            rank[open_] = open_[np.repeat(begin, size)]
            open_ = open_[np.repeat((size > 1) & (value[begin] != 0), size)]
            skip += self.per
        return at

    def common(self, at: np.ndarray, other: "Suffixes", theirs: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that suffixes share with those of ``other`` from their begin, at most ``most``."""
        out = np.minimum(np.minimum(self.run[at], other.run[theirs]), most)
        open_, skip = np.flatnonzero(out > 0), 0
        while len(open_):
            gap = self.keys(at[open_], skip) ^ other.keys(theirs[open_], skip)
            off = np.flatnonzero(gap)
            alike = sum(((gap[off] >> np.uint64(self.bits * (self.per - k))) == 0).astype(np.int64) for k in range(1, self.per)) if self.per > 1 else 0
            out[open_[off]] = np.minimum(out[open_[off]], skip + alike)
            skip += self.per
            open_ = open_[(gap == 0) & (out[open_] > skip)]
        return out

    def place(self, array: np.ndarray, other: "Suffixes", theirs: np.ndarray, most: np.ndarray, after: bool = False) -> np.ndarray:
        """By binary search in the suffix array: the first place not below (``after``: above) the first ``most`` words
        of each suffix of ``other``."""
        low, high = np.zeros(len(theirs), np.int64), np.full(len(theirs), len(array), np.int64)
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            at, t, n = array[middle], theirs[open_], most[open_]
            shared = self.common(at, other, t, n)
            below = np.where(shared >= n, after, self.word(at, shared) < other.word(t, shared))
            low[open_[below]] = middle[below] + 1
            high[open_[~below]] = middle[~below]
        return low


class TestSet:
    """Test items as words with their vocabulary, suffix array and distinct windows. Items of one text are one."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        named: dict[bytes, set[str]] = {}
        for i, t in items:
            named.setdefault((t or "").encode("utf-8", "surrogatepass"), set()).update([] if i is None else [i])
        self.names = [sorted(x) for x in named.values()]
        self.words = w = Words(list(named))
        self._number(w)
        run = w.end - np.arange(len(w.hash))
        self.suffixes = Suffixes(self.numbers(w), run, max(1, len(self.vocabulary).bit_length()))
        self.most = int(run.max(initial=0))
        self.array = self.suffixes.order(np.arange(len(w.hash)), self.most)
        size = np.minimum(window, np.diff(w.first))[w.text]
        self._windows(np.where(run >= size, size, 0))

    def _number(self, w: Words) -> None:
        """The vocabulary: an example of each word, ascending by hash; words that share a hash have a place each."""
        left, found = np.arange(len(w.hash)), []
        while len(left):
            _, example, inverse = np.unique(w.hash[left], return_index=True, return_inverse=True)
            found.append(left[example])
            left = left[~w.same(left, w, left[example][inverse])]
        found = np.concatenate(found) if found else np.zeros(0, np.int64)
        self.examples = found[np.argsort(w.hash[found], kind="stable")]
        self.vocabulary = w.hash[self.examples]

    def numbers(self, words: Words) -> np.ndarray:
        """The number of each word in the vocabulary, from 1, bytes compared; 0 for other words."""
        out = np.zeros(len(words.hash), np.int64)
        if not len(self.vocabulary):
            return out
        place = np.searchsorted(self.vocabulary, words.hash)
        open_ = np.arange(len(out))
        while len(open_):
            open_ = open_[place[open_] < len(self.vocabulary)]
            open_ = open_[self.vocabulary[place[open_]] == words.hash[open_]]
            same = words.same(open_, self.words, self.examples[place[open_]])
            out[open_[same]] = place[open_[same]] + 1
            open_ = open_[~same]
            place[open_] += 1
        return out

    def _windows(self, length: np.ndarray) -> None:
        """Distinct windows: an example, its words, and the texts that hold it; ``length`` is 0 where no window begins."""
        starts, lengths, owners, heads = [], [], [], {}
        for n in np.unique(length[length > 0]).tolist():
            at = self.array[length[self.array] == n]
            new = np.ones(len(at), bool)
            new[1:] = self.suffixes.common(at[1:], self.suffixes, at[:-1], np.full(len(at) - 1, n)) < n
            begin = np.flatnonzero(new)
            starts.append(at[begin])
            lengths.append(np.full(len(begin), n))
            owners += np.split(self.words.text[at], begin[1:])
            q = min(n, self.suffixes.per)
            least, known = heads.get(q, (n, np.zeros(0, np.uint64)))
            heads[q] = (min(least, n), np.union1d(known, self.suffixes.head(at[begin], q)))
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        self.owners = [np.unique(x) for x in owners]
        self.heads = heads

    def items_of(self, windows: np.ndarray) -> list[str]:
        """The ids of the items with any of these windows, sorted."""
        texts = np.unique(np.concatenate([self.owners[k] for k in windows]))
        return sorted(set().union(*(self.names[k] for k in texts)))


class Shard:
    """The suffix array of a few documents."""

    def __init__(self, words: Words, tests: TestSet):
        self.words, self.tests = words, tests
        numbers = tests.numbers(words)
        n = len(numbers)
        stop = np.flatnonzero(numbers == 0)
        nxt = np.append(stop, n)[np.searchsorted(stop, np.arange(n))]
        self.suffixes = Suffixes(numbers, np.minimum(nxt, words.end) - np.arange(n), tests.suffixes.bits)
        can = np.zeros(n, bool)
        for q, (least, heads) in tests.heads.items():
            at = np.flatnonzero(~can & (self.suffixes.run >= least))
            head = self.suffixes.head(at, q)
            can[at[heads[np.minimum(np.searchsorted(heads, head), len(heads) - 1)] == head]] = True
        self.array = self.suffixes.order(np.flatnonzero(can), tests.most)

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(word position, distinct window) of every verbatim occurrence, by window."""
        t = self.tests
        if not len(self.array):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        window = []
        for n in np.unique(t.lengths).tolist():  # those whose first words are in the array at all
            own, q = np.flatnonzero(t.lengths == n), min(n, t.suffixes.per)
            window.append(own[np.isin(t.suffixes.head(t.starts[own], q), np.unique(self.suffixes.head(self.array, q)))])
        window = np.concatenate(window)
        asked = (self.array, t.suffixes, t.starts[window], t.lengths[window])
        begin, end = self.suffixes.place(*asked), self.suffixes.place(*asked, after=True)
        return self.array[ragged(begin, end - begin)], np.repeat(window, end - begin)

    def longest(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, test word) of the longest match that begins at each of these places: one of the two neighbours of
        the place's suffix in the test items' array."""
        t = self.tests
        most = np.full(len(at), t.most)
        place = t.suffixes.place(t.array, self.suffixes, at, most)
        best, where = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for near in (place - 1, place):
            some = np.flatnonzero((near >= 0) & (near < len(t.array)))
            words = self.suffixes.common(at[some], t.suffixes, t.array[near[some]], most[some])
            better = words > best[some]
            best[some[better]], where[some[better]] = words[better], t.array[near[some[better]]]
        return best, where


def _search(texts: list[bytes], tests: TestSet, matches: bool = False):
    """(words of each text, hit words of each text, {text: ids of its items}, {text: its matches})."""
    words = Words(texts)
    shard = Shard(words, tests)
    at, window = shard.occurrences()
    edge = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + tests.lengths[window], -1)
    hit = np.bincount(words.text, np.cumsum(edge[:-1]) > 0, len(texts)).astype(np.int64)
    pair = np.unique(words.text[at] * max(len(tests.starts), 1) + window)
    owner = pair // max(len(tests.starts), 1)
    cut = np.flatnonzero(np.diff(owner)) + 1
    items = {int(owner[part[0]]): tests.items_of(pair[part] % len(tests.starts)) for part in np.split(np.arange(len(pair)), cut) if len(part)}
    where: dict[int, list] = {}
    if matches and len(at):
        place, inverse = np.unique(at, return_inverse=True)
        size = np.zeros(len(place), np.int64)
        np.maximum.at(size, inverse, tests.lengths[window])
        longest, there = shard.longest(place)
        for p, n, most, t in zip(place.tolist(), size.tolist(), longest.tolist(), there.tolist(), strict=True):
            text, item = int(words.text[p]), int(tests.words.text[t])
            where.setdefault(text, []).append({"at": p - int(words.first[text]), "words": n, "item": next(iter(tests.names[item]), None), "item_at": t - int(tests.words.first[item]), "longest": most})
    return np.diff(words.first), hit, items, where


def _passes(benchmark: DataFrame, id_col: str, text_col: str, limit: int):
    """The test items in lists of at most ``limit`` bytes, streamed to the driver one list at a time."""
    held, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.octet_length(text_col).alias("n"))
    for row in rows.orderBy("i", "t").toLocalIterator():
        if held and size + (row.n or 0) > limit:
            yield held
            held, size = [], 0
        held.append((row.i, row.t or ""))
        size += row.n or 0
    yield held


#: first word, words, item, first word in the item, words of the longest match from there
MATCH = "array<struct<at:int,words:int,item:string,item_at:int,longest:int>>"


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, matches: bool = False, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, items_sha256, contaminated; with ``matches`` also, for each word where a
    window begins, the window's words, and the longest match with any item (of its pass) from there: item, word, length.

    Defined cases: null or empty texts have no words and are clean; items without words match nothing; items
    with a null id hit words but are neither named nor counted; items that repeat an id count once; repeated rows are
    judged alike; very long texts are searched whole; other columns are ignored. Without test items every document is
    clean. Test items of more than ``pass_bytes`` take further passes over the documents, whose results are written
    and merged by a key of each row; an ordinary benchmark takes one pass and no shuffle.
    """
    need(docs, id_col, text_col)
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    wanted = "id {}, row long, n_words long, n_hit long, items array<string>{}".format
    passes = _passes(benchmark, item_col, item_text, pass_bytes)
    items, more = next(passes), next(passes, None)
    if more is None:
        found = src.mapInArrow(lean(_judge(_shared(spark, items), window, matches), "decontaminate"), wanted(kind, f", matches {MATCH}" if matches else ""))
    else:
        src, parts = written(src.withColumn("row", F.monotonically_increasing_id()), "rows"), []
        while items is not None:  # one list of items at a time in the driver and the workers
            shared = _shared(spark, items)
            parts.append(written(src.mapInArrow(lean(_judge(shared, window, True), "decontaminate"), wanted(kind, f", matches {MATCH}")), "pass"))
            shared.destroy()
            items, more = more, next(passes, None)
        found = parts[0]
        for part in parts[1:]:
            found = found.union(part)
        # of a word where windows of several passes begin, the longest of each
        best = F.max(F.struct("longest", "words", "item", "item_at")).alias("m")
        at = found.select("row", F.explode("matches").alias("x")).select("row", "x.*")
        at = at.groupBy("row", "at").agg(F.max("words").alias("words"), best).select("row", F.struct("at", "words", "m.item", "m.item_at", "m.longest").alias("x"))
        at = at.groupBy("row").agg(F.array_sort(F.collect_list("x")).alias("matches"))  # no more than the row's words
        named = found.select("row", F.explode("items").alias("i")).groupBy("row").agg(F.array_sort(F.collect_set("i")).alias("items"))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))
        step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["at"] + x["words"] - F.greatest(x["at"], a["reach"]))).alias("n"), F.greatest(a["reach"], x["at"] + x["words"]).alias("reach"))
        rows = parts[0].select("row", "id", "n_words").join(at, "row", "left").join(named, "row", "left")
        none = F.array().cast(MATCH)
        rows = rows.withColumn("matches", F.coalesce("matches", none)).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
        found = rows.withColumn("n_hit", F.aggregate("matches", start, step, lambda a: a["n"]))
    cols = [F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")]
    return found.select(*cols, *(["matches"] if matches else []))


def _shared(spark: SparkSession, items: list):
    """A broadcast of at most about ``PASS_BYTES`` of test items, with a name."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, items))


#: The last test set that this worker has built, by the name of its broadcast.
_BUILT: dict = {}
KEPT["decontaminate"] = _BUILT


def _tests(shared, window: int) -> TestSet:
    name, items = shared.value
    if (name, window) not in _BUILT:
        _BUILT.clear()
        _BUILT[name, window] = TestSet(items, window)
    return _BUILT[name, window]


def _texts(column: pa.Array) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def _judge(shared, window: int, matches: bool):
    def run(batches):
        tests = _tests(shared, window)
        for batch in batches:
            texts = _texts(batch.column(1))
            n, hit, items, where = [], [], [], []
            for i, j in chunks([len(t) for t in texts], SHARD_BYTES):
                count, hits, named, places = _search(texts[i:j], tests, matches)
                n.append(count)
                hit.append(hits)
                items += [named.get(k, []) for k in range(j - i)]
                where += [places.get(k, []) for k in range(j - i)]
            row = batch.column(2) if batch.num_columns > 2 else pa.nulls(len(texts), pa.int64())
            none = [np.zeros(0, np.int64)]
            cols = [batch.column(0), row, pa.array(np.concatenate(n or none)), pa.array(np.concatenate(hit or none)), pa.array(items, pa.list_(pa.string()))]
            names = ["id", "row", "n_words", "n_hit", "items"]
            if matches:
                kind = pa.list_(pa.struct([("at", pa.int32()), ("words", pa.int32()), ("item", pa.string()), ("item_at", pa.int32()), ("longest", pa.int32())]))
                cols.append(pa.array(where, kind))
                names.append("matches")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _clean(shared, text_at: int, window: int):
    def run(batches):
        tests = _tests(shared, window)
        for batch in batches:
            texts = _texts(batch.column(text_at))
            clean = [_search(texts[i:j], tests)[1] == 0 for i, j in chunks([len(t) for t in texts], SHARD_BYTES)]
            yield batch.filter(pa.array(np.concatenate(clean) if clean else [], pa.bool_()))

    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of a test item occurs.

    The cases of :func:`contamination` hold. Further passes, where there are any, each write the rows still clean.
    """
    need(docs, text_col)
    passes = _passes(benchmark, item_col, item_text, pass_bytes)
    items, rest = next(passes), docs
    while items is not None:
        more = next(passes, None)
        shared = _shared(docs.sparkSession, items)
        rest = rest.mapInArrow(lean(_clean(shared, rest.columns.index(text_col), window), "decontaminate"), rest.schema)
        if more is not None:
            rest = written(rest, "clean")
            shared.destroy()
        items = more
    return rest


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
