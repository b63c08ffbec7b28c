"""Document quality: random-indexing word vectors pooled for each document, and a two-layer network with a
temperature fitted on rows it has not seen."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from attesta.llm.common import bounded_sample, chunks, drawn, lean, need, padded, span_hash, table, texts_of, without, written

#: Bounds of the labelled sample that vectors, network and temperature are fitted on.
FIT_ROWS, FIT_BYTES = 6000, 24 << 20
#: Word rows (by hash), dimensions, non-zero places of an index vector, neighbours on each side.
ROWS, DIMS, PLACES, NEAR = 1 << 14, 64, 4, 2
HIDDEN, STEPS, RATE, DECAY, SEED = 32, 400, 0.02, 1e-4, 11
#: Text that is held as arrays at once; these take about 100 bytes for each of text.
CHUNK_BYTES = 1 << 20

SPACE, MARK, DIGIT, UPPER, LOWER = range(5)
_CLASS = np.full(256, LOWER, np.uint8)
_CLASS[:0x80] = MARK
_CLASS[0x30:0x3A] = DIGIT
_CLASS[0x41:0x5B] = UPPER
_CLASS[0x61:0x7B] = LOWER
_CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE

#: Shapes count as words of their own: six of words, four marks by run length, and two kinds of repetition.
SHAPES = 6 + 4 * 3 + 2


class Tokens:
    """Words and runs of marks of a list of texts: rows of the vector table, shapes, and the text of each."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n".join(raw) + b"\n"
        units = padded(data)
        kind = _CLASS[units[: len(data)]]
        side = np.where(kind == SPACE, 0, np.where(kind == MARK, 1, 2))
        begin = np.flatnonzero(np.diff(side, prepend=-1) != 0)
        end = np.append(begin[1:], len(data))
        keep = side[begin] > 0
        s, e = begin[keep], end[keep]
        self.text = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), s, "right").astype(np.int32)
        named = span_hash(units, s, e)
        self.row = (named % np.uint64(ROWS)).astype(np.int32)
        n = e - s
        run = lambda k: np.concatenate(([0], np.cumsum(kind == k)))
        upper, digit = (run(k)[e] - run(k)[s] for k in (UPPER, DIGIT))
        first = kind[s] == UPPER if len(s) else np.zeros(0, bool)
        word = np.select([digit > 0, upper == 0, (upper == n) & (n == 1), upper == n, first & (upper == 1)], [4, 0, 3, 2, 1], 5)
        char = units[s]
        mark = np.select([(char == 0x2E) | (char == 0x2C), np.isin(char, [0x21, 0x3F]), np.isin(char, [0x22, 0x27, 0x28, 0x29, 0x2D, 0x3A, 0x3B])], [0, 1, 2], 3)
        is_word = side[s] == 2 if len(s) else np.zeros(0, bool)
        self.shape = np.where(is_word, word, 6 + 3 * mark + np.minimum(n, 3) - 1).astype(np.uint8)
        self.again = np.zeros((2, len(s)), bool)
        for k in (1, 2):
            self.again[k - 1, k:] = (named[k:] == named[:-k]) & (self.text[k:] == self.text[:-k]) & is_word[k:]


def index_vectors() -> np.ndarray:
    """A sparse ternary vector for each row."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((ROWS, DIMS), np.float32)
    at = rng.permuted(np.tile(np.arange(DIMS), (ROWS, 1)), axis=1)[:, :PLACES]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (ROWS, PLACES)), axis=1)
    return out


def word_vectors(parts: list[Tokens]) -> np.ndarray:
    """Each row's own index vector plus those of its neighbours, rarer neighbours weighing more; unit length."""
    index = index_vectors()
    seen = sum((np.bincount(p.row, minlength=ROWS) for p in parts), np.zeros(ROWS))
    weighed = index / np.sqrt(1 + seen)[:, None].astype(np.float32)
    context = np.zeros_like(index)
    for p in parts:
        for k in range(1, NEAR + 1):
            same = np.flatnonzero(p.text[k:] == p.text[:-k])
            for a, b in ((p.row[same], p.row[same + k]), (p.row[same + k], p.row[same])):
                for i in range(0, len(a), 1 << 18):
                    order = np.argsort(a[i : i + (1 << 18)], kind="stable")
                    rows, near = a[i : i + (1 << 18)][order], b[i : i + (1 << 18)][order]
                    cut = np.flatnonzero(np.diff(rows, prepend=-1))
                    context[rows[cut]] += np.add.reduceat(weighed[near], cut, axis=0)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    return unit(unit(index) + unit(context)).astype(np.float32)


def pooled(vectors: np.ndarray, t: Tokens, texts: int) -> np.ndarray:
    """Mean word vector, its length, and the shares of the shapes, for each text; zeros without words."""
    out = np.zeros((texts, DIMS + 1 + SHAPES), np.float64)
    n = np.maximum(np.bincount(t.text, minlength=texts), 1)
    first = np.searchsorted(t.text, np.arange(texts))
    some = np.flatnonzero(np.diff(np.append(first, len(t.text))))
    for i in range(0, len(some), 64):
        own = some[i : i + 64]
        stop = first[own[-1] + 1] if own[-1] + 1 < texts else len(t.text)
        out[own, :DIMS] = np.add.reduceat(vectors[t.row[first[own[0]] : stop]], first[own] - first[own[0]], axis=0, dtype=np.float64)
    out[:, :DIMS] /= n[:, None]
    out[:, DIMS] = np.linalg.norm(out[:, :DIMS], axis=1)
    shapes = np.bincount(t.text.astype(np.int64) * SHAPES + t.shape, minlength=texts * SHAPES).reshape(texts, SHAPES).astype(np.float64)
    for k in range(2):
        shapes[:, SHAPES - 2 + k] = np.bincount(t.text[t.again[k]], minlength=texts)
    out[:, DIMS + 1 :] = np.sqrt(shapes / n[:, None])
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    width: int

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.tanh((features - self.mean) / self.spread @ w1 + b1) @ w2 + b2)[:, 0]

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, j in chunks([len(t) for t in texts], CHUNK_BYTES):
            features = pooled(self.vectors, Tokens(texts[i:j]), j - i)[:, : self.width]
            out[i:j] = _sigmoid(self.logits(features) / self.temperature)
        return out


def _network(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Two layers by Adam on the log loss."""
    rng = np.random.default_rng(SEED)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    for step in range(1, STEPS + 1):
        hidden = np.tanh(x @ layers[0] + layers[1])
        off = (_sigmoid(hidden @ layers[2] + layers[3]) - y[:, None]) / len(y)
        back = off @ layers[2].T * (1 - hidden**2)
        grads = [x.T @ back + DECAY * layers[0], back.sum(0), hidden.T @ off + DECAY * layers[2], off.sum(0)]
        for p, g, a, b in zip(layers, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return layers


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss on a grid; 1 without rows."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [-np.mean(np.log(np.where(y > 0, p := _sigmoid(logits / t), 1 - p) + 1e-12)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(texts: list[str], labels: list[int], shapes: bool = True) -> Model:
    """Every fifth text is kept back for the temperature. With one class only, scores are near that class. Without
    ``shapes`` the pooled word vectors are all that the network sees."""
    y = np.array(labels, np.float64)
    cuts = list(chunks([len(t) for t in texts], CHUNK_BYTES))
    parts = [Tokens(texts[i:j]) for i, j in cuts]
    vectors = word_vectors(parts)
    width = DIMS + 1 + (SHAPES if shapes else 0)
    x = np.concatenate([pooled(vectors, p, j - i)[:, :width] for p, (i, j) in zip(parts, cuts, strict=True)]) if parts else np.zeros((0, width))
    mean = x.mean(axis=0) if len(x) else np.zeros(width)
    spread = (x.std(axis=0) if len(x) else np.zeros(width)) + 1e-3
    back = np.arange(len(y)) % 5 == 4
    z = (x - mean) / spread
    layers = _network(z[~back], y[~back]) if len(y) else [np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.zeros(1)]
    model = Model(vectors, mean, spread, layers, 1.0, width)
    model.temperature = _temperature(model.logits(x[back]), y[back])
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id", rows: int = FIT_ROWS, size: int = FIT_BYTES, shapes: bool = True) -> Model:
    """Fits on at most about ``rows`` labelled documents and ``size`` bytes of text, drawn by a hash of id and text.

    A label holds for all documents of its id, null ids and labels aside; a document with two labels counts with
    each; null texts and single ones of more than a sixteenth of ``size`` are left out; other columns are ignored.
    The ids are counted before any text is read, so that an id that many documents share stays within the bound.
    """
    need(docs, id_col, text_col)
    need(labels, id_col, label_col)
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    some = marked.filter(drawn(min(1.0, rows / max(marked.count(), 1)), "id"))
    some = written(some.dropDuplicates(), "labels")
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(some, "id")
    share = min(1.0, rows / max(docs.select(F.col(id_col).alias("id")).join(some, "id").count(), 1))
    known = written(known.dropna().filter(drawn(share, "id", "text")), "labelled")
    found = bounded_sample(known, "id", "text", rows, size).orderBy(F.xxhash64("id"), "id", F.xxhash64("text"), "label").toArrow()
    return fit(found.column("text").to_pylist(), found.column("label").to_pylist(), shapes)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (score >= 0.5), in place of any columns of those names. Null and empty texts
    are scored as texts without words.

    Repeated rows get the same score; other columns pass through; very long texts are scored whole; an empty table
    gives no rows.
    """
    need(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = without(docs, *({"score", "predicted"} - {text_col.lower()}))
    at = kept.columns.index(text_col)

    def run(batches):
        for batch in batches:
            value = shared.value.scores(texts_of(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value), pa.array((value >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return kept.mapInArrow(lean(run), StructType([*kept.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not reject: those of a score of 0.5 or more.

    Null and empty texts are judged as texts without words, repeated rows alike, very long texts whole.
    """
    need(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(texts_of(batch.column(at))) >= 0.5))

    return docs.mapInArrow(lean(run), docs.schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    model = train(docs, labels.filter(~held_out))
    out = score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", "predicted")
