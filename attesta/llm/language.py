"""Language identification, word first: known words score by their log frequency in each language, unseen words by
the longest character n-grams of theirs that are known."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from attesta.llm.common import bounded_sample, chunks, need, padded, ragged, span_hash, spans, table, texts_of, without

UNKNOWN = "und"
#: Bounds of the labelled sample that the model is fitted on.
FIT_ROWS, FIT_BYTES = 6000, 24 << 20
MIN_COUNT, SMOOTH, LONGEST = 3, 0.5, 4
CHUNK_CHARS = 2 << 20
#: Smaller while fitting, which the driver does.
FIT_CHARS = 1 << 19

_LETTER = np.fromiter((0xD800 <= i < 0xE000 or chr(i).isalpha() for i in range(1 << 16)), bool, 1 << 16)


class Letters:
    """The words (runs of letters) of lower-cased texts as spans of UTF-16 units."""

    def __init__(self, texts: list[str]):
        low = [t.lower().encode("utf-16-le", "surrogatepass") for t in texts]
        data = b"\n\0".join(low)
        self.units = padded(data, "<u2")
        self.starts, self.ends = spans(_LETTER[self.units[: len(data) // 2]])
        self.hash = span_hash(self.units, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, np.cumsum([0, *(len(x) // 2 + 1 for x in low)]))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def grams(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys of all n-grams of these words, number of each word's); a key holds the n units themselves."""
        count = np.maximum(self.ends[which] - self.starts[which] - n + 1, 0)
        at = ragged(self.starts[which], count)
        words = np.ndarray((len(self.units) - 3,), "<u8", self.units, strides=(2,))
        return words[at] & np.uint64((1 << 16 * n) - 1), count


@dataclass
class Model:
    langs: list[str]
    words: np.ndarray
    word_scores: np.ndarray
    grams: dict[int, tuple[np.ndarray, np.ndarray]]

    def scores(self, letters: Letters, texts: int) -> np.ndarray:
        """Sum of the scores of each text's words, by language."""
        keys, example, inverse = np.unique(letters.hash, return_index=True, return_inverse=True)
        values = np.zeros((len(keys), len(self.langs)), np.float64)
        place, known = _find(self.words, keys)
        values[known] = self.word_scores[place[known]]
        left = np.flatnonzero(~known)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            gram, count = letters.grams(example[left], n)
            at, found = _find(self.grams[n][0], gram)
            owner = np.repeat(np.arange(len(left)), count)
            total = np.zeros((len(left), len(self.langs)))
            for k in range(len(self.langs)):
                total[:, k] = np.bincount(owner[found], self.grams[n][1][at[found], k], len(left))
            hits = np.bincount(owner[found], minlength=len(left))
            some = hits > 0
            values[left[some]] = total[some] / hits[some, None]
            left = left[~some]
        out = np.zeros((texts, len(self.langs)))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(letters.text, values[inverse, k], texts)
        return out


def _find(table_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table_):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    place = np.minimum(np.searchsorted(table_, keys), len(table_) - 1)
    return place, table_[place] == keys


class Counts:
    """Counts of keys by language, merged chunk by chunk, so that memory follows the distinct keys."""

    def __init__(self, n_lang: int):
        self.n_lang = n_lang
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros((0, n_lang))

    def add(self, keys: np.ndarray, lang: np.ndarray, weight: np.ndarray) -> None:
        new, at = np.unique(keys, return_inverse=True)
        part = np.bincount(at * self.n_lang + lang, weight, len(new) * self.n_lang).reshape(len(new), self.n_lang)
        both, place = np.unique(np.concatenate((self.keys, new)), return_inverse=True)
        merged = np.zeros((len(both), self.n_lang))
        merged[place[: len(self.keys)]] += self.counts
        merged[place[len(self.keys) :]] += part
        self.keys, self.counts = both, merged

    def log_share(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys met at least MIN_COUNT times and their smoothed log frequency in each language."""
        kept = self.counts.sum(axis=1) >= MIN_COUNT
        total = self.counts.sum(axis=0) + SMOOTH * max(len(self.keys), 1)
        return self.keys[kept], np.log((self.counts[kept] + SMOOTH) / total).astype(np.float32)


def fit(texts: list[str], langs: list[str]) -> Model:
    """The model of a list of labelled texts; labels sort alphabetically, and the first wins a tie."""
    names = sorted(set(langs))
    number = {x: i for i, x in enumerate(names)}
    of = np.array([number[x] for x in langs], np.int64)
    n_lang = max(len(names), 1)
    words, grams = Counts(n_lang), {n: Counts(n_lang) for n in range(1, LONGEST + 1)}
    for i, j in chunks([len(t) for t in texts], FIT_CHARS):
        letters = Letters(texts[i:j])
        lang = of[i:j][letters.text]
        words.add(letters.hash, lang, np.ones(len(lang)))
        pair = letters.hash ^ (lang.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        _, example, count = np.unique(pair, return_index=True, return_counts=True)
        for n, found in grams.items():
            gram, size = letters.grams(example, n)
            found.add(gram, np.repeat(lang[example], size), np.repeat(count, size))
    return Model(names, *words.log_share(), {n: c.log_share() for n, c in grams.items()})


def predict(model: Model, texts: list[str]) -> tuple[list[str], list[float]]:
    langs, scores = [], []
    for i, j in chunks([len(t) for t in texts], CHUNK_CHARS):
        letters = Letters(texts[i:j])
        words = np.diff(letters.first)
        total = model.scores(letters, j - i) if model.langs else None
        for k in range(j - i):
            if not words[k] or total is None or not any(c.isalpha() for c in texts[i + k]):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(np.argmax(total[k]))
            # eight words' worth of evidence at most, so that scores stay comparable over lengths
            apart = (total[k] - total[k, best]) * min(1.0, 8 / words[k])
            langs.append(model.langs[best])
            scores.append(float(1 / np.exp(apart).sum()))
    return langs, scores


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows: int = FIT_ROWS, size: int = FIT_BYTES) -> Model:
    """Fits on at most about ``rows`` labelled rows and ``size`` bytes of text, drawn by a hash of id and text, each
    language by itself: a rare one keeps its rows, whatever the size of the table.

    Rows without a text or a language are left out, as are single texts of more than a sixteenth of ``size``; a null
    id is an id as any other; other columns are ignored. Few languages are assumed: their counts reach the driver.
    """
    need(docs, text_col, lang_col, id_col)
    labelled = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna(subset=["text", "lang"])
    found = bounded_sample(labelled, "id", "text", rows, size, "lang").orderBy("id", "text").toArrow()
    return fit(found.column("text").to_pylist(), found.column("lang").to_pylist())


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score, in place of any columns of those names. Null texts and texts without a letter are
    ``und`` with score 0.

    Repeated rows get the same answer; other columns pass through; very long texts are scored whole; an empty table
    gives no rows, and a model without labels says ``und`` for all.
    """
    need(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = without(docs, *({"lang_pred", "score"} - {text_col.lower()}))
    at = kept.columns.index(text_col)
    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        for batch in batches:
            langs, scores = predict(shared.value, texts_of(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    model = train(docs.filter(~held_out))
    out = identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
