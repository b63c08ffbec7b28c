"""Token files coded with a static range asymmetric numeral system.

A segment holds the ids of consecutive documents. Its frequency table is shared by its blocks; each block has
interleaved lanes, the lanes' states as a checkpoint, the place of its words and a checksum, so that blocks are
decoded independently and in any order. A token file is a table of segments, which Spark writes and reads on any
store and commits task by task.

Segment, little-endian: "RNS1", u32 docs, u32 symbols, u32 blocks, u64 ids; per symbol u32 id and u32 frequency
(sum 2**SCALE); per document i64 doc_id, u8 null, u64 ids; per block u32 ids, u32 words, u32 crc32 of the ids, then
the blocks: LANES u64 states and the words, u32 each.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm.common import chunks, lean, need, scratch_path, table, texts_of, whole_text, written
from attesta.llm.tokens import CHUNK_BYTES, encoder

SCALE, LOW, LANES, BLOCK_IDS, SEGMENT_IDS = 18, 1 << 31, 1024, 1 << 18, 1 << 21
MAGIC = b"RNS1"
END_ID = 1


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and their frequencies, each at least 1, with the sum 2**SCALE."""
    symbols, counts = np.unique(ids, return_counts=True)
    if not len(symbols):
        return symbols.astype(np.uint32), np.zeros(0, np.uint32)
    total = 1 << SCALE
    if len(symbols) > total:
        raise ValueError("more distinct ids than the table has places")
    spare = total - len(symbols)
    exact = counts * (spare / counts.sum())
    freq = 1 + exact.astype(np.int64)
    rest = total - int(freq.sum())
    freq[np.argsort(freq - 1 - exact, kind="stable")[:rest]] += 1
    return symbols.astype(np.uint32), freq.astype(np.uint32)


def encode_block(slots: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(states, words) for symbol numbers; row t of the lanes holds slots[t * LANES : (t + 1) * LANES]."""
    states = np.full(LANES, LOW, np.uint64)
    f, c = freq[slots].astype(np.uint64), cum[slots].astype(np.uint64)
    most = f << np.uint64(63 - SCALE)
    out = []
    shift, scale = np.uint64(32), np.uint64(SCALE)
    for s in range((len(slots) - 1) // LANES * LANES, -1, -LANES):
        e = min(s + LANES, len(slots))
        x = states[: e - s]
        full = x >= most[s:e]
        out.append(x[full].astype(np.uint32))
        x = np.where(full, x >> shift, x)
        q, r = np.divmod(x, f[s:e])
        states[: e - s] = (q << scale) + r + c[s:e]
    return states, np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)


def decode_block(states: np.ndarray, words: np.ndarray, n: int, table_: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> np.ndarray:
    """The symbol numbers of a block."""
    states = states.copy()
    out = np.empty(n, np.int64)
    f, c = freq.astype(np.uint64), cum.astype(np.uint64)
    mask, scale, shift, low = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32), np.uint64(LOW)
    at = 0
    for s in range(0, n, LANES):
        e = min(s + LANES, n)
        x = states[: e - s]
        place = x & mask
        symbol = table_[place.astype(np.int64)]
        out[s:e] = symbol
        x = f[symbol] * (x >> scale) + place - c[symbol]
        short = np.flatnonzero(x < low)
        x[short] = (x[short] << shift) | words[at : at + len(short)].astype(np.uint64)
        at += len(short)
        states[: e - s] = x
    if at != len(words) or (states != np.uint64(LOW)).any():
        raise ValueError("the block does not end where it began")
    return out


def pack_segment(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    symbols, freq = frequencies(ids)
    cum = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint32) if len(freq) else freq
    slots = np.searchsorted(symbols, ids)
    heads, blocks = [], []
    for s in range(0, len(ids), BLOCK_IDS):
        part = ids[s : s + BLOCK_IDS]
        states, words = encode_block(slots[s : s + BLOCK_IDS], freq, cum)
        heads.append(struct.pack("<III", len(part), len(words), zlib.crc32(part.astype("<u4").tobytes())))
        blocks.append(states.astype("<u8").tobytes() + words.astype("<u4").tobytes())
    known = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    null = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    head = MAGIC + struct.pack("<IIIQ", len(doc_ids), len(symbols), len(heads), len(ids))
    table_ = symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes()
    return b"".join([head, table_, known, null, counts.astype("<u8").tobytes(), *heads, *blocks])


def unpack_segment(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc ids, number of ids of each, ids); raises if a checksum differs."""
    if data[:4] != MAGIC:
        raise ValueError("no token segment")
    docs, symbols_n, blocks, n = struct.unpack_from("<IIIQ", data, 4)
    at = 24

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    symbols, freq = take("<u4", symbols_n), take("<u4", symbols_n)
    known, null, counts = take("<i8", docs), take(np.uint8, docs), take("<u8", docs).astype(np.int64)
    heads = take("<u4", 3 * blocks).reshape(blocks, 3)
    cum = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint32) if symbols_n else freq
    table_ = np.repeat(np.arange(symbols_n), freq)
    ids = np.empty(n, np.uint32)
    done = 0
    for count, words_n, crc in heads.tolist():
        states, words = take("<u8", LANES), take("<u4", words_n)
        part = symbols[decode_block(states, words, count, table_, freq, cum)]
        if zlib.crc32(part.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's checksum differs")
        ids[done : done + count] = part
        done += count
    return [None if z else int(d) for d, z in zip(known, null, strict=True)], counts, ids


#: ``before``: ids of the file's earlier segments, which its writer knows, so that readers need no more than the files' sums.
SEGMENTS = "file int, segment int, docs long, ids long, before long, data binary"
#: Files whose sums are broadcast; more are joined.
MANY_FILES = 1 << 20


def _write(path: str, drops_space: bool, end_id: int):
    def run(batches):
        enc, file, number = encoder(path, drops_space), TaskContext.get().partitionId(), 0
        names, counts, held, size, before = [], [], [], 0, 0

        def close():
            nonlocal names, counts, held, size, number, before
            n = np.array(counts, np.int64)
            row = [[file], [number], [len(names)], [size], [before], [pack_segment(names, n, np.concatenate(held))]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names, counts, held, size, number, before = [], [], [], 0, number + 1, before + size
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["file", "segment", "docs", "ids", "before", "data"])

        for batch in batches:
            texts, keys = texts_of(batch.column(1)), batch.column(0).to_pylist()
            for i, j in chunks([len(t) for t in texts], CHUNK_BYTES):
                ids, n = enc.encode(texts[i:j])
                ids = np.insert(ids, np.cumsum(n), end_id)
                names += keys[i:j]
                counts += (n + 1).tolist()
                held.append(ids)
                size += len(ids)
                if size >= SEGMENT_IDS:
                    yield close()
        if names:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, drops_space: bool = True, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the token file ``path``: segments in ascending id order over (file, segment), one end id a document.

    Defined cases: null and empty texts are the end id alone; a null id comes first and stays null; rows that
    repeat an id stand together, by the hash of their texts and then of their place, which also part an id that many
    rows have over several tasks; very long texts are encoded whole; an empty table gives an empty file; other columns
    are ignored.
    """
    need(docs, id_col, text_col)
    kept = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"), F.xxhash64(text_col, F.monotonically_increasing_id()).alias("salt"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("salt")]
    dealt = kept.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.mapInArrow(lean(_write(tokenizer, drops_space, end_id), "tokens"), SEGMENTS).write.parquet(path)


def _bases(segments: DataFrame) -> DataFrame:
    """(file, base): ids of all earlier files. Only sums for each file meet in one task."""
    files = segments.groupBy("file").agg(F.sum("ids").alias("n"))
    return written(files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base")), "bases")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of a token file: doc_id, start, n_tokens, ids_crc32, and ``ids`` if asked for."""
    found = spark.read.schema(SEGMENTS).parquet(path)
    bases = _bases(found.select("file", "ids"))
    bases = F.broadcast(bases) if bases.count() <= MANY_FILES else bases
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches):
        for batch in batches:
            for data, base in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                names, counts, ids = unpack_segment(data.as_py())
                ends = np.cumsum(counts)
                starts = ends - counts
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts, ends, strict=True)]
                cols = [pa.array(names, pa.int64()), pa.array(starts + base), pa.array(counts), pa.array(crc, pa.int64())]
                fields = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([ids[s:e].astype(np.int32) for s, e in zip(starts, ends, strict=True)], pa.list_(pa.int32())))
                    fields.append("ids")
                yield pa.RecordBatch.from_arrays(cols, fields)

    placed = found.select("file", "before", "data").join(bases, "file").select("data", (F.col("base") + F.col("before")).alias("base"))
    return placed.mapInArrow(lean(run), schema)


def op2_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path)
