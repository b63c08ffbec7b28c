"""Cost-balanced packing of token ids into sequences.

Documents are cut into full sequences and a rest. The rests of a group of documents are taken by descending cost,
linear plus quadratic in their length (attention), and each goes to the sequence of lowest cost with enough room;
one that fits nowhere is cut over the roomiest. A group is a run of documents of one scan task, so nothing is
shuffled, and at most one sequence of each group is not full.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import chunks, lean, need, table, texts_of, whole_text
from attesta.llm.tokens import CHUNK_BYTES, encoder

LENGTH, END_ID = 1024, 0
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: A group is closed at so many documents or ids.
GROUP_DOCS, GROUP_IDS = 4096, 1 << 22


def cost(n, linear: float = LINEAR, quadratic: float = QUADRATIC):
    return linear * n + quadratic * n * n


def balance(lengths: np.ndarray, length: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (item, start, n, sequence, offset) of items shorter than ``length``, and the number of sequences."""
    total = int(lengths.sum())
    n_seq = -(-total // length)
    room = np.full(n_seq, length, np.int64)
    load = np.zeros(n_seq)
    out = []

    def put(item, start, n, seq):
        out.append((item, start, n, seq, length - int(room[seq])))
        room[seq] -= n
        load[seq] += cost(n)

    if n_seq:
        room[-1] = total - (n_seq - 1) * length  # the rest of the group's ids: only this sequence is short
    short = length - int(room[-1]) if n_seq else 0
    for item in np.argsort(-cost(lengths), kind="stable").tolist():
        n, start = int(lengths[item]), 0
        fits = np.flatnonzero(room >= n)
        if n and len(fits):
            put(item, 0, n, int(fits[np.argmin(load[fits])]))
            continue
        while n:
            seq = int(np.argmax(room))
            part = min(n, int(room[seq]))
            put(item, start, part, seq)
            start, n = start + part, n - part
    if short:  # offsets of the short sequence count from its own begin
        out = [(i, s, n, q, o - short if q == n_seq - 1 else o) for i, s, n, q, o in out]
    return out, n_seq


SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(tokenizer: str, drops_space: bool, end_id: int, length: int, with_ids: bool):
    def run(batches):
        enc = encoder(tokenizer, drops_space)
        base = TaskContext.get().partitionId() << 33  # each task numbers its own sequences
        keys, counts, held, size = [], [], [], 0
        kind = None

        def close():
            nonlocal keys, counts, held, size, base
            ids = np.concatenate(held)
            n = np.array(counts, np.int64)
            first = np.cumsum(n) - n
            full, rest = n // length, n % length
            doc = np.repeat(np.arange(len(n)), full)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
            pieces = [(d, s * length, length, q, 0) for d, s, q in zip(doc.tolist(), k.tolist(), range(len(doc)), strict=True)]
            packed, used = balance(rest, length)
            pieces += [(d, int(full[d]) * length + s, m, len(doc) + q, o) for d, s, m, q, o in packed]
            pieces.sort()
            raw = memoryview(ids.astype("<u4").tobytes())
            begin = [int(first[d]) + s for d, s, *_ in pieces]
            crc = [zlib.crc32(raw[4 * b : 4 * (b + p[2])]) for b, p in zip(begin, pieces, strict=True)]
            cols = [pa.array([keys[p[0]] for p in pieces], kind), *(pa.array(v, pa.int64()) for v in ([p[1] for p in pieces], [p[2] for p in pieces], crc, [counts[p[0]] for p in pieces], [base + p[3] for p in pieces], [p[4] for p in pieces]))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                cols.append(pa.array([ids[b : b + p[2]].astype(np.int32) for b, p in zip(begin, pieces, strict=True)], pa.list_(pa.int32())))
                names.append("ids")
            base += len(doc) + used
            keys, counts, held, size = [], [], [], 0
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            kind = batch.schema.field(0).type
            texts, names = texts_of(batch.column(1)), batch.column(0).to_pylist()
            for i, j in chunks([len(t) for t in texts], CHUNK_BYTES):
                ids, n = enc.encode(texts[i:j])
                held.append(np.insert(ids, np.cumsum(n), end_id))
                keys += names[i:j]
                counts += (n + 1).tolist()
                size += len(ids) + j - i
                if len(keys) >= GROUP_DOCS or size >= GROUP_IDS:
                    yield close()
        if keys:
            yield close()

    return run


def pack(docs: DataFrame, tokenizer: str, drops_space: bool = False, end_id: int = END_ID, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` if asked for.

    Defined cases: null and empty texts are the end id alone; repeated rows are packed each; null ids stay null;
    an empty table gives no rows; other columns are ignored. Numbers of sequences depend on how the input is
    dealt to tasks; which ids a document has does not.
    """
    need(docs, id_col, text_col)
    kept = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    schema = SCHEMA.format(kept.schema["doc_id"].dataType.simpleString()) + (", ids array<int>" if with_ids else "")
    return kept.mapInArrow(lean(_pack(tokenizer, drops_space, end_id, length, with_ids), "tokens"), schema)


def op8_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
