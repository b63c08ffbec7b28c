import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attesta.llm import packing, rans, tokens
from tests.llm.cases import ODD, documents

FILES = [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)]
PLAIN = {}


def plain(name):
    if name not in PLAIN:
        PLAIN[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return PLAIN[name]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


TRICKY = [*ODD, "it's I'LL don't 'tis ,'s a'b", "a\n\nb", "a\n b", "a \n b", "  a  b ", "x1y2 33", "   foo \n\nbar", "é ≠a", "<|endoftext|> x <|startoftext|>", "a,b.c;d!!!e", "\ta\r\nb\r\n\r\nc", "ΑΣ Σ. İI", "\x1ca\x1c b\x85c", "<|endoftext|>", "a<|endoftext|><|endoftext|>b <|ENDOFTEXT|>", "x  <|endoftext|>  y<|startoftext|", "é<|startoftext|>́ z"]


@pytest.mark.parametrize("name,drops", FILES)
def test_ids_are_those_of_the_whole_text(name, drops):
    enc = tokens.Encoder(public_tokenizers.path(name), drops)
    texts = [t or "" for t in TRICKY]
    ids, n = enc.encode(texts)
    ends = np.cumsum(n)
    for i, t in enumerate(texts):
        assert ids[ends[i] - n[i] : ends[i]].tolist() == plain(name).encode(t, add_special_tokens=False).ids, repr(t)[:80]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from([*" \n\t\r'.,!aAbZ019é  ́\x85\x1c字<|>", "<|endoftext|>", "<|startoftext|>"]), st.characters(exclude_categories=["Cs"])), max_size=40).map("".join), min_size=1, max_size=5))
def test_ids_of_any_text(texts):
    for name, drops in FILES:
        enc = tokens.encoder(public_tokenizers.path(name), drops)
        ids, n = enc.encode(texts)
        assert ids.tolist() == [x for t in texts for x in plain(name).encode(t, add_special_tokens=False).ids]


@pytest.mark.parametrize("name,drops", FILES)
def test_pieces_that_share_a_hash_keep_their_own_ids(monkeypatch, name, drops):
    monkeypatch.setattr(tokens, "span_hash", lambda units, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    enc = tokens.Encoder(public_tokenizers.path(name), drops)
    for texts in (["one two six ten", "a bc def ghij"], ["two one", "x" * 600 + " " + "y" * 600 + " bc a"]):
        assert enc.encode(texts)[0].tolist() == [x for t in texts for x in plain(name).encode(t, add_special_tokens=False).ids]


def test_forgetting(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_PIECES", 5)
    enc = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), True)
    for t in ("a b c d", "e f g h", "a b c d e f g h i j"):
        assert enc.encode([t])[0].tolist() == plain("word_bpe_49k.json").encode(t, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=5000), st.integers(1, 50000))
def test_segment_round_trip(ids, top):
    ids = np.array([*ids, top], np.uint32)
    counts = np.array([0, len(ids) - 1, 1], np.int64)
    data = rans.pack_segment([3, None, 9], counts, ids)
    names, n, back = rans.unpack_segment(data)
    assert names == [3, None, 9] and (n == counts).all() and (back == ids).all()


def test_blocks_and_damage():
    ids = np.random.default_rng(1).zipf(1.3, 600000).clip(0, 40000).astype(np.uint32)
    data = rans.pack_segment([1], np.array([len(ids)]), ids)
    assert (rans.unpack_segment(data)[2] == ids).all()
    freq = np.unique(ids, return_counts=True)[1] / len(ids)
    assert len(data) < len(ids) * -(freq * np.log2(freq)).sum() / 8 * 1.03 + 200000
    bad = bytearray(data)
    bad[-5] ^= 1
    with pytest.raises(ValueError):
        rans.unpack_segment(bytes(bad))


def whole(name, text, end):
    return [*plain(name).encode(text or "", add_special_tokens=False).ids, end]


def test_token_file(spark, sf_dir):
    got = {r.doc_id: r for r in rans.op2_rans_tokens(spark, sf_dir).collect()}
    start = 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = whole("word_bpe_49k.json", r.text, 1)
        assert tuple(got[r.doc_id])[1:] == (start, len(ids), crc(ids))
        start += len(ids)


def test_token_file_odd_rows(spark, tmp_path):
    docs = documents(spark, [*TRICKY, "again", "again"], [*range(len(TRICKY)), None, 0])
    path = f"file://{tmp_path}/t"
    rans.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(rans.read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got][:3] == [None, 0, 0] and len(got) == len(TRICKY) + 2
    assert sum(r.n_tokens for r in got) == got[-1].start + got[-1].n_tokens
    for r in got[3:]:
        assert r.ids == whole("word_bpe_49k.json", TRICKY[r.doc_id], 1)
    rans.write_tokens(docs.limit(0), path + "0", public_tokenizers.path("word_bpe_49k.json"))
    assert rans.read_tokens(spark, path + "0").count() == 0


def check_packing(rows, texts):
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for d, text in texts.items():
        ids, at = whole("byte_bpe_50k.json", text, 0), 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == crc(ids[at : at + r.length]) and r.doc_tokens == len(ids) and r.length > 0
            at += r.length
        assert at == len(ids)
    short = 0
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        short += at < 1024
    return short


def test_packing(spark, sf_dir):
    rows = packing.op8_cost_balanced_packing(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert check_packing(rows, texts) <= 2


def test_packing_odd_rows(spark):
    docs = documents(spark, TRICKY)
    check_packing(packing.pack(docs.coalesce(1), public_tokenizers.path("byte_bpe_50k.json")).collect(), dict(enumerate(TRICKY)))
    assert packing.pack(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert packing.pack(documents(spark, [None, None], [None, 1]), public_tokenizers.path("byte_bpe_50k.json"), with_ids=True).count() == 2


def test_balance_evens_cost():
    lengths = np.random.default_rng(2).integers(1, 1024, 2000)
    pieces, n = packing.balance(lengths)
    load, fill = np.zeros(n), np.zeros(n, int)
    for _, _, m, q, _ in pieces:
        load[q] += packing.cost(m)
        fill[q] += m
    assert fill.sum() == lengths.sum() and (fill[:-1] == 1024).all() and fill[-1] == lengths.sum() - 1024 * (n - 1)
    assert load[:-1].std() / load[:-1].mean() < 0.2


@pytest.mark.parametrize("name,drops", FILES)
def test_words_with_accents_are_cut_and_encoded_together(name, drops):
    path = public_tokenizers.path(name)
    library, enc, calls = Tokenizer.from_file(path), tokens.Encoder(path, drops), []
    texts = [" élan où ÀÉ ñandú ßtraße", " où élan", " a×b ÷ é÷é", " é e\u0301 é\u0301 éЖ é\u2003 é", " é1 é. l'été's"]
    encode = enc._encode
    enc._encode = lambda pieces: calls.append(pieces) or encode(pieces)
    ids, n = enc.encode(texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [len(w) for w in want] == n.tolist() and sum(want, []) == ids.tolist()
    assert sum("élan" in p for p in calls[0]) == 1  # one piece for both texts
