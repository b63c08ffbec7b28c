import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import spelling
from tests.compare import assert_same, connection
from tests.llm.cases import ODD, documents


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, least=6, least_count=5, times=5, typo=199):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if typo and h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= least_count}
    by = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    form, met = {}, {}
    for w, n in words.items():
        own = [v for k in (len(w) - 1, len(w), len(w) + 1) for v in by.get(k, []) if near(w, v)]
        met[w] = len(own)
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, met[w], words[form[w]] if form[w] else None))
    return sorted(out)


def result(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_query_matches_sql(spark, sf_dir):
    assert assert_same(spark, connection(sf_dir), "op13", spelling.op13_spelling_variants, spelling.OP13_SQL, sf_dir) > 0


def test_query_matches_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert result(spelling.op13_spelling_variants(spark, sf_dir)) == brute(docs)


def variants(word, draw, n):
    letters = "abcdefghijklmnopqrstuvwxyzéÀ÷"
    for _ in range(n):
        i, kind = draw.randrange(len(word)), draw.randrange(3)
        yield word[:i] + ("" if kind == 0 else draw.choice(letters) + (word[i] if kind == 1 else "")) + word[i + 1 :]


@pytest.mark.parametrize("shard", [8192, 40])
def test_planted_variants_over_shards(spark, monkeypatch, shard):
    """Chains of forms, ties, anagrams and dense neighbourhoods, in one shard a length and in many."""
    monkeypatch.setattr(spelling, "SHARD", shard)
    monkeypatch.setattr(spelling, "LEAF", 8)
    monkeypatch.setattr(spelling, "SAMPLE_LEAF", 2)
    draw = random.Random(shard)
    words = ["".join(draw.choice("abcdeé") for _ in range(draw.randrange(6, 10))) for _ in range(60)]
    words += ["stream", "streams", "master", "maters", "tamers", "streak", "aaaaaa", "aaaaaaa", "aaaaaaaa", "AAAAAA", "Éaaaaa", "éaaaaa"]
    more = [v for w in words for v in variants(w, draw, 6)]
    texts = []
    for w in words + more:
        texts.append(" ".join([w] * draw.choice([4, 5, 6, 30, 180])))
    texts += [t + "-x" for t in texts[:20]]
    docs = list(enumerate(texts))
    want = brute(docs, typo=7)
    assert len(want) > 200 and any(r[2] not in (r[0], r[1]) for r in want)
    assert result(spelling.spelling_variants(documents(spark, texts).repartition(3), typo=7)) == want


def test_odd_rows(spark):
    texts = [*ODD, "y" * 200_000, None, *["straße naïve ÀÉÎõ×÷ straßé straße"] * 6, "StrasseıStrasse ퟿abcdef abcdef,abcdef abcdef 字abcdef"]
    ids = [None, *range(1, len(texts))]
    ids[-1] = ids[-2]
    want = brute(list(zip(ids, texts, strict=True)), typo=3)
    assert result(spelling.spelling_variants(documents(spark, texts, ids), typo=3)) == want
    assert result(spelling.spelling_variants(documents(spark, texts, ids))) == brute(list(zip(ids, texts, strict=True)), typo=None)
    assert spelling.spelling_variants(documents(spark, []).limit(0)).collect() == []
    assert spelling.spelling_variants(documents(spark, [None, "", "a b"])).collect() == []


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    texts = ["alphabet betagamma alphabet", "betagamma " * 3, "z" * 100 + " alphabet"] * 4
    monkeypatch.setattr(spelling, "HELD_WORDS", 1)
    assert sorted(map(tuple, spelling.word_counts(documents(spark, texts)).collect())) == [("alphabet", 12), ("betagamma", 16), ("z" * 100, 4)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abcdé", min_size=1, max_size=7), min_size=1, max_size=40, unique=True), st.integers(1, 6), st.integers(1, 5))
def test_trees_find_all_within_reach(words, leaves, leaf):
    x, length = spelling.letter_counts(words)
    router = object.__new__(spelling.Router)
    router.nodes, router.leaves = [], 0
    before = spelling.SAMPLE_LEAF, spelling.LEAF
    spelling.SAMPLE_LEAF, spelling.LEAF = 1, leaf
    try:
        router._grow(x, leaves)
        home = dict(zip(*(c.tolist() for c in router.reach(x, 0)), strict=True))
        assert sorted(home) == list(range(len(words)))
        for radius in (1, 2):
            reached = set(zip(*(c.tolist() for c in router.reach(x, radius)), strict=True))
            gap = np.abs(x[:, None, :] - x[None, :, :]).sum(axis=2)
            assert all((i, home[j]) in reached for i, j in zip(*np.nonzero(gap <= radius), strict=True))
            found = sorted((i, j) for a, b in spelling.Box(x).near(x, radius) for i, j in zip(a.tolist(), b.tolist(), strict=True) if abs(length[i] - length[j]) == 2 - radius)
            want = sorted((i, j) for i, j in zip(*(c.tolist() for c in np.nonzero(gap == radius)), strict=True) if abs(length[i] - length[j]) == 2 - radius)
            assert found == want
    finally:
        spelling.SAMPLE_LEAF, spelling.LEAF = before


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=1, max_size=6), st.text("ab", min_size=1, max_size=7))
def test_letter_order(a, b):
    codes = lambda w: np.frombuffer(w.encode(), np.uint8)[None, :]
    if len(a) == len(b):
        assert spelling.one_replaced(codes(a), codes(b))[0] == near(a, b)
    if len(b) == len(a) + 1:
        assert spelling.one_inserted(codes(a), codes(b))[0] == near(a, b)
