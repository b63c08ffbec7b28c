import hashlib
import random
import re
import time

import numpy as np

from attesta.llm import decontaminate
from tests.llm.cases import ODD, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, window=10):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault((n, tuple(w[k : k + n])), set()).update([] if i is None else [str(i)])
    sizes = {n for n, _ in grams}
    out = []
    for t in texts:
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (who := grams.get((n, tuple(w[k : k + n])))) is not None:
                    hit |= set(range(k, k + n))
                    found |= who
        ids = ",".join(sorted(found))
        out.append((len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def rows(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = rows(decontaminate.op5_decontamination(spark, sf_dir))
    want = brute([r.text for r in docs], items)
    assert len(got) == len(docs) and any(w[4] for w in want)
    assert all(got[r.doc_id] == w for r, w in zip(docs, want, strict=True))


ITEMS = [(1, "the cat sat on the mat"), (2, None), (3, ""), (4, "ß"), (5, "a b c d e f g h i j k l"), (6, "word word word"), (5, "a b c d e f g h i j k l"), (10, "THE cat, sat on the mat"), (None, "tab and vt"), (None, "one two"), (7, "one two")]
TEXTS = [*ODD, "x a b c d e f g h i j y", "a b c d e f g h i j k l m a b c d e f g h i j", "c d e f g h i j k l", "b c d e f g h i j"]


def test_odd_rows(spark):
    docs = documents(spark, TEXTS)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute(TEXTS, ITEMS)
    got = rows(decontaminate.contamination(docs, bench))
    assert [got[i] for i in range(len(TEXTS))] == want
    several = rows(decontaminate.contamination(docs, bench, pass_bytes=20))
    assert several == got
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, w in enumerate(want) if not w[4]]
    assert rows(decontaminate.contamination(docs.limit(0), bench)) == {}
    assert all(not v[4] for v in rows(decontaminate.contamination(docs, bench.limit(0))).values())


def brute_matches(text, items, window=10):
    """{place: (words of the longest window there, words of the longest match with any item from there)}."""
    w, size, longest = words(text), {}, {}
    for _, t in items:
        v = words(t)
        n = min(window, len(v))
        for j in range(len(v)):
            for k in range(len(w)):
                m = 0
                while k + m < len(w) and j + m < len(v) and w[k + m] == v[j + m]:
                    m += 1
                longest[k] = max(longest.get(k, 0), m)
                if m >= n and j + n <= len(v):
                    size[k] = max(size.get(k, 0), n)
    return {k: (n, longest[k]) for k, n in size.items()}


def check_matches(found, texts, items):
    of = {}
    for i, t in items:
        of.setdefault(None if i is None else str(i), []).append(words(t))
    for r in found:
        w = words(texts[r.doc_id])
        assert {m.at: (m.words, m.longest) for m in r.matches} == brute_matches(texts[r.doc_id], items)
        for m in r.matches:
            assert any(v[m.item_at : m.item_at + m.longest] == w[m.at : m.at + m.longest] for v in of[m["item"]])


def test_longest_matches(spark):
    docs = documents(spark, TEXTS)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    check_matches(decontaminate.contamination(docs, bench, matches=True).collect(), TEXTS, ITEMS)
    check_matches(decontaminate.contamination(docs, bench, matches=True, pass_bytes=20).collect(), TEXTS, ITEMS)


def test_long_and_repeated_matches():
    random.seed(6)
    long = [random.choice("abcd") + random.choice("xyz") for _ in range(400)]
    items = [(str(i), " ".join(long[10 * i : 10 * i + random.randint(10, 90)])) for i in range(25)] + [("r", "p q " * 30), ("s", "p q p q p q"), ("t", "ax")]
    texts = [" ".join(long), " ".join(long[55:230] + ["other"] + long[:40]), "p q " * 80, " ".join(long[300:] * 2), "q p q p q p", "zz", " ".join(long)]
    got = decontaminate._search([t.encode() for t in texts], decontaminate.TestSet(items, 10), True)
    want = brute(texts, items)
    for k, t in enumerate(texts):
        ids = got[2].get(k, [])
        assert (got[0][k], got[1][k], len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()) == want[k][:4]
        assert {m["at"]: (m["words"], m["longest"]) for m in got[3].get(k, [])} == brute_matches(t, items)


def test_suffixes_are_in_order():
    random.seed(7)
    text = " ".join(random.choice("abc") for _ in range(2000)) + " a b c" * 200
    tests = decontaminate.TestSet([("1", text), ("2", "a b c a b c")], 10)
    v = [words(text), words("a b c a b c")]
    rank = {w: i for i, w in enumerate(sorted({x for y in v for x in y}, key=lambda w: int(tests.numbers(decontaminate.Words([w.encode()]))[0])))}
    suffix = lambda p: [rank[x] for x in (v[0][p:] if p < len(v[0]) else v[1][p - len(v[0]) :])]
    found = [suffix(p) for p in tests.array.tolist()]
    assert found == sorted(found) and len(found) == len(v[0]) + len(v[1])


def test_words_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(decontaminate, "span_hash", lambda units, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(2))
    found = decontaminate._search([b"x one two six y", b"one too six"], decontaminate.TestSet([("1", "one two six"), ("2", "too")], 10))
    assert found[1].tolist() == [3, 1] and found[2] == {0: ["1"], 1: ["2"]}


def test_many_items_of_one_word():
    items = [(str(i), "the") for i in range(2000)]
    start = time.perf_counter()
    n, hit, named, where = decontaminate._search([b"the " * 2000, b"them"], decontaminate.TestSet(items, 10), True)
    assert time.perf_counter() - start < 1
    assert hit.tolist() == [2000, 0] and len(named[0]) == 2000 and len(where[0]) == 2000
