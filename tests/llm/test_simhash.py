import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import simhash
from tests.llm.cases import ODD, documents


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, cur = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += c
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_groups(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return [low[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("text", ODD)
def test_fingerprint(text):
    if text and len(text) > 100000:
        text = text[:9000]
    assert simhash.fingerprint(text or "") == brute_print(text)


def test_groups_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in simhash.op6_simhash_groups(spark, sf_dir).collect()}
    src = docs.select("doc_id", "text").orderBy("doc_id").collect()
    prints = [brute_print(r.text) for r in src]
    groups = brute_groups([r.doc_id for r in src], prints)
    assert len(rows) == len(src)
    for r, p, g in zip(src, prints, groups, strict=True):
        assert rows[r.doc_id].fingerprint == f"{p:016x}" and rows[r.doc_id].component_id == g


def test_odd_rows(spark):
    docs = documents(spark, [*ODD, "extra"], [*range(len(ODD)), None])
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(ODD) + 1
    by = {r.doc_id: r.component_id for r in got}
    assert by[0] == by[1] == by[2] == 0 and by[11] == by[12] == by[10] == 10 and by[None] is None
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and {0, 10, None} <= {r.doc_id for r in kept.collect()}
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_survivors_are_rows(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = documents(spark, [a, b, b, a, c, c, a], [1, 1, 0, None, None, None, 2])
    got = sorted((str(r.doc_id), r.text[0]) for r in simhash.drop_near_copies(docs).collect())
    assert got == [("0", "b"), ("1", "a"), ("None", "c")]


@pytest.mark.parametrize("block", [3, 2048])
def test_links_in_blocks(spark, block):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    prints = set()
    for b in base:
        for _ in range(40):
            x = int(b)
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(bit)
            prints.add(x)
    prints = sorted(prints)
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    found = simhash.links(frame, 3, block).collect()
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        a, b = (find(int(np.int64(v).view(np.uint64))) for v in (r.a, r.b))
        root[max(a, b)] = min(a, b)
    assert [find(p) for p in prints] == brute_groups(prints, prints)
    if block == 2048:
        assert len(found) < len(prints) * 130


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=60, unique=True), st.integers(1, 3))
def test_layout_is_complete(values, flips):
    sample = np.array(values, np.uint64)
    masks = simhash.layout(sample, 10**9)
    x = values[0]
    y = x
    for b in range(flips):
        y ^= 1 << (x * 7 + b * 13) % 64
    assert any(x & m == y & m for m in masks)


def test_any_column_names_pass_through(spark):
    docs = documents(spark, ["one two three four", "one two three four", "other words here now"], [3, 1, 2])
    docs = docs.withColumns({"row": docs.id, "_row": docs.id, "fp": docs.id, "component_id": docs.id, "none": docs.id})
    got = simhash.drop_near_copies(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 2]
    assert simhash.near_groups(docs).count() == 3
