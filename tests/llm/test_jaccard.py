import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attesta.llm import jaccard, simhash
from tests.llm.cases import ODD, documents


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_links(texts):
    sets = [brute_set(t) for t in texts]
    near = lambda a, b: a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)) > 0
    return [(i, j) for i in range(len(texts)) for j in range(i) if near(sets[i], sets[j])]


def brute_roots(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in brute_links(texts):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_stage_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    roots = brute_roots([r.text for r in rows])
    got = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, sf_dir).collect()}
    assert got == {rows[i].doc_id for i in set(roots)}


def test_edited_copies_are_found(spark, sf_dir):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for k in range(40):
        base = [draw.choice(words) for _ in range(120)]
        edited = list(base)
        for i in draw.sample(range(120), 1 + k % 6):
            edited[i] = "changed"
        texts += [" ".join(base), " ".join(edited)]
    docs = documents(spark, texts)
    roots = set(brute_roots(texts))
    assert 40 < len(roots) < 80
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, sf_dir).collect()} == roots


def edits(n, most):
    """Texts of 300 words and copies with 1 to ``most`` words changed."""
    draw, texts = random.Random(5), []
    for k in range(n):
        base = [f"w{draw.randrange(3000)}" for _ in range(300)]
        copy = list(base)
        for i in draw.sample(range(300), 1 + k % most):
            copy[i] = "changed"
        texts += [" ".join(base), " ".join(copy)]
    return texts


def test_fingerprints_are_searched_within_the_radius(spark):
    texts = edits(40, 12)
    sets = [jaccard.shingles(t) for t in texts]
    prints = [simhash.majority(s) for s in sets]
    near = {(i, j) for j in range(len(texts)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= jaccard.RADIUS}
    signed = spark.createDataFrame([(i, len(s), p - (1 << 64) if p >> 63 else p) for i, (s, p) in enumerate(zip(sets, prints, strict=True))], "row long, size long, fp long")
    keys = {r.node: r.key for r in jaccard.alike(signed).collect()}
    assert len(near) >= 10 and {(i, j) for j in keys for i in range(j) if keys[i] == keys[j]} == near


def test_fingerprints_alone_find_near_copies(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(jaccard, "bands", lambda values: [])
    texts = [*edits(12, 1), *(f"a text of few words {i % 3}" for i in range(6))]
    roots = set(brute_roots(texts))
    assert len(roots) == 15
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, documents(spark, texts), sf_dir).collect()} == roots


@pytest.mark.parametrize("block", [2, 2048])
def test_large_groups_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    chain = [" ".join(f"w{i}" for i in range(k * 4, k * 4 + 60)) for k in range(12)]  # only neighbours are near
    texts = [*chain, *(" ".join([*chain[0].split(), f"x{k}"]) for k in range(10)), *(f"other text number {k} of its own kind" for k in range(5))]
    roots = set(brute_roots(texts))
    assert {r.doc_id for r in jaccard.drop_near_copies(documents(spark, texts)).collect()} == roots and len(roots) == 6


def test_odd_rows(spark):
    docs = documents(spark, ODD)
    kept = jaccard.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(brute_roots(ODD))
    assert jaccard.drop_near_copies(docs.limit(0)).count() == 0


def test_repeated_and_null_ids(spark, sf_dir):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = documents(spark, [a, b, b, a, c, c, a], [1, 1, 0, None, None, None, 2]).withColumn("source", F.lit("x"))
    got = sorted((str(r.doc_id), r.text[0]) for r in corpus_pipeline.near_dedup_stage(spark, docs, sf_dir).collect())
    assert got == [("0", "b"), ("1", "a"), ("None", "c")]


@pytest.mark.skipif(not os.environ.get("RECALL_SF_DIR"), reason="measures recall on a larger table")
def test_recall(spark):
    rows = spark.read.parquet(f"{os.environ['RECALL_SF_DIR']}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    by: dict = {}
    for r in rows:
        by.setdefault(frozenset(brute_set(r.text)), r.text)
    sets, holders, found = list(by), {}, []
    for i, s in enumerate(sets):
        seen: dict = {}
        for x in s:
            for j in holders.setdefault(x, []):
                seen[j] = seen.get(j, 0) + 1
            holders[x].append(i)
        found += [(i, j) for j, n in seen.items() if 9 * n >= 4 * (len(s) + len(sets[j]))]
    keys = [set(jaccard.bands(jaccard.shingles(t)).tolist()) if t else set() for t in by.values()]
    hit = sum(bool(keys[i] & keys[j]) for i, j in found)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in found:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    want = len({find(i) for i in range(len(sets))})
    docs = spark.read.parquet(f"{os.environ['RECALL_SF_DIR']}/documents.parquet")
    got = jaccard.drop_near_copies(docs).count()
    print(f"pairs of distinct texts at 0.8 {len(found)}, with a band in common {hit}; groups {want}, kept {got}; rows {len(rows)}")
    assert hit >= 0.999 * len(found) and got == want


def test_any_column_names_pass_through(spark):
    docs = documents(spark, ["one two three four five six", "one two three four five six", None], [3, 1, 2])
    docs = docs.withColumns({"row": docs.id, "_row": docs.id, "doc": docs.id, "hash": docs.id, "root": docs.id, "a.b": docs.id})
    got = jaccard.drop_near_copies(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 2]
