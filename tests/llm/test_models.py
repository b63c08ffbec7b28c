import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from attesta.llm import common, language, quality
from tests.llm.cases import ODD, documents


def test_language_query(spark, sf_dir):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in language.op3_language_id(spark, sf_dir).collect()}
    assert got.keys() == truth.keys()
    held = [r for r in got.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def brute_scores(model, text):
    total = np.zeros(len(model.langs))
    low = text.lower()
    words, cur = [], ""
    for c in low + " ":
        if c.isalpha():
            cur += c
        elif cur:
            words.append(cur)
            cur = ""
    for w in words:
        one = language.Letters([w])
        at = np.flatnonzero(model.words == one.hash[0])
        if len(at):
            total += model.word_scores[at[0]]
            continue
        for n in (4, 3, 2, 1):
            keys = [int.from_bytes(w[i : i + n].encode("utf-16-le"), "little") for i in range(len(w) - n + 1)]
            table = {int(k): s for k, s in zip(*model.grams[n], strict=True)}
            if hits := [table[k] for k in keys if k in table]:
                total += np.mean(hits, axis=0)
                break
    return total


def test_backoff_matches_brute_force():
    texts = ["the cat sat on the mat the cat", "le chat est sur le tapis le chat", "der hund ist auf der matte"] * 3
    model = language.fit(texts, ["en", "fr", "de"] * 3)
    tries = ["the cats chaton hundert zzz", "déjà vu über x", "matte"]
    got = model.scores(language.Letters(tries), 3)
    assert np.allclose(got, [brute_scores(model, t) for t in tries], atol=1e-4)


def test_language_odd_rows(spark):
    docs = documents(spark, [*ODD, "123 😀 !!"])
    model = language.fit(["the cat sat on the mat"] * 3, ["en"] * 3)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in range(4)] == ["und", "und", "und", "en"] and got[len(ODD)].lang_pred == "und"
    assert language.identify(docs.limit(0), model).count() == 0
    none = language.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}


def auroc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_quality_query(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = {r.doc_id: r for r in quality.op4_quality_classifier(spark, sf_dir).collect()}
    held = [r for r in got.values() if r.held_out and truth.get(r.doc_id) is not None]
    assert {r.doc_id for r in got.values() if r.held_out} == {i for i in got if zlib.crc32(str(i).encode()) % 3 == 1}
    score, label = np.array([r.score for r in held]), np.array([truth[r.doc_id] for r in held])
    assert auroc(score, label) > 0.9 and np.mean((score >= 0.5) == label) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_quality_odd_rows(spark):
    docs = documents(spark, ODD)
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(ODD) and all(np.isfinite(r.score) for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[0] == by[1] == by[2] and by[10] == by[11]
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}
    assert quality.score(docs.limit(0), model).count() == 0
    blank = quality.train(docs, labels.limit(0))
    assert all(r.score == 0.5 for r in quality.score(docs, blank).collect())


def test_temperature_recovers_scale():
    rng = np.random.default_rng(0)
    logits = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-logits))).astype(float)
    assert 2.5 < quality._temperature(logits * 3, y) < 3.6


def test_taken_names_are_replaced(spark):
    docs = documents(spark, ["the cat", None]).withColumns({"score": F.lit("mine"), "Lang_Pred": F.lit(1), "predicted": F.lit("x")})
    got = language.identify(docs, language.fit(["the cat sat on the mat"] * 3, ["en"] * 3))
    assert got.columns == [*(c for c in docs.columns if c not in ("score", "Lang_Pred")), "lang_pred", "score"]
    assert [r.lang_pred for r in got.orderBy("doc_id").collect()] == ["en", "und"]
    scored = quality.score(docs, quality.fit(["good words here", "BAD!!!"] * 5, [1, 0] * 5))
    assert scored.columns == [*(c for c in docs.columns if c not in ("score", "predicted")), "score", "predicted"]
    assert dict(scored.dtypes)["score"] == "double"


def test_small_shares_draw_bounded_samples(spark):
    rows = spark.range(200_000).select(F.col("id").cast("string").alias("id"), F.lit("four").alias("text"), F.when(F.col("id") % 1000 == 0, "rare").otherwise("often").alias("lang"))
    # what a share of 1e-9 draws of 2e5 rows is what it draws of each 2e5 among 2e14: the hashes below it
    place = rows.select(F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "id", "text"), 1).alias("p"))
    for share in (1e-3, 1e-7, 1e-9):
        assert rows.filter(common.drawn(share, "id", "text")).count() == place.filter(F.col("p") < int(share * 2**63)).count()
        assert int(share * 2**63) > 9e9
    assert place.filter(F.col("p") < int(1e-3 * 2**63)).count() > 100
    found = common.bounded_sample(rows, "id", "text", 600, 10**9, "lang").groupBy("lang").count().collect()
    count = {r.lang: r["count"] for r in found}
    assert count["rare"] == 200 and 300 < count["often"] < 550
    tight = common.bounded_sample(rows, "id", "text", 10**6, 4000).count()
    assert 700 < tight < 1300
    hot = spark.range(50_000).select(F.lit("1").alias("id"), F.lit("same").alias("text"))
    assert common.bounded_sample(hot, "id", "text", 100, 10**9).count() <= 125
    assert common.fair_parts([10, 1000, 50], 100) == [10, 45, 45]


def test_a_rare_language_stays_learnable(spark):
    often = [(str(i), f"the cat sat on mat number {'abcdefgh'[i % 8]}", "en") for i in range(3000)]
    rare = [(f"r{i}", "der hund ist auf der matte", "de") for i in range(6)]
    docs = spark.createDataFrame(often + rare, "doc_id string, text string, lang string")
    model = language.train(docs, rows=60)
    assert language.predict(model, ["der hund", "the cat"])[0] == ["de", "en"]


def brute_fit(texts, langs):
    """log((count + smooth) / total) of the words and n-grams met often enough, by language."""
    names = sorted(set(langs))
    words, grams = Counter(), {n: Counter() for n in range(1, 5)}
    for t, x in zip(texts, langs, strict=True):
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            words[w, x] += 1
            for n in grams:
                for i in range(len(w) - n + 1):
                    grams[n][w[i : i + n], x] += 1

    def table(counts):
        keys = {k for k, _ in counts}
        total = {x: sum(counts[k, x] for k in keys) + language.SMOOTH * len(keys) for x in names}
        return {k: [np.log((counts[k, x] + language.SMOOTH) / total[x]) for x in names] for k in keys if sum(counts[k, x] for x in names) >= language.MIN_COUNT}

    return table(words), {n: table(c) for n, c in grams.items()}


def test_fit_matches_brute_force():
    texts = ["the cat sat on the mat the cat", "le chat est sur le tapis le chat déjà", "der hund ist auf der matte über", "the end"] * 4
    langs = ["en", "fr", "de", "en"] * 4
    model = language.fit(texts, langs)
    words, grams = brute_fit(texts, langs)
    assert len(words) == len(model.words)
    for w, want in words.items():
        at = np.flatnonzero(model.words == language.Letters([w]).hash[0])
        assert np.allclose(model.word_scores[at[0]], want, atol=1e-5)
    for n, table in grams.items():
        known = dict(zip(model.grams[n][0].tolist(), model.grams[n][1], strict=True))
        assert len(known) == len(table)
        for g, want in table.items():
            assert np.allclose(known[int.from_bytes(g.encode("utf-16-le"), "little")], want, atol=1e-5)


def brute_tokens(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff \t-\r]+", text.encode())


def brute_row(token):
    units = common.padded(token)
    return int(common.span_hash(units, np.array([0]), np.array([len(token)]))[0] % np.uint64(quality.ROWS))


def brute_shape(token):
    n = len(token)
    if not re.match(rb"[0-9A-Za-z\x80-\xff]", token):
        c = token[:1]
        mark = 0 if c in b".," else 1 if c in b"!?" else 2 if c in b"\"'()-:;" else 3
        return 6 + 3 * mark + min(n, 3) - 1
    upper, first = len(re.findall(rb"[A-Z]", token)), token[:1].isupper()
    if re.search(rb"[0-9]", token):
        return 4
    if not upper:
        return 0
    if upper == n:
        return 3 if n == 1 else 2
    return 1 if first and upper == 1 else 5


def brute_features(vectors, text):
    tokens = brute_tokens(text)
    if not tokens:
        return np.zeros(quality.DIMS + 1 + quality.SHAPES)
    mean = np.mean([vectors[brute_row(t)].astype(float) for t in tokens], axis=0)
    shapes = np.zeros(quality.SHAPES)
    for i, t in enumerate(tokens):
        shapes[brute_shape(t)] += 1
        for k in (1, 2):
            if i >= k and tokens[i - k] == t and re.match(rb"[0-9A-Za-z\x80-\xff]", t):
                shapes[quality.SHAPES - 3 + k] += 1
    return np.concatenate((mean, [np.linalg.norm(mean)], np.sqrt(shapes / len(tokens))))


QUALITY_TEXTS = ["The cat sat, on the the Mat!", "BUY now!!! A1 b2 $$$ a a a", "", "   ", "é ü McDonald's (x-y) ... 中文 WOW ??", "word " * 300]


def test_vectors_and_pooling_match_brute_force():
    index = quality.index_vectors()
    rows = [[brute_row(t) for t in brute_tokens(x)] for x in QUALITY_TEXTS]
    seen = Counter(r for x in rows for r in x)
    context = {r: np.zeros(quality.DIMS) for r in seen}
    for x in rows:
        for i, r in enumerate(x):
            for j in range(max(0, i - quality.NEAR), min(len(x), i + quality.NEAR + 1)):
                if j != i:
                    context[r] += index[x[j]] / np.sqrt(1 + seen[x[j]])
    got = quality.word_vectors([quality.Tokens(QUALITY_TEXTS[:3]), quality.Tokens(QUALITY_TEXTS[3:])])
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    for r in seen:
        assert np.allclose(got[r], unit(unit(index[r].astype(float)) + unit(context[r])), atol=1e-4)
    features = quality.pooled(got, quality.Tokens(QUALITY_TEXTS), len(QUALITY_TEXTS))
    assert np.allclose(features, [brute_features(got, t) for t in QUALITY_TEXTS], atol=1e-5)


def test_network_steps_match_numeric_gradients(monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 3)
    monkeypatch.setattr(quality, "HIDDEN", 3)
    rng = np.random.default_rng(5)
    x, y = rng.normal(0, 1, (12, 4)), (np.arange(12) % 2).astype(float)
    got = quality._network(x, y)
    rng = np.random.default_rng(quality.SEED)
    flat = np.concatenate([rng.normal(0, 0.5, 12), np.zeros(3), rng.normal(0, 1 / np.sqrt(3), 3), np.zeros(1)])

    def loss(p):
        w1, b1, w2, b2 = p[:12].reshape(4, 3), p[12:15], p[15:18], p[18]
        total = 0.0
        for row, label in zip(x, y, strict=True):
            z = sum(w2[h] * np.tanh(sum(row[i] * w1[i, h] for i in range(4)) + b1[h]) for h in range(3)) + b2
            total += np.log1p(np.exp(-z)) if label else np.log1p(np.exp(z))
        return total / len(y) + quality.DECAY / 2 * ((w1**2).sum() + (w2**2).sum())

    m, v = np.zeros(19), np.zeros(19)
    for step in (1, 2, 3):
        grad = np.array([(loss(flat + e) - loss(flat - e)) / 2e-6 for e in np.eye(19) * 1e-6])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        flat = flat - quality.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    assert np.allclose(np.concatenate([p.ravel() for p in got]), flat, atol=1e-4)


def test_word_vectors_alone_tell_quality(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = quality.train(docs, labels.filter(~held), shapes=False)
    rows = docs.join(labels.filter(held), "doc_id").select("text", "quality").dropna().collect()
    value = auroc(model.scores([r.text for r in rows]), np.array([r.quality for r in rows]))
    print(f"AUROC of word vectors alone: {value:.4f}")
    assert value > 0.9
