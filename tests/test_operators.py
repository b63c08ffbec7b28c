"""Edge cases of the operators, and properties that hold on any input."""

import difflib
import hashlib
import itertools
import json
import math
import random
import re
import time
import uuid
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesta.functions import draws
from attesta.functions import statistics as stats
from attesta.operators import bootstrap as boot
from attesta.operators import compare as cp
from attesta.operators import design as ds
from attesta.operators import diagnostics as dg
from attesta.operators import facts as fx
from attesta.operators import indicators as ind
from attesta.operators import ranking as rk
from attesta.operators import ratings as rt
from attesta.operators import runlog as rl
from attesta.operators import scan
from attesta.operators import selection as sl
from attesta.operators import text as tx
from attesta.operators import verify as vf
from attesta.sources import io

RAW = "row_id long, student_id long, skill string, correct int, start_time double, end_time double, time_taken double, hint_count double, attempt_count double, confused double, concentrating double, bored double, frustrated double"


def log(spark, rows):
    return spark.createDataFrame(rows, RAW)


def test_ties_and_missing_starts(spark):
    rows = [(2, 1, "a", 1, 5.0, 9.0, 4.0, 0.0, 1.0, 0.1, 0.1, 0.1, 0.1), (1, 1, "a", 0, 5.0, 6.0, None, 1.0, 1.0, None, 0.1, 0.1, 0.1), (3, 1, "a", 1, None, 1.0, 9999.0, 0.0, 1.0, 0.1, 0.1, 0.1, 0.1), (4, 2, None, 1, 1.0, 2.0, 1.0, 0.0, 1.0, 0.1, 0.1, 0.1, 0.1), (5, 3, "b", 2, 1.0, 2.0, 1.0, 0.0, 1.0, 0.1, 0.1, 0.1, 0.1)]
    out = {r.row_id: r for r in ind.indicator_table(log(spark, rows)).collect()}
    assert set(out) == {1, 2, 3}
    assert [out[i].step_idx for i in (1, 2, 3)] == [0, 1, 2]
    assert out[2].lag_time == 0 and out[3].lag_time == 0 and out[3].elapsed_time == 3600 and out[1].elapsed_time == 0
    assert out[1].skill_cum_accuracy is None and out[2].skill_cum_accuracy == 0 and out[3].skill_cum_accuracy == 0.5


def test_constant_column_and_lone_skill(spark):
    rows = [(1, 1, "a", 1, 0.0, 1.0, 0.0, 2.0, 1.0, 0.2, 0.1, 0.1, 0.1)]
    r = ind.indicator_table(log(spark, rows)).first()
    assert r.hint_scaled == 0 and r.sc == 1 and r.response_time_ratio is None


@pytest.mark.parametrize("x,want", [(-1, 0), (0, 1), (59.9, 1), (60, 2), (1e9, 10)])
def test_digitize(spark, x, want):
    assert spark.range(1).select(ind.digitize(F.lit(float(x)), [0, 60, 300, 900, 1800, 3600, 10800, 86400, 259200, 604800])).first()[0] == want


def facts_of(spark, **m):
    row = {f"m_{k}": 0.0 for k in ("overconfidence", "underconfidence", "strategic_help", "cognitive_avoidance", "productive_struggle", "unproductive_frustration", "lucky_guess", "slipping", "boredom_offtask")}
    row |= {"row_id": 1, "hint_scaled": 1.0, "sc": 0.5} | {k if k in ("hint_scaled", "sc") else f"m_{k}": v for k, v in m.items()}
    df = spark.createDataFrame([row], ", ".join(f"{k} {'long' if k == 'row_id' else 'double'}" for k in row))
    return fx.symbolic_facts(df).first().facts


@pytest.mark.parametrize("m,want", [
    ({"underconfidence": 0.15, "productive_struggle": 0.15}, ("confidence_triad", "LOW")),
    ({"underconfidence": 0.2, "hint_scaled": 1e-6}, ("confidence_triad", "AMBIGUOUS")),
    ({"underconfidence": 0.2}, ("underconfidence", "HIGH")),
    ({"underconfidence": 0.3, "productive_struggle": 0.3, "lucky_guess": 0.3}, ("underconfidence", "HIGH")),
    ({"productive_struggle": 0.3, "lucky_guess": 0.3}, ("productive_struggle", "HIGH")),
])
def test_triad(spark, m, want):
    f = facts_of(spark, **m)[0]
    assert (f.indicator, f.status) == want


@pytest.mark.parametrize("sc,word", [(None, ""), (0.34, "guessing"), (0.35, "mid-range"), (0.65, "mid-range"), (0.66, "struggle")])
def test_triad_direction(spark, sc, word):
    f = facts_of(spark, underconfidence=0.2, hint_scaled=0.0, sc=sc)[0]
    assert f.value is None and f.note.rpartition("(lucky_guess).")[2].strip() == "" if not word else word in f.note.rpartition("(lucky_guess).")[2]


def test_simple_facts(spark):
    f = {x.indicator: x for x in facts_of(spark, overconfidence=0.51, slipping=0.6, strategic_help=0.5, boredom_offtask=0.15)}
    assert f["overconfidence"].status == f["slipping"].status == "HIGH" and "Instruction" in f["slipping"].note
    assert f["strategic_help"].status == "LOW" and "boredom_offtask" not in f


POINT = "\ue000"


def python_sentences(raw):
    text = re.sub(r"(?<=\d)\.(?=\d)", POINT, raw.strip())
    out = []
    for m in re.finditer(r"([^.!?]*[.!?])\s*((?:\[[^\]]+\]\s*)*)", text):
        s, t = m[1].strip().replace(POINT, "."), m[2].replace(POINT, ".")
        if s:
            tags = list(dict.fromkeys(re.findall(r"\[([^\]]+)\]", t) + re.findall(r"\[([^\]]+)\]", s)))
            out.append((re.sub(r"\s*\[[^\]]+\]\s*", " ", s).strip(), tags))
    return out


TEXTS = ["Value 0.840 is high. [a] Next! [b] [a] tail", "No mark at all", "", "  A [x] mid? [y, z][w]\n[v] End.", "foo. [a.b] bar", "1.2.3. ok... [t]", "[only tag]", "a. b] c [d"]


@pytest.mark.parametrize("raw", TEXTS)
def test_split_sentences(spark, raw):
    got = tx.split_cited_sentences(spark.createDataFrame([(raw,)], "raw_text string")).first().sentences
    assert [(s.text, s.cited) for s in got] == python_sentences(raw)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab 1.!?[]é\n,", max_size=30), min_size=1, max_size=8))
def test_split_sentences_any(spark, raws):
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw_text string")
    for r in tx.split_cited_sentences(df).collect():
        assert [(s.text, s.cited) for s in r.sentences] == python_sentences(raws[r.i]), raws[r.i]


def plain_kept(texts, cited, threshold):
    kept = []
    norm = lambda t: re.sub(r"[\s,.!?\"'~()\[\]]+", "", t)
    pairs = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}

    def near(a, b):
        x, y = pairs(norm(a)), pairs(norm(b))
        return bool(x and y) and len(x & y) / len(x | y) >= threshold

    for i, t in enumerate(texts):
        t = t.strip()
        if t and not any(t == texts[k].strip() or (set(cited[i]) & set(cited[k]) and near(t, texts[k].strip())) for k in kept):
            kept.append(i)
    return kept


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.text("abc .", max_size=12), st.lists(st.sampled_from("xyz"), max_size=2)), max_size=12), st.sampled_from([0.3, 0.6, 1.0]))
def test_dedupe(rows, threshold):
    texts, cited = [r[0] for r in rows], [r[1] for r in rows]
    kept = tx.kept_sentences(texts, cited, threshold)
    assert kept == plain_kept(texts, cited, threshold)
    again = tx.kept_sentences([texts[i] for i in kept], [cited[i] for i in kept], threshold)
    assert again == list(range(len(kept)))


def test_dedupe_query_matches_brute_force(spark, sf_dir):
    from attesta.plans import bindings as b

    split = tx.split_cited_sentences(b.narratives(spark, sf_dir)).select("narrative_id", "sentences")
    src = {r.narrative_id: r.sentences for r in split.collect()}
    for r in tx.dedupe_narrative(split).collect():
        s = src[r.narrative_id]
        want = plain_kept([x.text for x in s], [x.cited for x in s], 0.6)
        assert [x.text for x in r.sentences] == [s[i].text for i in want] and r.had_repetition == (len(want) < len(s))


def test_citation_repair(spark):
    valid = ["overconfidence", "slipping", "lucky_guess"]
    tags = ["Slipping", "lucky_gues", "over confidence", "xyz", "slipping, lucky-guess，SLIP", ""]
    df = spark.createDataFrame([(i, [t, "slipping"]) for i, t in enumerate(tags)] + [(99, [])], "i int, cited array<string>")
    got = {r.i: r.cited for r in tx.correct_citations(df, valid).collect()}
    for i, t in enumerate(tags):
        parts = [p.strip() for p in re.split("[,，、]", t) if p.strip()]
        fixed = [p if p in valid else (difflib.get_close_matches(p.lower(), valid, 1, 0.75) or [p])[0] for p in parts]
        assert got[i] == list(dict.fromkeys([*fixed, "slipping"]))
    assert got[99] == []


def test_text_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(tx.hedge_violation(F.lit("It was a guess"))) and not one(tx.hedge_violation(F.lit("It clearly may be")))
    assert one(tx.hedge_violation(F.lit("확실히 이해했다"), "ko")) and not one(tx.hedge_violation(F.lit("그럴 수 있다"), "ko"))
    assert one(tx.translation_suspect(F.lit(" "))) and one(tx.translation_suspect(F.lit("가나 abc"))) and not one(tx.translation_suspect(F.lit("가나 a")))
    assert one(tx.strip_echoed_bullets(F.lit("- [x] status=HIGH\nkeep\n - [y] status = LOW"))) == "keep"
    df = spark.createDataFrame([("a <think>b</think> c",), ("a <think>b",), (None,)], "t string")
    assert [(r.t, r.truncated_in_thinking) for r in tx.strip_thinking(df, "t").collect()] == [("a  c", False), ("", True), (None, False)]
    steps = tx.parse_steps(F.lit("[{'step': 1, 'correct': True, 'hint_count': 1, 'response_time_ratio': 0.5}]"))
    words = tx.record_premise(spark.range(1).select(steps.alias("steps"), F.lit("Sums").alias("skill"), F.lit(0.5).alias("skill_cum_accuracy"))).first().record_premise
    assert "accuracy on this skill was 50%." in words and "answered correctly, used 1 hint, and took 0.50 times" in words
    flags = tx.sentence_flags(spark.createDataFrame([("LOW value",), ("You should go",), ("漢",), ("가",), (None,)], "text string")).collect()
    assert [r.is_leaked for r in flags][:2] == [True, False] and flags[1].is_recommends and flags[2].is_foreign and flags[3].is_hangul and flags[4].is_leaked is None


def test_judge_json(spark):
    rows = ['x {"label": "Supported ", "confidence_supported": 90, "reasoning": "r"} y', '{"label": "other", "confidence_supported": "x"}', "none", "{bad}", None]
    got = tx.parse_judge_json(spark.createDataFrame([(r,) for r in rows], "t string"), "t").collect()
    assert [(r.pred_label, r.pred_confidence_supported, r.parse_failed) for r in got] == [("supported", 90.0, False), (None, None, False), (None, None, True), (None, None, True), (None, None, True)]


FACTS = "row_id long, pos int, indicator string, status string, value double, note string"


def test_verify_cited_cases(spark):
    facts = spark.createDataFrame([(1, 0, "a", "HIGH", 0.9, ""), (1, 1, "b", "AMBIGUOUS", None, ""), (2, 0, "a", "LOW", 0.2, "")], FACTS)
    s = spark.createDataFrame([(1, 0, "x", []), (2, 0, "x", []), (1, 1, "x", ["a", "zz"]), (1, 2, "it was a case", ["b"]), (1, 3, "half", ["a"]), (1, 4, "low", ["a", "b"]), (3, 0, "x", [])], "row_id long, pos int, text string, cited array<string>")
    got = {(r.row_id, r.pos): (r.status, r.score) for r in vf.verify_cited(s, facts, scorer=lambda p, c: [0.5 if t == "half" else 0.1 for t in c]).collect()}
    assert got == {(1, 0): ("FAIL_NO_CITATION", None), (2, 0): ("PASS_NO_SIGNAL", None), (3, 0): ("PASS_NO_SIGNAL", None), (1, 1): ("FAIL_INVALID_REF", None), (1, 2): ("FAIL_HEDGE", 0.1), (1, 3): ("PASS", 0.5), (1, 4): ("FAIL_NLI", 0.1)}
    best = {(r.row_id, r.pos): (r.status, r.matched_indicator) for r in vf.verify_best_match(s, facts, scorer=lambda p, c: [0.5] * len(c)).collect()}
    assert best[1, 0] == ("PASS_INFERRED", "a") and best[2, 0] == ("PASS_NO_SIGNAL", None)
    assert vf.verify_cited(s.limit(0), facts).count() == 0 and vf.verify_best_match(s, facts.limit(0)).filter("status = 'PASS_NO_SIGNAL'").count() == 7


def test_a_scorer_sees_each_distinct_pair_once(spark, tmp_path):
    folder = str(tmp_path)

    def scorer(premises, claims):
        assert len(premises) == len(claims) <= 8
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            json.dump(list(zip(premises, claims, strict=True)), f)
        return [len(p or "") - 10 * len(c or "") + (1000 if p is None else 0) for p, c in zip(premises, claims, strict=True)]

    draw = random.Random(6)
    pairs = [(draw.choice(["", None, "a", "ab", "x" * 50, "fact"]), draw.choice(["", None, "a", "ab", "longer claim", "fact"])) for _ in range(300)] + [("hot", "pair")] * 200
    df = spark.createDataFrame([(i, p, c, 0.5) for i, (p, c) in enumerate(pairs)], "id int, premise string, text string, score double").repartition(6)
    got = {r.id: r for r in vf.score_pairs(df, scorer, partitions=3, rows=8).collect()}
    assert len(got) == 500 and all(got[i].score == len(p or "") - 10 * len(c or "") + (1000 if p is None else 0) for i, (p, c) in enumerate(pairs))
    seen = [json.loads(f.read_text()) for f in tmp_path.iterdir()]
    assert sorted(map(str, (tuple(x) for batch in seen for x in batch))) == sorted(map(str, set(pairs)))
    lengths = [[len(p or "") + len(c or "") for p, c in batch] for batch in seen]
    assert all(x == sorted(x) for x in lengths)
    assert vf.score_pairs(df.limit(0), scorer).count() == 0


def test_run_log_edges(spark, tmp_path):
    runs = [
        {"condition": "full", "ITEST_id": 1, "step_idx": 0, "citation_required": True, "ground_truth_facts": ["[a] HIGH: x"], "sentences": [{"text": "t", "cited": []}], "verification": [{"text": "t", "status": "FAIL_NO_CITATION"}], "summary": {"n_sentences": 1, "faithfulness_rate": 0.0}},
        {"condition": "full", "ITEST_id": 2, "step_idx": 0, "error": "boom"},
        {"condition": "full", "ITEST_id": 3, "step_idx": 0, "truncated_in_thinking": True, "summary": {}},
    ]
    (tmp_path / "run_m_1.json").write_text(json.dumps(runs))
    raw = io.read_pipeline_log(spark, f"file://{tmp_path}/*.json")
    m = {r.ITEST_id: r for r in rl.interaction_metrics(raw).collect()}
    assert m[1].F == 0 and m[1].cF is None and m[1].SVR_stage3 == 1 and m[1].has_citable and m[2].F is None and m[2].error and m[3].truncated
    assert rl.valid_rows(rl.interaction_metrics(raw)).count() == 1
    assert raw.select("model").first()[0].startswith("run_m")
    a = rl.citation_audit(raw).first()
    assert (a.n_uncited, a.n_invalid, a.SVR_uncited) == (1, 0, 1.0)


def brute_auroc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 6)), min_size=1, max_size=40))
def test_auroc_is_pair_counting(spark, rows):
    df = spark.createDataFrame([(1, y, s / 7, -s / 7) for y, s in rows], "g int, y boolean, s double, t double")
    got = rk.auroc(df, ["g"], "y", "s").first()
    want = brute_auroc([(y, s / 7) for y, s in rows])
    assert (got.auroc is None) == (want is None) and (want is None or abs(got.auroc - want) < 1e-12)
    turned = rk.auroc(df, ["g"], "y", "t").first().auroc
    assert want is None or abs(turned - (1 - want)) < 1e-12
    weighted = rk.auroc(df.withColumn("w", F.lit(1)), [], "y", "s", "w").first().auroc
    assert weighted == got.auroc


def test_auroc_leaves_nulls_out(spark):
    df = spark.createDataFrame([(1, True, 0.5), (1, False, 0.5), (1, None, 0.9), (1, True, None), (2, True, 0.1)], "g int, y boolean, s double")
    got = {r.g: r.auroc for r in rk.auroc(df, ["g"], "y", "s").collect()}
    assert got == {1: 0.5, 2: None}


def test_sweep_on_grid_points(spark):
    df = spark.createDataFrame([(True, 0.5, "PASS"), (False, 0.5, "FAIL_HEDGE"), (False, 0.3, "FAIL_NLI"), (True, None, "PASS_NO_SIGNAL")], "label boolean, score double, status string")
    sweep = {r.threshold: r for r in rk.threshold_sweep(df, [], status="status").collect()}
    assert sweep[0.5].tp == 1 and sweep[0.55].tp == 0 and sweep[0.55].precision is None and all(r.tp + r.fn == 1 for r in sweep.values())
    what = {r.threshold: r for r in rk.whatif_sweep(df, []).collect()}
    assert what[0.95].tp == 1 and what[0.5].pass_rate == 0.5


def test_bootstrap_edges(spark):
    df = spark.createDataFrame([(1, True, 0.9), (1, True, 0.8), (2, False, 0.1)], "c int, y boolean, s double")
    r = boot.cluster_auroc_ci(df, [], "c", "y", "s", 50, 3).first()
    assert r.auroc == 1 and r.n_skipped > 0 and r.ci_lo == 1 and r.n_clusters == 2
    w = boot.cluster_weights(df, "c", 40, 3)
    assert {x[0] for x in w.groupBy("rep").agg(F.sum("w")).select(F.col("sum(w)")).collect()} == {2}
    p = boot.cluster_weights(df, "c", 400, 3, method="poisson").agg(F.sum("w")).first()[0]
    assert 700 < p < 900
    assert boot.cluster_weights(df.limit(0), "c", 5, 3).count() == 0


def brute_weighted(rows):
    """Pairs of a positive and a negative, by weight."""
    wins = total = 0.0
    for _, y, s, w in rows:
        for _, z, t, v in rows:
            if y and not z:
                total += w * v
                wins += w * v * (1.0 if s > t else 0.5 if s == t else 0.0)
    return wins / total if total else None


@pytest.mark.parametrize("method,task_rows,block", [("multinomial", None, 1 << 18), ("multinomial", 7, 1 << 18), ("multinomial", None, 4), ("multinomial", 7, 2), ("poisson", 7, 4)])
def test_resamples_match_brute_force(spark, monkeypatch, method, task_rows, block):
    draw = random.Random(5)
    rows = [(g, f"c{draw.randrange(9)}", draw.random() < 0.5, draw.choice([0.0, 0.0, 0.0, 0.25, 0.5, 0.75, 1.0, 1.0])) for g in (1, 2) for _ in range(45)]
    df = spark.createDataFrame(rows, "g int, c string, y boolean, s double")
    if task_rows:
        monkeypatch.setattr(boot, "TASK_ROWS", (task_rows, task_rows))
    r = boot.Resamples(df, "c", 12, 3, method, block)
    weights = {}
    for x in boot.cluster_weights(df, "c", 12, 3, method, block).collect():
        weights.setdefault(x.rep, {})[x.c] = x.w
    assert method == "poisson" or all(sum(w.values()) == r.n for w in weights.values())
    got = {(x.g, x.rep): x.auroc for x in boot._replicates(df, ["g"], r, "y", "s", boot._sized(df, ["g"])).collect()}
    want = {(g, rep): brute_weighted([(c, y, s, weights[rep].get(c, 0)) for h, c, y, s in rows if h == g]) for g in (1, 2) for rep in range(12)}
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx({k: v for k, v in want.items() if v is not None})
    sums = {(x.g, x.rep): x.v for x in boot.resampled_sums(df.withColumn("v", F.col("s") + 1), ["g"], r, ["v"]).collect()}
    total = {(g, rep): sum((s + 1) * weights[rep].get(c, 0) for h, c, _, s in rows if h == g) for g in (1, 2) for rep in range(12)}
    assert {k: v for k, v in sums.items() if v} == pytest.approx({k: v for k, v in total.items() if v})


def chi_square(found, want):
    """The statistic over its expectation, for counts whose expected numbers are large enough."""
    kept = want > 5
    return ((found - want)[kept] ** 2 / want[kept]).sum() / (kept.sum() - 1)


@pytest.mark.parametrize("n,p", [(7, 0.3), (60, 0.6), (2000, 0.004), (2000, 0.4), (100_000, 0.25)])
def test_binomial_law(n, p):
    k = np.arange(100_000, dtype=np.uint64) * np.uint64(7919)
    m, b = draws.numbers(3, 5, k), draws.numbers(11, 17, k)
    found = draws.binomial(np.full(len(k), n), p, m, b)
    chance = np.array([math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(n + 1)])
    width = max(1, int(math.sqrt(n * p * (1 - p)) / 4))
    assert chi_square(np.bincount(found // width, minlength=n // width + 1), np.bincount(np.arange(n + 1) // width, chance) * len(k)) < 2
    assert (draws.binomial(np.full(len(k), n), p, m, b) == found).all()


def test_split_draws():
    """A range drawn alone is that of the whole; the weights have the law of those drawn in one range."""
    n, reps = 4000, range(60)
    whole = np.stack([draws.multinomial(r, 9, n, 256) for r in reps])
    assert (whole.sum(axis=1) == n).all()
    for first, last in ((0, 1), (3, 7), (15, 16)):
        totals = draws.range_totals(reps, 9, n, first, last, 256)
        for i in range(first, last):
            assert all((draws.range_counts(r, 9, n, i, t, 256) == w[i * 256 : (i + 1) * 256]).all() for r, t, w in zip(reps, totals[:, i - first], whole, strict=True))
    one = np.stack([draws.multinomial(r, 9, n) for r in reps])
    law = np.array([math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - i * math.log(n) + (n - i) * math.log1p(-1 / n)) for i in range(9)]) * n * len(reps)
    assert all(chi_square(np.bincount(x.ravel(), minlength=9)[:9], law) < 3 for x in (whole, one))
    # a pair of clusters in different ranges and one in the same range are as often drawn together
    assert np.cov(whole[:, 0:256].sum(axis=1), whole[:, 256:512].sum(axis=1))[0, 1] < 60
    with duckdb.connect() as con:
        sql = f"select rep, idx, count(*) from ({draws.draws_sql(draws.keys_sql(3, 9), '40')}) group by 1, 2"
        assert {(r, i): c for r, i, c in con.sql(sql).fetchall()} == {(r, i): int(c) for r in range(3) for i, c in enumerate(draws.multinomial(r, 9, 40)) if c}


def test_draws_of_many_clusters():
    n = 1 << 26
    totals = draws.range_totals([0, 1], 5, n, 0, 256)
    assert totals.shape == (2, 256) and (totals.sum(axis=1) == n).all() and (totals[0] != totals[1]).any()
    assert abs(totals - (1 << 18)).max() < 6 * 512
    assert (draws.range_totals([1], 5, n, 200, 202)[0] == totals[1, 200:202]).all()
    counts = draws.range_counts(1, 5, n, 201, int(totals[1, 201]))
    assert counts.sum() == totals[1, 201] and len(counts) == 1 << 18 and 0.98 < counts.var() < 1.02


def test_an_interval_at_the_published_resamples(spark):
    draw = random.Random(8)
    rows = [(i, draw.random() < 0.4, draw.choice([0.1, 0.2, 0.3, 0.4])) for i in range(30) for _ in range(2)]
    df = spark.createDataFrame(rows, "c int, y boolean, s double")
    got = boot.cluster_auroc_ci(df, [], "c", "y", "s").first()
    order = sorted(range(30), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    place = {c: k for k, c in enumerate(order)}
    values = []
    for rep in range(10_000):
        w = draws.multinomial(rep, 42, 30)
        pos, neg = Counter(), Counter()
        for c, y, s in rows:
            (pos if y else neg)[s] += int(w[place[c]])
        below = wins = 0.0
        for s in (0.1, 0.2, 0.3, 0.4):
            wins += pos[s] * (below + neg[s] / 2)
            below += neg[s]
        if pos.total() and neg.total():
            values.append(wins / (pos.total() * neg.total()))
    assert got.n_skipped == 10_000 - len(values) and got.n_clusters == 30
    assert (got.ci_lo, got.ci_hi) == pytest.approx(tuple(np.quantile(values, [0.025, 0.975])))


def test_ranges_of_scores_are_even(spark):
    # one outlier, and scores heaped at both ends
    heaped = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.col("id") / 1e9).when(F.col("id") % 3 == 1, 1 - F.col("id") / 1e9).otherwise(F.col("id") / 2e4).alias("s"))
    df = heaped.union(spark.createDataFrame([(1e12,)], "s double")).withColumn("g", F.lit(1))
    sizes = [r["count"] for r in rk._ranged(df, ["g"], "s").groupBy("_r").count().collect()]
    assert len(sizes) > 200 and max(sizes) < 4 * 20_000 / rk.RANGES
    ranks = rk.average_rank(df, ["g"], "s").orderBy("s").select("rank").collect()
    assert [r[0] for r in ranks] == list(range(1, 20_002))


def test_rings_and_orders_of_hot_groups(spark):
    items = spark.range(3000).select(F.col("id").alias("item_id"), F.when(F.col("id") < 2990, "hot").when(F.col("id") < 2998, F.concat(F.lit("s"), F.col("id").cast("string"))).alias("skill"))
    got = ds.shuffled_records(items, 2, 7).collect()
    assert len(got) == 6000
    for v in (1, 2):
        donor = {r.item_id: r.donor for r in got if r.variant == v}
        assert sorted(donor.values()) == list(range(3000)) and all(k != d for k, d in donor.items())
        assert all(r.same_skill == (r.item_id < 2990 or r.item_id >= 2998) for r in got)
    n = [r.n for r in ds.ranked(items, ["skill"], 3, "item_id").filter("skill = 'hot'").collect()]
    assert sorted(n) == list(range(1, 2991))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.sampled_from([0.001, 0.01, 0.02, 0.02, 0.3, 1.0]), min_size=1, max_size=8))
def test_holm(spark, ps):
    got = sorted((r.p, r.p_holm) for r in boot.holm(spark.createDataFrame([(p,) for p in ps], "p double"), [], "p").collect())
    run = 0
    for k, (p, h) in enumerate(got):
        run = max(run, min(1, (len(ps) - k) * p))
        assert abs(h - run) < 1e-12 and h >= p


def test_flip_influence_is_exact(spark):
    rng = random.Random(4)
    rows = [(i, rng.random() < 0.5, rng.randint(0, 5) / 5) for i in range(30)]
    for r in dg.flip_influence(spark.createDataFrame(rows, "i int, label boolean, score double"), []).collect():
        flipped = [(i, y != (i == r.i), s, 1) for i, y, s in rows]
        assert abs(r.auroc + r.flip_change - brute_weighted(flipped)) < 1e-12


def test_majority_rules(spark):
    rows = [(1, "R1", "unsupported", 1), (1, "R2", "supported", 2), (1, "R3", None, 3), (2, "R1", "partial", 4)]
    df = spark.createDataFrame([(i, "S1", r, t, n) for i, r, t, n in rows], "item_id int, sentence_id string, rater_id string, tag string, row_id int")
    s = {r.item_id: r for r in rt.sentence_summary(df).withColumn("tied", rt.is_tied("tag_distribution")).collect()}
    assert s[1].majority_tag == "supported" and s[1].tied and not s[2].tied
    assert {r.item_id: r.majority_tag for r in rt.majority_first_seen(df).collect()} == {1: "unsupported", 2: "partial"}


def full_fisher(a, b, c, d):
    """The sum over all tables, in whole numbers."""
    rows, cols, n = a + b, a + c, a + b + c + d
    ways = {x: math.comb(rows, x) * math.comb(n - rows, cols - x) for x in range(max(0, rows + cols - n), min(rows, cols) + 1)}
    return float(Fraction(sum(w for w in ways.values() if w <= ways[a] * (1 + Fraction(1, 10**7))), math.comb(n, cols)))


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 9).flatmap(lambda k: st.tuples(*[st.integers(0, 1 << k)] * 4)))
def test_fisher_matches_the_full_sum(table):
    assert stats.fisher_two_sided(*table) == pytest.approx(full_fisher(*table), rel=1e-12) or stats.fisher_two_sided(*table) < 1e-290


def test_fisher_at_large_margins():
    assert stats.fisher_two_sided(1010, 990, 970, 1030) == pytest.approx(full_fisher(1010, 990, 970, 1030), rel=1e-10)
    start = time.perf_counter()
    for off in (0, 1, 31622, 94868, 10**8):  # standard deviations of 2^-1/2 * 10^4.5: two-sided normal tails
        got = stats.fisher_two_sided(10**9 + off, 10**9 - off, 10**9, 10**9)
        assert got == pytest.approx(math.erfc(off / math.sqrt(2 * 10**9)), rel=1e-3, abs=1e-12)
    assert time.perf_counter() - start < 0.5
    assert stats.fisher_two_sided(0, 0, 5, 7) == 1.0 and stats.fisher_two_sided(0, 0, 0, 0) == 1.0 and stats.fisher_two_sided(1, None, 1, 1) is None


@pytest.mark.parametrize("ranges, most", [(256, 1 << 16), (4, 6)])
def test_quantiles_by_selection(spark, monkeypatch, ranges, most):
    monkeypatch.setattr(sl, "RANGES", ranges)
    monkeypatch.setattr(sl, "SORTED", most)
    draw = random.Random(ranges)
    groups = {"distinct": [draw.gauss(0, 1e6) for _ in range(300)], "hot": [0.5] + [5.0] * 200 + [draw.random() * 10 for _ in range(40)], "one": [3.5], "two": [1.0, 2.0], None: [float(i % 7) for i in range(90)], "none": [], "negative": [-0.0, 0.0, -1e300, 1e300]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("one", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    at = [0.0, 1 / 3, 0.5, 2 / 3, 0.99, 1.0]
    got = {r.g: r.q for r in sl.quantiles(df, ["g"], "v", at, "q").collect()}
    assert set(got) == {g for g, vs in groups.items() if vs}
    for g, q in got.items():
        assert q == pytest.approx(np.quantile(groups[g], at).tolist(), rel=1e-12, abs=1e-12), g
    alone = sl.quantiles(df.filter("g = 'distinct'"), [], "v", at, "q").first().q
    assert alone == pytest.approx(np.quantile(groups["distinct"], at).tolist(), rel=1e-12)
    assert sl.quantiles(df.filter("g = 'none'"), ["g"], "v", [0.5]).count() == 0


def test_selection_holds_no_more_than_a_range(spark, monkeypatch):
    """All values distinct: the sorted rows are those of a range of the last round."""
    monkeypatch.setattr(sl, "RANGES", 16)
    monkeypatch.setattr(sl, "SORTED", 50)
    df = spark.range(20_000).select(F.col("id").cast("double").alias("v")).repartition(8)
    seen, real = [], sl.written
    monkeypatch.setattr(sl, "written", lambda d, label: seen.append((label, real(d, label))) or seen[-1][1])
    assert sl.quantiles(df, [], "v", [0.25, 0.5]).first().quantiles == pytest.approx([4999.75, 9999.5])
    placed = [d.count() for label, d in seen if label == "placed"]
    assert len(placed) >= 3 and placed[0] == 20_000 and all(b < a / 4 for a, b in zip(placed, placed[1:], strict=False)) and placed[-1] < 4 * 16 * 50


def test_long_students_are_scanned_in_segments(spark, monkeypatch):
    """A student with a third of the rows is spread over ranges; carries give what one scan gives, by brute force."""
    draw = random.Random(3)
    rows = []
    for i in range(600):
        start = draw.choice([None, float(draw.randrange(40)), float(draw.randrange(1000))])
        rows.append((i, 7 if i % 3 == 0 else draw.randrange(20), draw.choice("abc") if i % 6 else "rare", draw.randrange(2), start, None if start is None or i % 11 == 0 else start + draw.random(), draw.random() * (i % 13 > 0), i % 5, float(i % 4)))
    cols = "row_id long, student_id long, skill string, correct int, start_time double, end_time double, elapsed_time double, hint_raw int, hint_scaled double"
    df = spark.createDataFrame(rows, cols).repartition(5)

    def result():
        out = ind.skill_cum_accuracy(ind.response_time_ratio(ind.step_index(ind.lag_time(df))))
        out = ds.item_context(out)
        assert set(out.columns) == {*df.columns, "lag_time", "step_idx", "response_time_ratio", "skill_cum_accuracy", "steps"}
        return {r.row_id: (r.lag_time, r.step_idx, r.response_time_ratio, r.skill_cum_accuracy, [s.step for s in r.steps]) for r in out.collect()}

    order = {}
    for r in sorted(rows, key=lambda r: (r[1], r[4] is None, r[4] or 0.0, r[0])):
        order.setdefault(r[1], []).append(r)
    want = {}
    for own in order.values():
        mean = sum(r[6] for r in own) / len(own)
        for i, r in enumerate(own):
            end = own[i - 1][5] if i else None
            past = [x for x in own[:i] if x[2] == r[2]]
            steps = [j for j, x in enumerate(own[: i + 1]) if x[2] == r[2]][-4:]
            want[r[0]] = (max(r[4] - end, 0.0) if r[4] is not None and end is not None else 0.0, i, r[6] / mean, sum(x[3] for x in past) / len(past) if past else None, steps)
    plain = result()
    monkeypatch.setattr(scan, "SEGMENT_ROWS", 25)
    cut = scan.segmented(df, "student_id", ind.student_order())
    seven = cut.filter("student_id = 7").groupBy("_seg").count().collect()
    assert len(seven) > 4 and max(r["count"] for r in seven) < 100 and cut.count() == 600 and cut.filter("_seg is null").count() > 0
    spread = result()
    for found in (plain, spread):
        assert set(found) == set(want)
        for k, v in want.items():
            assert found[k][:4] == pytest.approx(v[:4], nan_ok=True) and found[k][4] == v[4], (k, found[k], v)


def test_p_values():
    assert abs(stats.chi_square_tail(3.841458820694124) - 0.05) < 1e-9
    assert abs(stats.fisher_two_sided(8, 2, 1, 5) - 0.034965034965034975) < 1e-9
    assert abs(stats.correlation_tail(0.5, 20) - 0.0247702) < 1e-5 and stats.correlation_tail(0.5, 2) is None and stats.correlation_tail(1.0, 5) == 0


def test_design_constraints(spark):
    cats = ["a"] * 12 + ["b"] * 5 + ["c"] * 3
    items = spark.createDataFrame([(i, c) for i, c in enumerate(cats)], "item_id int, category string")
    pairs = ds.negative_controls(items, 100, 1).collect()
    assert len({p.host for p in pairs}) == len({p.donor for p in pairs}) == len(pairs) >= 2 * (20 - 12)
    assert all(p.host_category != p.donor_category for p in pairs)
    assert ds.n_controls(10, 0.2) == 2 and ds.n_controls(1, 0.01) == 1
    raters = ds.assign_raters(items, ["R1", "R2"], 4, 1).collect()
    assert len(raters) == 4 * 2 + 16
    rows = spark.createDataFrame([("r", i, i < 4) for i in range(23)], "rater string, item_id int, is_negative_control boolean")
    placed = ds.spaced_order(rows, 1).collect()
    assert sorted(p.position for p in placed) == list(range(23))
    at = sorted(p.position for p in placed if p.is_negative_control)
    assert all(b - a >= 5 for a, b in itertools.pairwise(at))
    f = ds.folds(items, 3, 2).collect()
    assert sorted(sum(r.fold == k for r in f) for k in range(3)) == [6, 7, 7]
    shots = ds.few_shot_select(ds.folds(items, 3, 2), 4, 3, 1, "category", "item_id").collect()
    assert all(r.fold != r.own_fold for r in shots) and len(shots) == 12
    lone = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "c")], "item_id int, skill string")
    rec = ds.shuffled_records(lone, 3, 1).collect()
    assert all(r.donor != r.item_id and r.donor is not None for r in rec) and all(r.same_skill == (r.item_id > 2) for r in rec)


@pytest.mark.parametrize("n,k", [(5, 5), (7, 3), (4, 0), (1, 1), (9, 5)])
def test_spaced_order_is_a_permutation(spark, n, k):
    rows = spark.createDataFrame([("r", i, i < k) for i in range(n)], "rater string, item_id int, is_negative_control boolean")
    assert sorted(p.position for p in ds.spaced_order(rows, 1).collect()) == list(range(n))


def test_json_arrays_are_read_in_blocks(spark, tmp_path):
    draw = random.Random(2)
    odd = ["{", "}", '"', "\\", "\\}", '\\"', "}]", "[{", "é字", "\n", ","]
    runs = [{"condition": "".join(draw.choice(odd) for _ in range(draw.randrange(30))), "ITEST_id": i, "step_idx": i % 7, "sentences": [{"text": "}" * (i % 4) + '"', "cited": ["a{"]}] * (i % 3), "summary": {"n_sentences": i, "breakdown": {"PASS": i % 5}}} for i in range(400)]
    (tmp_path / "run_a b_1.json").write_text(json.dumps(runs))
    (tmp_path / "run_c_2.json").write_text(json.dumps(runs[:50], indent=2, ensure_ascii=False) + "\n")
    (tmp_path / "run_d_3.json").write_text("[]")
    (tmp_path / "run_e_4.json").write_text(json.dumps(runs[:5])[:-40])  # breaks off
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        blocks = spark.read.text(f"file://{tmp_path}/*.json", lineSep="}").select(F.spark_partition_id()).distinct().count()
        assert blocks > 10
        got = io.read_pipeline_log(spark, f"file://{tmp_path}/*.json")
        found = {(r.model.replace("%20", " "), r.ITEST_id): r for r in got.collect()}
        places = sorted((r.source_file[-9:], r.place) for r in io.array_elements(spark, f"file://{tmp_path}/run_c*.json").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(found) == sorted([("run_a b", i) for i in range(400)] + [("run_c", i) for i in range(50)] + [("run_e", i) for i in range(4)])
    for (_, i), r in found.items():
        assert r.condition == runs[i]["condition"] and [s.text for s in r.sentences] == [s["text"] for s in runs[i]["sentences"]] and r.summary.breakdown == {"PASS": i % 5}
    assert [n for _, n in places] == list(range(50))


def test_rating_files_take_a_scan_for_each_header(spark, tmp_path):
    head = "item_id,rater_id,level1_tags,faithfulness,actionability,clarity"
    for i in range(60):
        more = ("", ",free text", ",free text,duration_sec")[i % 3]
        (tmp_path / f"r {i}.csv").write_text(f"{head}{more}\nQ{i},R1,S1:supported,4,3,5" + ("", ",x", ",x,7")[i % 3] + "\n")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    df = io.read_ratings(spark, [f"file://{tmp_path}/*.csv"])
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 3
    rows = {r.item_id: r for r in df.collect()}
    assert len(rows) == 60 and rows["Q5"].duration_sec == 7 and rows["Q4"]["free text"] == "x" and rows["Q3"].duration_sec is None
    with pytest.raises(ValueError):
        io.read_ratings(spark, [f"file://{tmp_path}/other.csv"])


def test_readers(spark, tmp_path):
    (tmp_path / "ratings_R1.csv").write_bytes('﻿item_id,rater_id,level1_tags,faithfulness,actionability,clarity,free_text,duration_sec\nQ1,R1,"S1:지지됨;S2:unsuppported",4,3,5,"two\nlines, ""quoted""",10\nQ2,R1,,x,3,5,,\n'.encode())
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    df = io.read_ratings(spark, [f"file://{tmp_path}/ratings_R1.csv", f"file://{tmp_path}/other.csv"])
    rows = {r.item_id: r for r in df.collect()}
    assert rows["Q1"].faithfulness == 4 and rows["Q2"].faithfulness is None and rows["Q1"].free_text == 'two\nlines, "quoted"' and rows["Q1"].source_file == "ratings_R1.csv"
    tags = [(r.item_id, r.sentence_id, r.tag) for r in io.parse_tags(df).orderBy("item_id", "sentence_id").collect()]
    assert tags == [("Q1", "S1", "supported"), ("Q1", "S2", "unsuppported"), ("Q2", None, None)]
    (tmp_path / "key.csv").write_text("display_id,is_negative_control,in_core_set,mean_entailment\nQ1,True,False,0.5\nQ2,1,yes,NaN\nQ3,,,\n")
    key = {r.display_id: r for r in io.read_answer_key(spark, f"file://{tmp_path}/key.csv").collect()}
    assert key["Q1"].is_negative_control and key["Q2"].in_core_set and not key["Q3"].is_negative_control and key["Q2"].mean_entailment is None
    item = {"internal_item_id": "IT-1", "skill": "s", "steps": [{"step": 1, "correct": True, "hint_count": 0, "response_time_ratio": 1.5}], "skill_cum_accuracy": 0.5, "sentences": [{"id": "S1", "en": " ", "ko": "가"}]}
    (tmp_path / "items.json").write_text(json.dumps({"stimuli": [item, item | {"display_id": "Q9"}]}))
    (tmp_path / "list.json").write_text(json.dumps([item]))
    names = spark.createDataFrame([("IT-1", "Q1")], "internal_item_id string, display_id string")
    got = io.read_stimuli(spark, f"file://{tmp_path}/items.json", names)
    assert sorted(r.item_id for r in got.collect()) == ["Q1", "Q9"]
    assert got.select(io.sentence_text(F.col("sentences")[0], "en", ("en", "ko"))).first()[0] == "가"
    assert io.read_stimuli(spark, f"file://{tmp_path}/list.json").first().item_id == "IT-1"
    (tmp_path / "student_log_1.csv").write_text("ITEST_id,skill,correct,startTime,endTime,timeTaken,hintCount,attemptCount,Ln-1,RES_GAMING,RES_CONFUSED,RES_CONCENTRATING,RES_BORED,RES_FRUSTRATED,RES_OFFTASK\n7,sums,1,100,bad,3,0,1,0.5,0,0.1,0.2,0.3,0.4,0.5\n")
    r = io.read_logs(spark, f"file://{tmp_path}/student_log_*.csv").first()
    assert (r.student_id, r.start_time, r.end_time, r.prior_knowledge, r.offtask) == (7, 100.0, None, 0.5, 0.5)


def test_tables_and_guards(spark, tmp_path):
    df = spark.createDataFrame([(1, "R1", "a"), (1, "R2", "b")], "item_id int, rater_id string, t string")
    for form in ("parquet", "csv", "json"):
        io.write_table(df, f"file://{tmp_path}/{form}", form, ["rater_id"])
    assert io.read_source(spark, f"file://{tmp_path}/parquet", "item_id", "rater_id").count() == 2
    with pytest.raises(ValueError):
        io.require_columns(df, "zz")
    with pytest.raises(ValueError):
        io.assert_unique(df, ["item_id"])
    assert io.assert_unique(df, ["item_id", "rater_id"]) is df
    labels = spark.createDataFrame([("F1", " Faithful", None), ("F2", None, "x")], "ID string, Label string, Note string")
    assert [r.label for r in io.read_labels(labels).collect()] == ["faithful"]
    with pytest.raises(ValueError):
        io.read_labels(spark.createDataFrame([("F1", "maybe")], "ID string, Label string"))
    scores = spark.createDataFrame([("unsuppported", "False", "p", "0.5"), ("unknown", "False", "p", "0.5"), ("partial", "True", "p", "0.5"), ("partial", "False", None, "0.5"), ("partial", "False", "p", "NaN")], "majority_tag string, is_negative_control string, fact_premise string, score string")
    assert [(r.majority_tag, r.score) for r in io.standard_scores(scores).collect()] == [("unsupported", 0.5)]


def test_missing_flags(spark):
    df = spark.createDataFrame([(1, "supported", None, None), (2, "supported", True, True), (3, "supported", False, True)], "item_id int, majority_tag string, is_negative_control boolean, is_core boolean")
    assert {r.item_id for r in cp.filter_sentences(df).collect()} == {1, 3}
    assert {r.item_id for r in cp.filter_sentences(df, core_only=True).collect()} == {3}


def test_kappa_agreement(spark):
    rows = [(i, "S1", r, "supported" if i % 2 else "unsupported", i) for i in range(6) for r in ("R1", "R2", "R3")]
    df = spark.createDataFrame(rows, "item_id int, sentence_id string, rater_id string, tag string, row_id int")
    assert abs(rt.fleiss_kappa(df).first().kappa - 1) < 1e-12 and abs(rt.weighted_kappa(df).first().mean_kappa - 1) < 1e-12
    one = df.filter("item_id % 2 = 1")
    assert rt.weighted_kappa(one).first().mean_kappa is None and rt.fleiss_kappa(one).first().kappa is None
    assert math.isclose(rt.cohen_kappa(df.groupBy("item_id").pivot("rater_id", ["R1", "R2"]).agg(F.first("tag")), "R1", "R2", ["unsupported", "supported"]).first().kappa, 1)
