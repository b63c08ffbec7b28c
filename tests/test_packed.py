"""The packed bootstrap: ranges of scores, views, clusters without a name, and what is written on the way."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from attesta.functions import draws
from attesta.operators import bootstrap as boot
from attesta.plans import QUERIES, q_compare, q_ranking
from tests.test_operators import brute_weighted


@pytest.mark.parametrize("method,task_rows,block", [("multinomial", 7, 2), ("multinomial", 1 << 16, 1 << 18), ("poisson", 7, 4)])
def test_ranges_of_scores_match_brute_force(spark, monkeypatch, method, task_rows, block):
    draw = random.Random(9)
    rows = [(g, f"c{draw.randrange(11)}", draw.random() < 0.5, draw.choice([0.5, 0.75, draw.random()])) for g in ("x", None) for _ in range(60)]
    df = spark.createDataFrame(rows, "g string, c string, y boolean, s double").repartition(3)
    monkeypatch.setattr(boot, "CELLS", 0)
    monkeypatch.setattr(boot, "TASK_ROWS", (task_rows, task_rows))
    r = boot.Resamples(df, "c", 9, 3, method, block)
    weights = {}
    for x in boot.cluster_weights(df, "c", 9, 3, method, block).collect():
        weights.setdefault(x.rep, {})[x.c] = x.w
    got = {(x.g, x.rep): x.auroc for x in boot._replicates(df, ["g"], r, "y", "s").collect()}
    want = {(g, rep): brute_weighted([(c, y, s, weights[rep].get(c, 0)) for h, c, y, s in rows if h == g]) for g in ("x", None) for rep in range(9)}
    assert len(got) == 18 and {k: v for k, v in got.items() if v is not None} == pytest.approx({k: v for k, v in want.items() if v is not None})


@pytest.mark.parametrize("cells", [0, 1 << 17])
def test_views_are_as_repeated_rows(spark, monkeypatch, cells):
    draw = random.Random(4)
    rows = [(draw.choice([1, 2]), draw.choice([None, *range(8)]), draw.choice(["a", "b", "n", None]), draw.choice([True, False, None]), draw.choice([0.1, 0.2, None, draw.random()])) for _ in range(300)]
    df = spark.createDataFrame(rows, "g int, c int, tag string, core boolean, s double")
    monkeypatch.setattr(boot, "CELLS", cells)
    known = F.col("tag") != "n"
    views = boot.each_view([boot.View({"scope": "all"}, F.lit(True), None), boot.View({"scope": "core"}, F.col("core"), None)], [boot.View({"coding": "a"}, known, F.col("tag") == "a")])
    long = df.withColumn("scope", F.explode(F.array(F.lit("all"), F.lit("core")))).filter("scope = 'all' or core").filter("tag <> 'n'").withColumns({"coding": F.lit("a"), "y": F.col("tag") == "a"})
    names = ["g", "scope", "coding"]
    one = boot.cluster_auroc_ci(df, ["g"], "c", "", "s", 20, 5, views=views)
    two = boot.cluster_auroc_ci(long, names, "c", "y", "s", 20, 5)
    assert one.columns == two.columns
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    n = {(g, scope): [c for h, c, tag, core, s in rows if h == g and tag in ("a", "b") and s is not None and (scope == "all" or core)] for g in (1, 2) for scope in ("all", "core")}
    assert {(x.g, x.scope): (x.n, x.n_clusters) for x in one.collect()} == {k: (len(v), len({c for c in v if c is not None})) for k, v in n.items()}


def test_a_cluster_of_many_rows_and_large_counts(spark):
    # counts beyond what shares a word, and runs longer than one
    df = spark.range(9000).select(F.when(F.col("id") < 7000, 0).otherwise(F.col("id") % 40).alias("c"), (F.col("id") % 3 == 0).alias("y"), F.when(F.col("id") < 7000, 0.5).otherwise(F.col("id") % 5 / 4).alias("s"))
    got = {x.rep: x.auroc for x in boot._replicates(df, [], boot.Resamples(df, "c", 6, 3), "y", "s").collect()}
    w = {(x.rep, x.c): x.w for x in boot.cluster_weights(df, "c", 6, 3).collect()}
    cells = [tuple(x) for x in df.groupBy("c", "y", "s").count().collect()]
    for rep in range(6):
        assert got[rep] == pytest.approx(brute_weighted([(c, y, s, n * w.get((rep, c), 0)) for c, y, s, n in cells]))


def shuffled(spark) -> int:
    return sum(x.totalShuffleWrite() for x in _each(spark._jsc.sc().statusStore().executorList(True)))


def _each(seq):
    return [seq.apply(i) for i in range(seq.size())]


#: Names of queries that resample, and bytes that each may shuffle for a row of lineitem at eight resamples.
SHUFFLED = {"j11_interpretation_flags": 60, "j4_auroc_table": 60, "j5_paired_premise": 120, "k2_k4_cluster_auroc_ci": 60, "l1_nonaffective_auroc": 60, "l6_fidelity_auroc": 120, "k2_cluster_auroc_ci_published": 60, "k3_paired_diff_published": 120, "j6_paired_vs_baseline": 120, "l3_fact_controls_auroc": 160, "k3_k5_paired_diff": 120}


@pytest.mark.parametrize("name", sorted(SHUFFLED))
def test_resampled_rows_are_shuffled_in_few_bytes(spark, monkeypatch, name):
    for module, name_ in ((q_compare, "REPS"), (q_ranking, "REPS"), (q_ranking, "PUBLISHED")):
        monkeypatch.setattr(module, name_, 8)
    sf = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    before = shuffled(spark)
    QUERIES[name](spark, sf).collect()
    assert (shuffled(spark) - before) / n < SHUFFLED[name]


def test_more_clusters_than_a_range_are_drawn_as_in_sql(spark):
    # 2^18 were the clusters beyond which draws were split, and differed from the SQL
    n = (1 << 18) + 9000
    df = spark.range(n).select(F.col("id").alias("cluster"), (F.col("id") % 3 == 0).alias("y"), (F.pmod(F.xxhash64("id"), F.lit(50)) / 50).alias("s"))
    con = duckdb.connect()
    con.execute(f"create view src as select range as cluster from range({n})")
    want = con.sql(f"with {q_ranking.weights_sql('src', reps=2, seed=3)} select rep, sum(w * w), sum(w * (cluster % 1009)) from wts group by 1 order by 1").fetchall()
    got = boot.cluster_weights(df, "cluster", 2, 3)
    found = got.groupBy("rep").agg(F.sum(F.col("w") * F.col("w")).alias("a"), F.sum(F.col("w") * (F.col("cluster") % 1009)).alias("b")).orderBy("rep").collect()
    assert [tuple(map(int, x)) for x in found] == [tuple(map(int, x)) for x in want]
    r = boot.Resamples(df, "cluster", 2, 3)
    sums = boot.resampled_sums(df.withColumn("v", F.col("cluster") % 1009), [], r, ["v"]).orderBy("rep").collect()
    assert [int(x.v) for x in sums] == [int(x[2]) for x in want]
    weighted = df.join(got, "cluster").groupBy("rep", "y", "s").agg(F.sum("w").alias("w")).collect()
    for x in boot._replicates(df, [], r, "y", "s").collect():
        assert x.auroc == pytest.approx(brute_weighted([(0, w.y, w.s, w.w) for w in weighted if w.rep == x.rep]))
