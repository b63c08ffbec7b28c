"""Queries of section H: rating studies."""

from pyspark.sql import functions as F

from attesta.operators import ratings as rt
from attesta.plans import bindings as b
from attesta.plans.q_ranking import S
from attesta.plans.registry import query

R = f"r as (select *, item_id * 1000 + sentence_id * 10 + substr(rater_id, 2)::int as row_id from ({b.RATINGS}))"
CORE = f"{R}, core as (select * from r where item_id in (select item_id from r group by 1 having count(distinct rater_id) >= (select count(distinct rater_id) from r)))"
ALL = f"{R}, core as (select * from r)"
r6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})


def resp(spark, d):
    return b.ratings(spark, d).withColumn("row_id", F.col("item_id") * 1000 + F.col("sentence_id") * 10 + F.substring("rater_id", 2, 1).cast("int"))


def core(spark, d):
    """Ratings of the items that every rater has rated."""
    r = resp(spark, d)
    return r.join(rt.core_items(r), "item_id", "left_semi")


def key(spark, d):
    return b.table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), (F.col("o_custkey") % 4 == 0).alias("is_negative_control"), F.col("o_orderpriority").alias("category"))


KEY = "k as (select o_orderkey as item_id, o_custkey % 4 = 0 as is_negative_control, o_orderpriority as category from orders)"
ONE = "one as (select item_id, rater_id, arg_min(faithfulness, row_id) as f from r group by 1, 2)"


@query("h1_item_summary", f"with {R}, {ONE} select item_id, count(*) as n_raters, round(avg(f), 6) as mean_faithfulness from one group by 1")
def h1(spark, d):
    return r6(rt.item_summary(resp(spark, d)), "mean_faithfulness")


@query("h1_unmatched_items", f"with {R}, {KEY} select distinct item_id, 'ratings' as side from r where item_id not in (select item_id from k) union all select item_id, 'key' from (select distinct item_id from k) where item_id not in (select item_id from r)")
def h1b(spark, d):
    return rt.unmatched_items(resp(spark, d), key(spark, d))


TC = "c as (select item_id, sentence_id, tag, count(*) as n, min(row_id) as f from r group by 1, 2, 3)"


@query("h2_h4_sentence_summary", f"""with {R}, {TC}, s as (select item_id, sentence_id, sum(n)::bigint as n_raters, arg_min(tag, (-n, tag)) as majority_tag, string_agg(tag || ':' || n, ';' order by n desc, tag) as tag_distribution, list(n order by n desc) as ns from c group by 1, 2)
select item_id, sentence_id, n_raters, majority_tag, tag_distribution, len(ns) > 1 and ns[1] = ns[2] as tied from s""")
def h2(spark, d):
    return rt.sentence_summary(resp(spark, d)).withColumn("tied", rt.is_tied("tag_distribution"))


@query("h3_majority_first_seen", f"with {R}, {TC}, o as (select *, row_number() over (partition by item_id, sentence_id order by n desc, f) as q from c) select item_id, sentence_id, tag as majority_tag from o where q = 1")
def h3(spark, d):
    return rt.majority_first_seen(resp(spark, d))


@query("h5_core_items", f"with {R} select item_id from r group by 1 having count(distinct rater_id) >= (select count(distinct rater_id) from r)")
def h5(spark, d):
    return rt.core_items(resp(spark, d))


@query("h6_fleiss_kappa", f"""with {CORE}, w as (select item_id, sentence_id, count(*) filter (tag = 'supported') as a, count(*) filter (tag = 'partial') as b, count(*) filter (tag = 'unsupported') as c, count(*) filter (tag = 'unknown') as e, count(*) as n from core group by 1, 2),
m as (select n from w group by n order by count(*) desc, n limit 1), i as (select w.* from w, m where w.n = m.n),
p as (select avg((a * a + b * b + c * c + e * e - n) / (n * (n - 1))::double) as p_bar, pow(sum(a) / sum(n)::double, 2) + pow(sum(b) / sum(n)::double, 2) + pow(sum(c) / sum(n)::double, 2) + pow(sum(e) / sum(n)::double, 2) as p_e, count(*) as n_subjects from i)
select round((p_bar - p_e) / (1 - p_e), 6) as kappa, round(p_bar, 6) as p_bar, round(p_e, 6) as p_e, n_subjects, (select count(*) from w, m where w.n <> m.n) as n_dropped, (select n from m) as n_ratings from p""")
def h6(spark, d):
    return r6(rt.fleiss_kappa(core(spark, d)), "kappa", "p_bar", "p_e")


def _kappa_sql(unknown, digits=6):
    lev = lambda c: f"case {c} when 'unsupported' then 0 when 'partial' then 1 when 'supported' then 2 end"
    w = f"pow(case when ta = tb then 0 when {lev('ta')} is not null and {lev('tb')} is not null then abs({lev('ta')} - {lev('tb')}) else 2 end / 2.0::double, 2)"
    cond = "where tag <> 'unknown'" if unknown == "exclude" else ""
    return f"""with {ALL}, u as (select * from core {cond}),
p as (select x.rater_id as rater_a, y.rater_id as rater_b, x.tag as ta, y.tag as tb from u x join u y on x.item_id = y.item_id and x.sentence_id = y.sentence_id and x.rater_id < y.rater_id),
c as (select rater_a, rater_b, ta, tb, count(*) as n from p group by all), a as (select rater_a, rater_b, ta, sum(n) as na from c group by all), q as (select rater_a, rater_b, tb, sum(n) as nb from c group by all),
e as (select a.rater_a, a.rater_b, sum({w} * na * nb) as e from a join q on a.rater_a = q.rater_a and a.rater_b = q.rater_b group by 1, 2),
o as (select rater_a, rater_b, sum({w} * n) as o, sum(n) as n from c group by 1, 2)
select rater_a, rater_b, o.n::bigint as n, round(1 - o / (e / o.n), {digits}) as kappa from o join e using (rater_a, rater_b)"""


@query("h7_weighted_kappa_pairs", _kappa_sql("exclude"))
def h7(spark, d):
    return r6(rt.weighted_kappa_pairs(resp(spark, d)), "kappa")


@query("h7_weighted_kappa_penalised", f"select round(avg(kappa), 6) as mean_kappa, count(kappa) as n_pairs from ({_kappa_sql('penalise', 15)})")
def h7b(spark, d):
    return r6(rt.weighted_kappa(resp(spark, d), "penalise"), "mean_kappa")


@query("h8_icc", f"""with {R}, {ONE}, n as (select count(distinct rater_id) as k from one), i as (select item_id, count(*) as c from one group by 1), full_ as (select one.* from one join i using (item_id), n where c = k),
s as (select *, avg(f) over (partition by item_id) as mi, avg(f) over (partition by rater_id) as mr, (select avg(f) from full_) as g from full_),
t as (select count(distinct item_id)::double as n, (select k from n)::double as k, sum(pow(mi - g, 2)) as ssr, sum(pow(mr - g, 2)) as ssc, sum(pow(f - mi - mr + g, 2)) as sse from s),
m as (select n, k, ssr / (n - 1) as msr, ssc / (k - 1) as msc, sse / ((n - 1) * (k - 1)) as mse from t)
select round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 6) as icc, round(msr, 6) as msr, round(msc, 6) as msc, round(mse, 6) as mse, n::bigint as n_items, k::bigint as n_raters, (select count(*) from i, n where c < k) as n_dropped from m""")
def h8(spark, d):
    return r6(rt.icc_2_1(resp(spark, d), "faithfulness"), "icc", "msr", "msc", "mse")


@query("h9_rater_profiles", f"""with {R}, t as (select rater_id, count(*) as n_tags, {', '.join(f"round(100 * (count(*) filter (tag = '{x}')) / count(*)::double, 1) as pct_{x}" for x in ('supported', 'partial', 'unsupported', 'unknown'))} from r group by 1),
one as (select rater_id, item_id, arg_min(faithfulness, row_id) as f from r group by 1, 2)
select t.*, (select round(avg(f), 2) from one where one.rater_id = t.rater_id) as mean_faithfulness from t""")
def h9(spark, d):
    return rt.rater_profiles(resp(spark, d))


@query("h10_control_detection", f"""with {R}, {KEY}, c as (select r.item_id, r.rater_id, tag, count(*) as n, min(faithfulness) as f from r join k on k.item_id = r.item_id and k.is_negative_control group by 1, 2, 3),
one as (select item_id, rater_id, arg_min(tag, (-n, tag)) = 'unsupported' or min(f) <= 2 as hit from c group by 1, 2)
select rater_id, count(*) as n, count(*) filter (hit) as n_detected, round(count(*) filter (hit) / count(*)::double, 6) as rate, count(*) filter (hit) / count(*)::double >= 0.7::double as passes from one group by rollup (rater_id)""")
def h10(spark, d):
    return r6(rt.control_detection(resp(spark, d), key(spark, d)), "rate")


AUTO = f"{S}, auto as (select item_id, avg(score) as mean_score, avg((score >= 0.5)::int) as auto_rate, count(*) as n_sentences from s where verifier = 'v1' and premise = 'record' and not is_negative_control group by 1)"
BOTH = f"with {AUTO}, {R}, {ONE}, h as (select item_id, avg(f) as mean_faithfulness from one group by 1), j as (select * from auto join h using (item_id)) "


def joined(spark, d):
    auto = rt.item_auto_scores(b.sentences(spark, d), "v1", "record")
    return auto.join(rt.item_summary(resp(spark, d)), "item_id")


@query("h11_discrepancies_item", BOTH + "select item_id, case when auto_rate >= 0.7 then 'under_detection' else 'over_flag' end as kind from j where (auto_rate >= 0.7 and mean_faithfulness <= 2) or (auto_rate <= 0.3 and mean_faithfulness >= 4)")
def h11(spark, d):
    return rt.discrepancies_item(joined(spark, d)).select("item_id", "kind")


ST = "case when sentence_id % 4 = 0 then 'FAIL_INVALID_REF' when score >= 0.5 then 'PASS' else 'FAIL_NLI' end"


@query("h12_discrepancies_sentence", f"with {S}, t as (select *, {ST} as auto_status from s) select item_id, sentence_id, verifier, premise, case when auto_status = 'PASS' then 'under_detection' else 'over_flag' end as kind from t where (auto_status = 'PASS' and majority_tag = 'unsupported') or (auto_status <> 'PASS' and majority_tag = 'supported')")
def h12(spark, d):
    return rt.discrepancies_sentence(b.sentences(spark, d).withColumn("auto_status", F.expr(ST))).select("item_id", "sentence_id", "verifier", "premise", "kind")


@query("h13_crosstab", f"with {S}, t as (select *, {ST} as auto_status from s) select majority_tag, count(*) filter (auto_status = 'PASS') as \"PASS\", count(*) filter (auto_status = 'FAIL_NLI') as \"FAIL_NLI\", count(*) filter (auto_status = 'FAIL_INVALID_REF') as \"FAIL_INVALID_REF\" from t group by 1")
def h13(spark, d):
    return rt.crosstab(b.sentences(spark, d).withColumn("auto_status", F.expr(ST)), "majority_tag", "auto_status", ["PASS", "FAIL_NLI", "FAIL_INVALID_REF"])


@query("h14_item_auto_scores", f"with {AUTO} select item_id, round(mean_score, 6) as mean_score, round(auto_rate, 6) as auto_rate, n_sentences from auto")
def h14(spark, d):
    return r6(rt.item_auto_scores(b.sentences(spark, d), "v1", "record"), "mean_score", "auto_rate")


@query("h15_correlations", BOTH + """, k as (select mean_score as x, mean_faithfulness as y, rank() over (order by mean_score) + (count(*) over (partition by mean_score) - 1) / 2.0 as rx, rank() over (order by mean_faithfulness) + (count(*) over (partition by mean_faithfulness) - 1) / 2.0 as ry from j)
select count(*) as n, round(corr(x, y), 5) as pearson, round(corr(rx, ry), 5) as spearman from k""")
def h15(spark, d):
    j = joined(spark, d).withColumn("mean_score", F.col("mean_score"))
    return rt.correlations(j, "mean_score", "mean_faithfulness").select("n", F.round("pearson", 5).alias("pearson"), F.round("spearman", 5).alias("spearman"))


@query("h16_exclude_raters", f"with {R} select rater_id, count(*) as n from r where rater_id not in ('R2', 'R5') group by 1")
def h16(spark, d):
    return rt.exclude_raters(resp(spark, d), ["R2", "R5"]).groupBy("rater_id").agg(F.count(F.lit(1)).alias("n"))


@query("h17_merged_responses", f"with {R}, {KEY} select r.item_id, sentence_id, rater_id, tag, is_negative_control, category from r left join k on r.item_id = k.item_id")
def h17(spark, d):
    return rt.merged_responses(resp(spark, d), key(spark, d)).select("item_id", "sentence_id", "rater_id", "tag", "is_negative_control", "category")


@query("h18_loo_human", f"""with {R}, c as (select r.*, v.coding, (case v.coding when 'strict' then tag = 'supported' else tag in ('supported', 'partial') end)::int as y from r cross join (values ('strict'), ('lenient')) v(coding) where tag <> 'unknown'),
o as (select *, count(*) over (partition by coding, item_id, sentence_id) - 1 as n, sum(y) over (partition by coding, item_id, sentence_id) - y as s from c), t as (select *, case when s * 2 > n then 1 when s * 2 < n then 0 end as truth from o where n > 0)
select coding, rater_id, count(truth) as n, count(*) filter (truth is null) as n_ties, round((avg(y) filter (truth = 1) + avg(1 - y) filter (truth = 0)) / 2, 6) as balanced_accuracy from t group by 1, 2""")
def h18(spark, d):
    return r6(rt.loo_human(resp(spark, d)), "balanced_accuracy")


@query("h19_cohen_kappa", f"""with {ALL}, p as (select x.tag as a, y.tag as b from core x join core y on x.item_id = y.item_id and x.sentence_id = y.sentence_id and x.rater_id = 'R1' and y.rater_id = 'R2' where x.tag <> 'unknown' and y.tag <> 'unknown'),
l as (select *, case a when 'unsupported' then 0 when 'partial' then 1 else 2 end as i, case b when 'unsupported' then 0 when 'partial' then 1 else 2 end as j from p), n as (select count(*)::double as n from l),
o as (select avg((a = b)::int) as po, avg(pow((i - j) / 2.0, 2)) as wo from l), ma as (select i, count(*) as c from l group by 1), mb as (select j, count(*) as c from l group by 1),
e as (select sum(case when i = j then ma.c * mb.c else 0 end) / (select n * n from n) as pe, sum(pow((i - j) / 2.0, 2) * ma.c * mb.c) / (select n * n from n) as we from ma cross join mb)
select (select n::bigint from n) as n, round(po, 6) as agreement, round((po - pe) / (1 - pe), 6) as kappa, round(1 - wo / we, 6) as quadratic_kappa from o cross join e""")
def h19(spark, d):
    wide = resp(spark, d).groupBy("item_id", "sentence_id").pivot("rater_id", ["R1", "R2"]).agg(F.first("tag"))
    return r6(rt.cohen_kappa(wide, "R1", "R2", ["unsupported", "partial", "supported"]), "agreement", "kappa", "quadratic_kappa")


@query("h20_free_text_by_item", "with t as (select distinct o_custkey as item_id, o_orderpriority as rater_id, strftime(o_orderdate, '%Y-%m-%d') as t from orders) select item_id, string_agg(rater_id || ': ' || t, ' | ' order by rater_id, t) as comments from t group by 1")
def h20(spark, d):
    o = b.table(spark, d, "orders").select(F.col("o_custkey").alias("item_id"), F.col("o_orderpriority").alias("rater_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("free_text"))
    return rt.free_text_by_item(o)
