"""Queries of sections I and K: ranking metrics, thresholds and the bootstrap."""

from pyspark.sql import functions as F

from attesta.functions.draws import draws_sql, keys_sql
from attesta.operators import bootstrap as boot
from attesta.operators import ranking as rk
from attesta.plans import bindings as b
from attesta.plans.registry import query

S = f"s as ({b.SENTENCES})"
# whether a pair of verifier rows is coded as positive, both codings in one scan
CODED = f"""{S}, coded as (select s.*, c.coding, case c.coding when 'strict' then majority_tag = 'supported' else majority_tag in ('supported', 'partial') end as label
  from s cross join (values ('strict'), ('lenient')) c(coding) where majority_tag <> 'unknown')"""
G = ["verifier", "premise", "coding"]


def auroc_sql(source: str, keys: str, score: str = "score", digits: int = 6) -> str:
    """Mann-Whitney over (keys, score, label) rows by cumulative counts of the distinct scores."""
    on = keys + ", " if keys else ""
    part = f"partition by {keys}" if keys else ""
    by = f"group by {keys}" if keys else ""
    return f"""select {on}round(sum(pos * (below + neg / 2.0)) / nullif(sum(pos)::double * sum(neg), 0), {digits}) as auroc, sum(pos)::bigint as n_pos, sum(neg)::bigint as n_neg from (
  select *, coalesce(sum(neg) over ({part} order by {score} rows between unbounded preceding and 1 preceding), 0) as below from (
    select {on}{score}, count(*) filter (label) as pos, count(*) filter (not label) as neg from {source} where label is not null and {score} is not null group by {on}{score}) g) r {by}"""


def coded(spark, d):
    return rk.binary_coding(b.sentences(spark, d))


r6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})


@query("i1_average_rank", f"with {S} select item_id, sentence_id, verifier, premise, rank() over (partition by verifier, premise order by score) + (count(*) over (partition by verifier, premise, score) - 1) / 2.0 as rank from s")
def i1(spark, d):
    return rk.average_rank(b.sentences(spark, d), ["verifier", "premise"], "score").select("item_id", "sentence_id", "verifier", "premise", "rank")


@query("i2_auroc", f"with {CODED} " + auroc_sql("coded", "verifier, premise, coding"))
def i2(spark, d):
    return r6(rk.auroc(coded(spark, d), G, "label", "score"), "auroc")


@query("i3_binary_coding", f"with {CODED} select verifier, premise, coding, label, count(*) as n from coded group by all")
def i3(spark, d):
    return coded(spark, d).groupBy(*G, "label").agg(F.count(F.lit(1)).alias("n"))


RATES = """round(tp / nullif(tp + fp, 0)::double, 6) as precision, round(tp / nullif(tp + fn, 0)::double, 6) as recall, round(tn / nullif(tn + fp, 0)::double, 6) as specificity,
 round(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 6) as f1, round((tp + tn) / nullif(tp + fp + fn + tn, 0)::double, 6) as accuracy, round(tp / nullif(tp + fn, 0)::double + tn / nullif(tn + fp, 0)::double - 1, 6) as youden_j,
 round(fn / nullif(fn + tn, 0)::double, 6) as overflag_given_fail, round(fn / nullif(tp + fn, 0)::double, 6) as overflag_given_supported,
 round(fp / nullif(tp + fp, 0)::double, 6) as underflag_given_pass, round(fp / nullif(fp + tn, 0)::double, 6) as underflag_given_unsupported"""
RATE_NAMES = ["precision", "recall", "specificity", "f1", "accuracy", "youden_j", "overflag_given_fail", "overflag_given_supported", "underflag_given_pass", "underflag_given_unsupported"]
COUNTS = "count(*) filter (label and {p}) as tp, count(*) filter (not label and {p}) as fp, count(*) filter (label and not {p}) as fn, count(*) filter (not label and not {p}) as tn"


@query("i4_confusion_metrics", f"with {CODED}, c as (select verifier, premise, coding, {COUNTS.format(p='(score >= 0.5)')} from coded group by 1, 2, 3) select *, {RATES} from c")
def i4(spark, d):
    return r6(rk.confusion_metrics(coded(spark, d).withColumn("predicted", F.col("score") >= 0.5), G), *RATE_NAMES)


GRID = ", ".join(f"({t}::double)" for t in rk.THRESHOLDS)
STATUS = "case when sentence_id % 5 = 0 then 'FAIL_HEDGE' when sentence_id % 7 = 0 then 'PASS_NO_SIGNAL' when score >= 0.5 then 'PASS' else 'FAIL_NLI' end"
SWEEP = f"{CODED}, st as (select *, {STATUS} as status from coded), t(threshold) as (values {GRID})"


def with_status(spark, d):
    return coded(spark, d).withColumn("status", F.expr(STATUS))


@query("i5_threshold_sweep", f"with {SWEEP}, c as (select verifier, premise, coding, threshold, {COUNTS.format(p='(score >= threshold)')} from st cross join t where status <> 'FAIL_HEDGE' group by 1, 2, 3, 4) select *, {RATES} from c")
def i5(spark, d):
    return r6(rk.threshold_sweep(with_status(spark, d), G, status="status"), *RATE_NAMES)


P = "case when score is null or status = 'FAIL_HEDGE' then status like 'PASS%' else score >= threshold end"


@query("i6_whatif_sweep", f"with {SWEEP}, c as (select verifier, premise, coding, threshold, {COUNTS.format(p=f'({P})')} from st cross join t group by 1, 2, 3, 4) select *, {RATES}, round((tp + fp) / (tp + fp + fn + tn)::double, 6) as pass_rate from c")
def i6(spark, d):
    return r6(rk.whatif_sweep(with_status(spark, d), G), *RATE_NAMES, "pass_rate")


@query("i7_best_thresholds", f"""with {SWEEP}, c as (select verifier, premise, coding, threshold, {COUNTS.format(p='(score >= threshold)')} from st cross join t where status <> 'FAIL_HEDGE' group by 1, 2, 3, 4),
m as (select *, 2.0::double * tp / nullif(2 * tp + fp + fn, 0) as f, tp / nullif(tp + fn, 0)::double + tn / nullif(tn + fp, 0)::double - 1 as j from c),
r as (select *, row_number() over (partition by verifier, premise, coding order by f desc nulls last, threshold) as rf, row_number() over (partition by verifier, premise, coding order by j desc nulls last, threshold) as rj from m)
select verifier, premise, coding, 'f1' as criterion, threshold, round(f, 6) as f1, round(j, 6) as youden_j from r where rf = 1
union all select verifier, premise, coding, 'youden_j', threshold, round(f, 6), round(j, 6) from r where rj = 1
union all select verifier, premise, coding, 'current', threshold, round(f, 6), round(j, 6) from r where threshold = 0.5""")
def i7(spark, d):
    best = rk.best_thresholds(rk.threshold_sweep(with_status(spark, d), G, status="status"), G)
    return r6(best, "f1", "youden_j").select(*G, "criterion", "threshold", "f1", "youden_j")


@query("i8_point_biserial", f"with {CODED} select verifier, premise, coding, count(*) as n, round(corr(label::int, score), 6) as r from coded group by 1, 2, 3")
def i8(spark, d):
    return r6(rk.point_biserial(coded(spark, d), G), "r")


TWO = "count(*) filter (label and high) as n11, count(*) filter (label and not high) as n10, count(*) filter (not label and high) as n01, count(*) filter (not label and not high) as n00"


@query("i9_chi_square", f"""with {CODED}, c as (select verifier, premise, coding, {TWO} from (select *, score >= 0.5 as high from coded) group by 1, 2, 3),
x as (select *, (n11 + n10 + n01 + n00)::double as n, (n11 + n10)::double as r1, (n01 + n00)::double as r0, (n11 + n01)::double as c1, (n10 + n00)::double as c0 from c),
y as (select *, n * pow(greatest(abs(n11::double * n00 - n10::double * n01) - n / 2, 0), 2) / (r1 * r0 * c1 * c0) as chi, least(r1 * c1, r1 * c0, r0 * c1, r0 * c0) / n as least_e from x)
select verifier, premise, coding, n11, n10, n01, n00, round(chi, 4) as chi2, round(sqrt(chi / n), 6) as cramers_v, round(least_e, 4) as min_expected, least_e < 5 as small_expected from y""")
def i9(spark, d):
    out = rk.chi_square_2x2(coded(spark, d).withColumn("high", F.col("score") >= 0.5), G, "label", "high").drop("p_value")
    return r6(out, "cramers_v").withColumns({"chi2": F.round("chi2", 4), "min_expected": F.round("min_expected", 4)})


@query("i10_fisher_exact", f"""with {CODED}, c as (select verifier, premise, coding, {TWO} from (select *, score >= 0.5 as high from coded) group by 1, 2, 3),
x as (select *, n11 + n10 as r, n11 + n01 as k, n11 + n10 + n01 + n00 as n, unnest(range(greatest(0, n11 - n00), n11 + least(n10, n01) + 1)) as x from c),
h as (select *, lgamma(r + 1) - lgamma(x + 1) - lgamma(r - x + 1) + lgamma(n - r + 1) - lgamma(k - x + 1) - lgamma(n - r - k + x + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1) as w from x),
a as (select verifier, premise, coding, w as here from h where x = n11),
p as (select verifier, premise, coding, least(1.0::double, sum(exp(w)) filter (w <= here + 1e-7)) as p_value from h join a using (verifier, premise, coding) group by 1, 2, 3)
select c.*, round(n11::double * n00 / nullif(n10::double * n01, 0), 6) as odds_ratio, round(p_value, 6) as p_value from c join p using (verifier, premise, coding)""")
def i10(spark, d):
    return r6(rk.fisher_exact(coded(spark, d).withColumn("high", F.col("score") >= 0.5), G, "label", "high"), "odds_ratio", "p_value")


PREDS = f"""{S}, preds as (select *, case when sentence_id % 6 = 0 then null when score > 0.6 then 'supported' when score > 0.4 then 'partial' else 'unsupported' end as pred_label, round(score * 100) as conf,
  case when sentence_id % 6 = 0 then 'bad json ' || (item_id % 9) else '' end as reason from s)"""


def preds(spark, d):
    s = b.sentences(spark, d)
    label = F.expr("case when sentence_id % 6 = 0 then null when score > 0.6 then 'supported' when score > 0.4 then 'partial' else 'unsupported' end")
    reason = F.expr("case when sentence_id % 6 = 0 then 'bad json ' || cast(item_id % 9 as string) else '' end")
    return s.withColumns({"pred_label": label, "conf": F.round(F.col("score") * 100), "reason": reason})


@query("i11_judge_evaluation", f"""with {PREDS}, k as (select verifier, premise, count(*) as n, round(avg(case when pred_label is not null then (pred_label = majority_tag)::int end), 6) as accuracy from preds group by 1, 2),
a as ({auroc_sql("(select p.*, c.coding, case c.coding when 'strict' then majority_tag = 'supported' else majority_tag in ('supported', 'partial') end as label from preds p cross join (values ('strict'), ('lenient')) c(coding) where majority_tag <> 'unknown')", "verifier, premise, coding", "conf")})
select k.*, s.auroc as auroc_strict, l.auroc as auroc_lenient from k left join a s on s.verifier = k.verifier and s.premise = k.premise and s.coding = 'strict' left join a l on l.verifier = k.verifier and l.premise = k.premise and l.coding = 'lenient'""")
def i11(spark, d):
    out = rk.judge_evaluation(preds(spark, d), ["verifier", "premise"], confidence="conf")
    return r6(out, "accuracy", "auroc_strict", "auroc_lenient")


@query("i11_failure_reasons", f"with {PREDS}, c as (select verifier, premise, reason, count(*) as n from preds where pred_label is null group by 1, 2, 3), r as (select *, row_number() over (partition by verifier, premise order by n desc, reason) as rank from c) select * from r where rank <= 5")
def i11b(spark, d):
    return rk.failure_reasons(preds(spark, d), ["verifier", "premise"], reason="reason")


@query("i12_from_scores", f"with {S} select item_id, sentence_id, score, majority_tag, case when score >= 0.5 then 'PASS' else 'FAIL_NLI' end as status from s where verifier = 'v2' and premise = 'record' and not is_negative_control")
def i12(spark, d):
    return rk.from_scores(b.sentences(spark, d), "v2", "record").select("item_id", "sentence_id", "score", "majority_tag", "status")


@query("i13_score_profile", f"with {S} select premise, count(*) as n, count(*) filter (score is null) as n_missing, count(distinct round(score, 6)) as n_distinct, round(quantile_cont(score, 0.5), 6) as median_mass, round(avg((score >= 0.5)::int), 6) as pass_share from s group by 1")
def i13(spark, d):
    return r6(rk.score_profile(b.sentences(spark, d), ["premise"], mass=F.col("score")), "median_mass", "pass_share")


REPS, SEED = 1000, 42
LABELLED = f"""{CODED}, cl as (select coded.*, item_id as cluster from coded where coding = 'strict' and not is_negative_control)"""


def weights_sql(source: str, cluster: str = "cluster", reps: int = REPS, seed: int = SEED) -> str:
    """CTE wts (rep, cluster, w): how often each cluster of ``source`` is drawn in each resample."""
    return f"""k as (select cluster, row_number() over (order by md5(cluster::varchar), cluster) - 1 as idx from (select distinct {cluster} as cluster from {source} where {cluster} is not null)),
wts as (select rep, cluster, w from (select rep, idx, count(*) as w from ({draws_sql(keys_sql(reps, seed), '(select count(*) from k)')}) d group by 1, 2) join k using (idx))"""


def labelled(spark, d):
    return coded(spark, d).filter("coding = 'strict' and not is_negative_control").withColumn("cluster", F.col("item_id"))


def rep_sql(source: str, keys: str) -> str:
    """AUROC of each resample: weighted counts of the distinct scores."""
    return f"""select {keys}, rep, sum(pos * (below + neg / 2.0)) / nullif(sum(pos)::double * sum(neg), 0) as auroc from (
  select *, coalesce(sum(neg) over (partition by {keys}, rep order by score rows between unbounded preceding and 1 preceding), 0) as below from (
    select {keys}, rep, score, sum(w) filter (label) as p0, coalesce(sum(w) filter (label), 0) as pos, coalesce(sum(w) filter (not label), 0) as neg from {source} join wts on wts.cluster = {source}.cluster group by {keys}, rep, score) g) r group by {keys}, rep"""


#: Weights are listed for few resamples: the list is the result.
LISTED = 20


@query("k1_cluster_weights", f"with {LABELLED}, {weights_sql('cl', reps=LISTED)} select rep::int as rep, cluster, w from wts")
def k1(spark, d):
    return boot.cluster_weights(labelled(spark, d), "cluster", LISTED, SEED)


@query("k2_k4_cluster_auroc_ci", f"""with {LABELLED}, {weights_sql('cl')}, p as ({auroc_sql('cl', 'verifier, premise')}), reps as ({rep_sql('cl', 'verifier, premise')}),
c as (select verifier, premise, round(quantile_cont(auroc, 0.025), 6) as ci_lo, round(quantile_cont(auroc, 0.975), 6) as ci_hi, ({REPS} - count(auroc))::bigint as n_skipped from reps group by 1, 2),
z as (select verifier, premise, count(*) as n, count(distinct cluster) as n_clusters from cl group by 1, 2)
select p.*, ci_lo, ci_hi, n_skipped, n, n_clusters from p join c using (verifier, premise) join z using (verifier, premise)""")
def k2(spark, d):
    return r6(boot.cluster_auroc_ci(labelled(spark, d), ["verifier", "premise"], "cluster", "label", "score", REPS, SEED), "auroc", "ci_lo", "ci_hi")


PAIR = f"""{LABELLED}, fr as (select f.verifier, f.cluster, f.label, f.score as a, r.score as b from cl f join cl r on r.item_id = f.item_id and r.sentence_id = f.sentence_id and r.verifier = f.verifier and f.premise = 'record' and r.premise = 'fact'),
sides as (select verifier, cluster, label, 'a' as side, a as score from fr union all select verifier, cluster, label, 'b', b from fr)"""


@query("k3_k5_paired_diff", f"""with {PAIR}, {weights_sql('fr')}, p as ({auroc_sql('sides', 'verifier, side', digits=15)}), reps as ({rep_sql('sides', 'verifier, side')}),
dl as (select x.verifier, x.rep, x.auroc - y.auroc as delta from reps x join reps y on x.verifier = y.verifier and x.rep = y.rep and x.side = 'a' and y.side = 'b'),
c as (select verifier, round(quantile_cont(delta, 0.025), 6) as ci_lo, round(quantile_cont(delta, 0.975), 6) as ci_hi, round(least(1.0::double, 2.0::double * (least(count(*) filter (delta <= 0), count(*) filter (delta >= 0)) + 1) / (count(*) + 1)), 6) as p_value from dl group by 1)
select c.verifier, round(x.auroc, 6) as auroc_a, round(y.auroc, 6) as auroc_b, round(x.auroc - y.auroc, 6) as delta, (select count(*) from fr where fr.verifier = c.verifier) as n, ci_lo, ci_hi, p_value
from c join p x on x.verifier = c.verifier and x.side = 'a' join p y on y.verifier = c.verifier and y.side = 'b'""")
def k3(spark, d):
    return paired(spark, d, REPS)


def paired(spark, d, reps):
    keys = ["item_id", "sentence_id", "verifier", "cluster", "label"]
    wide = labelled(spark, d).groupBy(*keys).pivot("premise", ["fact", "record"]).agg(F.first("score"))
    out = boot.cluster_paired_diff(wide, ["verifier"], "cluster", "label", "record", "fact", reps, SEED)
    return r6(out, "auroc_a", "auroc_b", "delta", "ci_lo", "ci_hi", "p_value")


#: The resamples of the published tables; too many for the SQL, which joins rows with draws.
PUBLISHED = 10_000


@query("k2_cluster_auroc_ci_published")
def k2b(spark, d):
    return r6(boot.cluster_auroc_ci(labelled(spark, d), ["verifier", "premise"], "cluster", "label", "score", PUBLISHED, SEED), "auroc", "ci_lo", "ci_hi")


@query("k3_paired_diff_published")
def k3b(spark, d):
    return paired(spark, d, PUBLISHED)


@query("k6_holm", """with p as (select l_returnflag as family, l_suppkey as test, (sum(l_quantity)::bigint % 1000) / 5000.0::double as p from lineitem group by 1, 2),
r as (select *, count(*) over (partition by family) as m, row_number() over (partition by family order by p) as n from p)
select family, test, p, round(max(least(1.0::double, (m - n + 1) * p)) over (partition by family order by n rows between unbounded preceding and current row), 6) as p_holm from r""")
def k6(spark, d):
    p = b.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("family"), F.col("l_suppkey").alias("test")).agg(((F.sum("l_quantity").cast("long") % 1000) / 5000).alias("p"))
    return r6(boot.holm(p, ["family"], "p"), "p_holm")


@query("k7_cluster_mean_ci", f"""with {LABELLED}, {weights_sql('cl')}, m as (select verifier, premise, rep, sum(w * score) / sum(w) as v from cl join wts on wts.cluster = cl.cluster group by 1, 2, 3),
c as (select verifier, premise, round(quantile_cont(v, 0.025), 6) as ci_lo, round(quantile_cont(v, 0.975), 6) as ci_hi from m group by 1, 2)
select cl.verifier, cl.premise, round(avg(score), 6) as mean, count(*) as n, count(distinct cluster) as n_clusters, any_value(ci_lo) as ci_lo, any_value(ci_hi) as ci_hi from cl join c on c.verifier = cl.verifier and c.premise = cl.premise group by 1, 2""")
def k7(spark, d):
    return r6(boot.cluster_mean_ci(labelled(spark, d), ["verifier", "premise"], "cluster", "score", REPS, SEED), "mean", "ci_lo", "ci_hi")
