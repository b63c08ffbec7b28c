"""Queries of sections F, J and L: run logs, verifier comparisons and diagnostics."""

from pyspark.sql import functions as F

from attesta.operators import compare as cp
from attesta.operators import diagnostics as dg
from attesta.operators import runlog as rl
from attesta.plans import bindings as b
from attesta.plans import q_ranking
from attesta.plans.q_ranking import S, auroc_sql
from attesta.plans.registry import query

REPS, SEED = 200, 7
r6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})
# analysis set with a fact premise on all rows, and a cluster for the resamples
A = f"{S}, an as (select *, item_id as cluster from s where not is_negative_control and majority_tag <> 'unknown')"
SC = f"""{A}, sc as (select an.*, x.scope, c.coding, case c.coding when 'strict' then majority_tag = 'supported' else majority_tag in ('supported', 'partial') end as label
  from an cross join (values ('all'), ('core')) x(scope) cross join (values ('strict'), ('lenient')) c(coding) where x.scope = 'all' or is_core)"""


def sent(spark, d):
    return b.sentences(spark, d).withColumns({"cluster": F.col("item_id"), "fact_premise": F.lit("x")})


def weights_sql(source: str, cluster: str = "cluster") -> str:
    return q_ranking.weights_sql(source, cluster, REPS, SEED)


def ci_sql(source: str, keys: str, name: str = "ci") -> str:
    """CTEs: <name>_rep with the AUROC of each resample, <name> with point, interval and sizes."""
    return f"""{name}_rep as (select {keys}, rep, sum(pos * (below + neg / 2.0)) / nullif(sum(pos)::double * sum(neg), 0) as auroc from (
  select *, coalesce(sum(neg) over (partition by {keys}, rep order by score rows between unbounded preceding and 1 preceding), 0) as below from (
    select {keys}, rep, score, coalesce(sum(w) filter (label), 0) as pos, coalesce(sum(w) filter (not label), 0) as neg from {source} join wts on wts.cluster = {source}.cluster group by {keys}, rep, score) g) r group by {keys}, rep),
{name}_ci as (select {keys}, round(quantile_cont(auroc, 0.025), 6) as ci_lo, round(quantile_cont(auroc, 0.975), 6) as ci_hi, ({REPS} - count(auroc))::bigint as n_skipped from {name}_rep group by all),
{name}_n as (select {keys}, count(*) as n, count(distinct cluster) as n_clusters from {source} group by all),
{name}_p as ({auroc_sql(source, keys)}),
{name} as (select * from {name}_p join {name}_ci using ({keys}) join {name}_n using ({keys}))"""


def diff_sql(source: str, keys: str, name: str = "df") -> str:
    """CTE <name> of paired differences over rows with columns a, b and label."""
    return f"""{name}_l as (select {keys}, cluster, label, 'a' as side, a as score from {source} union all select {keys}, cluster, label, 'b' as side, b as score from {source}),
{ci_sql(name + '_l', keys + ', side', name + '_x')},
{name}_d as (select x.* exclude (side, auroc), x.auroc - y.auroc as delta from {name}_x_rep x join {name}_x_rep y using ({keys}, rep) where x.side = 'a' and y.side = 'b'),
{name}_q as (select {keys}, round(quantile_cont(delta, 0.025), 6) as ci_lo, round(quantile_cont(delta, 0.975), 6) as ci_hi, least(1.0::double, 2.0::double * (least(count(*) filter (delta <= 0), count(*) filter (delta >= 0)) + 1) / (count(delta) + 1)) as p_value from {name}_d where delta is not null group by all),
{name} as (select x.* exclude (side, auroc, n_pos, n_neg, ci_lo, ci_hi, n_skipped, n, n_clusters), x.n, x.auroc as auroc_a, y.auroc as auroc_b, q.ci_lo, q.ci_hi, q.p_value from {name}_x x join {name}_x y using ({keys}) left join {name}_q q using ({keys}) where x.side = 'a' and y.side = 'b')"""


def holm_sql(source: str) -> str:
    return f"(select *, max(least(1.0::double, (m - rn + 1) * p_value)) over (order by rn rows between unbounded preceding and current row) as p_holm from (select *, count(*) over () as m, row_number() over (order by p_value) as rn from {source}))"


@query("j1_analysis_set", f"with {A} select item_id, sentence_id, verifier, premise from an")
def j1(spark, d):
    return cp.analysis_set(sent(spark, d)).select("item_id", "sentence_id", "verifier", "premise")


@query("j2_filter_sentences", f"""with {S}, t as (select *, case sentence_id % 3 when 0 then 'supported:2;partial:2' when 1 then 'supported:3;partial:2' else 'partial:5' end as dist from s)
select item_id, sentence_id, verifier, premise, majority_tag from t where not is_negative_control and is_core and sentence_id % 3 <> 0""")
def j2(spark, d):
    dist = F.expr("case sentence_id % 3 when 0 then 'supported:2;partial:2' when 1 then 'supported:3;partial:2' else 'partial:5' end")
    df = sent(spark, d).withColumn("tag_distribution", dist).withColumn("majority_tag", F.concat(F.lit(" "), F.upper("majority_tag")))
    return cp.filter_sentences(df, core_only=True, exclude_ties=True).select("item_id", "sentence_id", "verifier", "premise", "majority_tag")


@query("j3_to_wide", f"with {S} select item_id, sentence_id, min(majority_tag) as majority_tag, bool_and(is_core) as is_core, bool_and(is_negative_control) as is_negative_control, " + ", ".join(f"round(min(score) filter (verifier = '{v}' and premise = '{p}'), 6) as {v}__{p}" for v in ("v1", "v2") for p in ("fact", "record")) + " from s group by 1, 2")
def j3(spark, d):
    cols = [f"{v}__{p}" for v in ("v1", "v2") for p in ("fact", "record")]
    return r6(cp.to_wide(sent(spark, d), cols), *cols)


@query("j4_auroc_table", f"with {SC}, {weights_sql('sc')}, {ci_sql('sc', 'verifier, premise, scope, coding')} select * from ci")
def j4(spark, d):
    return r6(cp.auroc_table(sent(spark, d), REPS, SEED, "cluster"), "auroc", "ci_lo", "ci_hi")


@query("j5_paired_premise", f"""with {SC}, pr as (select r.verifier, r.scope, r.coding, r.cluster, r.label, r.score as a, f.score as b from sc r join sc f using (item_id, sentence_id, verifier, scope, coding) where r.premise = 'record' and f.premise = 'fact'),
{weights_sql('pr')}, {diff_sql('pr', 'verifier, scope, coding')} select verifier, scope, coding, n, auroc_a, auroc_b, ci_lo, ci_hi, round(p_value, 6) as p_value, round(p_holm, 6) as p_holm from {holm_sql('df')}""")
def j5(spark, d):
    return r6(cp.paired_premise(sent(spark, d), reps=REPS, seed=SEED, cluster="cluster").drop("delta"), "auroc_a", "auroc_b", "ci_lo", "ci_hi", "p_value", "p_holm")


@query("j6_paired_vs_baseline", f"""with {SC}, pr as (select v.verifier, v.premise, v.scope, v.coding, v.cluster, v.label, v.score as a, f.score as b from sc v join sc f using (item_id, sentence_id, premise, scope, coding) where v.verifier <> 'v1' and f.verifier = 'v1'),
{weights_sql('pr')}, {diff_sql('pr', 'verifier, premise, scope, coding')} select verifier, premise, scope, coding, n, auroc_a, auroc_b, ci_lo, ci_hi, round(p_value, 6) as p_value, round(p_holm, 6) as p_holm from {holm_sql('df')}""")
def j6(spark, d):
    return r6(cp.paired_vs_baseline(sent(spark, d), "v1", REPS, SEED, "cluster").drop("delta"), "auroc_a", "auroc_b", "ci_lo", "ci_hi", "p_value", "p_holm")


@query("j7_control_scores", f"with {S} select verifier, premise, is_negative_control as control, count(*) as n, round(avg(score), 6) as mean_score, round(avg((score >= 0.5)::int), 6) as pass_rate from s group by 1, 2, 3")
def j7(spark, d):
    return r6(cp.control_scores(sent(spark, d)), "mean_score", "pass_rate")


IND = "case when sentence_id % 4 = 0 then null else 'ind' || (item_id % 3) end"


@query("j8_within_indicator", f"""with {A}, w as (select verifier, premise, g as "group", score, case majority_tag when 'supported' then true when 'unsupported' then false end as label from (select *, unnest(case when sentence_id % 4 = 0 then ['pooled'] else ['pooled', 'ind' || (item_id % 3)] end) as g from an)),
n as (select verifier, premise, "group", count(*) as n, round(avg(score), 6) as mean_score from w group by 1, 2, 3), a as ({auroc_sql('w', 'verifier, premise, "group"')})
select n.*, a.auroc, a.n_pos as n_supported, a.n_neg as n_unsupported from n left join a using (verifier, premise, "group")""")
def j8(spark, d):
    return r6(cp.within_indicator(sent(spark, d).withColumn("indicator", F.expr(IND.replace("(item_id % 3)", "cast(item_id % 3 as string)")))), "mean_score", "auroc")


@query("j9_nli_subsets", f"""with {A}, su as (select an.*, q.subset, c.coding, case c.coding when 'strict' then majority_tag = 'supported' else majority_tag in ('supported', 'partial') end as label from an
  cross join (values ('all'), ('without_slipping')) q(subset) cross join (values ('strict'), ('lenient')) c(coding) where q.subset = 'all' or sentence_id % 3 <> 0),
{weights_sql('su')}, {ci_sql('su', 'verifier, premise, subset, coding')} select * from ci""")
def j9(spark, d):
    df = sent(spark, d).withColumn("cited_indicators", F.expr("case when sentence_id % 3 = 0 then 'lucky_guess;slipping' else 'lucky_guess' end"))
    return r6(cp.nli_subsets(df, "slipping", reps=REPS, seed=SEED, cluster="cluster"), "auroc", "ci_lo", "ci_hi")


@query("j10_reproduction_check", f"""with {SC}, p as ({auroc_sql('sc', 'verifier, premise, scope, coding')}), n as (select verifier, premise, scope, coding, count(*) as n from sc group by all)
select verifier, premise, scope, coding, n, auroc, n as expected_n, case verifier when 'v1' then auroc else auroc + 0.01 end as expected_auroc, verifier = 'v1' as ok from p join n using (verifier, premise, scope, coding)""")
def j10(spark, d):
    found = r6(cp.auroc_table(sent(spark, d), 2, SEED, "cluster"), "auroc").select("verifier", "premise", "scope", "coding", "n", "auroc")
    expected = found.withColumn("auroc", F.when(F.col("verifier") == "v1", F.col("auroc")).otherwise(F.col("auroc") + 0.01))
    return cp.reproduction_check(found, expected, ["verifier", "premise", "scope", "coding"])


@query("j11_interpretation_flags", f"""with {SC}, {weights_sql('sc')}, {ci_sql('sc', 'verifier, premise, scope, coding')}
select scope, coding, bool_and(ci_lo <= 0.5 and ci_hi >= 0.5) filter (premise = 'fact') as all_fact_null, bool_or(ci_lo > 0.5) filter (premise = 'fact' and verifier <> 'v1') as stronger_above_on_fact,
 bool_and(ci_lo <= 0.5 and ci_hi >= 0.5) filter (premise = 'fact') and bool_or(ci_lo > 0.5) filter (premise = 'record') as fact_null_record_clear from ci group by 1, 2""")
def j11(spark, d):
    return cp.interpretation_flags(cp.auroc_table(sent(spark, d), REPS, SEED, "cluster"), "v1")


@query("j12_premise_pairing", f"with {S} select premise, 'pair' as verifier, count(*) as n, round(avg(score), 6) as mean_score from s where (verifier = 'v1' and premise = 'fact') or (verifier = 'v2' and premise = 'record') group by 1")
def j12(spark, d):
    s = sent(spark, d)
    both = cp.premise_pairing(s.filter("verifier = 'v1' and premise = 'fact'"), s.filter("verifier = 'v2' and premise = 'record'"), "pair")
    return r6(both.groupBy("premise", "verifier").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score")), "mean_score")


@query("j13_replace_verifier", f"with {S}, u as (select verifier, premise, score from s where verifier <> 'v2' union all select verifier, premise, score / 2 from s where verifier = 'v2') select verifier, premise, count(*) as n, round(sum(score), 3) as total from u group by 1, 2")
def j13(spark, d):
    s = sent(spark, d)
    new = s.filter("verifier = 'v2'").withColumn("score", F.col("score") / 2)
    return cp.replace_verifier(s, new).groupBy("verifier", "premise").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 3).alias("total"))


TEXT = "case item_id % 5 when 0 then 'The student was FRUSTRATED here.' when 1 then 'A lucky guess it seems.' else 'Plain words.' end"


@query("l1_nonaffective_auroc", f"""with {A}, cl as (select an.*, c.coding, case c.coding when 'strict' then majority_tag = 'supported' else majority_tag in ('supported', 'partial') end as label from an cross join (values ('strict'), ('lenient')) c(coding) where item_id % 5 <> 0),
{weights_sql('cl')}, {ci_sql('cl', 'verifier, premise, coding')} select * from ci""")
def l1(spark, d):
    return r6(dg.nonaffective_auroc(sent(spark, d).withColumn("sentence_text", F.expr(TEXT)), reps=REPS, seed=SEED, cluster="cluster"), "auroc", "ci_lo", "ci_hi")


CTL = f"{S}, ctl as (select item_id, sentence_id, verifier, v.variant, score * (cast((item_id * 31 + sentence_id * 17 + v.i * 7) % 100 as double) / 100) as score, v.i as k from s cross join (values ('shuffle1', 1), ('shuffle2', 2), ('hyponly', 3)) v(variant, i) where premise = 'record')"


def controls(spark, d):
    v = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(i).alias("k")) for n, i in (("shuffle1", 1), ("shuffle2", 2), ("hyponly", 3))]))
    s = sent(spark, d).filter("premise = 'record'").withColumn("v", v)
    factor = ((F.col("item_id") * 31 + F.col("sentence_id") * 17 + F.col("v.k") * 7) % 100).cast("double") / 100
    return s.select("item_id", "sentence_id", "verifier", "v.variant", (F.col("score") * factor).alias("score"), "v.k")


@query("l2_record_controls", f"""with {CTL}, cm as (select item_id, sentence_id, verifier, case when variant like 'shuffle%' then 'shuffled' else 'hyponly' end as kind, round(avg(score), 9) as control, count(distinct variant) as n_shuffles from ctl group by 1, 2, 3, 4),
an as (select *, item_id as cluster from s where premise = 'record' and not is_negative_control and majority_tag <> 'unknown'),
pr as (select an.verifier, x.scope, c.coding, kind, cluster, case c.coding when 'strict' then majority_tag = 'supported' else majority_tag in ('supported', 'partial') end as label, score as a, control as b, n_shuffles from an join cm using (item_id, sentence_id, verifier)
  cross join (values ('all'), ('core')) x(scope) cross join (values ('strict'), ('lenient')) c(coding) where x.scope = 'all' or is_core),
{weights_sql('pr')}, {diff_sql('pr', 'verifier, scope, coding, kind')}
select d.verifier, d.scope, d.coding, d.kind, d.n, auroc_a as auroc_true, auroc_b as auroc_control, d.ci_lo as delta_lo, d.ci_hi as delta_hi, round(p_value, 6) as p_value, x.ci_lo as control_lo, x.ci_hi as control_hi, (select max(n_shuffles) from pr where pr.kind = d.kind) as n_shuffles
from df d join df_x x on x.verifier = d.verifier and x.scope = d.scope and x.coding = d.coding and x.kind = d.kind and x.side = 'b'""")
def l2(spark, d):
    out = dg.record_controls(sent(spark, d).filter("premise = 'record'"), controls(spark, d), REPS, SEED, "cluster").drop("delta")
    return r6(out, "auroc_true", "auroc_control", "delta_lo", "delta_hi", "p_value", "control_lo", "control_hi")


SENS = f"""{CTL}, an as (select *, item_id as cluster from s where premise = 'record' and not is_negative_control and majority_tag <> 'unknown'),
se as (select an.item_id, an.sentence_id, an.verifier, any_value(cluster) as cluster, avg(case when an.score > ctl.score then 1.0::double when an.score = ctl.score then 0.5::double else 0 end) as win, round(avg(ctl.score), 9) as control, any_value(an.score) as score, any_value(majority_tag) as majority_tag, any_value(is_core) as is_core, count(distinct k) as n_shuffles from ctl join an using (item_id, sentence_id, verifier) group by 1, 2, 3)"""


def sens(spark, d):
    true = sent(spark, d).filter("premise = 'record'").withColumn("status_matched", F.col("sentence_id") % 2 == 0)
    return dg.sensitivity(true, controls(spark, d)).withColumn("cluster", F.col("item_id"))


@query("l3_sensitivity_by_sentence", f"with {SENS} select item_id, sentence_id, verifier, round(win, 6) as win, round(control, 6) as control, n_shuffles from se")
def l3(spark, d):
    return r6(sens(spark, d), "win", "control").select("item_id", "sentence_id", "verifier", "win", "control", "n_shuffles")


@query("l3_fact_sensitivity", f"""with {SENS}, sb as (select se.*, x.scope, q.subset from se cross join (values ('all'), ('core')) x(scope) cross join (values ('all_rows'), ('status_matched')) q(subset) where (x.scope = 'all' or is_core) and (q.subset = 'all_rows' or sentence_id % 2 = 0)),
{weights_sql('sb')}, m as (select verifier, scope, subset, rep, sum(w * win) / sum(w) as v from sb join wts on wts.cluster = sb.cluster group by all), c as (select verifier, scope, subset, round(quantile_cont(v, 0.025), 6) as ci_lo, round(quantile_cont(v, 0.975), 6) as ci_hi from m group by all)
select verifier, scope, subset, round(avg(win), 6) as mean, count(*) as n, count(distinct cluster) as n_clusters, any_value(ci_lo) as ci_lo, any_value(ci_hi) as ci_hi from sb join c using (verifier, scope, subset) group by all""")
def l3b(spark, d):
    return r6(dg.fact_sensitivity(sens(spark, d), REPS, SEED, "cluster"), "mean", "ci_lo", "ci_hi")


@query("l3_fact_controls_auroc", f"""with {SENS}, pr as (select se.verifier, x.scope, c.coding, cluster, case c.coding when 'strict' then majority_tag = 'supported' else majority_tag in ('supported', 'partial') end as label, score as a, control as b from se
  cross join (values ('all'), ('core')) x(scope) cross join (values ('strict'), ('lenient')) c(coding) where x.scope = 'all' or is_core),
{weights_sql('pr')}, {diff_sql('pr', 'verifier, scope, coding')} select * exclude (p_value), round(p_value, 6) as p_value from df""")
def l3c(spark, d):
    return r6(dg.fact_controls_auroc(sens(spark, d), REPS, SEED, "cluster").drop("delta"), "auroc_a", "auroc_b", "ci_lo", "ci_hi", "p_value")


TWO = "count(*) filter (x and y) as n11, count(*) filter (x and not y) as n10, count(*) filter (not x and y) as n01, count(*) filter (not x and not y) as n00"


@query("l4_restatement", f"""with {A}, t as (select verifier, premise, o.outcome, item_id % 5 = 1 as x, case o.outcome when 'passed' then score >= 0.5 else majority_tag = 'supported' end as y from an cross join (values ('passed'), ('supported')) o(outcome)),
c as (select verifier, premise, outcome, {TWO} from t group by 1, 2, 3) select *, round(n11::double * n00 / nullif(n10::double * n01, 0), 6) as odds_ratio, round((n11 + n10) / (n11 + n10 + n01 + n00)::double, 6) as share_named, round(n11 / (n11 + n10)::double, 6) as rate_named, round(n01 / (n01 + n00)::double, 6) as rate_other from c""")
def l4(spark, d):
    df = cp.analysis_set(sent(spark, d)).withColumn("sentence_text", F.expr(TEXT))
    return r6(dg.restatement(df, group=["verifier", "premise"]).drop("p_value"), "odds_ratio", "share_named", "rate_named", "rate_other")


CODE = "case (item_id + sentence_id) % 3 when 0 then ' YES' when 1 then 'no' end"
SPLIT = f"{A}, cs as (select *, case when majority_tag = 'unsupported' then case (item_id + sentence_id) % 3 when 0 then 'contradicted' when 1 then 'unrelated' else 'unsupported' end else majority_tag end as cls from an)"


def coding_of(spark, d):
    return sent(spark, d).select("item_id", "sentence_id").distinct().withColumn("counter_evidence", F.expr(CODE))


@query("l5_unsupported_split", f"""with {SPLIT}, cl as (select cs.*, c.coding, q.negatives, case c.coding when 'strict' then cls = 'supported' else cls in ('supported', 'partial') end as label from cs cross join (values ('strict'), ('lenient')) c(coding) cross join (values ('contradicted'), ('unrelated')) q(negatives)
  where cls = q.negatives or (case c.coding when 'strict' then cls = 'supported' else cls in ('supported', 'partial') end)),
{weights_sql('cl')}, {ci_sql('cl', 'verifier, premise, coding, negatives')} select * from ci""")
def l5(spark, d):
    return r6(dg.unsupported_split(sent(spark, d), coding_of(spark, d), reps=REPS, seed=SEED, cluster="cluster"), "auroc", "ci_lo", "ci_hi")


@query("l5_counter_evidence_by_verdict", f"with {SPLIT}, t as (select verifier, premise, score >= 0.5 as x, cls = 'contradicted' as y from cs where cls in ('contradicted', 'unrelated')), c as (select verifier, premise, {TWO} from t group by 1, 2) select *, round(n11::double * n00 / nullif(n10::double * n01, 0), 6) as odds_ratio from c")
def l5b(spark, d):
    return r6(dg.counter_evidence_by_verdict(sent(spark, d), coding_of(spark, d)).drop("p_value"), "odds_ratio")


FID = "case (item_id * 7 + sentence_id) % 4 when 0 then 'faithful' when 1 then 'partial' when 2 then 'unfaithful' else 'not_assessable' end"


@query("l6_fidelity_auroc", f"""with {S}, f as (select *, item_id as cluster, {FID} as fid from s), cl as (select f.*, c.coding, case c.coding when 'strict' then fid = 'faithful' else fid in ('faithful', 'partial') end as label from f cross join (values ('strict'), ('lenient')) c(coding) where fid <> 'not_assessable'),
{weights_sql('cl')}, {ci_sql('cl', 'verifier, premise, coding')} select *, ci_lo > 0.5 as tracks from ci""")
def l6(spark, d):
    s = sent(spark, d)
    labels = s.select("item_id", "sentence_id").distinct().withColumn("label", F.expr(FID))
    return r6(dg.fidelity_auroc(labels, s, reps=REPS, seed=SEED, cluster="cluster"), "auroc", "ci_lo", "ci_hi")


@query("l7_fidelity_x_support", f"with {S}, f as (select {FID} as label, majority_tag from s), c as (select label, " + ", ".join(f"count(*) filter (majority_tag = '{t}') as {t}" for t in ("supported", "partial", "unsupported", "unknown")) + " from f group by 1) select *, round((partial + unsupported + unknown) / (partial + unsupported + unknown + supported)::double, 6) as share_not_supported from c")
def l7(spark, d):
    return r6(dg.fidelity_x_support(sent(spark, d).withColumn("label", F.expr(FID))), "share_not_supported")


@query("l8_flip_influence", f"""with {S}, c as (select item_id, sentence_id, verifier, premise, score, majority_tag = 'supported' as label from s where majority_tag <> 'unknown'),
g as (select verifier, premise, score, count(*) filter (label) as pos, count(*) filter (not label) as neg from c group by 1, 2, 3),
h as (select *, coalesce(sum(pos) over w, 0) as bp, coalesce(sum(neg) over w, 0) as bn from g window w as (partition by verifier, premise order by score rows between unbounded preceding and 1 preceding)),
t as (select verifier, premise, sum(pos)::double as p, sum(neg)::double as n, sum(pos * (bn + neg / 2.0))::double as w from h group by 1, 2),
r as (select c.*, p, n, w, bn + neg / 2.0 as beaten, p - bp - pos / 2.0 as above from c join h using (verifier, premise, score) join t using (verifier, premise))
select item_id, sentence_id, verifier, premise, round(w / (p * n), 6) as auroc, round(1e4 * (case when label then (w - beaten + (above - 0.5)) / ((p - 1) * (n + 1)) else (w - above + (beaten - 0.5)) / ((p + 1) * (n - 1)) end - w / (p * n)), 5) as flip_change_e4 from r""")
def l8(spark, d):
    df = sent(spark, d).filter("majority_tag <> 'unknown'").withColumn("label", F.col("majority_tag") == "supported")
    out = dg.flip_influence(df, ["verifier", "premise"])
    return out.select("item_id", "sentence_id", "verifier", "premise", F.round("auroc", 6).alias("auroc"), F.round(F.col("flip_change") * 1e4, 5).alias("flip_change_e4"))


RUN = f"""rs as ({b.RUNS}), one as (select *, row_number() over (partition by condition, interaction_id, run_id order by pos) as q from rs),
ru as (select condition, interaction_id, run_id, count(*) as n_sentences, count(*) filter (status like 'PASS%') as p, count(*) filter (status = 'FAIL_NO_CITATION') as u, count(*) filter (status = 'FAIL_INVALID_REF') as inv, interaction_id % 11 = 0 as error, run_id % 13 = 0 as truncated, interaction_id % 3 <> 0 as has_citable from rs group by all),
me as (select *, p / n_sentences::double as "F", p / nullif(n_sentences - u, 0)::double as cF, u / n_sentences::double as svr, n_sentences - u as n_content_eligible from ru)"""


def log(spark, d):
    """Runs with the nested columns of a run log."""
    st = b.run_status(spark, d)
    nested = st.groupBy("condition", "interaction_id", "run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "status"))), lambda x: x["status"]).alias("st"))  # a run has few sentences
    n = F.size("st")
    has = lambda *names: F.size(F.filter("st", lambda s: s.isin(*names)))
    p, u = has("PASS", "PASS_NO_SIGNAL"), has("FAIL_NO_CITATION")
    none = F.lit(None).cast("double")
    summary = F.struct(n.cast("long").alias("n_sentences"), (p / n + F.when(F.col("run_id") % 17 == 0, 0.5).otherwise(0.0)).alias("faithfulness_rate"), none.alias("hallucination_rate"), none.alias("hedge_violation_rate"), (u / n).alias("structural_violation_rate"), (p / F.nullif(n - u, F.lit(0))).alias("conditional_faithfulness_rate"), none.alias("conditional_hallucination_rate"), (n - u).cast("long").alias("n_content_eligible"), F.create_map(F.lit("x"), F.lit(1).cast("long")).alias("breakdown"))
    facts = F.when(F.col("interaction_id") % 3 != 0, F.array(F.lit("[slipping] LOW: a"), F.lit("[slipping] HIGH: b"), F.lit("junk"))).otherwise(F.array(F.lit("[slipping] HIGH: a"), F.lit("[slipping] LOW: b")))
    cited = lambda s, i: F.when(s == "FAIL_NO_CITATION", F.array().cast("array<string>")).when(i % 5 == 4, F.array(F.lit("no such tag"))).when(i % 3 == 2, F.array(F.lit("lucky_guess"), F.lit("slipping"))).otherwise(F.array(F.lit("slipping")))
    return nested.select(
        F.lit("m").alias("model"), "condition", F.col("interaction_id").alias("ITEST_id"), F.col("run_id").alias("step_idx"),
        F.when(F.col("interaction_id") % 11 == 0, "boom").alias("error"), (F.col("run_id") % 13 == 0).alias("truncated_in_thinking"), (F.col("condition") != "5-LOW").alias("citation_required"),
        facts.alias("ground_truth_facts"), F.array(F.lit("[slipping] HIGH: b")).alias("facts_shown_to_generator"),
        F.transform("st", lambda s, i: F.struct(F.lit("t").alias("text"), cited(s, i).alias("cited"))).alias("sentences"),
        F.transform("st", lambda s: F.struct(F.lit("t").alias("text"), s.alias("status"))).alias("verification"), summary.alias("summary"),
    )


@query("f1_interaction_metrics", f"""with {RUN} select condition, interaction_id as "ITEST_id", run_id as step_idx, error, truncated, case when not error and not truncated then has_citable end as has_citable, case when not error and not truncated then n_sentences end as n_sentences,
 case when not error and not truncated then round("F", 6) end as "F", case when not error and not truncated then round(cF, 6) end as "cF", case when not error and not truncated then round(svr, 6) end as "SVR_stage3", case when not error and not truncated then n_content_eligible end as n_content_eligible from me""")
def f1(spark, d):
    out = rl.interaction_metrics(log(spark, d))
    return r6(out, "F", "cF", "SVR_stage3").select("condition", "ITEST_id", "step_idx", "error", "truncated", "has_citable", "n_sentences", "F", "cF", "SVR_stage3", "n_content_eligible")


@query("f2_citation_audit", f"""with rs as ({b.RUNS}), t as (select *, pos - 1 as i, status = 'FAIL_NO_CITATION' as un from rs),
c as (select condition, interaction_id, run_id, count(*) as n, count(*) filter (un) as u, count(*) filter (not un and i % 5 = 4) as malformed, count(*) filter (not un and (i % 5 = 4 or i % 3 = 2)) as inv, count(*) filter (status = 'FAIL_INVALID_REF') as verdicts from t where condition <> '5-LOW' and interaction_id % 11 <> 0 and run_id % 13 <> 0 group by all),
d as (select *, case when condition = '1-URGENT' then verdicts else inv end as bad from c)
select condition, interaction_id as "ITEST_id", run_id as step_idx, n::int as n_parsed_sentences, u::int as n_uncited, malformed::int as n_malformed_tag, bad::int as n_invalid, case when interaction_id % 3 = 0 then 0 else round(u / n::double, 6) end as "SVR_uncited", round(u / n::double, 6) as "SVR_uncited_noexempt", round((u + bad) / n::double, 6) as "SVR_uncited_or_invalid" from d""")
def f2(spark, d):
    out = rl.citation_audit(log(spark, d), cited_conditions=("1-URGENT",)).drop("model")
    return r6(out, "SVR_uncited", "SVR_uncited_noexempt", "SVR_uncited_or_invalid")


@query("f3_f5_consistency_check", f"with {RUN} select condition, count(*) as n, count(*) filter (run_id % 17 = 0) as \"F_mismatch\", 0::bigint as \"cF_mismatch\" from me where not error and not truncated group by 1")
def f3(spark, d):
    return rl.consistency_check(rl.interaction_metrics(log(spark, d)), group=("condition",))


@query("f4_condition_table", f"""with {RUN} select condition, count(*) as n_interactions, round(100 * avg("F"), 5) as "F_mean", round(100 * avg(cF), 5) as "cF_mean", count(cF) as "n_cF_defined", round(100 * sum(p) / sum(n_sentences)::double, 5) as "F_pooled", round(100 * avg(svr), 5) as "SVR_stored",
 count(*) filter (has_citable) as n_citable, round(100 * avg("F") filter (has_citable), 5) as "F_mean_citable", round(100 * avg("F") filter (not has_citable), 5) as "F_mean_no_citable" from me where not error and not truncated group by 1""")
def f4(spark, d):
    out = rl.condition_table(rl.interaction_metrics(log(spark, d)), group=("condition",))
    return out.withColumns({c: F.round(c, 5) for c in ("F_mean", "cF_mean", "F_pooled", "SVR_stored", "F_mean_citable", "F_mean_no_citable")})


@query("f6_metric_parts", f"""with {RUN} select condition, interaction_id as "ITEST_id", run_id as step_idx, round(coalesce(cF * n_content_eligible, 0), 6) as num, case when cF is null then 0 else n_content_eligible end::double as den from me where not error and not truncated""")
def f6(spark, d):
    df = rl.valid_rows(rl.interaction_metrics(log(spark, d)))
    return r6(rl.metric_parts(df, "cF", "pooled"), "num").select("condition", "ITEST_id", "step_idx", "num", "den")


F7 = f"""{RUN}, v as (select *, row_number() over (partition by condition, interaction_id order by run_id) as fr from me where not error and not truncated), fst as (select * from v where fr = 1),
pt as (select interaction_id::varchar as cluster, condition, sum({{num}}) as num, sum({{den}}) as den from fst {{where}} group by 1, 2),
{weights_sql('pt', 'cluster')}, pv as (select condition, sum(num) / nullif(sum(den), 0) as v from pt group by 1), ev as (select rep, condition, sum(w * num) / nullif(sum(w * den), 0) as v from pt join wts on wts.cluster = pt.cluster group by 1, 2),
dl as (select c.condition, r.v - c.v as delta from ev r join ev c on r.rep = c.rep and r.condition = '1-URGENT' and c.condition <> '1-URGENT' where r.v is not null and c.v is not null),
q as (select condition, round(100 * quantile_cont(delta, 0.025), 5) as ci_lo_pp, round(100 * quantile_cont(delta, 0.975), 5) as ci_hi_pp, least(1.0::double, 2.0::double * (least(count(*) filter (delta <= 0), count(*) filter (delta >= 0)) + 1) / (count(*) + 1)) as p_value from dl group by 1)
select h.condition as compare, round(100 * r.v, 5) as ref_pct, round(100 * c.v, 5) as cmp_pct, round(100 * (r.v - c.v), 5) as delta_pp, ci_lo_pp, ci_hi_pp, round(p_value, 6) as p_value, round(p_holm, 6) as p_holm, (select count(distinct cluster) from pt) as n_clusters
from {holm_sql('q')} h join pv c on c.condition = h.condition join pv r on r.condition = '1-URGENT'"""
COMPS = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _paired(spark, d, **options):
    df = rl.valid_rows(rl.interaction_metrics(log(spark, d)))
    out = rl.paired_condition_bootstrap(df, "1-URGENT", COMPS, key=("ITEST_id",), reps=REPS, seed=SEED, order="step_idx", **options)
    return out.drop("model").withColumns({c: F.round(c, 5) for c in ("ref_pct", "cmp_pct", "delta_pp", "ci_lo_pp", "ci_hi_pp")} | {c: F.round(c, 6) for c in ("p_value", "p_holm")})


@query("f7_paired_condition_bootstrap", "with " + F7.format(num='"F"', den="1", where=""))
def f7(spark, d):
    return _paired(spark, d)


@query("f7_paired_pooled_intersect", "with " + F7.format(num="p", den="n_sentences", where="where interaction_id in (select interaction_id from fst group by 1 having count(distinct condition) = 5)"))
def f7b(spark, d):
    return _paired(spark, d, agg="pooled", keys="intersect")


@query("f8_best_match_table", f"""with {RUN}, w as (select condition, "F", p, n_sentences, has_citable from me where not error and not truncated) select condition, count(*) as n_interactions, round(100 * avg("F"), 5) as "F_mean", round(100 * sum(p) / sum(n_sentences)::double, 5) as "F_pooled", round(100 * avg("F") filter (has_citable), 5) as "F_mean_citable" from w where condition in ('1-URGENT', '2-HIGH') group by 1""")
def f8(spark, d):
    return best_match(spark, d)[0].select("condition", "n_interactions", *[F.round(c, 5).alias(c) for c in ("F_mean", "F_pooled", "F_mean_citable")])


def best_match(spark, d):
    m = rl.interaction_metrics(log(spark, d))
    return rl.best_match_table(m.filter("condition = '1-URGENT'"), m.filter("condition = '2-HIGH'"), "1-URGENT", ["2-HIGH"], key=("ITEST_id",), order="step_idx", reps=REPS, seed=SEED)


TWO_CONDITIONS = F7.format(num='"F"', den="1", where="where condition in ('1-URGENT', '2-HIGH')")


@query("f8_best_match_paired", "with " + TWO_CONDITIONS)
def f8b(spark, d):
    out = best_match(spark, d)[1].drop("model")
    return out.withColumns({c: F.round(c, 5) for c in ("ref_pct", "cmp_pct", "delta_pp", "ci_lo_pp", "ci_hi_pp")} | {c: F.round(c, 6) for c in ("p_value", "p_holm")})


@query("f9_run_counts", f"with {RUN} select condition, count(*) as n_rows, count(*) filter (error) as n_errors, count(*) filter (truncated) as n_truncated from me group by 1")
def f9(spark, d):
    return rl.run_counts(rl.interaction_metrics(log(spark, d)), group=("condition",))


@query("f10_flatten_summaries", f"""with {RUN} select condition, interaction_id as "ITEST_id", run_id as step_idx, n_sentences, round(svr, 6) as structural_violation_rate, round(cF, 6) as conditional_faithfulness_rate, n_content_eligible from me""")
def f10(spark, d):
    out = rl.flatten_summaries(log(spark, d))
    return r6(out, "structural_violation_rate", "conditional_faithfulness_rate").select("condition", "ITEST_id", "step_idx", "n_sentences", "structural_violation_rate", "conditional_faithfulness_rate", "n_content_eligible")


