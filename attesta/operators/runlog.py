"""Run logs of a generation study: metrics of each interaction, tables by condition, paired bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.columns import let, ratio
from attesta.operators.bootstrap import Resamples, holm, percentile_ci, resampled_sums, two_sided_p

PASSES = ("PASS", "PASS_NO_SIGNAL", "PASS_INFERRED")
KEYS = ["model", "condition", "ITEST_id", "step_idx"]
CITED_CONDITIONS = ("full", "no_stage1")
WEIGHT = {"F": "n_sentences", "cF": "n_content_eligible"}
FACT = r"^\[([^\]]+)\]\s+([A-Z_]+)"


def _statuses(facts: str):
    """Indicator and status of each fact text that has the form."""
    parsed = F.transform(F.coalesce(F.col(facts), F.array()), lambda x: F.struct(F.regexp_extract(x, FACT, 1).alias("indicator"), F.regexp_extract(x, FACT, 2).alias("status")))
    return F.filter(parsed, lambda f: f["indicator"] != "")


def valid_rows(df: DataFrame) -> DataFrame:
    """Without interactions that failed or whose thinking was cut off."""
    return df.filter(~F.coalesce(F.col("error"), F.lit(False)) & ~F.coalesce(F.col("truncated"), F.lit(False)))


def interaction_metrics(log: DataFrame) -> DataFrame:
    """(keys, error, truncated, has_citable, n_sentences, F, cF, SVR_stage3, n_content_eligible, stored values).

    All from the arrays of one row, without a shuffle. Failed and cut-off rows, and rows without verdicts, have nulls.
    """
    st = F.transform("verification", lambda v: v["status"])
    bad = F.col("error").isNotNull() | F.coalesce(F.col("truncated_in_thinking"), F.lit(False))
    good = ~bad & F.col("summary").isNotNull()
    n = F.size(F.coalesce(st, F.array().cast("array<string>")))
    counts = F.struct(n.alias("n"), F.size(F.filter(st, lambda s: s.isin(*PASSES))).alias("p"), F.size(F.filter(st, lambda s: s == "FAIL_NO_CITATION")).alias("u"))
    scored = good & (n > 0)
    # of repeated facts the last counts
    gt = _statuses("ground_truth_facts")
    citable = let(gt, lambda g: F.exists(F.map_values(F.map_from_entries(_last(g))), lambda s: s.isin("HIGH", "AMBIGUOUS")))
    out = log.withColumn("_c", F.when(scored, counts))
    left = F.col("_c.n") - F.col("_c.u")
    return out.select(
        *KEYS, F.col("error").isNotNull().alias("error"), F.coalesce("truncated_in_thinking", F.lit(False)).alias("truncated"),
        F.when(good, citable).alias("has_citable"), F.col("_c.n").cast("long").alias("n_sentences"),
        ratio("_c.p", "_c.n").alias("F"), ratio("_c.p", left).alias("cF"), ratio("_c.u", "_c.n").alias("SVR_stage3"), left.cast("long").alias("n_content_eligible"),
        *[F.when(good, F.col(f"summary.{b}")).alias(a) for a, b in (("F_stored", "faithfulness_rate"), ("cF_stored", "conditional_faithfulness_rate"), ("SVR_stored", "structural_violation_rate"))],
    )


def _last(entries):
    """Entries without those whose indicator comes again."""
    numbered = F.transform(entries, lambda e, i: F.struct(e["indicator"].alias("k"), e["status"].alias("v"), i.alias("i")))
    kept = F.filter(numbered, lambda e: ~F.exists(numbered, lambda o: (o["k"] == e["k"]) & (o["i"] > e["i"])))
    return F.transform(kept, lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value")))


def citation_audit(log: DataFrame, cited_conditions=CITED_CONDITIONS) -> DataFrame:
    """(keys, n_parsed_sentences, n_uncited, n_malformed_tag, n_invalid, SVR_uncited, SVR_uncited_noexempt,
    SVR_uncited_or_invalid) of interactions that had to cite and have sentences.

    Invalid: the verifier's own FAIL_INVALID_REF verdicts in conditions it judged by citations, else tags that
    were not shown. Interactions without a citable fact are exempt from the first rate.
    """
    good = F.col("error").isNull() & ~F.coalesce(F.col("truncated_in_thinking"), F.lit(False)) & F.col("summary").isNotNull()
    rows = log.filter(good & F.coalesce(F.col("citation_required"), F.lit(False)) & (F.size("sentences") > 0))
    names = lambda facts: F.transform(_statuses(facts), lambda f: f["indicator"])
    shown = F.when(F.size(names("facts_shown_to_generator")) > 0, names("facts_shown_to_generator")).otherwise(names("ground_truth_facts"))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("_tags", F.transform("sentences", lambda s: F.coalesce(s["cited"], none))).withColumn("_shown", shown)
    n = F.size("sentences")
    uncited = F.size(F.filter("_tags", lambda t: F.size(t) == 0))
    malformed = F.size(F.filter("_tags", lambda t: F.exists(t, lambda x: ~x.rlike("^[A-Za-z_]+$"))))
    verdicts = F.size(F.filter("verification", lambda v: v["status"] == "FAIL_INVALID_REF"))
    unknown = F.size(F.filter("_tags", lambda t: F.size(F.array_except(t, F.col("_shown"))) > 0))
    invalid = F.when(F.col("condition").isin(*cited_conditions) & (F.size("verification") == n), verdicts).otherwise(unknown)
    citable = F.exists(F.map_values(F.map_from_entries(_last(_statuses("ground_truth_facts")))), lambda s: s.isin("HIGH", "AMBIGUOUS"))
    rows = rows.withColumns({"n_parsed_sentences": n, "n_uncited": uncited, "n_malformed_tag": malformed, "n_invalid": invalid, "_citable": citable})
    return rows.select(
        *KEYS, "n_parsed_sentences", "n_uncited", "n_malformed_tag", "n_invalid",
        F.when(F.col("_citable"), ratio("n_uncited", "n_parsed_sentences")).otherwise(F.lit(0.0)).alias("SVR_uncited"),
        ratio("n_uncited", "n_parsed_sentences").alias("SVR_uncited_noexempt"),
        ratio(F.col("n_uncited") + F.col("n_invalid"), "n_parsed_sentences").alias("SVR_uncited_or_invalid"),
    )


def consistency_check(df: DataFrame, group=("model", "condition"), pairs=(("F", "F_stored"), ("cF", "cF_stored")), tolerance: float = 1e-9) -> DataFrame:
    """Rows whose recomputed value differs from the stored one, or where only one of them is known."""
    differ = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) > tolerance, F.lit(False)) | (F.col(a).isNull() != F.col(b).isNull())
    return valid_rows(df).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(differ(a, b)).alias(f"{a}_mismatch") for a, b in pairs])


def condition_table(df: DataFrame, group=("model", "condition")) -> DataFrame:
    """Means in percent, how many are defined, the sentence-pooled rate and the strata with and without a citable fact."""
    cit = F.coalesce(F.col("has_citable"), F.lit(False))
    rates = [c for c in ("SVR_stored", "SVR_uncited", "SVR_uncited_noexempt", "SVR_uncited_or_invalid") if c in df.columns]
    known = F.col("F").isNotNull()
    return valid_rows(df).groupBy(*group).agg(
        F.count("F").alias("n_interactions"), (100 * F.avg("F")).alias("F_mean"), (100 * F.avg("cF")).alias("cF_mean"), F.count("cF").alias("n_cF_defined"),
        (100 * ratio(F.sum(F.col("F") * F.col("n_sentences")), F.sum(F.when(known, F.col("n_sentences"))))).alias("F_pooled"),
        *[(100 * F.avg(c)).alias(c) for c in rates],
        F.count_if(cit).alias("n_citable"), (100 * F.avg(F.when(cit, F.col("F")))).alias("F_mean_citable"), (100 * F.avg(F.when(~cit, F.col("F")))).alias("F_mean_no_citable"),
    )


def metric_parts(df: DataFrame, metric: str, agg: str = "mean") -> DataFrame:
    """Adds num and den, so that any resample is two sums: (rate, 1), or pooled (rate * w, w); unknown is (0, 0)."""
    v = F.col(metric).cast("double")
    if agg == "mean":
        return df.withColumns({"num": F.coalesce(v, F.lit(0.0)), "den": F.when(v.isNotNull(), 1.0).otherwise(0.0)})
    w = F.col(WEIGHT.get(metric, "n_sentences")).cast("double")
    ok = v.isNotNull() & w.isNotNull()
    return df.withColumns({"num": F.when(ok, v * w).otherwise(0.0), "den": F.when(ok, w).otherwise(0.0)})


def first_run(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")


def paired_condition_bootstrap(df: DataFrame, reference: str, comps: list[str], metric: str = "F", key: tuple = ("ITEST_id", "step_idx"), cluster: str | None = None, agg: str = "mean", keys: str = "union", reps: int = 10_000, seed=42, order: str | None = None, citable_only: bool = False, group: tuple = ("model",)) -> DataFrame:
    """(group, compare, ref_pct, cmp_pct, delta_pp, ci_lo_pp, ci_hi_pp, p_value, p_holm, n_clusters) of rates in percent.

    df: rows by condition with the metric; of repeated keys the first by ``order``. cluster: a column that groups
    keys (a student), or each key by itself. keys: all that some condition has, or those that every one has.
    """
    rows = df.filter(F.col("condition").isin(reference, *comps))
    if citable_only:
        rows = rows.filter(F.col("has_citable").eqNullSafe(True))
    if order:
        rows = first_run(rows, [*group, "condition", *key], order)
    rows = metric_parts(rows, metric, agg)
    if keys == "intersect":
        whole = rows.groupBy(*group, *key).agg(F.count_distinct("condition").alias("_c")).filter(F.col("_c") == len(comps) + 1)
        rows = rows.join(whole.drop("_c"), [*group, *key], "left_semi")
    unit = F.col(cluster).cast("string") if cluster else F.concat_ws("_", *[F.col(k).cast("string") for k in key])
    parts = rows.withColumn("unit", unit).groupBy(*group, "unit", "condition").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    point = parts.groupBy(*group, "condition").agg(ratio(F.sum("num"), F.sum("den")).alias("v"))
    each = resampled_sums(parts, [*group, "condition"], Resamples(parts, "unit", reps, seed), ["num", "den"]).withColumn("v", ratio("num", "den"))

    def against(d: DataFrame, extra: list[str]) -> DataFrame:
        ref = d.filter(F.col("condition") == reference).select(*group, *extra, F.col("v").alias("ref"))
        cmp = d.filter(F.col("condition") != reference).select(*group, *extra, F.col("condition").alias("compare"), F.col("v").alias("cmp"))
        return cmp.join(ref, [*group, *extra]).withColumn("delta", F.col("ref") - F.col("cmp"))

    g = [*group, "compare"]
    found = against(each, ["rep"]).filter("delta is not null")
    out = against(point, []).join(percentile_ci(found, g, "delta"), g, "left").join(two_sided_p(found, g, "delta"), g, "left")
    n = parts.groupBy(*group).agg(F.count_distinct("unit").alias("n_clusters"))
    out = holm(out.join(n, list(group)), list(group), "p_value")
    pct = {"ref": "ref_pct", "cmp": "cmp_pct", "delta": "delta_pp", "ci_lo": "ci_lo_pp", "ci_hi": "ci_hi_pp"}
    return out.select(*g, *[(100 * F.col(a)).alias(b) for a, b in pct.items()], "p_value", "p_holm", "n_clusters")


def best_match_table(full: DataFrame, others: DataFrame, reference: str = "full", comps: list[str] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """The re-scored condition with the others: their condition table, and the paired comparison."""
    both = full.unionByName(others, allowMissingColumns=True)
    return condition_table(both), paired_condition_bootstrap(valid_rows(both), reference, comps or [], **options)


def run_counts(df: DataFrame, group=("model", "condition")) -> DataFrame:
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("error").alias("n_errors"), F.count_if("truncated").alias("n_truncated"))


def flatten_summaries(log: DataFrame) -> DataFrame:
    """One flat row a run; the breakdown is left out."""
    fields = [f.name for f in log.schema["summary"].dataType.fields if f.name != "breakdown"]
    about = [c for c in ("model", "condition", "group", "label", "ITEST_id", "step_idx") if c in log.columns]
    return log.filter(F.col("summary").isNotNull()).select(*about, *[F.col(f"summary.{f}").alias(f) for f in fields])
