"""Ranking metrics and threshold tables. Scores are collapsed to (score, positives, negatives) before any window.

For many distinct scores the cumulative sum has two levels: a window inside ranges of scores, and a window over the
few range totals; no task then holds all scores of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.columns import each_of, ratio
from attesta.functions.statistics import chi_square_p, fisher_p

CODINGS = {"strict": ["supported"], "lenient": ["supported", "partial"]}
THRESHOLDS = sorted({round(0.05 * i, 2) for i in range(1, 20)} | {0.5})
#: Ranges of scores in the first level of a cumulative sum.
RANGES = 256


def score_cuts(df: DataFrame, group: list[str], score: str, ranges: int) -> DataFrame:
    """(group, _cuts): ascending quantiles that cut each group's rows into ``ranges`` of about equal size; a score that
    many rows share is repeated."""
    at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    return df.groupBy(*group).agg(F.percentile_approx(F.col(score).cast("double"), at, F.lit(max(10_000, 4 * ranges))).alias("_cuts"))


def bucket(cuts: str, value: Column) -> Column:
    """How many of the ascending cuts are below the value, by binary search."""
    steps = F.array(*[F.lit(1 << i) for i in range(12, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.coalesce(F.get(F.col(cuts), at + s - 1) < value, F.lit(False)), at + s).otherwise(at))


def _ranged(df: DataFrame, group: list[str], score: str) -> DataFrame:
    """``df``, one row a score in each group, with _r: the range, of ``RANGES`` of about equal size, that a score is in."""
    cuts = score_cuts(df, group, score, RANGES)
    placed = df.join(cuts, group) if group else df.withColumn("_cuts", cuts.scalar())
    return placed.withColumn("_r", bucket("_cuts", F.col(score).cast("double"))).drop("_cuts")


def _prefix(df: DataFrame, group: list[str], score: str, values: list[str]) -> DataFrame:
    """``df``, one row a score in each group, with below_<v>: sums of the values over lower scores."""
    placed = _ranged(df, group, score)
    totals = placed.groupBy(*group, "_r").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    over = Window.partitionBy(*group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "_r", *[F.coalesce(F.sum(f"_t_{v}").over(over), F.lit(0)).alias(f"_b_{v}") for v in values])
    inner = Window.partitionBy(*group, "_r").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumns({f"_i_{v}": F.coalesce(F.sum(v).over(inner), F.lit(0)) for v in values})
    out = placed.join(totals, [*group, "_r"])
    return out.select(*df.columns, *[(F.col(f"_i_{v}") + F.col(f"_b_{v}")).alias(f"below_{v}") for v in values])


def score_counts(df: DataFrame, group: list[str], label: str, score: str, weight=None) -> DataFrame:
    """(group, score, pos, neg): weights of the positives and negatives at each score; null labels and scores are left out."""
    w = F.lit(1) if weight is None else F.col(weight)
    known = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    yes = F.col(label).cast("boolean")
    return known.groupBy(*group, score).agg(F.sum(F.when(yes, w).otherwise(0)).alias("pos"), F.sum(F.when(~yes, w).otherwise(0)).alias("neg"))


def auroc_of_counts(counts: DataFrame, group: list[str], score: str = "score") -> DataFrame:
    """(group, auroc, n_pos, n_neg) of (group, score, pos, neg); ties count half, null where a class is missing."""
    inside = Window.partitionBy(*group, "_r").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy(*group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranked = _ranged(counts, group, score).withColumn("_below", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    wins = F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2.0))
    parts = ranked.groupBy(*group, "_r").agg(wins.alias("_w"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    parts = parts.withColumn("_c", F.coalesce(F.sum("_n").over(lower), F.lit(0)).cast("double"))
    out = parts.groupBy(*group).agg(F.sum(F.col("_w") + F.col("_p") * F.col("_c")).alias("_w"), F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"))
    return out.select(*group, ratio("_w", F.col("n_pos") * F.col("n_neg")).alias("auroc"), "n_pos", "n_neg")


def auroc(df: DataFrame, group: list[str], label: str, score: str, weight=None) -> DataFrame:
    """Mann-Whitney probability that a positive scores above a negative, half for ties; one row for each group.

    Rows with a null label or score are left out; a group without one of the classes has a null value.
    """
    return auroc_of_counts(score_counts(df, group, label, score, weight), group, score)


def average_rank(df: DataFrame, group: list[str], score: str, into: str = "rank") -> DataFrame:
    """Ranks from 1, ties averaged; null scores get a null rank."""
    counts = df.filter(F.col(score).isNotNull()).groupBy(*group, score).agg(F.count(F.lit(1)).alias("n"))
    ranked = _prefix(counts, group, score, ["n"]).select(*group, score, (F.col("below_n") + (F.col("n") + 1) / 2.0).alias(into))
    return df.join(ranked, [*group, score], "left")


def binary_coding(df: DataFrame, tag: str = "majority_tag", codings: dict | None = None) -> DataFrame:
    """Each row once for each coding, with label; unknown and null tags are dropped."""
    codings = codings or CODINGS
    out = each_of(df.filter(F.col(tag).isNotNull() & (F.col(tag) != "unknown")), list(codings), "coding")
    label = F.lit(False)
    for name, tags in codings.items():
        label = F.when(F.col("coding") == name, F.col(tag).isin(tags)).otherwise(label)
    return out.withColumn("label", label)


def confusion_rates(df: DataFrame) -> DataFrame:
    """Adds the rates of tp, fp, fn and tn columns; undefined ones are null."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    return df.withColumns({
        "precision": precision, "recall": recall, "specificity": specificity,
        "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn), "youden_j": recall + specificity - 1,
        "overflag_given_fail": ratio(fn, fn + tn), "overflag_given_supported": ratio(fn, tp + fn),
        "underflag_given_pass": ratio(fp, tp + fp), "underflag_given_unsupported": ratio(fp, fp + tn),
    })


def confusion_metrics(df: DataFrame, group: list[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    y, p = F.col(label).cast("boolean"), F.col(predicted).cast("boolean")
    counts = df.groupBy(*group).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    return confusion_rates(counts)


def threshold_sweep(df: DataFrame, group: list[str], label: str = "label", score: str = "score", status: str | None = None, grid=None) -> DataFrame:
    """Confusion metrics at each threshold (score >= t passes), of rows that a threshold governs: scored, and no FAIL_HEDGE.

    One pass: rows fall into the ranges between thresholds, and sums over the higher ranges give every count.
    """
    grid = grid or THRESHOLDS
    known = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    if status:
        known = known.filter(F.coalesce(F.col(status), F.lit("")) != "FAIL_HEDGE")
    bin_ = F.size(F.filter(F.array(*[F.lit(float(t)) for t in grid]), lambda t: t <= F.col(score)))
    y = F.col(label).cast("boolean")
    bins = known.groupBy(*group, bin_.alias("bin")).agg(F.count_if(y).alias("p"), F.count_if(~y).alias("n"))
    counts = bins.groupBy(*group).agg(F.collect_list(F.struct("bin", "p", "n")).alias("bins"))  # grid + 1 entries at most
    at = F.posexplode(F.array(*[F.lit(float(t)) for t in grid]))
    each = counts.select(*group, "bins", at.alias("i", "threshold"))
    total = lambda field, above: F.aggregate(F.filter("bins", lambda b: (b["bin"] > F.col("i")) == F.lit(above)), F.lit(0).cast("long"), lambda a, b: a + b[field])
    out = each.select(*group, "threshold", total("p", True).alias("tp"), total("n", True).alias("fp"), total("p", False).alias("fn"), total("n", False).alias("tn"))
    return confusion_rates(out)


def whatif_sweep(df: DataFrame, group: list[str], label: str = "label", score: str = "score", status: str = "status", grid=None) -> DataFrame:
    """As :func:`threshold_sweep` over all rows: those that no threshold governs keep their verdict; adds pass_rate."""
    passed = F.coalesce(F.col(status).startswith("PASS"), F.lit(False))
    governed = F.col(score).isNotNull() & (F.coalesce(F.col(status), F.lit("")) != "FAIL_HEDGE")
    fixed = df.withColumn("_s", F.when(governed, F.col(score)).otherwise(F.when(passed, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))))
    out = threshold_sweep(fixed, group, label, "_s", None, grid)
    return out.withColumn("pass_rate", ratio(F.col("tp") + F.col("fp"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def best_thresholds(sweep: DataFrame, group: list[str], current: float = 0.5) -> DataFrame:
    """The rows of largest F1, largest J (lowest threshold on ties) and the current threshold, by ``criterion``."""
    parts = []
    for name, c in (("f1", "f1"), ("youden_j", "youden_j")):
        order = Window.partitionBy(*group).orderBy(F.col(c).desc_nulls_last(), "threshold")
        parts.append(sweep.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n").withColumn("criterion", F.lit(name)))
    parts.append(sweep.filter(F.abs(F.col("threshold") - current) < 1e-9).withColumn("criterion", F.lit("current")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def point_biserial(df: DataFrame, group: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """(group, n, r): null below three rows or where a side is constant."""
    known = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    x, y = F.col(label).cast("boolean").cast("double"), F.col(score).cast("double")
    out = known.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("_r"), F.min(x).alias("_a"), F.max(x).alias("_b"), F.min(y).alias("_c"), F.max(y).alias("_d"))
    good = (F.col("n") >= 3) & (F.col("_a") < F.col("_b")) & (F.col("_c") < F.col("_d"))
    return out.select(*group, "n", F.when(good, F.col("_r")).alias("r"))


def chi_square_2x2(df: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Yates-corrected chi-square of two booleans, its p, Cramer's V, the least expected count, and whether that is under 5."""
    x, y = F.col(a).cast("boolean"), F.col(b).cast("boolean")
    t = df.groupBy(*group).agg(F.count_if(x & y).alias("n11"), F.count_if(x & ~y).alias("n10"), F.count_if(~x & y).alias("n01"), F.count_if(~x & ~y).alias("n00"))
    n11, n10, n01, n00 = (F.col(c).cast("double") for c in ("n11", "n10", "n01", "n00"))
    n = n11 + n10 + n01 + n00
    r1, r0, c1, c0 = n11 + n10, n01 + n00, n11 + n01, n10 + n00
    gap = F.abs(n11 * n00 - n10 * n01)
    chi = ratio(n * F.pow(F.greatest(gap - n / 2, F.lit(0.0)), 2), r1 * r0 * c1 * c0)
    least = F.least(r1 * c1, r1 * c0, r0 * c1, r0 * c0) / n
    out = t.withColumn("chi2", chi).withColumn("cramers_v", F.sqrt(F.col("chi2") / n)).withColumn("min_expected", least)
    return out.withColumn("small_expected", F.col("min_expected") < 5).withColumn("p_value", chi_square_p("chi2"))


def fisher_exact(df: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Counts, odds ratio (null where its denominator is 0) and two-sided p of two booleans."""
    x, y = F.col(a).cast("boolean"), F.col(b).cast("boolean")
    t = df.groupBy(*group).agg(F.count_if(x & y).alias("n11"), F.count_if(x & ~y).alias("n10"), F.count_if(~x & y).alias("n01"), F.count_if(~x & ~y).alias("n00"))
    return t.withColumn("odds_ratio", ratio(F.col("n11") * F.col("n00"), F.col("n10") * F.col("n01"))).withColumn("p_value", fisher_p("n11", "n10", "n01", "n00"))


def judge_evaluation(preds: DataFrame, group: list[str], truth: str = "majority_tag", label: str = "pred_label", confidence: str = "pred_confidence_supported") -> DataFrame:
    """(group, n, accuracy, auroc_strict, auroc_lenient) over rows with a known tag; confidence is the score."""
    known = preds.filter(F.col(truth).isNotNull())
    base = known.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col(label).isNotNull(), (F.col(label) == F.col(truth)).cast("double"))).alias("accuracy"))
    a = auroc(binary_coding(known, truth), [*group, "coding"], "label", confidence)
    for coding in CODINGS:
        part = a.filter(F.col("coding") == coding).select(*group, F.col("auroc").alias(f"auroc_{coding}"))
        base = base.join(part, group, "left") if group else base.withColumn("_k", F.lit(1)).join(part.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")
    return base


def failure_reasons(preds: DataFrame, group: list[str], reason: str = "pred_reasoning", label: str = "pred_label", top: int = 5) -> DataFrame:
    """The most frequent reasons of predictions without a label."""
    counts = preds.filter(F.col(label).isNull()).groupBy(*group, reason).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*group).orderBy(F.desc("n"), reason)
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def from_scores(scores: DataFrame, verifier: str, premise: str, threshold: float = 0.5) -> DataFrame:
    """The sentences of one verifier and premise, with status PASS or FAIL_NLI."""
    kept = scores.filter((F.col("verifier") == verifier) & (F.col("premise") == premise) & F.col("score").isNotNull() & ~F.col("is_negative_control").eqNullSafe(True))
    return kept.withColumn("status", F.when(F.col("score") >= threshold, "PASS").otherwise("FAIL_NLI"))


def score_profile(df: DataFrame, group: list[str], score: str = "score", mass: Column | None = None) -> DataFrame:
    """n, missing, distinct scores at six decimals, median mass and pass share at 0.5.

    Scores are counted by value before groups meet, and the median is an exact selection, so no task holds a group's values.
    """
    from attesta.operators.selection import quantiles

    marked = df.select(*group, F.col(score).alias("_score"), F.round(score, 6).alias("_rounded"), (F.lit(None).cast("double") if mass is None else mass).alias("_mass"))
    by_value = marked.groupBy(*group, "_rounded").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_score").isNull()).alias("_missing"), F.count_if(F.col("_score") >= 0.5).alias("_pass"), F.count("_score").alias("_known"))
    out = by_value.groupBy(*group).agg(F.sum("_n").alias("n"), F.sum("_missing").alias("n_missing"), F.count("_rounded").alias("n_distinct"), ratio(F.sum("_pass"), F.sum("_known")).alias("pass_share"))
    if mass is None:
        return out.select(*group, "n", "n_missing", "n_distinct", F.lit(None).cast("double").alias("median_mass"), "pass_share")
    middle = quantiles(marked, group, "_mass", [0.5]).select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("quantiles")[0].alias("median_mass"))
    met = out.join(middle, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group], "left") if group else out.withColumn("median_mass", middle.scalar())
    return met.select(*group, "n", "n_missing", "n_distinct", "median_mass", "pass_share")
