"""Verifiers against each other: analysis sets, wide tables, AUROC tables, paired differences and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.columns import each_of
from attesta.operators.bootstrap import Resamples, View, cluster_auroc_ci, cluster_paired_diff, each_view, holm
from attesta.operators.ranking import CODINGS, auroc
from attesta.operators.ratings import is_tied
from attesta.sources.io import fix_tag_typos

KEYS = ["item_id", "sentence_id"]


def analysis_set(df: DataFrame) -> DataFrame:
    """No controls (an unknown flag counts as none), a fact premise, a score, a tag other than unknown."""
    keep = ~F.col("is_negative_control").eqNullSafe(True) & F.col("score").isNotNull() & F.col("majority_tag").isNotNull() & (F.col("majority_tag") != "unknown")
    return df.filter(keep & F.col("fact_premise").isNotNull() if "fact_premise" in df.columns else keep)


def filter_sentences(df: DataFrame, key: DataFrame | None = None, keep_controls: bool = False, core_only: bool = False, exclude_ties: bool = False) -> DataFrame:
    """Tags spelt right, the item key joined, then controls, other than core items, and ties left out as asked.

    A missing control flag is kept, a missing core flag is not core.
    """
    out = df.filter(F.col("majority_tag").isNotNull()).withColumn("majority_tag", fix_tag_typos("majority_tag"))
    if key is not None:
        out = out.drop(*[c for c in key.columns if c in out.columns and c != "item_id"]).join(key, "item_id", "left")
    if not keep_controls and "is_negative_control" in out.columns:
        out = out.filter(~F.col("is_negative_control").eqNullSafe(True))
    if core_only:
        out = out.filter(F.col("is_core").eqNullSafe(True))
    if exclude_ties and "tag_distribution" in out.columns:
        out = out.filter(~is_tied(F.col("tag_distribution")))
    return out


def to_wide(df: DataFrame, columns: list[str], meta=("majority_tag", "is_core", "is_negative_control"), keys=tuple(KEYS), names: dict | None = None, template: str = "{verifier}__{premise}") -> DataFrame:
    """One row a sentence with a score column for each of the given "verifier__premise" names. Values are the least of
    a cell, so that repeats give the same table on any partitioning."""
    verifier = F.col("verifier")
    for a, b in (names or {}).items():
        verifier = F.when(F.col("verifier") == a, F.lit(b)).otherwise(verifier)
    parts = template.replace("{premise}", "{verifier}").split("{verifier}")
    named = df.withColumn("_c", F.concat(F.lit(parts[0]), verifier, F.lit(parts[1]), F.col("premise"), F.lit(parts[2])))
    about = df.groupBy(*keys).agg(*[F.min(m).alias(m) for m in meta if m in df.columns])
    wide = named.groupBy(*keys).pivot("_c", columns).agg(F.min("score"))
    return about.join(wide, list(keys))


def scoped(df: DataFrame, core: str = "is_core") -> DataFrame:
    """Each row once in scope all, and once more in scope core where it is core."""
    return each_of(df, ["all", "core"], "scope").filter((F.col("scope") == "all") | F.col(core).eqNullSafe(True))


def scopes(core: str = "is_core") -> list[View]:
    """The views of :func:`scoped`, for which no row is repeated."""
    return [View({"scope": "all"}, F.lit(True), None), View({"scope": "core"}, F.col(core).eqNullSafe(True), None)]


def codings(tag: str = "majority_tag", tags: dict | None = None) -> list[View]:
    """The views of ``binary_coding``, for which no row is repeated."""
    known = F.col(tag).isNotNull() & (F.col(tag) != "unknown")
    return [View({"coding": name}, known, F.col(tag).isin(yes)) for name, yes in (tags or CODINGS).items()]


def auroc_table(df: DataFrame, reps: int = 10_000, seed=42, cluster: str = "item_id") -> DataFrame:
    """AUROC with its interval by verifier, premise, scope and coding: one job over all of them, on the same resamples."""
    return cluster_auroc_ci(analysis_set(df), ["verifier", "premise"], cluster, "label", "score", reps, seed, views=each_view(scopes(), codings()))


def paired_premise(df: DataFrame, a: str = "record", b: str = "fact", reps: int = 10_000, seed=42, cluster: str = "item_id", family: list[str] | None = None) -> DataFrame:
    """Score on premise a minus on b, on sentences that have both, by verifier, scope and coding, with Holm's p over ``family``."""
    keys = [*dict.fromkeys([*KEYS, cluster]), "verifier", "majority_tag", "is_core"]
    wide = analysis_set(df).groupBy(*keys).pivot("premise", [a, b]).agg(F.min("score"))
    out = cluster_paired_diff(wide, ["verifier"], cluster, "label", a, b, reps, seed, views=each_view(scopes(), codings()))
    return holm(out, family or [], "p_value")


def paired_vs_baseline(df: DataFrame, baseline: str, reps: int = 10_000, seed=42, cluster: str = "item_id", family: list[str] | None = None) -> DataFrame:
    """Each verifier minus the baseline on the sentences that both scored, by premise, scope and coding."""
    keys = [*dict.fromkeys([*KEYS, cluster]), "premise"]
    kept = analysis_set(df)
    base = kept.filter(F.col("verifier") == baseline).groupBy(*keys).agg(F.min("score").alias("base"))
    rest = kept.filter(F.col("verifier") != baseline).join(base, keys)
    out = cluster_paired_diff(rest, ["verifier", "premise"], cluster, "label", "score", "base", reps, seed, views=each_view(scopes(), codings()))
    return holm(out, family or [], "p_value")


def control_scores(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """n, mean and pass share by verifier, premise and whether the item is a control."""
    kept = df.filter(F.col("score").isNotNull()).withColumn("control", F.col("is_negative_control").eqNullSafe(True))
    return kept.groupBy("verifier", "premise", "control").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg((F.col("score") >= threshold).cast("double")).alias("pass_rate"))


def within_indicator(df: DataFrame, indicator: str = "indicator", single_only: bool = False) -> DataFrame:
    """By verifier, premise and indicator, and pooled over all sentences (``single_only``: those of one citation): n,
    mean score, and the AUROC of supported against unsupported sentences with both counts."""
    kept = analysis_set(df)
    pooled = F.array(F.lit("pooled")) if not single_only else F.when(F.col(indicator).isNotNull(), F.array(F.lit("pooled"))).otherwise(F.array().cast("array<string>"))
    own = F.when(F.col(indicator).isNotNull(), F.array(F.col(indicator).cast("string"))).otherwise(F.array().cast("array<string>"))
    long = kept.withColumn("group", F.explode(F.concat(own, pooled)))
    about = long.groupBy("verifier", "premise", "group").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))
    label = F.when(F.col("majority_tag") == "supported", True).when(F.col("majority_tag") == "unsupported", False)
    found = auroc(long.withColumn("label", label), ["verifier", "premise", "group"], "label", "score")
    return about.join(found.withColumnsRenamed({"n_pos": "n_supported", "n_neg": "n_unsupported"}), ["verifier", "premise", "group"], "left")


def nli_subsets(df: DataFrame, exclude: str, cited: str = "cited_indicators", reps: int = 10_000, seed=42, cluster: str = "item_id") -> DataFrame:
    """AUROC of all sentences and of those whose citations don't contain ``exclude``, by verifier, premise and coding."""
    rest = ~F.coalesce(F.contains(F.col(cited), F.lit(exclude)), F.lit(False))
    subsets = [View({"subset": "all"}, F.lit(True), None), View({"subset": f"without_{exclude}"}, rest, None)]
    return cluster_auroc_ci(analysis_set(df), ["verifier", "premise"], cluster, "label", "score", reps, seed, views=each_view(subsets, codings()))


def reproduction_check(summary: DataFrame, expected: DataFrame, keys: list[str], tolerance: float = 0.005) -> DataFrame:
    """Expected rows (keys, n, auroc) with what was found, and ok: the same n and a value within the tolerance."""
    want = expected.withColumnsRenamed({"n": "expected_n", "auroc": "expected_auroc"})
    both = want.join(summary.select(*keys, "n", "auroc"), keys, "left")
    ok = F.coalesce((F.col("n") == F.col("expected_n")) & (F.abs(F.col("auroc") - F.col("expected_auroc")) <= tolerance), F.lit(False))
    return both.withColumn("ok", ok)


def interpretation_flags(summary: DataFrame, baseline: str, keys=("scope", "coding")) -> DataFrame:
    """From an AUROC table, by keys: whether all fact intervals hold 0.5, whether any verifier beyond the baseline is
    above it on facts, and whether facts say nothing while records do."""
    holds = (F.col("ci_lo") <= 0.5) & (F.col("ci_hi") >= 0.5)
    above = F.col("ci_lo") > 0.5
    fact, record = F.col("premise") == "fact", F.col("premise") == "record"
    return summary.groupBy(*keys).agg(
        F.bool_and(F.when(fact, holds)).alias("all_fact_null"),
        F.coalesce(F.bool_or(F.when(fact & (F.col("verifier") != baseline), above)), F.lit(False)).alias("stronger_above_on_fact"),
        (F.coalesce(F.bool_and(F.when(fact, holds)), F.lit(False)) & F.coalesce(F.bool_or(F.when(record, above)), F.lit(False))).alias("fact_null_record_clear"),
    )


def premise_pairing(fact: DataFrame, record: DataFrame, name: str) -> DataFrame:
    """The rows of two premises under one verifier name."""
    return fact.withColumn("verifier", F.lit(name)).unionByName(record.withColumn("verifier", F.lit(name)), allowMissingColumns=True)


def replace_verifier(base: DataFrame, new: DataFrame) -> DataFrame:
    """``base`` without the verifiers that ``new`` has, and the rows of ``new``."""
    return base.join(new.select("verifier").distinct(), "verifier", "left_anti").unionByName(new, allowMissingColumns=True)


def shared_resamples(df: DataFrame, reps: int, seed=42, cluster: str = "item_id") -> Resamples:
    """Resamples for several tables over the same items."""
    return Resamples(df, cluster, reps, seed)
