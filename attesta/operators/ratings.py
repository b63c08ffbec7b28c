"""Rating studies: item and sentence summaries, agreement and reliability statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import lexicon as fixed
from attesta.functions.columns import mapped, no_nan, ratio
from attesta.functions.statistics import correlation_p
from attesta.operators.ranking import average_rank

DIMS = ["faithfulness", "actionability", "clarity"]
LEVELS = {"unsupported": 0, "partial": 1, "supported": 2}


def first_known(value: str, order: str = "row_id"):
    """The value of the first row, in order, where it is known."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def item_summary(resp: DataFrame, dims=None, item="item_id", rater="rater_id", order="row_id") -> DataFrame:
    """(item, n_raters, mean_<dim>): the first known value of each item and rater counts."""
    dims = [d for d in (dims or DIMS) if d in resp.columns]
    one = resp.groupBy(item, rater).agg(*[first_known(d, order).alias(d) for d in dims])
    return one.groupBy(item).agg(F.count(F.lit(1)).alias("n_raters"), *[F.avg(no_nan(d)).alias(f"mean_{d}") for d in dims])


def with_key(summary: DataFrame, key: DataFrame, item="item_id", key_item="item_id") -> DataFrame:
    """Left join of the answer key by item."""
    return summary.join(key.withColumnRenamed(key_item, item), item, "left")


def unmatched_items(resp: DataFrame, key: DataFrame, item="item_id", key_item="item_id") -> DataFrame:
    """(item, side): ids that only the ratings or only the key have."""
    a, b = resp.select(item).distinct(), key.select(F.col(key_item).alias(item)).distinct()
    return a.join(b, item, "left_anti").withColumn("side", F.lit("ratings")).unionByName(b.join(a, item, "left_anti").withColumn("side", F.lit("key")))


def tag_counts(resp: DataFrame, keys: list[str], tag="tag", order: str | None = None) -> DataFrame:
    extra = [F.min(order).alias("first_row")] if order else []
    return resp.filter(F.col(tag).isNotNull()).groupBy(*keys, tag).agg(F.count(F.lit(1)).alias("n"), *extra)


def sentence_summary(resp: DataFrame, keys=("item_id", "sentence_id"), tag="tag") -> DataFrame:
    """(keys, n_raters, majority_tag, tag_distribution): the most frequent tag, alphabetically first on ties, and
    "tag:n" by descending count. A sentence has few tags, so the gathered list is short."""
    counts = tag_counts(resp, list(keys), tag).groupBy(*keys).agg(F.sum("n").alias("n_raters"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(tag).alias("t")))).alias("_d"))
    text = F.array_join(F.transform("_d", lambda x: F.concat(x["t"], F.lit(":"), (-x["m"]).cast("string"))), ";")
    return counts.select(*keys, "n_raters", F.col("_d")[0]["t"].alias("majority_tag"), text.alias("tag_distribution"))


def majority_first_seen(resp: DataFrame, keys=("item_id", "sentence_id"), tag="tag", order="row_id") -> DataFrame:
    """The most frequent tag; on ties the one met first."""
    counts = tag_counts(resp, list(keys), tag, order)
    best = F.min_by(tag, F.struct((-F.col("n")).alias("m"), "first_row"))
    return counts.groupBy(*keys).agg(best.alias("majority_tag"))


def is_tied(distribution):
    """Whether the two largest counts of a "tag:n;tag:n" text, in descending order, are equal."""
    parts = F.split(distribution, ";")
    n = lambda i: F.element_at(F.split(F.get(parts, F.lit(i)), ":"), -1).try_cast("int")
    return F.coalesce((F.size(parts) > 1) & (n(0) == n(1)), F.lit(False))


def core_items(resp: DataFrame, min_raters: int | None = None, item="item_id", rater="rater_id") -> DataFrame:
    """Items rated by at least ``min_raters``, or by every rater there is."""
    counts = resp.groupBy(item).agg(F.count_distinct(rater).alias("_n"))
    least = F.lit(min_raters) if min_raters is not None else resp.agg(F.count_distinct(rater)).scalar()
    return counts.filter(F.col("_n") >= least).select(item)


def fleiss_kappa(resp: DataFrame, keys=("item_id", "sentence_id"), tag="tag", categories=tuple(fixed.TAGS)) -> DataFrame:
    """One row: kappa, p_bar, p_e, n_subjects, n_dropped, n_ratings of subjects with the commonest number of ratings."""
    wide = resp.filter(F.col(tag).isin(*categories)).groupBy(*keys).pivot(tag, list(categories)).agg(F.count(F.lit(1))).fillna(0, list(categories))
    total = sum((F.col(c) for c in categories), F.lit(0))
    wide = wide.withColumn("_n", total)
    sizes = wide.groupBy("_n").agg(F.count(F.lit(1)).alias("_c"))
    modal = sizes.agg(F.min_by("_n", F.struct((-F.col("_c")).alias("c"), "_n"))).scalar()
    kept = wide.withColumn("_m", modal).withColumn("_in", F.col("_n") == F.col("_m"))
    agree = (sum((F.col(c) * F.col(c) for c in categories), F.lit(0)) - F.col("_n")) / (F.col("_n") * (F.col("_n") - 1))
    s = kept.agg(F.avg(F.when(F.col("_in") & (F.col("_n") > 1), agree)).alias("p_bar"), *[F.sum(F.when(F.col("_in"), F.col(c))).alias(c) for c in categories], F.count_if("_in").alias("n_subjects"), F.count_if(~F.col("_in")).alias("n_dropped"), F.max("_m").alias("n_ratings"))
    grand = sum((F.col(c) for c in categories), F.lit(0)).cast("double")
    s = s.withColumn("p_e", sum((F.pow(F.col(c) / grand, 2) for c in categories), F.lit(0.0)))
    return s.select(ratio(F.col("p_bar") - F.col("p_e"), 1 - F.col("p_e")).alias("kappa"), "p_bar", "p_e", "n_subjects", "n_dropped", "n_ratings")


def _distance(a, b, unknown: str):
    x, y = mapped(LEVELS, F.col(a)), mapped(LEVELS, F.col(b))
    gap = F.when(F.col(a) == F.col(b), 0).when(x.isNotNull() & y.isNotNull(), F.abs(x - y)).otherwise(2 if unknown == "penalise" else None)
    return F.pow(gap.cast("double") / 2, 2)


def weighted_kappa_pairs(resp: DataFrame, unknown: str = "exclude", keys=("item_id", "sentence_id"), rater="rater_id", tag="tag") -> DataFrame:
    """(rater_a, rater_b, n, kappa): quadratic weights over unsupported < partial < supported, for each pair of raters.

    unknown: left out of a pair's sentences, or kept at the largest distance. A pair is null below two sentences,
    below two tags, or where no disagreement is expected. Pairs are made inside a sentence only, of its few raters.
    """
    used = resp.filter(F.col(tag).isNotNull()).select(*keys, rater, tag)
    if unknown == "exclude":
        used = used.filter(F.col(tag) != "unknown")
    used = used.dropDuplicates([*keys, rater])
    pair = used.withColumnsRenamed({rater: "rater_a", tag: "ta"}).join(used.withColumnsRenamed({rater: "rater_b", tag: "tb"}), list(keys)).filter("rater_a < rater_b")
    cells = pair.groupBy("rater_a", "rater_b", "ta", "tb").agg(F.count(F.lit(1)).alias("n"))
    a = cells.groupBy("rater_a", "rater_b", "ta").agg(F.sum("n").alias("na"))
    b = cells.groupBy("rater_a", "rater_b", "tb").agg(F.sum("n").alias("nb"))
    expected = a.join(b, ["rater_a", "rater_b"]).withColumn("w", _distance("ta", "tb", unknown))
    expected = expected.groupBy("rater_a", "rater_b").agg(F.sum(F.col("w") * F.col("na") * F.col("nb")).alias("e"))
    observed = cells.withColumn("w", _distance("ta", "tb", unknown)).groupBy("rater_a", "rater_b").agg(F.sum(F.col("w") * F.col("n")).alias("o"), F.sum("n").alias("n"), F.size(F.array_union(F.collect_set("ta"), F.collect_set("tb"))).alias("tags"))
    both = observed.join(expected, ["rater_a", "rater_b"])
    kappa = 1 - ratio("o", F.col("e") / F.col("n"))
    return both.select("rater_a", "rater_b", "n", F.when((F.col("n") >= 2) & (F.col("tags") >= 2), kappa).alias("kappa"))


def weighted_kappa(resp: DataFrame, unknown: str = "exclude", **names) -> DataFrame:
    """One row: the mean over pairs of raters, and how many pairs have a value."""
    pairs = weighted_kappa_pairs(resp, unknown, **names)
    return pairs.agg(F.avg("kappa").alias("mean_kappa"), F.count("kappa").alias("n_pairs"))


def icc_2_1(resp: DataFrame, dim: str, item="item_id", rater="rater_id", order="row_id") -> DataFrame:
    """One row: icc, msr, msc, mse, n_items, n_raters, n_dropped; two-way random, single rater, items that all rated."""
    one = resp.groupBy(item, rater).agg(first_known(dim, order).cast("double").alias("x")).filter("x is not null")
    # a row for each item with its raters' values; an item has few raters
    items = one.groupBy(item).agg(F.collect_list(F.struct(F.col(rater).alias("r"), "x")).alias("v"))
    raters = items.select(F.explode("v.r").alias("r")).agg(F.count_distinct("r")).scalar()
    sized = items.withColumn("k", raters).withColumn("c", F.size("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, b: a + b["x"])
    square = F.aggregate("v", F.lit(0.0), lambda a, b: a + b["x"] * b["x"])
    whole = F.col("c") == F.col("k")
    # sums by rater, and over all in the row without one
    long = sized.select("k", whole.alias("in"), total.alias("t"), square.alias("q"), F.explode(F.concat(F.col("v"), F.array(F.struct(F.lit(None).alias("r"), F.lit(0.0).alias("x"))))).alias("e"))
    by = long.groupBy(F.col("e.r").alias("r")).agg(F.max("k").cast("double").alias("k"), F.count_if("in").alias("n"), F.count_if(~F.col("in")).alias("out"), F.sum(F.when(F.col("in"), F.col("e.x"))).alias("x"), F.sum(F.when(F.col("in"), F.col("t"))).alias("t"), F.sum(F.when(F.col("in"), F.col("t") * F.col("t"))).alias("tt"), F.sum(F.when(F.col("in"), F.col("q"))).alias("q"))
    pick = lambda c: F.max(F.when(F.col("r").isNull(), F.col(c)))
    s = by.agg(pick("k").alias("k"), pick("n").cast("double").alias("n"), pick("out").alias("n_dropped"), pick("t").alias("t"), pick("tt").alias("tt"), pick("q").alias("q"), F.sum(F.when(F.col("r").isNotNull(), F.col("x") * F.col("x"))).alias("rr"))
    grand = F.col("t") * F.col("t") / (F.col("n") * F.col("k"))
    s = s.withColumns({"ssr": F.col("tt") / F.col("k") - grand, "ssc": F.col("rr") / F.col("n") - grand})
    s = s.withColumn("sse", F.col("q") - grand - F.col("ssr") - F.col("ssc"))
    msr, msc, mse = ratio("ssr", F.col("n") - 1), ratio("ssc", F.col("k") - 1), ratio("sse", (F.col("n") - 1) * (F.col("k") - 1))
    s = s.withColumns({"msr": msr, "msc": msc, "mse": mse})
    icc = ratio(F.col("msr") - F.col("mse"), F.col("msr") + (F.col("k") - 1) * F.col("mse") + F.col("k") * (F.col("msc") - F.col("mse")) / F.col("n"))
    return s.select(icc.alias("icc"), "msr", "msc", "mse", F.col("n").cast("long").alias("n_items"), F.col("k").cast("long").alias("n_raters"), "n_dropped")


def rater_profiles(resp: DataFrame, dims=None, item="item_id", rater="rater_id", tag="tag", order="row_id") -> DataFrame:
    """(rater, n_tags, pct_<tag>, mean_<dim>): tag shares in percent, and score means over the first row of each item."""
    dims = [d for d in (dims or DIMS) if d in resp.columns]
    tags = resp.filter(F.col(tag).isNotNull()).groupBy(rater).agg(F.count(F.lit(1)).alias("n_tags"), *[F.round(100 * F.count_if(F.col(tag) == t) / F.count(F.lit(1)), 1).alias(f"pct_{t}") for t in fixed.TAGS])
    one = resp.groupBy(rater, item).agg(*[F.min_by(d, order).alias(d) for d in dims])
    means = one.groupBy(rater).agg(*[F.round(F.avg(d), 2).alias(f"mean_{d}") for d in dims])
    return tags.join(means, rater, "left")


def control_detection(resp: DataFrame, key: DataFrame, gate: float = 0.7, item="item_id", rater="rater_id", tag="tag", score="faithfulness", control="is_negative_control") -> DataFrame:
    """(rater or null for all, n, n_detected, rate, passes): a control is detected where the rater's commonest tag is
    unsupported (alphabetically first on ties) or the score is at most 2."""
    controls = key.filter(F.col(control).eqNullSafe(True)).select(item).distinct()
    rows = resp.join(controls, item, "left_semi")
    one = rows.groupBy(item, rater).agg(F.mode(tag, True).alias("t"), F.min(score).alias("s"))
    seen = one.withColumn("hit", F.coalesce((F.col("t") == "unsupported"), F.lit(False)) | F.coalesce(F.col("s") <= 2, F.lit(False)))
    out = seen.rollup(rater).agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("n_detected"), F.grouping(rater).alias("_g"))
    return out.select(rater, "n", "n_detected", ratio("n_detected", "n").alias("rate"), (ratio("n_detected", "n") >= gate).alias("passes"))


def discrepancies_item(df: DataFrame, auto="auto_rate", human="mean_faithfulness") -> DataFrame:
    """Items that the automatic score and the raters see differently, by kind."""
    kind = F.when((F.col(auto) >= 0.7) & (F.col(human) <= 2), "under_detection").when((F.col(auto) <= 0.3) & (F.col(human) >= 4), "over_flag")
    return df.withColumn("kind", kind).filter("kind is not null")


def discrepancies_sentence(df: DataFrame, status="auto_status", tag="majority_tag") -> DataFrame:
    kind = F.when(F.col(status).startswith("PASS") & (F.col(tag) == "unsupported"), "under_detection").when(F.col(status).isin("FAIL_NLI", "FAIL_INVALID_REF") & (F.col(tag) == "supported"), "over_flag")
    return df.withColumn("kind", kind).filter("kind is not null")


def crosstab(df: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    """Counts of a by the given values of b; rows with a null in either are left out."""
    kept = df.filter(F.col(a).isNotNull() & F.col(b).isin(*values))
    return kept.groupBy(a).pivot(b, values).agg(F.count(F.lit(1))).fillna(0, values)


def item_auto_scores(scores: DataFrame, verifier: str, premise: str, threshold: float = 0.5, item="item_id") -> DataFrame:
    """(item, mean_score, auto_rate, n_sentences) of one verifier and premise, controls left out."""
    kept = scores.filter((F.col("verifier") == verifier) & (F.col("premise") == premise) & ~F.col("is_negative_control").eqNullSafe(True) & F.col("score").isNotNull())
    return kept.groupBy(item).agg(F.avg("score").alias("mean_score"), F.avg((F.col("score") >= threshold).cast("double")).alias("auto_rate"), F.count(F.lit(1)).alias("n_sentences"))


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, pearson, pearson_p, spearman, spearman_p over pairs where both are known; null below three."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ranked = average_rank(average_rank(known, [], "x", "rx"), [], "y", "ry")
    s = ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("_p"), F.corr("rx", "ry").alias("_s"))
    good = F.col("n") >= 3
    s = s.withColumns({"pearson": F.when(good, F.nanvl("_p", F.lit(None))), "spearman": F.when(good, F.nanvl("_s", F.lit(None)))})
    return s.select("n", "pearson", correlation_p("pearson", "n").alias("pearson_p"), "spearman", correlation_p("spearman", "n").alias("spearman_p"))


def exclude_raters(resp: DataFrame, raters: list[str], rater="rater_id") -> DataFrame:
    return resp.filter(~F.col(rater).isin(*raters)) if raters else resp


def merged_responses(resp: DataFrame, key: DataFrame, item="item_id", key_item="item_id") -> DataFrame:
    return resp.join(key.withColumnRenamed(key_item, item), item, "left")


def loo_human(tags: DataFrame, keys=("item_id", "sentence_id"), rater="rater_id", tag="tag") -> DataFrame:
    """(coding, rater, n, n_ties, balanced_accuracy): each rater against the strict majority of the others.

    Unknown tags are missing; sentences on which the others tie are left out and counted.
    """
    from attesta.operators.ranking import binary_coding

    coded = binary_coding(tags, tag)
    over = Window.partitionBy("coding", *keys)
    yes = F.col("label").cast("long")
    rest = coded.withColumn("_n", F.count(F.lit(1)).over(over) - 1).withColumn("_y", F.sum(yes).over(over) - yes)
    rest = rest.filter(F.col("_n") > 0)
    truth = F.when(F.col("_y") * 2 > F.col("_n"), F.lit(True)).when(F.col("_y") * 2 < F.col("_n"), F.lit(False))
    rest = rest.withColumn("_t", truth)
    sens = F.avg(F.when(F.col("_t"), F.col("label").cast("double")))
    spec = F.avg(F.when(~F.col("_t"), (~F.col("label")).cast("double")))
    return rest.groupBy("coding", rater).agg(F.count("_t").alias("n"), F.count_if(F.col("_t").isNull()).alias("n_ties"), ((sens + spec) / 2).alias("balanced_accuracy"))


def cohen_kappa(df: DataFrame, a: str, b: str, levels: list[str]) -> DataFrame:
    """One row: n, agreement, kappa, quadratic_kappa of two codings of the same rows over the given ordered levels."""
    kept = df.filter(F.col(a).isin(*levels) & F.col(b).isin(*levels))
    at = {v: i for i, v in enumerate(levels)}
    cells = kept.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    pa, pb = rows.withColumn("_k", F.lit(1)), cols.withColumn("_k", F.lit(1))
    top = max(len(levels) - 1, 1)
    w = F.pow((mapped(at, F.col("a")) - mapped(at, F.col("b"))).cast("double") / top, 2)
    same = F.col("a") == F.col("b")
    e = pa.join(pb, "_k").agg(F.sum(F.when(same, F.col("na") * F.col("nb")).otherwise(0)).alias("ea"), F.sum(w * F.col("na") * F.col("nb")).alias("ew"))
    o = cells.agg(F.sum("n").alias("n"), F.sum(F.when(same, F.col("n")).otherwise(0)).alias("oa"), F.sum(w * F.col("n")).alias("ow"))
    both = o.withColumn("_k", F.lit(1)).join(e.withColumn("_k", F.lit(1)), "_k")
    agree, chance = ratio("oa", "n"), ratio("ea", F.col("n") * F.col("n"))
    return both.select("n", agree.alias("agreement"), ratio(agree - chance, 1 - chance).alias("kappa"), (1 - ratio(F.col("ow"), F.col("ew") / F.col("n"))).alias("quadratic_kappa"))


def free_text_by_item(resp: DataFrame, item="item_id", rater="rater_id", text="free_text") -> DataFrame:
    """(item, comments): distinct comments as "R1: .. | R2: ..", by rater and text."""
    kept = resp.filter(F.coalesce(F.trim(text), F.lit("")) != "").select(item, rater, F.trim(text).alias("t")).distinct()
    lines = F.transform(F.array_sort(F.collect_list(F.struct(rater, "t"))), lambda x: F.concat(x[rater], F.lit(": "), x["t"]))
    return kept.groupBy(item).agg(F.array_join(lines, " | ").alias("comments"))
