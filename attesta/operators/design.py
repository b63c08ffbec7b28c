"""Study design: samples, strata, controls, assignments and folds, all ordered by hashes of keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.hashing import stable_key
from attesta.operators import scan
from attesta.operators.selection import quantiles


def _with(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` joined with ``small`` on keys that may be null, which a plain join would drop."""
    if not keys:
        return df.withColumn("_one", F.lit(1)).join(small.withColumn("_one", F.lit(1)), "_one").drop("_one")
    other = small.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(other[f"_k_{i}"]) for i, k in enumerate(keys)])
    return df.join(other, on).drop(*[f"_k_{i}" for i in range(len(keys))])


def ranked(df: DataFrame, by: list[str], seed, key: str, into: str = "n", parts: tuple = ()) -> DataFrame:
    """Rows numbered from 1 inside ``by`` in the order of a hash of seed, ``parts`` and ``key``.

    Ranges of the hash's first three digits are numbered apart and then shifted, so no group, however large, is in one
    task.
    """
    hashed = df.withColumn("_hash", stable_key(seed, *[F.col(c) for c in parts], F.col(key)))
    hashed = hashed.withColumn("_range", F.substring("_hash", 1, 3))
    sizes = hashed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_size"))
    shift = sizes.withColumn("_shift", F.sum("_size").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_size")).drop("_size")  # 4096 rows a group
    inner = Window.partitionBy(*by, "_range").orderBy("_hash", key)
    out = _with(hashed.withColumn("_inside", F.row_number().over(inner)), shift, [*by, "_range"])
    return out.select(*df.columns, (F.col("_inside") + F.col("_shift")).alias(into))


def numbered(df: DataFrame, seed, key: str, into: str = "n") -> DataFrame:
    """Rows numbered from 0 in the order of a hash, without one task for all. ``key`` names a row."""
    return ranked(df, [], seed, key, "_1").withColumn(into, F.col("_1") - 1).drop("_1")


def candidate_pool(df: DataFrame, pool_size: int, seed, category: str = "category", key: str = "row_id", whole: int = 2000) -> DataFrame:
    """All rows of a category of at most ``whole``, else max(10, pool_size // 5) of it by hash."""
    sizes = df.groupBy(category).agg(F.count(F.lit(1)).alias("_c"))
    out = ranked(df, [category], seed, key, "_n").join(sizes, category)
    return out.filter((F.col("_c") <= whole) | (F.col("_n") <= max(10, pool_size // 5))).select(df.columns)


def item_context(df: DataFrame, window: int = 4, student: str = "student_id", skill: str = "skill", step: str = "step_idx") -> DataFrame:
    """Each row with steps: its last attempts at the skill up to itself, oldest first, and the newest one's accuracy and hints.

    The segments of a long student get the last attempts of those before.
    """
    fields = F.struct(F.col(step).alias("step"), (F.col("correct") == 1).alias("correct"), F.coalesce(F.round("hint_raw"), F.col("hint_scaled")).alias("hint_count"), "response_time_ratio")
    keys, order = [student, skill], [F.col(step).asc()]
    cut = scan.segmented(df, student, order)
    over = scan.inside(keys, order).rowsBetween(-(window - 1), 0)
    out = cut.withColumn("_steps", F.collect_list(fields).over(over))
    tails = scan.carried(out, keys, _tail=F.max_by("_steps", F.col(step)))
    before = Window.partitionBy(*keys).orderBy(scan.SEGMENT).rowsBetween(-(window - 1), -1)  # each has a row at least
    tails = tails.select(*keys, scan.SEGMENT, F.flatten(F.collect_list("_tail").over(before)).alias("_carry"))
    both = F.concat(F.coalesce("_carry", F.array().cast(out.schema["_steps"].dataType)), "_steps")
    last = F.when(F.size("_both") > window, F.slice("_both", F.size("_both") - window + 1, F.lit(window))).otherwise(F.col("_both"))
    return scan.finish(scan.with_carry(out, tails, keys).withColumn("_both", both).withColumn("steps", last), df, "steps")


def tertiles(df: DataFrame, value: str, into: str = "tertile") -> DataFrame:
    """low, mid or high by the linearly interpolated third quantiles; rows without a value are left out."""
    known = df.filter(F.col(value).isNotNull())
    marked = known.withColumn("_q", quantiles(known, [], value, [1 / 3, 2 / 3], "q").scalar())
    return marked.withColumn(into, F.when(F.col(value) <= F.col("_q")[0], "low").when(F.col(value) <= F.col("_q")[1], "mid").otherwise("high")).drop("_q")


def stratified_sample(df: DataFrame, n: int, most: int, seed, strata=("category", "tertile"), key: str = "row_id") -> DataFrame:
    """At most ``most`` rows of each cell, and n in all, both by hash."""
    cell = ranked(df, list(strata), seed, key, "_n").filter(F.col("_n") <= most).drop("_n")
    return cell.orderBy(stable_key(seed, F.lit("all"), F.col(key)), key).limit(n)


def stratum_report(df: DataFrame, sample: DataFrame, least: int, strata=("category", "tertile")) -> DataFrame:
    """(strata, n_available, n_sampled, shortfall) of every cell."""
    a = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n_available"))
    b = sample.groupBy(*strata).agg(F.count(F.lit(1)).alias("n_sampled"))
    out = a.join(b, list(strata), "left").fillna(0, ["n_sampled"])
    return out.withColumn("shortfall", F.greatest(F.lit(0), least - F.col("n_sampled")))


def n_controls(k: int, fraction: float) -> int:
    """How many controls make the given share with k real items; halves go to the even number."""
    return max(1, round(k * fraction / (1 - fraction)))


def negative_controls(items: DataFrame, n: int, seed, category: str = "category", key: str = "item_id") -> DataFrame:
    """(host, donor, host_category, donor_category) of n items that get the sentences of an item of another category.

    Donors are the items in order of category, turned by the size of the largest category; each item is at most once
    a host and once a donor. Where one category holds more than half of the items, its surplus has no donor.
    """
    placed = items.select(F.col(key).alias("k"), F.col(category).alias("c"), stable_key(seed, F.col(key)).alias("_h")).withColumnRenamed("c", category)
    sized = placed.groupBy(category).agg(F.count(F.lit(1)).alias("m"))
    start = sized.withColumn("s", F.sum("m").over(Window.orderBy(category)) - F.col("m"))  # as many rows as categories
    within = ranked(placed, [category], seed, "k", "_n").join(start, category)
    order = within.withColumn("p", F.col("s") + F.col("_n") - 1)
    shape = sized.agg(F.struct(F.sum("m").alias("t"), F.max("m").alias("x"))).scalar()
    turned = order.withColumn("_s", shape).withColumn("d", F.pmod(F.col("p") + F.col("_s.x"), F.col("_s.t")))
    pairs = turned.select(F.col("k").alias("host"), F.col(category).alias("host_category"), "_h", "d").join(order.select(F.col("p").alias("d"), F.col("k").alias("donor"), F.col(category).alias("donor_category")), "d")
    return pairs.filter("host_category <> donor_category").orderBy("_h", "host").limit(n).select("host", "donor", "host_category", "donor_category")


def assign_raters(items: DataFrame, raters: list[str], core_n: int, seed, category: str = "category", key: str = "item_id") -> DataFrame:
    """(item, rater, in_core): ``core_n`` items, taken from the categories in turn, go to every rater; the others are dealt."""
    inside = ranked(items, [category], seed, key, "_n")
    # one row a category: how many items stand before the n-th of a category follows from the sizes alone
    sizes = items.groupBy(category).agg(F.count(F.lit(1)).alias("m")).agg(F.collect_list(F.struct(F.coalesce(F.col(category).cast("string"), F.lit("")).alias("c"), "m")).alias("_all"))
    place = _with(inside, sizes, [])
    own = F.coalesce(F.col(category).cast("string"), F.lit(""))
    rounds = F.aggregate("_all", F.lit(0).cast("long"), lambda a, x: a + F.least(x["m"], F.col("_n") - 1))
    ahead = F.size(F.filter("_all", lambda x: (x["c"] < own) & (x["m"] >= F.col("_n"))))
    place = place.withColumn("_p", rounds + ahead)
    core = place.filter(F.col("_p") < core_n).select(key, F.explode(F.array(*[F.lit(r) for r in raters])).alias("rater"), F.lit(True).alias("in_core"))
    names = F.array(*[F.lit(r) for r in raters])
    rest = place.filter(F.col("_p") >= core_n).select(key, F.element_at(names, F.pmod(F.col("_p") - core_n, F.lit(len(raters))).cast("int") + 1).alias("rater"), F.lit(False).alias("in_core"))
    return core.unionByName(rest)


def spaced_order(df: DataFrame, seed, rater: str = "rater", control: str = "is_negative_control", key: str = "item_id") -> DataFrame:
    """Adds position from 0 for each rater: the j-th control stands at j * floor(N / k), the others fill the rest."""
    flagged = df.withColumn("_c", F.coalesce(F.col(control), F.lit(False)))
    ordered = ranked(flagged, [rater, "_c"], seed, key, "_n", (rater,)).withColumn("_n", F.col("_n") - 1)
    sizes = flagged.groupBy(rater).agg(F.count_if("_c").alias("_k"), F.count(F.lit(1)).alias("_all"))
    sized = _with(ordered, sizes, [rater]).withColumn("_s", F.floor(F.col("_all") / F.greatest(F.col("_k"), F.lit(1))))
    # a normal row in the m-th place stands after the controls that come before it
    gap = F.greatest(F.col("_s") - 1, F.lit(1))
    before = F.when(F.col("_s") <= 1, F.col("_k")).otherwise(F.least(F.col("_k"), F.floor(F.col("_n") / gap) + 1))
    position = F.when(F.col("_c"), F.col("_n") * F.col("_s")).otherwise(F.col("_n") + before)
    return sized.withColumn("position", position.cast("long")).select(*df.columns, "position")


def display_ids(df: DataFrame, seed, key: str = "item_id", prefix: str = "Q", width: int = 3) -> DataFrame:
    """Adds display_id, an opaque number in the order of a hash."""
    return numbered(df, seed, key, "_d").withColumn("display_id", F.format_string(f"{prefix}%0{width}d", F.col("_d") + 1)).drop("_d")


def public_items(items: DataFrame) -> DataFrame:
    """What a rater sees: id, skill, attempts, accuracy and sentences with ids S1, S2, ..."""
    named = F.transform("sentences", lambda s, i: F.struct(F.concat(F.lit("S"), (i + 1).cast("string")).alias("id"), s["text"].alias("en")))
    return items.select(F.col("display_id").alias("item_id"), "skill", "steps", "skill_cum_accuracy", named.alias("sentences"))


def answer_key(items: DataFrame) -> DataFrame:
    wanted = ["display_id", "internal_item_id", "is_negative_control", "true_origin_item_id", "category", "tertile", "mean_entailment", "faithfulness_rate", "in_core_set"]
    return items.select(*[c for c in wanted if c in items.columns])


def sentence_key(items: DataFrame) -> DataFrame:
    """A row for each sentence of the real items, with its citations joined by semicolons."""
    real = items.filter(~F.coalesce(F.col("is_negative_control"), F.lit(False)))
    s = real.select("display_id", F.posexplode("sentences").alias("_p", "s"))
    return s.select("display_id", F.concat(F.lit("S"), (F.col("_p") + 1).cast("string")).alias("sentence_id"), F.col("s.text").alias("sentence_en"), F.array_join("s.cited", ";").alias("cited_indicators"))


def generation_quality(df: DataFrame, score: str = "mean_entailment", violation: str = "structural_violation_rate", most: float = 0.1) -> DataFrame:
    """One row: n, the share without a score, the mean violation rate, and whether either is above ``most``."""
    out = df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(score).isNull().cast("double")).alias("share_invalid"), F.avg(violation).alias("mean_violation"))
    return out.withColumn("warning", F.coalesce(F.col("share_invalid") > most, F.lit(False)) | F.coalesce(F.col("mean_violation") > most, F.lit(False)))


def folds(df: DataFrame, k: int, seed, key: str = "item_id", into: str = "fold") -> DataFrame:
    """Rows with the fold of their key, from 0: near-equal runs of keys in the order of a hash, the larger ones first."""
    keys = df.select(key).distinct()
    placed = numbered(keys, seed, key, "_n")
    total = keys.agg(F.count(F.lit(1))).scalar()
    t = placed.withColumn("_t", total)
    big, size = F.pmod(F.col("_t"), F.lit(k)), F.floor(F.col("_t") / k)
    edge = big * (size + 1)
    fold = F.when(F.col("_n") < edge, F.floor(F.col("_n") / (size + 1))).otherwise(big + F.floor((F.col("_n") - edge) / F.greatest(size, F.lit(1))))
    return df.join(t.select(key, fold.cast("int").alias(into)), key)


def few_shot_select(train: DataFrame, k: int, n_folds: int, seed, label: str = "majority_tag", key: str = "case_id", fold: str = "fold") -> DataFrame:
    """For each fold, k examples from other folds (column ``own_fold``), labels in turn; column shot counts from 1.

    Only the first k of each label of a fold can be chosen, so each fold keeps that many candidates, not all rows.
    """
    best = train.withColumn("_n", F.row_number().over(Window.partitionBy(fold, label).orderBy(stable_key(seed, F.col(key)), key))).filter(F.col("_n") <= k)
    each = best.withColumnRenamed(fold, "own_fold").withColumn(fold, F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))).filter(F.col(fold) != F.col("own_fold"))
    inside = each.withColumn("_m", F.row_number().over(Window.partitionBy(fold, label).orderBy(stable_key(seed, F.col(key)), key)))
    out = inside.withColumn("shot", F.row_number().over(Window.partitionBy(fold).orderBy("_m", label)))
    return out.filter(F.col("shot") <= k).drop("_n", "_m")


def shuffled_records(items: DataFrame, variants: int, seed, skill: str = "skill", key: str = "item_id") -> DataFrame:
    """(variant, item, donor, same_skill): each item's donor record from another item, of the same skill if it has one.

    In a variant, the items of a skill form a cycle in the order of a hash; single ones form one over all skills.
    """
    v = items.select(key, skill).withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(variants))))
    rings = _ring(v, ["variant", skill], seed, key)
    kept = rings.filter("_m > 1").withColumn("same_skill", F.lit(True))
    alone = _ring(rings.filter("_m = 1").select(key, skill, "variant"), ["variant"], seed, key).withColumn("same_skill", F.lit(False))
    out = kept.unionByName(alone)
    return out.select("variant", key, F.when(F.col("donor") != F.col(key), F.col("donor")).alias("donor"), "same_skill")


def _ring(df: DataFrame, by: list[str], seed, key: str) -> DataFrame:
    """Rows with _m, the size of their group, and donor, the key of the next in the order of a hash, after the last the first."""
    placed = _with(ranked(df, by, seed, key, "_n", ("variant",)), df.groupBy(*by).agg(F.count(F.lit(1)).alias("_m")), by)
    nxt = placed.select(*by, F.col("_n").alias("_x"), F.col(key).alias("donor"))
    return _with(placed.withColumn("_x", F.pmod(F.col("_n"), F.col("_m")) + 1), nxt, [*by, "_x"]).drop("_n", "_x")
