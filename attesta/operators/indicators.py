"""Interaction logs to behavioural indicators: filters, per-student windows and per-skill statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import lexicon as fixed
from attesta.functions.columns import col, ratio
from attesta.functions.hashing import stable_key
from attesta.operators import scan


def student_order(start: str = "start_time", row: str = "row_id") -> list[Column]:
    """A student's rows by start, unknown starts last; the row id settles ties."""
    return [F.col(start).asc_nulls_last(), F.col(row).asc()]


def _place(start: str = "start_time", row: str = "row_id") -> Column:
    """A value that grows in :func:`student_order`."""
    return F.struct(F.col(start).isNull(), F.col(start), F.col(row))


def clean_interactions(df: DataFrame, skill="skill", student="student_id", correct="correct", times=("start_time", "end_time")) -> DataFrame:
    """Rows with skill, student and a correctness of 0 or 1; times that are no numbers become null."""
    out = df.dropna(subset=[skill, student, correct]).filter(F.col(correct).isin(0, 1))
    return out.withColumns({t: F.col(t).try_cast("double") for t in times})


def lag_time(df: DataFrame, into="lag_time", start="start_time", end="end_time", student="student_id") -> DataFrame:
    """Seconds since the student's previous end; 0 where unknown or negative. A long student's segments begin after the
    last end of the one before."""
    cut = scan.segmented(df, student, student_order(start))
    over = scan.inside([student], student_order(start))
    ends = scan.carried(cut, [student], _last=F.max_by(F.col(end), _place(start)))
    ends = ends.withColumn("_carry", F.lag("_last").over(Window.partitionBy(student).orderBy(scan.SEGMENT))).drop("_last")
    out = scan.with_carry(cut, ends, [student]).withColumn("_place", F.row_number().over(over))
    before = F.when(F.col("_place") == 1, F.col("_carry")).otherwise(F.lag(end).over(over))
    return scan.finish(out.withColumn(into, F.greatest(F.coalesce(F.col(start) - before, F.lit(0.0)), F.lit(0.0))), df, into)


def elapsed_time(df: DataFrame, into="elapsed_time", taken="time_taken", most: float = 3600.0) -> DataFrame:
    return df.withColumn(into, F.least(F.greatest(F.coalesce(F.col(taken).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(most)))


def log1p_features(df: DataFrame, cols=("lag_time", "elapsed_time")) -> DataFrame:
    return df.withColumns({f"{c}_log": F.log1p(c) for c in cols})


def digitize(value, edges) -> Column:
    """How many of the ascending edges are at most the value."""
    value = col(value)
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= value))


def binned(df: DataFrame, attempts="attempt_count") -> DataFrame:
    """lag_bin, elapsed_bin and attempt_bin by the fixed edges; attempts are cut to whole numbers from 0 to 10."""
    tries = F.least(F.greatest(F.coalesce(F.col(attempts).cast("int"), F.lit(0)), F.lit(0)), F.lit(10))
    return df.withColumns({"lag_bin": digitize("lag_time", fixed.LAG_EDGES), "elapsed_bin": digitize("elapsed_time", fixed.ELAPSED_EDGES), "attempt_bin": digitize(tries, fixed.ATTEMPT_EDGES)})


def fill_zero(df: DataFrame, cols) -> DataFrame:
    """Nulls and NaN become 0."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for c in cols})


def minmax_scale(df: DataFrame, cols, suffix: str = "") -> DataFrame:
    """(x - min) / (max - min) over all rows; 0 in a constant column. The bounds are one row, read as a scalar subquery."""
    bounds = df.agg(F.struct(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c) for c in cols]).alias("b")).scalar()
    out = {}
    for c in cols:
        lo, hi = bounds[c]["lo"], bounds[c]["hi"]
        out[f"{c}{suffix}"] = F.when(F.col(c).isNotNull(), F.when(hi == lo, F.lit(0.0)).otherwise((F.col(c) - lo) / (hi - lo)))
    return df.withColumns(out)


def self_confidence(df: DataFrame, into="sc", elapsed="elapsed_time", student="student_id", skill="skill") -> DataFrame:
    """exp(-(ln t - target)^2 / (2 sigma^2)); target: the student's mean plus the skill's offset from the overall mean.

    Skills are few and may be hot, so their statistics are partial sums joined back, not windows.
    """
    timed = df.withColumn("_log_rt", F.log(F.when(F.col(elapsed) == 0, F.lit(1e-5)).otherwise(F.col(elapsed))))
    by_student = timed.groupBy(student).agg(F.avg("_log_rt").alias("_mu_u"))
    by_skill = timed.groupBy(skill).agg(F.avg("_log_rt").alias("_mu_j"), F.stddev_samp("_log_rt").alias("_sd"))
    overall = timed.agg(F.avg("_log_rt")).scalar()
    sigma = F.coalesce(F.nullif(F.col("_sd"), F.lit(0.0)), F.lit(1.0))
    by_skill = by_skill.select(skill, (F.col("_mu_j") - overall).alias("_d_j"), sigma.alias("_sigma"))
    joined = timed.join(by_skill, skill).join(by_student, student)
    off = F.col("_log_rt") - (F.col("_mu_u") + F.col("_d_j"))
    out = joined.withColumn(into, F.exp(-(off * off) / (2 * F.col("_sigma") * F.col("_sigma"))))
    return out.select(*df.columns, into)


def indicators(df: DataFrame, correct="correct", hint="hint_scaled", sc="sc", confused="confused", concentrating="concentrating", bored="bored", frustrated="frustrated") -> DataFrame:
    """The nine m_* columns."""
    c, h, s, q, k, b, f = (F.col(x).cast("double") for x in (correct, hint, sc, confused, concentrating, bored, frustrated))
    wrong, alone = 1 - c, 1 - h
    return df.withColumns({
        "m_overconfidence": wrong * s * (1 - q),
        "m_underconfidence": c * (1 - s) * q,
        "m_strategic_help": q * h,
        "m_cognitive_avoidance": F.abs(q - h),
        "m_productive_struggle": c * q * alone * s,
        "m_unproductive_frustration": wrong * f * alone,
        "m_lucky_guess": c * alone * (1 - s) * q,
        "m_slipping": wrong * alone * s * k,
        "m_boredom_offtask": b * c * (1 - k),
    })


def step_index(df: DataFrame, into="step_idx", student="student_id") -> DataFrame:
    """The row's number among its student's, from 0."""
    cut = scan.segmented(df, student, student_order())
    rows = scan.carried(cut, [student], _rows=F.count(F.lit(1)))
    rows = rows.withColumn("_carry", F.sum("_rows").over(scan.earlier([student]))).drop("_rows")
    number = F.row_number().over(scan.inside([student], student_order())).cast("long") - 1
    return scan.finish(scan.with_carry(cut, rows, [student]).withColumn(into, number + F.coalesce("_carry", F.lit(0))), df, into)


def response_time_ratio(df: DataFrame, into="response_time_ratio", elapsed="elapsed_time", student="student_id") -> DataFrame:
    """Elapsed time over the student's mean; null where that is 0. A long student's mean is a partial aggregate."""
    cut = scan.segmented(df, student, student_order())
    sums = scan.carried(cut, [student], _sum=F.sum(F.col(elapsed).cast("double")), _n=F.count(elapsed))
    whole = Window.partitionBy(student)
    sums = sums.select(student, scan.SEGMENT, (F.sum("_sum").over(whole) / F.sum("_n").over(whole)).alias("_carry"))
    mean = F.coalesce("_carry", F.avg(elapsed).over(Window.partitionBy(student, scan.SEGMENT)))
    return scan.finish(scan.with_carry(cut, sums, [student]).withColumn(into, ratio(elapsed, mean)), df, into)


def skill_cum_accuracy(df: DataFrame, into="skill_cum_accuracy", student="student_id", skill="skill", correct="correct") -> DataFrame:
    """Mean correctness over strictly earlier rows of the student and skill; null at the first."""
    cut = scan.segmented(df, student, student_order())
    keys, right = [student, skill], F.col(correct).cast("double")
    sums = scan.carried(cut, keys, _sum=F.sum(right), _n=F.count(right))
    sums = sums.select(*keys, scan.SEGMENT, F.sum("_sum").over(scan.earlier(keys)).alias("_right"), F.sum("_n").over(scan.earlier(keys)).alias("_tried"))
    over = scan.inside(keys, student_order()).rowsBetween(Window.unboundedPreceding, -1)
    out = scan.with_carry(cut, sums, keys).withColumns({"_s": F.sum(right).over(over), "_c": F.count(right).over(over)})
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scan.finish(out.withColumn(into, ratio(zero("_right") + zero("_s"), zero("_tried") + zero("_c"))), df, into)


def merge_splits(train: DataFrame, test: DataFrame, student="student_id", hint="hint_count") -> DataFrame:
    """Train rows of students that are not in test, and all test rows, without exact repeats; hint_raw is kept before scaling."""
    both = train.join(test.select(student).distinct(), student, "left_anti").select(train.columns).unionByName(test)
    return both.dropDuplicates().withColumn("hint_raw", F.col(hint).cast("double"))


def avoidance_audit(df: DataFrame, value="m_cognitive_avoidance", confused="confused", hint="hint_scaled", raw="hint_raw", high=fixed.HIGH) -> DataFrame:
    """One row: how many values are high, which way they lean, and raw hint counts of those that lean on hints."""
    h = F.coalesce(F.col(raw), F.lit(0.0))
    strong = F.col(value) > high
    reverse = strong & (F.col(hint) > F.col(confused))
    forward = strong & (F.col(confused) > F.col(hint))
    quiet = h.between(1, 8) & (F.col(confused) == 0)
    return df.agg(
        F.count_if(strong).alias("n_high"),
        ratio(F.count_if(forward), F.count_if(strong)).alias("share_confused_over_hint"),
        F.count_if(reverse).alias("n_reversed"),
        F.min(F.when(reverse, h)).alias("reversed_min_hints"),
        F.max(F.when(reverse, h)).alias("reversed_max_hints"),
        F.avg(F.when(reverse, h)).alias("reversed_mean_hints"),
        F.count_if(quiet).alias("n_hints_without_confusion"),
        F.count_if(quiet & strong).alias("n_of_these_high"),
    )


def informative_rows(df: DataFrame, least: float = fixed.WEAK) -> DataFrame:
    """Rows with an indicator beyond ``least`` in size."""
    return df.filter(F.exists(F.array(*[f"m_{i}" for i in fixed.INDICATORS]), lambda x: F.abs(x) > least))


def sample_rows(df: DataFrame, n: int, seed, key: str = "row_id") -> DataFrame:
    """n rows by a hash of the key: the same rows on any partitioning."""
    return df.orderBy(stable_key(seed, F.col(key)), key).limit(n)


def select_student(df: DataFrame, student_id, step=None, student="student_id", step_col="step_idx") -> DataFrame:
    out = df.filter(F.col(student) == student_id)
    return (out if step is None else out.filter(F.col(step_col) == step)).orderBy(step_col)


def indicator_table(df: DataFrame) -> DataFrame:
    """All of the above over one table: cleaned rows with context columns, scaled hints, SC and the nine indicators."""
    cut = scan.segmented(clean_interactions(df), "student_id", student_order())
    out = elapsed_time(lag_time(cut))
    out = fill_zero(out, ["confused", "concentrating", "bored", "frustrated"])
    out = minmax_scale(out.withColumn("hint_scaled", F.col("hint_count").cast("double")), ["hint_scaled"])
    out = out.withColumn("hint_raw", F.col("hint_count").cast("double"))
    out = indicators(self_confidence(out))
    return skill_cum_accuracy(response_time_ratio(step_index(out))).drop(scan.SEGMENT)
