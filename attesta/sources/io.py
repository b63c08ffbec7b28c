"""Sources and sinks: logs, rating files, keys, stimuli, run logs, scores and labels, with their checks."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.functions import lexicon as fixed
from attesta.functions.columns import col, is_true, mapped, no_nan
from attesta.sources.json_arrays import array_elements, read_json_arrays  # noqa: F401

LOG_SCHEMA = "ITEST_id long, skill string, correct int, startTime string, endTime string, timeTaken double, hintCount double, attemptCount double, `Ln-1` double, RES_GAMING double, RES_CONFUSED double, RES_CONCENTRATING double, RES_BORED double, RES_FRUSTRATED double, RES_OFFTASK double"
LOG_NAMES = {
    "ITEST_id": "student_id", "startTime": "start_time", "endTime": "end_time", "timeTaken": "time_taken", "hintCount": "hint_count", "attemptCount": "attempt_count",
    "Ln-1": "prior_knowledge", "RES_GAMING": "gaming", "RES_CONFUSED": "confused", "RES_CONCENTRATING": "concentrating", "RES_BORED": "bored", "RES_FRUSTRATED": "frustrated", "RES_OFFTASK": "offtask",
}
RUN_SCHEMA = """condition string, `group` string, label string, ITEST_id long, step_idx long, citation_required boolean, stage1_used boolean, stage3_used boolean,
truncated_in_thinking boolean, error string, facts_shown_to_generator array<string>, ground_truth_facts array<string>, raw_narrative string,
sentences array<struct<text:string,cited:array<string>>>,
verification array<struct<text:string,status:string,nli:struct<entailment:double,neutral:double,contradiction:double>,detail:string>>,
summary struct<n_sentences:bigint,faithfulness_rate:double,hallucination_rate:double,hedge_violation_rate:double,structural_violation_rate:double,conditional_faithfulness_rate:double,conditional_hallucination_rate:double,n_content_eligible:bigint,breakdown:map<string,bigint>>"""
STIMULUS = [
    ("item_id", "string"), ("display_id", "string"), ("internal_item_id", "string"), ("skill", "string"),
    ("steps", "array<struct<step:bigint,correct:boolean,hint_count:double,response_time_ratio:double>>"), ("skill_cum_accuracy", "double"), ("sentences", "array<struct<id:string,en:string,ko:string>>"),
]


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def repeated_keys(df: DataFrame, keys: list[str], into: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(into)).filter(F.col(into) > 1)


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if not repeated_keys(df, keys).isEmpty():
        raise ValueError(f"keys repeat: {', '.join(keys)}")
    return df


def read_logs(spark: SparkSession, glob: str) -> DataFrame:
    """Interaction logs in one scan, under the engine's names; row_id orders rows as they stand in the files."""
    raw = spark.read.csv(glob, header=True, schema=LOG_SCHEMA, enforceSchema=False, nanValue="", nullValue="")
    out = raw.select(*[F.col(f"`{c}`").alias(LOG_NAMES.get(c, c)) for c in raw.columns], F.monotonically_increasing_id().alias("row_id"))
    return out.withColumns({c: F.col(c).try_cast("double") for c in ("start_time", "end_time")})


def keep_labelled(df: DataFrame, labels: DataFrame, key: str = "student_id") -> DataFrame:
    """Rows whose key is in ``labels``."""
    return df.join(labels.select(key).distinct(), key, "left_semi")


def split_tags(text) -> Column:
    """array<struct<pos, sentence_id, tag>> of "S1:supported;S2:partial"; parts without a colon are left out."""
    parts = F.transform(F.split(F.coalesce(col(text), F.lit("")), ";"), lambda x, i: F.struct(i.alias("pos"), x.alias("x")))
    good = F.filter(parts, lambda p: F.instr(p["x"], ":") > 0)
    name = lambda p: F.trim(F.substring_index(p["x"], ":", 1))
    tag = lambda p: normalise_tag(F.substr(p["x"], F.instr(p["x"], ":") + 1))
    return F.transform(good, lambda p: F.struct(p["pos"].alias("pos"), name(p).alias("sentence_id"), tag(p).alias("tag")))


def parse_tags(df: DataFrame, text: str = "level1_tags") -> DataFrame:
    """A row for each sentence, of a repeated one the last; rows without tags stay, with nulls."""
    tags = split_tags(text)
    last = F.filter(tags, lambda t: ~F.exists(tags, lambda o: (o["sentence_id"] == t["sentence_id"]) & (o["pos"] > t["pos"])))
    return df.withColumn("_t", F.explode_outer(last)).select(*df.columns, "_t.sentence_id", "_t.tag")


def normalise_tag(tag) -> Column:
    """Korean and English names become the four tags; other text passes, blank text becomes null."""
    text = F.trim(col(tag))
    return F.coalesce(mapped(fixed.TAG_NAMES, text), F.nullif(text, F.lit("")))


def fix_tag_typos(tag) -> Column:
    text = F.lower(F.trim(col(tag)))
    return F.coalesce(mapped(fixed.TYPOS, text), text)


RATING_COLUMNS = ("item_id", "rater_id", "level1_tags", "faithfulness", "actionability", "clarity")


def _headers(spark: SparkSession, paths: list[str], encoding: str) -> dict[str, list[str]]:
    """The column names of each CSV file below ``paths``, from the first lines of all files, in one job."""
    raw = spark.read.option("encoding", encoding).text(paths).select(F.input_file_name().alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), "value")
    first = raw.filter(F.col("at") == 0).groupBy("path").agg(F.min_by("value", "n").alias("line"))
    known: dict[str, list[str]] = {}
    out = {}
    for r in first.collect():  # a line a file
        if r.line not in known:
            known[r.line] = [c.strip().lstrip("\ufeff") for c in next(csv.reader([r.line]), [])]
        out[unquote(r.path)] = known[r.line]
    return out


def read_ratings(spark: SparkSession, paths: list[str], encoding: str = "UTF-8", multi_line: bool = True) -> DataFrame:
    """Rating files that have the required columns, with typed scores and the file's name; others are skipped.

    Files are grouped by their header, and each group is one scan, so the plan grows with the number of different headers,
    not of files. ``multi_line``: texts may hold line ends; without, large files are split.
    """
    groups: dict[tuple, list[str]] = {}
    for path, names in _headers(spark, paths, encoding).items():
        if set(RATING_COLUMNS) <= set(names):
            groups.setdefault(tuple(names), []).append(path)
    out = None
    for names, files in sorted(groups.items()):
        schema = ", ".join(f"`{n}` string" for n in names)
        df = spark.read.csv(sorted(files), header=True, schema=schema, encoding=encoding, multiLine=multi_line, escape='"', enforceSchema=True)
        df = df.withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no file has the columns of a rating file")
    typed = {c: F.col(c).try_cast("double") for c in ("faithfulness", "actionability", "clarity", "duration_sec") if c in out.columns}
    return out.withColumns(typed).withColumn("row_id", F.monotonically_increasing_id())


def read_answer_key(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``multi_line``: texts may hold line ends; without, large files are split."""
    df = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    typed = {c: is_true(c) for c in ("is_negative_control", "in_core_set", "translation_ok") if c in df.columns}
    typed |= {c: no_nan(F.col(c).try_cast("double")) for c in ("mean_entailment", "faithfulness_rate", "auto_entailment") if c in df.columns}
    return df.withColumns(typed)


read_sentence_key = read_answer_key


def read_stimuli(spark: SparkSession, path: str, id_map: DataFrame | None = None) -> DataFrame:
    """Items of a JSON file under any of its wrappers; the first id that is there; ``id_map`` (internal_item_id,
    display_id) renames internal ids."""
    wrappers = ("items", "stimuli", "data", "calibration", "practice")
    item = "struct<" + ",".join(f"{n}:{t}" for n, t in STIMULUS) + ">"
    schema = ", ".join([*(f"{w} array<{item}>" for w in wrappers), *(f"{n} {t}" for n, t in STIMULUS)])
    raw = spark.read.json(path, multiLine=True, schema=schema)
    wrapped = F.coalesce(*[F.col(w) for w in wrappers], F.array(F.struct(*[F.col(n) for n, _ in STIMULUS])))
    items = raw.select(F.inline(wrapped))
    out = items.withColumn("item_id", F.coalesce("display_id", "item_id", "internal_item_id")).drop("display_id", "internal_item_id")
    if id_map is not None:
        names = id_map.select(F.col("internal_item_id").alias("item_id"), F.col("display_id").alias("_d"))
        out = out.join(names, "item_id", "left").withColumn("item_id", F.coalesce("_d", "item_id")).drop("_d")
    return out.filter(F.col("item_id").isNotNull())


def sentence_text(sentence: Column, lang: str = "en", fields=("en", "text", "sentence_text", "ko")) -> Column:
    """The first non-blank text of a sentence struct; ``lang`` first. ``fields``: those that the struct has."""
    order = [lang, *[f for f in fields if f != lang]]
    return F.coalesce(*[F.nullif(F.trim(sentence[f]), F.lit("")) for f in order if f in fields])


def read_pipeline_log(spark: SparkSession, glob: str, pattern: str = r"([^/]+?)(?:_[0-9]+)?\.json$", lines: bool = False) -> DataFrame:
    """Run logs with the model's name from the file name. A file is one JSON array, or with ``lines`` has a run on each
    line; both are read in blocks."""
    if not lines:
        raw = read_json_arrays(spark, glob, RUN_SCHEMA)
        return raw.withColumn("model", F.regexp_extract("source_file", pattern, 1)).drop("source_file")
    raw = spark.read.schema(RUN_SCHEMA).json(glob)
    return raw.withColumn("model", F.regexp_extract(F.input_file_name(), pattern, 1))


def read_scores(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A score table, tags spelt right, only sentences that count: no control, with a premise, a score and a known tag.

    ``multi_line``: CSV texts may hold line ends; without, large files are split.
    """
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    require_columns(df, "majority_tag", "is_negative_control", "fact_premise", "score")
    return standard_scores(df)


def standard_scores(df: DataFrame) -> DataFrame:
    out = df.withColumn("majority_tag", fix_tag_typos("majority_tag")).withColumn("score", no_nan(F.col("score").try_cast("double")))
    keep = ~is_true("is_negative_control") & F.col("fact_premise").isNotNull() & F.col("score").isNotNull()
    return out.filter(keep & (F.col("majority_tag") != "unknown"))


LABELS = ("faithful", "partial", "unfaithful", "not_assessable")


def read_labels(df: DataFrame) -> DataFrame:
    """ID, Label, Note as label_id, label, note; rows without a label are dropped, an unknown label is an error."""
    names = {"ID": "label_id", "Label": "label", "Note": "note"}
    out = df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})
    out = require_columns(out, "label_id", "label").withColumn("label", F.lower(F.trim("label")))
    out = out.filter(F.col("label_id").isNotNull() & (F.coalesce(F.col("label"), F.lit("")) != ""))
    if not out.filter(~F.col("label").isin(*LABELS)).isEmpty():
        raise ValueError(f"a label is none of {', '.join(LABELS)}")
    return out


def read_source(spark: SparkSession, path: str, *columns: str, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """CSV or Parquet by its name, with the columns that must be there.

    Without a ``schema`` the types of a CSV are inferred by a pass of its own. ``multi_line``: texts may hold line ends;
    without, large files are split.
    """
    if path.lower().endswith(".csv"):
        df = spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None, multiLine=multi_line, escape='"')
    else:
        df = spark.read.parquet(path)
    return require_columns(df, *columns)


def write_table(df: DataFrame, path: str, form: str = "parquet", partition_by: list[str] | None = None, mode: str = "error") -> None:
    """Parquet, CSV with a header, JSON lines or lines of text, in as many files as there are partitions."""
    writer = df.write.mode(mode).partitionBy(*(partition_by or []))
    if form == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(form).save(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows hashed by keys over all slots, where the scan gives fewer partitions than there are slots; else as it is.

    For costly work on each row of a small file: a large table's scan has partitions enough and isn't moved.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, *keys) if df.rdd.getNumPartitions() < slots else df
