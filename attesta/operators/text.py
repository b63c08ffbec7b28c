"""Narrative texts: splitting, flags, cleaning, de-duplication, citation repair, judge outputs and prompts.

Sentences are array<struct<text, cited array<string>>> columns or, exploded, rows with pos, text and cited.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import lexicon as fixed
from attesta.functions.columns import col, is_true, ratio

#: Stands for a decimal point while sentences are cut.
POINT = "\ue000"
STRINGS = "array<string>"
SENTENCES = "array<struct<text:string,cited:array<string>>>"


#: Characters with the Unicode property White_Space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(text) -> Column:
    """Without white space at both ends."""
    return F.btrim(col(text), F.lit(SPACES))


def _tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]"), F.lit(1))


def _without_tags(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("[")), stripped(F.regexp_replace(text, r"(?U)\s*\[[^\]]+\]\s*", " "))).otherwise(stripped(text))


def cited_sentences(text) -> Column:
    """Sentences that end in a mark, with the tags after or inside them; decimal points end nothing.

    Text after the last mark is dropped. Tags are distinct, those after the sentence first.
    """
    whole = F.regexp_replace(stripped(F.coalesce(col(text), F.lit(""))), r"(?U)(?<=\d)\.(?=\d)", POINT)
    # nothing ends after the last mark or bracket: without that tail a search never runs to the end of a text in vain
    whole = F.regexp_extract(whole, r"(?s)^(.*[.!?\]])", 1)
    pieces = F.regexp_extract_all(whole, F.lit(r"(?U)[^.!?]*[.!?]\s*(?:\[[^\]]+\]\s*)*"), F.lit(0))
    sentence = lambda p: F.regexp_extract(p, r"^[^.!?]*[.!?]", 0)
    back = lambda c: F.replace(c, F.lit(POINT), F.lit("."))
    parts = F.transform(pieces, lambda p: F.struct(back(stripped(sentence(p))).alias("s"), back(F.substring(p, F.length(sentence(p)) + 1, F.length(p))).alias("t")))
    return F.transform(parts, lambda p: F.struct(_without_tags(p["s"]).alias("text"), F.array_distinct(F.concat(_tags(p["t"]), _tags(p["s"]))).alias("cited")))


def split_cited_sentences(df: DataFrame, text: str = "raw_text", into: str = "sentences") -> DataFrame:
    return df.withColumn(into, cited_sentences(text))


def split_numbered_lines(df: DataFrame, text: str, into: str = "sentences") -> DataFrame:
    """A sentence for each line, its number taken off, with its tags in order."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.regexp_replace(stripped(x), r"(?U)^\s*\d+[\.\)]\s*", ""))
    found = F.transform(lines, lambda x: F.struct(_without_tags(x).alias("text"), _tags(x).alias("cited")))
    return df.withColumn(into, F.filter(found, lambda s: s["text"] != ""))


def explode_sentences(df: DataFrame, *keys: str, sentences: str = "sentences") -> DataFrame:
    """A row for each sentence. The outer form keeps Catalyst from inferring a filter on the array's size, which would split each text twice."""
    rows = df.select(*keys, F.posexplode_outer(sentences).alias("pos", "s")).filter(F.col("pos").isNotNull())
    return rows.select(*keys, "pos", "s.text", "s.cited")


def strip_echoed_bullets(text, lang: str = "en") -> Column:
    """Without the lines that repeat the evidence."""
    lines = F.filter(F.split(col(text), "\n"), lambda x: ~x.rlike("(?U)" + fixed.ECHOED[lang]))
    return F.array_join(lines, "\n")


def strip_thinking(df: DataFrame, text: str, into: str | None = None, flag: str = "truncated_in_thinking") -> DataFrame:
    """Without thought blocks; a block that never ends leaves an empty text and sets the flag."""
    cut = F.contains(F.col(text), F.lit("<think>")) & ~F.contains(F.col(text), F.lit("</think>"))
    clean = F.when(cut, "").otherwise(stripped(F.regexp_replace(text, r"(?s)<think>.*?</think>", "")))
    return df.withColumn(flag, F.coalesce(cut, F.lit(False))).withColumn(into or text, clean)


def _any(text: Column, patterns: list[str], flags: str = "") -> Column:
    return text.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def flag_columns(text, lang: str = "en") -> dict[str, Column]:
    t = col(text)
    return {
        "leaked": _any(t, fixed.LEAKED[lang]), "code": t.rlike(fixed.CODE), "recommends": t.rlike(fixed.RECOMMENDATION[lang]),
        "foreign": t.rlike(fixed.FOREIGN), "latin": t.rlike(fixed.LATIN), "hangul": t.rlike(fixed.HANGUL), "typos": F.regexp_count(t, F.lit(fixed.TYPO)) >= 2,
    }


def sentence_flags(df: DataFrame, text: str = "text", lang: str = "en") -> DataFrame:
    return df.withColumns({f"is_{k}": v for k, v in flag_columns(text, lang).items()})


def flag_rates(df: DataFrame, group: list[str], flags: list[str]) -> DataFrame:
    """n and the share of each flag in each group."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f).cast("double")).alias(f"rate_{f}") for f in flags])


def sanitize(sentences, lang: str = "en") -> Column:
    """Sentences without the flagged ones, variable names and doubled spaces."""

    def bad(s):
        f = flag_columns(s["text"], lang)
        script = f["latin"] if lang == "ko" else f["hangul"]
        out = f["leaked"] | f["code"] | f["recommends"] | f["foreign"] | script
        return out | f["typos"] if lang == "ko" else out

    def clean(s):
        text = F.regexp_replace(s["text"], fixed.VARIABLE_NAME, "")
        if lang == "ko":
            text = F.regexp_replace(text, fixed.TYPO, fixed.TYPO_FIX)
        return F.struct(stripped(F.regexp_replace(text, r"(?U)\s{2,}", " ")).alias("text"), s["cited"].alias("cited"))

    kept = F.filter(col(sentences), lambda s: ~bad(s))
    return F.filter(F.transform(kept, clean), lambda s: s["text"] != "")


def sanitize_sentences(df: DataFrame, lang: str = "en", sentences: str = "sentences") -> DataFrame:
    return df.withColumn(sentences, sanitize(sentences, lang))


_MARKS = re.compile(r"[\s,.!?\"'~()\[\]]+")


def kept_sentences(texts: list[str], cited: list, threshold: float) -> list[int]:
    """Indices kept in order: a sentence goes if it equals a kept one, or shares a citation with a kept one and the
    Jaccard similarity of their character pairs reaches the threshold. Each pair lists the kept sentences that have it,
    so one count over the lists of a sentence's pairs gives its overlap with all of them."""
    having: dict[str, array] = {}
    sizes = array("q")
    tags_of: list[set] = []
    seen: set[str] = set()
    kept: list[int] = []
    for i, raw in enumerate(texts):
        text = (raw or "").strip()
        if not text or text in seen:
            continue
        norm = _MARKS.sub("", text)
        own = {norm[k : k + 2] for k in range(len(norm) - 1)}
        tags = set(cited[i]) if cited[i] is not None else set()
        lists = [having[p] for p in own if p in having]
        if tags and lists:
            shared = np.bincount(np.concatenate([np.frombuffer(x, np.int64) for x in lists]), minlength=len(kept))
            near = np.flatnonzero((shared > 0) & (shared / (len(own) + np.array(sizes) - shared) >= threshold))
            if any(not tags.isdisjoint(tags_of[k]) for k in near):
                continue
        for p in own:
            having.setdefault(p, array("q")).append(len(kept))
        sizes.append(len(own))
        tags_of.append(tags)
        seen.add(text)
        kept.append(i)
    return kept


def dedupe_narrative(df: DataFrame, threshold: float = 0.6, sentences: str = "sentences") -> DataFrame:
    """Sentences without repeats of kept ones, and had_repetition. Each narrative is a row of its own, in order; the
    comparison is with kept sentences only, which makes it a scan that no built-in function has."""
    rest = [c for c in df.columns if c != sentences]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest) + f", {sentences} {SENTENCES}, had_repetition boolean"

    def run(batches):
        for pdf in batches:
            out, flags = [], []
            for row in pdf[sentences]:
                items = [] if row is None else list(row)
                texts = [s["text"] for s in items]
                kept = kept_sentences(texts, [s["cited"] for s in items], threshold)
                filled = sum(bool((t or "").strip()) for t in texts)
                out.append([{"text": items[k]["text"], "cited": list(items[k]["cited"] if items[k]["cited"] is not None else [])} for k in kept])
                flags.append(len(kept) < filled)
            pdf = pdf[rest].copy()
            pdf[sentences] = pd.Series(out, index=pdf.index, dtype=object)
            pdf["had_repetition"] = pd.Series(flags, index=pdf.index, dtype=bool)
            yield pdf

    return df.select(*rest, sentences).mapInPandas(run, schema)


def _closest(valid: list[str], cutoff: float):
    """A function of tags to themselves if valid, else to the closest valid name by ``difflib``, else to themselves."""
    import difflib
    import functools

    lower = {v.lower(): v for v in valid}

    @functools.lru_cache(maxsize=65_536)
    def fix(tag: str) -> str:
        if tag in valid:
            return tag
        near = difflib.get_close_matches(tag.lower(), list(lower), n=1, cutoff=cutoff)
        return lower[near[0]] if near else tag

    return fix


def correct_citations(df: DataFrame, valid: list[str], cited: str = "cited", cutoff: float = 0.75) -> DataFrame:
    """Tags split at commas, repaired and made distinct, in order; without valid names nothing changes.

    Only the tags go through Python, which compares each distinct one of a task once; no rows are moved.
    """
    if not valid:
        return df

    @F.pandas_udf(STRINGS)
    def repaired(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fix = _closest(valid, cutoff)
        for tags in batches:
            yield pd.Series([list(dict.fromkeys(fix(t) for t in row)) for row in tags], index=tags.index, dtype=object)

    split = F.filter(F.transform(F.flatten(F.transform(F.coalesce(cited, F.array().cast(STRINGS)), lambda t: F.split(t, r"[,，、]"))), stripped), lambda t: t != "")
    return df.withColumn(cited, repaired(split))


def citation_check(df: DataFrame, group: list[str], valid: list[str] | None = None, cited: str = "cited") -> DataFrame:
    """n_sentences, n_uncited, n_invalid_reference and structural_violation_rate. valid: names, or a column valid_indicators."""
    names = F.array(*[F.lit(v) for v in valid]) if valid is not None else F.col("valid_indicators")
    n = F.count(F.lit(1))
    uncited, invalid = F.count_if(F.size(cited) == 0), F.count_if(F.size(F.array_except(cited, names)) > 0)
    return df.groupBy(*group).agg(n.alias("n_sentences"), uncited.alias("n_uncited"), invalid.alias("n_invalid_reference"), ratio(uncited + invalid, n).alias("structural_violation_rate"))


def hedge_violation(text, lang: str = "en") -> Column:
    """Definitive wording without any hedge, in any case."""
    t = col(text)
    return _any(t, fixed.DEFINITIVE[lang], "(?iU)") & ~_any(t, fixed.HEDGE[lang], "(?iU)")


def translation_suspect(text) -> Column:
    """Empty, without Hangul, or with two Latin letters together."""
    t = F.coalesce(stripped(text), F.lit(""))
    return (t == "") | ~t.rlike(fixed.HANGUL) | t.rlike(fixed.LATIN)


def _citation_parts(text) -> Column:
    t = F.coalesce(stripped(col(text).cast("string")), F.lit(""))
    none = F.lower(t).isin("", "nan", "none", "[]")
    clean = lambda p: stripped(F.regexp_replace(stripped(p), r"^['\"]+|['\"]+$", ""))
    parts = F.filter(F.transform(F.split(t, r"[,;|\[\]]"), clean), lambda p: p != "")
    return F.when(none, F.array().cast(STRINGS)).otherwise(parts)


_IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*$"


def parse_citation_field(df: DataFrame, text: str, into: str = "citations", invalid: str = "invalid_citations") -> DataFrame:
    """Tags of a text field that are whole identifiers, and those that are not; status words are neither."""
    parts = _citation_parts(text)
    word = lambda p: F.lower(p).isin(*fixed.STATUS_WORDS)
    return df.withColumns({into: F.filter(parts, lambda p: p.rlike(_IDENTIFIER) & ~word(p)), invalid: F.filter(parts, lambda p: ~p.rlike(_IDENTIFIER) & ~word(p))})


def clean_indicator_token(df: DataFrame, cited: str, into: str = "cleaned", count: str = "n_messy") -> DataFrame:
    """The leading identifier of each tag of an array, and how many tags had more than it."""
    token = lambda t: F.regexp_extract(stripped(t), r"^([a-zA-Z_]+)", 1)
    pairs = F.filter(F.transform(cited, lambda t: F.struct(token(t).alias("c"), stripped(t).alias("t"))), lambda p: p["c"] != "")
    return df.withColumns({into: F.transform(pairs, lambda p: p["c"]), count: F.size(F.filter(pairs, lambda p: p["c"] != p["t"]))})


def parse_judge_json(df: DataFrame, text: str) -> DataFrame:
    """pred_label (one of four or null), pred_confidence_supported, pred_reasoning and parse_failed of the outermost braces of a text."""
    span = F.regexp_extract(F.coalesce(F.col(text), F.lit("")), r"(?s)\{.*\}", 0)
    body = F.from_json(span, "label string, confidence_supported string, reasoning string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    out = df.withColumn("_j", body)
    failed = (span == "") | F.col("_j._corrupt").isNotNull()
    label = F.lower(stripped("_j.label"))
    return out.withColumns({
        "pred_label": F.when(~failed & label.isin(*fixed.TAGS), label), "pred_confidence_supported": F.when(~failed, F.col("_j.confidence_supported").try_cast("double")),
        "pred_reasoning": F.when(failed, F.concat(F.lit("no JSON: "), F.substring(text, 1, 200))).otherwise(F.coalesce("_j.reasoning", F.lit(""))), "parse_failed": failed,
    }).drop("_j")


def yes_no_score(df: DataFrame, top: str = "top_logprobs", into: str = "score") -> DataFrame:
    """p_yes_raw, p_no_raw and p_yes / (p_yes + p_no), null where neither token is among the top."""
    total = lambda word: F.aggregate(F.filter(top, lambda x: F.lower(stripped(x["token"])) == word), F.lit(0.0), lambda a, x: a + F.exp(x["logprob"]))
    out = df.withColumns({"p_yes_raw": total("yes"), "p_no_raw": total("no")})
    return out.withColumn(into, ratio("p_yes_raw", F.col("p_yes_raw") + F.col("p_no_raw")))


STEPS = "array<struct<step:bigint,correct:string,hint_count:string,response_time_ratio:double>>"


def parse_steps(text) -> Column:
    """Attempts from JSON text, or from the same with single quotes, True, False and None."""
    json = F.from_json(col(text), STEPS)
    python = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(col(text), "'", '"'), r"\bTrue\b", "true"), r"\bFalse\b", "false"), r"\bNone\b", "null")
    return F.coalesce(json, F.from_json(python, STEPS))


def record_premise(df: DataFrame, steps: str = "steps", skill: str = "skill", accuracy: str = "skill_cum_accuracy", into: str = "record_premise") -> DataFrame:
    """What a teacher sees of the attempts, in words; null without attempts. Accuracy may be a fraction or a percentage."""
    a = F.col(accuracy).try_cast("double")
    percent = F.concat(F.format_string("%.0f", F.rint(F.when(a <= 1, a * 100).otherwise(a))), F.lit("%"))
    shown = F.when(a.isNotNull(), percent).otherwise("unknown")
    h = lambda s: s["hint_count"].try_cast("double").cast("long")
    hints = lambda s: F.when(h(s).isNull(), F.concat(F.lit("used "), F.coalesce(s["hint_count"].cast("string"), F.lit("None")), F.lit(" hints"))).when(h(s) == 0, "used no hints").otherwise(F.concat(F.lit("used "), h(s).cast("string"), F.when(h(s) == 1, " hint").otherwise(" hints")))
    time = lambda s: F.coalesce(F.format_string("%.2f", F.when(s["response_time_ratio"].isNotNull(), s["response_time_ratio"])), F.lit("None"))
    answer = lambda s: F.when(is_true(s["correct"]), "correctly").otherwise("incorrectly")
    line = lambda s, i: F.concat(F.lit("On attempt "), (i + 1).cast("string"), F.lit(", the student answered "), answer(s), F.lit(", "), hints(s), F.lit(", and took "), F.when(s["response_time_ratio"].isNull(), "None").otherwise(time(s)), F.lit(" times their own average response time."))
    first = F.concat(F.lit("The student is practicing the skill '"), F.col(skill), F.lit("'."))
    second = F.concat(F.lit("Before these attempts, the student's cumulative accuracy on this skill was "), shown, F.lit("."))
    return df.withColumn(into, F.when(F.size(steps) > 0, F.concat_ws(" ", first, second, F.array_join(F.transform(steps, line), " "))))


def step_table(steps) -> Column:
    """Attempts as a table in Markdown."""
    cell = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    row = lambda s: F.concat(F.lit("| "), F.concat_ws(" | ", cell(s["step"]), cell(s["correct"]), cell(s["hint_count"]), F.coalesce(F.format_string("%.3f", s["response_time_ratio"]), F.lit("None"))), F.lit(" |"))
    head = F.array(F.lit("| step | correct | hint_count | response_time_ratio |"), F.lit("|---|---|---|---|"))
    return F.array_join(F.concat(head, F.transform(steps, row)), "\n")


def render_case_prompt(targets: DataFrame, shots: DataFrame | None, intro: str, closing: str, fold: str = "fold", premise: str = "record_premise", claim: str = "sentence_text", tag: str = "majority_tag", into: str = "prompt") -> DataFrame:
    """A prompt for each target: the introduction, the fold's examples (premise, claim, tag, rationale) and the target.

    shots: rows of examples with their fold and ``shot`` number, few for each fold; None for a prompt without any.
    """
    case = lambda p, c: F.concat(F.lit("Premise:\n"), p, F.lit("\nClaim: "), c)
    target = F.concat(F.lit("### Target\n"), case(F.col(premise), F.col(claim)))
    if shots is None:
        return targets.withColumn(into, F.concat_ws("\n\n", F.lit(intro), target, F.lit(closing)))
    why = F.when(F.coalesce(F.col("rationale"), F.lit("")) != "", F.concat(F.lit("\nRationale: "), F.col("rationale"))).otherwise("") if "rationale" in shots.columns else F.lit("")
    block = F.concat(case(F.col(premise), F.col(claim)), F.lit("\nLabel: "), F.col(tag), why)
    gathered = shots.groupBy(fold).agg(F.array_sort(F.collect_list(F.struct("shot", block.alias("b")))).alias("_s"))
    text = F.array_join(F.transform("_s", lambda x, i: F.concat(F.lit("### Example "), (i + 1).cast("string"), F.lit("\n"), x["b"])), "\n\n")
    out = targets.join(gathered, fold, "left")
    return out.withColumn(into, F.concat_ws("\n\n", F.lit(intro), text, target, F.lit(closing))).drop("_s")


def mask_donor_skill(df: DataFrame, text: str, donor: str = "donor_skill", host: str = "host_skill", mark: str = "that skill") -> DataFrame:
    """The donor's skill as plain text replaced where host and donor differ."""
    differ = (F.coalesce(F.col(donor), F.lit("")) != "") & (F.col(donor) != F.coalesce(F.col(host), F.lit("")))
    return df.withColumn(text, F.when(differ, F.replace(F.col(text), F.col(donor), F.lit(mark))).otherwise(F.col(text)))


def lexicon_filter(df: DataFrame, pattern: str, text: str = "text", keep: bool = True) -> DataFrame:
    """Rows whose text does (or does not) match the lexicon, in any case; a null text matches nothing."""
    hit = F.coalesce(F.col(text).rlike(f"(?i){pattern}"), F.lit(False))
    return df.filter(hit if keep else ~hit)


def clean_narrative(df: DataFrame, lang: str = "en", text: str = "raw_text", threshold: float = 0.6) -> DataFrame:
    """Echoed evidence off, split, sanitised and de-duplicated: sentences and had_repetition."""
    out = df.withColumn("sentences", sanitize(cited_sentences(strip_echoed_bullets(text, lang)), lang))
    return dedupe_narrative(out, threshold)


