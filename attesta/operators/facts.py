"""Indicators to symbolic facts: array<struct<indicator, status, value, note>> and texts about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import lexicon as fixed
from attesta.functions.columns import col, mapped


def fact(indicator, status: str, value=None, note="") -> Column:
    value = F.lit(None).cast("double") if value is None else value
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(indicator).alias("indicator"), F.lit(status).alias("status"), value.alias("value"), lit(note).alias("note"))


def _value(name: str) -> Column:
    return F.coalesce(F.col(f"m_{name}").cast("double"), F.lit(0.0))


def triad_fact(lang: str = "en", hint="hint_scaled", sc: str | None = "sc") -> Column:
    """What the three confidence indicators say together; the largest is HIGH even below the high threshold."""
    scores = [_value(n) for n in fixed.TRIAD]
    weak = F.greatest(*scores) <= F.lit(fixed.WEAK)
    s = F.col(sc) if sc else F.lit(None).cast("double")
    says = fixed.TRIAD_DIRECTION[lang]
    lean = F.when(s.isNull(), "").when(s < 0.5 - fixed.SC_BAND, says["guess"]).when(s > 0.5 + fixed.SC_BAND, says["struggle"]).otherwise(says["mid"])
    before, after = fixed.TRIAD_AMBIGUOUS[lang].split("{direction}")
    top = F.array_max(F.array(*[F.struct(v.alias("v"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, (v, n) in enumerate(zip(scores, fixed.TRIAD, strict=True))]))
    begin, end = fixed.TRIAD_DOMINANT[lang].split("{dominant}")
    named = F.concat(F.lit(begin), top["n"], F.lit(end))
    ambiguous = fact("confidence_triad", "AMBIGUOUS", None, F.concat(F.lit(before), lean, F.lit(after)))
    return F.when(weak, fact("confidence_triad", "LOW", None, fixed.TRIAD_INACTIVE[lang])).when(F.col(hint) <= fixed.HINT_ZERO, ambiguous).otherwise(fact(top["n"], "HIGH", top["v"], named))


def confidence_triad(df: DataFrame, lang: str = "en", into: str = "triad", **names) -> DataFrame:
    return df.withColumn(into, triad_fact(lang, **names))


def symbolic_facts(df: DataFrame, lang: str = "en", into: str = "facts", **names) -> DataFrame:
    """The triad and the six simple indicators that are above the weak threshold; a note where two overlap."""
    both = (_value("overconfidence") > fixed.HIGH) & (_value("slipping") > fixed.HIGH)
    found = [triad_fact(lang, **names)]
    for name in fixed.SIMPLE:
        v = _value(name)
        note = F.when(both, fixed.OVERLAP_NOTE[lang]).otherwise("") if name in ("overconfidence", "slipping") else ""
        found.append(F.when(v > fixed.HIGH, fact(name, "HIGH", v, note)).when(v > F.lit(fixed.WEAK), fact(name, "LOW", v, fixed.WEAK_NOTE[lang])))
    return df.withColumn(into, F.array_compact(F.array(*found)))


def raw_facts(df: DataFrame, lang: str = "en", into: str = "facts") -> DataFrame:
    return df.withColumn(into, F.array(*[fact(n, "RAW", _value(n), fixed.RAW_NOTE[lang]) for n in fixed.INDICATORS]))


def explode_facts(df: DataFrame, *keys: str, facts="facts") -> DataFrame:
    """A row for each fact: keys, pos, indicator, status, value, note."""
    return df.select(*keys, F.posexplode(facts).alias("pos", "f")).select(*keys, "pos", "f.*")


def strip_instructions(note) -> Column:
    """Without the parts in brackets."""
    return F.trim(F.regexp_replace(col(note), r"\s*\[[^\]]*\]\s*", " "))


def fixed3(value) -> Column:
    """Three decimals, without grouping."""
    return F.format_string("%.3f", col(value))


def premise_text(indicator, status, value, note, lang: str = "en") -> Column:
    """The fact as a sentence, with its note."""
    i, s, v, n = (col(x) for x in (indicator, status, value, note))
    a, b, c = fixed.PREMISE_RAW[lang].replace("{v}", "{i}").split("{i}")
    raw = F.concat(F.lit(a), i, F.lit(b), fixed3(v), F.lit(c))
    d, e, f = fixed.PREMISE_STATUS[lang].replace("{s}", "{i}").split("{i}")
    plain = F.concat(F.lit(d), i, F.lit(e), s, F.lit(f))
    known = mapped(fixed.DESCRIPTION[lang], i)
    base = F.when((s == "HIGH") & known.isNotNull(), known).when((s == "RAW") & v.isNotNull(), raw).otherwise(plain)
    return F.when(F.coalesce(n, F.lit("")) != "", F.concat(base, F.lit(" "), strip_instructions(n))).otherwise(base)


def fact_category(indicator, sc) -> Column:
    """The category of a fact; an ambiguous triad is Struggle above the confidence band, else Reliability."""
    i, s = col(indicator), col(sc)
    triad = F.when(s > 0.5 + fixed.SC_BAND, "Struggle").otherwise("Reliability")
    return F.when(i == "confidence_triad", triad).otherwise(mapped(fixed.CATEGORY, i))


def dominant_fact(df: DataFrame, facts="facts", sc="sc") -> DataFrame:
    """dominant_indicator, category and has_signal of the HIGH or AMBIGUOUS fact of the largest value (unknown: 0.5; first on ties)."""
    strong = F.filter(facts, lambda f: f["status"].isin("HIGH", "AMBIGUOUS"))
    best = F.array_max(F.transform(strong, lambda f, i: F.struct(F.coalesce(f["value"], F.lit(0.5)).alias("v"), (-i).alias("o"), f["indicator"].alias("n"))))
    out = df.withColumn("dominant_indicator", best["n"])
    out = out.withColumn("category", fact_category("dominant_indicator", sc))
    return out.withColumn("has_signal", F.col("category").isNotNull())


FACT_LINE = r"^\s*\[([^\]]+)\]\s*([A-Za-z_]+)\s*(?::\s*(.*))?$"


def parse_fact_strings(df: DataFrame, lines: str, *keys: str) -> DataFrame:
    """Rows (keys, indicator, status, note) of "[indicator] STATUS: note" texts; the last of a repeated indicator wins.

    Texts of another form are counted in n_unmatched, on a row without indicator if nothing else matches.
    """
    one = lambda x: F.struct(F.regexp_extract(x, FACT_LINE, 1).alias("indicator"), F.regexp_extract(x, FACT_LINE, 2).alias("status"), F.regexp_extract(x, FACT_LINE, 3).alias("note"))
    parsed = df.select(*keys, F.transform(F.col(lines), one).alias("_all"))
    parsed = parsed.withColumn("n_unmatched", F.size(F.filter("_all", lambda f: f["indicator"] == "")))
    good = F.filter("_all", lambda f: f["indicator"] != "")
    last = F.filter(F.transform(good, lambda f, i: F.struct(f.alias("f"), i.alias("i"))), lambda x: ~F.exists(F.slice(good, x["i"] + 2, F.greatest(F.size(good), F.lit(1))), lambda g: g["indicator"] == x["f"]["indicator"]))
    return parsed.select(*keys, "n_unmatched", F.explode_outer(last).alias("x")).select(*keys, "n_unmatched", "x.f.*")


def facts_block(df: DataFrame, lang: str = "en", facts="facts", context: dict | None = None, into: str = "facts_block") -> DataFrame:
    """The evidence as lines: ambiguous, high and raw facts; LOW facts are left out. ``context``: skill and step columns."""
    t = fixed.BLOCK[lang]

    def fill(template, f, value):
        out = [F.lit("")]
        for part in _parts(template):
            out.append({"{i}": f["indicator"], "{n}": f["note"], "{v}": value}.get(part, F.lit(part)))
        return F.concat(*out)

    def line(f):
        a, b = t["value"].split("{v}")
        value = F.when(f["value"].isNotNull(), F.concat(F.lit(a), fixed3(f["value"]), F.lit(b))).otherwise("")
        return F.when(f["status"] == "AMBIGUOUS", fill(t["ambiguous"], f, value)).when(f["status"] == "HIGH", fill(t["high"], f, value)).when(f["status"] == "RAW", fill(t["raw"], f, fixed3(f["value"])))

    lines = F.array_compact(F.transform(facts, line))
    body = F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(t["none"])
    head = [F.lit(t["context"]), *[F.concat(F.lit(t[k]), F.col(c).cast("string")) for k, c in (context or {}).items()], F.lit("")]
    return df.withColumn(into, F.concat_ws("\n", *(head if context else []), F.lit(t["evidence"]), body))


def _parts(template: str) -> list[str]:
    import re

    return [p for p in re.split(r"(\{[ivn]\})", template) if p]


def build_messages(df: DataFrame, system: Column | str, instruction: str, block="facts_block", into: str = "messages") -> DataFrame:
    """array<struct<role, content>> of a system text (a column, for one that depends on the condition) and the evidence."""
    system = system if isinstance(system, Column) else F.lit(system)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    user = F.concat(F.col(block), F.lit("\n\n"), F.lit(instruction))
    return df.withColumn(into, F.array(message("system", system), message("user", user)))


def template_narrative(df: DataFrame, lang: str = "en", facts="facts") -> DataFrame:
    """Adds sentences array<struct<text, cited>> and raw_text: one fixed sentence for each strong fact."""
    strong = F.filter(facts, lambda f: f["status"].isin("HIGH", "AMBIGUOUS"))
    a, b = fixed.TEMPLATE_OTHER[lang].split("{i}")

    def sentence(f):
        ambiguous = F.when(F.coalesce(f["note"], F.lit("")) != "", strip_instructions(f["note"])).otherwise(fixed.TEMPLATE_AMBIGUOUS[lang])
        plain = F.coalesce(mapped(fixed.DESCRIPTION[lang], f["indicator"]), F.concat(F.lit(a), f["indicator"], F.lit(b)))
        return F.struct(F.when(f["status"] == "AMBIGUOUS", ambiguous).otherwise(plain).alias("text"), F.array(f["indicator"]).alias("cited"))

    none = F.array(F.struct(F.lit(fixed.TEMPLATE_NONE[lang]).alias("text"), F.array().cast("array<string>").alias("cited")))
    out = df.withColumn("sentences", F.when(F.size(strong) > 0, F.transform(strong, sentence)).otherwise(none))
    tagged = lambda s: F.when(F.size(s["cited"]) > 0, F.concat(s["text"], F.lit(" ["), F.array_join(s["cited"], ","), F.lit("]"))).otherwise(s["text"])
    return out.withColumn("raw_text", F.array_join(F.transform("sentences", tagged), " "))
