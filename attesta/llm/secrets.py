"""Secret scans on column expressions only: fixed patterns, and high-entropy windows of candidate strings.

Positions come from splitting a text at a pattern: the pieces before the matches and the matches themselves give
every start, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import as_struct, need, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
#: A run of at least so many characters is the same as all runs without the shorter ones, as runs are maximal.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: Candidate strings of the entropy scan, by character class: pattern, window, least bits per character.
CLASSES = {
    "entropy_hex": (r"(?<![0-9A-Za-z])[0-9A-F]{20,}(?![0-9A-Za-z])", 20, 3.0),
    "entropy_base64": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}", 24, 3.9),
}
#: Characters that a whole candidate must have.
HAS = {"entropy_hex": (), "entropy_base64": ("[0-9]", "[A-Z]", "[a-z]")}
#: Candidates that are no secrets: examples, placeholders, one repeated pair, identifiers in dashed groups.
ALLOW = r"(?i)example|placeholder|changeme|xxxx|^(.{1,4})\1+$|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[a-z]+([-_/][a-z]+)+$"

#: What a text must have for any match but those of ``assign``: most texts are searched no further.
RUN = r"[A-Za-z0-9+/_-]{16}"

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")


#: Values that are added up in one go, so that many matches in a text cost in proportion.
BLOCK = 64
#: Characters of a text that a cut looks at.
PIECE = 4096
MATCHES = "array<struct<match:string,start:int,end:int>>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, add) -> Column:
    """What the values (int, at least 0) before each come to: their sum or, by another ``add``, their maximum."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def each(part, start):
        step = lambda a, x: F.struct(add(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(part, start, step, lambda a: a["out"])

    def use(all_):
        blocks = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int"))
        part = lambda k: F.slice(all_, k * BLOCK + 1, BLOCK)
        firsts = each(F.transform(blocks, lambda k: F.aggregate(part(k), F.lit(0), add)), begin)
        inside = lambda k, first: each(part(k), F.struct(first.alias("at"), begin["out"].alias("out")))
        return F.flatten(_let(firsts, lambda f: F.transform(blocks, lambda k: inside(k, F.element_at(f, k + 1)))))

    return _let(values, lambda v: F.when(F.size(v) > 0, use(v)).otherwise(begin["out"]))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<match, start, end>> of the leftmost non-overlapping matches; positions in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    steps = F.filter(F.arrays_zip(found.alias("match"), gaps.alias("gap")), lambda p: p["match"].isNotNull())
    size = lambda p: p["gap"] + F.char_length(p["match"])
    put = lambda p, at: F.struct(p["match"].alias("match"), (at + p["gap"]).alias("start"), (at + size(p)).alias("end"))
    placed = _let(steps, lambda all_: F.zip_with(all_, running(F.transform(all_, size), lambda a, b: a + b), put))
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast(MATCHES))


def entropy_peak(value: Column, window: int) -> Column:
    """Largest Shannon entropy, in bits per character, of any ``window`` characters of ``value``; null if shorter.

    Each step takes in one character and lets one go; the sum of c log2 c changes by those two counts alone.
    """
    chars = F.split(value, "")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    begin = F.struct(none.alias("n"), F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("peak"))

    def weight(c):
        return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def change(acc, char, by):
        def use(x):
            n, rest = x["n"], F.map_filter(acc["n"], lambda k, _: k != x["char"])
            counts = F.map_concat(rest, F.map_from_arrays(F.array(x["char"]), F.array(n + by)))
            return F.struct(counts.alias("n"), (acc["s"] + weight(n + by) - weight(n)).alias("s"), acc["peak"].alias("peak"))

        return _let(F.struct(char.alias("char"), F.coalesce(F.element_at(acc["n"], char), F.lit(0)).alias("n")), use)

    def leave(acc, i):
        return F.when(i > window, change(acc, F.element_at(chars, F.greatest(i - window, F.lit(1))), -1)).otherwise(acc)

    def measure(acc, i):
        bits = F.log2(F.lit(float(window))) - acc["s"] / F.lit(window)
        return F.struct(acc["n"].alias("n"), acc["s"].alias("s"), F.when(i >= window, F.greatest(acc["peak"], bits)).otherwise(acc["peak"]).alias("peak"))

    def move(acc, i):
        taken = change(acc, F.element_at(chars, i), 1)
        return _let(taken, lambda x: _let(leave(x, i), lambda y: measure(y, i)))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(value)), begin, move, lambda acc: acc["peak"])


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))


def _secret(base: Column, window: int, least: float, has: tuple[str, ...]):
    """Whether a candidate has the characters ``has``, is off the allow list, in no base span and of high entropy."""

    def use(m):
        free = ~F.exists(base, lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"]))
        fits = F.lit(True)
        for part in has:
            fits &= m["match"].rlike(part)
        return fits & ~m["match"].rlike(ALLOW) & free & (entropy_peak(m["match"], window) >= least)

    return use


def _found(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, text, base, spans): ``docs`` as one struct, so that no column name of its can clash."""
    text = F.col("text")
    value = lambda m: F.char_length(F.regexp_extract(m["match"], ASSIGN, 2)) >= ASSIGN_VALUE
    out = docs.select(as_struct(docs).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    out = out.withColumn("long", text.rlike(RUN))
    run = lambda pattern: F.when(F.col("long"), matches(text, pattern)).otherwise(F.array().cast(MATCHES))
    base = F.concat(_spans(F.filter(matches(text, ASSIGN), value), "assign"), _spans(run(ACCESS), "access"), _spans(run(HEX), "hex"))
    out = out.withColumn("base", base)
    parts = [F.col("base")]
    for kind, (pattern, window, least) in CLASSES.items():
        parts.append(_spans(F.filter(run(pattern), _secret(F.col("base"), window, least, HAS[kind])), kind))
    return out.withColumn("spans", F.array_sort(F.concat(*parts)))


def find_secrets(docs: DataFrame, text_col: str = "text", into: str = "secrets") -> DataFrame:
    """Adds ``into``: array<struct<start, kind, end>>, by start, then kind as in KINDS; other columns stay, but one of
    that name, whose place it takes.

    Base spans (assign, access, hex) are always kept. An entropy span is a candidate string with a window whose
    entropy reaches its class's threshold, unless it is on the allow list or a base span contains it whole. Defined cases:
    a null text counts as empty and has no span; positions are code points, the end exclusive; very long texts are
    searched whole; repeated rows are judged alike; an empty table gives no rows.
    """
    need(docs, text_col)
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() != into.lower()]
    return _found(docs, text_col).select(*kept, F.col("spans").alias(into))


def named_spans(spans: Column) -> Column:
    """"kind:start:end" of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def _redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text between the spans, and a mark for each run of overlapping ones. A cut goes to its own piece of the text,
    not through all that stands before it."""

    def use(pieces):
        piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))

        def between(a, b):
            i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
            several = F.concat(F.substring(piece(i), a % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(piece(j), F.lit(1), b % PIECE))
            return F.when(i == j, F.substring(piece(i), a % PIECE + 1, b - a)).otherwise(several)

        part = lambda s, at: F.when(s["start"] < at, F.lit("")).otherwise(F.concat(between(at, s["start"]), F.lit(mark)))
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        parts = F.zip_with(spans, running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), part)
        return F.concat(F.array_join(parts, ""), between(end, F.char_length(text)))

    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), use)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", size_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` with every span of :func:`find_secrets` replaced by ``mark``, overlapping ones by one mark;
    texts without a span stay as they are, null ones null. ``size_col``, if there is such a column, becomes the new
    number of characters where the text has changed. No column is added, whatever the names of the others."""
    need(docs, text_col)
    found = _found(docs, text_col)
    found = found.withColumn("clean", F.when(F.size("spans") > 0, _redacted(F.col("text"), F.col("spans"), mark)))
    cols = []
    for c in docs.columns:
        own = F.col(f"row.`{c}`")
        if c == text_col:
            own = F.coalesce("clean", own)
        elif c == size_col:
            own = F.when(F.col("clean").isNotNull(), F.char_length("clean").cast(docs.schema[c].dataType)).otherwise(own)
        cols.append(own.alias(c))
    return found.select(*cols)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), "text", "all_spans")
    base = F.filter("all_spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("all_spans", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(named_spans(base), 256).alias("base_sha256"), named_spans(F.col("all_spans")).alias("spans"))
