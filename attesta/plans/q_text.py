"""Queries of sections D, E and G: narrative texts, verification and study design."""

from pyspark.sql import functions as F

from attesta.functions import lexicon as fixed
from attesta.operators import design as ds
from attesta.operators import facts as fx
from attesta.operators import indicators as ind
from attesta.operators import text as tx
from attesta.operators import verify as vf
from attesta.plans import bindings as b
from attesta.plans.q_indicators import FACTS, PREMISE, TABLE, fact_rows
from attesta.plans.registry import query
from attesta.sources.scratch import written

r6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})
q = lambda s: "'" + s.replace("'", "''") + "'"
PT = "chr(57344)"
STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
NARR = f"na as ({b.NARRATIVES})"
# sentences of the narratives: text, tags after and inside, as a list in order
SENT = f"""{NARR}, pr as (select narrative_id, lang, source, regexp_replace(regexp_replace({STRIP('raw_text')}, '([0-9])\\.([0-9])', '\\1' || {PT} || '\\2', 'g'), '([0-9])\\.([0-9])', '\\1' || {PT} || '\\2', 'g') as t from na),
m as (select narrative_id, lang, source, regexp_extract_all(t, '([^.!?]*[.!?])\\s*((?:\\[[^\\]]+\\]\\s*)*)', 1) as s, regexp_extract_all(t, '([^.!?]*[.!?])\\s*((?:\\[[^\\]]+\\]\\s*)*)', 2) as g from pr),
u as (select narrative_id, lang, source, unnest(s) as s, unnest(g) as g, unnest(range(len(s))) as i from m),
v as (select narrative_id, lang, source, i, replace({STRIP('s')}, {PT}, '.') as s, replace(g, {PT}, '.') as g from u), w as (select * from v where s <> ''),
se as (select narrative_id, lang, source, row_number() over (partition by narrative_id order by i) - 1 as pos, {STRIP("regexp_replace(s, '\\s*\\[[^\\]]+\\]\\s*', ' ', 'g')")} as text,
  list_concat(regexp_extract_all(g, '\\[([^\\]]+)\\]', 1), regexp_extract_all(s, '\\[([^\\]]+)\\]', 1)) as tags from w)"""


def sents(spark, d):
    return tx.explode_sentences(tx.split_cited_sentences(b.narratives(spark, d)), "narrative_id", "lang", "source")


@query("d1_split_cited_sentences", f"with {SENT} select narrative_id, pos::int as pos, text, array_to_string(list_sort(list_distinct(tags)), ';') as cited from se")
def d1(spark, d):
    return sents(spark, d).select("narrative_id", "pos", "text", F.array_join(F.array_sort("cited"), ";").alias("cited"))


@query("d2_split_numbered_lines", f"""with l as (select doc_id as narrative_id, unnest(string_split(text, chr(10))) as x, unnest(range(len(string_split(text, chr(10))))) as i from documents),
n as (select narrative_id, i, regexp_replace({STRIP("'1. ' || x || ' [slipping]'")}, '^\\s*\\d+[\\.\\)]\\s*', '') as x from l),
c as (select narrative_id, i, {STRIP("regexp_replace(x, '\\s*\\[[^\\]]+\\]\\s*', ' ', 'g')")} as text from n)
select narrative_id, (row_number() over (partition by narrative_id order by i) - 1)::int as pos, text, 'slipping' as cited from c where text <> ''""")
def d2(spark, d):
    docs = b.documents(spark, d)
    text = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("1. "), x, F.lit(" [slipping]"))), "\n")
    out = tx.split_numbered_lines(docs.select(F.col("doc_id").alias("narrative_id"), text.alias("t")), "t")
    return tx.explode_sentences(out, "narrative_id").withColumn("cited", F.array_join("cited", ";"))


@query("d3_strip_echoed_bullets", "select doc_id, replace(text, 'The ', chr(10) || 'The ') as text from documents")
def d3(spark, d):
    marked = F.replace(F.col("text"), F.lit("The "), F.lit("\n - [slipping] status=HIGH. echoed\nThe "))
    return b.documents(spark, d).select("doc_id", tx.strip_echoed_bullets(marked).alias("text"))


@query("d4_strip_thinking", f"""with t as (select doc_id, case when doc_id % 2 = 0 then '<think>a' || chr(10) || 'b</think>' || text else text || '<think>never ends' end as t from documents),
c as (select *, contains(t, '<think>') and not contains(t, '</think>') as cut from t)
select doc_id, case when cut then '' else {STRIP("regexp_replace(t, '(?s)<think>.*?</think>', '', 'g')")} end as text, coalesce(cut, false) as truncated_in_thinking from c""")
def d4(spark, d):
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<think>a\nb</think>"), F.col("text"))).otherwise(F.concat(F.col("text"), F.lit("<think>never ends")))
    return tx.strip_thinking(b.documents(spark, d).select("doc_id", t.alias("text")), "text")


LEAK = "|".join(f"(?:{p})" for p in fixed.LEAKED["en"])
FLAG_SQL = {
    "is_leaked": f"regexp_matches(text, {q(LEAK)})", "is_code": f"regexp_matches(text, {q(fixed.CODE)})", "is_recommends": f"regexp_matches(text, {q(fixed.RECOMMENDATION['en'])})",
    "is_foreign": f"regexp_matches(text, {q(fixed.FOREIGN)})", "is_latin": f"regexp_matches(text, {q(fixed.LATIN)})", "is_hangul": f"regexp_matches(text, {q(fixed.HANGUL)})", "is_typos": f"len(regexp_extract_all(text, {q(fixed.TYPO)})) >= 2",
}


@query("d5_sentence_flags", f"with {SENT} select narrative_id, pos::int as pos, {', '.join(f'{v} as {k}' for k, v in FLAG_SQL.items())} from se")
def d5(spark, d):
    return tx.sentence_flags(sents(spark, d)).select("narrative_id", "pos", *FLAG_SQL)


@query("d5_flag_rates", f"with {SENT}, f as (select source, {', '.join(f'{v} as {k}' for k, v in FLAG_SQL.items())} from se) select source, count(*) as n, {', '.join(f'round(avg({k}::int), 6) as rate_{k}' for k in FLAG_SQL)} from f group by 1")
def d5b(spark, d):
    return r6(tx.flag_rates(tx.sentence_flags(sents(spark, d)), ["source"], list(FLAG_SQL)), *[f"rate_{k}" for k in FLAG_SQL])


BAD = " or ".join(FLAG_SQL[k] for k in ("is_leaked", "is_code", "is_recommends", "is_foreign", "is_hangul"))
SANE = f"""{SENT}, sa as (select narrative_id, lang, source, pos, {STRIP(f"regexp_replace(regexp_replace(text, {q(fixed.VARIABLE_NAME)}, '', 'g'), '\\s{{2,}}', ' ', 'g')")} as text, tags from se where not ({BAD})),
sn as (select narrative_id, lang, source, row_number() over (partition by narrative_id order by pos) - 1 as pos, text, tags from sa where text <> '')"""


@query("d6_sanitize_sentences", f"with {SANE} select narrative_id, pos::int as pos, text, array_to_string(list_sort(list_distinct(tags)), ';') as cited from sn")
def d6(spark, d):
    out = tx.sanitize_sentences(tx.split_cited_sentences(b.narratives(spark, d)))
    return tx.explode_sentences(out, "narrative_id").select("narrative_id", "pos", "text", F.array_join(F.array_sort("cited"), ";").alias("cited"))


@query("d7_dedupe_narrative")
def d7(spark, d):
    out = tx.dedupe_narrative(tx.split_cited_sentences(b.narratives(spark, d)).select("narrative_id", "sentences"))
    return out.select("narrative_id", F.size("sentences").alias("n_kept"), "had_repetition", F.md5(F.array_join(F.transform("sentences", lambda s: s["text"]), "\n")).alias("texts_md5"))


FIXED = f"{SENT}, fx as (select *, list_transform(flatten(list_transform(tags, lambda t: string_split(t, ','))), lambda t: case trim(t) when 'lucky_gues' then 'lucky_guess' else trim(t) end) as f from se)"


@query("d8_correct_citations", f"with {FIXED} select narrative_id, pos::int as pos, array_to_string(list_sort(list_distinct(f)), ';') as cited from fx")
def d8(spark, d):
    out = tx.correct_citations(sents(spark, d).select("narrative_id", "pos", "cited"), fixed.INDICATORS)
    return out.withColumn("cited", F.array_join(F.array_sort("cited"), ";"))


@query("d9_citation_check", f"""with {SENT}, c as (select narrative_id, len(tags) = 0 as un, len(list_filter(tags, lambda t: t not in ('overconfidence', 'slipping'))) > 0 as inv from se)
select narrative_id, count(*) as n_sentences, count(*) filter (un) as n_uncited, count(*) filter (inv) as n_invalid_reference, round((count(*) filter (un) + count(*) filter (inv)) / count(*)::double, 6) as structural_violation_rate from c group by 1""")
def d9(spark, d):
    return r6(tx.citation_check(sents(spark, d), ["narrative_id"], ["overconfidence", "slipping"]), "structural_violation_rate")


DEFI, HEDG = ("(?i)" + "|".join(f"(?:{p})" for p in x["en"]) for x in (fixed.DEFINITIVE, fixed.HEDGE))
HEDGED = "case doc_id % 4 when 0 then ' It was a guess.' when 1 then ' It CLEARLY may be.' when 2 then ' Possibly so.' else '' end"


@query("d10_hedge_violation", f"with t as (select doc_id, text || {HEDGED} as t from documents) select doc_id, regexp_matches(t, {q(DEFI)}) and not regexp_matches(t, {q(HEDG)}) as violates from t")
def d10(spark, d):
    t = F.concat(F.col("text"), F.expr(HEDGED))
    return b.documents(spark, d).select("doc_id", tx.hedge_violation(t).alias("violates"))


@query("d11_translation_suspect", f"""with t as (select doc_id, coalesce(case when doc_id % 3 = 0 then text when doc_id % 3 = 1 then '학생 ' || regexp_replace(text, '[A-Za-zÀ-ɏ]+', '가', 'g') else ' ' end, '') as t from documents)
select doc_id, {STRIP("t")} = '' or not regexp_matches(t, {q(fixed.HANGUL)}) or regexp_matches(t, {q(fixed.LATIN)}) as suspect from t""")
def d11(spark, d):
    t = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("학생 "), F.regexp_replace("text", r"[A-Za-zÀ-ɏ]+", "가"))).otherwise(F.lit(" "))
    return b.documents(spark, d).select("doc_id", tx.translation_suspect(t).alias("suspect"))


CITE_TEXT = "case doc_id % 5 when 0 then '[''slipping'', ''' || source || ''']' when 1 then 'slipping; not a tag | high' when 2 then 'nan' when 3 then 'a1,_b,2c' else '' end"


STRIP_QUOTES = f"""regexp_replace({STRIP("x")}, '^[''"]+|[''"]+$', '', 'g')"""
WORDS = "(" + ", ".join(q(w) for w in fixed.STATUS_WORDS) + ")"


@query("d12_parse_citation_field", f"""with t as (select doc_id, coalesce({STRIP(CITE_TEXT)}, '') as t from documents),
p as (select doc_id, case when lower(t) in ('', 'nan', 'none', '[]') then []::varchar[] else regexp_split_to_array(t, '[,;|\\[\\]]') end as parts from t),
c as (select doc_id, list_filter(list_transform(parts, lambda x: {STRIP(STRIP_QUOTES)}), lambda x: x <> '' and lower(x) not in {WORDS}) as parts from p)
select doc_id, array_to_string(list_filter(parts, lambda x: regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_]*$')), ';') as citations, array_to_string(list_filter(parts, lambda x: not regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_]*$')), ';') as invalid_citations from c""")
def d12(spark, d):
    text = F.expr("case doc_id % 5 when 0 then concat('[\\'slipping\\', \\'', source, '\\']') when 1 then 'slipping; not a tag | high' when 2 then 'nan' when 3 then 'a1,_b,2c' else '' end")
    out = tx.parse_citation_field(b.documents(spark, d).select("doc_id", text.alias("t")), "t")
    return out.select("doc_id", F.array_join("citations", ";").alias("citations"), F.array_join("invalid_citations", ";").alias("invalid_citations"))


@query("d13_clean_indicator_token", "select doc_id, 'slipping;' || regexp_extract(source, '^([a-zA-Z_]+)', 1) || ';lucky_guess' as cleaned, 2 as n_messy from documents")
def d13(spark, d):
    c = F.array(F.lit(" slipping"), F.concat("source", F.lit(" x")), F.lit("9z"), F.lit("lucky_guess]"))
    out = tx.clean_indicator_token(b.documents(spark, d).select("doc_id", c.alias("c")), "c")
    return out.select("doc_id", F.array_join("cleaned", ";").alias("cleaned"), "n_messy")


JUDGED = """case (conv_id + turn) % 4 when 0 then 'Sure:' || chr(10) || json_object('label', ' Partial', 'confidence_supported', '70', 'reasoning', text)::varchar || ' done'
 when 1 then 'Sure:' || chr(10) || json_object('label', 'maybe', 'confidence_supported', 'high', 'reasoning', text)::varchar || ' done'
 when 2 then '{ not json ' || regexp_replace(text, '[{}]', '', 'g') || '}' else regexp_replace(text, '[{}]', '', 'g') end"""


@query("d14_parse_judge_json", f"""with t as (select conv_id, turn, regexp_extract(coalesce({JUDGED}, ''), '(?s)\\{{.*\\}}', 0) as span from conversations),
j as (select *, span = '' or not json_valid(span) as parse_failed from t),
f as (select *, case when not parse_failed then span::json end as j from j),
l as (select *, lower({STRIP("json_extract_string(j, '$.label')")}) as label from f)
select conv_id, turn, case when label in ({", ".join(q(t) for t in fixed.TAGS)}) then label end as pred_label, try_cast(json_extract_string(j, '$.confidence_supported') as double) as pred_confidence_supported,
 case when not parse_failed then coalesce(json_extract_string(j, '$.reasoning'), '') end as pred_reasoning, parse_failed from l""")
def d14(spark, d):
    c = b.table(spark, d, "conversations")
    body = lambda label, conf: F.concat(F.lit("Sure:\n"), F.to_json(F.struct(F.lit(label).alias("label"), F.lit(conf).alias("confidence_supported"), F.col("text").alias("reasoning"))), F.lit(" done"))
    k = (F.col("conv_id") + F.col("turn")) % 4
    t = F.when(k == 0, body(" Partial", "70")).when(k == 1, body("maybe", "high")).when(k == 2, F.concat(F.lit("{ not json "), F.regexp_replace("text", r"[{}]", ""), F.lit("}"))).otherwise(F.regexp_replace("text", r"[{}]", ""))
    out = tx.parse_judge_json(c.withColumn("t", t), "t")
    return out.select("conv_id", "turn", "pred_label", "pred_confidence_supported", F.when(~F.col("parse_failed"), F.col("pred_reasoning")).alias("pred_reasoning"), "parse_failed")


@query("d15_yes_no_score", """with e as (select event_id, json_extract_string(props, '$.k')::int as k from events), p as (select event_id, case when k % 7 = 0 then 0 else exp(-k / 100.0::double) + exp(-3.0::double) end as y, case when k % 7 = 0 then 0 else exp(-1.0::double) end as n from e)
select event_id, round(y, 6) as p_yes_raw, round(n, 6) as p_no_raw, round(y / nullif(y + n, 0), 6) as score from p""")
def d15(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    tok = lambda t, lp: F.struct(F.lit(t).alias("token"), lp.alias("logprob"))
    rows = F.when(k % 7 == 0, F.array(tok("maybe", F.lit(0.0)))).otherwise(F.array(tok(" Yes", -k / 100.0), tok("YES", F.lit(-3.0)), tok("no ", F.lit(-1.0)), tok("nope", F.lit(-0.5))))
    out = tx.yes_no_score(b.table(spark, d, "events").select("event_id", rows.alias("top_logprobs")))
    return r6(out, "p_yes_raw", "p_no_raw", "score").drop("top_logprobs")


CONTEXT = f"""{TABLE}, cx as (select row_id, student_id, skill, step_idx, skill_cum_accuracy, list({{'i': step_idx, 'c': correct, 'h': hint_raw::bigint, 'r': response_time_ratio}}) over (partition by student_id, skill order by step_idx rows between 3 preceding and current row) as st from inds)"""


def context(spark, d):
    return ds.item_context(ind.indicator_table(b.interactions(spark, d)))


@query("d16_record_premise", f"""with {CONTEXT}, s as (select row_id, unnest(st) as x, unnest(range(len(st))) as i from cx),
l as (select row_id, string_agg('On attempt ' || (i + 1) || ', the student answered ' || case x.c when 1 then 'correctly' else 'incorrectly' end || ', ' || case x.h when 0 then 'used no hints' when 1 then 'used 1 hint' else 'used ' || x.h || ' hints' end || ', and took ', ' ' order by i) as t, round(sum(x.r), 4) as ratios from s group by 1)
select cx.row_id, 'The student is practicing the skill ''' || skill || '''. Before these attempts, the student''s cumulative accuracy on this skill was ' || case when skill_cum_accuracy is null then 'unknown' else round_even(skill_cum_accuracy * 100, 0)::int || '%' end || '. ' || t as words, ratios from cx join l on l.row_id = cx.row_id""")
def d16(spark, d):
    out = tx.record_premise(context(spark, d))
    words = F.regexp_replace("record_premise", r"and took (\S+ times their own average response time\.)", "and took ")
    total = F.aggregate("steps", F.lit(0.0), lambda a, s: a + s["response_time_ratio"])
    return out.select("row_id", F.regexp_replace(words, r"\s+$", " ").alias("words"), F.round(total, 4).alias("ratios"))


@query("d17_render_case_prompt", "with t as (select conv_id, turn, conv_id % 3 as fold, text from conversations) select conv_id, turn, 'Judge.' || chr(10) || chr(10) || '### Example 1' || chr(10) || 'Premise:' || chr(10) || 'p' || fold || chr(10) || 'Claim: c' || chr(10) || 'Label: partial' || chr(10) || chr(10) || '### Example 2' || chr(10) || 'Premise:' || chr(10) || 'q' || chr(10) || 'Claim: c' || chr(10) || 'Label: unknown' || chr(10) || chr(10) || '### Target' || chr(10) || 'Premise:' || chr(10) || text || chr(10) || 'Claim: says' || chr(10) || chr(10) || 'Answer.' as prompt from t")
def d17(spark, d):
    targets = b.table(spark, d, "conversations").select("conv_id", "turn", (F.col("conv_id") % 3).alias("fold"), F.col("text").alias("record_premise"), F.lit("says").alias("sentence_text"))
    fold = targets.select("fold").distinct()
    first = fold.select("fold", F.lit(1).alias("shot"), F.concat(F.lit("p"), F.col("fold").cast("string")).alias("record_premise"), F.lit("c").alias("sentence_text"), F.lit("partial").alias("majority_tag"))
    second = fold.select("fold", F.lit(2).alias("shot"), F.lit("q").alias("record_premise"), F.lit("c").alias("sentence_text"), F.lit("unknown").alias("majority_tag"))
    return tx.render_case_prompt(targets, second.unionByName(first), "Judge.", "Answer.").select("conv_id", "turn", "prompt")


@query("d18_mask_donor_skill", "select doc_id, case when doc_id % 2 = 0 then replace(text, 'the', 'that skill') else text end as text from documents")
def d18(spark, d):
    docs = b.documents(spark, d).select("doc_id", "text", F.lit("the").alias("donor_skill"), F.when(F.col("doc_id") % 2 == 0, "of").otherwise("the").alias("host_skill"))
    return tx.mask_donor_skill(docs, "text").select("doc_id", "text")


@query("d19_lexicon_filter", f"with {SENT} select narrative_id, pos::int as pos from se where regexp_matches(text, '(?i)tion|heit')")
def d19(spark, d):
    return tx.lexicon_filter(sents(spark, d), "tion|heit").select("narrative_id", "pos")


# cited sentences about each interaction, and its facts
SCEN = f"""{FACTS}, st as (select row_id, 0 as pos, 'The student showed signs of boredom and it was a guess.' as text, case row_id % 4 when 0 then [] when 1 then ['confidence_triad'] when 2 then ['no_such'] else ['strategic_help', 'cognitive_avoidance'] end as cited from inds
 union all select row_id, 1, 'The student may have used hints.', ['cognitive_avoidance'] from inds),
fp as (select *, {PREMISE} as premise from numbered), wd as (select 'The student showed signs of boredom and it was a guess.' as text, ['the', 'student', 'showed', 'signs', 'of', 'boredom', 'and', 'it', 'was', 'a', 'guess'] as ws union all select 'The student may have used hints.', ['the', 'student', 'may', 'have', 'used', 'hints']),
pw as (select *, list_distinct(list_filter(regexp_split_to_array(lower(premise), '[^a-z0-9]+'), lambda w: w <> '')) as pws from fp),
sco as (select st.row_id, st.pos, st.text, st.cited, pw.indicator, pw.status as fs, pw.pos as fpos, len(list_intersect(pws, ws)) / len(ws)::double as score from st join wd using (text) join pw on pw.row_id = st.row_id),
sg as (select row_id, bool_or(status in ('HIGH', 'AMBIGUOUS')) as signal from numbered group by 1)"""
HV = "pos = 0"  # the first sentence is definitive, the second hedges


def written_facts(spark, d):
    """(row_id, facts), computed once: queries that join them several times would plan all of the indicators each time."""
    return written(fact_rows(spark, d).select("row_id", "facts"), "facts")


def scene(spark, d):
    base = written_facts(spark, d)
    s = F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("The student showed signs of boredom and it was a guess.").alias("text"), F.expr("case row_id % 4 when 0 then cast(array() as array<string>) when 1 then array('confidence_triad') when 2 then array('no_such') else array('strategic_help', 'cognitive_avoidance') end").alias("cited")),
        F.struct(F.lit(1).alias("pos"), F.lit("The student may have used hints.").alias("text"), F.array(F.lit("cognitive_avoidance")).alias("cited")),
    )
    sentences = base.select("row_id", F.inline(s))
    return sentences, fx.explode_facts(base, "row_id"), base


@query("e1_score_pairs", f"with {SCEN} select row_id, pos::int as pos, indicator, round(score, 6) as score from sco")
def e1(spark, d):
    s, f, _ = scene(spark, d)
    pairs = s.select("row_id", "pos", "text").join(f.select("row_id", "indicator", fx.premise_text("indicator", "status", "value", "note").alias("premise")), "row_id")
    return r6(vf.score_pairs(pairs), "score").select("row_id", "pos", "indicator", "score")


VERDICTS = f"""{SCEN}, ci as (select st.row_id, st.pos, unnest(cited) as indicator from st), cf as (select ci.*, sco.fs, sco.score from ci left join sco on sco.row_id = ci.row_id and sco.pos = ci.pos and sco.indicator = ci.indicator),
ag as (select row_id, pos, min(score) as score, bool_or(fs is null) as missing, bool_or(coalesce(fs = 'AMBIGUOUS', false)) as amb from cf group by 1, 2),
vd as (select st.row_id, st.pos, st.cited, ag.score, case when len(st.cited) = 0 then case when signal then 'FAIL_NO_CITATION' else 'PASS_NO_SIGNAL' end when missing then 'FAIL_INVALID_REF' when amb and st.{HV} then 'FAIL_HEDGE' when ag.score >= 0.3::double then 'PASS' else 'FAIL_NLI' end as status from st join sg using (row_id) left join ag on ag.row_id = st.row_id and ag.pos = st.pos)"""


def verdicts(spark, d):
    s, f, _ = scene(spark, d)
    return vf.verify_cited(s, f, threshold=0.3)


@query("e2_verify_cited", f"with {VERDICTS} select row_id, pos::int as pos, status, case when status in ('PASS', 'FAIL_NLI', 'FAIL_HEDGE') then round(score, 6) end as score from vd")
def e2(spark, d):
    return r6(verdicts(spark, d), "score").select("row_id", "pos", "status", "score")


@query("e3_verify_best_match", f"""with {SCEN}, r as (select *, row_number() over (partition by row_id, pos order by score desc, fpos) as n from sco where fs in ('HIGH', 'AMBIGUOUS', 'RAW')), o as (select * from r where n = 1)
select st.row_id, st.pos::int as pos, round(o.score, 6) as score, o.indicator as matched_indicator, case when o.row_id is null then 'PASS_NO_SIGNAL' when fs = 'AMBIGUOUS' and st.{HV} then 'FAIL_HEDGE' when o.score >= 0.3::double then 'PASS_INFERRED' else 'FAIL_NLI_UNCITED' end as status from st left join o on o.row_id = st.row_id and o.pos = st.pos""")
def e3(spark, d):
    s, f, _ = scene(spark, d)
    return r6(vf.verify_best_match(s, f, threshold=0.3), "score").select("row_id", "pos", "status", "score", "matched_indicator")


SUMS = ", ".join(f"count(*) filter (status = '{s}') as \"{s}\"" for s in vf.STATUSES)
SUMMARY = f"""select {{k}}, count(*) as n_sentences, round(count(*) filter (status like 'PASS%') / count(*)::double, 6) as faithfulness_rate, round(count(*) filter (status in ('FAIL_NLI', 'FAIL_NLI_UNCITED', 'FAIL_INVALID_REF')) / count(*)::double, 6) as hallucination_rate,
 round(count(*) filter (status = 'FAIL_HEDGE') / count(*)::double, 6) as hedge_violation_rate, round(count(*) filter (status = 'FAIL_NO_CITATION') / count(*)::double, 6) as structural_violation_rate,
 round(count(*) filter (status like 'PASS%') / nullif(count(*) filter (status <> 'FAIL_NO_CITATION'), 0)::double, 6) as conditional_faithfulness_rate, round(count(*) filter (status in ('FAIL_NLI', 'FAIL_NLI_UNCITED', 'FAIL_INVALID_REF')) / nullif(count(*) filter (status <> 'FAIL_NO_CITATION'), 0)::double, 6) as conditional_hallucination_rate,
 count(*) filter (status <> 'FAIL_NO_CITATION') as n_content_eligible, {SUMS} from {{t}} group by {{k}}"""
RATES = ["faithfulness_rate", "hallucination_rate", "hedge_violation_rate", "structural_violation_rate", "conditional_faithfulness_rate", "conditional_hallucination_rate"]


@query("e4_summarize_verification", f"with rs as ({b.RUNS}) " + SUMMARY.format(k="condition, run_id", t="rs"))
def e4(spark, d):
    return r6(vf.summarize_verification(b.run_status(spark, d), ["condition", "run_id"]), *RATES)


@query("e5_threshold_report", f"with {VERDICTS}, t(threshold) as (values (0.5::double), (0.4::double), (0.3::double), (0.2::double), (0.1::double)) select threshold, count(*) as n_scored, count(*) filter (score >= threshold) as n_would_pass, round(count(*) filter (score >= threshold) / count(*)::double, 6) as pass_rate from vd cross join t where status in ('PASS', 'FAIL_NLI') group by 1")
def e5(spark, d):
    return r6(vf.threshold_report(verdicts(spark, d), []), "pass_rate")


@query("e6_structural_violation", f"with {SCEN} select st.row_id, case when any_value(signal) then round(avg((len(cited) = 0)::int), 6) else 0 end as structural_violation_rate from st join sg using (row_id) group by 1")
def e6(spark, d):
    s, f, base = scene(spark, d)
    return r6(vf.structural_violation(s, f, base), "structural_violation_rate")


COND = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v).lower() for v in c) + ")" for c in vf.CONDITIONS)


@query("e7_run_conditions", f"""with base as ({b.INTERACTIONS}), c(condition, "group", use_stage1, require_citation, use_llm, use_stage3, uncited_eval) as (values {COND})
select row_id, condition, "group", use_stage1, require_citation, use_llm, use_stage3, uncited_eval, case when use_stage1 then 'symbolic' else 'raw' end as facts_shown, case when not use_stage3 then 'none' when uncited_eval then 'best_match' else 'cited' end as verification_path from base cross join c""")
def e7(spark, d):
    return vf.run_conditions(b.interactions(spark, d).select("row_id"))


@query("e7_verify_conditions", f"""with {VERDICTS}, r as (select *, row_number() over (partition by row_id, pos order by score desc, fpos) as n from sco where fs in ('HIGH', 'AMBIGUOUS', 'RAW')), o as (select * from r where n = 1),
bm as (select st.row_id, st.pos, case when o.row_id is null then 'PASS_NO_SIGNAL' when fs = 'AMBIGUOUS' and st.{HV} then 'FAIL_HEDGE' when o.score >= 0.3::double then 'PASS_INFERRED' else 'FAIL_NLI_UNCITED' end as status from st left join o on o.row_id = st.row_id and o.pos = st.pos)
select 'full' as condition, status, count(*) as n from vd group by 2 union all select 'naive', status, count(*) from bm group by 2""")
def e7b(spark, d):
    s, f, base = scene(spark, d)
    runs = vf.run_conditions(base.select("row_id"), [c for c in vf.CONDITIONS if c[0] in ("full", "naive", "ablate_stage3")])
    three = F.explode(F.array(F.lit("full"), F.lit("naive"), F.lit("ablate_stage3")))
    out = vf.verify_conditions(runs, s.withColumn("condition", three), f.withColumn("condition", three), threshold=0.3)
    return out.groupBy("condition", "status").agg(F.count(F.lit(1)).alias("n"))


@query("e8_condition_means", f"with rs as ({b.RUNS}), su as ({SUMMARY.format(k='condition, run_id', t='rs')}) select condition, count(*) as n, round(avg(faithfulness_rate), 5) as mean_faithfulness_rate, round(avg(conditional_faithfulness_rate), 5) as mean_conditional_faithfulness_rate, count(faithfulness_rate) as n_faithfulness_rate, count(conditional_faithfulness_rate) as n_conditional_faithfulness_rate from su group by 1")
def e8(spark, d):
    s = vf.summarize_verification(b.run_status(spark, d), ["condition", "run_id"])
    out = vf.condition_means(r6(s, *RATES), ["condition"], ["faithfulness_rate", "conditional_faithfulness_rate"])
    return out.withColumns({c: F.round(c, 5) for c in ("mean_faithfulness_rate", "mean_conditional_faithfulness_rate")})


@query("e9_stable_key", f"with base as ({b.INTERACTIONS}) select row_id, md5('42|' || skill || '|' || student_id) as k from base")
def e9(spark, d):
    return b.interactions(spark, d).select("row_id", vf.run_seed(42, F.col("skill"), F.col("student_id")).alias("k"))


LK = "lk as (select l_orderkey as item_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as sentence_id, l_discount::double as auto_entailment, case l_returnflag when 'A' then 'FAIL_INVALID_REF' else 'PASS' end as auto_status, l_orderkey % 5 = 0 as rec from lineitem)"


def line_key(spark, d):
    text = "select l_orderkey as item_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as sentence_id, cast(l_discount as double) as auto_entailment, case l_returnflag when 'A' then 'FAIL_INVALID_REF' else 'PASS' end as auto_status, l_orderkey % 5 = 0 as rec from {lineitem}"
    return spark.sql(text, lineitem=b.table(spark, d, "lineitem"))


@query("e10_align_scores", f"with {LK} select item_id, sentence_id, case when rec then 0.9::double when auto_status = 'FAIL_INVALID_REF' then 0 else auto_entailment end as auto_entailment, case when rec then 'RECOVERED:inferred_negative_control' else auto_status end as auto_status, round(100 * case when rec then 0.9::double when auto_status = 'FAIL_INVALID_REF' then 0 else auto_entailment end, 6) as confidence_supported from lk where item_id % 3 <> 0")
def e10(spark, d):
    k = line_key(spark, d)
    rec = k.filter("rec").select("item_id", "sentence_id", F.lit(0.9).alias("recovered_entailment"), F.lit("inferred_negative_control").alias("recovery_method"))
    other = k.filter("not rec").select("item_id", "sentence_id", F.lit(0.1).alias("recovered_entailment"), F.lit("recovered_from_tag_residue").alias("recovery_method"))
    return r6(vf.align_scores(k, rec.unionByName(other), keys=k.filter("item_id % 3 <> 0")), "confidence_supported")


CASES = f"""{FACTS}, fp as (select *, {PREMISE} as premise from numbered), ca as (select row_id as item_id, case row_id % 4 when 0 then [] when 1 then ['cognitive_avoidance'] when 2 then ['strategic_help', 'cognitive_avoidance'] else ['no_such'] end as cites, row_id % 7 as n_raters, sc, skill from inds where row_id % 7 >= 1),
cx as (select item_id, unnest(cites) as indicator, unnest(range(len(cites))) as p from ca), cj as (select cx.item_id, count(*) as n, count(fp.premise) as k, string_agg(fp.premise, ' ' order by p) as t from cx left join fp on fp.row_id = cx.item_id and fp.indicator = cx.indicator group by 1),
cs as (select ca.item_id, n_raters, array_to_string(cites, ';') as citations, case when n = k then t end as fact_premise, case when len(cites) = 1 then cites[1] end as indicator, n_raters >= 5 as is_core from ca left join cj using (item_id))"""


def cases(spark, d):
    base = written_facts(spark, d)
    summary = base.select(F.col("row_id").alias("item_id"), F.lit("S1").alias("sentence_id"), F.lit("partial").alias("majority_tag"), F.lit("partial:1").alias("tag_distribution"), (F.col("row_id") % 7).alias("n_raters"))
    key = base.select(F.col("row_id").alias("item_id"), F.lit("S1").alias("sentence_id"), F.expr("case row_id % 4 when 0 then '' when 1 then 'cognitive_avoidance' when 2 then 'strategic_help; cognitive_avoidance' else '[no_such]' end").alias("cited_indicators"))
    texts = base.select(F.col("row_id").alias("item_id"), F.lit("S1").alias("sentence_id"), F.lit("t").alias("sentence_text"))
    return vf.build_cases(summary, texts, key, fx.explode_facts(base, "row_id").withColumnRenamed("row_id", "item_id"))


@query("e11_build_cases", f"with {CASES} select * from cs")
def e11(spark, d):
    return cases(spark, d).select("item_id", "n_raters", F.array_join("citations", ";").alias("citations"), "fact_premise", "indicator", "is_core")


@query("e12_validate_cases", f"with {CASES} select count(*) as n_cases, count(distinct item_id) as n_items, count(*) filter (citations <> '') as n_cited, count(fact_premise) as n_fact_premise, count(*) filter (citations <> '' and fact_premise is null) as n_missing_fact, count(fact_premise) = 0 as no_premise, count(fact_premise) / count(*) filter (citations <> '')::double < 0.5 as under_half from cs")
def e12(spark, d):
    return vf.validate_cases(cases(spark, d))


@query("e13_core_item_scores", f"with {VERDICTS} select row_id, pos::int as pos, status from vd where row_id in (select c_custkey from customer)")
def e13(spark, d):
    s, f, _ = scene(spark, d)
    core = b.table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"))
    out = vf.verify_cited(s.join(core, "row_id", "left_semi"), f, threshold=0.3)
    return out.select("row_id", "pos", "status")


@query("e14_item_source_rows", f"with {TABLE} select o_orderkey as item_id, inds.row_id, round(sc, 6) as sc, hint_raw from orders join inds on inds.row_id = o_custkey where o_orderkey % 3 <> 0")
def e14(spark, d):
    internal = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("NC-"), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit("IT-"), F.col("o_custkey").cast("string")))
    key = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), internal.alias("internal_item_id"))
    return r6(vf.item_source_rows(key, ind.indicator_table(b.interactions(spark, d))), "sc").select("item_id", "row_id", "sc", "hint_raw")


# items are the orders; categories their priorities
IT = "it as (select o_orderkey as item_id, o_orderpriority as category, o_orderstatus as skill, o_totalprice::double as v from orders)"


def items(spark, d):
    return b.table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("skill"), F.col("o_totalprice").cast("double").alias("v"))


@query("g1_candidate_pool", f"with {IT}, r as (select *, row_number() over (partition by category order by md5('5|' || item_id), item_id) as n, count(*) over (partition by category) as c from it) select item_id, category from r where c <= 100 or n <= 40")
def g1(spark, d):
    return ds.candidate_pool(items(spark, d), 200, 5, key="item_id", whole=100).select("item_id", "category")


@query("g2_item_context", f"with {CONTEXT} select row_id, len(st)::int as n_steps, st[1].i as first_step, round(list_sum(list_transform(st, lambda s: s.h)), 6)::double as hints, round(skill_cum_accuracy, 6) as accuracy from cx")
def g2(spark, d):
    hints = F.aggregate("steps", F.lit(0.0), lambda a, s: a + s["hint_count"])
    return context(spark, d).select("row_id", F.size("steps").alias("n_steps"), F.col("steps")[0]["step"].alias("first_step"), F.round(hints, 6).alias("hints"), F.round("skill_cum_accuracy", 6).alias("accuracy"))


TER = f"{IT}, te as (select *, case when v <= (select quantile_cont(v, 1 / 3.0::double) from it) then 'low' when v <= (select quantile_cont(v, 2 / 3.0::double) from it) then 'mid' else 'high' end as tertile from it)"


@query("g3_tertiles", f"with {TER} select item_id, tertile from te")
def g3(spark, d):
    return ds.tertiles(items(spark, d), "v").select("item_id", "tertile")


PICK = f"{TER}, ce as (select *, row_number() over (partition by category, tertile order by md5('3|' || item_id), item_id) as n from te), pk as (select * from ce where n <= 8 order by md5('3|all|' || item_id), item_id limit 100)"


@query("g4_stratified_sample", f"with {PICK} select item_id, category, tertile from pk")
def g4(spark, d):
    return ds.stratified_sample(ds.tertiles(items(spark, d), "v"), 100, 8, 3, key="item_id").select("item_id", "category", "tertile")


@query("g4_stratum_report", f"with {PICK}, a as (select category, tertile, count(*) as n_available from te group by 1, 2), s as (select category, tertile, count(*) as c from pk group by 1, 2) select a.*, coalesce(c, 0) as n_sampled, greatest(0, 7 - coalesce(c, 0)) as shortfall from a left join s using (category, tertile)")
def g4b(spark, d):
    all_ = ds.tertiles(items(spark, d), "v")
    return ds.stratum_report(all_, ds.stratified_sample(all_, 100, 8, 3, key="item_id"), 7)


@query("g5_negative_controls", f"""with {IT}, o as (select *, md5('9|' || item_id) as h, row_number() over (order by category, md5('9|' || item_id), item_id) - 1 as p from it), z as (select max(c) as x, sum(c) as t from (select count(*) as c from it group by category))
select a.item_id as host, d.item_id as donor, a.category as host_category, d.category as donor_category from o a, z join o d on d.p = (a.p + z.x) % z.t where a.category <> d.category order by a.h, a.item_id limit 300""".replace("from o a, z join o d on", "from o a cross join z join o d on"))
def g5(spark, d):
    return ds.negative_controls(items(spark, d), 300, 9)


@query("g6_assign_raters", f"""with {IT}, w as (select *, row_number() over (partition by category order by md5('4|' || item_id), item_id) as n from it), p as (select *, row_number() over (order by n, category, item_id::varchar) - 1 as p from w)
select item_id, rater, true as in_core from p cross join (values ('R1'), ('R2'), ('R3')) r(rater) where p < 50 union all select item_id, ['R1', 'R2', 'R3'][((p - 50) % 3)::int + 1], false from p where p >= 50""")
def g6(spark, d):
    return ds.assign_raters(items(spark, d), ["R1", "R2", "R3"], 50, 4)


@query("g7_spaced_order", f"""with {IT}, r as (select item_id, 'R' || (item_id % 3) as rater, item_id % 10 = 0 as ctl from it), s as (select *, count(*) over (partition by rater) as n, count(*) filter (ctl) over (partition by rater) as k, row_number() over (partition by rater, ctl order by md5('8|' || rater || '|' || item_id), item_id) - 1 as m from r)
select rater, ctl as is_negative_control, m, case when ctl then m * (n // k) else m + least(k, m // ((n // k) - 1) + 1) end as position from s""")
def g7(spark, d):
    rows = items(spark, d).select("item_id", F.concat(F.lit("R"), (F.col("item_id") % 3).cast("string")).alias("rater"), (F.col("item_id") % 10 == 0).alias("is_negative_control"))
    from pyspark.sql import Window

    out = ds.spaced_order(rows, 8)
    m = F.row_number().over(Window.partitionBy("rater", "is_negative_control").orderBy("position")) - 1
    return out.select("rater", "is_negative_control", m.cast("long").alias("m"), "position")


@query("g8_display_ids", f"with {IT} select item_id, printf('Q%05d', row_number() over (order by md5('2|' || item_id) || '|' || item_id)) as display_id from it")
def g8(spark, d):
    return ds.display_ids(items(spark, d), 2, width=5).select("item_id", "display_id")


def study(spark, d):
    cited = lambda name: F.array(F.lit(name), F.col("skill"))
    s = F.array(F.struct(F.concat(F.lit("one "), F.col("category")).alias("text"), cited("slipping").alias("cited")), F.struct(F.lit("two").alias("text"), cited("lucky_guess").alias("cited")))
    i = items(spark, d).withColumns({"sentences": s, "is_negative_control": F.col("item_id") % 4 == 0, "steps": F.array().cast("array<int>"), "skill_cum_accuracy": F.lit(0.5), "internal_item_id": F.concat(F.lit("IT-"), F.col("item_id").cast("string"))})
    return i.withColumn("display_id", F.concat(F.lit("Q"), F.col("item_id").cast("string")))


@query("g9_public_items", f"with {IT} select 'Q' || item_id as item_id, skill, 2 as n_sentences, 'S1=one ' || category || ';S2=two' as sentences from it")
def g9(spark, d):
    out = ds.public_items(study(spark, d))
    return out.select("item_id", "skill", F.size("sentences").alias("n_sentences"), F.array_join(F.transform("sentences", lambda s: F.concat(s["id"], F.lit("="), s["en"])), ";").alias("sentences"))


@query("g9_sentence_key", f"with {IT} select 'Q' || item_id as display_id, 'S1' as sentence_id, 'one ' || category as sentence_en, 'slipping;' || skill as cited_indicators from it where item_id % 4 <> 0 union all select 'Q' || item_id, 'S2', 'two', 'lucky_guess;' || skill from it where item_id % 4 <> 0")
def g9b(spark, d):
    return ds.sentence_key(study(spark, d))


@query("g9_answer_key", f"with {IT} select 'Q' || item_id as display_id, 'IT-' || item_id as internal_item_id, item_id % 4 = 0 as is_negative_control, category from it")
def g9c(spark, d):
    return ds.answer_key(study(spark, d))


@query("g10_generation_quality", f"with {IT} select count(*) as n, round(avg((item_id % 6 = 0)::int), 6) as share_invalid, round(avg((item_id % 5) / 100.0::double), 6) as mean_violation, avg((item_id % 6 = 0)::int) > 0.1 or avg((item_id % 5) / 100.0::double) > 0.1 as warning from it")
def g10(spark, d):
    df = items(spark, d).select(F.when(F.col("item_id") % 6 != 0, 1.0).alias("mean_entailment"), ((F.col("item_id") % 5) / 100).alias("structural_violation_rate"))
    return r6(ds.generation_quality(df), "share_invalid", "mean_violation")


FOLD = f"{IT}, fo as (select *, (ntile(7) over (order by md5('6|' || item_id) || '|' || item_id) - 1)::int as fold from it)"


@query("g11_folds", f"with {FOLD} select item_id, fold from fo")
def g11(spark, d):
    return ds.folds(items(spark, d), 7, 6).select("item_id", "fold")


@query("g12_few_shot_select", f"""with {FOLD}, f(fold) as (select unnest(range(7))::int), e as (select f.fold, fo.fold as own_fold, item_id, category, row_number() over (partition by f.fold, category order by md5('1|' || item_id), item_id) as m from fo join f on f.fold <> fo.fold),
s as (select *, row_number() over (partition by fold order by m, category) as shot from e) select fold, own_fold, item_id, category, shot::int as shot from s where shot <= 12""")
def g12(spark, d):
    f = ds.folds(items(spark, d), 7, 6)
    return ds.few_shot_select(f, 12, 7, 1, label="category", key="item_id").select("fold", "own_fold", "item_id", "category", "shot")


@query("g13_shuffled_records", f"""with {IT}, v as (select it.*, x.variant from it cross join (values (1), (2)) x(variant)), h as (select *, md5('11|' || variant || '|' || item_id) as h from v),
c as (select *, lead(item_id) over (partition by variant, skill order by h, item_id) as nx, first_value(item_id) over (partition by variant, skill order by h, item_id) as fs from h) select variant, item_id, coalesce(nx, fs) as donor, true as same_skill from c""")
def g13(spark, d):
    return ds.shuffled_records(items(spark, d), 2, 11)
